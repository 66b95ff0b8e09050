"""Cleaning rules, audits, evaluation, maintenance, training data."""

import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from cuelake.operators import audit as A, cleaning as C, evaluate as E, maintain as M, mldata as D
from cuelake.sources.logs import eval_curve, read_eval_report, read_logs, read_run_logs, read_trials, summary_json, write_report
from cuelake.sources.segments import read_segments_csv, segments_from_api_json, torn_lines
from cuelake.sources.store import (
    read_feature_store, read_planned_shards, shard_manifest, shard_plan, write_feature_store, write_planned_shards, write_sharded,
)

CSV = '''videoID,startTime,endTime,votes,category,hidden,actionType,videoDuration
abcdefghijk,10.5,20,3,sponsor,0,skip,100
abcdefghijk,5,5.5,9,sponsor,0,skip,100
" padded ",0,10,x,sponsor,,,100
abcdefghijk,0,10,3.0,sponsor,0,skip,100
abcdefghijk,0,10,4,sponsor,1,skip,100
abcdefghijk,0,10,4,sponsor,0,mute,100
abcdefghijk,nan,10,4,sponsor,0,skip,59
"q""uote",0,10,1,intro,0,skip,100
abcdefghijk,30,20,2.9,sponsor,0,full,100
short
'''


@pytest.fixture
def raw(spark, tmp_path):
    path = tmp_path / "segments.csv"
    path.write_text(CSV)
    return read_segments_csv(spark, str(path))


def test_csv_reader(raw):
    assert raw.count() == 10 and raw.filter("service IS NULL").count() == 10
    assert raw.filter("category = 'intro'").first()["videoID"] == 'q"uote'


def test_line_breaks_in_quotes_stay(spark, tmp_path):
    head = "videoID,startTime,endTime,votes,category,hidden,actionType,videoDuration\n"
    whole = 'a,1,2,3,"with, comma",0,"say ""hi""",100\nb,1,2,3,,0,"",100\n'
    torn = 'c,1,2,3,"two\nlines, ""quoted""\n",0,skip,100\nd,1,2,3,sponsor,0,skip,100\n'
    (tmp_path / "whole.csv").write_text(head + whole)
    (tmp_path / "torn.csv").write_text(head + torn)
    assert torn_lines(spark, str(tmp_path / "whole.csv")) == 0
    assert torn_lines(spark, str(tmp_path / "torn.csv")) == 2
    assert rows(read_segments_csv(spark, str(tmp_path)).select("videoID", "category", "videoDuration")) == [
        ("a", "with, comma", "100"), ("b", None, "100"), ("c", 'two\nlines, "quoted"\n', "100"), ("d", "sponsor", "100")]
    assert read_segments_csv(spark, str(tmp_path / "torn.csv"), multi_line=False).count() > 2


def test_rule_sets_disagree_as_intended(raw):
    # votes "x" and "3.0" count as 0 here, so they fall below the default floor
    assert rows(C.clean_segments(raw)) == [("abcdefghijk", 10500, 20000, 3)]
    assert ("padded", 0, 10000, 0) in rows(C.clean_segments(raw, min_votes=0))
    # floats are accepted and truncated, the order of the ends is not checked
    assert rows(C.clean_segments_bench(raw)) == [
        ("abcdefghijk", 0, 10000, 3), ("abcdefghijk", 0, 10000, 4), ("abcdefghijk", 5000, 5500, 9),
        ("abcdefghijk", 10500, 20000, 3), ("abcdefghijk", 30000, 20000, 2),
    ]
    # unparsable votes drop the row, short segments and other actions stay
    cached = raw.sparkSession.createDataFrame([("abcdefghijk",)], "video_id STRING")
    got = rows(C.clean_segments_audit(raw, cached).select("start_ms", "dur_ms", "votes", "in_cache"))
    assert got == [(0, 10000, 4, True), (5000, 500, 9, True), (10500, 9500, 3, True)]


def test_api_json(spark):
    df = spark.createDataFrame([
        ("a", '[{"segment":[1.5,9],"category":"sponsor","actionType":"skip"},{"segment":[1,2],"category":"sponsor","actionType":"mute"}]'),
        ("b", "{}"), ("c", ""), ("d", None),
    ], "video_id STRING, payload STRING")
    assert rows(segments_from_api_json(df)) == [("a", 1500, 9000)]


def windows(spark, vectors):
    return spark.createDataFrame(
        [(k, i, x) for k, v in vectors.items() for i, x in enumerate(v)], "video_id STRING, window_idx INT, label INT"
    )


def test_label_audit_figures(spark):
    w = windows(spark, {"a": [1, 1, 1, 0, 1], "b": [0, 0], "c": [0, 1, 0, 0, 0]})
    assert A.dataset_overview(w).first()[:4] == (3, 12, 5, 7)
    assert A.run_stats(w).first() == (3, pytest.approx(25 / 3), 5.0, 2)
    b = A.boundary_windows(w).first()
    assert (b["n_boundary"], b["n_positive"], b["noise"]) == (4, 5, "HIGH")
    p = A.positive_rate_profile(w).first()
    assert (p["n_zero"], p["n_over_labelled"], p["n_sparse"]) == (1, 1, 1)
    flags = {r["flag"] for r in A.audit_recommendations(A.label_audit(w)).collect()}
    assert flags == {"boundary_noise", "short_runs", "over_labelled"}
    calm = windows(spark, {"a": [0] * 90 + [1] * 10})
    assert [r["flag"] for r in A.audit_recommendations(A.label_audit(calm)).collect()] == ["none"]


def test_histogram_overflow_goes_to_the_last_bin(spark):
    df = spark.createDataFrame([(0.0,), (0.05,), (0.95,), (1.0,), (7.0,)], "x DOUBLE")
    assert [r["n"] for r in A.histogram(df, "x", 4, 0.0, 1.0).orderBy("bin").collect()] == [2, 0, 0, 3]


def scored(spark):
    data = [("a", 0, 1, 0.9), ("a", 1, 0, 0.6), ("a", 2, 1, 0.5), ("b", 0, 0, 0.1), ("b", 1, -1, 0.9), ("b", 2, 1, 0.2)]
    return spark.createDataFrame(data, "video_id STRING, window_idx INT, label INT, prob DOUBLE")


def test_confusion_strict_and_not(spark):
    df = scored(spark)
    assert E.confusion(df).first()[:4] == (1, 1, 2, 1)
    assert E.confusion(df, strict=False).first()[:4] == (2, 1, 1, 1)
    assert E.error_types(df).count() == 5
    assert E.error_types(df, ignored_as_tn=True).filter("error_type = 'TN'").count() == 2


def test_curve_rows_equal_single_confusions(spark):
    df = scored(spark)
    curve = E.threshold_curve(df, digits=None).collect()
    assert [r["threshold"] for r in curve] == E.CURVE
    for r in curve:
        c = E.confusion(df, r["threshold"]).first()
        assert (r["tp"], r["fp"], r["fn"], r["tn"]) == c[:4] and r["f1"] == pytest.approx(c["f1"])
    best = E.best_threshold(E.threshold_curve(df)).first()
    top = max(r["f1"] for r in curve)
    assert best["threshold"] == min(r["threshold"] for r in curve if r["f1"] == top)


def losses(spark, weight):
    data = [(0.3, 1, -0.2, weight), (-1.1, 0, 0.7, weight), (2.0, 0, 1.0, weight), (-0.4, 1, 2.5, weight)]
    return E.loss_report(spark.createDataFrame(data, "logit DOUBLE, label INT, teacher_logit DOUBLE, weight DOUBLE")).first()


def test_loss_weighting(spark):
    full, half, none = losses(spark, 1.0), losses(spark, 0.5), losses(spark, None)
    assert half["kd"] == pytest.approx(full["kd"] / 2) and none["kd"] == pytest.approx(full["kd"])
    one = E.loss_report(spark.createDataFrame([(0.0, 1, 0.0, 1.0)], "logit DOUBLE, label INT, teacher_logit DOUBLE, weight DOUBLE")).first()
    assert one["bce"] == pytest.approx(math.log(2)) and one["weighted_bce"] == pytest.approx(15 * math.log(2))
    assert one["focal"] == pytest.approx(0.25 * 0.25 * math.log(2))


def test_early_stop(spark):
    runs = {1: [0.1, 0.3, 0.3, 0.2, 0.9], 2: [0.0, 0.1, 0.2, 0.3, 0.4], 3: [0.0, 0.0, 0.0, 0.5, 0.1]}
    df = spark.createDataFrame(
        [(r, i + 1, f) for r, v in runs.items() for i, f in enumerate(v)], "run_id LONG, epoch INT, val_f1 DOUBLE"
    )
    got = rows(E.early_stop_replay(df, patience=2))
    assert got == [(1, 2, 0.3, 4, True), (2, 5, 0.4, 5, False), (3, 1, 0.0, 3, True)]


def test_trials(spark):
    df = spark.createDataFrame([
        (0, "COMPLETE", 0.2), (1, "PRUNED", 0.9), (2, "COMPLETE", 0.5), (3, "COMPLETE", 0.5), (4, "FAIL", None), (5, "COMPLETE", 0.4),
    ], "trial LONG, state STRING, val_f1 DOUBLE")
    assert tuple(E.trial_leaderboard(df).first()) == (4, 1, 1, 2, 0.5)
    assert rows(E.new_best_trials(df)) == [(0, 0.2), (2, 0.5)]


def test_work_selection(spark):
    segs = spark.createDataFrame([(v, 5) for v in "abcde"] + [("low", 1)], "video_id STRING, votes INT")
    cache = spark.createDataFrame([("a", True), ("b", False)], "video_id STRING, zero_audio BOOLEAN")
    skip = spark.createDataFrame([("c",)], "video_id STRING")
    pick = lambda mode, n=None: [r[0] for r in rows(M.select_work(segs, cache, skip, n, 3, mode))]
    assert pick("default") == ["d", "e"]
    assert pick("force") == ["a", "b", "d", "e"]
    assert pick("force_zero_audio") == ["a", "d", "e"]
    assert len(pick("default", 1)) == 1


def test_negative_cache(spark):
    df = spark.createDataFrame([
        ("a", 1, "none"), ("a", 2, "ok"), ("b", 1, "blocked"), ("c", 1, "none"), ("d", 1, "ok"),
    ], "video_id STRING, ts INT, outcome STRING")
    ids = spark.createDataFrame([(v,) for v in "abcde"], "video_id STRING")
    assert [r[0] for r in rows(M.caption_todo(ids, df))] == ["b", "e"]
    assert [r[0] for r in rows(M.caption_todo(ids, df, retry_failed=True))] == ["b", "c", "e"]


def test_merge_cache_inserts_only_absent(spark):
    old = spark.createDataFrame([("a", 1)], "video_id STRING, x INT")
    new = spark.createDataFrame([("a", 2), ("b", 2), ("b", 3)], "video_id STRING, x INT")
    assert rows(M.merge_cache(old, new)) == [("a", 1), ("b", 2), ("b", 3)]
    assert tuple(M.merge_report(old, new).first()) == (1, 2)


def test_split_is_stable_and_by_video(spark):
    df = spark.range(3000).select(F.concat(F.lit("v"), (F.col("id") % 1000).cast("string")).alias("video_id"))
    out = D.split_by_video(df)
    assert out.groupBy("video_id").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    share = {r["split"]: r["count"] / 3000 for r in out.groupBy("split").count().collect()}
    assert share["train"] == pytest.approx(0.7, abs=0.05) and share["val"] == pytest.approx(0.15, abs=0.04)


def test_balance(spark):
    w = windows(spark, {"a": [1, 0, 0, 0], "b": [0, 0]})
    got = {r["label"]: r["balance_weight"] for r in D.class_balance_weights(w).collect()}
    assert got == {1: 1.0, 0: pytest.approx(0.2)}
    empty = D.class_balance_weights(windows(spark, {"a": [0]})).first()
    assert empty["balance_weight"] is None
    big = spark.range(4000).select(F.lit("v").alias("video_id"), F.col("id").alias("window_idx"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    drawn = D.balanced_resample(D.class_balance_weights(big))
    counts = {r["label"]: r["count"] for r in drawn.groupBy("label").count().collect()}
    assert rows(drawn) == rows(D.balanced_resample(D.class_balance_weights(big.repartition(7))))  # drawn by key
    assert counts[0] == pytest.approx(2000, rel=0.1) and counts[1] == pytest.approx(2000, rel=0.1)


def test_sequences_pad_to_the_longest_of_the_batch(spark):
    w = windows(spark, {"a": [1, 0, 1], "b": [0]}).withColumn("vote_weight", F.lit(0.5)).withColumn("e", F.array(F.lit(2.0)))
    out = {r["video_id"]: r for r in D.assemble_sequences(w, 2, ["e"]).collect()}
    assert out["b"]["labels"] == [0, -1, -1] and out["b"]["weights"] == [0.5, 0.0, 0.0]
    assert out["b"]["e"] == [[2.0], [0.0], [0.0]] and out["b"]["length"] == 1 and out["a"]["pad_to"] == 3
    blocks = D.assemble_sequences(w, 2, block=2).groupBy("video_id").count()
    assert rows(blocks) == [("a", 2), ("b", 2)]


def test_context_needs_adjacent_windows(spark, monkeypatch):
    monkeypatch.setattr(D, "INDEX_CHUNK", 2)
    df = spark.createDataFrame([("a", i, 0.1 * i) for i in range(6)], "video_id STRING, window_idx INT, teacher_prob DOUBLE")
    out = {r["window_idx"]: r["context"] for r in D.context_features(df, 3).collect()}
    assert out[0] == [0.5, 0.5, 0.5] and out[2] == pytest.approx([0.1, 0.0, 0.5]) and out[5] == pytest.approx([0.4, 0.3, 0.2])
    old = {r["window_idx"]: r["context"] for r in D.context_features(df, 3, newest_first=False).collect()}
    assert old[5] == pytest.approx([0.2, 0.3, 0.4])


def test_teacher_default(spark):
    w = windows(spark, {"a": [1, 0, -1]})
    logits = spark.createDataFrame([("a", 1, 0.25)], "video_id STRING, window_idx INT, logit DOUBLE")
    got = rows(D.attach_teacher_logit(w, logits).select("window_idx", "teacher_logit"))
    assert got == [(0, 10.0), (1, 0.25), (2, 10.0)]


def test_heuristic_score_equals_the_layered_scorer(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    vec, audio = (rng.random((40, 128)) < 0.05).astype(float), rng.normal(size=(40, 13))
    x = np.hstack([vec, audio])
    group = lambda g: np.isin(np.arange(141) // 16, g) & (np.arange(141) < 128)
    layer1 = np.zeros((32, 141))
    for lo, hi, (a, wa), (b, wb) in ((0, 8, (0, .8), (4, .6)), (8, 16, (1, .65), (5, .5)), (16, 24, (2, .65), (6, .5)), (24, 28, (3, .45), (7, .35))):
        layer1[lo:hi, group(a)], layer1[lo:hi, group(b)] = wa, wb
    layer1[28:, 128:134], layer1[28:, 134:141], layer1[28:, :16] = 0.7, 0.25, 0.15
    h1 = np.maximum(0, x @ layer1.T + np.repeat([-.5, -.5, -.5, -.8, -.8], [8, 8, 8, 4, 4]))
    layer2 = np.zeros((16, 32))
    layer2[0:4, 0:8], layer2[4:8, 8:24], layer2[8:12, 28:], layer2[12:, 28:], layer2[12:, 24:28] = 1.2, 0.8, 1.0, 0.7, 0.3
    h2 = np.maximum(0, h1 @ layer2.T + np.repeat([-.3, -1.1, -.3, -1.5], 4))
    want = 1 / (1 + np.exp(-(h2 @ np.repeat([2.0, 1.6, 0.9, 1.3], 4) - 1.6)))
    df = spark.createDataFrame(
        [(i, [int(v) for v in vec[i]], [float(a) for a in audio[i]]) for i in range(40)], "i INT, k ARRAY<TINYINT>, m ARRAY<DOUBLE>"
    )
    got = df.orderBy("i").select(D.heuristic_score(F.col("k"), F.col("m")).alias("s")).collect()
    assert np.allclose([r["s"] for r in got], want)


def test_score_windows_marks_what_fails(spark):
    import numpy as np

    def load():
        def encode(texts):
            if "boom" in texts:
                raise RuntimeError("broken")
            return np.array([[len(t)] for t in texts], dtype=np.float32)
        return encode

    df = spark.createDataFrame([("a", 0, " "), ("a", 1, "four"), ("a", 2, "boom")], "video_id STRING, window_idx INT, text STRING").coalesce(1)
    for batch in (1, 32):
        got = rows(D.score_windows(df, load, 1, batch=batch).select("window_idx", F.get("text_emb", F.lit(0)), "text_emb_error"))
        assert got == [(0, 5.0, None), (1, 4.0, None), (2, None, "RuntimeError: broken")]


def test_classifier_learns_and_distills(spark):
    df = spark.range(400).select(
        F.concat(F.lit("v"), (F.col("id") % 40).cast("string")).alias("video_id"),
        (F.col("id") % 4 == 0).cast("int").alias("label"), F.rand(1).alias("noise"),
    ).withColumn("e", F.array(F.col("label") * 2.0 + F.col("noise"), F.col("noise"))).withColumn("vote_weight", F.lit(0.5))
    model = D.train_window_classifier(df, ["e"])
    assert E.confusion(D.apply_classifier(model, df, ["e"])).first()["f1"] > 0.95
    soft = df.withColumn("teacher_logit", F.when(F.col("label") == 1, 4.0).otherwise(-4.0))
    assert E.confusion(D.apply_classifier(D.distill(soft, ["e"]), df, ["e"])).first()["f1"] > 0.95


def test_feature_store_and_shards(spark, tmp_path):
    base = spark.createDataFrame([("a", 0, 1)], "video_id STRING, window_idx INT, label INT")
    short = base.withColumn("keyword_vec", F.array_repeat(F.lit(1).cast("tinyint"), 64))
    full = base.withColumn("keyword_vec", F.array_repeat(F.lit(1).cast("tinyint"), 128)).withColumn("mfcc_mean", F.array_repeat(F.lit(2.0), 13))
    path = str(tmp_path / "store")
    write_feature_store(short, path)
    write_feature_store(full, path)
    got = sorted((sum(r["keyword_vec"]), len(r["keyword_vec"]), r["mfcc_mean"][0]) for r in read_feature_store(spark, path).collect())
    assert got == [(64, 128, 0.0), (128, 128, 2.0)]
    names = spark.range(250).select(F.format_string("%05d.npz", "id").alias("name"))
    plan = shard_plan(names, "data")
    assert rows(plan.groupBy("shard_name").count()) == [("data", 100), ("data-s1", 100), ("data-s2", 50)]
    assert plan.filter("name = '00100.npz'").first()["shard"] == 1
    out = str(tmp_path / "shards")
    write_sharded(names, "name", out, 100, partitions=2)
    per_file = spark.read.parquet(out).groupBy(F.input_file_name().alias("f")).count()
    assert per_file.agg(F.max("count"), F.sum("count")).first() == (100, 250)


def test_planned_shards(spark, tmp_path):
    path = str(tmp_path / "planned")
    df = spark.range(257).select(F.format_string("%05d", F.col("id") % 250).alias("name"), "id").repartition(7)
    write_planned_shards(df, "name", path, "data", 100)
    assert sorted(p.name for p in (tmp_path / "planned").iterdir() if p.name.startswith("shard=")) == ["shard=data", "shard=data-s1", "shard=data-s2"]
    assert rows(shard_manifest(spark, path)) == [
        ("data", 100, 107, "00000", "00099"), ("data-s1", 100, 100, "00100", "00199"), ("data-s2", 50, 50, "00200", "00249")]
    # A folder that no manifest names is not part of the layout.
    df.limit(3).write.parquet(f"{path}/shard=stray")
    assert rows(read_planned_shards(spark, path).select("name", "id")) == rows(df)
    some = shard_manifest(spark, path).filter("first_key >= '00200'")
    assert read_planned_shards(spark, path, some).agg(F.min("name"), F.count("*")).first() == ("00200", 50)
    with pytest.raises(ValueError, match="null"):
        write_planned_shards(df.withColumn("name", F.lit(None).cast("string")), "name", str(tmp_path / "none"), "data")


def test_logs_of_mixed_shape(spark, tmp_path):
    logs = {
        "run": '{"phase": "student", "epochs": [{"epoch": 1}]}', "trials": '[{"trial": 0}]', "cut": '{"threshold_curve": [', "other": '{"a": 1}',
        "one": '{"phase": "teacher", "n_test_videos": 3, "test_loss": 0.25, "metrics_at_0.50": {"precision": 0.5, "recall": 1, "f1": 0.66},'
               ' "best_threshold": 0.4, "best_threshold_f1": 0.7, "threshold_curve": [{"threshold": 0.4, "f1": 0.7}, {"threshold": 0.1, "f1": 0.2}]}',
        "two": '{"test_loss": "n/a", "threshold_curve": [], "metrics_at_0.50": []}',
    }
    for name, text in logs.items():
        (tmp_path / f"{name}.json").write_text(text)
    found = read_logs(spark, str(tmp_path))
    assert rows(found.select("log_id", "kind")) == [
        ("cut", "broken"), ("one", "eval"), ("other", "other"), ("run", "epochs"), ("trials", "trials"), ("two", "eval")]
    reports = read_eval_report(found)
    assert rows(reports.drop("curve")) == [
        ("one", "teacher", 3, 0.25, 0.5, 1.0, 0.66, 0.4, 0.7), ("two", None, None, None, None, None, None, None, None)]
    assert rows(eval_curve(reports).select("log_id", "point", "threshold", "f1")) == [("one", 0, 0.4, 0.7), ("one", 1, 0.1, 0.2)]


def test_run_logs_and_reports(spark, tmp_path):
    (tmp_path / "run1.json").write_text(
        '{"phase":"teacher","best_epoch":2,"epochs":[{"epoch":1,"val_f1":0.1},{"epoch":2,"val_f1":0.4,"val_loss":0.3}]}'
    )
    log = read_run_logs(spark, str(tmp_path / "run1.json"))
    assert rows(log.select("run_id", "epoch", "val_f1")) == [("run1", 1, 0.1), ("run1", 2, 0.4)]
    (tmp_path / "trials.json").write_text('[{"trial":0,"state":"COMPLETE","val_f1":0.5,"params":{"lr":0.1}}]')
    assert read_trials(spark, str(tmp_path / "trials.json")).first()["params"] == {"lr": 0.1}
    for fmt in ("json", "csv"):
        write_report(log, str(tmp_path / fmt), fmt)
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    assert summary_json(log.agg(F.count(F.lit(1)).alias("n"))).first()["report"] == '{"n":2}'
