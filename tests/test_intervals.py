"""Metrics, coverage, labels, weights and range joins."""

import random

import pytest
from conftest import cue_table, rows
from pyspark.sql import functions as F

from cuelake.operators import intervals as I, windows as W

SPAN = "video_id STRING, start_ms LONG, end_ms LONG"

# (detected, truth) -> precision, recall, iou
PAIRS = {
    "both_empty": ([], [], (1, 1, 1)),
    "false_alarm": ([(10, 30)], [], (0, 1, 0)),
    "missed": ([], [(10, 30)], (1, 0, 0)),
    "exact": ([(10, 30)], [(10, 30)], (1, 1, 1)),
    "half": ([(20, 40)], [(10, 30)], (0.5, 0.5, 1 / 3)),
    "third": ([(5, 15)], [(0, 10)], (0.5, 0.5, 1 / 3)),
    "inside": ([(40, 60)], [(0, 100)], (1, 0.2, 0.2)),
    "around": ([(0, 100)], [(40, 60)], (0.2, 1, 0.2)),
    "apart": ([(0, 10)], [(20, 30)], (0, 0, 0)),
    "long": ([(0, 4000)], [(500, 1500), (3500, 5000)], (0.375, 0.6, 1500 / 5000)),
}


def spans(spark, which):
    return spark.createDataFrame(
        [(k, s * 1000, e * 1000) for k, v in PAIRS.items() for s, e in v[which]], SPAN
    )


def test_metric_values(spark):
    videos = spark.createDataFrame([(k,) for k in PAIRS], "video_id STRING")
    out = I.segment_metrics(spans(spark, 0), spans(spark, 1), videos).collect()
    assert len(out) == len(PAIRS)
    for r in out:
        want = PAIRS[r["video_id"]][2]
        assert (r["precision"], r["recall"], r["iou"]) == pytest.approx(want), r["video_id"]
        assert r["true_negative"] == (r["video_id"] == "both_empty")


def random_spans(rng, key, n, top=3_000_000):
    return [(key, s := rng.randint(0, top), s + rng.choice([0, 1000, 40_000, 1_500_000])) for _ in range(n)]


def test_intersection_and_coverage_equal_brute_force(spark):
    rng = random.Random(7)
    gt = random_spans(rng, "hot", 150) + random_spans(rng, "a", 5)
    det = random_spans(rng, "hot", 120) + random_spans(rng, "b", 4)
    g, d = spark.createDataFrame(gt, SPAN), spark.createDataFrame(det, SPAN)

    def union(items):
        out = []
        for s, e in sorted(items):
            if out and s <= out[-1][1]:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([s, e])
        return out

    def measure(key):
        a, b = (union([(s, e) for k, s, e in side if k == key]) for side in (gt, det))
        return sum(max(0, min(x[1], y[1]) - max(x[0], y[0])) for x in a for y in b)

    got = dict(rows(I.interval_intersection(g, d)))
    assert got == {k: measure(k) for k in ("hot", "a", "b")}
    assert got == dict(rows(I.interval_intersection(d, g)))  # symmetric
    cover = rows(I.gt_coverage(g, d).select("video_id", "start_ms", "end_ms", "overlap_ms"))
    want = sorted(
        (k, s, e, sum(max(0, min(e, y) - max(s, x)) for kk, x, y in det if kk == k)) for k, s, e in gt
    )
    assert cover == want


def test_first_match_equals_scan_in_start_order(spark):
    rng = random.Random(8)
    segs = random_spans(rng, "hot", 60, 400_000) + random_spans(rng, "a", 3, 400_000)
    ticks = [(k, i, rng.randint(0, 2_000_000)) for k in ("hot", "a", "none") for i in range(200)]
    t = spark.createDataFrame(ticks, "video_id STRING, tick_id INT, t_ms LONG")
    out = I.point_in_segments(t, spark.createDataFrame(segs, SPAN)).collect()
    assert len(out) == len(ticks)
    ordered = sorted(segs, key=lambda x: (x[1], x[2]))
    for r in out:
        hit = next(((s, e) for k, s, e in ordered if k == r["video_id"] and s <= r["t_ms"] <= e), None)
        assert r["in_segment"] == (hit is not None)
        assert (r["seg_start_ms"], r["seg_end_ms"]) == (hit or (None, None))


def grid(spark, lengths):
    return W.grid_windows(spark.createDataFrame(list(lengths.items()), "video_id STRING, dur_ms LONG"))


def test_grid_drops_short_tail_but_keeps_only_window(spark):
    got = rows(grid(spark, {"a": 12_000, "b": 3_000, "c": 5_000}))
    assert got == [("a", 0, 0, 5000), ("a", 1, 5000, 10000), ("b", 0, 0, 3000), ("c", 0, 0, 5000)]


SEG = "video_id STRING, start_ms LONG, end_ms LONG, votes INT"


def test_label_is_half_of_one_segment(spark):
    w = grid(spark, {"a": 20_000, "b": 3_000})
    segs = spark.createDataFrame([
        ("a", 0, 2500, 5),            # exactly half of window 0
        ("a", 5000, 7000, 9), ("a", 7000, 9000, 9),    # two halves do not add up
        ("a", 9_000, 10**12, 1),      # an absurd end only touches the video's windows
        ("b", 1500, 9000, 3),
    ], SEG)
    got = {(r["video_id"], r["window_idx"]): r["label"] for r in I.label_windows(w, segs).collect()}
    assert got == {("a", 0): 1, ("a", 1): 0, ("a", 2): 1, ("a", 3): 1, ("b", 0): 1}


@pytest.mark.parametrize("votes,weight", [(10, 1.0), (2, 0.2), (30, 1.0), (-3, 0.0)])
def test_vote_weights(spark, votes, weight):
    w = grid(spark, {"a": 10_000})
    segs = spark.createDataFrame([("a", 0, 5000, votes)], SEG)
    out = rows(I.vote_weights(I.label_windows(w, segs), segs).select("window_idx", "label", "vote_weight"))
    assert out == [(0, 1, weight), (1, 0, 1.0)]


def test_relabel_keeps_stored_label_without_votes(spark):
    w = spark.createDataFrame(
        [("a", 0, 0, 5000, 1, True), ("b", 0, 0, 5000, 1, False)],
        "video_id STRING, window_idx INT, t_start_ms LONG, t_end_ms LONG, label INT, has_votes BOOLEAN",
    )
    segs = spark.createDataFrame([("a", 0, 5000, 2), ("b", 0, 5000, 2)], SEG)
    assert rows(I.relabel(w, segs, 3).select("video_id", "label")) == [("a", 0), ("b", 1)]
    assert rows(I.relabel(w, segs, 0).select("video_id", "label")) == [("a", 1), ("b", 1)]


def labels(spark, vectors):
    return spark.createDataFrame(
        [(k, i, x) for k, v in vectors.items() for i, x in enumerate(v)], "video_id STRING, window_idx INT, label INT"
    )


def test_temporal_consistency(spark, monkeypatch):
    monkeypatch.setattr(W, "INDEX_CHUNK", 2)
    cases = {
        "a": ([0, 1, 0, 0, 0], [0, -1, 0, 0, 0]), "b": ([0, 1, 1, 0, 0], [0, 1, 1, 0, 0]),
        "c": ([0, 1, 0, 1, 0], [0, -1, 0, -1, 0]), "d": ([1], [1]), "e": ([1, 1, 0, 0], [1, 1, 0, 0]),
    }
    out = W.temporal_consistency(labels(spark, {k: v[0] for k, v in cases.items()}))
    got = {}
    for k, i, x in rows(out.select("video_id", "window_idx", "label")):
        got.setdefault(k, []).append(x)
    assert got == {k: v[1] for k, v in cases.items()}


def test_label_runs_cross_chunks(spark, monkeypatch):
    monkeypatch.setattr(W, "INDEX_CHUNK", 3)
    got = rows(W.label_runs(labels(spark, {"a": [1, 1, 0, 1, 1, 1, 1, 1, 0, 1]})))
    assert got == [("a", 0, 1, 2), ("a", 3, 7, 5), ("a", 9, 9, 1)]


def test_cues_in_window_is_half_open_and_ordered(spark):
    cues = cue_table(spark, {"a": [(0, 5, "x"), (4, 2, "y"), (5, 0, "edge"), (6, 0, "point"), (9.5, 3, "z")]})
    out = rows(I.cues_in_window(grid(spark, {"a": 15_000}), cues).select("window_idx", "text"))
    assert out == [(0, "x y"), (1, "y point z"), (2, "z")]


def test_active_cues_are_inclusive(spark):
    cues = cue_table(spark, {"a": [(0, 5, "x"), (10, 2, "y")]})
    ticks = spark.createDataFrame([("a", 1, 5000), ("a", 2, 5001), ("a", 3, 12001)], "video_id STRING, tick_id INT, t_ms LONG")
    assert rows(I.active_cues(ticks, cues).select("tick_id", "cue_idx")) == [(1, 0), (1, 1), (2, 1)]


def test_merge_scored_windows(spark):
    df = spark.createDataFrame([
        ("a", 0, 5000, 0.6), ("a", 10_000, 15_000, 0.8), ("a", 23_001, 28_000, 0.5), ("a", 50_000, 50_100, 0.9),
        ("a", 60_000, 65_000, 0.49),
    ], "video_id STRING, start_ms LONG, end_ms LONG, prob DOUBLE")
    got = rows(W.merge_scored_windows(df))
    assert got == [("a", 0, 17_000, 0.7, 2), ("a", 21_501, 30_000, 0.5, 1)]


def test_attach_segments_keeps_videos_without_any(spark):
    videos = spark.createDataFrame([("a",), ("b",)], "video_id STRING")
    segs = spark.createDataFrame([("a", 0, 1, 2), ("c", 0, 1, 2)], SEG)
    assert rows(I.attach_segments(videos, segs), "video_id") == [("a", 0, 1, 2, False), ("b", None, None, None, True)]


def test_coverage_of_sides_dealt_by_video(spark, tmp_path):
    """Spark may take a union of sides joined by video as dealt by video; times must not fall apart."""
    changed = {"spark.sql.autoBroadcastJoinThreshold": "4k", "spark.sql.unionOutputPartitioning": "true"}
    before = {k: spark.conf.get(k) for k in changed}
    video = lambda x: F.concat(F.lit("v"), x.cast("string")).alias("video_id")
    gt = spark.range(0, 25_000, 1, 6).select(video(F.col("id") % 2500), (F.expr("id div 2500") * 90_000).alias("start_ms")).withColumn("end_ms", F.col("start_ms") + 20_000)
    det = gt.filter("start_ms % 180000 = 0").withColumn("end_ms", F.col("start_ms") + 15_000)
    for name, df in {"gt": gt, "det": det, "scope": spark.range(0, 2500, 1, 4).select(video(F.col("id")))}.items():
        df.write.parquet(f"{tmp_path}/{name}")
    gt, det, scope = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("gt", "det", "scope"))
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        got = I.gt_coverage(gt.join(scope, "video_id", "left_semi"), det.join(scope, "video_id", "left_semi"))
        assert tuple(got.agg(F.count("*"), F.count_if("covered")).first()) == (25_000, 12_500)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_sweep_holds_no_table_of_times(spark):
    sides = "video_id STRING, start_ms LONG, end_ms LONG"
    gt = spark.createDataFrame([("a", 0, 10), ("a", 0, 10), ("a", 5, 20)], sides)
    det = spark.createDataFrame([("a", 8, 12), ("a", 10, 30), ("b", 0, 5)], sides)
    got = I.interval_intersection(gt, det)
    assert rows(got) == [("a", 12), ("b", 0)]
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert not any("Aggregate" in line and ", t#" in line.split("functions=")[0] for line in plan.splitlines())


def test_coverage_sorts_once_and_keeps_equal_and_null_rows(spark):
    """Truth travels with its times: the carried sums are the only join, and rows come back as often as they were."""
    g = spark.createDataFrame([("a", 0, 10_000, 1), ("a", 0, 10_000, 1), ("a", 0, 10_000, None), ("a", 5000, 1_300_000, 2), ("b", 0, 5, 1),
                               ("a", 7, 7, 1), ("a", None, 9, 1), (None, 0, 9, 1)], "video_id STRING, start_ms LONG, end_ms LONG, votes INT")
    d = spark.createDataFrame([("a", 9000, 601_000), ("a", 9000, 10_000), ("a", 1_200_000, 9_000_000), (None, 0, 9)], "video_id STRING, start_ms LONG, end_ms LONG")
    out = I.gt_coverage(g, d)
    assert out.columns[:4] == g.columns
    got = sorted(map(tuple, out.select("video_id", "start_ms", "end_ms", "votes", "overlap_ms").collect()), key=str)
    assert got == sorted([("a", 0, 10_000, 1, 2000), ("a", 0, 10_000, 1, 2000), ("a", 0, 10_000, None, 2000), ("a", 5000, 1_300_000, 2, 693_000),
                          ("b", 0, 5, 1, 0), ("a", 7, 7, 1, 0), ("a", None, 9, 1, 0), (None, 0, 9, 1, None)], key=str)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
