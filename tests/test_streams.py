"""Streaming twins against their batch operators, with several micro-batches."""

import random
from collections import Counter

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from cuelake.operators import signal as S
from cuelake.plans.ordered import chunk_of
from cuelake.session import SPARKS_OWN, STATE_STORE
from cuelake.streaming import online, states


@pytest.fixture(scope="module")
def ticks(spark, tmp_path_factory):
    """Time-ordered files, so that each micro-batch continues the one before."""
    rng = random.Random(9)
    path = str(tmp_path_factory.mktemp("ticks"))
    data = [
        (rng.choice(["hot", "hot", "a", "b"]), i, i, rng.choice(["click", "view", "error"]), round(rng.random(), 3))
        for i in range(300)
    ]
    df = spark.createDataFrame(data, "video_id STRING, event_id LONG, s LONG, event_type STRING, score DOUBLE").select(
        "video_id", "event_id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id") * 30).alias("ts"), "event_type", "score"
    ).withColumn("enter_at", F.lit(0.6)).withColumn("t_ms", F.col("event_id") * 1000)
    for part in range(4):  # in no order inside a micro-batch
        df.filter(f"event_id div 75 = {part}").coalesce(1).orderBy(F.xxhash64("event_id")).write.mode("append").parquet(path)
    batch = spark.read.parquet(path)
    last = df.limit(1).select([F.lit("closing").alias(c) if c == "video_id" else (F.col(c) + F.expr("INTERVAL 30 DAYS")).alias(c) if c == "ts" else F.col(c) for c in df.columns])
    last.write.mode("append").parquet(path)
    stream = lambda: spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return spark.createDataFrame(batch.collect(), batch.schema), stream


def own(df):
    return df.filter("video_id <> 'closing'")


def by_time():
    return chunk_of(F.unix_seconds("ts"), 1000)


def test_counter_hysteresis(ticks):
    batch, stream = ticks
    cols = ["video_id", "ts", "event_id", "score", "enter_at"]
    got = online.run_append(states.stream_hysteresis(stream().select(*cols))).drop("score")
    want = states.hysteresis_segments(batch.select(*cols), ["event_id"], chunk_of(F.col("event_id"), 20))
    assert rows(got) == rows(want.select(got.columns))


def test_two_level_and_reset_counter(ticks):
    batch, stream = ticks
    got = online.run_append(states.stream_hysteresis_two_level(stream())).select("video_id", "event_id", "inside")
    want = states.hysteresis_two_level(batch, ["ts", "event_id"], by_time())
    assert rows(got) == rows(want.select(got.columns))
    got = online.run_append(states.stream_count_since_reset(stream(), "click", ["error"]))
    kind = F.col("event_type")
    want = states.count_since_reset(batch, ["ts", "event_id"], by_time(), kind == "click", kind == "error")
    assert rows(got) == rows(want.select(got.columns))


def test_membership_and_transitions(spark, ticks):
    batch, stream = ticks
    segs = spark.createDataFrame([("hot", 10_000, 60_000), ("hot", 50_000, 90_000), ("a", 0, 5_000), ("b", 0, 10**11)], "video_id STRING, start_ms LONG, end_ms LONG")
    member = own(online.run_append(states.stream_segment_membership(stream().select("video_id", "event_id", "t_ms"), segs)))
    hot = [r for r in rows(member.select("t_ms", "in_segment", "video_id")) if r[2] == "hot"]
    assert all(flag == (10_000 <= t <= 90_000) for t, flag, _ in hot)
    assert all(r["in_segment"] for r in member.filter("video_id = 'b'").collect())
    changes = states.segment_transitions(batch.filter("video_id = 'hot'"), segs, ["t_ms"], chunk_of(F.col("t_ms"), 30_000))
    assert [r["change"] for r in changes.orderBy("t_ms").collect()] == ["enter", "exit"]


def test_sessions_close_in_append_mode(ticks):
    batch, stream = ticks
    got = own(online.run_append(online.session_segments(stream().filter("score >= 0.8 OR video_id = 'closing'"), "2 minutes")))
    assert got.agg(F.sum("n_hits")).first()[0] == batch.filter("score >= 0.8").count()
    gaps = got.select("video_id", (F.unix_seconds("last_ts") - F.unix_seconds("start_ts")).alias("len"), "n_hits").collect()
    assert all(r["len"] <= 120 * (r["n_hits"] - 1) for r in gaps)


def test_delta_stream(spark, tmp_path):
    rng = random.Random(10)
    data = [(v, i, [rng.gauss(0, 1) for _ in range(13)]) for v in ("a", "b") for i in range(80)] + [("closing", 10**6, [0.0])]
    df = spark.createDataFrame(data, "video_id STRING, frame_idx INT, coeffs ARRAY<DOUBLE>").withColumn(
        "captured_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("frame_idx")))
    path = str(tmp_path / "frames")
    for part in [0, 1, 2, 3, 10**6 // 20]:
        df.filter(f"frame_idx div 20 = {part}").coalesce(1).orderBy(F.xxhash64("frame_idx")).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    # Spans of 7 s: a ring of 60 deltas is carried over eight of them.
    got = {(r[0], r[1]): r for r in online.run_append(states.stream_delta_mfcc(stream, wait_ms=7000)).collect()}
    batch = S.delta_mfcc(own(df)).collect()
    assert len(got) == len(batch) == 160
    for r in batch:
        assert got[r["video_id"], r["frame_idx"]]["delta"] == pytest.approx(r["delta"])
        assert got[r["video_id"], r["frame_idx"]]["anomaly"] == pytest.approx(r["anomaly"])


def events_in_files(spark, path, *parts):
    """(video, id, second, kind) rows, one file and so one micro-batch per part."""
    for part in parts:
        spark.createDataFrame(part, "video_id STRING, event_id LONG, s LONG, event_type STRING").withColumn(
            "ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s"))).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


END = ("closing", -1, 10**7, "click")


def test_a_closing_event_ends_the_state(spark, tmp_path):
    stream = events_in_files(spark, str(tmp_path / "in"), [("a", 0, 0, "click"), ("a", 1, 1, "click"), ("a", 2, 2, "close")], [("a", 3, 100, "click")],
                             [("a", 4, 200, "click")], [END])
    got = rows(own(online.run_append(states.stream_count_since_reset(stream, "click", [], ends=["close"], wait_ms=10_000))))
    assert got == [("a", 0, 1), ("a", 1, 2), ("a", 2, 0), ("a", 3, 1), ("a", 4, 2)]


@pytest.mark.parametrize("cut", [1, 2, 5])
def test_an_idle_key_starts_afresh(spark, tmp_path, cut):
    """Key a is idle for over ten minutes, b is not; results are the same however the rows are dealt into micro-batches."""
    data = [("a", 0, 0, "click"), ("b", 1, 10, "click"), ("a", 2, 60, "click"), ("b", 3, 400, "click"), ("a", 4, 900, "click"), ("b", 5, 901, "click"), ("a", 6, 950, "click")]
    stream = events_in_files(spark, str(tmp_path / "in"), *[data[k:k + cut] for k in range(0, len(data), cut)], [END])
    out = states.stream_count_since_reset(stream, "click", [], wait_ms=10_000, idle_ms=600_000)
    assert rows(own(online.run_append(out))) == [("a", 0, 1), ("a", 2, 2), ("a", 4, 1), ("a", 6, 2), ("b", 1, 1), ("b", 3, 2), ("b", 5, 3)]


def test_videos_of_one_group_are_idle_each_for_itself(spark, tmp_path):
    data = [("a", 0, 0, "click"), ("b", 1, 10, "click"), ("b", 3, 400, "click"), (None, 8, 890, "click"), ("a", 4, 900, "click"), ("b", 5, 901, "click"),
            (None, 9, 905, "click")]
    stream = events_in_files(spark, str(tmp_path / "in"), data[:3], data[3:], [END])
    fold = states.SinceReset("click", [], [])
    out = states.in_order(stream, fold, "ts", "30 seconds", 10_000, 600_000, groups=1)
    assert rows(own(online.run_append(out).na.fill("null"))) == [("a", 0, 1), ("a", 4, 1), ("b", 1, 1), ("b", 3, 2), ("b", 5, 3), ("null", 8, 1), ("null", 9, 2)]


class FakeStore:
    """A handle whose states are in memory; counts the calls that would go to the state store."""

    def __init__(self):
        self.calls, self.timers = Counter(), set()

    def _state(self, name, *_):
        held = {}

        class State:
            def __getattr__(_, call):
                def run(*args):
                    self.calls[name, call] += 1
                    key = args[0] if len(args) > 1 or call in ("getValue", "removeKey") else "value"
                    if call in ("updateValue", "update"):
                        held[key] = args[-1]
                    elif call in ("removeKey", "clear"):
                        held.pop(key, None)
                    else:
                        return key in held if call == "exists" else held.get(key)
                return run
        return State()

    getValueState = getMapState = getListState = _state

    def registerTimer(self, at):
        self.calls["timer", "register"] += 1
        self.timers.add(at)


class Expired:
    def __init__(self, at):
        self.getExpiryTimeInMs = lambda: at


def test_the_state_store_is_called_per_group_not_per_video():
    def run(videos):
        store, processor = FakeStore(), states.InOrder(states.Hysteresis(0.5, 2), 60_000, 10**9)
        processor.init(store)
        for batch in range(2):
            frame = pd.DataFrame({"video_id": [f"v{v}" for v in range(videos)], "at_us": [70_000_000 * batch + 1] * videos,
                                  "event_id": range(videos), "score": 0.9, "enter_at": 0.6})
            list(processor.handleInputRows((0,), iter([frame]), None))
        out = pd.concat([x for at in (60_000, 120_000) for x in processor.handleExpiredTimer((0,), None, Expired(at))])
        assert sorted(zip(out["video_id"], out["consecutive"], out["inside"])) == sorted(
            (f"v{v}", n, n == 2) for v in range(videos) for n in (1, 2))
        return store.calls

    assert run(1) == run(100)


def test_ticks_of_one_millisecond_go_by_their_microseconds():
    store, processor = FakeStore(), states.InOrder(states.TwoLevel(0.45, 0.3), 60_000, 10**9)
    processor.init(store)
    frame = pd.DataFrame({"video_id": ["a", "a"], "at_us": [1_900, 1_100], "event_id": [1, 2], "score": [0.1, 0.9]})
    list(processor.handleInputRows((0,), iter([frame]), None))
    out = next(processor.handleExpiredTimer((0,), None, Expired(60_000)))
    assert dict(zip(out["event_id"], out["inside"])) == {2: True, 1: False}


def test_late_rows_are_dropped_and_early_ones_wait(spark, tmp_path):
    stream = events_in_files(spark, str(tmp_path / "in"), [("a", 2, 50, "click"), ("a", 1, 40, "click")], [("a", 0, 30, "click"), ("a", 4, 1000, "click")],
                             [("b", 9, 1000, "click")], [("a", 3, 100, "click"), ("a", 5, 1001, "click")], [END])
    # The second file's early row is within the 30 s; the fourth's is not.
    out = states.stream_count_since_reset(stream, "click", [], late="30 seconds", wait_ms=60_000)
    assert rows(own(online.run_append(out))) == [("a", 0, 1), ("a", 1, 2), ("a", 2, 3), ("a", 4, 4), ("a", 5, 5), ("b", 9, 1)]


def test_state_survives_a_restart(spark, tmp_path):
    path, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in ([("a", 0, 0, "click")], [("a", 1, 100, "click")], [END]):
        stream = events_in_files(spark, path, part)
        got = online.run_append(states.stream_count_since_reset(stream, "click", [], wait_ms=10_000), out, state)
    assert rows(own(got)) == [("a", 0, 1), ("a", 1, 2)]


def test_av_windows_in_append_mode(spark, tmp_path):
    """Sessions of one video at different times; a sample behind the watermark is dropped."""
    base, path = 1_700_000_000, str(tmp_path / "in")
    schema = "video_id STRING, began LONG, time_ms LONG, hist ARRAY<DOUBLE>, low DOUBLE, high DOUBLE, ratio DOUBLE"
    row = lambda video, began, ms, x: (video, began, ms, [x, 2 * x], x, 0.0, 0.5)
    for part in ([row("a", 0, 0, 1.0), row("a", 0, 4999, 3.0), row("a", 0, 5000, 7.0)], [row("b", 0, 1000, 2.0), row("a", 60, 0, 9.0)],
                 [row("a", 60, 1000, 10.0)], [row("a", 0, 100, 100.0), row("a", 60, 4000, 11.0)], [row("closing", 10**6, 0, 0.0)]):
        spark.createDataFrame(part, schema).withColumn("session_start", F.timestamp_seconds(F.lit(base) + F.col("began"))).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = own(online.run_append(online.stream_av_windows(stream, bins=2)))
    found = rows(got.select("video_id", F.unix_seconds("session_start") - base, "start_ms", "n_samples", "hist", "low"))
    assert found == [("a", 0, 0, 2, [2.0, 4.0], 2.0), ("a", 0, 5000, 1, [7.0, 14.0], 7.0), ("a", 60, 0, 3, [10.0, 20.0], 10.0), ("b", 0, 0, 1, [2.0, 4.0], 2.0)]


def test_upsert_inserts_each_video_once(spark, tmp_path):
    path, store = str(tmp_path / "in"), str(tmp_path / "store")
    batches = [[("a", 0), ("a", 1)], [("a", 2), ("b", 0)], [("b", 1), ("c", 0)]]
    schema = "video_id STRING, window_idx INT"
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    online.stream_feature_upsert(stream, store)
    got = rows(online.read_store(spark, store).select("video_id", "window_idx"))
    assert rows(spark.read.parquet(store).select("video_id", "window_idx")) == got  # index and commits are not data
    assert got == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1), ("c", 0)]
    before = got
    online.stream_feature_upsert(stream, store)
    assert rows(spark.read.parquet(store).select("video_id", "window_idx")) == before


def test_upsert_goes_on_with_its_checkpoint(spark, tmp_path):
    path, store, state = (str(tmp_path / n) for n in ("in", "store", "state"))
    schema = "video_id STRING, window_idx INT"
    for k in range(2):
        spark.createDataFrame([("a", 5 * k + i) for i in range(5)], schema).coalesce(1).write.mode("append").parquet(path)
        online.stream_feature_upsert(spark.readStream.schema(schema).parquet(path), store, checkpoint=state)
    assert rows(spark.read.parquet(store).select("video_id", "window_idx")) == [("a", i) for i in range(10)]


def stored_windows(spark, store):
    return rows(online.read_store(spark, store, "video_id STRING, window_idx INT"))


def windows_in_files(spark, path, *parts):
    for part in parts:
        spark.createDataFrame(part, "video_id STRING, window_idx INT").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("video_id STRING, window_idx INT").option("maxFilesPerTrigger", 1).parquet(path)


def test_upsert_reads_only_buckets_of_its_keys(spark, tmp_path, monkeypatch):
    """After the first run the store itself and the buckets of other keys are moved away: the second needs neither."""
    store = str(tmp_path / "store")
    online.stream_feature_upsert(windows_in_files(spark, str(tmp_path / "one"), [(f"v{k}", 0) for k in range(40)]), store, buckets=8)
    bucket = {r[0]: r[1] for r in spark.range(40).select(F.format_string("v%d", "id").alias("k")).select("k", F.pmod(F.xxhash64("k"), F.lit(8))).collect()}
    away = [p for p in (tmp_path / "store" / "_index").iterdir() if p.name.startswith("bucket=") and p.name != f"bucket={bucket['v3']}"]
    assert len(away) == 7
    for p in [*away, *(tmp_path / "store").glob("insert=*")]:
        p.rename(tmp_path / f"away-{p.name}")
    again = windows_in_files(spark, str(tmp_path / "two"), [("v3", 1), ("v3", 2)])
    online.stream_feature_upsert(again, store, buckets=8)
    newest = [c for c in online.commits(spark, store) if c.n_rows == 0]
    assert len(newest) == 1 and newest[0].buckets == []


def test_an_uncommitted_insert_is_neither_read_nor_known(spark, tmp_path):
    """A run that died after its rows and index, before its commit; then one that replays after its commit."""
    store, state = str(tmp_path / "store"), str(tmp_path / "state")
    one = windows_in_files(spark, str(tmp_path / "one"), [("a", 0), ("b", 0)])
    online.stream_feature_upsert(one, store, checkpoint=state)
    commit = next((tmp_path / "store" / "_manifest").glob("insert=*"))
    commit.rename(tmp_path / "lost")
    assert stored_windows(spark, store) == []
    online.stream_feature_upsert(windows_in_files(spark, str(tmp_path / "two"), [("a", 7)]), store)
    assert stored_windows(spark, store) == [("a", 7)]
    (tmp_path / "lost").rename(commit)
    # The first run again, without its query's log: the committed batch is not inserted a second time.
    online.stream_feature_upsert(one, store, checkpoint=state)
    (tmp_path / "state").rename(tmp_path / "state-old")
    online.stream_feature_upsert(one, store, checkpoint=state)
    assert stored_windows(spark, store) == [("a", 0), ("a", 7), ("b", 0)]


def test_repeated_rows_are_stored_once(spark, tmp_path):
    path, store = str(tmp_path / "in"), str(tmp_path / "store")
    schema = "video_id STRING, window_idx INT, ts TIMESTAMP"
    for part in ([("a", 0, 0), ("a", 1, 1), ("a", 0, 2)], [("a", 1, 30), ("b", 0, 31)]):
        spark.createDataFrame(part, "video_id STRING, window_idx INT, s LONG").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s"))).drop("s").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    online.stream_feature_upsert(stream, store, unique=["video_id", "window_idx"], clock="ts")
    assert stored_windows(spark, store) == [("a", 0), ("a", 1), ("b", 0)]


def test_keyed_streams_in_a_session_with_sparks_own_state_store(spark, ticks):
    batch, stream = ticks
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, SPARKS_OWN)
    try:
        got = rows(online.run_append(states.stream_count_since_reset(stream(), "click", ["error"])))
        assert spark.conf.get(STATE_STORE) == SPARKS_OWN
    finally:
        spark.conf.set(STATE_STORE, before)
    kind = F.col("event_type")
    want = states.count_since_reset(batch, ["ts", "event_id"], by_time(), kind == "click", kind == "error")
    assert got == rows(want.select("video_id", "event_id", "since_reset"))


def test_membership_reads_its_static_side_from_a_stored_table(spark, tmp_path):
    """Pieces are worked out once, not per level and micro-batch."""
    spark.range(4).selectExpr("'a' AS video_id", "id AS event_id", "id * 1000 AS t_ms").write.parquet(str(tmp_path / "in"))
    ticks = spark.readStream.schema("video_id STRING, event_id LONG, t_ms LONG").parquet(str(tmp_path / "in"))
    segs = spark.createDataFrame([("a", 1000, 2000)], "video_id STRING, start_ms LONG, end_ms LONG")
    out = states.stream_segment_membership(ticks, segs)
    assert "Window" not in out._jdf.queryExecution().analyzed().toString()
    assert sorted((r.event_id, r.in_segment) for r in online.run_append(out).collect()) == [(0, False), (1, True), (2, True), (3, False)]


def test_stateless_slices_have_a_file_for_each_core(spark, monkeypatch):
    """A micro-batch of a stateless stream keeps all cores busy."""
    from cuelake.catalog import signals

    monkeypatch.setattr(signals.Streamed, "FILES", 1)
    table = signals.Streamed(spark, "/root/testdata/sf0.001").table("documents")
    files = online.run_append(table.selectExpr("doc_id", "_metadata.file_path AS f")).select("f").distinct().count()
    assert files > signals.Streamed.SLICES and files >= spark.sparkContext.defaultParallelism
