"""Stateless and windowed streaming operators, upserts and a bounded runner (S1, S7-S9)."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from cuelake.operators.text import tag_cues
from cuelake.session import new_shared_path, rocks_state


def stream_av_windows(
    samples: DataFrame, session: str = "session_start", width_ms: int = 5000, late: str = "10 seconds", bins: int = 24,
) -> DataFrame:
    """Tumbling averages of sampled frames over the media time of a viewing session, in append mode.

    Media time starts over with each video, so no watermark can go by it.  ``session`` is the time at which
    the session's media time was zero: a window closes at that time plus its end, a clock that all
    sessions share and that carries the watermark.  Samples of windows that closed more than
    ``late`` ago are dropped.  Anchored on the clock grid, unlike the greedy batch windows.
    """
    start = (F.floor(F.col("time_ms") / width_ms) * width_ms).cast("bigint")
    return (
        samples.withColumn("start_ms", start)
        .withColumn("closes_at", F.timestamp_millis(F.unix_millis(session) + F.col("start_ms") + width_ms))
        .withWatermark("closes_at", late)
        .groupBy("video_id", session, "start_ms", "closes_at")
        .agg(
            F.count(F.lit(1)).alias("n_samples"),
            *[F.avg(F.get("hist", F.lit(i))).alias(f"_h{i}") for i in range(bins)],
            F.avg("low").alias("low"), F.avg("high").alias("high"), F.avg("ratio").alias("ratio"),
        )
        .select(
            "video_id", session, "start_ms", "n_samples",
            F.array(*[F.col(f"_h{i}") for i in range(bins)]).alias("hist"), "low", "high", "ratio",
        )
    )


def stream_score_windows(ticks: DataFrame, width: str = "25 seconds", slide: str = "5 seconds", late: str = "30 seconds") -> DataFrame:
    """Sliding context on streams: a grid approximation of the exact range window."""
    return (
        ticks.withWatermark("ts", late)
        .groupBy("video_id", F.window("ts", width, slide).alias("w"))
        .agg(F.max("score").alias("max_score"), F.count(F.lit(1)).alias("n"))
        .select("video_id", F.col("w.start").alias("window_start"), "max_score", "n")
    )


def session_segments(hits: DataFrame, gap: str = "2 minutes", late: str = "5 minutes") -> DataFrame:
    """Hits within a start-to-start gap form one session."""
    return (
        hits.withWatermark("ts", late)
        .groupBy("video_id", F.session_window("ts", gap).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("n_hits"), F.max("score").alias("max_score"),
            F.max("ts").alias("last_ts"),
        )
        .select("video_id", F.col("w.start").alias("start_ts"), "last_ts", "n_hits", "max_score")
    )


def stream_cue_tagging(cues: DataFrame) -> DataFrame:
    """Per-cue scores on arriving cues; stateless."""
    return tag_cues(cues)


def run_append(stream: DataFrame, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run to the end of the available input in append mode; read the written table.

    With a ``path`` and ``checkpoint`` that are kept, the next call goes on where this one ended.
    """
    spark = stream.sparkSession
    out = path or new_shared_path(spark, "stream")
    with rocks_state(spark):
        query = (
            stream.writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", checkpoint or new_shared_path(spark, "stream-state"))
            .outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


# ---------------------------------------------------------------------------
# S8: inserts into a feature store
# ---------------------------------------------------------------------------

#: Names with an underscore are not read as data.
MANIFEST, INDEX = "_manifest", "_index"
COMMIT = "run STRING, n_rows LONG, buckets ARRAY<INT>"


def commits(spark: SparkSession, store: str) -> list:
    """What has been committed to a feature store: one entry per micro-batch."""
    try:
        return spark.read.schema(f"{COMMIT}, insert STRING").json(f"{store}/{MANIFEST}").collect()
    except AnalysisException:  # nothing yet
        return []


def read_store(spark: SparkSession, store: str, schema: str | None = None) -> DataFrame:
    """The committed rows of a feature store."""
    paths = [f"{store}/insert={c.insert}" for c in commits(spark, store) if c.n_rows]
    if not paths:
        return spark.createDataFrame([], schema or "video_id STRING")
    return (spark.read.schema(schema) if schema else spark.read).parquet(*paths)


def stream_feature_upsert(
    features: DataFrame, store: str, key: str = "video_id", checkpoint: str | None = None,
    unique: list[str] | None = None, clock: str | None = None, late: str = "1 hour", buckets: int = 256,
) -> None:
    """Append the windows of videos that the store did not hold before this run.

    A run is named after its checkpoint folder and owns one directory per micro-batch, so
    a replayed batch rewrites itself, and a run that is started again with its checkpoint goes on.
    Membership is decided against other runs' commits: all windows of a new video are
    stored, in whatever micro-batches they arrive.

    The stored keys are indexed in ``buckets`` by hash; a micro-batch reads only the buckets its
    own keys fall into, never the store.  A commit names the buckets an insert has keys in, and
    counts only once it is written, after rows and index.  With a ``clock``, rows that agree in
    ``unique`` and come again within ``late`` are stored once.
    """
    spark = features.sparkSession
    checkpoint = checkpoint or new_shared_path(spark, "upsert-state")
    run = uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex
    if clock:
        features = features.withWatermark(clock, late).dropDuplicatesWithinWatermark(unique or [key])
    before = commits(spark, store)
    done = {c.insert for c in before}
    others = [c for c in before if c.run != run]
    #: By bucket, the other runs' inserts that have keys in it.
    held: dict[int, list[str]] = {}
    for c in others:
        for bucket in c.buckets:
            held.setdefault(bucket, []).append(c.insert)

    def insert(batch: DataFrame, batch_id: int) -> None:
        name = f"{run}-{batch_id:06d}"
        if name in done:  # written and committed before a failure of the query's own log
            return
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        batch.persist()
        try:
            keys = batch.select(key).distinct().withColumn("bucket", bucket)
            touched = sorted(r.bucket for r in keys.select("bucket").distinct().collect())
            paths = [f"{store}/{INDEX}/bucket={b}/insert={i}" for b in touched for i in held.get(b, [])]
            if paths:
                known = spark.read.schema(keys.select(key).schema).parquet(*paths)
                batch_new, keys = batch.join(known, key, "left_anti"), keys.join(known, key, "left_anti")
            else:
                batch_new = batch
            path = f"{store}/insert={name}"
            batch_new.write.mode("overwrite").parquet(path)
            # Only this insert's part of each bucket is replaced.
            keys.withColumn("insert", F.lit(name)).repartition("bucket").write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic").partitionBy("bucket", "insert").parquet(f"{store}/{INDEX}")
            written = sorted(r.bucket for r in keys.select("bucket").distinct().collect())
            n_rows = spark.read.schema(batch.schema).parquet(path).count()
            spark.createDataFrame([(run, n_rows, written)], COMMIT).coalesce(1).write.mode("overwrite").json(f"{store}/{MANIFEST}/insert={name}")
        finally:
            batch.unpersist()

    query = (
        features.writeStream.foreachBatch(insert)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
