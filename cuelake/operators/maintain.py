"""Work selection, backfills, negative cache and lookups (I operators)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cuelake.plans.onerow import with_one_row


def _ids(df: DataFrame) -> DataFrame:
    return df.select("video_id").distinct()


def shuffled(df: DataFrame, seed: str) -> Column:
    """Reproducible pseudo-random order key of a video."""
    return F.md5(F.concat(F.lit(seed), df["video_id"]))


def select_work(
    segments: DataFrame, cache: DataFrame, skip: DataFrame | None = None, n: int | None = None,
    min_votes: int = 1, mode: str = "default", seed: str = "42",
) -> DataFrame:
    """Videos to process next.

    Eligible are videos with a segment of enough votes, minus the skip list and, by
    ``mode``: ``default`` minus all cached; ``force`` none removed;
    ``force_zero_audio`` minus the cached ones that have sound.
    """
    eligible = segments.groupBy("video_id").agg(F.max("votes").alias("_v")).filter(
        F.col("_v") >= min_votes
    ).select("video_id")
    if mode == "default":
        done = _ids(cache)
    elif mode == "force_zero_audio":
        done = _ids(cache.filter(~F.col("zero_audio")))
    elif mode == "force":
        done = None
    else:
        raise ValueError(f"unknown mode {mode!r}")
    todo = eligible if done is None else eligible.join(done, "video_id", "left_anti")
    if skip is not None:
        todo = todo.join(_ids(skip), "video_id", "left_anti")
    if n:
        todo = todo.orderBy(shuffled(todo, seed)).limit(n)
    return todo


def work_counters(segments: DataFrame, cache: DataFrame, skip: DataFrame) -> DataFrame:
    """How many eligible ids are cached, on the skip list, or left to do."""
    cached = _ids(cache).withColumn("_c", F.lit(True))
    skipped = _ids(skip).withColumn("_s", F.lit(True))
    joined = _ids(segments).join(cached, "video_id", "left").join(skipped, "video_id", "left")
    c, s = F.col("_c").isNotNull(), F.col("_s").isNotNull()
    return joined.agg(
        F.count(F.lit(1)).alias("n_eligible"), F.count_if(c).alias("n_cached"),
        F.count_if(s).alias("n_skipped"), F.count_if(~c & ~s).alias("n_todo"),
    )


def backfill_status(cache: DataFrame, segments: DataFrame, force: bool = False) -> DataFrame:
    """What a vote backfill does with each cached video."""
    known = _ids(segments).withColumn("_k", F.lit(True))
    joined = cache.join(known, "video_id", "left")
    return joined.select(
        "video_id",
        F.when(F.col("has_votes") & F.lit(not force), "already_done").otherwise("updated").alias("status"),
        F.col("_k").isNull().alias("missing_from_csv"),
    )


def backfill_counters(status: DataFrame) -> DataFrame:
    updated = F.col("status") == "updated"
    return status.agg(
        F.count_if(updated).alias("updated"),
        F.count_if(~updated).alias("already_done"),
        F.count_if(updated & F.col("missing_from_csv")).alias("missing_from_csv"),
    )


def backfill_votes(
    cache: DataFrame, stored: DataFrame, segments: DataFrame, force: bool = False
) -> DataFrame:
    """The vote child table after the backfill: kept rows plus the newly attached ones."""
    status = backfill_status(cache, segments, force)
    fresh = segments.join(status.filter("status = 'updated'").select("video_id"), "video_id", "left_semi")
    kept = stored.join(status.filter("status = 'already_done'").select("video_id"), "video_id", "left_semi")
    return kept.unionByName(fresh)


def merge_cache(master: DataFrame, new: DataFrame) -> DataFrame:
    """Insert-if-absent by video id."""
    return master.unionByName(new.join(_ids(master), "video_id", "left_anti"))


def merge_report(master: DataFrame, new: DataFrame) -> DataFrame:
    ids = _ids(master).withColumn("_m", F.lit(1)).join(
        _ids(new).withColumn("_n", F.lit(1)), "video_id", "full_outer"
    )
    return ids.agg(
        F.count_if(F.col("_m").isNull()).alias("added"), F.count(F.lit(1)).alias("total")
    )


def negative_cache(attempts: DataFrame) -> DataFrame:
    """Latest remembered outcome per video: ``ok`` or permanent ``none``.

    ``attempts(video_id, ts, outcome)``; transient outcomes are not remembered.
    """
    lasting = attempts.filter("outcome IN ('ok', 'none')")
    return lasting.groupBy("video_id").agg(F.max_by("outcome", F.struct("ts", "outcome")).alias("outcome"))


def caption_todo(videos: DataFrame, attempts: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Videos to fetch; ``retry_failed`` forgets the permanent ``none`` entries."""
    known = negative_cache(attempts)
    if retry_failed:
        known = known.filter("outcome <> 'none'")
    return _ids(videos).join(known.select("video_id"), "video_id", "left_anti")


def lookup_predictions(log: DataFrame, now: Column, memory: bool = False) -> DataFrame:
    """Latest logged prediction per video, if it has not expired at ``now``.

    A store entry without expiry never expires; the memory path needs one.
    """
    fields = [c for c in log.columns if c != "video_id"]
    latest = log.groupBy("video_id").agg(
        F.max_by(F.struct(*fields), F.struct("updated_at", "event_id")).alias("_r")
    ).select("video_id", *[F.col(f"_r.{c}").alias(c) for c in fields])
    alive = F.col("expires_at") > now if memory else ~F.coalesce(F.col("expires_at") < now, F.lit(False))
    return latest.filter(alive)


def with_expiry(log: DataFrame, ttl_days: int = 7) -> DataFrame:
    return log.withColumn("expires_at", F.col("updated_at") + F.expr(f"INTERVAL '{ttl_days}' DAY"))


def job_status(events: DataFrame) -> DataFrame:
    """Latest state of each job, with the whole error and its last 500 characters for display."""
    last = F.max_by(F.struct("video_id", "status", "error"), F.struct("ts", "event_id"))
    return events.groupBy("job_id").agg(last.alias("_r")).select(
        "job_id", "_r.video_id", "_r.status", "_r.error", F.right(F.col("_r.error"), F.lit(500)).alias("error_tail")
    )


def job_answers(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Status per requested job id; unknown ids answer ``not_found``."""
    return requests.join(jobs, "job_id", "left").select(
        "job_id", F.coalesce("status", F.lit("not_found")).alias("status")
    )


def missing_feature_work(features: DataFrame, column: str, force: bool = False) -> DataFrame:
    """Per video: ``todo`` where the feature is absent in a window (or forced), else ``skip``."""
    return features.groupBy("video_id").agg(
        F.count_if(F.col(column).isNull()).alias("n_missing"), F.count(F.lit(1)).alias("n_windows")
    ).withColumn(
        "action", F.when((F.col("n_missing") > 0) | F.lit(force), "todo").otherwise("skip")
    )


def skip_id_union(listed: DataFrame, cached: DataFrame) -> DataFrame:
    return _ids(listed.select("video_id").union(cached.select("video_id")))


def skip_id_overlap(listed: DataFrame, cached: DataFrame) -> DataFrame:
    both = listed.select("video_id").intersect(cached.select("video_id"))
    return with_one_row(
        both.agg(F.count(F.lit(1)).alias("n_both")),
        skip_id_union(listed, cached).agg(F.count(F.lit(1)).alias("n_either")),
    )
