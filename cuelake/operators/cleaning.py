"""Cleaning rule sets and whole-video predicates (B operators)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cuelake.schema import to_ms


def _number(name: str) -> Column:
    """Column parsed as a finite double, null where it is not one.

    Casting ignores blanks around the number; NaN sorts above infinity.
    """
    value = F.col(name).try_cast("double")
    return F.when(F.abs(value) < float("inf"), value)


def _whole(name: str) -> Column:
    return F.col(name).try_cast("int")


def _text(df: DataFrame, name: str, default: str = "") -> Column:
    """A text column, or the default where the table does not have it."""
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def clean_segments(df: DataFrame, category: str = "sponsor", min_votes: int = 1) -> DataFrame:
    """Feature-build rules: votes default to 0, hidden and non-skip rows go, >= 1 s long."""
    start, end = _number("startTime"), _number("endTime")
    votes = F.coalesce(_whole("votes"), F.lit(0))
    return (
        df.filter(F.col("category") == category)
        .filter(_text(df, "hidden", "0").isin("0", ""))
        .filter(_text(df, "actionType", "skip").isin("skip", ""))
        .select(
            F.trim("videoID").alias("video_id"),
            start.alias("_s"), end.alias("_e"), votes.alias("votes"),
        )
        .filter((F.col("votes") >= min_votes) & (F.col("video_id") != ""))
        .filter((F.col("_e") > F.col("_s")) & (F.col("_e") - F.col("_s") >= 1.0))
        .select("video_id", to_ms(F.col("_s")).alias("start_ms"),
                to_ms(F.col("_e")).alias("end_ms"), "votes")
    )


def clean_segments_bench(df: DataFrame, category: str = "sponsor") -> DataFrame:
    """Evaluation rules: float votes >= 1, video >= 60 s, 11-character id; order unchecked."""
    votes, length = _number("votes"), _number("videoDuration")
    return (
        df.filter(F.col("category") == category)
        .filter((_text(df, "hidden") != "1") & (_text(df, "shadowHidden") != "1"))
        .filter(_text(df, "service").isin("", "YouTube"))
        .filter(F.length("videoID") == 11)
        .select(
            F.col("videoID").alias("video_id"),
            _number("startTime").alias("_s"), _number("endTime").alias("_e"),
            votes.alias("_votes"), length.alias("_len"),
        )
        .filter((F.col("_votes") >= 1) & (F.col("_len") >= 60))
        .filter(F.col("_s").isNotNull() & F.col("_e").isNotNull())
        .select("video_id", to_ms(F.col("_s")).alias("start_ms"),
                to_ms(F.col("_e")).alias("end_ms"), F.col("_votes").cast("int").alias("votes"))
    )


def clean_segments_audit(
    df: DataFrame, cached: DataFrame | None = None, category: str = "sponsor"
) -> DataFrame:
    """Audit rules: unparsable rows go, no vote floor; adds ``dur_ms`` and ``in_cache``."""
    out = (
        df.filter(F.col("category") == category)
        .filter(_text(df, "hidden", "0").isin("0", ""))
        .select(
            F.trim("videoID").alias("video_id"),
            _number("startTime").alias("_s"), _number("endTime").alias("_e"),
            _whole("votes").alias("votes"),
        )
        .filter((F.col("video_id") != "") & F.col("votes").isNotNull())
        .filter(F.col("_e") > F.col("_s"))
        .select("video_id", to_ms(F.col("_s")).alias("start_ms"),
                to_ms(F.col("_e")).alias("end_ms"), "votes")
        .withColumn("dur_ms", F.col("end_ms") - F.col("start_ms"))
    )
    if cached is None:
        return out.withColumn("in_cache", F.lit(False))
    ids = cached.select("video_id").distinct().withColumn("in_cache", F.lit(True))
    return out.join(ids, "video_id", "left").withColumn(
        "in_cache", F.coalesce("in_cache", F.lit(False))
    )


def videos_with_confident_segment(df: DataFrame, k: int = 3) -> DataFrame:
    """All segments of the videos that have at least one with ``votes >= k``."""
    confident = df.filter(F.col("votes") >= k).select("video_id").distinct()
    return df.join(confident, "video_id", "left_semi")


def detection_status(
    videos: DataFrame, cues: DataFrame, segments: DataFrame, errors: DataFrame | None = None
) -> DataFrame:
    """error / no_captions / true_negative / with_segments per video.

    ``videos`` lists the tested ids, ``segments`` holds truth and detections.
    """
    has_cues = cues.select("video_id").distinct().withColumn("_cues", F.lit(True))
    has_segments = segments.select("video_id").distinct().withColumn("_segs", F.lit(True))
    out = videos.select("video_id").join(has_cues, "video_id", "left").join(
        has_segments, "video_id", "left"
    )
    failed: Column = F.lit(False)
    if errors is not None:
        out = out.join(
            errors.select("video_id").distinct().withColumn("_err", F.lit(True)), "video_id", "left"
        )
        failed = F.coalesce("_err", F.lit(False))
    return out.select(
        "video_id",
        F.when(failed, "error")
        .when(F.col("_cues").isNull(), "no_captions")
        .when(F.col("_segs").isNull(), "true_negative")
        .otherwise("with_segments")
        .alias("status"),
    )


def all_zero(vector: Column) -> Column:
    return ~F.exists(vector, lambda x: x != 0)


def silent_videos(df: DataFrame, vector: str = "audio_emb") -> DataFrame:
    """Ids of the videos whose vectors are zero in every window."""
    return (
        df.groupBy("video_id")
        .agg(F.bool_and(all_zero(F.col(vector))).alias("_silent"))
        .filter("_silent")
        .select("video_id")
    )


def drop_zero_audio(df: DataFrame, vector: str = "audio_emb") -> DataFrame:
    return df.join(silent_videos(df, vector), "video_id", "left_anti")


def exclude_label(df: DataFrame, label: int = -1) -> DataFrame:
    """Apply after positions and lags are computed: they count the dropped rows."""
    return df.filter(F.col("label") != label)
