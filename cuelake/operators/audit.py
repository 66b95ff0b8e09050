"""Label, vote and embedding audits (F operators)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cuelake.functions.math import ratio
from cuelake.operators.cleaning import all_zero
from cuelake.operators.windows import label_runs
from cuelake.plans.onerow import with_one_row

WINDOW_SEC = 5.0
VOTE_THRESHOLDS = [3, 5, 8, 10, 15, 20]


def per_video_counts(windows: DataFrame) -> DataFrame:
    return windows.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.count_if(F.col("label") == 1).alias("n_positive"),
    ).withColumn("rate", F.col("n_positive") / F.col("n_windows"))


def dataset_overview(windows: DataFrame) -> DataFrame:
    total = per_video_counts(windows).agg(
        F.count(F.lit(1)).alias("n_videos"),
        F.coalesce(F.sum("n_windows"), F.lit(0)).alias("n_windows"),
        F.coalesce(F.sum("n_positive"), F.lit(0)).alias("n_positive"),
    )
    neg = F.col("n_windows") - F.col("n_positive")
    return total.withColumn("n_negative", neg).withColumn(
        "base_rate", ratio(F.col("n_positive"), F.col("n_windows"))
    ).withColumn("imbalance", ratio(F.col("n_negative"), F.col("n_positive")))


def run_stats(windows: DataFrame, approximate: bool = False) -> DataFrame:
    """Count, mean and median length in seconds of label runs.

    Run lengths repeat heavily, so the exact median works on (length, count) rows.
    """
    seconds = F.col("length") * F.lit(WINDOW_SEC)
    runs = label_runs(windows)
    if approximate:
        middle = F.percentile_approx(seconds, 0.5)
        return runs.agg(
            F.count(F.lit(1)).alias("n_runs"), F.avg(seconds).alias("mean_sec"),
            middle.alias("median_sec"), F.count_if(F.col("length") == 1).alias("n_short_runs"),
        )
    lengths = runs.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    return lengths.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_runs"),
        (F.sum(seconds * F.col("n")) / F.sum("n")).alias("mean_sec"),
        F.percentile(seconds, F.lit(0.5), F.col("n")).alias("median_sec"),
        F.coalesce(F.sum(F.when(F.col("length") == 1, F.col("n"))), F.lit(0)).alias("n_short_runs"),
    )


def boundary_windows(windows: DataFrame) -> DataFrame:
    """Distinct first and last windows of runs, their share of positives, noise class."""
    edges = label_runs(windows).agg(
        F.coalesce(
            F.sum(F.when(F.col("length") == 1, 1).otherwise(2)), F.lit(0)
        ).alias("n_boundary"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("n_positive"),
    )
    share = ratio(F.col("n_boundary"), F.col("n_positive"))
    return edges.withColumn("boundary_share", share).withColumn(
        "noise",
        F.when(F.col("boundary_share") > 0.35, "HIGH")
        .when(F.col("boundary_share") > 0.20, "Moderate").otherwise("Low"),
    )


def positive_rate_profile(windows: DataFrame) -> DataFrame:
    return per_video_counts(windows).agg(
        F.count(F.lit(1)).alias("n_videos"),
        F.count_if(F.col("n_positive") == 0).alias("n_zero"),
        F.count_if(F.col("rate") > 0.40).alias("n_over_labelled"),
        F.count_if(F.col("n_positive").between(1, 2)).alias("n_sparse"),
        F.avg("rate").alias("mean_rate"),
    )


def over_labelled_videos(windows: DataFrame, limit: int = 20) -> DataFrame:
    return (
        per_video_counts(windows).filter(F.col("rate") > 0.40)
        .orderBy(F.desc("rate"), "video_id").limit(limit)
    )


def histogram(df: DataFrame, value: str, bins: int, lo: float, hi: float, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins; the last one also takes what lies beyond; empty bins count 0.

    The fixed list of bins is tiny, the data side only sends (bin, count) rows.
    """
    width = (hi - lo) / bins
    idx = F.least(F.floor((F.col(value) - lo) / width).cast("int"), F.lit(bins - 1))
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, idx.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    )
    all_bins = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    if by:
        frame = counts.select(*by).distinct().select(*by, all_bins)
    else:
        frame = df.sparkSession.range(1).select(all_bins)
    full = frame.join(counts, [*by, "bin"], "left")
    return full.select(
        *by, "bin",
        F.round(F.col("bin") * width + lo, 6).alias("bin_lo"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def histogram_to_max(df: DataFrame, value: str, bins: int, cap: float) -> DataFrame:
    """Histogram over 0..min(max, cap); the upper bound is joined in, not collected."""
    hi = df.agg(F.least(F.max(value).cast("double"), F.lit(cap)).alias("_hi"))
    width = F.col("_hi") / bins
    idx = F.least(F.floor(F.col(value) / width).cast("int"), F.lit(bins - 1))
    counts = (
        with_one_row(df.select(value), hi)
        .groupBy(idx.alias("bin"), width.alias("_w")).agg(F.count(F.lit(1)).alias("n"))
        .select("bin", "n")
    )
    frame = hi.select(
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), width.alias("_w")
    )
    return frame.join(counts, "bin", "left").select(
        "bin", F.round(F.col("bin") * F.col("_w"), 6).alias("bin_lo"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def _cached(audit: DataFrame) -> DataFrame:
    return audit.filter("in_cache")


def vote_buckets(audit: DataFrame) -> DataFrame:
    v = F.col("votes")
    return _cached(audit).agg(
        F.count_if(v.between(3, 5)).alias("v3_5"),
        F.count_if(v.between(6, 10)).alias("v6_10"),
        F.count_if(v.between(11, 20)).alias("v11_20"),
        F.count_if(v.between(21, 50)).alias("v21_50"),
        F.count_if(v > 50).alias("v51_up"),
    )


def vote_threshold_sim(
    audit: DataFrame, cached: DataFrame, thresholds: Sequence[int] = tuple(VOTE_THRESHOLDS)
) -> DataFrame:
    """What survives at each vote floor, as shares of cached segments and cached videos.

    One pass: per video the counts above every floor, then a global sum.
    """
    v = F.col("votes")
    per_video = _cached(audit).groupBy("video_id").agg(
        F.count(F.lit(1)).alias("_all"),
        *[F.count_if(v >= t).alias(f"_s{t}") for t in thresholds],
    )
    one = per_video.agg(
        F.coalesce(F.sum("_all"), F.lit(0)).alias("_all"),
        *[F.coalesce(F.sum(f"_s{t}"), F.lit(0)).alias(f"_s{t}") for t in thresholds],
        *[F.count_if(F.col(f"_s{t}") > 0).alias(f"_v{t}") for t in thresholds],
    )
    n_cached = cached.agg(F.count_distinct("video_id").alias("_cached"))
    rows = F.explode(F.array(*[
        F.struct(
            F.lit(t).alias("min_votes"), F.col(f"_s{t}").alias("segments"),
            F.col(f"_v{t}").alias("videos"),
        )
        for t in thresholds
    ]))
    flat = with_one_row(one, n_cached).select("_all", "_cached", rows.alias("r"))
    out = flat.select(
        "r.*",
        (ratio(F.col("r.segments"), F.col("_all")) * 100).alias("seg_pct"),
        (ratio(F.col("r.videos"), F.col("_cached")) * 100).alias("vid_pct"),
    )
    seg, vid = F.col("seg_pct"), F.col("vid_pct")
    return out.withColumn(
        "recommendation",
        F.when(F.col("min_votes") == 3, "current")
        .when((seg >= 70) & (vid >= 70), "safe to use")
        .when(seg >= 50, "worth trying").otherwise("too aggressive"),
    )


def vote_stats(audit: DataFrame) -> DataFrame:
    """Mean and exact median votes of cached segments, over (votes, count) rows."""
    counts = audit.groupBy("in_cache", "votes").agg(F.count(F.lit(1)).alias("n"))
    v, n = F.col("votes"), F.col("n")
    inside = F.col("in_cache")
    return counts.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("total_segments"),
        F.coalesce(F.sum(F.when(inside, n)), F.lit(0)).alias("cached_segments"),
        (F.sum(F.when(inside, v * n)) / F.sum(F.when(inside, n))).alias("mean_votes"),
        F.percentile(F.when(inside, v), F.lit(0.5), F.when(inside, n).otherwise(0)).alias("median_votes"),
        (F.sum(F.when(inside & (v < 8), n).otherwise(0)) * 100.0
         / F.sum(F.when(inside, n))).alias("pct_low_votes"),
    )


def embedding_audit(features: DataFrame) -> DataFrame:
    per_video = features.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(all_zero(F.col("audio_emb"))).alias("zero_audio"),
        F.bool_and(all_zero(F.col("text_emb"))).alias("zero_text"),
    )
    silent = F.col("zero_audio") == F.col("n")
    partial = (F.col("zero_audio") > 0) & ~silent
    counts = per_video.agg(
        F.count(F.lit(1)).alias("n_videos"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_windows"),
        F.count_if(silent).alias("zero_audio_videos"),
        F.count_if(partial).alias("partial_audio_videos"),
        F.coalesce(F.sum("zero_audio"), F.lit(0)).alias("zero_audio_windows"),
        F.count_if("zero_text").alias("zero_text_videos"),
    )
    videos = F.col("n_videos")
    return counts.select(
        "*",
        (ratio(F.col("zero_audio_videos"), videos) * 100).alias("zero_audio_pct"),
        (ratio(F.col("partial_audio_videos"), videos) * 100).alias("partial_audio_pct"),
        (ratio(F.col("zero_audio_windows"), F.col("n_windows")) * 100).alias("zero_window_pct"),
        (ratio(F.col("zero_text_videos"), videos) * 100).alias("zero_text_pct"),
    )


def constant_embedding_videos(
    features: DataFrame, vector: str = "text_emb", rtol: float = 1e-5, atol: float = 1e-8
) -> DataFrame:
    """Videos whose every embedding is close to that of the first window."""
    first = features.groupBy("video_id").agg(F.min_by(vector, "window_idx").alias("_first"))
    close = F.forall(
        F.zip_with(
            F.col(vector), F.col("_first"),
            lambda a, b: F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b),
        ),
        lambda ok: ok,
    )
    return (
        features.join(first, "video_id").groupBy("video_id")
        .agg(F.bool_and(close).alias("_same"), F.count(F.lit(1)).alias("n_windows"))
        .filter("_same").select("video_id", "n_windows")
    )


def label_audit(windows: DataFrame, audit: DataFrame | None = None) -> DataFrame:
    """One row with the figures that :func:`audit_recommendations` judges."""
    out = with_one_row(
        boundary_windows(windows), run_stats(windows), positive_rate_profile(windows)
    )
    if audit is None:
        return out.withColumn("pct_low_votes", F.lit(None).cast("double"))
    return with_one_row(out, vote_stats(audit).select("pct_low_votes"))


def audit_recommendations(figures: DataFrame) -> DataFrame:
    """Rule flags raised by a one-row audit; ``none`` if nothing stands out."""
    low = F.coalesce(F.col("pct_low_votes"), F.lit(0.0))

    def flag(cond: Column, name: str) -> Column:
        return F.when(cond, F.lit(name))

    flags = F.filter(
        F.array(
            flag(F.col("boundary_share") > 0.35, "boundary_noise"),
            flag(ratio(F.col("n_short_runs"), F.col("n_runs")) > 0.15, "short_runs"),
            flag(ratio(F.col("n_over_labelled"), F.col("n_videos")) > 0.05, "over_labelled"),
            F.when(low > 40, F.lit("low_votes_significant"))
            .when(low > 20, F.lit("low_votes_moderate")),
        ),
        lambda f: f.isNotNull(),
    )
    return figures.select(
        F.explode(F.when(F.size(flags) > 0, flags).otherwise(F.array(F.lit("none")))).alias("flag")
    )


def class_counts(windows: DataFrame) -> DataFrame:
    """Windows per class and their ratio; ignored labels (-1) are in neither."""
    counts = windows.agg(
        F.count_if(F.col("label") == 1).alias("n_pos"),
        F.count_if(F.col("label") == 0).alias("n_neg"),
    )
    return counts.withColumn("ratio", F.col("n_neg") / F.greatest("n_pos", F.lit(1)))


def flagged_videos(windows: DataFrame) -> DataFrame:
    return windows.groupBy("video_id").agg(F.bool_or(F.col("label") == 1).alias("has_segment"))


def sample_videos(videos: DataFrame, n: int | None, seed: str = "42") -> DataFrame:
    """Reproducible uniform sample of ``n`` videos; all of them for None or 0."""
    ids = videos.select("video_id").distinct()
    if not n:
        return ids
    return ids.orderBy(F.md5(F.concat(F.lit(seed), "video_id"))).limit(n)
