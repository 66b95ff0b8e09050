"""Interval joins and measures without pairing whole groups (C operators, E6, G1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cuelake.plans.ordered import (
    CHUNK, TIME_CHUNK_MS, Scan, by_chunk, carry_scan, chunk_of, merge_runs,
)
from cuelake.plans.spans import BUCKET, bucket_of, clip_ends, over_buckets, overlap_ms
from cuelake.schema import GRID_MS


# ---------------------------------------------------------------------------
# merging
# ---------------------------------------------------------------------------


def merge_intervals(df: DataFrame, gap_ms: int = 2000) -> DataFrame:
    """Merge intervals whose start is within ``gap_ms`` of the furthest end so far."""
    extra = {"votes": ("max", "votes")} if "votes" in df.columns else {}
    # Equal rows merge anyway: drop the copies before any shuffle by chunk.
    aggs = [F.max("votes").alias("votes")] if extra else [F.lit(1).alias("_one")]
    distinct = df.groupBy("video_id", "start_ms", "end_ms").agg(*aggs)
    return merge_runs(
        distinct, ["video_id"], "start_ms", "end_ms", ["start_ms", "end_ms"], gap_ms,
        extra=extra, reach="furthest",
    )


# ---------------------------------------------------------------------------
# windows x segments on the grid
# ---------------------------------------------------------------------------


def _grid_hits(
    segments: DataFrame, windows: DataFrame, width_ms: int, value: Column
) -> DataFrame:
    """(video_id, window_idx) -> max ``value`` over segments covering half the window."""
    # Copies of a segment collapse first; ends are clipped to the video so that one
    # absurd end time cannot fan out over the whole grid.
    distinct = segments.groupBy("video_id", "start_ms", "end_ms").agg(F.max(value).alias("_v"))
    bounds = windows.groupBy("video_id").agg(F.max("t_end_ms").alias("_limit"))
    clipped = (
        distinct.join(bounds, "video_id")
        .withColumn("_to", F.least("end_ms", "_limit") - 1)
        .withColumn("_from", F.greatest("start_ms", F.lit(0)))
    )
    touched = over_buckets(clipped, F.col("_from"), F.col("_to"), width_ms)
    lo = F.col(BUCKET) * width_ms
    hi = F.least(lo + width_ms, F.col("_limit"))
    covered = overlap_ms(lo, hi, F.col("start_ms"), F.col("end_ms"))
    # The last window may be shorter: its length is decided by the window row, so
    # keep the raw overlap and test it after the join.
    return (
        by_chunk(touched, "video_id", BUCKET).withColumn("_ov", covered)
        .filter(F.col("_ov") > 0)
        .groupBy("video_id", F.col(BUCKET).cast("int").alias("window_idx"))
        .agg(
            F.max("_ov").alias("_ov"),
            F.max(F.when(F.col("_ov") * 2 >= hi - lo, F.col("_v"))).alias("_v"),
        )
    )


def label_windows(
    windows: DataFrame, segments: DataFrame, width_ms: int = GRID_MS, name: str = "label"
) -> DataFrame:
    """1 where a single segment covers at least half of the window, else 0."""
    hits = _grid_hits(segments, windows, width_ms, F.lit(1)).drop("_v")
    length = F.col("t_end_ms") - F.col("t_start_ms")
    return windows.join(hits, ["video_id", "window_idx"], "left").withColumn(
        name, F.when((length > 0) & (F.col("_ov") * 2 >= length), 1).otherwise(0)
    ).drop("_ov")


def relabel(
    windows: DataFrame, segments: DataFrame, min_votes: int, width_ms: int = GRID_MS
) -> DataFrame:
    """Labels recomputed from segments with enough votes.

    ``windows`` carries the stored ``label`` and ``has_votes``; videos without vote
    data, and every video when ``min_votes`` is 0, keep the stored label.
    """
    if min_votes <= 0:
        return windows
    fresh = label_windows(
        windows, segments.filter(F.col("votes") >= min_votes), width_ms, "_fresh"
    )
    return fresh.withColumn(
        "label", F.when(F.col("has_votes"), F.col("_fresh")).otherwise(F.col("label"))
    ).drop("_fresh")


def vote_weights(
    windows: DataFrame, segments: DataFrame, cap: int = 10, width_ms: int = GRID_MS
) -> DataFrame:
    """Loss weight: votes/cap (at most 1) for label 1, otherwise 1; all segments count."""
    hits = _grid_hits(segments, windows, width_ms, F.col("votes")).drop("_ov")
    strength = F.least(F.lit(1.0), F.coalesce(F.greatest("_v", F.lit(0)), F.lit(0)) / F.lit(float(cap)))
    known = F.col("has_votes") if "has_votes" in windows.columns else F.lit(True)
    empty = F.col("t_end_ms") <= F.col("t_start_ms")
    return windows.join(hits, ["video_id", "window_idx"], "left").withColumn(
        "vote_weight",
        F.when(known & (F.col("label") == 1) & ~empty, strength).otherwise(F.lit(1.0)),
    ).drop("_v")


# ---------------------------------------------------------------------------
# windows x cues, ticks x cues, ticks x segments
# ---------------------------------------------------------------------------


def cues_in_window(windows: DataFrame, cues: DataFrame, width_ms: int = GRID_MS) -> DataFrame:
    """Adds ``text``: cues overlapping the window, in cue order, joined by one space."""
    ended = cues.withColumn("_end", F.col("start_ms") + F.col("dur_ms"))
    spread = over_buckets(
        clip_ends(ended, "_end", windows, F.col("t_end_ms")),
        F.greatest(F.col("start_ms"), F.lit(0)),
        F.greatest(F.col("start_ms"), F.col("_end") - 1), width_ms,
    ).select("video_id", F.col(BUCKET).cast("int").alias("window_idx"),
             "cue_idx", "start_ms", "_end", F.col("text").alias("_text"))
    placed = by_chunk(windows, "video_id", "window_idx")
    pairs = placed.join(spread, ["video_id", "window_idx"], "left")
    inside = (F.col("_end") > F.col("t_start_ms")) & (F.col("start_ms") < F.col("t_end_ms"))
    held = F.collect_list(F.when(inside, F.struct("cue_idx", F.col("_text").alias("t"))))
    keep = [c for c in windows.columns if c not in ("video_id", "window_idx")]
    return (
        pairs.groupBy("video_id", "window_idx")
        .agg(*[F.first(c).alias(c) for c in keep], held.alias("_held"))
        .withColumn(
            "text", F.array_join(F.transform(F.array_sort("_held"), lambda x: x["t"]), " ")
        )
        .drop("_held")
    )


def active_cues(ticks: DataFrame, cues: DataFrame, ahead_ms: int = 5000) -> DataFrame:
    """(tick, cue) where the cue starts within ``ahead_ms`` and has not ended (inclusive)."""
    width = 10_000
    reach = cues.withColumn("_lo", F.col("start_ms") - ahead_ms).withColumn(
        "_hi", F.col("start_ms") + F.col("dur_ms")
    )
    near = clip_ends(reach, "_hi", ticks, F.col("t_ms"))
    spread = over_buckets(near, F.col("_lo"), F.col("_hi"), width)
    return (
        ticks.withColumn(BUCKET, bucket_of(F.col("t_ms"), width))
        .join(spread, ["video_id", BUCKET])
        .filter((F.col("t_ms") >= F.col("_lo")) & (F.col("t_ms") <= F.col("_hi")))
        .drop(BUCKET, "_lo", "_hi")
    )


def first_match_pieces(segments: DataFrame) -> DataFrame:
    """Disjoint pieces telling which segment is the first (by start) to contain a time.

    Ordered by start, a segment that ends no later than an earlier one is never the
    first match.  The remaining ones have rising ends, and each is the first match
    exactly between the previous furthest end and its own end.
    """
    proper = segments.select("video_id", "start_ms", "end_ms").distinct().filter(
        F.col("end_ms") >= F.col("start_ms")
    )
    seen = carry_scan(
        proper, ["video_id"], ["start_ms", "end_ms"], chunk_of(F.col("start_ms"), TIME_CHUNK_MS),
        [Scan("_before", "max_before", F.col("end_ms"))],
    )
    return seen.filter(F.col("_before").isNull() | (F.col("end_ms") > F.col("_before"))).select(
        "video_id",
        F.greatest(F.col("start_ms"), F.coalesce(F.col("_before") + 1, F.col("start_ms"))).alias("piece_ms"),
        F.col("start_ms").alias("seg_start_ms"),
        F.col("end_ms").alias("seg_end_ms"),
    )


def point_in_segments(ticks: DataFrame, segments: DataFrame) -> DataFrame:
    """Adds ``in_segment`` and the first matching segment; at most one match per tick."""
    width = 10_000
    reach = first_match_pieces(segments).withColumn("_to", F.col("seg_end_ms"))
    pieces = over_buckets(
        clip_ends(reach, "_to", ticks, F.col("t_ms")), F.col("piece_ms"), F.col("_to"), width
    )
    placed = ticks.withColumn(BUCKET, bucket_of(F.col("t_ms"), width))
    inside = (
        (placed["video_id"] == pieces["video_id"])
        & (placed[BUCKET] == pieces[BUCKET])
        & (placed["t_ms"] >= pieces["piece_ms"])
        & (placed["t_ms"] <= pieces["seg_end_ms"])
    )
    return (
        placed.join(pieces, inside, "left")
        .select(*[placed[c] for c in ticks.columns],
                pieces["seg_end_ms"].isNotNull().alias("in_segment"),
                pieces["seg_start_ms"], pieces["seg_end_ms"])
    )


# ---------------------------------------------------------------------------
# measures
# ---------------------------------------------------------------------------


def interval_intersection(gt: DataFrame, det: DataFrame) -> DataFrame:
    """Measure of union(gt) n union(det) for every video of either side."""
    ids = gt.select("video_id").union(det.select("video_id")).distinct()
    return ids.join(_common_ms(gt, det), "video_id", "left").na.fill(0, ["inter_ms"])


def _common_ms(gt: DataFrame, det: DataFrame) -> DataFrame:
    """The measure for videos present on both sides, by a sweep inside time chunks.

    Intervals are cut at chunk borders, so each (video, chunk) sweep stands alone.
    """

    def events(df: DataFrame, side: str) -> DataFrame:
        other = det if side == "g" else gt
        distinct = df.filter("end_ms > start_ms").select("video_id", "start_ms", "end_ms").distinct()
        cut = (
            clip_ends(distinct, "end_ms", other, F.col("end_ms"))
            .filter("end_ms > start_ms")
            .withColumn(
                CHUNK,
                F.explode(F.sequence(
                    chunk_of(F.col("start_ms"), TIME_CHUNK_MS),
                    chunk_of(F.col("end_ms") - 1, TIME_CHUNK_MS),
                )),
            )
        )
        lo = F.greatest(F.col("start_ms"), F.col(CHUNK) * TIME_CHUNK_MS)
        hi = F.least(F.col("end_ms"), (F.col(CHUNK) + 1) * TIME_CHUNK_MS)
        edge = F.explode(F.array(
            F.struct(lo.alias("t"), F.lit(1).alias("d")),
            F.struct(hi.alias("t"), F.lit(-1).alias("d")),
        ))
        flat = cut.select("video_id", CHUNK, edge.alias("e"))
        zero = F.lit(0)
        return flat.select(
            "video_id", CHUNK, F.col("e.t").alias("t"),
            (F.col("e.d") if side == "g" else zero).alias("dg"),
            (F.col("e.d") if side == "d" else zero).alias("dd"),
        )

    points = by_chunk(events(gt, "g").unionByName(events(det, "d")), "video_id", CHUNK)
    # A range frame takes rows of one time together, of which only the last has a length: no table of
    # times is held, sorting spills.
    w = Window.partitionBy("video_id", CHUNK).orderBy("t")
    upto = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = (F.sum("dg").over(upto) > 0) & (F.sum("dd").over(upto) > 0)
    swept = points.withColumn("_len", F.lead("t").over(w) - F.col("t")).withColumn("_both", both)
    return (
        swept.groupBy("video_id")
        .agg(F.sum(F.when(F.col("_both"), F.col("_len")).otherwise(0)).alias("inter_ms"))
    )


def gt_coverage(gt: DataFrame, det: DataFrame, half: float = 0.5) -> DataFrame:
    """Per truth segment: total overlap with all detections over its length.

    Overlaps add up where detections overlap each other.  With F(t) the total
    detected length before ``t``, that sum is F(end) - F(start); F follows from
    running counts over the distinct times, so no truth x detection pairs arise.
    """
    known = F.col("video_id").isNotNull() & F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull()
    row = F.struct(*gt.columns).alias("_row")
    # A computed key: sides dealt by video are not taken for a union dealt by it, which adaptive execution may break.
    key = F.concat(F.col("video_id").cast("string"), F.lit("")).alias("_key")
    edges = det.filter("end_ms > start_ms AND video_id IS NOT NULL").select(key, F.explode(F.array(
        F.struct(F.col("start_ms").alias("t"), F.lit(1).cast("bigint").alias("n")),
        F.struct(F.col("end_ms").alias("t"), F.lit(-1).cast("bigint").alias("n")),
    )).alias("e")).select("_key", "e.t", "e.n", F.lit(None).cast("boolean").alias("_end"), F.lit(None).cast(gt.select(row).schema[0].dataType).alias("_row"))
    asked = gt.filter(known).select(key, row, F.explode(F.array(
        F.struct(F.col("start_ms").alias("t"), F.lit(False).alias("end")), F.struct(F.col("end_ms").alias("t"), F.lit(True).alias("end")),
    )).alias("e")).select("_key", "e.t", F.lit(0).cast("bigint").alias("n"), F.col("e.end").alias("_end"), "_row")
    # An edge at t adds nothing to F(t), so the order of rows of one time is free, and truth travels with its own times.
    running = carry_scan(
        edges.unionByName(asked), ["_key"], ["t"], chunk_of(F.col("t"), TIME_CHUNK_MS),
        [Scan("_n", "sum", F.col("n")), Scan("_nt", "sum", F.col("n") * F.col("t"))],
    )
    total = F.col("t") * F.col("_n") - F.col("_nt")
    # Equal rows of truth have equal values, and come back as often as they were.
    found = running.filter("_end IS NOT NULL").groupBy("_row").agg(
        F.max(F.when(~F.col("_end"), total)).alias("_f0"), F.max(F.when(F.col("_end"), total)).alias("_f1"),
        F.count_if("_end").cast("int").alias("_times"),
    ).withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_times")))).select("_row.*", "_f0", "_f1")
    nothing = F.lit(None).cast("bigint")
    found = found.unionByName(gt.filter(~known).withColumn("_f0", nothing).withColumn("_f1", nothing))
    length = F.col("end_ms") - F.col("start_ms")
    out = (
        found.withColumn("overlap_ms", F.when(length > 0, F.col("_f1") - F.col("_f0")).otherwise(0))
        .drop("_f0", "_f1")
        .withColumn(
            "coverage", F.when(length > 0, F.col("overlap_ms") / length).otherwise(F.lit(0.0))
        )
    )
    return out.withColumn("covered", F.col("coverage") >= half)


def segment_metrics(det: DataFrame, gt: DataFrame, videos: DataFrame | None = None) -> DataFrame:
    """Precision, recall and IoU per video; videos with neither side score 1/1/1."""

    def totals(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy("video_id").agg(
            F.sum(F.col("end_ms") - F.col("start_ms")).alias(f"{tag}_ms"),
            F.count(F.lit(1)).alias(f"n_{tag}"),
        )

    sides = totals(gt, "gt").join(totals(det, "det"), "video_id", "full_outer")
    if videos is not None:
        sides = videos.select("video_id").join(sides, "video_id", "left")
    table = sides.join(_common_ms(gt, det), "video_id", "left").na.fill(
        0, ["gt_ms", "det_ms", "n_gt", "n_det", "inter_ms"]
    )
    inter, no_gt, no_det = F.col("inter_ms"), F.col("n_gt") == 0, F.col("n_det") == 0
    union = F.col("gt_ms") + F.col("det_ms") - inter

    def over(den: Column) -> Column:
        return F.when(den > 0, inter / den).otherwise(F.lit(0.0))

    one, zero = F.lit(1.0), F.lit(0.0)
    return table.select(
        "video_id", "n_gt", "n_det", "gt_ms", "det_ms", "inter_ms",
        F.when(no_det, one).when(no_gt, zero).otherwise(over(F.col("det_ms"))).alias("precision"),
        F.when(no_gt, one).when(no_det, zero).otherwise(over(F.col("gt_ms"))).alias("recall"),
        F.when(no_gt & no_det, one).when(no_gt | no_det, zero).otherwise(over(union)).alias("iou"),
        (no_gt & no_det).alias("true_negative"),
    )


def attach_segments(videos: DataFrame, segments: DataFrame) -> DataFrame:
    """Child rows of every cached video: its segments, or one empty row if it has none.

    Kept as rows, not as one array per video, so a video with very many segments
    stays spread over tasks.  ``missing_from_csv`` marks videos without any.
    """
    ids = videos.select("video_id").distinct()
    found = segments.join(ids, "video_id", "left_semi").withColumn("missing_from_csv", F.lit(False))
    absent = ids.join(segments.select("video_id").distinct(), "video_id", "left_anti")
    empty = absent.select(
        "video_id",
        *[F.lit(None).cast(segments.schema[c].dataType).alias(c)
          for c in segments.columns if c != "video_id"],
        F.lit(True).alias("missing_from_csv"),
    )
    return found.unionByName(empty)
