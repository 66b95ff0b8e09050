"""Grids, anchored windows, gap clustering and label runs (E operators)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from cuelake import vocab
from cuelake.functions.text import keyword_vector, score_cue
from cuelake.operators.intervals import cues_in_window, label_windows
from cuelake.plans.ordered import (
    CHUNK, INDEX_CHUNK, TIME_CHUNK_MS, ChunkFold, chunk_fold, chunk_of, halo, merge_runs, own_rows,
)
from cuelake.schema import GRID_MS, MIN_VIDEO_MS


# ---------------------------------------------------------------------------
# grids
# ---------------------------------------------------------------------------


def _grid(videos: DataFrame, width_ms: int) -> DataFrame:
    n = F.greatest(F.lit(1), F.floor(F.col("dur_ms") / width_ms)).cast("int")
    return videos.select(
        "video_id", "dur_ms", F.explode(F.sequence(F.lit(0), n - 1)).alias("window_idx")
    ).withColumn("t_start_ms", F.col("window_idx").cast("bigint") * width_ms)


def grid_windows(videos: DataFrame, width_ms: int = GRID_MS) -> DataFrame:
    """Full windows only; the short tail is dropped unless it is the only window."""
    return _grid(videos, width_ms).select(
        "video_id", "window_idx", "t_start_ms",
        F.least(F.col("t_start_ms") + width_ms, F.col("dur_ms")).cast("bigint").alias("t_end_ms"),
    )


def duration_windows(videos: DataFrame, width_ms: int = GRID_MS) -> DataFrame:
    """Empty windows for videos without cues; the end is not clipped."""
    return _grid(videos, width_ms).select(
        "video_id", "window_idx", "t_start_ms",
        (F.col("t_start_ms") + width_ms).alias("t_end_ms"), F.lit("").alias("text"),
    )


def build_windows(
    cues: DataFrame, videos: DataFrame, segments: DataFrame, width_ms: int = GRID_MS,
    patterns: list[str] = vocab.VOCAB_PIPELINE,
) -> DataFrame:
    """Grid, window text, indicator vector and label in one table."""
    windows = cues_in_window(grid_windows(videos, width_ms), cues, width_ms)
    labelled = label_windows(windows, segments, width_ms)
    return labelled.withColumn("keyword_vec", keyword_vector(F.col("text"), patterns))


def video_duration_from_cues(
    videos: DataFrame, cues: DataFrame, tail_ms: int = 5000, min_ms: int = MIN_VIDEO_MS
) -> DataFrame:
    """Last cue end (0 without cues) plus a tail; too short videos are skipped."""
    ends = cues.groupBy("video_id").agg(F.max(F.col("start_ms") + F.col("dur_ms")).alias("_e"))
    return (
        videos.select("video_id").join(ends, "video_id", "left")
        .select("video_id", (F.coalesce("_e", F.lit(0)) + tail_ms).cast("bigint").alias("dur_ms"))
        .filter(F.col("dur_ms") >= min_ms)
    )


# ---------------------------------------------------------------------------
# greedy anchors: a window opens at the first row >= width after the last opening
# ---------------------------------------------------------------------------


#: Folds run in Python per chunk: wider chunks, fewer calls, still a bounded group.
FOLD_CHUNK_MS = 6 * TIME_CHUNK_MS


class GreedyAnchors(ChunkFold):
    """State: time of the open window's anchor (none before the first row)."""

    NONE = -(2**62)
    initial = [NONE]

    def __init__(self, time: str, width: int):
        self.time, self.width = time, width

    def _orbit_end(self, times: np.ndarray, at: int) -> int:
        while True:
            nxt = int(np.searchsorted(times, times[at] + self.width, side="left"))
            if nxt >= len(times):
                return int(times[at])
            at = nxt

    def summarize(self, rows: pd.DataFrame) -> list[int]:
        # Entry candidates: an anchor from an earlier chunk reaches less than one
        # width past this chunk's first row, so the first anchor here is one of the
        # rows within that reach or the first row after it.
        times = np.unique(rows[self.time].to_numpy(dtype=np.int64))
        last = int(np.searchsorted(times, times[0] + self.width, side="left"))
        summary: list[int] = []
        for at in range(min(last + 1, len(times))):
            summary += [int(times[at]), self._orbit_end(times, at)]
        return summary

    def advance(self, state: list[int], summary: list[int]) -> list[int]:
        need = state[0] + self.width if state[0] != self.NONE else self.NONE
        for entry, out in zip(summary[::2], summary[1::2]):
            if entry >= need:
                return [out]
        return state

    def replay(self, rows: pd.DataFrame, state: list[int]) -> pd.DataFrame:
        times = rows[self.time].to_numpy(dtype=np.int64)
        anchor = np.empty(len(times), dtype=np.int64)
        before = np.empty(len(times), dtype=np.int64)
        opens = np.zeros(len(times), dtype=bool)
        at, current, previous = 0, state[0], state[0]
        while at < len(times):
            need = current + self.width if current != self.NONE else self.NONE
            nxt = int(np.searchsorted(times, need, side="left"))
            nxt = max(nxt, at)
            anchor[at:nxt], before[at:nxt] = current, previous
            if nxt < len(times):
                previous, current = current, int(times[nxt])
                anchor[nxt], before[nxt], opens[nxt] = current, previous, True
                at = nxt + 1
            else:
                at = nxt
        return rows.assign(anchor_ms=anchor, before_ms=before, opens=opens)


ANCHOR_COLUMNS = T.StructType([
    T.StructField("anchor_ms", T.LongType()),
    T.StructField("before_ms", T.LongType()),
    T.StructField("opens", T.BooleanType()),
])


def greedy_anchors(df: DataFrame, time: str, order: list[str], width_ms: int) -> DataFrame:
    """Adds ``anchor_ms`` (open window's start), ``before_ms`` (the one before) and ``opens``.

    Where windows start depends on the distinct times of a video alone, so only those are folded; the
    rows, with whatever texts and arrays they carry, are joined by video and time.  Of rows of one time the first opens.
    """
    times = df.select("video_id", time).distinct()
    placed = chunk_fold(times, ["video_id"], [time], chunk_of(F.col(time), FOLD_CHUNK_MS), GreedyAnchors(time, width_ms), [time], ANCHOR_COLUMNS)
    # Partitioned as the join leaves it: no further exchange.
    nth = F.row_number().over(Window.partitionBy("video_id", time).orderBy(*order))
    joined = df.join(placed, ["video_id", time])
    return joined.withColumn("opens", F.col("opens") & (nth == 1)).select(*df.columns, *ANCHOR_COLUMNS.names)


def anchored_windows(
    cues: DataFrame, width_ms: int = GRID_MS, missing_dur_ms: int | None = None
) -> DataFrame:
    """Greedy windows over ordered cues: start, end of the last cue, text, cue count.

    ``missing_dur_ms`` stands in for a zero or absent duration of the closing cue.
    """
    placed = greedy_anchors(
        cues.select("video_id", "cue_idx", "start_ms", "dur_ms", "text"),
        "start_ms", ["start_ms", "cue_idx"], width_ms,
    )
    dur = F.col("dur_ms")
    if missing_dur_ms is not None:
        dur = F.when(F.coalesce(dur, F.lit(0)) == 0, F.lit(missing_dur_ms)).otherwise(dur)
    return (
        placed.withColumn("_end", F.col("start_ms") + dur)
        .groupBy("video_id", F.col("anchor_ms").alias("start_ms"))
        .agg(
            F.max_by("_end", F.struct("start_ms", "cue_idx")).alias("end_ms"),
            F.count(F.lit(1)).alias("n_cues"),
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("start_ms", "cue_idx", "text"))),
                    lambda x: x["text"],
                ),
                " ",
            ).alias("text"),
        )
    )


# ---------------------------------------------------------------------------
# clustering of hits
# ---------------------------------------------------------------------------


def cluster_hits(hits: DataFrame, gap_ms: int = 120_000) -> DataFrame:
    """Clusters of scored cues; a hit joins if it starts within the gap after the last one."""
    return merge_runs(
        hits, ["video_id"], "start_ms", "end_ms", ["start_ms", "cue_idx"], gap_ms,
        extra={
            "n_hits": ("count", "cue_idx"), "score": ("sum", "score"),
            "first_idx": ("min", "cue_idx"), "last_idx": ("max", "cue_idx"),
            "last_start_ms": ("last", "start_ms"),
            **({"back_ms": ("first", "back_ms")} if "back_ms" in hits.columns else {}),
        },
    )


def detect_segments_simple(
    cues: DataFrame, gap_ms: int = 8000, min_score: int = 6,
    pad_before_ms: int = 1500, pad_after_ms: int = 2000,
) -> DataFrame:
    """Per-cue phrase hits clustered at a short gap; weak clusters go, the rest is padded."""
    hits = (
        cues.withColumn(
            "score", F.explode(F.filter(F.array(score_cue(F.col("text"))), lambda s: s > 0))
        )
        .select("video_id", "cue_idx", "start_ms",
                (F.col("start_ms") + F.col("dur_ms")).alias("end_ms"), "score")
    )
    clusters = cluster_hits(hits, gap_ms).filter(F.col("score") >= min_score)
    return clusters.select(
        "video_id",
        F.greatest(F.lit(0), F.col("start_ms") - pad_before_ms).cast("bigint").alias("start_ms"),
        (F.col("end_ms") + pad_after_ms).alias("end_ms"),
        "score", "n_hits",
    )


def merge_scored_windows(
    windows: DataFrame, threshold: float = 0.5, gap_ms: int = 8000,
    pad_before_ms: int = 1500, pad_after_ms: int = 2000, min_len_ms: int = 8000,
    digits: int | None = 4,
) -> DataFrame:
    """Windows with ``prob >= threshold`` merged over small gaps; score is their mean."""
    runs = merge_runs(
        windows.filter(F.col("prob") >= threshold)
        .select("video_id", "start_ms", "end_ms", "prob"),
        ["video_id"], "start_ms", "end_ms", ["start_ms", "end_ms"], gap_ms,
        extra={"_sum": ("sum", "prob"), "n_windows": ("count", "prob")},
    )
    score = F.col("_sum") / F.col("n_windows")
    return runs.select(
        "video_id",
        F.greatest(F.lit(0), F.col("start_ms") - pad_before_ms).cast("bigint").alias("start_ms"),
        (F.col("end_ms") + pad_after_ms).alias("end_ms"),
        (score if digits is None else F.round(score, digits)).alias("score"),
        "n_windows",
    ).filter(F.col("end_ms") - F.col("start_ms") >= min_len_ms)


def merge_flags(
    flagged: DataFrame, gap_ms: int = 10_000, width_ms: int = 5000,
    pad_before_ms: int = 1000, pad_after_ms: int = 2000, min_len_ms: int = 12_000,
) -> DataFrame:
    """Flagged signal windows merged by their start times."""
    # Start-to-start gaps: a row's "end" is its own start.
    points = flagged.select("video_id", "time_ms", F.col("time_ms").alias("last_ms"))
    runs = merge_runs(
        points, ["video_id"], "time_ms", "last_ms", ["time_ms"], gap_ms + width_ms,
        extra={"n_windows": ("count", "time_ms")},
    )
    return runs.select(
        "video_id",
        F.greatest(F.lit(0), F.col("time_ms") - pad_before_ms).cast("bigint").alias("start_ms"),
        (F.col("last_ms") + width_ms + pad_after_ms).alias("end_ms"),
        "n_windows",
        F.lit("av-analysis").alias("source"),
    ).filter(F.col("end_ms") - F.col("start_ms") >= min_len_ms)


# ---------------------------------------------------------------------------
# label runs and neighbours
# ---------------------------------------------------------------------------


def label_runs(windows: DataFrame) -> DataFrame:
    """Runs of consecutive ``label = 1`` windows per video."""
    runs = merge_runs(
        windows.filter("label = 1").select(
            "video_id", F.col("window_idx").cast("bigint").alias("start_idx"),
            F.col("window_idx").cast("bigint").alias("end_idx"),
        ),
        ["video_id"], "start_idx", "end_idx", ["start_idx"], 1, width=INDEX_CHUNK,
    )
    return runs.withColumn("length", F.col("end_idx") - F.col("start_idx") + 1)


def temporal_consistency(windows: DataFrame) -> DataFrame:
    """Label 1 without a neighbour labelled 1 becomes -1; one-window videos stay as is."""
    spread = halo(windows, "window_idx", INDEX_CHUNK, before=1, after=1)
    w = Window.partitionBy("video_id", CHUNK).orderBy("window_idx")
    prev, nxt = F.lag("label").over(w), F.lead("label").over(w)
    lonely = ~F.coalesce(prev == 1, F.lit(False)) & ~F.coalesce(nxt == 1, F.lit(False))
    # A video's only window has no neighbour row at all.
    single = prev.isNull() & nxt.isNull()
    flagged = spread.withColumn(
        "label",
        F.when((F.col("label") == 1) & lonely & ~single, F.lit(-1)).otherwise(F.col("label")),
    )
    return own_rows(flagged)


def window_position(windows: DataFrame, total: Column | None = None) -> DataFrame:
    """``window_idx / max(n - 1, 1)`` with n = largest index + 1 of the rows present."""
    n = windows.groupBy("video_id").agg((F.max("window_idx") + 1).alias("_n"))
    joined = windows.join(n, "video_id")
    size = F.col("_n") if total is None else total
    return joined.withColumn(
        "position", F.col("window_idx") / F.greatest(size - 1, F.lit(1))
    ).drop("_n")
