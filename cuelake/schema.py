"""Table shapes and the milliseconds convention.

Media time is BIGINT milliseconds inside the library: range frames are exact and
"half of the window" is an integer test.  Use :func:`to_ms` once at ingest.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

#: Columns of the crowd-labelled interval CSV; all text, some may be absent.
RAW_SEGMENT_COLUMNS = [
    "videoID", "startTime", "endTime", "votes", "category", "hidden",
    "shadowHidden", "actionType", "videoDuration", "service",
]

CUES = T.StructType([
    T.StructField("video_id", T.StringType()),
    T.StructField("cue_idx", T.IntegerType()),
    T.StructField("start_ms", T.LongType()),
    T.StructField("dur_ms", T.LongType()),
    T.StructField("text", T.StringType()),
])

SEGMENTS = T.StructType([
    T.StructField("video_id", T.StringType()),
    T.StructField("start_ms", T.LongType()),
    T.StructField("end_ms", T.LongType()),
    T.StructField("votes", T.IntegerType()),
])

GRID_MS = 5000          # fixed analysis grid
MIN_VIDEO_MS = 60000    # shorter videos are skipped


def to_ms(seconds: Column) -> Column:
    return F.round(seconds * 1000).cast("bigint")


def to_sec(ms: Column) -> Column:
    return ms / F.lit(1000.0)
