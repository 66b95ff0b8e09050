"""Crowd-labelled interval CSV and per-video JSON payloads (A1, A7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cuelake.schema import RAW_SEGMENT_COLUMNS, to_ms


def with_optional_columns(df: DataFrame) -> DataFrame:
    """Add the absent optional columns as nulls and project the known ones."""
    return df.select(*[
        (F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c)
        for c in RAW_SEGMENT_COLUMNS
    ])


#: A quoted field, escaped quotes included, or a plain one, up to the next comma or the end of the line.
WHOLE_LINE = r'^(?:"(?:[^"]|"")*+"|[^",][^,]*+|)(?:,(?:"(?:[^"]|"")*+"|[^",][^,]*+|))*+$'


def torn_lines(spark: SparkSession, path: str) -> int:
    """Lines that are no whole record: a line break inside quotes tears one into several."""
    return spark.read.text(path).filter(F.contains("value", F.lit('"')) & ~F.col("value").rlike(WHOLE_LINE)).count()


def read_segments_csv(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """Header CSV, everything text; ``""`` escapes a quote; short rows become nulls, line breaks inside quotes stay.

    No schema inference pass, and unused columns are never parsed.  Files without torn lines are
    split among tasks; if there is one, a file is read by one task as a whole.  Unless
    ``multi_line`` says which, a pass over the lines finds out.
    """
    if multi_line is None:
        multi_line = torn_lines(spark, path) > 0
    raw = spark.read.csv(path, header=True, quote='"', escape='"', inferSchema=False, encoding="UTF-8", multiLine=multi_line)
    return with_optional_columns(raw)


API_SCHEMA = "ARRAY<STRUCT<segment: ARRAY<DOUBLE>, category: STRING, actionType: STRING>>"


def segments_from_api_json(df: DataFrame, payload: str = "payload", category: str = "sponsor") -> DataFrame:
    """Per-video JSON list -> intervals of the category with action exactly ``skip``."""
    items = df.select("video_id", F.explode(F.from_json(F.col(payload), API_SCHEMA)).alias("s"))
    return (
        items.filter((F.col("s.category") == category) & (F.col("s.actionType") == "skip"))
        .select(
            "video_id",
            to_ms(F.get("s.segment", F.lit(0))).alias("start_ms"),
            to_ms(F.get("s.segment", F.lit(1))).alias("end_ms"),
        )
        .filter("start_ms IS NOT NULL AND end_ms IS NOT NULL")
    )
