"""Interval joins as equi-joins on time buckets (Spark has no interval join)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

BUCKET = "_bucket"


def bucket_of(ms: Column, width: int) -> Column:
    return F.floor(ms / F.lit(width)).cast("bigint")


def over_buckets(df: DataFrame, lo: Column, hi: Column, width: int) -> DataFrame:
    """One copy of the row per bucket touched by the closed range [lo, hi].

    Rows with ``hi < lo`` touch nothing and are dropped.
    """
    return df.filter(hi >= lo).withColumn(
        BUCKET, F.explode(F.sequence(bucket_of(lo, width), bucket_of(hi, width)))
    )


def clip_ends(df: DataFrame, end: str, others: DataFrame, limit: Column, key: str = "video_id") -> DataFrame:
    """Cut ``end`` to the largest ``limit`` of the other side and drop keys it lacks.

    Nothing matches beyond that point, so results stay whole, and one absurd end time
    cannot fan a row out over endless buckets.
    """
    bounds = others.groupBy(key).agg(F.max(limit).alias("_limit"))
    return df.join(bounds, key).withColumn(end, F.least(F.col(end), F.col("_limit"))).drop("_limit")


#: Bucket widths grow by this factor per level; a row spans at most about as many.
LEVEL_FACTOR = 64


def level_width(level: Column, width: int) -> Column:
    return F.lit(width) * F.pow(F.lit(LEVEL_FACTOR), level).cast("bigint")


def over_levelled_buckets(df: DataFrame, lo: Column, hi: Column, width: int, levels: int = 7) -> DataFrame:
    """Like :func:`over_buckets`, on the finest level where the row spans few buckets."""
    length = F.greatest(hi - lo, F.lit(1))
    ratio = F.ln(length / F.lit(width * LEVEL_FACTOR)) / F.lit(math.log(LEVEL_FACTOR))
    level = F.least(F.greatest(F.ceil(ratio), F.lit(0)), F.lit(levels - 1)).cast("int")
    w = level_width(F.col("_level"), width)
    return df.filter(hi >= lo).withColumn("_level", level).withColumn(
        BUCKET, F.explode(F.sequence(F.floor(lo / w).cast("bigint"), F.floor(hi / w).cast("bigint")))
    )


def overlap_ms(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
