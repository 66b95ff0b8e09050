"""Attach one-row aggregates as scalar subqueries instead of unconditioned joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def with_one_row(df: DataFrame, *rows: DataFrame) -> DataFrame:
    """``df`` plus the columns of each one-row table in ``rows``."""
    for row in rows:
        packed = row.select(F.struct("*").alias("s")).scalar()
        names = [c for c in row.columns if c not in df.columns]
        df = df.withColumn("_row", packed).select(*df.columns, *[f"_row.{c}" for c in names])
    return df
