"""Registry of runnable queries and of their SQL counterparts for checking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cuelake.fixtures import Inputs, duck_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None, recursive: bool = False):
    """Register ``fn(inputs) -> DataFrame`` and, where given, its DuckDB text."""

    def register(fn: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, directory: fn(Inputs(spark, directory))
        if sql is not None:
            ORACLE[name] = duck_sql(views, sql, recursive)
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison across engines."""
    return df.select(*[
        F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes
    ])


def flat_vector(df: DataFrame, column: str) -> DataFrame:
    """A 0/1 vector as text."""
    return df.withColumn(column, F.array_join(F.transform(column, lambda x: x.cast("string")), ""))


def sql_text(pattern: str) -> str:
    """A regular expression as a quoted SQL string."""
    return "'" + pattern.replace("'", "''") + "'"
