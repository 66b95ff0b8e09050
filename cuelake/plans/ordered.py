"""Ordered computations per key that never put a whole key into one task.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task.  Keys
here are videos, users or runs, and one of them may hold a third of all rows, so
the helpers below cut each key's ordered rows into chunks and partition by
``(key, chunk)``:

* :func:`halo` copies rows near a chunk border into the neighbouring chunk, which
  makes every window with a bounded reach exact inside its chunk;
* :func:`carry_scan` handles unbounded frames (running sums and maxima, last
  value so far, row numbers): chunk-local windows plus one carried value per
  chunk, taken from a map-side combined aggregate with one row per chunk;
* :func:`merge_runs` merges gap-separated islands first inside each chunk and
  then across chunks, so only partial islands are shuffled a second time;
* :func:`chunk_fold` runs order-dependent folds whose state is small: each chunk
  is summarised as a function of its entry state, the summaries are chained, and
  the chunks are replayed in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

CHUNK = "_chunk"

#: Default chunk widths.  They bound the rows of a (key, chunk) group, not results.
TIME_CHUNK_MS = 600_000
INDEX_CHUNK = 4096


def chunk_of(position: Column, width: int) -> Column:
    return F.floor(position / F.lit(width)).cast("bigint")


# ---------------------------------------------------------------------------
# bounded reach: replicate borders
# ---------------------------------------------------------------------------


def by_chunk(df: DataFrame, *columns: str) -> DataFrame:
    """Spread rows by all of ``columns``.

    Spark regards data already partitioned by the key alone as good enough for a window
    or aggregate over (key, chunk), and would leave a hot key in one task; the explicit
    exchange prevents that.  Where one is needed anyway it takes its place.
    """
    return df.repartition(*columns)


def halo(
    df: DataFrame, position: str, width: int, before: int = 0, after: int = 0, key: str = "video_id"
) -> DataFrame:
    """Add ``_chunk`` and ``_own``; a row also appears in each chunk it is near to.

    A chunk sees all rows from ``before`` units ahead of its start to ``after``
    units past its end.  Compute windows over ``(key, _chunk)`` and then keep the
    rows with ``_own``.
    """
    pos = F.col(position)
    first = chunk_of(pos - F.lit(after), width)
    last = chunk_of(pos + F.lit(before), width)
    spread = df.withColumn(CHUNK, F.explode(F.sequence(first, last))).withColumn(
        "_own", F.col(CHUNK) == chunk_of(pos, width)
    )
    return by_chunk(spread, key, CHUNK)


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter("_own").drop(CHUNK, "_own")


# ---------------------------------------------------------------------------
# unbounded frames: local windows plus carried values
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Scan:
    """One output column of :func:`carry_scan`.

    kinds: ``rank`` (0-based row number), ``sum`` (inclusive running sum),
    ``max_before`` (max over earlier rows), ``last`` (last non-null so far,
    inclusive), ``prev`` (value of the preceding row), ``next`` (of the following).
    """

    name: str
    kind: str
    value: Column | None = None


def _struct(columns: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in columns])


def carry_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    scans: Sequence[Scan],
) -> DataFrame:
    """Ordered scans per key; ``chunk`` must not decrease along ``order``.

    Key and chunk columns must not be null.
    """
    rows = df.withColumn(CHUNK, chunk)
    values = {s.name: f"_v_{s.name}" for s in scans if s.value is not None}
    for s in scans:
        if s.value is not None:
            rows = rows.withColumn(values[s.name], s.value)
    order_key = _struct(order)

    # One row per chunk; combined on the map side, so this shuffle is small.
    aggs: list[Column] = []
    for s in scans:
        if s.kind == "rank":
            agg = F.count(F.lit(1))
        elif s.kind == "sum":
            agg = F.sum(values[s.name])
        elif s.kind == "max_before":
            agg = F.max(values[s.name])
        elif s.kind == "last":
            v = F.col(values[s.name])
            agg = F.max_by(v, F.when(v.isNotNull(), order_key))
        elif s.kind == "prev":
            agg = F.max_by(F.struct(F.col(values[s.name]).alias("v")), order_key)
        elif s.kind == "next":
            agg = F.min_by(F.struct(F.col(values[s.name]).alias("v")), order_key)
        else:
            raise ValueError(f"unknown scan kind {s.kind!r}")
        aggs.append(agg.alias(f"_a_{s.name}"))
    per_chunk = rows.groupBy(*keys, CHUNK).agg(*aggs)

    along = Window.partitionBy(*keys).orderBy(CHUNK)
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    carried = []
    for s in scans:
        a = F.col(f"_a_{s.name}")
        if s.kind in ("rank", "sum"):
            c = F.sum(a).over(earlier)
        elif s.kind == "max_before":
            c = F.max(a).over(earlier)
        elif s.kind == "last":
            c = F.last(a, ignorenulls=True).over(earlier)
        elif s.kind == "prev":
            c = F.lag(a).over(along)
        else:
            c = F.lead(a).over(along)
        carried.append(c.alias(f"_c_{s.name}"))
    carry = per_chunk.select(*keys, CHUNK, *carried)

    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = []
    for s in scans:
        v = F.col(values[s.name]) if s.value is not None else None
        if s.kind == "rank":
            c = F.row_number().over(inside) - 1
        elif s.kind == "sum":
            c = F.sum(v).over(upto)
        elif s.kind == "max_before":
            c = F.max(v).over(before)
        elif s.kind == "last":
            c = F.last(v, ignorenulls=True).over(upto)
        elif s.kind == "prev":
            c = F.lag(F.struct(v.alias("v"))).over(inside)
        else:
            c = F.lead(F.struct(v.alias("v"))).over(inside)
        local.append(c.alias(f"_l_{s.name}"))
    placed = by_chunk(rows, *keys, CHUNK)
    joined = placed.select("*", *local).join(carry, [*keys, CHUNK], "left")

    out = []
    for s in scans:
        here, carried_in = F.col(f"_l_{s.name}"), F.col(f"_c_{s.name}")
        if s.kind == "rank":
            c = (here + F.coalesce(carried_in, F.lit(0))).cast("bigint")
        elif s.kind == "sum":
            zero = F.lit(0)
            c = F.coalesce(here, zero) + F.coalesce(carried_in, zero)
        elif s.kind == "max_before":
            c = F.greatest(here, carried_in)
        elif s.kind == "last":
            c = F.coalesce(here, carried_in)
        else:
            c = F.coalesce(here, carried_in)["v"]
        out.append(c.alias(s.name))
    return joined.select(*[F.col(c) for c in df.columns], *out)


def ordered_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, name: str
) -> DataFrame:
    """Dense 0-based position of each row within its key."""
    return carry_scan(df, keys, order, chunk, [Scan(name, "rank")])


# ---------------------------------------------------------------------------
# gap-separated islands
# ---------------------------------------------------------------------------

_FINAL = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.sum}


def merge_runs(
    df: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    order: Sequence[str],
    gap: int,
    extra: dict[str, tuple[str, str]] | None = None,
    reach: str = "previous",
    width: int = TIME_CHUNK_MS,
) -> DataFrame:
    """Merge rows per key into runs; a new run opens when ``start - reach > gap``.

    ``reach`` is the end of the preceding row (``"previous"``) or the largest end
    so far (``"furthest"``); rows must not end before they start in the former case.
    The run's start is the first row's; its end is the last row's for ``previous`` and
    the largest for ``furthest``.  ``extra`` maps output names to
    ``(min|max|sum|count|first|last, column)``.

    First pass: per ``(key, chunk)``.  Only the first and the last run of a chunk can
    continue in another one, so the second pass puts just these edge runs (two per
    chunk) together by key; all inner runs stay with their chunk.
    """
    extra = extra or {}
    keys = list(keys)
    position = F.struct(*[F.col(c) for c in order])
    current = df.select(
        *keys, F.col(start).alias("_s"), F.col(end).alias("_e"),
        chunk_of(F.col(start), width).alias(CHUNK),
        position.alias("_first"), position.alias("_last"),
        *[
            (F.lit(1).cast("bigint") if fn == "count" else F.col(col)).alias(name)
            for name, (fn, col) in extra.items()
        ],
    )
    furthest = reach == "furthest"
    part = [*keys, CHUNK]
    if furthest:
        # Largest end of all earlier chunks: rows within its reach continue that run.
        tops = df.groupBy(*keys, chunk_of(F.col(start), width).alias(CHUNK)).agg(F.max(end).alias("_top"))
        earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        carried = tops.select(*part, F.max("_top").over(earlier).alias("_carry"))
        current = current.join(carried, part)
    else:
        current = current.withColumn("_carry", F.lit(None).cast("bigint"))
    merged = _merge_pass(by_chunk(current, *part), part, gap, extra, furthest)

    # Group 0 continues an earlier run; without a carried reach the first run may.
    w = Window.partitionBy(*part).orderBy("_first")
    first = F.col("_grp") == 0 if furthest else F.lag("_s").over(w).isNull()
    edge = first | F.lead("_s").over(w).isNull()
    salted = merged.withColumn("_edge", edge).withColumn(
        "_salt", F.when(F.col("_edge"), F.lit(None).cast("bigint")).otherwise(F.col(CHUNK))
    )
    regrouped = by_chunk(salted.withColumn("_carry", F.lit(None).cast("bigint")), *keys, "_salt")
    final = _merge_pass(regrouped, [*keys, "_salt"], gap, extra, furthest)
    return final.select(*keys, F.col("_s").alias(start), F.col("_e").alias(end), *extra.keys())


def _merge_pass(
    df: DataFrame, part: list[str], gap: int, extra: dict[str, tuple[str, str]], furthest: bool
) -> DataFrame:
    """Runs within each partition; ``_grp`` 0 holds the rows within the carried reach."""
    w = Window.partitionBy(*part).orderBy("_first")
    if furthest:
        behind = F.greatest(F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_carry"))
    else:
        behind = F.lag("_e").over(w)
    opened = df.withColumn(
        "_new", F.when(F.col("_s") - behind <= F.lit(gap), F.lit(0)).otherwise(F.lit(1))
    )
    grouped = opened.withColumn(
        "_grp", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    aggs = [
        F.min("_s").alias("_s"),
        (F.max("_e") if furthest else F.max_by("_e", "_last")).alias("_e"),
        F.min("_first").alias("_first"),
    ]
    for name, (fn, _) in extra.items():
        if fn == "first":
            aggs.append(F.min_by(name, "_first").alias(name))
        elif fn == "last":
            aggs.append(F.max_by(name, "_last").alias(name))
        else:
            aggs.append(_FINAL[fn](name).alias(name))
    aggs.append(F.max("_last").alias("_last"))
    return grouped.groupBy(*part, "_grp").agg(*aggs)


# ---------------------------------------------------------------------------
# order-dependent folds with a small state
# ---------------------------------------------------------------------------


class ChunkFold:
    """A fold over the ordered rows of a key, split into chunks.

    ``summarize`` describes a chunk as a function of its entry state (a short list
    of integers), ``advance`` applies such a description to a state, and
    ``replay`` processes the rows of a chunk from a known entry state.
    """

    initial: list[int]

    def summarize(self, rows: pd.DataFrame) -> list[int]:
        raise NotImplementedError

    def advance(self, state: list[int], summary: list[int]) -> list[int]:
        raise NotImplementedError

    def replay(self, rows: pd.DataFrame, state: list[int]) -> pd.DataFrame:
        raise NotImplementedError


def whole_groups(batches: Iterator[pd.DataFrame], by: Sequence[str]) -> Iterator[list[pd.DataFrame]]:
    """Complete groups of sorted batches, a list per batch.

    Only the group that a batch breaks off in is kept for the next one, in parts that are put
    together once, when it ends.
    """
    rest: list[pd.DataFrame] = []
    for pdf in batches:
        if len(pdf) == 0:
            continue
        starts = np.flatnonzero((pdf[by] != pdf[by].shift()).any(axis=1).to_numpy())
        parts = [pdf.iloc[i:j] for i, j in zip(starts, [*starts[1:], len(pdf)])]
        done = []
        if rest:
            if tuple(rest[-1][by].iloc[-1]) == tuple(parts[0][by].iloc[0]):
                rest.append(parts.pop(0))
            if parts:
                done.append(pd.concat(rest, ignore_index=True))
        if parts:
            rest = [parts.pop()]
        yield [*done, *parts]
    if rest:
        yield [pd.concat(rest, ignore_index=True)]


def chunk_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    fold: ChunkFold,
    needs: Sequence[str],
    adds: T.StructType,
) -> DataFrame:
    """Run ``fold`` per key; ``adds`` are the columns ``replay`` appends to ``df``.

    Chunks are processed as runs of sorted Arrow batches, which costs far less per
    chunk than a grouped call; a chunk is the largest thing held in memory.
    """
    keys, order, needs = list(keys), list(order), list(needs)
    by = [*keys, CHUNK]
    rows = df.withColumn(CHUNK, chunk)
    lean = rows.select(*by, *[c for c in dict.fromkeys([*order, *needs]) if c not in by])
    by_fields = [lean.schema[c] for c in by]
    ints = T.ArrayType(T.LongType())

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for groups in whole_groups(batches, by):
            if groups:
                heads = pd.concat([g.iloc[:1][by] for g in groups], ignore_index=True)
                yield heads.assign(_summary=[fold.summarize(g) for g in groups])

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key_now, state = None, list(fold.initial)
        for pdf in batches:
            entries = []
            for key, summary in zip(pdf[keys].itertuples(index=False, name=None), pdf["_summary"]):
                if key != key_now:
                    key_now, state = key, list(fold.initial)
                entries.append(list(state))
                state = fold.advance(state, [int(v) for v in summary])
            yield pdf[by].assign(_entry=entries)

    # One short row per chunk, chained in order with constant memory.
    summaries = _sorted_runs(lean, by, order).mapInPandas(
        describe, T.StructType([*by_fields, T.StructField("_summary", ints)])
    )
    entries = (
        summaries.repartition(*keys).sortWithinPartitions(*by)
        .mapInPandas(chain, T.StructType([*by_fields, T.StructField("_entry", ints)]))
    )

    out_schema = T.StructType([*df.schema.fields, *adds.fields])
    names = [f.name for f in out_schema.fields]

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for groups in whole_groups(batches, by):
            if groups:
                done = [fold.replay(g, [int(v) for v in g["_entry"].iloc[0]]) for g in groups]
                yield pd.concat(done, ignore_index=True)[names]

    return _sorted_runs(rows.join(entries, by), by, order).mapInPandas(replay, out_schema)


def _sorted_runs(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows of each group together in one partition and in order, numbered in ``_nth``.

    Spark drops the exchange where a join has already dealt rows by these columns, and adaptive
    execution then reads that join's input by mapper or in splits, as no function over batches asks for whole
    groups.  A window does ask for them.
    """
    along = [c for c in dict.fromkeys(order) if c not in by] or by
    return by_chunk(df, *by).withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy(*along)))
