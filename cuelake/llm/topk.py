"""Exact top-k inner products by distributed histogram selection (operator 4).

Vectors are packed into tiles, one file of the shared folder each; every query tile meets every
candidate tile in one task, which reads the two files.  Rows of the grid are names of files, so no
vector is shuffled or broadcast, however often a tile is met.
A pass scores all pairs and counts each query's scores in bins; the global counts say
in which bin its k-th best lies, and the next pass counts finer bins inside that one,
until a bin is one score.  A last pass keeps the scores from there on and breaks ties by
the smaller id.  A tile only reports bins down to its own k best: lower ones cannot hold the k-th.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.common import file_name, read_file, spread, stored, write_file
from cuelake.session import new_shared_path

STEP_BITS = 8


def as_integers(vectors: DataFrame) -> DataFrame:
    """Usable rows as (vec_id, row_no, v): components floor(64 x); others take no part."""
    x = F.col("embedding")
    usable = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return (vectors.where(F.col("vec_id").isNotNull() & usable)
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("row_no"),
                    F.transform(x, lambda e: F.floor(64 * e.cast("double"))).alias("v")))


class Tile(NamedTuple):
    """Vectors of one length: their ids in order, row numbers, and the largest absolute component."""

    most: int
    ids: np.ndarray
    numbers: np.ndarray
    v: np.ndarray


def tiles(rows: DataFrame, blocks: int) -> DataFrame:
    """Rows dealt evenly into ``blocks`` files, each with a tile for each length of vector: (block, path, bound).

    ``bound`` is the largest inner product that a tile's own components allow.
    """
    folder = new_shared_path(rows.sparkSession, "tiles")

    def pack(batches):
        held: dict[int, list] = {}
        for batch in batches:
            lengths = batch.column(2).value_lengths().to_numpy()
            for dim in np.unique(lengths).tolist():
                some = batch.filter(pa.array(lengths == dim))
                v = some.column(2).flatten().to_numpy().reshape(some.num_rows, dim)
                held.setdefault(dim, []).append((some.column(0).to_numpy(), some.column(1).to_numpy(), v))
        if not held:
            return
        packed, bound = [], 0
        for dim, parts in sorted(held.items()):
            ids, numbers, v = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort([numbers, ids])
            v = v[order].astype("<i8")
            most = int(np.abs(v).max(initial=0))
            bound = max(bound, dim * most * most)
            packed.append({"dim": dim, "n": len(ids), "most": most, "ids": ids[order].astype("<i8").tobytes(),
                           "numbers": numbers[order].astype("<i8").tobytes(), "vectors": shorten(v, most)})
        path = f"{folder}/{file_name('tile', '.arrow')}"
        write_table(path, pa.Table.from_pylist(packed))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([path]),
                                          pa.array([min(bound, np.iinfo(np.int64).max)], pa.int64())], names=["block", "path", "bound"])

    return rows.repartition(blocks).mapInArrow(pack, "block int, path string, bound long")


def write_table(path: str, table: pa.Table) -> None:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    write_file(path, sink.getvalue())


def read_table(path: str) -> pa.Table:
    return pa.ipc.open_stream(read_file(path)).read_all()


def read_tiles(path: str) -> dict[int, Tile]:
    """The tiles of a file, by the length of their vectors."""
    return {r["dim"]: Tile(r["most"], np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["numbers"], "<i8"),
                           matrix(r["vectors"], r["n"], r["dim"], r["most"])) for r in read_table(path).to_pylist()}


def width(most: int) -> str:
    return "<i1" if most < 1 << 7 else "<i2" if most < 1 << 15 else "<i8"


def shorten(v: np.ndarray, most: int) -> bytes:
    return v.astype(width(most)).tobytes()


def matrix(raw: bytes, n: int, dim: int, most: int) -> np.ndarray:
    return np.frombuffer(raw, width(most)).reshape(n, dim)


def scores(q: np.ndarray, c: np.ndarray, dim: int, most_q: int, most_c: int) -> np.ndarray:
    """Exact inner products: in floats where every partial sum is an integer they hold, else in integers."""
    bound = dim * most_q * most_c
    if bound < 1 << 24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if bound < 1 << 53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q.astype(np.int64) @ c.astype(np.int64).T


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, tile_rows: int = 4096, query_rows: int = 1024) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): each query's ``k`` best of all other rows, ties to the smaller vec_id.

    ``is_query`` is a condition on vec_id.  Null ids and vectors that are null or hold null or
    non-finite components take no part; vectors of another length are no candidates of a query.  Rows
    with equal vec_id are rows of their own, as queries and as candidates.  Inner products must fit 63 bits.
    """
    rows = stored(as_integers(vectors), "vectors")
    counts = rows.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    n_c, n_q = max(1, -(-counts.n // tile_rows)), max(1, -(-counts.q // query_rows))
    candidates = stored(tiles(rows, n_c), "candidates")
    queries = stored(tiles(rows.where(is_query), n_q), "queries")
    grid = (rows.sparkSession.range(n_q * n_c)
            .select(F.expr(f"CAST(id DIV {n_c} AS INT)").alias("q_block"), F.expr(f"CAST(id % {n_c} AS INT)").alias("c_block"))
            .join(queries.select(F.col("block").alias("q_block"), F.col("path").alias("q_path")), "q_block")
            .join(candidates.select(F.col("block").alias("c_block"), F.col("path").alias("c_path")), "c_block"))
    # A pair takes up to half a second: a task each while they are few, then several to a task.
    deal = lambda g: spread(g, max(min(n_q * n_c, 200), n_q * n_c // 8))
    shift = max(0, (candidates.agg(F.max("bound").alias("b")).first().b or 1).bit_length() - STEP_BITS)
    last_shift, on_grid = None, deal(grid)
    while True:
        places = stored(placed(located(counted(on_grid, k, shift, last_shift))), "places")
        on_grid = deal(grid.join(places, "q_block"))
        if shift == 0:
            break
        last_shift, shift = shift, max(0, shift - STEP_BITS)
    best = kept(on_grid, k)
    order = Window.partitionBy("row_no").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def pair(q: Tile, c: Tile) -> np.ndarray:
    """The scores of a tile pair; a row's own score is the lowest number."""
    s = scores(q.v, c.v, q.v.shape[1], q.most, c.most)
    order = np.argsort(c.numbers)
    at = order[np.minimum(np.searchsorted(c.numbers, q.numbers, sorter=order), len(c.numbers) - 1)]
    own = np.flatnonzero(c.numbers[at] == q.numbers)
    s[own, at[own]] = OWN
    return s


OWN = np.iinfo(np.int64).min


class Places(NamedTuple):
    """A query block's bins so far, by row number: the bin of the k-th best, and which of that bin's scores it is."""

    numbers: np.ndarray
    bins: np.ndarray
    needs: np.ndarray

    def of(self, q_no: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bins and needs of the query rows, in their order; one that has no scores at all gets a bin above all."""
        at = np.minimum(np.searchsorted(self.numbers, q_no), len(self.numbers) - 1)
        found = self.numbers[at] == q_no
        return np.where(found, self.bins[at], np.iinfo(np.int64).max), np.where(found, self.needs[at], 0)


def read_places(path: str) -> Places:
    return Places(*(c.to_numpy() for c in read_table(path).columns))


def placed(place: DataFrame) -> DataFrame:
    """(q_block, place): the places of each query block in a file (bounded by the block)."""
    folder = new_shared_path(place.sparkSession, "places")

    def write(key, table):
        path = f"{folder}/{file_name('place', '.arrow')}"
        write_table(path, table.select(["row_no", "bin", "need"]).sort_by("row_no").combine_chunks())
        return pa.table({"q_block": pa.array([key[0].as_py()], pa.int32()), "place": [path]})

    return place.groupBy("q_block").applyInArrow(write, "q_block int, place string")


def each_pair(batches):
    """The tile pairs of the grid's rows, as (row, query tile, candidate tile): a pair is the unit of memory."""
    for batch in batches:
        for row in batch.to_pylist():
            q, c = read_tiles(row["q_path"]), read_tiles(row["c_path"])
            for dim in sorted(q.keys() & c.keys()):
                yield row, q[dim], c[dim]


def counted(grid: DataFrame, k: int, shift: int, last_shift: int | None) -> DataFrame:
    """(q_block, row_no, bin, need, n): how many scores of a query lie in a bin of width 2**shift inside its bin so far.

    ``need`` says which of that bin's scores, from the best, is the k-th best.
    """

    def count(batches):
        for row, q, c in each_pair(batches):
            s = pair(q, c)
            valid = s != OWN
            needs = np.full(len(q.numbers), k)
            if last_shift is not None:
                bins, needs = read_places(row["place"]).of(q.numbers)
                valid &= (s >> last_shift) == bins[:, None]
            s = np.where(valid, s, OWN)
            if s.shape[1] > k:
                least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                valid &= (s >> shift) >= (least >> shift)[:, None]
            i, j = np.nonzero(valid)
            if not len(i):
                continue
            bins = s[i, j] >> shift
            order = np.lexsort([bins, i])
            i, bins = i[order], bins[order]
            first = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (bins[1:] != bins[:-1])]))
            sizes = np.diff(np.append(first, len(i)))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(first), row["q_block"]), pa.int32()), pa.array(q.numbers[i[first]]), pa.array(bins[first]),
                pa.array(needs[i[first]]), pa.array(sizes.astype(np.int64))], names=["q_block", "row_no", "bin", "need", "n"])

    return grid.mapInArrow(count, "q_block int, row_no long, bin long, need long, n long")


def located(found: DataFrame) -> DataFrame:
    """(q_block, row_no, bin, need): the bin of the k-th best, and which of that bin's scores it is.

    With fewer than k scores it is the lowest bin.
    """
    total = found.groupBy("q_block", "row_no", "bin", "need").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("row_no").orderBy(F.desc("bin"))
    total = (total.withColumn("before", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)))
             .withColumn("before", F.coalesce("before", F.lit(0))).where("before < need"))
    last = F.max_by(F.struct("need", "before"), -F.col("bin"))
    return (total.groupBy("q_block", "row_no").agg(F.min("bin").alias("bin"), last.alias("at"))
            .select("q_block", "row_no", "bin", (F.col("at.need") - F.col("at.before")).alias("need")))


def kept(grid: DataFrame, k: int) -> DataFrame:
    """Scores from the k-th on; of those equal to it, a tile's k of smallest id (the others cannot be among the k)."""

    def keep(batches):
        for row, q, c in each_pair(batches):
            s = pair(q, c)
            limit = read_places(row["place"]).of(q.numbers)[0][:, None]
            equal = (s == limit) & (s != OWN)
            # Candidates are in order of their ids, so the first k of equal score have the smallest.
            i, j = np.nonzero((s > limit) | (equal & (np.cumsum(equal, axis=1) <= k)))
            if len(i):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q.ids[i]), pa.array(q.numbers[i]), pa.array(c.ids[j]), pa.array(s[i, j])],
                    names=["query_id", "row_no", "vec_id", "score"])

    return grid.mapInArrow(keep, "query_id long, row_no long, vec_id long, score long")
