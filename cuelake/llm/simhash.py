"""Near-duplicates by SimHash: exact tiled comparison of fingerprints (operator 2).

Distinct fingerprints are dealt into tiles of neighbouring population counts.  Two
fingerprints within the radius have population counts within the radius, so tile
pairs farther apart are skipped; the others meet in one task each and are compared with
exclusive-or and bit counts.  Inside a tile pair the same rule is used again on the
population counts of the four 16-bit quarters (their differences add up to at most the
radius).  A task returns a forest of its links, never all pairs of a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelake.llm.common import Hot, claim_cache, fresh, stored

SEED = 42
LANES = np.uint64(0x0101010101010101)
PART = 1 << 16
PAIRS = 1 << 22


def fingerprint(text: str | None, width: int = 4) -> int:
    """64-bit SimHash of the ``width``-word shingles of a text; repeats count, no word gives 0.

    A-Z are lower-cased and words are what ASCII white space separates; a text of fewer
    words is one shingle.  A bit is set where over half of the shingles' XXH64 have it.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    totals, n = np.zeros(64, np.int64), max(1, len(words) - width + 1)
    for lo in range(0, n, PART):
        some = words[lo:lo + PART + width - 1]
        line = b" ".join(some)
        ends = np.cumsum([len(w) + 1 for w in some]).tolist()
        starts = [0, *ends[:-1]]
        hashes = np.array([xxhash.xxh64_intdigest(line[i:j - 1], SEED)
                           for i, j in zip(starts, ends[min(width, len(some)) - 1:])], np.uint64)
        totals += bit_totals(hashes)
    return int(sum(1 << int(k) for k in np.flatnonzero(2 * totals > n)))


def bit_totals(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit: byte lanes are added, 255 hashes at a time."""
    blocks = -(-len(hashes) // 255)
    padded = np.zeros((blocks, 255), np.uint64)
    padded.reshape(-1)[:len(hashes)] = hashes
    out = np.zeros(64, np.int64)
    for bit in range(8):
        lanes = ((padded >> np.uint64(bit)) & LANES).sum(axis=1, dtype=np.uint64)
        out[bit::8] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return out


def fingerprints(texts: pa.Array) -> pa.Array:
    """:func:`fingerprint` of each text, as a signed long of the same bits."""
    claim_cache("simhash", lambda: None)
    found = np.array([fingerprint(t) for t in texts.to_pylist()], np.uint64)
    return pa.array(found.view(np.int64))


def fingerprint_column(text: str | Column) -> Column:
    return F.arrow_udf(fingerprints, T.LongType())(text)


class Forest:
    """Links between numbered nodes, kept as the smallest number of each component."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            a, b = root[a], root[b]
            open_ = a != b
            a, b = a[open_], b[open_]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := root[root], root):
                root[:] = up


def quarters(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values.view(np.uint16)).reshape(-1, 4)


def by_quarters(values: np.ndarray):
    """Values ordered by the population counts of their quarters; the distinct counts and where they start."""
    counts = quarters(values)
    code = counts.astype(np.int64) @ np.array([17 ** 3, 17 ** 2, 17, 1])
    order = np.argsort(code, kind="stable")
    _, first = np.unique(code[order], return_index=True)
    return order, counts[order][first].astype(np.int16), np.append(first, len(values))


def tile_links(left: np.ndarray, right: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between two tiles of fingerprints, as (fingerprint, root fingerprint)."""
    every = left if same else np.concatenate([left, right])
    shift = 0 if same else len(left)
    forest = Forest(len(every))
    order_a, kinds_a, from_a = by_quarters(left)
    order_b, kinds_b, from_b = by_quarters(right)
    a, b, sizes_b = left[order_a], right[order_b], np.diff(from_b)
    for k in range(len(kinds_a)):
        near = np.abs(kinds_b - kinds_a[k]).sum(axis=1) <= radius
        at_b = np.flatnonzero(np.repeat(near, sizes_b))
        if not len(at_b):
            continue
        close = b[at_b]
        step = max(1, PAIRS // len(at_b))
        for lo in range(int(from_a[k]), int(from_a[k + 1]), step):
            hi = min(lo + step, int(from_a[k + 1]))
            i, j = np.nonzero(np.bitwise_count(a[lo:hi, None] ^ close[None, :]) <= radius)
            i, j = order_a[lo + i], order_b[at_b[j]] + shift
            keep = i < j if same else i != j
            if keep.any():
                forest.add(i[keep], j[keep])
    linked = np.flatnonzero(forest.root != np.arange(len(every)))
    return every[linked], every[forest.root[linked]]


def tiles(counts: dict[int, int], size: int) -> list[tuple[int, int, int]]:
    """Ranges of population counts with about ``size`` fingerprints or more: (from, to, how many tiles)."""
    out, start, held = [], None, 0
    for p in sorted(counts):
        start = p if start is None else start
        held += counts[p]
        if held >= size:
            out.append((start, p, -(-held // size)))
            start, held = None, 0
    if held:
        out.append((start, max(counts), -(-held // size)))
    return out


def links(prints: DataFrame, radius: int = 4, most: int = 1 << 18) -> DataFrame:
    """Forest of the links among distinct ``prints(fp)``: rows (a, b) that differ in at most ``radius`` bits or are joined by others that do.

    The tiles grow with the input up to ``most`` fingerprints (2 MB), so there are few
    tile pairs; no link is dropped.
    """
    weighed = prints.select("fp", F.expr("bit_count(fp)").alias("ones"))
    counts = {r.ones: r.n for r in weighed.groupBy("ones").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    ranges = tiles(counts, max(512, min(most, -(-total // 16))))
    numbered, first = [], 0
    for lo, hi, n in ranges:
        numbered.append((lo, hi, first, n))
        first += n
    tile = F.lit(None).cast("int")
    for lo, hi, base, n in numbered:
        spot = (F.lit(base) + F.pmod(F.xxhash64("fp", F.lit("tile")), F.lit(n))).cast("int")
        tile = F.when(F.col("ones").between(lo, hi), spot).otherwise(tile)
    spans = [(lo, hi) for lo, hi, _, n in numbered for _ in range(n)]
    near = [[j for j, (lo, hi) in enumerate(spans) if lo - b <= radius and a - hi <= radius] for a, b in spans]
    later = [[j for j in js if j >= i] for i, js in enumerate(near)]
    earlier = [[j for j in js if j <= i] for i, js in enumerate(near)]

    def partners(lists):
        rows = [F.array(*[F.lit(j) for j in js]).cast("array<int>") for js in lists] or [F.array().cast("array<int>")]
        return F.explode(F.get(F.array(*rows), F.col("tile")))

    packed = stored(weighed.select("fp", tile.alias("tile")).groupBy("tile").agg(F.collect_list("fp").alias("fps")), "tiles")
    left = packed.select(F.col("tile").alias("i"), partners(later).alias("j"), F.col("fps").alias("left"))
    right = packed.select(F.col("tile").alias("j"), partners(earlier).alias("i"), F.col("fps").alias("right"))

    def compare(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                i, j = batch.column("i")[k].as_py(), batch.column("j")[k].as_py()
                one, two = (np.asarray(batch.column(c)[k].values.to_numpy(), np.int64).view(np.uint64) for c in ("left", "right"))
                a, b = tile_links(one, two, radius, i == j)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    pairs = left.join(right, ["i", "j"]).repartition(max(1, sum(map(len, later))), "i", "j")
    return pairs.mapInArrow(compare, "a long, b long")


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, label) of every node of ``edges(a, b)``: the smallest node of its component.

    Alternates stars around the smallest neighbour, of larger neighbours and of smaller
    ones, until nothing changes; each round is a written table.
    """
    state = stored(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u != v").distinct(), "links")
    seen = None
    for _ in range(most_rounds):
        both = state.select("v", "u").union(state.select(F.col("u").alias("v"), F.col("v").alias("u")))
        lowest = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = Hot(both, "v").join(both, lowest, "u").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u != v").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (large.join(least, "v").select(F.explode(F.array(
            F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct("v", F.col("m").alias("u")))).alias("e"))
            .select("e.*").where("u != v").distinct())
        state = stored(small, "links")
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components still change after {most_rounds} rounds")
    return state.select(F.col("v").alias("node"), F.col("u").alias("label")).union(
        state.select(F.col("u").alias("node"), F.col("u").alias("label"))).distinct()


def near_duplicates(docs: DataFrame, radius: int = 4) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, fingerprint and component_id.

    The component id is the smallest doc_id that links of at most ``radius`` bits reach,
    itself included; ids that are null do not count (a component of null ids only has a
    null id).  Null and empty texts have fingerprint zero and are linked like others.
    """
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_column("text").alias("fp")), "prints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "nodes")
    labels = stored(components(links(nodes.select("fp"), radius)), "labels")
    grouped = stored(nodes.join(labels, nodes.fp == labels.node, "left").select(
        "fp", "first_id", F.coalesce("label", "fp").alias("label")), "grouped")
    smallest = grouped.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_print = Hot(grouped, "label").join(grouped, smallest, "fp").select("fp", "component_id")
    return Hot(rows, "fp", counts=nodes.select("fp", "n")).join(rows, of_print, F.coalesce("doc_id", "fp")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 4) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: the one of its smallest doc_id.

    Columns stay as they are.  Rows with equal doc_id and rows with a null id are told apart by a
    row number of the written input, so exactly one row of a component is kept.
    """
    key = fresh(docs.columns, "row_no")
    print_name = fresh(docs.columns, "fp")
    source = stored(docs.withColumn(key, F.monotonically_increasing_id()).withColumn(print_name, fingerprint_column("text")), "docs")
    rows = source.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(key).alias("k"), F.col(print_name).alias("fp"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "k"))
    nodes = rows.groupBy("fp").agg(first.alias("first"))
    labels = stored(components(links(nodes.select("fp"), radius)), "labels")
    heads = (nodes.join(labels, nodes.fp == labels.node, "left")
             .groupBy(F.coalesce("label", "fp").alias("label")).agg(F.min("first").alias("first")).select(F.col("first.k").alias(key)))
    return source.join(heads, key, "left_semi").select(*docs.columns)
