"""Near copies by SimHash and the Jaccard similarity of word shingles (stage of the pipeline).

Documents are linked where their sets of five-word shingles have a Jaccard similarity of 0.8 or more.
Operator 2 comes first: fingerprints within its radius give pairs, which are verified by their shingles, and
groups that these links join throughout are done.  A SimHash misses some similar sets, mostly of short
texts, so an exact join follows for what is not linked yet.

In any one order of all shingles, the first fifth of two such sets (and one more) shares a
shingle, so only documents that meet there are compared; no pair is missed, whatever the
order.  Shingles that are common in a sample come last in it, which keeps the groups small.

Where two sets meet at their first common shingle, what follows it in both bounds what they share, so
its positions tell whether they can be similar; sets that have only a form in common meet too late.
Members of a group are compared with two of them first.  After that, groups that are linked
throughout are done; in the others, members outside the largest component are compared with all that
are not linked with them.  So pairs are made of members that positions cannot tell apart, not of whole groups.

Pairs are held against parity sketches, whose differing bits never exceed the shingles that
differ, then compared shingle by shingle; texts never travel with pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import Hot, claim_cache, fresh, stored
from cuelake.llm.simhash import SEED, components, fingerprint, links

WIDTH = 5
SKETCH = 1024
#: Every tenth text (by hash) shows which shingles are common; so many of them are told to the tasks.
SHARE = 10
MOST_COMMON = 1_000_000
#: Members that a whole group is compared with.
CENTRES = 2


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct XXH64 of the ``width``-word shingles; words as in :func:`simhash.fingerprint`, no word gives none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]).tolist()
    return np.unique(np.array([xxhash.xxh64_intdigest(line[i:j - 1], SEED)
                               for i, j in zip([0, *ends[:-1]], ends[min(width, len(words)) - 1:])], np.uint64))


def first_fifth(found: np.ndarray, common: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The shingles of a set of which a similar set must share one: the rarest, as many as may differ and one more."""
    most = len(found) - -(-4 * len(found) // 5) + 1 if len(found) else 0
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        found = found[np.lexsort((found, np.where(common[at] == found, times[at], 0)))]
    return found[:most]


def parity_sketch(found: np.ndarray) -> np.ndarray:
    """``SKETCH`` bits: whether an odd number of shingles falls on each."""
    odd = np.bincount((found % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def every_shingle(texts: pa.Array) -> pa.Array:
    """:func:`shingles` of each text, as signed longs of the same bits."""
    claim_cache("similar", lambda: None)
    return pa.array([shingles(t).view(np.int64) for t in texts.to_pylist()], pa.list_(pa.int64()))


def common_shingles(source: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, counts) of those met twice or more in a sample of texts; at most ``MOST_COMMON``, the most common ones.

    They only order the shingles: similar documents are found with any list.
    """
    sample = source.where(F.pmod(F.xxhash64("text", F.lit("common")), F.lit(SHARE)) == 0)
    counts = stored(sample.select(F.explode(F.arrow_udf(every_shingle, "array<long>")("text")).alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "common")
    held, least = 0, None
    for r in sorted(counts.groupBy("n").agg(F.count("*").alias("rows")).collect(), reverse=True):
        held += r["rows"]
        if held > MOST_COMMON:
            break
        least = r.n
    top = counts.where(F.col("n") >= least).toArrow() if least else None
    if top is None or not top.num_rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, n = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def described(source: DataFrame, key: str) -> DataFrame:
    """Per row of the source: id, row number k, the set's digest, its size, first fifth and sketch, and the text's fingerprint."""
    shared = source.sparkSession.sparkContext.broadcast(common_shingles(source))

    @F.arrow_udf("struct<same:binary,n:long,fifth:array<long>,sketch:array<long>,fp:long>")
    def describe(texts: pa.Array) -> pa.Array:
        claim_cache("similar", lambda: None)
        common, times = shared.value
        same, sizes, fifths, sketches, prints = [], [], [], [], []
        for text in texts.to_pylist():
            found = shingles(text)
            same.append(xxhash.xxh3_128_digest(found.tobytes()))
            sizes.append(len(found))
            fifths.append(first_fifth(found, common, times).view(np.int64))
            sketches.append(parity_sketch(found))
            prints.append(fingerprint(text))
        longs = pa.list_(pa.int64())
        return pa.StructArray.from_arrays([pa.array(same, pa.binary()), pa.array(sizes, pa.int64()), pa.array(fifths, longs), pa.array(sketches, longs),
                                           pa.array(np.array(prints, np.uint64).view(np.int64))], ["same", "n", "fifth", "sketch", "fp"])

    return stored(source.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(key).alias("k"), describe("text").alias("s"))
                  .select("doc_id", "k", "s.*"), "sets")


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the ``pairs(a, b)`` of nodes that are similar: by sketch first, then shingle by shingle."""
    pairs = stored(pairs.distinct(), "pairs")
    side = lambda x: nodes.select(F.col("k").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    bits = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    one, two = Hot(pairs, "a"), Hot(pairs, "b")
    met = two.join(one.join(pairs, side("a"), "b"), side("b"), "a")
    # Similar sets differ in at most a ninth of their sizes' sum.
    near = stored(met.where(9 * bits <= F.col("n_a") + F.col("n_b")).select("a", "b", "n_a", "n_b"), "near-pairs")
    wanted = near.select(F.explode(F.array("a", "b")).alias("k")).distinct()
    held = stored(texts.join(wanted, "k", "left_semi").select("k", F.arrow_udf(every_shingle, "array<long>")("text").alias("held")), "near-sets")
    sets = lambda x: held.select(F.col("k").alias(x), F.col("held").alias(f"held_{x}"))
    one, two = Hot(near, "a"), Hot(near, "b")
    compared = two.join(one.join(near, sets("a"), "b"), sets("b"), "a")
    both = F.size(F.array_intersect("held_a", "held_b"))
    return stored(compared.where(9 * both >= 4 * (F.col("n_a") + F.col("n_b"))).select("a", "b"), "similar-pairs")


def possible(a: str, b: str):
    """Whether sets that meet at a shingle can be similar if it is the first they share: what follows it in both bounds what they share."""
    left = [F.col(f"n_{x}") - F.col(f"p_{x}") for x in (a, b)]
    return 9 * F.least(*left) >= 4 * (F.col(f"n_{a}") + F.col(f"n_{b}"))


def named(rows: DataFrame, x: str, key: str = "h") -> DataFrame:
    return rows.select(key, *[F.col(c).alias(f"{c}_{x}") for c in rows.columns if c != key])


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("k_a", "k_b").alias("a"), F.greatest("k_a", "k_b").alias("b"))


def print_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of the ``nodes(k, fp)`` by fingerprints: a node and the first with its fingerprint, and the firsts of linked fingerprints.

    A fingerprint goes with the nearest of those that the forest of links gives it, so pairs are no more than nodes.
    """
    firsts = stored(nodes.groupBy("fp").agg(F.min("k").alias("first"), F.count("*").alias("n")), "prints")
    same = Hot(nodes, "fp", counts=firsts.select("fp", "n")).join(nodes.select("fp", "k"), firsts.select("fp", "first"), "k").where("k != first")
    bits = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    nearest = stored(links(firsts.select("fp")).groupBy("a").agg(F.min(F.struct(bits.alias("bits"), "b")).alias("to")).select("a", "to.b"), "linked")
    first = lambda x: firsts.select(F.col("fp").alias(x), F.col("first").alias(f"k_{x}"))
    across = Hot(nearest, "b").join(nearest, first("b"), "a").join(first("a"), "a")
    return ordered(across).union(same.select(F.col("first").alias("a"), F.col("k").alias("b")))


def similar_labels(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, label) of the ``nodes(k, n, fifth, sketch, fp)`` that have a similar one: the smallest of the component."""
    by_print = verified(print_pairs(nodes), nodes, texts)
    known = stored(components(by_print), "print-labels").withColumnRenamed("node", "k")
    postings = nodes.join(known, "k", "left").select("k", "n", F.coalesce("label", "k").alias("known"), F.posexplode("fifth").alias("p", "h"))
    # The smaller of two similar sets meets the other in its first ninth; what fingerprints have linked throughout is done.
    met = (postings.groupBy("h").agg(F.count("*").alias("size"), F.max((9 * F.col("p") <= F.col("n")).cast("int")).alias("early"),
                                     F.min("known").alias("low"), F.max("known").alias("high")).where("size > 1 AND early = 1 AND low != high"))
    groups = stored(postings.join(met.select("h"), "h"), "groups")
    hot = Hot(groups, "h")

    centres = groups.groupBy("h").agg(*[F.min(F.struct(F.xxhash64("k", F.lit(turn)), "k", "n", "p", "known")).alias(f"c{turn}") for turn in range(CENTRES)])
    centres = centres.select("h", F.explode(F.array_distinct(F.array(*[F.struct(*[f"c{turn}.{c}" for c in ("k", "n", "p", "known")]) for turn in range(CENTRES)]))).alias("c"))
    met = hot.join(named(groups, "b"), named(centres.select("h", "c.*"), "a"), "k_b").where((F.col("known_a") != F.col("known_b")) & possible("a", "b"))
    edges = by_print.union(verified(ordered(met), nodes, texts))
    labels = stored(components(edges), "labels")

    linked = Hot(groups, "k").join(groups, labels.withColumnRenamed("node", "k"), "h", "left")
    members = stored(linked.withColumn("label", F.coalesce("label", "k")), "members")
    sizes = members.groupBy("h", "label").agg(F.count("*").alias("size"))
    mixed = stored(sizes.groupBy("h").agg(F.max(F.struct("size", "label")).alias("most"), F.count("*").alias("labels"))
                   .where("labels > 1").select("h", F.col("most.label").alias("largest")), "mixed")
    open_ = stored(hot.join(members, mixed, "k"), "open")
    outside = named(open_.where("label != largest").drop("largest"), "a")
    met = hot.join(named(open_.drop("largest"), "b"), outside, "k_b").where((F.col("label_a") != F.col("label_b")) & possible("a", "b"))
    more = verified(ordered(met), nodes, texts)
    return labels if more.isEmpty() else stored(components(edges.union(more)), "labels")


def keep_dissimilar(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component of similar documents: the one of its smallest doc_id.

    Columns stay as they are; equal sets are one node, texts without a word are alike.  Rows with equal
    doc_id and rows with a null id are told apart by a row number, as in :func:`simhash.keep_one`.
    """
    key = fresh(docs.columns, "row_no")
    source = stored(docs.withColumn(key, F.monotonically_increasing_id()), "docs")
    sets = described(source, key)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "k"))
    heads = stored(sets.groupBy("same").agg(first.alias("first")).select(F.col("first.k").alias("k"), "first"), "heads")
    nodes = stored(sets.drop("doc_id", "same").join(heads.select("k"), "k", "left_semi"), "nodes")
    labels = similar_labels(nodes, source.select(F.col(key).alias("k"), F.col("text")))
    kept = (heads.join(labels, heads.k == labels.node, "left").groupBy(F.coalesce("label", "k").alias("label"))
            .agg(F.min("first").alias("first")).select(F.col("first.k").alias(key)))
    return source.join(kept, key, "left_semi").select(*docs.columns)
