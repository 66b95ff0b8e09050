"""Interaction of document filters, by a Gray-code walk over all subsets (operator 13).

Each document gets a mask of the filters it fails.  Documents are counted per part, mask and
label, so a part is a few cells whatever its size.  A walk over the 2**k subsets of filters
switches one filter at a time; it keeps, per cell, how many active filters the cell fails, and the
running survivors.  The stored states (one per subset) give each step of each order as a difference.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import claim_cache, stored

LETTERS = "ABCDE"
SIGNS = re.compile(rb"[#$%&*|]")
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Documents, documents of good quality, toxic documents.
N_COUNTS = 3
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
RESULT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def failures(text: str | None) -> int:
    """Mask of the filters A to D (bits 0 to 3) that a text fails; null is empty."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return ((len(words) < 50) | (100 * len(set(words)) < 65 * len(words)) << 1
            | (100 * capitals > 5 * len(text)) << 2 | (SIGNS.search(raw) is not None) << 3)


def marked(docs: DataFrame) -> DataFrame:
    """(part, doc_id, same, mask) per row: ``same`` stands for the text, ``mask`` has filters A to D."""

    @F.arrow_udf("struct<same:binary,mask:int>")
    def judge(texts: pa.Array) -> pa.Array:
        claim_cache("audit", lambda: None)
        same, masks = [], []
        for text in texts.to_pylist():
            same.append(hashlib.sha256((text or "").encode("utf-8", "surrogatepass")).digest())
            masks.append(failures(text))
        return pa.StructArray.from_arrays([pa.array(same, pa.binary()), pa.array(masks, pa.int32())], ["same", "mask"])

    return docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("doc_id").cast("long").alias("doc_id"),
                       judge("text").alias("j")).select("part", "doc_id", "j.same", "j.mask")


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters that they fail, E included.

    Rows meet by (text, id) first and by text after that, both with partial counts, so that a
    text or an id which a third of all rows share is a handful of rows before it is dealt out.
    """
    known = (labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
                  F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("bad")))
    rows = stored(marked(docs).groupBy("doc_id", "same", "part", "mask").agg(F.count("*").alias("n")), "audit-rows")
    labelled = rows.where("doc_id IS NOT NULL").join(known, "doc_id", "left")
    unknown = rows.where("doc_id IS NULL").withColumns({"good": F.lit(0), "bad": F.lit(0)})
    every = labelled.select("doc_id", "same", "part", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"),
                            F.coalesce("bad", F.lit(0)).alias("bad")).unionByName(unknown)
    # Rows of one text: those with the smallest id (of all parts) pass E, as do those without an id.
    groups = every.groupBy("same", "part", "mask", "good", "bad").agg(
        F.sum("n").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"))
    least = groups.groupBy("same").agg(F.min("first.doc_id").alias("least"))
    judged = groups.join(least, "same")
    first = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    passing = F.col("no_id") + first
    both = judged.select("part", "good", "bad", F.explode(F.array(
        F.struct(F.col("mask"), passing.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - passing).alias("n")))).alias("c"))
    n = F.col("c.n")
    return both.groupBy("part", F.col("c.mask").alias("mask")).agg(
        F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("bad")).alias("toxic"))


def walk(masks: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Survivors of each of the 2**k subsets of filters: row s has the counts of the cells that fail no filter of s.

    The subsets come in Gray-code order, so that one filter is switched at a time.
    """
    active = np.zeros(len(masks), np.int64)
    running = counts.sum(axis=0) if len(masks) else np.zeros(counts.shape[1], np.int64)
    states = np.zeros((1 << k, counts.shape[1]), np.int64)
    states[0] = running
    subset = 0
    for turn in range(1, 1 << k):
        bit = (turn & -turn).bit_length() - 1
        subset ^= 1 << bit
        failing = (masks >> bit) & 1 == 1
        if subset >> bit & 1:
            running = running - counts[failing & (active == 0)].sum(axis=0)
            active[failing] += 1
        else:
            active[failing] -= 1
            running = running + counts[failing & (active == 0)].sum(axis=0)
        states[subset] = running
    return states


def steps(masks: np.ndarray, counts: np.ndarray, letters: str = LETTERS):
    """Rows (order, step, *COUNTS) of one part, for all orders of the filters."""
    k = len(letters)
    states = walk(masks, counts, k)
    failing = [int(counts[(masks >> b) & 1 == 1, 0].sum()) for b in range(k)]
    alone = [int(counts[masks == 1 << b, 0].sum()) for b in range(k)]
    # Over all orders, the filters before b form the subset s in |s|! (k - 1 - |s|)! of them.
    shapley = [sum(math.factorial(s.bit_count()) * math.factorial(k - 1 - s.bit_count()) * int(states[s, 0] - states[s | 1 << b, 0])
                   for s in range(1 << k) if not s >> b & 1) for b in range(k)]
    for order in itertools.permutations(range(k)):
        name, before = "".join(letters[b] for b in order), 0
        for step, b in enumerate(order, 1):
            after = before | 1 << b
            removed, good, toxic = (int(x) for x in states[before] - states[after])
            yield name, step, int(states[after, 0]), removed, failing[b] - removed, alone[b], good, toxic, shapley[b]
            before = after


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part (source) of ``docs(doc_id, text, source)``, order of the five filters and step: what the step does.

    Null texts are empty, a null source is the empty string.  Rows count one by one, repeated ones
    too; a row without an id has no smaller and is smaller than none.  A document is good (toxic)
    if any of its rows in ``labels(doc_id, quality, toxic)`` says so; labels without an id are not
    used.  Other columns, whatever their names, are left alone.  An empty table gives no row.
    """
    held = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))

    def orders(batches):
        for batch in batches:
            for part, found in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist()):
                masks = np.array([c["mask"] for c in found], np.int64)
                counts = np.array([[c["n"], c["good"], c["toxic"]] for c in found], np.int64).reshape(-1, N_COUNTS)
                name, step, *numbers = zip(*steps(masks, counts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(name)), pa.array(name), pa.array(step, pa.int32()), *[pa.array(n, pa.int64()) for n in numbers]],
                    names=["part", "filter_order", "step", *COUNTS])

    return held.mapInArrow(orders, RESULT)


SQL = """
WITH d AS (SELECT doc_id::BIGINT AS doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents),
l AS (SELECT doc_id::BIGINT AS doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
firsts AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
worded AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
masked AS (
    SELECT w.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
        (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
        + 4 * (100 * length(regexp_replace(w.text, '[^A-Z]+', '', 'g')) > 5 * length(w.text))::INT
        + 8 * regexp_matches(w.text, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > f.least, false)::INT AS mask
    FROM worded w JOIN firsts f ON w.text = f.text LEFT JOIN l ON w.doc_id = l.doc_id),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masked GROUP BY part, mask),
letters AS (SELECT unnest([0, 1, 2, 3, 4]) AS b),
orders AS (
    SELECT [p.b, q.b, r.b, s.b, t.b] AS o FROM letters p, letters q, letters r, letters s, letters t
    WHERE len(list_distinct([p.b, q.b, r.b, s.b, t.b])) = 5),
steps AS (
    SELECT array_to_string(list_transform(o, lambda x: chr((65 + x)::INT)), '') AS filter_order, step, o[step] AS b,
        coalesce(list_sum(list_transform(o[1:step - 1], lambda x: 1 << x)), 0)::INT AS before
    FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
counted AS (
    SELECT part, filter_order, step, b,
        coalesce(sum(n) FILTER (WHERE mask & (before | (1 << b)) = 0), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & (1 << b) != 0), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (WHERE mask & before != 0 AND mask & (1 << b) != 0), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (WHERE mask = 1 << b), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (WHERE mask & before = 0 AND mask & (1 << b) != 0), 0)::BIGINT AS good_lost,
        coalesce(sum(toxic) FILTER (WHERE mask & before = 0 AND mask & (1 << b) != 0), 0)::BIGINT AS toxic_lost
    FROM cells, steps GROUP BY part, filter_order, step, b)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    sum(removed) OVER (PARTITION BY part, b)::BIGINT AS shapley
FROM counted
"""
