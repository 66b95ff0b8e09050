"""Packing of documents into fixed windows by non-negative least squares (operator 6).

Documents are cut at multiples of the window; what remains of each is rounded up to a
length class.  All combinations of at most three classes that fill a window exactly
are enumerated, non-negative least squares gives how often each should be used so
that the classes' histogram is met, the counts are rounded down, and a greedy pass over
the remaining histogram packs the rest.  The plan is made from the histogram alone (a
bounded number of classes); pieces find their sequence by their rank in their class.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.common import stored
from cuelake.llm.wordbpe import opened

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, class int, nth long"


def cut_pieces(docs: DataFrame, vocabulary: str, end_id: int, window: int, unit: int) -> DataFrame:
    """Tokenise and cut; ``nth`` counts the pieces of a class within a task's output, ``part`` names the task."""

    def cut(batches):
        encoder, part = opened(vocabulary), TaskContext.get().partitionId()
        end, seen = struct.pack("<I", end_id), np.zeros(window // unit + 1, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                rows = []
                some = batch.slice(lo, 2048)
                for doc, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    raw = encoder.encode(text or "") + end
                    total = len(raw) // 4
                    for start in range(0, total, window):
                        length = min(window, total - start)
                        kind = -(-length // unit)
                        rows.append((doc, start, length, zlib.crc32(raw[4 * start:4 * (start + length)]), total,
                                     part, kind, int(seen[kind])))
                        seen[kind] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 6 + [pa.int32(), pa.int64()])],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "class", "nth"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def shallow_fills(classes: list[int], full: int) -> list[tuple[int, ...]]:
    """All ways to fill ``full`` units exactly with two or three of the classes."""
    held, found = set(classes), []
    for a in classes:
        if full - a in held and full - a <= a:
            found.append((a, full - a))
        for b in classes:
            c = full - a - b
            if a >= b >= c > 0 and c in held:
                found.append((a, b, c))
    return found


def least_squares(matrix: np.ndarray, target: np.ndarray, rounds: int = 600) -> np.ndarray:
    """x >= 0 that minimises |matrix x - target|, by an active set that grows by the steepest column."""
    x, active = np.zeros(matrix.shape[1]), []
    for _ in range(rounds):
        slope = matrix.T @ (target - matrix @ x)
        slope[active] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= 1e-6 * max(1.0, float(target.max(initial=0))):
            break
        active.append(best)
        while True:
            used = matrix[:, active]
            wanted = np.linalg.solve(used.T @ used + 1e-9 * np.eye(len(active)), used.T @ target)
            if (wanted > 0).all():
                x[:] = 0
                x[active] = wanted
                break
            now = x[active]
            falling = wanted <= 0
            step = float(np.min(now[falling] / np.maximum(now[falling] - wanted[falling], 1e-12)))
            moved = now + step * (wanted - now)
            x[:] = 0
            x[active] = np.maximum(moved, 0)
            kept = [a for a, m, f in zip(active, moved, falling) if not (f and m <= 1e-9)]
            if len(kept) == len(active):
                kept = [a for a, f in zip(active, falling) if not f]
            active = kept
            if not active:
                break
    return x


def plan(histogram: dict[int, int], full: int) -> list[tuple[tuple[int, ...], int]]:
    """(classes of a sequence, how many such sequences) that use up the histogram exactly."""
    left = {c: n for c, n in histogram.items() if n > 0}
    made: list[tuple[tuple[int, ...], int]] = []

    def use(mix: tuple[int, ...], times: int) -> None:
        if times > 0:
            made.append((mix, times))
            for c in mix:
                left[c] -= times

    use((full,), left.get(full, 0))
    classes = sorted((c for c, n in left.items() if n), reverse=True)
    fills = shallow_fills(classes, full)
    if fills:
        at = {c: i for i, c in enumerate(classes)}
        matrix = np.zeros((len(classes), len(fills)))
        for j, mix in enumerate(fills):
            for c in mix:
                matrix[at[c], j] += 1
        counts = least_squares(matrix, np.array([left[c] for c in classes], float))
        for j in np.argsort(-counts, kind="stable").tolist():
            mix = fills[j]
            most = min(left[c] // mix.count(c) for c in set(mix))
            use(mix, min(int(counts[j]), most))
    while classes := sorted((c for c, n in left.items() if n), reverse=True):
        mix, gap, spare = [], full, dict(left)
        for c in classes:
            n = min(gap // c, spare[c])
            mix += [c] * n
            gap -= n * c
        use(tuple(mix), min(left[c] // mix.count(c) for c in set(mix)))
    return made


def slots(made: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, end rank, first sequence, slot): where the ranks of a class go."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for mix, times in made:
        for slot, c in enumerate(mix):
            rank = used.get(c, 0)
            out.append((c, rank, rank + times, sequence, slot))
            used[c] = rank + times
        sequence += times
    return out


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, window: int = 4096, unit: int = 16) -> DataFrame:
    """Pieces of all documents with their sequence and offset.

    A null text is empty (one piece: the end id); ids of documents may be null or
    repeat, each row is packed by itself; an empty table gives no piece.  ``unit`` must divide
    ``window``; a sequence holds at most ``window`` tokens and no gap.
    """
    pieces = stored(cut_pieces(docs, vocabulary, end_id, window, unit), "pieces")
    counts = pieces.groupBy("class", "part").agg(F.count("*").alias("n"))
    order = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("class", "part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    histogram = {r["class"]: r.n for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    table = slots(plan(histogram, window // unit))
    by_class: dict[int, list] = {}
    for row in table:
        by_class.setdefault(row[0], []).append(row[1:])
    lookup = {c: np.array(sorted(rows), np.int64) for c, rows in by_class.items()}

    def assign(batches):
        for batch in batches:
            kind = batch.column("class").to_numpy()
            rank = batch.column("base").to_numpy() + batch.column("nth").to_numpy()
            sequence, slot = np.zeros(len(kind), np.int64), np.zeros(len(kind), np.int64)
            for c in np.unique(kind).tolist():
                here = np.flatnonzero(kind == c)
                found = lookup[c][np.searchsorted(lookup[c][:, 1], rank[here], side="right")]
                sequence[here] = found[:, 2] + rank[here] - found[:, 0]
                slot[here] = found[:, 3]
            kept = [batch.column(n) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(slot)], [
                "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"])

    placed = pieces.join(bases, ["class", "part"]).mapInArrow(
        assign, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long")
    within = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(within), F.lit(0)).alias("offset"))
