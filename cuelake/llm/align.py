"""Alignment of two tokenizers over the same bytes, by products of sparse matrices (operator 12).

A tokenizing of a text is a 0/1 matrix in CSR form, tokens by bytes.  The product A * Bᵀ, row by
row (Gustavson), holds the number of bytes that two tokens share: the overlap links.  Overlaps
that end at one byte are the end links; they cut both sides into groups, and the product of the
token-by-group matrices gives the shared-group links.  End links are counted over the corpus by id pair:
the shorter of two such tokens is a suffix of the longer, so the vocabularies bound the
number of pairs, whatever the number of documents.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.bpe import read_ranks, spans
from cuelake.llm.common import claim_cache, stored

#: A blank between plain letters: no token of either kind spans it, so a long text may be cut there.
CUT = re.compile("(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
PART = 1 << 18
#: Entries of a product that are expanded at once.
BLOCK = 1 << 20
BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")

#: Lists of numbers are little-endian unsigned 32-bit ones, one after the other.
ALIGNED = "doc_id long, a_ids binary, b_ids binary, group_a binary, group_b binary, n_overlaps long, n_shared long"
LONGS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "n_overlaps", "n_shared"]
RESULT = "doc_id long, " + ", ".join(f"{c} long" for c in LONGS[:6]) + ", groups_sha256 string, n_overlaps long, n_shared long"


@dataclass
class Csr:
    """Sparse matrix of whole numbers: the columns and values of row i are those from indptr[i] to indptr[i + 1]."""

    indptr: np.ndarray
    indices: np.ndarray
    values: np.ndarray
    width: int

    @property
    def rows(self) -> int:
        return len(self.indptr) - 1

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) of each entry."""
        return np.repeat(np.arange(self.rows), np.diff(self.indptr)), self.indices


def runs_of(sizes: np.ndarray, of: int) -> Csr:
    """Row i has ones in the ``sizes[i]`` columns after those of the rows before it."""
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    return Csr(ends, np.arange(of, dtype=np.int64), np.ones(of, np.int64), of)


def turned(m: Csr) -> Csr:
    """The transpose."""
    row, col = m.pairs()
    ends = np.concatenate([[0], np.cumsum(np.bincount(col, minlength=m.width))])
    if len(col) < 2 or (col[1:] >= col[:-1]).all():
        return Csr(ends, row, m.values, m.rows)
    order = np.argsort(col, kind="stable")
    return Csr(ends, row[order], m.values[order], m.rows)


def product_blocks(a: Csr, b: Csr):
    """A * B by rows: row i is the sum of B's rows at the columns of A's row i, so weighted.

    Gives (first row, entries in each row, columns, values) for blocks of rows with about ``BLOCK``
    terms, so that no more of them are held at once (one row's terms at least).
    """
    widths = np.diff(b.indptr)
    terms = np.concatenate([[0], np.cumsum(widths[a.indices])])[a.indptr]  # before each row of A
    lo = 0
    while lo < a.rows:
        hi = max(lo + 1, int(np.searchsorted(terms, terms[lo] + BLOCK, "right")) - 1)
        at = a.indices[a.indptr[lo]:a.indptr[hi]]
        width = widths[at]
        row, val = np.repeat(np.arange(lo, hi), np.diff(a.indptr[lo:hi + 1])), a.values[a.indptr[lo]:a.indptr[hi]]
        if (width == 1).all():  # each term is one entry of B
            only = b.indptr[at]
            col, val = b.indices[only], val * b.values[only]
        else:
            row, col = np.repeat(row, width), spans(b.indices, b.indptr, at)
            val = spans(b.values, b.indptr, at) * np.repeat(val, width)
        key = row * b.width + col
        if len(key) > 1 and (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            row, col, val, key = row[order], col[order], val[order], key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        yield lo, np.bincount(row[first] - lo, minlength=hi - lo), col[first], np.add.reduceat(val, first) if len(first) else val
        lo = hi


def product(a: Csr, b: Csr) -> Csr:
    """A * B as a whole."""
    none = np.zeros(0, np.int64)
    _, sizes, cols, vals = zip((0, none, none, none), *product_blocks(a, b))
    return Csr(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), np.concatenate(cols), np.concatenate(vals), b.width)


def overlap_links(sizes_a: np.ndarray, sizes_b: np.ndarray) -> Csr:
    """Tokens of A by tokens of B: how many bytes they share.  The sizes in bytes of both add up to the same."""
    n = int(sizes_a.sum())
    return product(runs_of(sizes_a, n), turned(runs_of(sizes_b, n)))


def end_links(sizes_a: np.ndarray, sizes_b: np.ndarray, overlaps: Csr) -> tuple[np.ndarray, np.ndarray]:
    """(token of A, token of B) of the overlaps that end at the same byte."""
    i, j = overlaps.pairs()
    same = np.cumsum(sizes_a)[i] == np.cumsum(sizes_b)[j]
    return i[same], j[same]


def group_sizes(ends: np.ndarray) -> np.ndarray:
    """Tokens in each group, from the last token of each."""
    return np.diff(ends, prepend=-1)


def shared_group_links(group_a: np.ndarray, group_b: np.ndarray) -> Csr:
    """Tokens of A by tokens of B: one where they are in the same group, given the tokens in each group."""
    return product(turned(runs_of(group_a, int(group_a.sum()))), runs_of(group_b, int(group_b.sum())))


class Tokenizers:
    """Byte-level ranks (A) and a sentence-piece model (B), with the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str, pattern: str):
        import sentencepiece
        import tiktoken

        ranks = read_ranks(a_path)
        self.a = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.a_bytes[rank] = token
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := BYTE_PIECE.fullmatch(piece)) else piece.replace("▁", " ").encode()
                        for piece in map(self.b.id_to_piece, range(self.b.get_piece_size()))]
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in table], np.int64) for table in (self.a_bytes, self.b_bytes))

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides for a blank and the text; none where a side does not give these bytes back."""
        a, b, start = [], [], 0
        while start < len(text):
            cut = CUT.search(text, start + PART)
            stop = cut.start() if cut else len(text)
            part = text[start:stop]
            line = " " + part
            a.append(self.a.encode_to_numpy(line, disallowed_special=()).astype(np.int64))
            ids = self.b.encode(part, num_threads=1)
            line = line.encode("utf-8", "surrogatepass")
            # A's tokens cut the bytes it was given, so their sizes tell; B's need not be those of the text.
            if b"".join(map(self.b_bytes.__getitem__, ids)) != line or self.a_sizes[a[-1]].sum() != len(line):
                return None
            b.append(np.array(ids, np.int64))
            start = stop + 1
        return np.concatenate(a), np.concatenate(b)


_OPEN: dict = {}


def opened(*paths: str) -> Tokenizers:
    claim_cache("align", _OPEN.clear)
    if paths not in _OPEN:
        _OPEN[paths] = Tokenizers(*paths)
    return _OPEN[paths]


def sliced(batches, rows: int = 64):
    """Smaller batches: what is held per token is many times its text."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def packed(rows: list) -> pa.Array:
    return pa.array([r.astype("<u4").tobytes() for r in rows], pa.binary())


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4").astype(np.int64)


def alignments(docs: DataFrame, a_path: str, b_path: str, pattern: str) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: the ids of both sides and the tokens of each side in each group, packed.

    The last tokens of a group are linked (:func:`end_links`).  ``n_overlaps`` and ``n_shared`` count
    the overlap and shared-group links.  Texts that are null, empty, or that a side cannot
    give back have no tokens.
    """
    def align(batches):
        both = opened(a_path, b_path, pattern)
        for batch in sliced(batches):
            out = []
            for text in batch.column(1).to_pylist():
                found = both.encode(text) if text else None
                a, b = found or (np.zeros(0, np.int64),) * 2
                sizes_a, sizes_b = both.a_sizes[a], both.b_sizes[b]
                overlaps = overlap_links(sizes_a, sizes_b)
                i, j = end_links(sizes_a, sizes_b, overlaps)
                group_a, group_b = group_sizes(i), group_sizes(j)
                # As many as the entries of shared_group_links, which grow with the square of a group.
                out.append((a, b, group_a, group_b, len(overlaps.indices), int(group_a @ group_b)))
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[packed(c) for c in columns[:4]], *[pa.array(c, pa.int64()) for c in columns[4:]]],
                names=["doc_id", "a_ids", "b_ids", "group_a", "group_b", "n_overlaps", "n_shared"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(align, ALIGNED)


def links(aligned: DataFrame, a_path: str, b_path: str, pattern: str, kind: str = "overlap") -> DataFrame:
    """(doc_id, a, b, weight): links between token positions of :func:`alignments`.

    ``overlap``: tokens that share bytes (the weight); ``end``: those that end together; ``group``: tokens of one group.
    A product is written in blocks of rows, never as a whole.
    """
    def link(batches):
        both = opened(a_path, b_path, pattern)
        for batch in batches:
            for doc, *raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "a_ids", "b_ids", "group_a", "group_b"))):
                a, b, group_a, group_b = map(unpacked, raw)
                ends_a, ends_b = np.cumsum(sizes_a := both.a_sizes[a]), np.cumsum(sizes_b := both.b_sizes[b])
                if kind == "group":
                    factors = turned(runs_of(group_a, len(a))), runs_of(group_b, len(b))
                else:
                    factors = runs_of(sizes_a, int(sizes_a.sum())), turned(runs_of(sizes_b, int(sizes_b.sum())))
                for first, sizes, col, value in product_blocks(*factors):
                    row = np.repeat(np.arange(first, first + len(sizes)), sizes)
                    kept = ends_a[row] == ends_b[col] if kind == "end" else np.ones(len(row), bool)
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * int(kept.sum()), pa.int64()), *[pa.array(x[kept]) for x in (row, col, value)]],
                                                     names=["doc_id", "a", "b", "weight"])

    return aligned.select("doc_id", "a_ids", "b_ids", "group_a", "group_b").mapInArrow(link, "doc_id long, a long, b long, weight long")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers, where each row's start) of a column of packed numbers."""
    rows = column.to_pylist()
    return unpacked(b"".join(rows)), np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int64)


def linked_pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Id pairs of the end links of a batch as a * 2**32 + b, and where each row's start."""
    sides = []
    for ids, groups in (("a_ids", "group_a"), ("b_ids", "group_b")):
        values, _ = flat(batch.column(ids))
        sizes, starts = flat(batch.column(groups))
        sides.append(values[np.cumsum(sizes) - 1])
    return sides[0] << 32 | sides[1], starts


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): end links of each id pair over all documents."""

    def count(batches):
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in sliced(batches):
            found, n = np.unique(linked_pairs(batch)[0], return_counts=True)
            pairs, at = np.unique(np.concatenate([pairs, found]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), len(pairs)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], names=["pair", "n"])

    links = aligned.select("a_ids", "b_ids", "group_a", "group_b").mapInArrow(count, "pair long, n long")
    return links.groupBy("pair").agg(F.sum("n").alias("n"))


def most_pairs(a_path: str, b_path: str, pattern: str) -> int:
    """How many id pairs can end together: of two such tokens the shorter is a suffix of the longer."""
    both = opened(a_path, b_path, pattern)
    return int(both.a_sizes.sum() + both.b_sizes.sum())


def written_groups(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> np.ndarray:
    """Order in which ``a1,a2|b1;a3|b2,b3`` names the tokens: 4 * id for a token of A and 4 * id + 2 for one of B, one more for the last of its group."""
    out = np.empty(len(a) + len(b), np.int64)
    end_a, end_b = np.cumsum(group_a), np.cumsum(group_b)
    place_a = np.arange(len(a)) + np.repeat(end_b - group_b, group_a)
    place_b = np.arange(len(b)) + np.repeat(end_a, group_b)
    out[place_a], out[place_b] = 4 * a, 4 * b + 2
    out[place_a[end_a - 1]] += 1
    out[place_b[end_b - 1]] += 1
    return out


def group_words(n: int) -> list[str]:
    """Text of each number of :func:`written_groups`."""
    return [f"{k}{sign}" for k in range(n) for sign in ",|,;"]


def alignment_digests(docs: DataFrame, a_path: str, b_path: str, pattern: str) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: sizes of its alignment, how its links fare in the corpus, and the groups' digest.

    ``n_best`` counts the links whose id pair is as frequent in the corpus as any with the same B id,
    ``count_sum`` adds up the pairs' counts over the links.  Rows without tokens (null, empty, not given back)
    have zeros and an empty digest.  Null and repeated ids stay rows of their own; repeated texts
    count once per row; other columns are left alone; an empty table gives no row.
    """
    aligned = stored(alignments(docs, a_path, b_path, pattern), "aligned", **{"compression": "zstd", "parquet.block.size": str(16 << 20)})
    counts = stored(pair_counts(aligned), "pairs")
    both = opened(a_path, b_path, pattern)
    tokens = max(len(both.a_bytes), len(both.b_bytes))
    # The vocabularies bound the table that is sent to every task (about 0.5 million rows for 50,000 and 32,000 tokens).
    bound, held = most_pairs(a_path, b_path, pattern), counts.toArrow()
    if held.num_rows > bound:
        raise RuntimeError(f"{held.num_rows} id pairs end together; the vocabularies allow {bound}")
    pair, n = held.column("pair").to_numpy(), held.column("n").to_numpy()
    order = np.argsort(pair)
    pair, n = pair[order], n[order]
    top = np.zeros(int((pair & 0xFFFFFFFF).max(initial=0)) + 1, np.int64)
    np.maximum.at(top, pair & 0xFFFFFFFF, n)
    shared = docs.sparkSession.sparkContext.broadcast((pair, n, n == top[pair & 0xFFFFFFFF]))

    def digest(batches):
        pair, n, best = shared.value
        words = group_words(tokens)
        for batch in sliced(batches):
            links, starts = linked_pairs(batch)
            at = np.searchsorted(pair, links)
            sums, bests = (np.concatenate([[0], np.cumsum(x[at], dtype=np.int64)]) for x in (n, best))
            names = ["a_ids", "b_ids", "group_a", "group_b"]
            values = [flat(batch.column(c)) for c in names]
            sizes = [np.diff(s) for _, s in values]
            order = written_groups(*[v for v, _ in values]).tolist()
            cuts = (values[0][1] + values[1][1]).tolist()
            sha = [hashlib.sha256("".join(map(words.__getitem__, order[i:j]))[:-1].encode()).hexdigest() if j > i else ""
                   for i, j in zip(cuts, cuts[1:])]
            longs = [sizes[0], sizes[1], sizes[2], np.diff(starts), np.diff(bests[starts]), np.diff(sums[starts])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(x.astype(np.int64)) for x in longs], pa.array(sha, pa.string()), batch.column("n_overlaps"), batch.column("n_shared")],
                names=["doc_id", *LONGS[:6], "groups_sha256", "n_overlaps", "n_shared"])

    return aligned.mapInArrow(digest, RESULT)
