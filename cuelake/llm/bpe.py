"""Byte-level BPE by a shuffle of distinct words (operator 1).

Texts are split into pre-tokens.  A block of documents (one task's stream, cut at a bounded
size) keeps its distinct pre-tokens once and the texts as positions into that list.  The
lists are dealt out by word (in buckets of a word hash, packed), each distinct word of the
corpus is encoded once, and its ids go back to every list that has it.  The texts are put together by position
from their block's list, whose size is bounded, so the texts themselves never move.
Decoding looks the ids up in the token-byte table, whose size the vocabulary bounds.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import claim_cache, read_file, stored, write_file
from cuelake.session import new_shared_path

#: White space before a blank: only there could a cut before the blank change the pre-tokens.
RISKY = re.compile("[\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000] ")
BLOCK_CHARS = 32 << 20

BUCKETS = 512

BLOCKS = "block long, doc_id long, codes binary, bucket int, places binary, words binary"
NAMES = ["block", "doc_id", "codes", "bucket", "places", "words"]
PACKED = "block long, places binary, sizes binary, ids binary"
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a vocabulary file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def shrink(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32 as byte planes, compressed."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3, write_content_size=True).compress(np.ascontiguousarray(planes).tobytes())


def unshrink(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def pack_words(words: list[bytes]) -> bytes:
    """Lengths, then the words' bytes, compressed."""
    raw = np.array([len(words)], "<u4").tobytes() + np.array([len(w) for w in words], "<u4").tobytes() + b"".join(words)
    return zstandard.ZstdCompressor(level=3, write_content_size=True).compress(raw)


def unpack_words(packed: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = (np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64) + 4 + 4 * n).tolist()
    return [raw[i:j] for i, j in zip([4 + 4 * n, *ends[:-1]], ends)]


class Block:
    """Distinct pre-tokens of some texts by number, and the texts as such numbers."""

    def __init__(self, pattern):
        self.pattern = pattern
        self.words: dict[str, int] = {}
        self.pieces: dict = {}  # a piece (without the blank before it), or (first piece,): its number
        self.flat: list[int] = []  # numbers of the pieces' words, one piece after another
        self.starts: list[int] = [0]
        self.rows: list[tuple] = []  # doc_id, numbers, whether they are pieces
        self.size = 0

    def numbers(self, part: str) -> list[int]:
        words = self.words
        return [words.setdefault(w, len(words)) for w in self.pattern.findall(part)]

    def piece(self, key, part: str) -> int:
        number = self.pieces.get(key)
        if number is None:
            number = self.pieces[key] = len(self.pieces)
            self.flat.extend(self.numbers(part))
            self.starts.append(len(self.flat))
        return number

    def add(self, doc_id: int | None, text: str) -> None:
        """A blank after a character that is not white space starts a pre-token: pieces between
        such blanks are matched once each.  A text with other blanks is matched as a whole."""
        self.size += len(text)
        if "  " in text or "\n " in text or RISKY.search(text):
            self.rows.append((doc_id, np.array(self.numbers(text), np.uint32), False))
            return
        head, *rest = text.split(" ")
        found = list(map(self.pieces.get, rest))
        if None in found:
            found = [self.piece(r, " " + r) if k is None else k for r, k in zip(rest, found)]
        self.rows.append((doc_id, np.array([self.piece((head,), head), *found], np.uint32), True))

    def codes(self):
        """(doc_id, numbers of the text's pre-tokens in order) of each text."""
        flat, starts = np.array(self.flat, np.uint32), np.array(self.starts, np.int64)
        for doc_id, numbers, pieces in self.rows:
            yield doc_id, spans(flat, starts, numbers) if pieces else numbers


def spans(flat: np.ndarray, starts: np.ndarray, picked: np.ndarray) -> np.ndarray:
    """``flat[starts[k]:starts[k + 1]]`` for each k in turn, as one array."""
    picked = picked.astype(np.int64)
    begin, sizes = starts[picked], starts[picked + 1] - starts[picked]
    shift = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)
    return flat[shift + np.arange(len(shift))]


def block_table(docs: DataFrame, pattern: str) -> DataFrame:
    """Blocks of documents: a row per document with its positions, and rows with the block's words."""

    def split(batches):
        claim_cache("bpe", _TABLES.clear)
        task, made, compiled = TaskContext.get().partitionId(), 0, regex.compile(pattern)
        held = Block(compiled)

        def flush():
            block = (task << 20) + made
            rows = [(d, shrink(c)) for d, c in held.codes()]
            for lo in range(0, len(rows), 2000):
                some = rows[lo:lo + 2000]
                yield pa.RecordBatch.from_arrays([
                    pa.array([block] * len(some), pa.int64()), pa.array([d for d, _ in some], pa.int64()),
                    pa.array([c for _, c in some], pa.binary()), pa.nulls(len(some), pa.int32()),
                    pa.nulls(len(some), pa.binary()), pa.nulls(len(some), pa.binary())], names=NAMES)
            words = [w.encode("utf-8", "surrogatepass") for w in held.words]
            bucket = np.array([zlib.crc32(w) % BUCKETS for w in words], np.int32)
            order = np.argsort(bucket, kind="stable")
            names, first = np.unique(bucket[order], return_index=True)
            parts = np.split(order, first[1:]) if len(names) else []
            yield pa.RecordBatch.from_arrays([
                pa.array([block] * len(names), pa.int64()), pa.nulls(len(names), pa.int64()), pa.nulls(len(names), pa.binary()),
                pa.array(names, pa.int32()), pa.array([shrink(p) for p in parts], pa.binary()),
                pa.array([pack_words([words[k] for k in p.tolist()]) for p in parts], pa.binary())], names=NAMES)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.add(doc, text or "")
                if held.size >= BLOCK_CHARS:
                    yield from flush()
                    held, made = Block(compiled), made + 1
        if held.rows:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(split, BLOCKS)


def encode_words(listed: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Rows (block, bucket, places, words) with the words' ids: dealt by bucket, so a word meets one task and is encoded once.

    A block has a word at most once, so one very frequent word is no heavy key.
    """

    def encode(batches):
        import tiktoken

        library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            for block, places, packed in zip(*(batch.column(c).to_pylist() for c in ("block", "places", "words"))):
                found = []
                for word in unpack_words(packed):
                    ids = known.get(word)
                    if ids is None:
                        if len(known) > 500_000:  # a very large share of the words: forget, to bound memory
                            known.clear()
                        ids = known[word] = library._encode_single_piece(word)
                    found.append(ids)
                yield pa.RecordBatch.from_arrays([
                    pa.array([block], pa.int64()), pa.array([places], pa.binary()),
                    pa.array([shrink(np.array([len(i) for i in found], np.uint32))], pa.binary()),
                    pa.array([shrink(np.array([k for i in found for k in i], np.uint32))], pa.binary())],
                    names=["block", "places", "sizes", "ids"])

    tasks = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return listed.repartition(tasks, "bucket").mapInArrow(encode, PACKED)


def write_lists(encoded: DataFrame, folder: str) -> None:
    """One file per block with its words' ids by number: sizes, then all ids."""

    def write(batches):
        key, held = None, []

        def close():
            places, sizes, ids = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(places)
            ids = spans(ids, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), order)
            raw = np.array([len(sizes)], "<u8").tobytes() + sizes[order].astype("<u4").tobytes() + ids.astype("<u4").tobytes()
            write_file(list_path(folder, key), zstandard.ZstdCompressor(level=3).compress(raw))
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int64())], names=["block"])

        for batch in batches:
            for block, *parts in zip(*(c.to_pylist() for c in batch.columns)):
                if block != key and held:
                    yield close()
                    held = []
                key = block
                held.append([unshrink(p) for p in parts])
        if held:
            yield close()

    tasks = int(encoded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stored(encoded.repartition(tasks, "block").sortWithinPartitions("block").mapInArrow(write, "block long"), "bpe-lists")


def list_path(folder: str, block: int) -> str:
    return f"{folder}/{block}.ids"


def read_list(folder: str, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, where each word's ids start) of a block."""
    raw = zstandard.ZstdDecompressor().decompressobj().decompress(read_file(list_path(folder, block)))
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    sizes = np.frombuffer(raw, "<u4", n, 8)
    return np.frombuffer(raw, "<u4", -1, 8 + 4 * n), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> tuple[DataFrame, str]:
    """Texts as positions by block, and the folder of the blocks' ids."""
    blocks = stored(block_table(docs, pattern), "bpe-blocks", compression="zstd")
    listed = blocks.where("words IS NOT NULL").select("block", "bucket", "places", "words")
    folder = new_shared_path(docs.sparkSession, "bpe-ids")
    write_lists(encode_words(listed, ranks_path, pattern), folder)
    return blocks.where("codes IS NOT NULL").select("block", "doc_id", "codes"), folder


def ids_of(batches, folder: str):
    """(doc_id, ids) of each document of batches of (block, doc_id, codes)."""
    key, ids, starts = None, None, None
    for batch in batches:
        for block, doc, raw in zip(*(c.to_pylist() for c in batch.columns)):
            codes = unshrink(raw)
            if not len(codes):
                yield doc, codes
                continue
            if block != key:
                ids, starts = read_list(folder, block)
                key = block
            yield doc, spans(ids, starts, codes)


def decode(ids: np.ndarray, table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, ids.tolist()))


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text is empty (no ids, hashes of no bytes); null and repeated ids stay rows of
    their own; an empty table gives no row.
    """
    texts, folder = encode_documents(docs, ranks_path, pattern)

    def digest(batches):
        table = token_bytes(ranks_path)
        rows: list[tuple] = []

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*rows), [pa.int64(), pa.int64(), pa.string(), pa.string()])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        for doc, ids in ids_of(batches, folder):
            rows.append((doc, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
                         hashlib.sha256(decode(ids, table)).hexdigest()))
            if len(rows) == 5000:
                yield out()
                rows = []
        if rows:
            yield out()

    return texts.mapInArrow(digest, RESULT)


_TABLES: dict[str, list[bytes]] = {}


def token_bytes(ranks_path: str) -> list[bytes]:
    """Bytes of each id, read once per worker."""
    if ranks_path not in _TABLES:
        ranks = read_ranks(ranks_path)
        table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        _TABLES[ranks_path] = table
    return _TABLES[ranks_path]
