"""Token-ID files: documents compressed one by one with a shared Zstandard dictionary (operator 9).

Layout of a file (little endian)::

    magic "CLTOK01\\n" | SHA-256 of the dictionary (32) | bytes per id (4)
    frame of document 0 | frame of document 1 | ...
    index: doc_id int64[n] | id present uint8[n] | offset uint64[n] | bytes uint32[n] | tokens uint32[n]
    offset of the index (8) | n (8) | magic

A short document is read by its index entry alone: seek, read, decompress one frame.
Files hold consecutive ranges of the ascending doc_id order; null ids come last, equal
ids are ordered by their ids' bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.common import file_name, hash_share, read_file, spread, stored, write_file
from cuelake.llm.wordbpe import opened
from cuelake.session import new_shared_path

MAGIC = b"CLTOK01\n"
HEAD = struct.Struct("<8s32sI")
TAIL = struct.Struct("<QQ8s")
SAMPLE_BYTES = 1 << 16

FRAMES = "doc_id long, part long, n_tokens long, frame binary"
FILES = "part long, file_no long, path string, docs long, tokens long, bytes long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long, file string, frame_offset long, frame_bytes long"


def id_width(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def encode_ids(text: str | None, vocabulary: str, end_id: int) -> np.ndarray:
    """Ids of a text (null: empty), closed by ``end_id``."""
    encoder = opened(vocabulary)
    return np.frombuffer(encoder.encode(text or "") + struct.pack("<I", end_id), "<u4")


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    shared = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    return zstandard.ZstdCompressor(level=3, write_content_size=True, write_checksum=True, **shared)


def decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    shared = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    return zstandard.ZstdDecompressor(**shared)


def train_dictionary(docs: DataFrame, vocabulary: str, end_id: int, total: int,
                     samples: int = 2000, size: int = 1 << 16) -> bytes:
    """Dictionary from about ``samples`` documents chosen by a hash of doc_id.

    At most 64 KB of each sampled array are used: a bound on the training only.  Where
    the sample is too small to train on, the dictionary is empty and frames are plain.
    """

    def serialize(batches):
        width = id_width(opened(vocabulary).size)
        for batch in batches:
            raw = [encode_ids(t, vocabulary, end_id).astype(width).tobytes()[:SAMPLE_BYTES]
                   for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary())], ["raw"])

    chosen = docs.where(hash_share("doc_id", samples, total)).select("text").mapInArrow(serialize, "raw binary")
    raw = sorted(bytes(r.raw) for r in chosen.collect())
    try:
        return zstandard.train_dictionary(size, raw).as_bytes() if raw else b""
    except zstandard.ZstdError:
        return b""


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int, *,
                      docs_per_range: int = 2048, most_ranges: int = 20_000, file_bytes: int = 32 << 20) -> DataFrame:
    """Write ``docs(doc_id, text)`` as token files under ``folder``; one row per file, in order.

    Ranges of doc_id come from quantiles of that column, so one pass over the texts is
    enough and a range is streamed: its files are cut at ``file_bytes``.  Null texts are
    empty, null ids come last; an empty table gives no file.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.count()
    ranges = max(1, min(most_ranges, total // docs_per_range))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)] or [0.5], 10 * ranges + 100)).first()[0]
    edges = np.array(sorted(set(cuts or [])), np.int64)
    dictionary = train_dictionary(docs, vocabulary, end_id, total)
    digest = hashlib.sha256(dictionary).hexdigest()
    write_file(f"{folder}/{digest}.dict", dictionary)

    def compress(batches):
        encoder, packer = opened(vocabulary), compressor(dictionary)
        width = id_width(encoder.size)
        end = np.array([end_id], width).tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                keys = part.column(0)
                counts, frames = [], []
                for flat, starts in encoder.encode_many(part.column(1)):
                    raw, size = flat.astype(width).tobytes(), np.dtype(width).itemsize
                    counts += (np.diff(starts) + 1).tolist()
                    frames += [packer.compress(raw[i:j] + end) for i, j in zip((starts[:-1] * size).tolist(), (starts[1:] * size).tolist())]
                ranged = np.searchsorted(edges, keys.fill_null(0).to_numpy(zero_copy_only=False), side="left")
                ranged[keys.is_null().to_numpy(zero_copy_only=False)] = len(edges) + 1
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(ranged, pa.int64()), pa.array(counts, pa.int64()), pa.array(frames, pa.binary())],
                    ["doc_id", "part", "n_tokens", "frame"])

    def write(batches):
        width = np.dtype(id_width(opened(vocabulary).size)).itemsize
        held, size, key, number = [], 0, None, 0

        def close():
            path = f"{folder}/{file_name(f'{key:08d}-{number:05d}-{TaskContext.get().partitionId()}', '.tok')}"
            tokens = sum(n for _, n, _ in held)
            data = token_file(held, bytes.fromhex(digest), width)
            write_file(path, data)
            return pa.RecordBatch.from_pylist([{"part": key, "file_no": number, "path": path, "docs": len(held),
                                                "tokens": tokens, "bytes": len(data)}], schema=FILE_SCHEMA)

        for batch in batches:
            for doc, part, n, frame in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (part != key or size + len(frame) > file_bytes):
                    yield close()
                    held, size, number = [], 0, number + 1
                if part != key:
                    key, number = part, 0
                held.append((doc, n, frame))
                size += len(frame)
        if held:
            yield close()

    tasks = max(1, min(ranges + 2, 20_000))
    files = (docs.mapInArrow(compress, FRAMES)
             .repartition(tasks, "part").sortWithinPartitions(F.col("part"), F.col("doc_id").asc_nulls_last(), "frame")
             .mapInArrow(write, FILES))
    return stored(files, "token-files")


FILE_SCHEMA = pa.schema([("part", pa.int64()), ("file_no", pa.int64()), ("path", pa.string()),
                         ("docs", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())])


def token_file(held: list[tuple[int | None, int, bytes]], digest: bytes, width: int) -> bytes:
    """Bytes of one file from (doc_id, tokens, frame) in order."""
    sizes = np.array([len(f) for _, _, f in held], "<u4")
    offsets = HEAD.size + np.concatenate([[0], np.cumsum(sizes[:-1], dtype=np.uint64)]).astype("<u8")
    frames = b"".join(f for _, _, f in held)
    index = b"".join([
        np.array([d or 0 for d, _, _ in held], "<i8").tobytes(),
        np.array([d is not None for d, _, _ in held], "u1").tobytes(),
        offsets.tobytes(), sizes.tobytes(), np.array([n for _, n, _ in held], "<u4").tobytes()])
    return b"".join([HEAD.pack(MAGIC, digest, width), frames, index,
                     TAIL.pack(HEAD.size + len(frames), len(held), MAGIC)])


def file_index(data: bytes) -> dict:
    """Header and index of a file's bytes."""
    magic, digest, width = HEAD.unpack_from(data)
    at, n, tail = TAIL.unpack_from(data, len(data) - TAIL.size)
    if magic != MAGIC or tail != MAGIC:
        raise ValueError("not a token file")
    out = {"dictionary": digest.hex(), "width": f"<u{width}"}
    for name, kind, step in (("doc_id", "<i8", 8), ("known", "u1", 1), ("offset", "<u8", 8), ("bytes", "<u4", 4), ("tokens", "<u4", 4)):
        out[name] = np.frombuffer(data, kind, n, at)
        at += step * n
    return out


def read_document(data: bytes, index: dict, k: int, unpack: zstandard.ZstdDecompressor) -> np.ndarray:
    """Ids of the k-th document of a file, from its frame alone."""
    start = int(index["offset"][k])
    raw = unpack.decompress(data[start:start + int(index["bytes"][k])])
    return np.frombuffer(raw, index["width"])


def read_token_files(files: DataFrame) -> DataFrame:
    """Read files back: one row per document with its global start, crc32 and place.

    ``files`` is what :func:`write_token_files` returned; each file is one work item.
    """
    order = Window.orderBy("part", "file_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("path", F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("base"))

    def read(batches):
        open_with: dict[str, zstandard.ZstdDecompressor] = {}
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = read_file(path)
                index = file_index(data)
                digest = index["dictionary"]
                if digest not in open_with:
                    shared = read_file(f"{path.rsplit('/', 1)[0]}/{digest}.dict")
                    if hashlib.sha256(shared).hexdigest() != digest:
                        raise ValueError(f"dictionary of {path} is not the one it was written with")
                    open_with[digest] = decompressor(shared)
                counts = index["tokens"].astype(np.int64)
                starts = base + np.concatenate([[0], np.cumsum(counts)])[:-1].astype(np.int64)
                crcs = []
                for k, n in enumerate(counts.tolist()):
                    ids = read_document(data, index, k, open_with[digest])
                    if len(ids) != n:
                        raise ValueError(f"{path}: document {k} has {len(ids)} ids, its index says {n}")
                    crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([
                    pa.array(index["doc_id"].astype(np.int64), mask=index["known"] == 0), pa.array(starts),
                    pa.array(counts), pa.array(crcs, pa.int64()), pa.array([path] * len(crcs)),
                    pa.array(index["offset"].astype(np.int64)), pa.array(index["bytes"].astype(np.int64))],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "file", "frame_offset", "frame_bytes"])

    return spread(placed, files.count()).mapInArrow(read, ROWS)


def token_file_round_trip(docs: DataFrame, vocabulary: str, end_id: int = 2, **options) -> DataFrame:
    """Write ``docs`` into a new shared folder and return what its files say."""
    folder = new_shared_path(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, folder, vocabulary, end_id, **options))
