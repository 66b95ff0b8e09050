"""WARC archives as seekable Zstandard bundles (operator 7).

A bundle is a row of independent Zstandard frames, each a group of whole WARC records,
closed by a seek table in a skippable frame (the public seekable format: sizes of each frame
before and after compression, number of frames, descriptor, magic).  Any Zstandard
tool can unpack a bundle; :func:`fetch` reads one record by its frame and its offset in it.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import Hot, file_name, file_system, read_file, spread, stored, write_file
from cuelake.session import new_shared_path

# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 32 << 20
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id long, bundle string, frame long, start long, length long"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(value: str) -> int | None:
    number = value.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def one_line(value: str | None) -> str:
    return "" if value is None else value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers: bool, head_id: int | None) -> bytes:
    """A response record, or a revisit of ``head_id``'s response without the payload; both have the HTTP head."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {record_id(page_id)}",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {one_line(url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(head_id)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse(data: bytes, start: int) -> tuple[dict[str, str], bytes, bytes, int]:
    """(WARC fields, HTTP head, payload, end) of the record at ``start``."""
    blank = data.index(b"\r\n\r\n", start)
    lines = data[start:blank].decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record at {start}")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    begin = blank + 4
    end = begin + int(fields["Content-Length"])
    split = data.index(b"\r\n\r\n", begin) + 4
    return fields, data[begin:split], data[split:end], end + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", packed, plain) for packed, plain in sizes)
    body += struct.pack("<IBI", len(sizes), 0, SEEK_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(tail: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, size) of each frame, from the end of a bundle."""
    n, flags, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEK_MAGIC:
        raise ValueError("no seek table")
    step = 12 if flags & 0x80 else 8
    at, out = 0, []
    for k in range(n):
        packed, plain = struct.unpack_from("<II", tail, len(tail) - 9 - step * (n - k))
        out.append((at, packed, plain))
        at += packed
    return out


class Bundle:
    """A bundle in the making: records fill a frame, frames fill the bundle."""

    def __init__(self):
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.open_bytes = self.bytes = 0
        self.index: list[tuple] = []

    def add(self, page_id: int | None, data: bytes) -> None:
        if self.open and self.open_bytes + len(data) > FRAME_BYTES:
            self.close_frame()
        self.index.append((page_id, len(self.frames), self.open_bytes, len(data)))
        self.open.append(data)
        self.open_bytes += len(data)

    def close_frame(self) -> None:
        if self.open:
            plain = b"".join(self.open)
            packed = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True).compress(plain)
            self.frames.append(packed)
            self.sizes.append((len(packed), len(plain)))
            self.bytes += len(packed)
            self.open, self.open_bytes = [], 0

    def close(self) -> bytes:
        self.close_frame()
        return b"".join([*self.frames, seek_table(self.sizes)])


def with_heads(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Pages with payload, digest and, for those that revisit another, the id of its response.

    Of equal payloads of at least ``least`` bytes the one of the largest page_id is the
    response (rows that share it are all responses; null ids come last).  Equal means an equal
    SHA-256.  Only groups of two or more are joined back, and counts are taken before any shuffle.
    Smaller payloads take no part in the join, and the copies of one that is very common are dealt over tasks.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    key = F.sha2("payload", 256)
    keyed = rows.withColumn("same", F.when(F.octet_length("payload") >= least, key))
    large = keyed.where("same IS NOT NULL")
    heads = stored(large.groupBy("same").agg(F.max("page_id").alias("head_id"), F.count("*").alias("n")).where("n > 1"), "warc-heads")
    wanted = heads.where("head_id IS NOT NULL").select("same", "head_id")
    joined = Hot(rows, "same", counts=heads).join(large, wanted, F.coalesce("page_id", F.length("url")), "left").unionByName(
        keyed.where("same IS NULL").withColumn("head_id", F.lit(None).cast("long")))
    refers = F.col("head_id").isNotNull() & ~F.col("head_id").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "payload", F.sha1("payload").alias("digest"), refers.alias("refers"), "head_id")


def write_bundles(pages: DataFrame, folder: str, least: int = 1000) -> DataFrame:
    """Write ``pages(page_id, url, html)`` and return the index: each record's bundle, frame, offset in the frame and length."""

    def write(batches):
        bundle, number = Bundle(), 0

        def close():
            nonlocal bundle, number
            path = f"{folder}/{file_name(f'{TaskContext.get().partitionId():06d}-{number:05d}', '.warc.zst')}"
            write_file(path, bundle.close())
            columns = list(zip(*bundle.index))
            out = pa.RecordBatch.from_arrays([
                pa.array(columns[0], pa.int64()), pa.array([path] * len(bundle.index)),
                *[pa.array(c, pa.int64()) for c in columns[1:]]], names=["page_id", "bundle", "frame", "start", "length"])
            bundle, number = Bundle(), number + 1
            return out

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                for page, url, payload, digest, refers, head in zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns)):
                    bundle.add(page, record(page, url, payload, digest, refers, head))
                    if bundle.bytes >= BUNDLE_BYTES:
                        yield close()
        if bundle.index:
            yield close()

    return stored(with_heads(pages, least).mapInArrow(write, INDEX), "warc-index")


def frames(path: str) -> Iterator[bytes]:
    """The plain frames of a bundle, by its seek table."""
    data = read_file(path)
    unpack = zstandard.ZstdDecompressor()
    for at, packed, _ in read_seek_table(data):
        yield unpack.decompress(data[at:at + packed])


def read_bundles(index: DataFrame) -> DataFrame:
    """Every record of the index's bundles, read back; a response's digest is checked against its payload."""

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for plain in frames(path):
                    rows, at = [], 0
                    while at < len(plain):
                        fields, http, payload, at = parse(plain, at)
                        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        size = int(http.split(b"Content-Length: ", 1)[1].split(b"\r\n", 1)[0])
                        if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                            raise ValueError(f"{path}: {fields['WARC-Record-ID']} is damaged")
                        head = page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None
                        rows.append((page_of(fields["WARC-Record-ID"]), size, digest, kind, head))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                        zip(*rows), [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()])],
                        names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    bundles = index.select("bundle").distinct()
    return spread(bundles, bundles.count()).mapInArrow(read, READ)


def fetch(bundle: str, frame: int, start: int) -> tuple[dict[str, str], bytes]:
    """(WARC fields, payload) of one record by its place in the index; only its frame is unpacked."""
    fs, inner = file_system(bundle)
    with fs.open_input_file(inner) as src:
        size = src.size()
        n = struct.unpack("<I", src.read_at(9, size - 9)[:4])[0]
        table = min(size, 9 + 12 * n)
        at, packed, _ = read_seek_table(src.read_at(table, size - table))[frame]
        plain = zstandard.ZstdDecompressor().decompress(src.read_at(packed, at))
    fields, _, payload, _ = parse(plain, start)
    return fields, payload


def warc_round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Write ``pages`` into a new shared folder and return what its archives say, one row per page.

    Null html is empty, a null url is an empty target; null page_ids stay null and are never
    referred to; repeated rows give repeated records; an empty table writes nothing.
    """
    return read_bundles(write_bundles(pages, new_shared_path(pages.sparkSession, "warc"), least))
