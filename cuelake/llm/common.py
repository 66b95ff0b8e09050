"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import gc
import uuid

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.session import new_shared_path

SEGMENT = 1 << 20


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, executors may go."""
    path = new_shared_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(taken: list[str], name: str) -> str:
    """``name``, with underscores before it until no column has it (names differ by more than case)."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name = "_" + name
    return name


def hash_share(key: str, wanted: int, total: int):
    """Condition that keeps about ``wanted`` of ``total`` rows, by a hash of ``key``.

    The same rows on every run; rows with a null key are left out.
    """
    grain = 1_000_000
    if total <= wanted:
        return F.col(key).isNotNull()
    share = max(1, wanted * grain // max(total, 1))
    return F.col(key).isNotNull() & (F.pmod(F.xxhash64(F.col(key), F.lit("share")), F.lit(grain)) < share)


#: Caches that this Python worker keeps between tasks: how to empty each.
_CACHES: dict = {}


def claim_cache(name: str, empty) -> None:
    """Keep the cache ``name`` and empty all others: a worker holds one operator's cache at a time."""
    others = [n for n in _CACHES if n != name]
    for other in others:
        _CACHES.pop(other)()
    _CACHES[name] = empty
    if others:
        give_back()


def give_back() -> None:
    """Return freed memory to the system: a worker that goes on with another operator keeps none of the last one's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


class Hot:
    """Keys that hold more than one row in ``share`` of a table (so at most ``share`` of them), and joins that split those.

    The rows of a hot key are dealt over ``SALTS`` tasks, and the rows that join with them are repeated for each.
    """

    SALTS = 32

    def __init__(self, rows: DataFrame, key: str, share: int = 1000, least: int = 1000, counts: DataFrame | None = None):
        """``counts`` (key, n), where known, saves counting ``rows``."""
        if counts is None:
            counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
        often = counts.where(F.col("n") >= least)
        found = [] if often.isEmpty() else often.where(F.col("n") * share > F.lit(rows.count())).select(key).collect()
        self.key, self.values = key, [r[0] for r in found]

    def join(self, many: DataFrame, few: DataFrame, by: str | Column, how: str = "inner") -> DataFrame:
        """``many`` with ``few`` on the key; the ``many`` of a hot key are told apart by ``by``.

        The same rows as a plain join that names the key; ``how`` is inner, left or left_semi.
        """
        if not self.values:
            return many.join(few, self.key, how)
        salt = fresh([*many.columns, *few.columns], "salt")
        hot = F.col(self.key).isin(self.values)
        spot = F.pmod(F.xxhash64(by, F.lit("salt")), F.lit(self.SALTS)).cast("int")
        dealt = many.withColumn(salt, F.when(hot, spot).otherwise(0))
        every = F.sequence(F.lit(0), F.lit(self.SALTS - 1))
        copied = few.withColumn(salt, F.explode(F.when(hot, every).otherwise(F.array(F.lit(0)))))
        return dealt.join(copied, [self.key, salt], how).drop(salt)


def segments(text: str, size: int = SEGMENT):
    """Cut a text at blanks into parts of about ``size`` characters, so that long ones stay cheap to hold."""
    start = 0
    while len(text) - start > size:
        blank, line = text.find(" ", start + size), text.find("\n", start + size)
        ends = [x for x in (blank, line) if x >= 0]
        if not ends:
            break
        yield text[start:min(ends)]
        start = min(ends)
    yield text[start:] if start else text


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and inner path of a location that every executor can reach."""
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:"):
            return pyarrow.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path


def write_file(path: str, data: bytes) -> None:
    fs, inner = file_system(path)
    fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(inner, compression=None) as out:
        out.write(data)


def read_file(path: str) -> bytes:
    fs, inner = file_system(path)
    with fs.open_input_stream(inner, compression=None) as src:
        return src.read()


def file_name(stem: str, suffix: str) -> str:
    """A name that no other attempt of the same task uses."""
    return f"{stem}-{uuid.uuid4().hex[:12]}{suffix}"


def spread(df: DataFrame, rows: int, most: int = 2000) -> DataFrame:
    """Deal a small table of work items (one row each) out over tasks."""
    return df.repartition(max(1, min(rows, most)))


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
