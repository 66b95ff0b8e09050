"""Files with names of their own: one text file per row."""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F

#: What a reading task hands on at once, and the tasks that read: they stream, so their number bounds no memory.
BATCH_BYTES, BATCH_FILES, READERS = 4 << 20, 1000, 256


def _place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


def write_named_files(df: DataFrame, path: str, name: str = "name", content: str = "content", folders: int = 0) -> int:
    """Write ``content`` of each row to ``path/name``, or into one of ``folders`` in it by the name's hash; the number of files.

    Files are written where the rows are and appear as a whole, so a task that runs again writes the
    same.  Names must differ, and the folder be one that all executors share.  Folders let many files
    be listed by many tasks (:func:`read_named_files`).
    """

    def write(batches):
        fs, top = _place(path)
        made = set()
        for batch in batches:
            for file, text in zip(*(c.to_pylist() for c in batch.columns)):
                folder = f"{top}/{zlib.crc32(file.encode()) % folders:04d}" if folders else top
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                part = f"{folder}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(part, compression=None) as out:
                    out.write((text or "").encode())
                fs.move(part, f"{folder}/{file}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return df.select(name, content).mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def _entries(fs: pyarrow.fs.FileSystem, folder: str) -> Iterator[tuple[str, bool]]:
    """(path, whether it is a folder) of what lies in ``folder``; hidden names are left out."""
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for e in found:
                if e.name[0] not in "._":
                    yield e.path, e.is_dir()
    else:
        for e in fs.get_file_info(pyarrow.fs.FileSelector(folder)):
            if e.base_name[0] not in "._":
                yield e.path, e.type == pyarrow.fs.FileType.Directory


def read_named_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of the files in ``path`` and in its folders; empty and hidden files are left out.

    One task lists ``path`` itself, others list its folders and read the files, so small files cost
    neither the driver an entry nor a task a split each.  Locations that are not a plain path (URIs of other
    systems, patterns) go to Spark's reader.
    """
    if ("://" in path and not path.startswith("file:")) or any(c in path for c in "*?[{"):
        name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
        return spark.read.text(path, wholetext=True).select(name.alias("name"), F.col("value").alias("content"))

    def top(batches):
        fs, folder = _place(path)
        for _ in batches:
            held = []
            for entry in _entries(fs, folder) if fs.get_file_info(folder).type != pyarrow.fs.FileType.File else [(folder, False)]:
                held.append(entry)
                if len(held) == BATCH_FILES:
                    yield pa.RecordBatch.from_pylist([{"place": p, "is_folder": d} for p, d in held])
                    held = []
            if held:
                yield pa.RecordBatch.from_pylist([{"place": p, "is_folder": d} for p, d in held])

    def read(batches):
        fs, _ = _place(path)
        names, contents, size = [], [], 0
        for batch in batches:
            for place, is_folder in zip(*(c.to_pylist() for c in batch.columns)):
                for file in (p for p, deeper in _entries(fs, place) if not deeper) if is_folder else [place]:
                    with fs.open_input_stream(file) as src:
                        content = src.read()
                    if content:
                        names.append(file.rsplit("/", 1)[-1])
                        contents.append(content)
                        size += len(content)
                    if size >= BATCH_BYTES or len(names) >= BATCH_FILES:
                        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["name", "content"])
                        names, contents, size = [], [], 0
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["name", "content"])

    places = spark.range(0, 1, 1, 1).mapInArrow(top, "place string, is_folder boolean").repartition(READERS, "place")
    return places.mapInArrow(read, "name string, content binary").select("name", F.col("content").cast("string").alias("content"))
