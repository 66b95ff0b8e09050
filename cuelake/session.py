"""Session helpers: local defaults, and the shared folder for written state."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Remove a statement's shuffle files when it has ended, not when the driver happens to collect its garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_PROVIDERS = "org.apache.spark.sql.execution.streaming.state."
ROCKS, SPARKS_OWN = f"{_PROVIDERS}RocksDBStateStoreProvider", f"{_PROVIDERS}HDFSBackedStateStoreProvider"


def local_session(cores: str = "8", app: str = "cuelake", **conf: str) -> SparkSession:
    """Session for one machine (tests, bench).  On a cluster pass your own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Text stages are CPU-bound on few bytes: do not squeeze them into one task.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config(STATE_STORE, ROCKS)
        .config("spark.sql.unionOutputPartitioning", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Streams started in here keep their state in RocksDB, unless the session names a store other than Spark's own.

    ``transformWithState`` needs several column families, which Spark's own store has not.
    """
    before = spark.conf.get(STATE_STORE)
    if before != SPARKS_OWN:
        yield
        return
    spark.conf.set(STATE_STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Where the session names none, a fresh local folder is made and recorded in the
    session, so later calls agree; with executors elsewhere that would lose rows
    silently, so it is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("cuelake.shared.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("cuelake.shared.dir", root)
    return root


def plain_unions(spark: SparkSession) -> None:
    """Let groupings over a union always have an exchange of their own.

    Spark takes sides that are dealt by the same key for one table dealt by it, also after adaptive
    execution has read one of them differently; a group is then in several tasks, and counted in each.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, once per Spark context.

    Functions that run in Python workers are pickled by module name, so the workers
    must be able to import the package wherever the driver was started.
    """
    plain_unions(spark)
    context = spark.sparkContext
    if getattr(context, "_cuelake_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "cuelake.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(archive)
    context._cuelake_shipped = True


def new_shared_path(spark: SparkSession, label: str) -> str:
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write an intermediate result once to the shared folder and read it back.

    For results that several branches use and that are costly to compute but small,
    such as detections; the written table survives the loss of executors.  What was shuffled for it is gone
    once it is written.
    """
    spark = df.sparkSession
    path = new_shared_path(spark, label)
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)
