"""Feature store and sharded writes (A3, A6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cuelake.functions.text import pad_vector
from cuelake.plans.ordered import INDEX_CHUNK, chunk_of
from cuelake.session import materialize
from cuelake.vocab import N_DIMS


def write_feature_store(df: DataFrame, path: str, mode: str = "append", buckets: int | None = None) -> None:
    """Parquet clustered by video and window chunk.

    Rows are spread by (video, chunk), so one huge video becomes several files, and
    sorted within a file, so row-group statistics prune reads of single videos.
    """
    spread = [F.col("video_id"), chunk_of(F.col("window_idx"), INDEX_CHUNK)]
    placed = df.repartition(buckets, *spread) if buckets else df.repartition(*spread)
    placed.sortWithinPartitions("video_id", "window_idx").write.mode(mode).parquet(path)


def normalize_features(df: DataFrame, mfcc_dims: int = 13) -> DataFrame:
    """Pad legacy keyword vectors and fill an absent audio feature with zeros."""
    out = df.withColumn("keyword_vec", pad_vector(F.col("keyword_vec"), N_DIMS))
    zeros = F.array_repeat(F.lit(0.0), mfcc_dims)
    have = F.col("mfcc_mean") if "mfcc_mean" in df.columns else F.lit(None).cast("array<double>")
    return out.withColumn("mfcc_mean", F.coalesce(have, zeros))


def read_feature_store(spark: SparkSession, path: str) -> DataFrame:
    return normalize_features(spark.read.option("mergeSchema", "true").parquet(path))


def shard_plan(files: DataFrame, slug: str, rows_per_shard: int = 100) -> DataFrame:
    """Shard name per key in key order: ``slug``, ``slug-s1``, ...

    Keys are dealt out by ranges and numbered inside them; only one count per range meets
    in a single task.  The dealt keys are a written table, so numbers survive lost executors.
    """
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = materialize(
        files.select("name").repartitionByRange("name").sortWithinPartitions("name")
        .select("name", F.spark_partition_id().alias("part"), within.alias("nth")), "shard-keys")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("part").agg(F.count("*").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    shard = F.floor((F.col("base") + F.col("nth")) / rows_per_shard).cast("bigint")
    return dealt.join(bases, "part").select(
        "name", shard.alias("shard"),
        F.when(shard == 0, F.lit(slug))
        .otherwise(F.concat(F.lit(f"{slug}-s"), shard.cast("string"))).alias("shard_name"),
    )


def write_sharded(df: DataFrame, key: str, path: str, rows_per_shard: int = 100, partitions: int | None = None) -> None:
    """Key-sorted files of at most ``rows_per_shard`` rows; read them back as a directory."""
    ordered = df.repartitionByRange(partitions, key) if partitions else df.repartitionByRange(key)
    ordered.sortWithinPartitions(key).write.option("maxRecordsPerFile", rows_per_shard).parquet(path)


# ---------------------------------------------------------------------------
# named shards
# ---------------------------------------------------------------------------

#: Folder of the table that says which shards a layout has; names with an underscore are not data.
MANIFEST = "_shards"
SHARD = "shard"


def write_planned_shards(df: DataFrame, key: str, path: str, slug: str, keys_per_shard: int = 100) -> None:
    """Folders ``shard=<slug>``, ``shard=<slug>-s1``, ... with the rows of at most ``keys_per_shard`` keys each, in key order.

    The plan is a written table, joined by key, so no key list passes the driver.  Rows meet by shard
    with a rebalancing exchange: small shards share tasks, one whose keys hold many rows becomes several files.
    The manifest (name, keys, rows, first and last key of each shard) is written last, from the
    files, and makes the layout valid; rows without a key belong to no shard and are an error.
    """
    spark = df.sparkSession
    if not df.filter(F.col(key).isNull()).isEmpty():
        raise ValueError(f"{key} is null in some rows, which no shard can hold")
    plan = shard_plan(df.select(F.col(key).alias("name")).distinct(), slug, keys_per_shard)
    named = df.join(plan.select(F.col("name").alias(key), F.col("shard_name").alias(SHARD)), key)
    named.hint("rebalance", SHARD).sortWithinPartitions(SHARD, key).write.partitionBy(SHARD).parquet(path)
    found = spark.read.parquet(path).groupBy(SHARD, key).agg(F.count("*").alias("rows")).groupBy(SHARD).agg(
        F.count("*").alias("n_keys"), F.sum("rows").alias("n_rows"), F.min(key).alias("first_key"), F.max(key).alias("last_key"))
    found.write.parquet(f"{path}/{MANIFEST}")


def shard_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{MANIFEST}")


def read_planned_shards(spark: SparkSession, path: str, shards: DataFrame | None = None) -> DataFrame:
    """The rows of all shards of the manifest, or of those of its rows given as ``shards``.

    Folders that the manifest does not name are not read: the join prunes them.
    """
    wanted = shard_manifest(spark, path) if shards is None else shards
    return spark.read.parquet(path).join(wanted.select(SHARD), SHARD, "left_semi")
