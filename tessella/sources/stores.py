"""Block stores as Parquet layouts, and conversions between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.errors import AlreadyExistsError, InvalidValueError
from tessella.functions.expressions import djb2
from tessella.operators.analytics import place_hybrid

MODES = ("container", "directory", "hybrid")
#: Partition folders of the directory layout; reads by id touch one of them.
FANOUT = 256


def _by_folder(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("folder", F.lower(F.lpad(F.hex(F.pmod("block_id", F.lit(FANOUT))), 2, "0")))


def write(blocks: DataFrame, path: str, mode: str, overwrite: bool = False) -> None:
    """container: few large files sorted by id; directory: a folder by id; hybrid: by location, from the size."""
    save = "overwrite" if overwrite else "errorifexists"
    if mode == "container":
        blocks.repartitionByRange("block_id").sortWithinPartitions("block_id").write.mode(save).parquet(f"{path}/container")
    elif mode == "directory":
        _by_folder(blocks).repartition("folder").sortWithinPartitions("block_id").write.mode(save).partitionBy("folder").parquet(f"{path}/directory")
    elif mode == "hybrid":
        placed = blocks.withColumn("location", place_hybrid(F.col("size"))).withColumn("key_hash", djb2(F.col("block_id").cast("string")))
        placed.repartition("location", F.pmod("key_hash", F.lit(FANOUT))).write.mode(save).partitionBy("location").parquet(f"{path}/hybrid")
    else:
        raise InvalidValueError(mode)


def read(spark: SparkSession, path: str, mode: str) -> DataFrame:
    if mode not in MODES:
        raise InvalidValueError(mode)
    return spark.read.parquet(f"{path}/{mode}").drop("folder", "key_hash")


def block(spark: SparkSession, path: str, mode: str, block_id: int) -> DataFrame:
    found = spark.read.parquet(f"{path}/{mode}")
    if mode == "directory":
        found = found.where(F.col("folder") == f"{block_id % FANOUT:02x}")  # prunes to one folder
    return found.where(F.col("block_id") == block_id).drop("folder", "key_hash")


def convert(spark: SparkSession, path: str, old: str, new: str) -> None:
    """Writes the new layout whole before anyone reads it; the old one stays until drop_mode."""
    if old == new:
        raise AlreadyExistsError(new)
    write(read(spark, path, old).drop("location"), path, new)


def upsert(spark: SparkSession, path: str, mode: str, blocks: DataFrame, to: str) -> None:
    """The store with these blocks instead of those of the same ids, at another path."""
    kept = read(spark, path, mode).drop("location").join(blocks.select("block_id"), "block_id", "left_anti")
    write(kept.unionByName(blocks), to, mode)


def content_addressed(blocks: DataFrame) -> DataFrame:
    """hash, data: each content once, known by its SHA-256; only digests are compared."""
    return blocks.withColumn("hash", F.sha2("data", 256)).dropDuplicates(["hash"]).select("hash", "data")
