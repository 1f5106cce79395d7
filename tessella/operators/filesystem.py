"""A file tree over fs_entries(path, is_dir, size, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.errors import AlreadyExistsError, InvalidValueError, NotFoundError
from tessella.functions.expressions import parent_path


def exists(entries: DataFrame, path: str) -> bool:
    return path == "/" or not entries.where(F.col("path") == path).isEmpty()


def children(entries: DataFrame, directory: str) -> DataFrame:
    return entries.where((parent_path(F.col("path")) == directory) & (F.col("path") != directory))


def stat(entries: DataFrame, path: str) -> DataFrame:
    return entries.where(F.col("path") == path).withColumn("blocks", F.ceil(F.col("size") / 512))


def _below(path: str):
    return (F.col("path") == path) | F.col("path").startswith(path.rstrip("/") + "/")


def moved(entries: DataFrame, old: str, new: str) -> DataFrame:
    """The entry and, of a directory, all below it under the new path."""
    if not exists(entries, old):
        raise NotFoundError(old)
    if exists(entries, new):
        raise AlreadyExistsError(new)
    if new.startswith(old.rstrip("/") + "/"):
        raise InvalidValueError("a directory can't move below itself")
    renamed = F.concat(F.lit(new), F.substring("path", len(old) + 1, 1 << 30))
    return entries.withColumn("path", F.when(_below(old), renamed).otherwise(F.col("path")))


def deleted(entries: DataFrame, path: str) -> DataFrame:
    if not exists(entries, path):
        raise NotFoundError(path)
    if not children(entries, path).isEmpty():
        raise InvalidValueError(f"{path} isn't empty")
    return entries.where(F.col("path") != path)


def made(entries: DataFrame, path: str, is_dir: bool = True, size: int = 0) -> DataFrame:
    parent = path.rsplit("/", 1)[0] or "/"
    if exists(entries, path):
        raise AlreadyExistsError(path)
    if not exists(entries, parent):
        raise NotFoundError(parent)
    row = entries.sparkSession.range(1).select(F.lit(path).alias("path"), F.lit(is_dir).alias("is_dir"), F.lit(size).cast("bigint").alias("size"))
    return entries.unionByName(row, allowMissingColumns=True)
