"""Id-set operators as joins, so that they keep or drop duplicates as their names say."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def intersect(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Rows of a, duplicates included, whose key stands in b."""
    return a.join(b.select(key), key, "left_semi")


def union(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    return a.select(key).union(b.select(key)).distinct()


def difference(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Rows of a, duplicates included, whose key doesn't stand in b."""
    return a.join(b.select(key), key, "left_anti")


def union_all(sets: list[DataFrame], key: str = "id") -> DataFrame:
    return reduce(lambda a, b: a.union(b), [s.select(key) for s in sets]).distinct()


def intersect_all(sets: list[DataFrame], key: str = "id") -> DataFrame:
    return reduce(lambda a, b: intersect(a, b, key), sets)


def all_of(tags: DataFrame, wanted: list[int]) -> DataFrame:
    """Ids that have every tag, by one aggregation whatever their number: counts distinct tags, partial before the shuffle."""
    kinds = sorted(set(wanted))
    return tags.where(F.col("tag").isin(kinds)).groupBy("id").agg(F.count_distinct("tag").alias("k")).where(F.col("k") == len(kinds)).select("id")


def any_of(tags: DataFrame, wanted: list[int]) -> DataFrame:
    return tags.where(F.col("tag").isin(wanted)).select("id").distinct()


def none_of(tags: DataFrame, wanted: list[int], universe: DataFrame | None = None) -> DataFrame:
    """Ids of the universe (all tagged ids by default) that have none of the tags."""
    ids = tags.select("id").distinct() if universe is None else universe.select("id").distinct()
    return difference(ids, tags.where(F.col("tag").isin(wanted)))
