"""The tag index: look-ups and maintenance over tags(tag, id).

Stored partitioned by shard and sorted by tag within files, look-ups prune shards and skip row groups. An unknown tag
gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.errors import InvalidQueryError, InvalidValueError, NotFoundError, UnsupportedOperatorError
from tessella.operators import set_ops

SHARDS = 16


@dataclass(frozen=True)
class Condition:
    """One condition on a tag's ids: eq (all of them), prefix, range, or a comparison of the id with a value."""

    tag: int
    op: str = "eq"
    value: object = None
    low: int | None = None
    high: int | None = None


class TagIndex:
    def __init__(self, tags: DataFrame, shards: int = SHARDS) -> None:
        self.tags, self.shards = tags.select("tag", "id"), shards

    def _same(self, tags: DataFrame) -> TagIndex:
        return TagIndex(tags, self.shards)

    # look-ups
    def ids(self) -> DataFrame:
        return self.tags.select("id").distinct()

    def find(self, tag: int) -> DataFrame:
        return self.tags.where(F.col("tag") == tag).select("id")

    def find_in_shard(self, tag: int, shard: int) -> DataFrame:
        if not 0 <= shard < self.shards:
            raise InvalidValueError(f"there's no shard {shard}")
        return self.find(tag).where(F.pmod("id", F.lit(self.shards)) == shard)

    def find_pattern(self, pattern: str) -> DataFrame:
        """(tag, id) of tags whose decimal form contains the pattern; empty or *: all."""
        return self.tags if pattern in ("", "*") else self.tags.where(F.col("tag").cast("string").contains(pattern))

    def find_prefix(self, tag: int, prefix: str) -> DataFrame:
        found = self.find(tag)
        return found.where(F.col("id").cast("string").startswith(prefix)) if prefix else found

    def find_range(self, tag: int, low: int, high: int) -> DataFrame:
        return self.find(tag).where(F.col("id").between(low, high)).orderBy("id")

    def prefix_tree(self, tag: int, depth: int = 8) -> DataFrame:
        """prefix, n: how many ids stand below each node of the tree of decimal ids; one aggregation for all depths."""
        text = F.col("id").cast("string")
        prefixes = F.transform(F.sequence(F.lit(1), F.least(F.length(text), F.lit(depth))), lambda d: F.substring(text, F.lit(1), d))
        return self.find(tag).select(F.explode(prefixes).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n"))

    def _one(self, c: Condition) -> DataFrame:
        match c.op:
            case "eq":
                return self.find(c.tag)
            case "prefix":
                return self.find_prefix(c.tag, str(c.value))
            case "range":
                return self.find(c.tag).where(F.col("id").between(c.low, c.high))
            case "suffix":
                return self.find(c.tag).where(F.col("id").cast("string").endswith(str(c.value)))
            case "contains":
                return self.find(c.tag).where(F.col("id").cast("string").contains(str(c.value)))
            case "neq" | "lt" | "lte" | "gt" | "gte":
                value, i = F.lit(int(c.value)), F.col("id")
                return self.find(c.tag).where({"neq": i != value, "lt": i < value, "lte": i <= value, "gt": i > value, "gte": i >= value}[c.op])
        raise UnsupportedOperatorError(c.op)

    def find_compound(self, conditions: list[Condition]) -> DataFrame:
        """Ids that meet all conditions. Plain tags are met by one aggregation, the others by semi-joins."""
        if not conditions:
            raise InvalidQueryError("a compound look-up needs conditions")
        plain = [c.tag for c in conditions if c.op == "eq"]
        sets = [self._one(c).distinct() for c in conditions if c.op != "eq"]
        if len(set(plain)) > 1:
            sets.insert(0, set_ops.all_of(self.tags, plain))
        elif plain:
            sets.insert(0, self.find(plain[0]).distinct())
        return set_ops.intersect_all(sets)

    # changes; each returns a new index
    def add(self, rows: DataFrame) -> TagIndex:
        return self._same(self.tags.unionByName(rows.select("tag", "id")).dropDuplicates(["tag", "id"]))

    def append(self, rows: DataFrame) -> TagIndex:
        """Adds and keeps duplicates, as the unsharded index does; compact() drops them."""
        return self._same(self.tags.unionByName(rows.select("tag", "id")))

    def remove(self, rows: DataFrame) -> TagIndex:
        return self._same(self.tags.join(rows.select("tag", "id"), ["tag", "id"], "left_anti"))

    def index_metadata(self, rows: DataFrame) -> TagIndex:
        """rows: id, tags array."""
        return self.add(rows.select(F.explode("tags").alias("tag"), "id"))

    def compact(self) -> TagIndex:
        """Distinct postings, each shard together and sorted: dictionary and delta encodings of Parquet do the rest."""
        rows = self.tags.dropDuplicates(["tag", "id"])
        return self._same(rows.repartition(F.pmod("id", F.lit(self.shards))).sortWithinPartitions("tag", "id"))

    def rebalanced(self, partitions: int) -> TagIndex:
        return self._same(self.tags.repartition(partitions, "id"))

    # figures
    def status(self) -> DataFrame:
        return self.tags.agg(F.count("*").alias("postings"), F.count_distinct("tag").alias("tags"), F.count_distinct("id").alias("ids"))

    def per_shard(self) -> DataFrame:
        """shard, n for every shard, empty ones too."""
        held = self.tags.groupBy(F.pmod("id", F.lit(self.shards)).alias("shard")).agg(F.count("*").alias("n"))
        return self.tags.sparkSession.range(self.shards).withColumnRenamed("id", "shard").join(held, "shard", "left").select("shard", F.coalesce("n", F.lit(0)).alias("n"))

    def balance(self) -> DataFrame:
        """1 - min(1, coefficient of variation of the shards' sizes)."""
        return self.per_shard().agg((1 - F.least(F.lit(1.0), F.try_divide(F.stddev_pop("n"), F.avg("n")))).alias("balance"))

    def verify(self, entities: DataFrame) -> DataFrame:
        """Postings whose id isn't an entity."""
        return self.tags.join(entities.select("id"), "id", "left_anti")

    # storage
    def save(self, path: str) -> None:
        """Parquet by shard, and a checksum of the content: sums of row hashes, so any order and any split give the same."""
        rows = self.compact().tags.withColumn("shard", F.pmod("id", F.lit(self.shards)))
        rows.write.mode("overwrite").partitionBy("shard").parquet(f"{path}/postings")
        self._checksum(rows).write.mode("overwrite").json(f"{path}/checksum")

    @staticmethod
    def _checksum(rows: DataFrame) -> DataFrame:
        h = F.xxhash64("tag", "id")
        return rows.agg(F.count("*").alias("n"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("low"), F.sum(F.shiftrightunsigned(h, 33)).alias("high"))

    @classmethod
    def load(cls, spark, path: str, shards: int = SHARDS, check: bool = True) -> TagIndex:
        from tessella.errors import CorruptedError

        try:
            rows = spark.read.parquet(f"{path}/postings")
        except Exception as e:
            raise NotFoundError(path) from e
        if check and cls._checksum(rows).first() != spark.read.schema("n long, low long, high long").json(f"{path}/checksum").first():
            raise CorruptedError(path)
        return cls(rows, shards)
