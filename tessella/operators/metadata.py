"""Byte-valued metadata in long form, metadata(file_id, tag, value): predicates, paging, changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.errors import AccessError, NotFoundError, UnsupportedOperatorError
from tessella.functions.expressions import int64_be

PROTECTED = (0x0001, 0x0002, 0x0009)
EQ, NE, GT, LT, CONTAINS = range(5)


@dataclass(frozen=True)
class Condition:
    tag: int
    op: int
    value: bytes


def compare(value: Column, op: int, other: bytes) -> Column:
    """Equality and containment on bytes; order as big-endian numbers if both have eight bytes, else by the first byte."""
    o = F.lit(other)
    if op == EQ:
        return value == o
    if op == NE:
        return value != o
    if op == CONTAINS:
        return F.contains(value, o) if other else F.lit(True)
    if op not in (GT, LT):
        raise UnsupportedOperatorError(str(op))
    if not other:
        return F.lit(False)
    first = lambda c: F.conv(F.hex(F.substring(c, 1, 1)), 16, 10).cast("int")
    a, b = int64_be(value), F.lit(int.from_bytes(other[:8], "big", signed=True))
    x, y = first(value), F.lit(other[0])
    long = F.octet_length(value) >= 8 if len(other) >= 8 else F.lit(False)
    byte = F.when(F.octet_length(value) == 0, False).otherwise(x > y if op == GT else x < y)
    return F.when(long, a > b if op == GT else a < b).otherwise(byte)


class Metadata:
    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows

    def get(self, file_id: str, tag: int) -> DataFrame:
        return self.rows.where((F.col("file_id") == file_id) & (F.col("tag") == tag)).select("value")

    def entries(self, file_id: str) -> DataFrame:
        return self.rows.where(F.col("file_id") == file_id).select("tag", "value")

    def by_tag(self, tag: int, value: bytes, limit: int = 100) -> DataFrame:
        return self.rows.where((F.col("tag") == tag) & (F.col("value") == F.lit(value))).orderBy("file_id").limit(limit)

    def matching(self, conditions: list[Condition], any_of: bool = False) -> DataFrame:
        """file_id of files that meet all (or any) conditions, over different tags: one aggregation for all of them."""
        flags = [F.max((F.col("tag") == c.tag) & compare(F.col("value"), c.op, c.value)).alias(f"c{k}") for k, c in enumerate(conditions)]
        tags = sorted({c.tag for c in conditions})
        per_file = self.rows.where(F.col("tag").isin(tags)).groupBy("file_id").agg(*flags)
        hits = [F.coalesce(F.col(f"c{k}"), F.lit(False)) for k in range(len(conditions))]
        total = hits[0]
        for h in hits[1:]:
            total = total | h if any_of else total & h
        return per_file.where(total).select("file_id")

    def query(self, conditions: list[Condition], *, limit: int = 0, offset: int = 0, sort_tag: int | None = None, descending: bool = False, any_of: bool = False) -> DataFrame:
        """file_id, total_count, has_more: a page of the matching files, by the value of a tag if one is given."""
        found = self.matching(conditions, any_of)
        total = found.agg(F.count("*").alias("n"))
        order = [F.asc("file_id")]
        if sort_tag is not None:
            by = self.rows.where(F.col("tag") == sort_tag).select("file_id", F.col("value").alias("sort_value"))
            found = found.join(by, "file_id", "left")
            order.insert(0, F.desc_nulls_last("sort_value") if descending else F.asc_nulls_last("sort_value"))
        page = found.orderBy(*order)
        page = page.offset(offset) if offset > 0 else page
        page = page.limit(limit) if limit > 0 else page
        return page.select("file_id", total.scalar().alias("total_count")).withColumn("has_more", F.col("total_count") > offset + limit if limit > 0 else F.lit(False))

    def matching_entries(self, conditions: list[Condition]) -> DataFrame:
        """The entry-level reading: each single entry must meet all conditions, so two tags never match."""
        hit = F.lit(True)
        for c in conditions:
            hit = hit & (F.col("tag") == c.tag) & compare(F.col("value"), c.op, c.value)
        return self.rows.where(hit)

    # changes; each returns new metadata
    def set(self, rows: DataFrame) -> Metadata:
        kept = self.rows.join(rows.select("file_id", "tag"), ["file_id", "tag"], "left_anti")
        return Metadata(kept.unionByName(rows.select("file_id", "tag", "value")))

    def delete(self, file_id: str, tag: int, missing_ok: bool = False) -> Metadata:
        if tag in PROTECTED:
            raise AccessError(f"tag {tag:#06x} is protected")
        if not missing_ok and self.get(file_id, tag).isEmpty():
            raise NotFoundError(f"{file_id} has no tag {tag:#06x}")
        return Metadata(self.rows.where(~((F.col("file_id") == file_id) & (F.col("tag") == tag))))

    def batch(self, ops: DataFrame) -> Metadata:
        """ops: file_id, tag, seq, op (0 set, 1 delete, 2 append), value. Folded per entry in order of seq, all or
        nothing: a delete of a protected tag fails the batch, one of an absent tag does nothing."""
        if not ops.where((F.col("op") == 1) & F.col("tag").isin(*PROTECTED)).isEmpty():
            raise AccessError("the batch deletes a protected tag")
        start = self.rows.select("file_id", "tag", F.lit(None).cast("bigint").alias("seq"), F.lit(0).alias("op"), "value")
        changed = start.join(ops.select("file_id", "tag").distinct(), ["file_id", "tag"], "left_semi")
        steps = changed.unionByName(ops.select("file_id", "tag", F.col("seq").cast("bigint").alias("seq"), F.col("op").cast("int").alias("op"), "value"))
        ordered = steps.groupBy("file_id", "tag").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("seq", F.lit(-1)).alias("seq"), "op", "value"))).alias("steps"))
        fold = lambda v, s: F.when(s["op"] == 0, s["value"]).when(s["op"] == 1, F.lit(None)).otherwise(F.concat(F.coalesce(v, F.lit(b"")), s["value"]))
        result = ordered.select("file_id", "tag", F.aggregate("steps", F.lit(None).cast("binary"), fold).alias("value")).where("value is not null")
        untouched = self.rows.join(ops.select("file_id", "tag").distinct(), ["file_id", "tag"], "left_anti")
        return Metadata(untouched.unionByName(result))


def from_entities(df: DataFrame, id_col: str, tags: dict[str, int]) -> DataFrame:
    """Wide rows as metadata: each named column becomes an entry, nulls none; one narrow pass."""
    entries = F.array(*[F.struct(F.lit(t).alias("tag"), F.col(c).cast("string").cast("binary").alias("value")) for c, t in tags.items()])
    return df.select(F.col(id_col).cast("string").alias("file_id"), F.explode(entries).alias("e")).select("file_id", "e.tag", "e.value").where("value is not null")
