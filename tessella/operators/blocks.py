"""Blocks: writing with fresh or freed ids, reading, chains, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.errors import NotFoundError
from tessella.model import BLOCK_TYPES
from tessella.scratch import stored


def number(new: DataFrame, order: list[str], free: DataFrame | None = None, first: int = 1) -> DataFrame:
    """new rows with block_id: freed ids (free: block_id) first, then those from ``first`` on.

    Ids are dense, so rows need a global order; it comes from counts per range partition and a rank within each, not
    from one task. Counts and ranks must see the same partitions, and a range exchange that is planned twice may be
    sampled and coalesced otherwise, so the partitioned rows are stored, once."""
    ranged = new.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    ranked = stored(ranged, "numbered").withColumn("_part", F.shiftright("_row", 33)).withColumn("_rank", F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    sizes = ranked.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a partition
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    placed = ranked.join(F.broadcast(starts), "_part").withColumn("_k", F.col("_start") + F.col("_rank")).drop("_row", "_part", "_rank", "_start")
    if free is None:
        return placed.withColumn("block_id", F.col("_k") + first - 1).drop("_k")
    reused = number(free.select(F.col("block_id").alias("_freed")).distinct(), ["_freed"]).select(F.col("block_id").alias("_k"), "_freed")
    count = reused.agg(F.count("*").alias("n"))
    return placed.join(reused, "_k", "left").withColumn("block_id", F.coalesce("_freed", F.col("_k") - count.scalar() + first - 1)).drop("_k", "_freed")


def written(data: DataFrame, order: list[str], *, compressed: bool = False, free: DataFrame | None = None, first: int = 1, block_type: int = 0) -> DataFrame:
    """data (with a column data) as block rows: size and MD5 computed, compression marked by flag 0x01."""
    rows = number(data, order, free, first)
    columns = [c for c in rows.columns if c not in ("block_id", "data")]
    return rows.select(
        "block_id",
        F.lit(block_type).cast("smallint").alias("type"),
        F.lit(1 if compressed else 0).cast("smallint").alias("flags"),
        F.octet_length("data").cast("bigint").alias("size"),
        F.md5("data").alias("checksum"),
        F.lit(0).cast("bigint").alias("prev"),
        F.lit(0).cast("bigint").alias("next"),
        "data",
        *columns,
    )


def read(blocks: DataFrame, block_id: int) -> DataFrame:
    return blocks.where(F.col("block_id") == block_id)


def corrupted(blocks: DataFrame) -> DataFrame:
    """block_id of blocks whose data doesn't match their checksum or size."""
    return blocks.where((F.md5("data") != F.col("checksum")) | (F.octet_length("data") != F.col("size"))).select("block_id")


def type_name(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in BLOCK_TYPES.items() for x in pair]), kind.cast("int")), F.lit("unknown"))


def linked(blocks: DataFrame, a: int, b: int) -> DataFrame:
    """a's next and b's previous set to each other; the former links of both ends give way."""
    return blocks.withColumn("next", F.when(F.col("block_id") == a, F.lit(b)).otherwise(F.col("next"))).withColumn("prev", F.when(F.col("block_id") == b, F.lit(a)).otherwise(F.col("prev")))


def deleted(blocks: DataFrame, block_id: int) -> DataFrame:
    """Without the block; its neighbours are joined."""
    gone = read(blocks, block_id).select("prev", "next").first()
    if gone is None:
        raise NotFoundError(f"block {block_id}")
    rest = blocks.where(F.col("block_id") != block_id)
    rest = rest.withColumn("next", F.when(F.col("block_id") == gone["prev"], F.lit(gone["next"])).otherwise(F.col("next")))
    return rest.withColumn("prev", F.when(F.col("block_id") == gone["next"], F.lit(gone["prev"])).otherwise(F.col("prev")))


def chain(edges: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """edges: id, next; starts: id -> start, id, depth along the links. Pointers are doubled: round k adds what lies
    2**k steps behind all that is found, so a chain of n blocks takes log2 n rounds. No walk is longer than all edges
    (or ``depth``), which ends cycles."""
    jump = stored(edges.where("next is not null").select("id", "next"), "jump")
    longest = jump.count() if depth is None else min(depth, jump.count())
    found = starts.select(F.col("id").alias("start"), "id", F.lit(0).cast("bigint").alias("depth"))
    step = 1
    while step <= longest and not jump.isEmpty():
        further = found.join(jump, "id").where(F.col("depth") + step <= longest).select("start", F.col("next").alias("id"), (F.col("depth") + step).alias("depth"))
        found = stored(found.unionByName(further), "chain")
        onward = jump.select(F.col("id").alias("next"), F.col("next").alias("end"))
        jump = stored(jump.join(onward, "next").select("id", F.col("end").alias("next")), "jump")
        step *= 2
    return found


def chain_positions(rows: DataFrame, chain_col: str, order_col: str) -> DataFrame:
    """Where chains are known by a key, as in stored conversations: depth by one window, no recursion."""
    return rows.withColumn("depth", F.row_number().over(Window.partitionBy(chain_col).orderBy(order_col)) - 1)
