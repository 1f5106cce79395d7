"""Access records, placement, latency and storage figures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KIB, MIB = 1024, 1024 * 1024


@dataclass(frozen=True)
class Strategy:
    inline: int = KIB
    hot: int = 5
    cold_minutes: int = 30
    target: str = "balanced"  # speed, space


def access_records(access: DataFrame) -> DataFrame:
    """block_key, n, first, last, location (of the last access), size (the last one above zero). access: block_key,
    size, location, ts, seq (order among equal times). All states are small and combine before the shuffle."""
    at = F.struct("ts", "seq")
    return access.groupBy("block_key").agg(
        F.count("*").alias("n"),
        F.min("ts").alias("first"),
        F.max("ts").alias("last"),
        F.max_by("location", at).alias("location"),
        F.max_by(F.when(F.col("size") > 0, F.col("size")), F.when(F.col("size") > 0, at)).alias("size"),
    )


def is_hot(s: Strategy = Strategy()) -> Column:
    return F.col("n") >= s.hot


def is_cold(now: Column, s: Strategy = Strategy()) -> Column:
    return (F.unix_micros(now) - F.unix_micros("last")) > s.cold_minutes * 60 * 1_000_000


def importance(now: Column) -> Column:
    """Up to 0.7 for how often, up to 0.3 for how lately within a day."""
    age = (F.unix_micros(now) - F.unix_micros("last")) / F.lit(86_400_000_000.0)
    return F.least(F.col("n") / 10.0, F.lit(0.7)) + F.greatest(1 - age, F.lit(0.0)) * 0.3


def place_simple(size: Column, s: Strategy = Strategy()) -> Column:
    return F.when(size <= s.inline, "inline").otherwise("directory")


def place_adaptive(size: Column, now: Column, s: Strategy = Strategy()) -> Column:
    """By size, then by record (n null: none), then by target."""
    by_target = {"speed": F.lit("container"), "space": F.lit("directory")}.get(s.target, F.when(size > 512 * KIB, "directory").otherwise("container"))
    return F.when(size <= s.inline, "inline").when(F.col("n").isNull(), F.when(size > MIB, "directory").otherwise("container")).when(is_hot(s), "container").when(is_cold(now, s), "directory").otherwise(by_target)


def place_hybrid(size: Column, inline: int = 512) -> Column:
    return F.when(size <= inline, "inline").when(size >= MIB, "directory").otherwise("container")


def _shares() -> dict[str, Column]:
    total = F.count("*")
    return {loc: F.try_divide(F.count_if(F.col("location") == loc), total) for loc in ("inline", "container", "directory")}


def distribution_simple(records: DataFrame) -> DataFrame:
    """total, shares by location, efficiency, score, recommendations."""
    share = _shares()
    out = records.agg(F.count("*").alias("total"), *[c.alias(k) for k, c in share.items()])
    advice = F.array_compact(F.array(F.when(F.col("inline") > 0.3, "lower the inline threshold"), F.when((F.col("inline") < 0.1) & (F.col("total") > 20), "raise the inline threshold"), F.when(F.col("directory") > 0.8, "compress or split large blocks")))
    return out.withColumn("efficiency", 1 - F.abs(F.col("inline") - 0.2)).withColumn("score", F.col("efficiency") * 100).withColumn("recommendations", advice)


def distribution_adaptive(records: DataFrame, now: Column, s: Strategy = Strategy()) -> DataFrame:
    """As above, with how much of the hot blocks lies in containers and of the cold ones in directories."""
    hot, cold = is_hot(s), is_cold(now, s)
    share = _shares()
    out = records.agg(
        F.count("*").alias("total"),
        *[c.alias(k) for k, c in share.items()],
        F.count_if(hot).alias("hot_blocks"),
        F.count_if(cold).alias("cold_blocks"),
        F.coalesce(F.try_divide(F.count_if(hot & (F.col("location") == "container")), F.count_if(hot)), F.lit(1.0)).alias("hot_efficiency"),
        F.coalesce(F.try_divide(F.count_if(cold & (F.col("location") == "directory")), F.count_if(cold)), F.lit(1.0)).alias("cold_efficiency"),
    )
    inline = 1 - F.abs(F.col("inline") - 0.2)
    speed = {"speed": 0.7, "space": 0.3}.get(s.target, 0.5)
    space = F.col("cold_efficiency") * 0.7 + inline * 0.3
    efficiency = F.col("hot_efficiency") * 0.4 + F.col("cold_efficiency") * 0.3 + inline * 0.3
    big = F.col("total") > 20
    advice = F.array_compact(
        F.array(
            F.when((F.col("hot_blocks") > 0) & (F.col("hot_efficiency") < 0.6), "move hot blocks to containers"),
            F.when((F.col("cold_blocks") > 0) & (F.col("cold_efficiency") < 0.6), "move cold blocks to directories"),
            F.when(F.col("inline") > 0.3, "lower the inline threshold").when((F.col("inline") < 0.1) & (F.col("total") > 50), "raise the inline threshold"),
            F.when(F.col("efficiency") < 0.6, "optimise the storage"),
            F.when(F.lit(s.target == "speed") & (F.col("container") < 0.5) & big, "use containers more").when(F.lit(s.target == "space") & (F.col("directory") < 0.5) & big, "use directories more"),
        )
    )
    return out.withColumn("efficiency", efficiency).withColumn("score", (F.col("hot_efficiency") * speed + space * (1 - speed)) * 100).withColumn("recommendations", advice)


def storage_mode(used: Column, blocks: Column, fragmentation: Column, current: Column, threshold: int, inline: int = 512) -> Column:
    average = F.floor(F.try_divide(used, blocks))
    return F.when(used < threshold // 2, "container").when(used >= threshold, "directory").when((average < inline) & (used >= threshold * 3 // 4), "hybrid").when(fragmentation > 0.3, "directory").otherwise(current)


def location_stats(blocks: DataFrame, inline: int = 512) -> DataFrame:
    """location, blocks, bytes of a hybrid store, counted as they lie."""
    return blocks.withColumn("location", place_hybrid(F.col("size"), inline)).groupBy("location").agg(F.count("*").alias("blocks"), F.sum("size").alias("bytes"))


def storage_stats(blocks: DataFrame, capacity: int) -> DataFrame:
    used = F.coalesce(F.sum("size"), F.lit(0))
    return blocks.agg(F.count("*").alias("blocks"), used.alias("used"), (F.lit(capacity) - used).alias("free"), F.lit(0.0).alias("fragmentation"))


def read_write_pattern(reads: Column, writes: Column) -> Column:
    """struct(pattern, value); null without accesses."""
    ratio = F.try_divide(reads, reads + writes)
    as_pair = lambda name, value: F.struct(F.lit(name).alias("pattern"), value.alias("value"))
    return F.when(ratio > 0.8, as_pair("read-heavy", ratio)).when(ratio < 0.2, as_pair("write-heavy", 1 - ratio)).when(ratio.isNotNull(), as_pair("mixed", F.lit(1.0)))


def index_report(tags: DataFrame, shards: int, memory_bytes: int) -> DataFrame:
    from tessella.functions.expressions import byte_size
    from tessella.operators.tag_index import TagIndex

    out = TagIndex(tags, shards).balance().withColumn("balance", F.coalesce("balance", F.lit(1.0))).withColumn("postings", tags.agg(F.count("*").alias("n")).scalar())
    advice = F.array_compact(F.array(F.when(F.col("balance") < 0.7, F.concat(F.lit("rebalance shards: "), F.format_number("balance", 2))), F.when(F.lit(memory_bytes) > 500 * MIB, F.concat(F.lit("compress more: "), byte_size(F.lit(memory_bytes))))))
    return out.withColumn("recommendations", advice)


def query_statistics(queries: DataFrame) -> DataFrame:
    """queries: query_type, ms, rows, hit."""
    return queries.groupBy("query_type").agg(F.count("*").alias("n"), F.avg("ms").alias("avg_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"), F.avg("rows").alias("avg_rows"), F.avg(F.col("hit").cast("int")).alias("hit_rate"))


def last_values(samples: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return samples.groupBy(key).agg(F.max_by(value, order).alias(value))


def hit_rate(hit: Column) -> Column:
    return F.coalesce(F.avg(hit.cast("int")), F.lit(0.0))


def latency_percentiles(samples: DataFrame, key: list[str], value: str, ps: list[float]) -> DataFrame:
    """key, p50, p95, ...: nearest rank from below. Values are counted first; a running count finds each rank."""
    counts = samples.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*key)
    run = counts.withColumn("to", F.sum("c").over(w.orderBy(value))).withColumn("n", F.sum("c").over(w))
    at = lambda p: F.floor((F.col("n") - 1) * min(100.0, max(0.0, p)) / 100)
    inside = lambda p: (F.col("to") - F.col("c") <= at(p)) & (at(p) < F.col("to"))
    return run.groupBy(*key).agg(*[F.max(F.when(inside(p), F.col(value))).alias(f"p{p:g}") for p in ps])


def sliding_mean(samples: DataFrame, key: list[str], order: list[str], value: str, n: int = 100) -> DataFrame:
    """samples with the mean of the last n, and the least and greatest of all so far."""
    w = Window.partitionBy(*key).orderBy(*order)
    return samples.withColumn("mean", F.avg(value).over(w.rowsBetween(-(n - 1), 0))).withColumn("least", F.min(value).over(w)).withColumn("greatest", F.max(value).over(w))


def evicted(entries: DataFrame, need: int, order: list[str], size: str = "size") -> DataFrame:
    """The oldest entries until their sizes reach what is needed; a cache's entries, so one ordered run over them."""
    return entries.withColumn("freed_before", F.coalesce(F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("freed_before") < need).drop("freed_before")


def kept_by_lru(entries: DataFrame, capacity: int, last: str, tie: str) -> DataFrame:
    """The most recently used, as many as fit: a top-k, so each task sends at most that many."""
    return entries.orderBy(F.desc(last), tie).limit(capacity)


def kept_by_score(records: DataFrame, now: Column, k: int) -> DataFrame:
    return records.withColumn("importance", importance(now)).orderBy(F.desc("importance"), "block_key").limit(k)
