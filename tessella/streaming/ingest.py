"""Index maintenance and trackers as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window


def last_op_wins(events: DataFrame) -> DataFrame:
    """events: tag, id, seq, op (add or remove) -> the postings that stand after all of them."""
    return events.groupBy("tag", "id").agg(F.max_by("op", "seq").alias("op")).where("op = 'add'").select("tag", "id")


def apply_batch(tags: DataFrame, events: DataFrame) -> DataFrame:
    """Postings after a batch of adds and removes; within the batch the last of a posting counts."""
    touched = events.select("tag", "id").distinct()
    return tags.select("tag", "id").distinct().join(touched, ["tag", "id"], "left_anti").unionByName(last_op_wins(events))


def maintain_index(events: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes each micro-batch's net changes as a numbered version folder; current_index folds them. A batch that is
    replayed after a failure overwrites its own folder, so every change counts once."""

    def upsert(batch: DataFrame, number: int) -> None:
        net = batch.groupBy("tag", "id").agg(F.max("seq").alias("seq"), F.max_by("op", "seq").alias("op"))
        net.write.mode("overwrite").parquet(f"{path}/batch={number:08d}")

    return events.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current_index(spark, path: str) -> DataFrame:
    changes = spark.read.parquet(path)
    return changes.groupBy("tag", "id").agg(F.max_by("op", F.struct("seq", "batch")).alias("op")).where("op = 'add'").select("tag", "id")


def compact_index(spark, path: str, to: str) -> None:
    """One version of what the batches amount to."""
    current_index(spark, path).withColumn("op", F.lit("add")).withColumn("seq", F.lit(0).cast("bigint")).write.mode("overwrite").parquet(f"{to}/batch=00000000")


def distinct_postings(events: DataFrame, time_col: str, delay: str) -> DataFrame:
    """Repeated adds of a posting within the delay pass once; state older than that is dropped."""
    return events.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["tag", "id"])


def tracked_access(access: DataFrame) -> DataFrame:
    """Running access records for update or complete mode: block_key, n, first, last."""
    return access.groupBy("block_key").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def tumbling(events: DataFrame, size: str, delay: str, time_col: str = "ts", slide: str | None = None) -> DataFrame:
    window = F.window(time_col, size, slide) if slide else F.window(time_col, size)
    marked = events.withWatermark(time_col, delay) if events.isStreaming else events
    return marked.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, delay: str, key: str = "user_id", time_col: str = "ts") -> DataFrame:
    marked = events.withWatermark(time_col, delay) if events.isStreaming else events
    return marked.groupBy(F.session_window(time_col, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def by_priority(tasks: DataFrame) -> DataFrame:
    """A micro-batch's tasks in the order they are taken."""
    return tasks.withColumn("place", F.row_number().over(Window.orderBy(F.desc("priority"), "seq")))
