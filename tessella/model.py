"""The logical tables, their schemas, and the session that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

TAGS = T.StructType([T.StructField("tag", T.LongType()), T.StructField("id", T.LongType())])
METADATA = T.StructType([T.StructField("file_id", T.StringType()), T.StructField("tag", T.IntegerType()), T.StructField("value", T.BinaryType())])
DOCS = T.StructType([T.StructField("id", T.LongType()), T.StructField("content", T.StringType())])
BLOCKS = T.StructType(
    [
        T.StructField("block_id", T.LongType()),
        T.StructField("type", T.ShortType()),
        T.StructField("flags", T.ShortType()),
        T.StructField("size", T.LongType()),
        T.StructField("checksum", T.StringType()),
        T.StructField("prev", T.LongType()),
        T.StructField("next", T.LongType()),
        T.StructField("ts", T.LongType()),
        T.StructField("data", T.BinaryType()),
    ]
)
ACCESS = T.StructType(
    [
        T.StructField("block_key", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("location", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("op", T.StringType()),
        T.StructField("latency", T.LongType()),
    ]
)
ACL = T.StructType(
    [
        T.StructField("subject_id", T.StringType()),
        T.StructField("subject_type", T.StringType()),
        T.StructField("resource_id", T.StringType()),
        T.StructField("resource_type", T.StringType()),
        T.StructField("operation", T.StringType()),
        T.StructField("effect", T.StringType()),
        T.StructField("expires_at", T.TimestampType()),
    ]
)
FS_ENTRIES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("is_dir", T.BooleanType()),
        T.StructField("size", T.LongType()),
        T.StructField("mode", T.IntegerType()),
        T.StructField("modified", T.TimestampType()),
    ]
)

BLOCK_TYPES = {0: "normal", 1: "metadata", 2: "index", 3: "delta", 4: "xor", 5: "compression", 6: "encrypted", 7: "indirect", 8: "system"}


def session(app: str = "tessella", **conf: str) -> SparkSession:
    """A session with the settings that results depend on (UTC) and those that plans profit from (AQE)."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
