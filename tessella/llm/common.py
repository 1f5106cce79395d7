"""Shared pieces of the training-data operators: reading, cutting lineage, bounded broadcasts, word splitting."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it was counted and has at most so many rows of a few bytes each.
BROADCAST_ROWS = 1_000_000
_LOCAL: dict[str, str] = {}

#: Words are runs of anything but the six ASCII white-space characters.
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Only a local session, as in tests, whose executors
    are the driver itself, gets one of its own where it is unset; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that driver and executors share")
        path = _LOCAL.setdefault(spark.sparkContext.applicationId, "") or f"file://{tempfile.mkdtemp(prefix='tessella-')}"
        _LOCAL[spark.sparkContext.applicationId] = path
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessella-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **write_options: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet to the shared folder and reads it again, so a lost executor loses nothing."""
    path = new_path(df.sparkSession, name)
    df.write.options(**write_options).parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._stored_at = path
    return found


def discard(*tables: DataFrame) -> None:
    """Removes stored tables that no result reads any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def clean(spark: SparkSession, hours: float = 24.0) -> int:
    """Removes the tables that queries left in the shared folder more than ``hours`` ago; lazy results that are older
    can't be computed after it. Returns how many went."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    old = [f for f in (fs.listStatus(root) if fs.exists(root) else []) if f.getPath().getName().startswith("tessella-") and f.getModificationTime() <= (time.time() - hours * 3600) * 1000]
    for f in old:
        fs.delete(f.getPath(), True)
    return len(old)


def small_side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df marked for broadcast if its counted rows are at most ``rows``; otherwise df as it is, for a shuffled join.
    Callers pass a stored table of a few narrow columns, so the count is cheap and the bound is one on bytes too."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if rows is None else rows) else df


def let(value: Column, body) -> Column:
    """Binds ``value`` once: a lambda variable is evaluated a single time, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text; empty for null, empty and all-space texts."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), "^[\\x20\\x09-\\x0D]+", "")
    return F.filter(F.split(trimmed, WORD_GAP), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only, as the contract asks; F.lower would also change other letters."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
