"""Quality classifier by hierarchical empirical Bayes: a document's own evidence with its host's and path's record.

A logistic model over text measures, fitted on labelled rows, gives each document's evidence. Grouped aggregation
gives every host and path within it its record: of labelled documents their labels, of others the evidence. A source
that is a URL has its host and its first path segment, any other stands for a host itself; the language is part of the
path. A host's rate is shrunk towards the global prior and a path's towards its host's, the more the fewer documents
they have; how much is estimated from the spread of the rates over all groups (method of moments), so that sites that
differ by chance alone are all taken as the global prior. A document's own part is left out of its path's record. The
posterior odds of a document are its own odds, moved from the global prior to its path's rate.

The fit uses at most ``train_rows`` labelled rows, chosen by a hash; measures, group statistics and decisions cover
all rows.

Defined results: null or empty text has measures of zero and is rejected; null host or path is a group of its own;
repeated rows each keep their row and count each; a null doc_id stays null and isn't learned from; without labels of
both kinds every document with text is kept; an empty table gives no rows; extra columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import small_side, stored
from tessella.shipping import map_arrow

TRAIN_ROWS = 20_000
MEASURES = ("log_words", "mean_word", "symbols", "bars", "upper", "shouts", "digits", "stops", "dup_lines", "distinct_words", "short_lines", "long_words")
#: How far the odds move from the global prior to the path's rate: 1 is Bayes' rule, 0 leaves sites out.
SITE_WEIGHT = 1.0
_SYMBOLS = re.compile(r"[#*$%&<>]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGITS = re.compile(r"[0-9]")
_STOPS = re.compile(r"[.!?:;,]")


def measure(text: str) -> tuple[float, ...]:
    """The measures of one whole text."""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(MEASURES)
    chars = len(text)
    lines = [x for x in text.split("\n") if x.strip()]
    kinds = set(words)
    share = lambda p: len(p.findall(text)) / chars
    lengths = list(map(len, words))
    return (
        float(np.log1p(n)),
        sum(lengths) / n,
        len(_SYMBOLS.findall(text)) / n,
        text.count("|") / n,
        share(_UPPER),
        text.count("!") / n,
        share(_DIGITS),
        len(_STOPS.findall(text)) / n,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        len(kinds) / n**0.8,
        sum(len(x) < 20 for x in lines) / len(lines) if lines else 0.0,
        sum(x > 15 for x in lengths) / n,
    )


def _expanded(x: np.ndarray) -> np.ndarray:
    """Measures with squares of their clipped, scaled values, for bounds on both sides."""
    return np.hstack([np.ones((len(x), 1)), x, x**2])


class Evidence:
    """Logistic regression over the scaled measures."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = _expanded(self._scaled(x))
        w, ridge = np.zeros(z.shape[1]), np.eye(z.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
            w -= step
            if abs(step).max() < 1e-6:
                break
        self.w = w

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -4, 4)

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(_expanded(self._scaled(x)) @ self.w, -19, 19)


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, host, path, text) -> those without text, with m array<double> and has_text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(v.as_py() or "") for v in batch.column(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "host", "path", "m"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs, run, f"doc_id {kind}, host string, path string, m array<double>")


def fit(found: DataFrame, labels: DataFrame, train_rows: int) -> Evidence | None:
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("quality"))
    chosen = stored(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows), "labelled")
    rows = found.join(small_side(chosen, max(train_rows, 1)), "doc_id").where("m[0] > 0").dropDuplicates(["doc_id"]).select("m", "quality").collect()
    y = np.array([float(r["quality"]) for r in rows])
    if not len(y) or y.min() == y.max():
        return None
    return Evidence(np.array([r["m"] for r in rows]), y)


def strength_of(groups: DataFrame, rate: str) -> float:
    """groups: n, good, <rate> (what to shrink to) -> how many documents the rate counts for, as of a beta prior:
    estimated from all groups at once, by the variance between them beyond what chance gives."""
    p = F.col("good") / F.col("n")
    spread = groups.where("n > 1").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(p - F.col(rate), 2)).alias("v"), F.sum(F.col("n") * F.col(rate) * (1 - F.col(rate))).alias("u"), F.count("*").alias("k")).first()
    if not spread["n"] or not spread["u"]:
        return 50.0
    unit, between = spread["u"] / spread["n"], (spread["v"] - spread["k"] * spread["u"] / spread["n"]) / spread["n"]
    return float(min(1e4, max(2.0, unit / between - 1))) if between > 0 else 1e4


def shrunk(groups: DataFrame, rate: str) -> DataFrame:
    """groups with posterior: the rate of each, shrunk to what <rate> says."""
    strength = strength_of(groups, rate)
    return groups.withColumn("posterior", (F.col("good") + strength * F.col(rate)) / (F.col("n") + strength))


def site(url: Column) -> tuple[Column, Column]:
    """Host and first path segment of a URL; what is no URL is a host with an empty path."""
    parts = "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)/?([^/?#]*)"
    is_url = url.rlike(parts)
    return F.when(is_url, F.lower(F.regexp_extract(url, parts, 1))).otherwise(url), F.when(is_url, F.regexp_extract(url, parts, 2)).otherwise("")


def quality(docs: DataFrame, labels: DataFrame, *, train_rows: int = TRAIN_ROWS, threshold: float = 0.5, site_weight: float = SITE_WEIGHT, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """doc_id, evidence, host_rate, path_rate, score, kept."""
    spark = docs.sparkSession
    host, segment = site(F.col(host_col).cast("string"))
    rows = docs.select(F.col(id_col).alias("doc_id"), host.alias("host"), F.concat_ws("/", segment, F.col(path_col).cast("string")).alias("path"), F.col(text_col).alias("text"))
    found = stored(measured(rows), "quality")
    model = fit(found, labels.select(F.col(id_col).alias("doc_id"), "quality"), train_rows)
    if model is None:
        return found.select("doc_id", F.lit(1.0).alias("evidence"), F.lit(1.0).alias("host_rate"), F.lit(1.0).alias("path_rate"), F.lit(1.0).alias("score"), (F.col("m")[0] > 0).alias("kept"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.array(batch.column(3).to_pylist()).reshape(batch.num_rows, len(MEASURES))
            odds = np.where(m[:, 0] > 0, shared.value.odds(m), -20.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(odds)], ["doc_id", "host", "path", "odds"])

    kind = found.schema["doc_id"].dataType.simpleString()
    scored = stored(map_arrow(found, run, f"doc_id {kind}, host string, path string, odds double").withColumn("evidence", F.lit(1.0) / (1 + F.exp(-F.col("odds")))), "evidence")

    # Labels count whole, wherever they are: every labelled row, not the fit's sample
    known = labels.select(F.col(id_col).alias("doc_id"), F.col("quality").cast("int").alias("label")).where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    scored = stored(scored.join(small_side(known), "doc_id", "left").withColumn("good", F.when(F.col("odds") > -20.0, F.coalesce(F.col("label").cast("double"), F.col("evidence"))).otherwise(0.0)).drop("label"), "records")
    # sums of (host, path), then of hosts, then of all: each aggregated before it is shuffled, whatever a host holds
    paths = stored(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("good").alias("good")), "paths")
    total = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    prior = min(0.999, max(0.001, total["good"] / total["n"])) if total["n"] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("prior", F.lit(prior))
    hosts = shrunk(hosts, "prior").select(F.col("host").alias("h"), F.col("posterior").alias("host_rate"))
    paths = stored(paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h"), "rates")
    by_path = strength_of(paths, "host_rate")
    rates = paths.select(F.col("host").alias("h"), F.col("path").alias("p"), "host_rate", F.col("n").alias("path_n"), F.col("good").alias("path_good"))

    logit = lambda c: F.log(c / (1 - c))
    joined = scored.join(small_side(rates), F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
    rate = (F.col("path_good") - F.col("good") + by_path * F.col("host_rate")) / (F.col("path_n") - 1 + by_path)
    joined = joined.withColumn("path_rate", F.least(F.lit(0.999), F.greatest(F.lit(0.001), rate)))
    score = F.lit(1.0) / (1 + F.exp(-(F.col("odds") + site_weight * (logit(F.col("path_rate")) - F.log(F.lit(prior / (1 - prior)))))))
    has_text = F.col("odds") > -20.0
    return joined.select("doc_id", "evidence", "host_rate", "path_rate", score.alias("score"), (has_text & (score >= threshold)).alias("kept"))


def kept_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without those it rejects; all columns as they are. Rows without doc_id stay."""
    bad = stored(quality(docs, labels, **options).where("not kept and doc_id is not null").select("doc_id").distinct(), "rejected")
    return docs.join(small_side(bad), "doc_id", "left_anti").select(docs.columns)
