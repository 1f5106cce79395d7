"""The corpus pipeline: quality classifier, near duplicates, benchmark decontamination, personal data, encoding.

Every stage takes what its predecessor kept and is written as Parquet and read again before the next, so a lost
executor costs at most a stage. Part of the training-data operators in tessella.llm.

Defined results: null, empty and all-space texts are rejected by the first stage; rows without doc_id pass the filtering
stages, whose decisions are joined by doc_id; of repeated rows one stays; columns beside those of documents go through
all stages but the last, which returns doc_id, n_tokens, ids_sha256 and decoded_sha256.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, decontamination, ngram_jaccard, pii, quality_classifier
from tessella.llm.common import shared_dir, small_side, stored, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality_classifier.kept_documents(docs, table(spark, sf_dir, "labels"))


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked by 3-gram Jaccard similarity; of repeated rows one."""
    groups = ngram_jaccard.similar_documents(docs)
    gone = stored(groups.where("doc_id is not null and doc_id <> component_id").select("doc_id").distinct(), "similar")
    left = docs.join(small_side(gone), "doc_id", "left_anti").select(docs.columns)
    repeated = stored(docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return left
    once = left.join(small_side(repeated), "doc_id", "left_anti").select(docs.columns)
    return once.unionByName(left.join(small_side(repeated), "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"]))


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars follows the text."""
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document that is left."""
    return bpe.round_trip(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("ngram_jaccard_join", keep_one_of_similar),
    ("benchmark_decontamination", keep_uncontaminated),
    ("pii", redact),
    ("byte_level_bpe", encode),
]

#: SQL can't express the classifier's fit, the span classifier or the encoder; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/tessella-pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
