"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, decontamination, html_extract, ngram_jaccard, pii, quality_classifier, quality_rules, substring_dedup, token_counts, toxicity
from tessella.llm.common import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.similar_documents(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _with_spans(found: DataFrame) -> DataFrame:
    """The spans removed, as start:end:doc_id:start of what stays, joined by commas, beside the text that is left."""
    spans = F.transform("removed", lambda g: F.concat_ws(":", g["start"].cast("string"), g["end"].cast("string"), g["first_doc_id"].cast("string"), g["first_start"].cast("string")))
    return found.select("doc_id", "text", "n_removed", F.array_join(spans, ",").alias("spans"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_spans(substring_dedup.substring_dedup(table(spark, sf_dir, "documents")))


def passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that repeat, wherever they begin and end; op10 is bound to lines and sentences by its SQL."""
    return _with_spans(substring_dedup.passage_dedup(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_token_counts": op3_token_counts,
    "op4_quality_rules": op4_quality_rules,
    "op5_decontamination": op5_decontamination,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_pii": op7_pii,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_toxicity": op9_toxicity,
    "op10_substring_dedup": op10_substring_dedup,
    "passage_dedup": passage_dedup,
}

ORACLES: dict[str, str] = {"op2_ngram_jaccard": ngram_jaccard.ORACLE, "op10_substring_dedup": substring_dedup.ORACLE, "passage_dedup": substring_dedup.PASSAGE_ORACLE}
