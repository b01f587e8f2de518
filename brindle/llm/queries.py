"""The operators over the driver's tables: name -> (query, SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import credential_linking, filter_audit, hmm_language_model, importance_resampling, multi_order_jaccard, norm_topk, ppm_language, subword_toxicity, suffix_decontamination, suffix_sentencepiece, sum_of_squares_packing, weak_pii, winnowed_lines
from .common import table
from .oracles import ORACLES


def op1_norm_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm_topk.topk(table(spark, sf_dir, "embeddings"))


def op2_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subword_toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_suffix_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sentencepiece.encode(table(spark, sf_dir, "documents"))


def op4_winnowed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowed_lines.deduplicated(table(spark, sf_dir, "documents"))


def op5_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_hmm_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_language_model.scored(table(spark, sf_dir, "documents"))


def op7_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_pii.scan(table(spark, sf_dir, "documents"))


def op8_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_language.predict(table(spark, sf_dir, "documents"))


def op9_multi_order_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_order_jaccard.near_copies(table(spark, sf_dir, "documents"))


def op10_credential_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credential_linking.scan(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sum_of_squares_packing.packed(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_norm_topk, op2_subword_toxicity, op3_suffix_sentencepiece, op4_winnowed_lines, op5_suffix_decontamination, op6_hmm_language_model, op7_weak_pii, op8_ppm_language, op9_multi_order_jaccard, op10_credential_linking, op11_importance_resampling, op12_sum_of_squares_packing, op13_filter_audit)}
SQL = {k: v for k, v in ORACLES.items() if k in QUERIES}
