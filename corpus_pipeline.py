"""From raw documents to token ids, in five stages that each work on all their predecessor kept.

Every stage is written as a Parquet table and read again by the next one, so a
lost executor costs part of one stage. SQL can't express context-tree codes or
byte-pair merging, so there is no ORACLE_SQL; tests hold each stage against a
brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import multi_order_jaccard, ppm_language, suffix_decontamination, suffix_sentencepiece, winnowed_lines
from brindle.llm.common import discard, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language can be told (learnt from this stage's own rows); the others go."""
    return ppm_language.accepted(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that occurred before are cut from texts; a text of nothing else goes."""
    return winnowed_lines.without_repeats(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    return multi_order_jaccard.first_copies(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return suffix_decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text left, with their number and whether they decode to the text."""
    return suffix_sentencepiece.encode_columns(docs).select("doc_id", "lang", "source", "n_tokens", "ids", "round_trip")


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("lines", lines),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("tokens", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs, done = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        discard(*done)  # what the stage before has written is read
        done = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
