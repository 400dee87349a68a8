"""A training-corpus pipeline of five stages over ``documents``.

Each stage takes what the one before it kept, written as Parquet and read again. All but the last
return the columns of the table. SQL can express neither the language model, the n-gram join at
this size nor the tokenizer, so there is no SQL for the result; tests hold it against a brute-force
version.

Null and empty texts, and texts without a letter, have no language: the first stage drops them. Rows with the same
doc_id and text are repeats, of which the second stage keeps one; rows with a null doc_id belong to no group and
pass it and the third. Ties of copies go to the smallest doc_id. Very long texts are worked through whole. Further
columns, whatever their names, go along unread up to the last stage. An empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from zonepack.llm import decontaminate, jaccard_join, language_id, packing, pii
from zonepack.llm.shared import delete, stage_path, staged_until_end
from zonepack.llm.word_ids import vocabulary_path

NEAR_PERCENT, NEAR_WORDS = 80, 5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents in one of the learned languages; learned from the stage's own input."""
    return language_id.in_known_language(docs, language_id.learn(docs))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of each group of linked documents the one with the smallest doc_id. Documents link here
    when they share 80 % of their five-word shingles."""
    return jaccard_join.one_of_each(docs, percent=NEAR_PERCENT, width=NEAR_WORDS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents into which no benchmark item leaks."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: all documents, personal data replaced by typed placeholders."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the pieces of all documents in cost-balanced sequences."""
    return packing.pack(docs, vocabulary_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("near_copies", one_of_near_copies),
    ("benchmark", without_benchmark),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What each stage before it returns is written and read again; then what it has read,
    and what it has staged for itself, is deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, step in STAGES[:-1]:
        path = stage_path(spark, name)
        with staged_until_end(spark):
            step(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
