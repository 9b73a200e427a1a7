"""The corpus pipeline: stages that clean, deduplicate and pack the table ``documents``.

Each stage takes all rows that the one before kept. All but the last return the
columns of documents as they are; the fourth replaces texts, and ``n_chars``
with them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lectern.llm import stages


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return stages.keep_quality(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is told with some certainty."""
    return stages.keep_languages(docs)


def shingle_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, a Jaccard similarity of 0.8."""
    return stages.keep_one_of_near(docs, words=5, num=4, den=5)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without 100-byte strings that start earlier."""
    return stages.drop_repeats(docs, size=100)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens."""
    return stages.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("shingle_join", shingle_join),
    ("suffix_dedup", suffix_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express the learnt and iterative stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage gives is written to the shared checkpoint folder and read by the next one, then deleted; the result's table stays, as it is read when the caller reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stages.written(stage(spark, docs, sf_dir))
        if k:
            stages.forget(before)
    return docs
