"""The corpus pipeline: language, quality, exact copies, near copies, packing.

Each stage takes the documents its predecessor kept, whole, and is written as Parquet before the next one reads it. All stages but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact_dedup, language, ngram_join, packing, quality
from tidemark.llm.common import bounded_batches, scratch, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts of which no language holds half."""
    bounded_batches(spark)
    return language.keep_known(docs, language.train(docs))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what fails the base rules or the classifier, trained on the labelled rows among these documents."""
    bounded_batches(spark)
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return exact_dedup.exact_dedup(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked texts the smallest doc_id stays."""
    bounded_batches(spark)
    return ngram_join.near_dedup(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents by sequence."""
    bounded_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("language", known_language),
    ("quality", good_quality),
    ("exact dedup", without_copies),
    ("n-gram join", without_near_copies),
    ("packing", packed),
]

#: Language, quality and packing aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/stage-{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
