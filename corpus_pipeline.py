"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before has written,
and returns what the next one reads. All but the last return the columns of documents.

A null text is an empty one in every stage. Rows without an id are judged by quality like
any other and otherwise stay whole; rows of one id stay or go together as near copies, are
one document where repeats are cut, and are packed each. An empty table stays empty.
Columns beside those of documents are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiloom.llm import decontaminate, packing, quality_classifier, simhash, substring_dedup
from lexiloom.llm.common import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays."""
    return simhash.deduplicate(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that another document keeps are cut out of the text."""
    return substring_dedup.deduplicate(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", quality),
    ("simhash", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontamination", benchmark_leaks),
    ("packing", packed),
]
#: Learnt trees, components and byte-pair merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
