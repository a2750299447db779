"""A training corpus from raw documents, in five stages.

Each stage takes what the one before it kept, all of it, and its decisions take effect: documents of
low quality go, one document of each group of near-duplicates stays, documents that hold a benchmark
item go, secrets that look live are masked in the text, and the rest is packed into sequences.

Edge cases: null and empty texts are scored, linked with nothing, hold nothing, and are packed as their
closing id; texts of any length are read whole. A row without doc_id is linked with nothing and goes on.
Repeated rows are scored, scanned and packed once each, and one of them outlives near-dedup; of equally
near documents the smallest id stays. Extra columns, whatever their names, are handed on by all stages
but the last. Empty tables give an empty result; without labels no document is rejected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import decontaminate, neardup, packing, quality, scratch, secrets


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier doesn't reject."""
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.keep(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return decontaminate.keep(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets that look live masked."""
    return secrets.redact(docs, repository=secrets.repository(), owner="source")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, by sequence."""
    return packing.pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good),
    ("near-dedup", distinct),
    ("decontamination", unseen),
    ("secret scans", masked),
    ("packing", packed),
]

#: Neither the classifier nor the vocabulary can be put into SQL; the tests hold stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
