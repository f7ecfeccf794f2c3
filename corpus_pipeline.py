"""From raw documents to packed sequences: five stages, each on all that the one before has kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fleetlens.llm import near_duplicates, packing, private_data, quality_rules, substring_dedup
from fleetlens.llm.common import as_documents, stored

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
# SQL has neither the tokenizer nor the trained and iterative stages; the tests compare with plain versions.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    rated = quality_rules.rated(docs, quality_rules.language_references(docs), carry=True)
    return as_documents(rated.where("kept"), docs, "text")


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest id, a null id last."""
    return as_documents(near_duplicates.representatives(docs), docs, "text")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur again; a text that loses nothing stays as it is."""
    return as_documents(substring_dedup.deduplicated(docs, carry=True), docs, "kept")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a label in place of personal data."""
    return as_documents(private_data.found(docs, private_data.trained(docs), carry=True), docs, "redacted")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts in sequences of 1024 tokens."""
    return packing.packed(docs, VOCABULARY)


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicate),
    ("repeated passages", repeated_passages),
    ("personal data", personal_data),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next stage's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs, f"stage-{number}")
    return docs
