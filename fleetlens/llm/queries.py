"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fleetlens.llm import (
    importance,
    merge_replay,
    near_duplicates,
    oracle,
    packing,
    periodic_runs,
    piece_tokens,
    private_data,
    quality_rules,
    substring_dedup,
    token_counts,
    token_files,
    vector_links,
    whitening,
)
from fleetlens.llm.common import work_path

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def query(build: Query) -> Query:
    REGISTRY[build.__name__] = build
    return build


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return private_data.found(docs, private_data.trained(docs)).drop("redacted")


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicated(documents(spark, sf_dir)).drop("kept")


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_replay.round_trip(documents(spark, sf_dir), BYTE_RANKS)


@query
def op4_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "token-files")
    token_files.write_token_files(documents(spark, sf_dir), path, BYTE_BPE)
    return token_files.with_checksums(token_files.read_token_files(spark, path))


@query
def op5_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links.linked(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), BYTE_BPE).drop("ids")


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_rules.rated(docs, quality_rules.language_references(docs))


@query
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.deduplicated(documents(spark, sf_dir))


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(documents(spark, sf_dir), WORD_BPE, 2048)


@query
def op10_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.sampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.found(periodic_runs.planted(documents(spark, sf_dir))))


@query
def op12_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_tokens.round_trip(documents(spark, sf_dir), PIECES)


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_dedup": oracle.REPEATS,
        "op5_vector_links": oracle.VECTORS,
        "op8_near_duplicates": oracle.NEAR,
    }
