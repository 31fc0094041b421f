"""Registered queries of this folder, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    best_fit,
    decontaminate,
    embedding_dedup,
    hard_negatives,
    language_gru,
    length_buckets,
    license_scan,
    line_dedup,
    parity_join,
    prefix_trie,
    quality_crf,
    secret_grammar,
    token_transducer,
)
from .common import given
from .oracle import ORACLE

__all__ = ["ORACLE", "QUERIES"]

def tokenizer(name: str) -> str:
    """The path of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.documents_scan(given(spark, sf_dir, "documents"))


def op2_secret_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_grammar.find_secrets(given(spark, sf_dir, "documents"))


def op3_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.quality(given(spark, sf_dir, "documents"), given(spark, sf_dir, "labels"))


def op4_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.similar_documents(given(spark, sf_dir, "documents"))


def op5_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_buckets.pack(given(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(given(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_gru.identify(given(spark, sf_dir, "documents"))


def op8_token_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_transducer.token_counts(given(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(given(spark, sf_dir, "documents"), given(spark, sf_dir, "benchmark"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(given(spark, sf_dir, "embeddings"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(given(spark, sf_dir, "embeddings"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(given(spark, sf_dir, "conversations"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(given(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_secret_grammar,
        op3_quality_crf,
        op4_parity_join,
        op5_length_buckets,
        op6_line_dedup,
        op7_language_id,
        op8_token_transducer,
        op9_decontamination,
        op10_embedding_dedup,
        op11_hard_negatives,
        op12_conversation_trie,
        op13_best_fit_packing,
    )
}
