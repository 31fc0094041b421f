"""Documents to packed batches: language, repeated lines, near copies, benchmark text, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and is
written as Parquet before the next one reads it.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from barscreen.llm import (  # noqa: E402
    decontaminate,
    language_gru,
    length_buckets,
    line_dedup,
    parity_join,
)
from barscreen.llm.common import given  # noqa: E402
from barscreen.session import staged  # noqa: E402


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language was recognised."""
    return language_gru.accepted(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated lines go, and documents of which nothing is left."""
    return line_dedup.cleaned(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard of 0.8 at least."""
    return parity_join.without_repeats(parity_join.representatives(docs, percent=80, width=5))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark text to speak of."""
    return decontaminate.clean_documents(docs, given(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents in padded batches."""
    return length_buckets.pack(docs)


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("packing", packing),
]

# a trained network decides in the first stage, so SQL can't give the rows
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = given(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
