"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# letters beyond ASCII that lower() would change and the contracts leave alone
_OTHER_UPPER = r"[\x{80}-\x{10FFFF}&&[\p{Lu}\p{Lt}\p{IsUppercase}]]"


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is (``translate`` alone is slow)."""
    slow = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(text.rlike(_OTHER_UPPER), slow).otherwise(F.lower(text))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(key: str, folds: int) -> Column:
    """The remainder that the contracts split rows by."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def first_by_hash(df: DataFrame, key: str, group: str, most: int) -> DataFrame:
    """The ``most`` rows of every group that come first by a hash of the key.

    A bounded, repeatable sample. ``df`` should hold small columns only; Spark cuts each group
    to ``most`` rows before the shuffle.
    """
    from pyspark.sql import Window

    order = Window.partitionBy(group).orderBy(F.xxhash64(key), key)
    rank = fresh(df, "rank")
    return df.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= most).drop(rank)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins (one more for the end); a null is empty."""
    binary = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = binary.buffers()
    bounds = np.frombuffer(offsets, np.int64)[binary.offset : binary.offset + len(binary) + 1]
    if data is None:
        return np.empty(0, np.uint8), bounds
    return np.frombuffer(data, np.uint8), bounds
