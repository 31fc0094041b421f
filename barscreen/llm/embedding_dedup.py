"""Near-duplicate vectors: random-hyperplane hashing, exact cosines, connected components.

Each table hashes a vector to the signs of its products with random hyperplanes. Vectors of one
label with the same code in some table are compared exactly, in blocks of bounded size. The
number of signs follows the logarithm of the number of vectors, and the number of tables is what
keeps the chance to miss a pair at the threshold below ``miss``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .components import connected_components

BLOCK = 1024
SMALL, BUNDLE = 32, 4096  # members of a small bucket; rows of small buckets worked on together
BUCKET = ["label", "size", "table", "code"]
OUT = "id bigint, links bigint, low bigint"


def plan_tables(count: int, threshold: float, miss: float = 0.001) -> tuple[int, int]:
    """Signs for each table and number of tables."""
    signs = min(62, max(8, math.ceil(math.log2(max(count, 2))) - 3))
    agree = (1 - math.acos(threshold) / math.pi) ** signs
    return signs, math.ceil(math.log(miss) / math.log(1 - agree))


def codes(vectors: np.ndarray, signs: int, tables: int, seed: int = 11) -> np.ndarray:
    """The code of every vector (row) in every table."""
    planes = np.random.default_rng([seed, vectors.shape[1]]).normal(size=(vectors.shape[1], tables * signs))
    above = (vectors @ planes >= 0).reshape(len(vectors), tables, signs)
    return above @ (1 << np.arange(signs, dtype=np.int64))


def _with_codes(classes: DataFrame, signs: int, tables: int) -> DataFrame:
    @F.arrow_udf("array<bigint>")
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            vectors = column.to_pylist()
            out: list = [None] * len(vectors)
            by_size: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                by_size.setdefault(len(v), []).append(i)
            for rows in by_size.values():
                found = codes(np.array([vectors[i] for i in rows], np.float64), signs, tables)
                for i, code in zip(rows, found, strict=True):
                    out[i] = code
            yield pa.array(out, pa.list_(pa.int64()))

    return classes.withColumn("codes", hashed("vector"))


def _lowest(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``count`` nodes reaches over links a-b."""
    low = np.arange(count)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _compare(threshold: float):
    """Counts and joins what is linked in a bundle: a part of one large bucket, or small buckets.

    A pair that met in an earlier table isn't counted again.
    """

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        low, high = int(rows["low"].iloc[0]), int(rows["high"].iloc[0])
        rows = rows.sort_values([*BUCKET, "id"], ignore_index=True)
        names = rows[BUCKET].to_numpy()
        bounds = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
        vectors = np.array(rows["vector"].tolist(), np.float64)
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
        all_codes = np.array(rows["codes"].tolist())
        copies, block, tables = (rows[c].to_numpy() for c in ("copies", "block", "table"))
        links = np.zeros(len(rows), np.int64)
        ends = [(bounds[:0], bounds[:0])]
        for begin, end in pairwise([0, *bounds.tolist(), len(rows)]):
            left = begin + np.flatnonzero(block[begin:end] == low)
            right = begin + np.flatnonzero(block[begin:end] == high)
            for i in range(0, len(left), 256):
                part = left[i : i + 256]
                a, b = np.nonzero(vectors[part] @ vectors[right].T >= threshold)
                a, b = part[a], right[b]
                if low == high:
                    a, b = a[a < b], b[a < b]
                if len(a):
                    ends.append((a, b))
                    table = tables[begin]
                    first = ~(all_codes[a, :table] == all_codes[b, :table]).any(axis=1)
                    np.add.at(links, a[first], copies[b[first]])
                    np.add.at(links, b[first], copies[a[first]])
        a, b = (np.concatenate(x) for x in zip(*ends, strict=True))
        ids = rows["id"].to_numpy()
        # rows of a bucket lie in the order of their ids, so the lowest row has the lowest id
        out = pd.DataFrame({"id": ids, "links": links, "low": ids[_lowest(len(ids), a, b)]})
        return out[(out["links"] > 0) | (out["low"] != out["id"])]

    return compare


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.98, miss: float = 0.001, block: int = BLOCK
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding, label).

    Rows are linked if their labels are equal and the cosine is ``threshold`` or more. Rows whose
    label or vector is null, or whose vector is empty, zero or holds a null or non-finite
    component, link with nothing, and so do vectors of different length. Equal vectors form a
    class that is compared as one and counts as many links as it has rows. A null vec_id counts
    as a row; it is never a component's name unless it is alone.
    """
    usable = (
        F.col("label").isNotNull()
        & F.col("vector").isNotNull()
        & F.exists("vector", lambda x: x != 0)
        & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )
    rows = vectors.select(
        F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("vector")
    ).withColumn("usable", F.coalesce(usable, F.lit(False)))
    classes = (
        rows.filter("usable")
        .groupBy("label", "vector")
        .agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    )
    classes = staged(classes, "vectors")
    compared = classes.filter(F.col("id").isNotNull())
    signs, tables = plan_tables(compared.count(), threshold, miss)
    coded = staged(_with_codes(compared.withColumn("size", F.size("vector")), signs, tables), "codes")
    keys = coded.select("id", "label", "size", F.posexplode("codes").alias("table", "code"))
    shared = staged(keys.groupBy(*BUCKET).agg(F.count("*").alias("members")).filter("members > 1"), "buckets")
    rows_of_small = shared.filter(F.col("members") <= SMALL).agg(F.sum("members")).first()[0] or 0
    name = F.xxhash64(*BUCKET)
    small = F.pmod(name, F.lit(rows_of_small // BUNDLE + 1))
    blocks = F.ceil(F.col("members") / block)
    # each member meets every block of its bucket: blocks, not members, are paired
    members = (
        keys.join(shared, BUCKET)
        .withColumn("block", F.pmod(F.xxhash64("id"), blocks))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
        .withColumn("bundle", F.when(F.col("members") <= SMALL, small).otherwise(name))
        .select("id", "table", "code", "bundle", "block", "low", "high")
        .join(coded, "id")
    )
    found = staged(
        members.groupBy("size", "bundle", "low", "high").applyInPandas(_compare(threshold), OUT), "compared"
    )
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    components = connected_components(found, "id", "low").withColumnRenamed("node", "id")
    of_class = (
        classes.join(links, "id", "left")
        .join(components, "id", "left")
        .select(
            "label", "vector",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
    )
    joined = rows.filter("usable").join(of_class, ["label", "vector"])
    alone = rows.filter("NOT usable").select(
        F.col("id").alias("vec_id"), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id")
    )
    out = joined.select(F.col("id").alias("vec_id"), "n_links", "component_id").unionAll(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
