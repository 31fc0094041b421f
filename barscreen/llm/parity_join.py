"""Similarity join of shingle sets by parity sketches.

A set of n shingles is cut by hash range into blocks, and every block is sketched by the XOR of
its shingles' hashes. One differing shingle changes one block, so two sets whose symmetric
difference is at most d agree in all but d of their blocks (pigeonhole): an equal block is a join
key. A second sketch flips one bit per shingle; its Hamming distance is a lower bound of the
symmetric difference and drops most candidates before the exact check of the sets.

Sets of similar size share a band, which fixes the number of blocks and bits. A set also takes
part in the bands of the larger sets it could be similar to.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .common import utf8
from .components import connected_components

SMALL = 32  # members of a key that are paired row by row; larger keys are compared in blocks
BLOCK = 1024
_ODD = np.uint64(0x9E3779B97F4A7C15)
_CACHED_WORDS = 150_000

SKETCH = (
    "id bigint, n bigint, sum bigint, parity bigint, own boolean, band int, "
    "blocks array<bigint>, bits array<bigint>"
)
IDENTITY = "id bigint, n bigint, sum bigint, parity bigint"
SHINGLES = "id bigint, n bigint, sum bigint, parity bigint, shingles array<bigint>"


def _band_starts(limit: int = 1 << 40) -> list[int]:
    """Sizes at which a band begins; a band is a quarter wider than its start."""
    starts = [1]
    while starts[-1] < limit:
        starts.append(max(starts[-1] + 1, starts[-1] * 5 // 4))
    return starts


_STARTS = _band_starts()


def band_of(n: int) -> int:
    return bisect_right(_STARTS, n) - 1


def bands_for(n: int, percent: int) -> range:
    """The own band and those of larger sets that may reach ``percent`` similarity with n."""
    return range(band_of(n), band_of(n * 100 // percent) + 1)


def most_different(band: int, percent: int) -> int:
    """Symmetric difference of two similar sets, the larger one in ``band``, at most."""
    return 2 * (_STARTS[band + 1] - 1) * (100 - percent) // (100 + percent)


def spare_blocks(band: int, percent: int) -> int:
    """Blocks beyond those that the pigeonhole needs; every set leaves out as many of its own."""
    count = most_different(band, percent) + 1
    fewest = -(-_STARTS[band] * percent // 100)
    return 1 + count // 16 + math.ceil(2 * count * math.exp(-fewest / count))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_hashes(text: bytes, width: int, words: _WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; of all words if there are fewer.

    Words are what ASCII white space (0x09-0x0D, 0x20) separates, A-Z in lower case.
    """
    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    width = min(width, len(hashes))
    rolled = np.full(len(hashes) - width + 1, width, np.uint64)
    for k in range(width):
        rolled = (rolled + hashes[k : k + len(rolled)]) * _ODD
        rolled ^= rolled >> np.uint64(29)
    return np.unique(_mix(rolled))


def _blocks(shingles: np.ndarray, band: int, percent: int) -> np.ndarray:
    """The join keys of a set in a band: XORs of its blocks, each mixed with its place.

    With s spare blocks, similar sets agree in s + 1 blocks at least. Each set leaves out the
    first s blocks in order of (number of shingles, place): empty and nearly empty blocks, which
    many sets share. Of the blocks that two sets agree in, the last one in that order has s
    others before it in both sets, so neither leaves it out.
    """
    spare = spare_blocks(band, percent)
    count = most_different(band, percent) + 1 + spare
    # a range of hashes for each block: the sorted shingles of a block lie side by side
    place = ((shingles >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
    used, starts, sizes = np.unique(place, return_index=True, return_counts=True)
    keys, held = np.zeros(count, np.uint64), np.zeros(count, np.int64)
    at = used.astype(np.int64)
    keys[at], held[at] = np.bitwise_xor.reduceat(shingles, starts), sizes
    kept = np.argsort(held, kind="stable")[spare:]
    return _mix(keys[kept] ^ ((kept.astype(np.uint64) + np.uint64(band << 40)) * _ODD))


def _bits(shingles: np.ndarray, band: int) -> np.ndarray:
    """Four bits for each shingle that a set of the band may have; each shingle flips one."""
    words = -(-4 * _STARTS[band + 1] // 64)
    flips = np.bincount((_mix(shingles ^ _ODD) % np.uint64(64 * words)).astype(np.int64), minlength=64 * words)
    return np.packbits((flips & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def _identity(shingles: np.ndarray) -> tuple[int, int, int]:
    """Size and 128 bits that stand for the set."""
    if not len(shingles):
        return 0, 0, 0
    other = np.bitwise_xor.reduce(_mix(shingles + _ODD))
    return len(shingles), int(shingles.sum().astype(np.int64)), int(other.astype(np.int64))


def sketches(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """A row for each set and band it takes part in; sets are not kept."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordHashes()
        for batch in batches:
            data, bounds = utf8(batch.column(1))
            columns: list[list] = [[] for _ in range(8)]
            for i, doc in enumerate(batch.column(0).to_pylist()):
                shingles = shingle_hashes(data[bounds[i] : bounds[i + 1]].tobytes(), width, words)
                n, total, parity = _identity(shingles)
                for band in bands_for(n, percent) if n else (-1,):
                    none = np.empty(0, np.uint64)
                    row = (
                        doc, n, total, parity, band == (band_of(n) if n else -1), band,
                        (_blocks(shingles, band, percent) if n else none).view(np.int64),
                        (_bits(shingles, band) if n else none).view(np.int64),
                    )
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
            kinds = [pa.int64()] * 4 + [pa.bool_(), pa.int32()] + [pa.list_(pa.int64())] * 2
            names = [c.split()[0] for c in SKETCH.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
            )

    return docs.mapInArrow(work, SKETCH)


def identities(docs: DataFrame, width: int) -> DataFrame:
    """(id, n, sum, parity) of every row: what its set is, without the set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordHashes()
        for batch in batches:
            data, bounds = utf8(batch.column(1))
            sets = (shingle_hashes(data[lo:hi].tobytes(), width, words) for lo, hi in pairwise(bounds.tolist()))
            columns = list(zip(*map(_identity, sets), strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["id", "n", "sum", "parity"]
            )

    return docs.mapInArrow(work, IDENTITY)


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordHashes()
        for batch in batches:
            data, bounds = utf8(batch.column(1))
            rows = []
            for i, doc in enumerate(batch.column(0).to_pylist()):
                shingles = shingle_hashes(data[bounds[i] : bounds[i + 1]].tobytes(), width, words)
                rows.append((doc, *_identity(shingles), shingles.view(np.int64)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
            names = ["id", "n", "sum", "parity", "shingles"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
            )

    return docs.mapInArrow(work, SHINGLES)


def _similar(a: Column, b: Column, shared: Column, percent: int) -> Column:
    return 100 * shared >= percent * (a + b - shared)


def _near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v, band) of class ids that size and Hamming distance allow to be similar."""
    ends = classes.select("id", "band", "n", "bits")
    a = ends.select(F.col("id").alias("u"), "band", F.col("n").alias("nu"), F.col("bits").alias("bu"))
    b = ends.select(F.col("id").alias("v"), "band", F.col("n").alias("nv"), F.col("bits").alias("bv"))
    hamming = F.aggregate(
        F.zip_with("bu", "bv", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x
    )
    return (
        pairs.join(a, ["u", "band"])
        .join(b, ["v", "band"])
        .filter(100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv"))
        .filter((100 + percent) * hamming <= (100 - percent) * (F.col("nu") + F.col("nv")))
        .select("u", "v")
    )


def _compare(percent: int):
    """Pairs inside two blocks of a key that are in different components and may be similar."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", ignore_index=True)
        low, high = int(rows["low"].iloc[0]), int(rows["high"].iloc[0])
        bits = np.array(rows["bits"].tolist(), np.int64).view(np.uint64)
        n, ids, component = (rows[c].to_numpy() for c in ("n", "id", "component"))
        left = np.flatnonzero(rows["block"].to_numpy() == low)
        right = np.flatnonzero(rows["block"].to_numpy() == high)
        found = []
        for i in left:
            total = n[i] + n[right]
            open_ = (component[i] != component[right]) & (
                100 * np.minimum(n[i], n[right]) >= percent * np.maximum(n[i], n[right])
            )
            at = right[open_]
            hamming = np.bitwise_count(bits[i] ^ bits[at]).sum(axis=1, dtype=np.int64)
            near = at[(100 + percent) * hamming <= (100 - percent) * total[open_]]
            found.append(pd.DataFrame({"u": np.minimum(ids[i], ids[near]), "v": np.maximum(ids[i], ids[near])}))
        out = pd.concat(found) if found else pd.DataFrame({"u": ids[:0], "v": ids[:0]})
        return out.drop_duplicates()

    return compare


def _open_pairs(keyed: DataFrame, hubs: DataFrame, found: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of one key that no hub has tested, that are in different components and may be similar."""
    placed = (
        keyed.join(hubs.filter("members > 2").select("key", "hub"), "key")
        .filter("id != hub")
        .join(found.withColumnRenamed("node", "id"), "id", "left")
        .select("key", "band", "id", F.coalesce("component", "id").alias("component"))
    )
    placed = staged(placed, "placed")
    apart = placed.groupBy("key").agg(
        F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("members")
    )
    open_ = placed.join(apart.filter("a < b").select("key", "members"), "key")
    open_ = staged(open_, "open")
    left = open_.filter(F.col("members") <= SMALL)
    right = left.select("key", F.col("id").alias("v"), F.col("component").alias("other"))
    few = left.join(right, "key").filter("id < v AND component != other")
    few = staged(few.select(F.col("id").alias("u"), "v", "band").distinct(), "few")
    few = _near(few, classes, percent)
    blocks = F.ceil(F.col("members") / BLOCK)
    # each member meets every block of its key: blocks, not members, are paired
    many = (
        open_.filter(F.col("members") > SMALL)
        .withColumn("block", F.pmod(F.xxhash64("id"), blocks))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
        .select("key", "band", "id", "component", "block", "low", "high")
        .join(classes.select("id", "band", "n", "bits"), ["id", "band"])
        .groupBy("key", "low", "high")
        .applyInPandas(_compare(percent), "u bigint, v bigint")
    )
    return few.unionAll(many).distinct()


def _verified(near: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs (u, v) of class ids whose sets are similar. ``near`` is a stored table."""
    wanted = near.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    texts = docs.join(wanted, "id", "left_semi").select("id", "text")
    known = classes.filter("own").select("id", "n", "sum", "parity")
    sets = shingle_sets(texts, width).join(known, ["id", "n", "sum", "parity"], "left_semi")
    # a doc_id that repeats may stand for several classes: the set of each one counts
    sets = staged(sets.dropDuplicates(["id", "n", "sum", "parity"]).select("id", "shingles"), "sets")
    su = sets.select(F.col("id").alias("u"), F.col("shingles").alias("su"))
    sv = sets.select(F.col("id").alias("v"), F.col("shingles").alias("sv"))
    shared = F.size(F.array_intersect("su", "sv"))
    return (
        near.join(su, "u").join(sv, "v")
        .filter(_similar(F.size("su"), F.size("sv"), shared, percent))
        .select("u", "v")
    )


def similar_documents(docs: DataFrame, percent: int = 90, width: int = 3) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    Rows are linked where 100 * |intersection| >= percent * |union| of their shingle sets;
    component_id is the smallest doc_id reachable over links, the own one included. A null or
    wordless text has no shingles and no links. Rows that repeat a doc_id are documents of their
    own. A null doc_id gets the component of its class, null if nothing else is in it.

    Equal sets form a class that joins as one. Every key links its members to one hub first,
    which puts a large group of near copies together in linear work; members of a key that are
    still apart are then compared with each other by their sketches, those of large keys in
    blocks of bounded size. Nothing is capped or dropped.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))
    rows = staged(identities(texts, width), "identities")
    kind = ["n", "sum", "parity"]
    # members of a class have the same sketches: any one stands for it, and only its are stored
    classes = staged(
        sketches(texts, percent, width).filter("n > 0 AND id IS NOT NULL")
        .groupBy(*kind, "band", "own")
        .agg(F.min("id").alias("id"), F.first("blocks").alias("blocks"), F.first("bits").alias("bits")),
        "classes",
    )
    keyed = classes.select(F.explode("blocks").alias("key"), "band", "id")
    hubs = keyed.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("members"))
    hubs = staged(hubs.filter("members > 1"), "hubs")
    spokes = (
        keyed.join(hubs.select("key", "hub"), "key")
        .filter("id != hub")
        .select(F.col("hub").alias("u"), F.col("id").alias("v"), "band")
        .distinct()
    )
    # stored on its own: the keys' shuffle is gone before the sketches are shuffled
    spokes = staged(spokes, "spokes")
    near = staged(_near(spokes, classes, percent).distinct(), "near")
    links = staged(_verified(near, classes, texts, percent, width), "links")
    found = connected_components(links, "u", "v")
    rest = staged(_open_pairs(keyed, hubs, found, classes, percent), "rest")
    if not rest.isEmpty():
        more = staged(_verified(rest, classes, texts, percent, width), "links")
        found = connected_components(links.unionAll(more), "u", "v")
    of_class = (
        classes.filter("own").select(*kind, "id")
        .join(found.withColumnRenamed("node", "id"), "id", "left")
        .select(*kind, F.coalesce("component", "id").alias("of_class"))
    )
    return rows.join(of_class, kind, "left").select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.coalesce("of_class", "id").alias("component_id"),
    )


def representatives(docs: DataFrame, percent: int = 90, width: int = 3) -> DataFrame:
    """``docs`` without rows that are similar to one with a smaller doc_id in their component.

    Rows with a null doc_id stay. Of rows that repeat a kept doc_id all stay.
    """
    found = similar_documents(docs, percent, width)
    gone = found.filter("doc_id != component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each (doc_id, text); only rows whose doc_id repeats are shuffled."""
    many = docs.groupBy("doc_id").agg(F.count("*").alias("__n")).filter("__n > 1").select(F.col("doc_id").alias("__many"))
    many = staged(many, "repeated")
    same = docs["doc_id"].eqNullSafe(many["__many"])
    again = docs.join(many, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return docs.join(many, same, "left_anti").unionByName(again)
