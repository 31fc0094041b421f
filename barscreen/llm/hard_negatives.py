"""Hard negatives: anchors read only the Hilbert-ordered blocks that their zone maps allow.

Vectors are quantised to integers, sorted along a Hilbert curve over their widest dimensions
within each label, cut into blocks of ``block`` rows and written as Parquet. Each block keeps a
zone map, the smallest and largest value of every dimension. For an anchor ``a`` interval
arithmetic bounds every score in a block: ``sum(min(a*lo, a*hi)) <= a.x <= sum(max(a*lo, a*hi))``.

* Positives: the lower bounds of an anchor's same-label blocks, taken in falling order, show a
  score that six rows (the anchor may be one of them) surely reach; only blocks whose upper bound
  reaches it are read.
* Negatives: a block is read for (anchor, positive) only if its interval meets the band
  ``[0.8 * positive_score, positive_score]`` and its upper bound reaches the score that five
  rows of blocks lying wholly in the band surely reach.

Blocks are scored in groups of (block, anchor chunk) with numpy; the best five of each block are
merged per anchor. Nothing is cut: a block that can hold a winner is always read, and every
anchor is compared with every row that the bounds can't exclude.

Rules: a row takes part only with a label, a vector and finite, non-null components; where
vec_id is divisible by 7 its label becomes (label + 1) % 10. Components become
``floor(256 * x)``; a shorter vector counts its missing components as 0. Rows order by score
(higher first), ties by smaller vec_id. An anchor's "other rows" are rows of another vec_id, so
a repeated anchor row neither counts itself nor its copies; every anchor row is answered on
its own (a repeated anchor id gives its rows once per copy). Empty input gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

TOP = 5  # positives per anchor, negatives per (anchor, positive)
BLOCK = 256  # rows of a block
CURVE_DIMS, CURVE_BITS = 4, 8  # widest dimensions that the Hilbert curve follows, bits of each
RANGE_ROWS = 50_000  # rows of a range partition while blocks are cut
CHUNK = 2048  # query rows that meet one block in one group
BROADCAST_BYTES = 64 << 20  # zone maps broadcast up to this measured size

CANDIDATE = "anchor_key bigint, anchor_id bigint, slot int, vec_id bigint, score bigint"
OUT_COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def hilbert_index(coords: np.ndarray, bits: int) -> np.ndarray:
    """Place of every point (row of non-negative integers below 2**bits) along a Hilbert curve.

    Skilling's transform of the axes to the curve's transposed index, then the bits interleaved.
    """
    x = coords.astype(np.uint64).copy()
    m = len(x)
    dims = x.shape[1] if x.ndim == 2 else 0
    if m == 0 or dims == 0:
        return np.zeros(m, np.uint64)
    q = 1 << (bits - 1)
    while q > 1:
        p = np.uint64(q - 1)
        for i in range(dims):
            high = (x[:, i] & np.uint64(q)) != 0
            x[high, 0] ^= p
            t = (x[~high, 0] ^ x[~high, i]) & p
            x[~high, 0] ^= t
            x[~high, i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(m, np.uint64)
    q = 1 << (bits - 1)
    while q > 1:
        t[(x[:, dims - 1] & np.uint64(q)) != 0] ^= np.uint64(q - 1)
        q >>= 1
    x ^= t[:, None]
    h = np.zeros(m, np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            h = (h << np.uint64(1)) | ((x[:, i] >> np.uint64(b)) & np.uint64(1))
    return h


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, q) of the rows that take part; q holds floor(256 * x) of every component."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return embeddings.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite).select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        label.cast("bigint").alias("label"),
        F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double"))).alias("q"),
    )


def _padded(rows: DataFrame, dims: int) -> DataFrame:
    pad = F.array_repeat(F.lit(0).cast("bigint"), F.greatest(F.lit(dims) - F.size("q"), F.lit(0)))
    return rows.withColumn("q", F.concat("q", pad))


def _dimension_stats(rows: DataFrame) -> pd.DataFrame:
    """Variance, minimum and maximum of every dimension over all rows (one row per dimension)."""
    exploded = rows.select(F.posexplode("q").alias("pos", "v"))
    stats = exploded.groupBy("pos").agg(F.var_pop("v").alias("var"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    return stats.toPandas()


def _blocks(rows: DataFrame, stats: pd.DataFrame, count: int, block: int) -> DataFrame:
    """Rows with a block number: Hilbert order within each label, ``block`` rows at most a block."""
    widest = stats.sort_values(["var", "pos"], ascending=[False, True]).head(CURVE_DIMS)
    axes = [int(p) for p in widest["pos"]]
    lows = np.array([float(v) for v in widest["lo"]], np.float64)
    spans = np.array([float(h) - float(v) + 1 for v, h in zip(widest["lo"], widest["hi"], strict=True)], np.float64)
    cells = 1 << CURVE_BITS

    def curve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if axes and len(frame):
                picked = np.array([[vec[a] for a in axes] for vec in frame["q"]], np.float64)
                grid = np.clip(((picked - lows) / spans * cells).astype(np.int64), 0, cells - 1)
                frame["hkey"] = hilbert_index(grid, CURVE_BITS).astype(np.int64)
            else:
                frame["hkey"] = np.zeros(len(frame), np.int64)
            yield frame

    keyed = rows.mapInPandas(curve, "vec_id bigint, label bigint, q array<bigint>, hkey bigint")
    parts = max(1, math.ceil(count / RANGE_ROWS))
    ordered = keyed.repartitionByRange(parts, "label", "hkey", "vec_id").sortWithinPartitions(
        "label", "hkey", "vec_id"
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, filled, last = -1, block, None
        for frame in batches:
            if not len(frame):
                continue
            part = int(frame["part"].iloc[0])
            blocks = np.empty(len(frame), np.int64)
            for i, label in enumerate(frame["label"].to_numpy()):
                if filled >= block or label != last:
                    current, filled, last = current + 1, 0, label
                blocks[i] = (part << 32) | current
                filled += 1
            frame["block"] = blocks
            yield frame.drop(columns=["part", "hkey"])

    return ordered.withColumn("part", F.spark_partition_id().cast("bigint")).mapInPandas(
        cut, "vec_id bigint, label bigint, q array<bigint>, block bigint"
    )


def _zone_maps(blocked: DataFrame) -> DataFrame:
    """(block, label, n, lo, hi): lo and hi hold every dimension's smallest and largest value."""
    cells = blocked.select("block", "label", F.posexplode("q").alias("pos", "v"))
    per_dim = cells.groupBy("block", "label", "pos").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    maps = per_dim.groupBy("block", "label").agg(F.sort_array(F.collect_list(F.struct("pos", "lo", "hi"))).alias("z"))
    counts = blocked.groupBy("block").agg(F.count("*").alias("n"))
    return maps.join(counts, "block").select(
        "block", "label", "n", F.col("z.lo").alias("lo"), F.col("z.hi").alias("hi")
    )


def _bound(a: Column, lo: Column, hi: Column, pick) -> Column:
    both = F.zip_with(lo, hi, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    terms = F.zip_with(a, both, lambda v, r: pick(v * r["x"], v * r["y"]))
    return F.aggregate(terms, F.lit(0).cast("bigint"), lambda s, t: s + F.coalesce(t, F.lit(0).cast("bigint")))


def _cumulative_bar(candidates: DataFrame, key: list[str], eligible: Column, need: int) -> DataFrame:
    """Adds ``bar``: the highest lower bound that ``need`` rows of eligible blocks surely reach."""
    order = Window.partitionBy(*key).orderBy(F.col("lb").desc(), F.col("block")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ranked = candidates.filter(eligible).withColumn("cum", F.sum("n").over(order))
    bars = ranked.filter(F.col("cum") >= need).groupBy(*key).agg(F.max("lb").alias("bar"))
    return candidates.join(bars, key, "left")


def _score_blocks(needs: DataFrame, anchors: DataFrame, blocked: DataFrame, chunks: int, band: bool) -> DataFrame:
    """Best ``TOP`` rows of every needed block for every query row, scored with numpy.

    ``needs``: (anchor_key, anchor_id, slot, aq, block[, ps]). For positives rows of the anchor's
    own id are skipped; with ``band`` only rows in [0.8 * ps, ps] count.
    """
    chunk = F.pmod(F.xxhash64("anchor_key", "slot"), F.lit(chunks))
    needs = needs.join(anchors.select("anchor_key", "aq"), "anchor_key").withColumn("chunk", chunk)
    wanted = needs.select(F.col("block").alias("wanted"), F.col("chunk").alias("part")).distinct()
    rows = blocked.join(wanted, F.col("block") == F.col("wanted")).select(
        "block", F.col("part").alias("chunk"), "vec_id", "q"
    )

    def best(queries: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(found):
            return _EMPTY
        vectors = np.stack(found["q"].to_numpy()).astype(np.int64)
        ids = found["vec_id"].to_numpy(np.int64)
        anchors = np.stack(queries["aq"].to_numpy()).astype(np.int64)
        scores = anchors @ vectors.T
        out = {"anchor_key": [], "anchor_id": [], "slot": [], "vec_id": [], "score": []}
        for i, query in enumerate(queries.itertuples(index=False)):
            s = scores[i]
            if band:
                ok = (80 * query.ps <= 100 * s) & (s <= query.ps)
            else:
                ok = ids != query.anchor_id
            picked = np.flatnonzero(ok)
            if not len(picked):
                continue
            picked = picked[np.lexsort((ids[picked], -s[picked]))][:TOP]
            out["anchor_key"] += [query.anchor_key] * len(picked)
            out["anchor_id"] += [query.anchor_id] * len(picked)
            out["slot"] += [query.slot] * len(picked)
            out["vec_id"] += ids[picked].tolist()
            out["score"] += s[picked].tolist()
        return pd.DataFrame(out)

    columns = ["anchor_key", "anchor_id", "slot", "aq", "block", "chunk"] + (["ps"] if band else [])
    return (
        needs.select(*columns)
        .groupBy("block", "chunk")
        .cogroup(rows.groupBy("block", "chunk"))
        .applyInPandas(best, CANDIDATE)
    )


_EMPTY = pd.DataFrame({c: pd.Series([], dtype=t) for c, t in
                       [("anchor_key", "int64"), ("anchor_id", "int64"), ("slot", "int32"), ("vec_id", "int64"), ("score", "int64")]})


def _top(candidates: DataFrame, key: list[str], score: str, vec: str) -> DataFrame:
    order = Window.partitionBy(*key).orderBy(F.col(score).desc(), F.col(vec))
    return candidates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)


def mine(embeddings: DataFrame, block: int = BLOCK) -> DataFrame:
    """Hard negatives of every anchor (vec_id divisible by 100); see the module's rules.

    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.
    """
    rows = staged(usable(embeddings), "negatives-rows")
    stats = _dimension_stats(rows)
    dims = int(stats["pos"].max()) + 1 if len(stats) else 0
    rows = _padded(rows, dims)
    count = rows.count()
    blocked = staged(_blocks(rows, stats, count, block), "negatives-blocks")
    maps = staged(_zone_maps(blocked), "negatives-zones")

    anchors = blocked.filter(F.col("vec_id") % 100 == 0).select(
        F.monotonically_increasing_id().alias("anchor_key"),
        F.col("vec_id").alias("anchor_id"),
        F.col("label").alias("alabel"),
        F.col("q").alias("aq"),
    )
    anchors = staged(anchors, "negatives-anchors")
    n_anchors = anchors.count()
    n_blocks = maps.count()
    side = F.broadcast(maps) if n_blocks * (2 * dims * 8 + 64) <= BROADCAST_BYTES else maps
    # the stated query set (every anchor) against the zone map of every block, never rows
    bounds = anchors.join(side).select(
        "anchor_key", "anchor_id", "alabel", "block", "label", "n",
        _bound(F.col("aq"), F.col("lo"), F.col("hi"), F.least).alias("lb"),
        _bound(F.col("aq"), F.col("lo"), F.col("hi"), F.greatest).alias("ub"),
    )
    bounds = staged(bounds, "negatives-bounds")

    # positives: same label, blocks whose upper bound reaches what six rows surely reach
    own = bounds.filter(F.col("label") == F.col("alabel"))
    own = _cumulative_bar(own, ["anchor_key"], F.lit(True), TOP + 1)
    own = own.filter(F.col("bar").isNull() | (F.col("ub") >= F.col("bar"))).withColumn("slot", F.lit(0))
    chunks = max(1, math.ceil(n_anchors / CHUNK))
    found = _score_blocks(own, anchors, blocked, chunks, band=False)
    positives = _top(found, ["anchor_key"], "score", "vec_id").select(
        "anchor_key", F.col("rank").cast("int").alias("slot"), F.col("vec_id").alias("positive_id"),
        F.col("score").alias("ps"),
    )
    positives = staged(positives, "negatives-positives")

    # negatives: other labels, blocks that meet the band and can still be among the best five
    other = bounds.filter(F.col("label") != F.col("alabel")).join(positives, "anchor_key")
    other = other.filter((100 * F.col("ub") >= 80 * F.col("ps")) & (F.col("lb") <= F.col("ps")))
    inside = (100 * F.col("lb") >= 80 * F.col("ps")) & (F.col("ub") <= F.col("ps"))
    other = _cumulative_bar(other, ["anchor_key", "slot"], inside, TOP)
    other = other.filter(F.col("bar").isNull() | (F.col("ub") >= F.col("bar")))
    chunks = max(1, math.ceil(n_anchors * TOP / CHUNK))
    found = _score_blocks(other, anchors, blocked, chunks, band=True)
    negatives = _top(found, ["anchor_key", "slot"], "score", "vec_id")
    out = negatives.join(positives, ["anchor_key", "slot"]).select(
        F.col("anchor_id").cast("bigint").alias("anchor_id"),
        F.col("positive_id").cast("bigint").alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        F.col("vec_id").cast("bigint").alias("negative_id"),
        F.col("ps").cast("bigint").alias("positive_score"),
        F.col("score").cast("bigint").alias("negative_score"),
    )
    return out
