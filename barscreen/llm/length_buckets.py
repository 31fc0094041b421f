"""Length buckets with the least padding, and batches of a token budget inside each.

Lengths are counted on Spark; their histogram has at most ``longest`` entries, because longer
texts are cut into pieces of that length. Dynamic programming over the histogram finds the
boundaries. Batches are numbered without gathering a bucket: shards are numbered on their own
and shifted by the sizes of the shards before them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

LONGEST = 2048
BUCKETS = 16
BUDGET = 32_768
SHARD = 50_000


def count_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    found = F.size(F.array_remove(F.split(text, r"[\x09-\x0D\x20]+", -1), ""))
    return F.coalesce(found, F.lit(0)).cast("bigint")


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` buckets with the least total padding.

    ``lengths`` ascend and are distinct. Equal padding goes to fewer, then to smaller first
    buckets. Exact: integers only.
    """
    m = len(lengths)
    if not m:
        return []
    lengths = lengths.astype(np.int64)
    before = np.concatenate([[0], np.cumsum(counts.astype(np.int64))])
    never = np.iinfo(np.int64).max // 4
    # best[j]: padded tokens of the j shortest lengths
    best = np.full(m + 1, never)
    best[0] = 0
    cuts = []
    results = []
    for _ in range(min(buckets, m)):
        new, cut = np.full(m + 1, never), np.zeros(m + 1, np.int64)
        for j in range(1, m + 1):
            total = best[:j] + lengths[j - 1] * (before[j] - before[:j])
            cut[j] = total.argmin()
            new[j] = total[cut[j]]
        best = new
        cuts.append(cut)
        results.append(int(best[m]))
    used = results.index(min(results))
    ends, j = [], m
    for k in range(used, -1, -1):
        ends.append(int(lengths[j - 1]))
        j = int(cuts[k][j])
    return ends[::-1]


def pack(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """A row for each piece of each row of ``docs``: where it lies and which batch it is in.

    doc_id, piece (from 0), first_word, n_tokens, bucket (its padded length), batch (from 0
    inside the bucket), slot (from 0 inside the batch). A batch of bucket b holds
    ``budget // b`` pieces, one at least; only the last one of a bucket may hold fewer. A text
    without words is one piece of 0 tokens without bucket, batch and slot. Rows that repeat a
    doc_id are packed one by one.
    """
    if longest < 1 or buckets < 1:
        raise ValueError("longest and buckets must be 1 or more")
    n = F.col("n")
    lengths = staged(docs.select("doc_id", count_words(F.col("text")).alias("n")), "lengths")
    last = F.greatest(F.ceil(n / longest), F.lit(1)) - 1
    pieces = lengths.select("doc_id", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece")).select(
        "doc_id",
        "piece",
        (F.col("piece") * longest).alias("first_word"),
        F.least(n - F.col("piece") * longest, F.lit(longest)).alias("n_tokens"),
    )
    histogram = pieces.filter("n_tokens > 0").groupBy("n_tokens").count().collect()  # <= longest rows
    histogram.sort()
    sizes, counts = (np.array([r[i] for r in histogram], np.int64) for i in (0, 1))
    ends = best_boundaries(sizes, counts, buckets)
    shards = max(1, -(-int(counts.sum()) // SHARD))
    bucket = F.coalesce(*[F.when(F.col("n_tokens") <= end, F.lit(end)) for end in ends], F.lit(None).cast("int"))
    sized = pieces.withColumns(
        {
            "bucket": F.when(F.col("n_tokens") > 0, bucket).cast("bigint"),
            "shard": F.pmod(F.xxhash64("doc_id", "piece", "n_tokens"), F.lit(shards)),
        }
    )
    full = sized.filter("bucket IS NOT NULL")
    ahead = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        full.groupBy("bucket", "shard")
        .agg(F.count("*").alias("size"))
        .select("bucket", "shard", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("shift"))
    )
    within = Window.partitionBy("bucket", "shard").orderBy("doc_id", "piece", "n_tokens")
    per_batch = F.greatest(F.floor(F.lit(budget) / F.col("bucket")), F.lit(1))
    numbered = (
        full.withColumn("number", F.row_number().over(within) - 1)
        .join(shifts, ["bucket", "shard"])
        .withColumn("number", F.col("number") + F.col("shift"))
        .withColumns({"batch": F.floor(F.col("number") / per_batch), "slot": F.col("number") % per_batch})
    )
    columns = ["doc_id", "piece", "first_word", "n_tokens", "bucket", "batch", "slot"]
    empty = sized.filter("bucket IS NULL").withColumns(
        {"batch": F.lit(None).cast("bigint"), "slot": F.lit(None).cast("bigint")}
    )
    return numbered.select(*columns).unionAll(empty.select(*columns))
