"""Removal of repeated passages by overlapping windows of consecutive lines.

Built-in functions only. Every window of three lines is hashed, the first occurrence of each
window in the whole corpus is found by an aggregate, and every line that a later occurrence
covers is removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh


def _lines(text: str) -> Column:
    return F.split(text, "\n", -1)


def _windows(keyed: DataFrame, width: int) -> DataFrame:
    """(id, hash, pos, w1, w2): a row for each window; two 64-bit hashes name its lines."""
    shifted = [F.slice("lines", i + 1, F.greatest(F.size("lines"), F.lit(1))).alias(f"l{i}") for i in range(width)]
    rows = (
        keyed.filter("lines IS NOT NULL")
        .select("id", "hash", F.posexplode(F.arrays_zip(*shifted)).alias("pos", "w"))
        # the zip pads with nulls: a window is full, or it is a whole short text
        .filter(F.col(f"w.l{width - 1}").isNotNull() | (F.col("pos") == 0))
    )
    lines = [F.col(f"w.l{i}") for i in range(width)]
    blank = F.trim(F.concat_ws("", *lines)) == ""
    return rows.filter(~blank).select(
        "id", "hash", "pos", F.xxhash64(*lines).alias("w1"), F.xxhash64(F.lit("w"), *lines).alias("w2")
    )


def _covered(windows: DataFrame) -> DataFrame:
    """(id, hash, starts): where windows begin that occur earlier in the corpus."""
    first = (
        windows.groupBy("w1", "w2")
        .agg(F.min(F.struct("id", "hash", "pos")).alias("first"), F.count("*").alias("copies"))
        .filter("copies > 1")
        .select("w1", "w2", "first")
    )
    later = windows.join(first, ["w1", "w2"]).filter(F.struct("id", "hash", "pos") != F.col("first"))
    return later.groupBy("id", "hash").agg(F.collect_set("pos").alias("starts"))


def without_repeated_lines(docs: DataFrame, width: int = 3) -> DataFrame:
    """``docs`` with a struct column ``dedup`` (n_lines, n_removed, text) added at the end.

    Lines are what ``\\n`` separates. A window is ``width`` consecutive lines, or all lines of a
    shorter text; windows of blank lines only don't count. Occurrences are ordered by doc_id
    (null first), hash of the text and position: a line goes if it is covered by a window that
    is not the first of its kind, so an equal line always stays somewhere before it. Rows that
    repeat both doc_id and text are one document and are treated alike. A null text stays null
    and has no lines.
    """
    result = fresh(docs, "dedup")
    key = (F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    # texts are shuffled once; their lines are split again after the join
    carried, keyed = docs.select(F.struct("*").alias("row"), *key), docs.select(*key, _lines("text").alias("lines"))
    covered = _covered(_windows(keyed, width)).select(
        F.col("id").alias("covered_id"), F.col("hash").alias("covered_hash"), "starts"
    )
    same = carried["id"].eqNullSafe(covered["covered_id"]) & (carried["hash"] == covered["covered_hash"])
    gone = F.flatten(F.transform("starts", lambda p: F.sequence(p, p + (width - 1))))

    def shortened(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.struct(
            F.size(lines).cast("bigint").alias("n_lines"),
            (F.size(lines) - F.size(kept)).cast("bigint").alias("n_removed"),
            F.array_join(F.transform(kept, lambda i: F.element_at(lines, i + 1)), "\n").alias("text"),
        )

    untouched = F.struct(
        F.coalesce(F.size(_lines("row.text")), F.lit(0)).cast("bigint").alias("n_lines"),
        F.lit(0).cast("bigint").alias("n_removed"),
        F.col("row.text").alias("text"),
    )
    # as the variable of a lambda, the lines are split once and not for every index
    changed = F.transform(F.array(_lines("row.text")), shortened)[0]
    return carried.join(covered, same, "left").select(
        "row.*", F.when(F.col("starts").isNull(), untouched).otherwise(changed).alias(result)
    )


def dedup_lines(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, n_lines, n_removed, text) for every row of ``docs`` (doc_id, text)."""
    out = without_repeated_lines(docs.select("doc_id", "text"), width)
    return out.select("doc_id", "dedup.n_lines", "dedup.n_removed", "dedup.text")


def cleaned(docs: DataFrame, width: int = 3) -> DataFrame:
    """``docs`` with the shorter texts, without the rows that lost every line.

    A column ``n_chars`` is set to the length of the new text.
    """
    name = fresh(docs, "dedup")
    out = without_repeated_lines(docs, width)
    found = F.col(name)
    lost = (found["n_removed"] > 0) & (found["n_removed"] == found["n_lines"])
    new = {"text": found["text"], "n_chars": F.length(found["text"]).cast("bigint")}
    columns = [
        F.when(found["n_removed"] > 0, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c)
        for c in docs.columns
    ]
    return out.filter(~lost).select(*columns)
