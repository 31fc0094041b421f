"""Keyed writes expressed as joins: what a table holds after a batch has been applied."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDINAL = "_ordinal"


def last_per_key(df: DataFrame, keys: Sequence[str], order: str | None = ORDINAL) -> DataFrame:
    """Keep the row written last for each key and drop the ordinal column.

    An aggregate rather than a ranking window: many copies of one key are combined on the
    map side and never meet in one task. Of rows without an ordinal the one with the largest
    values wins, compared column by column, so that a repeated run keeps the same row.
    """
    rest = [c for c in df.columns if c not in (*keys, order)]
    values = F.struct(*rest) if rest else F.lit(0)
    newest = F.max_by(values, F.struct(order)) if order in df.columns else F.max(values)
    picked = df.groupBy(*keys).agg(newest.alias("_row"))
    return picked.select(*keys, *(F.col("_row").getField(c).alias(c) for c in rest))


def upsert(
    existing: DataFrame, new: DataFrame, keys: Sequence[str], order: str | None = ORDINAL
) -> DataFrame:
    """Insert rows or overwrite all their non-key columns."""
    return upsert_partial(existing, new, keys, [c for c in existing.columns if c not in keys], order)


def upsert_partial(
    existing: DataFrame,
    new: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    order: str | None = ORDINAL,
    stamp: str | None = None,
) -> DataFrame:
    """Insert rows or overwrite only ``columns``; others keep their value.

    ``stamp`` names a timestamp column set to now on every row the batch touches.
    One full outer join: batch and table are each read and shuffled once.
    """
    batch = last_per_key(new, keys, order).select(
        *keys, *(F.col(c).alias(f"_new_{c}") for c in columns), F.lit(True).alias("_touched")
    )
    touched = F.col("_touched").isNotNull()

    def value(c: str) -> Column:
        if c in columns:
            return F.when(touched, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
        if c == stamp:
            return F.when(touched, F.current_timestamp()).otherwise(F.col(c)).alias(c)
        return F.col(c)

    joined = existing.join(batch, list(keys), "full_outer")
    return joined.select(*(value(c) for c in existing.columns))


def new_rows(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each key of ``new`` that is not in ``existing``, in its columns."""
    batch = new.dropDuplicates(list(keys))
    if "created_at" in existing.columns and "created_at" not in batch.columns:
        batch = batch.withColumn("created_at", F.current_timestamp())
    fresh = batch.join(existing.select(*keys), list(keys), "left_anti")
    return fresh.select(*existing.columns)


def insert_ignore(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert rows whose key is not there yet; stored rows stay as they are."""
    return existing.unionByName(new_rows(existing, new, keys))


def keyed_update(
    existing: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    order: str | None = ORDINAL,
) -> DataFrame:
    """Overwrite ``columns`` of stored rows from matching source rows.

    Source rows with a value that is missing or doesn't fit the stored column are skipped; keys
    not stored are not inserted.
    The result has an extra boolean ``_matched``.
    """
    types = {f.name: f.dataType for f in existing.schema}
    fitting = source.withColumns({c: F.col(c).try_cast(types[c]) for c in columns})
    usable = last_per_key(fitting.dropna(subset=list(columns)), keys, order).select(
        *keys, *(F.col(c).alias(f"_new_{c}") for c in columns), F.lit(True).alias("_hit")
    )
    matched = F.col("_hit").isNotNull()

    def value(c: str) -> Column:
        if c not in columns:
            return F.col(c)
        return F.when(matched, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)

    joined = existing.join(usable, list(keys), "left")
    return joined.select(*(value(c) for c in existing.columns), matched.alias("_matched"))


def metadata_gaps(master: DataFrame) -> DataFrame:
    """Symbols without industry or segment."""

    def missing(c: str) -> Column:
        return F.col(c).isNull() | (F.col(c) == "")

    return master.filter(missing("industry") | missing("segment")).select("symbol")


def metadata_updates(master: DataFrame, metadata: DataFrame) -> DataFrame:
    """The feed's last row for each symbol with a gap, where it knows industry or segment."""
    return (
        last_per_key(metadata, ["symbol"])
        .withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("industry", "segment")})
        .filter((F.col("industry") != "") | (F.col("segment") != ""))
        .join(metadata_gaps(master), "symbol", "left_semi")
    )


def update_metadata(master: DataFrame, metadata: DataFrame) -> DataFrame:
    """Fill gaps where the feed knows industry or segment; then both are written."""
    usable = metadata_updates(master, metadata)
    updated = keyed_update(master, usable, ["symbol"], ["industry", "segment"])
    return updated.drop("_matched")
