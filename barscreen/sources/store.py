"""The four keyed tables as Parquet folders."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.upsert import new_rows
from ..schemas import TABLES, Table
from ..session import delete_folder, folder_exists, staging, subfolders

MONTH = "month"
KEEP_SNAPSHOTS = 3  # finished snapshots of a keyed table kept for readers that pinned one
LEASE_SECONDS = 2 * 3600  # a claim whose snapshot never finished may be taken over after this

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class ConcurrentWrite(RuntimeError):
    """Another writer has claimed the snapshot that this write would make."""


class Store:
    """Reads tables and applies keyed writes; one writer per table at a time.

    Time series are partitioned by month, and a write replaces only the months it touches.
    Keyed tables without a date (A12, A15) are numbered snapshots: a write makes the next one
    and Spark's ``_SUCCESS`` marker publishes it, so a reader sees the old rows or the new ones,
    never a half-written or deleted folder, and a DataFrame keeps the snapshot it was made
    from. A writer first claims the next number with a file that only one can create: a second
    writer that started from the same snapshot raises ``ConcurrentWrite`` (K19).
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def counts_path(self, name: str) -> str:
        """Rows per (month, key) of a time series; small, rewritten for the months a write touches."""
        return f"{self.root}/_month_counts/{name}"

    def pending_path(self, name: str) -> str:
        """Merged rows on their way into the table; Spark skips folders with an underscore."""
        return f"{self.root}/_pending/{name}"

    def snapshots_path(self, name: str) -> str:
        return f"{self.root}/_snapshots/{name}"

    def snapshot(self, name: str) -> int | None:
        """Number of the newest finished snapshot of a keyed table; None before the first."""
        root = self.snapshots_path(name)
        done = [int(f) for f in subfolders(self.spark, root) if f.isdigit()]
        done = [n for n in done if folder_exists(self.spark, f"{root}/{n}/_SUCCESS")]
        return max(done) if done else None

    def _stored(self, table: Table, version: int | None = None) -> DataFrame:
        schema = table.schema
        if table.date_column:
            schema = T.StructType([*schema.fields, T.StructField(MONTH, T.IntegerType())])
        else:
            version = self.snapshot(table.name) if version is None else version
            if version is not None:
                return self.spark.read.schema(schema).parquet(f"{self.snapshots_path(table.name)}/{version}")
        if not folder_exists(self.spark, self.path(table.name)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(table.name))

    def table(
        self, name: str, start: dt.date | None = None, end: dt.date | None = None
    ) -> DataFrame:
        """A stored table; empty with the declared schema before its first write.

        Of a time series with ``start`` or ``end`` (inclusive), only their months are read.
        """
        table = TABLES[name]
        rows = self._stored(table)
        month, date = F.col(MONTH), F.col(table.date_column or table.keys[0])
        if start is not None:
            rows = rows.filter((month >= _month_of(start)) & (date >= F.lit(start)))
        if end is not None:
            rows = rows.filter((month <= _month_of(end)) & (date <= F.lit(end)))
        return rows.select(*table.schema.names)

    def recent(self, name: str, rows: int, among: DataFrame | None = None) -> DataFrame:
        """The newest months of a time series that hold the newest ``rows`` rows of every key (A10).

        The walk runs over the month counts, from the newest month backwards: each key stops at
        the first month at which its running count reaches ``rows``, or at its oldest month.
        Only months from the earliest stop on are read, so the scan's partition filter leaves
        older months out. ``among`` (one column, the key) limits the keys that must reach it.
        """
        table = TABLES[name]
        key, month = _entity(table), F.col(MONTH)
        counts = self.month_counts(name)
        if among is not None:
            counts = counts.join(among.select(key).distinct(), key, "left_semi")
        newest_first = Window.partitionBy(key).orderBy(month.desc()).rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        walked = counts.withColumn("running", F.sum("n").over(newest_first))
        stops = walked.groupBy(key).agg(
            F.coalesce(F.max(F.when(F.col("running") >= rows, month)), F.min(month)).alias("stop")
        )
        cutoff = stops.agg(F.min("stop")).first()[0]
        if cutoff is None:
            return self.table(name).limit(0) if among is not None else self.table(name)
        stored = self._stored(table).filter(month >= F.lit(cutoff))
        return stored.select(*table.schema.names)

    def month_counts(self, name: str) -> DataFrame:
        """(month, key, n) of a time series, built from the table once if a store has none yet."""
        table = TABLES[name]
        schema = f"{MONTH} int, {_entity(table)} string, n bigint"
        if not folder_exists(self.spark, f"{self.counts_path(name)}/_SUCCESS"):
            self._count_months(table, None)
        if not folder_exists(self.spark, self.counts_path(name)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.counts_path(name))

    def _count_months(self, table: Table, months: list[int] | None) -> None:
        """Count the rows of the given months (all if None) into the month counts."""
        stored = self._stored(table)
        if months is not None:
            stored = stored.filter(F.col(MONTH).isin(months))
        counts = stored.groupBy(MONTH, _entity(table)).agg(F.count(F.lit(1)).alias("n"))
        writer = counts.repartition(MONTH).write.partitionBy(MONTH)
        path = self.counts_path(table.name)
        if months is None:
            writer.mode("overwrite").parquet(path)
        else:
            writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)

    def last_date(self, name: str) -> dt.date | None:
        """Latest date of a time series, from its newest month."""
        table = TABLES[name]
        folders = (f.removeprefix(f"{MONTH}=") for f in subfolders(self.spark, self.path(name)))
        months = [int(f) for f in folders if f.isdigit()]
        if not months:
            return None
        newest = self._stored(table).filter(F.col(MONTH) == max(months))
        return newest.agg(F.max(table.date_column)).first()[0]

    def set_aside(self, feed: str, rows: DataFrame) -> str:
        """Keep the raw rows that a load had to leave out, beside those of earlier loads.

        Every load appends its own ``load=`` partition (UTC time, then a random part, so names
        sort by time); nothing set aside before is rewritten. Returns the load's name.
        """
        load = f"{dt.datetime.now(dt.UTC):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"
        kept = rows.select(F.to_json(F.struct("*")).alias("row"), F.lit(load).alias("load"))
        kept.write.mode("append").partitionBy("load").parquet(self.aside_path(feed))
        return load

    def aside_path(self, feed: str) -> str:
        return f"{self.root}/_quarantine/{feed}"

    def apply(
        self, name: str, batch: DataFrame, merge: Merge, counters: dict[str, Column] | None = None
    ) -> dict[str, int]:
        """Replace the touched part of a table by ``merge(stored, batch)``.

        Returns the number of batch rows and of those that meet each counter's condition. The
        merged rows are written aside first, so that no folder is overwritten while it is read
        and a write that broke off is finished by the next one (or by ``recover``).
        """
        self.recover(name)
        rules = {"rows": F.lit(True), **(counters or {})}
        seen = Observation()
        counted = batch.observe(seen, *(F.count_if(rule).alias(c) for c, rule in rules.items()))
        if not TABLES[name].date_column:
            return self._apply_snapshot(name, counted, merge, rules, seen)
        with staging(self.spark, name) as stage:
            landed = stage(counted, "batch")
            counts = {c: seen.get[c] for c in rules}
            if counts["rows"]:
                merged = merge(self._touched(TABLES[name], landed), landed)
                merged.write.mode("overwrite").parquet(self.pending_path(name))
                self.recover(name)
        return counts

    def _apply_snapshot(self, name: str, counted: DataFrame, merge: Merge, rules: dict, seen) -> dict[str, int]:
        """Merge into the next snapshot of a keyed table, claimed before anything is read."""
        base = self.snapshot(name)
        target = 0 if base is None else base + 1
        claim = self._claim(name, target)
        try:
            with staging(self.spark, name) as stage:
                landed = stage(counted, "batch")
                counts = {c: seen.get[c] for c in rules}
                if counts["rows"]:
                    merged = merge(self._stored(TABLES[name], base), landed)
                    merged.write.mode("overwrite").parquet(f"{self.snapshots_path(name)}/{target}")
                    self._forget(name, target)
                    return counts
        except BaseException:
            delete_folder(self.spark, claim)
            raise
        delete_folder(self.spark, claim)
        return counts

    def _claim(self, name: str, version: int) -> str:
        """Create the claim of a snapshot number; raise if a live writer holds it already."""
        claim = f"{self.snapshots_path(name)}/{version}.claim"
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(claim)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for _ in range(2):
            try:
                fs.create(path, False).close()  # only one writer can create it
                return claim
            except Exception as taken:  # noqa: BLE001 - the JVM's FileAlreadyExistsException
                if not fs.exists(path):
                    raise
                age = (jvm.System.currentTimeMillis() - fs.getFileStatus(path).getModificationTime()) / 1000
                finished = fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.snapshots_path(name)}/{version}/_SUCCESS"))
                if finished or age < LEASE_SECONDS:
                    raise ConcurrentWrite(f"{name}: snapshot {version} is claimed by another writer") from taken
                # a writer that died long ago: its half-written snapshot goes, the claim is taken over
                delete_folder(self.spark, f"{self.snapshots_path(name)}/{version}")
                fs.delete(path, False)
        raise ConcurrentWrite(f"{name}: snapshot {version} is claimed by another writer")

    def _forget(self, name: str, newest: int) -> None:
        """Delete snapshots and claims older than the last ``KEEP_SNAPSHOTS``."""
        for entry in subfolders(self.spark, self.snapshots_path(name)):
            number = entry.removesuffix(".claim")
            if number.isdigit() and int(number) <= newest - KEEP_SNAPSHOTS:
                delete_folder(self.spark, f"{self.snapshots_path(name)}/{entry}")

    def add(self, name: str, batch: DataFrame) -> int:
        """Append the batch rows whose key is not stored yet; no stored file is rewritten.

        Returns the number of batch rows. An append that broke off is simply repeated: what it
        had stored is not new any more.
        """
        self.recover(name)
        table, seen = TABLES[name], Observation()
        with staging(self.spark, name) as stage:
            landed = stage(batch.observe(seen, F.count(F.lit(1)).alias("rows")), "batch")
            count = seen.get["rows"]
            if count:
                fresh = new_rows(self._touched(table, landed), landed, table.keys)
                if table.date_column:
                    fresh = fresh.withColumn(MONTH, _month(table)).hint("rebalance", F.col(MONTH))
                parts = [MONTH] if table.date_column else []
                fresh.write.mode("append").partitionBy(*parts).parquet(self.path(name))
                if table.date_column:
                    # counts that miss an append only make a walk read further back
                    self._count_months(table, _months_in(landed.withColumn(MONTH, _month(table))))
        return count

    def _touched(self, table: Table, batch: DataFrame) -> DataFrame:
        """Stored rows of the months that occur in the batch."""
        stored = self._stored(table)
        if not table.date_column:
            return stored
        months = batch.select(_month(table).alias(MONTH)).distinct()
        # calendar months: twelve values per year of data
        found = [row[0] for row in months.collect()]
        return stored.filter(F.col(MONTH).isin(found)).drop(MONTH)

    def recover(self, name: str) -> None:
        """Move complete pending rows into the table."""
        table, pending = TABLES[name], self.pending_path(name)
        if not folder_exists(self.spark, f"{pending}/_SUCCESS"):
            return
        rows = self.spark.read.schema(table.schema).parquet(pending)
        if table.date_column:
            rows = rows.withColumn(MONTH, _month(table))
            (
                rows.hint("rebalance", F.col(MONTH))
                .sortWithinPartitions(MONTH, *table.keys)
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy(MONTH)
                .parquet(self.path(name))
            )
            # the counts of the rewritten months, before the pending rows go
            self._count_months(table, _months_in(rows))
        else:
            # pending rows of a keyed table come from stores of the earlier layout
            base = self.snapshot(name)
            target = 0 if base is None else base + 1
            self._claim(name, target)
            rows.write.mode("overwrite").parquet(f"{self.snapshots_path(name)}/{target}")
        delete_folder(self.spark, pending)


def _entity(table: Table) -> str:
    """The key column that is not the date: what a series belongs to."""
    return next(k for k in table.keys if k != table.date_column)


def _months_in(rows: DataFrame) -> list[int]:
    # calendar months: twelve values per year of data
    return [row[0] for row in rows.select(MONTH).distinct().collect()]


def _month_of(date: dt.date) -> int:
    return date.year * 100 + date.month


def _month(table: Table) -> Column:
    return F.year(table.date_column) * 100 + F.month(table.date_column)
