"""Batch jobs: collection, repair and index refresh."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.lookups import last_dates
from ..operators.quality import (
    detect_jumps,
    ohlc_violation_counts,
    ohlc_violations,
    repair,
    repair_report,
)
from ..operators.upsert import (
    metadata_updates,
    update_metadata,
    upsert,
    upsert_partial,
)
from ..schemas import TABLES
from ..session import checkpointed, folder_exists, staging
from ..sources import readers
from ..sources.store import Store

# First date collected, benchmarks kept.
START_DATE = dt.date(2025, 1, 1)
BENCHMARKS = ("NIFTY 50", "NIFTY BANK")

# why a row of the equity feed is not loaded; the first that holds
LEFT_OUT = ("other_series", "undated", "out_of_range", "unlisted", "already_stored")

DETECTORS = {"jumps": detect_jumps, "violations": ohlc_violations}


@dataclass
class Landing:
    """Folders of the landed feeds, below ``root`` or whole paths; a missing one skips its step."""

    root: str
    eligible: str = "eligible"
    instruments: str = "instruments"
    equity: str = "equity"
    adjusted: str = "adjusted"
    index: str = "index"
    bans: str = "bans"
    metadata: str = "metadata"

    def find(self, spark: SparkSession, feed: str) -> str | None:
        folder = getattr(self, feed)
        path = folder if "/" in folder else f"{self.root.rstrip('/')}/{folder}"
        return path if folder_exists(spark, path) else None


@dataclass
class CollectReport:
    """Rows applied per step, and of the equity feed those read and left out."""

    rows: dict[str, int] = field(default_factory=dict)


def store_master(store: Store, rows: DataFrame) -> dict[str, int]:
    """Upsert names and lot sizes, keep sector, industry and segment."""
    return store.apply(
        "fno_stocks",
        rows,
        lambda old, new: upsert_partial(
            old, new, ["symbol"], ["company_name", "lot_size"], stamp="last_updated"
        ),
        {"with_lot_size": F.col("lot_size") > 0},
    )


def store_series(store: Store, name: str, rows: DataFrame) -> int:
    """Upsert stock or index bars."""
    keys = list(TABLES[name].keys)
    return store.apply(name, rows, lambda old, new: upsert(old, new, keys))["rows"]


def store_bans(store: Store, rows: DataFrame) -> int:
    """Add ban rows that are not stored yet."""
    return store.add("fno_ban_period", rows)


def store_metadata(store: Store, rows: DataFrame) -> int:
    """Fill missing industry and segment; returns the number of stocks that were filled."""
    filled = 0

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        nonlocal filled
        filled = metadata_updates(old, new).count()
        return update_metadata(old, new)

    store.apply("fno_stocks", rows, merge)
    return filled


def repaired(
    bars: DataFrame, adjusted: DataFrame, detector: str = "jumps"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Detect, update and verify without writing.

    Returns (bars, report per flagged symbol, bad rows left per symbol) (K18).
    """
    flagged = checkpointed(DETECTORS[detector](bars))
    marked = repair(bars, adjusted, flagged)
    fixed = marked.drop("_matched")
    return fixed, repair_report(marked, flagged), ohlc_violation_counts(fixed)


def repair_store(store: Store, adjusted: DataFrame, detector: str = "jumps") -> DataFrame:
    """Repair the stored bars of flagged symbols and return the report."""
    bars = store.table("daily_ohlcv")
    flagged = checkpointed(DETECTORS[detector](bars))
    with staging(store.spark, "repair") as stage:
        touched = bars.join(flagged, "symbol", "left_semi")
        marked = stage(repair(touched, adjusted, flagged), "marked")
        report = checkpointed(repair_report(marked, flagged))
        store_series(store, "daily_ohlcv", marked.filter("_matched").drop("_matched"))
    return report


def refresh_index(store: Store, rows: DataFrame, index_name: str) -> tuple[int, int]:
    """Upsert one benchmark; its row counts before and after."""

    def stored() -> int:
        table = store.table("index_ohlcv")
        return table.filter(F.col("index_name") == index_name).count()

    before = stored()
    store_series(store, "index_ohlcv", rows)
    return before, stored()


def bar_fates(
    flagged: DataFrame, listed: DataFrame, stored: DataFrame, start: dt.date, end: dt.date
) -> DataFrame:
    """Rows of ``readers.flagged_equity`` with ``_fate``: 'new' or one of ``LEFT_OUT``."""
    known = listed.select("symbol", F.lit(True).alias("_listed"))
    ends = last_dates(stored).withColumnRenamed("last_date", "_last")
    date = F.col("date")
    rules = (
        F.col(readers.OTHER_SERIES),
        date.isNull(),
        (date < F.lit(start)) | (date > F.lit(end)),
        F.col("_listed").isNull(),
        date <= F.col("_last"),
    )
    fate = F.when(rules[0], LEFT_OUT[0])
    for name, rule in zip(LEFT_OUT[1:], rules[1:]):
        fate = fate.when(rule, name)
    joined = flagged.join(known, "symbol", "left").join(ends, "symbol", "left")
    fated = joined.withColumn("_fate", fate.otherwise("new"))
    return fated.drop(readers.OTHER_SERIES, "_listed", "_last")


def _collect_equity(
    spark: SparkSession, path: str, store: Store, start: dt.date, end: dt.date, on_bad: str
) -> dict[str, int]:
    """Load the new bars of listed symbols; the counts of all rows read by what became of them."""
    raw = readers.read_equity(spark, path)
    listed = store.table("fno_stocks").select("symbol")
    fates = bar_fates(
        readers.flagged_equity(raw, on_bad), listed, store.table("daily_ohlcv"), start, end
    )
    seen = Observation()
    counted = fates.observe(
        seen,
        F.count(F.lit(1)).alias("read"),
        *(F.count_if(F.col("_fate") == name).alias(name) for name in LEFT_OUT),
    )
    with staging(spark, "new-bars") as stage:
        rows = stage(counted.filter(F.col("_fate") == "new").drop("_fate"), "rows")
        counts = {f"equity_{name}": seen.get[name] for name in ("read", *LEFT_OUT)}
        loaded = rows.select("symbol").distinct().count()
        counts["symbols_loaded"] = loaded
        counts["symbols_without_rows"] = listed.count() - loaded
        counts["daily_ohlcv"] = store_series(store, "daily_ohlcv", rows)
    if counts["equity_undated"]:
        store.set_aside("equity", readers.quarantine(raw).drop(readers.ORDINAL))
    return counts


def collect_one(
    spark: SparkSession,
    landing: Landing,
    store: Store,
    symbol: str,
    start: dt.date | None = None,
    today: dt.date | None = None,
) -> int:
    """Load the landed bars of one symbol over a period, one year by default."""
    path = landing.find(spark, "equity")
    if path is None:
        return 0
    end = today or dt.date.today()
    rows = readers.clean_equity(readers.read_equity(spark, path))
    rows = readers.between(rows, start or readers.period_start("1Y", end), end)
    return store_series(store, "daily_ohlcv", rows.filter(F.col("symbol") == symbol))


def collect_all(
    spark: SparkSession,
    landing: Landing,
    store: Store,
    start: dt.date = START_DATE,
    today: dt.date | None = None,
    on_bad: str = "zero",
) -> CollectReport:
    """Load every landed feed, repair jumps, refresh benchmarks, bans and metadata.

    Each step handles all symbols in one Spark job.
    """
    end = today or dt.date.today()
    report = CollectReport()

    eligible = landing.find(spark, "eligible")
    if eligible:
        stocks = readers.read_eligible(spark, eligible)
        instruments = landing.find(spark, "instruments")
        if instruments:
            lots = readers.lot_sizes(readers.read_instruments(spark, instruments))
        else:
            lots = spark.createDataFrame([], "symbol string, lot_size int")
        stored = store_master(store, readers.master_rows(stocks, lots))
        report.rows["fno_stocks"] = stored["rows"]
        report.rows["with_lot_size"] = stored["with_lot_size"]

    equity = landing.find(spark, "equity")
    if equity:
        report.rows.update(_collect_equity(spark, equity, store, start, end, on_bad))

    adjusted = landing.find(spark, "adjusted")
    if adjusted:
        feed = readers.read_adjusted(spark, adjusted)
        outcome = repair_store(store, readers.adjusted_bars(feed, start))
        report.rows["repaired"] = outcome.filter("fixed").count()
        report.rows["repair_failed"] = outcome.filter("NOT fixed").count()
        for name in BENCHMARKS:
            raw = readers.adjusted_index(feed, name, start)
            report.rows[name] = store_series(store, "index_ohlcv", readers.clean_index(raw))

    index = landing.find(spark, "index")
    if index:
        raw = readers.read_index(spark, index)
        rows = readers.between(readers.clean_index(raw), start, end)
        report.rows["index_ohlcv"] = store_series(store, "index_ohlcv", rows)

    bans = landing.find(spark, "bans")
    if bans:
        report.rows["fno_ban_period"] = store_bans(store, readers.read_bans(spark, bans))

    metadata = landing.find(spark, "metadata")
    if metadata:
        report.rows["metadata"] = store_metadata(store, readers.read_metadata(spark, metadata))
    return report
