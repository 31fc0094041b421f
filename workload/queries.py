"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barscreen.functions import labels
from barscreen.operators import bans as ban_ops
from barscreen.operators import lookups, quality, rolling
from barscreen.operators.upsert import (
    ORDINAL,
    insert_ignore,
    metadata_gaps,
    update_metadata,
    upsert,
    upsert_partial,
)
from barscreen.plans import jobs, metrics, reports, screens, stored
from barscreen.schemas import BANS, BARS, INDEX_BARS
from barscreen.session import new_folder
from barscreen.sources import output, readers
from barscreen.sources.store import Store
from barscreen.streaming import stream_collect

from . import tables as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

FLOOR = dt.date(1998, 1, 1)
CUTOVER = dt.date(2000, 1, 1)
OVERLAP = dt.date(1999, 1, 1)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def plain(df: DataFrame) -> DataFrame:
    """Types both engines spell alike: bigint, double and text."""
    columns = []
    for f in df.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(f.dataType, T.IntegralType):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DateType, T.BooleanType)):
            c = c.cast("string")
        columns.append(c.alias(f.name))
    return df.select(*columns)


def _date(value: dt.date) -> Column:
    return F.lit(value).cast("date")


# -- screens: every date, and the latest date that has a hit ---------------------------------


def _screen_queries(screen_id: str) -> None:
    name = f"screen_{screen_id.replace('-', '_')}"

    def every_date(spark: SparkSession, sf: str) -> DataFrame:
        return plain(
            screens.screen(
                t.bars(spark, sf), screen_id, index=t.index(spark, sf), as_of=None,
                benchmark=t.BENCHMARK,
            )
        )

    def one_date(spark: SparkSession, sf: str) -> DataFrame:
        bars, index = t.bars(spark, sf), t.index(spark, sf)
        options = {"index": index, "benchmark": t.BENCHMARK}
        hits = screens.screen(bars, screen_id, as_of=None, **options)
        day = rolling.max_date(hits)
        return plain(screens.screen(bars, screen_id, as_of=day, ordered=True, **options))

    QUERIES[name] = every_date
    QUERIES[f"{name}_as_of"] = one_date


for _id in screens.SCREEN_IDS:
    _screen_queries(_id)


@query
def screen_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The everyday use: one screen on the table's last date."""
    return plain(
        screens.screen(
            t.bars(spark, sf), "relative-weakness", index=t.index(spark, sf),
            benchmark=t.BENCHMARK, ordered=True,
        )
    )


@query
def screen_ban_marked(spark: SparkSession, sf: str) -> DataFrame:
    return plain(
        screens.run_screen(t.bars(spark, sf), t.bans(spark, sf), "upward-breakout", as_of=None)
    )


@query
def screen_ban_excluded(spark: SparkSession, sf: str) -> DataFrame:
    return plain(
        screens.run_screen(
            t.bars(spark, sf), t.bans(spark, sf), "upward-breakout", as_of=None, exclude=True
        )
    )


@query
def screen_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = screens.screen_counts(
        t.bars(spark, sf), t.index(spark, sf), as_of=None, benchmark=t.BENCHMARK
    )
    return plain(counts.select("id", "title", "hits"))


@query
def screen_result_sort(spark: SparkSession, sf: str) -> DataFrame:
    """A whole result re-sorted by a column that has NULLs."""
    hits = screens.screen(t.bars(spark, sf), "upward-breakout-delivery", as_of=None)
    return plain(screens.sort_results(hits, "volume_mult"))


@query
def screen_api_records(spark: SparkSession, sf: str) -> DataFrame:
    hits = screens.run_screen(
        t.bars(spark, sf), t.bans(spark, sf), "relative-weakness", index=t.index(spark, sf),
        as_of=None, benchmark=t.BENCHMARK,
    )
    return plain(output.to_api_records(hits))


# -- rolling columns -------------------------------------------------------------------------

ROLLING_COLUMNS = (
    "max_20_high", "min_20_low", "avg_50_vol", "max_10_vol", "avg_20_vol", "avg_50_del_vol",
    "max_10_del_vol", "avg_20_del_vol", "tr", "atr", "high_52w", "sma_20", "sma_50", "sma_200",
    "close_1m_ago", "close_1y_ago",
)


@query
def rolling_indicators(spark: SparkSession, sf: str) -> DataFrame:
    rolled = rolling.rolling_indicators(t.bars(spark, sf))
    return plain(rolled.select("symbol", "date", *ROLLING_COLUMNS))


@query
def rolling_indicators_split(spark: SparkSession, sf: str) -> DataFrame:
    """The same with every series cut into blocks."""
    rolled = rolling.rolling_indicators(t.bars(spark, sf), block_rows=512)
    return plain(rolled.select("symbol", "date", *ROLLING_COLUMNS))


@query
def benchmark_return(spark: SparkSession, sf: str) -> DataFrame:
    return plain(rolling.benchmark_returns(t.index(spark, sf), t.BENCHMARK))


# -- stock list ------------------------------------------------------------------------------


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.stock_metrics(t.bars(spark, sf), t.index(spark, sf), benchmark=t.BENCHMARK)


@query
def stock_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return plain(_metrics(spark, sf))


def _page(spark: SparkSession, sf: str, **paging) -> DataFrame:
    return plain(
        metrics.stock_page(_metrics(spark, sf), t.master(spark, sf), t.bans(spark, sf), **paging)
    )


@query
def stock_list_page(spark: SparkSession, sf: str) -> DataFrame:
    return _page(spark, sf, sort_by="pct_1y", order="desc", page=2, limit=7)


@query
def stock_search(spark: SparkSession, sf: str) -> DataFrame:
    return _page(spark, sf, search="and#2", sort_by="no_such_column", limit=50)


@query
def stock_list_unbanned(spark: SparkSession, sf: str) -> DataFrame:
    return _page(spark, sf, sort_by="volume", order="desc", limit=20, exclude=True)


@query
def stock_list_unbanned_strict(spark: SparkSession, sf: str) -> DataFrame:
    return _page(
        spark, sf, sort_by="volume", order="desc", limit=20, exclude=True, strict_compat=True
    )


@query
def stock_list(spark: SparkSession, sf: str) -> DataFrame:
    """The whole list row: metrics, ban mark and closes of the page's symbols."""
    page = metrics.stock_list(
        t.bars(spark, sf), t.index(spark, sf), t.master(spark, sf), t.bans(spark, sf),
        benchmark=t.BENCHMARK, sort_by="rs_rank", order="desc", limit=10,
    )
    return plain(page.withColumn("sparkline", _joined("sparkline")))


@query
def stock_page_totals(spark: SparkSession, sf: str) -> DataFrame:
    return plain(metrics.page_totals(t.master(spark, sf), search="brand#1", page=2, limit=4))


def _joined(c: str) -> Column:
    return F.array_join(F.col(c).cast("array<string>"), ",")


@query
def sparkline(spark: SparkSession, sf: str) -> DataFrame:
    return plain(
        metrics.sparkline(t.bars(spark, sf)).select("symbol", _joined("sparkline").alias("prices"))
    )


@query
def sparkline_trend(spark: SparkSession, sf: str) -> DataFrame:
    lines = metrics.sparkline(t.bars(spark, sf))
    return lines.select("symbol", labels.sparkline_trend("sparkline").alias("trend"))


@query
def sparkline_scaled(spark: SparkSession, sf: str) -> DataFrame:
    scaled = metrics.sparkline(t.bars(spark, sf)).withColumn(
        "scaled", labels.sparkline_scaled("sparkline")
    )
    points = scaled.select("symbol", F.posexplode("scaled").alias("position", "height"))
    return plain(points)


@query
def stock_history(spark: SparkSession, sf: str) -> DataFrame:
    return plain(metrics.stock_history(t.bars(spark, sf), t.master(spark, sf), "brand#13"))


@query
def stock_info(spark: SparkSession, sf: str) -> DataFrame:
    info = lookups.stock_info(t.master(spark, sf), "brand#13")
    return plain(info.drop("last_updated"))


# -- bans ------------------------------------------------------------------------------------


@query
def ban_status(spark: SparkSession, sf: str) -> DataFrame:
    return plain(ban_ops.ban_status(t.bans(spark, sf)))


def _last_ban(spark: SparkSession, sf: str) -> Column:
    return rolling.max_date(t.bans(spark, sf), "trade_date")


@query
def ban_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return plain(ban_ops.ban_frequency(t.bans(spark, sf), _last_ban(spark, sf)))


@query
def ban_frequency_summary(spark: SparkSession, sf: str) -> DataFrame:
    return plain(ban_ops.ban_frequency_summary(t.bans(spark, sf), _last_ban(spark, sf)))


@query
def ban_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return plain(ban_ops.ban_sweep(t.bans(spark, sf), _last_ban(spark, sf)))


@query
def insert_ignore_bans(spark: SparkSession, sf: str) -> DataFrame:
    """Stored bans end at the cut-over, the landed lists hold all of them."""
    landed = readers.read_bans(spark, t.ban_landing(spark, sf))
    stored = t.bans(spark, sf).filter(F.col("trade_date") < _date(CUTOVER))
    stored = stored.withColumn("created_at", F.lit("2001-01-01").cast("timestamp"))
    merged = insert_ignore(stored.select(*BANS.names), landed, ["trade_date", "symbol"])
    kept = F.col("created_at") == F.lit("2001-01-01").cast("timestamp")
    return plain(merged.select("trade_date", "symbol", kept.alias("kept")))


# -- statistics and quality ------------------------------------------------------------------


@query
def market_stats(spark: SparkSession, sf: str) -> DataFrame:
    return plain(lookups.market_stats(t.master(spark, sf), t.bars(spark, sf)))


@query
def store_stats(spark: SparkSession, sf: str) -> DataFrame:
    return plain(lookups.store_stats(t.master(spark, sf), t.bars(spark, sf)))


@query
def detect_jumps_abs(spark: SparkSession, sf: str) -> DataFrame:
    return quality.detect_jumps(t.quality_bars(spark, sf), "abs")


@query
def detect_jumps_drop(spark: SparkSession, sf: str) -> DataFrame:
    return quality.detect_jumps(t.bars(spark, sf), "drop")


@query
def detect_jumps_prev_close(spark: SparkSession, sf: str) -> DataFrame:
    return quality.detect_jumps(t.quality_bars(spark, sf), "prev_close")


@query
def jump_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = quality.jump_rows(t.bars(spark, sf), "abs")
    return plain(rows.select("symbol", "date", "close", "prev_row_close"))


@query
def ohlc_violations(spark: SparkSession, sf: str) -> DataFrame:
    return quality.ohlc_violations(t.quality_bars(spark, sf))


@query
def ohlc_violation_counts(spark: SparkSession, sf: str) -> DataFrame:
    return plain(quality.ohlc_violation_counts(t.quality_bars(spark, sf)))


@query
def dq_summary(spark: SparkSession, sf: str) -> DataFrame:
    return plain(quality.dq_summary(t.quality_bars(spark, sf), FLOOR))


@query
def dq_delta_52w(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per symbol that close above their own 52-week high."""
    rolled = rolling.rolling_indicators(t.quality_bars(spark, sf))
    above = rolled.withColumn("delta_52w_high", metrics.pct_return("close", "high_52w"))
    return plain(quality.positive_deltas(above).groupBy("symbol").agg(F.count("*").alias("bad_rows")))


# -- repair ----------------------------------------------------------------------------------


def _repaired(spark: SparkSession, sf: str, detector: str):
    feed = readers.adjusted_bars(readers.read_adjusted(spark, t.adjusted_landing(spark, sf)))
    return jobs.repaired(t.quality_bars(spark, sf), feed, detector)


@query
def repair_update(spark: SparkSession, sf: str) -> DataFrame:
    fixed, _, _ = _repaired(spark, sf, "jumps")
    return plain(
        fixed.select("symbol", "date", "open", "high", "low", "close", "prev_close", "volume",
                     "delivery_volume")
    )


@query
def repair_report(spark: SparkSession, sf: str) -> DataFrame:
    return plain(_repaired(spark, sf, "violations")[1])


@query
def repair_verify(spark: SparkSession, sf: str) -> DataFrame:
    """Bad rows before and after the violation repair, per symbol."""
    before = quality.ohlc_violation_counts(t.quality_bars(spark, sf))
    after = _repaired(spark, sf, "violations")[2].withColumnRenamed("bad_rows", "rows_after")
    both = before.join(after, "symbol", "left")
    return plain(
        both.select("symbol", F.col("bad_rows").alias("rows_before"),
                    F.coalesce("rows_after", F.lit(0)).alias("rows_after"))
    )


# -- cleaning and feeds ----------------------------------------------------------------------


def _raw_equity(spark: SparkSession, sf: str) -> DataFrame:
    return readers.read_equity(spark, t.equity_landing(spark, sf))


@query
def clean_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Landed text back to bars."""
    return plain(readers.clean_equity(_raw_equity(spark, sf)).drop(ORDINAL))


@query
def clean_bars_mixed_headers(spark: SparkSession, sf: str) -> DataFrame:
    """The same bars from files whose headers differ in order and columns."""
    raw = readers.read_equity(spark, t.mixed_landing(spark, sf))
    return plain(readers.clean_equity(raw).drop(ORDINAL))


@query
def clean_bars_null(spark: SparkSession, sf: str) -> DataFrame:
    """Unusable cells as NULL instead of 0."""
    cleaned = readers.clean_equity(_raw_equity(spark, sf), on_bad="null")
    return plain(cleaned.select("symbol", "date", "prev_close", "delivery_volume"))


@query
def clean_bars_range(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = readers.clean_equity(_raw_equity(spark, sf)).drop(ORDINAL)
    ranged = readers.between(cleaned, dt.date(1996, 1, 1), dt.date(1996, 12, 31))
    return plain(ranged.select("symbol", "date", "close", "volume"))


@query
def quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Undated rows per symbol."""
    bad = readers.quarantine(_raw_equity(spark, sf))
    return plain(bad.groupBy("symbol").agg(F.count("*").alias("bad_rows")))


@query
def bad_cells(spark: SparkSession, sf: str) -> DataFrame:
    return plain(readers.bad_cells(_raw_equity(spark, sf)))


@query
def clean_index(spark: SparkSession, sf: str) -> DataFrame:
    raw = readers.read_index(spark, t.index_landing(spark, sf))
    return plain(readers.clean_index(raw).drop(ORDINAL))


@query
def adjusted_feed(spark: SparkSession, sf: str) -> DataFrame:
    feed = readers.read_adjusted(spark, t.adjusted_landing(spark, sf))
    return plain(readers.adjusted_bars(feed, FLOOR).drop(ORDINAL))


@query
def adjusted_index_feed(spark: SparkSession, sf: str) -> DataFrame:
    """The default benchmark's bars under an unknown name, through the raw index layout."""
    feed = readers.read_adjusted(spark, t.adjusted_landing(spark, sf))
    raw = readers.adjusted_index(feed, t.BENCHMARK)
    return plain(readers.clean_index(raw).drop(ORDINAL))


@query
def lot_sizes_json(spark: SparkSession, sf: str) -> DataFrame:
    return plain(readers.lot_sizes(t.instruments(spark, sf)))


@query
def eligible_mixed_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Eligible files under two headers, with their columns in other orders, read alike."""
    listed = readers.read_eligible(spark, t.mixed_eligible_landing(spark, sf))
    return plain(listed.select("symbol", "company_name"))


@query
def master_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Listed brands with lot sizes from the instrument entries, 0 where there is none."""
    listed = t.given(spark, sf, "part").select(
        t.brand_symbol().alias("symbol"), F.col("p_name").alias("underlying"),
        F.col("p_partkey").alias(ORDINAL),
    )
    lots = readers.lot_sizes(t.part_instruments(spark, sf))
    rows = readers.master_rows(readers.eligible_stocks(listed), lots)
    empty = t.master(spark, sf).filter(F.lit(False))
    stored = upsert_partial(empty, rows, ["symbol"], ["company_name", "lot_size"])
    return plain(stored.select("symbol", "company_name", "lot_size"))


@query
def asset_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return plain(reports.asset_coverage(_manifest(spark, sf)))


@query
def asset_summary(spark: SparkSession, sf: str) -> DataFrame:
    return plain(reports.asset_summary(_manifest(spark, sf)))


def _manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as assets, one JSON object each: their balance decides the source."""
    balance = F.col("c_acctbal")
    good = F.named_struct(
        F.lit("available"), F.lit(True),
        F.lit("source"), F.when(balance > 5000, "first").otherwise("second"),
    )
    kinds = (
        F.when(balance > 0, F.to_json(good))
        .when(balance > -500, '{"available":false,"placeholder":true}')
        .otherwise('{"available":false,"error":true}')
    )
    text = F.concat(F.lit('{"'), "c_name", F.lit('":'), kinds, F.lit("}"))
    customers = t.given(spark, sf, "customer").select(text.alias("value"))
    return readers.json_map_rows(customers, reports.MANIFEST_ENTRY)


# -- keyed writes ----------------------------------------------------------------------------


def _corrections(rows: DataFrame) -> DataFrame:
    """Two corrections of every row from 1999 on; the later one must win."""
    late = rows.filter(F.col("date") >= _date(OVERLAP))

    def corrected(n: int) -> DataFrame:
        shifted = (F.col("close") + n).cast("decimal(12,2)")
        return late.withColumns({"close": shifted, ORDINAL: F.lit(n)})

    return corrected(2).unionByName(corrected(1))


@query
def upsert_bars(spark: SparkSession, sf: str) -> DataFrame:
    bars = t.bars(spark, sf)
    stored = bars.filter(F.col("date") < _date(CUTOVER))
    return plain(upsert(stored, _corrections(bars), ["symbol", "date"]).select(*BARS.names))


@query
def upsert_index(spark: SparkSession, sf: str) -> DataFrame:
    index = t.index(spark, sf)
    stored = index.filter(F.col("date") < _date(CUTOVER))
    merged = upsert(stored, _corrections(index), ["index_name", "date"])
    return plain(merged.select(*INDEX_BARS.names))


@query
def upsert_master_partial(spark: SparkSession, sf: str) -> DataFrame:
    """Brands with a promo part are stored; the batch knows all brands but one."""
    master = t.master(spark, sf)
    part = t.given(spark, sf, "part")
    promo = part.filter(F.col("p_type") == "PROMO").select(t.brand_symbol().alias("symbol"))
    merged = upsert_partial(
        master.join(promo, "symbol", "left_semi"), t.master_batch(spark, sf),
        ["symbol"], ["company_name", "lot_size"], stamp="last_updated",
    )
    stamped = F.col("last_updated").isNotNull()
    return plain(merged.withColumn("stamped", stamped).drop("last_updated"))


@query
def metadata_update(spark: SparkSession, sf: str) -> DataFrame:
    landed = readers.read_metadata(spark, t.metadata_landing(spark, sf))
    return plain(update_metadata(t.master(spark, sf), landed).drop("last_updated"))


@query
def metadata_gap_list(spark: SparkSession, sf: str) -> DataFrame:
    return metadata_gaps(t.master(spark, sf)).orderBy("symbol")


# -- incremental and continuous collection ---------------------------------------------------


def _partly_loaded(spark: SparkSession, sf: str) -> DataFrame:
    """Bars of all but one symbol; half of the rest end at the cut-over."""
    bars = t.bars(spark, sf)
    complete = F.col("symbol") < "BRAND#2"
    loaded = bars.filter(complete | (F.col("date") < _date(CUTOVER)))
    return loaded.filter(F.col("symbol") != "BRAND#25")


@query
def incremental_plan(spark: SparkSession, sf: str) -> DataFrame:
    today = rolling.max_date(t.bars(spark, sf))
    plan = lookups.incremental_plan(
        t.master(spark, sf), _partly_loaded(spark, sf), _date(dt.date(1995, 1, 1)), today
    )
    return plain(plan)


@query
def incremental_append(spark: SparkSession, sf: str) -> DataFrame:
    stored = _partly_loaded(spark, sf)
    fresh = lookups.new_rows_only(t.bars(spark, sf), stored)
    return plain(upsert(stored, fresh, ["symbol", "date"]))


@query
def incremental_new_rows(spark: SparkSession, sf: str) -> DataFrame:
    fresh = lookups.new_rows_only(t.bars(spark, sf), _partly_loaded(spark, sf))
    return plain(fresh.select("symbol", "date", "close"))


@query
def stream_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Landing files replayed as a stream; the table must equal the batch result."""
    store = Store(spark, new_folder(spark, "stream-store"))
    stream = stream_collect(
        spark, t.equity_landing(spark, sf), store, new_folder(spark, "stream-state"),
    )
    stream.awaitTermination()
    return plain(store.table("daily_ohlcv"))


@query
def stream_upsert_mixed_headers(spark: SparkSession, sf: str) -> DataFrame:
    """The stream reads files of different layouts as the batch does."""
    store = Store(spark, new_folder(spark, "stream-store"))
    landing = t.mixed_landing(spark, sf)
    stream_collect(spark, landing, store, new_folder(spark, "stream-state")).awaitTermination()
    return plain(store.table("daily_ohlcv"))


# -- stores and jobs -------------------------------------------------------------------------


@query
def store_market_stats(spark: SparkSession, sf: str) -> DataFrame:
    """The market's latest day from the newest month of a store."""
    return plain(stored.market_stats(t.market_store(spark, sf)))


@query
def store_ban_status(spark: SparkSession, sf: str) -> DataFrame:
    return plain(stored.ban_status(t.market_store(spark, sf)))


@query
def store_ban_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return plain(stored.ban_frequency(t.market_store(spark, sf)))


@query
def store_screen_latest(spark: SparkSession, sf: str) -> DataFrame:
    store = t.market_store(spark, sf)
    return plain(stored.screen_latest(store, "upward-breakout", benchmark=t.BENCHMARK))


@query
def store_stock_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return plain(stored.stock_metrics(t.market_store(spark, sf), t.BENCHMARK))


def _collected(spark: SparkSession, sf: str) -> tuple[Store, DataFrame]:
    return t.collected(spark, sf, FLOOR, OVERLAP, CUTOVER)


@query
def collect_all_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Bars that two collections of the landed feeds leave in the store."""
    return plain(_collected(spark, sf)[0].table("daily_ohlcv"))


@query
def collect_all_master(spark: SparkSession, sf: str) -> DataFrame:
    stocks = _collected(spark, sf)[0].table("fno_stocks")
    return plain(stocks.select("symbol", "company_name", "lot_size"))


@query
def collect_report(spark: SparkSession, sf: str) -> DataFrame:
    """What the second collection read, left out and stored."""
    return _collected(spark, sf)[1]


@query
def refresh_index_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a benchmark before and after its refresh."""
    store = Store(spark, new_folder(spark, "refresh-store"))
    index = t.index(spark, sf)
    jobs.store_series(store, "index_ohlcv", index.filter(F.col("date") < _date(CUTOVER)))
    counts = jobs.refresh_index(store, _corrections(index), t.BENCHMARK)
    return spark.createDataFrame([counts], "rows_before bigint, rows_after bigint")


@query
def adjusted_feed_dirty(spark: SparkSession, sf: str) -> DataFrame:
    """Unusable dates are left out, everything else is read."""
    feed = readers.read_adjusted(spark, t.dirty_adjusted_landing(spark, sf))
    return plain(readers.adjusted_bars(feed, FLOOR).drop(ORDINAL))


@query
def repair_update_dirty(spark: SparkSession, sf: str) -> DataFrame:
    """Source rows with a price that no stored column can hold are skipped."""
    feed = readers.read_adjusted(spark, t.dirty_adjusted_landing(spark, sf))
    fixed, _, _ = jobs.repaired(t.quality_bars(spark, sf), readers.adjusted_bars(feed), "jumps")
    return plain(fixed.select("symbol", "date", "open", "high", "low", "close", "volume"))


# -- display labels --------------------------------------------------------------------------


@query
def heat_levels(spark: SparkSession, sf: str) -> DataFrame:
    change = metrics.pct_return("close", "prev_close")
    rows = t.bars(spark, sf).select("symbol", "date", change.alias("change_pct"))
    return plain(
        rows.select(
            "symbol", "date", labels.heat_sign("change_pct").alias("heat_sign"),
            labels.heat_level("change_pct").alias("heat_level"),
        )
    )


@query
def rs_class(spark: SparkSession, sf: str) -> DataFrame:
    cls = labels.relative_strength_class("rs_rank")
    return _metrics(spark, sf).select("symbol", cls.alias("rs_class"))


@query
def volume_units(spark: SparkSession, sf: str) -> DataFrame:
    """Volume and turnover texts, so that every unit occurs."""
    return plain(
        t.bars(spark, sf).select(
            "symbol", "date", labels.volume_text("volume").alias("volume_text"),
            labels.volume_text(F.col("value").cast("bigint") * 10).alias("turnover_text"),
        )
    )


@query
def strength_classes(spark: SparkSession, sf: str) -> DataFrame:
    hits = screens.screen(t.bars(spark, sf), "downward-breakout", as_of=None)
    return plain(
        hits.select(
            "symbol", "date", labels.strength_class("strength").alias("strength_class"),
            labels.change_class("change_pct").alias("change_class"),
        )
    )
