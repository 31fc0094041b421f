"""Per-symbol metrics, the paged stock list and sparklines."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import change_pct, double, mean_price, pct_return, round_to
from ..operators.bans import exclude_banned, mark_banned
from ..operators.lookups import stock_info
from ..operators.rolling import max_date, newest_rows
from ..session import checkpointed
from .screens import BENCHMARK

# Look-backs in rows.
YEAR_ROWS, MONTH_ROWS = 252, 21
SMA_ROWS = (20, 50, 200)

LATEST_COLUMNS = (
    "date", "open", "high", "low", "close", "prev_close", "volume", "value", "delivery_volume",
    "delivery_pct",
)
METRIC_COLUMNS = (
    "symbol", "date", "open", "high", "low", "close", "prev_close", "change_pct", "volume",
    "value", "delivery_volume", "delivery_pct", "ytd_pct", "pct_1y", "pct_1m", "delta_52w_high",
    "above_sma_20", "above_sma_50", "above_sma_200", "rs_rank",
)
# Columns the list may be sorted by.
SORTABLE = (
    "symbol", "company_name", "close", "change_pct", "volume", "date", "delivery_pct", "ytd_pct",
    "pct_1y", "pct_1m", "delta_52w_high", "rs_rank",
)


def _at(rn: int, c: Column | str) -> Column:
    """Value of the row numbered ``rn`` within its group."""
    return F.max(F.when(F.col("rn") == rn, F.col(c) if isinstance(c, str) else c))


def benchmark_1y(index: DataFrame, index_name: str = BENCHMARK) -> Column:
    """One-year % move of the benchmark as a scalar subquery, 0 if unknown."""
    series = index.filter(F.col("index_name") == index_name).select("index_name", "date", "close")
    ends = newest_rows(series, YEAR_ROWS, key="index_name").agg(
        _at(1, "close").alias("now"), _at(YEAR_ROWS, "close").alias("then")
    )
    known = (F.col("now") != 0) & (F.col("then") != 0)
    # operands are rounded to doubles before the difference is taken
    move = F.try_divide(double("now") - double("then"), double("then")) * 100
    return ends.select(F.when(known, move).otherwise(0.0)).scalar()


def ytd_anchor(bars: DataFrame, ytd_from: dt.date | None = None) -> DataFrame:
    """Close of each symbol on the first trading date of the year."""
    start = F.lit(ytd_from) if ytd_from else F.trunc(max_date(bars), "year")
    first = bars.filter(F.col("date") >= start).agg(F.min("date")).scalar()
    anchor = bars.filter(F.col("date") == first)
    return anchor.select("symbol", F.col("close").alias("ytd_start_close"))


def stock_metrics(
    bars: DataFrame,
    index: DataFrame,
    ytd_from: dt.date | None = None,
    benchmark: str = BENCHMARK,
    anchor: DataFrame | None = None,
) -> DataFrame:
    """Latest bar and look-back metrics, one row per symbol (K9).

    ``anchor`` (symbol, ytd_start_close) is looked up in ``bars`` if it is not given.

    Only the newest 252 rows of a symbol count, so Spark drops the rest before the shuffle,
    and plain conditional aggregates replace running windows.
    """
    recent = newest_rows(bars.select("symbol", *LATEST_COLUMNS), YEAR_ROWS)
    rn = F.col("rn")
    per_symbol = recent.groupBy("symbol").agg(
        *(_at(1, c).alias(c) for c in LATEST_COLUMNS),
        F.max("high").alias("high_52w"),
        _at(YEAR_ROWS, "close").alias("close_1y_ago"),
        _at(MONTH_ROWS, "close").alias("close_1m_ago"),
        *(mean_price(F.when(rn <= n, F.col("close"))).alias(f"sma_{n}") for n in SMA_ROWS),
    )
    close = F.col("close")
    year = change_pct(close, "close_1y_ago")
    if anchor is None:
        anchor = ytd_anchor(bars, ytd_from)
    anchored = per_symbol.join(anchor, "symbol", "left").withColumn(
        "benchmark_1y", benchmark_1y(index, benchmark)
    )
    metrics = anchored.withColumns(
        {
            "change_pct": pct_return(close, "prev_close"),
            "ytd_pct": pct_return(close, "ytd_start_close"),
            "pct_1y": pct_return(close, "close_1y_ago"),
            "pct_1m": pct_return(close, "close_1m_ago"),
            "delta_52w_high": pct_return(close, "high_52w"),
            **{f"above_sma_{n}": double(close) > F.col(f"sma_{n}") for n in SMA_ROWS},
            "rs_rank": F.when(
                F.col("close_1y_ago") > 0, round_to(year - F.col("benchmark_1y"))
            ),
        }
    )
    return metrics.select(*METRIC_COLUMNS)


def search_stocks(df: DataFrame, search: str | None) -> DataFrame:
    """Case-insensitive substring of symbol or company; % and _ are wildcards."""
    if not search:
        return df
    pattern = f"%{search}%"
    return df.filter(F.col("symbol").ilike(pattern) | F.col("company_name").ilike(pattern))


def _sort_columns(sort_by: str, order: str) -> list[Column]:
    """Allowed sort column and direction, NULLs last, symbol as tie-break."""
    c = F.col(sort_by if sort_by in SORTABLE else "symbol")
    primary = c.desc_nulls_last() if order.lower() == "desc" else c.asc_nulls_last()
    return [primary, F.col("symbol").asc()]


def stock_page(
    metrics: DataFrame,
    master: DataFrame,
    bans: DataFrame,
    *,
    search: str | None = None,
    sort_by: str = "symbol",
    order: str = "asc",
    page: int = 1,
    limit: int = 50,
    exclude: bool = False,
    strict_compat: bool = False,
) -> DataFrame:
    """One ordered page of master joined with metrics, with ban marks.

    ``exclude`` hides banned symbols before paging; with ``strict_compat`` after it, so that
    pages may come back short.
    """
    stocks = search_stocks(master.select("symbol", "company_name", "lot_size"), search)
    rows = stocks.join(metrics, "symbol")
    if exclude and not strict_compat:
        rows = exclude_banned(rows, bans)
    sort = _sort_columns(sort_by, order)
    rows = mark_banned(rows.orderBy(*sort).offset((page - 1) * limit).limit(limit), bans)
    if exclude and strict_compat:
        rows = rows.filter(~F.col("in_ban"))
    return rows.orderBy(*sort)


def page_totals(
    master: DataFrame,
    bans: DataFrame | None = None,
    *,
    search: str | None = None,
    page: int = 1,
    limit: int = 50,
    exclude: bool = False,
    strict_compat: bool = False,
) -> DataFrame:
    """Total stocks, pages and the shown row range; counts the master table."""
    stocks = search_stocks(master.select("symbol", "company_name"), search)
    if exclude and not strict_compat:
        stocks = exclude_banned(stocks, bans)
    total = F.col("total")
    return stocks.agg(F.count("*").alias("total")).select(
        F.lit(page).alias("page"),
        F.lit(limit).alias("page_limit"),
        "total",
        F.ceil(total / limit).alias("total_pages"),
        F.lit((page - 1) * limit + 1).alias("first_row"),
        F.least(F.lit(page * limit), total).alias("last_row"),
    )


def sparkline(bars: DataFrame, n: int = YEAR_ROWS) -> DataFrame:
    """The newest ``n`` closes of each symbol, oldest first."""
    recent = newest_rows(bars.select("symbol", "date", "close"), n)
    points = F.array_sort(F.collect_list(F.struct("date", "close")))
    return recent.groupBy("symbol").agg(
        F.transform(points, lambda p: p["close"]).alias("sparkline")
    )


def attach_sparkline(page: DataFrame, bars: DataFrame, n: int = YEAR_ROWS) -> DataFrame:
    """Add closes for the symbols of a page only; none gives an empty array."""
    page = checkpointed(page)  # computed once for both joins
    shown = bars.select("symbol", "date", "close").join(page.select("symbol"), "symbol", "left_semi")
    joined = page.join(sparkline(shown, n), "symbol", "left")
    return joined.withColumn(
        "sparkline", F.coalesce("sparkline", F.array().cast("array<decimal(12,2)>"))
    )


def stock_list(
    bars: DataFrame,
    index: DataFrame,
    master: DataFrame,
    bans: DataFrame,
    *,
    ytd_from: dt.date | None = None,
    benchmark: str = BENCHMARK,
    sort_by: str = "symbol",
    order: str = "asc",
    **paging,
) -> DataFrame:
    """Metrics, search, sort, page, ban marks and sparklines in one result."""
    metrics = stock_metrics(bars, index, ytd_from, benchmark)
    page = stock_page(metrics, master, bans, sort_by=sort_by, order=order, **paging)
    return attach_sparkline(page, bars).orderBy(*_sort_columns(sort_by, order))


def stock_history(bars: DataFrame, master: DataFrame, symbol: str, days: int = 30) -> DataFrame:
    """Newest bars of one listed symbol with their change %; empty if unknown."""
    rows = bars.filter(F.col("symbol") == symbol.upper())
    listed = rows.join(stock_info(master, symbol), "symbol", "left_semi")
    changed = listed.select(
        "symbol", *LATEST_COLUMNS, round_to(change_pct("close", "prev_close")).alias("change_pct")
    )
    return changed.orderBy(F.desc("date")).limit(days)
