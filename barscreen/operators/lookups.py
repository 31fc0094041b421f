"""Small lookups over the stored tables, and the incremental load plan."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rolling import max_date


def market_stats(master: DataFrame, bars: DataFrame) -> DataFrame:
    """Stock count, stocks up on the latest date, and that date."""
    latest = max_date(bars)
    up = (F.col("prev_close") > 0) & (F.col("close") > F.col("prev_close"))
    return bars.filter(F.col("date") == latest).agg(
        master.agg(F.count("*")).scalar().alias("stock_count"),
        F.count_if(up).alias("positive_count"),
        F.max("date").alias("last_updated"),
    )


def store_stats(master: DataFrame, bars: DataFrame) -> DataFrame:
    """Row counts and date range of the store."""
    return bars.agg(
        master.agg(F.count("*")).scalar().alias("stock_count"),
        F.count("*").alias("bar_count"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


def stock_info(master: DataFrame, symbol: str) -> DataFrame:
    """Master row of one symbol; empty if there is none."""
    found = master.filter(F.col("symbol") == symbol.upper())
    return found.select("symbol", "company_name", "lot_size", "last_updated")


def last_dates(bars: DataFrame) -> DataFrame:
    """Last stored date per symbol."""
    return bars.groupBy("symbol").agg(F.max("date").alias("last_date"))


def _day(value: dt.date | Column | None, default: Column) -> Column:
    if value is None:
        return default
    return value if isinstance(value, Column) else F.lit(value)


def incremental_plan(
    master: DataFrame,
    bars: DataFrame,
    start: dt.date | Column,
    today: dt.date | Column | None = None,
) -> DataFrame:
    """From/to dates to load per symbol; up-to-date symbols are marked to skip."""
    end = _day(today, F.current_date())
    following = F.date_add("last_date", 1)
    return (
        master.select("symbol")
        .join(last_dates(bars), "symbol", "left")
        .select(
            "symbol",
            F.coalesce(following, _day(start, F.current_date())).alias("from_date"),
            end.alias("to_date"),
            F.coalesce(following > end, F.lit(False)).alias("skip"),
        )
    )


def new_rows_only(new: DataFrame, bars: DataFrame) -> DataFrame:
    """Rows later than the symbol's last stored date."""
    joined = new.join(last_dates(bars), "symbol", "left")
    fresh = F.col("last_date").isNull() | (F.col("date") > F.col("last_date"))
    return joined.filter(fresh).drop("last_date")
