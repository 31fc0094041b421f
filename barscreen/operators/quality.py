"""Data-quality checks and price repair."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.numeric import double
from .rolling import over_series
from .upsert import keyed_update

REPAIRED_COLUMNS = ("open", "high", "low", "close", "volume")


def jump_rows(bars: DataFrame, mode: str = "abs", threshold: float = 0.30) -> DataFrame:
    """Bars that do not follow from the bar before.

    ``abs``: close moved by more than the threshold; ``drop``: fell by more than it;
    ``prev_close``: the stored previous close is not the close stored the day before.
    """
    prev = F.col("prev_row_close")
    move = F.try_divide(double(F.col("close") - prev), double(prev))
    rules = {
        "abs": F.abs(move) > threshold,
        "drop": move < -threshold,
        "prev_close": F.col("prev_close") != prev,
    }
    if mode not in rules:
        raise ValueError(f"mode must be one of {sorted(rules)}, not {mode!r}")

    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.withColumn("prev_row_close", F.lag("close").over(w))

    return over_series(bars, 1, build).filter(prev.isNotNull() & rules[mode])


def detect_jumps(bars: DataFrame, mode: str = "abs", threshold: float = 0.30) -> DataFrame:
    """Symbols with at least one jump, i.e. likely unadjusted splits."""
    columns = ["symbol", "date", "close"] + (["prev_close"] if mode == "prev_close" else [])
    return jump_rows(bars.select(*columns), mode, threshold).select("symbol").distinct()


def is_violation() -> Column:
    return (F.col("close") < F.col("low")) | (F.col("close") > F.col("high"))


def ohlc_violations(bars: DataFrame) -> DataFrame:
    """Symbols with a close outside its day's range."""
    return bars.filter(is_violation()).select("symbol").distinct()


def ohlc_violation_counts(bars: DataFrame) -> DataFrame:
    """Bad rows per symbol."""
    return bars.filter(is_violation()).groupBy("symbol").agg(F.count("*").alias("bad_rows"))


def dq_summary(bars: DataFrame, floor: dt.date) -> DataFrame:
    """Failing rows per check, all checks in one pass."""
    checks = {
        "null_close": F.col("close").isNull(),
        "null_date": F.col("date").isNull(),
        "date_before_floor": F.col("date") < F.lit(floor),
        "non_positive_close": F.col("close") <= 0,
        "negative_volume": F.col("volume") < 0,
        "close_outside_range": is_violation(),
    }
    counts = bars.agg(*(F.count_if(rule).alias(name) for name, rule in checks.items()))
    return counts.unpivot([], list(checks), "check_name", "bad_rows")


def positive_deltas(metrics: DataFrame) -> DataFrame:
    """Symbols quoted above their own 52-week high, which must not happen."""
    return metrics.filter(F.col("delta_52w_high") > 0).select("symbol", "delta_52w_high")


def repair(bars: DataFrame, adjusted: DataFrame, flagged: DataFrame) -> DataFrame:
    """Overwrite prices and volume of flagged symbols from the adjusted feed.

    Rows that found a match are marked ``_matched``.
    """
    source = adjusted.join(flagged, "symbol", "left_semi")
    return keyed_update(bars, source, ["symbol", "date"], REPAIRED_COLUMNS)


def repair_report(repaired: DataFrame, flagged: DataFrame) -> DataFrame:
    """Rows updated per flagged symbol; only rows that really matched count."""
    hits = repaired.filter("_matched").groupBy("symbol").agg(F.count("*").alias("rows_updated"))
    return (
        flagged.select("symbol")
        .distinct()
        .join(hits, "symbol", "left")
        .withColumn("rows_updated", F.coalesce("rows_updated", F.lit(0)))
        .withColumn("fixed", F.col("rows_updated") > 0)
    )
