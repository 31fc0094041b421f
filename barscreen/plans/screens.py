"""The pattern screens: registry, plans and runner (K1-K8)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.numeric import (
    breakout_strength,
    change_pct,
    close_location,
    guarded_change_pct,
    multiple,
    round_to,
)
from ..operators.bans import exclude_banned, mark_banned
from ..operators.rolling import (
    add_indicators,
    benchmark_returns,
    max_date,
    newest_rows,
    over_series,
    reach,
)

BENCHMARK = "NIFTY 50"

# Thresholds of the screens.
MIN_CLOSE = 20
EXPLOSION = 2
HIGH_DELIVERY = 1.5
MAX_RELATIVE_RETURN = -1.2
MAX_CLOSE_LOCATION = 0.30

# Label and display type of every result column.
COLUMN_TYPES = {
    "symbol": ("Symbol", "symbol"),
    "close": ("Price", "currency"),
    "changePct": ("Change %", "percent"),
    "strength": ("Strength", "strength"),
    "relativeReturn": ("Rel. Return", "percent"),
    "closeLocation": ("Close Loc %", "percent"),
    "volumeMult": ("Vol Multiple", "multiplier"),
    "deliveryMult": ("Del Vol Multiple", "multiplier"),
    "deliveryPct": ("Delivery %", "percent"),
    "date": ("Date", "date"),
}

BREAKOUT_OUTPUT = (
    "symbol", "date", "close", "change_pct", "volume", "delivery_pct", "volume_mult", "strength",
)
WEAKNESS_OUTPUT = (
    "symbol", "close", "change_pct", "relative_return", "close_location", "delivery_mult",
    "delivery_pct", "date",
)


@dataclass(frozen=True)
class Screen:
    """One screen: the columns it reads, its rolling columns, row rule, output and order."""

    id: str
    title: str
    description: str
    shown: tuple[str, ...]
    inputs: tuple[str, ...]
    indicators: tuple[str, ...]
    rule: Column
    output: dict[str, Column]
    order: list[Column]
    uses_benchmark: bool = False

    @property
    def columns(self) -> list[dict[str, str]]:
        """Displayed columns with label and type."""
        described = ((key, *COLUMN_TYPES[key]) for key in self.shown)
        return [{"key": k, "label": label, "type": kind} for k, label, kind in described]


def _volume_breakout(amount: str, mean: str, peak: str) -> dict:
    """New 20-row high on exploding (delivery) volume (K1, K4)."""
    close = F.col("close")
    output = {
        "change_pct": change_pct("close", "open"),
        "volume_mult": multiple(amount, mean),
        "strength": F.lit("N/A"),
    }
    by = F.col("volume") if amount == "volume" else output["volume_mult"]
    return {
        "shown": ("symbol", "close", "changePct", "volumeMult", "deliveryPct", "date"),
        "inputs": ("open", "high", "close", "volume", "delivery_volume", "delivery_pct"),
        "indicators": ("max_20_high", mean, peak),
        "rule": (
            (close > F.col("max_20_high"))
            & (F.col(amount) > F.col(mean) * EXPLOSION)
            & (F.col(amount) > F.col(peak))
            & (close > F.col("open"))
            & (close > MIN_CLOSE)
        ),
        "output": {c: output.get(c, F.col(c)) for c in BREAKOUT_OUTPUT},
        "order": [by.desc_nulls_last()],
    }


def _range_breakout(level: str, amount: str, mean: str) -> dict:
    """Close beyond the extreme of the 20 rows before, graded by ATR and volume (K2, K3, K5, K6)."""
    above = F.col("close") - F.col(level)
    move = above if level == "max_20_high" else -above
    output = {
        "change_pct": round_to(change_pct("close", "prev_close")),
        "volume_mult": multiple(amount, mean),
        "strength": breakout_strength(move, F.col("atr"), F.col(amount), F.col(mean)),
    }
    return {
        "shown": (
            "symbol", "close", "changePct", "strength", "volumeMult", "deliveryPct", "date",
        ),
        "inputs": (
            "high", "low", "close", "prev_close", "volume", "delivery_volume", "delivery_pct",
        ),
        "indicators": (level, "atr", mean),
        "rule": move > 0,
        "output": {c: output.get(c, F.col(c)) for c in BREAKOUT_OUTPUT},
        "order": [output["strength"].asc_nulls_last(), output["volume_mult"].desc_nulls_last()],
    }


def _relative_weakness() -> dict:
    """Lagging the benchmark, closing low, on high delivery volume (K7)."""
    mean = "avg_20_del_vol"
    stock_pct = guarded_change_pct("close", "prev_close")
    place = close_location("high", "low", "close")
    lead = stock_pct - F.coalesce(F.col("benchmark_pct"), F.lit(0.0))
    output = {
        "change_pct": round_to(stock_pct),
        "relative_return": round_to(stock_pct - F.col("benchmark_pct")),
        "close_location": round_to(place * 100, 1),
        "delivery_mult": multiple("delivery_volume", mean),
    }
    return {
        "shown": (
            "symbol", "close", "changePct", "relativeReturn", "closeLocation", "deliveryMult",
            "deliveryPct", "date",
        ),
        "inputs": ("high", "low", "close", "prev_close", "delivery_volume", "delivery_pct"),
        "indicators": (mean,),
        "rule": (
            (lead <= MAX_RELATIVE_RETURN)
            & (place <= MAX_CLOSE_LOCATION)
            & (F.col("delivery_volume") >= F.col(mean) * HIGH_DELIVERY)
            & (F.col("close") > MIN_CLOSE)
        ),
        "output": {c: output.get(c, F.col(c)) for c in WEAKNESS_OUTPUT},
        "order": [lead.asc_nulls_last(), output["delivery_mult"].desc_nulls_last()],
        "uses_benchmark": True,
    }


# Ids, titles and descriptions as shown to users.
_TEXTS = (
    (
        "volume-breakout",
        "Volume Breakout Pattern",
        "Bullish breakout with high volume confirmation.",
    ),
    (
        "upward-breakout",
        "Upward Breakout (20D)",
        "Price breaks above the highest high of the last 20 days.",
    ),
    (
        "downward-breakout",
        "Downward Breakdown (20D)",
        "Price breaks below the lowest low of the last 20 days.",
    ),
    (
        "volume-breakout-delivery",
        "Volume Breakout (Delivery)",
        "Bullish breakout based on high *delivery* volume confirmation.",
    ),
    (
        "upward-breakout-delivery",
        "Upward Breakout (20D Delivery)",
        "Price breaks above 20-day high with high *delivery* volume.",
    ),
    (
        "downward-breakout-delivery",
        "Downward Breakdown (20D Delivery)",
        "Price breaks below 20-day low with high *delivery* volume.",
    ),
    (
        "relative-weakness",
        "Relative Weakness (vs Nifty)",
        "Stocks showing weakness relative to Nifty 50: underperformance ≥1.2%, "
        "close in bottom 30% of range, high delivery volume.",
    ),
)

_PLANS: dict[str, Callable[[], dict]] = {
    "volume-breakout": lambda: _volume_breakout("volume", "avg_50_vol", "max_10_vol"),
    "upward-breakout": lambda: _range_breakout("max_20_high", "volume", "avg_20_vol"),
    "downward-breakout": lambda: _range_breakout("min_20_low", "volume", "avg_20_vol"),
    "volume-breakout-delivery": lambda: _volume_breakout(
        "delivery_volume", "avg_50_del_vol", "max_10_del_vol"
    ),
    "upward-breakout-delivery": lambda: _range_breakout(
        "max_20_high", "delivery_volume", "avg_20_del_vol"
    ),
    "downward-breakout-delivery": lambda: _range_breakout(
        "min_20_low", "delivery_volume", "avg_20_del_vol"
    ),
    "relative-weakness": _relative_weakness,
}

SCREEN_IDS = tuple(_PLANS)

AsOf = dt.date | Column | str | None


def get_screen(screen_id: str) -> Screen:
    """Look a screen up; an unknown id raises ``KeyError``."""
    title, description = {i: (t, d) for i, t, d in _TEXTS}[screen_id]
    return Screen(screen_id, title, description, **_PLANS[screen_id]())


def list_screens(spark: SparkSession) -> DataFrame:
    """Screen catalogue."""
    return spark.createDataFrame(list(_TEXTS), "id string, title string, description string")


def _with_columns(
    bars: DataFrame,
    index: DataFrame | None,
    specs: Sequence[Screen],
    as_of: AsOf,
    benchmark: str,
    block_rows: int | None,
) -> DataFrame:
    """Bars with all rolling and benchmark columns the screens need: one shuffle on symbol."""
    inputs = list(dict.fromkeys(c for spec in specs for c in spec.inputs))
    names = list(dict.fromkeys(n for spec in specs for n in spec.indicators))
    rows = bars.select("symbol", "date", *inputs)

    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        return add_indicators(df, w, names)

    if as_of is None:
        rows = over_series(rows, reach(names), build, block_rows=block_rows)
    else:
        if isinstance(as_of, str) and as_of == "latest":
            day = max_date(bars)
        else:
            day = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")
            rows = rows.filter(F.col("date") <= day)
        rows = newest_rows(rows, reach(names) + 1).drop("rn")
        rows = over_series(rows, reach(names), build).filter(F.col("date") == day)
    if any(spec.uses_benchmark for spec in specs):
        if index is None:
            raise ValueError("this screen needs the index table")
        rows = rows.join(benchmark_returns(index, benchmark), "date", "left")
    return rows


def screen(
    bars: DataFrame,
    screen_id: str,
    *,
    index: DataFrame | None = None,
    as_of: AsOf = "latest",
    benchmark: str = BENCHMARK,
    ordered: bool = False,
    block_rows: int | None = None,
) -> DataFrame:
    """Rows that match a screen.

    ``as_of`` is 'latest' (the table's last date), a date, a scalar date column, or None for
    every date. For one date only the look-back rows of each symbol take part.
    """
    spec = get_screen(screen_id)
    hits = _with_columns(bars, index, [spec], as_of, benchmark, block_rows).filter(spec.rule)
    return _shown(hits, spec, spec.output, ordered)


def _shown(hits: DataFrame, spec: Screen, output: dict[str, Column], ordered: bool) -> DataFrame:
    if ordered:
        hits = hits.orderBy(*spec.order, F.asc("symbol"), F.asc("date"))
    return hits.select(*(c.alias(name) for name, c in output.items()))


def screen_counts(
    bars: DataFrame, index: DataFrame, as_of: AsOf = "latest", benchmark: str = BENCHMARK
) -> DataFrame:
    """Catalogue with the number of rows each screen returns, in one pass."""
    specs = [get_screen(i) for i in SCREEN_IDS]
    rows = _with_columns(bars, index, specs, as_of, benchmark, None)
    counts = rows.agg(*(F.count_if(spec.rule).alias(spec.id) for spec in specs))
    return counts.unpivot([], list(SCREEN_IDS), "id", "hits").join(
        list_screens(bars.sparkSession), "id"
    )


def run_screen(
    bars: DataFrame,
    bans: DataFrame,
    screen_id: str,
    *,
    index: DataFrame | None = None,
    as_of: AsOf = "latest",
    exclude: bool = False,
    benchmark: str = BENCHMARK,
    ordered: bool = False,
    block_rows: int | None = None,
) -> DataFrame:
    """A screen's rows with their ban mark, or without banned symbols (K8).

    Rows are sorted after the bans are joined: a join keeps no order.
    """
    spec = get_screen(screen_id)
    hits = _with_columns(bars, index, [spec], as_of, benchmark, block_rows).filter(spec.rule)
    if exclude:
        hits = exclude_banned(hits, bans).withColumn("in_ban", F.lit(False))
    else:
        hits = mark_banned(hits, bans)
    return _shown(hits, spec, {**spec.output, "in_ban": F.col("in_ban")}, ordered)


def sort_results(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Re-sort by any column; a missing number sorts as 0, a missing text as '' (G7)."""
    if dict(df.dtypes)[column] in ("string", "date"):
        key = F.coalesce(F.col(column).cast("string"), F.lit(""))
    else:
        key = F.coalesce(F.col(column).cast("double"), F.lit(0.0))
    ties = [F.asc(c) for c in ("symbol", "date") if c in df.columns]
    return df.orderBy(key.desc() if descending else key.asc(), *ties)
