"""Rolling windows over keyed date series.

Frames are counted in rows, and all windows of a query share one spec
``partitionBy(key).orderBy(date)``: one shuffle, one sort. (key, date) is unique in every
stored table, so a series holds at most 366 rows a year however large the table is, and so
does the task that processes it. ``block_rows`` cuts series into overlapping blocks where
there are fewer series than cores; it changes the plan, never the result.

Work per row does not grow with the frame: means are differences of running integer sums,
long extremes are combined from short ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from ..functions.numeric import change_pct, true_range
from ..session import checkpointed

MAX_MONTH_ROWS = 31  # unique dates: no calendar month of a series is longer
SHORT_ROWS = 16  # frames up to twice this length are scanned directly

Build = Callable[[DataFrame, WindowSpec], DataFrame]


def over_series(
    df: DataFrame,
    lookback: int,
    build: Build,
    key: str = "symbol",
    block_rows: int | None = None,
) -> DataFrame:
    """Apply ``build(df, w)``, whose windows look back at most ``lookback`` rows.

    ``build`` must keep all columns it is given.
    """
    if block_rows is None:
        return build(df, Window.partitionBy(key).orderBy("date"))
    months = checkpointed(_month_blocks(df, key, lookback, block_rows))
    blocked = (
        df.withColumn("_month", F.trunc("date", "month"))
        .join(months, [key, "_month"])
        .withColumn("_copy", F.explode("_copies"))
        .withColumns({"_block": F.col("_copy.block"), "_warm": F.col("_copy.warm")})
        .drop("_month", "_copies", "_copy")
    )
    built = build(blocked, Window.partitionBy(key, "_block").orderBy("date"))
    return built.filter(~F.col("_warm")).drop("_block", "_warm")


def _month_blocks(df: DataFrame, key: str, lookback: int, block_rows: int) -> DataFrame:
    """Assign each (series, month) to a block, and late months also to the next block.

    A month belongs to the block of its first row. Blocks hold ``size`` rows, give or take
    one month, so a look-back never reaches past the block before.
    """
    size = max(block_rows, lookback + 2 * MAX_MONTH_ROWS)
    w = Window.partitionBy(key).orderBy("_month")
    months = (
        df.groupBy(key, F.trunc("date", "month").alias("_month"))
        .agg(F.count("*").alias("_n"))
        .withColumn("_end", F.sum("_n").over(w))
        .withColumn("_block", F.floor((F.col("_end") - F.col("_n")) / size).cast("int"))
    )
    block = F.col("_block")
    own = F.struct(block.alias("block"), F.lit(False).alias("warm"))
    warm_up = F.struct((block + 1).alias("block"), F.lit(True).alias("warm"))
    # the next block starts no earlier than row (block + 1) * size
    late = F.col("_end") > (block + 1) * size - lookback
    copies = F.when(late, F.array(own, warm_up)).otherwise(F.array(own))
    return months.select(key, "_month", copies.alias("_copies"))


def newest_rows(df: DataFrame, n: int, key: str = "symbol") -> DataFrame:
    """The ``n`` newest rows of each series, numbered 1.. in ``rn``.

    Spark cuts each map task's input to ``n`` rows per series before the shuffle.
    """
    newest_first = Window.partitionBy(key).orderBy(F.desc("date"))
    return df.withColumn("rn", F.row_number().over(newest_first)).filter(F.col("rn") <= n)


def max_date(df: DataFrame, column: str = "date") -> Column:
    """Latest date of a table as a scalar subquery."""
    return df.agg(F.max(column)).scalar()


@dataclass(frozen=True)
class Trailing:
    """A statistic of ``column`` over ``rows`` rows, up to the current row or the one before."""

    kind: str
    column: str
    rows: int
    current: bool

    @property
    def skip(self) -> int:
        return 0 if self.current else 1

    @property
    def reach(self) -> int:
        """Rows before the current one that are read; a true range also reads its previous row."""
        return self.rows - 1 + self.skip + (self.column == "tr")


# The rolling columns of the screens and metrics.
INDICATORS = {
    "max_20_high": Trailing("max", "high", 20, False),
    "min_20_low": Trailing("min", "low", 20, False),
    "avg_50_vol": Trailing("mean", "volume", 50, False),
    "max_10_vol": Trailing("max", "volume", 10, False),
    "avg_20_vol": Trailing("mean", "volume", 20, False),
    "avg_50_del_vol": Trailing("mean", "delivery_volume", 50, False),
    "max_10_del_vol": Trailing("max", "delivery_volume", 10, False),
    "avg_20_del_vol": Trailing("mean", "delivery_volume", 20, False),
    "atr": Trailing("mean", "tr", 14, True),
    "high_52w": Trailing("max", "high", 252, True),
    "sma_20": Trailing("mean", "close", 20, True),
    "sma_50": Trailing("mean", "close", 50, True),
    "sma_200": Trailing("mean", "close", 200, True),
}


def reach(names: Iterable[str]) -> int:
    """Look-back of a set of indicators."""
    return max(INDICATORS[name].reach for name in names)


def add_indicators(df: DataFrame, w: WindowSpec, names: Iterable[str]) -> DataFrame:
    """Add rolling columns by name."""
    wanted = {name: INDICATORS[name] for name in names}
    if any(t.column == "tr" for t in wanted.values()):
        df = df.withColumn("prev_close_calc", F.lag("close").over(w))
        df = df.withColumn("tr", true_range("high", "low", "prev_close_calc"))
    types = {f.name: f.dataType for f in df.schema}
    prepared: dict[str, Column] = {}
    final: dict[str, Column] = {}
    for name, t in wanted.items():
        if t.kind == "mean":
            scale = types[t.column].scale if isinstance(types[t.column], T.DecimalType) else 0
            prepared |= _running_totals(t.column, scale, w)
            final[name] = _mean_of_totals(t, scale, w)
        elif t.rows <= 2 * SHORT_ROWS:
            prepared[name] = _extreme(t).over(w.rowsBetween(1 - t.rows - t.skip, -t.skip))
        else:
            part = f"_{t.kind}_{t.column}"
            prepared[part] = _extreme(t).over(w.rowsBetween(1 - SHORT_ROWS, 0))
            final[name] = _combined_extreme(t, part, w)
    df = df.withColumns(prepared)
    if final:
        df = df.withColumns(final)
    return df.drop(*(c for c in prepared if c.startswith("_")))


def _running_totals(column: str, scale: int, w: WindowSpec) -> dict[str, Column]:
    """Integer sum and count from the start of the series (or block)."""
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    units = (F.col(column) * 10**scale).cast("bigint") if scale else F.col(column)
    return {
        f"_sum_{column}": F.coalesce(F.sum(units).over(so_far), F.lit(0).cast("bigint")),
        f"_count_{column}": F.count(column).over(so_far),
    }


def _mean_of_totals(t: Trailing, scale: int, w: WindowSpec) -> Column:
    """Exact integer difference of two running totals, divided once."""

    def span(total: str) -> Column:
        end = F.lag(total, t.skip).over(w) if t.skip else F.col(total)
        start = F.lag(total, t.rows + t.skip).over(w)
        return end - F.coalesce(start, F.lit(0).cast("bigint"))

    rows = (span(f"_count_{t.column}") * 10**scale).cast("double")
    return F.try_divide(span(f"_sum_{t.column}").cast("double"), rows)


def _extreme(t: Trailing) -> Column:
    return F.max(t.column) if t.kind == "max" else F.min(t.column)


def _combined_extreme(t: Trailing, part: str, w: WindowSpec) -> Column:
    """Extreme of a long frame from overlapping short ones; missing ones are skipped."""
    steps = [*range(0, t.rows - SHORT_ROWS, SHORT_ROWS), t.rows - SHORT_ROWS]
    pieces = [F.lag(part, step + t.skip).over(w) for step in steps]
    return F.greatest(*pieces) if t.kind == "max" else F.least(*pieces)


def rolling_indicators(bars: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Every rolling column, and the closes 20 and 251 rows back, for every bar."""

    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        anchored = df.withColumns(
            {
                "close_1m_ago": F.lag("close", 20).over(w),
                "close_1y_ago": F.lag("close", 251).over(w),
            }
        )
        return add_indicators(anchored, w, INDICATORS)

    return over_series(bars, 251, build, block_rows=block_rows)


def benchmark_returns(index: DataFrame, index_name: str) -> DataFrame:
    """Daily % move of one benchmark, per date."""

    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        before = df.withColumn("_before", F.lag("close").over(w))
        return before.withColumn("benchmark_pct", change_pct("close", "_before")).drop("_before")

    series = index.filter(F.col("index_name") == index_name).select("index_name", "date", "close")
    return over_series(series, 1, build, key="index_name").select("date", "benchmark_pct")
