"""Numeric rules shared by screens and metrics.

Prices are two-digit decimals. Differences stay exact decimals; ratios and means are
doubles, so that a result never depends on decimal scale rules.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def double(c: Column | str) -> Column:
    return col(c).cast("double")


def round_to(c: Column | str, digits: int = 2) -> Column:
    """Round the double itself half away from zero (not its decimal text, as ``F.round``)."""
    x, scale = double(c), float(10**digits)
    rounded = F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale
    # beyond 1e15 a double has no two decimals left, and floor() would leave bigint
    return F.when(F.abs(x) < 1e15, rounded).otherwise(x)


def ratio(num: Column | str, den: Column | str) -> Column:
    """Division on doubles; a zero denominator gives NULL."""
    return F.try_divide(double(num), double(den))


def mean_price(c: Column | str) -> Column:
    """Mean of two-digit decimals in a group: an integer sum of cents, divided once."""
    total, n = F.sum((col(c) * 100).cast("bigint")), F.count(col(c))
    return F.try_divide(total.cast("double"), (n * 100).cast("double"))


def change_pct(now: Column | str, base: Column | str) -> Column:
    """Unrounded percentage move from ``base`` (B12, B14); NULL when the base is 0."""
    return ratio(col(now) - col(base), base) * 100


def guarded_change_pct(now: Column | str, base: Column | str) -> Column:
    """As ``change_pct``, but 0 unless the base is positive."""
    return F.when(col(base) > 0, change_pct(now, base)).otherwise(0.0)


def pct_return(now: Column | str, anchor: Column | str) -> Column:
    """Rounded return against a positive anchor price, else NULL."""
    return F.when(col(anchor) > 0, round_to(change_pct(now, anchor)))


def true_range(high: Column | str, low: Column | str, prev: Column | str) -> Column:
    """Largest of the day's range and its gaps from the previous close."""
    h, l, p = col(high), col(low), col(prev)
    return F.greatest(h - l, F.abs(h - p), F.abs(l - p))


def close_location(high: Column | str, low: Column | str, close: Column | str) -> Column:
    """Position of the close in the day's range, 0.5 on a flat day."""
    h, l, c = col(high), col(low), col(close)
    return F.when(h > l, ratio(c - l, h - l)).otherwise(0.5)


def multiple(amount: Column | str, mean: Column | str) -> Column:
    """How many times its mean an amount is."""
    return round_to(ratio(amount, mean))


def breakout_strength(move: Column, atr: Column, amount: Column, mean: Column) -> Column:
    """Grade a breakout by its size against ATR and its volume against the mean."""
    big = double(move) > atr
    return (
        F.when(big & (amount > mean * 1.5), "Full")
        .when(big, "Partial (Low Volume)")
        .otherwise("Partial (Small Size)")
    )
