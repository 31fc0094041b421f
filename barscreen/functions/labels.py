"""Display classes and texts derived from metric columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col, double, round_to

# Upper bounds of heat levels 1 to 4; level 5 is open.
HEAT_BOUNDS = (5, 15, 30, 50)
# Volume units, largest first.
VOLUME_UNITS = ((10_000_000, "Cr"), (100_000, "L"), (1_000, "K"))
STRONG, WEAK = 5, -5


def change_class(c: Column | str) -> Column:
    """'positive', 'negative' or 'neutral'; NULL is neutral."""
    x = col(c)
    return F.when(x > 0, "positive").when(x < 0, "negative").otherwise("neutral")


heat_sign = change_class


def heat_level(c: Column | str) -> Column:
    """Intensity 1 to 5 by absolute value, 0 for zero or NULL."""
    x = F.abs(col(c))
    level = F.when(x.isNull() | (x == 0), 0)
    for i, bound in enumerate(HEAT_BOUNDS, start=1):
        level = level.when(x < bound, i)
    return level.otherwise(len(HEAT_BOUNDS) + 1)


def relative_strength_class(c: Column | str) -> Column:
    """Stronger or weaker than the benchmark by more than five points."""
    x = col(c)
    return F.when(x > STRONG, "strong").when(x < WEAK, "weak").otherwise("neutral")


def sparkline_trend(prices: Column | str) -> Column:
    """Last against first price; 'none' below two points."""
    p = col(prices)
    first, last = F.element_at(p, 1), F.element_at(p, -1)
    return F.when(
        F.coalesce(F.size(p), F.lit(0)) >= 2,
        F.when(last > first, "positive").when(last < first, "negative").otherwise("neutral"),
    ).otherwise("none")


def sparkline_scaled(prices: Column | str) -> Column:
    """Prices on [0, 1]; a flat line divides by 1, so it stays at 0."""
    p = col(prices).cast("array<double>")
    low, high = F.array_min(p), F.array_max(p)
    span = F.when(high == low, 1.0).otherwise(high - low)
    # the one-element outer array binds low and span once per line, not once per point
    bounds = F.array(F.struct(low.alias("low"), span.alias("span")))
    return F.transform(
        bounds, lambda b: F.transform(p, lambda x: (x - b["low"]) / b["span"])
    )[0]


def volume_text(c: Column | str) -> Column:
    """Volume with its unit, two decimals."""
    x, out = col(c), None
    for size, unit in VOLUME_UNITS:
        text = F.format_string(f"%.2f {unit}", round_to(double(x) / size))
        out = F.when(x >= size, text) if out is None else out.when(x >= size, text)
    return out.otherwise(x.cast("string"))


def strength_class(c: Column | str) -> Column:
    """First word of a strength label in lower case; none for 'N/A' (B34)."""
    x = col(c)
    return F.when(x.isNotNull() & (x != "N/A") & (x != ""), F.lower(F.split(x, " ")[0]))
