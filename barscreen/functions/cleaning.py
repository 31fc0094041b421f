"""Text-to-typed cleaning of raw feeds; built-in expressions only."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import col

# Accepted date layouts, tried in this order, and the shape of each.
DATE_FORMATS = {
    "d-MMM-yyyy": r"^\d{1,2}-[A-Za-z]{3}-\d{4}$",
    "d-M-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$",
    "yyyy-M-d": r"^\d{4}-\d{1,2}-\d{1,2}$",
    "d MMM yyyy": r"^\d{1,2} [A-Za-z]{3} \d{4}$",
    "yyyy/M/d": r"^\d{4}/\d{1,2}/\d{1,2}$",
}
# a timestamp: its first ten characters are the date
TIMESTAMP_SHAPE = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?$"


def quoted(name: str) -> Column:
    """A column whose name may hold dots or percent signs."""
    return F.col(f"`{name}`")


def clean_header(name: str) -> str:
    """Drop a byte-order mark, quotes and outer blanks (B1)."""
    return name.replace("\ufeff", "").replace('"', "").strip()


def snake_header(name: str) -> str:
    """Trimmed lower case with underscores (B2)."""
    return clean_header(name).lower().replace(" ", "_")


def rename_headers(df: DataFrame, cleaner: Callable[[str], str] = clean_header) -> DataFrame:
    return df.select(*(quoted(c).alias(cleaner(c)) for c in df.columns))


def first_present(df: DataFrame, names: Sequence[str], default: str = "") -> Column:
    """The first of ``names`` that exists as a column; its cells are kept as they are."""
    for name in names:
        if name in df.columns:
            return quoted(name)
    return F.lit(default)


def parse_date(c: Column | str) -> Column:
    """First matching layout wins, NULL when none does.

    Each text is parsed once, by the layout it has the shape of: failed parses are slow.
    """
    text = F.trim(col(c).cast("string"))
    parsed = None
    for layout, shape in DATE_FORMATS.items():
        date = F.try_to_date(text, layout)
        parsed = (F if parsed is None else parsed).when(text.rlike(shape), date)
    moment = F.try_to_date(F.left(text, F.lit(10)), "yyyy-MM-dd")
    return parsed.when(text.rlike(TIMESTAMP_SHAPE), moment)


def _digits(c: Column | str) -> Column:
    """Text of a number without thousands marks; '-' and other junk fail the cast after it."""
    return F.trim(F.replace(col(c).cast("string"), F.lit(","), F.lit("")))


def _or_fallback(c: Column, kind, on_bad: str) -> Column:
    if on_bad not in ("zero", "null"):
        raise ValueError(f"on_bad must be 'zero' or 'null', not {on_bad!r}")
    return F.coalesce(c, F.lit(0).cast(kind)) if on_bad == "zero" else c


def clean_double(c: Column | str, on_bad: str = "zero") -> Column:
    """Text to double; unusable cells become 0 or NULL."""
    number = F.nanvl(_digits(c).try_cast("double"), F.lit(None).cast("double"))
    return _or_fallback(number, "double", on_bad)


def clean_long(c: Column | str, on_bad: str = "zero") -> Column:
    """Text to bigint, fraction cut off towards zero."""
    whole = _digits(c).try_cast("decimal(38,18)").try_cast("bigint")
    return _or_fallback(whole, "bigint", on_bad)


def clean_decimal(c: Column | str, kind, on_bad: str = "zero") -> Column:
    """Text to a stored decimal; a value too large for it counts as unusable."""
    return _or_fallback(_digits(c).try_cast(kind), kind, on_bad)
