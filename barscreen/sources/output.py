"""Result serialisation for API clients."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names that do not follow from the camel-case rule.
SPECIAL_NAMES = {"pct_1y": "pct1Y", "pct_1m": "pct1M"}


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return SPECIAL_NAMES.get(name, head + "".join(part.capitalize() for part in rest))


def to_api_records(df: DataFrame) -> DataFrame:
    """Camel-case names, prices and amounts as doubles, dates as text, NULL kept."""
    columns = []
    for f in df.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, T.NumericType) and not isinstance(f.dataType, T.IntegerType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.DateType, T.TimestampType)):
            c = c.cast("string")
        elif isinstance(f.dataType, T.ArrayType):
            c = c.cast("array<double>")
        columns.append(c.alias(camel(f.name)))
    return df.select(*columns)


def to_json_lines(df: DataFrame) -> DataFrame:
    """One JSON object per row, missing values written as null."""
    record = F.struct(*to_api_records(df).columns)
    options = {"ignoreNullFields": "false"}
    return to_api_records(df).select(F.to_json(record, options).alias("value"))
