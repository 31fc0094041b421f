"""Fixed table schemas, keys and raw feed layouts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

PRICE = T.DecimalType(12, 2)
MONEY = T.DecimalType(18, 2)
PERCENT = T.DecimalType(6, 2)


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


STOCKS = _schema(
    ("symbol", T.StringType()),
    ("company_name", T.StringType()),
    ("lot_size", T.IntegerType()),
    ("sector", T.StringType()),
    ("industry", T.StringType()),
    ("segment", T.StringType()),
    ("last_updated", T.TimestampType()),
)

BARS = _schema(
    ("symbol", T.StringType()),
    ("date", T.DateType()),
    ("series", T.StringType()),
    ("open", PRICE),
    ("high", PRICE),
    ("low", PRICE),
    ("close", PRICE),
    ("prev_close", PRICE),
    ("volume", T.LongType()),
    ("value", MONEY),
    ("vwap", PRICE),
    ("trades", T.IntegerType()),
    ("delivery_volume", T.LongType()),
    ("delivery_pct", PERCENT),
)

INDEX_BARS = _schema(
    ("index_name", T.StringType()),
    ("date", T.DateType()),
    ("open", PRICE),
    ("high", PRICE),
    ("close", PRICE),
    ("low", PRICE),
)

BANS = _schema(
    ("trade_date", T.DateType()),
    ("symbol", T.StringType()),
    ("created_at", T.TimestampType()),
)


@dataclass(frozen=True)
class Table:
    """A stored table: its schema, unique key and (for time series) its date column."""

    name: str
    schema: T.StructType
    keys: tuple[str, ...]
    date_column: str | None = None


TABLES = {
    table.name: table
    for table in (
        Table("fno_stocks", STOCKS, ("symbol",)),
        Table("daily_ohlcv", BARS, ("symbol", "date"), "date"),
        Table("index_ohlcv", INDEX_BARS, ("index_name", "date"), "date"),
        Table("fno_ban_period", BANS, ("trade_date", "symbol"), "trade_date"),
    )
}

# Raw header -> stored column, in feed order.
EQUITY_FEED = {
    "Date": "date",
    "Series": "series",
    "OpenPrice": "open",
    "HighPrice": "high",
    "LowPrice": "low",
    "ClosePrice": "close",
    "PrevClose": "prev_close",
    "TotalTradedQuantity": "volume",
    "TurnoverInRs": "value",
    "AveragePrice": "vwap",
    "No.ofTrades": "trades",
    "DeliverableQty": "delivery_volume",
    "%DlyQttoTradedQty": "delivery_pct",
}
INDEX_FEED = {
    "TIMESTAMP": "date",
    "OPEN_INDEX_VAL": "open",
    "HIGH_INDEX_VAL": "high",
    "LOW_INDEX_VAL": "low",
    "CLOSE_INDEX_VAL": "close",
}
ADJUSTED_FEED = {
    "Date": "date",
    "Open": "open",
    "High": "high",
    "Low": "low",
    "Close": "close",
    "Volume": "volume",
}


def raw_schema(*headers: str) -> T.StructType:
    """Landing layout: every cell is text until it has been cleaned."""
    return _schema(*((header, T.StringType()) for header in headers))
