"""Readers for landed feed files, and their cleaning into table rows.

Every reader adds ``_ordinal``, the position of a row in its feed (file time, file, block,
row), because the row that comes last wins when a key occurs twice.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cleaning import (
    clean_decimal,
    clean_long,
    first_present,
    parse_date,
    quoted,
    rename_headers,
    snake_header,
)
from ..operators.upsert import ORDINAL, last_per_key
from ..schemas import ADJUSTED_FEED, BARS, EQUITY_FEED, INDEX_BARS, INDEX_FEED, raw_schema

# Benchmark name -> ticker in the adjusted feed; the default comes first.
INDEX_TICKERS = {"NIFTY 50": "^NSEI", "NIFTY BANK": "^NSEBANK"}
DEFAULT_TICKER = "^NSEI"
# Suffix of a symbol's ticker, time zone of the feed, test symbols to leave out.
TICKER_SUFFIX = ".NS"
FEED_ZONE = "Asia/Kolkata"
TEST_SUFFIX = "NSETEST"

OTHER_SERIES = "_other_series"
# Look-back per period name.
PERIODS = {
    "1D": dt.timedelta(days=1),
    "1W": dt.timedelta(days=7),
    "1M": dt.timedelta(days=30),
    "3M": dt.timedelta(days=91),
    "6M": dt.timedelta(days=182),
    "1Y": dt.timedelta(days=365),
}


def with_block(df: DataFrame) -> DataFrame:
    """Add the file block each row comes from; also works on a stream."""
    block = F.struct(
        F.col("_metadata.file_modification_time").alias("file_time"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
    )
    return df.select("*", block.alias(ORDINAL))


def number_rows(df: DataFrame) -> DataFrame:
    """Complete the feed position: rows of a block are read in order by one task."""
    row = F.monotonically_increasing_id()
    return df.withColumn(ORDINAL, F.struct(F.col(ORDINAL).alias("block"), row.alias("row")))


def with_ordinal(df: DataFrame) -> DataFrame:
    return number_rows(with_block(df))


def file_stem() -> Column:
    """File name up to its first dot: feeds may name their symbol only there."""
    # the name comes percent-encoded, a plus sign stands for itself
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    return F.split(name, r"\.")[0]


def _files_by_header(spark: SparkSession, path: str | list[str]) -> list[list[str]]:
    """The files of a feed folder, those with the same header line together.

    One short text per file comes to the driver, which lists the files anyway.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("value"),
    )
    first = lines.filter("start = 0").withColumn("row", F.monotonically_increasing_id())
    headers = first.groupBy("file").agg(F.min_by("value", "row").alias("header")).collect()
    groups: dict[str, list[str]] = {}
    for row in sorted(headers):
        groups.setdefault(row["header"], []).append(unquote(row["file"]))
    return list(groups.values())


def _named_csv(
    spark: SparkSession, path: str | list[str], name_column: str, defaults: dict[str, str] | None = None
) -> DataFrame:
    """CSV as text with clean headers; the series name comes from a column or the file name.

    Spark takes one header for all files of a read, so files are read by their headers. A
    column of ``defaults`` that a file lacks gets its default.
    """

    def named(raw: DataFrame) -> DataFrame:
        clean = rename_headers(with_ordinal(raw.withColumn("_stem", file_stem())))
        name = first_present(clean, (name_column, name_column.capitalize(), "_stem"))
        missing = {c: F.lit(v) for c, v in (defaults or {}).items() if c not in clean.columns}
        return clean.withColumn(name_column, name).drop("_stem").withColumns(missing)

    reader = spark.read.option("header", True)
    groups = _files_by_header(spark, path)
    if not groups:
        return named(reader.csv(path))
    parts = [named(reader.csv(files)) for files in groups]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_equity(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw daily bars (A1, B1); a file without a series column holds ordinary shares."""
    return _named_csv(spark, path, "symbol", {"Series": "EQ"})


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Raw benchmark bars (A4)."""
    return _named_csv(spark, path, "index_name")


def period_start(period: str, today: dt.date) -> dt.date:
    """First date of a named period (A1, A4)."""
    return today - PERIODS[period]


def between(df: DataFrame, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """Rows within an inclusive date range; an open end means today (A1)."""
    if start is not None:
        df = df.filter(F.col("date") >= F.lit(start))
    return df.filter(F.col("date") <= (F.lit(end) if end is not None else F.current_date()))


def _whole(cell: Column, kind: T.DataType, on_bad: str) -> Column:
    """An integer of the stored type; one that is too large for it is unusable as well."""
    value = clean_long(cell, on_bad).try_cast(kind)
    return F.coalesce(value, F.lit(0).cast(kind)) if on_bad == "zero" else value


def _parsed(raw: DataFrame, feed: dict[str, str], schema: T.StructType, on_bad: str) -> DataFrame:
    """Rename and convert the feed's columns to their stored types."""
    types = {f.name: f.dataType for f in schema}
    columns = []
    for header, name in feed.items():
        cell = quoted(header) if header in raw.columns else F.lit(None).cast("string")
        kind = types[name]
        if isinstance(kind, T.DateType):
            value = parse_date(cell)
        elif isinstance(kind, T.DecimalType):
            value = clean_decimal(cell, kind, on_bad)
        elif isinstance(kind, (T.LongType, T.IntegerType)):
            value = _whole(cell, kind, on_bad)
        else:
            # a feed without a series column holds ordinary shares only
            value = F.trim(cell if header in raw.columns else F.lit("EQ"))
        columns.append(value.alias(name))
    kept = ("symbol", "index_name", "ticker", OTHER_SERIES, ORDINAL)
    return raw.select(*(c for c in kept if c in raw.columns), *columns)


def flagged_equity(raw: DataFrame, on_bad: str = "zero") -> DataFrame:
    """Typed bars of every raw row, those of another series marked, undated ones kept."""
    other = ~F.coalesce(F.col("Series") == "EQ", F.lit(False)) if "Series" in raw.columns else F.lit(False)
    parsed = _parsed(raw.withColumn(OTHER_SERIES, other), EQUITY_FEED, BARS, on_bad)
    return parsed.select(*BARS.names, OTHER_SERIES, *(c for c in (ORDINAL,) if c in parsed.columns))


def clean_equity(raw: DataFrame, on_bad: str = "zero") -> DataFrame:
    """Typed bars of the ordinary share series, rows without a date left out."""
    if "Series" in raw.columns:
        raw = raw.filter(F.col("Series") == "EQ")
    parsed = _parsed(raw, EQUITY_FEED, BARS, on_bad).filter(F.col("date").isNotNull())
    return parsed.select(*BARS.names, *(c for c in (ORDINAL,) if c in parsed.columns))


def clean_index(raw: DataFrame, on_bad: str = "zero") -> DataFrame:
    """Typed benchmark bars."""
    parsed = _parsed(raw, INDEX_FEED, INDEX_BARS, on_bad).filter(F.col("date").isNotNull())
    return parsed.select(*INDEX_BARS.names, *(c for c in (ORDINAL,) if c in parsed.columns))


def quarantine(raw: DataFrame, date_header: str = "Date") -> DataFrame:
    """Raw rows whose date no layout fits, for inspection."""
    if date_header not in raw.columns:
        return raw
    return raw.filter(parse_date(quoted(date_header)).isNull())


def bad_cells(
    raw: DataFrame, feed: dict[str, str] = EQUITY_FEED, schema: T.StructType = BARS
) -> DataFrame:
    """Number of cells per numeric column that cleaning can't use, one pass."""
    numeric = [h for h, name in feed.items() if h in raw.columns and name not in ("date", "series")]
    types = {f.name: f.dataType for f in schema}

    def unusable(header: str) -> Column:
        kind, cell = types[feed[header]], quoted(header)
        if isinstance(kind, T.DecimalType):
            return clean_decimal(cell, kind, "null").isNull()
        return _whole(cell, kind, "null").isNull()

    counts = raw.agg(*(F.count_if(unusable(h)).alias(feed[h]) for h in numeric))
    return counts.unpivot([], [feed[h] for h in numeric], "column_name", "bad_cells")


def local_date(ts: Column | str, zone: str = FEED_ZONE) -> Column:
    """Calendar date of an instant in the feed's time zone, whatever the session zone is."""
    instant = F.col(ts) if isinstance(ts, str) else ts  # no instant: no date
    return F.to_date(
        F.convert_timezone(None, F.lit(zone), instant.try_cast("timestamp").cast("timestamp_ntz"))
    )


def read_adjusted(spark: SparkSession, path: str) -> DataFrame:
    """Adjusted bars of the second source, keyed by ticker."""
    raw = _named_csv(spark, path, "ticker")
    return raw.select(
        "ticker",
        ORDINAL,
        local_date("Date").alias("date"),
        *(
            quoted(header).try_cast("double").alias(name)
            for header, name in ADJUSTED_FEED.items()
            if name not in ("date", "volume")
        ),
        quoted("Volume").try_cast("double").try_cast("bigint").alias("volume"),
    )


def adjusted_bars(feed: DataFrame, start: dt.date | None = None) -> DataFrame:
    """Adjusted bars of stocks: tickers carry a market suffix (A2)."""
    stocks = feed.filter(F.endswith("ticker", F.lit(TICKER_SUFFIX)))
    symbol = F.expr(f"left(ticker, length(ticker) - {len(TICKER_SUFFIX)})")
    bars = stocks.withColumn("symbol", symbol).drop("ticker")
    return bars if start is None else bars.filter(F.col("date") >= F.lit(start))


def index_ticker(index_name: Column | str) -> Column:
    """Ticker of a benchmark name, the main benchmark's for unknown names (A3)."""
    pairs = [F.lit(x) for pair in INDEX_TICKERS.items() for x in pair]
    name = F.col(index_name) if isinstance(index_name, str) else index_name
    return F.coalesce(F.create_map(*pairs)[name], F.lit(DEFAULT_TICKER))


def adjusted_index(
    feed: DataFrame, index_name: str, start: dt.date | None = None
) -> DataFrame:
    """Adjusted bars of one benchmark in the raw index layout, dates as text (A3)."""
    rows = feed.filter(F.col("ticker") == INDEX_TICKERS.get(index_name, DEFAULT_TICKER))
    if start is not None:
        rows = rows.filter(F.col("date") >= F.lit(start))
    kept = [ORDINAL] if ORDINAL in feed.columns else []
    return rows.select(
        F.lit(index_name).alias("index_name"),
        *kept,
        F.date_format("date", "dd-MMM-yyyy").alias("TIMESTAMP"),
        *(
            F.col(name).cast("string").alias(header)
            for header, name in INDEX_FEED.items()
            if name != "date"
        ),
    )


INSTRUMENTS = raw_schema("exch_seg", "instrumenttype", "name", "lotsize")


def read_instruments(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Instrument objects: one JSON array per file, or one object per line (A5)."""
    reader = spark.read.schema(INSTRUMENTS).option("multiLine", multi_line)
    return with_ordinal(reader.json(path))


def lot_sizes(instruments: DataFrame) -> DataFrame:
    """Lot size per symbol from stock futures, the last entry wins."""
    name = F.coalesce("name", F.lit(""))
    futures = instruments.filter(
        (F.col("exch_seg") == "NFO")
        & (F.col("instrumenttype") == "FUTSTK")
        & ~F.endswith(name, F.lit(TEST_SUFFIX))
    )
    sized = futures.select(
        F.trim(name).alias("symbol"),
        F.col("lotsize").try_cast("int").alias("lot_size"),
        ORDINAL,
    ).filter((F.col("symbol") != "") & (F.col("lot_size") > 0))
    return last_per_key(sized, ["symbol"])


def read_eligible(spark: SparkSession, path: str) -> DataFrame:
    """Eligible symbols with company names under any of their known headers.

    Files are read by their header line, each group under its own names, so files whose
    columns differ in name or order are all read right.
    """
    reader = spark.read.option("header", True)
    groups = _files_by_header(spark, path) or [path]
    parts = [eligible_stocks(rename_headers(with_ordinal(reader.csv(files)), snake_header)) for files in groups]
    return reduce(lambda a, b: a.unionByName(b), parts)


def eligible_stocks(listed: DataFrame) -> DataFrame:
    company = first_present(listed, ("underlying", "company_name", "companyname"))
    kept = [ORDINAL] if ORDINAL in listed.columns else []
    return listed.select(
        F.trim(first_present(listed, ("symbol", "Symbol"))).alias("symbol"),
        F.trim(company).alias("company_name"),
        *kept,
    ).filter(F.col("symbol") != "")


def master_rows(eligible: DataFrame, lots: DataFrame) -> DataFrame:
    """Eligible symbols with their lot size, 0 if unknown."""
    joined = eligible.join(lots.select("symbol", "lot_size"), "symbol", "left")
    return joined.withColumn("lot_size", F.coalesce("lot_size", F.lit(0)))


BAN_LISTS = T.StructType(
    [
        T.StructField("trade_date", T.StringType()),
        T.StructField("symbols", T.ArrayType(T.StringType())),
    ]
)


def read_bans(spark: SparkSession, path: str) -> DataFrame:
    """Ban lists, one JSON object per day."""
    return ban_rows(spark.read.schema(BAN_LISTS).json(path))


def ban_rows(lists: DataFrame, trade_date: dt.date | None = None) -> DataFrame:
    """One row per banned symbol; a list with a malformed date gives none."""
    rows = lists.select(
        F.try_to_date("trade_date", "d-M-yyyy").alias("trade_date"),
        F.explode("symbols").alias("symbol"),
    ).filter(F.col("trade_date").isNotNull())
    return rows if trade_date is None else rows.filter(F.col("trade_date") == F.lit(trade_date))


METADATA = "symbol string, info struct<industry:string,segment:string>"


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Metadata objects, one per line, '' where a field is missing."""
    raw = with_ordinal(spark.read.schema(METADATA).json(path))
    return metadata_rows(raw)


def metadata_rows(raw: DataFrame) -> DataFrame:
    """A line without a symbol (malformed, or none given) names no stock and is left out."""
    kept = [ORDINAL] if ORDINAL in raw.columns else []
    return raw.filter(F.trim("symbol") != "").select(
        "symbol",
        F.coalesce("info.industry", F.lit("")).alias("industry"),
        F.coalesce("info.segment", F.lit("")).alias("segment"),
        *kept,
    )


def read_json_map(spark: SparkSession, path: str, value_type: str = "string") -> DataFrame:
    """Files that each hold one JSON object used as a map, as (key, value) rows."""
    return json_map_rows(spark.read.text(path, wholetext=True), value_type)


def json_map_rows(text: DataFrame, value_type: str = "string") -> DataFrame:
    """Entries of the JSON objects in ``value``."""
    entries = F.from_json("value", f"map<string,{value_type}>")
    return text.select(F.explode(entries).alias("key", "value"))
