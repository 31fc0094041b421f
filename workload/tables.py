"""Market tables derived from the given tables (see FIXTURES.md, section 3).

A trade is a line item of a brand. One pass over the line items gives one row per brand and
date; it is stored once per session and input folder in the shared folder, and the market
tables are small projections of it, as the screens are meant to run over stored bars.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from barscreen.functions.numeric import ratio, round_to
from barscreen.operators.rolling import over_series
from barscreen.operators.upsert import ORDINAL, upsert
from barscreen.plans import jobs
from barscreen.schemas import BARS, EQUITY_FEED, INDEX_FEED
from barscreen.session import new_folder, staged
from barscreen.sources.store import Store

BENCHMARK = "MARKET"
SPLIT_BRANDS = ("BRAND#1", "BRAND#13")
SPLIT_BEFORE = "1998-01-01"
BROKEN_BRAND = "BRAND#7"
UNLISTED_BRAND = "BRAND#5"

_STORED: dict[tuple[str, str, str], DataFrame | str] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame | str]):
    """Build a stored table or landing folder on first use."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    if key not in _STORED:
        built = build()
        _STORED[key] = built if isinstance(built, str) else staged(built, name)
    return _STORED[key]


def forget() -> None:
    """Build every table anew on its next use."""
    _STORED.clear()


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def brand_symbol() -> Column:
    return F.upper("p_brand")


def trades(spark: SparkSession, sf_dir: str, by: str = "brand") -> DataFrame:
    """Line items as trades of their brand, or of their supplier: those grow with the tables."""
    lines = given(spark, sf_dir, "lineitem")
    if by == "brand":
        parts = given(spark, sf_dir, "part").select("p_partkey", brand_symbol().alias("symbol"))
        lines = lines.join(parts, lines.l_partkey == parts.p_partkey)
    else:
        lines = lines.withColumn("symbol", F.concat(F.lit("SUPPLIER#"), F.col("l_suppkey").cast("string")))
    order = ("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")
    # prices have two decimals: whole cents stay exact and cheap until after the aggregate
    cents = F.floor(F.col("l_extendedprice") * 100 + 0.5)
    return lines.select(
        "symbol",
        F.col("l_shipdate").cast("date").alias("date"),
        cents.alias("px"),
        F.col("l_quantity").cast("bigint").alias("qty"),
        (F.col("l_returnflag") != "R").alias("kept"),
        F.struct(*order, "l_quantity").alias("k"),
    )


def _band(cents: Column | str) -> Column:
    """A price in cents folded into the band 1000.00 to 1049.99."""
    return (F.col(cents) if isinstance(cents, str) else cents) % 5000 + 100000


def _price(cents: Column | str, kind: str = "decimal(12,2)") -> Column:
    """Cents as a price, multiplied in decimals."""
    c = F.col(cents) if isinstance(cents, str) else cents
    return (c * F.expr("0.01BD")).cast(kind)


def daily(spark: SparkSession, sf_dir: str, by: str = "brand") -> DataFrame:
    """One row per symbol and date, with plain and folded prices: the only pass over the lines."""

    def with_lags(rows: DataFrame, w: WindowSpec) -> DataFrame:
        return rows.withColumns(
            {c: F.lag(c.removeprefix("prev_")).over(w) for c in ("prev_close", "prev_close_band")}
        )

    def build() -> DataFrame:
        per_day = (
            trades(spark, sf_dir, by)
            .groupBy("date", "symbol")  # the date decides most comparisons of the sort
            .agg(
                F.min_by("px", "k").alias("open"),
                F.max("px").alias("high"),
                F.min("px").alias("low"),
                F.max_by("px", "k").alias("close"),
                F.max(_band("px")).alias("high_band"),
                F.min(_band("px")).alias("low_band"),
                F.sum("qty").alias("volume"),
                F.sum("px").alias("value"),
                F.count("*").cast("int").alias("trades"),
                F.sum(F.when(F.col("kept"), F.col("qty")).otherwise(0)).alias("delivery_volume"),
            )
            .withColumns({"open_band": _band("open"), "close_band": _band("close")})
        )
        cents = ("open", "high", "low", "close", "prev_close")
        # ratios are rounded before they become decimals
        value = _price("value", "decimal(18,2)")
        delivered = ratio(F.col("delivery_volume") * 100, "volume")
        return over_series(per_day, 1, with_lags).withColumns(
            {
                "series": F.lit("EQ"),
                **{c: _price(c) for c in cents},
                **{f"{c}_band": _price(f"{c}_band") for c in cents},
                "value": value,
                "vwap": round_to(ratio(value, "volume")).cast("decimal(12,2)"),
                "delivery_pct": round_to(delivered).cast("decimal(6,2)"),
            }
        )

    return _once(spark, sf_dir, f"daily-{by}", build)


def bars(spark: SparkSession, sf_dir: str, by: str = "brand") -> DataFrame:
    return daily(spark, sf_dir, by).select(*BARS.names)


def adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of the second source: prices folded into a band, so no day jumps by 30 %."""
    folded = {c: F.col(f"{c}_band") for c in ("open", "high", "low", "close", "prev_close")}
    return daily(spark, sf_dir).withColumns(folded).select(*BARS.names)


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All trades of a date in symbol order; the benchmark has no Sunday rows."""

    def build() -> DataFrame:
        per_date = (
            bars(spark, sf_dir)
            .filter(F.dayofweek("date") != 1)
            .groupBy("date")
            .agg(
                F.min_by("open", "symbol").alias("open"),
                F.max("high").alias("high"),
                F.max_by("close", "symbol").alias("close"),
                F.min("low").alias("low"),
            )
        )
        return per_date.select(
            F.lit(BENCHMARK).alias("index_name"), "date", "open", "high", "close", "low"
        )

    return _once(spark, sf_dir, "index", build)


def bans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates on which less than half of a symbol's volume was delivered."""
    banned = bars(spark, sf_dir).filter(F.col("delivery_volume") * 2 < F.col("volume"))
    return banned.select(F.col("date").alias("trade_date"), "symbol")


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per brand, with metadata gaps for brands ending in 1, 2 and 3."""

    def build() -> DataFrame:
        brands = (
            given(spark, sf_dir, "part")
            .groupBy(brand_symbol().alias("symbol"))
            .agg(F.min("p_type").alias("company_name"), F.min("p_size").alias("lot_size"))
        )
        ending = F.right("symbol", F.lit(1))
        return brands.select(
            "symbol",
            "company_name",
            F.col("lot_size").cast("int").alias("lot_size"),
            F.lit(None).cast("string").alias("sector"),
            F.when(ending == "1", None)
            .when(ending == "2", "")
            .otherwise(F.col("company_name"))
            .alias("industry"),
            F.when(ending == "3", None).otherwise("DERIVATIVES").alias("segment"),
            F.lit(None).cast("timestamp").alias("last_updated"),
        )

    return _once(spark, sf_dir, "master", build)


def quality_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adjusted bars with two unadjusted splits and one symbol with broken closes.

    ``prev_close`` stays the true one.
    """
    rows = adjusted(spark, sf_dir)
    split = F.col("symbol").isin(*SPLIT_BRANDS) & (F.col("date") < F.lit(SPLIT_BEFORE).cast("date"))
    broken = (F.col("symbol") == BROKEN_BRAND) & (F.dayofmonth("date") == 13)
    doubled = {
        c: (F.col(c) * F.when(split, 2).otherwise(1)).cast("decimal(12,2)")
        for c in ("open", "high", "low", "close")
    }
    shifted = (F.col("close") + F.when(broken, 200).otherwise(0)).cast("decimal(12,2)")
    return rows.withColumns(doubled).withColumn("close", shifted)


# -- landing files ---------------------------------------------------------------------

_LAYOUTS = ("dd-MMM-yyyy", "dd-MM-yyyy", "yyyy-MM-dd", "dd MMM yyyy")


def _landing_date(c: str = "date") -> Column:
    """The four accepted layouts in turn, by day of month."""
    turn = F.dayofmonth(c) % 4
    text = F.date_format(c, _LAYOUTS[0])
    for i, layout in enumerate(_LAYOUTS[1:], start=1):
        text = F.when(turn == i, F.date_format(c, layout)).otherwise(text)
    return F.concat(F.lit(" "), text, F.lit(" "))


def _landing_text(rows: DataFrame) -> DataFrame:
    """Bars as a feed would write them: thousands commas, '-' for none, blanks around."""
    text = {
        "volume": F.format_number("volume", 0),
        "value": F.format_number("value", 2),
        "delivery_volume": F.when(F.col("delivery_volume") == 0, "-").otherwise(
            F.format_number("delivery_volume", 0)
        ),
        "trades": F.format_string("%d.0", "trades"),
        "close": F.format_string(" %s ", F.col("close").cast("string")),
        "date": _landing_date(),
    }
    cells = (
        text.get(name, F.col(name).cast("string")).alias(header)
        for header, name in EQUITY_FEED.items()
    )
    return rows.select("symbol", *cells)


def equity_landing(spark: SparkSession, sf_dir: str) -> str:
    """CSV files of all bars, plus rows of another series and rows without a usable date."""

    def build() -> str:
        text = _landing_text(bars(spark, sf_dir))
        other = text.filter(F.col("Date").rlike("^ 08-")).withColumns(
            {"Series": F.lit("BL"), "OpenPrice": F.lit("1")}
        )
        undated = text.filter(F.col("Date").rlike("^ 2000-")).withColumn("Date", F.lit("n/a"))
        path = new_folder(spark, "landing-equity")
        (
            text.unionByName(other)
            .unionByName(undated)
            .write.option("header", True)
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
            .csv(path)
        )
        return path

    return _once(spark, sf_dir, "landing-equity", build)


def mixed_landing(spark: SparkSession, sf_dir: str) -> str:
    """The landed bars in files of three layouts: as they are, reversed, without a series."""

    def build() -> str:
        text = spark.read.option("header", True).csv(equity_landing(spark, sf_dir))
        plain = (F.col("Series") == "EQ") & (F.col("Date") != "n/a")
        part = F.when(plain, F.pmod(F.xxhash64("symbol"), F.lit(3))).otherwise(0)
        names = text.columns
        layouts = (names, names[::-1], [c for c in names if c != "Series"])
        path = new_folder(spark, "landing-mixed")
        for i, columns in enumerate(layouts):
            rows = text.filter(part == i).select(*[F.col(f"`{c}`") for c in columns])
            rows.write.mode("append").option("header", True).csv(path)
        return path

    return _once(spark, sf_dir, "landing-mixed", build)


def index_landing(spark: SparkSession, sf_dir: str) -> str:
    def build() -> str:
        cells = (
            (_landing_date() if name == "date" else F.format_number(name, 2)).alias(header)
            for header, name in INDEX_FEED.items()
        )
        path = new_folder(spark, "landing-index")
        index(spark, sf_dir).select("index_name", *cells).write.option("header", True).csv(path)
        return path

    return _once(spark, sf_dir, "landing-index", build)


def adjusted_landing(spark: SparkSession, sf_dir: str) -> str:
    """The second source: stocks by suffixed ticker and the benchmark, zoned timestamps."""

    def build() -> str:
        stocks = adjusted(spark, sf_dir).select(
            F.concat("symbol", F.lit(".NS")).alias("ticker"), *_adjusted_cells("volume")
        )
        market = index(spark, sf_dir).select(F.lit("^NSEI").alias("ticker"), *_adjusted_cells(None))
        path = new_folder(spark, "landing-adjusted")
        stocks.unionByName(market).write.option("header", True).csv(path)
        return path

    return _once(spark, sf_dir, "landing-adjusted", build)


def _adjusted_cells(volume: str | None) -> list[Column]:
    return [
        F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit(" 00:00:00+05:30")).alias("Date"),
        *(F.col(c).cast("string").alias(c.capitalize()) for c in ("open", "high", "low", "close")),
        (F.col(volume).cast("string") if volume else F.lit("0")).alias("Volume"),
    ]


def dirty_adjusted_landing(spark: SparkSession, sf_dir: str) -> str:
    """The second source with unusable dates on the 7th and prices out of range on the 9th."""

    def build() -> str:
        text = spark.read.option("header", True).csv(adjusted_landing(spark, sf_dir))
        day = F.substring("Date", 9, 2)
        path = new_folder(spark, "landing-dirty")
        dirty = text.withColumns(
            {
                "Close": F.when(day == "09", "1e30").otherwise(F.col("Close")),
                "Date": F.when(day == "07", "n/a").otherwise(F.col("Date")),
            }
        )
        dirty.write.option("header", True).csv(path)
        return path

    return _once(spark, sf_dir, "landing-dirty", build)


def metadata_landing(spark: SparkSession, sf_dir: str) -> str:
    """JSON lines with nested info; some brands know nothing, some only one field."""

    def build() -> str:
        brands = given(spark, sf_dir, "part").groupBy(brand_symbol().alias("symbol")).agg(
            F.max("p_type").alias("kind")
        )
        info = F.when(F.col("symbol") == "BRAND#11", F.struct(
            F.lit("").alias("industry"), F.lit("").alias("segment")
        )).when(F.col("symbol") == "BRAND#12", F.struct(
            F.lit("").alias("industry"), F.lit("CASH").alias("segment")
        )).otherwise(F.struct(
            F.col("kind").alias("industry"), F.lit(None).cast("string").alias("segment")
        ))
        path = new_folder(spark, "landing-metadata")
        brands.select("symbol", info.alias("info")).write.json(path)
        return path

    return _once(spark, sf_dir, "landing-metadata", build)


def ban_landing(spark: SparkSession, sf_dir: str) -> str:
    """JSON lines, one list per day (at most one entry per symbol)."""

    def build() -> str:
        lists = bans(spark, sf_dir).groupBy("trade_date").agg(
            F.collect_list("symbol").alias("symbols")
        )
        path = new_folder(spark, "landing-bans")
        lists.withColumn("trade_date", F.date_format("trade_date", "dd-MM-yyyy")).write.json(path)
        return path

    return _once(spark, sf_dir, "landing-bans", build)


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instrument entries from purchase events: user as symbol, payload number as lot size."""
    events = given(spark, sf_dir, "events")
    return events.select(
        F.when(F.col("event_type") == "purchase", "NFO").otherwise("NSE").alias("exch_seg"),
        F.lit("FUTSTK").alias("instrumenttype"),
        F.concat(F.lit(" "), F.col("user_id").cast("string")).alias("name"),
        F.from_json("props", "k string")["k"].alias("lotsize"),
        F.col("event_id").alias(ORDINAL),
    )


def part_instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instrument entries from parts: brand as symbol, size as lot size.

    Promo parts and those of one brand are no futures, so that brand has no lot size.
    """
    part = given(spark, sf_dir, "part")
    other = (F.col("p_type") == "PROMO") | (brand_symbol() == UNLISTED_BRAND)
    return part.select(
        F.lit("NFO").alias("exch_seg"),
        F.when(other, "OPTSTK").otherwise("FUTSTK").alias("instrumenttype"),
        brand_symbol().alias("name"),
        F.col("p_size").cast("string").alias("lotsize"),
        F.col("p_partkey").alias(ORDINAL),
    )


def master_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partial master load: name and lot size of every brand but the unlisted one."""
    part = given(spark, sf_dir, "part").filter(brand_symbol() != UNLISTED_BRAND)
    return part.groupBy(brand_symbol().alias("symbol")).agg(
        F.max("p_name").alias("company_name"), F.max("p_size").cast("int").alias("lot_size")
    )


# -- stores ------------------------------------------------------------------------------


def eligible_landing(spark: SparkSession, sf_dir: str) -> str:
    """The list of eligible symbols: every brand but one."""

    def build() -> str:
        path = new_folder(spark, "landing-eligible")
        listed = master_batch(spark, sf_dir).select("symbol", F.col("company_name").alias("Underlying"))
        listed.write.option("header", True).csv(path)
        return path

    return _once(spark, sf_dir, "landing-eligible", build)


def mixed_eligible_landing(spark: SparkSession, sf_dir: str) -> str:
    """The list of eligible symbols in files of two layouts: other names, other column order."""

    def build() -> str:
        path = new_folder(spark, "landing-eligible-mixed")
        listed = master_batch(spark, sf_dir)
        odd = F.crc32(F.col("symbol").cast("binary")) % 2 == 1
        listed.filter(~odd).select("symbol", F.col("company_name").alias("Underlying")).write.option(
            "header", True
        ).csv(path)
        listed.filter(odd).select(F.col("company_name").alias("Company Name"), F.col("symbol").alias("Symbol")).write.option(
            "header", True
        ).mode("append").csv(path)
        return path

    return _once(spark, sf_dir, "landing-eligible-mixed", build)


def market_store(spark: SparkSession, sf_dir: str) -> Store:
    """All market tables in a store."""

    def build() -> str:
        store = Store(spark, new_folder(spark, "store"))
        jobs.store_series(store, "daily_ohlcv", bars(spark, sf_dir))
        jobs.store_series(store, "index_ohlcv", index(spark, sf_dir))
        jobs.store_bans(store, bans(spark, sf_dir))
        store.apply("fno_stocks", master(spark, sf_dir), lambda old, new: upsert(old, new, ["symbol"]))
        return store.root

    return Store(spark, _once(spark, sf_dir, "store", build))


def collected(
    spark: SparkSession, sf_dir: str, start: dt.date, middle: dt.date, end: dt.date
) -> tuple[Store, DataFrame]:
    """A store filled by two collections, up to ``middle`` and ``end``, and the second report."""

    def build() -> str:
        store = Store(spark, new_folder(spark, "collected"))
        landing = jobs.Landing(
            store.path("no-other-feeds"),
            eligible=eligible_landing(spark, sf_dir),
            equity=equity_landing(spark, sf_dir),
            index=index_landing(spark, sf_dir),
            bans=ban_landing(spark, sf_dir),
        )
        for today in (middle, end):
            report = jobs.collect_all(spark, landing, store, start, today)
        counts = spark.createDataFrame(list(report.rows.items()), "step string, n_rows bigint")
        counts.write.parquet(store.path("_report"))
        return store.root

    store = Store(spark, _once(spark, sf_dir, f"collected-{start}-{middle}-{end}", build))
    return store, spark.read.parquet(store.path("_report"))
