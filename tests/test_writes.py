"""Keyed writes, the table store and the collection jobs."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from barscreen import session
from barscreen.operators import lookups
from barscreen.operators.upsert import (
    ORDINAL,
    insert_ignore,
    keyed_update,
    last_per_key,
    metadata_gaps,
    update_metadata,
    upsert,
    upsert_partial,
)
from barscreen.plans import jobs, stored
from barscreen.sources import readers
from barscreen.sources.store import Store
from barscreen.streaming import stream_collect
from conftest import day, series

HEADER = (
    "symbol,Date,Series,OpenPrice,HighPrice,LowPrice,ClosePrice,PrevClose,TotalTradedQuantity,"
    "TurnoverInRs,AveragePrice,No.ofTrades,DeliverableQty,%DlyQttoTradedQty\n"
)


def line(symbol, date, close, kind="EQ", volume='"1,200,000"'):
    return (
        f"{symbol},{date},{kind},{close},{close + 5},{close - 5},{close},{close},{volume},"
        f"120000000.00,101.50,6000,600000,50.00\n"
    )


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def landed(tmp_path, feed, files):
    folder = tmp_path / "landing" / feed
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in files.items():
        (folder / name).write_text(text)
    return str(folder)


def pairs(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_last_row_of_a_batch_wins(spark):
    rows = spark.createDataFrame(
        [("A", 1, 10), ("A", 3, 30), ("A", 2, 20), ("B", 1, None)],
        f"symbol string, {ORDINAL} int, x int",
    )
    assert pairs(last_per_key(rows, ["symbol"]), "symbol", "x") == [("A", 30), ("B", None)]


def test_copies_of_one_key_are_combined_before_the_shuffle(spark):
    rows = spark.range(0, 3000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"),
        F.col("id").alias("x"), F.col("id").alias(ORDINAL),
    )
    kept = last_per_key(rows, ["k"])
    assert kept.filter("k = -1").collect()[0].x == 2997
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan


def test_without_an_ordinal_the_largest_row_wins(spark):
    rows = [("A", 1, None), ("A", 3, 1), ("A", 3, 2), ("B", None, None)]
    for order in (rows, rows[::-1]):
        kept = last_per_key(spark.createDataFrame(order, "symbol string, x int, y int"), ["symbol"])
        assert pairs(kept, "symbol", "x", "y") == [("A", 3, 2), ("B", None, None)]
    keys_only = spark.createDataFrame([("A",), ("A",)], "symbol string")
    assert pairs(last_per_key(keys_only, ["symbol"]), "symbol") == [("A",)]


def test_upsert_overwrites_and_is_idempotent(make):
    old = make("bars", series("A", [1, 2, 3]))
    new = make("bars", series("A", [1, 9]) + series("B", [5]))
    once = upsert(old, new, ["symbol", "date"])
    twice = upsert(once, new, ["symbol", "date"])
    want = [("A", day(0), 1), ("A", day(1), 9), ("A", day(2), 3), ("B", day(0), 5)]
    assert pairs(once, "symbol", "date", "close") == want
    assert pairs(twice, "symbol", "date", "close") == want


def test_upsert_can_write_null(make):
    old = make("bars", series("A", [1], vwap=7))
    new = make("bars", series("A", [1], vwap=None))
    assert upsert(old, new, ["symbol", "date"]).first().vwap is None


def test_partial_upsert_keeps_other_columns(make):
    old = make("master", [
        {"symbol": "A", "company_name": "old", "lot_size": 1, "industry": "Steel"},
        {"symbol": "B", "company_name": "kept", "lot_size": 2},
    ])
    new = make("master", [
        {"symbol": "A", "company_name": "new", "lot_size": 5}, {"symbol": "C", "company_name": "c"},
    ])
    got = upsert_partial(old, new, ["symbol"], ["company_name", "lot_size"], stamp="last_updated")
    rows = {r.symbol: r for r in got.collect()}
    assert (rows["A"].company_name, rows["A"].lot_size, rows["A"].industry) == ("new", 5, "Steel")
    assert rows["A"].last_updated is not None and rows["C"].last_updated is not None
    assert rows["B"].company_name == "kept" and rows["B"].last_updated is None


def test_insert_ignore(make):
    old = make("bans", [{"trade_date": day(0), "symbol": "A", "created_at": dt.datetime(2020, 1, 1)}])
    new = make("bans", [{"trade_date": day(0), "symbol": s} for s in ("A", "B", "B")])
    rows = {r.symbol: r for r in insert_ignore(old, new.drop("created_at"), ["trade_date", "symbol"]).collect()}
    assert rows["A"].created_at == dt.datetime(2020, 1, 1)
    assert set(rows) == {"A", "B"} and rows["B"].created_at is not None


def test_new_bans_are_appended(make, store, tmp_path):
    def ban(i, symbol):
        return {"trade_date": day(i), "symbol": symbol}

    def files():
        found = (tmp_path / "store" / "fno_ban_period").rglob("*.parquet")
        return {f: f.stat().st_mtime_ns for f in found}

    assert jobs.store_bans(store, make("bans", [ban(0, "A"), ban(40, "A"), ban(0, "A")])) == 3
    before = files()
    assert jobs.store_bans(store, make("bans", [ban(0, "A"), ban(0, "B")])) == 2
    assert before.items() <= files().items()
    want = [(day(0), "A"), (day(0), "B"), (day(40), "A")]
    assert pairs(store.table("fno_ban_period"), "trade_date", "symbol") == want
    assert jobs.store_bans(store, make("bans", [])) == 0


def test_clear_deletes_what_the_session_staged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    session.clear(spark)
    kept = session.staged(spark.range(3), "numbers")
    assert kept.count() == 3 and list(tmp_path.rglob("*.parquet"))
    session.clear(spark)
    assert not list(tmp_path.rglob("*.parquet"))


def test_keyed_update_only_touches_matches(make, spark):
    bars = make("bars", series("A", [1, 2]))
    source = spark.createDataFrame(
        [("A", day(1), 8.5), ("A", day(9), 7.0), ("A", day(0), None)],
        "symbol string, date date, close double",
    )
    got = keyed_update(bars, source, ["symbol", "date"], ["close"])
    assert got.count() == 2
    assert [(float(r.close), r._matched) for r in got.orderBy("date").collect()] == [
        (1.0, False), (8.5, True),
    ]


def test_metadata(make, spark):
    master = make("master", [
        {"symbol": "A", "industry": None, "segment": "X"},
        {"symbol": "B", "industry": "", "segment": "X"},
        {"symbol": "C", "industry": "Steel", "segment": "Y"},
        {"symbol": "D", "industry": None, "segment": None},
    ])
    assert [r.symbol for r in metadata_gaps(master).orderBy("symbol").collect()] == ["A", "B", "D"]
    feed = spark.createDataFrame(
        [("A", "Oil", ""), ("B", "", ""), ("C", "Other", "Z"), ("D", None, "S")],
        "symbol string, industry string, segment string",
    )
    got = pairs(update_metadata(master, feed), "symbol", "industry", "segment")
    assert got == [("A", "Oil", ""), ("B", "", "X"), ("C", "Steel", "Y"), ("D", "", "S")]


def test_incremental_plan(make):
    master = make("master", [{"symbol": s} for s in "ABC"])
    bars = make("bars", series("A", [1, 2]) + series("B", [1, 2, 3, 4]))
    plan = lookups.incremental_plan(master, bars, dt.date(2024, 1, 1), day(3)).orderBy("symbol")
    assert [(r.from_date, r.skip) for r in plan.collect()] == [
        (day(2), False), (day(4), True), (dt.date(2024, 1, 1), False),
    ]


def test_new_rows_only(make):
    stored = make("bars", series("A", [1, 2]))
    fresh = lookups.new_rows_only(make("bars", series("A", [5, 6, 7]) + series("B", [1])), stored)
    assert pairs(fresh, "symbol", "date") == [("A", day(2)), ("B", day(0))]


def test_store_starts_empty_and_is_typed(store):
    bars = store.table("daily_ohlcv")
    assert bars.count() == 0 and dict(bars.dtypes)["close"] == "decimal(12,2)"


def test_store_series(make, store):
    assert jobs.store_series(store, "daily_ohlcv", make("bars", series("A", [1, 2, 3] * 20))) == 60
    assert jobs.store_series(store, "daily_ohlcv", make("bars", series("A", [9]))) == 1
    assert jobs.store_series(store, "daily_ohlcv", make("bars", series("B", [4]))) == 1
    table = store.table("daily_ohlcv")
    assert table.count() == 61
    assert float(table.filter("symbol = 'A' AND date = '2025-01-01'").first().close) == 9
    assert jobs.store_series(store, "daily_ohlcv", make("bars", [])) == 0
    assert store.table("daily_ohlcv").count() == 61


def test_a_batch_rewrites_only_its_months(make, store, tmp_path):
    jobs.store_series(store, "daily_ohlcv", make("bars", series("A", [1] * 60)))
    files = {p.name for p in (tmp_path / "store/daily_ohlcv/month=202501").iterdir()}
    february = make("bars", [{**series("A", [7])[0], "date": dt.date(2025, 2, 3)}])
    jobs.store_series(store, "daily_ohlcv", february)
    assert {p.name for p in (tmp_path / "store/daily_ohlcv/month=202501").iterdir()} == files
    assert store.table("daily_ohlcv").count() == 60


def test_a_broken_off_write_is_finished_by_the_next_one(make, store, spark, monkeypatch):
    jobs.store_series(store, "daily_ohlcv", make("bars", series("A", [1, 2, 3])))
    publish = Store.recover
    with monkeypatch.context() as patch:
        # the job dies once the merged rows are complete but before they are in the table
        calls = iter([None, RuntimeError("lost driver")])

        def dies(self, name):
            error = next(calls)
            if error:
                raise error
            publish(self, name)

        patch.setattr(Store, "recover", dies)
        with pytest.raises(RuntimeError):
            jobs.store_series(store, "daily_ohlcv", make("bars", series("A", [9])))
    store.spark._jvm.org.apache.hadoop.fs.FileSystem.getLocal(
        spark._jsc.hadoopConfiguration()
    ).delete(spark._jvm.org.apache.hadoop.fs.Path(store.path("daily_ohlcv") + "/month=202501"), True)
    jobs.store_series(store, "daily_ohlcv", make("bars", series("B", [4])))
    got = pairs(store.table("daily_ohlcv").withColumn("c", F.col("close").cast("int")),
                "symbol", "date", "c")
    assert got == [("A", day(0), 9), ("A", day(1), 2), ("A", day(2), 3), ("B", day(0), 4)]


def test_read_equity_names_symbol_from_file(spark, tmp_path):
    header = HEADER.removeprefix("symbol,")
    body = line("X", "01-Jan-2025", 100).removeprefix("X,")
    folder = landed(tmp_path, "equity", {"SBIN.csv": '\ufeff' + header + body})
    (row,) = readers.clean_equity(readers.read_equity(spark, folder)).collect()
    assert (row.symbol, row.date, row.volume, row.trades) == ("SBIN", day(0), 1_200_000, 6000)


def test_clean_equity_rules(spark, tmp_path):
    folder = landed(tmp_path, "equity", {
        "a.csv": HEADER + line("A", "01-Jan-2025", 100) + line("A", "01-Jan-2025", 50, "BL")
        + line("A", "02-01-2025", 101, volume="-") + line("A", "soon", 1) + line("A", "2025-01-01", 7),
    })
    raw = readers.read_equity(spark, folder)
    assert readers.quarantine(raw).count() == 1
    cleaned = readers.clean_equity(raw)
    assert cleaned.count() == 3
    kept = last_per_key(cleaned, ["symbol", "date"])
    assert [(r.date, float(r.close), r.volume) for r in kept.orderBy("date").collect()] == [
        (day(0), 7.0, 1_200_000), (day(1), 101.0, 0),
    ]
    bad = {r.column_name: r.bad_cells for r in readers.bad_cells(raw).collect()}
    assert bad["volume"] == 1 and bad["close"] == 0


def test_missing_series_column_means_ordinary_shares(spark):
    raw = spark.createDataFrame([("A", "2025-01-01", "5")], "symbol string, Date string, ClosePrice string")
    (row,) = readers.clean_equity(raw).collect()
    assert row.series == "EQ" and float(row.close) == 5 and float(row.open) == 0


def test_lot_sizes(spark, tmp_path):
    entries = [
        {"exch_seg": "NFO", "instrumenttype": "FUTSTK", "name": n, "lotsize": s}
        for n, s in [("SBIN", "100"), ("SBIN ", "1500"), ("011NSETEST", "9"), ("TCS", "0"), ("X", "?")]
    ] + [{"exch_seg": "NSE", "instrumenttype": "FUTSTK", "name": "B", "lotsize": "5"}]
    folder = landed(tmp_path, "instruments", {"all.json": json.dumps(entries)})
    lots = readers.lot_sizes(readers.read_instruments(spark, folder))
    assert pairs(lots, "symbol", "lot_size") == [("SBIN", 1500)]


def test_bans_and_metadata_readers(spark, tmp_path):
    folder = landed(tmp_path, "bans", {"b.json": "\n".join([
        '{"trade_date":"05-01-2025","symbols":["A","B"]}', '{"trade_date":"bad","symbols":["C"]}',
        '{"trade_date":"06-01-2025","symbols":[]}',
    ])})
    assert pairs(readers.read_bans(spark, folder), "symbol") == [("A",), ("B",)]
    folder = landed(tmp_path, "metadata", {"m.json": "\n".join([
        '{"symbol":"A","info":{"industry":"Oil"}}', '{"symbol":"B"}', '{"symbol": "C", broken',
        '{"info":{"industry":"Gas"}}', '{"symbol":" "}',
    ])})
    assert pairs(readers.read_metadata(spark, folder), "symbol", "industry", "segment") == [
        ("A", "Oil", ""), ("B", "", ""),
    ]


def test_local_date_does_not_depend_on_the_session_zone(spark):
    rows = spark.createDataFrame([("2025-01-01 00:00:00+05:30",)], "d string")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert rows.select(readers.local_date("d")).first()[0] == day(0)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_json_map(spark, tmp_path):
    folder = landed(tmp_path, "map", {"m.json": json.dumps({"A": "a.in", "B": "b.in"}, indent=2)})
    assert pairs(readers.read_json_map(spark, folder), "key", "value") == [("A", "a.in"), ("B", "b.in")]


def test_index_tickers(spark):
    names = spark.createDataFrame([("NIFTY BANK",), ("UNKNOWN",)], "n string")
    got = [r[0] for r in names.select(readers.index_ticker("n")).collect()]
    assert got == ["^NSEBANK", "^NSEI"]


@pytest.fixture
def landing(tmp_path):
    """Two symbols; SPLIT halves on the third day, the second source is adjusted."""
    landed(tmp_path, "eligible", {"e.csv": "Symbol,Company Name\nGOOD,Good Ltd\nSPLIT,Split Ltd\n"})
    landed(tmp_path, "instruments", {"i.json": json.dumps(
        [{"exch_seg": "NFO", "instrumenttype": "FUTSTK", "name": "GOOD", "lotsize": "50"}]
    )})
    closes = {"GOOD": [100, 101, 102], "SPLIT": [200, 200, 100], "UNLISTED": [1, 1, 1]}
    landed(tmp_path, "equity", {
        f"{s}.csv": HEADER + "".join(line(s, day(i).strftime("%d-%b-%Y"), c) for i, c in enumerate(cs))
        for s, cs in closes.items()
    })
    rows = "".join(
        f"{ticker},{day(i)} 00:00:00+05:30,100,105,95,100,77\n"
        for ticker in ("SPLIT.NS", "^NSEI", "^NSEBANK") for i in range(4)
    )
    landed(tmp_path, "adjusted", {"a.csv": "ticker,Date,Open,High,Low,Close,Volume\n" + rows})
    landed(tmp_path, "bans", {"b.json": '{"trade_date":"03-01-2025","symbols":["GOOD"]}'})
    landed(tmp_path, "metadata", {"m.json": '{"symbol":"GOOD","info":{"industry":"Oil","segment":"S"}}'})
    return jobs.Landing(str(tmp_path / "landing"))


def test_collect_all(spark, landing, store):
    report = jobs.collect_all(spark, landing, store, today=day(10))
    assert report.rows["daily_ohlcv"] == 6
    assert (report.rows["fno_stocks"], report.rows["with_lot_size"]) == (2, 1)
    assert (report.rows["symbols_loaded"], report.rows["symbols_without_rows"]) == (2, 0)
    assert (report.rows["repaired"], report.rows["repair_failed"]) == (1, 0)
    bars = store.table("daily_ohlcv")
    closes = pairs(bars.withColumn("c", F.col("close").cast("int")), "symbol", "date", "c")
    assert closes == [("GOOD", day(i), 100 + i) for i in range(3)] + [
        ("SPLIT", day(i), 100) for i in range(3)
    ]
    assert bars.filter("symbol = 'SPLIT'").select("volume", "delivery_volume").distinct().collect() == [
        (77, 600000)
    ]
    master = {r.symbol: r for r in store.table("fno_stocks").collect()}
    assert (master["GOOD"].lot_size, master["GOOD"].industry) == (50, "Oil")
    assert (master["SPLIT"].lot_size, master["SPLIT"].company_name) == (0, "Split Ltd")
    assert store.table("index_ohlcv").groupBy("index_name").count().count() == 2
    assert store.table("fno_ban_period").count() == 1

    again = jobs.collect_all(spark, landing, store, today=day(10))
    assert again.rows["daily_ohlcv"] == 0
    assert pairs(store.table("daily_ohlcv"), "symbol", "date") == [c[:2] for c in closes]
    assert store.table("fno_ban_period").count() == 1


def test_collect_one_and_missing_feeds(spark, landing, store, tmp_path):
    assert jobs.collect_one(spark, landing, store, "GOOD", today=day(10)) == 3
    nothing = jobs.Landing(str(tmp_path / "nowhere"))
    assert jobs.collect_one(spark, nothing, store, "GOOD") == 0
    assert jobs.collect_all(spark, nothing, store).rows == {}


def test_refresh_index_counts(spark, landing, store):
    feed = readers.read_adjusted(spark, landing.find(spark, "adjusted"))
    rows = readers.clean_index(readers.adjusted_index(feed, "NIFTY 50"))
    assert jobs.refresh_index(store, rows, "NIFTY 50") == (0, 4)
    assert jobs.refresh_index(store, rows, "NIFTY 50") == (4, 4)


def test_stream_equals_batch_and_survives_a_restart(spark, store, tmp_path):
    folder = landed(tmp_path, "equity", {
        f"{n}.csv": HEADER + "".join(line("A", day(10 * n + i), 100 + i) for i in range(10))
        for n in range(3)
    })
    state = str(tmp_path / "state")

    def run(max_files=None):
        stream_collect(spark, folder, store, state, max_files=max_files).awaitTermination()
        return pairs(store.table("daily_ohlcv"), "symbol", "date", "close")

    first = run(max_files=1)
    batch = readers.clean_equity(readers.read_equity(spark, folder))
    assert first == pairs(batch, "symbol", "date", "close") and len(first) == 30
    assert run() == first  # nothing new
    landed(tmp_path, "equity", {"late.csv": HEADER + line("A", day(3), 55)})
    corrected = dict(((s, d), c) for s, d, c in run())
    assert len(corrected) == 30 and float(corrected["A", day(3)]) == 55


def _land(folder, files):
    folder.mkdir(parents=True)
    for name, text in files.items():
        (folder / name).write_text(text, encoding="utf-8")
    return str(folder)


def test_files_with_different_headers_lose_no_row(spark, tmp_path):
    path = _land(
        tmp_path / "bars",
        {
            "A.csv": "Date,Series,ClosePrice,HighPrice\n02-Jan-2025,EQ,10,11\n03-Jan-2025,BE,10,11\n",
            "B.csv": '﻿"HighPrice","ClosePrice","Date"\n"21","20","02-Jan-2025"\n',
            "C.csv": "Symbol,ClosePrice,Series,HighPrice,Date\nX,30,EQ,31,02-Jan-2025\n",
        },
    )
    rows = readers.clean_equity(readers.read_equity(spark, path)).collect()
    assert sorted((r["symbol"], float(r["close"]), float(r["high"])) for r in rows) == [
        ("A", 10.0, 11.0), ("B", 20.0, 21.0), ("X", 30.0, 31.0)
    ]


def test_index_name_with_a_space_in_the_file_name(spark, tmp_path):
    text = "TIMESTAMP,OPEN_INDEX_VAL,HIGH_INDEX_VAL,CLOSE_INDEX_VAL,LOW_INDEX_VAL\n02-Jan-2025,1,2,1,1\n"
    path = _land(tmp_path / "index", {"NIFTY 50.csv": text, "A+B.csv": text})
    names = {r["index_name"] for r in readers.clean_index(readers.read_index(spark, path)).collect()}
    assert names == {"NIFTY 50", "A+B"}


def test_one_bad_date_leaves_the_adjusted_feed_alone(spark, tmp_path):
    text = "ticker,Date,Open,High,Low,Close,Volume\nA.NS,n/a,1,1,1,1,1\nA.NS,2025-01-02 00:00:00+05:30,1,1,1,1,1\n"
    rows = readers.read_adjusted(spark, _land(tmp_path / "adjusted", {"all.csv": text})).collect()
    assert sorted(str(r["date"]) for r in rows) == ["2025-01-02", "None"]


def test_bad_cells_are_what_cleaning_zeroes(spark):
    raw = spark.createDataFrame(
        [("99999999999999", "inf", "1e30", "1e12"), ("1", "2", "3", "4")],
        "ClosePrice string, OpenPrice string, TotalTradedQuantity string, `No.ofTrades` string",
    )
    found = {r["column_name"]: r["bad_cells"] for r in readers.bad_cells(raw).collect()}
    assert found == {"close": 1, "open": 1, "volume": 1, "trades": 1}


def test_dates_of_a_range_prune_months(spark, make, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.last_date("daily_ohlcv") is None
    assert store.table("daily_ohlcv", day(0), day(9)).count() == 0
    assert stored.market_stats(store).first().stock_count == 0
    jobs.store_series(store, "daily_ohlcv", make("bars", series("A", [100] * 100)))
    jobs.store_bans(
        store, make("bans", [{"trade_date": day(i), "symbol": "A"} for i in (0, 50, 99)])
    )
    assert store.last_date("daily_ohlcv") == day(99)
    frames = {
        "range": store.table("daily_ohlcv", day(40), day(45)),
        "stats": stored.market_stats(store),
        "bans": stored.ban_status(store),
        "frequency": stored.ban_frequency(store),
        "ytd": stored.ytd_anchor(store),
    }
    for name, frame in frames.items():
        plan = frame._jdf.queryExecution().executedPlan().toString()
        scans = plan.count("PartitionFilters: [isnotnull(month")
        tables = plan.count("FileScan parquet")
        assert scans >= max(1, tables - (name == "stats")), (name, plan)
    assert frames["range"].count() == 6
    assert [r.days_in_ban for r in frames["frequency"].collect()] == [1]
    assert [r.trade_date for r in frames["bans"].collect()] == [day(99)]


def test_undated_rows_are_counted_and_set_aside(spark, tmp_path):
    text = "symbol,Date,Series,ClosePrice\nA,2025-01-02 00:00:00,EQ,5\nA,2025/01/03,EQ,6\nA,soon,EQ,7\n"
    root = tmp_path / "landing"
    _land(root / "equity", {"all.csv": text})
    _land(root / "eligible", {"all.csv": "symbol,Underlying\nA,Alpha\n"})
    store = Store(spark, str(tmp_path / "store"))
    report = jobs.collect_all(spark, jobs.Landing(str(root)), store, today=day(10))
    counts = {k: report.rows[k] for k in ("equity_read", "equity_undated", "daily_ohlcv")}
    assert counts == {"equity_read": 3, "equity_undated": 1, "daily_ohlcv": 2}
    aside = spark.read.parquet(store.aside_path("equity")).collect()
    assert len(aside) == 1 and '"Date":"soon"' in aside[0].row
    (root / "equity" / "later.csv").write_text("symbol,Date,Series,ClosePrice\nA,never,EQ,8\n")
    jobs.collect_all(spark, jobs.Landing(str(root)), store, today=day(10))
    aside = spark.read.parquet(store.aside_path("equity")).collect()
    assert sorted(r.row.split('"Date":')[1][:7] for r in aside) == ['"never"', '"soon",', '"soon",']
    assert len({r.load for r in aside}) == 2  # each load keeps its own rows


def _months_read(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return plan.count("PartitionFilters: [isnotnull(month"), plan


def test_look_backs_walk_months_back_and_read_no_older_month(spark, make, store):
    closes = [100 + (i * 7) % 23 for i in range(400)]
    rows = series("A", closes, volume=[1000 + 37 * (i % 11) for i in range(400)])
    rows += series("B", closes[:30])  # listed lately: all its months
    old = series("C", closes[:300])  # stopped trading long ago
    rows += [{**r, "date": r["date"] - dt.timedelta(days=500)} for r in old]
    jobs.store_series(store, "daily_ohlcv", make("bars", rows))
    whole = store.table("daily_ohlcv")

    year = store.recent("daily_ohlcv", 252, among=whole.filter("symbol = 'A'").select("symbol"))
    months = sorted({r.date.year * 100 + r.date.month for r in year.select("date").collect()})
    assert months[0] == 202505  # 252 days back from 2026-02-04 end in May 2025, not earlier
    assert year.filter("symbol = 'A'").count() >= 252
    scans, plan = _months_read(year)
    assert scans == 1 and "month#" in plan and ">= 202505" in plan, plan

    # every stored symbol: C's newest year lies far back, so the walk reaches it
    every = store.recent("daily_ohlcv", 252)
    assert 252 <= every.filter("symbol = 'C'").count() < 300  # whole months, not all of C's rows
    got = pairs(stored.stock_metrics(store, "NIFTY"), "symbol", "pct_1y", "above_sma_200", "delta_52w_high")
    from barscreen.plans import metrics

    anchor = stored.ytd_anchor(store)
    want = pairs(metrics.stock_metrics(whole, store.table("index_ohlcv"), benchmark="NIFTY", anchor=anchor),
                 "symbol", "pct_1y", "above_sma_200", "delta_52w_high")
    assert got == want and len(got) == 3

    screen = stored.screen_latest(store, "upward-breakout", benchmark="NIFTY", ordered=False)
    assert _months_read(screen)[0] >= 1
    from barscreen.plans import screens

    last = store.last_date("daily_ohlcv")
    full = screens.run_screen(whole, store.table("fno_ban_period"), "upward-breakout",
                              index=store.table("index_ohlcv"), as_of=last, benchmark="NIFTY", ordered=False)
    assert sorted(map(tuple, screen.collect())) == sorted(map(tuple, full.collect()))


def test_month_counts_follow_every_write_and_are_rebuilt_if_missing(spark, make, store, tmp_path):
    jobs.store_series(store, "daily_ohlcv", make("bars", series("A", [1] * 40)))
    counts = {(r.month, r.symbol): r.n for r in store.month_counts("daily_ohlcv").collect()}
    assert counts == {(202501, "A"): 31, (202502, "A"): 9}
    jobs.store_series(store, "daily_ohlcv", make("bars", [{**series("B", [5])[0], "date": dt.date(2025, 2, 20)}]))
    counts = {(r.month, r.symbol): r.n for r in store.month_counts("daily_ohlcv").collect()}
    assert counts == {(202501, "A"): 31, (202502, "A"): 9, (202502, "B"): 1}
    jobs.store_bans(store, make("bans", [{"trade_date": day(i), "symbol": "A"} for i in (0, 40)]))
    assert store.month_counts("fno_ban_period").count() == 2

    session.delete_folder(spark, store.counts_path("daily_ohlcv"))
    again = {(r.month, r.symbol): r.n for r in store.month_counts("daily_ohlcv").collect()}
    assert again == counts
    assert store.recent("daily_ohlcv", 5).count() == 10  # February holds A's last 9 and B's row
    assert store.recent("daily_ohlcv", 10).count() == 41


def _upsert_symbol(old, new):
    from barscreen.operators.upsert import upsert

    return upsert(old, new, ["symbol"])


def test_a_reader_keeps_its_snapshot_while_the_table_is_replaced(make, store, spark):
    store.apply("fno_stocks", make("master", [{"symbol": "A"}, {"symbol": "B"}]), _upsert_symbol)
    pinned = store.table("fno_stocks")
    store.apply("fno_stocks", make("master", [{"symbol": "C"}]), _upsert_symbol)
    assert pinned.count() == 2 and store.table("fno_stocks").count() == 3

    def breaks(old, new):
        raise RuntimeError("lost the driver while merging")

    with pytest.raises(RuntimeError):
        store.apply("fno_stocks", make("master", [{"symbol": "D"}]), breaks)
    assert sorted(r.symbol for r in store.table("fno_stocks").collect()) == ["A", "B", "C"]
    for n in range(4):
        store.apply("fno_stocks", make("master", [{"symbol": f"E{n}"}]), _upsert_symbol)
    assert store.table("fno_stocks").count() == 7
    kept = [f for f in session.subfolders(spark, store.snapshots_path("fno_stocks")) if f.isdigit()]
    assert sorted(map(int, kept)) == [3, 4, 5]


def test_a_second_writer_is_refused_and_a_dead_one_is_taken_over(make, store, spark):
    from barscreen.sources.store import ConcurrentWrite

    store.apply("fno_stocks", make("master", [{"symbol": "A"}]), _upsert_symbol)
    claim = store._claim("fno_stocks", store.snapshot("fno_stocks") + 1)  # a writer at work
    with pytest.raises(ConcurrentWrite):
        store.apply("fno_stocks", make("master", [{"symbol": "B"}]), _upsert_symbol)
    assert [r.symbol for r in store.table("fno_stocks").collect()] == ["A"]

    path = spark._jvm.org.apache.hadoop.fs.Path(claim)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.setTimes(path, 0, -1)  # that writer died long ago
    store.apply("fno_stocks", make("master", [{"symbol": "B"}]), _upsert_symbol)
    assert sorted(r.symbol for r in store.table("fno_stocks").collect()) == ["A", "B"]


def test_eligible_files_with_other_headers_and_orders_are_read_right(spark, tmp_path):
    folder = tmp_path / "eligible"
    folder.mkdir()
    (folder / "a.csv").write_text("symbol,underlying\nABC,Alpha Ltd\n")
    (folder / "b.csv").write_text("Company Name,Symbol\nBeta Ltd,XYZ\n")
    (folder / "c.csv").write_text("SYMBOL, Company Name \n DEF , Delta Ltd\n")
    got = pairs(readers.read_eligible(spark, str(folder)), "symbol", "company_name")
    assert got == [("ABC", "Alpha Ltd"), ("DEF", "Delta Ltd"), ("XYZ", "Beta Ltd")]
