"""Stock list, statistics, bans, quality and repair."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from barscreen.operators import bans as ban_ops
from barscreen.operators import lookups, quality
from barscreen.plans import jobs, metrics, reports
from conftest import SF_DIR, day, series
from workload import tables as t


@pytest.fixture
def market(make):
    """Three symbols; A has more than a year of history."""
    bars = make("bars", series("A", list(range(100, 400))) + series("B", [50] * 30)
                + series("C", [10, 20, 30]))
    index = make("index", [
        {"index_name": "NIFTY 50", "date": day(i), "close": 1000 + i} for i in range(300)
    ])
    master = make("master", [
        {"symbol": s, "company_name": n, "lot_size": 1}
        for s, n in [("A", "Alpha Steel"), ("B", "Beta"), ("C", "alphabet"), ("NOBARS", "None")]
    ])
    bans = make("bans", [
        {"trade_date": day(2), "symbol": "A"}, {"trade_date": day(5), "symbol": "B"},
    ])
    return bars, index, master, bans


def metric_rows(market, **options):
    bars, index, _, _ = market
    return {r.symbol: r for r in metrics.stock_metrics(bars, index, **options).collect()}


def test_metrics(market):
    rows = metric_rows(market)
    a = rows["A"]
    assert a.date == day(299) and float(a.close) == 399
    assert a.pct_1y == pytest.approx(round((399 - 148) / 148 * 100, 2))
    assert a.pct_1m == pytest.approx(round((399 - 379) / 379 * 100, 2))
    assert a.ytd_pct == pytest.approx(round((399 - 100) / 100 * 100, 2))
    assert a.delta_52w_high == pytest.approx(round((399 - 404) / 404 * 100, 2))
    assert a.above_sma_20 and a.above_sma_50 and a.above_sma_200
    index_1y = (1299 - 1048) / 1048 * 100
    assert a.rs_rank == pytest.approx((399 - 148) / 148 * 100 - index_1y, abs=0.006)


def test_short_history(market):
    b = metric_rows(market)["B"]
    assert b.pct_1y is None and b.rs_rank is None and b.pct_1m == 0
    assert b.above_sma_20 is False
    assert metric_rows(market)["C"].pct_1m is None


def test_ytd_parameter(market):
    assert metric_rows(market, ytd_from=day(200))["A"].ytd_pct == pytest.approx(33.0)
    assert metric_rows(market, ytd_from=day(200))["B"].ytd_pct is None


def test_metrics_equal_the_last_rolling_row(spark):
    """The 252-row shortcut gives what full windows give."""
    from barscreen.operators.rolling import rolling_indicators

    bars = t.bars(spark, SF_DIR)
    full = rolling_indicators(bars)
    latest = bars.groupBy("symbol").agg(F.max("date").alias("date"))
    full = full.join(latest, ["symbol", "date"])
    want = {r.symbol: r for r in full.collect()}
    got = metrics.stock_metrics(bars, t.index(spark, SF_DIR), benchmark=t.BENCHMARK).collect()
    assert len(got) == len(want) == 25
    for r in got:
        w = want[r.symbol]
        assert r.above_sma_200 == (float(r.close) > w.sma_200)
        assert r.delta_52w_high == pytest.approx(
            float((w.close - w.high_52w) / w.high_52w * 100), abs=0.006
        )


def page(market, **options):
    bars, index, master, bans = market
    m = metrics.stock_metrics(bars, index)
    return metrics.stock_page(m, master, bans, **options).collect()


def test_paging_and_sorting(market):
    assert [r.symbol for r in page(market)] == ["A", "B", "C"]
    assert [r.symbol for r in page(market, sort_by="close", order="desc")] == ["A", "B", "C"]
    assert [r.symbol for r in page(market, sort_by="pct_1y", order="desc")] == ["A", "B", "C"]
    assert [r.symbol for r in page(market, sort_by="volume; drop")] == ["A", "B", "C"]
    assert [r.symbol for r in page(market, page=2, limit=2)] == ["C"]
    assert page(market, page=9, limit=2) == []


def test_search(market):
    assert [r.symbol for r in page(market, search="ALPHA")] == ["A", "C"]
    assert [r.symbol for r in page(market, search="%")] == ["A", "B", "C"]
    assert page(market, search="'; --") == []


def test_bans_on_the_list(market):
    assert [r.symbol for r in page(market) if r.in_ban] == ["B"]
    assert [r.symbol for r in page(market, exclude=True, limit=2)] == ["A", "C"]
    assert [r.symbol for r in page(market, exclude=True, limit=2, strict_compat=True)] == ["A"]


def test_totals(market):
    _, _, master, bans = market
    (r,) = metrics.page_totals(master, page=2, limit=3).collect()
    assert (r.total, r.total_pages, r.first_row, r.last_row) == (4, 2, 4, 4)
    (r,) = metrics.page_totals(master, bans, exclude=True, limit=3).collect()
    assert r.total == 3
    (r,) = metrics.page_totals(master, search="alpha").collect()
    assert r.total == 2


def test_stock_list_has_sparklines(market):
    bars, index, master, bans = market
    rows = {r.symbol: r for r in metrics.stock_list(bars, index, master, bans).collect()}
    assert len(rows["A"].sparkline) == 252
    assert rows["A"].sparkline[-1] == Decimal("399.00") > rows["A"].sparkline[0]
    assert rows["C"].sparkline == [Decimal(10), Decimal(20), Decimal(30)]


def test_sparkline_of_a_page_without_bars(market, spark, make):
    empty = metrics.attach_sparkline(spark.createDataFrame([("Q",)], "symbol string"), market[0])
    assert empty.first().sparkline == []


def test_history(market):
    bars, _, master, _ = market
    rows = metrics.stock_history(bars, master, "a", days=5).collect()
    assert [r.date for r in rows] == [day(299 - i) for i in range(5)]
    assert rows[0].change_pct == pytest.approx(round((399 - 398) / 398 * 100, 2))
    assert metrics.stock_history(bars, master, "nope").count() == 0
    assert lookups.stock_info(master, "a").first().company_name == "Alpha Steel"


def test_statistics(market):
    bars, _, master, _ = market
    (r,) = lookups.market_stats(master, bars).collect()
    assert (r.stock_count, r.positive_count, r.last_updated) == (4, 1, day(299))
    (r,) = lookups.store_stats(master, bars).collect()
    assert (r.bar_count, r.first_date, r.last_date) == (333, day(0), day(299))


def test_empty_tables(make):
    empty = make("bars", [])
    (r,) = lookups.market_stats(make("master", []), empty).collect()
    assert (r.stock_count, r.positive_count, r.last_updated) == (0, 0, None)
    assert ban_ops.ban_status(make("bans", [])).count() == 0


def test_ban_reports(make):
    bans = make("bans", [
        {"trade_date": day(n), "symbol": s}
        for n, s in [(40, "A"), (40, "B"), (39, "A"), (11, "A"), (10, "C")]
    ])
    status = ban_ops.ban_status(bans).collect()
    assert [(r.trade_date, r.symbol, r.banned_count) for r in status] == [
        (day(40), "A", 2), (day(40), "B", 2),
    ]
    frequency = ban_ops.ban_frequency(bans, day(40)).collect()
    assert [tuple(r) for r in frequency] == [("A", 3), ("B", 1)]
    assert tuple(ban_ops.ban_frequency_summary(bans, day(40)).first()) == (3, 2)
    sweep = ban_ops.ban_sweep(bans, day(40)).collect()
    assert len(sweep) == 30 and sum(r.banned_count for r in sweep) == 4


@pytest.mark.parametrize(
    "closes, mode, flagged",
    [
        ([100, 50], "abs", True), ([100, 50], "drop", True), ([100, 90], "abs", False),
        ([100, 131], "abs", True), ([100, 131], "drop", False), ([100, 130], "abs", False),
        ([0, 50], "abs", False),
    ],
)
def test_jumps(make, closes, mode, flagged):
    assert (quality.detect_jumps(make("bars", series("T", closes)), mode).count() == 1) is flagged


def test_prev_close_mismatch(make):
    good, bad = series("G", [100, 90]), series("B", [100, 90])
    bad[1]["prev_close"] = 99
    got = quality.detect_jumps(make("bars", good + bad), "prev_close")
    assert [r.symbol for r in got.collect()] == ["B"]
    with pytest.raises(ValueError):
        quality.detect_jumps(make("bars", good), "other")


def test_violations(make):
    bars = make("bars", series("VALID", [102]) + series("SPLIT", [102], low=490, high=510))
    assert [r.symbol for r in quality.ohlc_violations(bars).collect()] == ["SPLIT"]
    assert tuple(quality.ohlc_violation_counts(bars).first()) == ("SPLIT", 1)


def test_dq_summary(make):
    rows = series("A", [1, 0, 3]) + [{"symbol": "B", "volume": -1}]
    got = {r.check_name: r.bad_rows for r in quality.dq_summary(make("bars", rows), day(1)).collect()}
    assert got == {
        "null_close": 1, "null_date": 1, "date_before_floor": 1, "non_positive_close": 1,
        "negative_volume": 1, "close_outside_range": 0,
    }


def test_delta_is_never_positive(market, make):
    bars, index, _, _ = market
    assert quality.positive_deltas(metrics.stock_metrics(bars, index)).count() == 0
    at_high = make("bars", series("ATHIGH", [100, 110], high=[100, 110]))
    (row,) = metrics.stock_metrics(at_high, index).collect()
    assert row.delta_52w_high == 0


def test_repair_leaves_nothing(spark):
    """Both detectors: flagged symbols as planted, none left after the repair."""
    bars, adjusted = t.quality_bars(spark, SF_DIR), t.adjusted(spark, SF_DIR)
    for detector, planted in [("jumps", set(t.SPLIT_BRANDS)), ("violations", {t.BROKEN_BRAND})]:
        fixed, report, _ = jobs.repaired(bars, adjusted, detector)
        assert {r.symbol for r in report.collect() if r.fixed} == planted
        assert jobs.DETECTORS[detector](fixed).count() == 0
        assert fixed.count() == bars.count()


def test_repair_without_feed_fails(make, spark):
    bars = make("bars", series("T", [100, 50]))
    flagged = quality.detect_jumps(bars)
    report = quality.repair_report(quality.repair(bars, make("bars", []), flagged), flagged)
    assert [tuple(r) for r in report.collect()] == [("T", 0, False)]


def test_asset_coverage(spark):
    rows = spark.createDataFrame(
        [("A", (True, "x", None, None)), ("B", (False, None, True, None)),
         ("C", (False, None, None, True)), ("D", (True, "x", None, None))],
        f"key string, value {reports.MANIFEST_ENTRY}",
    )
    got = {r.asset_source: (r.symbols, r.share_pct) for r in reports.asset_coverage(rows).collect()}
    assert got == {"x": (2, 50.0), "placeholder": (1, 25.0), "error": (1, 25.0)}
    assert tuple(reports.asset_summary(rows).first()) == (4, 2, 50.0)


def test_period_start():
    from barscreen.sources.readers import period_start

    assert period_start("1W", dt.date(2025, 1, 8)) == dt.date(2025, 1, 1)
