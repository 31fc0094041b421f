import pytest
from pyspark.sql import functions as F

from barscreen.plans import screens
from barscreen.sources import output
from conftest import SF_DIR, day, series
from workload import tables as t


def hits(df):
    return {(r.symbol, r.date): r for r in df.collect()}


def breakout_bars(**last):
    """Sixty quiet days, then one that breaks out."""
    closes = [100] * 60 + [130]
    rows = series("UP", closes)
    rows[-1].update({"open": 110, "high": 131, "low": 109, "volume": 9000, "delivery_volume": 4000})
    rows[-1].update(last)
    return rows


def test_volume_breakout_found(make):
    got = hits(screens.screen(make("bars", breakout_bars()), "volume-breakout"))
    (row,) = got.values()
    assert (row.symbol, row.volume_mult, row.strength) == ("UP", 9.0, "N/A")
    assert row.change_pct == pytest.approx((130 - 110) / 110 * 100)


@pytest.mark.parametrize(
    "change",
    [{"volume": 2000}, {"open": 130}, {"close": 105}, {"volume": 1000}],
)
def test_volume_breakout_conditions(make, change):
    assert not hits(screens.screen(make("bars", breakout_bars(**change)), "volume-breakout"))


def test_penny_stock_is_left_out(make):
    rows = series("P", [10] * 30 + [19])
    rows[-1].update({"open": 16, "volume": 99999})
    assert not hits(screens.screen(make("bars", rows), "volume-breakout"))


def test_upward_and_downward(make):
    up = hits(screens.screen(make("bars", breakout_bars()), "upward-breakout"))
    assert [r.strength for r in up.values()] == ["Full"]
    low = series("DN", [100] * 30 + [60])
    down = hits(screens.screen(make("bars", low), "downward-breakout"))
    assert [r.strength for r in down.values()] == ["Partial (Low Volume)"]
    assert not hits(screens.screen(make("bars", low), "upward-breakout"))


def test_zero_mean_gives_null_multiple(make):
    rows = series("Z", [100] * 25 + [140], delivery_volume=0)
    got = hits(screens.screen(make("bars", rows), "upward-breakout-delivery"))
    assert [r.volume_mult for r in got.values()] == [None]


def test_first_row_never_breaks_out(make):
    rows = series("A", [100])
    assert not hits(screens.screen(make("bars", rows), "upward-breakout", as_of=None))


def weak_case(make, index_rows):
    rows = series("W", [100] * 25 + [95], delivery_volume=100)
    rows[-1].update({"high": 105, "low": 94, "delivery_volume": 200})
    index = make("index", index_rows)
    return hits(screens.screen(make("bars", rows), "relative-weakness", index=index))


def test_relative_weakness(make):
    index = [{"index_name": "NIFTY 50", "date": day(i), "close": 100} for i in range(26)]
    (row,) = weak_case(make, index).values()
    assert (row.change_pct, row.relative_return, row.delivery_mult) == (-5.0, -5.0, 2.0)
    assert row.close_location == 9.1


def test_missing_benchmark_date(make):
    """The return counts as 0 in the rule and stays NULL in the result."""
    (row,) = weak_case(make, []).values()
    assert row.relative_return is None and row.change_pct == -5.0


def test_benchmark_explains_the_fall(make):
    index = [{"index_name": "NIFTY 50", "date": day(i), "close": 100} for i in range(25)]
    index.append({"index_name": "NIFTY 50", "date": day(25), "close": 95})
    assert not weak_case(make, index)


def test_stale_symbol_is_not_latest(make):
    rows = breakout_bars() + series("LATER", [100] * 70)
    assert not hits(screens.screen(make("bars", rows), "upward-breakout"))
    found = hits(screens.screen(make("bars", rows), "upward-breakout", as_of=day(60)))
    assert set(found) == {("UP", day(60))}


@pytest.mark.parametrize("screen_id", screens.SCREEN_IDS)
def test_one_date_equals_all_dates_filtered(spark, screen_id):
    bars, index = t.bars(spark, SF_DIR), t.index(spark, SF_DIR)
    options = {"index": index, "benchmark": t.BENCHMARK}
    every = screens.screen(bars, screen_id, as_of=None, **options)
    date = every.agg(F.max("date")).first()[0]
    want = every.filter(F.col("date") == date).collect()
    got = screens.screen(bars, screen_id, as_of=date, **options).collect()
    assert want and set(got) == set(want) and len(got) == len(want)


def test_blocks_give_the_same_hits(spark):
    bars = t.bars(spark, SF_DIR)
    whole = screens.screen(bars, "upward-breakout", as_of=None).collect()
    split = screens.screen(bars, "upward-breakout", as_of=None, block_rows=64).collect()
    assert set(whole) == set(split) and len(whole) == len(split)


def test_order(make):
    rows = []
    for n, volume in enumerate([9000, 20000, 12000]):
        rows += [{**r, "symbol": f"S{n}", "volume": volume if i == 60 else 1000}
                 for i, r in enumerate(breakout_bars())]
    got = screens.screen(make("bars", rows), "volume-breakout", ordered=True).collect()
    assert [r.symbol for r in got] == ["S1", "S2", "S0"]


def test_bans(make):
    bars = make("bars", breakout_bars())
    bans = make("bans", [{"trade_date": day(9), "symbol": "UP"}, {"trade_date": day(8), "symbol": "X"}])
    (row,) = screens.run_screen(bars, bans, "upward-breakout").collect()
    assert row.in_ban is True
    assert screens.run_screen(bars, bans, "upward-breakout", exclude=True).count() == 0
    other = make("bans", [{"trade_date": day(9), "symbol": "X"}])
    (row,) = screens.run_screen(bars, other, "upward-breakout", exclude=True).collect()
    assert row.in_ban is False


def test_catalogue(spark):
    assert screens.list_screens(spark).count() == 7
    spec = screens.get_screen("relative-weakness")
    assert [c["key"] for c in spec.columns][:3] == ["symbol", "close", "changePct"]
    with pytest.raises(KeyError):
        screens.get_screen("nothing")
    with pytest.raises(ValueError):
        screens.screen(t.bars(spark, SF_DIR), "relative-weakness")


def test_result_sort_treats_null_as_zero(spark):
    rows = spark.createDataFrame([("A", -1.0), ("B", None), ("C", 2.0)], "symbol string, x double")
    assert [r.symbol for r in screens.sort_results(rows, "x").collect()] == ["A", "B", "C"]
    down = screens.sort_results(rows, "x", descending=True).collect()
    assert [r.symbol for r in down] == ["C", "B", "A"]


def test_api_records(make):
    rows = make("bars", breakout_bars())
    got = output.to_api_records(screens.screen(rows, "volume-breakout"))
    assert got.columns == [
        "symbol", "date", "close", "changePct", "volume", "deliveryPct", "volumeMult", "strength",
    ]
    first = got.first()
    assert first.close == 130.0 and first.volume == 9000.0 and first.date == str(day(60))
    (line,) = output.to_json_lines(rows.limit(1).select("symbol", "vwap")).collect()
    assert line.value == '{"symbol":"UP","vwap":null}'
