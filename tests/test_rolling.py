import random

import pytest
from pyspark.sql import functions as F

from barscreen.operators import rolling
from conftest import day, series

COLUMNS = [*rolling.INDICATORS, "tr", "close_1m_ago", "close_1y_ago"]


def random_bars(make, lengths, seed=1):
    rng = random.Random(seed)
    rows = []
    for n, length in enumerate(lengths):
        closes = [rng.randint(50, 150) for _ in range(length)]
        rows += series(
            f"S{n}", closes, volume=[rng.randint(0, 900) for _ in closes],
            delivery_volume=[rng.randint(0, 90) if rng.random() < 0.9 else None for _ in closes],
        )
        # irregular gaps between dates
    for row in rows:
        row["date"] = day((row["date"] - day(0)).days * 3 // 2)
    return make("bars", rows)


def brute_force(rows):
    """Every indicator by scanning its frame."""
    by_symbol = {}
    for r in sorted(rows, key=lambda r: (r.symbol, r.date)):
        by_symbol.setdefault(r.symbol, []).append(r)
    out = {}
    for symbol, s in by_symbol.items():
        trs = []
        for i, r in enumerate(s):
            ranges = [r.high - r.low]
            if i:
                ranges += [abs(r.high - s[i - 1].close), abs(r.low - s[i - 1].close)]
            trs.append(max(ranges))
        for i, r in enumerate(s):
            got = {"tr": trs[i]}
            got["close_1m_ago"] = s[i - 20].close if i >= 20 else None
            got["close_1y_ago"] = s[i - 251].close if i >= 251 else None
            for name, t in rolling.INDICATORS.items():
                end = i + 1 - t.skip
                frame = range(max(0, end - t.rows), end)
                values = [trs[j] if t.column == "tr" else s[j][t.column] for j in frame]
                values = [v for v in values if v is not None]
                if not values:
                    got[name] = None
                elif t.kind == "mean":
                    got[name] = pytest.approx(float(sum(values)) / len(values), rel=1e-12)
                else:
                    got[name] = max(values) if t.kind == "max" else min(values)
            out[symbol, r.date] = got
    return out


def test_indicators_match_brute_force(make):
    bars = random_bars(make, [300, 1, 19, 60])
    want = brute_force(bars.collect())
    rows = rolling.rolling_indicators(bars).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert {c: r[c] for c in COLUMNS} == want[r.symbol, r.date]


@pytest.mark.parametrize("block_rows", [1, 400, 5000])
def test_blocks_change_nothing(make, block_rows):
    bars = random_bars(make, [1500, 3, 700], seed=5)
    picked = ["symbol", "date", *COLUMNS]
    whole = rolling.rolling_indicators(bars).select(picked).collect()
    split = rolling.rolling_indicators(bars, block_rows=block_rows).select(picked).collect()
    assert set(whole) == set(split)
    assert len(whole) == len(split)


def test_blocks_bound_the_window_groups(make):
    bars = random_bars(make, [3000], seed=6)
    sizes = []

    def build(df, w):
        sizes.append(df.groupBy("_block").count().agg(F.max("count")).first()[0])
        return df

    rows = rolling.over_series(bars, 20, build, block_rows=200)
    assert rows.count() == 3000
    assert sizes[0] <= 200 + 20 + 3 * rolling.MAX_MONTH_ROWS


def test_blocks_with_sparse_dates(make):
    """One bar a month: a block spans many years."""
    rows = series("A", list(range(100, 400)))
    for i, row in enumerate(rows):
        row["date"] = day(30 * i)
    bars = make("bars", rows)
    picked = ["symbol", "date", *COLUMNS]
    whole = rolling.rolling_indicators(bars).select(picked).collect()
    split = rolling.rolling_indicators(bars, block_rows=1).select(picked).collect()
    assert set(whole) == set(split) and len(split) == 300


def test_newest_rows_limits_before_the_shuffle(make):
    bars = random_bars(make, [40, 3])
    newest = rolling.newest_rows(bars, 5)
    assert sorted(r.rn for r in newest.collect()) == sorted([1, 2, 3, 4, 5, 1, 2, 3])
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_one_shuffle_for_all_indicators(make):
    plan = rolling.rolling_indicators(random_bars(make, [30]))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1
    assert text.count("Sort [symbol") == 1


def test_benchmark_returns(make):
    rows = [
        {"index_name": "X", "date": day(i), "close": c} for i, c in enumerate([100, 110, 0, 5])
    ] + [{"index_name": "Y", "date": day(0), "close": 7}]
    got = {r.date: r.benchmark_pct for r in rolling.benchmark_returns(make("index", rows), "X").collect()}
    assert got == {day(0): None, day(1): 10.0, day(2): -100.0, day(3): None}
