import datetime as dt
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from barscreen.functions import cleaning, labels, numeric


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def column_of(spark, values, kind, expression):
    rows = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in rows.select(expression("v")).collect()]


def test_round_matches_duckdb(spark):
    rng = random.Random(7)
    values = [rng.uniform(-1e6, 1e6) for _ in range(3000)]
    values += [n / 1000 for n in range(-2000, 2000)] + [1.005, 0.0, 1e300, -1e17]
    ours = column_of(spark, values, "double", numeric.round_to)
    con = duckdb.connect()
    con.execute("CREATE TABLE t(i INTEGER, v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(values)))
    theirs = [r[0] for r in con.execute("SELECT round(v, 2) FROM t ORDER BY i").fetchall()]
    assert ours == theirs


def test_round_keeps_null_and_nan(spark):
    null, nan = column_of(spark, [None, math.nan], "double", numeric.round_to)
    assert null is None and math.isnan(nan)


def test_zero_denominators_give_null(spark):
    assert one(spark, numeric.ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, numeric.change_pct(F.lit(5.0), F.lit(0.0))) is None
    assert one(spark, numeric.guarded_change_pct(F.lit(5.0), F.lit(0.0))) == 0
    assert one(spark, numeric.pct_return(F.lit(5.0), F.lit(0.0))) is None
    assert one(spark, numeric.pct_return(F.lit(110.0), F.lit(100.0))) == 10


def test_flat_bar_and_first_row(spark):
    assert one(spark, numeric.close_location(F.lit(5), F.lit(5), F.lit(5))) == 0.5
    none = F.lit(None).cast("int")
    assert one(spark, numeric.true_range(F.lit(9), F.lit(4), none)) == 5
    assert one(spark, numeric.true_range(F.lit(9), F.lit(4), F.lit(20))) == 16


@pytest.mark.parametrize(
    "move, atr, amount, mean, label",
    [
        (5.0, 2.0, 300, 100.0, "Full"),
        (5.0, 2.0, 120, 100.0, "Partial (Low Volume)"),
        (5.0, 2.0, 300, None, "Partial (Low Volume)"),
        (1.0, 2.0, 300, 100.0, "Partial (Small Size)"),
        (1.0, None, 300, 100.0, "Partial (Small Size)"),
    ],
)
def test_breakout_strength(spark, move, atr, amount, mean, label):
    c = [F.lit(v).cast("double") for v in (move, atr, amount, mean)]
    assert one(spark, numeric.breakout_strength(*c)) == label


@pytest.mark.parametrize(
    "text, value",
    [
        ("1,234.50", 1234.5), ("-", 0.0), ("", 0.0), (None, 0.0), ("nan", 0.0), ("abc", 0.0),
        (" 7 ", 7.0), ("-3.5", -3.5),
    ],
)
def test_clean_double(spark, text, value):
    assert column_of(spark, [text], "string", cleaning.clean_double) == [value]


def test_clean_long_truncates_towards_zero(spark):
    texts = ["123.0", "1,00,000", "-2.9", "-", "x", "1e30"]
    assert column_of(spark, texts, "string", cleaning.clean_long) == [123, 100000, -2, 0, 0, 0]


def test_bad_cells_as_null(spark):
    got = column_of(spark, ["-", "5"], "string", lambda c: cleaning.clean_double(c, "null"))
    assert got == [None, 5.0]
    with pytest.raises(ValueError):
        cleaning.clean_double("v", "guess")


def test_parse_date_layouts(spark):
    texts = ["01-Jan-2025", " 01-01-2025 ", "2025-01-01", "1 JAN 2025", "01/01/2025", "", None]
    got = column_of(spark, texts, "string", cleaning.parse_date)
    assert got == [dt.date(2025, 1, 1)] * 4 + [None] * 3


def test_impossible_date_is_null(spark):
    assert column_of(spark, ["31-02-2025"], "string", cleaning.parse_date) == [None]


def test_headers(spark):
    assert cleaning.clean_header('\ufeff"Date" ') == "Date"
    assert cleaning.snake_header(" Company Name ") == "company_name"
    df = spark.createDataFrame([(None, "b")], "company_name string, companyname string")
    picked = df.select(cleaning.first_present(df, ("underlying", "company_name", "companyname")))
    assert picked.first()[0] is None  # a present column wins even where its cell is empty


def test_heat(spark):
    values = [0.0, 4.9, -5.0, 14.9, 15.0, 30.0, -50.0, None]
    assert column_of(spark, values, "double", labels.heat_level) == [0, 1, 2, 2, 3, 4, 5, 0]
    assert column_of(spark, values, "double", labels.heat_sign)[1:3] == ["positive", "negative"]
    assert column_of(spark, [0.0, None], "double", labels.change_class) == ["neutral", "neutral"]


def test_relative_strength_class(spark):
    got = column_of(spark, [5.1, 5.0, -5.0, -5.1, None], "double", labels.relative_strength_class)
    assert got == ["strong", "neutral", "neutral", "weak", "neutral"]


def test_volume_text(spark):
    values = [999, 1000, 250_000, 12_345_678]
    got = column_of(spark, values, "bigint", labels.volume_text)
    assert got == ["999", "1.00 K", "2.50 L", "1.23 Cr"]


def test_strength_class(spark):
    values = ["Full", "Partial (Low Volume)", "N/A", None]
    got = column_of(spark, values, "string", labels.strength_class)
    assert got == ["full", "partial", None, None]


def test_sparkline_labels(spark):
    lines = [[1.0, 3.0], [3.0, 1.0], [2.0, 5.0, 2.0], [1.0], [], None]
    got = column_of(spark, lines, "array<double>", labels.sparkline_trend)
    assert got == ["positive", "negative", "neutral", "none", "none", "none"]
    got = column_of(spark, [[1.0, 3.0, 2.0], [4.0, 4.0]], "array<double>", labels.sparkline_scaled)
    assert got == [[0.0, 1.0, 0.5], [0.0, 0.0]]
