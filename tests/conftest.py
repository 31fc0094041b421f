import datetime as dt
import os
import sys
from decimal import Decimal

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from barscreen.schemas import BANS, BARS, INDEX_BARS, STOCKS

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("barscreen-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(n: int, start: dt.date = dt.date(2025, 1, 1)) -> dt.date:
    return start + dt.timedelta(days=n)


def _typed(schema, rows):
    """Rows given as dicts; missing columns are NULL, numbers fit the column type."""
    out = []
    for row in rows:
        values = []
        for f in schema:
            v = row.get(f.name)
            if v is not None and f.dataType.typeName() == "decimal":
                v = Decimal(str(v)).quantize(Decimal("0.01"))
            values.append(v)
        out.append(tuple(values))
    return out


@pytest.fixture
def make(spark):
    """Build bars, index, bans or master tables from dicts."""
    schemas = {"bars": BARS, "index": INDEX_BARS, "bans": BANS, "master": STOCKS}

    def build(table, rows):
        schema = schemas[table]
        return spark.createDataFrame(_typed(schema, rows), schema)

    return build


def series(symbol, closes, **extra):
    """Bars of one symbol on consecutive days; extra columns are scalars or per-day lists."""
    rows = []
    for i, close in enumerate(closes):
        row = {
            "symbol": symbol, "date": day(i), "series": "EQ", "open": close, "high": close + 5,
            "low": close - 5, "close": close, "prev_close": closes[i - 1] if i else None,
            "volume": 1000, "delivery_volume": 500, "delivery_pct": 50,
        }
        for name, value in extra.items():
            row[name] = value[i] if isinstance(value, list) else value
        rows.append(row)
    return rows
