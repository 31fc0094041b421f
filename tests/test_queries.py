"""Every registered query against its oracle SQL, and the derivation under skew."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from conftest import SF_DIR
from workload import tables as t
from workload.oracle import ORACLE
from workload.queries import QUERIES


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for file in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS FROM '{SF_DIR}/{file}'")
    return con


def _key(row):
    return tuple((v is None, v if v is not None else 0) for v in row)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_oracle(spark, oracle, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    ours = sorted((tuple(r) for r in df.select(columns).collect()), key=_key)
    quoted = ", ".join(f'"{c}"' for c in columns)
    theirs = oracle.sql(f"SELECT {quoted} FROM ({ORACLE[name]})").fetchall()
    assert ours == sorted(theirs, key=_key)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    assert entry_module.entry(spark).count() == 278


def test_bars_with_a_hot_part_and_copies(spark, tmp_path):
    """A third of all line items on one part, many of them exact copies."""
    lines = t.given(spark, SF_DIR, "lineitem")
    n = lines.count()
    hot = spark.range(n // 2).crossJoin(lines.limit(1)).drop("id")
    lines.unionByName(hot).write.parquet(str(tmp_path / "lineitem.parquet"))
    t.given(spark, SF_DIR, "part").write.parquet(str(tmp_path / "part.parquet"))
    bars = t.bars(spark, str(tmp_path))
    plain = t.bars(spark, SF_DIR)
    assert bars.count() == plain.count()
    assert bars.agg(F.sum("trades")).first()[0] == n + n // 2
    prices = ["symbol", "date", "open", "high", "low", "close", "prev_close"]
    assert bars.select(prices).exceptAll(plain.select(prices)).count() == 0
