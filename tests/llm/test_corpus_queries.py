"""Registered corpus queries against SQL, and the pipeline end to end, on the smallest tables."""

import os

import duckdb
import pytest

import corpus_pipeline
from barscreen.llm.queries import ORACLE, QUERIES
from conftest import SF_DIR


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for file in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS FROM '{SF_DIR}/{file}'")
    return con


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_matches_oracle(spark, oracle, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    ours = sorted(map(tuple, df.select(columns).collect()), key=repr)
    theirs = oracle.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})").fetchall()
    assert ours == sorted(theirs, key=repr)


def test_pipeline_keeps_the_columns_and_packs_everything(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, left, SF_DIR)
        assert out.columns == docs.columns
        left = out
    packed = corpus_pipeline.run(spark, SF_DIR)
    assert packed.select("doc_id").distinct().count() == left.select("doc_id").distinct().count() > 0


def test_near_copies_of_the_pipeline_share_five_words_at_80_percent(spark):
    base = [f"w{i}" for i in range(100)]
    # 96 of 108 five-word shingles are shared, but only 98 of 110 three-word ones
    texts = [" ".join(base), " ".join(base + [f"x{i}" for i in range(12)]), " ".join(base[:40] + [f"y{i}" for i in range(40)])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, SF_DIR).collect()} == {0, 2}


def test_near_copies_of_the_pipeline_keep_one_of_equal_rows(spark):
    rows = [(1, "a b c"), (1, "a b c"), (1, "d e f"), (2, "g h i"), (None, "j k"), (None, "j k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = [tuple(r) for r in corpus_pipeline.near_copies(spark, docs, SF_DIR).collect()]
    assert sorted(out, key=repr) == sorted(set(rows), key=repr)
