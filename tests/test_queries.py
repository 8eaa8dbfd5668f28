"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from fieldloom.plans.oracle import ORACLE
from fieldloom.plans.queries import REGISTRY

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_DIR}/{name}.parquet')")
    return con


def test_every_query_has_sql():
    assert set(REGISTRY) == set(ORACLE)
    assert set(REGISTRY) <= set(entry_point.queries())


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_sql(spark, duck, name):
    df = REGISTRY[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    answer = duck.sql(ORACLE[name])
    assert sorted(answer.columns) == columns
    places = [answer.columns.index(c) for c in columns]
    assert got == sorted(repr(tuple(r[i] for i in places)) for r in answer.fetchall())


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["source_table", "name", "info", "type", "doc_id", "fields"]
    assert {r["source_table"] for r in df.collect()} >= {"customer", "supplier"}
