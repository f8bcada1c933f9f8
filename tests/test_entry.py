"""The registered queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from lodestone.plans.oracle import oracle_sql
from lodestone.plans.queries import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def test_every_query_has_sql():
    assert queries().keys() == oracle_sql().keys()


@pytest.mark.parametrize("name", queries())
def test_query(spark, duck, name):
    ours, theirs = queries()[name](spark, SF), duck.sql(oracle_sql()[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    rows = [tuple(r[c] for c in columns) for r in ours.collect()]
    at = [theirs.columns.index(c) for c in columns]
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r[i] for i in at)) for r in theirs.fetchall())


def test_entry(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert found.columns == ["rank", "doc_id", "_score", "title", "content", "tags"] and found.count() == 10
