"""The corpus queries that have SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from lodestone.llm.entries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", oracle_sql())
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    theirs = con.sql(oracle_sql()[name])
    ours = queries()[name](spark, SF)
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    at = [theirs.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in ours.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in theirs.fetchall())
