"""Every document query with SQL returns what DuckDB makes of it."""

import glob
import os

import duckdb
import pytest

from tidemill.llm import queries


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(rows, columns):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple("" if r[i] is None else str(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = queries.QUERIES[name](spark, sf), duck.sql(queries.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), want.columns)
