"""Every registered query that has SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from rosterlight.plans import queries

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DIR):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DIR}/{name}')")
    return con


def normal(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda x: "NULL" if x is None else repr(round(x, 6)) if isinstance(x, float) else str(x)
    return [columns[i] for i in at], sorted(tuple(cell(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_spark_and_duckdb_agree(spark, duck, name):
    df = queries.QUERIES[name](spark, DIR)
    want = duck.execute(queries.SQL[name])
    assert normal(df.columns, df.collect()) == normal([c[0] for c in want.description], want.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(entry.queries()) and set(queries.SQL) <= set(entry.oracle_sql())
