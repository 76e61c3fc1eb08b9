"""Every query with SQL gives the same rows in DuckDB."""

import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerline import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(x):
    if isinstance(x, Decimal):
        x = float(x)
    return "null" if x is None else f"{x:.5f}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_duckdb(spark, name):
    ours = catalog.QUERIES[name](spark, DATA)
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    path = f"{DATA}/events.parquet"
    con.sql(f"create view events as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    theirs = con.sql(catalog.ORACLES[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    a = sorted([plain(r[c]) for c in columns] for r in ours.collect())
    at = [theirs.columns.index(c) for c in columns]
    b = sorted([plain(r[i]) for i in at] for r in theirs.fetchall())
    assert len(a) == len(b)
    assert [x for x, y in zip(a, b) if x != y][:3] == [y for x, y in zip(a, b) if x != y][:3]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
