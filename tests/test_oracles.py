"""Every registered query with SQL of its own gives DuckDB's rows on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{TABLES}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value if isinstance(value, (int, bool, type(None))) else str(value)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    frame = entry.queries()[name](spark, TABLES)
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(frame.columns) == sorted(columns)
    order = sorted(columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in frame.collect()), key=repr)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in cursor.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
