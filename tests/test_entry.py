"""The driver's contract: names, columns, and equality with DuckDB on the small tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
PLAIN = [q for q in entry.oracle_sql() if not q.startswith("op") and q != "pipeline"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert sorted(r["size"] for r in entry.entry(spark).collect()) == [6, 77]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", PLAIN)
def test_matches_duckdb(spark, duck, name):
    frame = entry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in frame.select(*columns).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
