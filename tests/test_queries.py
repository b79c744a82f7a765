"""Every query with SQL, against DuckDB on the smallest tables."""

import datetime
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = {k: v for k, v in entry.oracle_sql().items() if k.startswith("q_")}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    names = sorted(df.columns)
    mine = sorted((tuple(map(plain, r)) for r in df.select(names).collect()), key=repr)
    columns = ", ".join(f'"{c}"' for c in names)
    assert mine == sorted((tuple(map(plain, r)) for r in duck.sql(f"SELECT {columns} FROM ({SQL[name]})").fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
