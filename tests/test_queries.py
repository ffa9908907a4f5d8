"""Every registered query against its SQL in DuckDB, on the smallest data."""

import datetime as dt

import duckdb
import pytest

import __spark_entry__ as entry
from shoebox.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([plain(row[i]) for i in order]) for row in rows), sorted(columns)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    cursor = duck.execute(ORACLES[name])
    assert got == canonical(cursor.fetchall(), [c[0] for c in cursor.description])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
