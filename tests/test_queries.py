"""Every registered query against its expected result, on the smallest data set."""

import duckdb
import pytest

import __spark_entry__ as entry
from tracewell.plans.oracle import SQL
from tracewell.plans.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 9)
    return value.replace(tzinfo=None) if hasattr(value, "tzinfo") else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i].lower())
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def test_names_agree():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, database, name):
    got = entry.queries()[name](spark, FOLDER)
    want = database.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())
