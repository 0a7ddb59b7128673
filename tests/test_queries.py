"""Every query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare, database

DIR = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return database(DIR)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    ok, note, rows, _ = compare(spark, db, DIR, QUERIES[name], SQL.get(name))
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
