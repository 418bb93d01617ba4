"""Every query with SQL gives the same rows in Spark and in DuckDB."""

from __future__ import annotations

import pytest

import __spark_entry__ as registered
from compare import database, difference
from conftest import SF_DIR

SQL = registered.oracle_sql()
QUERIES = registered.queries()


@pytest.fixture(scope="module")
def tables():
    return database(SF_DIR)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, tables, name):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    assert difference(got, tables.execute(SQL[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_give_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert registered.entry(spark).count() > 0
