"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest
from benchmark_tables import SF_DIR

import __spark_entry__ as entry
from check import compare, database

QUERIES = entry.queries()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    outcome, _ = compare(spark, con, QUERIES[name], SQL.get(name), SF_DIR)
    assert outcome.startswith(("ok", "rows-only")), outcome


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_sql_only_for_registered_queries():
    assert set(SQL) <= set(QUERIES)
