"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import oracle
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db(data):
    return oracle.duck(data)


def test_all_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, data, name):
    if name in SQL:
        assert oracle.compare(spark, db, data, name, QUERIES[name], SQL[name]) == ""
    else:
        assert QUERIES[name](spark, data).count() > 0
