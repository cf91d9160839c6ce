"""Every named query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import SMOKE_DIR, entry, oracle_sql, queries
from check_queries import compare, database


@pytest.fixture(scope="module")
def connection():
    return database(SMOKE_DIR)


def test_entry_totals(spark):
    total = entry(spark).agg({"n_chunks": "sum", "n_tokens": "sum"}).first()
    assert sorted(total) == [914, 160178]


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, connection, name):
    assert compare(spark, connection, name, SMOKE_DIR) == ""
