"""Every query of the core that has SQL gives the same rows as the SQL."""

from __future__ import annotations

import pytest
from tests.oracle import connect, duckdb_rows, spark_rows

from tshegflow.plans import registry

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    assert spark_rows(QUERIES[name](spark, FOLDER)) == duckdb_rows(con, SQL[name])
