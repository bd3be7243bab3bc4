"""Every query that SQL can express, on the smallest tables, against DuckDB."""

import pytest

from quillon import queries as own
from tests.compare import same, tables


@pytest.fixture(scope="module")
def con(data):
    return tables(data)


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_query(spark, data, con, name):
    same(own.queries()[name](spark, data), con, own.oracle_sql()[name])
