"""Every query with SQL must give the same rows as that SQL."""

import pytest

from signalcheck.queries import ORACLE, QUERIES
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def connection(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, folder, connection, name):
    assert compare(QUERIES[name](spark, folder), connection, ORACLE[name]) is None


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
