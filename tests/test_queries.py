"""Every core query with an SQL equivalent, on the smallest tables."""

import pytest

from loomgraph import queries
from tests.conftest import compare

Q, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, name):
    got, want = compare(spark, data, Q[name], SQL[name])
    assert got == want


def test_every_query_has_sql():
    assert set(Q) == set(SQL)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
