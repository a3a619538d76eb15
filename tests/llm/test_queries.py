import pytest

from loomgraph.llm import queries
from tests.conftest import compare

Q, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, name):
    got, want = compare(spark, data, Q[name], SQL[name])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL)))
def test_query_runs(spark, data, name):
    df = Q[name](spark, data)
    assert df.columns and df.count() >= 0


def test_nothing_else_imports_the_subpackage():
    import os

    import loomgraph

    root = os.path.dirname(loomgraph.__file__)
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) == "llm" or "llm" in os.path.relpath(folder, root).split(os.sep):
            continue
        for f in files:
            if f.endswith(".py"):
                assert "loomgraph.llm" not in open(os.path.join(folder, f)).read(), f
