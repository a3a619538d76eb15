import pytest

from loomgraph.engine import Engine
from loomgraph.operators.scan import connected_order, scan
from loomgraph.plans.rules import Atom

BIG = (1 << 40) + 5


@pytest.fixture(scope="module")
def triples(spark):
    rows = [
        (1, 10, 2), (1, 10, 3), (2, 10, 3), (2, 11, 2), (3, 11, BIG), (BIG, 10, 1),
        (1, 10, 2), (None, 10, 2), (1, None, 2), (1, 10, None), (None, None, None),
    ]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "s long, p long, o long, src_file string, n int")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_terms(spark, triples):
    everything = rows(scan(triples))
    assert len(everything) == 6
    for s in (None, 1, BIG, [1, 2], [], spark.createDataFrame([(1,), (None,), (BIG,), (1,)], "n long")):
        for p in (None, 10, [10, 11]):
            for o in (None, 3, [2, BIG]):

                def fits(v, t):
                    if t is None:
                        return True
                    if hasattr(t, "collect"):
                        return v in (1, BIG)
                    return v == t if isinstance(t, int) else v in t

                want = [r for r in everything if fits(r[0], s) and fits(r[1], p) and fits(r[2], o)]
                assert rows(scan(triples, s, p, o)) == want


def test_long_sets_are_joined(triples):
    assert rows(scan(triples, s=range(2000), o=range(2000))) == [r for r in rows(scan(triples)) if r[0] < 2000 and r[2] < 2000]


def test_empty(spark):
    empty = spark.createDataFrame([], "s long, p long, o long")
    assert rows(scan(empty)) == []
    assert rows(Engine(empty).pattern(None, 0, None)) == []
    assert rows(Engine(empty).bgp([Atom("?x", 1, "?y"), Atom("?y", 1, "?z"), Atom("?z", 1, "?x")])) == []


def test_filter_is_pushed_down(spark, triples, tmp_path):
    triples.write.parquet(f"{tmp_path}/t")
    plan = scan(spark.read.parquet(f"{tmp_path}/t"), p=10, o=[2, 3])._jdf.queryExecution().toString()
    assert "EqualTo(p,10)" in plan and "In(o, [2,3])" in plan and "ReadSchema: struct<s:bigint,p:bigint,o:bigint>" in plan


def test_repeated_variable(triples):
    assert rows(Engine(triples).bgp([Atom("?x", 11, "?x")], reason=False)) == [(2,)]


def test_bgp_order_does_not_matter(triples):
    atoms = [Atom("?x", 10, "?y"), Atom("?y", 10, "?z"), Atom("?z", 11, "?w")]
    e = Engine(triples)
    want = rows(e.bgp(atoms, reason=False).select("w", "x", "y", "z"))
    assert want == [(2, BIG, 1, 2), (BIG, 1, 2, 3), (BIG, BIG, 1, 3)]
    for order in ([2, 1, 0], [1, 0, 2], [1, 2, 0]):
        got = e.bgp([atoms[i] for i in order], reason=False, optimise=False)
        assert rows(got.select("w", "x", "y", "z")) == want


def test_cartesian_product_is_refused(triples):
    e = Engine(triples)
    with pytest.raises(ValueError, match="Cartesian"):
        e.bgp([Atom("?x", 10, "?y"), Atom("?a", 11, "?b")], reason=False)
    assert e.bgp([Atom("?x", 10, "?y"), Atom("?a", 11, "?b")], reason=False, allow_cross=True).count() == 8


def test_estimates_and_plan(triples):
    e = Engine(triples)
    atoms = [Atom("?x", 10, "?y"), Atom("?y", 11, "?z"), Atom("?z", 10, 1)]
    found = e.cardinality(atoms, implicit=False)
    assert [x.explicit for x in found] == [5, 2, 1]  # repeated statements are not told apart in an estimate
    assert e.explain(atoms, reason=False).splitlines()[0].startswith("?z 10 1")


def test_connected_order():
    atoms = [Atom("?a", 1, "?b"), Atom("?c", 1, "?d"), Atom("?b", 1, "?c")]
    assert connected_order(atoms) == [0, 2, 1]
