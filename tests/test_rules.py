"""Each rule on a few triples, in both ways of answering and both ways of closing the schema."""

import random

import pytest

from loomgraph import terms as T
from loomgraph.engine import Engine
from loomgraph.plans import rules as R
from loomgraph.plans.rules import Atom, Profile, Rule, parse_rule_file, rule
from loomgraph.plans.tbox import TBox, assemble_lists

S = "s long, p long, o long"
a, b, c, d, e = 1001, 1002, 1003, 1004, 1005
P, Q, U = 400, 401, 402
C, D, E, F = 300, 301, 302, 303

# rule: (schema, lists, triples, what must follow)
CASES = {
    "prp-trp": ([(P, 0, 10)], [], [(a, P, b), (b, P, c), (c, P, d)], [(a, P, c), (a, P, d), (b, P, d)]),
    "prp-fp": ([(P, 0, 7)], [], [(a, P, b), (a, P, c)], [(b, 11, c), (c, 11, b), (b, 11, b), (c, 11, c)]),
    "prp-ifp": ([(P, 0, 8)], [], [(a, P, c), (b, P, c)], [(a, 11, b), (b, 11, a), (a, 11, a), (b, 11, b)]),
    "prp-spo1": ([(P, 4, Q)], [], [(a, P, b)], [(a, Q, b)]),
    "prp-dom": ([(P, 3, C)], [], [(a, P, b)], [(a, 0, C)]),
    "prp-rng": ([(P, 2, C)], [], [(a, P, b)], [(b, 0, C)]),
    "prp-eqp": ([(P, 14, Q)], [], [(a, P, b), (c, Q, d)], [(a, Q, b), (c, P, d)]),
    "prp-inv": ([(P, 12, Q)], [], [(a, P, b), (c, Q, d)], [(b, Q, a), (d, P, c)]),
    "prp-symp": ([(P, 0, 9)], [], [(a, P, b), (c, P, c)], [(b, P, a)]),
    "prp-spo2": ([(P, 29, 500)], [(500, 0, 0, Q), (500, 0, 1, U), (500, 1, 0, U)], [(a, Q, b), (b, U, c)], [(a, P, c), (b, P, c)]),
    "prp-key": ([(C, 30, 500)], [(500, 0, 0, P), (500, 0, 1, Q)],
                [(a, 0, C), (b, 0, C), (c, 0, C), (a, P, d), (b, P, d), (c, P, d), (a, Q, e), (b, Q, e), (c, Q, a)],
                [(a, 11, a), (a, 11, b), (b, 11, a), (b, 11, b), (c, 11, c)]),
    "cax-sco": ([(C, 5, D), (D, 5, E)], [], [(a, 0, C)], [(a, 0, D), (a, 0, E)]),
    "cax-eqc": ([(C, 13, D)], [], [(a, 0, C), (b, 0, D)], [(a, 0, D), (b, 0, C)]),
    "cls-hv1": ([(C, 15, d), (C, 16, P)], [], [(a, 0, C)], [(a, P, d)]),
    "cls-hv2": ([(C, 15, d), (C, 16, P)], [], [(a, P, d), (b, P, c)], [(a, 0, C)]),
    "cls-svf1": ([(C, 17, D), (C, 16, P)], [], [(a, P, b), (b, 0, D), (c, P, d)], [(a, 0, C)]),
    "cls-svf2": ([(C, 17, 34), (C, 16, P)], [], [(a, P, b)], [(a, 0, C)]),
    "cls-avf": ([(C, 18, D), (C, 16, P)], [], [(a, 0, C), (a, P, b)], [(b, 0, D)]),
    "cls-maxc2": ([(C, 36, 35), (C, 16, P)], [], [(a, 0, C), (a, P, b), (a, P, c)], [(b, 11, c), (c, 11, b), (b, 11, b), (c, 11, c)]),
    "cls-maxqc3": ([(C, 37, 35), (C, 16, P), (C, 38, D)], [], [(a, 0, C), (a, P, b), (a, P, c), (a, P, d), (b, 0, D), (c, 0, D)],
                   [(b, 11, c), (c, 11, b), (b, 11, b), (c, 11, c)]),
    "cls-maxqc4": ([(C, 37, 35), (C, 16, P), (C, 38, 34)], [], [(a, 0, C), (a, P, b), (a, P, c)], [(b, 11, c), (c, 11, b), (b, 11, b), (c, 11, c)]),
    "cls-uni": ([(C, 32, 500)], [(500, 0, 0, D), (500, 0, 1, E)], [(a, 0, D), (b, 0, E)], [(a, 0, C), (b, 0, C)]),
    "cls-oo": ([(C, 33, 500)], [(500, 0, 0, a), (500, 0, 1, b)], [(d, P, e)], [(a, 0, C), (b, 0, C)]),
    "cls-int1": ([(C, 31, 500)], [(500, 0, 0, D), (500, 0, 1, E), (500, 0, 2, F)], [(a, 0, D), (a, 0, E), (a, 0, F), (b, 0, D), (b, 0, E)], [(a, 0, C)]),
    "cls-int2": ([(C, 31, 500)], [(500, 0, 0, D), (500, 0, 1, E)], [(a, 0, C)], [(a, 0, D), (a, 0, E)]),
}

SCHEMA_CASES = {
    "scm-spo": ([(P, 4, Q), (Q, 4, U)], [(P, 4, U)]),
    "scm-sco": ([(C, 5, D), (D, 5, C)], [(C, 5, C), (D, 5, D)]),
    "scm-op": ([(P, 0, 41)], [(P, 4, P)]),
    "scm-op-eq": ([(P, 0, 41)], [(P, 14, P)]),
    "scm-dp": ([(P, 0, 40)], [(P, 4, P)]),
    "scm-dp-eq": ([(P, 0, 40)], [(P, 14, P)]),
    "scm-cls-thing": ([(C, 0, 6)], [(C, 5, 34)]),
    "scm-cls-self": ([(C, 0, 6)], [(C, 5, C)]),
    "scm-cls-nothing": ([(C, 0, 6)], [(39, 5, C)]),
    "scm-cls-eq": ([(C, 0, 6)], [(C, 13, C)]),
    "scm-eqp1": ([(P, 14, Q)], [(P, 4, Q), (Q, 4, P)]),
    "scm-eqp2": ([(P, 4, Q), (Q, 4, P)], [(P, 14, Q), (Q, 14, P)]),
    "scm-eqc1": ([(C, 13, D)], [(C, 5, D), (D, 5, C)]),
    "scm-eqc2": ([(C, 5, D), (D, 5, C)], [(C, 13, D), (D, 13, C)]),
    "scm-dom1": ([(P, 3, C), (C, 5, D)], [(P, 3, D)]),
    "scm-dom2": ([(Q, 3, C), (P, 4, Q)], [(P, 3, C)]),
    "scm-rng1": ([(P, 2, C), (C, 5, D)], [(P, 2, D)]),
    "scm-rng2": ([(Q, 2, C), (P, 4, Q)], [(P, 2, C)]),
    "scm-hv": ([(C, 15, a), (C, 16, P), (D, 15, a), (D, 16, Q), (P, 4, Q)], [(C, 5, D)]),
    "scm-svf1": ([(C, 17, E), (C, 16, P), (D, 17, F), (D, 16, P), (E, 5, F)], [(C, 5, D)]),
    "scm-svf2": ([(C, 17, E), (C, 16, P), (D, 17, E), (D, 16, Q), (P, 4, Q)], [(C, 5, D)]),
    "scm-avf1": ([(C, 18, E), (C, 16, P), (D, 18, F), (D, 16, P), (E, 5, F)], [(C, 5, D)]),
    "scm-avf2": ([(C, 18, E), (C, 16, P), (D, 18, E), (D, 16, Q), (P, 4, Q)], [(D, 5, C)]),
}
AS_IS = {
    "scm-dom2": ([(Q, 3, C), (Q, 4, P)], [(P, 3, C)]),
    "scm-rng2": ([(Q, 2, C), (Q, 4, P)], [(P, 2, C)]),
    "scm-svf1": ([(C, 17, E), (C, 16, P), (D, 17, E), (D, 16, P), (E, 5, F)], [(C, 5, C), (C, 5, D), (D, 5, C), (D, 5, D)]),
    "scm-avf2": ([(C, 18, E), (C, 16, P), (D, 18, E), (D, 16, Q), (P, 4, Q)], [(C, 5, D)]),
}


def frame(spark, rows, schema=S):
    return spark.createDataFrame(rows, schema)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_every_rule_has_a_case():
    names = {r.name for r in R.OWL2RL_SPEC.rules}
    assert names == set(CASES) | set(SCHEMA_CASES) | {"scm-int", "scm-uni"}
    assert len(R.OWL2RL_SPEC.rules) == 50 and len(R.RDFS.rules) == 6 and len(R.AFTER_CLOSURE.rules) == 19


@pytest.mark.parametrize("name", sorted(CASES))
def test_rule(spark, name):
    schema, lists, triples, want = CASES[name]
    made = frame(spark, lists, "head long, list_id int, pos int, el long") if lists else None
    eng = Engine(frame(spark, triples + triples[:1]), frame(spark, schema), made, profile=R.OWL2RL_SPEC.only(name))
    assert rows(eng.closure.derived) == sorted(want)
    # each conclusion is also found for its own goal
    s, p, o = want[0]
    got = rows(eng.pattern(None, p, o if p == 0 else None))
    assert set(got) == {t for t in [*triples, *want, *schema] if t[1] == p and (p != 0 or t[2] == o)}
    assert rows(eng.pattern(s, p, o)) == [want[0]]


@pytest.mark.parametrize("on_driver", [True, False])
@pytest.mark.parametrize("profile,cases", [(R.OWL2RL_SPEC, SCHEMA_CASES), (R.OWL2RL_ASIS, AS_IS)], ids=["spec", "as-is"])
def test_schema_rules(spark, profile, cases, on_driver):
    # the joins are covered by the random schemas too
    for name, (schema, want) in list(cases.items())[: None if on_driver else 3]:
        t = TBox(frame(spark, schema), profile.only(name), on_driver=on_driver)
        assert rows(t.closure.derived) == sorted(want), name


def test_cax_eqc_as_is_says_nothing(spark):
    eng = Engine(frame(spark, [(a, 0, C)]), frame(spark, [(C, 13, D)]), profile=R.OWL2RL_ASIS.only("cax-eqc"))
    assert rows(eng.closure.derived) == []


@pytest.mark.parametrize("name,want", [("scm-int", [(C, 5, D), (C, 5, E)]), ("scm-uni", [(D, 5, C), (E, 5, C)])])
def test_list_rules_of_the_schema(spark, name, want):
    stated = [(C, T.INTERSECTION_OF if name == "scm-int" else T.UNION_OF, 500)]
    cells = [(500, T.FIRST, D), (500, T.REST, 501), (501, T.FIRST, E), (501, T.REST, T.NIL)]
    t = TBox(frame(spark, stated + cells), R.OWL2RL_SPEC.only(name))
    assert rows(t.closure.derived) == sorted(want)


def test_lists(spark):
    cells = [(1, 26, 10), (1, 25, 2), (2, 26, 11), (2, 25, 3), (3, 26, 12), (3, 25, 28), (9, 26, 13), (9, 25, 28)]
    assert rows(assemble_lists(frame(spark, cells + cells[:2]))) == [(1, 0, 0, 10), (1, 0, 1, 11), (1, 0, 2, 12), (9, 0, 0, 13)]
    assert rows(assemble_lists(frame(spark, []))) == []
    with pytest.raises(ValueError, match="two firsts"):
        assemble_lists(frame(spark, [(1, 26, 10), (1, 26, 11), (1, 25, 28)]))
    with pytest.raises(ValueError, match="cycle"):
        assemble_lists(frame(spark, [(1, 26, 10), (1, 25, 2), (2, 26, 11), (2, 25, 3), (3, 26, 12), (3, 25, 2)]))


def naive(facts, profile, lists):
    """Brute force: every rule over every combination, until nothing is new."""
    from loomgraph.plans.rules import is_variable, unrolled

    facts = set(facts)
    flat = []
    for r in profile.rules:
        if r.kind != 4:
            flat.append((r, {}))
            continue
        for h, els in lists.items():
            link = next(x for x in r.schema if r.elements in x.terms())
            for s, p, o in list(facts):
                if p == link.p and o == h:
                    if r.each():
                        flat += [(Rule(r.name, r.head, (), r.body), {link.s: s, r.elements: x}) for x in els]
                    else:
                        u = unrolled(r, len(els))
                        flat.append((Rule(r.name, u.head, (), u.body), {link.s: s} | {f"?el_{i}": x for i, x in enumerate(els)}))
    while True:
        new = set()
        for r, fixed in flat:
            found = [dict(fixed)]
            for atom in (*r.schema, *r.body):
                step = []
                for row in found:
                    for f in facts | ({x[::-1] for x in facts} if atom.symmetric else set()):
                        nxt = dict(row)
                        if all((nxt.setdefault(t, v) if is_variable(t) else t) == v for t, v in zip(atom.terms(), f)):
                            step.append(nxt)
                found = step
            new |= {tuple(row[t] if is_variable(t) else t for t in r.head.terms()) for row in found}
        if new <= facts:
            return facts
        facts |= new


@pytest.mark.parametrize("seed", range(4))
def test_random_schemas(spark, seed):
    """Deriving ahead, deriving for a goal, both schema closures and brute force agree; a second closure adds nothing."""
    rnd = random.Random(seed)
    classes, props, things = [300, 301, 302, 303], [400, 401, 402, 403], [1001, 1002, 1003, 1004]
    makers = [
        lambda: (rnd.choice(classes), 5, rnd.choice(classes)),
        lambda: (rnd.choice(props), 4, rnd.choice(props)),
        lambda: (rnd.choice(props), rnd.choice([2, 3]), rnd.choice(classes)),
        lambda: (rnd.choice(props), 12, rnd.choice(props)),
        lambda: (rnd.choice(props), 0, rnd.choice([9, 10])),
        lambda: (rnd.choice(classes), 13, rnd.choice(classes)),
    ]
    schema = [rnd.choice(makers)() for _ in range(6)]
    if seed % 2:
        schema += [(303, 17, 300), (303, 16, 400), (403, 29, 500)]
    lists = {500: [400, 401]}
    triples = [(rnd.choice(things), rnd.choice(props), rnd.choice(things)) for _ in range(5)]
    triples += [(rnd.choice(things), 0, rnd.choice(classes)) for _ in range(3)]
    made = frame(spark, [(500, 0, i, x) for i, x in enumerate(lists[500])], "head long, list_id int, pos int, el long")
    profile = Profile("some", [r for r in R.OWL2RL_SPEC.rules if not r.name.startswith("scm-cls")])
    want = naive(triples + schema, profile, lists)
    eng = Engine(frame(spark, triples), frame(spark, schema), made, profile=profile)
    everything = eng.known.unionByName(eng.closure.derived).distinct()
    assert set(rows(everything)) == want
    joined = TBox(frame(spark, schema), profile, made, on_driver=False)
    assert rows(joined.closed) == rows(eng.tbox.closed)
    for goal in ((None, 0, classes[seed % 4]), (None, props[seed % 4], None)):
        got = rows(eng.pattern(*goal))
        assert got == sorted(f for f in want if f[1] == goal[1] and (goal[2] is None or f[2] == goal[2]))


def test_cycles_end(spark):
    ring = [(1 + i, 5, 1 + (i + 1) % 10) for i in range(10)]
    t = TBox(frame(spark, [(s + 300, p, o + 300) for s, p, o in ring]), R.RDFS)
    assert t.closed.where("p = 5").count() == 100 and t.closed.where("p = 13").count() == 100


def test_large_schema_takes_the_joins(spark):
    t = TBox(frame(spark, [(10_000 + i, 5, 10_001 + i) for i in range(30)] + [(1, 5, 2)] * 3), R.RDFS)
    assert t.facts is not None and t.closed.count() == 30 * 31 // 2 + 1
    wide = [(10_000 + i, 5, 300 + i % 3) for i in range(2_100)] + [(300, 5, 310)]
    t = TBox(frame(spark, wide), R.RDFS)
    assert t.facts is None and t.closed.count() == 2_101 + 700


def test_rule_files():
    text = (
        "3\t(?near 700 ?far) :- (?link 4 701)@[rdfs-subproperties]@@(?near ?link ?stop),(?stop ?link ?far)\n"
        "1\t(?one 14 ?two) :- (?one 12 ?two)@[owl-inverse+]\n"
        "2\t(?thing 702 ?kind) :- (?kind 5 703)@[rdfs-subclasses*],(?kind 16 ?link)@[owl-on-properties],(?thing ?link ?any)\n\n"
        "4\t(?u_0 ?way ?u_n+1) :- (?way 30 ?steps)@[owl2-has-key]@@(?steps)@[owl2-has-key-list]@@(?u_n ?el_n ?u_n+1)\n"
    )
    r = parse_rule_file(text)
    assert [x.kind for x in r] == [3, 1, 2, 4]
    assert r[1].schema[0].symmetric and r[3].elements == "?steps" and not r[3].each()
    for bad in ("x\t(?a 0 ?b) :- (?a 1 ?b)", "2\t(?a 0 ?b) :- (?a 1 ?c)", "3\t(?a 0 ?b) :- (?a 1 ?b)", "2\t(?a 0) :- (?a 1 ?b)"):
        with pytest.raises(ValueError):
            parse_rule_file(bad)
    with pytest.raises(ValueError, match="not bound"):
        rule("bad", "?a TYPE ?z <- ; ?a TYPE ?b")


def test_own_rules(spark):
    text = "3\t(?a 600 ?c) :- (?p 4 601)@[rdfs-subproperties]@@(?a ?p ?b),(?b ?p ?c)"
    eng = Engine(frame(spark, [(a, P, b), (b, P, c)]), frame(spark, [(P, 4, 601)]), profile=Profile("own", parse_rule_file(text)))
    assert rows(eng.pattern(None, 600, None)) == [(a, 600, c)]


def test_other_rules_after_the_closure(spark):
    """The schema closes by one profile, instances follow another."""
    eng = Engine(frame(spark, [(a, 0, C), (a, P, b)]), frame(spark, [(C, 5, D), (D, 5, E), (P, 4, Q), (P, 0, 7)]), after=R.AFTER_CLOSURE)
    assert rows(eng.closure.derived) == [(a, 0, D), (a, 0, E), (a, Q, b)]
    only = Engine(frame(spark, [(a, 0, C), (a, P, b)]), frame(spark, [(C, 5, D), (D, 5, E), (P, 4, Q)]), after=R.RDFS.only("cax-sco"))
    assert rows(only.closure.derived) == [(a, 0, D), (a, 0, E)]


def test_unknown_predicate_goal(spark):
    """A free predicate asks for everything that follows."""
    eng = Engine(frame(spark, [(a, P, b)]), frame(spark, [(P, 4, Q), (Q, 4, U)]))
    assert {t[1] for t in rows(eng.pattern(a, None, b))} == {P, Q, U}
    assert rows(eng.pattern(None, Q, None, exclude_explicit=True)) == [(a, Q, b)]
    assert rows(eng.bgp([Atom(a, "?p", "?x")]).select("p", "x")) == [(P, b), (Q, b), (U, b)]


def test_list_assembly_has_every_list_of_a_head(spark, tmp_path):
    from loomgraph.graph_queries import list_assembly

    data = [(7, 0, 5, 70), (7, 0, 2, 71), (7, 1, 0, 72), (7, 1, 1, 70), (7, 1, 1, 70), (7, 1, 4, None), (8, 1, 0, 7), (10**15 + 7, 0, 0, 73), (9, 0, 0, None)]
    spark.createDataFrame(data, "head long, list_id int, pos int, el long").write.parquet(f"{tmp_path}/lists.parquet")
    got = sorted(tuple(r) for r in list_assembly(spark, str(tmp_path)).select("head", "list_id", "pos", "el").collect())
    assert got == [(7, 0, 0, 71), (7, 0, 1, 70), (7, 1, 0, 72), (7, 1, 1, 70), (8, 1, 0, 7), (10**15 + 7, 0, 0, 73)]


def test_schema_that_follows_by_instance_rules(spark):
    e = Engine(frame(spark, [(300, 5, 10), (100, 0, 300), (1000, 100, 1001), (1001, 100, 1002)]))
    assert (1000, 100, 1002) in rows(e.pattern(1000, 100, None)) and (1000, 100, 1002) in rows(e.forward())
    e = Engine(frame(spark, [(900, 4, 5), (400, 900, 401), (5000, 0, 400)]))
    assert rows(e.pattern(None, 0, 401)) == [(5000, 0, 401)]
    assert {(400, 5, 401), (5000, 0, 401)} <= set(rows(e.forward()))


def test_bound_goals_follow_a_transitive_property(spark):
    from loomgraph.workspace import Workspace

    data = [(c * 1000 + i, P, c * 1000 + i + 1) for c in range(1, 21) for i in range(40)] + [(1040, P, 1000), (2010, Q, 3010)]
    e = Engine(frame(spark, data), frame(spark, [(P, 0, 10), (Q, 4, P), (U, 12, P)]))
    Workspace.counts.clear()
    assert {o for _, _, o in rows(e.pattern(5003, P, None))} == set(range(5004, 5041))
    written = sum(n for op, t, n in Workspace.counts if (op, t) == ("reach", "new"))
    assert written == 37
    assert {o for _, _, o in rows(e.pattern(2000, P, None))} == {*range(2001, 2041), *range(3010, 3041)}
    assert {o for _, _, o in rows(e.pattern(1007, P, None))} == set(range(1000, 1041))  # a ring
    assert {s for s, _, _ in rows(e.pattern(None, P, 3012))} == {*range(3000, 3012), *range(2000, 2011)}
    assert rows(e.pattern(2000, P, 3040)) == [(2000, P, 3040)] and rows(e.pattern(3000, P, 2001)) == []
    assert {s for s, _, _ in rows(e.pattern(None, U, 2000))} == {*range(2001, 2041), *range(3010, 3041)}  # the inverse
    seeds = spark.createDataFrame([(4000,), (4020,), (77,)], "s long")
    assert e.pattern(None, P, None, seeds={"s": seeds}).count() == 40 + 20
    got = e.bgp([Atom(4030, P, "?x"), Atom("?x", P, "?y")])
    assert got.count() == 10 * 9 // 2


def test_many_bindings_are_looked_up_by_goal(spark):
    """A hierarchy with more pairs than go to the driver, answered without deriving all members."""
    from loomgraph.plans.backward import rewrite

    n = 90
    e = Engine(frame(spark, [(7, 0, 300), (8, 0, 300 + n - 1), (9, 0, 300 + n)]), frame(spark, [(300 + i, 5, 301 + i) for i in range(n)]), profile=R.RDFS)
    side = next(r for r in e.tbox.compiled if r.name == "cax-sco")
    assert side.rows is None
    assert len(rewrite((None, 0, 300 + n), e.tbox.compiled)) == n + 1
    assert rows(e.pattern(None, 0, 300 + n)) == [(7, 0, 300 + n), (8, 0, 300 + n), (9, 0, 300 + n)]
    assert rows(e.pattern(None, 0, 300 + n - 1)) == [(7, 0, 300 + n - 1), (8, 0, 300 + n - 1)]


def test_needless_bindings_go(spark):
    own = Profile("own", [rule("a", "?x TYPE ?c <- ?p DOMAIN ?c ; ?x ?p ?y"), rule("b", "?u TYPE ?d <- ?q DOMAIN ?d ; ?u ?q ?v"),
                          rule("c", "?x TYPE ?c <- ?c HAS_VALUE ?v, ?c ON_PROPERTY ?p ; ?x ?p ?v")])
    schema = [(P, 3, C), (Q, 3, D), (C, 15, 50), (C, 16, P), (D, 15, 51), (D, 16, P)]
    e = Engine(frame(spark, [(a, P, b), (b, P, 51)]), frame(spark, schema), profile=own)
    kept = {r.name: len(r.rows) for r in e.tbox.compiled}
    assert kept == {"a": 2, "c": 1}  # b says what a says, and C needs no value
    assert rows(e.forward()) == [(a, 0, C), (b, 0, C), (b, 0, D)]


def test_whole_goals_stop_early_and_answers_are_tagged(spark):
    e = Engine(frame(spark, [(a, P, b), (b, P, c)]), frame(spark, [(P, 4, Q), (P, 0, 10)]))
    assert rows(e.pattern(a, P, c)) == [(a, P, c)] and rows(e.pattern(c, P, a)) == []
    assert rows(e.pattern(None, P, None, tag_explicit=True)) == [(a, P, b, True), (a, P, c, False), (b, P, c, True)]


def test_links_connect_what_all_pairs_do(spark):
    def groups(pairs):
        out = {}
        for x, y in pairs:
            one = out.get(x, {x}) | out.get(y, {y})
            for v in one:
                out[v] = one
        return {frozenset(g) for g in out.values()}

    hub = [(1, P, 100 + i) for i in range(40)] + [(2, P, 139), (2, P, 200), (300, Q, 7), (301, Q, 7), (302, Q, 8)]
    keys = [(x, 0, C) for x in (400, 401, 402)] + [(x, U, 5) for x in (400, 401, 402)] + [(x, Q + 50, v) for x, v in ((400, 1), (401, 1), (402, 2))]
    cards = [(500, 0, D), (500, 77, 501), (500, 77, 502), (501, 0, E), (502, 0, E), (500, 77, 503)]
    schema = [(P, 0, 7), (Q, 0, 8), (C, 30, 900), (D, 37, 35), (D, 16, 77), (D, 38, E)]
    lists = spark.createDataFrame([(900, 0, 0, U), (900, 0, 1, Q + 50)], "head long, list_id int, pos int, el long")
    eng = Engine(frame(spark, hub + keys + cards + [(600, 11, 601)]), frame(spark, schema), lists)
    links, pairs = rows(eng.same_as_links()), rows(eng.pattern(None, 11, None))
    assert groups((x, y) for x, _, y in links) == groups((x, y) for x, _, y in pairs)
    assert len(pairs) > 40 * 40 and len(links) < 70
