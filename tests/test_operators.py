"""Rejected lines, skewed keys and hierarchies on small and odd inputs."""

import random

import pytest

from loomgraph.operators.hierarchy import Hierarchy
from loomgraph.operators.rejects import parse_lines
from loomgraph.operators.skew import heavy_keys, heavy_statistics, keyed_statistics

LINES = [
    ("1\t<http://a>", None), ("2\t\"x\"\r", None), ("3\t\"x\\\"y\"@en-GB", None), ("4\t\"x\"^^<http://t>", None),
    ("9223372036854775807\t<a:b>", None), ("00012\t<u+r.n-1:x>", None), ("5\t\"a\\\\\"", None), ("6\t\"<b>\"", None),
    ("7\t\" \"", None), ("8\t<a:b'c>", None),
    ("", "column_count"), (" ", "column_count"), ("x", "column_count"), ("1\t\"a\"\t", "column_count"), ("\t\t", "column_count"),
    ("1\r", "column_count"), ("1\t\"a\tb\"", "column_count"),
    ("\t\"a\"", "bad_id"), ("x\t\"a\"", "bad_id"), ("-1\t\"a\"", "bad_id"), ("+1\t\"a\"", "bad_id"), (" 1\t\"a\"", "bad_id"),
    ("1.0\t\"a\"", "bad_id"), ("1e3\t\"a\"", "bad_id"), ("1_0\t\"a\"", "bad_id"), ("9223372036854775808\t\"a\"", "bad_id"),
    ("٣\t\"a\"", "bad_id"), ("1\n\t\"a\"", "bad_id"), ("x\t", "bad_id"),
    ("1\t", "bad_quoting"), ("1\ta", "bad_quoting"), ("1\t\"a", "bad_quoting"), ("1\ta\"", "bad_quoting"), ("1\t\"a\"b\"", "bad_quoting"),
    ("1\t\"a\\\"", "bad_quoting"), ("1\t\"a\"@", "bad_quoting"), ("1\t\"a\"^^", "bad_quoting"), ("1\t\"a\"^^b", "bad_quoting"),
    ("1\t<a:b>>", "bad_quoting"), ("1\t<<a:b>", "bad_quoting"), ("1\t <a:b>", "bad_quoting"), ("1\t'a'", "bad_quoting"), ("1\t\"a\"\r\r", "bad_quoting"),
    ("1\t\"", "bad_quoting"), ("1\t<", "bad_quoting"),
    ("1\t<>", "bad_value"), ("1\t<a>", "bad_value"), ("1\t<a:>", "bad_value"), ("1\t<1a:b>", "bad_value"), ("1\t<a:b c>", "bad_value"),
    ("1\t<a:b\u2003c>", "bad_value"), ("1\t<a:\u00a0>", "bad_value"), ("1\t<a:\"b>", "bad_value"), ("1\t<a:\u0007>", "bad_value"),
    ("1\t<a:\ufffd>", "bad_value"), ("1\t\"\"", "bad_value"), ("1\t\"\"@en", "bad_value"), ("1\t\"a\nb\"", "bad_value"), ("1\t\"a\x00b\"", "bad_value"),
    ("1\t\"\u0085\"", "bad_value"), ("1\t\"\ufffd\"", "bad_value"), ("1\t\"\x02\"", "bad_value"), ("1\t\"x\"^^<t>", "bad_value"), ("1\t<a:b\r>", "bad_value"),
]


def test_lines(spark):
    df = spark.createDataFrame([(i, f"f{i % 3}" if i % 5 else None, t, 1) for i, (t, _) in enumerate(LINES)], "line_id long, file_name string, line_text string, id int")
    got = {r["line_id"]: r for r in parse_lines(df, "line_id", "file_name", "line_text").collect()}
    assert {i: r["reason"] for i, r in got.items()} == dict(enumerate(r for _, r in LINES))
    assert (got[1]["id"], got[1]["text"]) == (2, '"x"') and got[5]["id"] == 12 and got[4]["id"] == (1 << 63) - 1
    assert got[20]["id"] is None and got[20]["text"] is None


def test_lines_long_repeated_and_empty(spark):
    schema = "line_id long, file_name string, line_text string"
    long = ["1\t\"" + "a" * 3_000_000 + "\"", "1\t\"" + "\\\\" * 500_000 + "\"", "1\t" + "<" * 300_000, "x" * 3_000_000]
    df = spark.createDataFrame([(7, "f", long[0]), (7, "f", long[0]), (8, "f", long[1]), (9, "f", long[2]), (10, "f", long[3]), (11, "f", None), (None, None, "z")], schema)
    got = sorted(((r["line_id"], r["reason"]) for r in parse_lines(df, "line_id", "file_name", "line_text").collect()), key=str)
    assert got == sorted([(7, None), (7, None), (8, None), (9, "bad_quoting"), (10, "column_count"), (None, "column_count")], key=str)
    assert parse_lines(spark.createDataFrame([], schema), "line_id", "file_name", "line_text").count() == 0


def test_keyed_statistics(spark):
    rnd = random.Random(1)
    data = [(rnd.choice([1, 1, 1, 1, 2, 3, None]), rnd.choice([5, 6, 7, None]), rnd.choice([None, 10, 20, 30])) for _ in range(500)]
    data += [(9, None, None), (9, None, None)]
    df = spark.createDataFrame([(*r, "x", 0) for r in data], "p long, o long, t long, val string, __n int")
    got = {r["val"]: (r["n_rows"], r["n_distinct"], r["latest"]) for r in keyed_statistics(df, "p", "o", "t").collect()}
    want = {}
    for k in {r[0] for r in data} - {None}:
        own = [r for r in data if r[0] == k]
        times = [t for _, _, t in own if t is not None]
        want[k] = (len(own), len({o for _, o, _ in own if o is not None}), max(times) if times else None)
    assert got == want
    assert keyed_statistics(df.limit(0), "p", "o", "t").count() == 0
    # the key itself may be the distinct column
    assert {r["n_distinct"] for r in keyed_statistics(df, "p", "p", "t").collect()} == {1}


def test_heavy_keys_at_the_border(spark):
    df = spark.createDataFrame([(k, i, i) for k, n in ((1, 98), (2, 1), (3, 1), (None, 50)) for i in range(n)], "p long, o long, t long")
    assert {tuple(r) for r in heavy_keys(df, ["p"], "0.01").collect()} == {("p", 1, 98), ("p", 2, 1), ("p", 3, 1)}
    assert {r["val"] for r in heavy_keys(df, ["p", "o"], "0.011").where("field_name = 'p'").collect()} == {1}
    assert [tuple(r) for r in heavy_statistics(df, ["p"], "o", "t", "0.011").collect()] == [("p", 1, 98, 98, 97)]
    assert heavy_keys(df.limit(0), ["p"]).count() == 0 and heavy_statistics(df.limit(0), ["p"], "o", "t").count() == 0


def brute_paths(links):
    """Every root path of every node, and the nodes on or below cycles."""
    clean = {(r, c, p) for r, c, p in links if None not in (r, c, p)}
    nodes = {(r, x) for r, c, p in clean for x in (c, p)}
    parents = {n: {p for r, c, p in clean if (r, c) == n and p != c} for n in nodes}

    def cyclic(n):
        seen, todo, first = set(), [n], True
        on = set()
        while todo:
            x = todo.pop()
            for p in parents[(n[0], x[1])]:
                y = (n[0], p)
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return any(reaches(y, y) for y in seen | {n})

    def reaches(a, b):
        seen, todo = set(), [a]
        while todo:
            x = todo.pop()
            for p in parents[x]:
                if (a[0], p) == b:
                    return True
                if (a[0], p) not in seen:
                    seen.add((a[0], p))
                    todo.append((a[0], p))
        return False

    def paths(n):
        if not parents[n]:
            return [[n[1]]]
        return [q + [n[1]] for p in parents[n] for q in paths((n[0], p))]

    out = []
    for n in nodes:
        if cyclic(n):
            out.append((*n, "cycle"))
        else:
            out += [(*n, "/".join(map(str, q))) for q in paths(n)]
    return sorted(out)


def found(spark, links):
    df = spark.createDataFrame([(*x, 1) for x in links], "relation string, child long, parent long, node_id int")
    h = Hierarchy(df)
    return h, sorted((r["relation"], r["node_id"], r["path"]) for r in h.node_paths().collect())


@pytest.mark.parametrize("seed", range(6))
def test_hierarchies_against_brute_force(spark, monkeypatch, seed):
    from loomgraph.operators import hierarchy

    monkeypatch.setattr(hierarchy, "LAYERS", seed % 3 * 2)
    rnd = random.Random(seed)
    links = [(rnd.choice("ab"), c := rnd.randrange(14), rnd.randrange(c, 15) if rnd.random() < 0.93 else rnd.randrange(14)) for _ in range(26)]
    links += [("a", None, 3), ("a", 3, None), (None, 1, 2), ("c", 5, 5)] + links[:4]
    _, got = found(spark, links)
    assert got == brute_paths(links)


def test_deep_chain_diamonds_and_hub(spark):
    chain = [("a", i, i + 1) for i in range(150)]
    diamonds = [x for i in range(0, 12, 3) for x in (("b", i, i + 1), ("b", i, i + 2), ("b", i + 1, i + 3), ("b", i + 2, i + 3))]
    hub = [("c", 1000 + i, 1) for i in range(500)] + [("c", 1, 2)]
    h, got = found(spark, chain + diamonds + hub)
    assert len([x for x in got if x[0] == "a"]) == 151 and max(r["depth"] for r in h.node_paths().collect()) == 150
    assert sum(1 for x in got if x[:2] == ("b", 0)) == 16
    assert h.descendants().where("relation = 'c' AND node_id = 2").count() == 501
    assert h.descendants().where("relation = 'a'").count() == 150 * 151 // 2
    assert {r["root"] for r in h.node_paths().where("relation = 'a'").collect()} == {150}


def test_only_cycles_and_nothing(spark):
    _, got = found(spark, [("a", 1, 2), ("a", 2, 1), ("a", 3, 2), ("a", 9, 9)])
    assert got == [("a", 1, "cycle"), ("a", 2, "cycle"), ("a", 3, "cycle"), ("a", 9, "9")]
    h, got = found(spark, [(None, 1, 2)])
    assert got == [] and h.descendants().count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_descendants_on_and_below_cycles(spark, seed):
    rnd = random.Random(seed)
    # an ordinary root over a ring with a tree below it, and a random graph
    links = [("a", 1, 0), ("a", 2, 1)] + [("a", 10 + i, 10 + (i + 1) % 7) for i in range(7)] + [("a", 12, 2), ("a", 20, 15), ("a", 21, 20), ("a", 22, 2)]
    links += [("b", rnd.randrange(20), rnd.randrange(20)) for _ in range(24)]
    want = {(r, p, c) for r, c, p in links if p != c}
    while more := {(r, u, v) for r, u, w in want for q, x, v in want if (r, w) == (q, x)} - want:
        want |= more
    df = spark.createDataFrame(links, "relation string, child long, parent long")
    got = [tuple(r) for r in Hierarchy(df).descendants().select("relation", "node_id", "descendant_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert ("a", 0, 16) in want and ("a", 10, 10) in want and ("a", 13, 21) in want


def test_descendants_of_many_paths(spark):
    """Pairs, not paths: 36 diamonds in a row have 2^36 paths."""
    links = [x for i in range(0, 108, 3) for x in (("b", i + 1, i), ("b", i + 2, i), ("b", i + 3, i + 1), ("b", i + 3, i + 2))]
    h = Hierarchy(spark.createDataFrame(links, "relation string, child long, parent long"))
    below = lambda i: 108 - i if i % 3 == 0 else 108 - (i // 3 + 1) * 3 + 1
    assert h.descendants().count() == sum(below(i) for i in range(108))
    assert h.cyclic.count() == 0
