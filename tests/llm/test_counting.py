"""Frequent values, groups and term frequencies against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomgraph.llm import components, heavy_hitters, term_frequency


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_top_k_ties_and_nulls(spark):
    data = [3] * 5 + [1] * 5 + [2] * 7 + [4] + [None] * 20
    df = spark.createDataFrame([(x, 1, 2) for x in data], "o long, n long, val long")
    assert [tuple(r) for r in heavy_hitters.top_k(df, "o", 2).collect()] == [(2, 7), (1, 5)]
    assert heavy_hitters.top_k(df, "o", 10).count() == 4
    assert heavy_hitters.top_k(df.limit(0), "o", 10).count() == 0
    assert heavy_hitters.top_k(df.where("o IS NULL"), "o", 10).count() == 0


def test_share_is_exact(spark):
    # 400 values, each exactly at the share; one below
    df = spark.createDataFrame([(i, 1) for i in range(400)] + [(None, 1)], "o long, n int")
    assert heavy_hitters.frequent_values(df, ["o"], "0.0025").count() == 400
    df = spark.createDataFrame([(i,) for i in range(401)], "o long")
    assert heavy_hitters.frequent_values(df, ["o"], "0.0025").count() == 0
    df = spark.createDataFrame([(i % 3, None if i % 2 else 7) for i in range(99)], "o long, s long")
    assert rows(heavy_hitters.frequent_values(df, ["o", "s"], "0.5")) == [("s", 7, 50)]
    assert heavy_hitters.frequent_values(df.limit(0), ["o", "s"], "0.5").count() == 0


def groups_by_hand(pairs):
    parent = {}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for w, a, b in pairs:
        if None in (w, a, b):
            continue
        for x in ((w, a), (w, b)):
            parent.setdefault(x, x)
        x, y = find((w, a)), find((w, b))
        parent[max(x, y)] = min(x, y)
    return sorted((x[0], find(x)[1], x[1]) for x in parent)


def shapes():
    rnd = random.Random(3)
    chain = [("a", i, i + 1) for i in range(300)]
    rnd.shuffle(chain)
    yield "chain", chain
    yield "star", [("a", 10**12, i) for i in range(300)] + [("b", i, 10**12 + i % 7) for i in range(100)]
    yield "random", [(rnd.choice("ab"), rnd.randrange(200), rnd.randrange(200)) for _ in range(180)]
    yield "loops", [("a", 5, 5), ("a", 5, 5), ("b", 6, 7), ("b", 7, 6), ("a", None, 1), ("a", 1, None), (None, 1, 2), ("c", -4, 9)]
    yield "nothing", []
    yield "nulls", [("a", None, None)]


@pytest.mark.parametrize("name,pairs", list(shapes()), ids=[n for n, _ in shapes()])
def test_groups(spark, name, pairs):
    df = spark.createDataFrame([(*p, 1, 1) for p in pairs], "kind string, a long, b long, v int, w int")
    got = components.connected_groups(df, "kind", "a", "b")
    assert got.columns == ["kind", "group_id", "member_id"]
    assert rows(got) == groups_by_hand(pairs)


def test_suffix_array_and_lcp():
    rnd = np.random.default_rng(5)
    t = rnd.integers(0, 3, 60)
    for depth in (1, 2, 3, 5, 8):
        order = term_frequency.suffix_array(t, depth)
        key = lambda i: (tuple(t[i : i + depth]), i)
        assert order.tolist() == sorted(range(60), key=key)
        lcp = term_frequency.common_prefixes(t, order, depth)
        for k in range(1, 60):
            a, b = t[order[k - 1] :], t[order[k] :]
            n = 0
            while n < min(len(a), len(b), depth) and a[n] == b[n]:
                n += 1
            assert lcp[k] == n


@pytest.mark.parametrize("max_n", [1, 2, 4])
def test_ngrams(spark, monkeypatch, max_n):
    monkeypatch.setattr(term_frequency, "BLOCK", 1 << 20 if max_n % 2 else 25)
    rnd = random.Random(max_n)
    texts = [[rnd.choice(["a", "b", "c", None]) for _ in range(rnd.randrange(12))] for _ in range(40)] + [None, [], ["a"] * 30, [None, None]]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, words array<string>, gram string")
    occ, rec = Counter(), defaultdict(set)
    for i, t in enumerate(texts):
        for n in range(1, max_n + 1):
            for k in range(len(t or []) - n + 1):
                g = tuple(t[k : k + n])
                if None not in g:
                    occ[g] += 1
                    rec[g].add(i)
    got = {tuple(r["gram"].split(" ")): (r["n"], r["occurrences"], r["records"]) for r in term_frequency.ngram_frequencies(df, "words", max_n).collect()}
    assert got == {g: (len(g), occ[g], len(rec[g])) for g in occ}
    assert term_frequency.ngram_frequencies(df.limit(0), "words", 2).count() == 0


@pytest.mark.parametrize("block", [1 << 20, 7])
def test_value_frequencies(spark, monkeypatch, block):
    monkeypatch.setattr(term_frequency, "BLOCK", block)
    rnd = random.Random(9)
    data = [(rnd.choice([1, 1, 1, 2, 3, -5, 1 << 60, None]), rnd.choice([10, 10, 10, 11, 12, 13, None])) for _ in range(400)] + [(77, None)]
    df = spark.createDataFrame([(*r, 0) for r in data], "p long, s long, n int").repartition(5)
    want = []
    for v in {p for p, _ in data} - {None}:
        own = [s for p, s in data if p == v]
        want.append((v, len(own), len(set(own) - {None})))
    assert rows(term_frequency.value_frequencies(df, "p", "s")) == sorted(want)
    assert term_frequency.value_frequencies(df.limit(0), "p", "s").count() == 0


def test_words(spark):
    df = spark.createDataFrame([(1, "The cat_1, the Été—x"), (2, None), (3, "")], "id long, text string")
    got = [r["w"] for r in df.select(term_frequency.words("text").alias("w")).collect()]
    assert got == [["the", "cat_1", "the", "été", "x"], None, []]


def test_value_counts_come_from_the_intervals(monkeypatch):
    """Without the common prefixes all values would be one."""
    order = term_frequency.common_prefixes
    assert len(term_frequency.gram_intervals(np.arange(50) % 5, np.arange(50), np.ones(50), 1)[0][1]) == 5
    monkeypatch.setattr(term_frequency, "common_prefixes", lambda t, o, d: np.ones_like(order(t, o, d)))
    assert len(term_frequency.gram_intervals(np.arange(50) % 5, np.arange(50), np.ones(50), 1)[0][1]) == 1
