"""Classes of n-grams of every length against brute force."""

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from loomgraph.llm import gram_classes, queries


def test_own_prefixes():
    rnd = np.random.default_rng(7)
    t, r = rnd.integers(0, 2, 80), np.sort(rnd.integers(0, 6, 80))
    got = gram_classes.own_prefixes(t, r)
    for n in (1, 2, 3, 5, 9):
        places = defaultdict(list)
        for i in range(80 - n + 1):
            if r[i] == r[i + n - 1]:
                places[r[i], tuple(t[i : i + n])].append(i)
        assert all(sum(got[i] < n for i in p) == 1 for p in places.values())


def test_all_lengths(spark, monkeypatch):
    monkeypatch.setattr(gram_classes, "BLOCK", 40)
    rnd = random.Random(1)
    texts = [[rnd.choice(["a", "b", "c", None]) for _ in range(rnd.randrange(12))] for _ in range(25)] + [None, [], ["a"] * 30, [None, None]]
    long = [rnd.choice("abcdefghij") for _ in range(70)]
    texts += [long, long[3:], long[:50] + ["z"] + long[50:]]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "n long, words array<string>, place int").repartition(3)
    places = defaultdict(list)
    for i, t in enumerate(texts):
        for k in range(len(t or [])):
            for n in range(1, len(t) - k + 1):
                if t[k + n - 1] is None:
                    break
                places[tuple(t[k : k + n])].append((i, k + 1))
    got = {}
    for r in gram_classes.ngram_classes(df, "n", "words").collect():
        for n in range(r["n_from"], r["n_to"] + 1):
            gram = tuple(texts[r["record"]][r["word"] - 1 : r["word"] - 1 + n])
            assert gram not in got
            got[gram] = (r["record"], r["word"]), r["occurrences"], r["records"]
    assert got == {g: (min(p), len(p), len({i for i, _ in p})) for g, p in places.items()}
    assert max(map(len, got)) == 71


def test_no_texts_and_no_repeats(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, None), (3, ["c"])], "id long, words array<string>")
    got = sorted(map(tuple, gram_classes.ngram_classes(df, "id", "words").collect()))
    assert got == [(1, 1, 1, 2, 1, 1), (1, 2, 1, 1, 1, 1), (3, 1, 1, 1, 1, 1)]
    assert gram_classes.ngram_classes(df.limit(0), "id", "words").count() == 0


def test_query_has_every_length(spark, data):
    """No sequence of words is left out: words and pairs are those of ``p6_ngrams``, and the occurrences those of all lengths."""
    q = queries.queries()
    found = q["p6_all_ngrams"](spark, data).cache()
    counts = ["n", "occurrences", "records", "mark"]
    short = found.withColumn("n", F.explode(F.expr("filter(array(1, 2), n -> n BETWEEN n_from AND n_to)")))
    listed = q["p6_ngrams"](spark, data)
    assert sorted(map(repr, short.select(counts).collect())) == sorted(map(repr, listed.select(counts).collect()))
    sizes = [r[0] for r in spark.read.parquet(f"{data}/documents.parquet").where("text IS NOT NULL").select(
        F.size(queries.term_frequency.words(F.col("text")))).collect()]
    assert found.agg(F.sum(F.expr("occurrences * (n_to - n_from + 1)"))).first()[0] == sum(n * (n + 1) // 2 for n in sizes)
    assert found.agg(F.max("n_to")).first()[0] == max(sizes)
