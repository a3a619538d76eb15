import random

import numpy as np
import pytest

from loomgraph.llm import leakage as L

RND = random.Random(4)
WORDS = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in "bdfgklmnprst"]


def words(n):
    return [RND.choice(WORDS) for _ in range(n)]


def test_normal_words():
    plain = L.normal_words("The quick brown fox, jumps over été")
    for text in (
        "THE QUICK BROWN fox—jumps   over ÉTÉ",
        "# The quick\n# brown **fox**,\n#   jumps over été",
        "> The qu​ick bro­wn <b>fox</b>&nbsp;jumps over &eacute;t&eacute;",
        "The\\nquick\\tbrown\\nfox jumps over \\u00e9t\\u00e9",
        "In [3]: The quick brown\nIn [4]: fox jumps\n   ...: over été",
        "\\textbf{The} quick \\emph{brown} fox jumps over été",
        "// The quick brown fox jum-\n// ps over été",
        "_The_ quick `brown` fox [jumps] over \"été\"",
    ):
        assert L.normal_words(text) == plain, text
    assert L.normal_words("") == [] and L.normal_words("...!?") == []
    assert L.normal_words("a_b c\\_d") == ["a_b", "c_d"]


@pytest.mark.parametrize("seed", range(3))
def test_index(seed):
    rnd = np.random.default_rng(seed)
    t = np.concatenate([[L.START], rnd.integers(L.GAP, 5 if seed else 1000, 400)])
    if seed == 2:  # long repeats
        t = np.concatenate([t, t[1:200], t[100:]]).astype(np.int32)
    t = t.astype(np.int32)
    depth = 4
    index = L.FMIndex(t)
    phrases = np.array([t[i : i + depth] for i in range(1, 390)] + [[4, 4, 4, 4], [4, 2, 3, 4]], np.int32)
    phrases = phrases[(phrases >= L.FIRST_WORD).all(axis=1)]
    lo, hi = index.search(phrases)
    for p, a, b in zip(phrases, lo, hi):
        want = [i for i in range(len(t) - depth + 1) if (t[i : i + depth] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want
    assert sorted(index.locate(np.arange(len(t))).tolist()) == list(range(len(t)))


def brute(item, doc):
    """Whether some window of at least MIN_WORDS item words is within one edit in ten words of some document window."""
    known = {w: k for k, w in enumerate(item)}
    a, b = np.array([known[w] for w in item]), np.array([known.get(w, -1) for w in doc])
    step = np.arange(len(b) + 1)
    for i in range(len(a) - L.MIN_WORDS + 1):
        row = np.zeros(len(b) + 1, np.int64)  # edit distance of the words so far to the best end at each place
        for size, x in enumerate(a[i : i + 2 * L.MIN_WORDS - 1], 1):
            new = np.r_[row[0] + 1, np.minimum(row[:-1] + (b != x), row[1:] + 1)]
            row = np.minimum.accumulate(new - step) + step
            if size >= L.MIN_WORDS and row.min() <= size // L.EDIT_EVERY:
                return True
    return False


def edited(w, edits):
    w = list(w)
    for _ in range(edits):
        k = RND.randrange(1, len(w) - 1)
        kind = RND.randrange(3)
        if kind == 0:
            w[k] = "changed"
        elif kind == 1:
            del w[k]
        else:
            w.insert(k, "added")
    return w


def test_cases_against_brute_force(spark):
    items = [words(RND.randrange(25, 60)) for _ in range(5)]
    docs = []
    for k in range(40):
        item = items[k % 5]
        n = RND.choice([14, 18, 20, 21, 24, 30, len(item)])
        n = min(n, len(item))
        i = RND.randrange(len(item) - n + 1)
        docs.append(words(15) + edited(item[i : i + n], RND.choice([0, 1, 2, 3, 4])) + words(15))
    # chunks of the passage with other words between
    docs.append([x for i in range(0, 24, 6) for x in items[0][i : i + 6] + words(6)])
    d = spark.createDataFrame([(i, " ".join(w), 7) for i, w in enumerate(docs)], "doc_id long, text string, item_id int")
    e = spark.createDataFrame([(i, " ".join(w), 7) for i, w in enumerate(items)], "item_id long, text string, doc_id int")
    got = {(r["doc_id"], r["item_id"]) for r in L.find_leaks(d, e, "doc_id", "text", "item_id", "text").collect()}
    want = {(i, j) for i, w in enumerate(docs) for j, x in enumerate(items) if brute(x, w)}
    assert got == want and 5 < len(want) < 40


def test_pieces(monkeypatch):
    from loomgraph.llm import text

    monkeypatch.setattr(text, "PIECE", 10)
    for t in ("", "abc", "a" * 35, "one two three four five six", "a\n\nb c\n\nddddddddd e\n" * 9, "\n\n" * 30, "x" * 25 + "\n\n" + "y" * 25):
        got = list(text.pieces(t, "\n\n"))
        assert "".join(got) == t and all(x.endswith("\n\n") for x in got[:-1])
        assert [b for x in got for b in x.split("\n\n") if b] == [b for b in t.split("\n\n") if b]


def test_odd_inputs(spark, monkeypatch):
    p = " ".join(words(30))
    short = " ".join(words(12))
    docs = [(1, None), (2, ""), (3, p), (4, p), (None, p), (5, "x " * 400_000 + p.upper() + " y" * 400_000), (6, short), (7, "a" * 2_000_000), (8, p + "\n\n" + p)]
    items = [(1, p), (2, None), (3, ""), (4, short), (5, p), (1, p)]
    d = spark.createDataFrame(docs, "id long, text string")
    e = spark.createDataFrame(items, "id long, text string")
    monkeypatch.setattr(L, "ITEM_BLOCK", 100)  # several passes
    monkeypatch.setattr(L, "SHARD", 50)
    cases = L.find_leaks(d, e, "id", "text", "id", "text")
    got = {(r["doc_id"], r["item_id"]) for r in cases.collect()}
    assert got == {(x, y) for x in (3, 4, None, 5, 8) for y in (1, 5)}
    spans = {(r["doc_id"], r["first"], r["end"]): r["items"] for r in L.removal_spans(cases).collect()}
    n = len(p)
    assert spans[3, 0, n] == [1, 5] and spans[8, 0, n] == spans[8, n + 2, 2 * n + 2] == [1, 5] and spans[5, 800_000, 800_000 + n] == [1, 5]
    assert L.find_leaks(d.limit(0), e, "id", "text", "id", "text").count() == 0
    assert L.find_leaks(d, e.limit(0), "id", "text", "id", "text").count() == 0


def test_whole_passages_are_removed(spark):
    """Ranges reach to both ends of a long passage, edited or not, and no further."""
    item = words(150)
    around = [f"o{i}" for i in range(90)]
    docs, want = [], []
    for a, b, edits in ((0, 150, {}), (20, 140, {}), (5, 145, {k: "changed" for k in range(15, 140, 12)}), (0, 150, {k: None for k in range(12, 150, 13)}),
                        (0, 150, {k: "added" for k in range(12, 150, 13)})):
        passage = []
        for k in range(a, b):
            how = edits.get(k)
            passage += [] if k in edits and how is None else ["x" + item[k]] if how == "changed" else ["y", item[k]] if how == "added" else [item[k]]
        docs.append(around[:33] + passage + around[33:])
        at = len(" ".join(around[:33])) + 1
        want.append((at, at + len(" ".join(passage))))
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "id long, text string")
    e = spark.createDataFrame([(1, " ".join(item))], "id long, text string")
    spans = {r["doc_id"]: (r["first"], r["end"]) for r in L.removal_spans(L.find_leaks(d, e, "id", "text", "id", "text")).collect()}
    assert spans == dict(enumerate(want))


ODD = [
    "# The quick\n# brown **fox**,\n#   jum-\n# ps over \u00e9t\u00e9", "> The qu\u200bick bro\u00adwn <b>fox</b>&nbsp;jumps &Eacute;t&eacute; &#65;x &amp",
    "The\\nquick\\tbrown \\u00e9t\\u0041 \\textbf{The} a\\_b \\item x", "In [3]: The quick\nOut[4]: fox\n   ...: over", "\u0130stanbul \ufb01ne e\u0301te\u0301 \u2163 \u1112\u1161\u11ab \u039f\u0394\u039f\u03a3",
    "a <b c> d < e <f\ng='h i'> j > k <!-- l --> m", "word in [3]: mid line out [4]: x", "",
]


def test_places_of_words():
    """The characters at a word's place have that word and no other."""
    rnd = random.Random(5)
    for _ in range(200):
        t = " ".join(rnd.choice(ODD) for _ in range(rnd.randrange(4)))
        first, end = L.word_places(t)
        assert len(first) == len(end) == len(L.normal_words(t))
        assert first == sorted(first) and all(a < b for a, b in zip(first, end))
    t = "x &eacute;t\u00e9 jum-\n# ps <b>a_b</b>"
    got = [t[a:b] for a, b in zip(*L.word_places(t))]
    assert got == ["x", "&eacute;t\u00e9", "jum-\n# ps", "a_b"]


@pytest.mark.parametrize("seed", range(4))
def test_long_texts_have_the_same_words(monkeypatch, seed):
    rnd = random.Random(seed)
    t = " ".join(rnd.choice([*ODD, "plain words here", "more of them in [7]: or out", "<a href='x y z' and more of it>"]) for _ in range(300))
    want, places = L.normal_words(t), L.word_places(t)
    monkeypatch.setattr(L, "PIECE", 40)
    pieces = list(L._cut(t))
    assert "".join(x for _, x in pieces) == t and len(pieces) > 20
    assert [w for _, x in pieces for w in L.normal_words(x)] == want and L.word_places(t) == places


def test_shared_instruction_is_cheap(spark):
    """A sentence of many items that stands alone in many documents is no case, and no work for each two of them."""
    import time

    said = words(16)
    items = [(i, " ".join(said + words(30))) for i in range(200)]
    docs = [(i, " ".join(said)) for i in range(3_000)] + [(9_000 + i, items[i][1]) for i in range(3)]
    d, e = spark.createDataFrame(docs, "id long, text string").coalesce(1), spark.createDataFrame(items, "id long, text string")
    began = time.time()
    got = {(r["doc_id"], r["item_id"]) for r in L.find_leaks(d, e, "id", "text", "id", "text").collect()}
    assert got == {(9_000 + i, i) for i in range(3)} and time.time() - began < 60


def test_all_cases_of_the_tables(spark):
    """Every pair of the test tables, against brute force over all pairs with common words in a row."""
    import os

    d = os.environ.get("LOOMGRAPH_LEAK_TABLES", "/root/testdata/sf0.01")
    if not os.path.isdir(d):
        pytest.skip(f"no tables in {d}")
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/eval_items.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in L.find_leaks(docs, items, "doc_id", "text", "item_id", "text").collect()}
    grams = {}
    texts = {r["item_id"]: L.normal_words(r["text"]) for r in items.collect() if r["text"]}
    for i, w in texts.items():
        for k in range(len(w) - L.SEED + 1):
            grams.setdefault(tuple(w[k : k + L.SEED]), set()).add(i)
    want = set()
    for r in docs.where("text IS NOT NULL").select("doc_id", "text").collect():
        w = L.normal_words(r["text"])
        near = {}
        for k in range(len(w) - L.SEED + 1):
            for i in grams.get(tuple(w[k : k + L.SEED]), ()):
                near.setdefault(i, []).append(k)
        for i, at in near.items():
            if brute(texts[i], w[max(0, min(at) - 150) : max(at) + 150]):
                want.add((r["doc_id"], i))
    assert got == want and len(want) > 20
