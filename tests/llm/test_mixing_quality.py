import math
import os
import random

import numpy as np
import pytest

from loomgraph.llm import mixing, quality

needs_tokenizer = pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="no tokenizer files")


def test_plan_meets_shares_and_caps():
    targets, available = {"a": (0.5, 1), "b": (0.3, 4), "c": (0.2, 2), "d": (0.1, 2), "e": (0.0, 3)}, {"a": 1000, "b": 50, "c": 400}
    live, total = mixing.plan(targets, available, None, 0.8)
    # b gives all it may, a and c the rest in proportion
    assert set(live) == {"a", "b", "c"} and total == pytest.approx(1450)
    assert live["b"].demand == 200 and live["a"].demand == pytest.approx(1250 * 5 / 7) and live["c"].demand == pytest.approx(1250 * 2 / 7)
    assert sum(t.share for t in live.values()) == pytest.approx(1) and sum(t.weight for t in live.values()) == pytest.approx(1)
    for x in (0.0, 0.3, 1.0):  # the weights add up to one at all times
        assert sum(t.weight * (1 + t.slope * (2 * x - 1)) for t in live.values()) == pytest.approx(1)
    assert all(abs(t.slope) <= 0.8 + 1e-9 for t in live.values())
    exact, most = mixing.plan(targets, available, None, 0.8, exact_shares=True)
    assert most == pytest.approx(4 * 50 / 0.3) and all(t.demand == pytest.approx(t.share * most) for t in exact.values())
    assert mixing.plan({"a": (0.5, 1)}, {}, None, 0.8) == ({}, 0.0)
    assert mixing.plan({"a": (1.0, 3)}, {"a": 10}, 12.0, 0.8)[1] == 12.0
    assert mixing.plan({"a": (1.0, 3)}, {"a": 10}, 99.0, 0.8)[1] == 30.0  # all there is


def test_a_scarce_source_does_not_cut_the_total():
    for total, want in ((None, 10**12 + 1000), (10**9, 10**9)):
        live, got = mixing.plan({"big": (0.99, 1), "small": (0.01, 2)}, {"big": 10**12, "small": 1000}, total, 0.8)
        assert got == pytest.approx(want) and live["small"].demand == 2000 and live["big"].demand == pytest.approx(want - 2000)


@needs_tokenizer
def test_mixture_against_brute_force(spark, data):
    """Every use and the report of the whole tables, from the definition."""
    import struct

    import xxhash

    docs, targets = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/mix_targets.parquet")
    m = mixing.Mixture(docs, targets)
    tokens = {}
    for r in mixing.token_counts(docs, "doc_id", "text", "source").collect():
        tokens.setdefault(r["source"], []).append((r["doc_id"], r["tokens"]))
    wanted = {mixing_name(r["source"]): r for r in targets.collect()}
    live = {s: r for s, r in wanted.items() if tokens.get(s)}
    total = sum(n for s in live for _, n in tokens[s])
    scale = sum(r["target_share"] for r in live.values())
    # the common rate at which capped shares make up the total, by halving
    capacity = {s: r["max_repeats"] * sum(n for _, n in tokens[s]) for s, r in live.items()}
    low, high = 0.0, 1e18
    for _ in range(300):
        rate = (low + high) / 2
        if sum(min(capacity[s], r["target_share"] * rate) for s, r in live.items()) < total:
            low = rate
        else:
            high = rate
    demand = {s: min(capacity[s], r["target_share"] * high) for s, r in live.items()}

    def key(i):
        seed = xxhash.xxh64(struct.pack("<i", 42), seed=42).intdigest()
        h = xxhash.xxh64(struct.pack("<q", i), seed=seed).intdigest()
        return h - (1 << 64) if h >> 63 else h

    want, report = set(), {}
    for s in live:
        at, own = 0, []
        order = sorted(tokens[s], key=lambda x: (key(x[0]), x[0]))
        for epoch in range(live[s]["max_repeats"]):
            for i, n in order:
                if at < demand[s] - 1e-6:
                    own.append((i, epoch, n))
                at += n
        want |= {(s, i, e, n) for i, e, n in own}
        report[s] = (sum(n for _, _, n in own), len(own), len({i for i, _, _ in own}))
    assert {(r["source"], r["doc_id"], r["epoch"], r["tokens"]) for r in m.documents.collect()} == want
    every = sum(t for t, _, _ in report.values())
    for r in m.report.collect():
        t, uses, n = report.get(r["source"], (0, 0, 0))
        assert (r["tokens"], r["uses"], r["documents"]) == (t, uses, n)
        assert r["actual_share"] == pytest.approx(t / every, abs=1e-6) and r["target_share"] == wanted[r["source"]]["target_share"]
        if r["source"] in live:
            share = live[r["source"]]["target_share"] / scale
            assert r["normalised_share"] == pytest.approx(share, abs=1e-6)
            assert r["planned_share"] == pytest.approx(demand[r["source"]] / total, abs=1e-6)
            assert r["missing_tokens"] == pytest.approx(max(0, share * total - demand[r["source"]]), abs=1)


def mixing_name(s):
    return "_".join(s.strip().lower().replace("-", " ").split())


def notes(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(400):
        source = rnd.choice(["big", "big", "big", "Big ", "small-one", "none", None, "mid"]) if i > 12 else "small_one"
        rows.append((i, " ".join(rnd.choice(["alpha", "beta", "gamma", "x", "1234"]) for _ in range(rnd.randrange(1, 40))), source))
    rows += [(None, "text", "big"), (900, None, "big"), (901, "", "big"), (902, "word " * 30_000, "mid")]
    return spark.createDataFrame([(*r, 5, 0.5) for r in rows], "doc_id long, text string, source string, tokens int, position double")


@needs_tokenizer
def test_mixture(spark, monkeypatch):
    docs = notes(spark)
    targets = spark.createDataFrame(
        [("big", 0.5, 1), ("small-one", 0.3, 3), ("mid", 0.2, 2), ("absent", 0.1, 2), (None, 0.5, 1), ("none", None, 4)],
        "source string, target_share double, max_repeats int",
    )
    m = mixing.Mixture(docs, targets, exact_shares=True)
    uses = [r.asDict() for r in m.documents.collect()]
    report = {r["source"]: r.asDict() for r in m.report.collect()}
    total = sum(u["tokens"] for u in uses)
    longest = 30_001
    for s, share in (("big", 0.5), ("small_one", 0.3), ("mid", 0.2)):
        own = [u for u in uses if u["source"] == s]
        # a source exceeds its demand by less than one document
        demand = share * m.total_tokens
        assert demand - 1e-6 <= sum(u["tokens"] for u in own) < demand + longest
        assert report[s]["tokens"] == sum(u["tokens"] for u in own) and report[s]["uses"] == len(own)
        assert report[s]["actual_share"] == pytest.approx(report[s]["tokens"] / total, abs=1e-5)
        counts = {}
        for u in own:
            counts[u["doc_id"]] = counts.get(u["doc_id"], 0) + 1
        assert max(counts.values()) == report[s]["most_uses"] <= report[s]["max_repeats"]
        # epochs follow each other, and within one no document comes twice
        assert len({(u["doc_id"], u["epoch"]) for u in own}) == len(own)
    assert report["absent"]["actual_share"] == 0 and report["none"]["uses"] == 0
    assert [u["position"] for u in uses] == sorted(u["position"] for u in uses)
    assert all(0 <= u["position"] < m.total_tokens for u in uses)
    assert {900, 901} & {u["doc_id"] for u in uses} == set()
    # many buckets give the same uses
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    again = [r.asDict() for r in mixing.Mixture(docs, targets, exact_shares=True).documents.collect()]
    assert again == uses


@needs_tokenizer
def test_tokens_are_exact(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(mixing.TOKENIZER, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=mixing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = notes(spark)
    want = {r["doc_id"]: len(enc.encode_ordinary(r["text"])) for r in docs.collect() if r["text"] and r["source"] and r["doc_id"] is not None}
    got = {r["doc_id"]: r["tokens"] for r in mixing.token_counts(docs, "doc_id", "text", "source").collect()}
    assert got == want
    assert enc.decode(enc.encode_ordinary("<|endoftext|> été ​")) == "<|endoftext|> été ​"


@needs_tokenizer
def test_mixture_of_nothing(spark):
    docs = notes(spark)
    targets = spark.createDataFrame([("big", 0.5, 1)], "source string, target_share double, max_repeats int")
    assert mixing.Mixture(docs.limit(0), targets).documents.count() == 0
    assert [r["actual_share"] for r in mixing.Mixture(docs.limit(0), targets).report.collect()] == [0.0]
    assert mixing.Mixture(docs, targets.limit(0)).documents.count() == 0


PROSE = "The harvest follows our narrow glacier. Another sample matches the gauge, so that we can see it. "
CODE = "import os\nfor i in range(9):\n    x = f(i, y=3)\n    print(x[i])\nassert x == 2, 'lost'\n"
SHAPES = {
    "list": [
        "\n".join(f"- item {i} here" for i in range(30)),
        "\n".join(f"{i}. thing of {i}" for i in range(30)),
        "\n".join(f"* [name{i}](http://x.example/{i})" for i in range(30)),
        "\n".join(f"data/part_{i}.csv" for i in range(30)),
        "\n".join(f"package-{i}==1.{i}.0" for i in range(30)),
        "\n".join(["Wörter", "größere Kiste", "été", "medição fina"] * 9),
    ],
    "table": [
        "a,b,c\n" + "\n".join(f"{i},{i * 2.5},name{i}" for i in range(30)),
        "a\tb\tc\n" + "\n".join(f"{i}\t{i * 2.5}\tname {i}" for i in range(30)),
        "\n".join(f"| {i} | x{i} | 3.5 |" for i in range(30)),
        "   one   two\n" + "\n".join(f"{i}   {i * 3.5}   name{i}" for i in range(30)),
        "<table>" + "\n".join(f"<tr><td>{i}</td><td>x</td></tr>" for i in range(30)) + "</table>",
        "\n".join(f"{i} & 2.5 & name \\\\" for i in range(30)),
        "┌──┬──┐\n" + "\n".join(f"│ {i} │ x │" for i in range(30)) + "\n└──┴──┘",
    ],
    "junk": [
        "iVBORw0KGgoAAAANSUhEUgAA" * 60,
        "\n".join(f"2024-01-02 03:04:{i:02d},001 INFO [worker-{i}] step={i}" for i in range(30)),
        "\n".join(f"{i * 16:08x}  3a65 a5db fb65 6a82 9c0c 4021" for i in range(30)),
        "!function(e,t){return e[54]^t<<3}(window);" * 40,
        "ha" * 700,
        "Ð¿Ñ€Ð¸ Ð²ÐµÑ‚ " * 60,
        "\n".join(f"Epoch {i}/30 [=====>....] - 2s - loss: 0.25" for i in range(30)),
    ],
}


def test_shapes():
    for shape, texts in SHAPES.items():
        for t in texts:
            for text in (t, CODE + "\n" + t + "\n\n" + PROSE):
                shares = quality.shape_characters(text)
                assert shares[shape] > 0.5 * len(text), (shape, text[:60], shares)
    trace = "Traceback (most recent call last)\n" + "".join(f'  File "/a/b.py", line {i}, in f\n    x = g(x, {i})\n' for i in range(9)) + "ValueError: bad value"
    for text in (PROSE * 9, CODE * 9, trace, "", "\n\n\n", PROSE + "\n\n" + CODE):
        assert sum(quality.shape_characters(text).values()) <= 0.3 * max(1, len(text)), text[:50]


def test_very_long_lines_are_linear():
    import time

    began = time.process_time()
    for line in ("0" * 400_000, "1,2;3\t" * 80_000, "a " * 200_000, " " * 300_000, "1  2  " * 60_000 + "!", "x" * 500_000, "é" * 200_000, "- " * 200_000, "|" * 300_000, "&" * 300_000):
        quality.document_statistics(line)
    assert time.process_time() - began < 30


def test_statistics():
    text = "The cat sat.\n\n- one\n- two and (three)!\n"
    got = dict(zip(quality.STATISTICS, quality.document_statistics(text)[0]))
    n = len(text)
    want = {
        "word_count": 7, "mean_word_length": 23 / 7, "symbol_ratio": 6 / n, "punctuated_lines": 2 / 3, "common_words": 2 / 7,
        "letter_ratio": 23 / n, "digit_ratio": 0, "space_ratio": 10 / n, "separator_ratio": 0, "bracket_ratio": 2 / n,
        "distinct_characters": len(set(text)) / n**0.5, "mean_line_length": 35 / 3, "short_line_share": 35 / n, "long_line_share": 0, "marked_lines": 2 / 3,
    }
    assert got == {k: round(v, 4) for k, v in want.items()}
    assert quality.document_statistics("") == ([0.0] * 15, [0.0] * 3)


def test_long_texts_add_up(monkeypatch):
    from loomgraph.llm import text

    t = "\n\n".join(SHAPES["list"] + SHAPES["table"] + SHAPES["junk"] + [PROSE, CODE] * 5)
    whole = quality.document_statistics(t)
    monkeypatch.setattr(text, "PIECE", 300)
    assert quality.document_statistics(t) == whole


def test_prose_of_other_scripts_and_verse():
    texts = [
        "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。何でも薄暗いじめじめした所でニャーニャー泣いていた事だけは記憶している。吾輩はここで始めて人間というものを見た。",
        "人之初，性本善。性相近，习相远。苟不教，性乃迁。教之道，贵以专。昔孟母，择邻处。子不学，断机杼。窦燕山，有义方。教五子，名俱扬。养不教，父之过。教不严，师之惰。子不学，非所宜。",
        "กาลครั้งหนึ่งนานมาแล้วมีชายคนหนึ่งอาศัยอยู่ในหมู่บ้านเล็กๆใกล้แม่น้ำเขามีลูกสาวสามคนและทุกคนช่วยกันทำงานในทุ่งนาทุกวันจนกระทั่งพระอาทิตย์ตกดิน",
    ]
    for t in texts:
        assert quality.document_statistics(t)[1] == [0.0, 0.0, 0.0], t[:20]
        assert quality.document_statistics("\n\n".join([t] * 9))[1] == [0.0, 0.0, 0.0], t[:20]
    assert quality.document_statistics("あ" * 700)[1][2] == 1.0


def labelled(spark):
    rnd = random.Random(8)
    rows, shapes = [], []
    for i in range(400):
        s = rnd.choice(["list", "table", "junk", "prose", "prose", "code", "mixed"])
        if s in SHAPES:
            t = "\n\n".join(rnd.choice(SHAPES[s]) for _ in range(rnd.randrange(1, 4)))
        else:
            t = {"prose": PROSE * rnd.randrange(3, 20), "code": CODE * rnd.randrange(3, 12), "mixed": (PROSE + "\n\n" + CODE) * rnd.randrange(2, 6)}[s]
        rows.append((i, t, rnd.choice(["en", "EN ", "de-DE", None, ""])))
        shapes.append((i, s))
    return rows, shapes


def test_ranks_decide(spark):
    """Scores made of the ranks choose the documents; the exact check only follows."""
    rows, shapes = labelled(spark)
    # verse in short lines: its shares say list, its ranks prose
    verse = "\n".join(["The woods are deep", "and they are old", "as we go from there", "with all of this snow"] * 4)
    rows += [(1000 + i, verse, "en") for i in range(30)]
    shapes += [(1000 + i, "prose") for i in range(10)]
    rows += [(500, None, "en"), (None, "text", "en"), (501, "alone", "pt"), (502, "", "en"), (503, "x" * 1_000_000, "en")]
    df = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "doc_id long, text string, lang string, value double, statistic int")
    labels = spark.createDataFrame([*shapes, (None, "list"), (3, None), (77_777, "junk")], "doc_id long, shape string")
    q = quality.Quality(df, "doc_id", "text", "lang")
    model = q.fit(labels)
    assert model.fitted == 205 and model.held_out == 205 and model.recall >= 0.9 and model.precision >= 0.9
    scored = q.scores(model)
    got = {r["doc_id"]: r["shape"] for r in quality.shaped_documents(scored, model).collect()}
    want = {i: s for i, s in shapes if s in SHAPES} | {503: "junk"}
    assert got == want
    # without the ranks the verse would be there too
    model.cut = -math.inf
    assert set(quality.shaped_documents(scored, model).select("doc_id").toPandas()["doc_id"]) == set(want) | set(range(1000, 1030))
    # nothing to fit on: all pass to the exact check
    none = q.fit(labels.limit(0))
    assert none.cut == -math.inf and quality.shaped_documents(q.scores(none), none).count() == len(want) + 30


def test_outlier_scores_against_brute_force(spark):
    rows, shapes = labelled(spark)
    rows = rows[:60] + [(500, None, "en"), (None, "text", "en"), (501, "alone", "pt"), (502, "", "en"), (504, "", "en")]
    df = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "doc_id long, text string, lang string, value double, statistic int")
    q = quality.Quality(df, "doc_id", "text", "lang")
    model = quality.fit_model(np.random.default_rng(1).random((40, 30)), ["list", "prose", "junk", "table"] * 10, np.arange(40) % 2 == 1)
    got = {r["doc_id"]: r for r in q.scores(model).collect()}

    def language(x):
        return (x or "").strip().lower().split("-")[0] or "und"

    kept = {i: (language(g), quality.document_statistics(t)[0]) for i, t, g in rows if i is not None and t is not None}
    assert set(got) == set(kept)
    every, k = [v for _, v in kept.values()], quality.PSEUDO_DOCUMENTS
    for i, (g, own) in kept.items():
        peers = [v for h, v in kept.values() if h == g]

        def tail(j, fits):
            n, all_n = sum(fits(p[j], own[j]) for p in peers), sum(fits(p[j], own[j]) for p in every)
            return -math.log((n + k * all_n / len(every)) / (len(peers) + k))

        left = [tail(j, lambda a, b: a <= b) for j in range(len(own))]
        right = [tail(j, lambda a, b: a >= b) for j in range(len(own))]
        assert got[i]["outlier_score"] == pytest.approx(max(sum(left), sum(right))), i
        f = np.array([x for p in zip(left, right) for x in p])
        for n, s in enumerate(quality.SHAPES):
            assert got[i][f"{s}_score"] == pytest.approx(float(f @ (model.weights[n] - model.weights[-1]) + model.bias[n] - model.bias[-1])), i
    empty = quality.Quality(df.limit(0), "doc_id", "text", "lang")
    assert empty.scores(model).count() == 0 and empty.fit(spark.createDataFrame(shapes, "doc_id long, shape string")).cut == -math.inf


def test_labels_hold(spark, data):
    """Agreement with the hand labels of the sample."""
    docs, known = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    labels = {r["doc_id"]: r["shape"] for r in known.collect()}
    q = quality.Quality(docs, "doc_id", "text", "lang")
    model = q.fit(known)
    got = {r["doc_id"]: r["shape"] for r in quality.shaped_documents(q.scores(model), model).collect()}
    right = sum(got.get(i) == (s if s in quality.SHAPES else None) for i, s in labels.items())
    assert right >= 0.97 * len(labels)
