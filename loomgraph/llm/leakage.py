"""Evaluation passages in training texts: an FM-index of each shard, searched backwards."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.text import PIECE

#: A case has so many consecutive item words, at most one in ``EDIT_EVERY`` of them edited.
MIN_WORDS = 20
EDIT_EVERY = 10
#: Of MIN_WORDS words with MIN_WORDS / EDIT_EVERY edits, so many in a row are untouched: (20 - 2) / 3.
SEED = (MIN_WORDS - MIN_WORDS // EDIT_EVERY) // (MIN_WORDS // EDIT_EVERY + 1)
#: A window of up to 2 * MIN_WORDS - 1 words has at most so many edits; longer ones contain such a window.
MAX_EDITS = (2 * MIN_WORDS - 1) // EDIT_EVERY
#: Known words in one shard's index, all words of its documents, and the distance of the index's sampled positions.
SHARD = 1 << 19
SHARD_WORDS = 1 << 23
SAMPLE = 16
#: Characters of items handled in one pass over the documents.
ITEM_BLOCK = 4 << 20

_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufeff\ufe00-\ufe0f]")
#: A run of other characters with the one that they may combine with.
_NOT_ASCII = re.compile(r"[\x00-\x7f]?[^\x00-\x7f]+")
_TAG = re.compile(r"</?[a-z][a-z0-9]*(?:\s[^<>]*)?/?>|<!--|-->")
_MACRO = re.compile(r"\\[a-z]+\*?(?=\{)|\\(?:item|par|newline)\b")
_CODE_ESCAPE = re.compile(r"\\u([0-9a-f]{4})|\\x([0-9a-f]{2})")
_UNDERSCORE = re.compile(r"\\_")
_ESCAPE = re.compile(r"\\[nrtfv]|\\")
_ENTITY = re.compile(r"&(?:#[0-9]+|#x[0-9a-f]+|[^\t\n\f <&#;]{1,32});?")
_PROMPT = re.compile(r"^[ \t]*(?:in|out)? ?\[\d*\] ?:|^[ \t]*\.{3}:", re.M)
_BROKEN = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t]*(?:#+|//+|>+|--|%+|\*)?[ \t]*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+(?:_+[^\W_]+)*")  # an identifier is one word
#: Where a text can be cut without changing its words, if no tag is open: between two plain words, the second not of a prompt.
_CUT = re.compile(r"[a-z0-9] (?!(?:in|out) ?\[)(?=[a-z0-9])", re.I)

#: What makes a text plain: whether a text in lower case has any of it, what is replaced, and by what.
_STEPS = (
    (lambda t: "\\" in t, _MACRO, " "),
    (lambda t: "\\" in t, _CODE_ESCAPE, lambda m: chr(int(m[1] or m[2], 16)).lower()),
    (lambda t: "\\" in t, _UNDERSCORE, "_"),
    (lambda t: "\\" in t, _ESCAPE, " "),
    (lambda t: "&" in t, _ENTITY, lambda m: html.unescape(m[0]).lower()),
    (lambda t: not t.isascii(), _INVISIBLE, ""),
    (lambda t: not t.isascii(), _NOT_ASCII, lambda m: unicodedata.normalize("NFKC", m[0]).lower()),
    (lambda t: "<" in t, _TAG, " "),
    (lambda t: "]:" in t or "...:" in t or "] :" in t, _PROMPT, " "),
    (lambda t: "-" in t, _BROKEN, ""),
)


def _cut(text: str) -> Iterator[tuple[int, str]]:
    """A long text in pieces, with their places, that have the words of the whole."""
    at = 0
    while len(text) - at > PIECE:
        look, k = at + PIECE, -1
        while m := _CUT.search(text, look):
            k = m.end()
            if text.rfind("<", at, k) > text.rfind(">", at, k):  # a tag may be open
                closed, opened = text.find(">", k), text.find("<", k)
                if closed >= 0 and not 0 <= opened < closed:
                    look, k = closed + 1, -1
                    continue
            break
        if k < 0:
            break
        yield at, text[at:k]
        at = k
    yield at, text[at:] if at else text


def normal_words(text: str) -> list[str]:
    """The words of a text without case, punctuation, spacing, line breaks, markup, escapes,
    invisible characters, or comment, quote and prompt prefixes."""
    t = text.lower()
    for there, pattern, by in _STEPS:
        if there(t):
            t = pattern.sub(by, t)
    return _WORD.findall(t)


def _aligned(m: re.Match, by) -> list[tuple[int, int, str]]:
    """``(start, end, what comes instead)`` of the smallest parts of a match that are replaced by themselves."""
    if isinstance(by, str):
        return [(m.start(), m.end(), by)]
    new = by(m)
    if m.re is _NOT_ASCII:  # letter by letter, where marks are not joined to a letter apart from it
        at = [i for i, c in enumerate(m[0]) if not unicodedata.combining(c)] or [0]
        bounds = [0, *at[at[0] == 0 :], len(m[0])]
        parts = [(a, b, unicodedata.normalize("NFKC", m[0][a:b]).lower()) for a, b in zip(bounds, bounds[1:])]
        if "".join(x for _, _, x in parts) == new:
            return [(m.start() + a, m.start() + b, x) for a, b, x in parts]
    return [(m.start(), m.end(), new)]


def word_places(text: str) -> tuple[list[int], list[int]]:
    """Where each of the words of a whole text begins and ends, in characters of the text."""
    firsts, ends = [], []
    for at, piece in _cut(text):
        t = piece.lower()
        n = [1] * len(piece) if len(t) == len(piece) else [len(c.lower()) for c in piece]
        first = np.repeat(np.arange(len(piece)), n)
        last = first + 1
        for there, pattern, by in _STEPS:
            if not there(t):
                continue
            parts, f, e, done = [], [], [], 0
            for m in pattern.finditer(t):
                parts.append(t[done : m.start()])
                f.append(first[done : m.start()])
                e.append(last[done : m.start()])
                for a, b, new in _aligned(m, by):
                    parts.append(new)
                    f.append(np.full(len(new), first[a]))
                    e.append(np.full(len(new), last[b - 1]))
                done = m.end()
            if done:
                t = "".join([*parts, t[done:]])
                first, last = np.concatenate([*f, first[done:]]), np.concatenate([*e, last[done:]])
        for m in _WORD.finditer(t):
            firsts.append(at + int(first[m.start()]))
            ends.append(at + int(last[m.end() - 1]))
    return firsts, ends


#: Tokens of a shard's text: its one start, what parts the texts and stands for unknown words, and the first word.
START, GAP, FIRST_WORD = 0, 1, 2


class FMIndex:
    """Backward search over a text of small numbers that begins with its only ``START``.

    Ranks come from a wavelet matrix of the Burrows-Wheeler text; positions from
    every ``SAMPLE``-th suffix.
    """

    def __init__(self, tokens: np.ndarray):
        n = len(tokens)
        self.n = n
        self.bits = max(1, int(tokens.max(initial=0)).bit_length())
        order = self._sorted_suffixes(tokens)
        bwt = tokens[order - 1]
        self.starts = np.zeros((1 << self.bits) + 1, np.int64)
        np.cumsum(np.bincount(tokens, minlength=1 << self.bits), out=self.starts[1:])
        self.ranks, self.zeros = [], []
        level = bwt
        for b in range(self.bits - 1, -1, -1):
            one = (level >> b) & 1
            self.ranks.append(np.concatenate([[0], np.cumsum(one, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(n - int(one.sum()))
            level = np.concatenate([level[one == 0], level[one == 1]])
        self.bwt = bwt
        sampled = order % SAMPLE == 0
        self.sampled_rank = np.concatenate([[0], np.cumsum(sampled, dtype=np.int32)]).astype(np.int32)
        self.sampled = order[sampled]

    def _sorted_suffixes(self, tokens: np.ndarray) -> np.ndarray:
        """The suffix array, by prefix doubling that sorts only what is still tied.

        The first pass compares as many tokens as fit one sort key.  Suffixes
        are taken round the end, where the one ``START`` settles every order.
        """
        k = max(1, 62 // self.bits)
        key = np.zeros(self.n, np.int64)
        for j in range(k):
            key = (key << self.bits) | np.roll(tokens, -j)
        order = np.argsort(key, kind="stable")
        at, group = np.arange(self.n), key[order]
        rank = np.empty(self.n, np.int64)
        second = np.zeros(self.n, np.int64)
        while True:
            start = np.r_[True, (group[1:] != group[:-1]) | (second[1:] != second[:-1])]
            first = np.flatnonzero(start)
            size = np.diff(np.r_[first, len(at)])
            rank[order[at]] = np.repeat(at[first], size)
            at = at[np.repeat(size > 1, size)]
            if not len(at):
                return order
            tied = order[at]
            group, second = rank[tied], rank[(tied + k) % self.n]
            by = np.lexsort((second, group))
            order[at], group, second = tied[by], group[by], second[by]
            k *= 2

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place of the Burrows-Wheeler text."""
        lo = np.zeros(len(at), np.int64)
        hi = at.astype(np.int64)
        for depth, b in enumerate(range(self.bits - 1, -1, -1)):
            one = ((symbols >> b) & 1).astype(bool)
            r = self.ranks[depth]
            l1, h1 = r[lo], r[hi]
            lo = np.where(one, self.zeros[depth] + l1, lo - l1)
            hi = np.where(one, self.zeros[depth] + h1, hi - h1)
        return hi - lo

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval ``[lo, hi)`` of each row of equally long phrases."""
        last = phrases[:, -1]
        lo, hi = self.starts[last].copy(), self.starts[last + 1].copy()
        live = np.flatnonzero(hi > lo)
        for k in range(phrases.shape[1] - 2, -1, -1):
            c = phrases[live, k]
            lo[live] = self.starts[c] + self.rank(c, lo[live])
            hi[live] = self.starts[c] + self.rank(c, hi[live])
            live = live[hi[live] > lo[live]]
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix array rows, stepping back to the next sampled one."""
        out = np.zeros(len(rows), np.int64)
        steps = np.zeros(len(rows), np.int64)
        at = rows.copy()
        live = np.arange(len(rows))
        while len(live):
            known = self.sampled_rank[at[live] + 1] > self.sampled_rank[at[live]]
            done = live[known]
            out[done] = (self.sampled[self.sampled_rank[at[done]]] + steps[done]) % self.n
            live = live[~known]
            c = self.bwt[at[live]]
            at[live] = self.starts[c] + self.rank(c, at[live])
            steps[live] += 1
        return out


def _reach(a: list[int], b: list[int], most: int) -> list[tuple[int, int, int]]:
    """``(edits, words of a, words of b)``: how far a start of ``a`` can be aligned with one of ``b``.

    Each alignment ends on an equal word, or is empty; with up to ``most``
    edits, one for each number of edits that takes it further.
    """
    la, lb = len(a), len(b)
    out: list[tuple[int, int, int]] = []

    def run(i: int, d: int, edits: int) -> int:
        end = i
        while end < la and end + d < lb and a[end] == b[end + d]:
            end += 1
        if end > i:
            if out[-1][0] == edits:
                out[-1] = max(out[-1], (edits, end, end + d))
            elif end > out[-1][1]:
                out.append((edits, end, end + d))
        return end

    out.append((0, 0, 0))
    front = {0: run(0, 0, 0)}
    for edits in range(1, most + 1):
        if out[-1][1] == la:
            break
        step: dict[int, int] = {}

        def go(d: int, i: int) -> None:
            step[d] = max(step.get(d, -1), run(i, d, edits))

        for d, i in front.items():
            if i < la and i + d < lb:
                go(d, i + 1)  # changed
            if i + d < lb:
                go(d + 1, i)  # added
            if i < la:
                go(d - 1, i + 1)  # missing
        front = step
    return out


def match(item: list[int], doc: list[int], i: int, j: int, n: int, most: int) -> tuple[int, int] | None:
    """``(first word, end word)`` in the document of the longest case around the ``n`` equal
    words at item ``i`` and document ``j``, with up to ``most`` edits on each side.

    The range begins and ends with equal words: edits at the ends of a case
    count for its length, but what stands there is not the item's.
    """
    right = _reach(item[i + n :], doc[j + n : j + n + len(item) - i - n + most], most)
    left = _reach(item[:i][::-1], doc[max(0, j - i - most) : j][::-1], most)
    best, found = 0, None
    for el, x, xd in left:
        for er, y, yd in right:
            words, edits = x + n + y, el + er
            short = max(0, MIN_WORDS - words)  # words changed or missing at the ends
            if words > best and words + short <= len(item) and (edits + short) * EDIT_EVERY <= words + short:
                best, found = words, (j - xd, j + n + yd)
    return found


#: Item words that a window of ``MIN_WORDS`` words around a seed may reach to on each side of it, and hits looked at together.
AROUND = MIN_WORDS - SEED
HITS = 1 << 16


class _Items:
    """The items of one block: vocabulary, word numbers, and the seed phrases with their places."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        pad = np.zeros(AROUND, np.int32)
        parts, owner, place, at = [pad], [], [], AROUND
        self.starts: list[int] = []
        for item_id, text in rows:
            words = normal_words(text or "")
            if len(words) >= MIN_WORDS:
                ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + FIRST_WORD) for w in words]
                n = len(ids) - SEED + 1
                owner.append(np.full(n, len(self.items), np.int32))
                place.append(np.arange(at, at + n))
                self.items.append((item_id, ids))
                self.starts.append(at)
                parts += [np.array(ids, np.int32), pad]
                at += len(ids) + AROUND
        #: all items in a row, with empty places between
        self.words = np.concatenate(parts)
        owner, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owner, place))
        grams = np.lib.stride_tricks.sliding_window_view(self.words, SEED)[place] if len(place) else np.zeros((0, SEED), np.int32)
        order = np.lexsort(grams.T[::-1])
        grams = grams[order]
        new = np.r_[True, (grams[1:] != grams[:-1]).any(axis=1)] if len(grams) else np.zeros(0, bool)
        self.phrases = grams[new]
        #: the places of phrase p are those from first_place[p] to first_place[p + 1]
        self.first_place = np.r_[np.flatnonzero(new), len(grams)]
        self.owner, self.place = owner[order], place[order]


def _promising(items: _Items, docs: np.ndarray, at: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which hits, at places of ``items.words`` and of ``docs``, begin a run of equal words and may be in a case.

    A case around a seed has ``MIN_WORDS`` item words in a row with it, at most
    ``MAX_EDITS`` of them without an equal word so many places to either side.
    """
    start = np.flatnonzero((items.words[at - 1] != docs[j - 1]) | (items.words[at - 1] == 0))
    at, j = at[start], j[start]
    span = np.arange(-AROUND, SEED + AROUND)
    own = items.words[at[:, None] + span]
    near = np.zeros(own.shape, bool)
    for shift in range(-MAX_EDITS, MAX_EDITS + 1):
        near |= own == docs[j[:, None] + span + shift]
    near &= own > 0
    total = np.concatenate([np.zeros((len(at), 1), np.int32), np.cumsum(near, axis=1, dtype=np.int32)], axis=1)
    return start[((total[:, MIN_WORDS:] - total[:, :-MIN_WORDS]).max(axis=1, initial=0)) >= MIN_WORDS - MAX_EDITS]


def _search(items: _Items, docs: list[tuple[int, np.ndarray, object]]):
    """The cases of one shard: ``(number of the document, item_id, first word, end word)``."""
    end = np.full(1, GAP, np.int32)
    parts, where = [np.full(1, START, np.int32)], [np.zeros(1, np.int64)]
    margin = np.full(AROUND + MAX_EDITS + 1, -1, np.int32)
    rows, begins, at = [margin], [], len(margin)
    for _, ids, _ in docs:
        known = ids > 0
        keep = np.flatnonzero(known | np.r_[True, known[:-1]])  # unknown words in a row are one gap
        parts += [np.where(known[keep], ids[keep], GAP), end]
        where += [keep + at, np.zeros(1, np.int64)]
        begins.append(at)
        rows += [np.where(known, ids, -1).astype(np.int32), margin]
        at += len(ids) + len(margin)
    tokens, where, words, begins = np.concatenate(parts), np.concatenate(where), np.concatenate(rows), np.array(begins)
    index = FMIndex(tokens.astype(np.int32))
    known = (items.phrases <= tokens.max()).all(axis=1)
    lo, hi = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
    lo[known], hi[known] = index.search(items.phrases[known])
    # each place of the shard begins one phrase at most
    size = hi - lo
    phrase = np.repeat(np.arange(len(size)), size)
    j = where[index.locate(np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + lo[phrase])]
    # a phrase of many items makes a hit with each of them: they are made in bounded numbers
    many = np.diff(items.first_place)[phrase]
    upto = np.cumsum(many)
    hits = defaultdict(set)
    a = 0
    while a < len(j):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] - many[a] + HITS, "right")))
        n = many[a:b]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(items.first_place[phrase[a:b]], n)
        places = np.repeat(j[a:b], n)
        good = _promising(items, words, items.place[k], places)
        d = np.searchsorted(begins, places[good], "right") - 1
        for d, k, at in zip(d.tolist(), k[good].tolist(), (places[good] - begins[d]).tolist()):
            item = int(items.owner[k])
            i = int(items.place[k]) - items.starts[item]
            hits[d, item].add((at - i, i))
        a = b
    for (d, k), seeds in sorted(hits.items()):
        ids = docs[d][1]
        item_id, own = items.items[k]
        first = max(0, min(g + i for g, i in seeds) - 2 * len(own))
        doc = ids[first : max(g + i for g, i in seeds) + 2 * len(own)].tolist()
        # every case has one of few edits in it, so that a pair without one needs no longer search
        if any(match(own, doc, i, i + g - first, SEED, MAX_EDITS) for g, i in seeds):
            ranges = {match(own, doc, i, i + g - first, SEED, len(own) // EDIT_EVERY) for g, i in seeds} - {None}
            for a, b in sorted(ranges):
                yield d, item_id, a + first, b + first


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str) -> DataFrame:
    """``(doc_id, item_id, first, end)``: every case of an item's passage in a document.

    A case is at least ``MIN_WORDS`` consecutive words of the item, in order,
    with at most one in ``EDIT_EVERY`` changed, missing or added; the range is
    in characters of the text as it is, from the first to the end of the last of
    the item's words in the longest case there, and a pair may have several.
    Every such case has ``SEED`` untouched words in a row.  Each shard of
    documents, in its task, becomes an FM-index over the items' vocabulary; all
    ``SEED``-word phrases of the items are searched backwards in it, the hits
    located through sampled positions.  Hits are first counted for equal words
    around them, all at once, which leaves what a shared instruction hits in
    every other text; the rest are held against the exact definition by aligning
    the words around them.  Documents are never shuffled.

    Items are taken in blocks of ``ITEM_BLOCK`` characters, one pass over the
    documents each, so what is sent to the tasks is bounded however many there
    are.  Null or empty texts give nothing on either side; items shorter than a
    case can't be found; repeated items or documents each give their rows.
    Whole texts are read, of any length.  Only the named columns are used.
    """
    out = None
    block: list[tuple[int, str]] = []
    size = 0
    rows = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("t IS NOT NULL")

    def search(block):
        prepared = _Items(block)
        schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first", pa.int64()), ("end", pa.int64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            get = prepared.vocabulary.get
            docs, known, total = [], 0, 0

            def flush():
                found, places = [], {}
                for d, item, a, b in _search(prepared, docs) if docs and prepared.items else ():
                    if d not in places:
                        places[d] = word_places(docs[d][2].as_py())
                    found.append((docs[d][0], item, places[d][0][a], places[d][1][b - 1]))
                columns = list(zip(*found)) or [[]] * 4
                return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    parts = []
                    for _, piece in _cut(text.as_py()):
                        words = normal_words(piece)
                        parts.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
                    ids = np.concatenate(parts)
                    n = int(np.count_nonzero(ids))
                    if n < SEED:
                        continue
                    docs.append((doc, ids, text))
                    known, total = known + n, total + len(ids)
                    if known >= SHARD or total >= SHARD_WORDS:
                        yield flush()
                        docs, known, total = [], 0, 0
            yield flush()

        texts = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(doc_text).alias("text"))
        return texts.where("text IS NOT NULL").mapInArrow(run, "doc_id bigint, item_id bigint, first bigint, end bigint")

    for row in rows.toLocalIterator():
        block.append((row["i"], row["t"]))
        size += len(row["t"])
        if size >= ITEM_BLOCK:
            part = search(block)
            out = part if out is None else out.unionByName(part)
            block, size = [], 0
    if block or out is None:
        part = search(block)
        out = part if out is None else out.unionByName(part)
    return out


def removal_spans(cases: DataFrame) -> DataFrame:
    """``(doc_id, first, end, items)``: overlapping or adjoining cases of a document merged; the
    characters from ``first`` up to ``end``, counted from 0, are what to remove."""
    w = Window.partitionBy("doc_id").orderBy("first", "end")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    opened = cases.withColumn("new", (F.col("first") > F.coalesce(F.max("end").over(before), F.lit(-1))).cast("int"))
    return (
        opened.withColumn("span", F.sum("new").over(w))
        .groupBy("doc_id", "span")
        .agg(F.min("first").alias("first"), F.max("end").alias("end"), F.array_sort(F.collect_set("item_id")).alias("items"))
        .drop("span")
    )
