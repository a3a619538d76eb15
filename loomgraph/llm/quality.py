"""Per-document text statistics, their rank-based outlier scores, and the shape of a document.

The scores decide which documents are list, table or junk; the share of
characters in such blocks is then checked for those only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.text import pieces
from loomgraph.workspace import Workspace

#: Common function words.
COMMON_WORDS = frozenset(
    """the a an and or but of to in on for with by from at as is are was were be been this that these those it its
    not no we our you your he she they their his her has have had will can may if so than then there which who what
    der die das den dem des ein eine einer eines und oder aber nicht mit von zu im auf ist sind war wird für als auch
    bei nach aus wenn weil jede dieser kein unser
    el la los las un una unos unas y o pero de del en con por para que es son se no su sus este esta cada como más
    le les des du et ou mais dans pour par sur avec est sont ce cette ces il elle nous vous ne pas plus chaque notre
    os as um uma e mas do da dos das em no na com por não este esta cada nosso nossa"""
    .split()
)

SHAPES = ("list", "table", "junk")
#: What is ranked within a language; none of them looks for a shape.
STATISTICS = (
    "word_count",
    "mean_word_length",
    "symbol_ratio",
    "punctuated_lines",
    "common_words",
    "letter_ratio",
    "digit_ratio",
    "space_ratio",
    "separator_ratio",
    "bracket_ratio",
    "distinct_characters",
    "mean_line_length",
    "short_line_share",
    "long_line_share",
    "marked_lines",
)
SHARES = tuple(f"{s}_share" for s in SHAPES)
#: Lines up to, and from, so many characters are short, or long.
SHORT_LINE, LONG_LINE = 40, 200
#: The whole collection counts in a language's ranks as so many documents, so that rare languages have ranks too.
PSEUDO_DOCUMENTS = 20
#: A document is taken for a shape where the odds of one are at least this.
LEAST_ODDS = 1 / 8
#: Labelled documents that the weights are fitted on, at most, with as many held out to measure them.
FIT_LABELS = 2_000

_BULLET = r"(?:[-*+•◦▪‣·–○●■□►→✓✗☐☑]|\(?\d{1,4}[.):]|\(?[A-Za-z][.)]|\(?[ivxIVX]{1,5}[.)]|\[[ xX]\])"
#: Both are taken whole or not at all, so that long rows are matched in one pass.
_NUMBER = r"(?>[-+]?[$€£]?(?:\d[\d,]*\.?\d*|\.\d+)(?:[eE][-+]?\d+)?%?)"
_CELL = r"(?>[\w.+\-%/$€£]+)"

#: The first alternative that fits names the kind of a line.
_LINE = re.compile(
    "|".join(
        f"(?P<{name}>{pattern})"
        for name, pattern in (
            # an error trace or a rule within one
            ("trace", r"(?:Traceback \(most recent|\s*File \"|\s*-{2,}>|\s*\^+\s*$|[A-Za-z_.]*(?:Error|Exception|Warning|Interrupt)\b|-{10,100}$)"),
            ("table_html", r"\s*</?(?:table|thead|tbody|tfoot|tr|td|th)\b"),
            ("table_rule", r"\s*(?:[+|:][-=+|: ]{2,}[+|:]?|[┌├└╔╠╚╒╞╘][─-╿]+|\\(?:hline|toprule|midrule|bottomrule|begin\{tab|end\{tab).*|[-=]{3,}(?:[ \t|+]+[-=]{3,})+)\s*$"),
            ("table_bar", r"\s*[|│║](?:[^|│║]*[|│║]){2,}\s*$"),
            ("table_latex", r"[^&\n]{1,60}(?:&[^&\n]{1,60})+\\\\"),
            ("junk_log", r"\s*[\[(<]?(?:\d{4}[-/]\d\d[-/]\d\d[T ]\d\d:\d\d|\d\d[-/]\w{2,3}[-/]\d{2,4}[: ]\d\d:\d\d|\w{3} +\d+ \d\d:\d\d:\d\d|\d\d:\d\d:\d\d[ ,.\]])|[\[<]?(?:DEBUG|INFO|WARN|WARNING|ERROR|FATAL|CRITICAL|TRACE)\b[\]>]?[ :\[|-]|[IWEF]\d{4} \d\d:|\[ *\d+\.\d{3,}\] "),
            ("junk_progress", r"\s*(?:Epoch|Step|Iter\w*|Batch|Download\w*|Training|Processing)\b[^\n]{0,40}?\d+ ?(?:/ ?\d+|%)|\s*\d+/\d+ \[|[^\n]{0,40}\d{1,3}%[ |\[]"),
            ("junk_hex", r"\s*(?:0x)?[0-9a-fA-F]{4,16}[:|]?\s+(?:[0-9a-fA-F]{2,8}(?:\s+|$)){3,}|\s*(?:(?:0x)?[0-9a-fA-F]{2}[ ,:]){8,}"),
            ("code_import", r"\s*(?:import|from|using|package|require|library|#include)(?=[\s(])"),
            ("code", r"\s*(?:(?:def|class|for|while|if|elif|return|assert|with|except|print|function|var|let|const)(?=[\s(])|(?:else|try|finally):|end\s*$|plt\.|@\w|>>>|\.\.\.|[%!]\w|\$ |in \[\d|out\[\d)[^?!]*$"),
            ("list_item", rf"\s*(?:>\s*)?{_BULLET}\s+\S|\s*</?(?:ul|ol|li|dl|dt|dd)\b|\s*\\item\b"),
            ("list_pin", r"\s*[\w.\-\[\]]+\s?(?:[=~><!]=|@)\s?v?\d[\w.*+\-]*\s*$"),
            ("list_path", r"\s*(?:[\w.\-~]*[/\\])+[\w.\-]+\s*$|\s*[\w\-]+\.(?:csv|json|txt|png|jpg|py|ipynb|md|parquet|tsv|xlsx?|pdf|zip|gz|html?)\s*$|\s*https?://\S+\s*$"),
            ("table_sep", rf"\s*(?:[^\t\n]{{0,40}}\t){{2,}}[^\t\n]{{0,40}}$|(?:[^;\n]{{0,30}};){{2,}}[^;\n(){{}}]{{0,30}}$|(?:{_CELL}?,){{2,}}{_CELL}?\s*$|(?:{_CELL}, ?){{3,}}{_CELL}\s*$"),
            ("table_tuple", rf"\s*[\[(\]]+\s*(?:['\"]?{_CELL}['\"]?,\s*){{2,}}['\"]?{_CELL}['\"]?\s*[\])]+,?\s*$"),
            ("table_space", rf"\s*{_CELL}(?:[ ]{{2,}}{_CELL}){{2,}}\s*$|\s{{2,}}{_CELL}(?:[ ]{{2,}}{_CELL})+\s*$|\s*{_NUMBER}[ \t]+(?:{_CELL}[ \t]+){{0,20}}?{_NUMBER}(?:[ \t]+{_CELL}){{0,20}}\s*$"),
            ("code_like", r"[^\n]*?(?:\w\(|\w\[|\s[-+*/|&<>=!]?=\s|[{};]\s*$|->|::|==|<-|\):?\s*$)|\s*[\])}]+[,;:]?\s*$"),
            ("list_pair", r"\s*[\w\-.' ]{1,30}(?:,|:|\s[-–=]>?)\s[\w\-.' ]{1,40}$"),
            ("short", r"\s*\S+(?:\s\S+){0,4}\s*$"),
        )
    )
)
_REPEATED = re.compile(r"(\S.{0,7}?)\1{9,}|(\S\s?)\2{9,}", re.S)
_GARBLED = re.compile("[\ufffd\x00-\x08\x0b\x0e-\x1f\x7f-\x9f\u0192\u2030\u201a\u00b8\u00bf\u00b9\u00d0\u00d1\u00c3\u00c2\u02c6\u20ac\u2122\u00a6\u00a4\u00af\u00b7\u00ba\u00bb\u00ac\u00a7\u00a9\u00ae\u00b1\u00b0\u00b5\u00b6]")
#: Scripts that put no spaces between words.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
_SENTENCE_END = re.compile(r"[.!?:;…。]['\"”’)\]]*\s*$")
_SPACE = re.compile(r"\s")
_ESCAPED = re.compile(r"\\[nrtux0]")

LONG = 70


def _dense(line: str) -> bool:
    """Encoded, minified or garbled: long without words between spaces, one unit over and over, or broken characters."""
    n = len(line)
    if not line.isascii() and len(_UNSPACED.findall(line)) > 0.3 * n:
        return bool(_REPEATED.match(line.strip())) and len(set(line)) < 24 and n >= LONG
    if n >= 12 and not line.isascii() and len(_GARBLED.findall(line)) > 0.12 * n:
        return True
    if n < LONG:
        return False
    if _REPEATED.match(line.strip()) and len(set(line)) < 24:
        return True
    spaces = len(_SPACE.findall(line))
    if spaces < 0.055 * n:
        return True
    return len(_ESCAPED.findall(line)) > 0.1 * n


def _line_kind(line: str) -> str:
    m = _LINE.match(line)
    kind = m.lastgroup.partition("_")[0] if m else ""
    if kind in ("table", "trace"):
        return "table" if kind == "table" else "code"
    if (len(line) >= LONG or not line.isascii()) and _dense(line):
        return "junk"
    if kind == "list" and len(line) > 90:
        return ""
    if kind == "short" and _SENTENCE_END.search(line):
        return ""
    return kind


def shape_characters(text: str) -> dict[str, int]:
    """Characters of the text in list, table and junk blocks.

    A block is lines without an empty one between.  Lines of one kind make
    others in their block that could be anything (headers, short entries,
    wrapped ends) the same.
    """
    out = dict.fromkeys(SHAPES, 0)
    for block in text.split("\n\n"):
        lines = block.strip("\n").split("\n")
        kinds = [_line_kind(x) if x else "" for x in lines]
        size = dict.fromkeys(("list", "table", "junk", "code", "short", ""), 0)
        count = dict.fromkeys(size, 0)
        for x, k in zip(lines, kinds):
            size[k] += len(x) + 1
            count[k] += 1
        if len(lines) == 1:
            if kinds[0] == "junk" or kinds[0] == "table" and len(lines[0]) > LONG:
                out[kinds[0]] += len(block)
            continue
        if count["table"] >= 2 and size["table"] > max(size["code"] + size["junk"] + size["list"], size[""]):
            out["table"] += size["table"] + size["short"] + (size[""] if size[""] < size["table"] / 4 else 0) + size["list"]
            out["junk"] += size["junk"]
            continue
        out["junk"] += size["junk"]
        if count["junk"] and size["junk"] > size["code"] + size[""]:
            out["junk"] += size["short"] + size[""] + size["list"] + size["table"]
            continue
        entries = count["list"] + count["short"]
        if entries >= 3 and size["list"] + size["short"] > 2 * size["code"] and entries > 2 * count[""]:
            out["list"] += size["list"] + size["short"] + size["code"] + size["table"]
        elif count["list"] >= 3 and not count["code"]:
            out["list"] += size["list"]
    return out


_LETTER, _DIGIT, _SPACE_, _WORD_OTHER, _SYMBOL = range(5)
_SEPARATOR, _BRACKET = 8, 16
_IDEOGRAPHS = 0x20000


def _character_classes() -> np.ndarray:
    """The class of every code point below ``_IDEOGRAPHS``, from where on all are letters; separators and brackets have one more bit."""
    out = np.full(_IDEOGRAPHS + 1, _SYMBOL, np.uint8)
    for i in range(_IDEOGRAPHS + 1):
        c = chr(i)
        if c.isalpha():
            out[i] = _LETTER
        elif c.isdigit():
            out[i] = _DIGIT
        elif c.isspace():
            out[i] = _SPACE_
        elif c.isalnum() or c == "_":
            out[i] = _WORD_OTHER
    for c in ",|&;":
        out[ord(c)] |= _SEPARATOR
    out[ord("\t")] |= _SEPARATOR
    for c in "()[]{}=":
        out[ord(c)] |= _BRACKET
    return out


_CLASSES: list[np.ndarray] = []
_END = frozenset(".!?:;…。！？")
_MARKS = frozenset("-*+•◦0123456789")


def document_statistics(text: str) -> tuple[list[float], list[float]]:
    """The values of ``STATISTICS`` and of ``SHARES`` for one text, an empty one's all 0.

    A long text is taken in pieces that end with a block, so that the counts add up exactly.
    """
    if not text:
        return [0.0] * len(STATISTICS), [0.0] * len(SHARES)
    if not _CLASSES:
        _CLASSES.append(_character_classes())
    words = letters = digits = spaces = symbols = separators = brackets = common = 0
    lines = ended = marked = line_characters = short = long = 0
    seen: set[str] = set()
    shapes = dict.fromkeys(SHAPES, 0)
    for piece in pieces(text, "\n\n"):
        c = _CLASSES[0][np.minimum(np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32), _IDEOGRAPHS)]
        kind = np.bincount(c, minlength=32)
        letter = c == _LETTER
        words += int(letter[0]) + int(np.count_nonzero(letter[1:] & ~letter[:-1]))
        letters += int(kind[_LETTER])
        digits += int(kind[_DIGIT])
        spaces += int(kind[_SPACE_] + kind[_SPACE_ | _SEPARATOR])
        symbols += int(kind[_SYMBOL] + kind[_SYMBOL | _SEPARATOR] + kind[_SYMBOL | _BRACKET])
        separators += int(kind[_SEPARATOR:_BRACKET].sum())
        brackets += int(kind[_BRACKET:].sum())
        common += sum(map(COMMON_WORDS.__contains__, piece.lower().split()))
        seen.update(piece)
        for line in piece.split("\n"):
            bare = line.strip()
            if bare:
                n = len(line)
                lines += 1
                line_characters += n
                ended += bare[-1] in _END
                marked += bare[0] in _MARKS
                if n <= SHORT_LINE:
                    short += n
                elif n >= LONG_LINE:
                    long += n
        for s, k in shape_characters(piece).items():
            shapes[s] += k
    n = len(text)
    values = (
        words,
        letters / max(1, words),
        symbols / n,
        ended / max(1, lines),
        common / max(1, words),
        letters / n,
        digits / n,
        spaces / n,
        separators / n,
        brackets / n,
        len(seen) / n**0.5,
        line_characters / max(1, lines),
        short / n,
        long / n,
        marked / max(1, lines),
    )
    return [round(float(v), 4) for v in values], [min(1.0, shapes[s] / n) for s in SHAPES]


def statistics(documents: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    """``(doc_id, lang, *STATISTICS, *SHARES)``: one row a document with an id and a text.

    Languages are lower-cased and cut at a hyphen; null or empty ones are ``und``.
    A null text or id gives no row, an empty text has zeros.  Whole texts are read.
    """
    language = F.split(F.lower(F.trim(F.col(lang))), "[-_]")[0]
    rows = documents.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        F.when(language.isNull() | (language == ""), "und").otherwise(language).alias("lang"),
        F.col(text).alias("text"),
    ).where("doc_id IS NOT NULL AND text IS NOT NULL")
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string())] + [(s, pa.float64()) for s in STATISTICS + SHARES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [document_statistics(t.as_py()) for t in b.column(2)]
            values = list(zip(*(v + s for v, s in found))) or [()] * (len(STATISTICS) + len(SHARES))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(v, pa.float64()) for v in values)], schema=schema)

    return rows.mapInArrow(run, "doc_id bigint, lang string, " + ", ".join(f"{s} double" for s in STATISTICS + SHARES))


def tail_probabilities(ws: Workspace, stats: DataFrame) -> DataFrame:
    """``(statistic, lang, value, left_tail, right_tail)`` for every distinct value.

    Exact empirical tails within a language, to which the tails in the whole
    collection are added with the weight of ``PSEUDO_DOCUMENTS``.  Equal values
    are counted first, combined on the map side; the distinct ones are
    range-partitioned by statistic and value, so each partition is a stretch of
    the sorted order.  Running sums inside the partition plus the partition's
    offsets, from one small row a partition, are the ranks in the language and
    in all.  No group is ever sorted in one task.
    """
    counts = _unpivot(stats).groupBy("statistic", "lang", "value").agg(F.count(F.lit(1)).alias("n"))
    # the partition is written beside its rows: its number must not change when they are read again
    ranged = counts.repartitionByRange("statistic", "value").withColumn("part", F.spark_partition_id())
    ranged = ws.save(ranged, "ranged")

    def offsets(by: list[str], prefix: str) -> DataFrame:
        sums = ranged.groupBy("part", *by).agg(F.sum("n").alias("own"))
        group = Window.partitionBy(*by)
        return sums.select(
            "part",
            *by,
            (F.sum("own").over(group.orderBy("part")) - F.col("own")).alias(f"{prefix}_offset"),
            F.sum("own").over(group).alias(f"{prefix}_total"),
        )

    rows = ranged
    for by, prefix in ((["statistic", "lang"], "lang"), (["statistic"], "all")):
        w = Window.partitionBy("part", *by).orderBy("value").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        at = Window.partitionBy("part", *by, "value")
        rows = rows.withColumn(f"{prefix}_upto", F.sum("n").over(w)).withColumn(f"{prefix}_same", F.sum("n").over(at))
        rows = rows.join(offsets(by, prefix), ["part", *by])
    k = PSEUDO_DOCUMENTS

    def tails(prefix: str):
        upto, total = F.col(f"{prefix}_offset") + F.col(f"{prefix}_upto"), F.col(f"{prefix}_total")
        return upto, total - upto + F.col(f"{prefix}_same"), total

    left, right, n = tails("lang")
    all_left, all_right, all_n = tails("all")
    return rows.select(
        "statistic",
        "lang",
        "value",
        ((left + k * all_left / all_n) / (n + k)).alias("left_tail"),
        ((right + k * all_right / all_n) / (n + k)).alias("right_tail"),
    )


def _unpivot(stats: DataFrame) -> DataFrame:
    pairs = [F.struct(F.lit(i).alias("statistic"), F.col(s).alias("value")) for i, s in enumerate(STATISTICS)]
    return stats.select("doc_id", "lang", F.explode(F.array(*pairs)).alias("p")).select(
        "doc_id", "lang", "p.statistic", "p.value"
    )


@dataclass
class ShapeModel:
    """Weights of the negative logarithms of the tails in the score of each shape, and of no shape.

    ``weights[k]`` has a left and a right one for each statistic, ``bias[k]`` a
    constant; the last ``k`` is no shape.  A document is taken for a shape
    where its best shape's score is at least ``cut`` above that of no shape.
    ``recall`` and ``precision`` of that choice are those on labels that were held out.
    """

    weights: np.ndarray
    bias: np.ndarray
    cut: float
    fitted: int = 0
    held_out: int = 0
    recall: float = 1.0
    precision: float = 1.0


def fit_model(features: np.ndarray, shapes: list[str], held_out: np.ndarray, steps: int = 1_500, penalty: float = 0.02) -> ShapeModel:
    """Logistic regression on the labelled documents that are not held out.

    ``cut`` is the logarithm of ``LEAST_ODDS``.  Without any document of a shape
    nothing can be told apart and the cut lets every one pass.
    """
    k = len(SHAPES) + 1
    y = np.array([SHAPES.index(s) if s in SHAPES else k - 1 for s in shapes], np.int64)
    own = ~held_out
    weights, bias = np.zeros((k, features.shape[1] if features.ndim == 2 else 2 * len(STATISTICS))), np.zeros(k)
    if not (y[own] < k - 1).any():
        return ShapeModel(weights, bias, -np.inf, int(own.sum()), int(held_out.sum()))
    x, mean, spread = features[own], features[own].mean(0), features[own].std(0) + 1e-3
    x = np.c_[(x - mean) / spread, np.ones(len(x))]
    w, one = np.zeros((x.shape[1], k)), np.eye(k)[y[own]]
    for _ in range(steps):
        p = np.exp(x @ w - (x @ w).max(1, keepdims=True))
        w -= 0.3 * (x.T @ (p / p.sum(1, keepdims=True) - one) / len(x) + penalty * w)
    weights = (w[:-1] / spread[:, None]).T
    bias = w[-1] - weights @ mean

    def margin(f: np.ndarray) -> np.ndarray:
        s = f @ weights.T + bias
        return s[:, :-1].max(1) - s[:, -1]

    model = ShapeModel(weights, bias, float(np.log(LEAST_ODDS)), int(own.sum()), int(held_out.sum()))
    if held_out.any():
        chosen, true = margin(features[held_out]) >= model.cut, y[held_out] < k - 1
        model.recall = float((chosen & true).sum() / max(1, true.sum()))
        model.precision = float((chosen & true).sum() / max(1, chosen.sum()))
    return model


class Quality:
    """The statistics of documents, ranked within their language, and the scores made of the ranks.

    ``stats`` is ``statistics`` written once, ``tails`` the tail probabilities.

    Documents without an id or text give no row; an empty table gives none.
    Equal values share their rank, so ties and repeated texts score alike.
    Repeated ids are not expected: their rows would be merged into one.
    """

    def __init__(self, documents: DataFrame, doc_id: str, text: str, lang: str):
        self.ws = Workspace(documents.sparkSession, "quality")
        self.stats = self.ws.save(statistics(documents, doc_id, text, lang), "statistics")
        self.tails = self.ws.save(tail_probabilities(self.ws, self.stats), "tails")

    def _ranked(self, stats: DataFrame) -> DataFrame:
        logs = [(-F.log(f"{side}_tail")).alias(side) for side in ("left", "right")]
        return _unpivot(stats).join(self.tails, ["statistic", "lang", "value"]).select("doc_id", "statistic", *logs)

    def fit(self, labels: DataFrame, doc_id: str = "doc_id", shape: str = "shape", most: int = FIT_LABELS) -> ShapeModel:
        """The model from hand labels: of at most ``2 * most`` labelled documents, the first in
        hash order, one half is fitted on and the other held out.  Labels without a shape or
        document do not count; of a document's labels the smallest does."""
        known = labels.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(shape).alias("shape")).na.drop()
        known = known.groupBy("doc_id").agg(F.min("shape").alias("shape")).withColumn("h", F.xxhash64("doc_id"))
        some = known.join(self.stats, "doc_id").orderBy("h", "doc_id").limit(2 * most)
        ranked = self._ranked(some.select("doc_id", "lang", *STATISTICS)).groupBy("doc_id").agg(
            F.array_sort(F.collect_list(F.struct("statistic", "left", "right"))).alias("logs")
        )
        rows = known.join(ranked, "doc_id").orderBy("h", "doc_id").collect()
        features = np.array([[v for x in r["logs"] for v in (x["left"], x["right"])] for r in rows]).reshape(-1, 2 * len(STATISTICS))
        return fit_model(features, [r["shape"] for r in rows], np.arange(len(rows)) % 2 == 1)

    def scores(self, model: ShapeModel | None = None) -> DataFrame:
        """``stats`` with ``outlier_score`` and, given a model, ``list_score``, ``table_score``,
        ``junk_score`` (each less the score of no shape).

        ``outlier_score`` is the larger of the sums, over the statistics, of the
        negative logarithms of the left and of the right tail probabilities;
        the others weigh these logarithms.
        """
        made = [F.greatest(F.sum("left"), F.sum("right")).alias("outlier_score")]
        if model is not None:
            at = F.col("statistic") + 1
            for k, s in enumerate(SHAPES):
                w = (model.weights[k] - model.weights[-1]).reshape(-1, 2)
                left, right = (F.element_at(F.array(*[F.lit(float(x)) for x in w[:, i]]), at) for i in (0, 1))
                own = F.sum(left * F.col("left") + right * F.col("right")) + F.lit(float(model.bias[k] - model.bias[-1]))
                made.append(own.alias(f"{s}_score"))
        return self.stats.join(self._ranked(self.stats).groupBy("doc_id").agg(*made), "doc_id")


def shaped_documents(scored: DataFrame, model: ShapeModel, share: float = 0.5) -> DataFrame:
    """``(doc_id, shape)`` of the documents that are lists, tables or junk.

    The scores made of the ranks choose the documents.  An exact check of
    those follows: more than ``share`` of the characters are in blocks of a
    shape, which is the one that is given.
    """
    best = F.greatest(*[F.col(f"{s}_score") for s in SHAPES])
    chosen = scored if model.cut == -np.inf else scored.where(best >= F.lit(model.cut))
    shape = F.coalesce(*[F.when(F.col(f"{s}_share") > share, F.lit(s)) for s in SHAPES])
    return chosen.select("doc_id", shape.alias("shape")).where("shape IS NOT NULL")
