"""Mixing sources to target weights along a curriculum."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.workspace import Workspace

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenising pattern that belongs to that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Documents of one source that are put in order in one task, about.
BUCKET_ROWS = 20_000


def source_name(c: Column) -> Column:
    """One spelling of a source: trimmed, lower case, underscores for hyphens and spaces."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[-\s]+", "_")


def token_counts(documents: DataFrame, doc_id: str, text: str, source: str, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """``(doc_id, source, tokens)`` with the exact token count of each whole text.

    Rows with a null id, text or source are left out, as are empty texts.
    """
    rows = documents.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), source_name(F.col(source)).alias("source"), F.col(text).alias("text")
    ).where("doc_id IS NOT NULL AND source IS NOT NULL AND text <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for b in batches:
            n = [len(encode(t.as_py())) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "tokens"])

    return rows.mapInArrow(run, "doc_id bigint, source string, tokens bigint")


@dataclass
class Target:
    """What a source shall give: its share among the sources with tokens, its cap, its demand in tokens, and its schedule.

    ``weight`` is the demand's part of the total.  The source's weight at time
    t, from 0 to 1, is ``weight * (1 + slope * (2t - 1))``.
    """

    share: float
    max_repeats: int
    available: int = 0
    demand: float = 0.0
    weight: float = 0.0
    slope: float = 0.0

    @property
    def most(self) -> float:
        return float(self.max_repeats * self.available)


def plan(targets: dict[str, tuple[float, int]], available: dict[str, int], total: float | None, ramp: float, exact_shares: bool = False) -> tuple[dict[str, Target], float]:
    """The sources that have tokens with their demands, and the total that these make.

    The shares of sources without any token are spread over the others in
    proportion.  ``total`` defaults to all tokens that the sources hold.  Each
    source gives its share of it; one whose share is more than its cap allows
    gives all that it can, and what is missing is spread over the others in
    proportion to their shares, until the total is met or all sources are
    exhausted.  Only with ``exact_shares`` the total is cut instead to the
    largest one at which every share holds within its cap.

    Sources that may be repeated more come later: the slopes are proportional to
    the caps less their weighted mean, at most ``ramp``, so the weights add up
    to 1 at all times.
    """
    live = {s: Target(w, r, available[s]) for s, (w, r) in targets.items() if available.get(s) and w > 0 and r > 0}
    if not live:
        return {}, 0.0
    scale = sum(t.share for t in live.values())
    for t in live.values():
        t.share /= scale
    total = float(sum(t.available for t in live.values())) if total is None else float(total)
    if exact_shares:
        total = min(total, *(t.most / t.share for t in live.values()))
    left, open_ = total, dict(live)
    while open_:
        rate = left / sum(t.share for t in open_.values())
        full = [s for s, t in open_.items() if t.share * rate >= t.most]
        for s in full or list(open_):
            t = open_.pop(s)
            t.demand = min(t.most, t.share * rate)
            left = max(0.0, left - t.demand)
    total = sum(t.demand for t in live.values())
    for t in live.values():
        t.weight = t.demand / total if total else 0.0
    mean = sum(t.weight * t.max_repeats for t in live.values())
    spread = max(abs(t.max_repeats - mean) for t in live.values()) or 1.0
    for t in live.values():
        t.slope = ramp * (t.max_repeats - mean) / spread
    return live, total


def _by_source(values: dict[str, float]) -> Column:
    """A literal map lookup; there is one entry a target row, and targets are a short table."""
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col("source")]


class Mixture:
    """Documents combined so that each source has its target share of all tokens, as far as its cap allows.

    ``documents``: ``(doc_id, source, epoch, tokens, position)``, one row a use,
    in training order; ``position`` is the token position of the use's start.
    ``report``: for every target ``(source, target_share, normalised_share,
    planned_share, actual_share, tokens, uses, documents, available_tokens,
    max_repeats, most_uses, missing_tokens)``: the share that was asked for, the
    same among the sources that have tokens, the one left by the caps, and the
    one of the mixture; ``missing_tokens`` is what the cap keeps from the
    normalised share of ``total_tokens``.  See ``plan`` for what happens then.

    Each source's weight schedule is integrated over time to its cumulative
    token demand.  The source's documents, in a hash order, fill cumulative
    tokens, epoch after epoch up to the cap; inverting the demand turns a use's
    cumulative tokens into the time of its training position, and one range
    sort by position gives the order.  A use is taken when it starts below the
    demand, so a source exceeds it by less than one document, and the actual
    share differs from the planned one by as much.

    Cumulative tokens are prefix sums without any large window: hash buckets of
    about ``BUCKET_ROWS`` rows are summed, the bucket sums are accumulated in
    groups of as many buckets as there are groups, and inside a bucket the rows
    are.  A source with most rows is spread over its buckets.  Equal hashes are
    ordered by id.

    Documents without id, text or source, of no target, or with no token are
    not used.  Targets with a null or zero share, or no documents, are reported
    with share 0.  Of several target rows of one source the last by share and
    cap counts.  Empty tables give no rows.  Repeated documents are documents.
    """

    def __init__(
        self,
        documents: DataFrame,
        targets: DataFrame,
        doc_id: str = "doc_id",
        text: str = "text",
        source: str = "source",
        tokenizer: str = TOKENIZER,
        total_tokens: float | None = None,
        ramp: float = 0.8,
        seed: int = 42,
        exact_shares: bool = False,
    ):
        spark = documents.sparkSession
        ws = Workspace(spark, "mixing")
        wanted = {
            r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0))
            for r in targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
            .where("source IS NOT NULL")
            .orderBy("source", "target_share", "max_repeats")
            .collect()
        }
        chosen = documents.where(source_name(F.col(source)).isin(list(wanted)))
        counts = ws.save(token_counts(chosen, doc_id, text, source, tokenizer).where("tokens > 0"), "tokens")
        sums = {r["source"]: (r["tokens"], r["n"]) for r in counts.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).collect()}
        live, total = plan(wanted, {s: t for s, (t, _) in sums.items()}, total_tokens, ramp, exact_shares)
        if not live or not total:
            empty = counts.where("false").select(
                "doc_id", "source", F.lit(0).alias("epoch"), "tokens", F.lit(0.0).alias("position")
            )
            self.documents = empty
        else:
            self.documents = self._uses(counts, live, total, sum(n for _, n in sums.values()), seed)
        self.total_tokens = total
        used = self.documents.groupBy("source", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("uses"))
        used = used.groupBy("source").agg(
            F.sum("tokens").alias("tokens"),
            F.sum("uses").alias("uses"),
            F.count(F.lit(1)).alias("documents"),
            F.max("uses").alias("most_uses"),
        )
        wish = float(sum(t.available for t in live.values())) if total_tokens is None else float(total_tokens)
        rows = []
        for s, (w, r) in wanted.items():
            t = live.get(s, Target(0.0, r))
            rows.append((s, w, round(t.share, 6), round(t.weight, 6), r, sums.get(s, (0, 0))[0], max(0, round(t.share * wish - t.demand))))
        asked = spark.createDataFrame(
            rows,
            "source string, target_share double, normalised_share double, planned_share double, max_repeats int, available_tokens bigint, missing_tokens bigint",
        )
        share = F.try_divide(F.col("tokens"), F.sum("tokens").over(Window.partitionBy()))
        self.report = (
            asked.join(used, "source", "left")
            .na.fill(0, ["tokens", "uses", "documents", "most_uses"])
            .withColumn("actual_share", F.coalesce(F.round(share, 6), F.lit(0.0)))
        )

    def _uses(self, counts: DataFrame, live: dict[str, Target], total: float, n: int, seed: int) -> DataFrame:
        bits = max(0, (n // BUCKET_ROWS).bit_length())
        rows = counts.where(F.col("source").isin(list(live))).withColumn("key", F.xxhash64(F.lit(seed), "doc_id"))
        rows = rows.withColumn("bucket", F.shiftright("key", 64 - bits) if bits else F.lit(0).cast("bigint"))
        sums = rows.groupBy("source", "bucket").agg(F.sum("tokens").alias("n")).withColumn("outer", F.shiftright("bucket", bits // 2))

        def before(within: list[str], order: str) -> Column:
            return F.sum("n").over(Window.partitionBy(*within).orderBy(order)) - F.col("n")

        groups = sums.groupBy("source", "outer").agg(F.sum("n").alias("n"))
        groups = groups.select("source", "outer", before(["source"], "outer").alias("group_offset"))
        offsets = sums.withColumn("own", before(["source", "outer"], "bucket")).join(groups, ["source", "outer"])
        offsets = offsets.select("source", "bucket", (F.col("own") + F.col("group_offset")).alias("offset"))
        inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
        start = F.coalesce(F.sum("tokens").over(inside), F.lit(0)) + F.col("offset")
        placed = rows.join(offsets, ["source", "bucket"]).withColumn("start", start)
        demand = _by_source({s: t.demand for s, t in live.items()})
        available = _by_source({s: t.available for s, t in live.items()})
        repeats = _by_source({s: t.max_repeats for s, t in live.items()})
        times = F.least(F.ceil((demand - F.col("start")) / available), repeats).cast("int")
        uses = placed.withColumn("times", times).where("times > 0").select(
            "doc_id", "source", "tokens", "start", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("epoch")
        )
        y = (F.col("epoch") * available + F.col("start")) / demand
        a = _by_source({s: t.slope for s, t in live.items()})
        # the demand share * (t + a (t^2 - t)) solved for t, in the form that is stable at a = 0
        t = 2 * y / ((1 - a) + F.sqrt((1 - a) * (1 - a) + 4 * a * y))
        return uses.select("doc_id", "source", "epoch", "tokens", (t * F.lit(total)).alias("position")).orderBy(
            "position", "source", "doc_id", "epoch"
        )
