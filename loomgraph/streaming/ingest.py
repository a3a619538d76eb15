"""A stream of statements into the store, with the conclusions they add."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.operators.scan import complete
from loomgraph.plans.forward import Compiled, derive, relevant_part
from loomgraph.sources.store import insert, read_store
from loomgraph.workspace import Workspace


def conclusions(new: DataFrame, stored: DataFrame, rules: list[Compiled]) -> DataFrame:
    """The statements that follow once ``new`` joins a ``stored`` set closed under the rules.

    The first round reads ``new`` at one body atom and everything at the others;
    what comes is new in turn, until nothing does.  Of what is stored only the
    predicates are read that the rules can read or conclude.
    """
    ws = Workspace(new.sparkSession, "incremental")
    total = relevant_part(complete(stored), rules).unionByName(complete(new))
    delta = complete(new)
    parts: list[DataFrame] = []
    while True:
        out = None
        for r in rules:
            for i in range(len(r.body)):
                b = derive(r, [delta if j == i else total for j in range(len(r.body))])
                out = b if out is None else out.unionByName(b)
        if out is None:
            break
        delta, n = ws.save_counted(out.distinct().join(total, ["s", "p", "o"], "left_anti").select("s", "p", "o"), "delta")
        if not n:
            break
        parts.append(delta)
        total = total.unionByName(delta)
    if not parts:
        return complete(new).where("false")
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def ingest(stream: DataFrame, store: str, checkpoint: str, rules: list[Compiled] | None = None, late: str | None = None) -> StreamingQuery:
    """Inserts each micro-batch of (s, p, o, ...) into the store, with its conclusions.

    Inserting is idempotent, as stored statements are not added again, so a
    batch that is run again after a failure changes nothing, nor do repeated
    deliveries.  ``late`` has no effect: a watermark would drop statements that
    first arrive after it.
    """

    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch = batch.select("s", "p", "o")
        if rules:
            found = conclusions(batch, read_store(spark, store), rules)
            batch = complete(batch).unionByName(found)
        insert(spark, store, batch)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def predicate_rates(stream: DataFrame, window: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Statements by predicate and window of ``asserted_at``; later ones than ``late`` are left out."""
    return (
        stream.where("p IS NOT NULL AND asserted_at IS NOT NULL")
        .withWatermark("asserted_at", late)
        .groupBy(F.window("asserted_at", window), "p")
        .agg(F.count(F.lit(1)).alias("n"))
    )
