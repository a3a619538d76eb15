"""Parent-child links to full hierarchies, by level-wise frontier joins."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.workspace import Workspace


#: Segments of paths may have so many rows for each link and level; beyond it they stay as short as they are.
GROWTH = 4
MAX_STRIDE = 32
#: Rounds in which nodes without parent or child are left out before cycles are looked for among the pairs of the others.
LAYERS = 4


def closed_pairs(ws: Workspace, links: DataFrame, within: list[str]) -> list[DataFrame]:
    """Tables whose ``new`` rows are all pairs ``(*within, top, bottom)`` once that walks of distinct links lead along;
    those of the first table are the links.

    A round joins the pairs with a walk of exactly ``h`` links and all pairs up
    to ``h`` links apart to those up to ``2h``.
    """
    spark, yes, no = links.sparkSession, F.lit(True), F.lit(False)
    pair = [*within, "top", "bottom"]
    # full: there is a walk of h links; new: there is none of fewer
    last, n = ws.save_counted(links.select(*pair, yes.alias("full"), yes.alias("new")), "pairs")
    tables = [last]
    while n:
        step = last.where("full").select(*within, "top", F.col("bottom").alias("middle"))
        known = spark.read.schema(last.schema).parquet(*[t._loomgraph_path for t in tables]).where("new").select(*pair)
        lower = known.select("*", no.alias("full")).union(last.where("full").select(*pair, yes))
        made = (
            step.join(lower.withColumnRenamed("top", "middle"), [*within, "middle"])
            .groupBy(*pair)
            .agg(F.max("full").alias("full"))
            .join(known.withColumn("old", yes), pair, "left")
            .select(*pair, "full", F.col("old").isNull().alias("new"))
            .where("full OR new")
        )
        last, n = ws.save_counted(made, "pairs", F.col("new"))
        tables.append(last)
    return tables


class Hierarchy:
    """Hierarchies of unknown depth, several relations at once.

    ``links`` has the columns ``relation, child, parent``.  Rows with a null in
    any of them give nothing.  A row with equal ends makes its id a node but is
    no link.  Repeated links count once.  Other columns are ignored.  An empty
    table gives empty results.

    ``edges(relation, parent, child)``, ``nodes(relation, node_id)``.
    ``pairs(relation, top, bottom)``: every pair once of a node and a node that
    a walk of one or more links leads down to; a node on a cycle is below itself.
    ``cyclic(relation, node_id)``: nodes on a cycle or below one.
    ``paths(relation, node_id, ids)``: one row per distinct path from a root to
    a node that is not cyclic; ``ids`` is root first, the node last.

    Pairs up to ``h`` links apart and the pairs with a walk of exactly ``h``
    links make, joined, those up to ``2h``: in a tree each is made once, and
    the rounds are the logarithm of the depth.  A node that is repeated in its
    own walk, one that is its own ancestor, is on a cycle; it and what is below
    it are never reached by paths.  Only pairs of inner nodes are looked at for that.  Paths grow level-wise from the roots: the
    frontier is joined with all downward segments of up to ``h`` links, so one
    round adds ``h`` levels; ``h`` doubles only while the measured table stays
    within a fixed multiple of the links.  Each round is a written table: plans
    stay flat and a lost executor costs one round at most.  Each result is made
    when it is first asked for.
    """

    def __init__(self, links: DataFrame):
        self.spark = links.sparkSession
        self.ws = Workspace(self.spark, "hierarchy")
        rows = links.select("relation", "child", "parent").na.drop().distinct()
        rows = self.ws.save(rows, "links")
        self.nodes = rows.select("relation", F.col("child").alias("node_id")).union(
            rows.select("relation", F.col("parent").alias("node_id"))
        ).distinct()
        self.edges = rows.where("child <> parent").select("relation", "parent", "child")

    def _read(self, tables: list[DataFrame]) -> DataFrame:
        return self.spark.read.schema(tables[0].schema).parquet(*[t._loomgraph_path for t in tables])

    @cached_property
    def pairs(self) -> DataFrame:
        ends = self.edges.select("relation", F.col("parent").alias("top"), F.col("child").alias("bottom"))
        tables = closed_pairs(self.ws, ends, ["relation"])
        return self._read(tables).where("new").select("relation", "top", "bottom")

    @cached_property
    def cyclic(self) -> DataFrame:
        # what has no parent or no child is on no cycle: some layers of such nodes, most of a tree, go first
        core, n = self.ws.save_counted(self.edges, "core")
        before, layers = n + 1, 0
        while n and n < before and layers < LAYERS:
            inner = core.join(core.select("relation", F.col("parent").alias("child")).distinct(), ["relation", "child"], "left_semi")
            inner = inner.join(core.select("relation", F.col("child").alias("parent")).distinct(), ["relation", "parent"], "left_semi")
            before, layers = n, layers + 1
            core, n = self.ws.save_counted(inner.select("relation", "parent", "child"), "core")
        pairs = self._read(closed_pairs(self.ws, core.withColumnsRenamed({"parent": "top", "child": "bottom"}), ["relation"])).where("new")
        ring = pairs.where("top = bottom").select("relation", "top")
        below = pairs.join(ring, ["relation", "top"], "left_semi").select("relation", F.col("bottom").alias("node_id")).distinct()
        new, n = self.ws.save_counted(below, "cyclic")
        found = [new]
        while n:  # through the layers
            step = self.edges.join(new.withColumnRenamed("node_id", "parent"), ["relation", "parent"], "left_semi")
            step = step.select("relation", F.col("child").alias("node_id")).distinct().join(self._read(found), ["relation", "node_id"], "left_anti")
            new, n = self.ws.save_counted(step, "cyclic")
            found.append(new)
        return self._read(found)

    def _segments(self, good: DataFrame, n_good: int) -> tuple[DataFrame, int]:
        """``(relation, parent, steps, h)``: downward chains of 1 to h links from
        ``parent``; ``steps`` are the ids below it."""
        parts = [self.ws.save(good.select("relation", "parent", F.array("child").alias("steps")), "segments")]
        h = 1
        while h < MAX_STRIDE:
            seg = self._read(parts)
            full = seg.where(F.size("steps") == h).withColumnRenamed("steps", "first")
            longer = full.join(
                seg.withColumnRenamed("parent", "middle"),
                (F.element_at("first", -1) == F.col("middle")) & (full["relation"] == seg["relation"]),
            ).select(full["relation"], full["parent"], F.concat("first", "steps").alias("steps"))
            longer, n = self.ws.save_counted(longer, "segments")
            if n == 0 or n > GROWTH * h * n_good:
                break
            parts.append(longer)
            h *= 2
        return self._read(parts), h

    @cached_property
    def paths(self) -> DataFrame:
        good, n_good = self.ws.save_counted(
            self.edges.join(
                self.cyclic.withColumnRenamed("node_id", "child"), ["relation", "child"], "left_anti"
            ).select("relation", "parent", "child"),
            "good",
        )
        seg, h = self._segments(good, n_good)
        children = self.edges.select("relation", F.col("child").alias("node_id")).distinct()
        level, n = self.ws.save_counted(
            self.nodes.join(children, ["relation", "node_id"], "left_anti").select(
                "relation", "node_id", F.array("node_id").alias("ids"), F.lit(0).alias("links")
            ),
            "level",
        )
        levels = [level]
        while n:
            # only the deepest nodes of a round are its frontier: the others' children were reached with them
            front = level.where(F.col("links") == (0 if len(levels) == 1 else h)).withColumnRenamed("node_id", "parent")
            step = front.join(seg, ["relation", "parent"]).select(
                "relation",
                F.element_at("steps", -1).alias("node_id"),
                F.concat("ids", "steps").alias("ids"),
                F.size("steps").alias("links"),
            )
            level, n = self.ws.save_counted(step, "level")
            if n:
                levels.append(level)
        return self._read(levels).drop("links")

    def node_paths(self) -> DataFrame:
        """``(relation, node_id, path, depth, root)``: one row per path, and the
        one row with path ``cycle``, null depth and null root for a cyclic node."""
        straight = self.paths.select(
            "relation",
            "node_id",
            F.array_join(F.col("ids").cast("array<string>"), "/").alias("path"),
            (F.size("ids") - 1).alias("depth"),
            F.element_at("ids", 1).alias("root"),
        )
        cyclic = self.cyclic.select(
            "relation",
            "node_id",
            F.lit("cycle").alias("path"),
            F.lit(None).cast("int").alias("depth"),
            F.lit(None).cast("bigint").alias("root"),
        )
        return straight.unionByName(cyclic)

    def descendants(self) -> DataFrame:
        """``(relation, node_id, descendant_id)``: the ancestor pairs."""
        return self.pairs.select("relation", F.col("top").alias("node_id"), F.col("bottom").alias("descendant_id"))
