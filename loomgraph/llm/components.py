"""Pairwise matches to groups: connected components by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.workspace import Workspace


def connected_groups(pairs: DataFrame, within: str, left: str, right: str) -> DataFrame:
    """``(within, group_id, member_id)``: one row for every id of a complete pair.

    Groups are formed within a value of ``within``, ignoring direction;
    ``group_id`` is the smallest id of the group.  A pair with a null in any of
    the three columns gives nothing, an id paired only with itself is a group
    of one, repeated pairs and other columns change nothing, an empty table
    gives no rows.

    Each round every vertex hooks to the vertex of its closed neighbourhood
    that comes first in a fresh hash order, then edges are relabelled, loops
    dropped and the rest deduplicated, until no edge is left.  A constant share
    of the vertices goes in every round in expectation, whatever the shape of
    the graph, so chains and stars take a logarithmic number of rounds.  The
    mappings of the rounds are then expanded from the last to the first.

    No neighbourhood is ever gathered: a hub's neighbours meet in a minimum
    that is combined on the map side, and the joins have a unique right side,
    so the rows of a hub or a giant group can be split over tasks by adaptive
    skew handling.  Each round writes its mapping and its remaining edges.
    """
    spark = pairs.sparkSession
    ws = Workspace(spark, "components")
    rows = pairs.select(F.col(within).alias("w"), F.col(left).alias("a"), F.col(right).alias("b")).na.drop()
    rows = ws.save(
        rows.select("w", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs"
    )
    vertices = rows.select("w", F.explode(F.array("a", "b")).alias("v")).distinct()
    edges, n = ws.save_counted(rows.where("a <> b"), "edges")
    mappings: list[DataFrame] = []
    while n:
        seed = F.lit(0x9E3779B1 * (len(mappings) + 1))

        def ranked(c: str):
            return F.struct(F.xxhash64(seed, F.col(c)).alias("h"), F.col(c).alias("x"))

        # one row for each end: the first of the two ends in this round's order
        ends = edges.select(
            "w",
            F.explode(
                F.array(
                    F.struct(F.col("a").alias("v"), F.least(ranked("a"), ranked("b")).alias("first")),
                    F.struct(F.col("b").alias("v"), F.least(ranked("a"), ranked("b")).alias("first")),
                )
            ).alias("e"),
        )
        hooks = ends.groupBy("w", F.col("e.v").alias("v")).agg(F.min("e.first").alias("first"))
        mapping = ws.save(hooks.select("w", "v", F.col("first.x").alias("to")), "mapping")
        mappings.append(mapping)
        moved = (
            edges.join(mapping.select("w", F.col("v").alias("a"), F.col("to").alias("ra")), ["w", "a"])
            .join(mapping.select("w", F.col("v").alias("b"), F.col("to").alias("rb")), ["w", "b"])
            .where("ra <> rb")
            .select("w", F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct()
        )
        smaller, n = ws.save_counted(moved, "edges")
        ws.drop(edges)
        edges = smaller
    # expand: where a vertex of round i ends after all later rounds
    final = None
    for mapping in reversed(mappings):
        if final is None:
            final = mapping
            continue
        after = final.select("w", F.col("v").alias("to"), F.col("to").alias("last"))
        expanded = mapping.join(after, ["w", "to"], "left").select(
            "w", "v", F.coalesce("last", "to").alias("to")
        )
        final = ws.save(expanded, "expanded")
    if final is None:
        labelled = vertices.select("w", "v", F.col("v").alias("to"))
    else:
        labelled = vertices.join(final, ["w", "v"], "left").select("w", "v", F.coalesce("to", "v").alias("to"))
    labelled = ws.save(labelled, "labelled")
    smallest = labelled.groupBy("w", "to").agg(F.min("v").alias("group_id"))
    return labelled.join(smallest, ["w", "to"]).select(
        F.col("w").alias(within), "group_id", F.col("v").alias("member_id")
    )
