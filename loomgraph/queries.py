"""All queries of the core, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import graph_queries
from loomgraph.operators.hierarchy import Hierarchy
from loomgraph.operators.rejects import parse_lines
from loomgraph.operators.skew import heavy_keys, heavy_statistics, keyed_statistics
from loomgraph.sources.tables import table

HOT_SHARE = "0.01"


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the URL cache that are not valid, with the first reason."""
    rows = parse_lines(table(spark, d, "url_cache_lines"), "line_id", "file_name", "line_text")
    return rows.where("reason IS NOT NULL").select("line_id", "reason")


def p3_valid(spark: SparkSession, d: str) -> DataFrame:
    """The valid lines as typed (id, text) pairs."""
    rows = parse_lines(table(spark, d, "url_cache_lines"), "line_id", "file_name", "line_text")
    return rows.where("reason IS NULL").select("line_id", "id", "text")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Ids in at least 1 % of the rows of ``triples`` whose p, or s, is not null."""
    return heavy_keys(table(spark, d, "triples"), ["p", "s"], HOT_SHARE).select("field_name", "val")


def p4_heavy(spark: SparkSession, d: str) -> DataFrame:
    """Statements, distinct objects and latest load of those ids."""
    return heavy_statistics(table(spark, d, "triples"), ["p", "s"], "o", "loaded_at", HOT_SHARE)


def p4_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Statements, distinct objects and latest load of every predicate and subject."""
    t = table(spark, d, "triples")
    parts = [
        keyed_statistics(t, c, "o", "loaded_at").select(F.lit(c).alias("field_name"), "*") for c in ("p", "s")
    ]
    return parts[0].unionByName(parts[1])


def _hierarchy(spark: SparkSession, d: str) -> Hierarchy:
    schema = table(spark, d, "schema_triples").where(F.col("subset_name").isin("rdfs-subclasses", "rdfs-subproperties"))
    lists = table(spark, d, "lists")
    return Hierarchy(
        schema.select(F.col("subset_name").alias("relation"), F.col("s").alias("child"), F.col("o").alias("parent"))
        .unionByName(lists.select(F.lit("lists").alias("relation"), F.col("el").alias("child"), F.col("head").alias("parent")))
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every path from a root to a node, or ``cycle``."""
    return _hierarchy(spark, d).node_paths().select("relation", "node_id", "path")


def p5_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Path, depth and root of every node."""
    return _hierarchy(spark, d).node_paths()


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of a node and a node below it, on and below cycles too."""
    return _hierarchy(spark, d).descendants()


def queries() -> dict:
    return graph_queries.queries() | {f.__name__: f for f in (p3_found, p3_valid, p4_found, p4_heavy, p4_statistics, p5_found, p5_nodes, p5_descendants)}


_P3 = r"""
WITH lines AS (
  SELECT line_id, CASE WHEN ends_with(line_text, chr(13)) THEN left(line_text, length(line_text) - 1) ELSE line_text END AS line
  FROM url_cache_lines WHERE line_text IS NOT NULL
), fields AS (
  SELECT line_id, line, length(line) - length(replace(line, chr(9), '')) AS tabs,
         split_part(line, chr(9), 1) AS a, split_part(line, chr(9), 2) AS b FROM lines
), parts AS (
  SELECT *, regexp_extract(b, '(?s)^<([^<>]*)>$', 1) AS iri,
    regexp_matches(b, '(?s)\A<[^<>]*>\z') AS is_iri,
    regexp_matches(b, '(?s)\A"(?:[^"\\]|\\.)*"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^<[^<>]*>)?\z') AS is_literal,
    regexp_extract(b, '(?s)\A"((?:[^"\\]|\\.)*)"', 1) AS content,
    regexp_extract(b, '(?s)"\^\^<([^<>]*)>\z', 1) AS kind,
    regexp_matches(b, '(?s)"\^\^<[^<>]*>\z') AS has_kind
  FROM fields
), verdicts AS (
  SELECT line_id, a, b, CASE
    WHEN tabs <> 1 THEN 'column_count'
    WHEN NOT regexp_matches(a, '\A[0-9]+\z') OR TRY_CAST(a AS BIGINT) IS NULL THEN 'bad_id'
    WHEN NOT is_iri AND NOT is_literal THEN 'bad_quoting'
    WHEN is_iri AND (NOT regexp_matches(iri, '(?s)\A[A-Za-z][A-Za-z0-9+.\-]*:.') OR regexp_matches(iri, '[\p{Z}\p{Cc}"\x{FFFD}]')) THEN 'bad_value'
    WHEN is_literal AND (content = '' OR regexp_matches(content, '[\p{Cc}\x{FFFD}]')) THEN 'bad_value'
    WHEN has_kind AND (NOT regexp_matches(kind, '(?s)\A[A-Za-z][A-Za-z0-9+.\-]*:.') OR regexp_matches(kind, '[\p{Z}\p{Cc}"\x{FFFD}]')) THEN 'bad_value'
  END AS reason FROM parts
)
"""

_P4 = """
SELECT '{c}' AS field_name, {c} AS val, count(*) AS n_rows, count(DISTINCT o) AS n_distinct, max(loaded_at) AS latest
FROM triples WHERE {c} IS NOT NULL GROUP BY {c}"""

_P5 = """
WITH RECURSIVE rows AS (
  SELECT subset_name AS relation, s AS child, o AS parent FROM schema_triples
  WHERE subset_name IN ('rdfs-subclasses', 'rdfs-subproperties') AND s IS NOT NULL AND o IS NOT NULL
  UNION SELECT 'lists', el, head FROM lists WHERE el IS NOT NULL AND head IS NOT NULL
), edges AS (SELECT * FROM rows WHERE child <> parent),
nodes AS (SELECT relation, child AS node_id FROM rows UNION SELECT relation, parent FROM rows),
above(relation, node_id, ancestor) AS (
  SELECT relation, child, parent FROM edges
  UNION SELECT a.relation, a.node_id, e.parent FROM above a JOIN edges e ON e.relation = a.relation AND e.child = a.ancestor
), ring AS (SELECT DISTINCT relation, node_id FROM above WHERE node_id = ancestor),
cyclic AS (
  SELECT relation, node_id FROM ring
  UNION SELECT a.relation, a.node_id FROM above a JOIN ring r ON r.relation = a.relation AND r.node_id = a.ancestor
), walk(relation, node_id, path, depth, root) AS (
  SELECT relation, node_id, CAST(node_id AS VARCHAR), 0, node_id FROM nodes n
  WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.relation = n.relation AND e.child = n.node_id)
  UNION ALL
  SELECT w.relation, e.child, w.path || '/' || e.child, w.depth + 1, w.root
  FROM walk w JOIN edges e ON e.relation = w.relation AND e.parent = w.node_id
  WHERE NOT EXISTS (SELECT 1 FROM cyclic c WHERE c.relation = e.relation AND c.node_id = e.child)
)
"""


def oracle_sql() -> dict:
    every = " UNION ALL ".join(_P4.format(c=c) for c in ("p", "s"))
    return graph_queries.oracle_sql() | {
        "p3_found": _P3 + "SELECT line_id, reason FROM verdicts WHERE reason IS NOT NULL",
        "p3_valid": _P3 + "SELECT line_id, CAST(a AS BIGINT) AS id, b AS text FROM verdicts WHERE reason IS NULL",
        "p4_found": "SELECT field_name, val FROM (" + every + """) WHERE n_rows * 100 >=
  CASE field_name WHEN 'p' THEN (SELECT count(p) FROM triples) ELSE (SELECT count(s) FROM triples) END""",
        "p4_heavy": "SELECT * FROM (" + every + """) WHERE n_rows * 100 >=
  CASE field_name WHEN 'p' THEN (SELECT count(p) FROM triples) ELSE (SELECT count(s) FROM triples) END""",
        "p4_statistics": every,
        "p5_found": _P5
        + "SELECT relation, node_id, path FROM walk UNION ALL SELECT relation, node_id, 'cycle' FROM cyclic",
        "p5_nodes": _P5
        + "SELECT * FROM walk UNION ALL SELECT relation, node_id, 'cycle', NULL, NULL FROM cyclic",
        "p5_descendants": _P5 + "SELECT relation, ancestor AS node_id, node_id AS descendant_id FROM above",
    }
