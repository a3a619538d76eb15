"""Queries of the triple store and the reasoner, each with its SQL over the plain tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import terms as T
from loomgraph.engine import Engine
from loomgraph.operators.scan import complete, scan
from loomgraph.plans import rules as R
from loomgraph.plans.planner import predicate_statistics
from loomgraph.plans.rules import Atom
from loomgraph.plans.tbox import TBox, assemble_lists, subset
from loomgraph.sources import files
from loomgraph.sources import relational as X
from loomgraph.sources.store import compact, insert, read_store, read_subsets, scan_store, write_store, write_subsets
from loomgraph.sources.tables import table
from loomgraph.terms import clean_dictionary, decode
from loomgraph.workspace import Workspace

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its function's name, with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def triples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "triples")


def schema(spark: SparkSession, d: str, *subsets: str) -> DataFrame:
    return table(spark, d, "schema_triples").where(F.col("subset_name").isin(list(subsets)))


_T = "(SELECT DISTINCT s, p, o FROM triples WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL)"


# Scans and projections


@query(f"SELECT * FROM {_T}")
def scan_spo(spark, d):
    """Every statement once."""
    return scan(triples(spark, d))


@query(f"SELECT * FROM {_T} WHERE p = 104")
def scan_p_bound(spark, d):
    return scan(triples(spark, d), p=104)


@query(f"SELECT * FROM {_T} WHERE p = 0 AND o = 207")
def scan_po_bound(spark, d):
    return scan(triples(spark, d), p=T.TYPE, o=207)


@query(f"SELECT * FROM {_T} WHERE s IN (SELECT s FROM triples WHERE p = 0 AND o = 207 AND s IS NOT NULL)")
def scan_set_subject(spark, d):
    """Everything about the members of a class: the subject is a set."""
    t = triples(spark, d)
    return scan(t, s=scan(t, p=T.TYPE, o=207).select("s"))


@query(f"""SELECT * FROM {_T} WHERE p IN (100, 101, 104)
AND s IN (SELECT s FROM triples WHERE p = 0 AND o IN (202, 207) AND s IS NOT NULL)
AND o IN (SELECT s FROM triples WHERE p = 0 AND o IN (202, 207) AND s IS NOT NULL)""")
def scan_three_sets(spark, d):
    t = triples(spark, d)
    members = scan(t, p=T.TYPE, o=[202, 207]).select("s")
    return scan(t, s=members, p=[100, 101, 104], o=members)


@query(f"SELECT * FROM {_T} WHERE s = 9223372036854775807")
def scan_empty(spark, d):
    return scan(triples(spark, d), s=9223372036854775807)


@query(f"SELECT DISTINCT s AS x, o AS y FROM {_T} WHERE p = 100")
def project_vars(spark, d):
    return Engine(triples(spark, d)).bgp([Atom("?x", 100, "?y")], reason=False)


@query(f"SELECT DISTINCT s FROM {_T} WHERE p = 117")
def distinct_subjects(spark, d):
    return scan(triples(spark, d), p=117).select("s").distinct()


@query(f"SELECT count(*) AS n FROM {_T} WHERE p = 104")
def count_answers(spark, d):
    return scan(triples(spark, d), p=104).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT s || ' ' || o AS line FROM {_T} WHERE p = 113")
def answer_lines(spark, d):
    """Answers as text, a line each."""
    e = Engine(triples(spark, d))
    return e.answer_lines(e.bgp([Atom("?x", 113, "?y")], reason=False))


@query(f"SELECT s, p, o FROM {_T} ORDER BY s, p, o LIMIT 20")
def first_answers(spark, d):
    """The row limit of the client, made deterministic by an order."""
    return scan(triples(spark, d)).orderBy("s", "p", "o").limit(20)


@query(f"SELECT p, count(*) AS n_triples FROM {_T} GROUP BY p")
def cardinality_by_predicate(spark, d):
    return predicate_statistics(scan(triples(spark, d))).select("p", "n_triples")


@query("""SELECT p, least(2147483647, sum(n)) AS estimate FROM (
SELECT p, count(*) AS n FROM triples WHERE s IS NOT NULL AND p IN (100, 101, 104, 117) AND o IS NOT NULL GROUP BY p) GROUP BY p""")
def cardinality_estimates(spark, d):
    """The explicit estimates of four patterns, found in one pass."""
    e = Engine(triples(spark, d))
    atoms = [Atom("?s", p, "?o") for p in (100, 101, 104, 117)]
    found = e.cardinality(atoms, implicit=False)
    return spark.createDataFrame([(a.p, x.explicit) for a, x in zip(atoms, found) if x.explicit], "p bigint, estimate bigint")


_DICT = "(SELECT id, min(text) AS text FROM dictionary WHERE id IS NOT NULL AND text IS NOT NULL GROUP BY id)"


@query(f"""SELECT t.s, a.text AS p, b.text AS o FROM {_T} t LEFT JOIN {_DICT} a ON a.id = t.p LEFT JOIN {_DICT} b ON b.id = t.o
WHERE t.p IN (101, 108)""")
def dictionary_decode(spark, d):
    return decode(scan(triples(spark, d), p=[101, 108]), table(spark, d, "dictionary"), ["p", "o"])


@query(f"SELECT DISTINCT right(b.text, 20) AS o FROM {_T} t JOIN {_DICT} b ON b.id = t.o WHERE t.p = 101")
def dictionary_decode_tail(spark, d):
    """Texts cut to their last 20 characters, as a client shows them."""
    rows = decode(scan(triples(spark, d), p=101).select("o"), table(spark, d, "dictionary"), ["o"], tail=20)
    return rows.where("o IS NOT NULL").distinct()


@query(f"SELECT s, p, o FROM {_T}")
def store_round_trip(spark, d):
    """Written to the clustered store and read back."""
    path = Workspace(spark, "store").root
    write_store(triples(spark, d), path)
    return read_store(spark, path)


@query(f"SELECT s, p, o FROM {_T}")
def store_compacted(spark, d):
    """Stored in two inserts, rewritten in order and read back from the copy by object."""
    path = Workspace(spark, "store").root
    t = triples(spark, d)
    write_store(t.where("p < 110"), path)
    insert(spark, path, t)
    compact(spark, path)
    return read_store(spark, path, "pos")


@query("""SELECT DISTINCT subset_name AS subset, s, p, o FROM schema_triples WHERE subset_name IN ('rdfs-domain', 'rdfs-range', 'owl-inverse', 'owl-type-class')
AND s IS NOT NULL AND o IS NOT NULL""")
def schema_subsets(spark, d):
    """The named subsets of a closed schema, written to their folders and some of them read back."""
    path = Workspace(spark, "subsets").root
    names = ["rdfs-domain", "rdfs-range", "owl-inverse", "owl-type-class"]
    write_subsets(_closed(spark, d, [], *names, "owl-symmetric-properties").closed, path)
    return read_subsets(spark, path, *names).select("subset", "s", "p", "o")


@query(f"SELECT s, p, o FROM {_T} WHERE o = 207")
def store_scan_object(spark, d):
    """A scan by object, from the copy in object order."""
    path = Workspace(spark, "store").root
    write_store(triples(spark, d), path)
    return scan_store(spark, path, o=207)


@query(f"SELECT p, count(*) AS n FROM {_T} GROUP BY p")
def insert_delta(spark, d):
    """What was delivered by 2024-03-02 is stored, the rest and some of it again is inserted."""
    path = Workspace(spark, "store").root
    t = triples(spark, d)
    early = F.coalesce(F.col("loaded_at") < "2024-03-02", F.lit(False))
    write_store(t.where(early), path)
    insert(spark, path, t.where(~early | (F.col("p") == 104)))
    return read_store(spark, path).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


_WHOLE = "WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL"


@query(f"SELECT s, p, o FROM triples {_WHOLE}")
def triple_files(spark, d):
    """Written as binary triple files in object order and read back; repeated rows stay."""
    path = Workspace(spark, "files").root
    files.write_triple_files(triples(spark, d), path, "pos")
    return files.read_triple_files(spark, path, "pos").select("s", "p", "o")


@query(f"SELECT s AS first_term, p AS second_term, o AS third_term FROM triples {_WHOLE} ORDER BY s, p, o LIMIT 1")
def first_of_files(spark, d):
    """The first records of sorted triple files; the least of them is the least of all."""
    path = Workspace(spark, "files").root
    t = complete(triples(spark, d))
    files.write_triple_files(t.repartitionByRange("s", "p", "o").sortWithinPartitions("s", "p", "o"), path)
    return files.first_elements(spark, path).drop("src_file").orderBy("first_term", "second_term", "third_term").limit(1)


@query("SELECT DISTINCT head, CAST(n - 1 AS INT) AS list_id, pos, el FROM (SELECT *, dense_rank() OVER (PARTITION BY head ORDER BY list_id) AS n FROM (SELECT head, list_id, CAST(row_number() OVER (PARTITION BY head, list_id ORDER BY pos, el) - 1 AS INT) AS pos, el FROM (SELECT DISTINCT head, list_id, pos, el FROM lists WHERE head IS NOT NULL AND list_id IS NOT NULL AND pos IS NOT NULL AND el IS NOT NULL)))")
def list_files(spark, d):
    """Lists written to a list file and read back; lists of a head and their elements are numbered anew."""
    path = Workspace(spark, "files").root
    files.write_list_file(table(spark, d, "lists"), path)
    return files.read_list_file(spark, path)


@query(f"SELECT id, text, true AS sorted FROM {_DICT}")
def dictionary_files(spark, d):
    """The dictionary written as index and texts, checked and read back."""
    path = Workspace(spark, "files").root
    files.write_dictionary_files(table(spark, d, "dictionary"), path)
    return files.read_dictionary_files(spark, path).withColumn("sorted", F.lit(files.check_dictionary_sorted(spark, path)))


@query(f"SELECT DISTINCT a.s, 700 AS p, b.o FROM {_T} a JOIN {_T} b ON a.o = b.s WHERE a.p = 101 AND b.p = 104")
def rule_file(spark, d):
    """Rules read from a rule file: two properties in a row make a third."""
    text = "3\t(?a 700 ?c) :- (?p 4 701)@[rdfs-subproperties],(?q 4 702)@[rdfs-subproperties]@@(?a ?p ?b),(?b ?q ?c)\n"
    profile = R.Profile("own", R.parse_rule_file(text))
    return Engine(triples(spark, d), X.statements(spark, [(101, 4, 701), (104, 4, 702)]), profile=profile).pattern(None, 700, None)


# Basic graph patterns

_ORDER, _PART, _SUPP, _CUST, _NATION, _REGION = (f"{i}000000000000" for i in (6, 5, 4, 3, 2, 1))


@query(f"""SELECT DISTINCT a.s AS x, a.o AS y, b.o AS z FROM {_T} a JOIN {_T} b ON a.o = b.s
WHERE a.p = 101 AND b.p = 104""")
def bgp_path(spark, d):
    return Engine(triples(spark, d)).bgp([Atom("?x", 101, "?y"), Atom("?y", 104, "?z")], reason=False)


@query("""SELECT DISTINCT o_orderkey AS "order", o_custkey AS customer, l_partkey AS part FROM orders JOIN lineitem ON l_orderkey = o_orderkey
JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'""")
def bgp_star(spark, d):
    """Orders with their customer and parts, for customers of a segment."""
    g = X.graph(spark, d, [X.PLACED_BY, X.CONTAINS, X.SEGMENT])
    building = X.literals(spark, d, X.SEGMENT).where("text = 'BUILDING'").select("id")
    e = Engine(g, once=True)
    ids = [r["id"] for r in building.collect()]
    out = e.bgp(
        [Atom("?o", X.PLACED_BY, "?c"), Atom("?o", X.CONTAINS, "?p"), Atom("?c", X.SEGMENT, "?seg")],
        reason=False, sets={"?seg": ids},
    )
    return out.select(X.key_of("o").alias("order"), X.key_of("c").alias("customer"), X.key_of("p").alias("part"))


_TRIANGLE = """SELECT DISTINCT a.l_orderkey AS "order", a.l_partkey AS part, b.l_suppkey AS supplier
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey
JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) c ON c.l_suppkey = b.l_suppkey AND c.l_partkey = a.l_partkey"""


@query(_TRIANGLE)
def bgp_triangle(spark, d):
    g = X.graph(spark, d, [X.CONTAINS, X.SUPPLIED_BY, X.SUPPLIES])
    out = Engine(g, once=True).bgp(
        [Atom("?o", X.CONTAINS, "?p"), Atom("?o", X.SUPPLIED_BY, "?s"), Atom("?s", X.SUPPLIES, "?p")], reason=False
    )
    return out.select(X.key_of("o").alias("order"), X.key_of("p").alias("part"), X.key_of("s").alias("supplier"))


@query("""SELECT DISTINCT s_suppkey AS supplier, c_custkey AS customer, s_nationkey AS nation FROM supplier JOIN customer ON s_nationkey = c_nationkey
JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey AND l_suppkey = s_suppkey""")
def bgp_multi_key(spark, d):
    """Customers supplied from their own nation: the last join is on two variables."""
    g = X.graph(spark, d, [X.LOCATED_IN, X.PLACED_BY, X.SUPPLIED_BY])
    out = Engine(g, once=True).bgp(
        [
            Atom("?o", X.PLACED_BY, "?c"),
            Atom("?o", X.SUPPLIED_BY, "?s"),
            Atom("?c", X.LOCATED_IN, "?n"),
            Atom("?s", X.LOCATED_IN, "?n"),
        ],
        reason=False,
    )
    return out.select(X.key_of("s").alias("supplier"), X.key_of("c").alias("customer"), X.key_of("n").alias("nation")).distinct()


@query(f"""SELECT DISTINCT a.o AS x, b.o AS y FROM {_T} a JOIN {_T} b ON a.s = b.s AND a.o <> b.o WHERE a.p = 127 AND b.p = 127""")
def bgp_filter_ne(spark, d):
    return Engine(triples(spark, d)).bgp([Atom("?s", 127, "?x"), Atom("?s", 127, "?y")], reason=False).where("x <> y").select("x", "y").distinct()


@query(f"SELECT DISTINCT b.o AS z FROM {_T} a JOIN {_T} b ON a.o = b.s WHERE a.p = 101 AND b.p = 104")
def bgp_distinct(spark, d):
    return bgp_path(spark, d).select("z").distinct()


@query("SELECT DISTINCT o_custkey AS x FROM orders")
def bgp_repeat_var(spark, d):
    """A variable twice in one pattern: statements whose ends are equal."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("s"), F.lit(500).cast("bigint").alias("p"), F.col("o_custkey").alias("o"))
    other = table(spark, d, "customer").select(F.col("c_custkey").alias("s"), F.lit(500).cast("bigint").alias("p"), (F.col("c_custkey") + 1).alias("o"))
    return Engine(rows.unionByName(other)).bgp([Atom("?x", 500, "?x")], reason=False).select("x")


@query("SELECT CAST(NULL AS BIGINT) AS x WHERE false")
def bgp_empty_const(spark, d):
    """A constant that nothing has."""
    e = Engine(triples(spark, d), dictionary=table(spark, d, "dictionary"))
    return e.sparql('SELECT ?x WHERE { ?x <http://nowhere.example/p> "nothing" }', reason=False)


# The schema

_SUB = "(SELECT DISTINCT s, o FROM schema_triples WHERE subset_name = '{}' AND s IS NOT NULL AND o IS NOT NULL)"


def _closed(spark, d, rules: list[str], *subsets: str) -> TBox:
    return TBox(schema(spark, d, *subsets), R.OWL2RL_SPEC.only(*rules))


@query("WITH RECURSIVE e AS " + _SUB.format("rdfs-subclasses") + ", r(s, o) AS (SELECT s, o FROM e UNION SELECT r.s, e.o FROM r JOIN e ON r.o = e.s) SELECT * FROM r")
def tbox_subclass_closure(spark, d):
    return _closed(spark, d, ["scm-sco"], "rdfs-subclasses").closed.select("s", "o")


@query("WITH RECURSIVE e AS " + _SUB.format("rdfs-subproperties") + ", r(s, o) AS (SELECT s, o FROM e UNION SELECT r.s, e.o FROM r JOIN e ON r.o = e.s) SELECT * FROM r")
def tbox_subprop_closure(spark, d):
    return _closed(spark, d, ["scm-spo"], "rdfs-subproperties").closed.select("s", "o")


@query("WITH RECURSIVE e AS " + _SUB.format("rdfs-subclasses") + """, r(s, o) AS (SELECT s, o FROM e UNION SELECT r.s, e.o FROM r JOIN e ON r.o = e.s)
SELECT a.s, a.o FROM r a JOIN r b ON a.s = b.o AND a.o = b.s""")
def tbox_equiv_class(spark, d):
    """Classes that are below each other are equivalent."""
    return subset(_closed(spark, d, ["scm-sco", "scm-eqc2"], "rdfs-subclasses").closed, "owl-equivalence-classes").select("s", "o")


@query("WITH RECURSIVE e AS " + _SUB.format("rdfs-subproperties") + """, r(s, o) AS (SELECT s, o FROM e UNION SELECT r.s, e.o FROM r JOIN e ON r.o = e.s)
SELECT a.s, a.o FROM r a JOIN r b ON a.s = b.o AND a.o = b.s""")
def tbox_equiv_prop(spark, d):
    return subset(_closed(spark, d, ["scm-spo", "scm-eqp2"], "rdfs-subproperties").closed, "owl-equivalence-properties").select("s", "o")


_DOMRNG = "WITH RECURSIVE e AS " + _SUB.format("rdfs-subclasses") + ", c(s, o) AS (SELECT s, o FROM e UNION SELECT c.s, e.o FROM c JOIN e ON c.o = e.s), f AS " + _SUB.format("rdfs-subproperties") + """,
q(s, o) AS (SELECT s, o FROM f UNION SELECT q.s, f.o FROM q JOIN f ON q.o = f.s), d AS (
  SELECT DISTINCT p, s, o FROM schema_triples WHERE subset_name IN ('rdfs-domain', 'rdfs-range') AND s IS NOT NULL AND o IS NOT NULL
), low AS (SELECT p, s, o FROM d UNION SELECT d.p, q.s, d.o FROM d JOIN q ON q.o = d.s)
SELECT p, s, o FROM low UNION SELECT low.p, low.s, c.o FROM low JOIN c ON c.s = low.o"""


@query(_DOMRNG)
def tbox_dom_rng(spark, d):
    """Domains and ranges hold for sub-properties and super-classes."""
    names = ["scm-sco", "scm-spo", "scm-dom1", "scm-dom2", "scm-rng1", "scm-rng2"]
    t = _closed(spark, d, names, "rdfs-subclasses", "rdfs-subproperties", "rdfs-domain", "rdfs-range")
    return t.closed.where(F.col("p").isin(T.DOMAIN, T.RANGE)).select("p", "s", "o")


@query("""SELECT s, 5 AS p, s AS o FROM {c} UNION SELECT s, 5, 34 FROM {c} UNION SELECT 39, 5, s FROM {c} UNION SELECT s, 13, s FROM {c}
UNION SELECT 39, 5, 34""".format(c="(SELECT DISTINCT s FROM schema_triples WHERE subset_name = 'owl-type-class' AND s IS NOT NULL)"))
def tbox_classes(spark, d):
    """Every class is below itself and Thing, above Nothing, and equivalent to itself."""
    names = ["scm-cls-thing", "scm-cls-self", "scm-cls-nothing", "scm-cls-eq", "scm-sco"]
    t = _closed(spark, d, names, "owl-type-class")
    return t.closed.where(F.col("p").isin(T.SUB_CLASS_OF, T.EQUIVALENT_CLASS)).select("s", "p", "o")


@query("""SELECT DISTINCT head AS s, el AS o FROM lists WHERE head IS NOT NULL AND el IS NOT NULL""")
def tbox_lists(spark, d):
    """Each list is an intersection here: its class is below every element."""
    lists = table(spark, d, "lists")
    heads = lists.select("head").where("head IS NOT NULL").distinct()
    stated = heads.select(F.col("head").alias("s"), F.lit(T.INTERSECTION_OF).cast("bigint").alias("p"), F.col("head").alias("o"))
    t = TBox(stated, R.OWL2RL_SPEC.only("scm-int"), lists)
    return t.closed.where(F.col("p") == T.SUB_CLASS_OF).select("s", "o")


@query("""WITH l AS (SELECT DISTINCT head, list_id, pos, el FROM lists WHERE head IS NOT NULL AND list_id IS NOT NULL AND el IS NOT NULL AND pos IS NOT NULL),
k AS (SELECT head, list_id, row_number() OVER (PARTITION BY head, list_id ORDER BY pos, el) - 1 AS pos, el FROM l)
SELECT head, list_id, CAST(pos AS INT) AS pos, el FROM k""")
def list_assembly(spark, d):
    """Lists written as first and rest statements, and put together again: every list of every head."""
    from pyspark.sql import Window

    rows = table(spark, d, "lists").select("head", "list_id", "pos", "el").na.drop().distinct()
    # each list has a first cell of its own, as a head can have several
    rows = Workspace(spark, "list_cells").save(rows.withColumn("cell", F.lit(1 << 62) + F.monotonically_increasing_id()), "cells")
    w = Window.partitionBy("head", "list_id").orderBy("pos", "el")
    cells = rows.select("cell", "el", F.coalesce(F.lead("cell").over(w), F.lit(T.NIL)).alias("next"))
    first = cells.select(F.col("cell").alias("s"), F.lit(T.FIRST).cast("bigint").alias("p"), F.col("el").alias("o"))
    rest = cells.select(F.col("cell").alias("s"), F.lit(T.REST).cast("bigint").alias("p"), F.col("next").alias("o"))
    out = assemble_lists(first.unionByName(rest)).select(F.col("head").alias("cell"), "pos", "el")
    return out.join(rows.select("cell", "head", "list_id"), "cell").select("head", "list_id", "pos", "el")


# (class or property ids of the small schemas below are free ones from 300 on)


@query("""SELECT * FROM (VALUES (300, 301), (303, 302), (304, 305), (307, 306), (308, 309)) t(s, o)""")
def tbox_restrictions(spark, d):
    """Restrictions order classes by their values and properties."""
    tbox = [
        (300, T.HAS_VALUE, 50), (300, T.ON_PROPERTY, 400), (301, T.HAS_VALUE, 50), (301, T.ON_PROPERTY, 401),
        (302, T.ALL_VALUES_FROM, 320), (302, T.ON_PROPERTY, 400), (303, T.ALL_VALUES_FROM, 320), (303, T.ON_PROPERTY, 401),
        (304, T.SOME_VALUES_FROM, 321), (304, T.ON_PROPERTY, 400), (305, T.SOME_VALUES_FROM, 321), (305, T.ON_PROPERTY, 401),
        (306, T.ALL_VALUES_FROM, 323), (306, T.ON_PROPERTY, 402), (307, T.ALL_VALUES_FROM, 322), (307, T.ON_PROPERTY, 402),
        (308, T.SOME_VALUES_FROM, 322), (308, T.ON_PROPERTY, 403), (309, T.SOME_VALUES_FROM, 323), (309, T.ON_PROPERTY, 403),
        (400, T.SUB_PROPERTY_OF, 401), (322, T.SUB_CLASS_OF, 323),
    ]
    names = ["scm-hv", "scm-svf1", "scm-svf2", "scm-avf1", "scm-avf2"]
    t = TBox(X.statements(spark, tbox), R.OWL2RL_SPEC.only(*names))
    return t.closure.derived.select("s", "o")


# Rules on instances


def _conclude(spark, d, tbox, goal, properties=(), classes=(), extra=None, rules=None, lists=None, derived=False) -> DataFrame:
    """The statements that fit a goal, stated or (``derived``) only concluded, under a small schema."""
    parts = [X.graph(spark, d, properties, classes)] if properties or classes else []
    parts += [extra] if extra is not None else []
    g = reduce(DataFrame.unionByName, parts)
    profile = R.OWL2RL_SPEC.only(*rules) if rules else R.OWL2RL_SPEC
    made = None if lists is None else spark.createDataFrame(lists, "head bigint, list_id int, pos int, el bigint")
    e = Engine(g, X.statements(spark, tbox), made, profile=profile, once=extra is None)
    return e.pattern(*goal, exclude_explicit=derived)


def _keys(df: DataFrame, **columns: str) -> DataFrame:
    return df.select(*[X.key_of(c).alias(n) for n, c in columns.items()])


def _with_tags(df: DataFrame, column: str, alias: str) -> DataFrame:
    return df.select(F.floor(F.col(column) / X.TAG).cast("bigint").alias("tag"), X.key_of(column).alias(alias))


@query("SELECT 3 AS tag, c_custkey AS key FROM customer UNION ALL SELECT 4, s_suppkey FROM supplier")
def cax_sco(spark, d):
    """Members of a class at the top of a hierarchy of three levels."""
    tbox = [(X.C_CUSTOMER, T.SUB_CLASS_OF, X.C_PARTY), (X.C_SUPPLIER, T.SUB_CLASS_OF, X.C_PARTY), (X.C_PARTY, T.SUB_CLASS_OF, X.C_AGENT)]
    out = _conclude(spark, d, tbox, (None, T.TYPE, X.C_AGENT), classes=[X.C_CUSTOMER, X.C_SUPPLIER])
    return _with_tags(out, "s", "key")


@query("SELECT 3 AS tag, c_custkey AS key FROM customer UNION ALL SELECT 4, s_suppkey FROM supplier")
def cax_eqc(spark, d):
    """Members of classes equivalent, directly or in turn, to a class without any."""
    tbox = [(X.C_PARTY, T.EQUIVALENT_CLASS, X.C_CUSTOMER), (X.C_SUPPLIER, T.EQUIVALENT_CLASS, X.C_PARTY)]
    out = _conclude(spark, d, tbox, (None, T.TYPE, X.C_PARTY), classes=[X.C_CUSTOMER, X.C_SUPPLIER])
    return _with_tags(out, "s", "key")


@query("""SELECT o_orderkey AS "order", 3 AS tag, o_custkey AS key FROM orders
UNION ALL SELECT DISTINCT l_orderkey, 4, l_suppkey FROM lineitem""")
def prp_spo1(spark, d):
    tbox = [(X.PLACED_BY, T.SUB_PROPERTY_OF, X.INVOLVES), (X.SUPPLIED_BY, T.SUB_PROPERTY_OF, X.INVOLVES)]
    out = _conclude(spark, d, tbox, (None, X.INVOLVES, None), [X.PLACED_BY, X.SUPPLIED_BY])
    return out.select(X.key_of("s").alias("order"), F.floor(F.col("o") / X.TAG).cast("bigint").alias("tag"), X.key_of("o").alias("key"))


@query(f"SELECT DISTINCT s, o FROM {_T} WHERE p IN (100, 101, 117)")
def prp_spo1_store(spark, d):
    """Two levels of super-properties over the stored triples."""
    tbox = [(101, T.SUB_PROPERTY_OF, 900), (117, T.SUB_PROPERTY_OF, 900), (900, T.SUB_PROPERTY_OF, 901), (100, T.SUB_PROPERTY_OF, 901)]
    return Engine(triples(spark, d), X.statements(spark, tbox)).pattern(None, 901, None).select("s", "o")


@query("SELECT DISTINCT o_orderkey AS key FROM orders")
def prp_dom(spark, d):
    tbox = [(X.PLACED_BY, T.DOMAIN, X.C_ORDER), (X.PLACED_BY, T.RANGE, X.C_CUSTOMER)]
    return _keys(_conclude(spark, d, tbox, (None, T.TYPE, X.C_ORDER), [X.PLACED_BY]), key="s")


@query("SELECT DISTINCT o_custkey AS key FROM orders")
def prp_rng(spark, d):
    tbox = [(X.PLACED_BY, T.DOMAIN, X.C_ORDER), (X.PLACED_BY, T.RANGE, X.C_CUSTOMER)]
    return _keys(_conclude(spark, d, tbox, (None, T.TYPE, X.C_CUSTOMER), [X.PLACED_BY]), key="s")


@query('SELECT o_custkey AS customer, o_orderkey AS "order" FROM orders')
def prp_inv(spark, d):
    out = _conclude(spark, d, [(X.PLACES, T.INVERSE_OF, X.PLACED_BY)], (None, X.PLACES, None), [X.PLACED_BY])
    return out.select(X.key_of("s").alias("customer"), X.key_of("o").alias("order"))


@query("SELECT DISTINCT l_partkey AS part, l_orderkey AS \"order\" FROM lineitem")
def prp_inv_other(spark, d):
    """The inverse stated the other way round."""
    out = _conclude(spark, d, [(X.CONTAINS, T.INVERSE_OF, X.CONTAINED_IN)], (None, X.CONTAINED_IN, None), [X.CONTAINS])
    return out.select(X.key_of("s").alias("part"), X.key_of("o").alias("order"))


_NEIGHBOUR = """SELECT CAST(a.n_nationkey AS BIGINT) AS x, CAST(min(b.n_nationkey) AS BIGINT) AS y FROM nation a
JOIN nation b ON b.n_nationkey > a.n_nationkey AND a.n_regionkey = b.n_regionkey GROUP BY a.n_nationkey"""


@query(f"WITH n AS ({_NEIGHBOUR}) SELECT x, y FROM n UNION SELECT y, x FROM n")
def prp_symp(spark, d):
    out = _conclude(spark, d, [(X.NEIGHBOUR_OF, T.TYPE, T.SYMMETRIC)], (None, X.NEIGHBOUR_OF, None), [X.NEIGHBOUR_OF])
    return _keys(out, x="s", y="o")


@query("SELECT DISTINCT l_suppkey AS supplier, l_partkey AS part FROM lineitem")
def prp_eqp(spark, d):
    out = _conclude(spark, d, [(410, T.EQUIVALENT_PROPERTY, X.SUPPLIES)], (None, 410, None), [X.SUPPLIES])
    return _keys(out, supplier="s", part="o")


def _literal(spark, d, prop: int, text: str) -> int:
    return X.literals(spark, d, prop).where(F.col("text") == text).first()["id"]


@query("SELECT c_custkey AS key FROM customer WHERE c_mktsegment = 'BUILDING'")
def cls_hv1(spark, d):
    """Members of a has-value class have the value."""
    v = _literal(spark, d, X.SEGMENT, "BUILDING")
    customers = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(X.entity(X.CUSTOMER, "c_custkey"))
    tbox = [(300, T.HAS_VALUE, v), (300, T.ON_PROPERTY, X.SEGMENT)]
    return _keys(_conclude(spark, d, tbox, (None, X.SEGMENT, v), extra=X.typed(customers, 300)), key="s")


@query("SELECT c_custkey AS key FROM customer WHERE c_mktsegment = 'BUILDING'")
def cls_hv2(spark, d):
    """Whatever has the value is a member."""
    tbox = [(300, T.HAS_VALUE, _literal(spark, d, X.SEGMENT, "BUILDING")), (300, T.ON_PROPERTY, X.SEGMENT)]
    return _keys(_conclude(spark, d, tbox, (None, T.TYPE, 300), [X.SEGMENT]), key="s")


@query("SELECT DISTINCT l_orderkey AS key FROM lineitem")
def cls_svf2(spark, d):
    tbox = [(300, T.SOME_VALUES_FROM, T.THING), (300, T.ON_PROPERTY, X.SUPPLIED_BY)]
    return _keys(_conclude(spark, d, tbox, (None, T.TYPE, 300), [X.SUPPLIED_BY]), key="s")


@query("""SELECT c_custkey AS key, 2 AS tag, CAST(c_nationkey AS BIGINT) AS place FROM customer
UNION ALL SELECT c_custkey, 1, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def prp_trp(spark, d):
    """Where customers are, in a transitive property."""
    out = _conclude(spark, d, [(X.LOCATED_IN, T.TYPE, T.TRANSITIVE)], (None, X.LOCATED_IN, None), [X.LOCATED_IN])
    out = out.where((F.col("s") >= X.CUSTOMER * X.TAG) & (F.col("s") < X.SUPPLIER * X.TAG))
    return out.select(X.key_of("s").alias("key"), F.floor(F.col("o") / X.TAG).cast("bigint").alias("tag"), X.key_of("o").alias("place"))


@query("""WITH RECURSIVE l AS (SELECT DISTINCT subset_name, s, o FROM schema_triples WHERE subset_name = 'rdfs-subclasses' AND s IS NOT NULL AND o IS NOT NULL),
r(o) AS (SELECT o FROM l WHERE s = (SELECT min(s) FROM l) UNION SELECT l.o FROM r JOIN l ON l.s = r.o) SELECT (SELECT min(s) FROM l) AS s, o FROM r""")
def prp_trp_bound(spark, d):
    """What one node leads to in a transitive property: followed from there."""
    rows = schema(spark, d, "rdfs-subclasses").select("s", F.lit(950).cast("bigint").alias("p"), "o")
    first = rows.na.drop().agg(F.min("s")).first()[0]
    return Engine(rows, X.statements(spark, [(950, T.TYPE, T.TRANSITIVE)])).pattern(first, 950, None).select("s", "o")


@query("""SELECT c_custkey AS key FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2""")
def prp_trp_bound_object(spark, d):
    """What leads to one node in a transitive property."""
    out = _conclude(spark, d, [(X.LOCATED_IN, T.TYPE, T.TRANSITIVE)], (None, X.LOCATED_IN, X.REGION * X.TAG + 2), [X.LOCATED_IN])
    out = out.where((F.col("s") >= X.CUSTOMER * X.TAG) & (F.col("s") < X.SUPPLIER * X.TAG))
    return _keys(out, key="s")


@query("""SELECT DISTINCT o_orderkey AS "order", n_regionkey + 1000000000000 AS region FROM orders JOIN customer ON c_custkey = o_custkey
JOIN nation ON n_nationkey = c_nationkey WHERE o_orderpriority = '1-URGENT'""")
def bgp_sideways(spark, d):
    """A transitive property that is followed only from what the other patterns leave."""
    e = Engine(X.graph(spark, d, [X.LOCATED_IN, X.PLACED_BY, X.PRIORITY]), X.statements(spark, [(X.LOCATED_IN, T.TYPE, T.TRANSITIVE)]))
    urgent = _literal(spark, d, X.PRIORITY, "1-URGENT")
    out = e.bgp([Atom("?o", X.PRIORITY, urgent), Atom("?o", X.PLACED_BY, "?c"), Atom("?c", X.LOCATED_IN, "?r")])
    return out.where(F.col("r") < X.NATION * X.TAG).select(X.key_of("o").alias("order"), F.col("r").alias("region"))


@query("SELECT c_custkey AS key FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2")
def schema_of_instances(spark, d):
    """A class whose members are transitive makes its member, a property, transitive."""
    tbox = [(300, T.SUB_CLASS_OF, T.TRANSITIVE), (X.LOCATED_IN, T.TYPE, 300)]
    e = Engine(X.graph(spark, d, [X.LOCATED_IN]).unionByName(X.statements(spark, tbox)))
    out = e.pattern(None, X.LOCATED_IN, X.REGION * X.TAG + 2)
    return _keys(out.where((F.col("s") >= X.CUSTOMER * X.TAG) & (F.col("s") < X.SUPPLIER * X.TAG)), key="s")


@query("SELECT 3 AS tag, c_custkey AS key FROM customer UNION ALL SELECT 4, s_suppkey FROM supplier")
def schema_by_own_property(spark, d):
    """A property below subClassOf states sub-classes."""
    own = 420
    tbox = [(own, T.SUB_PROPERTY_OF, T.SUB_CLASS_OF), (X.C_CUSTOMER, own, X.C_PARTY), (X.C_SUPPLIER, own, X.C_PARTY), (X.C_PARTY, T.SUB_CLASS_OF, X.C_AGENT)]
    e = Engine(X.graph(spark, d, (), [X.C_CUSTOMER, X.C_SUPPLIER]).unionByName(X.statements(spark, tbox)))
    return _with_tags(e.pattern(None, T.TYPE, X.C_AGENT), "s", "key")


@query(f"SELECT s, p, o, true AS explicit FROM {_T} WHERE p = 101 UNION SELECT s, 900, o, p = 900 FROM {_T} WHERE p = 101")
def tag_explicit(spark, d):
    """Answers with a mark on those that are stated."""
    e = Engine(triples(spark, d), X.statements(spark, [(101, T.SUB_PROPERTY_OF, 900)]))
    return e.pattern(None, [101, 900], None, tag_explicit=True)


def _property_rules(profile, *names: str):
    """The schema that rules on kinds of properties conclude, over the properties of the triples."""

    def run(spark, d):
        kinds = triples(spark, d).select("p").where("p >= 100").distinct().select(
            F.col("p").alias("s"), F.lit(T.TYPE).cast("bigint").alias("p"),
            F.when(F.col("p") % 2 == 0, T.OBJECT_PROPERTY).otherwise(T.DATATYPE_PROPERTY).cast("bigint").alias("o"),
        )
        return TBox(kinds, profile.only(*names)).closure.derived

    return run


_PROPERTIES = "(SELECT DISTINCT p, p % 2 = 0 AS object FROM triples WHERE p >= 100)"


@query(f"SELECT p AS s, 4 AS p, p AS o FROM {_PROPERTIES} WHERE object UNION ALL SELECT p, 14, p FROM {_PROPERTIES} WHERE object")
def scm_op(spark, d):
    """Object properties are below and equivalent to themselves."""
    return _property_rules(R.OWL2RL_SPEC, "scm-op", "scm-op-eq")(spark, d)


@query(f"SELECT p AS s, 4 AS p, p AS o FROM {_PROPERTIES} WHERE NOT object UNION ALL SELECT p, 14, p FROM {_PROPERTIES} WHERE NOT object")
def scm_dp(spark, d):
    """Datatype properties are below and equivalent to themselves."""
    return _property_rules(R.OWL2RL_SPEC, "scm-dp", "scm-dp-eq")(spark, d)


@query("WITH e AS " + "(SELECT DISTINCT s, o FROM schema_triples WHERE subset_name = 'owl-equivalence-classes' AND s IS NOT NULL AND o IS NOT NULL)" + " SELECT s, o FROM e UNION SELECT o, s FROM e")
def scm_eqc1(spark, d):
    """Equivalent classes are below each other."""
    return subset(_closed(spark, d, ["scm-eqc1"], "owl-equivalence-classes").closed, "rdfs-subclasses").select("s", "o")


@query("WITH e AS " + "(SELECT DISTINCT s, o FROM schema_triples WHERE subset_name = 'rdfs-subproperties' AND s IS NOT NULL AND o IS NOT NULL)" + " SELECT s, o FROM e UNION SELECT o, s FROM e")
def scm_eqp1(spark, d):
    """Equivalent properties are below each other."""
    rows = schema(spark, d, "rdfs-subproperties").select("s", F.lit(T.EQUIVALENT_PROPERTY).cast("bigint").alias("p"), "o")
    return subset(TBox(rows, R.OWL2RL_SPEC.only("scm-eqp1")).closed, "rdfs-subproperties").select("s", "o")


@query("WITH RECURSIVE f AS " + _SUB.format("rdfs-subproperties") + """, up(s, o) AS (SELECT s, o FROM f UNION SELECT up.s, f.o FROM up JOIN f ON up.o = f.s),
d AS (SELECT DISTINCT p, s, o FROM schema_triples WHERE subset_name IN ('rdfs-domain', 'rdfs-range') AND s IS NOT NULL AND o IS NOT NULL)
SELECT p, s, o FROM d UNION SELECT d.p, up.o, d.o FROM d JOIN up ON up.s = d.s""")
def asis_dom_rng(spark, d):
    """The rules on domains and ranges as the common rule file has them: up the properties."""
    s = schema(spark, d, "rdfs-subproperties", "rdfs-domain", "rdfs-range")
    closed = TBox(s, R.OWL2RL_ASIS.only("scm-spo", "scm-dom2", "scm-rng2")).closed
    return closed.where(F.col("p").isin(T.DOMAIN, T.RANGE)).select("p", "s", "o")


@query("SELECT c_custkey + 3000000000000 AS s, 0 AS p, c AS o FROM customer, (VALUES (200), (201)) v(c) UNION ALL SELECT o_orderkey + 6000000000000, 106, o_custkey + 3000000000000 FROM orders")
def closure_after(spark, d):
    """The schema closed by one profile, and instances by what it leaves to do."""
    g = X.graph(spark, d, [X.PLACED_BY], [X.C_CUSTOMER])
    return _instances(Engine(g, X.statements(spark, _PARTY_TBOX), after=R.AFTER_CLOSURE).forward())


_SAME_NATION = "SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey"


@query(_SAME_NATION)
def prp_fp(spark, d):
    out = _conclude(spark, d, [(X.LEAD_SUPPLIER, T.TYPE, T.FUNCTIONAL)], (None, T.SAME_AS, None), [X.LEAD_SUPPLIER])
    return _keys(out, x="s", y="o")


@query("SELECT s_suppkey AS x, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS y FROM supplier")
def same_as_groups(spark, d):
    """The same as links to one member of each group, where all pairs would be its square."""
    e = Engine(X.graph(spark, d, [X.LEAD_SUPPLIER]), X.statements(spark, [(X.LEAD_SUPPLIER, T.TYPE, T.FUNCTIONAL)]))
    return _keys(e.same_as_links(), x="s", y="o")


@query(_SAME_NATION)
def prp_ifp(spark, d):
    nations = table(spark, d, "supplier").select(
        X.entity(X.SUPPLIER, "s_suppkey").alias("s"), F.lit(X.LOCATED_IN).cast("bigint").alias("p"), X.entity(X.NATION, "s_nationkey").alias("o")
    )
    out = _conclude(spark, d, [(X.LOCATED_IN, T.TYPE, T.INVERSE_FUNCTIONAL)], (None, T.SAME_AS, None), extra=nations)
    return _keys(out, x="s", y="o")


@query("SELECT DISTINCT l_orderkey AS key FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = 3")
def cls_svf1(spark, d):
    some = table(spark, d, "supplier").where("s_nationkey = 3").select(X.entity(X.SUPPLIER, "s_suppkey"))
    tbox = [(300, T.SOME_VALUES_FROM, 320), (300, T.ON_PROPERTY, X.SUPPLIED_BY)]
    return _keys(_conclude(spark, d, tbox, (None, T.TYPE, 300), [X.SUPPLIED_BY], extra=X.typed(some, 320)), key="s")


@query("SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderpriority = '1-URGENT'")
def cls_avf(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(X.entity(X.ORDER, "o_orderkey"))
    tbox = [(321, T.ALL_VALUES_FROM, 322), (321, T.ON_PROPERTY, X.PLACED_BY)]
    return _keys(_conclude(spark, d, tbox, (None, T.TYPE, 322), [X.PLACED_BY], extra=X.typed(urgent, 321)), key="s")


@query(_SAME_NATION)
def cls_maxc2(spark, d):
    tbox = [(X.C_NATION, T.MAX_CARDINALITY, T.LITERAL_ONE), (X.C_NATION, T.ON_PROPERTY, X.LEAD_SUPPLIER)]
    return _keys(_conclude(spark, d, tbox, (None, T.SAME_AS, None), [X.LEAD_SUPPLIER], [X.C_NATION]), x="s", y="o")


@query(_SAME_NATION)
def cls_maxqc4(spark, d):
    tbox = [(X.C_NATION, T.MAX_QUALIFIED, T.LITERAL_ONE), (X.C_NATION, T.ON_PROPERTY, X.LEAD_SUPPLIER), (X.C_NATION, T.ON_CLASS, T.THING)]
    return _keys(_conclude(spark, d, tbox, (None, T.SAME_AS, None), [X.LEAD_SUPPLIER], [X.C_NATION]), x="s", y="o")


@query(_SAME_NATION + " WHERE a.s_acctbal > 0 AND b.s_acctbal > 0")
def cls_maxqc3(spark, d):
    """Of the suppliers only those in the class count."""
    rich = table(spark, d, "supplier").where("s_acctbal > 0").select(X.entity(X.SUPPLIER, "s_suppkey"))
    tbox = [(X.C_NATION, T.MAX_QUALIFIED, T.LITERAL_ONE), (X.C_NATION, T.ON_PROPERTY, X.LEAD_SUPPLIER), (X.C_NATION, T.ON_CLASS, 320)]
    out = _conclude(spark, d, tbox, (None, T.SAME_AS, None), [X.LEAD_SUPPLIER], [X.C_NATION], extra=X.typed(rich, 320))
    return _keys(out, x="s", y="o")


# Rules on lists


@query('SELECT o_orderkey AS "order", CAST(c_nationkey AS BIGINT) AS nation FROM orders JOIN customer ON c_custkey = o_custkey')
def prp_spo2(spark, d):
    """A property chain of two."""
    tbox = [(X.ORIGIN, T.PROPERTY_CHAIN, 500)]
    lists = [(500, 0, 0, X.PLACED_BY), (500, 0, 1, X.LOCATED_IN)]
    out = _conclude(spark, d, tbox, (None, X.ORIGIN, None), [X.PLACED_BY, X.LOCATED_IN], lists=lists)
    return out.select(X.key_of("s").alias("order"), X.key_of("o").alias("nation"))


@query('SELECT o_orderkey AS "order", CAST(n_regionkey AS BIGINT) AS region FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey')
def prp_spo2_long(spark, d):
    """A property chain of three."""
    tbox = [(X.ORIGIN, T.PROPERTY_CHAIN, 500)]
    lists = [(500, 0, 0, X.PLACED_BY), (500, 0, 1, X.LOCATED_IN), (500, 0, 2, X.LOCATED_IN)]
    out = _conclude(spark, d, tbox, (None, X.ORIGIN, None), [X.PLACED_BY, X.LOCATED_IN], lists=lists)
    return out.select(X.key_of("s").alias("order"), X.key_of("o").alias("region"))


@query("SELECT a.p_partkey AS x, b.p_partkey AS y FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand")
def prp_key(spark, d):
    lists = [(500, 0, 0, X.BRAND), (500, 0, 1, X.PART_NAME)]
    out = _conclude(spark, d, [(X.C_PART, T.HAS_KEY, 500)], (None, T.SAME_AS, None), [X.BRAND, X.PART_NAME], [X.C_PART], lists=lists)
    return _keys(out, x="s", y="o")


@query("SELECT 3 AS tag, c_custkey AS key FROM customer UNION ALL SELECT 4, s_suppkey FROM supplier")
def cls_uni(spark, d):
    lists = [(500, 0, 0, X.C_CUSTOMER), (500, 0, 1, X.C_SUPPLIER)]
    out = _conclude(spark, d, [(300, T.UNION_OF, 500)], (None, T.TYPE, 300), classes=[X.C_CUSTOMER, X.C_SUPPLIER], rules=["cls-uni"], lists=lists)
    return _with_tags(out, "s", "key")


@query("SELECT 3 AS tag, c_custkey AS key FROM customer UNION ALL SELECT 4, s_suppkey FROM supplier")
def scm_uni(spark, d):
    """The same through the hierarchy that the union implies."""
    lists = [(500, 0, 0, X.C_CUSTOMER), (500, 0, 1, X.C_SUPPLIER)]
    out = _conclude(spark, d, [(300, T.UNION_OF, 500)], (None, T.TYPE, 300), classes=[X.C_CUSTOMER, X.C_SUPPLIER], rules=["scm-uni", "cax-sco"], lists=lists)
    return _with_tags(out, "s", "key")


@query("SELECT CAST(r_regionkey AS BIGINT) AS key FROM region")
def cls_oo(spark, d):
    """A class given by listing its members."""
    regions = [r["r_regionkey"] for r in table(spark, d, "region").select("r_regionkey").collect()]
    lists = [(500, 0, i, X.REGION * X.TAG + k) for i, k in enumerate(sorted(regions))]
    out = _conclude(spark, d, [(300, T.ONE_OF, 500)], (None, T.TYPE, 300), classes=[X.C_NATION], lists=lists)
    return _keys(out, key="s")


_BOTH = "SELECT c_custkey AS key FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3"


def _building_from_3(spark, d) -> list[tuple]:
    return [
        (301, T.HAS_VALUE, _literal(spark, d, X.SEGMENT, "BUILDING")), (301, T.ON_PROPERTY, X.SEGMENT),
        (302, T.HAS_VALUE, X.NATION * X.TAG + 3), (302, T.ON_PROPERTY, X.LOCATED_IN),
        (300, T.INTERSECTION_OF, 500),
    ]


@query(_BOTH)
def cls_int1(spark, d):
    """Members of every class of an intersection are members of it."""
    customers = X.edges(spark, d, X.LOCATED_IN).where((F.col("s") >= X.CUSTOMER * X.TAG) & (F.col("s") < X.SUPPLIER * X.TAG))
    lists = [(500, 0, 0, 301), (500, 0, 1, 302)]
    out = _conclude(spark, d, _building_from_3(spark, d), (None, T.TYPE, 300), [X.SEGMENT], extra=customers, lists=lists)
    return _keys(out, key="s")


def _typed_both(spark, d) -> DataFrame:
    some = table(spark, d, "customer").where("c_mktsegment = 'BUILDING' AND c_nationkey = 3").select(X.entity(X.CUSTOMER, "c_custkey"))
    return X.typed(some, 300)


@query(f"SELECT key, 301 AS class FROM ({_BOTH}) UNION ALL SELECT key, 302 FROM ({_BOTH})")
def cls_int2(spark, d):
    """Members of an intersection are members of every class of it."""
    lists = [(500, 0, 0, 301), (500, 0, 1, 302)]
    out = _conclude(spark, d, [(300, T.INTERSECTION_OF, 500)], (None, T.TYPE, None), extra=_typed_both(spark, d), rules=["cls-int2"], lists=lists, derived=True)
    return out.select(X.key_of("s").alias("key"), F.col("o").alias("class"))


@query(f"SELECT key, 301 AS class FROM ({_BOTH}) UNION ALL SELECT key, 302 FROM ({_BOTH})")
def scm_int(spark, d):
    lists = [(500, 0, 0, 301), (500, 0, 1, 302)]
    out = _conclude(spark, d, [(300, T.INTERSECTION_OF, 500)], (None, T.TYPE, None), extra=_typed_both(spark, d), rules=["scm-int", "cax-sco"], lists=lists, derived=True)
    return out.select(X.key_of("s").alias("key"), F.col("o").alias("class"))


# The engine as a whole

_PARTY_TBOX = [
    (X.C_CUSTOMER, T.SUB_CLASS_OF, X.C_PARTY), (X.C_SUPPLIER, T.SUB_CLASS_OF, X.C_PARTY), (X.C_PARTY, T.SUB_CLASS_OF, X.C_AGENT),
    (X.PLACED_BY, T.SUB_PROPERTY_OF, X.INVOLVES), (X.SUPPLIED_BY, T.SUB_PROPERTY_OF, X.INVOLVES),
]
_OWL_TBOX = _PARTY_TBOX + [
    (X.PLACED_BY, T.DOMAIN, X.C_ORDER), (X.PLACES, T.INVERSE_OF, X.PLACED_BY), (X.LOCATED_IN, T.TYPE, T.TRANSITIVE),
]

_RDFS_SQL = """SELECT c_custkey + 3000000000000 AS s, 0 AS p, c AS o FROM customer, (VALUES (200), (201)) v(c)
UNION ALL SELECT s_suppkey + 4000000000000, 0, c FROM supplier, (VALUES (200), (201)) v(c)
UNION ALL SELECT o_orderkey + 6000000000000, 106, o_custkey + 3000000000000 FROM orders
UNION ALL SELECT DISTINCT l_orderkey + 6000000000000, 106, l_suppkey + 4000000000000 FROM lineitem
UNION ALL SELECT * FROM (VALUES (202, 5, 200), (203, 5, 200))"""
_OWL_SQL = _RDFS_SQL + """
UNION ALL SELECT DISTINCT o_orderkey + 6000000000000, 0, 205 FROM orders
UNION ALL SELECT o_custkey + 3000000000000, 102, o_orderkey + 6000000000000 FROM orders
UNION ALL SELECT c_custkey + 3000000000000, 100, n_regionkey + 1000000000000 FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT s_suppkey + 4000000000000, 100, n_regionkey + 1000000000000 FROM supplier JOIN nation ON n_nationkey = s_nationkey"""


def _engine(spark, d, tbox, profile=R.OWL2RL_SPEC, properties=(X.PLACED_BY, X.SUPPLIED_BY, X.LOCATED_IN)) -> Engine:
    g = X.graph(spark, d, properties, [X.C_CUSTOMER, X.C_SUPPLIER])
    return Engine(g, X.statements(spark, tbox), profile=profile, once=True)


def _instances(df: DataFrame) -> DataFrame:
    return df.where(F.col("s") >= X.TAG)


@query(_RDFS_SQL)
def closure_rdfs(spark, d):
    """All that follows by the RDFS profile, beyond what is stated."""
    return _engine(spark, d, _PARTY_TBOX, R.RDFS).forward()


@query(_OWL_SQL)
def closure_owl(spark, d):
    """All that follows by the OWL profile."""
    return _engine(spark, d, _OWL_TBOX).forward()


_EXTRA_SQL = "SELECT o_orderkey + 6000000000000 AS s, 106 AS p, o_custkey + 3000000000000 AS o FROM orders UNION ALL SELECT DISTINCT l_orderkey + 6000000000000, 106, l_suppkey + 4000000000000 FROM lineitem"


@query(_EXTRA_SQL)
def explicit_excluded(spark, d):
    """Only what is concluded of a goal."""
    return _engine(spark, d, _OWL_TBOX).pattern(None, X.INVOLVES, None, exclude_explicit=True)


@query("SELECT goal, 0 AS differences FROM (VALUES ('agents'), ('involves'), ('located'), ('places')) t(goal)")
def backward_eq_forward(spark, d):
    """How many answers differ between deriving for a goal and deriving ahead: none."""
    e = _engine(spark, d, _OWL_TBOX)
    out = None
    goals = {"agents": (None, T.TYPE, X.C_AGENT), "involves": (None, X.INVOLVES, None), "located": (None, X.LOCATED_IN, None), "places": (None, X.PLACES, None)}
    for name, goal in goals.items():
        a, b = e.pattern(*goal), e.pattern(*goal, ahead=True)
        both = a.select("s", "p", "o", F.lit(1).alias("k")).unionByName(b.select("s", "p", "o", F.lit(2).alias("k")))
        odd = both.groupBy("s", "p", "o").agg(F.sum("k").alias("k")).where("k <> 3")
        part = odd.agg(F.count(F.lit(1)).alias("differences")).select(F.lit(name).alias("goal"), "differences")
        out = part if out is None else out.unionByName(part)
    return out


_IRI = "http://shop.example/schema#"
_TEXTS = {
    X.PLACED_BY: "placedBy", X.SUPPLIED_BY: "suppliedBy", X.INVOLVES: "involves", X.LOCATED_IN: "locatedIn", X.CONTAINS: "contains",
    X.SUPPLIES: "supplies", X.C_AGENT: "Agent", X.C_PARTY: "Party", X.C_CUSTOMER: "Customer", X.C_SUPPLIER: "Supplier", X.SEGMENT: "segment",
}


def _shop(spark, d, properties, classes=(X.C_CUSTOMER, X.C_SUPPLIER)) -> Engine:
    g = X.graph(spark, d, properties, classes)
    texts = spark.createDataFrame([(i, f"<{_IRI}{n}>") for i, n in _TEXTS.items()], "id bigint, text string")
    segments = X.literals(spark, d, X.SEGMENT).select("id", F.concat(F.lit('"'), "text", F.lit('"')).alias("text"))
    return Engine(g, X.statements(spark, _PARTY_TBOX), dictionary=texts.unionByName(segments), once=True)


@query("SELECT c_custkey + 3000000000000 AS x FROM customer UNION ALL SELECT s_suppkey + 4000000000000 FROM supplier")
def sparql_lubm6_shape(spark, d):
    """Members of a class, by inference."""
    return _shop(spark, d, [X.LOCATED_IN]).sparql(f"PREFIX s: <{_IRI}> SELECT ?x WHERE {{ ?x a s:Agent . }}")


@query("""SELECT DISTINCT a.l_orderkey + 6000000000000 AS o, b.l_suppkey + 4000000000000 AS y, a.l_partkey + 5000000000000 AS z
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey
JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) c ON c.l_suppkey = b.l_suppkey AND c.l_partkey = a.l_partkey""")
def sparql_lubm2_shape(spark, d):
    """A triangle whose corner has a class."""
    text = f"""PREFIX s: <{_IRI}> SELECT DISTINCT ?o ?y ?z WHERE {{
      ?o s:suppliedBy ?y . ?y a s:Supplier . ?y s:supplies ?z . ?o s:contains ?z }}"""
    return _shop(spark, d, [X.SUPPLIED_BY, X.SUPPLIES, X.CONTAINS], [X.C_SUPPLIER]).sparql(text)


@query("""SELECT DISTINCT o_orderkey + 6000000000000 AS o, o_custkey + 3000000000000 AS x, l_suppkey + 4000000000000 AS y
FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey""")
def sparql_lubm9_shape(spark, d):
    """Two inferred members of an order in one place; the inferred property is used twice."""
    text = f"""PREFIX s: <{_IRI}> SELECT DISTINCT ?o ?x ?y WHERE {{
      ?o s:involves ?x ; s:involves ?y . ?x a s:Customer . ?y a s:Supplier .
      ?x s:locatedIn ?n . ?y s:locatedIn ?n }}"""
    return _shop(spark, d, [X.PLACED_BY, X.SUPPLIED_BY, X.LOCATED_IN]).sparql(text)


@query("""SELECT DISTINCT a.c_custkey + 3000000000000 AS x, CAST(a.c_nationkey AS BIGINT) + 2000000000000 AS n FROM customer a WHERE c_mktsegment = 'BUILDING'
AND EXISTS (SELECT 1 FROM customer b WHERE b.c_nationkey = a.c_nationkey AND b.c_custkey <> a.c_custkey AND b.c_mktsegment = 'MACHINERY')""")
def sparql_filter(spark, d):
    """DISTINCT, literals, a predicate list and a FILTER."""
    text = f"""PREFIX s: <{_IRI}> SELECT distinct ?x ?n WHERE {{
      ?x s:segment "BUILDING" ; s:locatedIn ?n . ?y s:locatedIn ?n ; s:segment 'MACHINERY' . filter(?x != ?y) }}"""
    return _shop(spark, d, [X.SEGMENT, X.LOCATED_IN], [X.C_CUSTOMER]).sparql(text)


@query(f"""SELECT a.s AS x, b.o AS z FROM {_T} a JOIN {_T} b ON a.o = b.s WHERE a.p = 101 AND b.p IN
(SELECT id FROM dictionary WHERE text = (SELECT min(text) FROM dictionary WHERE id = 117))""")
def sparql_store(spark, d):
    """A path over the stored triples, its second property given by its text in the dictionary, whatever that is."""
    text = clean_dictionary(table(spark, d, "dictionary").where("id = 117")).first()
    constants = {"<urn:first>": 101, "<urn:second>": text and text["text"]}
    e = Engine(triples(spark, d), dictionary=table(spark, d, "dictionary"))
    return e.sparql("SELECT ?x ?z WHERE { ?x <urn:first> [ <urn:second> ?z ] }", reason=False, constants=constants)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
