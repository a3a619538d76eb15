"""The schema: its subsets, lists and closure, and the bindings of rules in it."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph import terms as T
from loomgraph.operators.hierarchy import closed_pairs
from loomgraph.operators.scan import bindings, complete, connected_order, name, natural_join
from loomgraph.plans import local
from loomgraph.plans.forward import DRIVER_ROWS, Closure, Compiled, fixpoint, from_rows, is_chain, simplified, strata, with_side
from loomgraph.plans.rules import Atom, Profile, Rule, is_variable, unrolled
from loomgraph.workspace import Workspace


def schema_triples(triples: DataFrame) -> DataFrame:
    """The statements that are schema: they use the reserved vocabulary."""
    return complete(triples).where(
        F.col("p").isin(T.SCHEMA_PREDICATES) | ((F.col("p") == T.TYPE) & F.col("o").isin(T.SCHEMA_CLASSES))
    )


def subset(triples: DataFrame, subset_name: str, symmetric: bool = False) -> DataFrame:
    """The distinct statements of a named subset, with swapped ones if ``symmetric``."""
    p, o = T.SUBSETS[subset_name]
    out = complete(triples).where(F.col("p") == p)
    if o is not None:
        out = out.where(F.col("o") == o)
    if symmetric:
        out = out.union(out.select("o", "p", "s"))
    return out.distinct()


def assemble_lists(triples: DataFrame) -> DataFrame:
    """``(head, list_id, pos, el)`` from ``first`` and ``rest`` statements.

    A head is a cell no other cell goes on to.  One round a position, each a
    written table.  Cells with two firsts or rests, or lists that never end,
    are errors; an unfinished list ends at its last cell.
    """
    spark = triples.sparkSession
    ws = Workspace(spark, "lists")
    t = complete(triples)
    cells = t.where(F.col("p") == T.FIRST).select(F.col("s").alias("cell"), F.col("o").alias("el")).distinct()
    nexts = t.where(F.col("p") == T.REST).select(F.col("s").alias("cell"), F.col("o").alias("next")).distinct()
    cells = ws.save(cells.join(nexts, "cell", "left"), "cells")
    n = cells.count()
    if n != cells.select("cell").distinct().count():
        raise ValueError("a list cell has two firsts or rests")
    heads = cells.join(nexts.select(F.col("next").alias("cell")), "cell", "left_anti")
    level, m = ws.save_counted(heads.select(F.col("cell").alias("head"), F.lit(0).alias("pos"), "el", "next"), "level")
    levels = []
    while m:
        levels.append(level)
        if len(levels) > n:
            raise ValueError("a list runs into a cycle")
        step = (
            level.where(F.col("next").isNotNull() & (F.col("next") != T.NIL))
            .select("head", "pos", F.col("next").alias("cell"))
            .join(cells, "cell")
            .select("head", (F.col("pos") + 1).alias("pos"), "el", "next")
        )
        level, m = ws.save_counted(step, "level")
    if not levels:
        return level.select("head", F.lit(0).alias("list_id"), "pos", "el")
    rows = spark.read.schema(level.schema).parquet(*[x._loomgraph_path for x in levels])
    return rows.select("head", F.lit(0).alias("list_id"), "pos", "el")


#: A schema closed on the driver may grow to so many statements.
DRIVER_CLOSED = 100_000


class TBox:
    """The closed schema.

    Up to ``DRIVER_ROWS`` statements are closed on the driver; more, or ones
    whose closure is large, by the same rules as joins.

    ``statements`` may hold other triples too, only schema is used.  ``lists``
    has ``head, list_id, pos, el``; repeated rows count once, rows with a null
    element are left out, and a head can have several lists.  Without it the
    lists are assembled from the statements where a rule needs them.  With
    ``after`` its rules, not the profile's, are the ones on instances: what
    is concluded once the schema is closed.
    """

    def __init__(self, statements: DataFrame, profile: Profile, lists: DataFrame | None = None, on_driver: bool = True, after: Profile | None = None):
        self.spark = statements.sparkSession
        self.ws = Workspace(self.spark, "tbox")
        self.profile = profile
        self.after = after or profile
        self._given = lists
        #: statements of ``statements`` that are not stated but were concluded about instances
        self.more: DataFrame | None = None
        self.facts: local.Facts | None = None
        own = schema_triples(statements).distinct()
        few = own.limit(DRIVER_ROWS + 1).collect() if on_driver else []
        if on_driver and len(few) <= DRIVER_ROWS:
            few = sorted(map(tuple, few))
            self.explicit = self._frame(few)
            self.predicates = {p for _, p, _ in few}
        else:
            few = None
            self.explicit = self.ws.save(own, "explicit")
            self.predicates = {r["p"] for r in self.explicit.select("p").distinct().collect()}
        rules = []
        for r in profile.rules:
            if r.kind == 1 and r.name.startswith(("scm-", "line-")):
                rules.append(Compiled(r.name, r.head, r.schema))
            elif r.kind == 4 and r.each() and not r.body and r.head.p in T.SCHEMA_PREDICATES:
                rules += self._listed(r, self.explicit)
        # a rule can only fire where its predicates are stated or concluded by another one
        reachable = set(self.predicates)
        while True:
            live = [r for r in rules if all(a.p in reachable for a in r.body)]
            grown = reachable | {r.head.p for r in live}
            if grown == reachable:
                break
            reachable = grown
        if few is not None and all(r.rows is not None or r.body for r in live):
            try:
                stated = set(few) | {
                    tuple(row[name(t)] if is_variable(t) else t for t in r.head.terms()) for r in live if not r.body for row in r.rows
                }
                self.facts, rounds = local.closure(stated, [(r.head, r.body) for r in live if r.body], DRIVER_CLOSED)
                derived = sorted(self.facts.all - set(few))
                self.closure = Closure(self.explicit, self._frame(derived), rounds)
                self.closed = self._frame(sorted(self.facts.all))
                return
            except local.TooLarge:
                self.facts = None
        self.closure = self._closed(live)
        self.closed = self.ws.save(self.closure.all().distinct(), "closed")

    def _closed(self, rules: list[Compiled]) -> Closure:
        """The closure group by group; a group that only says that one property is transitive has its
        own way, the others between two of these are taken together."""
        facts = [r for r in rules if not r.body]
        found = [fixpoint(self.explicit, facts, "tbox-facts")] if facts else []
        groups: list[list[Compiled]] = []
        for group in strata([r for r in rules if r.body]):
            alone = len(group) == 1 and is_chain(group[0])
            if groups and not alone and not (len(groups[-1]) == 1 and is_chain(groups[-1][0])):
                groups[-1] += group
            else:
                groups.append(group)
        for group in groups:
            known = found[-1].all() if found else self.explicit
            if len(group) == 1 and is_chain(group[0]):
                p = group[0].head.p
                links = known.where(F.col("p") == p).select(F.col("s").alias("top"), F.col("o").alias("bottom")).distinct()
                tables = closed_pairs(self.ws, links, [])[1:]
                if tables:
                    pairs = self.spark.read.schema(tables[0].schema).parquet(*[t._loomgraph_path for t in tables]).where("new")
                    found.append(Closure(known, pairs.select(F.col("top").alias("s"), F.lit(p).cast("bigint").alias("p"), F.col("bottom").alias("o")), len(tables)))
            else:
                found.append(fixpoint(known, group, "tbox-closure"))
        derived = reduce(DataFrame.unionByName, [c.derived for c in found]) if found else self.explicit.where("false")
        return Closure(self.explicit, derived, sum(c.rounds for c in found))

    @property
    def derived(self) -> DataFrame:
        """All of the schema that is not stated."""
        return self.closure.derived if self.more is None else self.closure.derived.unionByName(self.more)

    def _frame(self, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, "s bigint, p bigint, o bigint")

    @cached_property
    def lists(self) -> DataFrame:
        rows = self._given if self._given is not None else assemble_lists(self.explicit)
        return self.ws.save(rows.select("head", "list_id", "pos", "el").where("head IS NOT NULL AND el IS NOT NULL").distinct(), "lists")

    @cached_property
    def whole_lists(self) -> DataFrame:
        """``(head, list_id, els)``: the elements in order of position."""
        els = F.transform(F.array_sort(F.collect_list(F.struct("pos", "el"))), lambda x: x["el"])
        return self.lists.groupBy("head", "list_id").agg(els.alias("els"))

    def _schema(self, atoms: tuple[Atom, ...], statements: DataFrame) -> tuple[DataFrame | None, list[str]]:
        out, variables = None, []
        for i in connected_order(list(atoms)):
            out = natural_join(out, bindings(statements, atoms[i]))
            variables += [v for v in atoms[i].variables() if v not in variables]
        return out, variables

    def _listed(self, r: Rule, statements: DataFrame) -> list[Compiled]:
        if not all(a.p in self.predicates for a in r.schema):
            return []
        side, variables = self._schema(r.schema, statements)
        head = name(r.elements)
        if r.each():
            rows = side.withColumnRenamed(head, "__head").join(
                self.lists.select(F.col("head").alias("__head"), F.col("el").alias(head)), "__head"
            )
            made = with_side(self.spark, r.name, r.head, r.body, rows, variables)
            return [made] if made else []
        rows = side.withColumnRenamed(head, "head").join(self.whole_lists, "head")
        rows = self.ws.save(rows, "lists-of-rule")
        lengths = sorted(x["n"] for x in rows.select(F.size("els").alias("n")).distinct().collect())
        out = []
        for n in lengths:
            flat = unrolled(r, n)
            els = [F.element_at("els", i + 1).alias(f"el_{i}") for i in range(n)]
            own = [v for v in variables if v != r.elements]
            part = rows.where(F.size("els") == n).select(*[name(v) for v in own], *els)
            made = with_side(self.spark, flat.name, flat.head, flat.body, part, own + [f"?el_{i}" for i in range(n)])
            out += [made] if made else []
        return out

    @cached_property
    def compiled(self) -> list[Compiled]:
        """The rules on instances, with their bindings in the closed schema; those without any are left out."""
        if self.facts is not None:
            present = {p for _, p, _ in self.facts.all}
        else:
            present = {r["p"] for r in self.closed.select("p").distinct().collect()}
        out = []
        for r in self.after.rules:
            if not all(is_variable(a.p) or a.p in present for a in r.schema):
                continue
            if r.kind == 4:
                if r.body or r.head.p not in T.SCHEMA_PREDICATES:
                    out += self._listed(r, self.closed)
            elif r.kind > 1 and self.facts is not None:
                rows = local.solutions(r.schema, [self.facts] * len(r.schema))
                made = from_rows(self.spark, r.name, r.head, r.body, rows)
                out += [made] if made else []
            elif r.kind > 1:
                side, variables = self._schema(r.schema, self.closed)
                made = with_side(self.spark, r.name, r.head, r.body, side, variables)
                out += [made] if made else []
        return simplified(out)
