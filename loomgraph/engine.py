"""The public interface: patterns, SPARQL, closure and estimates over a set of triples."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.scan import IN_LIST, bindings, complete, name, natural_join, scan
from loomgraph.plans import planner, sparql
from loomgraph.plans.backward import answer, is_followed, restricted, schema_goals
from loomgraph.plans.forward import Closure, derive, fixpoint, same_as_links
from loomgraph.plans.rules import OWL2RL_SPEC, Atom, Profile, is_variable
from loomgraph.plans.tbox import TBox, schema_triples
from loomgraph.terms import SAME_AS, lookup
from loomgraph.workspace import Workspace


#: A pattern is restricted to what it is joined with where it has so many times as many values.
FEWER = 20


class Engine:
    """Queries over ``triples`` (columns s, p, o; others are ignored).

    ``schema`` holds the schema statements if they are apart from the triples,
    ``lists`` (head, list_id, pos, el) the RDF lists, ``dictionary`` (id, text)
    the texts that SPARQL needs.  The rules of ``profile`` close the schema and,
    unless ``after`` has others for it, conclude about instances.  Statements with a null term do not count and
    repeated ones count once; ``once`` says that ``triples`` has none, as a store, which saves looking for them.
    """

    def __init__(
        self,
        triples: DataFrame,
        schema: DataFrame | None = None,
        lists: DataFrame | None = None,
        dictionary: DataFrame | None = None,
        profile: Profile = OWL2RL_SPEC,
        after: Profile | None = None,
        once: bool = False,
    ):
        self.once = once
        self.spark = triples.sparkSession
        self.triples = complete(triples)
        self.schema = complete(schema) if schema is not None else None
        self.lists = lists
        self.dictionary = dictionary
        self.profile = profile
        self.after = after

    @property
    def explicit(self) -> DataFrame:
        return self.triples if self.schema is None else self.triples.unionByName(self.schema)

    @cached_property
    def tbox(self) -> TBox:
        """The closed schema, with what of it follows from all statements by the rules on instances.

        Where such a rule can conclude schema at all, what it does is added and
        the schema closed again, until nothing is added any more.
        """
        stated = self.schema if self.schema is not None else self.triples
        out = TBox(stated, self.profile, self.lists, after=self.after)
        ws = Workspace(self.spark, "schema")
        while True:
            goals = schema_goals(out.compiled)
            if not goals:
                return out
            known = self.explicit.unionByName(out.derived)
            found = [answer(known, (None, p, o), out.compiled) for p, o in goals]
            more = schema_triples(reduce(DataFrame.unionByName, found))
            more, n = ws.save_counted(more.distinct().join(out.closed, ["s", "p", "o"], "left_anti").select("s", "p", "o"), "more")
            if not n:
                return out
            stated = stated.unionByName(more)
            derived = more if out.more is None else out.more.unionByName(more)
            out = TBox(stated, self.profile, self.lists, after=self.after)
            out.more = derived

    @cached_property
    def known(self) -> DataFrame:
        """What is known before rules on instances run: the statements and the closed schema."""
        return self.explicit.unionByName(self.tbox.derived)

    @cached_property
    def _schema_predicates(self) -> set[int] | None:
        """The predicates of statements that are not in ``triples``; None if they are many."""
        rows = self.tbox.derived if self.schema is None else self.schema.unionByName(self.tbox.derived)
        found = rows.select("p").distinct().limit(IN_LIST + 1).collect()
        return {r["p"] for r in found} if len(found) <= IN_LIST else None

    def _known_for(self, p: int | None, reason: bool) -> tuple[DataFrame, bool]:
        """What can have a predicate, and whether all of it is there once only."""
        if not reason and self.schema is None:
            return self.triples, self.once
        if isinstance(p, int) and self.once and self._schema_predicates is not None and p not in self._schema_predicates:
            return self.triples, True
        return (self.known if reason else self.explicit), False

    @cached_property
    def _settled(self) -> Engine:
        """This engine over a computed input that has been written once, for queries of several patterns."""
        ws = Workspace(self.spark, "engine")
        triples = ws.settled(self.triples)
        if triples is self.triples:
            return self
        out = Engine(triples, self.schema, self.lists, self.dictionary, self.profile, self.after, self.once)
        if "tbox" in self.__dict__:
            out.__dict__["tbox"] = self.tbox
        out.__dict__["_settled"] = out
        return out

    @cached_property
    def closure(self) -> Closure:
        """Everything that follows, derived ahead of time."""
        return fixpoint(self.known, self.tbox.compiled)

    def same_as_links(self) -> DataFrame:
        """``(s, p, o)``: what is the same as something else, stated or by rules on instances, as links that connect
        each group instead of all pairs of it: as many as there are terms, not their square.

        A rule whose links can't be told apart so gives its pairs.  What other rules conclude is known to these.
        """
        rules = self.tbox.compiled
        known = fixpoint(self.known, [r for r in rules if r.head.p != SAME_AS], "same-as").all()
        parts = [scan(known, p=SAME_AS)]
        for r in rules:
            if r.head.p == SAME_AS:
                links = same_as_links(r, known)
                parts.append(links if links is not None else derive(r, [known] * len(r.body)))
        return reduce(DataFrame.unionByName, parts).distinct()

    def forward(self) -> DataFrame:
        """All conclusions, of the schema and about instances, without what is stated."""
        return self.tbox.derived.unionByName(self.closure.derived)

    def pattern(
        self,
        s=None,
        p=None,
        o=None,
        reason: bool = True,
        exclude_explicit: bool = False,
        ahead: bool = False,
        tag_explicit: bool = False,
        seeds: dict[str, DataFrame] | None = None,
    ) -> DataFrame:
        """The distinct statements that fit.  A term is an id, a set of ids, or None for any.

        With ``reason`` they include what follows by the rules, derived for this
        goal or, with ``ahead``, taken from the full closure.  ``tag_explicit``
        adds a column ``explicit`` that says which are stated.  ``seeds`` has
        one-column tables of the distinct values of s or o that are asked for.
        """
        if tag_explicit:
            stated = scan(self.explicit, s, p, o).withColumn("explicit", F.lit(True))
            rows = self.pattern(s, p, o, reason, exclude_explicit, ahead, seeds=seeds).join(stated, ["s", "p", "o"], "left")
            return rows.select("s", "p", "o", F.col("explicit").isNotNull().alias("explicit"))
        if not reason:
            base, once = self._known_for(p, False)
            return restricted(scan(base, s, p, o, once), seeds or {})
        ids = tuple(x if isinstance(x, int) else None for x in (s, p, o))
        if ahead:
            out = scan(self.known.unionByName(self.closure.derived), s, p, o)
        else:
            several = isinstance(p, (set, frozenset, list, tuple))
            parts = []
            for x in sorted(set(p)) if several else [ids[1]]:
                _, once = self._known_for(x, True)
                parts.append(answer(self.known, (ids[0], x, ids[2]), self.tbox.compiled, seeds, self.triples if once else None))
            # answers are distinct, and so are those of several predicates
            out = reduce(DataFrame.unionByName, parts) if parts else self.known.where("false")
            if (s, o) != ids[::2] or isinstance(p, DataFrame):
                out = scan(out, s, None if several else p, o, once=True)
        if exclude_explicit:
            out = out.join(scan(self.explicit, s, p, o), ["s", "p", "o"], "left_anti").select("s", "p", "o")
        return out

    def cardinality(self, atoms: list[Atom], implicit: bool = True) -> list[planner.Estimate]:
        """The estimates of patterns, with what is concluded if ``implicit``."""
        rules = self.tbox.compiled if implicit else []
        return planner.estimates(self.known if implicit else self.explicit, atoms, rules)

    def bgp(
        self,
        atoms: list[Atom],
        reason: bool = True,
        optimise: bool = True,
        allow_cross: bool = False,
        sets: dict[str, list[int]] | None = None,
        implicit_estimates: bool = True,
    ) -> DataFrame:
        """The solutions of a basic graph pattern: a column for each variable.

        Patterns are joined smallest first, then along shared variables.  A
        variable twice in a pattern means equality.  Patterns without a common
        variable are refused unless ``allow_cross``.  ``sets`` restricts
        variables to ids.  A pattern is asked only for the values that a shared
        variable has so far, where these are fewer than ``FEWER`` of its own.
        """
        if len(atoms) > 2 and self._settled is not self:
            return self._settled.bgp(atoms, reason, optimise, allow_cross, sets, implicit_estimates)
        order, sizes, known = range(len(atoms)), None, None
        if optimise and len(atoms) > 2:  # two are joined either way; Spark picks the sides
            sizes = self.cardinality(atoms, implicit=reason and implicit_estimates)
            order = planner.join_order(atoms, sizes)
        elif optimise and len(atoms) == 2 and reason:
            order = sorted(order, key=lambda i: -sum(not is_variable(t) for t in atoms[i].terms()))
        out = None
        for i in order:
            terms = [t if isinstance(t, int) else None for t in atoms[i].terms()]
            for k, t in enumerate(atoms[i].terms()):
                if is_variable(t) and sets and t in sets:
                    terms[k] = sets[t]
            seeds = self._seeds(out, atoms[i], known, sizes and sizes[i].size, reason) if optimise else None
            if seeds:
                out, seeds = seeds
            rows = self.pattern(*terms, reason=reason, seeds=seeds)
            out = natural_join(out, bindings(rows, atoms[i]), allow_cross)
            if sizes:
                known = sizes[i].size if known is None else known.join(sizes[i].size)
        return out

    def _seeds(self, out: DataFrame | None, atom: Atom, known, size, reason: bool) -> tuple[DataFrame, dict[str, DataFrame]] | None:
        """What is joined so far, written once, and the values it leaves for the first shared end of the next pattern."""
        shared = [(c, t) for c, t in zip("so", (atom.s, atom.o)) if is_variable(t) and out is not None and name(t) in out.columns]
        if not shared:
            return None
        c, t = min(shared, key=lambda x: known.distinct.get(x[1], known.n)) if known else shared[0]
        few = known is not None and size is not None and known.distinct.get(t, known.n) * FEWER < size.distinct.get(t, size.n)
        followed = reason and not is_variable(atom.p) and all(map(is_variable, (atom.s, atom.o))) and is_followed(atom.p, self.tbox.compiled)
        if not few and not followed:
            return None
        out = Workspace(self.spark, "joined").save(out, "joined")
        return out, {c: out.select(F.col(name(t)).alias(c)).distinct()}

    def sparql(
        self,
        text: str,
        reason: bool = True,
        lexical: bool = False,
        select_all: bool = False,
        optimise: bool = True,
        implicit_estimates: bool = True,
        constants: dict[str, int | str | None] | None = None,
    ) -> DataFrame:
        """The answer of a SPARQL query, as ids; columns are the selected variables.

        A constant that the dictionary does not know gives no rows.  One text
        with several ids stands for any of them.  ``select_all`` returns every
        variable.  ``lexical`` compares literals without tags and datatypes.
        ``constants`` says what IRIs of the query stand for: an id, or a text of
        the dictionary, which need not be one that SPARQL allows there, as a
        literal for a predicate; None is nothing.
        """
        q = sparql.parse(text)
        given = constants or {}
        texts = list(dict.fromkeys(t for p in [*q.patterns, *[(a, b) for a, _, b in q.filters]] for t in p if not t.startswith("?") and t not in given))
        if lexical:
            texts = [c if c.startswith("<") else c[: c.rindex('"') + 1] for c in texts]
        known = lookup(self.dictionary, texts, lexical)
        stored = lookup(self.dictionary, [c for c in given.values() if isinstance(c, str)], reserved=False)
        known |= {t: [c] if isinstance(c, int) else stored.get(c, []) for t, c in given.items()}
        every = list(dict.fromkeys(t for p in q.patterns for t in p if t.startswith("?") and not t.startswith("?_b")))
        chosen = every if select_all else q.variables

        def text_of(t: str) -> str:
            return t if not lexical or t.startswith("<") else t[: t.rindex('"') + 1]

        def ids(t: str) -> list[int]:
            return known.get(text_of(t), [])

        if any(not ids(t) for p in q.patterns for t in p if not t.startswith("?")):
            return self.spark.createDataFrame([], ", ".join(f"`{name(v)}` bigint" for v in chosen))
        sets: dict[str, list[int]] = {}
        atoms = []
        for k, p in enumerate(q.patterns):
            terms = []
            for j, t in enumerate(p):
                if t.startswith("?"):
                    terms.append(t)
                elif len(ids(t)) == 1:
                    terms.append(ids(t)[0])
                else:
                    own = f"?_c{k}_{j}"
                    sets[own] = ids(t)
                    terms.append(own)
            atoms.append(Atom(*terms))
        out = self.bgp(atoms, reason, optimise, sets=sets, implicit_estimates=implicit_estimates)
        for a, op, b in q.filters:
            out = self._filter(out, a, op, b, ids, given)
        out = out.select(*[name(v) for v in chosen])
        if q.distinct:
            out = out.distinct()
        return out.limit(q.limit) if q.limit is not None else out

    def _filter(self, rows: DataFrame, a: str, op: str, b: str, ids, given: dict) -> DataFrame:
        if not a.startswith("?"):
            a, b = b, a
        if not a.startswith("?"):
            same = given.get(a, a) == given.get(b, b)
            return rows if same == (op == "=") else rows.where("false")
        left = F.col(name(a))
        if b.startswith("?"):
            equal = left == F.col(name(b))
        else:
            equal = left.isin(ids(b)) if ids(b) else F.lit(False)
        return rows.where(equal if op == "=" else ~equal)

    def answer_lines(self, rows: DataFrame) -> DataFrame:
        """One text a row: the ids joined by blanks."""
        return rows.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in rows.columns]).alias("line"))

    def explain(self, atoms: list[Atom], reason: bool = True) -> str:
        """The order and estimates of a basic graph pattern."""
        sizes = self.cardinality(atoms, implicit=reason)
        lines = []
        for i in planner.join_order(atoms, sizes):
            lines.append(f"{atoms[i].s} {atoms[i].p} {atoms[i].o}  explicit {sizes[i].explicit}, implicit {sizes[i].implicit}")
        return "\n".join(lines)
