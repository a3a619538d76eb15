"""Rules to DataFrame joins, and their semi-naive fixpoint."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.scan import IN_LIST, bindings, complete, connected_order, head_rows, name, natural_join
from loomgraph.plans.rules import Atom, Rule, is_variable
from loomgraph.terms import SAME_AS, TYPE
from loomgraph.workspace import Workspace

#: Schema bindings up to this many rows are taken to the driver, to prune with.
DRIVER_ROWS = 2_000


@dataclass
class Compiled:
    """A rule with its schema part evaluated: ``side`` has a column for each of its variables.

    ``rows`` are the side's rows where there are few, else None; then the side is a written table.
    """

    name: str
    head: Atom
    body: tuple[Atom, ...]
    side: DataFrame | None = None
    rows: list[dict[str, int]] | None = None
    variables: tuple[str, ...] = field(default=())
    _known: dict = field(default_factory=dict, repr=False, compare=False)

    def values(self, term) -> list[int] | None:
        """What a term can be: an id, the side's values of a variable, or None if unknown or too many for a filter."""
        if not is_variable(term):
            return [term]
        if term not in self.variables:
            return None
        if term not in self._known:
            if self.rows is not None:
                found = {r[name(term)] for r in self.rows}
            else:
                found = {r[0] for r in self.side.select(name(term)).distinct().limit(IN_LIST + 1).collect()}
            self._known[term] = sorted(found) if self.rows is not None or len(found) <= IN_LIST else None
        return self._known[term]

    def known(self) -> dict[str, list[int]]:
        return {v: self.values(v) for v in self.variables if self.values(v) is not None}

    def fitting(self, wanted: dict[str, set[int]], most: int) -> list[dict[str, int]] | None:
        """The bindings in which each of some variables has one of the values; None if there are more than ``most``."""
        if self.rows is not None:
            return [r for r in self.rows if all(r[name(v)] in x for v, x in wanted.items())]
        side = self.side
        for v, x in wanted.items():
            if len(x) <= IN_LIST:
                side = side.where(F.col(name(v)).isin(sorted(x)))
            else:
                side = side.join(side.sparkSession.createDataFrame([(i,) for i in sorted(x)], f"`{name(v)}` bigint"), name(v), "left_semi")
        found = side.limit(most + 1).collect()
        return [r.asDict() for r in found] if len(found) <= most else None


def with_side(spark, rule_name: str, head: Atom, body: tuple[Atom, ...], side: DataFrame, variables: list[str]) -> Compiled | None:
    """A compiled rule on the side's distinct bindings; None where there are none."""
    needed = [v for v in variables if v in head.variables() or any(v in a.variables() for a in body)]
    columns = [name(v) for v in needed]
    if not columns:
        return Compiled(rule_name, head, body, None, [{}], ()) if side.limit(1).count() else None
    side, n = Workspace(spark, "side").save_counted(side.select(*columns).distinct(), "side")
    if not n:
        return None
    if n > DRIVER_ROWS:
        return Compiled(rule_name, head, body, side, None, tuple(needed))
    first = side.collect()
    local = spark.createDataFrame([tuple(r) for r in first], ", ".join(f"`{c}` bigint" for c in columns))
    return Compiled(rule_name, head, body, local, [r.asDict() for r in first], tuple(needed))


def from_rows(spark, rule_name: str, head: Atom, body: tuple[Atom, ...], rows: list[dict[str, int]]) -> Compiled | None:
    """A compiled rule on bindings that are on the driver already."""
    if not rows:
        return None
    needed = [v for v in rows[0] if v in head.variables() or any(v in a.variables() for a in body)]
    distinct = sorted({tuple(r[v] for v in needed) for r in rows})
    columns = [name(v) for v in needed]
    if not columns:
        return Compiled(rule_name, head, body, None, [{}], ())
    side = spark.createDataFrame(distinct, ", ".join(f"`{c}` bigint" for c in columns))
    if len(distinct) > DRIVER_ROWS:
        return Compiled(rule_name, head, body, Workspace(spark, "side").save(side, "side"), None, tuple(needed))
    return Compiled(rule_name, head, body, side, [dict(zip(columns, r)) for r in distinct], tuple(needed))


def _stars(rule: Compiled) -> list[list[int]]:
    """The body atoms by subject, where two subjects meet in more than one variable; else all in one.

    Records that agree in all of several values, as under a key, are first put
    together and then matched on all the values at once: matching value by value
    would make every pair that agrees in one.
    """
    by: dict = {}
    for i, a in enumerate(rule.body):
        by.setdefault(a.s, []).append(i)
    groups = list(by.values())
    own = [{v for i in g for v in rule.body[i].variables()} - set(rule.variables) for g in groups]
    if len(groups) == 2 and min(map(len, groups)) > 1 and len(own[0] & own[1]) > 1:
        return groups
    return [list(range(len(rule.body)))]


def derive(rule: Compiled, relations: list[DataFrame]) -> DataFrame:
    """The rule's heads with each body atom read from its relation.

    The side, if any, is joined to the first atom; Spark broadcasts it when its
    measured size allows.  Atoms follow in connected order.
    """
    known = rule.known()
    result = None
    for star in _stars(rule):
        rows = rule.side
        for k in connected_order([rule.body[i] for i in star], rule.variables):
            rows = natural_join(rows, bindings(relations[star[k]], rule.body[star[k]], known))
        result = natural_join(result, rows)
    return head_rows(result, rule.head)


def same_as_links(rule: Compiled, triples: DataFrame) -> DataFrame | None:
    """``(s, p, o)``: each term that the rule makes the same as others, with the least of these; None for other rules.

    A rule that concludes ``?y sameAs ?z`` says the same of both, so those that
    agree in everything else are one group.  All pairs of a group are its square;
    these links are as many as its terms and connect the same terms.  The least
    of a group is found with a combined minimum and joined back, so that no
    group is gathered.
    """
    y, p, z = rule.head.terms()
    if p != SAME_AS or not (is_variable(y) and is_variable(z)) or y == z:
        return None
    own = [a for a in rule.body if y in a.terms()]
    if any(z in a.terms() for a in own) or {a.replaced({y: z}) for a in own} != {a for a in rule.body if z in a.terms()}:
        return None
    atoms = [a for a in rule.body if z not in a.terms()]
    rows = rule.side
    for k in connected_order(atoms, rule.variables):
        rows = natural_join(rows, bindings(triples, atoms[k], rule.known()))
    rest = [c for c in rows.columns if c != name(y)]
    rows = rows.distinct()
    least = rows.groupBy(*rest).agg(F.min(name(y)).alias("__least"))
    return rows.join(least, rest).select(F.col(name(y)).alias("s"), F.lit(SAME_AS).cast("bigint").alias("p"), F.col("__least").alias("o")).distinct()


def _can_feed(rule: Compiled, atom: Atom, fresh: set[tuple[int, int | None]] | None) -> bool:
    """Whether new statements of these predicates, and classes for ``type``, can fit the atom."""
    if fresh is None:
        return True
    possible, classes = rule.values(atom.p), rule.values(atom.o)
    for p, c in fresh:
        if possible is None or p in possible:
            if p != TYPE or classes is None or c in classes:
                return True
    return False


def is_chain(rule: Compiled) -> bool:
    """Whether a rule says that statements of a property follow each other: x p y and y p z give x p z."""
    if len(rule.body) != 2:
        return False
    h, (first, second) = rule.head, sorted(rule.body, key=lambda a: a.s != rule.head.s)
    return (
        h.p == first.p == second.p and (not is_variable(h.p) or h.p in rule.variables)
        and h.s == first.s and h.o == second.o and first.o == second.s and len({h.s, h.o, first.o}) == 3
        and all(map(is_variable, (h.s, h.o, first.o))) and not any(v in rule.variables for v in (h.s, h.o, first.o))
    )


def _grounded(rule: Compiled, row: dict[str, int]) -> tuple:
    """A rule under one binding as ``(head, body)``, its other variables numbered as they come."""
    values: dict = {v: row[name(v)] for v in rule.variables}

    def of(t):
        return values.setdefault(t, f"?{len(values)}") if is_variable(t) else t

    head = tuple(map(of, rule.head.terms()))
    return _numbered(head, tuple((*map(of, a.terms()), a.symmetric) for a in rule.body))


def _numbered(head: tuple, body: tuple) -> tuple:
    names: dict = {}

    def of(t):
        return names.setdefault(t, f"?{len(names)}") if is_variable(t) else t

    return tuple(map(of, head)), tuple(tuple(map(of, a)) for a in body)


def simplified(rules: list[Compiled]) -> list[Compiled]:
    """The rules without bindings that others make needless.

    Under a binding a rule says the same as another one, or has one body atom
    with an id where the same conclusion is drawn from any term at that place,
    as a value of a property where the property's domain is already the class.
    """
    known = {_grounded(r, x) for r in rules if r.rows is not None and len(r.body) == 1 for x in r.rows}
    seen: set = set()
    out = []
    for r in rules:
        if r.rows is None or not r.body:
            out.append(r)
            continue
        rows = []
        for x in r.rows:
            head, body = key = _grounded(r, x)
            wider = []
            if len(body) == 1:
                wider = [_numbered(head, (tuple("?any" if i == k else t for i, t in enumerate(body[0])),)) for k in (0, 2) if not is_variable(body[0][k])]
            if key not in seen and not any(w in known for w in wider):
                rows.append(x)
            seen.add(key)
        if len(rows) == len(r.rows):
            out.append(r)
        elif rows:
            columns = [name(v) for v in r.variables]
            side = r.side.sparkSession.createDataFrame([tuple(x[c] for c in columns) for x in rows], ", ".join(f"`{c}` bigint" for c in columns))
            out.append(replace(r, side=side, rows=rows, _known={}))
    return out


def strata(rules: list[Compiled]) -> list[list[Compiled]]:
    """The rules, whose predicates are ids, in groups that only need what groups before them and they themselves conclude."""
    needs: dict[int, set[int]] = {}
    for r in rules:
        needs.setdefault(r.head.p, set()).update(a.p for a in r.body)
    reach = {p: set(x) for p, x in needs.items()}
    while True:
        grown = {p: x.union(*(reach.get(q, set()) for q in x)) for p, x in reach.items()}
        if grown == reach:
            break
        reach = grown
    groups: dict[frozenset, list[Compiled]] = {}
    for r in rules:
        own = frozenset({q for q in reach[r.head.p] if r.head.p in reach.get(q, ())} | {r.head.p})
        groups.setdefault(own, []).append(r)
    order: list[frozenset] = []
    left = list(groups)
    while left:
        ready = next(g for g in left if not any(h is not g and any(q in h for p in g for q in reach.get(p, ())) for h in left))
        left.remove(ready)
        order.append(ready)
    return [groups[g] for g in order]


def relevant_part(triples: DataFrame, rules: list[Compiled]) -> DataFrame:
    """The statements with a predicate that the rules can read or conclude, if these are few enough for a filter."""
    needed: set[int] = set()
    for v in (r.values(a.p) for r in rules for a in (r.head, *r.body)):
        if v is None:
            return triples
        needed |= set(v)
    return triples.where(F.col("p").isin(sorted(needed))) if len(needed) <= IN_LIST else triples


@dataclass
class Closure:
    """``derived``: the distinct statements the rules add to the explicit ones."""

    explicit: DataFrame
    derived: DataFrame
    rounds: int

    def all(self) -> DataFrame:
        return self.explicit.unionByName(self.derived)


def fixpoint(explicit: DataFrame, rules: list[Compiled], name_: str = "closure", until: Column | None = None) -> Closure:
    """Semi-naive evaluation of the rules until nothing new comes, or a new statement fits ``until``.

    Each round joins what the last one added, at each body atom in turn, with
    everything known at the others, keeps what is new, and writes it.  A rule is
    skipped where the added predicates and classes cannot feed the atom.  What is known is
    read restricted to the predicates that heads can have when looking for
    duplicates.  No rule makes new terms, so this ends.
    """
    spark = explicit.sparkSession
    ws = Workspace(spark, name_)
    explicit = complete(explicit)
    heads: set[int] | None = set()
    for r in rules:
        v = r.values(r.head.p)
        heads = None if heads is None or v is None else heads | set(v)
    # a computed input is written once rather than computed every round
    base = relevant_part(explicit, rules)
    base = ws.settled(base) if rules else base
    parts: list[DataFrame] = []

    def read() -> DataFrame | None:
        return spark.read.schema(parts[0].schema).parquet(*[t._loomgraph_path for t in parts]) if parts else None

    total, delta, fresh = base, base, None
    rounds = 0
    while rules:
        new = None
        for r in rules:
            if not r.body:  # holds from the start
                branch = [head_rows(r.side, r.head)] if rounds == 0 else []
            elif rounds == 0:
                branch = [derive(r, [total] * len(r.body))]
            else:
                branch = [
                    derive(r, [delta if j == i else total for j in range(len(r.body))])
                    for i, a in enumerate(r.body)
                    if _can_feed(r, a, fresh)
                ]
            for b in branch:
                new = b if new is None else new.unionByName(b)
        if new is None:
            break
        old = total
        if heads is not None and len(heads) <= IN_LIST:
            old = old.where(F.col("p").isin(sorted(heads)))
        delta, n = ws.save_counted(new.distinct().join(old, ["s", "p", "o"], "left_anti").select("s", "p", "o"), "round")
        rounds += 1
        if not n:
            break
        parts.append(delta)
        if until is not None and delta.where(until).limit(1).count():
            break
        kinds = delta.select("p", F.when(F.col("p") == TYPE, F.col("o")).alias("c")).distinct()
        found = kinds.limit(DRIVER_ROWS + 1).collect()
        fresh = {(x["p"], x["c"]) for x in found} if len(found) <= DRIVER_ROWS else None
        total = base.unionByName(read())
    derived = read()
    if derived is None:
        derived = explicit.where("false")
    return Closure(explicit, derived, rounds)
