"""Answering one pattern at query time: the goal is rewritten against the rules."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph import terms as T
from loomgraph.operators.scan import IN_LIST, complete, name
from loomgraph.plans.forward import Compiled, fixpoint, is_chain
from loomgraph.plans.rules import is_variable
from loomgraph.workspace import Workspace

#: More rewritings than this, and the restricted fixpoint is used instead.
MOST_REWRITINGS = 100_000
#: Rounds of single links from what a goal fixes, before the links are doubled, and how many times as many as links the doubled ones may be.
PLAIN_ROUNDS = 6
GROWTH = 4


@dataclass(frozen=True)
class Rewriting:
    """Scan for ``scan`` (ids or None) and emit ``out``: each term an id, or the scanned column's name.

    ``out`` says where each of the goal's terms comes from, so the same scan with
    s and o changed over, as under a symmetric property, is another rewriting.
    With ``chain`` what is scanned are the chains of statements of a transitive property.
    """

    scan: tuple[int | None, int | None, int | None]
    out: tuple[int | str, int | str, int | str]
    chain: bool = False


class NotRewritable(Exception):
    """A rule with several body atoms, or with too many bindings, can feed the goal."""


def _head_values(goal: Rewriting, rule: Compiled) -> dict[str, int] | None:
    """What the goal makes the head's variables; None where it and the head differ."""
    bound: dict[str, int] = {}
    for wanted, h in zip(goal.scan, rule.head.terms()):
        if wanted is not None and (bound.setdefault(h, wanted) if is_variable(h) else h) != wanted:
            return None
    return bound


def _rewritten(goal: Rewriting, rule: Compiled, row: dict[str, int]) -> Rewriting | None:
    """The goal by a rule with one body atom, under one of its bindings."""
    values = {v: row[name(v)] for v in rule.variables}
    head = [values.get(t, t) if is_variable(t) else t for t in rule.head.terms()]
    body = [values.get(t, t) if is_variable(t) else t for t in rule.body[0].terms()]
    bound: dict[str, int] = {}
    for wanted, h in zip(goal.scan, head):
        if wanted is not None and (bound.setdefault(h, wanted) if is_variable(h) else h) != wanted:
            return None
    if rule.body[0].symmetric or len({t for t in body if is_variable(t)}) < sum(map(is_variable, body)):
        raise NotRewritable(rule.name)
    place = {t: c for c, t in zip("spo", body) if is_variable(t)}

    def source(c):
        if not isinstance(c, str):
            return c
        h = head["spo".index(c)]
        if not is_variable(h):
            return h
        return bound[h] if h in bound else place[h]

    return Rewriting(tuple(bound.get(t) if is_variable(t) else t for t in body), tuple(source(c) for c in goal.out))


def _unmet(rule: Compiled, k: str, f: str, wanted: set[int], member: tuple, seen: set[Rewriting]) -> list[dict[str, int]] | None:
    """One binding for each value of ``f`` that goes with a wanted one of ``k`` and has made none of the rewritings seen."""
    at = rule.body[0].terms().index(f)
    shape = _rewritten(member[0], rule, {name(k): member[1][k], name(f): -1})
    met = {r.scan[at] for r in seen if shape and r.out == shape.out and all(x == y for i, (x, y) in enumerate(zip(r.scan, shape.scan)) if i != at)}
    side = rule.side.join(_ids(rule.side, name(k), wanted), name(k), "left_semi").groupBy(name(f)).agg(F.min(name(k)).alias(name(k)))
    if met - {None}:
        side = side.join(_ids(side, name(f), met - {None}), name(f), "left_anti")
    return replace(rule, side=side, _known={}).fitting({}, MOST_REWRITINGS)


def _ids(like: DataFrame, column: str, values: set[int]) -> DataFrame:
    return like.sparkSession.createDataFrame([(x,) for x in sorted(values)], f"`{column}` bigint")


def _step(goals: list[Rewriting], rule: Compiled, seen: set[Rewriting]) -> set[Rewriting]:
    """The goals' rewritings by one rule with one body atom.

    Bindings are looked up for all goals at once.  Where one of the rule's
    variables depends on the goals and one other is new, as for a class and its
    sub-classes, the values of that one that were met before are left out.
    """
    found: set[Rewriting] = set()
    groups: dict[tuple, list[tuple[Rewriting, dict[str, int]]]] = defaultdict(list)
    for g in goals:
        bound = _head_values(g, rule)
        if bound is not None:
            own = {v: x for v, x in bound.items() if v in rule.variables}
            rest = tuple(None if is_variable(h) and h in own else x for x, h in zip(g.scan, rule.head.terms()))
            groups[tuple(own), rest, g.out].append((g, own))
    for (fixed, _, _), members in groups.items():
        wanted = {v: {own[v] for _, own in members} for v in fixed}
        free = [v for v in rule.variables if v not in wanted]
        if rule.rows is None and not wanted:
            rows = None
        elif rule.rows is None and len(fixed) == len(free) == 1 and free[0] in rule.body[0].terms() and fixed[0] not in rule.body[0].terms():
            rows = _unmet(rule, fixed[0], free[0], wanted[fixed[0]], members[0], seen)
        else:
            rows = rule.fitting(wanted, MOST_REWRITINGS)
        if rows is None:
            raise NotRewritable(rule.name)
        by: dict[tuple, list] = defaultdict(list)
        for r in rows:
            by[tuple(r[name(v)] for v in fixed)].append(r)
        for g, own in members:
            for r in by.get(tuple(own[v] for v in fixed), ()):
                made = _rewritten(g, rule, r)
                if made is not None:
                    found.add(made)
    return found


def _may_conclude(rule: Compiled, scan: tuple) -> bool:
    """Whether some head of the rule can be in the goal's scan."""
    for wanted, h in zip(scan, rule.head.terms()):
        possible = rule.values(h)
        if wanted is not None and possible is not None and wanted not in possible:
            return False
    return True


def rewrite(goal: tuple, rules: list[Compiled], chains: bool = False, inside: bool = False) -> list[Rewriting]:
    """All rewritings of a goal, itself first; each is scanned by itself and their union answers it.

    Rules with one body atom rewrite a goal to goals.  There are finitely many,
    as no rule makes terms, and one that was made before, or that a more general
    one covers, is not followed again.  All goals of a round are looked up in a
    rule's bindings together.

    With ``chains`` a goal for a transitive property with a fixed end becomes
    one for its chains and is not followed: see ``links_of``.  ``inside`` is for
    those links: the chains of all properties that only give statements of that
    property, as they are or the other way round, are chains of its links.
    """
    start = Rewriting(tuple(goal), tuple(g if g is not None else c for g, c in zip(goal, "spo")))
    seen, front = {start}, [start]
    done: list[Rewriting] = []
    while front:
        made: set[Rewriting] = set()
        live = []
        for g in front:
            over = [r for r in rules if is_chain(r) and _may_conclude(r, g.scan)] if chains or inside else []
            if over and (g.scan[1] is None or not inside and g.scan[0] is None and g.scan[2] is None):
                raise NotRewritable(over[0].name)
            if over and inside and g.scan[::2] != (None, None):
                raise NotRewritable(over[0].name)
            if over and not inside:
                done.append(replace(g, chain=True))
            else:
                live.append(g)
        for rule in rules:
            own = [g for g in live if _may_conclude(rule, g.scan)]
            if not own or inside and is_chain(rule):
                continue
            if len(rule.body) != 1:
                raise NotRewritable(rule.name)
            made |= _step(own, rule, seen)
        front = []
        for r in sorted(made, key=repr):
            general = [replace(r, scan=tuple(None if i == k else x for i, x in enumerate(r.scan))) for k in (0, 2)]
            if r in seen or any(g in seen and g.scan != r.scan for g in general):
                continue
            seen.add(r)
            front.append(r)
            if len(seen) > MOST_REWRITINGS:
                raise NotRewritable("too many rewritings")
    chained = {replace(g, chain=False) for g in done}
    return [*([start] if start not in chained else []), *done, *sorted(seen - {start} - chained, key=repr)]


def is_followed(prop: int, rules: list[Compiled]) -> bool:
    """Whether a goal for a property needs its chains, so that fixed ends are worth knowing."""
    return any(is_chain(r) and _may_conclude(r, (None, prop, None)) for r in rules)


def schema_goals(rules: list[Compiled]) -> list[tuple[int, int | None]]:
    """The ``(p, o)`` of schema statements that rules on instances may conclude; o is None but for ``type``."""
    found: set[tuple[int, int | None]] = set()
    for r in rules:
        predicates = _taken(r, r.head.p, {*T.SCHEMA_PREDICATES, T.TYPE})
        found |= {(p, None) for p in predicates - {T.TYPE}}
        if T.TYPE in predicates:
            found |= {(T.TYPE, c) for c in _taken(r, r.head.o, set(T.SCHEMA_CLASSES))}
    return sorted(found, key=repr)


def _taken(rule: Compiled, term, of: set[int]) -> set[int]:
    """Which of some ids a term of the rule can be."""
    if not is_variable(term):
        return of & {term}
    if term not in rule.variables:
        return of
    if rule.rows is not None:
        return of & set(rule.values(term))
    c = F.col(name(term))
    return {r[0] for r in rule.side.where(c.isin(sorted(of))).select(c).distinct().collect()}


def _links(explicit: DataFrame, prop: int, rules: list[Compiled]) -> DataFrame:
    """The distinct ``(s, o)`` of a transitive property that are not made by its chains."""
    return answer_rewritings(explicit, rewrite((None, prop, None), rules, inside=True)).select("s", "o")


def reach(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(seed, node)``: what chains of links lead to from each of the distinct ``seeds`` (one column).

    A round adds the nodes one link farther to what was found last, so what is
    written is the answer.  After ``PLAIN_ROUNDS`` rounds the walks of exactly
    ``h`` links are made of those of half as many, as long as there are not many
    more than links, and a round adds ``h`` links: deep chains take a
    logarithmic number of rounds.
    """
    spark = links.sparkSession
    ws = Workspace(spark, "reach")
    links = ws.settled(links.select("s", "o"))
    seed = seeds.columns[0]

    def farther(rows: DataFrame, walks: DataFrame) -> DataFrame:
        return rows.join(walks.select(F.col("s").alias("node"), F.col("o").alias("next")), "node").select("seed", F.col("next").alias("node"))

    start = seeds.select(F.col(seed).alias("seed"), F.col(seed).alias("node"))
    new, n = ws.save_counted(farther(start, links).distinct(), "new")
    found, walks, h, away, size = [new], links, 1, 1, None
    doubling = True
    while n:  # all nodes up to `away` links from a seed are found, the last `h` of these in `new`
        every = spark.read.schema(new.schema).parquet(*[t._loomgraph_path for t in found])
        front = new
        if doubling and away >= PLAIN_ROUNDS:
            size = links.count() if size is None else size
            twice = walks.select("s", F.col("o").alias("node")).join(walks.select(F.col("s").alias("node"), "o"), "node")
            twice, m = ws.save_counted(twice.select("s", "o").distinct(), "walks")
            doubling = m <= GROWTH * size
            if doubling:
                walks, h, front = twice, 2 * h, every.union(start)
        new, n = ws.save_counted(farther(front, walks).distinct().join(every, ["seed", "node"], "left_anti"), "new")
        found.append(new)
        away += h
    return spark.read.schema(new.schema).parquet(*[t._loomgraph_path for t in found])


def answer_rewritings(explicit: DataFrame, rewritings: list[Rewriting], once: bool = False) -> DataFrame:
    """The union of the rewritings' answers, in one branch for each shape.

    Rewritings of one shape scan the same columns and differ in ids only: they
    are one pushed-down list of ids, or one join with the small table of ids.
    With ``once`` the statements are known to be distinct, and one rewriting's are left as they are.
    """
    spark = explicit.sparkSession
    shapes: dict[tuple, list[Rewriting]] = defaultdict(list)
    for r in rewritings:
        shapes[tuple(x is not None for x in r.scan), tuple(x if isinstance(x, str) else None for x in r.out)].append(r)
    result = None
    for (fixed, out), group in sorted(shapes.items(), key=repr):
        columns = [c for c, f in zip("spo", fixed) if f]
        made = ["spo"[i] for i, x in enumerate(out) if x is None]
        rows = {
            (*[x for x in r.scan if x is not None], *[x for x in r.out if not isinstance(x, str)]): None for r in group
        }
        part = explicit
        for i, c in enumerate(columns):
            ids = sorted({row[i] for row in rows})
            if len(ids) <= IN_LIST:
                part = part.where(F.col(c).isin(ids))
        if len(rows) == 1:
            only = next(iter(rows))[len(columns) :]
            values = {f"__{c}": F.lit(v).cast("bigint") for c, v in zip(made, only)}
            part = part.withColumns(values) if values else part
        elif len(columns) > 1 or made:
            if not columns:  # ids made of any triple: the few rows are put beside each
                ids = F.array(*[F.struct(*[F.lit(v).cast("bigint").alias(f"__{c}") for c, v in zip(made, row)]) for row in rows])
                part = part.withColumn("__e", F.explode(ids)).select("s", "p", "o", "__e.*")
            else:
                names = columns + [f"__{c}" for c in made]
                part = part.join(spark.createDataFrame(list(rows), ", ".join(f"`{c}` bigint" for c in names)), columns)
        part = part.select(*[F.col(x if x else f"__{c}").alias(c) for c, x in zip("spo", out)])
        result = part if result is None else result.unionByName(part)
    return result if once and len(rewritings) == 1 else result.distinct()


def relevant(goal: tuple, rules: list[Compiled]) -> tuple[list[Compiled], set[int] | None]:
    """The rules, cut to the bindings, and the predicates that can matter for a goal (None: all).

    A goal is seen as its predicate, and its class if that is ``type``.
    """
    start = (goal[1], goal[2] if goal[1] == T.TYPE else None)
    seen, todo = {start}, [start]
    kept: dict[int, dict[tuple, dict]] = defaultdict(dict)
    whole: set[int] = set()
    while todo:
        p, c = todo.pop()
        for k, rule in enumerate(rules):
            if rule.rows is None:
                if _may_conclude(rule, (None, p, c)):
                    whole.add(k)
                    need = [(rule.values(a.p), rule.values(a.o)) for a in rule.body]
                    for ps, os in need:
                        for x in ps if ps is not None else [None]:
                            for y in os if x == T.TYPE and os is not None else [None]:
                                if (x, y) not in seen:
                                    seen.add((x, y))
                                    todo.append((x, y))
                continue
            for row in rule.rows:

                def value(t):
                    return row.get(t.lstrip("?").replace("+", "x")) if is_variable(t) else t

                hp, ho = value(rule.head.p), value(rule.head.o)
                if p is not None and hp is not None and p != hp:
                    continue
                if c is not None and ho is not None and c != ho:
                    continue
                kept[k][tuple(sorted(row.items()))] = row
                for a in rule.body:
                    x = value(a.p)
                    g = (x, value(a.o) if x == T.TYPE else None)
                    if g not in seen:
                        seen.add(g)
                        todo.append(g)
    out = []
    for k, rule in enumerate(rules):
        if k in whole:
            out.append(rule)
        elif kept.get(k):
            rows = list(kept[k].values())
            side = rule.side
            if side is not None and len(rows) < len(rule.rows):
                columns = side.columns
                side = side.sparkSession.createDataFrame(
                    [tuple(r[c] for c in columns) for r in rows], ", ".join(f"`{c}` bigint" for c in columns)
                )
            out.append(replace(rule, side=side, rows=rows, _known={}))
    predicates = None if any(p is None for p, _ in seen) else {p for p, _ in seen}
    return out, predicates


def _chains(explicit: DataFrame, r: Rewriting, rules: list[Compiled], seeds: dict[str, DataFrame]) -> DataFrame:
    """The statements of a rewriting for the chains of a transitive property with a fixed end."""
    s, p, o = r.scan
    links = _links(explicit, p, rules)
    spark = links.sparkSession
    if s is not None or "s" in seeds:
        start = spark.createDataFrame([(s,)], "id bigint") if s is not None else seeds["s"]
        rows = reach(links, start).toDF("s", "o")
    else:
        start = spark.createDataFrame([(o,)], "id bigint") if o is not None else seeds["o"]
        rows = reach(links.select(F.col("o").alias("s"), F.col("s").alias("o")), start).toDF("o", "s")
    if s is not None and o is not None:
        rows = rows.where(F.col("o") == o)
    rows = rows.select("s", F.lit(p).cast("bigint").alias("p"), "o")
    return rows.select(*[(F.col(x) if isinstance(x, str) else F.lit(x).cast("bigint")).alias(c) for c, x in zip("spo", r.out)])


def answer(explicit: DataFrame, goal: tuple, rules: list[Compiled], seeds: dict[str, DataFrame] | None = None, single: DataFrame | None = None) -> DataFrame:
    """The distinct statements, stated or concluded, that fit a goal of ids and None.

    ``seeds`` are one-column tables of the distinct values that s or o need only
    have: others may be left out.  ``single`` are the statements of the goal's
    own predicate, if they are known to be distinct.

    Where only rules with one body atom can feed the goal, it is rewritten and
    read in one pass; a transitive property with a fixed end, or seeds, is
    followed from there.  Else the relevant rules run to their fixpoint over the
    relevant predicates; with all three terms fixed, until the statement is found.
    """
    explicit = complete(explicit)
    seeds = seeds or {}
    try:
        # a column with seeds counts as fixed
        ways = rewrite(goal, rules)
        if len(ways) == 1 and single is not None:
            return restricted(answer_rewritings(single, ways, once=True), seeds)
        return restricted(answer_rewritings(explicit, ways), seeds)
    except NotRewritable:
        pass
    try:
        if goal[0] is None and goal[2] is None and seeds and goal[1] is not None:
            chained = is_followed(goal[1], rules)
            ways = [Rewriting((None, goal[1], None), ("s", goal[1], "o"), chain=True)] if chained else None
        else:
            ways = rewrite(goal, rules, chains=True)
        if ways:
            plain = [r for r in ways if not r.chain]
            out = answer_rewritings(explicit, plain) if plain else None
            for r in ways:
                if r.chain:
                    part = _chains(explicit, r, rules, seeds)
                    out = part if out is None else out.unionByName(part)
            return restricted(out.distinct(), seeds)
    except NotRewritable:
        pass
    some, predicates = relevant(goal, rules)
    base = explicit
    if predicates is not None and len(predicates) <= IN_LIST:
        base = base.where(F.col("p").isin(sorted(predicates)))
    wanted = F.lit(True)
    for c, g in zip("spo", goal):
        if g is not None:
            wanted = wanted & (F.col(c) == g)
    whole = all(g is not None for g in goal)
    if whole and base.where(wanted).limit(1).count():
        return base.where(wanted).distinct()
    out = fixpoint(base, some, "backward", wanted if whole else None).all()
    return restricted(out.where(wanted).distinct(), seeds)


def restricted(rows: DataFrame, seeds: dict[str, DataFrame]) -> DataFrame:
    for c, values in seeds.items():
        rows = rows.join(values.toDF(c), c, "left_semi")
    return rows.select("s", "p", "o")
