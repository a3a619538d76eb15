"""Rules over a few statements on the driver: the closure and bindings of a small schema.

A schema of some hundred statements takes dozens of tiny Spark jobs; here it is
a few milliseconds.  Larger ones never come here: see ``TBox``.
"""

from __future__ import annotations

from collections import defaultdict

from loomgraph.operators.scan import connected_order
from loomgraph.plans.rules import Atom, is_variable

Fact = tuple[int, int, int]


class TooLarge(Exception):
    pass


class Facts:
    """Statements indexed by predicate, and by predicate with subject or object."""

    def __init__(self, facts=()):
        self.all: set[Fact] = set()
        self.by: dict[tuple, list[Fact]] = defaultdict(list)
        for f in facts:
            self.add(f)

    def add(self, f: Fact) -> bool:
        if f in self.all:
            return False
        self.all.add(f)
        s, p, o = f
        for key in ((p,), (p, "s", s), (p, "o", o)):
            self.by[key].append(f)
        return True

    def fitting(self, s, p, o) -> list[Fact]:
        """Statements that fit; None is any.  The predicates of schema atoms are ids."""
        if s is not None:
            return [f for f in self.by.get((p, "s", s), ()) if o is None or f[2] == o]
        return self.by.get((p, "o", o) if o is not None else (p,), [])


def solutions(atoms: tuple[Atom, ...], sources: list[Facts]) -> list[dict[str, int]]:
    """The bindings of a conjunction, each atom read from its source."""
    rows: list[dict[str, int]] = [{}]
    for i in connected_order(list(atoms)):
        atom, found = atoms[i], []
        for row in rows:
            terms = [row.get(t) if is_variable(t) else t for t in atom.terms()]
            ways = [(terms, False)] + ([(terms[::-1], True)] if atom.symmetric else [])
            for (s, p, o), swapped in ways:
                for fact in sources[i].fitting(s, p, o):
                    new = dict(row)
                    values = fact[::-1] if swapped else fact
                    if all(not is_variable(t) or new.setdefault(t, v) == v for t, v in zip(atom.terms(), values)):
                        found.append(new)
        rows = found
    return rows


def closure(facts: set[Fact], rules: list[tuple[Atom, tuple[Atom, ...]]], most: int) -> tuple[Facts, int]:
    """Semi-naive fixpoint; raises ``TooLarge`` beyond ``most`` statements."""
    total, delta, rounds = Facts(facts), Facts(facts), 0
    while delta.all:
        new = Facts()
        fresh = {p for _, p, _ in delta.all}
        for head, body in rules:
            for i in range(len(body)):
                if body[i].p not in fresh:
                    continue
                for row in solutions(body, [delta if j == i else total for j in range(len(body))]):
                    f = tuple(row[t] if is_variable(t) else t for t in head.terms())
                    if f not in total.all:
                        new.add(f)
                if len(total.all) + len(new.all) > most:
                    raise TooLarge
        for f in new.all:
            total.add(f)
        delta = new
        rounds += 1
    return total, rounds
