"""Triple pattern scans and conjunctive joins over triples."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.rules import Atom, is_variable

#: Value lists up to this length become filters that reach the Parquet scan; longer ones are joined.
IN_LIST = 500

TermSet = int | Iterable[int] | DataFrame | None


def complete(triples: DataFrame) -> DataFrame:
    """The statements: rows with all three terms, and nothing else."""
    return triples.select("s", "p", "o").where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL")


def scan(triples: DataFrame, s: TermSet = None, p: TermSet = None, o: TermSet = None, once: bool = False) -> DataFrame:
    """The distinct statements that fit; a term is an id, a set of ids (list or
    one-column DataFrame) or None for any.

    Ids and short lists are pushed to the Parquet scan; longer lists and
    DataFrames become semi-joins, whose side Spark broadcasts if it is small.
    Any number of the three terms may be sets.  With ``once`` the statements are
    known to be distinct, and nothing is shuffled to make them so.
    """
    out = complete(triples)
    for column, term in (("s", s), ("p", p), ("o", o)):
        if term is None:
            continue
        if isinstance(term, DataFrame):
            out = out.join(term.toDF(column).distinct(), column, "left_semi")
        elif isinstance(term, int):
            out = out.where(F.col(column) == term)
        else:
            values = sorted(set(term))
            if len(values) <= IN_LIST:
                out = out.where(F.col(column).isin(values))
            else:
                members = triples.sparkSession.createDataFrame([(v,) for v in values], f"{column} bigint")
                out = out.join(members, column, "left_semi")
    out = out.select("s", "p", "o")
    return out if once else out.distinct()


def name(variable: str) -> str:
    return variable.lstrip("?").replace("+", "x")


def bindings(triples: DataFrame, atom: Atom, known: dict[str, list[int]] | None = None) -> DataFrame:
    """The atom's variables for every statement that fits it.

    A variable used twice must have equal values.  ``known`` gives short lists
    of the values some variables can have, which are pushed down as filters.
    """
    out = triples
    if atom.symmetric:
        out = out.select("s", "p", "o").union(out.select(F.col("o"), "p", F.col("s")))
    seen: dict[str, str] = {}
    for column, term in zip("spo", atom.terms()):
        if not is_variable(term):
            out = out.where(F.col(column) == term)
        elif term in seen:
            out = out.where(F.col(column) == F.col(seen[term]))
        else:
            seen[term] = column
            values = (known or {}).get(term)
            if values is not None and len(values) <= IN_LIST:
                out = out.where(F.col(column).isin(values))
    return out.select(*[F.col(c).alias(name(v)) for v, c in seen.items()])


def connected_order(atoms: list[Atom], bound: Iterable[str] = (), rank: dict[int, tuple] | None = None) -> list[int]:
    """An order of the atoms in which each next one shares the most variables with those before.

    ``rank`` breaks ties and picks the first; ``bound`` variables count half.
    """
    left = list(range(len(atoms)))
    joined: set[str] = set()
    bound = set(bound)
    out: list[int] = []
    while left:

        def key(i: int):
            own = atoms[i].variables()
            return (-sum(v in joined for v in own), -sum(v in bound for v in own) if not out else 0, (rank or {}).get(i, ()), i)

        best = min(left, key=key)
        left.remove(best)
        out.append(best)
        joined.update(atoms[best].variables())
    return out


def natural_join(left: DataFrame | None, right: DataFrame, allow_cross: bool = False) -> DataFrame:
    """Inner equi-join on the columns of the same name; without any it is refused."""
    if left is None:
        return right
    keys = [c for c in left.columns if c in right.columns]
    if keys:
        return left.join(right, keys)
    if not allow_cross:
        raise ValueError("the patterns share no variable: a Cartesian product is not allowed")
    return left.crossJoin(right)


def head_rows(rows: DataFrame, head: Atom) -> DataFrame:
    def column(t) -> Column:
        return F.col(name(t)) if is_variable(t) else F.lit(t).cast("bigint")

    return rows.select(*[column(t).alias(c) for c, t in zip("spo", head.terms())])
