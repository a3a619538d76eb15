"""Per-key results where a few keys hold most rows."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyed_statistics(df: DataFrame, key: str, distinct: str, latest: str) -> DataFrame:
    """``(val, n_rows, n_distinct, latest)`` for every non-null value of ``key``.

    Two algebraic steps, both combined on the map side into bounded hash tables
    that fall back to spilling sorts.  The first groups by ``(key, distinct)``,
    so a key with a third of all rows is spread over all tasks by its partner
    column and at most one compact partial state per distinct pair is shuffled.
    The second merges those states per key, again after a map-side combine, so
    a hot key reaches its reducer as one partial row per task.

    Rows with a null key do not count.  A null ``distinct`` counts as a row but
    not as a value; a null ``latest`` is ignored, and a key whose ``latest`` are
    all null has null.  Repeated rows count each time.  An empty table gives no
    rows.  Other columns, whatever their names, are not read.
    """
    partial = (
        df.select(F.col(key).alias("val"), F.col(distinct).alias("__d"), F.col(latest).alias("__t"))
        .where(F.col("val").isNotNull())
        .groupBy("val", "__d")
        .agg(F.count(F.lit(1)).alias("__n"), F.max("__t").alias("__t"))
    )
    return partial.groupBy("val").agg(
        F.sum("__n").alias("n_rows"), F.count("__d").alias("n_distinct"), F.max("__t").alias("latest")
    )


def at_least_share(n: Column, total: int, share: str) -> Column:
    """``n >= share * total`` in whole numbers; ``share`` is a decimal text."""
    f = Fraction(share)
    return n * F.lit(f.denominator) >= F.lit(f.numerator * total)


def heavy_keys(df: DataFrame, keys: list[str], share: str = "0.01") -> DataFrame:
    """``(field_name, val, n_rows)``: the keys with at least ``share`` (a decimal text) of the
    rows in which their column is not null, the ids responsible for the imbalance.

    Rows are counted per key in each task's bounded hash table before anything
    is shuffled, so a hot key is one compact count a task.  The totals are one
    pass with one result row.  An empty table gives no rows.
    """
    totals = df.select(*[F.count(c).alias(f"t{i}") for i, c in enumerate(keys)]).first()
    out = None
    for i, c in enumerate(keys):
        counts = df.select(F.col(c).alias("val")).where(F.col("val").isNotNull()).groupBy("val").agg(F.count(F.lit(1)).alias("n_rows"))
        part = counts.where(at_least_share(F.col("n_rows"), totals[f"t{i}"], share)).select(F.lit(c).alias("field_name"), "val", "n_rows")
        out = part if out is None else out.unionByName(part)
    return out


def heavy_statistics(df: DataFrame, keys: list[str], distinct: str, latest: str, share: str = "0.01") -> DataFrame:
    """``field_name`` and the columns of ``keyed_statistics`` for the ``heavy_keys`` only: at most ``1 / share`` a column,
    so that the other rows are left out before they are grouped."""
    heavy, out = heavy_keys(df, keys, share).collect(), None
    for c in keys:
        own = [r["val"] for r in heavy if r["field_name"] == c]
        part = keyed_statistics(df.where(F.col(c).isin(own)), c, distinct, latest).select(F.lit(c).alias("field_name"), "*")
        out = part if out is None else out.unionByName(part)
    return out
