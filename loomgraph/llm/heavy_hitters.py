"""The most frequent values of columns with billions of rows."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """``(val, n)`` of the non-null values: an exact spillable aggregation.

    Each task combines its rows into a bounded hash table of partial counts and
    falls back to an external sort when that is full, so memory is bounded
    however many values there are, and a value with a third of all rows is
    shuffled as one partial count a task.
    """
    return (
        df.select(F.col(column).alias("val"))
        .where(F.col("val").isNotNull())
        .groupBy("val")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def top_k(df: DataFrame, column: str, k: int) -> DataFrame:
    """``(val, n)``: the ``k`` most frequent non-null values, ties by smaller value.

    The ordered limit runs as a local top-k in every hash partition and one
    final merge of those short lists.  Nulls do not count, repeated rows count
    each time, an empty table or one of nulls only gives no rows, fewer than
    ``k`` distinct values give all of them.  Other columns are not read.
    """
    return value_counts(df, column).orderBy(F.desc("n"), F.asc("val")).limit(k)


def frequent_values(df: DataFrame, columns: list[str], share: str) -> DataFrame:
    """``(field_name, val, n)``: values in at least ``share`` (a decimal text) of the
    rows in which their column is not null.

    At most ``floor(1 / share)`` values can reach the share, so the top-k of
    that length holds all of them whatever the data; the threshold is then
    compared in whole numbers.  The totals are one pass with one result row.
    """
    f = Fraction(share)
    k = f.denominator // f.numerator
    totals = df.select(*[F.count(c).alias(f"t{i}") for i, c in enumerate(columns)]).first()
    out = None
    for i, c in enumerate(columns):
        part = top_k(df, c, k).where(F.col("n") * F.lit(f.denominator) >= F.lit(f.numerator * totals[f"t{i}"]))
        part = part.select(F.lit(c).alias("field_name"), "val", "n")
        out = part if out is None else out.unionByName(part)
    return out
