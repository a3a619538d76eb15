"""A triple store as Parquet clustered by predicate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.scan import IN_LIST, complete
from loomgraph.workspace import Workspace

#: With more predicates than this they are no folders: files are sorted by predicate instead.
MOST_FOLDERS = 2_000
#: Nor are they where there are fewer rows than this for each: a file of a few rows costs more to write than it saves.
FOLDER_ROWS = 100_000
ORDERS = ("pso", "pos")


def _fs(spark: SparkSession, path: str):
    """The path's file system and the path, as Hadoop's objects."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _write(rows: DataFrame, path: str, order: str, folders: bool, mode: str) -> None:
    out = rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode)
    (out.partitionBy("p") if folders else out).parquet(path)


def _fits(predicates: int, rows: int) -> bool:
    """Whether predicates are to be folders.  Without rows there would be no file, and so no columns to read."""
    return 0 < predicates <= MOST_FOLDERS and rows >= FOLDER_ROWS * predicates


def _folders_fit(rows: DataFrame) -> bool:
    each = rows.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    found = each.agg(F.count(F.lit(1)).alias("predicates"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    return _fits(found["predicates"], found["rows"])


def write_store(triples: DataFrame, path: str, by_object: bool = True) -> None:
    """Writes the distinct statements, once in (p, s, o) order and once in (p, o, s).

    Rows are range-partitioned by the order's columns, so a predicate with most
    rows is spread over many files, and each file's row groups have narrow
    statistics.  Both copies let Spark prune folders or row groups whichever
    terms a pattern fixes.  The statements are made distinct once: the second
    copy is made of the first.
    """
    rows = complete(triples)
    folders = _folders_fit(rows)
    for order in ORDERS:
        fs, old = _fs(triples.sparkSession, f"{path}/_{order}-old")
        fs.delete(old, True)  # of a store that is overwritten
    _write(rows.distinct(), f"{path}/pso", "pso", folders, "overwrite")
    if by_object:
        _write(read_store(triples.sparkSession, path), f"{path}/pos", "pos", folders, "overwrite")


def read_store(spark: SparkSession, path: str, order: str = "pso") -> DataFrame:
    """The store's statements; ``pos`` is the copy to take where the object is fixed and the subject is not."""
    return spark.read.parquet(f"{path}/{order}").select(F.col("s"), F.col("p").cast("bigint"), F.col("o"))


def scan_store(spark: SparkSession, path: str, s=None, p=None, o=None) -> DataFrame:
    """A pattern scan over the copy whose order fits the fixed terms."""
    from loomgraph.operators.scan import scan

    return scan(read_store(spark, path, "pos" if o is not None and s is None else "pso"), s, p, o, once=True)


def _copies(spark: SparkSession, path: str) -> dict[str, set[int] | None]:
    """The orders that there are, and the predicates that are folders, or None where none are."""
    out = {}
    for order in ORDERS:
        fs, target = _fs(spark, f"{path}/{order}")
        old = _fs(spark, f"{path}/_{order}-old")[1]
        if not fs.exists(target) and fs.exists(old):
            fs.rename(old, target)  # the exchange of old and new files was cut short
        if fs.exists(target):
            names = [x.getPath().getName() for x in fs.listStatus(target)]
            out[order] = {int(n[2:]) for n in names if n.startswith("p=")} or None
    return out


def _replace(spark: SparkSession, path: str, order: str, rows: DataFrame, folders: bool) -> None:
    """Puts a copy made of ``rows`` in the place of the one there, which can be read meanwhile and is kept until then."""
    fresh, old = f"{path}/_{order}-new", f"{path}/_{order}-old"
    _write(rows, fresh, order, folders, "overwrite")
    fs, target = _fs(spark, f"{path}/{order}")
    fs.delete(_fs(spark, old)[1], True)
    fs.rename(target, _fs(spark, old)[1])
    fs.rename(_fs(spark, fresh)[1], target)
    fs.delete(_fs(spark, old)[1], True)


def insert(spark: SparkSession, path: str, new: DataFrame) -> int:
    """Adds to each copy the statements that it has not yet; returns how many the first lacked.

    Each copy is held against itself, so an insert that failed between two
    copies, or within one, is completed by running it again.  Only the
    predicates of the new rows are read to look for repetitions.  Where
    predicates are folders and new ones would be too many or too small for
    that, the copy is written again without folders.
    """
    ws = Workspace(spark, "insert")
    rows = ws.save(complete(new).distinct(), "rows")
    found = {r["p"] for r in rows.select("p").distinct().limit(max(IN_LIST, MOST_FOLDERS) + 1).collect()}
    added = []
    for order, folders in _copies(spark, path).items():
        every = read_store(spark, path, order)
        stored = every.where(F.col("p").isin(found)) if len(found) <= IN_LIST else every
        fresh, n = ws.save_counted(rows.join(stored, ["s", "p", "o"], "left_anti").select("s", "p", "o"), "fresh")
        if n and folders and not found <= folders and not _fits(len(found | folders), every.count() + n):
            _replace(spark, path, order, every.unionByName(fresh), False)
        elif n:
            _write(fresh, f"{path}/{order}", order, bool(folders), "append")
        added.append(n)
        ws.drop(fresh)
    ws.drop(rows)
    return added[0] if added else 0


def compact(spark: SparkSession, path: str) -> None:
    """Rewrites each copy in its order, as many small inserts leave many small and overlapping files.

    The new files are complete before they take the place of the old ones,
    which are kept beside them until then.  Whether predicates are folders is
    decided anew.
    """
    for order in _copies(spark, path):
        rows = read_store(spark, path, order)
        _replace(spark, path, order, rows.distinct(), _folders_fit(rows))


def write_subsets(closed: DataFrame, path: str) -> dict[str, int]:
    """Writes each named subset of a closed schema below its own folder; returns their sizes.

    A schema that was closed once is read back with ``read_subsets`` and needs no closing again.
    """
    from loomgraph.terms import SUBSETS

    name = F.lit(None).cast("string")
    for k, (p, o) in SUBSETS.items():
        fits = (F.col("p") == p) if o is None else (F.col("p") == p) & (F.col("o") == o)
        name = F.when(fits, k).otherwise(name)
    rows = complete(closed).distinct().withColumn("subset", name).where("subset IS NOT NULL")
    rows.repartitionByRange("subset", "s").sortWithinPartitions("subset", "s", "o").write.mode("overwrite").partitionBy("subset").parquet(path)
    return {r["subset"]: r["n"] for r in closed.sparkSession.read.parquet(path).groupBy("subset").agg(F.count(F.lit(1)).alias("n")).collect()}


def read_subsets(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """The statements of the named subsets, or of all, read from their folders only."""
    rows = spark.read.parquet(path)
    if names:
        rows = rows.where(F.col("subset").isin(list(names)))
    return rows.select("s", "p", "o", "subset")
