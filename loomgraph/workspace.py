"""Intermediate tables of iterative operators, written to the cluster's shared folder.

Iterative plans are cut by writing each round's table as Parquet below
``spark.checkpoint.dir``.  Written tables survive the loss of any executor and,
unlike a checkpointed RDD, are compressed and carry sizes for the planner.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections import deque

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset and all executors run in this process (local tests) a
    folder of our own is made, and removed again when the process ends.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="loomgraph-")
        atexit.register(shutil.rmtree, _OWN_DIRS[app], ignore_errors=True)
    return "file://" + _OWN_DIRS[app]


def session_dir(spark: SparkSession) -> str:
    """The part of the shared folder that holds this application's tables."""
    return f"{shared_dir(spark)}/loomgraph/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application; results not yet read are lost with them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_READS = {"LogicalRelation", "LogicalRDD", "LocalRelation", "Project", "Filter", "Union", "SubqueryAlias", "Range"}


def is_scan(df: DataFrame) -> bool:
    """Whether a plan only reads and filters: reading it again costs no shuffle."""
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() not in _READS:
            return False
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return True


class Workspace:
    """Tables of one operator run.

    ``save`` materialises a DataFrame and returns it read back from the shared
    folder; ``drop`` deletes a table no later plan reads any more.
    """

    #: ``(operator, table, rows)`` of the last counted tables of all runs
    counts: deque[tuple[str, str, int]] = deque(maxlen=10_000)

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.name = name
        self.root = f"{session_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._count = 0

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = f"{self.root}/{name}-{self._count}"
        self._count += 1
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._loomgraph_path = path
        return out

    def save_counted(self, df: DataFrame, name: str = "t", which: Column | None = None) -> tuple[DataFrame, int]:
        """``save`` and the number of rows, or of those that fit ``which``, counted while they are written."""
        seen = Observation()
        counted = F.count(F.lit(1)) if which is None else F.count_if(which)
        out = self.save(df.observe(seen, counted.alias("n")), name)
        n = seen.get["n"]
        Workspace.counts.append((self.name, name, n))
        return out, n

    def settled(self, df: DataFrame, name: str = "base") -> DataFrame:
        """A plan that is read several times: itself if it is a scan, else written once."""
        return df if is_scan(df) else self.save(df, name)

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            path = getattr(t, "_loomgraph_path", None)
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)
