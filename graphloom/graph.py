"""A graph: nodes(id, kind, label, ...), edges(src, dst, kind, line, attrs) and its profile."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import time
import uuid
import weakref
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .profile import CODE, Profile

#: Edges up to which a graph is walked by kernels that hold its links in memory.
KERNEL_EDGES = 2_000_000


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    profile: Profile = CODE

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def real(self) -> DataFrame:
        """Nodes without the boundary."""
        return self.nodes.where(~self.profile.is_boundary(F.col("kind"), F.col("id")))

    def plain(self) -> DataFrame:
        """Edges without containment."""
        return self.edges.where(~self.profile.is_in("containment"))

    def links(self, name: str) -> DataFrame:
        """(src, dst), distinct, of the edges whose kind is in the profile's set of that name."""
        return self.edges.where(self.profile.is_in(name)).select("src", "dst").distinct()

    def has(self, id: str) -> bool:
        return not self.nodes.where(F.col("id") == id).isEmpty()


def parent(id: Column) -> Column:
    """The id without its last segment."""
    return F.regexp_replace(id, "::[^:]+$", "")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; where none is named a local one on a local master (tests), else none."""
    sc = spark.sparkContext
    if not (sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)):
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
    return (sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")).rstrip("/")


#: The tables of this process: their folders by the frame that reads them.
_TABLES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_MADE: set[str] = set()
#: Seconds between two calls of the collectors, and when the last was.
FREE_EVERY = 5.0
_freed = 0.0


def freed(spark: SparkSession, every: float = 0.0) -> None:
    """Shuffle files of finished stages go once both collectors have run; nothing where that was less than so many seconds ago."""
    global _freed
    if time.monotonic() - _freed >= every:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _freed = time.monotonic()


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _MADE.discard(path)


def _leave(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may have gone first
        for path in list(_MADE):
            _remove(spark, path)


def checkpointed(df: DataFrame, by: str | None = None) -> DataFrame:
    """Cuts the lineage of an iteration: df as a compressed table in the shared folder, read again; it goes with `dropped` or the process.

    With `by`, the last column, each of its values has a folder, so that a filter on it reads no other.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/graphloom/{uuid.uuid4().hex[:12]}"
    if not _MADE:
        atexit.register(_leave, spark)
    _MADE.add(path)
    to = df.write.option("compression", "zstd")
    (to.partitionBy(by) if by else to).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _TABLES[out] = path
    freed(spark, FREE_EVERY)
    return out


def is_table(df: DataFrame) -> bool:
    """Whether df is what `checkpointed` gave, so that it need not be written again to be read often."""
    return df in _TABLES


def dropped(*frames: DataFrame) -> None:
    """Removes what `checkpointed` wrote for these frames; nothing unread may be built on them."""
    for df in frames:
        if df in _TABLES:
            _remove(df.sparkSession, _TABLES.pop(df))


def dealt(df: DataFrame, by: str) -> DataFrame:
    """Rows over as many tasks as a shuffle has, whatever their size: few bytes can mean much work, and a count that is given is not lessened."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), by)


def bounded_links(links: DataFrame, most: int = KERNEL_EDGES):
    """(ids in order, src, dst) with the ends as places in ids, if there are at most `most` links, else None.

    The bound is checked before they travel; names come as Arrow columns and
    leave as one array, links as two arrays of numbers.
    """
    import numpy as np
    import pandas as pd

    if links.limit(most + 1).count() > most:
        return None
    t = links.select("src", "dst").toPandas()
    ids = np.array(sorted(set(t["src"]) | set(t["dst"])), dtype=object)
    of = pd.Index(ids)
    return ids, of.get_indexer(t["src"]).astype(np.int64), of.get_indexer(t["dst"]).astype(np.int64)


def running(df: DataFrame, order: list[Column | str], value: Column, name: str) -> DataFrame:
    """df with the sum of value over all rows up to each one, in a total order.

    Rows are dealt by ranges of the order; only one sum per range is ordered in
    a single task.
    """
    d = checkpointed(df.repartitionByRange(*order).withColumns({"_pid": F.spark_partition_id(), "_v": value}))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    off = d.groupBy("_pid").agg(F.sum("_v").alias("_s")).select("_pid", F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_off"))
    inside = F.sum("_v").over(Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return d.join(F.broadcast(off), "_pid").withColumn(name, (inside + F.col("_off")).cast("long")).drop("_pid", "_v", "_off")


def numbered(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """df with each row's place from 0 in a total order."""
    return running(df, order, F.lit(1), name).withColumn(name, F.col(name) - 1)
