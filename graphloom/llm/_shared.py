"""Tables in the folder that driver and executors share, and distributed ranks."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD_GAP = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is set there is a local one on a local master (tests), else none."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/graphloom/{uuid.uuid4().hex[:12]}-{name}"


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


#: Tables that this process has written for itself and not removed, in order.
_MADE: list[str] = []


def _write(df: DataFrame, name: str) -> str:
    path = fresh_path(df.sparkSession, name)
    if not _MADE:
        atexit.register(_leave, df.sparkSession)
    _MADE.append(path)
    df.write.parquet(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, read again."""
    return _read(df.sparkSession, _write(df, name), df.schema)


#: Names in the session's catalog of those that are bucketed, by path.
_NAMED: dict[str, str] = {}


def bucketed(df: DataFrame, by: str, buckets: int, name: str) -> DataFrame:
    """Like written, for rows that stay where they are when they are joined on `by` alone: each task's rows should share its value."""
    path, table = fresh_path(df.sparkSession, name), f"graphloom_{uuid.uuid4().hex[:12]}"
    if not _MADE:
        atexit.register(_leave, df.sparkSession)
    _MADE.append(path)
    _NAMED[path] = table
    df.write.format("parquet").option("path", path).bucketBy(buckets, by).saveAsTable(table)
    return df.sparkSession.table(table)


def remove(spark: SparkSession, path: str) -> None:
    if path in _NAMED:
        spark.sql(f"DROP TABLE IF EXISTS {_NAMED.pop(path)}")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if path in _MADE:
        _MADE.remove(path)


def made() -> int:
    """How many tables of this process there are: a mark for sweep."""
    return len(_MADE)


def sweep(spark: SparkSession, since: int, *more: str) -> None:
    """Removes the tables made since the mark; results that read them must have been written."""
    for p in [*_MADE[since:], *more]:
        remove(spark, p)


def _leave(spark: SparkSession) -> None:
    """At the process's end nothing reads its tables any more."""
    with contextlib.suppress(Exception):  # the session may have gone first
        sweep(spark, 0)


def freed(spark: SparkSession) -> None:
    """Shuffle files of finished stages go once both collectors have run."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Inside, Arrow carries so many rows at once at most: for long rows, on both sides of a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def long_rows(spark: SparkSession, rows: int = 1000) -> None:
    """From now on Arrow carries so many rows at once at most in this session: what is returned unread meets Python later."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(key))
    spark.conf.set(key, str(min(rows, before) if before > 0 else rows))


class Scratch:
    """Written tables that can be removed once a later table no longer needs them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = _write(df, name)
        self.paths.append(path)
        return _read(self.spark, path, df.schema)

    def drop(self, all_but: int = 0) -> None:
        gone = self.paths[: len(self.paths) - all_but]
        for p in gone:
            remove(self.spark, p)
        self.paths = self.paths[len(gone) :]


#: A key is hot if over one row in HOT has it, so there are fewer hot keys than this.
HOT, SALTS = 1024, 16


def hot_keys(counts: DataFrame, on: list[str], n: str = "n") -> DataFrame | None:
    """The keys of counts(on, n) that over one row in HOT of those counted has; None without any. At most HOT rows, whatever the table."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    hot = counts.where((F.col(n) * HOT > total) & (F.col(n) > HOT)).select(*on).collect()
    return counts.sparkSession.createDataFrame(hot, counts.select(*on).schema) if hot else None


def spread_join(left: DataFrame, right: DataFrame, on: list[str], how: str, hot: DataFrame | None) -> DataFrame:
    """left join right where rows of a hot key are dealt to SALTS tasks, with a copy of the right side for each.

    The salt is the task that a row comes from, so a task that runs again deals
    its rows alike.
    """
    if hot is None:
        return left.join(right, on, how)
    mark = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    salt = F.when(F.col("_hot"), F.spark_partition_id() % SALTS).otherwise(0)
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    a = left.join(mark, on, "left").withColumn("_salt", salt).drop("_hot")
    b = right.join(mark, on, "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    return a.join(b, [*on, "_salt"], how).drop("_salt")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with _rank, its place from 0 in a total order, and _pid, a range of that order.

    Rows are dealt by range and only one count per range meets in a single
    task, so no task holds more than its range.
    """
    spark = df.sparkSession
    d = written(df.repartitionByRange(partitions(spark), *order).withColumn("_pid", F.spark_partition_id()), name)
    off = offsets(d, "_pid", [], F.count(F.lit(1)))
    w = Window.partitionBy("_pid").orderBy(*order)
    return d.join(F.broadcast(off), "_pid").withColumn("_rank", F.row_number().over(w) - 1 + F.col("_off")).drop("_off")


def offsets(df: DataFrame, bucket: str, within: list[str], total: Column) -> DataFrame:
    """Per (within, bucket) the sum of total over the smaller buckets: one row per bucket."""
    sums = df.groupBy(*within, bucket).agg(total.alias("_sum"))
    w = Window.partitionBy(*within).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*within, bucket, F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_off"))


def col(name: str) -> Column:
    """The column of this very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def boxed(docs: DataFrame, **more: Column) -> DataFrame:
    """Each row as one column `row`, with more columns beside it that clash with none of its own."""
    return docs.select(F.struct(*map(col, docs.columns)).alias("row"), *[c.alias(n) for n, c in more.items()])


def unboxed(df: DataFrame) -> DataFrame:
    return df.select("row.*")


def words_of(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")
