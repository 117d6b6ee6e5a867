"""Change history: hotspots and files that change together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _known(transactions: DataFrame, functions: DataFrame) -> DataFrame:
    return transactions.select("tx_id", "file").distinct().join(functions.select("file").distinct(), "file", "left_semi")


def transaction_count(transactions: DataFrame, functions: DataFrame) -> DataFrame:
    return _known(transactions, functions).agg(F.count_distinct("tx_id").alias("transactions"))


def hotspots(transactions: DataFrame, functions: DataFrame) -> DataFrame:
    """(file, changes, complexity, score): complexity is null unless all of a file's functions were measured."""
    changes = _known(transactions, functions).groupBy("file").agg(F.count(F.lit(1)).alias("changes"))
    whole = F.when(F.count("decisions") == F.count(F.lit(1)), F.sum(F.col("decisions").cast("long") + 1))
    cx = functions.groupBy("file").agg(whole.alias("complexity"))
    return changes.join(cx, "file", "left").withColumn("score", F.col("changes") * F.col("complexity"))


def change_coupling(transactions: DataFrame, functions: DataFrame, min_support: int = 1) -> DataFrame:
    """(a, b, support, either, confidence) of files that changed in one transaction.

    Files with fewer changes than the support asked for cannot be in a pair and
    are dropped first; pairs of a transaction are built once each.
    """
    least = max(1, min_support)
    t = _known(transactions, functions)
    n = t.groupBy("file").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    t = t.join(n.select("file"), "file", "left_semi")
    a, b = t.select("tx_id", F.col("file").alias("a")), t.select("tx_id", F.col("file").alias("b"))
    pairs = a.join(b, "tx_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= least)
    pairs = pairs.join(n.select(F.col("file").alias("a"), F.col("n").alias("_a")), "a").join(n.select(F.col("file").alias("b"), F.col("n").alias("_b")), "b")
    either = F.col("_a") + F.col("_b") - F.col("support")
    return pairs.select("a", "b", "support", either.alias("either"), (F.col("support") / either).alias("confidence"))
