"""Connected components over a table of links, in rounds of written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(a, b); root is the component's smallest node.

    Each round takes the smallest label among a node's neighbours, then the
    label of that label, so paths shrink by halves. Nothing but the number of
    changed labels comes to the driver; each round's labels are a written table.
    """
    spark = links.sparkSession
    edges, labels = Scratch(spark), Scratch(spark)
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
    e = edges.keep(both.where("a <> b").distinct(), "links")
    now = labels.keep(e.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).withColumnRenamed("a", "node"), "labels")
    while True:
        heard = e.join(now.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("_heard"))
        step = now.join(heard.withColumnRenamed("a", "node"), "node", "left").select("node", F.col("root").alias("_old"), F.least("root", "_heard").alias("_new"))
        jump = now.select(F.col("node").alias("_new"), F.col("root").alias("_far"))
        step = step.join(jump, "_new", "left").select("node", "_old", F.least("_new", "_far").alias("root"))
        after = labels.keep(step, "labels")
        labels.drop(1)
        if after.where("root <> _old").isEmpty():
            edges.drop()
            return after.select("node", "root")
        now = after.select("node", "root")
