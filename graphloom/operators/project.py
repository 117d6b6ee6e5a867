"""The analytics projection: non-boundary nodes and simple links between them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph


@dataclass(frozen=True)
class Projection:
    nodes: DataFrame  # id
    links: DataFrame  # src, dst: distinct, no self links
    pairs: DataFrame  # a < b, weight: recorded edges between them


def projection(g: Graph) -> Projection:
    nodes = g.real().select("id")
    e = g.edges.where(g.profile.is_in("dependency")).where("src <> dst").select("src", "dst")
    e = e.join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")
    pairs = e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count(F.lit(1)).alias("weight"))
    return Projection(nodes, e.distinct(), pairs)
