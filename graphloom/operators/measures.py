"""Counting operators: statistics, degree ranks, search, dossiers, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, checkpointed, union

LIMIT, MOST = 20, 1000


def check_limit(limit: int) -> int:
    if not 1 <= limit <= MOST:
        raise ValueError(f"limit must be between 1 and {MOST}")
    return limit


def stats(g: Graph) -> DataFrame:
    """(relation, kind, n): node and edge counts per kind, and totals with kind '*'."""
    def of(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(F.lit(name).alias("relation"), "kind").agg(F.count(F.lit(1)).alias("n"))

    per = union([of(g.nodes, "nodes"), of(g.edges, "edges")])
    total = union([d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(r).alias("relation"), F.lit("*").alias("kind"), "n") for r, d in (("nodes", g.nodes), ("edges", g.edges))])
    return per.unionByName(total)


def degree(g: Graph, end: str) -> DataFrame:
    """(id, value): non-containment edges by dst (fan_in) or src (fan_out); no zeros, no boundary nodes."""
    counts = g.plain().groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("value"))
    return g.real().select("id").join(counts, "id")


def fan_in(g: Graph) -> DataFrame:
    return degree(g, "dst")


def fan_out(g: Graph) -> DataFrame:
    return degree(g, "src")


def complexity(g: Graph) -> DataFrame:
    """(id, value): decisions + 1 where decisions were measured."""
    return g.real().where("decisions is not null").select("id", (F.col("decisions").cast("long") + 1).alias("value"))


def size_lines(g: Graph) -> DataFrame:
    at, end = F.col("loc.line"), F.col("end_line")
    return g.nodes.select("id", F.when(end >= at, (end - at + 1).cast("long")).alias("value"))


def measure(name: str) -> Column:
    """A node's measure: reserved fields first, then its map; null where not measured."""
    reserved = {"decisions": F.col("decisions").cast("double"), "complexity": (F.col("decisions") + 1).cast("double")}
    return reserved.get(name, F.col("measures")[name].cast("double"))


def top(ranking: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Largest values first, ties by id."""
    return ranking.orderBy(F.col("value").desc(), "id").limit(check_limit(limit))


def search(g: Graph, query: str, limit: int = LIMIT) -> DataFrame:
    """(id, kind, label, match): exact label 0, label prefix 1, in the label 2, in the id 3."""
    q = query.strip().lower()
    label, id = F.lower("label"), F.lower("id")
    match = F.when(label == q, 0).when(label.startswith(q), 1).when(label.contains(q), 2).when(id.contains(q), 3)
    hits = g.nodes.select("id", "kind", "label", match.alias("match"), g.profile.rank_of(F.col("kind")).alias("_rank"))
    hits = hits.where(F.col("match").isNotNull() & F.lit(bool(q)))
    return hits.orderBy("match", "_rank", "id").limit(check_limit(limit)).drop("_rank")


def dossier(g: Graph, id: str) -> DataFrame:
    """(direction, kind, n, others): a node's edges by kind, the other ends in order."""
    out = g.plain().where(F.col("src") == id).select(F.lit("outgoing").alias("direction"), "kind", F.col("dst").alias("other"), "line")
    into = g.plain().where(F.col("dst") == id).select(F.lit("incoming").alias("direction"), "kind", F.col("src").alias("other"), "line")
    both = out.unionByName(into).groupBy("direction", "kind")
    return both.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("other", "line"))).alias("others"))


def neighborhood(g: Graph, id: str, depth: int = 1) -> DataFrame:
    """(id, level): nodes within depth steps over non-containment edges in either direction."""
    e = g.plain().select("src", "dst")
    seen = front = checkpointed(g.nodes.where(F.col("id") == id).select("id", F.lit(0).alias("level")))
    for level in range(1, depth + 1):
        ids = front.select("id")
        out = e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
        into = e.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
        front = checkpointed(out.union(into).distinct().join(seen, "id", "left_anti").withColumn("level", F.lit(level)))
        seen = seen.unionByName(front)
    return seen


def induced(g: Graph, ids: DataFrame) -> DataFrame:
    """Non-containment edges with both ends among ids(id)."""
    a, b = ids.select(F.col("id").alias("src")), ids.select(F.col("id").alias("dst"))
    return g.plain().join(a, "src", "left_semi").join(b, "dst", "left_semi").select("src", "dst", "kind", "line")


def graph_class(g: Graph) -> DataFrame:
    """(class, n): edges per provenance class."""
    return g.edges.groupBy(g.profile.provenance_class(F.col("kind")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def unresolved(g: Graph) -> DataFrame:
    """(id, value): incident edges whose other end is of kind external; a self edge counts once."""
    # Written first: where it is small it is sent to the edges, not the edges shuffled to meet it.
    ext = checkpointed(g.nodes.where("kind = 'external'").select("id"))
    out = g.edges.join(ext.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("o"))
    into = g.edges.where("src <> dst").join(ext.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"), F.col("src").alias("o"))
    return out.union(into).groupBy("id").agg(F.count(F.lit(1)).alias("value"))
