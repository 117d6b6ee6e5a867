"""Differences between two graphs, and the diagnosis of hotspots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, checkpointed, union
from .closure import _reversed, closure, sizes
from .measures import neighborhood, unresolved


def _plain(df: DataFrame, c: str):
    """A column that can be compared: maps have no order and become text."""
    kind = df.schema[c].dataType.typeName()
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c)))) if kind == "map" else F.col(c)


def diff_nodes(before: Graph, after: Graph) -> DataFrame:
    """(id, change): added, removed or changed in any field that both graphs have."""
    cols = sorted((set(before.nodes.columns) & set(after.nodes.columns)) - {"id"})
    a = before.nodes.select("id", *[_plain(before.nodes, c).alias(f"a_{c}") for c in cols], F.lit(1).alias("_a"))
    b = after.nodes.select("id", *[_plain(after.nodes, c).alias(f"b_{c}") for c in cols], F.lit(1).alias("_b"))
    differ = reduce(lambda x, y: x | y, [~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in cols], F.lit(False))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(differ, "changed")
    return a.join(b, "id", "full_outer").select("id", change.alias("change")).where("change is not null")


def diff_edges(before: Graph, after: Graph) -> DataFrame:
    """(src, dst, kind, line, change) over whole edge records."""
    cols = ["src", "dst", "kind", "line"]
    a = before.edges.select(*cols, _plain(before.edges, "attrs").alias("attrs"), F.lit(1).alias("n"))
    b = after.edges.select(*cols, _plain(after.edges, "attrs").alias("attrs"), F.lit(-1).alias("n"))
    both = a.union(b).groupBy(*cols, "attrs").agg(F.sum("n").alias("n")).where("n <> 0")
    return both.select(*cols, F.when(F.col("n") > 0, "removed").otherwise("added").alias("change"))


def impact(before: Graph, after: Graph) -> DataFrame:
    """(id, before, after, delta): blast radii of the nodes that differ or touch an edge that does."""
    nodes, edges = diff_nodes(before, after).select("id"), diff_edges(before, after)
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    seeds = checkpointed(nodes.union(ends).distinct().withColumnRenamed("id", "seed"))
    of = lambda g, name: sizes(_reversed(g.links("breakage")), seeds).withColumnRenamed("n", name)
    out = seeds.join(of(before, "before"), "seed", "left").join(of(after, "after"), "seed", "left").na.fill(0)
    return out.select(F.col("seed").alias("id"), "before", "after", (F.col("after") - F.col("before")).alias("delta"))


def answer(before: Graph, after: Graph) -> dict:
    """The whole difference: records added, removed and changed, each list in order, and what it does to blast radii, largest first."""
    change = checkpointed(diff_nodes(before, after))
    of = lambda kind: change.where(F.col("change") == kind).select("id")
    edges = checkpointed(diff_edges(before, after))
    line = [F.col(c).asc_nulls_first() for c in ("src", "dst", "kind", "line")]
    changed = before.nodes.join(of("changed"), "id").select("id", F.struct(*before.nodes.columns).alias("before"))
    changed = changed.join(after.nodes.join(of("changed"), "id").select("id", F.struct(*after.nodes.columns).alias("after")), "id")
    return {
        "nodes_added": after.nodes.join(of("added"), "id", "left_semi").orderBy("id"), "nodes_removed": before.nodes.join(of("removed"), "id", "left_semi").orderBy("id"), "nodes_changed": changed.orderBy("id"),
        "edges_added": edges.where("change = 'added'").drop("change").orderBy(*line), "edges_removed": edges.where("change = 'removed'").drop("change").orderBy(*line),
        "impact": impact(before, after).orderBy(F.abs("delta").desc(), "id"),
    }


def fails_above(found: DataFrame, most: int) -> bool:
    """Whether any blast radius of impact grows by more than that."""
    return not found.where(F.col("delta") > most).isEmpty()


def report(found: DataFrame, top: int = 10) -> str:
    """The largest changes of impact as a table of text, ties by id."""
    rows = found.orderBy(F.abs("delta").desc(), "id").limit(top).collect()
    lines = ["| id | before | after | delta |", "|---|---|---|---|"]
    return "\n".join(lines + [f"| {r['id']} | {r['before']} | {r['after']} | {r['delta']:+d} |" for r in rows])


def diagnose(g: Graph, ranking: DataFrame | None, id: str, diagnostics: DataFrame | None = None) -> DataFrame:
    """One row: rank and value in the whole ranking(id, value), blast size, neighbours at depth 1, unresolved references.

    Rank and value are null for a node that the ranking leaves out, or without a ranking.
    """
    value = ahead = None
    if ranking is not None:
        ranking = checkpointed(ranking.select("id", "value"))
        value = ranking.where(F.col("id") == id).select("value").first()
    if value is not None:
        first = (F.col("value") > value[0]) | ((F.col("value") == value[0]) & (F.col("id") < id))
        ahead = ranking.where(first).count() + 1
    blast = closure(_reversed(g.links("breakage")), g.spark.createDataFrame([(id,)], "seed string")).count()
    near = neighborhood(g, id).where("level > 0").count()
    loose = unresolved(g).where(F.col("id") == id).first()
    found = {} if diagnostics is None else {r["kind"]: r["count"] for r in diagnostics.groupBy("kind").count().collect()}
    row = (id, ahead, None if value is None else float(value[0]), blast, near, loose["value"] if loose else 0, found)
    return g.spark.createDataFrame([row], "id string, rank long, value double, blast long, neighbors long, unresolved long, diagnostics map<string,long>")


def changed_kinds(before: Graph, after: Graph) -> DataFrame:
    """(relation, change, n)."""
    n = diff_nodes(before, after).groupBy(F.lit("nodes").alias("relation"), "change").count()
    e = diff_edges(before, after).groupBy(F.lit("edges").alias("relation"), "change").count()
    return union([n, e]).withColumnRenamed("count", "n")
