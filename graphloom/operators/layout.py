"""Deterministic layouts and their drawings."""

from __future__ import annotations

import math
from html import escape

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import KERNEL_EDGES, Graph, bounded_links, checkpointed, dropped, numbered, running, union
from .project import Projection
from .topology import components

KINDS = ("package", "module", "file", "class", "interface", "function")
FORCE_NODES, FORCE_ROUNDS, FORCE_HEAT, FORCE_CANVAS = 3000, 80, 100.0, 1000.0


def structure(g: Graph) -> Graph:
    """Packages to functions only; edges of other nodes move to their nearest container that is kept."""
    kept = g.nodes.where(F.col("kind").isin(*KINDS))
    up = g.edges.where(g.profile.is_in("containment")).groupBy(F.col("dst").alias("at")).agg(F.min("src").alias("up"))
    found = kept.select("id", F.col("id").alias("to"))
    open_ = checkpointed(g.nodes.join(kept, "id", "left_anti").select("id", F.col("id").alias("at")))
    while not open_.isEmpty():
        step = checkpointed(open_.join(up, "at").select("id", F.col("up").alias("at")))
        hit = step.join(kept.select(F.col("id").alias("at")), "at", "left_semi")
        before, found = found, checkpointed(found.union(hit.select("id", "at")))
        was, open_ = open_, checkpointed(step.join(hit.select("id"), "id", "left_anti"))
        dropped(before, was, step)
    e = g.edges.where(F.col("kind").isin("contains", "imports", "inherits", "implements"))
    e = e.join(found.toDF("src", "a"), "src").join(found.toDF("dst", "b"), "dst").where("a <> b")
    return Graph(kept, e.select(F.col("a").alias("src"), F.col("b").alias("dst"), "kind", "line", "attrs").dropDuplicates(["src", "dst", "kind"]), g.profile)


def layered(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, x, y): y is the longest way down to a component without dependencies, x the place in the row by (component, id).

    Rounds of joins: each lifts every component above what it depends on, so
    there are as many as layers.
    """
    comp = checkpointed(components(nodes, links))
    across = links.join(comp.toDF("src", "a"), "src").join(comp.toDF("dst", "b"), "dst").where("a <> b").select("a", "b").distinct()
    across = checkpointed(across)
    level = checkpointed(comp.select(F.col("component").alias("c")).distinct().withColumn("y", F.lit(0).cast("long")))
    while True:
        least = across.join(level.toDF("b", "yb"), "b").groupBy(F.col("a").alias("c")).agg((F.max("yb") + 1).alias("up"))
        step = checkpointed(level.join(least, "c", "left").select("c", F.greatest("y", F.coalesce("up", F.lit(0))).alias("y"), F.col("y").alias("old")))
        if step.where("y <> old").isEmpty():
            break
        level = step.select("c", "y")
    w = Window.partitionBy("y").orderBy("component", "id")
    return comp.join(level.withColumnRenamed("c", "component"), "component").select("id", (F.row_number().over(w) - 1).cast("long").alias("x"), "y")


def _before(df: DataFrame, within: str, value) -> DataFrame:
    """df with `off`: the sum of value over the smaller ids of the same `within`, however many these are."""
    d = running(df, [within, "id"], value, "upto").withColumn("upto", F.col("upto") - value)
    base = d.groupBy(within).agg(F.min("upto").alias("_base"))
    return d.join(base, within).withColumn("off", F.col("upto") - F.col("_base")).drop("upto", "_base")


def clustered(g: Graph) -> DataFrame:
    """(id, depth, parent, x, y): containment bands.

    A container stands at the head of its band. What it contains and contains
    nothing itself is stacked below it in id order; what contains something
    stands beside that stack, bands side by side in id order. A band is as wide
    as its stack (1) and the bands in it. Nodes that no root leads to take a
    last row in id order, without depth. Of several containers the smallest
    counts. Widths are summed from the deepest level up, places from the roots
    down: two rounds for each level.
    """
    up = g.edges.where(g.profile.is_in("containment")).join(g.nodes.select(F.col("id").alias("src")), "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
    tree = checkpointed(g.nodes.select("id").join(up, "id", "left"))
    inner = tree.where("parent is not null").select(F.col("parent").alias("id")).distinct().withColumn("inner", F.lit(True))
    tree = checkpointed(tree.join(inner, "id", "left").select("id", "parent", F.coalesce("inner", F.lit(False)).alias("inner")))
    levels, level = [], tree.where("parent is null")
    while not level.isEmpty():
        levels.append(checkpointed(level))
        level = tree.join(levels[-1].where("inner").select(F.col("id").alias("parent")), "parent", "left_semi")
    # Bottom-up: what each container's children give to its width.
    sized, below = [], None
    for d in reversed(levels):
        if below is not None:
            d = d.join(below, "id", "left")
        wide = F.greatest(F.coalesce("wide", F.lit(1)), F.lit(1)) if below is not None else F.lit(1)
        d = checkpointed(d.select("id", "parent", "inner", wide.cast("long").alias("width")))
        sized.insert(0, d)
        below = d.where("parent is not null").groupBy(F.col("parent").alias("id")).agg((F.coalesce(F.sum(F.when(F.col("inner"), F.col("width"))), F.lit(0)) + F.max((~F.col("inner")).cast("long"))).alias("wide"))
    # Top-down: the place among siblings, from the parent's.
    out, heads = [], None
    for depth, d in enumerate(sized):
        if heads is None:
            here = _before(d.withColumn("parent", F.lit("")), "parent", F.col("width"))
            here = here.select("id", F.lit(None).cast("string").alias("parent"), "inner", F.col("off").alias("x"), F.lit(0).cast("long").alias("y"))
        else:
            side = _before(d.where("inner"), "parent", F.col("width")).select("id", "parent", "inner", "off")
            stack = _before(d.where("not inner"), "parent", F.lit(1)).select("id", "parent", "inner", "off")
            leaves = stack.select("parent").distinct().withColumn("_stack", F.lit(1))
            side = side.join(heads, "parent").join(leaves, "parent", "left").select("id", "parent", "inner", (F.col("px") + F.coalesce("_stack", F.lit(0)) + F.col("off")).alias("x"), F.lit(depth).cast("long").alias("y"))
            here = side.unionByName(stack.join(heads, "parent").select("id", "parent", "inner", F.col("px").alias("x"), (F.lit(depth) + F.col("off")).cast("long").alias("y")))
        here = checkpointed(here)
        heads = here.where("inner").select(F.col("id").alias("parent"), F.col("x").alias("px"))
        out.append(here.select("id", F.lit(depth).alias("depth"), "parent", "x", "y"))
    if not out:
        return tree.select("id", F.lit(None).cast("int").alias("depth"), "parent", F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y")) if tree.isEmpty() else _last_row(tree, 0)
    placed = union(out)
    rest = checkpointed(tree.join(placed.select("id"), "id", "left_anti"))
    if rest.isEmpty():
        return placed
    return placed.unionByName(_last_row(rest, placed.agg(F.max("y")).first()[0] + 1))


def _last_row(rest: DataFrame, y: int) -> DataFrame:
    return numbered(rest, ["id"], "x").select("id", F.lit(None).cast("int").alias("depth"), "parent", "x", F.lit(y).cast("long").alias("y"))


def force(p: Projection) -> DataFrame | None:
    """(id, x, y) by spring and charge from a fixed start; beyond 3000 nodes their components; None if these are too many."""
    import numpy as np

    nodes, links = p.nodes, p.links
    if nodes.limit(FORCE_NODES + 1).count() > FORCE_NODES:
        comp = checkpointed(components(nodes, links))
        nodes = comp.select(F.col("component").alias("id")).distinct()
        if nodes.limit(FORCE_NODES + 1).count() > FORCE_NODES:
            return None
        links = links.join(comp.toDF("src", "a"), "src").join(comp.toDF("dst", "b"), "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    ids = sorted(r["id"] for r in nodes.collect())
    found = bounded_links(links, KERNEL_EDGES)
    of = {x: i for i, x in enumerate(ids)}
    n = len(ids)
    if not n:
        return p.nodes.sparkSession.createDataFrame([], "id string, x double, y double")
    if found is None:
        return None
    a = np.array([(of[s], of[d]) for s, d in zip(found[0][found[1]], found[0][found[2]])], dtype=int).reshape(-1, 2)
    turn = 2 * math.pi * np.arange(n) / n
    at = FORCE_CANVAS / 2 + FORCE_CANVAS / 3 * np.stack([np.cos(turn), np.sin(turn)], axis=1)
    k = math.sqrt(FORCE_CANVAS * FORCE_CANVAS / n)
    for i in range(FORCE_ROUNDS):
        push = np.zeros_like(at)
        for lo in range(0, n, 512):  # rows in blocks: memory grows with n, not n squared
            gap = at[lo : lo + 512, None] - at[None]
            far = np.maximum((gap**2).sum(axis=2), 1e-4)
            push[lo : lo + 512] = (gap * (k * k / far)[:, :, None]).sum(axis=1)
        gap = at[a[:, 0]] - at[a[:, 1]]
        pull = gap * np.maximum(np.sqrt((gap**2).sum(axis=1, keepdims=True)), 1e-2) / k
        np.add.at(push, a[:, 0], -pull)
        np.add.at(push, a[:, 1], pull)
        size = np.maximum(np.sqrt((push**2).sum(axis=1, keepdims=True)), 1e-9)
        heat = FORCE_HEAT * (1 - i / FORCE_ROUNDS)
        at = np.clip(at + push / size * np.minimum(size, heat), 0, FORCE_CANVAS)
    return p.nodes.sparkSession.createDataFrame([(x, float(u), float(v)) for x, (u, v) in zip(ids, at)], "id string, x double, y double")


def svg(places: DataFrame, links: DataFrame, scale: float = 1.0, width: int = 26) -> str:
    """A drawing of (id, x, y) and (src, dst); labels are cut after 26 characters."""
    rows = {r["id"]: (r["x"] * scale + 20, r["y"] * scale + 20) for r in places.orderBy("y", "x", "id").collect()}
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{max((x for x, _ in rows.values()), default=0) + 200:g}" height="{max((y for _, y in rows.values()), default=0) + 40:g}">']
    for r in links.orderBy("src", "dst").collect():
        if r["src"] in rows and r["dst"] in rows:
            (a, b), (c, d) = rows[r["src"]], rows[r["dst"]]
            out.append(f'<line x1="{a:.2f}" y1="{b:.2f}" x2="{c:.2f}" y2="{d:.2f}" stroke="#888"/>')
    for id, (x, y) in rows.items():
        label = id if len(id) <= width else id[:width] + "…"
        out.append(f'<circle cx="{x:.2f}" cy="{y:.2f}" r="3"/><text x="{x + 5:.2f}" y="{y:.2f}" font-size="9">{escape(label)}</text>')
    return "\n".join([*out, "</svg>"])
