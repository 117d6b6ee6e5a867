"""Walks over links: closures, paths, blast radius.

A closure is asked for many starts at once. Below a checked number of links the
adjacency travels to the tasks and each walks its starts in memory, at any
depth; above it a loop of joins adds one level for all starts per round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import KERNEL_EDGES, Graph, bounded_links, checkpointed, dealt, dropped
from .blocks import reached
from .waves import levels

#: Pairs of start and node, and of start and link, that a task walks at once.
WALK_CELLS = 1_000_000


class Adjacency:
    """Links as sorted arrays; neighbours of a node come in id order."""

    def __init__(self, ids, src, dst):
        import numpy as np

        order = np.lexsort((dst, src))
        self.ids, self.to = ids, dst[order]
        self.at = np.searchsorted(src[order], np.arange(len(ids) + 1))
        self._of = None

    @property
    def of(self) -> dict:
        """Places of the names; made where it is needed, it does not travel."""
        if self._of is None:
            self._of = {x: i for i, x in enumerate(self.ids)}
        return self._of

    def __getstate__(self):
        return self.__dict__ | {"_of": None}

    def count(self, start: int) -> int:
        """How many nodes a walk reaches, the start left out."""
        import numpy as np

        seen = np.zeros(len(self.ids), dtype=bool)
        seen[start], todo, n, to, at = True, [start], 0, self.to, self.at
        while todo:
            x = todo.pop()
            near = to[at[x] : at[x + 1]]
            new = near[~seen[near]]
            if len(new):
                seen[new] = True
                n += len(new)
                todo += new.tolist()
        return n

    def walk(self, start: int) -> dict[int, int]:
        """Levels in breadth-first order, the start with level 0 first."""
        level, queue, head = {start: 0}, [start], 0
        to, at = self.to, self.at
        while head < len(queue):
            x = queue[head]
            head += 1
            for y in to[at[x] : at[x + 1]].tolist():
                if y not in level:
                    level[y] = level[x] + 1
                    queue.append(y)
        return level


def _together(graph: Adjacency, starts: list[int]):
    """(starts, nodes, level) for each level of walks from starts, all at once; a pair of start and node has one place."""
    import numpy as np

    n, to, first = len(graph.ids), graph.to, np.asarray(starts, dtype=np.int64)
    front, level = np.arange(len(first)) * n + first, 0
    seen, place = np.zeros(len(first) * n, dtype=bool), np.zeros(len(first) * n, dtype=np.int32)
    seen[front] = True
    while len(front):
        node = front % n
        many = graph.at[node + 1] - graph.at[node]
        come = np.repeat(front - node, many) + to[np.arange(many.sum()) + np.repeat(graph.at[node] - np.r_[0, np.cumsum(many)[:-1]], many)]
        come = come[~seen[come]]
        place[come] = np.arange(len(come))
        front, level = come[place[come] == np.arange(len(come))], level + 1
        seen[front] = True
        if len(front):
            yield first[front // n], front % n, level


def closure(links: DataFrame, seeds: DataFrame, most: int = KERNEL_EDGES) -> DataFrame:
    """(seed, id, level) for every node that is reached from each of seeds(seed), the seed left out."""
    links = links.select("src", "dst").distinct()
    found = bounded_links(links, most)
    if found is not None:
        graph = Adjacency(*found)

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import numpy as np

            names, wide = pa.array(graph.ids, pa.string()), max(1, WALK_CELLS // max(1, len(graph.ids), len(graph.to)))
            for b in batches:
                starts = [graph.of[s] for s in b["seed"].to_pylist() if s in graph.of]
                for lo in range(0, len(starts), wide):
                    for own, at, level in _together(graph, starts[lo : lo + wide]):
                        for i in range(0, len(own), 100_000):
                            to = slice(i, i + 100_000)
                            yield pa.record_batch({"seed": names.take(pa.array(own[to])), "id": names.take(pa.array(at[to])), "level": np.full(len(own[to]), level, dtype=np.int64)})

        return dealt(seeds.select("seed").distinct(), "seed").mapInArrow(walk, "seed string, id string, level long")
    e = checkpointed(links)
    front = seeds.select("seed", F.col("seed").alias("id"), F.lit(0).cast("long").alias("level")).distinct()
    seen = front
    while not front.isEmpty():
        step = front.join(e, front["id"] == e["src"]).select("seed", F.col("dst").alias("id"), (F.col("level") + 1).alias("level")).distinct()
        was, front = front, checkpointed(step.join(seen.select("seed", "id"), ["seed", "id"], "left_anti"))
        before, seen = seen, checkpointed(seen.unionByName(front))
        dropped(was, before)
    dropped(front, e)
    return seen.where("id <> seed")


def _reversed(links: DataFrame) -> DataFrame:
    return links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _around(g: Graph, name: str, id: str, back: bool) -> DataFrame:
    """(id, level) of what a walk from id reaches over the edges of that set; beyond the bound in blocks."""
    own = g.edges.where(g.profile.is_in(name)).select("src", "dst")
    own = _reversed(own) if back else own
    if own.limit(KERNEL_EDGES + 1).count() > KERNEL_EDGES and g.has(id):
        return reached(own, id).where(F.col("id") != id)
    return closure(own, g.nodes.where(F.col("id") == id).select(F.col("id").alias("seed"))).select("id", "level")


def descendants(g: Graph, id: str) -> DataFrame:
    return _around(g, "closure", id, False)


def ancestors(g: Graph, id: str) -> DataFrame:
    return _around(g, "closure", id, True)


def blast_radius(g: Graph, id: str) -> DataFrame:
    """What breaks when id changes: the closure of incoming breakage links."""
    return _around(g, "breakage", id, True)


def sizes(links: DataFrame, seeds: DataFrame, most: int = KERNEL_EDGES) -> DataFrame:
    """(seed, n): how many nodes each of seeds(seed) reaches, itself left out; seeds that reach none are left out.

    In memory only the counts leave a walk. Beyond the bound 64 walks share a
    long, and no pair of seed and node is ever a row.
    """
    links = checkpointed(links.select("src", "dst").repartition("src").distinct())
    found = bounded_links(links, most)
    out = levels(links, seeds).groupBy("seed").agg(F.sum("n").alias("n")) if found is None else None
    dropped(links)
    if out is not None:
        return out
    graph = Adjacency(*found)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(s, graph.count(graph.of[s])) for s in b["seed"] if s in graph.of]
            yield pd.DataFrame([x for x in got if x[1]], columns=["seed", "n"])

    return seeds.select("seed").distinct().repartition("seed").mapInPandas(count, "seed string, n long")


def blast_sizes(g: Graph, most: int = KERNEL_EDGES) -> DataFrame:
    """(id, value): sizes of all blast radii; no zeros, no boundary nodes."""
    seeds = g.real().select(F.col("id").alias("seed"))
    return sizes(_reversed(g.edges.where(g.profile.is_in("breakage"))), seeds, most).select(F.col("seed").alias("id"), F.col("n").alias("value"))


def path(g: Graph, a: str, b: str) -> DataFrame | None:
    """(step, src, dst, kind) of the shortest walk over non-containment edges.

    Ties go to the node reached earlier, then the smaller id, then the kind that
    the profile names first; symmetric kinds lead both ways. No rows for a = b,
    None where b cannot be reached. Beyond the links that fit in memory the
    levels come from blocks, and only links of shortest ways are walked: in
    memory where these fit, else by joins up to b and back from it.
    """
    schema = "step long, src string, dst string, kind string"
    spark = g.spark
    if not (g.has(a) and g.has(b)):
        return None
    if a == b:
        return spark.createDataFrame([], schema)
    e = g.plain().select("src", "dst", "kind")
    back = e.where(g.profile.is_in("symmetric")).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind") if g.profile.symmetric else e.limit(0)
    e = e.unionByName(back).groupBy("src", "dst").agg(F.min_by("kind", g.profile.edge_rank(F.col("kind"))).alias("kind"))
    found = bounded_links(e)
    if found is None:
        e = checkpointed(e)
        far = reached(e, a)
        goal = far.where(F.col("id") == b).first()
        if goal is None:
            return None
        near = far.where(F.col("level") <= goal["level"])
        e = checkpointed(e.join(near.toDF("src", "_a"), "src").join(near.toDF("dst", "_b"), "dst").where("_b = _a + 1").select("src", "dst", "kind"))
        found = bounded_links(e)
    if found is not None:
        graph = Adjacency(*found)
        if a not in graph.of or b not in graph.of:
            return None
        start, goal, prev, queue, head = graph.of[a], graph.of[b], {graph.of[a]: -1}, [graph.of[a]], 0
        while head < len(queue) and goal not in prev:
            x = queue[head]
            head += 1
            for y in map(int, graph.to[graph.at[x] : graph.at[x + 1]]):
                if y not in prev:
                    prev[y] = x
                    queue.append(y)
        if goal not in prev:
            return None
        steps = []
        while goal != start:
            steps.append((graph.ids[prev[goal]], graph.ids[goal]))
            goal = prev[goal]
    else:
        seen = spark.createDataFrame([(a, 0, "")], "id string, level long, trail string")
        front, level = seen, 0
        while seen.where(F.col("id") == b).isEmpty():
            level += 1
            step = front.join(e, front["id"] == e["src"]).groupBy(F.col("dst").alias("id")).agg(F.min("trail").alias("trail"))
            front = step.select("id", F.lit(level).cast("long").alias("level"), F.concat("trail", F.lit("\x00"), "id").alias("trail"))
            front = checkpointed(front.join(seen.select("id"), "id", "left_anti"))
            if front.isEmpty():
                return None
            seen = checkpointed(seen.unionByName(front))
        # Each node carries the way to it.
        trail = [a, *seen.where(F.col("id") == b).first()["trail"].split("\x00")[1:]]
        steps = list(zip(trail, trail[1:]))[::-1]
    rows = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(reversed(steps))], "step long, src string, dst string")
    return rows.join(e, ["src", "dst"]).select("step", "src", "dst", "kind")
