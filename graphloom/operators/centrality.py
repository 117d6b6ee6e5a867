"""Centralities of the analytics projection.

Iterated measures run as array kernels while the links fit in memory (checked),
else as rounds of join and sum. Path-based measures walk from each node in
parallel over the tasks, each with the whole adjacency; beyond the bound all
nodes walk at once, in rounds of joins (`waves`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import KERNEL_EDGES, bounded_links, checkpointed, dealt
from . import waves
from .closure import Adjacency
from .project import Projection

DAMPING, ROUNDS, TOLERANCE, ALPHA, BETA = 0.85, 100, 1e-6, 0.1, 1.0
#: Nodes up to which exact betweenness is offered.
BETWEENNESS_NODES = 50_000
#: Words that all links of a level carry at once.
BATCH_WORDS = 16_000_000
#: Links for each node from which paths are counted level by level.
WIDE = 4


def _arrays(p: Projection, most: int):
    """(ids, src, dst) with ids in order, or None beyond the bound."""
    import numpy as np

    found = bounded_links(p.links, most)
    if found is None or p.nodes.limit(most + 1).count() > most:
        return None
    ids = sorted(p.nodes.toArrow()["id"].to_pylist())
    place = pd.Index(ids).get_indexer(found[0]).astype(np.int64)
    src, dst = place[found[1]], place[found[2]]
    order = np.lexsort((dst, src))
    return ids, src[order], dst[order]


def _table(p: Projection, ids, values) -> DataFrame:
    return p.nodes.sparkSession.createDataFrame(list(zip(ids, map(float, values))), "id string, value double")


def pagerank(p: Projection, most: int = KERNEL_EDGES) -> DataFrame:
    """(id, value): damping 0.85, dangling mass spread evenly; stops at a change below n * 1e-6 or after 100 rounds."""
    import numpy as np

    got = _arrays(p, most)
    if got:
        ids, src, dst = got
        n = len(ids)
        if not n:
            return _table(p, [], [])
        out = np.bincount(src, minlength=n)
        x = np.full(n, 1 / n)
        for _ in range(ROUNDS):
            share = np.divide(x, out, out=np.zeros(n), where=out > 0)
            y = DAMPING * (np.bincount(dst, weights=share[src], minlength=n) + x[out == 0].sum() / n) + (1 - DAMPING) / n
            change, x = np.abs(y - x).sum(), y
            if change < n * TOLERANCE:
                break
        return _table(p, ids, x)
    n = p.nodes.count()
    out = p.links.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out"))
    x = checkpointed(p.nodes.join(out, "id", "left").withColumn("value", F.lit(1 / n)))
    links = checkpointed(p.links)
    for _ in range(ROUNDS):
        loose = x.where("out is null").agg(F.sum("value")).first()[0] or 0.0
        into = links.join(x.select(F.col("id").alias("src"), (F.col("value") / F.col("out")).alias("share")), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("share"))
        y = x.join(into, "id", "left").select("id", "out", F.col("value").alias("old"), (DAMPING * (F.coalesce("share", F.lit(0.0)) + loose / n) + (1 - DAMPING) / n).alias("value"))
        y = checkpointed(y)
        change = y.agg(F.sum(F.abs(F.col("value") - F.col("old")))).first()[0]
        x = y.drop("old")
        if change < n * TOLERANCE:
            break
    return x.select("id", "value")


def _iterate(p: Projection, step, start: float, done, scale, most: int) -> DataFrame | None:
    """Rounds of value = step(sum over incoming links, own value); None where they do not settle."""
    import numpy as np

    got = _arrays(p, most)
    if got:
        ids, src, dst = got
        n = len(ids)
        x = np.full(n, start if start else 1 / max(1, n))
        for _ in range(ROUNDS):
            y = step(np.bincount(dst, weights=x[src], minlength=n), x)
            y = scale(y, np.sqrt((y * y).sum()))
            change, x = np.abs(y - x).sum(), y
            if change < done(n):
                norm = np.sqrt((x * x).sum())
                return _table(p, ids, x / norm if norm else x)
        return None
    n = p.nodes.count()
    links, x = checkpointed(p.links), checkpointed(p.nodes.withColumn("value", F.lit(float(start if start else 1 / n))))
    for _ in range(ROUNDS):
        into = links.join(x.select(F.col("id").alias("src"), "value"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("value").alias("into"))
        y = checkpointed(x.join(into, "id", "left").select("id", F.col("value").alias("old"), step(F.coalesce("into", F.lit(0.0)), F.col("value")).alias("value")))
        norm = y.agg(F.sqrt(F.sum(F.col("value") * F.col("value")))).first()[0]
        y = checkpointed(y.withColumn("value", scale(F.col("value"), F.lit(norm))))
        change, x = y.agg(F.sum(F.abs(F.col("value") - F.col("old")))).first()[0], y.select("id", "value")
        if change < done(n):
            norm = x.agg(F.sqrt(F.sum(F.col("value") * F.col("value")))).first()[0]
            return x.withColumn("value", F.col("value") / norm)
    return None


def eigenvector(p: Projection, most: int = KERNEL_EDGES) -> DataFrame | None:
    """(id, value) by power iteration on incoming links plus the node itself; None if it does not settle."""
    return _iterate(p, lambda s, x: s + x, 0.0, lambda n: n * TOLERANCE, lambda v, norm: v / norm, most)


def katz(p: Projection, most: int = KERNEL_EDGES) -> DataFrame | None:
    """(id, value): alpha 0.1, beta 1, scaled to length 1; None if it does not settle."""
    return _iterate(p, lambda s, x: s * ALPHA + BETA, 1.0, lambda n: n * TOLERANCE, lambda v, norm: v, most)


def _per_source(p: Projection, links: DataFrame, schema: str, visit, most: int) -> DataFrame | None:
    """What visit finds from each node; None where the links do not fit in memory."""
    found = bounded_links(links, most)
    if found is None:
        return None
    graph = Adjacency(*found)
    n = p.nodes.count()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield visit(graph, n, b["id"])

    return dealt(p.nodes, "id").mapInPandas(run, schema)


def _distances(graph, starts, reached, total) -> None:
    """Adds to each node how many of starts reach it, and from how far: a bit for each start, all links of a level at once."""
    import numpy as np

    n, m = len(graph.ids), len(graph.to)
    words = max(1, min(-(-len(starts) // 64), BATCH_WORDS // max(1, n, m)))
    src = np.repeat(np.arange(n), np.diff(graph.at))
    order = np.argsort(graph.to, kind="stable")
    src, ends = src[order], graph.to[order]
    first = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]]) if m else np.zeros(0, dtype=np.int64)
    for lo in range(0, len(starts), 64 * words):
        own = np.asarray(starts[lo : lo + 64 * words], dtype=np.int64)
        bit = np.arange(len(own))
        front = np.zeros((n, words), dtype=np.uint64)
        np.bitwise_or.at(front, (own, bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
        seen, on, level = front.copy(), np.unique(own), 0
        while len(on):
            level += 1
            if len(on) > n // 8:
                to, come = ends[first], np.bitwise_or.reduceat(front[src], first, axis=0) if m else front[:0]
            else:  # few nodes: only their links
                at, many = graph.at[on], graph.at[on + 1] - graph.at[on]
                dst = graph.to[np.arange(many.sum()) + np.repeat(at - np.r_[0, np.cumsum(many)[:-1]], many)]
                by = np.argsort(dst, kind="stable")
                to, begin = np.unique(dst[by], return_index=True)
                come = np.bitwise_or.reduceat(front[np.repeat(on, many)[by]], begin, axis=0) if len(to) else front[:0]
            new = come & ~seen[to]
            front[on] = 0
            count = np.bitwise_count(new).sum(axis=1, dtype=np.int64)
            keep = count > 0
            on, new, count = to[keep], new[keep], count[keep]
            front[on] = new
            seen[on] |= new
            reached[on] += count
            total[on] += count * level


def closeness(p: Projection, most: int = KERNEL_EDGES) -> DataFrame:
    """(id, value): reached share times inverse mean distance over paths that end in the node; 0 for none.

    A task walks from its share of the nodes, 64 of them in a word, and gives one sum for each node.
    Beyond `most` links these are sent as numbers, and where they are too many for that too, all
    nodes walk at once in rounds of joins.
    """
    found = bounded_links(p.links, most)
    nth, e, numbers = waves.in_numbers(p.nodes, p.links) if found is None else (None, None, None)
    if numbers is not None:

        def walk(n: int, src, dst, starts) -> pd.DataFrame:
            import numpy as np

            reached, total = (np.zeros(n, dtype=np.int64) for _ in range(2))
            _distances(Adjacency(range(n), src, dst), starts, reached, total)
            at = np.flatnonzero(reached)
            return pd.DataFrame({"nth": at, "r": reached[at], "s": total[at]})

        far = waves.in_tasks(nth.where("start"), numbers, walk, "nth long, r long, s long").groupBy("nth").agg(F.sum("r").alias("r"), F.sum("s").alias("s")).join(nth, "nth").select("id", "r", "s")
    elif found is None:
        back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        far = waves.levels(back, p.nodes.select(F.col("id").alias("seed"))).groupBy(F.col("seed").alias("id")).agg(F.sum("n").alias("r"), F.sum(F.col("n") * F.col("level")).alias("s"))
    else:
        graph = Adjacency(*found)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import numpy as np

            starts = [graph.of[s] for b in batches for s in b["id"] if s in graph.of]
            reached, total = (np.zeros(len(graph.ids), dtype=np.int64) for _ in range(2))
            _distances(graph, starts, reached, total)
            at = np.flatnonzero(reached)
            if len(at):
                yield pd.DataFrame({"id": pd.Series(graph.ids[at], dtype=object), "r": reached[at], "s": total[at]})

        far = dealt(p.nodes, "id").mapInPandas(run, "id string, r long, s long").groupBy("id").agg(F.sum("r").alias("r"), F.sum("s").alias("s"))
    value = F.col("r") / F.col("s") * F.col("r") / max(1, p.nodes.count() - 1)
    return p.nodes.join(far, "id", "left").select("id", F.coalesce(value, F.lit(0.0)).alias("value"))


def _by_queue(graph, start: int, total) -> None:
    """Adds the shares of the paths from start, node by node: for graphs with long ways."""
    sigma, level, order, before, head = {start: 1.0}, {start: 0}, [start], {start: []}, 0
    while head < len(order):
        x = order[head]
        head += 1
        for y in map(int, graph.to[graph.at[x] : graph.at[x + 1]]):
            if y not in level:
                level[y], sigma[y], before[y] = level[x] + 1, 0.0, []
                order.append(y)
            if level[y] == level[x] + 1:
                sigma[y] += sigma[x]
                before[y].append(x)
    delta = dict.fromkeys(order, 0.0)
    for y in reversed(order):
        for x in before[y]:
            delta[x] += sigma[x] / sigma[y] * (1 + delta[y])
        if y != start:
            total[y] += delta[y]


def _by_level(graph, start: int, total) -> None:
    """The same, all links of a level at once: for graphs with many links to a node."""
    import numpy as np

    n = len(graph.ids)
    level, sigma, front, steps, depth = np.full(n, -1), np.zeros(n), np.array([start]), [], 0
    level[start], sigma[start] = 0, 1.0
    while len(front):
        lo, many = graph.at[front], graph.at[front + 1] - graph.at[front]
        src = np.repeat(front, many)
        dst = graph.to[np.arange(many.sum()) + np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many)]
        depth += 1
        on = level[dst] < 0
        src, dst = src[on], dst[on]
        sigma += np.bincount(dst, weights=sigma[src], minlength=n)
        front = np.unique(dst)
        level[front] = depth
        steps.append((src, dst))
    delta = np.zeros(n)
    for src, dst in reversed(steps):
        delta += np.bincount(src, weights=sigma[src] / sigma[dst] * (1 + delta[dst]), minlength=n)
    delta[start] = 0.0
    total += delta


def betweenness(p: Projection, most: int = KERNEL_EDGES, ceiling: bool = True) -> DataFrame | None:
    """(id, value): share of shortest directed paths through a node, ends excluded; None beyond 50,000 nodes unless without that ceiling."""
    n = p.nodes.count()
    if ceiling and n > BETWEENNESS_NODES:
        return None

    def visit(graph, n, ids):
        import numpy as np

        total = np.zeros(len(graph.ids))
        of = _by_level if len(graph.to) >= WIDE * len(graph.ids) else _by_queue
        for s in ids:
            if s in graph.of:
                of(graph, graph.of[s], total)
        at = np.flatnonzero(total)
        return pd.DataFrame({"id": pd.Series(graph.ids[at], dtype=object), "part": total[at]})

    parts = _per_source(p, p.links, "id string, part double", visit, most)
    parts = waves.path_shares(p.nodes, p.links) if parts is None else parts.groupBy("id").agg(F.sum("part").alias("part"))
    scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return p.nodes.join(parts, "id", "left").select("id", (F.coalesce("part", F.lit(0.0)) * scale).alias("value"))
