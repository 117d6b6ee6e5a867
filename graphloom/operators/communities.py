"""Communities by modularity, and summaries of a partition."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import KERNEL_EDGES, checkpointed, dropped
from ..graph import numbered as in_order
from .blocks import BLOCK_LINKS, by_block, places
from .project import Projection

SEED = 20261102


def leiden(n: int, pairs: list[tuple[int, int, float]], seed: int = SEED, own: list[float] | None = None, outside: list[float] | None = None, total: float | None = None) -> list[int]:
    """A community per node: local moves, refinement inside communities, then the same on the condensed graph.

    For a part of a graph: own is the weight inside each node, outside that of
    its links to other parts, total that of the whole graph.
    """
    import random

    rng = random.Random(seed)
    label = list(range(n))
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in pairs:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    self_w, out_w = list(own or [0.0] * n), list(outside or [0.0] * n)
    total = sum(w for *_, w in pairs) + sum(self_w) if total is None else total
    if not total:
        return label

    def move(near, degree, comm, within=None):
        sums: dict[int, float] = {}
        for i, c in enumerate(comm):
            sums[c] = sums.get(c, 0.0) + degree[i]
        queue = list(range(len(near)))
        rng.shuffle(queue)
        waiting, head, moved = set(queue), 0, False
        while head < len(queue):
            i = queue[head]
            head += 1
            waiting.discard(i)
            links: dict[int, float] = {}
            for j, w in near[i].items():
                if within is None or within[j] == within[i]:
                    links[comm[j]] = links.get(comm[j], 0.0) + w
            own = comm[i]
            sums[own] -= degree[i]
            gain = lambda c: links.get(c, 0.0) - degree[i] * sums.get(c, 0.0) / (2 * total)  # noqa: E731, B023
            best, most = own, gain(own)
            for c in sorted(links):
                if gain(c) > most + 1e-12:
                    best, most = c, gain(c)
            sums[best] = sums.get(best, 0.0) + degree[i]
            if best != own:
                comm[i], moved = best, True
                for j in near[i]:
                    if comm[j] != best and j not in waiting:
                        waiting.add(j)
                        queue.append(j)
        return moved

    node = list(range(n))  # of each original node: its node in the condensed graph
    comm = list(range(n))
    while True:
        degree = [sum(d.values()) + 2 * s + o for d, s, o in zip(near, self_w, out_w)]
        moved = move(near, degree, comm)
        label = [comm[x] for x in node]
        if not moved:
            return label
        fine = list(range(len(near)))
        move(near, degree, fine, comm)
        number = {c: k for k, c in enumerate(sorted(set(fine)))}
        if len(number) == len(near):
            return label
        merged: list[dict[int, float]] = [{} for _ in number]
        loops, up, far = [0.0] * len(number), [0] * len(number), [0.0] * len(number)
        for i, d in enumerate(near):
            a = number[fine[i]]
            up[a] = comm[i]
            loops[a] += self_w[i]
            far[a] += out_w[i]
            for j, w in d.items():
                b = number[fine[j]]
                if a == b:
                    loops[a] += w / 2
                else:
                    merged[a][b] = merged[a].get(b, 0.0) + w
        node = [number[fine[x]] for x in node]
        first = {}
        comm = [first.setdefault(c, k) for k, c in enumerate(up)]
        near, self_w, out_w = merged, loops, far


def _parts(n: int, pairs, label: list[int]) -> list[int]:
    """Communities whose links do not hold them together are taken apart: the smallest node of each piece."""
    up = list(range(n))

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b, _ in pairs:
        if label[a] == label[b]:
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


def _condensed(pairs: DataFrame, to: DataFrame) -> DataFrame:
    """pairs(a, b, weight), a = b for what is inside, between the nodes that to(id, least) names; others stay."""
    e = pairs.join(to.toDF("a", "_a"), "a", "left").join(to.toDF("b", "_b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"), "weight")
    return e.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("weight").alias("weight"))


def _in_blocks(pairs: DataFrame, most: int, size: int) -> DataFrame:
    """(id, least) of the nodes of pairs that are not the smallest of their community.

    Each block moves its own nodes among its own communities, with the degrees
    and the weight of the whole graph: a gain there is one of the whole, and
    blocks do not touch each other's communities. Communities then are nodes.
    Where a round merges less than a tenth of the nodes, the next one deals
    them by the heaviest neighbour that a coin leaves in place, each time
    another. It goes on in memory once the pairs fit; without them after eight
    such rounds that found nothing.
    """
    spark = pairs.sparkSession
    total = float(pairs.agg(F.sum("weight")).first()[0] or 0)

    def work(d: pa.Table) -> pa.Table:
        import numpy as np

        ids, src, dst, own = places(d)
        ids = ids.to_pylist()
        w = d["weight"].to_numpy()
        loop, in_ = src == dst, own[dst]
        inner = in_ & ~loop & (src < dst)
        rows = list(zip(src[inner].tolist(), dst[inner].tolist(), w[inner].tolist()))
        inside = np.bincount(src[loop], weights=w[loop], minlength=len(ids)).tolist()
        outside = np.bincount(src[~in_], weights=w[~in_], minlength=len(ids)).tolist()
        label = _parts(len(ids), rows, leiden(len(ids), rows, own=inside, outside=outside, total=total))
        least: dict[int, str] = {}
        for i, c in enumerate(label):
            least.setdefault(c, ids[i])
        moved = [(ids[i], least[c]) for i, c in enumerate(label) if ids[i] != least[c]]
        return pa.table({"id": pa.array([x for x, _ in moved], pa.string()), "least": pa.array([x for _, x in moved], pa.string())})

    e, found, idle, rounds, coin = checkpointed(pairs.select("a", "b", F.col("weight").cast("double").alias("weight"))), None, 0, 0, False
    while True:
        links = e.where("a <> b")
        if links.limit(most + 1).count() <= most or idle >= 8:
            break
        both = e.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").union(links.select("b", "a", "weight"))
        nodes = both.select(F.col("src").alias("id")).distinct()
        if coin:
            head = lambda c: F.xxhash64(c, F.lit(rounds)) % 2 == 0
            best = both.where((F.col("src") != F.col("dst")) & head("dst") & ~head("src")).groupBy(F.col("src").alias("id")).agg(F.max_by("dst", F.struct("weight", "dst")).alias("best"))
            keys = checkpointed(nodes.join(best, "id", "left").select("id", F.coalesce("best", "id").alias("key")))
            both = both.join(keys.toDF("src", "key"), "src")
        else:
            both = both.withColumn("key", F.col("src"))
        # A block is a range of keys: nodes of one key are never parted.
        got = checkpointed(by_block(both, work, "id string, least string", size, "key"))
        merged, n = got.count(), nodes.count()
        before, e = e, checkpointed(_condensed(e, got))
        dropped(before)
        if found is None:
            found = got
        else:
            before, found = found, checkpointed(found.join(got.toDF("least", "next"), "least", "left").select("id", F.coalesce("next", "least").alias("least")).unionByName(got))
            dropped(before)
        idle = idle + 1 if coin and not merged else 0
        coin = coin or 10 * merged < n
        rounds += 1
    if idle < 8:
        rows = sorted((r["a"], r["b"], r["weight"]) for r in e.where("a <> b").collect())
        ids = sorted({x for a, b, _ in rows for x in (a, b)})
        of = {x: i for i, x in enumerate(ids)}
        inside = dict.fromkeys(ids, 0.0)
        ends = spark.createDataFrame([(x,) for x in ids], "a string")
        for r in e.where("a = b").join(ends, "a", "left_semi").collect():
            inside[r["a"]] = r["weight"]
        rows = [(of[a], of[b], w) for a, b, w in rows]
        label = _parts(len(ids), rows, leiden(len(ids), rows, own=[inside[x] for x in ids], total=total))
        last = spark.createDataFrame([(ids[i], ids[c]) for i, c in enumerate(label) if i != c], "id string, least string")
        found = last if found is None else found.join(last.toDF("least", "next"), "least", "left").select("id", F.coalesce("next", "least").alias("least")).unionByName(last)
    return found


def communities(p: Projection, most: int = KERNEL_EDGES, size: int = BLOCK_LINKS) -> DataFrame:
    """(id, community), numbered by smallest member. In memory up to `most` pairs; beyond, in blocks of about `size` links until those left fit."""
    spark = p.nodes.sparkSession
    if p.pairs.limit(most + 1).count() > most:
        found = _in_blocks(p.pairs, most, size)
        return numbered(checkpointed(p.nodes.join(found, "id", "left").select("id", F.coalesce("least", "id").alias("least"))))
    rows = sorted((r["a"], r["b"], float(r["weight"])) for r in p.pairs.collect())
    ids = sorted({x for a, b, _ in rows for x in (a, b)})
    of = {x: i for i, x in enumerate(ids)}
    label = leiden(len(ids), [(of[a], of[b], w) for a, b, w in rows])
    least: dict[int, str] = {}
    for i, c in enumerate(label):
        least.setdefault(c, ids[i])
    found = spark.createDataFrame([(ids[i], least[c]) for i, c in enumerate(label)], "id string, least string")
    return numbered(p.nodes.join(found, "id", "left").select("id", F.coalesce("least", "id").alias("least")))


def numbered(partition: DataFrame) -> DataFrame:
    """(id, community) from (id, least): communities numbered from 0 by their smallest member."""
    order = in_order(partition.select("least").distinct(), ["least"], "community")
    return partition.join(order, "least").select("id", "community")


def modularity(p: Projection, partition: DataFrame) -> DataFrame:
    """(q): weighted modularity of partition(id, community); null without links."""
    c = partition.select("id", "community")
    e = p.pairs.join(c.toDF("a", "ca"), "a").join(c.toDF("b", "cb"), "b")
    inside = e.groupBy("ca").agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0)).alias("l")).withColumnRenamed("ca", "community")
    ends = e.select(F.col("ca").alias("community"), "weight").union(e.select("cb", "weight")).groupBy("community").agg(F.sum("weight").alias("d"))
    total = p.pairs.agg(F.sum("weight")).first()[0]
    parts = ends.join(inside, "community", "left")
    share = F.col("d") / (2.0 * F.lit(total))
    return parts.agg(F.sum(F.coalesce("l", F.lit(0)) / F.lit(total) - share * share).alias("q"))


def summaries(p: Projection, partition: DataFrame) -> DataFrame:
    """(community, size, internal, cut): pairs counted without weights, cut ones on both sides."""
    c = partition.select("id", "community")
    size = c.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    e = p.pairs.join(c.toDF("a", "ca"), "a").join(c.toDF("b", "cb"), "b")
    inside = e.where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count(F.lit(1)).alias("internal"))
    cut = e.where("ca <> cb")
    cut = cut.select(F.col("ca").alias("community")).union(cut.select("cb")).groupBy("community").agg(F.count(F.lit(1)).alias("cut"))
    return size.join(inside, "community", "left").join(cut, "community", "left").na.fill(0, ["internal", "cut"])
