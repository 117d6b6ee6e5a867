"""Strongly connected components, cycles and safe change order."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import KERNEL_EDGES, Graph, bounded_links, checkpointed, dropped, is_table, numbered, union
from .blocks import BLOCK_LINKS, contracted, peeled
from .project import Projection

#: Layers that are at most peeled off as joins before the rest goes on in blocks; one of less than a quarter of what waits for it is left to them.
PEELED = 3


def tarjan(n: int, to: list[list[int]]) -> list[int]:
    """A component number for each node, without recursion."""
    index, low, on, stack, comp = [-1] * n, [0] * n, [False] * n, [], [-1] * n
    count = found = 0
    for root in range(n):
        if index[root] >= 0:
            continue
        work = [(root, iter(to[root]))]
        index[root] = low[root] = count
        count += 1
        stack.append(root)
        on[root] = True
        while work:
            x, rest = work[-1]
            for y in rest:
                if index[y] < 0:
                    index[y] = low[y] = count
                    count += 1
                    stack.append(y)
                    on[y] = True
                    work.append((y, iter(to[y])))
                    break
                if on[y]:
                    low[x] = min(low[x], index[y])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[x])
                if low[x] == index[x]:
                    while True:
                        y = stack.pop()
                        on[y] = False
                        comp[y] = found
                        if y == x:
                            break
                    found += 1
    return comp


def _spread(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Smallest label along links until nothing changes: labels(id, label)."""
    before = None
    while True:
        heard = links.join(labels.select(F.col("id").alias("src"), "label"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("heard"))
        step = checkpointed(labels.join(heard, "id", "left").select("id", F.least("label", "heard").alias("label"), F.col("label").alias("old")))
        if before is not None:
            dropped(before)
        if step.where("label <> old").isEmpty():
            return step.select("id", "label")
        before = step
        labels = step.select("id", "label")


def _in_memory(spark, found) -> DataFrame:
    """(id, component) of the ends of links that fit in memory."""
    ids = found[0].tolist()
    to: list[list[int]] = [[] for _ in ids]
    for a, b in zip(found[1].tolist(), found[2].tolist()):
        to[a].append(b)
    comp, least = tarjan(len(ids), to), {}
    for i, c in enumerate(comp):
        least.setdefault(c, ids[i])
    return spark.createDataFrame([(ids[i], least[c]) for i, c in enumerate(comp)], "id string, component string")


def components(nodes: DataFrame, links: DataFrame, most: int = KERNEL_EDGES, size: int = BLOCK_LINKS) -> DataFrame:
    """(id, component): the smallest id of its strongly connected component.

    In memory while the links fit. Beyond, blocks of about `size` links are
    contracted (`blocks.contracted`), and what is left is done in memory where
    it fits, else in rounds.
    """
    e = checkpointed(links.select("src", "dst"))
    out = _moved(e, most, size)
    dropped(e)
    return nodes.select("id").join(out, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _moved(links: DataFrame, most: int = KERNEL_EDGES, size: int = BLOCK_LINKS) -> DataFrame:
    """(id, component) of the nodes of a written table of links that are not the smallest of their component."""
    spark = links.sparkSession
    found = bounded_links(links, most)
    if found is not None:
        return _in_memory(spark, found).where("id <> component")
    moved, left = contracted(links, size)
    rest = bounded_links(left, most)
    ends = left.select(F.col("src").alias("id")).union(left.select("dst")).distinct()
    comp = checkpointed((_in_memory(spark, rest) if rest is not None else _in_rounds(ends, left)).where("id <> component"))
    return moved.join(comp.toDF("component", "last"), "component", "left").select("id", F.coalesce("last", "component").alias("component")).unionByName(comp)


def _in_rounds(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) where links do not fit and blocks do not help.

    Nodes without a way in or out are alone; the others take the smallest id
    that reaches them, and of such a set those that also reach that id are its
    component.
    """
    done, left, e = [], checkpointed(nodes.select("id")), checkpointed(links.select("src", "dst").distinct())
    while not left.isEmpty():
        both = e.select(F.col("src").alias("id")).intersect(e.select(F.col("dst").alias("id")))
        lone = checkpointed(left.join(both, "id", "left_anti"))
        if not lone.isEmpty():
            done.append(lone.select("id", F.col("id").alias("component")))
            left = checkpointed(left.join(both, "id", "left_semi"))
            keep = left
        else:
            color = _spread(left.withColumn("label", F.col("id")), e)
            same = e.join(color.toDF("src", "a"), "src").join(color.toDF("dst", "b"), "dst").where("a = b").select("src", "dst", "a")
            # Backwards from the namesake inside its set.
            front = got = checkpointed(color.where("id = label").select("id", F.col("label").alias("component")))
            while not front.isEmpty():
                front = checkpointed(same.join(front.toDF("dst", "a"), ["dst", "a"]).select(F.col("src").alias("id"), F.col("a").alias("component")).distinct().join(got, ["id", "component"], "left_anti"))
                got = checkpointed(got.union(front))
            done.append(got)
            keep = left = checkpointed(left.join(got, "id", "left_anti"))
        was, e = e, checkpointed(e.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"))
        dropped(was)
    out = done[0] if done else nodes.select("id", F.col("id").alias("component")).limit(0)
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def cycles(g: Graph) -> DataFrame:
    """(component, members, edge_kind) of closure links: more than one member, or a link to itself.

    Only nodes on cycles are looked at; links are looked up again only where they are of several kinds.
    """
    own = g.edges.where(g.profile.is_in("closure"))
    links = checkpointed(own.select("src", "dst"))
    moved = checkpointed(_moved(links))
    loops = links.where("src = dst").select(F.col("src").alias("id")).distinct().join(moved, "id", "left_anti").select("id", F.col("id").alias("component"))
    least = moved.select("component").distinct().select(F.col("component").alias("id"), "component")
    comp = checkpointed(union([moved, least, loops]).distinct())
    dropped(links, moved)
    sets = comp.groupBy("component").agg(F.array_sort(F.collect_list("id")).alias("members"))
    kinds = [r[0] for r in own.select("kind").distinct().collect()]
    if len(kinds) < 2:
        return sets.withColumn("edge_kind", F.lit(kinds[0] if kinds else None).cast("string"))
    order = F.array_position(F.array(*map(F.lit, g.profile.closure)), F.col("kind"))
    inside = own.join(comp.toDF("src", "component"), "src").join(comp.toDF("dst", "_c"), "dst").where("component = _c")
    return sets.join(inside.groupBy("component").agg(F.min_by("kind", order).alias("edge_kind")), "component")


def layers(nodes: DataFrame, links: DataFrame, size: int = BLOCK_LINKS) -> DataFrame:
    """(id, layer) over links(src, dst) without cycles, src after dst: 0 for what waits for nothing, else one more than the last it waits for.

    Rounds peel off what is ready: each takes the peeled nodes' links alone and
    counts down what their users still wait for. Once few are ready, or after
    PEELED rounds, the rest is peeled in blocks of about `size` links (`blocks.peeled`).
    """
    e = checkpointed(links.select("src", "dst").distinct())
    left = checkpointed(e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n")))
    out = front = checkpointed(nodes.select("id").join(left, "id", "left_anti").select("id", F.lit(0).cast("long").alias("layer")))
    layer = 0
    while (ready := front.count()) and (wait := left.where("n > 0").count()) and layer < PEELED and 4 * ready >= wait:
        layer += 1
        less = e.join(front.select(F.col("id").alias("dst")), "dst").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("less"))
        was, left = left, checkpointed(left.where("n > 0").join(less, "id", "left").select("id", (F.col("n") - F.coalesce("less", F.lit(0))).alias("n")))
        front = left.where("n = 0").select("id", F.lit(layer).cast("long").alias("layer"))
        before, out = out, checkpointed(out.unionByName(front))
        dropped(was, before)
    if ready and wait:
        more = e.join(left.where("n > 0").select(F.col("id").alias("src")), "src", "left_semi") if layer else e
        more = peeled(more.join(out.select(F.col("id").alias("dst"), F.col("layer").alias("at")), "dst", "left"), size)
        before, out = out, checkpointed(union([out, *more]))
        dropped(before, *more)
    dropped(left, e)
    return out


def topo_sort(p: Projection, by: str = "ready", most: int | None = None) -> DataFrame:
    """(position, members, cyclic): groups of mutual dependencies, what they depend on first.

    by="ready": of the groups that could come next, the one with the smallest
    member, at any size. That order is serial: up to KERNEL_EDGES groups and
    links between them it is found in the driver, beyond in one task that holds
    numbers only. by="layers": groups come by layers (`layers`), and by their
    smallest member in each; a caller that names `most` asks for that beyond so
    many groups or links.
    """
    if by not in ("ready", "layers"):
        raise ValueError(f"unknown order: {by}")
    held = KERNEL_EDGES if most is None else most
    links = p.links if is_table(p.links) else checkpointed(p.links)
    moved = checkpointed(_moved(links, held))
    comp = checkpointed(p.nodes.select("id").join(moved, "id", "left").select("id", F.coalesce("component", "id").alias("component")))
    across = links.join(moved.toDF("src", "a"), "src", "left").join(moved.toDF("dst", "b"), "dst", "left").select(F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst")).where("src <> dst").distinct()
    groups = comp.groupBy("component").agg(F.array_sort(F.collect_list("id")).alias("members"))
    names = comp.where("id = component").select("id")  # each group has its smallest member
    few = by == "ready" and names.limit(held + 1).count() <= held
    found = bounded_links(across, held) if few else None
    if found is not None:
        place = _ready_order(p.nodes.sparkSession, [r[0] for r in names.toLocalIterator()], found)
    elif by == "ready" and most is None:
        place = _ready_in_a_task(names, across)
    else:
        layer = layers(names, across).withColumnRenamed("id", "component")
        place = numbered(layer, ["layer", "component"], "position")
    dropped(moved, *([] if links is p.links else [links]))
    return place.join(groups, "component").select("position", "members", (F.size("members") > 1).alias("cyclic"))


def _ready_order(spark, names: list[str], found) -> DataFrame:
    waits, users = dict.fromkeys(names, 0), {}
    for a, b in zip(found[0][found[1]], found[0][found[2]]):  # a depends on b
        waits[a] += 1
        users.setdefault(b, []).append(a)
    ready, order = [x for x, n in waits.items() if not n], []
    heapq.heapify(ready)
    while ready:
        x = heapq.heappop(ready)
        order.append(x)
        for y in users.get(x, ()):
            waits[y] -= 1
            if not waits[y]:
                heapq.heappush(ready, y)
    return spark.createDataFrame(list(enumerate(order)), "position long, component string")


def _ready_in_a_task(names: DataFrame, across: DataFrame) -> DataFrame:
    """The same of names(id) and across(src, dst), distinct: one task holds a number for each name and link, and what became ready on the way."""
    spark = names.sparkSession
    place = checkpointed(numbered(names, ["id"], "n").select("id", F.col("n").cast("int").alias("n")))
    n = place.count()
    e = across.join(place.toDF("src", "a"), "src").join(place.toDF("dst", "b"), "dst").select("a", "b")
    # The row of -1 is there so that the task runs also where there are no links.
    e = e.union(spark.range(1).select(F.lit(-1).alias("a"), F.lit(-1).alias("b"))).repartition(1).sortWithinPartitions("b", "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held = [(b["a"].to_numpy(), b["b"].to_numpy()) for b in batches if b.num_rows]
        if not held:
            return
        users, of = (np.concatenate(x)[1:] for x in zip(*held))
        del held
        at, users = memoryview(np.searchsorted(of, np.arange(n + 1))), memoryview(users)
        waits = np.bincount(users, minlength=n)
        first, later, order, nth = memoryview(np.flatnonzero(waits == 0).astype(np.int32)), [], np.empty(n, dtype=np.int32), 0
        waits, put, head = waits.tolist(), memoryview(order), 0
        # What waits for nothing is in order already; only what becomes ready later is in the heap.
        while head < len(first) or later:
            if not later or head < len(first) and first[head] < later[0]:
                x, head = first[head], head + 1
            else:
                x = heapq.heappop(later)
            put[nth] = x
            nth += 1
            for y in users[at[x] : at[x + 1]]:
                waits[y] -= 1
                if not waits[y]:
                    heapq.heappush(later, y)
        for lo in range(0, nth, 100_000):
            got = order[lo : min(nth, lo + 100_000)]
            yield pa.record_batch({"position": np.arange(lo, lo + len(got)), "n": got})

    order = checkpointed(e.mapInArrow(run, "position long, n int"))
    return order.join(place, "n").select("position", F.col("id").alias("component"))
