"""Work in blocks, for graphs that no task holds and whose ways are long.

Nodes are dealt by ranges of their ids, so what shares a package, a module or a
user mostly lies in one block. A task holds the links that leave one block and
works in it to the end; only what leads out waits for another round. So rounds
follow how often a way changes blocks, and not how long it is.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import KERNEL_EDGES, checkpointed, dropped

#: Links of a block, about.
BLOCK_LINKS = 250_000


def by_block(links: DataFrame, work: Callable, schema: str, size: int = BLOCK_LINKS, by: str = "src") -> DataFrame:
    """What work(rows of a block as one Arrow table) returns as a table; blocks are ranges of `by` with about `size` links, all of one value in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from work(pa.Table.from_batches(held)).to_batches()

    return links.repartitionByRange(max(1, -(-links.count() // size)), by).mapInArrow(run, schema)


def places(d: pa.Table):
    """(ids, src, dst, own): the ends as places in ids in order, and which ids are the block's own, being a src in it, if only of a null.

    Names stay in Arrow; its order of bytes is that of code points.
    """
    import numpy as np

    code = pa.chunked_array([c.cast(pa.string()) for c in d["src"].chunks + d["dst"].chunks], pa.string()).combine_chunks().dictionary_encode()
    by_name = pc.array_sort_indices(code.dictionary)
    place = np.empty(len(by_name), dtype=np.int64)
    place[by_name.to_numpy()] = np.arange(len(by_name))
    at = code.indices.fill_null(-1).to_numpy().astype(np.int64)
    at = np.where(at < 0, -1, place[at]) if len(place) else at
    own = np.zeros(len(place), dtype=bool)
    src, dst = at[: len(d)], at[len(d) :]
    own[src] = True
    return code.dictionary.take(by_name), src[dst >= 0], dst[dst >= 0], own


def neighbours(n: int, src, dst) -> list[list[int]]:
    to: list[list[int]] = [[] for _ in range(n)]
    for a, b in zip(src.tolist(), dst.tolist()):
        to[a].append(b)
    return to


def contracted(links: DataFrame, size: int = BLOCK_LINKS) -> tuple[DataFrame, DataFrame]:
    """((id, component) of nodes that are not the smallest of their component as far as found, links left between smallest ones).

    A block's components are contracted; what then leads to no other block is
    done, as a component of several blocks leaves each of them. links should be
    a written table, for it is read twice; repeated ones are merged. Every other
    round takes the links backwards. Where two rounds took less than a quarter
    of the links, blocks become four times as large, up to KERNEL_EDGES links;
    where that does not help either it ends, and those left are again forwards.
    """
    from .topology import tarjan

    def work(d: pa.Table) -> pa.Table:
        import numpy as np

        ids, src, dst, own = places(d)
        in_ = own[dst]
        comp = np.asarray(tarjan(len(ids), neighbours(len(ids), src[in_], dst[in_])))
        # Components come numbered behind all that they lead to; ids are in order, so the first place is the smallest member.
        _, first = np.unique(comp, return_index=True)
        least = first[comp]
        moved = np.flatnonzero(least != np.arange(len(ids)))
        open_ = np.zeros(len(first), dtype=bool)
        open_[comp[src[~in_]]] = True
        a, b = comp[src[in_]], comp[dst[in_]]
        order = np.argsort(a, kind="stable")
        leads = open_.tolist()
        for x, y in zip(a[order].tolist(), b[order].tolist()):
            if leads[y]:
                leads[x] = True
        leads = np.asarray(leads, dtype=bool)
        keep = leads[comp[src]] & (~in_ | leads[comp[dst]]) & (comp[src] != comp[dst])
        a, b, out = least[src[keep]], np.where(in_[keep], least[dst[keep]], dst[keep]), ~in_[keep]
        _, once = np.unique(a * len(ids) + b, return_index=True)
        a, b = np.r_[moved, a[once]], np.r_[least[moved], b[once]]
        return pa.table({"left": np.arange(len(a)) >= len(moved), "src": ids.take(pa.array(a)), "dst": ids.take(pa.array(b)), "out": np.r_[np.zeros(len(moved), dtype=bool), out[once]]})

    e, found, turned, rounds = links.select("src", "dst").where("src <> dst"), None, False, 0
    n = before = e.count()
    while n:
        # Every end is in the block that it would be a src in, also where nothing leads on from it.
        both = e.unionByName(e.select(F.col("dst").alias("src"), F.lit(None).cast("string").alias("dst")))
        got = checkpointed(by_block(both, work, "left boolean, src string, dst string, out boolean", size))
        to = got.where("not left").select(F.col("src").alias("id"), F.col("dst").alias("component"))
        left = got.where("left")
        ends = left.select(F.col("src").alias("dst")).distinct()
        outer = left.where("out").join(to.select(F.col("id").alias("dst"), "component"), "dst", "left").select("src", F.coalesce("component", "dst").alias("dst"))
        rest = left.where("not out").select("src", "dst").unionByName(outer.join(ends, "dst", "left_semi").select("src", "dst")).distinct()
        was, e = e, checkpointed(rest.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        dropped(was)
        turned = not turned
        if found is None:
            found = to
        else:
            later = to.select(F.col("id").alias("component"), F.col("component").alias("next"))
            found = checkpointed(found.join(later, "component", "left").select("id", F.coalesce("next", "component").alias("component")).unionByName(to))
        n, rounds = e.count(), rounds + 1
        if rounds % 2 == 0:
            if 4 * n > 3 * before:
                if size >= KERNEL_EDGES:
                    break
                size = min(4 * size, KERNEL_EDGES)
            before = n
    if turned:
        e = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if found is None:
        found = links.limit(0).select(F.col("src").alias("id"), F.col("dst").alias("component"))
    return found, e


def peeled(waiting: DataFrame, size: int = BLOCK_LINKS) -> list[DataFrame]:
    """Tables (id, layer) of the src of waiting(src, dst, at): one more than the last dst; `at` is a layer that is known.

    What is on a cycle or waits for one is left out.
    """

    def work(d: pa.Table) -> pa.Table:
        import numpy as np

        ids, src, dst, own = places(d)
        known = d["at"].cast(pa.float64()).to_numpy()
        layer = np.zeros(len(ids), dtype=np.int64)
        done = ~np.isnan(known)
        np.maximum.at(layer, src[done], known[done].astype(np.int64) + 1)
        waits = np.bincount(src[~done], minlength=len(ids))
        users = neighbours(len(ids), dst[~done], src[~done])
        layer, waits = layer.tolist(), waits.tolist()
        order = [i for i in np.flatnonzero(own).tolist() if not waits[i]]
        for x in order:
            up = layer[x] + 1
            for y in users[x]:
                if layer[y] < up:
                    layer[y] = up
                waits[y] -= 1
                if not waits[y]:
                    order.append(y)
        order = np.asarray(order, dtype=np.int64)
        return pa.table({"id": ids.take(pa.array(order)), "layer": np.asarray(layer, dtype=np.int64)[order]})

    w, done = checkpointed(waiting.select("src", "dst", "at")), []
    while not w.isEmpty():
        got = checkpointed(by_block(w, work, "id string, layer long", size))
        done.append(got)
        if got.isEmpty():
            break
        new = got.select(F.col("id").alias("dst"), F.col("layer").alias("new"))
        was, w = w, checkpointed(w.join(got.select(F.col("id").alias("src")), "src", "left_anti").join(new, "dst", "left").select("src", "dst", F.coalesce("at", "new").alias("at")))
        dropped(was)
    dropped(w)
    return done


def reached(links: DataFrame, start: str, size: int = BLOCK_LINKS) -> DataFrame:
    """(id, level) of what a walk over links(src, dst) from start reaches, itself with level 0, level being the fewest links to it.

    Each round reads only the blocks that something new or nearer came to.
    """
    n = max(1, -(-links.count() // size))
    e = checkpointed(links.select("src", "dst").repartitionByRange(n, "src").withColumn("block", F.spark_partition_id()), "block")
    ends = sorted((last, block) for block, last in e.groupBy("block").agg(F.max("src")).collect() if last is not None)
    lasts, numbers = [x for x, _ in ends], [x for _, x in ends]

    def block_of(id: str) -> int:
        at = bisect.bisect_left(lasts, id)
        return numbers[at] if at < len(numbers) else -1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        d = pa.Table.from_batches(held)
        # What has come to the block is a link to itself that has a level.
        ids, src, dst, own = places(d.filter(pc.is_valid(d["dst"])))
        level = d.filter(pc.is_valid(d["dst"]))["level"].cast(pa.float64()).to_numpy()
        far = np.full(len(ids), np.inf)
        come = ~np.isnan(level)
        np.minimum.at(far, src[come], level[come])
        to, todo, far, own = neighbours(len(ids), src[~come], dst[~come]), [(x, i) for i, x in enumerate(far.tolist()) if x < np.inf], far.tolist(), own.tolist()
        heapq.heapify(todo)
        while todo:
            x, i = heapq.heappop(todo)
            if x == far[i] and own[i]:
                for j in to[i]:
                    if x + 1 < far[j]:
                        far[j] = x + 1
                        heapq.heappush(todo, (x + 1, j))
        at = [i for i, x in enumerate(far) if x < np.inf]
        names = ids.take(pa.array(at, pa.int64()))
        yield from pa.table({"id": names, "level": pa.array([int(far[i]) for i in at], pa.int64()), "block": pa.array([-1 if own[i] else block_of(x) for i, x in zip(at, names.to_pylist())], pa.int32())}).to_batches()

    best = checkpointed(links.sparkSession.createDataFrame([(start, 0, block_of(start))], "id string, level long, block int"))
    front = best.where("block >= 0")
    while blocks := [r[0] for r in front.select("block").distinct().collect()]:
        there = e.where(F.col("block").isin(blocks)).select("src", "dst", F.lit(None).cast("long").alias("level"), "block")
        both = there.unionByName(front.select(F.col("id").alias("src"), F.col("id").alias("dst"), "level", "block")).repartition(len(blocks), "block")
        got = checkpointed(both.mapInArrow(work, "id string, level long, block int"))
        near = got.groupBy("id").agg(F.min("level").alias("level"), F.max("block").alias("block")).join(best.select("id", F.col("level").alias("old")), "id", "full_outer")
        # A block that is not -1 is still to be walked.
        new = (F.col("old").isNull() | (F.col("level") < F.col("old"))) & F.col("level").isNotNull()
        was, best = best, checkpointed(near.select("id", F.least("level", "old").alias("level"), F.when(new, F.col("block")).otherwise(-1).alias("block")))
        dropped(was, got)
        front = best.where("block >= 0")
    dropped(e)
    return best.select("id", "level")
