"""Sharding: a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `vnodes` points on a ring of 2**32 places. A row belongs to
the first point at or after its key's hash; rows that find a shard full go on
clockwise. With `slack` 0 the capacities are the exact equal shares (counts at
most one apart); with a positive slack a shard takes up to
ceil((1 + slack) * rows / shards), so fewer rows have to move on.

The rows stay in the JVM. The driver sees only one count per (cell, arc) of the
ring, `cells` + shards * vnodes numbers at most, and decides from them how many
rows of each arc go where; a row finds its shard by its rank in the ring.

Defined results: a null text has size 1 and CRC 0; a null key hashes like any
value; repeated rows get slots of their own; an empty table gives no rows;
columns other than key and text are not looked at.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import offsets, written

RING = 1 << 32


def ring_points(n_shards: int, vnodes: int) -> list[tuple[int, int]]:
    """Sorted (place, shard); a shard's points do not depend on the other shards."""
    at = {}
    for s in range(n_shards):
        for v in range(vnodes):
            at.setdefault(int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=4).digest(), "big"), s)
    return sorted(at.items())


def capacities(rows: int, n_shards: int, slack: float) -> list[int]:
    if slack > 0:
        return [ceil((1 + slack) * rows / n_shards)] * n_shards
    return [rows // n_shards + (s < rows % n_shards) for s in range(n_shards)]


def allocate(counts: list[int], owners: list[int], room: list[int]) -> list[list[tuple[int, int, int]]]:
    """For each arc its pieces (first rank in the arc, shard, first slot), in order.

    In round k the rows of arc a that are still without a shard try the point
    a + k; earlier arrivals keep their place.
    """
    left, room, used = list(counts), list(room), [0] * len(room)
    pieces: list[list[tuple[int, int, int]]] = [[] for _ in counts]
    waiting, k = [a for a, c in enumerate(left) if c], 0
    while waiting:
        for a in waiting:
            s = owners[(a + k) % len(owners)]
            if take := min(left[a], room[s]):
                pieces[a].append((counts[a] - left[a], s, used[s]))
                left[a] -= take
                room[s] -= take
                used[s] += take
        waiting, k = [a for a in waiting if left[a]], k + 1
    return pieces


def shard(docs: DataFrame, n_shards: int, *, key: str = "doc_id", text: str = "text", slack: float = 0.0, vnodes: int = 64, cells: int = 1024, spread: int = 16) -> DataFrame:
    """One row per row of docs: key, size, text_crc32, shard, slot (from 0 in its shard)."""
    points = ring_points(n_shards, vnodes)
    places, owners = [p for p, _ in points], [s for _, s in points]
    width = RING // cells
    first = [bisect_left(places, c * width) for c in range(cells)] + [len(places)]
    at = F.lit(places)
    pos, cell = F.col("_pos"), F.col("_cell")

    def pick(values: list[int], i):
        return F.get(F.lit(values), i)

    begin, end = pick(first, cell), pick(first, cell + 1)
    t = docs.select(
        F.col(key).alias(key),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(key).bitwiseAND(RING - 1).alias("_pos"),
    )
    # Parts of a ring cell, by what the row holds: the order does not depend on how the rows are dealt.
    t = t.withColumn("_sub", F.pmod(F.xxhash64(key, "text_crc32", "size", F.lit("sub")), F.lit(spread)).cast("int"))
    t = t.withColumn("_cell", F.floor(pos / width).cast("int"))
    t = t.withColumn("_arc", (begin + F.size(F.filter(F.slice(at, begin + 1, end - begin), lambda v: v < pos))).cast("int"))
    # Along the ring both grow, so their sum names the pair of cell and arc.
    t = written(t.withColumn("_group", F.col("_cell") + F.col("_arc")), "ring")

    counts = {(r["_group"], r["_arc"]): r["count"] for r in t.groupBy("_group", "_arc").count().collect()}
    base, per_arc, start, total = [0] * (cells + len(places) + 1), [0] * (len(places) + 1), [0] * (len(places) + 1), 0
    for (g, a), c in sorted(counts.items()):
        if not per_arc[a]:
            start[a] = total
        base[g] = total
        per_arc[a] += c
        total += c
    # The last arc, past the last point, is the first point's.
    pieces = allocate(per_arc, [*owners, owners[0]], capacities(total, n_shards, slack)) if total else [[] for _ in per_arc]
    flat = [(start[a] + r, s, slot) for a, ps in enumerate(pieces) for r, s, slot in ps] or [(0, 0, 0)]
    index, seen = [], 0
    for ps in pieces:
        index.append(seen)
        seen += len(ps)
    index.append(seen)

    sub = offsets(t, "_sub", ["_group"], F.count(F.lit(1)))
    w = Window.partitionBy("_group", "_sub").orderBy("_pos", key, "text_crc32", "size")
    r = t.withColumn("_in", F.row_number().over(w) - 1).join(sub, ["_group", "_sub"])
    r = r.withColumn("_at", F.get(F.lit(base), F.col("_group")) + F.col("_off") + F.col("_in"))
    begin, end = pick(index, F.col("_arc")), pick(index, F.col("_arc") + 1)
    piece = begin - 1 + F.size(F.filter(F.slice(F.lit([x for x, _, _ in flat]), begin + 1, end - begin), lambda x: x <= F.col("_at")))
    r = r.withColumn("_piece", piece)
    return r.select(
        key, "size", "text_crc32",
        pick([s for _, s, _ in flat], F.col("_piece")).cast("int").alias("shard"),
        (F.col("_at") - pick([x for x, _, _ in flat], F.col("_piece")) + pick([s for _, _, s in flat], F.col("_piece"))).cast("long").alias("slot"),
    )
