"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of slots, each worth one block of `block` tokens. Slot i
has the point i * a mod 2**31 of a golden-ratio lattice; the cumulative slot
shares of the sources turn it into a source, its rank among that source's slots
into one of the source's blocks. A source's blocks are cut from its documents
in hashed order; past its last block a source starts again. A source's last
slot is trimmed, so it gives the rounded target exactly.

Targets: the weights share all tokens out; what a source would get beyond
`most` times its size is shared again among the rest by weight, until none is
above.

Only JVM operations run. The driver sees sums, never rows; nothing is ranked in
a single task but one count per range or chunk.

Defined results: a null text has size 0; documents of size 0 are taken 0 times;
the null source is a source of its own, ordered last; repeated rows are
documents of their own; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import boxed, bucketed, col, offsets, ranked, unboxed, words_of, written

LATTICE = 1 << 31
GOLDEN = 1327217885  # 2**31 / golden ratio, made odd

#: Buckets for each task of the input, so that few of them hold several tasks' rows.
BUCKETS_EACH = 2


@dataclass
class Mix:
    sources: DataFrame  # sid, source, size, weight, target, words, slots
    docs: DataFrame  # rid, key, source, sid, size, text_crc32, start
    schedule: DataFrame  # slot, sid, rank, epoch, block, words
    taken: DataFrame  # rid, key, source, size, text_crc32, source_size, target, taken


def _targets(sources: DataFrame, most: float) -> DataFrame:
    """Adds target: least(most * size, level * weight), where the level uses up the total."""
    total = sources.agg(F.sum("size")).first()[0] or 0
    cap, level, capped = F.col("size") * F.lit(float(most)), 0.0, -1
    while total:
        at = cap <= F.lit(level) * F.col("weight")
        r = sources.agg(F.sum(F.when(at, 1).otherwise(0)).alias("n"), F.sum(F.when(at, cap)).alias("c"), F.sum(F.when(~at, F.col("weight"))).alias("w")).first()
        if r["n"] == capped or not r["w"]:
            break
        capped, level = r["n"], (total - (r["c"] or 0.0)) / r["w"]
    return sources.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


def _prefix(df: DataFrame, value: Column) -> Column:
    """Running sum of value before each row of a ranked table: within a range; add its offset."""
    return F.coalesce(F.sum(value).over(Window.partitionBy("_pid").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _schedule(sources: DataFrame, block: int, slots: int) -> DataFrame:
    spark, cells = sources.sparkSession, 1024
    i = F.col("id")
    point = (i % LATTICE * GOLDEN % LATTICE).cast("double") / LATTICE
    s = spark.range(slots).select(i.alias("slot"), point.alias("u")).withColumn("cell", F.floor(F.col("u") * cells).cast("int"))
    lo, hi = F.col("first") / slots, (F.col("first") + F.col("slots")) / slots
    parts = sources.where("slots > 0").select("sid", lo.alias("lo"), hi.alias("hi"))
    parts = parts.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells).cast("int"), F.least(F.lit(cells - 1), F.floor(F.col("hi") * cells).cast("int")))))
    s = s.join(parts, "cell").where("u >= lo and u < hi")
    s = written(s.select("slot", "sid", F.floor(F.col("slot") / 1024).alias("chunk"), F.floor(F.col("slot") / (1 << 20)).alias("super")), "slots")
    far = offsets(s, "super", ["sid"], F.count(F.lit(1)))
    near = offsets(s, "chunk", ["sid", "super"], F.count(F.lit(1))).withColumnRenamed("_off", "_near")
    near = near.join(far, ["sid", "super"]).select("sid", "chunk", (F.col("_off") + F.col("_near")).alias("_base"))
    w = Window.partitionBy("sid", "chunk").orderBy("slot")
    s = s.withColumn("_in", F.row_number().over(w) - 1).join(near, ["sid", "chunk"]).select("slot", "sid", (F.col("_base") + F.col("_in")).alias("rank"))
    # The lattice gives a source its share but for a few slots: extra ones are
    # dropped, missing ones follow the last slot.
    have = s.groupBy("sid").agg(F.count(F.lit(1)).alias("_have"))
    lack = sources.where("slots > 0").join(have, "sid", "left").withColumn("_have", F.coalesce("_have", F.lit(0))).where("_have < slots")
    lack = lack.select((F.lit(slots) + F.col("first")).alias("_at"), "sid", F.explode(F.sequence("_have", F.col("slots") - 1)).alias("rank")).select((F.col("_at") + F.col("rank")).alias("slot"), "sid", "rank")
    s = s.union(lack).join(sources.select("sid", F.col("size").alias("source_size"), F.col("words").alias("source_words"), "slots"), "sid").where("rank < slots")
    blocks = F.ceil(F.col("source_size") / block)
    s = s.withColumns({"epoch": F.floor(F.col("rank") / blocks), "block": F.col("rank") % blocks})
    whole = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    left = F.col("source_words") - F.col("epoch") * F.col("source_size") - F.col("block") * block
    return s.select("slot", "sid", "rank", "epoch", "block", F.least(whole, left).alias("words"), whole.alias("_whole"))


def mix(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block: int = 256, buckets: int = 1024, row: str | None = None) -> Mix:
    """row: a column that tells rows apart; without one rows get numbers of their own."""
    rid = F.monotonically_increasing_id() if row is None else col(row)
    crc = F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long")
    t = docs.select(rid.alias("rid"), F.col(key).alias(key), F.col(source).alias("source"), F.size(words_of(F.col(text))).cast("long").alias("size"), crc.alias("text_crc32"))
    t = written(t.withColumn("h", F.xxhash64(key, "text_crc32")), "sizes")

    by = t.groupBy("source").agg(F.sum("size").alias("size"))
    by = ranked(by, [F.col("source").asc_nulls_last()], "sources").withColumnRenamed("_rank", "sid")
    weight = F.get(F.lit([float(x) for x in weights]), (F.col("sid") % len(weights)).cast("int"))
    by = written(_targets(written(by.withColumn("weight", weight), "weighted"), most).withColumn("words", F.floor(F.col("target") + 0.5)), "targets")
    full, rest = F.floor(F.col("words") / F.col("size")), F.col("words") % F.col("size")
    need = F.when(F.col("size") > 0, full * F.ceil(F.col("size") / block) + F.ceil(rest / block)).otherwise(F.lit(0))
    by = written(by.withColumn("slots", need.cast("long")), "needs")
    ahead = offsets(by, "_pid", [], F.sum("slots"))
    by = by.withColumnRenamed("sid", "_rank").withColumn("_before", _prefix(by, F.col("slots"))).join(F.broadcast(ahead), "_pid")
    by = written(by.withColumn("first", F.col("_off") + F.col("_before")).withColumnRenamed("_rank", "sid").drop("_off", "_before", "_pid"), "sources")
    slots = by.agg(F.sum("slots")).first()[0] or 0

    t = t.join(by.select(F.col("source").alias("_s"), "sid", F.col("size").alias("source_size"), "target"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    t = t.withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    base = offsets(t, "bucket", ["sid"], F.sum("size"))
    w = Window.partitionBy("sid", "bucket").orderBy("h", key, "size", "rid").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_in", F.coalesce(F.sum("size").over(w), F.lit(0))).join(base, ["sid", "bucket"])
    t = written(t.select("rid", key, "source", "sid", "size", "text_crc32", "source_size", "target", (F.col("_off") + F.col("_in")).alias("start")), "streams")

    schedule = written(_schedule(by, block, slots), "schedule")
    uses = schedule.groupBy("sid", "block").agg(F.sum(F.when(F.col("words") == F.col("_whole"), 1).otherwise(0)).alias("_full"), F.max(F.when(F.col("words") < F.col("_whole"), F.col("words")).otherwise(F.lit(0))).alias("_cut"))
    p = t.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    p = p.withColumns({"lo": F.greatest(F.col("start") - F.col("block") * block, F.lit(0)), "hi": F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))})
    p = p.join(uses, ["sid", "block"]).withColumn("_w", F.col("_full") * (F.col("hi") - F.col("lo")) + F.greatest(F.lit(0), F.least("hi", "_cut") - F.col("lo")))
    taken = t.join(p.groupBy("rid").agg(F.sum("_w").alias("taken")), "rid", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    return Mix(by, t, schedule.drop("_whole"), taken.drop("sid", "start"))


def mixed_rows(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of docs as often as the mix takes them, to the nearest whole copy.

    Each row is taken for itself, whatever it has in common with others. Rows
    without words are no part of the shares and stay once.
    """
    # Copies come to the rows: those of one task of the input as one array, in the order of its numbers. Texts are not shuffled.
    rows = boxed(docs, rid=F.monotonically_increasing_id(), part=F.spark_partition_id(), key=col(key), text=col(text), source=col(source))
    d = bucketed(rows, "part", BUCKETS_EACH * max(1, rows.rdd.getNumPartitions()), "rows")
    took = mix(d, key="key", text="text", source="source", row="rid", **options).taken
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int")
    each = took.select(F.shiftright("rid", 33).cast("int").alias("part"), F.struct("rid", copies.alias("copies")).alias("c"))
    each = each.groupBy("part").agg(F.array_sort(F.collect_list("c"))["copies"].alias("all"))
    out = d.select("row", "rid", "part").join(each.hint("shuffle_hash"), "part").select("row", F.get("all", F.col("rid").bitwiseAND(F.lit((1 << 33) - 1)).cast("int")).alias("copies"))
    return unboxed(out.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), "copies"))))
