"""Order MinHash document fingerprints.

A text's k-mers are its runs of k code points, each with its occurrence number,
so that a repeated k-mer is several elements. A hash deals the elements to
`cells` cells and ranks them there; each cell selects its `picks` smallest,
puts them back into text order and hashes the tuple. One hash per element takes
the place of one permutation per cell. Two texts agree in a cell if the same
k-mers are smallest there and stand in the same order, so moved, inserted and
deleted passages lower the likeness as edit distance grows.

A fingerprint is 4 hex digits per cell; a cell without elements is 0000, and no
tuple has that value. Likeness is the share of agreeing cells among those that
have elements in either text; two texts without any are alike (1).

Defined results: a null text is the empty text, whose fingerprint is all zeros;
texts shorter than k are one element; equal texts have equal fingerprints; the
last document's next one is the first; a single document is its own next one;
rows that share a key are ordered by text; null keys come last, ordered by a
hash of the text; an empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import partitions

K, CELLS, PICKS = 5, 64, 2


def fingerprinter(k: int = K, cells: int = CELLS, picks: int = PICKS):
    """text -> fingerprint, an array of cells 16-bit numbers."""
    import numpy as np

    u = np.uint64
    weights = [u(w | 1) for w in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]

    def mix(x):
        x = (x ^ (x >> u(32))) * u(0xD6E8FEB86659FD93)
        x = (x ^ (x >> u(32))) * u(0xD6E8FEB86659FD93)
        return x ^ (x >> u(32))

    def of(text):
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        out = np.zeros(cells, dtype=np.uint16)
        if not len(c):
            return out
        n = max(1, len(c) - k + 1)
        h = np.zeros(n, dtype=np.uint64)
        for i in range(min(k, len(c))):
            h += (c[i : i + n] + u(i // len(weights))) * weights[i % len(weights)]
        if len(c) < k:
            h += u(len(c))
        h = mix(h)
        # Occurrence numbers: equal k-mers lie together in sorted order, first ones first.
        order = np.argsort(h, kind="stable")
        s = h[order]
        new = np.ones(n, dtype=bool)
        new[1:] = s[1:] != s[:-1]
        at = np.arange(n)
        nth = at - np.maximum.accumulate(np.where(new, at, 0))
        e = np.empty(n, dtype=np.uint64)
        e[order] = mix(s + nth.astype(np.uint64) * u(0x9E3779B97F4A7C15))
        # The smallest of each cell: only small values can be among them, so a
        # prefix of the sorted values is enough once every cell has its picks there.
        few = min(n, cells * picks * 6)
        while True:
            cand = np.argpartition(e, few - 1)[:few] if few < n else np.arange(n)
            cell = (e[cand] % u(cells)).astype(np.int64)
            if few == n or np.bincount(cell, minlength=cells).min() >= picks:
                break
            few = min(n, few * 4)
        srt = np.lexsort((e[cand], cell))
        cell, cand = cell[srt], cand[srt]
        first = np.searchsorted(cell, np.arange(cells))
        rank = np.arange(len(cell)) - first[cell]
        low = rank < picks
        cell, cand = cell[low], cand[low]
        srt = np.lexsort((cand, cell))
        cell, cand = cell[srt], cand[srt]
        place = np.arange(len(cell)) - np.searchsorted(cell, np.arange(cells))[cell]
        part = mix(e[cand] * u(2) + u(1) + place.astype(np.uint64) * u(0xC2B2AE3D27D4EB4F))
        total = np.zeros(cells, dtype=np.uint64)
        np.add.at(total, cell, part)
        there = np.bincount(cell, minlength=cells) > 0
        out[there] = (mix(total[there]) % u(65535)).astype(np.uint16) + np.uint16(1)
        return out

    return of


def likeness(a, b) -> float:
    either = (a > 0) | (b > 0)
    n = int(either.sum())
    return 1.0 if not n else float(((a == b) & either).sum()) / n


def in_order(docs: DataFrame, *, key: str, text: str, per_task: int = 8) -> DataFrame:
    """Rows by descending key in ranges; each range ends with the first row of the next one (own = false).

    The driver sees one key per range. Rows of a key stay in one range; rows
    without a key lie in ranges of their text's hash, after all others.
    """
    spark = docs.sparkSession
    ranges = per_task * partitions(spark)
    d = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    keys = d.select("k").where("k is not null").repartitionByRange(ranges, F.col("k").desc())
    heads = keys.groupBy(F.spark_partition_id()).agg(F.max("k").alias("k")).agg(F.sort_array(F.collect_set("k"), asc=False)).first()[0]
    hashed = F.when(F.col("k").isNull(), F.xxhash64("t"))
    bucket = F.floor((F.shiftright(hashed, 32) + (1 << 31)) * ranges / (1 << 32)).cast("int")
    d = d.withColumns({"h": hashed, "b": bucket})
    loose = sorted((r["b"], r["h"]) for r in d.where("k is null").groupBy("b").agg(F.min("h").alias("h")).collect())
    n = len(heads) + len(loose)
    part = head = None
    if heads:
        # Binary search in the descending heads: how many are at or above the key.
        arr, steps = F.lit(heads), max(1, len(heads).bit_length() + 1)
        middle = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        above = lambda s: F.struct((middle(s) + 1).alias("lo"), s["hi"].alias("hi"))
        below = lambda s: F.struct(s["lo"].alias("lo"), middle(s).alias("hi"))
        found = F.aggregate(
            F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0).alias("lo"), F.lit(len(heads)).alias("hi")),
            lambda s, _: F.when(s["lo"] < s["hi"], F.when(F.get(arr, middle(s)) >= F.col("k"), above(s)).otherwise(below(s))).otherwise(s),
        )
        part = found["lo"] - 1
        head = F.get(arr, part.cast("int")) == F.col("k")
    if loose:
        at = F.array_position(F.lit([b for b, _ in loose]), F.col("b")) - 1
        own, first = F.lit(len(heads)) + at, F.get(F.lit([h for _, h in loose]), at.cast("int")) == F.col("h")
        null = F.col("k").isNull()
        part, head = (own, first) if part is None else (F.when(null, own).otherwise(part), F.when(null, first).otherwise(head))
    d = d.withColumn("part", (F.lit(0) if part is None else part).cast("int")).withColumn("head", F.lit(False) if head is None else head)
    own = F.struct(F.col("part").alias("part"), F.lit(True).alias("own"))
    ghost = F.struct(((F.col("part") + n - 1) % n if n else F.lit(0)).cast("int").alias("part"), F.lit(False).alias("own"))
    d = d.withColumn("p", F.explode(F.when(F.col("head"), F.array(own, ghost)).otherwise(F.array(own)))).select("k", "t", "h", "p.part", "p.own")
    d = d.repartition(partitions(spark), "part").sortWithinPartitions(F.col("part"), F.col("own").desc(), F.col("k").desc_nulls_last(), F.col("h"), F.col("t"))
    return d.drop("h")


def compared(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = K, cells: int = CELLS, picks: int = PICKS) -> DataFrame:
    """Fingerprints of every text and of the text with its last third replaced by the next one's start."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = fingerprinter(k, cells, picks)

        def hexed(f):
            return f.astype(">u2").tobytes().hex()

        def close(held, text, mark):
            key, own, f = held
            n = len(own)
            edited = own[: n - n // 3] + text[: n // 3]
            g = of(edited)
            return (key, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), hexed(f), hexed(g), likeness(f, g), likeness(f, mark))

        names = ["k", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        held, part = None, None
        for b in batches:
            out = []
            for key, t, p, own in zip(b["k"], b["t"], b["part"], b["own"]):
                if p != part:
                    held, part = None, p
                if held is None and not own:
                    continue
                f = of(t)
                if held is not None:
                    out.append(close(held, t, f))
                held = (key, t, f) if own else None
            if out:
                yield pd.DataFrame(out, columns=names)

    kind = dict(docs.select(F.col(key).alias("k")).dtypes)["k"]
    rows = in_order(docs, key=key, text=text).withColumn("k", F.col("k").cast("string"))
    got = rows.mapInPandas(go, f"k string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return got.select(F.col("k").cast(kind).alias(key), *got.columns[1:])
