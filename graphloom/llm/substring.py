"""Substring dedup by seed and extend.

A passage of `window` words that starts in two places is removed in both. Seeds
are winnowed anchors: of the k-grams of every window the one with the smallest
hash (the last of equal ones), so equal windows choose the same anchor at the
same distance. Anchors that occur once are dropped. The others are extended both
ways, by as many words as keep the anchor the window's seed. Extents that are
equal elsewhere are repeats as a whole; the others, and one of each kind of
equal ones, meet window by window. Repeats that overlap join into maximal ones;
what these cover is removed.

Anchors, extents and texts that many rows share are salted in joins.

Meeting is counted, never paired: a passage that a third of all documents share
costs each of them a row per anchor. Sequences are compared by 128 bits of
hashes. Documents are known by a hash of their text, as the result depends on
nothing else of them.

Defined results: a null text has no words; texts shorter than the window stay
whole; of repeated rows all windows are repeats, so all their words go when
there are enough; an empty table gives no rows; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, boxed, col, freed, hot_keys, spread_join, written

WINDOW, ANCHOR = 35, 8


def hasher():
    """text -> two 64-bit hashes of each word, and hashes of runs of these; the same on every machine."""
    import numpy as np

    rng = np.random.default_rng(7)
    table = rng.integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = 0x9E3779B97F4A7C15 | 1
    inverse = pow(base, -1, 1 << 64)
    powers, inverses = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)
    gap = np.zeros(256, dtype=bool)
    gap[[9, 10, 11, 12, 13, 32]] = True

    def grow(n):
        nonlocal powers, inverses
        if n > len(powers):
            n = max(n, 2 * len(powers))
            first = np.ones(1, dtype=np.uint64)
            powers = np.cumprod(np.concatenate([first, np.full(n - 1, base, dtype=np.uint64)]))
            inverses = np.cumprod(np.concatenate([first, np.full(n - 1, inverse, dtype=np.uint64)]))

    def mix(x):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def between(values, start, end):
        grow(len(values) + 1)
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values * powers[: len(values)], dtype=np.uint64)])
        return mix((sums[end] - sums[start]) * inverses[start] + (end - start).astype(np.uint64))

    def words(text):
        data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
        inside = np.concatenate([[False], ~gap[data], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edges[::2], edges[1::2]
        return between(table[0][data], start, end), between(table[1][data], start, end)

    def spans(values, start, length):
        """Hashes of `length` values from each start."""
        return between(values, start, start + length)

    return words, spans


def seeds(kgrams, width: int):
    """For every run of `width` k-grams the place of its smallest, the last of equal ones."""
    import numpy as np

    view = np.lib.stride_tricks.sliding_window_view(kgrams, width)[:, ::-1]
    return np.arange(len(view)) + width - 1 - view.argmin(axis=1)


def text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("text"), text, F.length(text)).alias("t2")]


def _rows(names: str, cols) -> pd.DataFrame:
    import numpy as np

    return pd.DataFrame(dict(zip(names.split(), map(np.concatenate, cols))))


def _common(docs: DataFrame, text: str) -> DataFrame | None:
    """Texts that over one row in 1024 has."""
    t = docs.where(col(text).isNotNull()).select(*text_key(col(text)))
    return hot_keys(written(t.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated-texts"), ["t1", "t2"])


def repeats(docs: DataFrame, *, text: str = "text", window: int = WINDOW, anchor: int = ANCHOR, common: DataFrame | None = None) -> DataFrame:
    """(t1, t2, spans): for texts with repeated windows the first and last of each run of these, by first word."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    width = window - anchor + 1

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        words, spans = hasher()
        for b in batches:
            cols = [[], [], [], [], [], []]
            for t1, t2, t in zip(b["t1"], b["t2"], b["t"]):
                h, g = words(t)
                if len(h) < window:
                    continue
                k = spans(h, np.arange(len(h) - anchor + 1), anchor)
                at = seeds(k, width)
                # Windows with one seed follow each other; their extent is what the seed can grow to.
                lo = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                hi = np.concatenate([lo[1:], [len(at)]]) - 1
                e = spans(g, lo, hi - lo + window) + (at[lo] - lo).astype(np.uint64)
                for c, v in zip(cols, (k[at[lo]].astype(np.int64), e.astype(np.int64), np.full(len(lo), t1), np.full(len(lo), t2), lo.astype(np.int32), hi.astype(np.int32))):
                    c.append(v)
            if cols[0]:
                yield _rows("a e t1 t2 lo hi", cols)

    t = docs.select(*text_key(col(text)), col(text).alias("t")).where(F.col("t").isNotNull())
    anchors = scratch.keep(t.mapInPandas(find, "a long, e long, t1 long, t2 long, lo int, hi int"), "anchors")
    often = anchors.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("e").alias("x"), F.max("e").alias("y")).where("n > 1")
    often = scratch.keep(often.select("a", "n", (F.col("x") != F.col("y")).alias("mixed")), "frequent-anchors")
    met = scratch.keep(spread_join(anchors, often.drop("n"), ["a"], "inner", hot_keys(often, ["a"])), "met")
    freed(spark)
    # Where all extents of a seed are equal, everything in them is repeated. Else
    # equal extents are, and one of each kind meets the others window by window.
    mixed = met.where("mixed")
    kinds = mixed.groupBy("a", "e").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("t1", "t2", "lo", "hi")).alias("one"))
    kinds = scratch.keep(kinds.select("a", "e", "n", "one.*"), "extents")
    whole = met.where("not mixed").select("t1", "t2", "lo", "hi").union(spread_join(mixed, kinds.where("n > 1").select("a", "e"), ["a", "e"], "left_semi", hot_keys(kinds, ["a", "e"])).select("t1", "t2", "lo", "hi"))
    grow = kinds.groupBy("t1", "t2").agg(F.collect_list(F.struct("lo", "hi", (F.col("n") == 1).alias("alone"))).alias("extents"))
    grow = scratch.keep(grow, "growing")

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        words, spans = hasher()
        names = "w1 w2 t1 t2 at alone"
        for b in batches:
            cols, size = [[], [], [], [], [], []], 0
            for t1, t2, t, extents in zip(b["t1"], b["t2"], b["t"], b["extents"]):
                h, g = words(t)
                s = np.concatenate([np.arange(x["lo"], x["hi"] + 1) for x in extents])
                alone = np.concatenate([np.full(x["hi"] - x["lo"] + 1, x["alone"]) for x in extents])
                for c, v in zip(cols, (spans(h, s, window).astype(np.int64), spans(g, s, window).astype(np.int64), np.full(len(s), t1), np.full(len(s), t2), s.astype(np.int32), alone)):
                    c.append(v)
                size += len(s)
                if size > 200_000:
                    yield _rows(names, cols)
                    cols, size = [[], [], [], [], [], []], 0
            if cols[0]:
                yield _rows(names, cols)

    windows = spread_join(t, grow, ["t1", "t2"], "inner", common).select("t1", "t2", "t", "extents").mapInPandas(extend, "w1 long, w2 long, t1 long, t2 long, at int, alone boolean")
    windows = scratch.keep(windows, "windows")
    freed(spark)
    again = scratch.keep(windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.max("alone").alias("alone")).where("n > 1 and alone").select("w1", "w2"), "repeated-windows")
    single = windows.where("alone").join(again, ["w1", "w2"], "left_semi").select("t1", "t2", F.col("at").alias("lo"), F.col("at").alias("hi"))
    found = whole.union(single).groupBy("t1", "t2", "lo", "hi").agg(F.lit(1).alias("one"))
    out = written(found.groupBy("t1", "t2").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "repeats")
    scratch.drop()
    freed(spark)
    return out


def _cut(docs: DataFrame, text: str, window: int, anchor: int) -> DataFrame:
    """(row, cut) of every row: cut = struct(n_words, n_removed, kept)."""
    common = _common(docs, text)
    found = repeats(docs, text=text, window=window, anchor=anchor, common=common)

    @F.pandas_udf("struct<n_words:long,n_removed:long,kept:string>")
    def rest(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        import numpy as np

        out = []
        for t, s in zip(texts, spans):
            words = (t or "").encode("utf-8", "surrogatepass").split()
            n = len(words)
            if s is not None and len(s):
                edge = np.zeros(n + 1, dtype=np.int64)
                np.add.at(edge, np.array([x["lo"] for x in s]), 1)
                np.add.at(edge, np.array([x["hi"] for x in s]) + window, -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
            out.append((n, n - len(words), b" ".join(words).decode("utf-8", "surrogatepass")))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])

    t1, t2 = text_key(col(text))
    d = boxed(docs, t=col(text), t1=F.coalesce(t1, F.lit(0)), t2=F.coalesce(t2, F.lit(0)))
    return spread_join(d, found, ["t1", "t2"], "left", common).select("row", rest("t", "spans").alias("cut"))


def cut(docs: DataFrame, *, text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """docs with _cut = struct(n_words, n_removed, kept): kept is the rest, words joined by one space. An input column _cut is replaced."""
    return _cut(docs.drop("_cut"), text, window, anchor).select("row.*", F.col("cut").alias("_cut"))


def without_repeats(docs: DataFrame, *, text: str = "text", n_chars: str = "n_chars", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """docs with what is left of each text; texts without repeats stay as they are, n_chars follows where there is such a column."""
    got, row = _cut(docs, text, window, anchor), F.col("row")
    new = F.when(F.col("cut.n_removed") > 0, F.col("cut.kept")).otherwise(row.getField(text))
    change = {text: new, n_chars: F.char_length(new).cast("long")}
    return got.select(*[change.get(c, row.getField(c)).alias(c) for c in docs.columns])
