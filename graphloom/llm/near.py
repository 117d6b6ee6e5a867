"""Near-duplicates at 80 % common shingles: SimHash balls first, then what these cannot reach.

Two texts link where the Jaccard similarity of their sets of 5-word shingles is
0.8 or more. At 0.8 two 64-bit SimHash fingerprints differ in about ten bits,
and balls of half that radius are too large to emit; so the ball hashing of
`simhash` (3 bits) finds the closest pairs, each checked on the whole sets, and
a join on shared shingles the rest. No pair is missed:

1. Every set has a fingerprint over its shingles. Sets of one fingerprint and
   sets of linked ones are compared whole; what is similar is one component.
   Large groups of near copies mostly end here.
2. The shingles of each text are put in one order that all texts share, those
   that a sample finds common last. A pair of 80 of 100 shares at least 80 % of
   the larger set, so the first fifth (and one) of both have a shingle in
   common. Texts that share none of these are no candidates. The sample changes
   what this costs, not what it finds.
3. Of the texts at one shingle, neighbours are compared, whole sets against
   whole sets, and those that link become components; again in other orders
   while many pairs are left and many of them link.
4. What is left at a shingle in different components are pairs, of which sizes,
   places and parity bits rule out most before whole sets are compared: 512 bits
   say of how many elements with a bit a set has an odd number, so in as many
   bits as two sets disagree, at least, they differ by an element. Of long texts
   all bits are chance, so these have counts besides, in places that grow with
   the set: by as much as two sets' counts differ, at least, they differ too.

Texts with equal sets are one node from the start.

Defined results: shingles are hashed to 48 bits; letters A to Z are folded; a
text of fewer than five words is one shingle; null, empty and word-less texts
have the empty set, which links to itself only; null keys are left out of a
class's smallest key; an empty table gives no rows; columns other than key and
text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from ._components import components
from ._shared import Scratch, boxed, col, freed, hot_keys, small_batches, spread_join, unboxed, written

SHINGLE, PERCENT, SEED = 5, 80, 42
#: One text in SAMPLE is looked at for common shingles, and so many of these are remembered.
SAMPLE, COMMON = 16, 50_000
WIDTH = 6
#: Neighbours are compared again, in other orders, while more pairs than CROWD are left for each text at a shingle
#: and the comparison before linked one in FEW of these or more.
CROWD, FEW = 4, 64
#: The hashes of texts with candidates are sent to all tasks, so that no other text moves, where there are no more than this; else they are joined.
SENT = 250_000
#: Words of 64 parity bits for each set.
PARITY = 8
#: Sets of more elements than LONG have counts too, one byte for at most EACH elements.
LONG, EACH = 512, 8


def hashes(text: str | None, shingle: int = SHINGLE):
    """The set of a text's shingles as sorted 64-bit numbers."""
    import numpy as np
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        each = [h(b" ".join(words), SEED)]
    else:
        each = [h(b" ".join(x), SEED) for x in zip(*(words[i:] for i in range(shingle)))]
    return np.unique(np.array(each, dtype="<u8"))


def shingles(hashed):
    """The same as sorted 48-bit numbers."""
    import numpy as np

    return np.unique(hashed >> np.uint64(64 - 8 * WIDTH))


def parity(grams):
    """Which of 512 remainders an odd number of elements has, as 64-bit numbers."""
    import numpy as np

    odd = np.bincount((grams % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def counts(grams) -> bytes | None:
    """How many elements have each remainder, modulo 256, for the least power of two of remainders; None for small sets."""
    import numpy as np

    if len(grams) <= LONG:
        return None
    places = 1 << (-(-len(grams) // EACH) - 1).bit_length()
    return np.bincount((grams % np.uint64(places)).astype(np.int64), minlength=places).astype(np.uint8).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """By how many elements two sets differ, at least: their counts, the longer folded to the shorter, around 256."""
    import numpy as np

    a, b = sorted((np.frombuffer(x, dtype=np.uint8), np.frombuffer(y, dtype=np.uint8)), key=len)
    d = a - b.reshape(-1, len(a)).sum(axis=0, dtype=np.uint8)
    return int(np.minimum(d, -d).sum(dtype=np.int64))


def _bytes(grams) -> bytes:
    import numpy as np

    return np.ascontiguousarray(grams.view(np.uint8).reshape(-1, 8)[:, :WIDTH]).tobytes()


def _numbers(data: bytes):
    import numpy as np

    out = np.zeros((len(data) // WIDTH, 8), dtype=np.uint8)
    out[:, :WIDTH] = np.frombuffer(data, dtype=np.uint8).reshape(-1, WIDTH)
    return out.reshape(-1).view("<u8")


#: So many texts are held as arrays at once.
ROWS = 500


def _common(docs: DataFrame, text: str, shingle: int) -> list[int]:
    """Shingles that the sample has more than once, the most common last."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for b in batches:
            for at in range(0, len(b), ROWS):
                yield pd.DataFrame({"gram": np.concatenate([shingles(hashes(t, shingle)) for t in b["t"].iloc[at : at + ROWS]]).astype("int64")})

    some = docs.where(F.pmod(F.xxhash64(col(text)), F.lit(SAMPLE)) == 0).select(col(text).alias("t"))
    got = some.mapInPandas(of, "gram long").groupBy("gram").count().where("count > 1")
    return [r["gram"] for r in got.orderBy(F.desc("count"), "gram").limit(COMMON).collect()][::-1]


def _hash_of(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data, SEED) - (1 << 63)


def sets(docs: DataFrame, key: str = "doc_id", text: str = "text", *, shingle: int = SHINGLE) -> DataFrame:
    """(key, h, sid, n, fp, odd, counts): a row's text hash, its set's name, size, fingerprint, parity bits and, of a long text, counts."""
    kind = dict(docs.select(col(key).alias("k")).dtypes)["k"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (whole.iloc[at : at + ROWS] for whole in batches for at in range(0, len(whole), ROWS)):
            out = []
            for t in b["t"]:
                hashed = hashes(t, shingle)
                g = shingles(hashed)
                fp = simhash.of_hashes(hashed) if len(g) else 0
                out.append((_hash_of(_bytes(g)), len(g), fp - (fp >> 63 << 64), parity(g), counts(g)))
            got = pd.DataFrame(out, columns=["sid", "n", "fp", "odd", "counts"])
            yield pd.concat([b[["k", "h"]].reset_index(drop=True), got], axis=1)

    d = docs.select(col(key).alias("k"), F.xxhash64(col(text)).alias("h"), col(text).alias("t"))
    return d.mapInPandas(read, f"k {kind}, h long, sid long, n int, fp long, odd array<long>, counts binary").withColumnRenamed("k", key)


def heads(docs: DataFrame, text: str = "text", *, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(gram, sid, n, pos): the shingles that each set is found by; sets that a task meets again are left out."""
    common = _common(docs, text, shingle)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        known = np.array(common, dtype="<u8")
        by = np.argsort(known)
        known, place, met = known[by], by + 1, set()
        for texts in (whole["t"].iloc[at : at + ROWS] for whole in batches for at in range(0, len(whole), ROWS)):
            out = []
            for t in texts:
                g = shingles(hashes(t, shingle))
                n, sid = len(g), _hash_of(_bytes(g))
                if not n or sid in met:
                    continue
                met.add(sid)
                rank = np.zeros(n, dtype=np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, g), len(known) - 1)
                    rank = np.where(known[at] == g, place[at], 0)
                least = -(-percent * n // 100)
                out.append((sid, n, g[np.argsort(rank, kind="stable")][: n - least + 1].astype("int64")))
            if out:
                long = [len(x[2]) for x in out]
                yield pd.DataFrame({"gram": np.concatenate([x[2] for x in out]), "sid": np.repeat(np.array([x[0] for x in out], dtype=np.int64), long), "n": np.repeat(np.array([x[1] for x in out], dtype=np.int32), long), "pos": np.concatenate([np.arange(m, dtype=np.int32) for m in long])})

    return docs.select(col(text).alias("t")).mapInPandas(read, "gram long, sid long, n int, pos int")


def _whole(docs: DataFrame, text: str, texts: DataFrame, shingle: int) -> DataFrame:
    """(sid, grams): the whole sets of texts(h), each once; few texts are sent to all tasks, so that no others move."""
    if texts.count() <= SENT:
        texts = F.broadcast(texts)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met = set()
        for part in (whole["t"].iloc[at : at + ROWS] for whole in batches for at in range(0, len(whole), ROWS)):
            out = []
            for t in part:
                data = _bytes(shingles(hashes(t, shingle)))
                sid = _hash_of(data)
                if sid not in met:
                    met.add(sid)
                    out.append((sid, data))
            if out:
                yield pd.DataFrame(out, columns=["sid", "grams"])

    d = docs.select(F.xxhash64(col(text)).alias("h"), col(text).alias("t")).join(texts, "h", "left_semi")
    return d.select("t").mapInPandas(read, "sid long, grams binary").groupBy("sid").agg(F.first("grams").alias("grams"))


def _may(a: str, b: str, percent: int) -> Column:
    """Whether sets that first meet at these places can be similar enough: by size and by what stands behind."""
    na, nb = F.col(f"{a}n"), F.col(f"{b}n")
    behind = F.least(na - F.col(f"{a}pos"), nb - F.col(f"{b}pos"))
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (behind * (100 + percent) >= (na + nb) * percent)


def _differ(a: str, b: str) -> Column:
    """In how many parity bits two sets disagree."""
    each = [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(PARITY)]
    return sum(each[1:], each[0])


def _near_enough(percent: int) -> Column:
    """Whether sets with n, odd and _n, _odd can be similar enough: they differ by as many elements as bits, at least."""
    return _differ("odd", "_odd") * (100 + percent) <= (F.col("n") + F.col("_n")) * (100 - percent)


def _verified(pairs: DataFrame, sketch: DataFrame, whole, percent: int) -> DataFrame:
    """The pairs (a, b) of sets in sketch(sid, h, n, odd, counts) whose whole sets are similar enough.

    Size, parity bits and counts go first; whole(h) gives the sets (sid, grams) of the
    texts that are left, and only those.
    """

    @F.pandas_udf("boolean")
    def counts_allow(x: pd.Series, y: pd.Series, most: pd.Series) -> pd.Series:
        return pd.Series([a is None or b is None or apart(a, b) <= m for a, b, m in zip(x, y, most)], dtype=bool)

    @F.pandas_udf("boolean")
    def similar(x: pd.Series, y: pd.Series) -> pd.Series:
        import numpy as np

        out = []
        for g, h in zip(map(_numbers, x), map(_numbers, y)):
            both = len(np.intersect1d(g, h, assume_unique=True))
            out.append(both * (100 + percent) >= (len(g) + len(h)) * percent)
        return pd.Series(out, dtype=bool)

    spark = sketch.sparkSession
    scratch, s = Scratch(spark), sketch.select("sid", "n", "odd", "counts")
    ends = pairs.join(s.toDF("a", "n", "odd", "counts"), "a").join(s.toDF("b", "_n", "_odd", "_counts"), "b")
    ends = ends.where((F.least("n", "_n") * 100 >= F.greatest("n", "_n") * percent) & _near_enough(percent))
    most = F.floor((F.col("n") + F.col("_n")) * (100 - percent) / (100 + percent))
    with small_batches(spark):
        pairs = scratch.keep(ends.where(counts_allow("counts", "_counts", most)).select("a", "b"), "candidates")
    need = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    with small_batches(spark):
        sets = scratch.keep(whole(scratch.keep(sketch.join(need, "sid", "left_semi").select("h"), "candidate-texts")), "candidate-sets")
    freed(spark)
    # The smaller name stands in many pairs of a group: its set is joined last.
    got = pairs.join(sets.toDF("b", "_y"), "b").join(sets.toDF("a", "_x"), "a")
    with small_batches(spark):
        found = written(got.where(similar("_x", "_y")).select("a", "b"), "similar")
    # Each comparison shuffles sets; its files go before the next one.
    del pairs, need, sets, ends, got
    scratch.drop()
    freed(spark)
    return found


def _balls(each: DataFrame, sketch: DataFrame, whole, percent: int) -> DataFrame:
    """Similar pairs among sets whose fingerprints are equal or linked: a set for each such set, and one for each link."""
    fps = each.join(sketch.select("sid"), "sid", "left_semi").select("fp", "sid").distinct()
    least = written(fps.groupBy("fp").agg(F.min("sid").alias("least"), F.count(F.lit(1)).alias("m")), "set-fingerprints")
    own = fps.join(least.where("m > 1"), "fp").where("sid <> least").select(F.col("least").alias("a"), F.col("sid").alias("b"))
    ends = least.select(F.col("fp"), F.col("least"))
    linked = simhash.links(least.select("fp")).toDF("fa", "fb").join(ends.toDF("fa", "a"), "fa").join(ends.toDF("fb", "b"), "fb").select("a", "b")
    pairs = own.union(linked).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return _verified(pairs, sketch, whole, percent)


def _merged(roots: DataFrame | None, new: DataFrame) -> DataFrame:
    """(sid, root) of all sets with a link so far: the new links join what are components already."""
    if roots is None:
        return components(new).withColumnRenamed("node", "sid")
    at = lambda c: F.coalesce(F.col(c), F.col(c[-1]))
    ends = new.join(roots.toDF("a", "_a"), "a", "left").join(roots.toDF("b", "_b"), "b", "left")
    ends = ends.select("a", "b", at("_a").alias("ra"), at("_b").alias("rb"))
    over = components(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).toDF("root", "_top")
    every = roots.unionByName(ends.select(F.explode(F.array(F.struct(F.col("a").alias("sid"), F.col("ra").alias("root")), F.struct(F.col("b").alias("sid"), F.col("rb").alias("root")))).alias("x")).select("x.*").where("sid = root")).distinct()
    return written(every.join(over, "root", "left").select("sid", F.coalesce("_top", "root").alias("root")), "roots")


def _roots(docs: DataFrame, text: str, each: DataFrame, shingle: int, percent: int) -> DataFrame | None:
    """(sid, root) of the sets that are similar to others: root names the component. None without any."""
    spark, w = docs.sparkSession, Window.partitionBy("gram")
    with small_batches(spark):
        at = heads(docs, text, shingle=shingle, percent=percent)
        at = at.withColumns({"_lo": F.min("sid").over(w), "_hi": F.max("sid").over(w)}).where("_lo <> _hi")
        at = written(at.select("gram", "sid", "n", "pos").distinct(), "shared-shingles")
    freed(spark)
    if at.isEmpty():
        return None
    # Similar sets share a shingle here, so others need not be looked at again.
    sketch = each.join(at.select("sid").distinct(), "sid", "left_semi").groupBy("sid").agg(F.first("n").alias("n"), F.first("odd").alias("odd"), F.first("counts").alias("counts"), F.min("h").alias("h"))
    sketch = written(sketch, "sketches")

    def whole(texts: DataFrame) -> DataFrame:
        return _whole(docs, text, texts, shingle)

    roots, turn = _merged(None, _balls(each, sketch, whole, percent)), 0
    while True:
        rest = at.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        rest = rest.withColumns({"_lo": F.min("root").over(w), "_hi": F.max("root").over(w)}).where("_lo <> _hi")
        rest = written(rest.select("gram", "sid", "n", "pos", "root"), "unsettled-shingles")
        # Pairs that are left where no component has settled them.
        c = rest.groupBy("gram", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("gram").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("own"))
        c = c.agg(F.sum("m").alias("rows"), F.sum((F.col("m") * F.col("m") - F.col("own")) / 2).alias("pairs")).first()
        if not c["rows"] or c["pairs"] <= CROWD * c["rows"] or turn and merged * FEW < c["rows"]:
            break
        # Neighbours in two orders: by size, and by chance.
        near = None
        for order in (["n", "sid"], [F.xxhash64("sid", "gram", F.lit(turn)), F.col("sid")]):
            by = w.orderBy(*order)
            d = rest.withColumns({f"_{c}": F.lag(c).over(by) for c in ("sid", "n", "pos", "root")})
            d = d.where(F.col("_sid").isNotNull() & (F.col("root") != F.col("_root")) & _may("", "_", percent)).select(F.least("sid", "_sid").alias("a"), F.greatest("sid", "_sid").alias("b"))
            near = d if near is None else near.union(d)
        new = _verified(near.distinct(), sketch, whole, percent)
        merged = new.count()
        if not merged:
            break
        roots, turn = _merged(roots, new), turn + 1

    rest = written(rest.join(sketch.select("sid", "odd"), "sid").select("gram", "sid", "n", "pos", "root", "odd"), "sketched")
    freed(spark)
    y = rest.toDF("gram", "_sid", "_n", "_pos", "_root", "_odd")
    far = rest.join(y, (rest["gram"] == y["gram"]) & F.expr("sid < _sid and root <> _root") & _may("", "_", percent) & _near_enough(percent))
    far = far.select(F.col("sid").alias("a"), F.col("_sid").alias("b")).distinct()
    return _merged(roots, _verified(far, sketch, whole, percent))


def _rooted(docs: DataFrame, key: str, text: str, shingle: int, percent: int) -> DataFrame:
    """(key, h, root) for each row, in one task for each part of docs, however many copies a set has."""
    with small_batches(docs.sparkSession):
        each = written(sets(docs, key, text, shingle=shingle), "sets")
    roots = _roots(docs, text, each, shingle, percent)
    rows = each.select(col(key), "h", "sid")
    if roots is None:
        return rows.withColumnRenamed("sid", "root")
    hot = hot_keys(rows.groupBy("sid").agg(F.count(F.lit(1)).alias("n")), ["sid"])
    got = spread_join(rows, roots, ["sid"], "left", hot)
    return written(got.select(col(key), "h", F.coalesce("root", "sid").alias("root")), "rooted")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", *, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(key, h, root, component_id) for each row: its text's hash, its class, the class's smallest key."""
    rooted = _rooted(docs, key, text, shingle, percent)
    of = rooted.groupBy("root").agg(F.min(col(key)).alias("component_id"), F.count(F.lit(1)).alias("n"))
    least = written(of, "class-keys")
    return spread_join(rooted, least.drop("n"), ["root"], "inner", hot_keys(least, ["root"])).select(col(key), "h", "root", "component_id")


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", *, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs without all but one of each class: the smallest key, one row of it.

    Rows whose key is null stay: nothing names the one to keep.
    """
    rooted = _rooted(docs, key, text, shingle, percent)
    named = rooted.where(col(key).isNotNull())
    keep = named.groupBy("root").agg(F.min(F.struct(col(key).alias("k"), F.col("h").alias("h"))).alias("x")).select("x.k", "x.h").distinct()
    d = boxed(docs, k=col(key), h=F.xxhash64(col(text)))
    kept = d.join(keep, ["k", "h"], "left_semi").dropDuplicates(["k", "h"])
    return unboxed(kept).unionByName(docs.where(col(key).isNull()))
