"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints link at 3 differing bits or fewer. Every fingerprint
emits the variants within half the radius, variants are shuffled, and
fingerprints that meet on one are verified:

1. A sieve. Of three thirds of the fingerprint the one with most differences is
   left out; in the other two at most 2 bits differ, so variants within 1 bit
   of two linked fingerprints meet. Fingerprints that meet no other there have
   no link. Only membership is kept, no pairs.
2. The rest emit whole variants. Flipping a bit changes a fingerprint's parity,
   so for 3 differing bits one side is even: all emit their variants within 1
   bit, the even ones also those with 2 flips in one half (of three bits two
   lie in the same half). Members of a variant within 1 bit are at most 2 bits
   apart, others at most 3 from these: each links to the variant's smallest
   such member. These links connect what all pairs would, one per member.

Equal fingerprints are one node from the start, so copies never meet as pairs;
those that many rows have are salted when rows get their class.

Defined results: null, empty and word-less texts have fingerprint zero, which
links like any other; repeated rows share a fingerprint and a class; null ids
are left out of a class's smallest id; an empty table gives no rows; columns
other than key and text are not looked at.
"""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._components import components
from ._shared import hot_keys, spread_join, written

BITS, SHINGLE, SEED = 64, 3, 42
THIRDS = (range(0, 21), range(21, 42), range(42, 64))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a whole text as an unsigned number."""
    import numpy as np
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    h = xxhash.xxh64_intdigest
    if shingle == 3 and n > 1:
        each = [h(b"%b %b %b" % x, SEED) for x in zip(words, words[1:], words[2:])]
    else:
        each = [h(b" ".join(words[i : i + shingle]), SEED) for i in range(n)]
    return of_hashes(np.array(each, dtype="<u8"))


def of_hashes(hashes) -> int:
    """The bits that over half of these 64-bit hashes have set."""
    import numpy as np

    n, ones = len(hashes), np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp) with fp as a signed long."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([_signed(fingerprint(t)) for t in texts], dtype="int64")

    return docs.select(F.col(key).alias(key), fp(F.col(text)).alias("fp"))


def _flips(flips: list[int]) -> Column:
    return F.posexplode(F.lit([_signed(x) for x in flips]))


def _meeting(fps: DataFrame) -> DataFrame:
    """The fingerprints that may have a link to another one."""
    flips, cases = [], None
    for n, out in enumerate(THIRDS):
        gone = sum(1 << b for b in out)
        tag = (n + 1) << out.start
        at = len(flips)
        flips += [0, *(1 << b for b in range(BITS) if b not in out)]
        key = F.col("fp").bitwiseAND(_signed((1 << 64) - 1 - gone)).bitwiseOR(_signed(tag))
        cases = F.when(F.col("pos") < len(flips), key) if cases is None else cases.when(F.col("pos").between(at, len(flips) - 1), key)
    v = fps.select("fp", _flips(flips)).select("fp", cases.bitwiseXOR(F.col("col")).alias("v"))
    w = Window.partitionBy("v")
    return v.withColumns({"lo": F.min("fp").over(w), "hi": F.max("fp").over(w)}).where("lo <> hi").select("fp").distinct()


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between different fingerprints that connect all that link."""
    one = [0, *(1 << b for b in range(BITS))]
    two = [1 << a | 1 << b for half in (range(32), range(32, BITS)) for a, b in combinations(half, 2)]
    met = written(_meeting(fps), "sieved")
    even = F.bit_count("fp") % 2 == 0
    v = met.where(~even).select("fp", _flips(one)).union(met.where(even).select("fp", _flips(one + two)))
    v = v.select("fp", F.col("fp").bitwiseXOR(F.col("col")).alias("v"), (F.col("pos") < len(one)).alias("near"))
    center = F.min(F.when(F.col("near"), F.col("fp"))).over(Window.partitionBy("v"))
    pairs = v.withColumn("b", center).where("b <> fp").select(F.col("fp").alias("a"), "b").distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 3)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id): component_id is the smallest key reachable over links."""
    each = written(fingerprints(docs, key, text), "fingerprints")
    fps = written(each.groupBy("fp").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    comp = components(links(fps.select("fp"))).withColumnRenamed("node", "fp")
    rooted = written(fps.join(comp, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.select("fp", "root").join(least, "root").drop("root")
    return spread_join(each, found, ["fp"], "inner", hot_keys(fps, ["fp"])).select(key, "fp", "component_id")
