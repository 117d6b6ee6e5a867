"""Exact top-k inner products over vectors sorted by length.

Vectors lie in blocks by descending length. A rotation from the vectors' own
second moments (their singular vectors) puts most of an inner product into the
first coordinates. For a query with k results so far, the Cauchy-Schwarz bound
|q| |x| ends the walk over the blocks, and inside a block the partial product
over the first coordinates plus |q_rest| |x_rest| drops single vectors before
the exact integer product is taken.

Queries come in blocks too. First every query block meets the longest vectors,
which gives each query a threshold; then it meets the prefix of blocks that its
bound cannot rule out. That is done in groups of blocks on both sides, so a
query block goes once to a group of vector blocks and gives k rows per query
there at most, and neither side is ever broadcast. The driver sees LENGTHS block
lengths at most; the prefix is found by bisection.

Defined results: vectors that are null or hold null or non-finite components
take no part; shorter vectors count as if zeros followed; a query never meets
rows with its own id; a null id is never a query; repeated rows are vectors of
their own; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import offsets, partitions, written

#: Sums of products up to this are exact in doubles.
EXACT = float(1 << 52)
#: So many block lengths come to the driver at most; with more blocks each stands for a run of them.
LENGTHS = 1 << 16
#: The longest vectors are sent to all tasks where their blocks take less than this.
SENT_BYTES = 32 << 20
#: Blocks of vectors and of queries that meet in one task at a time.
GROUP, QUERY_GROUP = 16, 32


def integer_vectors(df: DataFrame, *, key: str, vector: str, scale: int) -> DataFrame:
    """(key, v): floor(scale * x) of every usable vector."""
    x = F.transform(F.col(vector), lambda e: e.cast("double"))
    bad = F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    d = df.select(F.col(key).alias("key"), x.alias("x")).where(F.col("x").isNotNull() & ~bad)
    return d.select("key", F.transform("x", lambda e: F.floor(e * scale).cast("long")).alias("v"))


def _moments(vectors: DataFrame, dim: int):
    """The sum of v vᵀ: a dim x dim matrix, summed per row of it."""
    import numpy as np

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        total = np.zeros((dim, dim))
        for b in batches:
            m = np.zeros((len(b), dim))
            for i, v in enumerate(b["v"]):
                m[i, : len(v)] = v
            total += m.T @ m
        yield pd.DataFrame({"i": np.repeat(np.arange(dim), dim), "j": np.tile(np.arange(dim), dim), "x": total.ravel()})

    rows = vectors.mapInPandas(part, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    out = np.zeros((dim, dim))
    for r in rows:
        out[r["i"], r["j"]] = r["x"]
    return out


def _blocks(vectors: DataFrame, rows: int, dim: int, turn, head: int) -> DataFrame:
    """Rows sorted by (norm desc, key) as blocks: place, n, longest, and the arrays as bytes, components in the narrowest integers that hold them."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        held: list[pd.DataFrame] = []
        for b in batches:
            held.append(b)
            while sum(map(len, held)) >= rows:
                whole = pd.concat(held)
                held = [whole.iloc[rows:]]
                yield one(whole.iloc[:rows], np)
        if sum(map(len, held)):
            yield one(pd.concat(held), np)

    def one(b: pd.DataFrame, np) -> pd.DataFrame:
        m = np.zeros((len(b), dim), dtype=np.int64)
        for i, v in enumerate(b["v"]):
            m[i, : len(v)] = v
        rest = np.sqrt(((m @ turn[:, head:]) ** 2).sum(axis=1))
        ids = b["key"].astype("Int64")
        kind = np.result_type(np.min_scalar_type(m.min(initial=0)), np.min_scalar_type(-1 - m.max(initial=0)))
        return pd.DataFrame({
            "pid": [int(b["pid"].iloc[0])], "longest": [float(b["norm"].max())], "n": [len(b)],
            "ids": [ids.fillna(0).to_numpy(dtype=np.int64).tobytes()], "no_id": [ids.isna().to_numpy().tobytes()],
            "norms": [b["norm"].to_numpy(dtype=float).tobytes()], "kind": [kind.str], "v": [m.astype(kind).tobytes()], "rest": [rest.tobytes()],
        })

    order = [F.col("norm").desc(), F.col("key").asc_nulls_last()]
    d = vectors.repartitionByRange(partitions(vectors.sparkSession), *order).sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id())
    b = d.mapInPandas(build, "pid int, longest double, n int, ids binary, no_id binary, norms binary, kind string, v binary, rest binary")
    return written(b.withColumn("nr", F.monotonically_increasing_id()), "blocks")


def _placed(blocks: DataFrame) -> DataFrame:
    """Blocks with their place in the order of descending length: from 0, without gaps."""
    w = Window.partitionBy("pid").orderBy("nr")
    off = offsets(blocks, "pid", [], F.count(F.lit(1)))
    return blocks.withColumn("_in", F.row_number().over(w) - 1).join(F.broadcast(off), "pid").withColumn("place", (F.col("_in") + F.col("_off")).cast("long")).drop("_in", "_off", "pid", "nr")


def _search(k: int, dim: int, turn, head: int):
    """found(rows of query blocks, rows of vector blocks): per query the k best of all vectors that may reach its threshold, as frames of FOUND."""
    front = turn[:, :head]

    def arr(x, kind="float64"):
        import numpy as np

        return np.frombuffer(x, dtype=kind)

    def block(r, v, kind):
        """The components as longs, and their first rotated coordinates."""
        import numpy as np

        m = arr(v, kind).reshape(-1, dim).astype(np.int64)
        return m, m @ front

    def found(queries, vectors) -> Iterator[pd.DataFrame]:
        import numpy as np

        held = sorted(((r, *block(r, r.v, r.kind), arr(r.ids, "int64"), arr(r.no_id, "bool")) for r in vectors), key=lambda h: h[0].place)
        for r in queries:
            q, q_front = block(r, r.q_v, r.q_kind)
            qid, qn, q_rest, least = arr(r.q_ids, "int64"), arr(r.q_norms), arr(r.q_rest), arr(r.least).copy()
            best: dict[int, list] = {}
            for b, x, x_front, xid, none in held:
                if not r.begin <= b.place < r.until:
                    continue
                xn = arr(b.norms)
                # Doubles may be off by a little; the slack keeps every vector in doubt.
                reach = q_front @ x_front.T + np.outer(q_rest, arr(b.rest))
                slack = 1e-9 * np.outer(qn, xn) + 1e-6
                may = reach + slack >= least[:, None]
                may &= (qid[:, None] != xid[None, :]) | none[None, :]
                exact = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * dim < EXACT
                for i in np.nonzero(may.any(axis=1))[0]:
                    c = np.nonzero(may[i])[0]
                    s = (x[c].astype(float) @ q[i].astype(float)).astype(np.int64) if exact else np.array([sum(int(a) * int(e) for a, e in zip(q[i], y)) for y in x[c]])
                    top = np.lexsort((xid[c], none[c], -s))[:k]
                    got = [(-int(s[t]), bool(none[c[t]]), int(xid[c[t]])) for t in top if s[t] >= least[i]]
                    best[i] = sorted(best.get(i, []) + got)[:k]
                    if len(best[i]) == k:
                        least[i] = max(least[i], -best[i][-1][0])
            out = [(int(r.q_place), int(i), int(qid[i]), None if none else x, -s) for i, rows in best.items() for s, none, x in rows]
            if out:
                yield pd.DataFrame(out, columns=["q_place", "q_row", "query_id", "vec_id", "score"]).astype({"vec_id": "Int64"})

    return found


FOUND = "q_place long, q_row int, query_id long, vec_id long, score long"


def top_k(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5, scale: int = 256, block: int = 2048, query_block: int = 256, first_blocks: int = 2) -> DataFrame:
    """(query_id, rank, vec_id, score) for every query, a row whose key divides by `every`."""
    import numpy as np

    spark = df.sparkSession
    v = integer_vectors(df, key=key, vector=vector, scale=scale)
    v = written(v.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e))), "vectors")
    dim = v.agg(F.max(F.size("v"))).first()[0] or 0
    if not dim:
        dim = 1
    values, turn = np.linalg.eigh(_moments(v, dim))
    order = np.argsort(-values, kind="stable")
    turn = np.ascontiguousarray(turn[:, order])
    share = np.cumsum(np.maximum(values[order], 0)) / max(values.clip(0).sum(), 1e-300)
    head = min(dim, max(1, int(np.searchsorted(share, 0.8)) + 1))

    x = written(_placed(_blocks(v, block, dim, turn, head)), "placed")
    q = written(_placed(_blocks(v.where(F.col("key") % every == 0), query_block, dim, turn, head)), "queries")
    q = q.select(*[F.col(c).alias(f"q_{c}") for c in q.columns if c not in ("no_id", "longest")])
    none = F.udf(lambda n: np.full(n, -np.inf).tobytes(), "binary")
    blocks = x.count()
    stride = max(1, -(-blocks // LENGTHS))
    lengths = [-r["longest"] for r in x.where(F.col("place") % stride == 0).select("place", "longest").orderBy("place").collect()]

    ahead = max(1, min(first_blocks, blocks))
    first = q.withColumns({"least": none("q_n"), "begin": F.lit(0), "until": F.lit(ahead)}).withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(ahead - 1))))
    search = _search(k, dim, turn, head)

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                yield from search([r], [r])

    longest = x.where(F.col("place") < ahead).withColumn("at", F.col("place").cast("int"))
    # A block is `block` rows of dim numbers at most.
    longest = F.broadcast(longest) if ahead * block * (8 * dim + 32) < SENT_BYTES else longest.hint("merge")
    found = written(first.join(longest, "at").mapInPandas(go, FOUND), "first")

    # The k-th score so far of each query, as an array beside its block.
    w = Window.partitionBy("q_place", "q_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    kth = found.withColumn("r", F.row_number().over(w)).where(F.col("r") == k).groupBy("q_place").agg(F.map_from_entries(F.collect_list(F.struct("q_row", "score"))).alias("kth"))

    @F.udf("struct<least:binary,until:long>")
    def bound(n, norms, scores):
        least = np.full(n, -np.inf)
        for i, s in (scores or {}).items():
            least[i] = s
        # |q| |x| reaches the threshold where |x| is at least this.
        qn = np.frombuffer(norms)
        reach = np.where(qn > 0, (least - 1e-6) / np.where(qn > 0, qn * (1 + 1e-9), 1), np.where(least > 1e-6, np.inf, -np.inf))
        until = max(first_blocks, min(blocks, stride * int(np.searchsorted(lengths, -reach.min(), side="right"))))
        return least.tobytes(), until

    more = q.join(kth, "q_place", "left").withColumn("b", bound("q_n", "q_norms", "kth")).withColumns({"least": F.col("b.least"), "begin": F.lit(first_blocks).cast("long"), "until": F.col("b.until")})
    more = written(more.where(F.col("until") > first_blocks).withColumn("q_group", F.floor(F.col("q_place") / QUERY_GROUP)).drop("b", "kth"), "more")
    # Each side goes once to every group of the other that it may have to meet.
    reach = more.groupBy("q_group").agg(F.max("until").alias("_until")).toDF("group", "_until")
    asked = more.withColumn("x_group", F.explode(F.sequence(F.lit(first_blocks // GROUP).cast("long"), F.floor((F.col("until") - 1) / GROUP))))
    near = x.where(F.col("place") >= first_blocks).withColumn("x_group", F.floor(F.col("place") / GROUP))
    near = near.join(F.broadcast(reach), F.col("place") < F.col("_until")).drop("_until").withColumnRenamed("group", "q_group")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        got = list(search(a.itertuples(index=False), b.itertuples(index=False)))
        return pd.concat(got) if got else pd.DataFrame(columns=["q_place", "q_row", "query_id", "vec_id", "score"])

    on = ["q_group", "x_group"]
    rest = asked.groupBy(*on).cogroup(near.groupBy(*on)).applyInPandas(meet, FOUND) if blocks > first_blocks else found.limit(0)
    both = found.union(rest).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return both.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
