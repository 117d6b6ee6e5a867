"""Whitening of embeddings: streaming covariance, merged by halves, and its eigenvectors.

Every task reads its distinct vectors once and keeps a mean and a matrix of
centred products, updated vector by vector (Welford's rank-one update), so
nothing is ever squared before it is centred and no task holds its vectors.
The tasks' parts meet by the parallel update formula, FAN at a time in the
order of their numbers, on the executors; only the last few reach the driver.
There the covariance is brought to tridiagonal form by reflections and
diagonalised by implicit QR steps. The rows are then projected where they are.

Entries are made whole numbers first: x = floor(scale * c) + shift. Sums of x
are whole numbers, and a row's deviation, the sum over dimensions of
(n * x - S)**2, is exact.

Defined results: rows whose vector is null or holds null or non-finite entries
are left out; shorter vectors count as if zeros followed; x is held within
+-2**53. A vector that many rows have is fitted once and returned for each of
them; null and repeated ids are rows like any other. A component without
variance (its eigenvalue is not above 1e-12 of the largest) has no whitened
value, and if all are so `explained` is null too. A deviation beyond the range
of long is null. Without a usable row there are no rows. Other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import col, written

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: So many parts meet in one task; parts of a group this small go to the driver.
FAN = 16
#: Eigenvalues up to this share of the largest count as none.
FLAT = 1e-12
_WHOLE = float(1 << 53)
_PART = "pid long, n long, sums binary, mean binary, products binary"


def whole_vectors(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(key, x): the usable vectors in whole numbers."""
    usable = F.col("v").isNotNull() & ~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))

    def whole(e: Column) -> Column:
        return F.greatest(F.least(F.floor(F.greatest(F.least(e * float(scale), F.lit(_WHOLE)), F.lit(-_WHOLE))).cast("long") + shift, F.lit(int(_WHOLE))), F.lit(-int(_WHOLE)))

    d = df.select(col(key).alias("key"), F.transform(col(vector), lambda e: e.cast("double")).alias("v"))
    return d.where(usable).select("key", F.transform("v", whole).alias("x"))


class Moments:
    """Number, sums, mean and centred products of vectors, one at a time."""

    def __init__(self, dim: int):
        import numpy as np

        self.n, self.sums = 0, np.zeros(dim, dtype=np.int64)
        self.mean, self.products = np.zeros(dim), np.zeros((dim, dim))

    def add(self, x) -> None:
        """Welford's update by one vector: the product of its distances from the old and from the new mean."""
        self.n += 1
        before = x - self.mean
        self.mean += before / self.n
        # The distance from the new mean is (n - 1) / n of that from the old one.
        self.products += before[:, None] * (before * ((self.n - 1) / self.n))

    def merge(self, other: Moments) -> None:
        """The parallel update: both parts' products and what their means are apart."""
        if not other.n:
            return
        n = self.n + other.n
        apart = other.mean - self.mean
        self.products += other.products + apart[:, None] * apart * (self.n * other.n / n)
        self.mean += apart * (other.n / n)
        self.n, self.sums = n, self.sums + other.sums

    def row(self, pid: int) -> tuple:
        return pid, self.n, self.sums.tobytes(), self.mean.tobytes(), self.products.tobytes()

    @classmethod
    def of(cls, r) -> Moments:
        import numpy as np

        m = cls(0)
        m.n, m.sums, m.mean = int(r.n), np.frombuffer(r.sums, dtype=np.int64).copy(), np.frombuffer(r.mean).copy()
        m.products = np.frombuffer(r.products).copy().reshape(len(m.mean), -1)
        return m


def _matrix(vectors: pd.Series, dim: int, fill: int):
    """Whole vectors as rows of a matrix; what is missing at a row's end is `fill`."""
    import numpy as np

    m = np.full((len(vectors), dim), fill, dtype=np.int64)
    for i, v in enumerate(vectors):
        m[i, : len(v)] = v
    return m


def moments(vectors: DataFrame, dim: int, rows_of) -> Moments:
    """Moments of rows_of(batch of x): float rows, with their whole numbers or None, over vectors(x)."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        m = Moments(dim)
        for b in batches:
            whole, rows = rows_of(b["x"])
            if whole is not None:
                m.sums += whole.sum(axis=0)
            for r in rows:
                m.add(r)
        yield pd.DataFrame([m.row(TaskContext.get().partitionId())] if m.n else [], columns=["pid", "n", "sums", "mean", "products"])

    def merged(parts: pd.DataFrame) -> pd.DataFrame:
        m = Moments(dim)
        parts = parts.sort_values("pid")
        for r in parts.itertuples():
            m.merge(Moments.of(r))
        return pd.DataFrame([m.row(int(parts["pid"].iloc[0]) // FAN)], columns=["pid", "n", "sums", "mean", "products"])

    parts = vectors.mapInPandas(part, _PART)
    left = vectors.rdd.getNumPartitions()
    while left > FAN:
        parts, left = parts.groupBy(F.floor(F.col("pid") / FAN)).applyInPandas(merged, _PART), -(-left // FAN)
    out = Moments(dim)
    for r in sorted(parts.collect(), key=lambda r: r.pid):
        out.merge(Moments.of(r))
    return out


def tridiagonal(a):
    """(diagonal, off-diagonal, q) with q.T @ a @ q tridiagonal, by reflections."""
    import numpy as np

    a, n = np.array(a, dtype=float), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        length = np.sqrt((x * x).sum())
        if not length or not np.any(x[1:]):
            continue
        x[0] += length if x[0] >= 0 else -length
        x /= np.sqrt((x * x).sum())
        a[k + 1 :] -= 2 * np.outer(x, x @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ x, x)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ x, x)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def eigen(a):
    """(values falling, vectors as columns) of a symmetric matrix, by implicit QR steps with Wilkinson's shift."""
    import numpy as np

    d, e, q = tridiagonal(a)
    tiny, end = np.finfo(float).eps, len(d) - 1
    q = q.T.copy()  # rows are turned, which lie together in memory
    while end > 0:
        small = np.abs(e[:end]) <= tiny * (np.abs(d[:end]) + np.abs(d[1 : end + 1]))
        e[:end][small] = 0.0
        if e[end - 1] == 0:
            end -= 1
            continue
        cuts = np.flatnonzero(e[:end] == 0)
        start = cuts[-1] + 1 if len(cuts) else 0
        half = (d[end - 1] - d[end]) / 2
        root = np.hypot(half, e[end - 1])
        shift = d[end] - e[end - 1] ** 2 / (half + (root if half >= 0 else -root))
        f, bulge = d[start] - shift, e[start]
        for k in range(start, end):
            r = np.hypot(f, bulge)
            c, s = (f / r, bulge / r) if r else (1.0, 0.0)
            if k > start:
                e[k - 1] = r
            a0, b0, a1 = d[k], e[k], d[k + 1]
            d[k] = c * c * a0 + 2 * c * s * b0 + s * s * a1
            d[k + 1] = s * s * a0 - 2 * c * s * b0 + c * c * a1
            e[k] = c * s * (a1 - a0) + (c * c - s * s) * b0
            if k + 1 < end:
                f, bulge = e[k], s * e[k + 1]
                e[k + 1] *= c
            q[k], q[k + 1] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
    by = np.argsort(-d, kind="stable")
    return d[by], q[by].T


@dataclass
class Whitening:
    """What the fit list says: n vectors, their sums, and the components with variance."""

    n: int
    sums: object
    values: object  # eigenvalues, falling, of the kept components
    vectors: object  # dim x components
    trace: float
    error: float | None = None

    @property
    def dim(self) -> int:
        return len(self.sums)

    def centred(self, x):
        """n * x - S without rounding, in long or, where that could overflow, in Python's numbers."""
        import numpy as np

        if len(x) and self.n * float(np.abs(x).max()) + float(np.abs(self.sums).max(initial=0)) > 2.0**62:
            return x.astype(object) * self.n - self.sums.astype(object)
        return x * self.n - self.sums

    def project(self, x):
        """The whitened coordinates of whole vectors; nan for a component without variance."""
        import numpy as np

        far = (self.centred(x) / self.n).astype(float) @ self.vectors
        there = self.values > FLAT * max(self.values.max(initial=0.0), 0.0)
        out = np.full(far.shape, np.nan)
        out[:, there] = far[:, there] / np.sqrt(self.values[there])
        return out

    def deviation(self, x) -> list[int | None]:
        """Sums of the squares of n * x - S, exact."""
        import numpy as np

        c = self.centred(x)
        if c.dtype != object and float(np.abs(c).max(initial=0)) ** 2 * self.dim < 2.0**62:
            return (c * c).sum(axis=1).tolist()
        sums = [sum(v * v for v in map(int, r)) for r in c]
        return [s if s < 1 << 63 else None for s in sums]


def fit(vectors: DataFrame, *, shift: int = SHIFT, components: int = COMPONENTS) -> Whitening | None:
    """From vectors(x), each distinct one once; None without any."""
    import numpy as np

    listed = written(vectors.select("x").distinct(), "fit-list")
    dim = listed.agg(F.max(F.size("x"))).first()[0]
    if dim is None:
        return None
    if listed.where(F.size("x") < dim).limit(1).count():
        # Vectors may be equal once zeros follow.
        pad = F.concat("x", F.array_repeat(F.lit(shift).cast("long"), F.lit(dim) - F.size("x")))
        listed = written(listed.select(pad.alias("x")).distinct(), "padded-fit-list")

    def own(xs: pd.Series):
        x = _matrix(xs, dim, shift)
        return x, x.astype(float)

    got = moments(listed, dim, own)
    v = got.products / got.n
    values, turned = eigen((v + v.T) / 2)
    k = min(components, dim)
    w = Whitening(got.n, got.sums, values[:k], turned[:, :k], float(np.trace(v)))
    kept = np.flatnonzero(w.values > FLAT * max(w.values.max(initial=0.0), 0.0))
    if len(kept):
        again = moments(listed, len(kept), lambda xs: (None, w.project(_matrix(xs, dim, shift))[:, kept]))
        w.error = float(np.abs(again.products / again.n - np.eye(len(kept))).max())
    return w


def whiten(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, shift: int = SHIFT, components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for each usable row and component."""
    rows = whole_vectors(df, key=key, vector=vector, scale=scale, shift=shift)
    w = fit(rows, shift=shift, components=components)
    if w is None or not w.dim:
        kinds = {"component": "int", "n": "long", "deviation": "long", "whitened": "double", "explained": "double", "identity_error": "double"}
        return rows.limit(0).select(F.col("key").alias(key), *[F.lit(None).cast(k).alias(c) for c, k in kinds.items()])

    @F.pandas_udf("struct<deviation:long,whitened:array<double>>")
    def of(xs: pd.Series) -> pd.DataFrame:
        x = _matrix(xs, w.dim, shift)
        return pd.DataFrame({"deviation": pd.Series(w.deviation(x), dtype="Int64"), "whitened": list(w.project(x))})

    explained = [float(v / w.trace) if w.trace > 0 else None for v in w.values]
    each = rows.select("key", of("x").alias("w"))
    each = each.select("key", F.col("w.deviation").alias("deviation"), F.posexplode("w.whitened").alias("i", "whitened"))
    return each.select(
        F.col("key").alias(key),
        (F.col("i") + 1).cast("int").alias("component"),
        F.lit(w.n).cast("long").alias("n"),
        "deviation",
        F.when(~F.isnan("whitened"), F.col("whitened")).alias("whitened"),
        F.get(F.array(*[F.lit(x).cast("double") for x in explained]), F.col("i")).alias("explained"),
        F.lit(w.error).cast("double").alias("identity_error"),
    )
