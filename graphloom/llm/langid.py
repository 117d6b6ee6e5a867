"""Language identification by error-correcting output codes.

Each learned language has a codeword of bits. One linear classifier per bit,
logistic over hashed character n-grams (1 to 3 letters, word edges included),
predicts that bit; decoding sums the logistic loss of every bit against each
codeword and takes the nearest one. Where the runner-up is nearly as near, the
prediction is flagged as ambiguous.

Training uses a sample of labelled rows: of each language about
sample_rows / languages, chosen by a hash of the key. Features are made on the
executors; the driver fits the weights. Prediction reads whole texts.

Defined results: null texts and texts without a letter are `und` with score 0;
without any labelled row all are `und`; rows with a null label or a null key
are not learned from; repeated rows get equal predictions; an empty table gives
no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import boxed, col, unboxed

DIM = 2048
UNKNOWN = "und"
#: A language whose share of the decoding leads by less is ambiguous.
MARGIN = 0.05


def featurizer(dim: int = DIM):
    """text -> square roots of the shares of its hashed 1-, 2- and 3-grams, or None without a letter."""
    import numpy as np

    letter = np.zeros(0x110000, dtype=np.int8)  # 1 letter, -1 none, 0 not looked up yet
    factors = [(np.uint32(0x9E3779B1),), (np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)), (np.uint32(0x27D4EB2F), np.uint32(0x165667B1), np.uint32(0x9E3779B9))]
    shift = np.uint32(32 - dim.bit_length() + 1)

    def features(text):
        c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        kinds = letter[c]
        if not kinds.all():
            for x in np.unique(c[kinds == 0]):
                letter[x] = 1 if chr(x).isalpha() else -1
            kinds = letter[c]
        is_letter = kinds > 0
        if not is_letter.any():
            return None
        # Words between single blanks.
        c = np.where(is_letter, c, 32).astype(np.uint32)
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]
        c = np.concatenate([[32], c[keep], [32]]).astype(np.uint32)
        total = np.zeros(dim)
        for fs in factors:
            n = len(c) - len(fs) + 1
            if n < 1:
                continue
            h = np.zeros(n, dtype=np.uint32)
            for i, f in enumerate(fs):
                h ^= (c[i : i + n] + np.uint32(i + 1)) * f
                h *= np.uint32(0x9E3779B1)
            counts = np.bincount(h >> shift, minlength=dim)
            total += counts / n
        return np.sqrt(total / len(factors))

    return features


def codewords(n: int):
    """n rows of +-1 bits, far apart: all distinct splits up to 6 languages, else the best of some random codes."""
    import numpy as np

    if n <= 6:
        cols = [[1 if i == 0 or m >> (i - 1) & 1 else -1 for i in range(n)] for m in range((1 << max(0, n - 1)) - 1)]
        return np.array(cols or [[1] * n], dtype=float).T
    bits, best, far = max(15, 10 * int(np.ceil(np.log2(n)))), None, -1
    rng = np.random.default_rng(0)
    for _ in range(100):
        code = rng.choice([-1.0, 1.0], size=(n, bits))
        gaps = (bits - code @ code.T) / 2 + np.eye(n) * bits
        if gaps.min() > far:
            best, far = code, gaps.min()
    return best


@dataclass
class Model:
    languages: list[str]
    code: object  # languages x bits
    weights: object  # dim x bits
    bias: object  # bits

    def decode(self, x):
        """(index, share of the best, lead over the second) for rows of features."""
        import numpy as np

        margins = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None, :, :]).sum(axis=2)
        share = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        share /= share.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        ordered = np.sort(share, axis=1)
        return best, ordered[:, -1], ordered[:, -1] - (ordered[:, -2] if share.shape[1] > 1 else 0)


def fit(x, y, languages: list[str], steps: int = 400, rate: float = 20.0, decay: float = 1e-5) -> Model:
    """Logistic bits by accelerated gradient descent; every language weighs the same."""
    import numpy as np

    code = codewords(len(languages))
    target = code[y]
    weight = (1 / np.bincount(y, minlength=len(languages)).clip(1))[y]
    weight = (weight / weight.sum())[:, None]
    w, b = np.zeros((x.shape[1], code.shape[1])), np.zeros(code.shape[1])
    vw, vb = w.copy(), b.copy()
    for i in range(steps):
        m = i / (i + 3)
        pull = -target / (1 + np.exp(np.clip((x @ vw + vb) * target, -50, 50))) * weight
        nw, nb = vw - rate * (x.T @ pull + decay * vw), vb - rate / 10 * pull.sum(axis=0)
        vw, vb, w, b = nw + m * (nw - w), nb + m * (nb - b), nw, nb
    return Model(languages, code, w, b)


def fold(key: Column, folds: int = 5) -> Column:
    """crc32 of the key as text, modulo folds; a null key is in fold 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds, F.lit(0))


def train(docs: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "lang", sample_rows: int = 2000, dim: int = DIM) -> Model | None:
    """A model from labelled rows whose fold is not 0; sample_rows bounds the sample."""
    import numpy as np

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).alias("label")).where((fold(F.col("key")) != 0) & F.col("label").isNotNull())
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not sizes:
        return None
    languages, each = sorted(sizes), max(20, sample_rows // len(sizes))
    spark = docs.sparkSession
    share = spark.createDataFrame([(k, min(1.0, each / n)) for k, n in sizes.items()], "label string, share double")
    luck = F.xxhash64("key", F.lit("sample")).bitwiseAND((1 << 53) - 1) / float(1 << 53)
    chosen = rows.join(F.broadcast(share), "label").where(luck < F.col("share"))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        f = featurizer(dim)
        for b in batches:
            got = [(k, l, v.astype(np.float32).tobytes()) for k, l, t in zip(b["key"], b["label"], b["text"]) if (v := f(t)) is not None]
            if got:
                yield pd.DataFrame(got, columns=["key", "label", "x"])

    kind = dict(rows.dtypes)["key"]
    got = chosen.select("key", "label", "text").mapInPandas(features, f"key {kind}, label string, x binary").toPandas()
    if got.empty:
        return None
    got = got.sort_values(["key", "label"], kind="stable")  # sums in one order: the same weights every time
    x = np.stack([np.frombuffer(v, dtype=np.float32) for v in got["x"]]).astype(float)
    return fit(x, got["label"].map(languages.index).to_numpy(), languages)


def predict(docs: DataFrame, model: Model | None, *, text: str = "text", dim: int = DIM) -> DataFrame:
    """docs with lang_pred, score and ambiguous; columns of these names are replaced."""

    @F.pandas_udf("struct<lang_pred:string,score:double,ambiguous:boolean>")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import numpy as np

        f = featurizer(dim)
        for texts in parts:
            out = []
            for at in range(0, len(texts), 256):
                xs = [f(t) if model else None for t in texts.iloc[at : at + 256]]
                there = [i for i, x in enumerate(xs) if x is not None]
                part = [(UNKNOWN, 0.0, True)] * len(xs)
                if there:
                    for i, b, s, m in zip(there, *model.decode(np.stack([xs[i] for i in there]))):
                        part[i] = (model.languages[b], float(s), bool(m < MARGIN))
                out += part
            if out:
                yield pd.DataFrame(out, columns=["lang_pred", "score", "ambiguous"])

    got = docs.withColumn("_langid", of(F.col(text)))
    return got.withColumns({c: F.col(f"_langid.{c}") for c in ("lang_pred", "score", "ambiguous")}).drop("_langid")


def known(docs: DataFrame, model: Model | None, *, text: str = "text") -> DataFrame:
    """The rows of docs that have a language, as they are; ambiguous ones stay."""
    got = predict(boxed(docs, text=col(text)), model)
    return unboxed(got.where(F.col("lang_pred") != UNKNOWN))
