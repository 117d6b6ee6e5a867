"""Toxicity of texts, judged after a noisy channel has been undone.

Writers hide words: digits and signs stand for letters, letters are repeated,
signs or blanks stand between them. Each doubtful stretch of a text becomes a
lattice of what it may have been: a sign is itself (the word ends) or a letter
that it resembles, a repeated letter is kept or was added, a separator ends the
word or was put in. A language model of characters over the corpus, and a cost
for each thing that the channel did, weigh the ways through it; Viterbi's
algorithm takes the best one, exactly, over states of three letters. Stretches
that could have been nothing else stay as they are.

The model counts four characters in a row inside words, over all documents, in
a table of 32**4 places, so what travels has a size that no corpus changes.
Letters A to Z have a place each, all others share five.

Then the restored words are scored: a logistic classifier over the words and
word beginnings that the labelled rows show to go with label 1. It is fitted on
at most sample_rows labelled rows, half of them of either label where there are
enough, weighed back to the share each label has. Documents are read whole.

Defined results: null texts are empty; a text without a word scores what the
fit says of such texts; a token without any letter is no word; letters are
compared in lower case; a stretch of more than WINDOW characters is decided in
runs of so many, each going on from the state before; rows with a null key or
label are not learned from, copies of a row are scored alike; without labels of
both kinds every score is the share of label 1, or 0.5 without any; an empty
table gives no rows; other columns are not looked at, and one of an added name
is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import col, written

#: What a sign may stand for. Fixed values.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "§": "s",
}
#: Signs that may have been put between letters.
BETWEEN = ".-_*~'· "
#: Costs of the channel, in nats: a sign for a letter, such a sign for itself, a letter repeated once more, and again, a separator put in.
LOOK, SIGN, TWICE, AGAIN, PUT = 1.2, 1.0, 2.0, 0.3, 0.7
SYMBOLS, WINDOW = 32, 512
#: So many tokens are counted, or known, at once.
TOKENS, CACHE = 200_000, 400_000
#: Rows of labels, and word features, that the classifier is fitted on at most; features of fewer rows are left out.
SAMPLE_ROWS, FEATURES, LEAST_ROWS = 8000, 1024, 3
THRESHOLD = 0.7

#: A token that can only be itself, signs around it left out.
_PLAIN = re.compile(r"[^\w@$+|(<€£§!]*([^\W\d_]+)[^\w@$+|(<€£§!]*")
_TWICE = re.compile(r"([^\W\d_])\1")
_LETTER = re.compile(r"[^\W\d_]")
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]{1,2}\S){2,}(?![^\s.,;:!?])")


def codes(table):
    """Places 1 to 31 of letters, 0 for what is none; `table` remembers those looked up (-1: not yet)."""
    import numpy as np

    def of(text: str):
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        got = table[c]
        if (got < 0).any():
            for x in np.unique(c[got < 0]):
                table[x] = x - 96 if 97 <= x <= 122 else 27 + x % 5 if chr(x).isalpha() else 0
            got = table[c]
        return got

    return of


def _unknown():
    import numpy as np

    return np.full(0x110000, -1, dtype=np.int8)


def four_in_a_row(c):
    """(numbers, there): the last three letters of the word and what comes next, for every letter and word end of coded text, and which places of [0, *c, 0] these are."""
    import numpy as np

    c = np.concatenate([[0], c, [0]]).astype(np.int32)
    b1 = np.concatenate([[0], c[:-1]])
    b2 = np.where(b1 > 0, np.concatenate([[0], b1[:-1]]), 0)
    b3 = np.where(b2 > 0, np.concatenate([[0], b2[:-1]]), 0)
    there = (c > 0) | (b1 > 0)
    return (((b3 * SYMBOLS + b2) * SYMBOLS + b1) * SYMBOLS + c)[there], there


def language_model(docs: DataFrame, *, text: str = "text"):
    """Costs (negative logarithms) of a character after three others, over all texts of docs."""
    import numpy as np

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        of, total, held = codes(_unknown()), np.zeros(SYMBOLS**4), Counter()

        def add():
            c, times = of("\n".join(held)), np.fromiter(held.values(), dtype=float, count=len(held))
            long = np.fromiter(map(len, held), dtype=np.int64, count=len(held)) + 1
            if len(c) + 1 == long.sum():
                at, there = four_in_a_row(c)
                # Of a token's characters each counts as often as the token; one more ends the last.
                np.add(total, np.bincount(at, weights=np.concatenate([[0], np.repeat(times, long)])[there], minlength=SYMBOLS**4), out=total)
            held.clear()

        for b in batches:
            for t in b["t"]:
                held.update(t.lower().split())
                if len(held) > TOKENS:
                    add()
        if held:
            add()
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "n": total[at].astype(np.int64)})

    got = docs.select(col(text).alias("t")).where("t is not null").mapInPandas(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(SYMBOLS**4)
    n[got["at"].to_numpy(dtype=np.int64)] = got["n"]
    return costs(n.reshape((SYMBOLS,) * 4))


def costs(n, weight: float = 5.0):
    """From counts, each length of context holding `weight` counts of the next shorter one."""
    import numpy as np

    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for k in range(4):
        own = n.sum(axis=tuple(range(3 - k))) if k < 3 else n
        p = (own + weight * p) / (own.sum(axis=-1, keepdims=True) + weight)
    return -np.log(p).astype(np.float32).ravel()


class Decoder:
    """Words of a text as they were before the channel."""

    def __init__(self, model):
        from array import array

        self.cost = array("f", model.tobytes())
        self._code, self._codes = {}, codes(_unknown())
        self.known: dict[str, tuple[str, ...]] = {}

    def code(self, ch: str) -> int:
        got = self._code.get(ch)
        if got is None:
            got = self._code[ch] = int(self._codes(ch)[0])
        return got

    def lattice(self, token: str) -> list[list[tuple[str, float, int]]]:
        """For each character what it may have been: (letter, '' or ' ' for a word's end, cost, code)."""
        steps, before = [], ""
        for ch in token:
            c = self.code(ch)
            if c:
                ways = [(ch, 0.0, c)]
                if ch == before:
                    ways.append(("", AGAIN if steps[-1][-1][0] == "" else TWICE, 0))
            else:
                looks = LOOKS.get(ch, "")
                ways = [(" ", SIGN if looks and ch != before else 0.0, 0)] + [(x, LOOK, ord(x) - 96) for x in looks]
                if ch in BETWEEN:
                    ways.append(("", PUT, 0))
                elif ch == before and looks:
                    ways.append(("", TWICE, 0))
            steps.append(ways)
            before = ch
        return steps

    def decode(self, token: str) -> tuple[str, ...]:
        """The words on the best way through the token's lattice."""
        cost, out = self.cost, []
        live = {0: (0.0, None)}  # state of three letters: cost and the way there
        for at in range(0, len(token), WINDOW):
            for ways in self.lattice(token[at : at + WINDOW]):
                if len(live) == 1 and len(ways) == 1 and ways[0][2]:
                    letter, toll, c = ways[0]
                    ((state, (so_far, way)),) = live.items()
                    live = {(state * SYMBOLS + c) & 0x7FFF: (so_far + cost[state * SYMBOLS + c], (letter, way))}
                    continue
                new: dict = {}
                for state, (so_far, way) in live.items():
                    for letter, toll, c in ways:
                        if c:
                            to, total, trail = (state * SYMBOLS + c) & 0x7FFF, so_far + toll + cost[state * SYMBOLS + c], (letter, way)
                        elif not letter:
                            to, total, trail = state, so_far + toll, way
                        elif state:
                            to, total, trail = 0, so_far + toll + cost[state * SYMBOLS], (" ", way)
                        else:
                            to, total, trail = 0, so_far + toll, way
                        if to not in new or total < new[to][0]:
                            new[to] = (total, trail)
                live = new
            if at + WINDOW < len(token):
                state = min(live, key=lambda s: live[s][0])
                out.append(self._read(live[state][1]))
                live = {state: (0.0, None)}
        ends = {s: v + (cost[s * SYMBOLS] if s else 0.0) for s, (v, _) in live.items()}
        out.append(self._read(live[min(ends, key=ends.get)][1]))
        return tuple("".join(out).split())

    @staticmethod
    def _read(way) -> str:
        letters = []
        while way is not None:
            letters.append(way[0])
            way = way[1]
        return "".join(reversed(letters))

    def token(self, token: str) -> tuple[str, ...]:
        """The words of a token in lower case."""
        got = self.known.get(token)
        if got is None:
            plain = _PLAIN.fullmatch(token)
            if plain and not _TWICE.search(token):
                got = (plain[1],)
            elif not _LETTER.search(token):
                got = ()
            else:
                got = self.decode(token)
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[token] = got
        return got

    def tokens(self, text: str) -> Counter:
        """How often each token is there; single characters with blanks between them are one."""
        text = text.lower()
        runs = _SPACED.findall(text)
        found = Counter((_SPACED.sub(" ", text) if runs else text).split())
        for r in runs:
            found[" ".join(r.split())] += 1
        return found

    def words(self, tokens: Counter) -> Counter:
        """How often each restored word is there."""
        found: Counter = Counter()
        for token, n in tokens.items():
            for w in self.token(token):
                found[w] += n
        return found

    def restore(self, text: str) -> str:
        """The restored words of a text in their order."""
        out, at = [], 0
        text = text.lower()
        for m in [*_SPACED.finditer(text), None]:
            for token in text[at : m.start() if m else len(text)].split():
                out += self.token(token)
            if m:
                out += self.token(" ".join(m[0].split()))
                at = m.end()
        return " ".join(out)


def fold(key: Column, folds: int = 3) -> Column:
    """crc32 of the key as text, modulo folds; a null key is in fold 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds, F.lit(0))


def features(words: Counter) -> Counter:
    """Words, with a blank behind, and their beginnings of 3 to 8 letters, counted."""
    got: Counter = Counter()
    for w, n in words.items():
        got[w + " "] += n
        for k in range(3, min(8, len(w)) + 1):
            got[w[:k]] += n
    return got


@dataclass
class Model:
    costs: object
    weights: dict[str, tuple[int, float]] = field(default_factory=dict)  # feature: place, weight
    length: float = 0.0
    bias: float = 0.0


#: Decoders of this worker, by a mark of their model: their caches serve all its tasks.
_DECODERS: dict[int, Decoder] = {}


def _decoder(model) -> Decoder:
    import zlib

    mark = zlib.crc32(model.tobytes())
    if mark not in _DECODERS:
        _DECODERS.clear()
        _DECODERS[mark] = Decoder(model)
    return _DECODERS[mark]


def _tall(tokens: Counter) -> float:
    import math

    return math.log1p(sum(tokens.values()))


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model: the characters of all docs, and the labels of rows whose fold is not 1."""
    import numpy as np

    model = language_model(docs, text=text)
    y = labels.select(col(key).alias("key"), col(label).cast("int").alias("y")).where("key is not null and y in (0, 1)").where(fold(F.col("key")) != 1)
    y = y.groupBy("key").agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["count"] for r in y.groupBy("y").count().collect()}
    total = sum(sizes.values())
    if len(sizes) < 2:
        share = sizes.get(1, 0) / total if total else 0.5
        return Model(model, bias=float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    # The keys of the sample are bounded, so they are sent to the texts and no other text moves.
    luck = F.xxhash64("key", F.lit("sample"))
    keys = [y.where(F.col("y") == v).orderBy(luck, "key").limit(sample_rows // 2) for v in (0, 1)]
    rows = docs.select(col(key).alias("key"), F.coalesce(col(text), F.lit("")).alias("t"))
    chosen = written(rows.join(F.broadcast(keys[0].union(keys[1])), "key"), "labelled-sample")

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def rows():
            names = [*held[0].keys() | held[1].keys()]
            got = pd.DataFrame({"f": names, "a": [held[1][f] for f in names], "b": [held[0][f] for f in names]})
            for c in held.values():
                c.clear()
            return got

        decoder = _decoder(model)
        for b in batches:
            for t, y in zip(b["t"], b["y"]):
                held[y].update(features(decoder.words(decoder.tokens(t))).keys())
                if len(held[0]) + len(held[1]) > 300_000:
                    yield rows()
        if held[0] or held[1]:
            yield rows()

    n = {r["y"]: r["count"] for r in chosen.groupBy("y").count().collect()}
    if len(n) < 2:
        return Model(model, bias=float(np.log((sizes[1] + 1e-3) / sizes[0])))
    by = chosen.mapInPandas(seen, "f string, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("a") >= LEAST_ROWS)

    def part(got: Column, of: int) -> Column:
        """A label's share in the likelihood ratio of a feature's being there."""
        both = (F.col("a") + F.col("b")) / float(n[0] + n[1])
        return got * F.log((got + 0.5) / (of + 1.0) / both) + (of - got) * F.log((of - got + 0.5) / (of + 1.0) / F.greatest(1 - both, F.lit(1e-9)))

    by = by.where(F.col("a") * n[0] > F.col("b") * n[1]).withColumn("g", part(F.col("a"), n[1]) + part(F.col("b"), n[0]))
    names = [r["f"] for r in by.where("g > 8").orderBy(F.desc("g"), "f").limit(FEATURES).select("f").collect()]
    place = {f: i for i, f in enumerate(names)}

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = _decoder(model)
        for b in batches:
            out = []
            for k, t, y in zip(b["key"], b["t"], b["y"]):
                tokens = decoder.tokens(t)
                got = {place[f]: c for f, c in features(decoder.words(tokens)).items() if f in place}
                out.append((str(k), y, _tall(tokens), list(got), list(map(float, got.values()))))
            if out:
                yield pd.DataFrame(out, columns=["key", "y", "tall", "at", "n"])

    got = chosen.mapInPandas(counted, "key string, y int, tall double, at array<int>, n array<double>").toPandas()
    got = got.sort_values(["key", "y", "tall"], kind="stable").reset_index(drop=True)
    x = np.zeros((len(got), len(names) + 1), dtype=np.float32)
    for i, (at, c) in enumerate(zip(got["at"], got["n"])):
        if len(at):
            x[i, at] = np.log1p(c)
    x[:, -1] = got["tall"] / 10
    target = got["y"].to_numpy(dtype=np.float32)
    weight = np.where(target == 1, sizes[1] / n[1], sizes[0] / n[0]).astype(np.float32)
    w, bias = logistic(x, target, weight / weight.sum())
    return Model(model, {f: (i, float(v)) for i, (f, v) in enumerate(zip(names, w)) if v}, float(w[-1]) / 10, float(bias))


def logistic(x, y, weight, steps: int = 400, decay: float = 3e-5):
    """Weights and bias of the weighed logistic loss with a quadratic penalty, by accelerated gradient steps."""
    import numpy as np

    rate = 4 / (float((weight * (x * x).sum(axis=1)).sum()) + 1)
    w, b = np.zeros(x.shape[1], dtype=np.float32), 0.0
    vw, vb = w.copy(), b
    for i in range(steps):
        miss = (1 / (1 + np.exp(-np.clip(x @ vw + vb, -50, 50))) - y) * weight
        nw, nb = vw - rate * (x.T @ miss + decay * vw), vb - rate * float(miss.sum())
        m = i / (i + 3)
        vw, vb, w, b = nw + m * (nw - w), nb + m * (nb - b), nw, nb
    return w, b


def score(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted (1 from the threshold on)."""

    @F.pandas_udf("double")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import math

        decoder, weights = _decoder(model.costs), model.weights
        # What a token adds; most add nothing.
        adds: dict[str, list[str]] = {}
        nothing: set[str] = set()
        for texts in parts:
            out = []
            for t in texts:
                tokens, got = decoder.tokens(t or ""), Counter()
                for token in tokens.keys() - nothing:
                    own = adds.get(token)
                    if own is None:
                        own = [f for f in features(Counter(decoder.token(token))).elements() if f in weights]
                        if len(nothing) + len(adds) >= CACHE:
                            nothing.clear()
                            adds.clear()
                        if own:
                            adds[token] = own
                        else:
                            nothing.add(token)
                    for f in own:
                        got[f] += tokens[token]
                z = model.bias + model.length * _tall(tokens) + sum(weights[f][1] * math.log1p(n) for f, n in sorted(got.items()))
                out.append(1 / (1 + math.exp(-max(-50.0, min(50.0, z)))))
            yield pd.Series(out, dtype=float)

    got = docs.withColumn("score", of(col(text)))
    return got.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def restored(docs: DataFrame, costs, *, text: str = "text", name: str = "restored") -> DataFrame:
    """docs with the restored words of each text, joined by blanks."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        decoder = _decoder(costs)
        return pd.Series([decoder.restore(t or "") for t in texts], dtype=object)

    return docs.withColumn(name, of(col(text)))
