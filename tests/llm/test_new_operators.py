"""Fill-in-the-middle, toxicity and whitening: against plain versions, exact round trips and rows held out."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import fim, queries, toxicity, whitening

import cases

SF = "/root/testdata/sf0.001"


def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def same_fim(df):
    got = fim.transform(df).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_fim(r.doc_id, r.text), r.doc_id
        assert r.back == (r.text or "")
    return got


def test_fim_cases(spark):
    docs = cases.docs(spark)
    got = same_fim(docs)
    assert len(got) == docs.count() and {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.transform(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("chunk, piece", [(1, 4), (3, 7), (5, 1000), (64, 128)])
def test_fim_chunks_and_pieces(spark, monkeypatch, chunk, piece):
    monkeypatch.setattr(fim, "CHUNK", chunk)
    monkeypatch.setattr(fim, "PIECE", piece)
    texts = ["", "a", "ab", "abcdefgh", " a b ", "ab cd\nef!!gh", "日本語 text 𝔘 ok", "a<S>b", "<<P", "<P>", "é" * 9, "x" * 40, "x y" * 30, None, "P>a<S"]
    rows = [(i * len(texts) + k, t) for i in range(12) for k, t in enumerate(texts)]
    assert len(same_fim(spark.createDataFrame([*rows, *rows[:5]], "doc_id long, text string"))) == len(rows) + 5


def test_fim_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op11_fim(spark, SF).collect()
    assert len(got) == len(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in got:
        n, form, p, m, out = plain_fim(r.doc_id, docs[r.doc_id])
        assert tuple(r) == (r.doc_id, n, form, p, m, sha(out), sha(docs[r.doc_id] or ""))


def plain_whiten(vectors):
    """Per row (deviation, whitened by component without sign, explained), by another eigensolver."""
    x = [np.floor(64 * np.asarray(v, dtype=float)).astype(np.int64) + 1_000_000 for v in vectors]
    fit = np.unique(np.array(x), axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = (n * fit - s) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    return n, [(sum(int(a) ** 2 for a in n * r - s), np.abs((n * r - s) / n @ v / np.sqrt(np.maximum(e, 1e-30))), e / e.sum()) for r in x]


def test_whitening_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)]
    n, want = plain_whiten([v for _, v in rows])
    of = dict(zip([k for k, _ in rows], want))
    got = queries.op13_whitening(spark, SF).collect()
    assert len(got) == 16 * len(rows)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    for r in got:
        deviation, whitened, explained = of[r.vec_id]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(abs(r.whitened) - whitened[r.component - 1]) < 1e-7 and abs(r.explained - explained[r.component - 1]) < 1e-10


def test_whitening_cases(spark):
    rng = np.random.default_rng(3)
    v = [[float(x) for x in rng.normal(size=3)] for _ in range(40)]
    rows = [*enumerate(v), (1, v[0]), (None, v[0]), (7, v[0][:2]), (8, None), (9, [1.0, None, 2.0]), (10, [1.0, math.nan, 0.0]), (11, [math.inf, 0.0, 0.0])]
    df = spark.createDataFrame([(k, x, "a", 1) for k, x in rows], "vec_id long, embedding array<double>, component string, n int").repartition(5)
    got = whitening.whiten(df).collect()
    assert len(got) == 3 * 43 and {r.component for r in got} == {1, 2, 3}
    full = [x + [0.0] * (3 - len(x)) for x in [*v, v[0][:2]]]
    n, want = plain_whiten(full)
    assert {r.n for r in got} == {n}
    short = sorted((r for r in got if r.vec_id == 7), key=lambda r: (r.deviation == want[40][0], r.component))[-3:]
    assert all(abs(abs(r.whitened) - want[40][1][r.component - 1]) < 1e-9 for r in short)
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in flat] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)] * 2
    assert whitening.whiten(df.limit(0)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(df.limit(0)).count() == 0


def test_moments_merge_as_one_pass():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(57, 4)) + 1e6
    whole, left = whitening.Moments(4), whitening.Moments(4)
    for r in x:
        whole.add(r)
    for part in np.split(x, [0, 5, 6, 40]):
        m = whitening.Moments(4)
        for r in part:
            m.add(r)
        left.merge(m)
    c = x - x.mean(axis=0)
    for m in (whole, left):
        assert np.abs(m.products - c.T @ c).max() < 1e-6 and m.n == 57


def test_deviation_is_exact_beyond_doubles():
    w = whitening.Whitening(10**9, np.array([10**15, 3]), np.array([1.0]), np.eye(2)[:, :1], 1.0)
    x = np.array([[10**6 + 2, 5]])
    assert w.deviation(x) == [(2 * 10**9) ** 2 + (5 * 10**9 - 3) ** 2] or w.deviation(x) == [None]
    assert w.deviation(np.array([[10**6 + 1, 0]])) == [10**18 + 9]


@pytest.mark.parametrize("n", [1, 2, 3, 8, 33])
def test_eigen(n):
    x = np.random.default_rng(n).normal(size=(n, n))
    for a in (x @ x.T, np.eye(n), np.zeros((n, n)), np.ones((n, n)), np.diag(np.arange(n) * 1.0)):
        e, v = whitening.eigen(a)
        assert np.all(np.diff(e) <= 1e-12) and np.abs(a @ v - v * e).max() < 1e-11 and np.abs(v.T @ v - np.eye(n)).max() < 1e-12


WORDS = "idiot moron trash the thing and over there worthless clown house garden".split()


def model():
    text = "\n".join(" ".join(np.random.default_rng(i).choice(WORDS, size=12)) for i in range(200))
    at, _ = toxicity.four_in_a_row(toxicity.codes(toxicity._unknown())(text))
    return toxicity.costs(np.bincount(at, minlength=toxicity.SYMBOLS**4).reshape((toxicity.SYMBOLS,) * 4).astype(float))


@pytest.mark.parametrize(
    "noisy, plain",
    [("1d10t", "idiot"), ("m0r0n!!", "moron"), ("tr@$h", "trash"), ("iiidiooot", "idiot"), ("i d i o t", "idiot"), ("the i d 1 0 t and", "the idiot and"), ("c.l.o.w.n", "clown"), ("w-o-r-t-h-l-e-s-s.", "worthless"),
     ("the house, and", "the house and"), ("garden###", "garden"), ("555-1234", ""), ("", ""), ("THE Moron", "the moron"), ("house\n\ttrash", "house trash")],
)
def test_restored(noisy, plain):
    assert toxicity.Decoder(model()).restore(noisy) == plain


def test_viterbi_is_the_best_of_all_ways():
    d, costs = toxicity.Decoder(model()), model()

    def price(steps):
        best = (math.inf, "")

        def go(i, state, so_far, out):
            nonlocal best
            if i == len(steps):
                best = min(best, (so_far + (costs[state * 32] if state else 0.0), out))
                return
            for letter, toll, c in steps[i]:
                if c:
                    go(i + 1, (state * 32 + c) & 0x7FFF, so_far + toll + costs[state * 32 + c], out + letter)
                elif letter == "":
                    go(i + 1, state, so_far + toll, out)
                else:
                    go(i + 1, 0, so_far + toll + (costs[state * 32] if state else 0.0), out + " ")

        go(0, 0, 0.0, "")
        return best[1].split()

    rng = np.random.default_rng(5)
    for _ in range(60):
        token = "".join(rng.choice(list("idiotmrn10$@!.-aaee"), size=rng.integers(1, 8)))
        assert list(d.decode(token)) == price(d.lattice(token)), token


def test_model_counts_every_text(spark):
    docs = spark.createDataFrame([("ab ab",), ("ab\n,ab abc",), (None,), ("",), ("AB 1 é",)], "text string").repartition(3)
    got = toxicity.language_model(docs)
    of = toxicity.codes(toxicity._unknown())
    n = np.bincount(toxicity.four_in_a_row(of("ab ab ab ,ab abc ab 1 é"))[0], minlength=32**4)
    assert np.array_equal(got, toxicity.costs(n.reshape((32,) * 4).astype(float)))


def test_long_tokens_are_read_whole():
    d = toxicity.Decoder(model())
    assert "".join(d.token("idiot0" * 400)).count("t") == 400
    assert d.words(d.tokens(" ".join(["x"] * 3000)))


def toxic_rows(seed, n):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        bad = int(r.random() < 0.3)
        words = list(r.choice(["the", "and", "house", "over", "there", "thing", "garden"], size=r.integers(5, 60)))
        if bad:
            words.insert(int(r.integers(len(words))), r.choice(["idiot", "moron", "clown", "1d10t", "m.o.r.o.n", "clooown"]))
        rows.append((seed * 10_000 + i, " ".join(words), bad))
    return rows


def test_toxicity_on_rows_held_out(spark):
    rows = toxic_rows(1, 600)
    docs = spark.createDataFrame([(k, t, "x") for k, t, _ in rows] + [(None, "idiot", "x"), (-1, None, "x"), (-2, "", "x"), (-3, "... !!", "x")], "doc_id long, text string, predicted string").repartition(3)
    labels = spark.createDataFrame([(k, 1, y) for k, _, y in rows] + [(None, 0, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == 604 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    truth, held = {k: y for k, _, y in rows}, [r for r in got if r.doc_id is not None and r.doc_id >= 0 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(r.predicted == truth[r.doc_id] for r in held) and len(held) > 100
    again = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert Counter((r.doc_id, r.score) for r in got) == Counter((r.doc_id, r.score) for r in again)


def test_toxicity_without_labels(spark):
    docs = cases.docs(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, none))
    assert got.count() == docs.count() and {round(r.score, 6) for r in got.collect()} == {0.5}
    one = spark.createDataFrame([(i, 0) for i in range(30)], "doc_id long, toxic int")
    assert all(r.score < 0.01 for r in toxicity.score(docs, toxicity.train(docs, one)).collect())
    assert toxicity.score(cases.empty(spark), toxicity.train(cases.empty(spark), one)).count() == 0


def test_toxicity_query(spark):
    got = queries.op12_toxicity(spark, "/root/testdata/sf0.01").collect()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    truth = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert len(got) == docs and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    hit = sum(r.predicted for r in held if truth[r.doc_id])
    assert sum(r.predicted for r in held) == hit and hit >= 0.6 * sum(truth[r.doc_id] for r in held)
