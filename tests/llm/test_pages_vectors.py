"""Operators on pages and vectors, and the entry of the subpackage."""

import base64
import hashlib
import html
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from graphloom.llm import extraction, labelled_pages, topk, warc

PAGES = "page_id long, url string, html string, key string, record string"


def pages(spark):
    kinds = [None, "", "abc", "é", "x" * 5000]
    rows = [(i, None if i == 3 else f"http://www.H{i % 3}.org:80/p {i % 5}?q=1", f"only {i}" if i % 7 == 0 else kinds[i % 5], "k", "r") for i in range(40)]
    rows += [(None, "http://a.b/", "abc", "k", "r"), (None, None, "no id", "k", "r"), rows[0], rows[9]]
    return spark.createDataFrame(rows, PAGES).repartition(3), rows


def test_warc_round_trip(spark):
    df, rows = pages(spark)
    first = {}
    for i, _, h, *_ in rows:
        p = (h or "").encode()
        first[p] = min((x for x in (first.get(p), i) if x is not None), default=None)
    want = Counter()
    for i, _, h, *_ in rows:
        p = (h or "").encode()
        mark = base64.b32encode(hashlib.sha1(p).digest()).decode()
        own = first[p] is None or first[p] == i
        want[(i, len(p), mark, "response" if own else "revisit", None if own else first[p])] += 1
    assert Counter(tuple(r)[:5] for r in warc.round_trip(df).collect()) == want
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_warc_index_finds_every_capture(spark):
    df, _ = pages(spark)
    captures = warc.write(df)
    shards = warc.index(captures, block_lines=4)
    want = Counter((r["key"], r["record"], r["file"], r["offset"]) for r in captures.collect())
    asked = captures.select("key").union(spark.createDataFrame([("zz,nowhere)/",), ("",)], "key string"))
    got = Counter((r["key"], r["record"], r["file"], r["offset"]) for r in warc.lookup(shards, asked).collect())
    assert got == want


def test_warc_through_the_index_is_what_the_archives_hold(spark):
    df, rows = pages(spark)
    captures = warc.write(df, file_bytes=2000)
    asked = captures.select("key")
    got = warc.fetch(warc.lookup(warc.index(captures, block_lines=3), asked), captures.first()["folder"], span=500)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, warc.read(captures).collect())) and got.count() == len(rows)


def test_warc_keeps_very_long_pages_and_ids_with_two_pages(spark):
    long = "<p>word " * 400_000
    rows = [(1, "http://a/", long), (2, "http://a/", long), (1, "http://a/", "other"), (3, None, "other"), (None, "u", None), (None, "u", None)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got) == Counter(
        [(1, len(long), "response", None), (2, len(long), "revisit", 1), (1, 5, "response", None), (3, 5, "revisit", 1), (None, 0, "response", None), (None, 0, "response", None)]
    )
    assert all(r["payload_digest"] == r["recorded_digest"] for r in got)


def test_warc_archives_of_many_records_are_read_in_one_pass():
    one = [warc.member(b"WARC/1.1\r\n" + np.random.default_rng(i).bytes(1700)) for i in range(16_000)]
    start = time.process_time()
    assert sum(1 for _ in warc.members(b"".join(one))) == len(one)
    assert time.process_time() - start < 2


def test_url_key():
    assert warc.url_key("http://User@b.A.org:80/x y?z") == "org,a,b:80)/x%20y?z"
    assert warc.url_key(None) == "" and warc.url_key("//a.b") == "b,a)/" and warc.url_key("plain\n") == "plain%0A"


@pytest.fixture(scope="module")
def model():
    return extraction.train()


def accuracy(model, pages):
    blocks, right, n = extraction.block_parser(), 0, 0
    for h in pages:
        found = blocks(h)
        scores = [sum(model.weights.get(f, 0) for f in extraction.path_features(p) + extraction.text_features(t, a, p.form())) for p, t, a, _ in found]
        right += sum(k == y for k, (*_, y) in zip(model.viterbi(scores), found))
        n += len(found)
    return right / n


def test_extraction_of_held_out_labelled_pages(model):
    assert accuracy(model, labelled_pages.pages(100, seed=77)) > 0.98


def test_extraction_of_pages_with_unseen_names():
    ours, others = labelled_pages.halves()
    assert not any(set(ours[p]) & set(others[p]) for p in ours)
    assert accuracy(extraction.train(labelled_pages.pages(900, names=ours)), labelled_pages.pages(100, seed=78, names=others)) > 0.94


#: Markup that is not closed or stands where no list expects it: no text is lost.
UNTIDY = [
    ("<article><p>one</p><video src=a><p>two</p><p>three</p></article>", ["one", "two", "three"]),
    ("<article><p>E = <math><mi>m</mi><mi>c</mi></math> holds</p></article>", ["E = mc holds"]),
    ("<p>a<object data=x>b</object> c<canvas>d</canvas></p><noscript>e</noscript>", ["ab cd", "e"]),
    ("<p>a</p><!-- open <p>two</p>", ["a", "two"]),
    ("<p>x <svg><text>no</text></svg> y</p><svg><p>z</p>", ["x y", "z"]),
    ("<iframe src=a><p>one</p><iframe src=b>no</iframe><p>t</p>", ["one", "t"]),
    ("<title>gone <p>one</p><script>var a; <p>two</p><style>x <p>three", ["one", "two", "three"]),
    ("<div><template><p>no</div><p>yes</p>", ["yes"]),
    ("a < b and c > d <y", ["a < b and c > d <y"]),
    ("<b>bold <i>both</b> one</i> <p title='a > b' class=\"x>y\">q</p>", ["bold both one", "q"]),
    ("plain", ["plain"]),
]


@pytest.mark.parametrize("page, want", UNTIDY)
def test_no_text_is_lost(page, want):
    assert [b[1] for b in extraction.block_parser()(page)] == want


def test_main_text_of_untidy_pages(model):
    extract = extraction.extractor(model)
    long = "One two three four five six seven eight nine ten eleven twelve, and then some more words to go."
    menu = '<div class=nav><ul><li><a href="/">Home</a><li><a href="/b">More</a></ul></div>'
    assert extract(UNTIDY[0][0]) == "one\n\ntwo\n\nthree" and extract(UNTIDY[1][0]) == "E = mc holds"
    assert extract(f'<form id="aspnetForm">{menu}<div class="content"><h1>Title</h1><p>{long}</p><p>{long}</p></div></form>') == f"Title\n\n{long}\n\n{long}"
    assert extract(f"<section><h1>Title</h1><p>{long}</p><p>{long}</p></section>") == f"Title\n\n{long}\n\n{long}"
    assert extract(long) == long


@pytest.mark.parametrize("page", ["<div>" * 20_000, "<div class=a>" * 20_000, "<!--" * 100_000, "<script>" * 50_000, '<a b="x>' * 50_000, "<p><div>" + "<h1>" * 10_000 + "<p>x" * 10_000, "<p>" + "word " * 1_000_000])
def test_long_and_hostile_pages_are_read_in_one_pass(model, page):
    start = time.process_time()
    extraction.extractor(model)(page + "x")
    assert time.process_time() - start < 3


def test_viterbi_against_all_labellings():
    rng = np.random.default_rng(0)
    for _ in range(30):
        m = extraction.Model({}, rng.normal(size=(2, 2)).tolist(), float(rng.normal()))
        s = rng.normal(size=rng.integers(1, 7))
        best = max(range(1 << len(s)), key=lambda x: score(m, s, [x >> i & 1 for i in range(len(s))]))
        assert m.viterbi(s) == [best >> i & 1 for i in range(len(s))]


def score(m, s, y):
    return sum(s[i] for i in range(len(s)) if y[i]) + m.first * y[0] + sum(m.moves[a][b] for a, b in zip(y, y[1:]))


def test_blocks_of_untidy_markup():
    blocks = extraction.block_parser()
    got = [b[1] for b in blocks("<p>a<b>b&amp;c<br>d<p>e <script>var x='</p>'</script>f<ul><li>g<li>h</ul>tail &nbsp; x<!-- <p>no --><td>t</div></p>end")]
    assert got == ["ab&c d", "e f", "g", "h", "tail x", "t", "end"]
    assert [b[1] for b in blocks("<html><head><title>t</title><meta x><style>p{}</style><body><p>kept")] == ["kept"]
    assert blocks(None) == [] and blocks("") == [] and blocks("<<<>") is not None


def test_extraction_on_a_table(spark):
    body = "<nav><ul><li><a href=x>Home</a></ul></nav><div class=ad>Buy now.</div><article><h1>T&eacute;st</h1><p>One\n two.<p>Three.</article><footer>&copy; me</footer>"
    df = spark.createDataFrame([(1, body, "old"), (2, None, "old"), (3, "", "old"), (1, body, "old")], "page_id long, html string, text string")
    got = Counter((r["page_id"], r["text"]) for r in extraction.main_text(df).collect())
    assert got == Counter({(1, "Tést\n\nOne two.\n\nThree."): 2, (2, ""): 1, (3, ""): 1})
    assert extraction.main_text(df.limit(0)).count() == 0


def test_extraction_against_the_template(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in extraction.main_text(df).collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n\n".join(filter(None, want))


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8 if i % 9 else 5).tolist(), "x") for i in range(300)]
    rows[20] = (20, None, "x")
    rows[21] = (21, [1.0, None], "x")
    rows[22] = (22, [float("nan")] * 8, "x")
    rows[23] = (23, [float("inf")] * 8, "x")
    rows[24] = (24, [], "x")
    rows += [(400 + i, rows[2][1], "x") for i in range(60)]  # ties
    rows += [(None, rows[3][1], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    use = {}
    for i, v, _ in rows:
        if v is not None and all(e is not None and np.isfinite(e) for e in v):
            use[i] = np.pad(np.floor(256 * np.array(v)).astype(np.int64), (0, 8 - len(v)))
    want = {}
    for q, v in use.items():
        if q is not None and q % 10 == 0:
            best = sorted(((-int(v @ x), i is None, i or 0, i) for i, x in use.items() if i != q))[:5]
            want[q] = [(b[3], -b[0]) for b in best]
    got = {}
    for r in topk.top_k(df, every=10, block=16, query_block=4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == want
    assert topk.top_k(df.limit(0)).count() == 0
    assert len(topk.top_k(df.where("vec_id in (0, 1)"), every=1).collect()) == 2


def test_the_rest_does_not_need_this_subpackage():
    import subprocess
    import sys
    from pathlib import Path

    top = Path(__file__).resolve().parents[2]
    code = "import sys; sys.modules['graphloom.llm'] = None; import graphloom.plans.queries, graphloom.api" if (top / "graphloom/api.py").exists() else "import sys; sys.modules['graphloom.llm'] = None; import graphloom.plans.queries"
    assert subprocess.run([sys.executable, "-c", code], cwd=top).returncode == 0


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10", "pipeline"])
def test_every_query_is_registered(name):
    import __spark_entry__

    assert [k for k in __spark_entry__.queries() if k == name or k.startswith(f"{name}_")]


P = " ".join(f"word{i}" for i in range(19)) + " end."
LINKS = "".join(f'<li><a href="/x">Link {i}</a></li>' for i in range(5))


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<article><p>{P}</p></article><div class=comments><p>nice one</p><p>I agree with you.</p></div>", [P]),
        (f"<html><body><article><p>{P}</p></article><div class=comments><p>nice one</p></div></body></html>", [P]),
        (f"<div class=container><div class=row><div class=col-md-8><h2>T</h2><p>{P}</p><p>{P}</p></div><div class=col-md-4><ul>{LINKS}</ul></div></div></div>", ["T", P, P]),
        ("<div class=a>" * 5 + f"<p>{P}</p><p>{P}</p>" + "</div>" * 5, [P, P]),
        ("<div class=a>" * 30 + f"<p>{P}</p><p>{P}</p>" + "</div>" * 30, [P, P]),
        ("<div class=a>" * 20_000 + f"<p>{P}</p>" + "</div>" * 20_000, [P]),
        (f"<div id=mw-content-text><p>{P}</p><p>{P}</p></div><div id=mw-navigation><ul>{LINKS}</ul></div>", [P, P]),
        (f"<p>{P}</p>", [P]),
        (f"<nav><ul>{LINKS}</ul></nav>", []),
        ("", []),
    ],
)
def test_ordinary_pages_are_not_empty(page, want):
    got = extraction.extractor(extraction.standard())(page)
    assert all(w in got for w in want) and "nice one" not in got and "Link 1" not in got
    assert bool(got) == bool(want)


def test_the_best_labelling_that_keeps_something():
    import itertools

    r = random.Random(4)
    for _ in range(200):
        n = r.randint(1, 6)
        m = extraction.Model({}, [[r.uniform(-2, 2) for _ in range(2)] for _ in range(2)], r.uniform(-2, 2))
        scores = [r.uniform(-3, 1) for _ in range(n)]

        def value(path):
            return sum(s for s, y in zip(scores, path) if y) + m.first * path[0] + sum(m.moves[a][b] for a, b in zip(path, path[1:]))

        runs = [p for p in itertools.product((0, 1), repeat=n) if len([1 for a, b in zip((0, *p), p) if (a, b) == (0, 1)]) == 1]
        best = max(runs, key=value)
        got, empty = m.some(scores), [0] * n
        if any(m.viterbi(scores)):
            assert got == m.viterbi(scores)
        else:
            assert got == (list(best) if value(best) >= value(empty) - extraction.LEAN else empty)


def test_pages_held_out_are_not_empty():
    """Other names than those learned, and pages of other seeds: no page with an article comes out empty but one in 200."""
    a, b = labelled_pages.halves()
    for model, names, most in ((extraction.standard(), None, 3), (extraction.train(labelled_pages.pages(900, names=a)), b, 3)):
        extract, blocks = extraction.extractor(model), extraction.block_parser()
        articles = [h for h in labelled_pages.pages(400, seed=11, names=names) if any(y for *_, y in blocks(h))]
        assert sum(not extract(h) for h in articles) <= most


def test_top_k_never_broadcasts_repeated_query_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(120)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(topk, "GROUP", 2)
    monkeypatch.setattr(topk, "QUERY_GROUP", 3)
    got = topk.top_k(df, every=3, block=8, query_block=2)
    # Both sides are dealt to groups: a join of the repeated blocks might be planned as a broadcast of all of them.
    assert "FlatMapCoGroupsInPandas" in got._jdf.queryExecution().optimizedPlan().toString()
    v = {r["vec_id"]: [math.floor(256 * x) for x in r["embedding"]] for r in df.collect()}
    want = set()
    for q in range(0, 120, 3):
        best = sorted((-sum(a * b for a, b in zip(v[q], x)), i) for i, x in v.items() if i != q)[:5]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert {tuple(r) for r in got.collect()} == want
