"""The registered queries and the pipeline, run on small tables with awkward cases, against plain versions."""

import base64
import hashlib
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import cases
import corpus_pipeline
import numpy as np
import pytest
from graphloom.llm import _shared, langid, order_minhash, queries, simhash
from test_documents import ball_classes, cut_plainly, near_classes, words

PAGE = "<html><head><title>t</title></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>{0}</h1><p>{1}</p></article><footer>&copy; us</footer></body></html>"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with the tables that the queries read; documents have columns with odd names."""
    top = str(tmp_path_factory.mktemp("tables"))
    docs = cases.docs(spark).withColumnsRenamed({"size": "a.dot", "kept": "_cut", "start": "row"})
    docs.write.parquet(f"{top}/documents.parquet")
    r = random.Random(4)
    pages = [(i, f"http://h{i % 3}.org/{i % 7}", PAGE.format(f"T{i % 9}", cases.words(random.Random(i % 9), 20) + ".")) for i in range(60)]
    pages += [(60, None, None), (61, "", ""), (62, "u", PAGE.format("Long", "word " * 200_000)), (None, "http://h1.org/", "x"), pages[3]]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3).write.parquet(f"{top}/pages.parquet")
    vectors = [(i, [r.gauss(0, 1) for _ in range(8)], i) for i in range(200)] + [(200, None, 1), (201, [1.0, None], 1), (202, [float("nan")] * 8, 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").repartition(2).write.parquet(f"{top}/embeddings.parquet")
    return top


def documents(spark, top):
    return [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{top}/documents.parquet").collect()]


def crc(t):
    return zlib.crc32((t or "").encode())


def test_op1(spark, tables):
    got = queries.op1_sharding(spark, tables).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, crc(t)) for i, t, _ in documents(spark, tables))
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    sizes = [len(slots[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_sharding_does_not_depend_on_how_rows_are_dealt(spark):
    from graphloom.llm import sharding

    d = spark.range(4000).selectExpr("id as doc_id", "cast(id % 7 as string) as text")
    assert Counter(sharding.shard(d, 5, cells=8).collect()) == Counter(sharding.shard(d.repartition(7), 5, cells=8).collect())


def test_op2(spark, tables):
    got = queries.op2_simhash(spark, tables).collect()
    assert Counter((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in got) == ball_classes(documents(spark, tables))
    assert all(re.fullmatch("[0-9a-f]{16}", r["fingerprint"]) for r in got)


def test_op3(spark, tables):
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in spark.read.parquet(f"{tables}/pages.parquet").collect()]
    first = {}
    for i, p in rows:
        first[p] = min((x for x in (first.get(p), i) if x is not None), default=None)
    want = Counter()
    for i, p in rows:
        own = first[p] is None or i == first[p]
        want[i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if own else "revisit", None if own else first[p]] += 1
    assert Counter(map(tuple, queries.op3_warc(spark, tables).collect())) == want


def plain_fingerprint(text, k=5, cells=64, picks=2):
    """The same method element by element, with Python's own numbers."""
    m64, weights = (1 << 64) - 1, [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63]

    def mix(x):
        for _ in range(2):
            x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 & m64
        return x ^ (x >> 32)

    grams = [text[i : i + k] for i in range(max(1, len(text) - k + 1))] if text else []
    seen, by = Counter(), defaultdict(list)
    for at, g in enumerate(grams):
        h = sum(ord(c) * (w | 1) for c, w in zip(g, weights)) + (len(g) if len(g) < k else 0)
        h = mix(h & m64)
        e = mix(h + seen[g] * 0x9E3779B97F4A7C15 & m64)
        seen[g] += 1
        by[e % cells].append((e, at))
    out = ""
    for c in range(cells):
        if not by[c]:
            out += "0000"
            continue
        chosen = sorted(sorted(by[c])[:picks], key=lambda x: x[1])
        out += f"{mix(sum(mix(e * 2 + 1 + i * 0xC2B2AE3D27D4EB4F & m64) for i, (e, _) in enumerate(chosen)) & m64) % 65535 + 1:04x}"
    return out


def plain_likeness(a, b):
    cells = [(a[i : i + 4], b[i : i + 4]) for i in range(0, len(a), 4)]
    there = [x == y for x, y in cells if (x, y) != ("0000", "0000")]
    return sum(there) / len(there) if there else 1.0


def test_op4(spark, tables):
    at = {t: h for t, h in {(r["t"], r["h"]) for r in spark.read.parquet(f"{tables}/documents.parquet").selectExpr("coalesce(text, '') as t", "xxhash64(coalesce(text, '')) as h").collect()}}
    rows = sorted(documents(spark, tables), key=lambda r: (r[0] is None, -(r[0] or 0), at[r[1] or ""] if r[0] is None else 0, r[1] or ""))
    texts, want = [t or "" for _, t, _ in rows], Counter()
    for i, (k, _, _) in enumerate(rows):
        t, nxt = texts[i], texts[(i + 1) % len(rows)]
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        f, g, x = map(plain_fingerprint, (t, edited, nxt))
        want[k, len(t), hashlib.sha256(edited.encode()).hexdigest(), f, g, round(plain_likeness(f, g), 9), round(plain_likeness(f, x), 9)] += 1
    got = queries.op4_order_minhash(spark, tables).collect()
    assert Counter((*r[:5], round(r[5], 9), round(r[6], 9)) for r in got) == want


def test_order_of_many_rows_without_a_key(spark):
    d = spark.range(300).selectExpr("if(id % 3 = 0, id, null) as doc_id", "concat(id, ' some text') as text")
    got = order_minhash.compared(d).collect()
    assert len(got) == 300 and len({r["edited_sha256"] for r in got}) == 300
    assert Counter(order_minhash.compared(d.repartition(5)).collect()) == Counter(got)


def test_op5(spark, tables):
    use = {r["vec_id"]: np.floor(256 * np.array(r["embedding"], dtype=float)).astype(int) for r in spark.read.parquet(f"{tables}/embeddings.parquet").where("vec_id < 200").collect()}
    want = set()
    for q in range(0, 200, 50):
        best = sorted((-int(use[q] @ v), i) for i, v in use.items() if i != q)[:5]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert {tuple(r) for r in queries.op5_topk(spark, tables).collect()} == want


def test_top_k_with_few_lengths_on_the_driver(spark, tables, monkeypatch):
    from graphloom.llm import topk

    want = set(queries.op5_topk(spark, tables).collect())
    monkeypatch.setattr(topk, "LENGTHS", 3)
    monkeypatch.setattr(topk, "SENT_BYTES", 0)
    assert {tuple(r) for r in topk.top_k(spark.read.parquet(f"{tables}/embeddings.parquet"), block=8, query_block=2).collect()} == {tuple(r) for r in want}


def test_op6(spark, tables):
    rows = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.train(rows)
    got = {(r["doc_id"], r["lang_pred"], round(r["score"], 9), r["held_out"]) for r in queries.op6_langid(spark, tables).collect()}
    want, f = set(), langid.featurizer()
    for i, t, _ in documents(spark, tables):
        x = f(t)
        fold = i is None or zlib.crc32(str(i).encode()) % 5 == 0
        if x is None:
            want.add((i, "und", 0.0, fold))
            continue
        # The decoder bit by bit: the loss of each language's codeword, then the shares.
        margins = [sum(float(v) * w for v, w in zip(x, model.weights[:, b])) + model.bias[b] for b in range(model.code.shape[1])]
        loss = [sum(np.log1p(np.exp(-m * s)) for m, s in zip(margins, word)) for word in model.code]
        share = np.exp(-np.array(loss))
        want.add((i, model.languages[int(np.argmin(loss))], round(float(share.max() / share.sum()), 9), fold))
    assert {(i, p, h) for i, p, _, h in got} == {(i, p, h) for i, p, _, h in want}
    assert max(abs(a[2] - b[2]) for a, b in zip(sorted(got, key=str), sorted(want, key=str))) < 1e-6


def test_op7(spark, tables):
    want = Counter((i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for (i, n, gone, kept), c in cut_plainly(documents(spark, tables)).items() for _ in range(c))
    assert Counter(map(tuple, queries.op7_substring(spark, tables).collect())) == want


def test_op8(spark, tables):
    got = {r["page_id"]: r for r in queries.op8_extraction(spark, tables).collect()}
    for i in range(60):
        assert got[i]["text"] == f"T{i % 9}\n\n" + cases.words(random.Random(i % 9), 20) + "."
    assert got[60]["text"] == got[61]["text"] == "" and got[60]["n_chars"] == 0 and got[62]["n_chars"] == 999_999 + 6


def test_op9(spark, tables):
    rows = documents(spark, tables)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    got = queries.op9_mixing(spark, tables).collect()
    assert Counter((r["doc_id"], r["size"], r["source_size"]) for r in got) == Counter((i, len(words(t)), sizes[s]) for i, t, s in rows)
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    targets = {(r["source_size"], r["target"]) for r in got}
    assert sum(t for _, t in targets) == pytest.approx(sum(sizes.values())) and abs(sum(r["taken"] for r in got) - sum(sizes.values())) <= len(targets)


def test_op10(spark, tables):
    from tokenizers import Tokenizer

    tok, want = Tokenizer.from_file(queries.tokenizer_path()), Counter()
    for i, t, _ in documents(spark, tables):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for n, s in enumerate(range(0, len(ids), 2048)):
            want[i, n, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())] += 1
    got = queries.op10_packing(spark, tables).collect()
    assert Counter(tuple(r[:5]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(sum(n for o, n in sorted(v)[:k]) == sorted(v)[k][0] for v in by.values() for k in range(len(v)))
    assert len(by) == -(-sum(r["length"] for r in got) // 2048)


def test_another_tokenizer_gets_whole_texts():
    import public_tokenizers
    from graphloom.llm import packing
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["  two  blanks\n\n and\tmore ", "", "x", "a <|endoftext|> b", "Ünï 中文"]
    assert [x.tolist() for x in packing.encoder(path)(texts)] == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]


def test_salted_joins(spark):
    left = spark.range(20_000).selectExpr("id", "if(id % 3 = 0, 7, id) as k").repartition(6)
    right = spark.range(0, 20_000, 2).selectExpr("id as k", "id * 10 as v").union(spark.createDataFrame([(7, 70)], "k long, v long"))
    hot = _shared.hot_keys(left.groupBy("k").agg({"*": "count"}).toDF("k", "n"), ["k"])
    assert [r["k"] for r in hot.collect()] == [7]
    for how in ("inner", "left", "left_semi"):
        assert Counter(_shared.spread_join(left, right, ["k"], how, hot).collect()) == Counter(left.join(right, ["k"], how).collect())
    assert _shared.hot_keys(left.groupBy("id").agg({"*": "count"}).toDF("k", "n"), ["k"]) is None


def test_no_folder_is_made_up_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        _shared.shared_dir(Session())


def test_pipeline_stage_by_stage(spark, tables):
    """Each stage on what the one before it kept, with columns that clash with none of its own."""
    docs = spark.read.parquet(f"{tables}/documents.parquet").cache()
    names, rows = docs.columns, lambda d: [(r["doc_id"], r["text"], r["source"]) for r in d.collect()]
    known = corpus_pipeline.language_id(spark, docs, tables).cache()
    assert known.columns == names and set(known.select("`a.dot`", "_cut", "row", "score").distinct().collect()) == {(1, "q", "q", "q")}
    assert Counter(rows(known)) == Counter(x for x in rows(docs) if x[1] and re.search("[^\\W\\d_]", x[1]))
    one = corpus_pipeline.near_duplicates(spark, known, tables).cache()
    best = {}
    for (i, _, _), c in zip(rows(known), near_classes(rows(known))):
        if i is not None:
            best[c] = min(best.get(c, i), i)
    assert one.columns == names and Counter(r["doc_id"] for r in one.collect()) == Counter([*best.values(), None])
    cut = corpus_pipeline.repeats(spark, one, tables).cache()
    want = Counter()
    for (i, n, gone, kept), c in cut_plainly(rows(one)).items():
        want[i, kept if gone else next(t for k, t, _ in rows(one) if k == i)] += c
    assert cut.columns == names and Counter((r["doc_id"], r["text"]) for r in cut.collect()) == want
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())
    mix = corpus_pipeline.mixed(spark, cut, tables).cache()
    assert mix.columns == names and set(mix.collect()) <= set(cut.collect()) and max(Counter(mix.collect()).values()) <= 4
    packed = corpus_pipeline.packed(spark, mix, tables)
    assert Counter(r["doc_id"] for r in packed.where("piece = 0").collect()) == Counter(r["doc_id"] for r in mix.collect())


def test_pipeline_runs_and_clears_up(spark, tables):
    before = _shared.made()
    got = corpus_pipeline.run(spark, tables)
    assert got.columns[:3] == ["doc_id", "piece", "start"] and got.count() > 30 and _shared.made() == before


def test_pipeline_of_nothing(spark):
    docs = cases.empty(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.count() == 0 and docs.columns == cases.empty(spark).columns
    assert corpus_pipeline.packed(spark, docs, "").count() == 0


def test_mixed_rows_are_told_apart(spark):
    """Rows that share key, source and checksum are documents of their own."""
    from graphloom.llm import mixing

    d = spark.createDataFrame([(None, "a b c", "s", x) for x in range(5)] + [(None, "d e f", "s", 9)], "doc_id long, text string, source string, x int")
    assert sorted(r["x"] for r in mixing.mixed_rows(d).collect()) == [0, 1, 2, 3, 4, 9]


def test_the_closest_near_copies_meet_by_simhash():
    r = random.Random(3)
    t = cases.words(r, 3000)
    assert bin(simhash.fingerprint(t) ^ simhash.fingerprint(t + " more")).count("1") <= 3


def test_mixed_rows_stay_where_they_are(spark):
    """Copies come to the texts: a join of the rows by their own numbers would shuffle every text."""
    from graphloom.llm import mixing

    d = spark.createDataFrame([(i, f"w{i} " * (i % 5), "ab"[i % 2]) for i in range(60)], "doc_id long, text string, source string").repartition(7)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = mixing.mixed_rows(d)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and "Join [part#" in plan
        assert {r["doc_id"] for r in df.collect()} >= {i for i in range(60) if i % 5 == 0}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
