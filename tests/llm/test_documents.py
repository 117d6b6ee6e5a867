"""Operators on documents against plain versions of their results."""

import hashlib
import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import cases
import corpus_pipeline
import numpy as np
import pytest
from graphloom.llm import _shared, langid, mixing, near, order_minhash, packing, queries, sharding, simhash, substring


def words(t):
    return (t or "").encode().split()


@pytest.fixture(scope="module")
def docs(spark):
    return cases.docs(spark).cache()


def plain(docs):
    return [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]


def test_sharding(spark, docs):
    got = sharding.shard(docs, 5).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in plain(docs))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    counts = [len(by[s]) for s in range(5)]
    assert max(counts) - min(counts) <= 1
    assert sharding.shard(cases.empty(spark), 5).count() == 0


def test_sharding_against_the_walk(spark):
    d = spark.range(3000).selectExpr("id as doc_id", "cast(id as string) as text")
    n, slack = 6, 0.1
    pos = {r["doc_id"]: r["p"] for r in d.selectExpr("doc_id", "xxhash64(doc_id) & 4294967295 as p").collect()}
    points, room = sharding.ring_points(n, 64), sharding.capacities(3000, n, slack)
    at = [p for p, _ in points]
    # The same rounds, key by key: all that wait try their k-th point, in ring order.
    waiting, where, k = sorted(pos, key=lambda i: (pos[i], i)), {}, 0
    while waiting:
        left = []
        for i in waiting:
            a = np.searchsorted(at, pos[i])
            s = points[(a + k) % len(points)][1]
            if room[s]:
                room[s] -= 1
                where[i] = s
            else:
                left.append(i)
        waiting, k = left, k + 1
    got = {r["doc_id"]: r["shard"] for r in sharding.shard(d, n, slack=slack).collect()}
    moved = sum(got[i] != where[i] for i in got)
    assert Counter(got.values()) == Counter(where.values()) and moved <= 3
    more = {r["doc_id"]: r["shard"] for r in sharding.shard(d, n + 1, slack=slack).collect()}
    assert sum(got[i] != more[i] for i in got) < 0.35 * len(got)


def ball_classes(rows):
    fps = [simhash.fingerprint(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)].append(r[0])
    return Counter((r[0], fps[i], min(least[find(i)], default=None)) for i, r in enumerate(rows))


def test_simhash(spark, docs):
    got = simhash.classes(docs).collect()
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == ball_classes(plain(docs))
    assert simhash.classes(cases.empty(spark)).count() == 0


def test_simhash_links_connect_every_distance(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 62, 40)]
    fps = set(base)
    for x in base:
        y = x
        for _ in range(3):  # chains of steps of 1 to 3 bits
            for b in rng.choice(64, rng.integers(1, 4), replace=False):
                y ^= 1 << int(b)
            fps.add(y)
    fps = sorted(fps)
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(fps):
        for y in fps[:i]:
            if bin(x ^ y).count("1") <= 3:
                root[find(x)] = find(y)
    want = {frozenset(y for y in fps if find(y) == find(x)) for x in fps}
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    for a, b in simhash.links(df).collect():
        root[find(a % (1 << 64))] = find(b % (1 << 64))
        assert bin((a ^ b) % (1 << 64)).count("1") <= 3
    fresh = {x: x for x in fps}
    root.clear()
    root.update(fresh)
    for a, b in simhash.links(df).collect():
        root[find(a % (1 << 64))] = find(b % (1 << 64))
    assert {frozenset(y for y in fps if find(y) == find(x)) for x in fps} == want


def near_classes(rows):
    grams = []
    for _, t, _ in rows:
        w = (t or "").lower().split()
        grams.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(grams):
        for j, b in enumerate(grams[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def near_rows():
    """Texts at 0.6 to 1 of each other, chains of them, and a group around one text with a common line."""
    r = random.Random(11)
    line = cases.words(r, 12)
    out = []
    for base in range(12):
        w = cases.words(r, r.randint(5, 90)).split()
        for _ in range(8):
            out.append(" ".join(w if base % 3 else [*w, line]))
            at = r.randrange(len(w))
            w = [*w[:at], cases.words(r, 1), *w[at + r.randint(0, 1) :]]
    passage = cases.words(r, 300)
    for n in (520, 900, 2000):
        w = cases.words(r, n).split()
        for cut in (0, 1, n // 10, n // 9, n // 8, n // 3):
            out += [" ".join([*w[cut:], passage]), " ".join([passage, *w[: n - cut], cases.words(r, cut)])]
    center = cases.words(r, 80).split()
    for _ in range(60):
        at = r.randrange(80)
        out.append(" ".join([*center[:at], cases.words(r, 1), *center[at + 1 :], cases.words(r, r.randint(0, 9))]))
    return [(i, t, None) for i, t in enumerate(out)]


def test_counts_never_say_more_than_the_sets_differ():
    r = np.random.default_rng(5)
    assert near.counts(np.arange(near.LONG, dtype="<u8")) is None
    for n in (513, 1024, 1025, 5000, 40_000):
        g = np.unique(r.integers(0, 1 << 48, n).astype("<u8"))
        assert len(near.counts(g)) * near.EACH >= len(g)
        for m in (0, 1, n // 9, n // 2, n):
            h = np.unique(np.concatenate([g[m:], r.integers(0, 1 << 48, m // 2 + 600).astype("<u8")]))
            differ = len(np.setxor1d(g, h))
            for x, y in ((g, h), (h, g)):
                if near.counts(x) and near.counts(y):
                    assert near.apart(near.counts(x), near.counts(y)) <= differ
        assert near.apart(near.counts(g), near.counts(g)) == 0
        other = np.unique(r.integers(0, 1 << 48, n).astype("<u8"))
        assert near.apart(near.counts(g), near.counts(other)) * 180 > 20 * (len(g) + len(other))
    # All elements at one place: its count goes round 256.
    heap = np.arange(1, 1000, dtype="<u8") << np.uint64(20)
    assert near.apart(near.counts(heap), near.counts(heap[:700])) <= 299


@pytest.mark.parametrize("common", [0, 50_000])
def test_near_duplicates_are_pairs_of_80_percent(spark, monkeypatch, common):
    monkeypatch.setattr(near, "SAMPLE", 1)
    monkeypatch.setattr(near, "COMMON", common)
    monkeypatch.setattr(near, "CROWD", 1)
    rows = near_rows()
    want = defaultdict(set)
    for (i, _, _), c in zip(rows, near_classes(rows)):
        want[c].add(i)
    assert sum(len(x) > 1 for x in want.values()) > 12 and len(want) > 30
    got = defaultdict(set)
    d = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string").repartition(3)
    for r in near.classes(d).collect():
        got[r["root"]].add(r["doc_id"])
    assert {frozenset(x) for x in got.values()} == {frozenset(x) for x in want.values()}
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, d, "").collect()} == {min(x) for x in want.values()}


def test_near_duplicates_awkward_rows(spark, docs):
    rows, got = plain(docs), near.first_of_each(docs)
    assert got.columns == docs.columns
    best = {}
    for (i, t, _), c in zip(rows, near_classes(rows)):
        if i is not None:
            best[c] = min(best.get(c, i), i)
    assert Counter(r["doc_id"] for r in got.collect()) == Counter([*best.values(), None, None])
    assert near.first_of_each(cases.empty(spark)).count() == 0


def test_order_minhash(spark, docs):
    rows = sorted(plain(docs), key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    texts = [t or "" for _, t, _ in rows]
    want = Counter()
    for i, (k, _, _) in enumerate(rows):
        t, n = texts[i], len(texts[i])
        nxt = texts[(i + 1) % len(rows)]
        want[(k, n, hashlib.sha256((t[: n - n // 3] + nxt[: n // 3]).encode()).hexdigest())] += 1
    got = order_minhash.compared(docs).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    by = {r["doc_id"]: r for r in got}
    assert by[7]["fingerprint"] == by[105]["fingerprint"] != by[8]["fingerprint"]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert set(by[100]["fingerprint"]) == {"0"} and by[100]["near_edited"] == 1
    assert order_minhash.compared(cases.empty(spark)).count() == 0
    one = order_minhash.compared(docs.where("doc_id = 5")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1


def test_order_minhash_falls_with_edits():
    f = order_minhash.fingerprinter()
    import random

    t = cases.words(random.Random(5), 400)
    half = len(t) // 2
    near = order_minhash.likeness(f(t), f(t[:50] + "x" + t[51:]))
    moved = order_minhash.likeness(f(t), f(t[half:] + t[:half]))
    other = order_minhash.likeness(f(t), f(cases.words(random.Random(6), 400)))
    assert near > 0.9 > moved > other < 0.1


def test_langid(spark, docs):
    model = langid.train(docs)
    assert model.languages == ["xx", "yy"]
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    for i in (100, 101, 102, 103):
        assert got[i]["lang_pred"] == "und" if i != 103 else True
    assert got[103]["lang_pred"] == "und" and got[103]["score"] == 0
    assert all(got[i]["lang_pred"] == ("xx" if i % 2 else "yy") for i in range(40))
    assert langid.train(cases.empty(spark)) is None
    assert {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(cases.empty(spark), model).count() == 0


def test_codewords_are_apart():
    for n in (1, 2, 4, 6, 7, 30):
        code = langid.codewords(n)
        assert len(code) == n and len({tuple(x) for x in code}) == n


def cut_plainly(rows):
    seqs = [words(t) for _, t, _ in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in seqs for i in range(len(w) - 34))
    want = Counter()
    for (k, _, _), w in zip(rows, seqs):
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        want[(k, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode())] += 1
    return want


def test_substring(spark, docs):
    got = substring.cut(docs).select("doc_id", "_cut.*").collect()
    assert Counter(tuple(r) for r in got) == cut_plainly(plain(docs))
    assert substring.cut(cases.empty(spark)).count() == 0


def test_substring_overlaps_in_one_text(spark):
    import random

    r = random.Random(2)
    a, b = cases.words(r, 50), cases.words(r, 20)
    rows = [(1, f"{a} {b} {a}", None), (2, f"{b} {a.split(' ', 9)[9]} {b}", None), (3, "w " * 80, None), (4, cases.words(r, 200), None), (5, " ".join(["p q"] * 30), None), (6, f"{a.rsplit(' ', 12)[0]} {b}", None)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    assert Counter(tuple(x) for x in substring.cut(df).select("doc_id", "_cut.*").collect()) == cut_plainly(rows)


def test_mixing(spark, docs):
    rows = plain(docs)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        level = (total - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and weight[s] * level > 3 * sizes[s]}
        if not more:
            break
        capped |= more
    target = {s: 3 * sizes[s] if s in capped else weight[s] * level for s in order}
    m = mixing.mix(docs, block=16)
    got = m.taken.collect()
    assert Counter((r["doc_id"], r["size"], r["source_size"]) for r in got) == Counter((i, len(words(t)), sizes[s]) for i, t, s in rows)
    took = Counter()
    for r in got:
        took[r["source"]] += r["taken"]
        assert r["target"] == pytest.approx(target[r["source"]]) and r["taken"] <= 3 * r["size"]
    assert all(abs(took[s] - target[s]) <= 1 for s in order)
    assert m.schedule.agg({"words": "sum"}).first()[0] == sum(took.values())
    again = mixing.mix(docs.repartition(5), block=16).taken
    key = lambda rs: Counter((r["doc_id"], r["size"], r["taken"]) for r in rs)
    assert key(again.collect()) == key(got)
    assert mixing.mix(cases.empty(spark)).taken.count() == 0


def test_mixing_spreads_sources(spark):
    d = spark.range(4000).selectExpr("id as doc_id", "'a b c d e f g h' as text", "concat('s', id % 2) as source")
    s = mixing.mix(d, block=8).schedule.orderBy("slot").collect()
    share = sum(r["sid"] == 1 for r in s) / len(s)
    for at in range(0, len(s) - 100, 100):
        assert abs(sum(r["sid"] == 1 for r in s[at : at + 100]) / 100 - share) < 0.05


def test_mixed_rows(spark, docs):
    got = mixing.mixed_rows(docs)
    assert got.columns == docs.columns
    counts = Counter(r["doc_id"] for r in got.collect())
    assert max(v for k, v in counts.items() if k is not None) <= 9 and counts[100] == 1


def test_packing(spark, docs):
    tok = packing.encoder(queries.tokenizer_path())
    from tokenizers import Tokenizer

    plain_tok = Tokenizer.from_file(queries.tokenizer_path())
    length, want = 64, Counter()
    for k, t, _ in plain(docs):
        ids = np.array([*plain_tok.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        assert tok([t or ""])[0].tolist() == ids[:-1].tolist()
        for n, s in enumerate(range(0, len(ids), length)):
            want[(k, n, s, len(ids[s : s + length]), zlib.crc32(ids[s : s + length].tobytes()))] += 1
    got = packing.packed(docs, queries.tokenizer_path(), length=length, group_rows=50).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= length
    least = -(-sum(r["length"] for r in got) // length)
    assert len(by) <= least + 4
    assert packing.packed(cases.empty(spark), queries.tokenizer_path()).count() == 0


def test_encoder_agrees_on_awkward_texts():
    import random

    from tokenizers import Tokenizer

    r = random.Random(1)
    alphabet = "aZ09 \n\t 'sS't.,!é́ÀßΣσİı½²٣中文🙂​\x1c\x85 <|endoftext|>'ll'VE\x00~\x7f­ǅԱա"
    texts = ["".join(r.choices(alphabet, k=r.randint(0, 40))) for _ in range(3000)] + ["a<|endoftext|>b", "ΑΣ ΟΔΟΣ"]
    tok = Tokenizer.from_file(queries.tokenizer_path())
    assert [x.tolist() for x in packing.encoder(queries.tokenizer_path())(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_lower_bound_is_one():
    rng = np.random.default_rng(0)
    for room in (10, 37):
        for _ in range(60):
            xs = sorted(rng.integers(1, room, rng.integers(1, 40)).tolist(), reverse=True)
            seq, place = packing.best_fit(xs, room)
            assert packing.lower_bound(np.bincount(xs, minlength=room + 1), room) <= len(set(seq))
    assert packing.lower_bound(np.bincount([6] * 9, minlength=11), 10) == 9
    assert packing.lower_bound(np.bincount([4] * 9, minlength=11), 10) == 5
