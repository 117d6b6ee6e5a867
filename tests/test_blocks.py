"""Blocks of links against the same in memory: many small blocks, ways that cross them, and blocks that do not help."""

import random

import pytest
from graphloom.graph import Graph
from graphloom.operators import blocks, closure, communities, topology
from graphloom.operators.project import Projection, projection
from pyspark.sql import functions as F


def links(spark, pairs):
    return spark.createDataFrame(sorted(set(pairs)), "src string, dst string")


def strips(seed, users=12, events=15):
    """Long ways with ways back, and from each strip to the next, as in the journeys; one ring over all of some strips."""
    r = random.Random(seed)
    at = lambda u, e: f"u{u:02}::e{e:02}"
    pairs = [(at(u, e), at(u, e + 1)) for u in range(users) for e in range(events - 1)]
    pairs += [(b, a) for a, b in pairs if r.random() < 0.4]
    pairs += [(at(u, r.randrange(events)), at(u + 1, r.randrange(events))) for u in range(users - 1) for _ in range(3)]
    return [*pairs, (at(5, 3), at(2, 1)), (at(9, 9), at(9, 9))]


def scattered(seed, n=60, m=100):
    r = random.Random(seed)
    return [(f"n{r.randrange(n):02}", f"n{r.randrange(n):02}") for _ in range(m)]


def in_rounds(monkeypatch):
    """How often frames were written: the rounds follow from it."""
    count, real = [0], blocks.checkpointed
    monkeypatch.setattr(blocks, "checkpointed", lambda df: (count.__setitem__(0, count[0] + 1), real(df))[1])
    return count


@pytest.mark.parametrize("pairs", [strips(1), scattered(3), [(f"c{i:03}", f"c{(i + 1) % 90:03}") for i in range(90)]])
def test_components_of_blocks(spark, pairs, size=25):
    e = links(spark, pairs)
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).union(spark.createDataFrame([("alone",)], "id string")).distinct()
    want = sorted(map(tuple, topology.components(nodes, e).collect()))
    assert sorted(map(tuple, topology.components(nodes, e, 0, size).collect())) == want


def test_components_where_blocks_do_not_help(spark, monkeypatch):
    e = links(spark, [p for p in scattered(7, 20, 50) if p[0] != p[1]])
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    want = sorted(map(tuple, topology.components(nodes, e).collect()))
    monkeypatch.setattr(blocks, "KERNEL_EDGES", 1)
    assert sorted(map(tuple, topology.components(nodes, e, 0, 1).collect())) == want
    assert sorted(map(tuple, topology._in_rounds(nodes, e).collect())) == want


def test_few_rounds_where_ways_are_long(spark, monkeypatch):
    """The trimming before took a round for each of the 400 steps."""
    e = links(spark, [(f"c{i:03}", f"c{i + 1:03}") for i in range(400)])
    count = in_rounds(monkeypatch)
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    assert topology.components(nodes, e, 0, 100).where("id = component").count() == 401
    assert count[0] < 40
    count[0] = 0
    assert dict(map(tuple, topology.layers(nodes, e, 100).collect())) == {f"c{i:03}": 400 - i for i in range(401)}
    assert count[0] < 40


@pytest.mark.parametrize("size", [20, 10**6])
def test_layers_of_blocks(spark, size):
    for pairs in (strips(4), scattered(5, 80, 160)):
        e = links(spark, [(min(p), max(p)) for p in pairs if p[0] != p[1]])
        nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
        got = dict(map(tuple, topology.layers(nodes, e, size).collect()))
        down: dict = {}
        for a, b in sorted(map(tuple, e.collect()), reverse=True):
            down[a] = max(down.get(a, 0), down.get(b, 0) + 1)
        assert got == {r.id: down.get(r.id, 0) for r in nodes.collect()}
    assert dict(map(tuple, topology.layers(nodes.limit(0), links(spark, [("a", "b"), ("b", "a"), ("c", "a")]), size).collect())) == {}


def test_order_of_blocks(spark):
    pairs = strips(6)
    ids = sorted({x for p in pairs for x in p})
    g = Graph(spark.createDataFrame([(i, "function", i) for i in ids], "id string, kind string, label string"), links(spark, pairs).selectExpr("src", "dst", "'calls' AS kind", "CAST(NULL AS INT) AS line"))
    p = projection(g)
    assert topology.topo_sort(p, most=0).orderBy("position").collect() == topology.topo_sort(p, by="layers").orderBy("position").collect()


def counted(spark, df):
    """df, and how many of its rows have been made so far."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(len(b))
            yield b

    return df.mapInPandas(run, df.schema), made


def test_order_makes_its_links_once(spark):
    """Before, they were made anew for the bound, for the blocks and for the links between groups."""
    e, made = counted(spark, links(spark, strips(6)))
    ids = {x for q in strips(6) for x in q}
    p = Projection(spark.createDataFrame([(i,) for i in sorted(ids)], "id string"), e, None)
    topology.topo_sort(p, most=0)
    assert made.value == len(set(strips(6)))


def test_cycles_make_their_edges_twice(spark):
    """Once for the links and once for their kinds; before, also for the nodes, the loops and each kind's component."""
    pairs = sorted(set(strips(6)))
    e, made = counted(spark, spark.createDataFrame([(a, b, "calls", None) for a, b in pairs], "src string, dst string, kind string, line int"))
    ids = sorted({x for q in pairs for x in q})
    got = topology.cycles(Graph(spark.createDataFrame([(i, "function", i) for i in ids], "id string, kind string, label string"), e)).collect()
    assert made.value <= 2 * len(pairs)
    assert {"u09::e09"} <= {m for r in got for m in r.members} and {r.edge_kind for r in got} == {"calls"}
    # Of several kinds the one that the profile names first is found inside each component.
    two = spark.createDataFrame([("a", "b", "calls", 1), ("b", "a", "calls", 1), ("b", "a", "imports", 1), ("c", "d", "calls", 1), ("d", "c", "calls", 1), ("a", "c", "imports", 1)], "src string, dst string, kind string, line int")
    g = Graph(spark.createDataFrame([(i, "function", i) for i in "abcd"], "id string, kind string, label string"), two)
    first = min(("calls", "imports"), key=g.profile.closure.index)
    assert {(r.component, r.edge_kind) for r in topology.cycles(g).collect()} == {("a", first), ("c", "calls")}


def test_few_ready_groups_go_to_blocks(spark, monkeypatch):
    """Before, three layers were peeled by joins over all links although one node of 400 was ready."""
    count, real = [0], topology.checkpointed
    monkeypatch.setattr(topology, "checkpointed", lambda df: (count.__setitem__(0, count[0] + 1), real(df))[1])
    e = links(spark, [(f"c{i:03}", f"c{i + 1:03}") for i in range(400)])
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    assert dict(map(tuple, topology.layers(nodes, e, 100).collect())) == {f"c{i:03}": 400 - i for i in range(401)}
    assert count[0] == 4


def test_walks_of_blocks(spark, monkeypatch):
    """Before, a walk beyond the bound wrote two tables for each of its steps."""
    pairs = sorted({*strips(8), *((f"v{i:03}", f"v{i + 1:03}") for i in range(60)), ("u11::e14", "v000")})
    e = links(spark, pairs)
    g = Graph(spark.createDataFrame([(i, "function", i) for i in sorted({x for q in pairs for x in q})], "id string, kind string, label string"), e.selectExpr("src", "dst", "'calls' AS kind", "CAST(NULL AS INT) AS line"))
    start, count, real, bounded, asked = "u00::e00", [0], blocks.checkpointed, closure.bounded_links, [0]
    want = {r.id: r.level for r in closure.descendants(g, start).collect()}
    way = sorted(map(tuple, closure.path(g, start, "v060").collect()))
    for m in (blocks, closure):
        monkeypatch.setattr(m, "checkpointed", lambda df, *by: (count.__setitem__(0, count[0] + 1), real(df, *by))[1])
    assert {r.id: r.level for r in blocks.reached(e, start, 30).collect()} == want | {start: 0}
    assert len(want) > 200 and count[0] < 60
    assert {r.id: r.level for r in blocks.reached(e, "nowhere", 30).collect()} == {"nowhere": 0}
    count[0] = 0
    monkeypatch.setattr(closure, "KERNEL_EDGES", 1)
    monkeypatch.setattr(closure, "bounded_links", lambda e: bounded(e) if asked[0] else asked.__setitem__(0, 1))
    assert sorted(map(tuple, closure.path(g, start, "v060").collect())) == way and len(way) == want["v060"]
    assert {r.id: r.level for r in closure.descendants(g, start).collect()} == want
    asked[0] = 0
    assert closure.path(g, "v060", start) is None
    assert count[0] < 20


def _unlike(pairs):
    ids = sorted({x for p in pairs for x in p})
    return ids, [(a, b, 1) for a, b in sorted({(min(p), max(p)) for p in pairs if p[0] != p[1]})]


@pytest.mark.parametrize("order", ["near", "far"])
def test_communities_of_blocks(spark, order):
    """Cliques in a ring, whose ids lie in one block or are strewn over all: before, more pairs than the bound were refused."""
    name = (lambda c, i: f"k{c:02}::{i}") if order == "near" else (lambda c, i: f"m{i}::{c:02}")
    pairs = [(name(c, i), name(c, j)) for c in range(12) for i in range(5) for j in range(i)] + [(name(c, 0), name((c + 1) % 12, 1)) for c in range(12)]
    ids, rows = _unlike(pairs)
    nodes = spark.createDataFrame([(i,) for i in [*ids, "z"]], "id string")
    p = Projection(nodes, links(spark, pairs), spark.createDataFrame(rows, "a string, b string, weight long"))
    whole = communities.communities(p).cache()
    for most in (30, 0):
        got = communities.communities(p, most, 40).cache()
        assert got.count() == 61 and got.select("community").distinct().count() == got.agg(F.max("community")).first()[0] + 1
        q, best = (communities.modularity(p, x).first()["q"] for x in (got, whole))
        assert q > best - 0.1
        # Each community is held together by its own links.
        of = dict(map(tuple, got.collect()))
        label = communities._parts(len(ids), [(ids.index(a), ids.index(b), w) for a, b, w in rows], [of[i] for i in ids])
        assert len(set(label)) == len({of[i] for i in ids})
