"""Operators beyond the links that fit in memory, against the same in memory and against plain versions."""

import random
from collections import defaultdict

import pytest
from graphloom.graph import Graph
from graphloom.operators import centrality, closure, diff, topology, waves
from graphloom.operators.project import projection
from pyspark.sql import functions as F


def some_links(seed, n=40, m=90):
    r = random.Random(seed)
    pairs = {(f"n{r.randrange(n):03}", f"n{r.randrange(n):03}") for _ in range(m)}
    hub = {("n000", f"n{i:03}") for i in range(1, n, 3)}
    chain = {(f"z{i}", f"z{i + 1}") for i in range(4)}
    return sorted(pairs | hub | chain | {("loop", "loop")})


def graph(spark, pairs, lone=("alone",)):
    ids = sorted({x for p in pairs for x in p} | set(lone))
    nodes = spark.createDataFrame([(i, "function", i) for i in ids], "id string, kind string, label string")
    return Graph(nodes, spark.createDataFrame([(a, b, "calls", None) for a, b in pairs], "src string, dst string, kind string, line int"))


def walk(pairs, start):
    to, level, todo = defaultdict(list), {start: 0}, [start]
    for a, b in pairs:
        to[a].append(b)
    for x in todo:
        for y in to[x]:
            if y not in level:
                level[y] = level[x] + 1
                todo.append(y)
    return level


def test_levels_are_those_of_plain_walks(spark):
    pairs = some_links(1)
    g = graph(spark, pairs)
    got = {(r.seed, r.level): r.n for r in waves.levels(g.links("closure"), g.nodes.select(F.col("id").alias("seed"))).collect()}
    want = defaultdict(int)
    for s in {r.id for r in g.nodes.collect()}:
        for x, n in walk(pairs, s).items():
            if n:
                want[s, n] += 1
    assert got == want


def test_shallow_seeds_are_counted_and_others_walk(spark, monkeypatch):
    """Before, every seed had its bit, also the many that lead only to what leads nowhere."""
    made, real = [], waves.numbered
    monkeypatch.setattr(waves, "numbered", lambda df, *a: (made.append(df.count()), real(df, *a))[1])
    pairs = [("p", f"o{i}") for i in range(3)] + [("q", f"o{i}") for i in range(2)] + [("top", "p"), ("top", "q"), ("top", "o0"), ("top", "top"), ("o0", "o0"), ("x", "y"), ("y", "x")]
    g = graph(spark, pairs)
    got = {(r.seed, r.level): r.n for r in waves.levels(g.links("closure"), g.nodes.select(F.col("id").alias("seed"))).collect()}
    assert got == {("p", 1): 3, ("q", 1): 2, ("top", 1): 3, ("top", 2): 2, ("x", 1): 1, ("y", 1): 1}
    assert made == [3]
    assert dict(map(tuple, closure.blast_sizes(g, most=0).collect())) == {"o0": 3, "o1": 3, "o2": 2, "p": 1, "q": 1, "x": 1, "y": 1}


def test_closeness_beyond_one_block(spark, monkeypatch):
    """Numbers go to the tasks, in no rounds; where they are too many the joins give the same."""
    p = projection(graph(spark, some_links(7)))
    count, real = [0], waves.checkpointed
    with monkeypatch.context() as m:
        m.setattr(waves, "checkpointed", lambda df: (count.__setitem__(0, count[0] + 1), real(df))[1])
        one = {r.id: r.value for r in centrality.closeness(p, most=0).collect()}
    assert count[0] == 2
    monkeypatch.setattr(waves, "TASK_CELLS", 0)
    other = {r.id: r.value for r in centrality.closeness(p, most=0).collect()}
    assert one.keys() == other.keys() and all(abs(one[k] - other[k]) < 1e-12 for k in one) and max(one.values()) > 0


def test_closures_of_few_bytes_are_dealt(spark):
    """Before, the starts of a closure went to as many tasks as their bytes seemed to need, often one."""
    g = graph(spark, some_links(8))
    got = closure.closure(g.links("closure"), g.nodes.select(F.col("id").alias("seed")))
    assert got.rdd.getNumPartitions() > 1
    want = {(s, x, n) for s in {r.id for r in g.nodes.collect()} for x, n in walk(some_links(8), s).items() if n}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_sizes_beyond_the_bound(spark):
    g = graph(spark, some_links(3))
    assert sorted(map(tuple, closure.blast_sizes(g, most=0).collect())) == sorted(map(tuple, closure.blast_sizes(g).collect()))
    none = spark.createDataFrame([], "seed string")
    assert waves.levels(g.links("closure"), none).count() == 0
    assert waves.levels(g.links("closure").limit(0), g.nodes.select(F.col("id").alias("seed"))).count() == 0


def test_centralities_beyond_the_bound(spark, monkeypatch):
    p = projection(graph(spark, some_links(4)))
    for f in (centrality.closeness, centrality.betweenness):
        other = {r.id: r.value for r in f(p, most=0).collect()}
        for wide in (0, 10**9):  # both ways of counting in memory
            monkeypatch.setattr(centrality, "WIDE", wide)
            one = {r.id: r.value for r in f(p).collect()}
            assert one.keys() == other.keys() and all(abs(one[k] - other[k]) < 1e-12 for k in one)
    assert max(one.values()) > 0


def test_batches_of_starts_add_up(spark):
    p = projection(graph(spark, some_links(5, 20, 40)))
    whole, parts = ({r.id: r.part for r in waves.path_shares(p.nodes, p.links, rows=n).collect()} for n in (10**6, 200))
    assert whole.keys() == parts.keys() and all(abs(whole[k] - parts[k]) < 1e-9 for k in whole)


def test_betweenness_in_waves_has_no_ceiling(spark, monkeypatch):
    """Before, more than 50,000 nodes gave one row of nulls."""
    from graphloom.plans import queries

    monkeypatch.setattr(queries.views, "followers", lambda spark, sf: graph(spark, [("a", "b"), ("b", "c")], ()))
    monkeypatch.setattr(centrality, "BETWEENNESS_NODES", 1)
    assert sorted(map(tuple, queries.rank_betweenness_waves(spark, "").collect())) == [("a", 0.0), ("b", 0.5), ("c", 0.0)]


def test_block_of_shares_takes_no_rounds(spark, monkeypatch):
    """The rounds before wrote a table for each level, there and back; what a block gives equals them."""
    count, real = [0], waves.checkpointed
    monkeypatch.setattr(waves, "checkpointed", lambda df: (count.__setitem__(0, count[0] + 1), real(df))[1])
    pairs = [(f"n{i:02}", f"n{i + 1:02}") for i in range(7)] + [("n01", "x"), ("x", "n03"), ("n04", "n04")]
    links = spark.createDataFrame(pairs, "src string, dst string")
    nodes = spark.createDataFrame([(f"n{i:02}",) for i in range(8)], "id string")  # x is walked through, but not from
    one = {r.id: r.part for r in waves.path_shares(nodes, links).collect()}
    assert count[0] < 6
    other = {r.id: r.part for r in waves.path_shares(nodes, links, size=0).collect()}
    assert one.keys() == other.keys() and all(abs(one[k] - other[k]) < 1e-9 for k in one) and one["x"] == one["n02"] == 5.0


def test_order_by_layers(spark):
    pairs = some_links(6)
    p = projection(graph(spark, pairs))
    ready, layers = (topology.topo_sort(p, by=by).orderBy("position").collect() for by in ("ready", "layers"))
    for order in (ready, layers):
        at = {x: r.position for r in order for x in r.members}
        assert [r.position for r in order] == list(range(len(order))) and len(at) == p.nodes.count()
        assert all(at[b] <= at[a] for a, b in pairs)  # what is depended on is first, or in the same group
        assert all(r.cyclic == (len(r.members) > 1) for r in order)
    assert {tuple(r.members) for r in ready} == {tuple(r.members) for r in layers}
    beyond = topology.topo_sort(p, most=0).orderBy("position").collect()
    assert beyond == layers
    with pytest.raises(ValueError):
        topology.topo_sort(p, by="chance")


def test_ready_order_is_one_order_at_any_size(spark, monkeypatch):
    """Before, groups came by layers where they were more than the bound."""
    for pairs in (some_links(6), [(f"n{i:03}", f"n{i * 7 % 40:03}") for i in range(40) if i > i * 7 % 40] + [("a", "n000"), ("n002", "z")], []):
        p = projection(graph(spark, pairs))
        want = topology.topo_sort(p).orderBy("position").collect()
        with monkeypatch.context() as m:
            m.setattr(topology, "KERNEL_EDGES", 0)
            assert topology.topo_sort(p).orderBy("position").collect() == want
    layered = [tuple(r.members) for r in topology.topo_sort(projection(graph(spark, [("a", "z"), ("b", "a"), ("c", "y")])), by="layers").orderBy("position").collect()]
    assert layered != [tuple(r.members) for r in topology.topo_sort(projection(graph(spark, [("a", "z"), ("b", "a"), ("c", "y")]))).orderBy("position").collect()]


def test_layers_are_longest_ways(spark):
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("d", "c"), ("e", "a"), ("e", "d")]
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "id string")
    got = dict(map(tuple, topology.layers(nodes, spark.createDataFrame(pairs, "src string, dst string")).collect()))
    assert got == {"c": 0, "f": 0, "b": 1, "d": 1, "a": 2, "e": 3}


def test_diagnosis_of_any_node(spark):
    pairs = [(f"c{i:02}", f"x{j:02}") for j in range(40) for i in range(j, 41)]
    g = graph(spark, pairs)
    from graphloom import api

    row = api.query(g, "diagnose_hotspot", node="x30").first()
    assert (row["rank"], row["value"], row["blast"], row["neighbors"]) == (31, 11.0, 11, 11)
    row = api.query(g, "diagnose_hotspot", node="alone").first()
    assert (row["rank"], row["value"], row["blast"]) == (None, None, 0)
    assert diff.diagnose(g, None, "x30").first()["rank"] is None


def test_clustered_bands(spark):
    from graphloom.operators import layout

    inside = [("p", "m1"), ("p", "m2"), ("p", "x"), ("m1", "c"), ("m1", "a"), ("m1", "b"), ("c", "d"), ("m2", "e"), ("q", "f"), ("k", "l"), ("l", "k")]
    nodes = sorted({x for p in inside for x in p} | {"z"})
    g = Graph(spark.createDataFrame([(x, "module", x) for x in nodes], "id string, kind string, label string"), spark.createDataFrame([(a, b, "contains", None) for a, b in inside], "src string, dst string, kind string, line int"))
    got = {r.id: (r.depth, r.x, r.y) for r in layout.clustered(g).collect()}
    # p: its leaf x below it, then m1 (a stack and the band of c: 2 wide), then m2; q after p's band of 4, z after q.
    assert got == {"p": (0, 0, 0), "x": (1, 0, 1), "m1": (1, 1, 1), "a": (2, 1, 2), "b": (2, 1, 3), "c": (2, 2, 2), "d": (3, 2, 3), "m2": (1, 3, 1), "e": (2, 3, 2), "q": (0, 4, 0), "f": (1, 4, 1), "z": (0, 5, 0), "k": (None, 0, 4), "l": (None, 1, 4)}


def test_views_leave_the_users_names_alone(spark):
    from graphloom import views

    spark.range(3).createOrReplaceTempView("nodes")
    before = {t.name for t in spark.catalog.listTables()}
    views.followers(spark, "/root/testdata/sf0.001")
    assert {t.name for t in spark.catalog.listTables()} == before and spark.table("nodes").count() == 3
    spark.catalog.dropTempView("nodes")


def test_superseded_rounds_leave_no_tables(spark):
    from graphloom import graph

    n = 12
    links = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(n)], "src string, dst string")
    nodes = spark.createDataFrame([(f"n{i:02}",) for i in range(n + 1)], "id string")
    before = len(graph._MADE)
    got = {r["id"]: r["layer"] for r in topology.layers(nodes, links).collect()}
    assert got == {f"n{i:02}": n - i for i in range(n + 1)}
    # Twelve rounds; only the last table is still read.
    assert len(graph._MADE) - before == 1
    found = closure.closure(links, nodes.limit(1).select(F.lit("n00").alias("seed")), most=0)
    assert {(r["id"], r["level"]) for r in found.collect()} == {(f"n{i:02}", i) for i in range(1, n + 1)}
    assert len(graph._MADE) - before == 2
