"""Known answers on small graphs."""

import pytest
from graphloom import api, build, profile
from graphloom.graph import Graph
from graphloom.operators import centrality, closure, communities, coupling, diff, history, layout, measures, topology
from graphloom.operators.project import projection
from pyspark.sql import functions as F

NODE = "id string, kind string, label string, decisions int, refs array<string>, measures map<string,string>"
EDGE = "src string, dst string, kind string, line int, attrs map<string,string>"


def graph(spark, edges, nodes=None):
    pairs = [tuple(e.split(">")) for e in edges.split()]
    names = sorted({x for p in pairs for x in p} | set((nodes or "").split()))
    return Graph(
        spark.createDataFrame([(n, "function", n, None, None, None) for n in names], NODE),
        spark.createDataFrame([(a, b, "calls", 1, None) for a, b in pairs], EDGE),
    )


COMPASS = "a>b a>c b>d c>d d>e e>f f>g b>h"
RING = "w>x x>y y>z z>w x>z"


def values(df):
    return {r["id"]: r["value"] for r in df.collect()}


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_pagerank_and_katz(spark, most):
    p = projection(graph(spark, COMPASS))
    want = dict(a=0.050366533824645295, b=0.0717724799737871, d=0.14187699226038397, e=0.17096200118402893, f=0.1956833061815353, g=0.21669618663194073, h=0.08087001996989152)
    got = values(centrality.pagerank(p, most))
    assert all(got[k] == pytest.approx(v, abs=1e-6) for k, v in want.items()) and sum(got.values()) == pytest.approx(1)
    want = dict(a=0.3182844374972241, b=0.35011288124694656, d=0.3883070137466134, e=0.35711513887188545, g=0.35368403263566545)
    got = values(centrality.katz(p, most))
    assert all(got[k] == pytest.approx(v, abs=1e-6) for k, v in want.items())


def test_eigenvector(spark):
    got = values(centrality.eigenvector(projection(graph(spark, RING))))
    want = dict(w=0.5262015076917937, x=0.43104970112724544, y=0.3531051686825981, z=0.6423588314257299)
    assert all(got[k] == pytest.approx(v, abs=1e-5) for k, v in want.items())
    assert centrality.eigenvector(projection(graph(spark, COMPASS))) is None


def test_path_centralities(spark):
    p = projection(graph(spark, COMPASS))
    got = values(centrality.betweenness(p))
    assert {k: round(v * 42, 9) for k, v in got.items()} == dict(a=0, b=3, c=2, d=9, e=8, f=5, g=0, h=0)
    got = values(centrality.closeness(p))
    assert got["a"] == 0 and got["b"] == pytest.approx(1 / 7) and got["e"] == pytest.approx(0.2857142857) and got["g"] == pytest.approx(0.2706766917)
    got = values(centrality.closeness(projection(graph(spark, RING))))
    assert got == pytest.approx(dict(w=0.6, x=0.5, y=0.5, z=0.75))


VILLAGES = " ".join(f"{s}{i}>{s}{j}" for s in "ab" for i in range(1, 6) for j in range(i + 1, 6)) + " a1>b1"


def test_communities(spark):
    p = projection(graph(spark, VILLAGES, "z9"))
    labels = communities.communities(p).cache()
    assert {r["id"]: r["community"] for r in labels.collect()} == {**{f"a{i}": 0 for i in range(1, 6)}, **{f"b{i}": 1 for i in range(1, 6)}, "z9": 2}
    assert communities.modularity(p, labels).first()["q"] == pytest.approx(2 * (10 / 21 - 1 / 4))
    assert sorted(tuple(r) for r in communities.summaries(p, labels).collect()) == [(0, 5, 10, 1), (1, 5, 10, 1), (2, 1, 0, 0)]


def test_leiden_merges_levels():
    ring = [(6 * c + i, 6 * c + j, 1.0) for c in range(8) for i in range(6) for j in range(i)] + [(6 * c, 6 * ((c + 1) % 8) + 1, 1.0) for c in range(8)]
    label = communities.leiden(48, ring)
    assert all(len({label[6 * c + i] for i in range(6)}) == 1 for c in range(8)) and len(set(label)) in (4, 8)


TRAP = "app>mid mid>lib mid>x x>y y>z z>x z>lib"


def test_topological_order(spark):
    p = projection(graph(spark, TRAP))
    got = [(r["members"], r["cyclic"]) for r in topology.topo_sort(p).orderBy("position").collect()]
    assert got == [(["lib"], False), (["x", "y", "z"], True), (["mid"], False), (["app"], False)]
    ring = topology.cycles(graph(spark, TRAP)).collect()
    assert [(r["members"], r["edge_kind"]) for r in ring] == [(["x", "y", "z"], "calls")]


@pytest.mark.parametrize("edges", [TRAP, RING, COMPASS, "a>b b>a b>c c>d d>c d>e e>e", "a>a"])
def test_components_without_the_kernel(spark, edges):
    g = graph(spark, edges)
    key = lambda most: sorted(tuple(r) for r in topology.components(g.nodes.select("id"), g.links("closure"), most).collect())
    assert key(0) == key(1000)


@pytest.mark.parametrize("most", [1000, 0])
def test_closures(spark, most):
    g = graph(spark, TRAP)
    seeds = g.nodes.select(F.col("id").alias("seed"))
    got = {}
    for r in closure.closure(g.links("closure"), seeds, most).collect():
        got.setdefault(r["seed"], {})[r["id"]] = r["level"]
    assert got["app"] == dict(mid=1, lib=2, x=2, y=3, z=4) and got["x"] == dict(y=1, z=2, lib=3) and "lib" not in got
    assert [r["id"] for r in closure.blast_radius(g, "lib").orderBy("level", "id").collect()] == ["mid", "z", "app", "y", "x"]
    assert closure.descendants(g, "nobody").count() == 0


def test_path(spark):
    g = graph(spark, COMPASS)
    assert [(r["src"], r["dst"]) for r in closure.path(g, "a", "e").orderBy("step").collect()] == [("a", "b"), ("b", "d"), ("d", "e")]
    assert closure.path(g, "e", "a") is None and closure.path(g, "a", "nobody") is None and closure.path(g, "a", "a").count() == 0


def types(spark):
    n = lambda id, kind, d=None, refs=None: (id, kind, id.rsplit("::", 1)[-1], d, refs, None)
    nodes = [n(p, "package") for p in ("alpha", "beta", "gamma")]
    nodes += [n("alpha::a::Engine", "class"), n("alpha::a::Car", "class"), n("beta::b::Wheel", "class"), n("gamma::g::Solo", "class")]
    nodes += [n("alpha::a::Engine::start", "method", 2), n("alpha::a::Engine::stop", "method", 0), n("alpha::a::Car::drive", "method", 1, ["LIMIT"]), n("alpha::a::Car::park", "method", 3)]
    nodes += [n("beta::b::Wheel::spin", "method", 0), n("gamma::g::Solo::idle", "method", 1), n("alpha::a::boot", "function", 0), n("alpha::a::ODOMETER", "variable"), n("beta::b::LIMIT", "variable"), n("external::std::fmt", "external")]
    car, eng = "alpha::a::Car::", "alpha::a::Engine::"
    edges = [(car + "drive", eng + "start", "calls"), (car + "drive", "beta::b::Wheel::spin", "calls"), (car + "park", eng + "stop", "calls"), (eng + "start", "alpha::a::boot", "calls"), ("alpha::a::boot", "beta::b::Wheel::spin", "calls"), ("alpha::a::boot", "external::std::fmt", "calls")]
    edges += [(car + "drive", "beta::b::LIMIT", "reads"), (eng + "start", "beta::b::LIMIT", "writes"), (car + "drive", "alpha::a::ODOMETER", "writes"), (car + "park", "alpha::a::ODOMETER", "writes")]
    return Graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame([(*e, None, None) for e in edges], EDGE))


def test_coupling(spark):
    g = types(spark)
    got = {r["id"].rsplit("::")[-1]: tuple(r)[1:] for r in coupling.type_metrics(g).collect()}
    assert got["Car"] == (2, 2, 5, 5, 6) and got["Engine"] == (2, 1, 2, 1, 4) and got["Wheel"] == (1, 1, 1, 0, 1)
    assert got["Solo"][0] == 1 and got["Solo"][1] == 0 and got["Solo"][4] == 2
    got = {r["id"].rsplit("::")[-1]: tuple(r)[1:] for r in coupling.cohesion(g).collect()}
    assert got == {"Car": (1, 0, 1.0), "Engine": (0, 1, 0.0), "Wheel": (None, None, None), "Solo": (None, None, None)}
    got = {r["id"]: tuple(r)[1:] for r in coupling.package_metrics(g).collect()}
    assert got == {"alpha": (0, 4, 1, 1.0), "beta": (4, 0, 0, 0.0), "gamma": (0, 0, 0, None)}


def test_history(spark):
    functions = spark.createDataFrame([("a", "f1", 2), ("b", "f1", 1), ("c", "f2", 3), ("d", "f3", None)], "id string, file string, decisions int")
    tx = spark.createDataFrame([(i, f) for i, fs in enumerate(["f1 f2", "f1 f2 gone", "f1", "f2 f3", "f1 f2", "gone"]) for f in fs.split()], "tx_id long, file string")
    assert history.transaction_count(tx, functions).first()[0] == 5
    assert {tuple(r) for r in history.hotspots(tx, functions).collect()} == {("f1", 4, 5, 20), ("f2", 4, 4, 16), ("f3", 1, None, None)}
    assert [tuple(r) for r in history.change_coupling(tx, functions, 2).collect()] == [("f1", "f2", 3, 5, 0.6)]


def test_counting(spark):
    g = types(spark)
    assert {(r["relation"], r["kind"]): r["n"] for r in measures.stats(g).collect()}[("edges", "*")] == 10
    assert values(measures.fan_in(g))["beta::b::Wheel::spin"] == 2 and "external::std::fmt" not in values(measures.fan_in(g))
    assert values(measures.complexity(g))["alpha::a::Engine::stop"] == 1
    hits = measures.search(g, " S ").collect()
    assert [r["match"] for r in hits] == sorted(r["match"] for r in hits) and hits[0]["label"] in ("Solo", "spin", "start", "stop")
    assert measures.search(g, "  ").count() == 0
    with pytest.raises(ValueError):
        measures.top(measures.fan_in(g), 0)
    d = {(r["direction"], r["kind"]): r["n"] for r in measures.dossier(g, "alpha::a::Car::drive").collect()}
    assert d == {("outgoing", "calls"): 2, ("outgoing", "reads"): 1, ("outgoing", "writes"): 1}
    assert {r["id"] for r in measures.neighborhood(g, "alpha::a::boot").collect()} == {"alpha::a::boot", "alpha::a::Engine::start", "beta::b::Wheel::spin", "external::std::fmt"}
    assert values(measures.unresolved(g)) == {"alpha::a::boot": 1}


def test_diff(spark):
    a, b = graph(spark, "a>b b>c"), graph(spark, "a>b c>b d>c")
    b = Graph(b.nodes.withColumn("label", F.when(F.col("id") == "a", "A").otherwise(F.col("label"))), b.edges)
    assert {tuple(r) for r in diff.diff_nodes(a, b).collect()} == {("a", "changed"), ("d", "added")}
    assert {(r["src"], r["dst"], r["change"]) for r in diff.diff_edges(a, b).collect()} == {("b", "c", "removed"), ("c", "b", "added"), ("d", "c", "added")}
    got = {r["id"]: (r["before"], r["after"], r["delta"]) for r in diff.impact(a, b).collect()}
    assert got == {"a": (0, 0, 0), "b": (1, 3, 2), "c": (2, 1, -1), "d": (0, 0, 0)}
    assert diff.report(diff.impact(a, b)).splitlines()[2] == "| b | 1 | 3 | +2 |"


def test_layouts(spark):
    p = projection(graph(spark, TRAP))
    got = {r["id"]: (r["x"], r["y"]) for r in layout.layered(p.nodes, p.links).collect()}
    assert got == {"lib": (0, 0), "x": (0, 1), "y": (1, 1), "z": (2, 1), "mid": (0, 2), "app": (0, 3)}
    first, again = (sorted(tuple(r) for r in layout.force(p).collect()) for _ in range(2))
    assert first == again and len(first) == 6
    assert layout.svg(layout.force(p), p.links).count("<line") == 7


def test_profiles():
    assert profile.CODE.dependency == set(profile.CODE.edge_kinds) - {"contains"}
    with pytest.raises(ValueError, match="unknown edge kinds"):
        profile.load('{"format": "graphloom.profile/1", "id": "x", "node_kinds": ["external"], "edge_kinds": ["a"], "dependency": ["b"]}')
    with pytest.raises(ValueError, match="format"):
        profile.load("{}")
    with pytest.raises(KeyError):
        profile.embedded("nope")


def test_questions(spark):
    g = graph(spark, COMPASS)
    assert api.route("What breaks if d?") == ("blast_radius", {"node": "d"}) and api.route("path from a to e") == ("path", {"a": "a", "b": "e"})
    assert api.ask(g, "what depends on d")["total"] == 3
    got = api.query(g, "descendants", node="a", limit=2)
    assert (got["total"], got["truncated"], got["rows"].count()) == (7, True, 2)
    assert api.query(g, "history")["measured"] is False and api.query(g, "rank", by="eigenvector")["measured"] is False
    with pytest.raises(PermissionError):
        api.route("rename d")
    with pytest.raises(ValueError):
        api.query(g, "nope")
    with pytest.raises(ValueError):
        api.query(g, "descendants", node="a", colour=1)


def test_graph_reads_its_calls_once(spark):
    """Before, they were made anew for the names, the callers, the edges and the diagnostics, with the places of all."""
    from graphloom import schema

    files = spark.createDataFrame([("p", "a.py", "p::a", 0), ("q", "b.py", "q::b", 1)], "package string, file string, module_id string, file_seq long")
    rows = [(0, 1, "p", "a.py", "p::a", "p::a::f", "function", "f", 1, 1), (0, 2, "p", "a.py", "p::a", "p::a::g", "function", "g", 2, 1), (1, 1, "q", "b.py", "q::b", "q::b::f", "function", "f", 1, 1)]
    symbols = spark.createDataFrame([dict(zip("file_seq sym_seq package file module_id id kind label line column".split(), r)) for r in rows], schema.SYMBOLS)
    data = [(0, 1, "p::a::g", "f", 5), (0, 2, "p::a::g", "f", 4), (0, 3, "p::a::g", "crate::a::f", 3), (1, 1, "q::b::f", "g", 2), (1, 2, "q::b::f", "crate::a::f", 2), (1, 3, "q::b::f", "gone", 9), (0, 4, "p::a::f", "gone", 8), (1, 4, "ghost", "gone", 7), (0, 5, "p", "f", 6)]
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(len(b))
            yield b

    calls = spark.createDataFrame([dict(zip("file_seq seq from_id to_name line".split(), r)) for r in data], schema.CALLS)
    raw = build.Raw(files, symbols, spark.createDataFrame([], schema.IMPORTS), calls.mapInPandas(run, calls.schema), spark.createDataFrame([], schema.HERITAGE))
    g, diagnostics = build.graph_of(raw)
    got = {(r.src, r.dst, r.line) for r in g.edges.where("kind = 'calls'").collect()}
    assert made.value == len(data)
    assert got == {("p::a::g", "p::a::f", 3), ("q::b::f", "p::a::g", 2), ("q::b::f", "q::b::f", 2), ("q::b::f", "external::gone", 9), ("p::a::f", "external::gone", 8), ("p", "p::a::f", 6)}
    said = [(r.kind, r.payload) for r in diagnostics().orderBy("seq").collect()]
    assert [k for k, _ in said] == ["UnknownSymbol", "UnresolvedCall", "Cycle"] and '"p::a::f"' in said[1][1] and "ghost" in said[0][1]
