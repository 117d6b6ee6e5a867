"""Commands on stored graphs, single additions, the whole difference."""

import json

import pytest
from graphloom import api, build, schema, store
from graphloom.graph import Graph
from graphloom.operators import diff
from graphloom.profile import CODE, RA
from pyspark.sql import functions as F

FILES = {"Cargo.toml": '[package]\nname = "top"\n', "src/a.rs": "use crate::b::go;\npub fn run() { go(); missing(); }\n", "src/b.rs": "pub fn go() { helper() }\nfn helper() {}\n", "web/m.mts": "export function f() {}\n"}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    for p, t in FILES.items():
        (top / "src").mkdir(exist_ok=True)
        (top / "web").mkdir(exist_ok=True)
        (top / p).write_text(t)
    path = str(tmp_path_factory.mktemp("db"))
    return path, api.command(spark, "index", root=str(top), path=path, name="none")


def test_index_reports_and_stores(spark, stored):
    path, report = stored
    assert report["generation"] == 1 and report["files"] == 3 and report["symbols"] == 4 and report["diagnostics"] == {"UnresolvedCall": 1}
    g = store.Store(spark, path).load_graph()
    e = {(r["src"], r["dst"], r["kind"]) for r in g.edges.collect()}
    assert ("top::a::run", "top::b::go", "calls") in e and ("top::a", "top::b", "imports") in e and ("top::a::run", "external::missing", "calls") in e
    assert g.nodes.where("id = 'top::web::m::f'").count() == 1
    got = api.command(spark, "verify", path=path)
    assert got["valid"] and got["entries"] == 2 and got["format"] == store.VERSION
    assert [r["kind"] for r in api.command(spark, "diagnostics", path=path).collect()] == ["UnresolvedCall"]
    with pytest.raises(ValueError, match="unknown command"):
        api.command(spark, "nothing")
    with pytest.raises(ValueError, match="stats"):
        api.query(g, "stats", odd=1)


def test_snapshot_in_a_file_and_the_gate(spark, stored, tmp_path):
    g = store.Store(spark, stored[0]).load_graph()
    log = store.audit_append([], "index", "{}", "7")
    text = api.query(g, "snapshot", audit=log)
    path = str(tmp_path / "snap.json")
    store.write_snapshot(g, path, log)
    assert open(path).read() == text
    back, trail = store.read_snapshot(spark, path)
    assert trail == log and store.snapshot(back, trail) == text
    cert = store.certify(text, log[-1][5], b"key", now=100)
    assert api.command(spark, "restore", text=text, cert=cert, key=b"key", now=200)[1] == log
    assert api.command(spark, "verify_proof", text=text, cert=cert, key=b"other", now=200) == {"wrong": ["signature"]}
    for bad in (cert | {"digest": "0"}, cert | {"version": 3}, store.certify(text, "another head", b"key", now=100)):
        with pytest.raises(PermissionError, match="certificate"):
            api.command(spark, "restore", text=text, cert=bad, key=b"key", now=200)
    with pytest.raises(ValueError, match="newer"):
        store.check_version("3.1")


def test_older_formats_and_first_rows(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "old"))
    assert s.load_audit()[0][2] == "genesis"
    nodes = spark.createDataFrame([("a", "module", "a")], "id string, kind string, label string")
    edges = spark.createDataFrame([], "src string, dst string, kind string, line int, attrs map<string,string>")
    s.replace_graph(Graph(nodes, edges))
    assert s.load_graph().nodes.columns == schema.NODES.names
    new = spark.createDataFrame([("b", "module", "first"), ("b", "module", "second"), ("a", "module", "other")], "id string, kind string, label string").coalesce(1)
    assert s.insert_graph(Graph(new, edges)) == (1, 0)
    assert {(r["id"], r["label"]) for r in s.load_graph().nodes.collect()} == {("a", "a"), ("b", "first")}


def test_single_additions(spark):
    nodes = spark.createDataFrame([("m::x", "line_item", "x"), ("m::y", "line_item", "y")], "id string, kind string, label string")
    nodes = store.migrated(nodes, schema.NODES)
    g = Graph(nodes, spark.createDataFrame([], schema.EDGES), RA)
    g = build.add_node(build.add_node(g, "m::z", "output", refs=["a"]), "m::x", "output")
    assert {(r["id"], r["kind"]) for r in g.nodes.collect()} == {("m::x", "line_item"), ("m::y", "line_item"), ("m::z", "output")}
    g, wrong = build.add_typed_edge(g, "m::x", "m::z", "computes_into", 3)
    assert g.edges.count() == 1 and wrong.count() == 0
    g, wrong = build.add_typed_edge(g, "m::x", "m::z", "computes_into", 4)
    assert g.edges.first()["line"] == 3
    g, wrong = build.add_typed_edge(g, "m::x", "gone", "estimates", attrs={"method": "m"})
    assert g.edges.count() == 1 and sorted(r["kind"] for r in wrong.collect()) == ["MissingProvenance", "UnknownSymbol"]
    with pytest.raises(ValueError, match="kind"):
        build.add_node(g, "q", "class")


def test_the_whole_difference(spark):
    a = [("a", "function", "a"), ("b", "function", "b"), ("c", "function", "c")]
    b = [("a", "function", "A"), ("b", "function", "b"), ("d", "function", "d")]
    e = lambda rows: spark.createDataFrame([(x, y, "calls", 1, None) for x, y in rows], schema.EDGES)
    n = lambda rows: store.migrated(spark.createDataFrame(rows, "id string, kind string, label string"), schema.NODES)
    before, after = Graph(n(a), e([("a", "b"), ("b", "c")]), CODE), Graph(n(b), e([("a", "b"), ("b", "d"), ("a", "d")]), CODE)
    got = api.query(before, "diff", other=after)
    ids = lambda k: [r["id"] for r in got[k].collect()]
    assert ids("nodes_added") == ["d"] and ids("nodes_removed") == ["c"] and ids("nodes_changed") == ["a"]
    assert got["nodes_changed"].first()["after"]["label"] == "A"
    assert [(r["src"], r["dst"]) for r in got["edges_added"].collect()] == [("a", "d"), ("b", "d")]
    assert [(r["id"], r["delta"]) for r in got["impact"].collect()][:2] == [("c", -2), ("d", 2)]
    assert diff.fails_above(got["impact"], 1) and not diff.fails_above(got["impact"], 2)
    assert json.loads(json.dumps(diff.report(got["impact"], 1))).count("| c |") == 1
    assert got["impact"].where(F.col("delta") == 0).count() >= 1
