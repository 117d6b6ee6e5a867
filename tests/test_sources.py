"""Building, reading and storing."""

import io
import json
import zipfile

import pytest
from graphloom import build, schema, store
from graphloom.functions import sheet
from graphloom.graph import Graph
from graphloom.profile import CODE, ENGLISH, RA
from graphloom.sources import english, repo, series, xlsx
from graphloom.streaming import metering
from pyspark.sql import functions as F

A = '''"""doc"""
import os
from . import b
from .b import helper as h
LIMIT: int = 3

class Base(object):
    def run(self, n=0):
        if n and LIMIT or n > 2:
            return [x for x in range(n) if x]
        return self.step(n)

class Child(Base):
    @staticmethod
    def step(n):
        total = 0
        for i in range(n):
            total += h(i)
        return b.helper(total) + missing_fn()
'''
B = "def helper(x):\n    return x if x else back()\n\ndef back():\n    return helper(1)\n"


def tree(spark, files):
    rows = [("pkg", p, t, p) for p, t in files.items()]
    return repo.extract(spark.createDataFrame(rows, "package string, file string, text string, path string"))


def test_build_from_python(spark):
    g, d = build.build(tree(spark, {"a.py": A, "b.py": B, "notes.md": "# hi", "sub/__init__.py": "", "bad.py": "def ("}))
    kinds = {r["id"]: r["kind"] for r in g.nodes.collect()}
    assert kinds["pkg"] == "package" and kinds["pkg::a"] == "module" and kinds["pkg::/a.py"] == "file" and kinds["pkg::sub"] == "module"
    assert kinds["pkg::a::Base"] == "class" and kinds["pkg::a::Child::step"] == "method" and kinds["pkg::a::LIMIT"] == "variable" and kinds["pkg::notes::notes"] == "doc"
    e = {(r["src"], r["dst"], r["kind"]) for r in g.edges.collect()}
    assert ("pkg::a", "pkg::b", "imports") in e and ("pkg::a", "external::os", "imports") in e
    assert ("pkg::a::Child", "pkg::a::Base", "inherits") in e
    assert ("pkg::a::Child::step", "pkg::b::helper", "calls") in e and ("pkg::a::Base::run", "pkg::a::LIMIT", "reads") in e
    assert ("pkg::a::Child::step", "external::missing_fn", "calls") in e
    n = {r["id"]: r for r in g.nodes.collect()}
    assert n["pkg::a::Base::run"]["decisions"] == 5 and n["pkg::a::Base::run"]["signature"] == "def run(self, n=0)"
    assert n["pkg::a::Child::step"]["refs"].count("staticmethod") == 1 and n["pkg::a"]["tier"] == "core"
    got = [(r["kind"], json.loads(r["payload"])) for r in d.orderBy("seq").collect()]
    assert [k for k, _ in got][-1] == "Cycle" and got[-1][1]["members"] == ["pkg::b::back", "pkg::b::helper"]
    assert "missing_fn" in {p["target"] for k, p in got if k == "UnresolvedCall"}


def test_planted_diagnostics(spark):
    g, d = build.build(tree(spark, {"a.py": "def a():\n    b()\n\ndef b():\n    a()\n    missing_fn()\n", "a/__init__.py": "def a():\n    pass\n"}))
    got = [(r["kind"], r["seq"]) for r in d.orderBy("seq").collect()]
    assert got == [("MultiDefinition", 0), ("UnresolvedCall", 1), ("Cycle", 2)]
    assert g.nodes.where("id = 'external::missing_fn' and kind = 'external'").count() == 1


def test_import_shapes(spark):
    f = spark.createDataFrame([("my-app", "x/a.rs", "my-app::x::a", 0), ("my-app", "x/b.rs", "my-app::x::b", 1), ("@s/lib", "l.ts", "@s/lib::l", 2)], schema.FILES)
    s = spark.createDataFrame([(2, 0, "@s/lib", "l.ts", "@s/lib::l", "@s/lib::l::Thing", "class", "Thing", 1, 1, None, None, None, None, None, None, None)], schema.SYMBOLS)
    to = ["my-app::x::b", "my-app::x::b::Item", "external::b", "external::my_app::x::b", "external::my_app", "external::@s::lib", "external::serde", "std"]
    i = spark.createDataFrame([(0, n, "my-app::x::a", t, ["Thing"] if "lib" in t else [], 1) for n, t in enumerate(to)], schema.IMPORTS)
    raw = build.Raw(f, s, i, spark.createDataFrame([], schema.CALLS), spark.createDataFrame([], schema.HERITAGE))
    nodes, _ = build.scaffold(raw, s, CODE)
    got = [r["target"] for r in build.import_targets(raw, nodes, s, CODE).orderBy("seq").collect()]
    assert got[:5] == ["my-app::x::b", "my-app::x::b", "my-app::x::b", "my-app::x::b", "my-app"] and got[6:] == ["external::serde", "external::std"]


def test_gate(spark):
    e = spark.createDataFrame([("a", "b", "estimates", None, {"method": "m"}), ("a", "c", "estimates", None, {"method": "m", "window": "w", "error": "0", "odd": "x"}), ("a", "d", "contains", None, None)], schema.EDGES)
    kept, bad = build.gate(e, RA)
    assert {(r["dst"], tuple(sorted(r["attrs"] or {}))) for r in kept.collect()} == {("c", ("error", "method", "window")), ("d", ())}
    assert sorted(r["kind"] for r in bad.collect()) == ["InvalidAttribute", "MissingProvenance"]


def test_repo_scan(spark, tmp_path):
    for p, t in {"Cargo.toml": '[package]\nname = "top"\n', "src/m.py": "x = 1\n", "web/package.json": '{"name": "@s/web"}', "web/i.py": "y = 2\n", ".git/h.py": "", "node_modules/z.py": "", "pic.png": ""}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    got = repo.with_packages(repo.files(spark, str(tmp_path)), "fallback")
    assert {(r["package"], r["file"]) for r in got.collect()} == {("top", "src/m.py"), ("@s/web", "i.py")}
    assert repo.manifest_name("pyproject.toml", '[tool.x]\nname="no"\n[project]\nname = "yes"') == "yes"


def test_git_log(spark):
    lines = spark.createDataFrame(list(enumerate(["commit 1", "", "r/a.py", "r/b.py", "commit 2", "a.py"])), "line_no long, value string")
    dated = spark.createDataFrame(list(enumerate(["commit 1 2024-01-05", "a", "commit 2 2024-02-01", "b", "commit 3", "c"])), "line_no long, value string")
    assert [tuple(r) for r in repo.commits(spark, dated, since="2024-01-31").collect()] == [(2, "b")]
    tx = repo.commits(spark, lines)
    known = spark.createDataFrame([("a.py",), ("r/b.py",)], "file string")
    assert sorted(tuple(r) for r in repo.to_graph_files(tx, known).collect()) == [(1, "a.py"), (1, "r/b.py"), (2, "a.py")]


def cells(spark, rows):
    return spark.createDataFrame([("m", *ref.split("!"), 1, 1, v if isinstance(v, str) and v.startswith("=") else None, v if isinstance(v, float) else None, v if isinstance(v, str) and not v.startswith("=") else None, None, None) for ref, v in rows.items()], schema.CELLS)


BOOK = {"s!A1": 2.0, "s!A2": "=A1*3", "s!A3": "=-A1^2", "s!A4": "=SUM(A1:A3, 1)", "s!A5": "=1/0", "s!A6": "=A5+1", "s!A7": "=B9", "s!A8": "=A9", "s!A9": "=A8", "s!B1": "=IF(A1>1, \"yes\", A5)", "s!B2": "=FOO(1)", "s!B3": "=1+", "s!B4": "=ROUND(-2.5)", "s!B5": "=NPV(0.1, 110, 121)", "s!B6": "text", "s!B7": "=B6+1", "t!A1": "=s!$A$2 + 's'!A1", "s!B8": "=2^3^2", "s!C1": "=10%4"}


def test_evaluator(spark):
    got = {f"{r['sheet']}!{r['reference']}": r["error"] or (r["text"] if r["value"] is None else r["value"]) for r in sheet.evaluate(cells(spark, BOOK)).collect()}
    want = {"s!A2": 6.0, "s!A3": 4.0, "s!A4": 13.0, "s!A5": "DivByZero", "s!A6": "AbsentInput", "s!A7": "UnresolvedRef", "s!A8": "Cycle", "s!A9": "Cycle", "s!B1": "yes", "s!B2": "UnknownFunction", "s!B3": "Parse", "s!B4": -3.0, "s!B5": pytest.approx(200.0), "s!B7": "Type", "t!A1": 8.0, "s!B8": 512.0}
    assert {k: got[k] for k in want} == want
    assert sheet.formula_reads("=SUM(A1:B2)+t!C3+A1", "s") == ["s!A1", "s!B1", "s!A2", "s!B2", "t!C3"]
    assert sheet.parse_ref("$AB$12") == (12, 28) and sheet.render_ref(12, 28) == "AB12"


def test_scenarios(spark):
    c = cells(spark, {"v!A1": 0.1, "v!A2": 100.0, "v!A3": "=A2*(1+A1)"})
    over = spark.createDataFrame([("m", s, "v", "A1", x) for s, x in (("bull", 0.3), ("bear", -0.2))], "model string, scenario string, sheet string, reference string, value double")
    out = spark.createDataFrame([("m", "v", "A3")], "model string, sheet string, reference string")
    r = sheet.scenario_spread(sheet.evaluate(c, over), out).first()
    assert r["range"] == pytest.approx(50) and r["base"] == pytest.approx(110) and r["deviation"]["bear"] == pytest.approx(-30)
    pair = spark.createDataFrame([("m", "v", "A3", "v", "A1")], "model string, output_sheet string, output string, driver_sheet string, driver string")
    r = sheet.sensitivity(c, pair).first()
    assert r["step"] == 0.01 and r["slope"] == pytest.approx(100) and r["elasticity"] == pytest.approx(100 * 0.1 / 110)
    rules = spark.createDataFrame([("m", "ok", "v!A3", {"v!A2": 1.1}, 0.01), ("m", "bad", "v!A3", {"v!A2": 1.0}, 0.01), ("m", "gone", "v!A3", {"v!Z9": 1.0}, 0.01)], "model string, name string, lhs string, rhs map<string,double>, tolerance double")
    assert [json.loads(r["payload"])["name"] for r in sheet.identities(sheet.evaluate(c), rules).collect()] == ["bad"]
    assert sorted((r["src"], r["dst"]) for r in sheet.reads(c).collect()) == [("v!A1", "v!A3"), ("v!A2", "v!A3")]


def test_workbook(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    parts = {
        "xl/workbook.xml": f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="val" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {main}><si><t>Rev</t></si><si><r><t>a&amp;</t></r><r><t>b</t></r></si></sst>",
        "xl/styles.xml": f'<styleSheet {main}><numFmts><numFmt numFmtId="164" formatCode="[$USD] 0"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>1</v></c><c r="B1" s="1"><v>2.5</v></c><c r="C1"><f>B1*2</f><v>9</v></c><c r="D1"/></row></sheetData></worksheet>',
    }
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    (tmp_path / "f2.xlsx").write_bytes(data.getvalue())
    got = {r["reference"]: r for r in xlsx.workbooks(spark, str(tmp_path)).collect()}
    assert got["A1"]["text"] == "a&b" and got["B1"]["number"] == 2.5 and got["B1"]["number_format"] == "[$USD] 0" and "D1" not in got
    assert got["C1"]["formula"] == "B1*2" and got["C1"]["cached"] == 9 and got["C1"]["number"] is None and got["C1"]["model"] == "f2"
    assert {r["reference"]: r["value"] for r in sheet.evaluate(xlsx.workbooks(spark, str(tmp_path))).collect()}["C1"] == 5.0


def test_audit(spark):
    log = store.audit_append(store.audit_append([], "index", "{}", "5"), "query", '{"a":1}', "6")
    ok = store.audit_verify(spark.createDataFrame(log, schema.AUDIT)).first()
    assert (ok["entries"], ok["valid"], ok["head"]) == (3, True, log[-1][5])
    for bad in (log[:1] + log[2:], [*log[:2], (*log[2][:3], "{}", *log[2][4:])]):
        assert store.audit_verify(spark.createDataFrame(bad, schema.AUDIT)).first()["valid"] is False


def test_store_and_snapshot(spark, tmp_path):
    g, d = build.build(tree(spark, {"a.py": A, "b.py": B}))
    s = store.Store(spark, str(tmp_path / "db"))
    assert s.generation() == 0
    log = store.audit_append([], "index", "{}", "7")
    assert s.replace_graph(g, d, log) == 1 and s.counts() == (g.nodes.count(), g.edges.count())
    assert s.get_node("pkg::a").count() == 1 and s.load_audit() == log
    more = Graph(g.nodes.where("id in ('pkg', 'pkg::a')").withColumn("id", F.when(F.col("id") == "pkg", "new").otherwise(F.col("id"))), g.edges)
    assert s.insert_graph(more) == (1, 0) and s.generation() == 2 and s.counts()[0] == g.nodes.count() + 1
    s.add_annotation("pkg::a", "note", "1")
    s.add_annotation("pkg", "other", "2")
    assert [(r["id"], r["body"]) for r in s.annotations("pkg").collect()] == [(2, "other")]
    text = store.snapshot(g, log, d)
    assert text == store.snapshot(g, log, d)
    back, trail = store.restore(spark, text)
    assert trail == log and back.nodes.count() == g.nodes.count() and store.snapshot(back, trail, d) == text
    with pytest.raises(ValueError, match="version"):
        store.restore(spark, text.replace('"2.0"', '"3.0"'))
    cert = store.certify(text, log[-1][5], b"key", now=100)
    assert store.verify_certificate(text, cert, b"key", now=200) == []
    assert store.verify_certificate(text + " ", cert, b"other", now=100 + 2 * store.YEAR) == ["digest", "signature", "expired"]


def test_inserts_add_parts(spark, tmp_path, monkeypatch):
    def rows(ids, links):
        n = spark.createDataFrame([(i, "module", i) for i in ids], "id string, kind string, label string")
        return Graph(store.migrated(n, schema.NODES), store.migrated(spark.createDataFrame(links, "src string, dst string, kind string"), schema.EDGES))

    s, folder = store.Store(spark, str(tmp_path / "db")), tmp_path / "db"
    s.replace_graph(rows([f"n{i:04d}" for i in range(2000)], [(f"n{i:04d}", "n0007", "calls") for i in range(2000)]), audit=store.audit_append([], "index", "{}", "7"))
    before = {f: f.stat().st_mtime_ns for f in folder.rglob("*.parquet")}
    assert s.insert_graph(rows(["n0001", "x1", "x2"], [("n0001", "n0007", "calls"), ("x1", "n0007", "calls"), ("x1", "x2", "calls")])) == (2, 2)
    assert s.parts()["nodes"] == [1, 2] and s.parts()["audit"] == [1] and s.counts() == (2002, 2002)
    assert {f: f.stat().st_mtime_ns for f in before} == before
    assert sum(spark.read.parquet(str(folder / "gen=2" / t)).count() for t in store.ORDER) == 6
    assert s.get_links("n0007", incoming=True).count() == 2001 and {r["dst"] for r in s.get_links("x1").collect()} == {"n0007", "x2"}
    assert s.get_node("x1").first()["label"] == "x1" and s.load_audit()[-1][2] == "index"
    # Files lie in the order of their key, so their bounds do not overlap and a lookup is pushed to them.
    for name, by in store.ORDER.items():
        ends = sorted(tuple(r) for r in s.spark.read.parquet(str(folder / "gen=1" / name)).groupBy(F.input_file_name()).agg(F.min(by[0]), F.max(by[0])).select("`min(%s)`" % by[0], "`max(%s)`" % by[0]).collect())
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
    plan = s.get_links("n0007", incoming=True)._jdf.queryExecution().toString()
    assert plan.count("EqualTo(dst,n0007)") >= 2
    monkeypatch.setattr(store, "PARTS", 2)
    assert s.insert_graph(rows(["x3"], [])) == (1, 0) and s.parts()["nodes"] == [3, 4] and s.counts() == (2003, 2002)
    assert s.insert_graph(rows([], [])) == (0, 0) and s.counts() == (2003, 2002)


def test_english(spark):
    t = spark.createDataFrame([("# A [b](u) **c**\n> d\n- e",)], "t string").select(english.clean_markdown(F.col("t")).alias("t")).first()["t"]
    assert t == "A b c\nd\ne"
    d = "# Head\n\n```\ncode\n```\n> 1. a *b c* `d_e` \\*\n***\n![alt](u.png \"t\") <https://x.y> [r][1] snake_case_name __f__"
    got = spark.createDataFrame([(d,), (None,)], "t string").select(english.clean_lines(F.col("t")).alias("t")).collect()
    assert [tuple(x) for x in got[0]["t"]] == [(1, "Head"), (6, "a b c d_e *"), (8, "alt https://x.y r snake_case_name f")] and got[1]["t"] == []
    d = spark.createDataFrame([(1, "One. Two!  Three\n\nFour"), (2, None)], "doc_id long, text string")
    assert [r["sentence"] for r in english.sentences(d).orderBy("seq").collect()] == ["One.", "Two!", "Three", "Four"]
    g = english.containment(d)
    assert g.profile is ENGLISH and g.nodes.count() == 5 and g.edges.count() == 4
    tok = spark.createDataFrame([(1, 0, 0, "dog", "NOUN", "nsubj", 1), (1, 0, 1, "bark", "VERB", "ROOT", 1), (1, 0, 2, "run", "VERB", "conj", 1)], "doc long, sentence int, token int, lemma string, pos string, relation string, head int")
    e = {(r["src"][-2:], r["dst"][-2:], r["kind"]) for r in english.parsed(tok).edges.collect() if r["kind"] != "contains"}
    assert e == {("t1", "t0", "subject"), ("t1", "t2", "coordinated-with"), ("t1", "t2", "precedes")}


def test_series(spark):
    wide = spark.createDataFrame([("m", 0, "FY0", 10.0, None, 5.0, 5.0), ("m", 1, "FY1", 12.0, 2.0, 6.0, 6.0), ("m", 2, "FY2", 15.0, 2.0, 6.0, 8.0)], "model string, period_idx int, period string, stock double, flow double, debt double, equity double")
    s = series.long_form(wide, ["stock", "flow", "debt", "equity"])
    assert s.count() == 11
    assert [r["period_idx"] for r in series.rollforward_breaks(s, "stock", {"flow": 1.0}).collect()] == [2]
    assert [r["period_idx"] for r in series.balance_breaks(s, "stock", ["debt", "equity"]).collect()] == [2]


def test_metering_batch_and_stream(spark, tmp_path):
    rows = [("2026-01-02T00:00:00.000Z", "k", "pro", "GET", "/v1/q", 200, 10, 1), ("2026-01-03T00:00:00.000Z", "k", "pro", "POST", "/v1/index", 200, 5, 1), ("2026-02-01T00:00:00.000Z", "k", "pro", "GET", "/v1/q", 200, 7, 1)]
    metering.append(spark.createDataFrame(rows, schema.METERING), str(tmp_path / "log"))
    (tmp_path / "log" / "part-x.json").write_text("not json\n")
    log = metering.read(spark, str(tmp_path / "log"))
    want = {("k", "2026-01", 1, 1, 15), ("k", "2026-02", 1, 0, 7)}
    assert {tuple(r) for r in metering.usage(log).collect()} == want
    assert metering.reaches(log, "k", "2026-01", 1) and not metering.reaches(log, "k", "2026-01", 2)
    q = metering.usage(metering.read(spark, str(tmp_path / "log"), stream=True)).writeStream.format("memory").queryName("usage").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("usage").collect()} == want
