"""Registered queries of the build, the evaluator, the store and the sources, with their SQL."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import api, build, schema, store, views
from ..functions import sheet
from ..graph import Graph, shared_folder, union
from ..operators import diff, layout, measures
from ..profile import RA
from ..sources import english, models, repo, series
from .queries import HUB, _cut, _trade, _yearly, query

_NATIONS = "WITH m AS (SELECT n_nationkey AS n, concat('r', n_regionkey) AS package, concat('r', n_regionkey, '::n', n_nationkey) AS id FROM nation)"
_MET = ", met AS (SELECT DISTINCT a.id AS src, a.package AS here, b.id AS dst, b.package AS there, b.n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN m a ON c_nationkey = a.n JOIN supplier ON l_suppkey = s_suppkey JOIN m b ON s_nationkey = b.n)"


def _leave(s: store.Store) -> None:
    with contextlib.suppress(Exception):  # the session may have gone first
        s.remove()


def _fresh_store(spark: SparkSession) -> store.Store:
    """A store of its own in the shared folder; it goes when the process ends, for results read it until then."""
    s = store.Store(spark, f"{shared_folder(spark)}/graphloom-store/{uuid.uuid4().hex[:12]}")
    atexit.register(_leave, s)
    return s


def _raw(spark: SparkSession, sf_dir: str, **parts) -> build.Raw:
    """The sellers' raw rows with some tables replaced, the others but files and symbols empty."""
    raw = views.sellers(spark, sf_dir)
    empty = {k: spark.createDataFrame([], s) for k, s in (("imports", schema.IMPORTS), ("calls", schema.CALLS), ("heritage", schema.HERITAGE))}
    return build.Raw(**{"files": raw.files, "symbols": raw.symbols} | empty | parts)


@query(_NATIONS + _MET + """SELECT src, CASE WHEN n % 4 IN (0, 1) THEN dst WHEN n % 4 = 2 AND here = there THEN dst WHEN n % 4 = 2 THEN concat('external::n', n) ELSE concat('external::out', n) END AS dst, min(n) AS first
FROM met WHERE NOT (n % 4 IN (0, 1) AND src = dst) AND NOT (n % 4 = 2 AND src = dst) GROUP BY 1, 2""")
def build_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whom each nation buys from, named by module, by a path below it, by a sibling's name, or by nothing known."""
    views.register(spark, sf_dir, ["lineitem", "orders", "customer", "supplier", "nation"])
    i = spark.sql(_NATIONS + _MET + """ SELECT src AS from_module_id, n AS line, CAST(split_part(src, '::n', 2) AS BIGINT) AS file_seq, n AS seq,
      CASE n % 4 WHEN 0 THEN dst WHEN 1 THEN concat('external::', dst, '::s', n) WHEN 2 THEN concat('n', n) ELSE concat('external::out', n) END AS to_module_id, array(concat('x', n)) AS bindings FROM met""")
    g, _ = build.build(_raw(spark, sf_dir, imports=i))
    return g.edges.where("kind = 'imports'").select("src", "dst", F.col("line").alias("first"))


@query("""WITH s AS (SELECT count(*) AS n FROM supplier) SELECT concat('r', a.n_regionkey, '::n', a.n_nationkey, '::c', c_custkey) AS src, concat('r', b.n_regionkey, '::n', b.n_nationkey, '::s', s_suppkey) AS dst,
  CASE WHEN c_custkey % 2 = 0 THEN 'inherits' ELSE 'implements' END AS kind FROM customer CROSS JOIN s JOIN supplier ON s_suppkey = c_custkey % s.n JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON s_nationkey = b.n_nationkey""")
def build_heritage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer as the child of a supplier, both by bare name; names that nothing bears give no edge."""
    n = spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    her = c.select(F.lit(0).cast("long").alias("file_seq"), F.col("c_custkey").cast("int").alias("seq"), F.concat(F.lit("c"), "c_custkey").alias("type_name"), F.concat(F.lit("s"), F.col("c_custkey") % n).alias("target_name"), F.when(F.col("c_custkey") % 2 == 0, "inherits").otherwise("implements").alias("kind"), F.lit(1).alias("line"))
    g, _ = build.build(_raw(spark, sf_dir, heritage=her))
    return g.edges.where("kind in ('inherits', 'implements')").select("src", "dst", "kind")


@query("""SELECT 'MultiDefinition' AS kind, count(*) AS n FROM customer WHERE c_custkey % 100 = 1
UNION ALL SELECT 'UnknownSymbol', count(*) FROM supplier
UNION ALL SELECT 'UnresolvedCall', count(DISTINCT l_suppkey) FROM lineitem WHERE l_returnflag = 'R'
UNION ALL SELECT 'Cycle', count(*) FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 WHERE a.c_custkey % 2 = 0
UNION ALL SELECT 'MissingProvenance', count(*) FROM part WHERE p_size % 2 = 1
UNION ALL SELECT 'InvalidAttribute', count(*) FROM part WHERE p_size % 2 = 0 AND p_size % 3 = 0
UNION ALL SELECT 'ArticulationIdentity', count(*) FROM part WHERE p_size % 5 = 0""")
def diagnostics_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of diagnostic, planted in the tables: doubled symbols, callers and names that are not there, pairs that call each other, estimates without an error, attributes that no kind has, sums that do not add up."""
    raw = views.sellers(spark, sf_dir)
    again = raw.symbols.where("label like 'c%' and cast(substring(label, 2) as bigint) % 100 = 1").withColumns({"file_seq": F.lit(10_000).cast("long"), "file": F.lit("copy.py")})
    c = raw.symbols.where("label like 'c%'").select("id", F.substring("label", 2, 20).cast("long").alias("k"))
    pairs = c.where("k % 2 = 0").select(F.col("id").alias("a"), (F.col("k") + 1).alias("k")).join(c.select("k", F.col("id").alias("b")), "k")
    number = F.row_number().over(Window.partitionBy("file_seq").orderBy("from_id", "to_name")).cast("int")
    call = lambda df, at, a, b: df.select(F.lit(at).cast("long").alias("file_seq"), a.alias("from_id"), b.alias("to_name"), F.lit(1).alias("line")).withColumn("seq", number)
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    calls = union([raw.calls.where("to_name like 'gone%'"), call(pairs, 20_000, F.col("a"), F.col("b")), call(pairs, 20_001, F.col("b"), F.col("a")), call(s, 20_002, F.concat(F.lit("ghost::"), "s_suppkey"), F.lit("x"))])
    _, d = build.build(_raw(spark, sf_dir, symbols=raw.symbols.unionByName(again), calls=calls))
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    keys = F.map_concat(F.create_map(F.lit("method"), F.lit("m"), F.lit("window"), F.lit("w")), F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("error"), F.lit("0"))).otherwise(F.create_map().cast("map<string,string>")), F.when(F.col("p_size") % 3 == 0, F.create_map(F.lit("odd"), F.lit("x"))).otherwise(F.create_map().cast("map<string,string>")))
    _, breaches = build.gate(part.select(F.concat(F.lit("m::"), "p_partkey").alias("src"), F.lit("m::x").alias("dst"), F.lit("estimates").alias("kind"), F.lit(None).cast("int").alias("line"), keys.alias("attrs")), RA)
    rule = part.select(F.col("p_partkey").cast("string").alias("model"), F.lit("sum").alias("name"), F.lit("v!B3").alias("lhs"), F.create_map(F.lit("v!B1"), F.lit(1.0), F.lit("v!B2"), F.when(F.col("p_size") % 5 == 0, 3.0).otherwise(1.0)).alias("rhs"), F.lit(0.001).alias("tolerance"))
    found = sheet.identities(sheet.evaluate(_book(spark, sf_dir, {"B3": "=B1+B2"})), rule)
    return union([d.select("kind"), breaches.select("kind"), found.select("kind")]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


#: Formulas of a part's sheet v: B1 is its price, B2 its size.
_FORMULAS = {
    "C1": "=B1*B2", "C2": "=IF(B2>25,C1*0.9,C1)", "C3": "=ROUND(C2/3,2)", "C4": "=SUM(B1:C1,2)", "C5": "=B1/(B2-B2)", "C6": "=SQRT(B2)+ABS(-B1)", "C7": "=NPV(0.1,B1,B2)", "C8": "=MAX(B1,B2)-MIN(B1:B2)",
    "C9": "=C5+1", "D1": "=D2", "D2": "=D1", "D3": "=Z9", "D4": "=AVERAGE(v!B1:v!B2)^2", "D5": "=-B2^2", "D6": "=IF(B2>=1,\"kept\",C5)", "D7": "=NOPE(1)", "D8": "=B2%7", "D9": "=1+",
}


def _book(spark: SparkSession, sf_dir: str, formulas: dict[str, str]) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    cells = [("B1", None, F.col("p_retailprice")), ("B2", None, F.col("p_size").cast("double")), *((r, f, F.lit(None)) for r, f in formulas.items())]
    cell = F.explode(F.array(*[F.struct(F.lit(r).alias("reference"), F.lit(f).cast("string").alias("formula"), n.cast("double").alias("number")) for r, f, n in cells])).alias("c")
    return part.select(F.col("p_partkey").cast("string").alias("model"), F.lit("v").alias("sheet"), cell).select("model", "sheet", "c.*", F.lit(None).cast("string").alias("text"))


_VALUES = {
    "B1": "p", "B2": "s", "C1": "p * s", "C2": "CASE WHEN s > 25 THEN p * s * 0.9 ELSE p * s END", "C4": "p + p * s + 2", "C6": "sqrt(s) + abs(-p)", "C7": "p / 1.1 + s / 1.1 / 1.1",
    "C8": "greatest(p, s) - least(p, s)", "D4": "((p + s) / 2) * ((p + s) / 2)", "D5": "s * s", "D8": "s - 7 * floor(s / 7)",
}
_ABSENT = {"C5": "DivByZero", "C9": "AbsentInput", "D1": "Cycle", "D2": "Cycle", "D3": "UnresolvedRef", "D7": "UnknownFunction", "D9": "Parse"}


@query("WITH x AS (SELECT p_partkey AS k, p_retailprice AS p, CAST(p_size AS DOUBLE) AS s FROM part) " + " UNION ALL ".join(
    [f"SELECT CAST(k AS VARCHAR) AS model, '{r}' AS reference, round({e}, 4) AS value, CAST(NULL AS VARCHAR) AS text, CAST(NULL AS VARCHAR) AS error FROM x" for r, e in _VALUES.items()]
    + [f"SELECT CAST(k AS VARCHAR), '{r}', NULL, NULL, '{e}' FROM x" for r, e in _ABSENT.items()] + ["SELECT CAST(k AS VARCHAR), 'D6', NULL, CASE WHEN s >= 1 THEN 'kept' END, NULL FROM x"]))
def sheet_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook per part: operators, functions, ranges, and each way for a value to be absent."""
    formulas = {k: v for k, v in _FORMULAS.items() if k != "C3"}
    return sheet.evaluate(_book(spark, sf_dir, formulas)).select("model", "reference", F.round("value", 4).alias("value"), "text", "error")


@query("SELECT CAST(p_partkey AS VARCHAR) AS model, round(p_retailprice * p_size, 2) AS base, round(p_retailprice * p_size * 0.2, 2) AS range, round(p_retailprice * p_size * 0.1, 2) AS bull, round(-p_retailprice * p_size * 0.1, 2) AS bear FROM part")
def sheet_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price up and down by a tenth: the output's spread, and each scenario's distance from the base."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    over = part.select(F.col("p_partkey").cast("string").alias("model"), F.explode(F.create_map(F.lit("bull"), F.lit(1.1), F.lit("bear"), F.lit(0.9))).alias("scenario", "by"), F.lit("v").alias("sheet"), F.lit("B1").alias("reference"), "p_retailprice")
    over = over.select("model", "scenario", "sheet", "reference", (F.col("p_retailprice") * F.col("by")).alias("value"))
    out = part.select(F.col("p_partkey").cast("string").alias("model"), F.lit("v").alias("sheet"), F.lit("C1").alias("reference"))
    got = sheet.scenario_spread(sheet.evaluate(_book(spark, sf_dir, {"C1": _FORMULAS["C1"]}), over), out)
    return got.select("model", F.round("base", 2).alias("base"), F.round("range", 2).alias("range"), *[F.round(F.col("deviation")[k], 2).alias(k) for k in ("bull", "bear")])


@query("SELECT CAST(p_partkey AS VARCHAR) AS model, round(p_retailprice * 0.01, 6) AS step, round(CAST(p_size AS DOUBLE), 3) AS slope, round(CAST(1 AS DOUBLE), 5) AS elasticity FROM part")
def sheet_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What price times size gains when the price rises by a hundredth."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    pairs = part.select(F.col("p_partkey").cast("string").alias("model"), *[F.lit(v).alias(k) for k, v in (("output_sheet", "v"), ("output", "C1"), ("driver_sheet", "v"), ("driver", "B1"))])
    got = sheet.sensitivity(_book(spark, sf_dir, {"C1": _FORMULAS["C1"]}), pairs)
    return got.select("model", F.round("step", 6).alias("step"), F.round("slope", 3).alias("slope"), F.round("elasticity", 5).alias("elasticity"))


_READS = {"C1": "B1 B2", "C4": "B1 C1", "C8": "B1 B2", "D3": "Z9", "D7": ""}


@query("SELECT model, dst, string_agg(src, ' ' ORDER BY src) AS src FROM (" + " UNION ALL ".join(f"SELECT CAST(p_partkey AS VARCHAR) AS model, 'v!{d}' AS dst, 'v!{x}' AS src FROM part" for d, xs in _READS.items() for x in xs.split()) + ") t GROUP BY model, dst")
def sheet_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which cells each formula names, ranges spelled out, whether it can be evaluated or not."""
    got = sheet.reads(_book(spark, sf_dir, {k: _FORMULAS[k] for k in _READS}))
    return got.groupBy("model", "dst").agg(F.array_join(F.array_sort(F.collect_set("src")), " ").alias("src"))


@query("""WITH k AS (SELECT count(*) AS n FROM part) SELECT 'nodes' AS relation, 'model' AS kind, n FROM k UNION ALL SELECT 'nodes', 'statement', n FROM k UNION ALL SELECT 'nodes', 'driver', n FROM k
UNION ALL SELECT 'nodes', 'line_item', n FROM k UNION ALL SELECT 'nodes', 'output', n FROM k UNION ALL SELECT 'nodes', 'scenario', n FROM k UNION ALL SELECT 'nodes', 'period', n FROM k UNION ALL SELECT 'nodes', 'source', 1
UNION ALL SELECT 'edges', 'contains', 6 * n FROM k UNION ALL SELECT 'edges', 'sourced_from', n FROM k UNION ALL SELECT 'edges', 'computes_into', 2 * n FROM k UNION ALL SELECT 'edges', 'articulates', n FROM k
UNION ALL SELECT 'edges', 'assumes', n FROM k UNION ALL SELECT 'edges', 'estimates', n FROM k UNION ALL SELECT 'edges', 'references', n FROM k
UNION ALL SELECT 'nodes', '*', 7 * n + 1 FROM k UNION ALL SELECT 'edges', '*', 13 * n FROM k""")
def model_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of a declared workbook per part: its cells, what they compute, where they come from."""
    import json

    decl = {
        "format": models.FORMAT, "model_id": "?", "artifact": "f.xlsx", "label": "M", "tolerance": 0.01,
        "sheets": [{"name": "v", "label": "V", "label_column": "A", "cells": {"B1": {"kind": "driver", "label": "price", "source": {"stub": "list", "label": "list", "source": "u", "as_of": "2024"}}, "B2": {"kind": "line_item", "label": "size", "period": "FY1"}, "C1": {"kind": "output", "label": "worth"}}}],
        "identities": [{"name": "i", "lhs": "v!C1", "rhs": {"v!B2": 1.0}}], "scenarios": [{"name": "bull", "label": "Bull", "binds": {"v!B1": 2.0}}],
        "estimates": [{"from": "v!B2", "to": "v!C1", "method": "m", "window": "w", "error": "0"}], "references": [{"from": "v!C1", "to": "v!B1", "claimant": "a"}],
    }
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    text = part.select(F.replace(F.lit(json.dumps(decl)), F.lit('"?"'), F.concat(F.lit('"'), "p_partkey", F.lit('"'))).alias("text"))
    cells = _book(spark, sf_dir, {"C1": _FORMULAS["C1"]})
    g, _ = models.model_graph(cells, models.declarations(text), sheet.evaluate(cells))
    return measures.stats(g)


@query(_trade("""
SELECT 'nodes' AS relation, kind, count(*) AS n FROM nodes GROUP BY kind
UNION ALL SELECT 'edges', kind, count(*) FROM edges GROUP BY kind
UNION ALL SELECT 'nodes', '*', count(*) FROM nodes UNION ALL SELECT 'edges', '*', count(*) FROM edges"""))
def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the graph stored, the rest inserted, what is there again left alone; then read back."""
    g = views.trade(spark, sf_dir)
    s = _fresh_store(spark)
    half = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    s.replace_graph(Graph(g.nodes.where(half), g.edges.where("kind <> 'calls'"), g.profile), audit=store.audit_append([], "index", "{}", "1"))
    s.insert_graph(g)
    return measures.stats(s.load_graph())


@query("""WITH RECURSIVE s AS (SELECT s_suppkey AS k, s_name AS name, row_number() OVER (ORDER BY s_suppkey) AS seq FROM supplier
), chain AS (SELECT CAST(0 AS BIGINT) AS seq, sha256('0|7|genesis|{}|GENESIS') AS hash
  UNION ALL SELECT s.seq, sha256(concat(s.seq, '|7|index|', s.name, '|', chain.hash)) FROM chain JOIN s ON s.seq = chain.seq + 1)
SELECT count(*) AS entries, true AS valid, arg_max(hash, seq) AS head FROM chain""")
def audit_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trail of one entry per supplier, written entry by entry: it must verify."""
    log: list = []
    for r in spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name").orderBy("s_suppkey").toLocalIterator():
        log = store.audit_append(log, "index", r["s_name"], "7")
    return store.audit_verify(spark.createDataFrame(log, schema.AUDIT))


@query(_trade(" SELECT src, dst FROM edges WHERE kind = 'contains' AND dst IN (SELECT id FROM nodes WHERE kind IN ('package', 'module', 'class', 'interface'))"))
def structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers only; what lies in them is lifted to the nearest one."""
    return layout.structure(views.trade(spark, sf_dir)).edges.select("src", "dst")


@query("""SELECT dense_rank() OVER (ORDER BY l_orderkey) AS tx_id, concat('p', l_partkey) AS file FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) t""")
def git_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a log: a commit line each, then paths, matched to the files that the graph knows."""
    views.register(spark, sf_dir, ["lineitem", "part"])
    lines = spark.sql("SELECT l_orderkey * 100 AS line_no, concat('commit ', l_orderkey) AS value FROM lineitem GROUP BY l_orderkey UNION ALL SELECT l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey), concat('work/tree/p', l_partkey) FROM lineitem")
    return repo.to_graph_files(repo.commits(spark, lines), spark.sql("SELECT concat('p', p_partkey) AS file FROM part"))


_PARTS = """SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '([.!?])[ \\t\\n\\r]+', '\\1\n', 'g'), '\n+')) AS s FROM documents"""


@query(f"WITH t AS (SELECT * FROM ({_PARTS}) x WHERE trim(s) <> ''), d AS (SELECT count(DISTINCT doc_id) AS n FROM t), k AS (SELECT count(*) AS n FROM t)" + """ SELECT 'nodes' AS relation, 'document' AS kind, n FROM d UNION ALL SELECT 'nodes', 'sentence', n FROM k UNION ALL SELECT 'edges', 'contains', n FROM k
UNION ALL SELECT 'nodes', '*', d.n + k.n FROM d, k UNION ALL SELECT 'edges', '*', n FROM k""")
def document_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and their sentences as a graph."""
    return measures.stats(english.containment(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


_IMPACT = """, a AS (SELECT * FROM nodes WHERE NOT (kind = 'external' AND id LIKE '%#11')
), b AS (SELECT id, kind, CASE WHEN kind = 'class' AND id LIKE '%7' THEN 'renamed' ELSE label END AS label, decisions FROM nodes WHERE NOT (kind = 'external' AND id LIKE '%#12')
), ea AS (SELECT * FROM edges WHERE src IN (SELECT id FROM a) AND dst IN (SELECT id FROM a)), eb AS (SELECT * FROM edges WHERE src IN (SELECT id FROM b) AND dst IN (SELECT id FROM b)
), de AS (SELECT src, dst FROM (SELECT * FROM ea EXCEPT SELECT * FROM eb) t UNION SELECT src, dst FROM (SELECT * FROM eb EXCEPT SELECT * FROM ea) t
), seeds AS (SELECT coalesce(a.id, b.id) AS id FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.label <> b.label UNION SELECT src FROM de UNION SELECT dst FROM de
), ra AS (SELECT s.id AS seed, e.src AS id FROM seeds s JOIN ea e ON e.dst = s.id AND e.kind IN ('calls', 'reads', 'writes') UNION SELECT r.seed, e.src FROM ra r JOIN ea e ON e.dst = r.id AND e.kind IN ('calls', 'reads', 'writes')
), rb AS (SELECT s.id AS seed, e.src AS id FROM seeds s JOIN eb e ON e.dst = s.id AND e.kind IN ('calls', 'reads', 'writes') UNION SELECT r.seed, e.src FROM rb r JOIN eb e ON e.dst = r.id AND e.kind IN ('calls', 'reads', 'writes'))
SELECT s.id, coalesce(x.n, 0) AS before, coalesce(y.n, 0) AS after, coalesce(y.n, 0) - coalesce(x.n, 0) AS delta FROM seeds s
LEFT JOIN (SELECT seed, count(*) AS n FROM ra WHERE id <> seed GROUP BY seed) x ON x.seed = s.id LEFT JOIN (SELECT seed, count(*) AS n FROM rb WHERE id <> seed GROUP BY seed) y ON y.seed = s.id"""


@query(_trade(_IMPACT))
def diff_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blast radii before and after, of all nodes that differ or touch an edge that does."""
    g = views.trade(spark, sf_dir)
    return diff.impact(_cut(g, True), _cut(g, False))


@query("""WITH f AS (SELECT concat('n', c_nationkey) AS model, CAST(year(o_orderdate) AS INTEGER) AS period_idx, CAST(count(*) AS DOUBLE) AS flow FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
, w AS (SELECT *, sum(flow) OVER (PARTITION BY model ORDER BY period_idx) + CASE WHEN model = 'n5' THEN period_idx ELSE 0 END AS stock FROM f)
SELECT model, period_idx, stock AS lhs, 2 * flow AS rhs FROM w WHERE (model <> 'n3' OR period_idx <> 1996) AND abs(stock - 2 * flow) > 0.01""")
def filed_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the stock is not the sum of two flows; years with a missing one are not judged."""
    return series.balance_breaks(_yearly(spark, sf_dir), "stock", ["flow", "sparse"])


@query(_trade(f" SELECT n.id, count(*) AS value FROM edges e JOIN nodes n ON e.dst = n.id WHERE e.kind <> 'contains' AND n.kind <> 'external' AND n.id NOT LIKE 'external::%' GROUP BY n.id ORDER BY value DESC, n.id LIMIT 20"))
def asked_in_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.ask(views.trade(spark, sf_dir), "What are the most used symbols?")["rows"]


@query(_trade(f""" SELECT id, kind, label, n_in, n_out FROM nodes LEFT JOIN (SELECT dst, count(*) AS n_in FROM edges GROUP BY dst) i ON i.dst = id LEFT JOIN (SELECT src, count(*) AS n_out FROM edges GROUP BY src) o ON o.src = id WHERE id = '{HUB}'"""))
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One node of a stored graph with its links counted: each read goes to the table that lies in the order of its key."""
    s = _fresh_store(spark)
    s.replace_graph(views.trade(spark, sf_dir))
    one = s.get_node(HUB).select("id", "kind", "label")
    count = lambda end, name: s.get_links(HUB, incoming=end == "dst").groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias(name))
    return reduce(lambda a, b: a.join(b, "id", "left"), [count("dst", "n_in"), count("src", "n_out")], one)
