"""From raw extractor rows to a graph: definitions, containment, name resolution, diagnostics.

Everything is joins over the raw tables. A name is looked up by its last
segment; the candidates of one reference are ranked in a window of that
reference alone.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import schema
from .graph import Graph, checkpointed, numbered, union
from .operators.topology import cycles
from .profile import CODE, Profile


@dataclass(frozen=True)
class Raw:
    files: DataFrame
    symbols: DataFrame
    imports: DataFrame
    calls: DataFrame
    heritage: DataFrame


def _last(c: Column) -> Column:
    return F.substring_index(c, "::", -1)


def _first_of(df: DataFrame, by: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def definitions(raw: Raw) -> tuple[DataFrame, DataFrame]:
    """Symbols whose id is defined first in file order, and a diagnostic per later definition."""
    s = raw.symbols
    w = Window.partitionBy("id").orderBy("file_seq", "sym_seq")
    at = F.struct("file", "line")
    s = s.withColumns({"_n": F.row_number().over(w), "_first": F.first(at).over(w)})
    dup = s.where("_n > 1").select("file_seq", "sym_seq", F.lit("MultiDefinition").alias("kind"), F.to_json(F.struct("id", F.array("_first", at).alias("locations"))).alias("payload"))
    return s.where("_n = 1").drop("_n", "_first"), dup


def scaffold(raw: Raw, symbols: DataFrame, profile: Profile) -> tuple[DataFrame, DataFrame]:
    """Nodes and containment edges of packages, modules, files and symbols; the first node under an id wins."""
    none = lambda t: F.lit(None).cast(t)
    f = raw.files.withColumn("file_id", F.concat("package", F.lit("::/"), "file"))

    def node(df: DataFrame, id: str, kind: str, label: Column, prio: int) -> DataFrame:
        return df.select(F.col(id).alias("id"), F.lit(kind).alias("kind"), label.alias("label"), F.struct("file", F.lit(1).alias("line"), none("int").alias("column")).alias("loc"), none("array<string>").alias("defines"), none("array<string>").alias("refs"), none("int").alias("end_line"), none("string").alias("signature"), none("int").alias("decisions"), none("map<string,string>").alias("measures"), "file_seq", F.lit(prio).alias("prio"), F.lit(0).alias("sym_seq"))

    parts = [node(f, "package", "package", F.col("package"), 0), node(f, "module_id", "module", _last(F.col("module_id")), 1), node(f, "file_id", "file", F.col("file"), 2)]
    parts.append(symbols.select("id", "kind", "label", F.struct("file", "line", "column").alias("loc"), "defines", "refs", "end_line", "signature", "decisions", "measures", "file_seq", F.lit(3).alias("prio"), "sym_seq"))
    nodes = _first_of(union(parts), ["id"], ["file_seq", "prio", "sym_seq"]).drop("file_seq", "prio", "sym_seq")
    nodes = nodes.withColumn("tier", profile.tier_of(F.col("kind")))
    sym = symbols.withColumn("file_id", F.concat("package", F.lit("::/"), "file"))
    edges = f.select(F.col("package").alias("src"), F.col("module_id").alias("dst")).union(f.select("module_id", "file_id")).union(sym.select("file_id", "id"))
    edges = edges.where("src <> dst").distinct().withColumns({"kind": F.lit("contains"), "line": none("int"), "attrs": none("map<string,string>")})
    return nodes, edges


def _hosts(raw: Raw, symbols: DataFrame) -> DataFrame:
    """(id, module, package) of whatever calls: symbols, and modules themselves."""
    m = raw.files.select(F.col("module_id").alias("id"), F.col("module_id").alias("module"), "package").distinct()
    return symbols.select("id", F.col("module_id").alias("module"), "package").union(m).dropDuplicates(["id"])


def resolve(refs: DataFrame, nodes: DataFrame, hosts: DataFrame, profile: Profile) -> DataFrame:
    """refs(rid, from_id, name) with target: null where nothing bears the name.

    In order: the exact id; `crate::` as the caller's package; a qualified name
    in a module that the qualifier ends; else any symbol of that last segment,
    nearest first (same module, same package, rest), then by kind, then by id.
    """
    r = refs.join(hosts.toDF("from_id", "module", "package"), "from_id", "left")
    name = F.col("name")
    swapped = F.when(name.startswith("crate::") & F.col("package").isNotNull(), F.concat("package", F.lit("::"), F.substring(name, 8, 1 << 30))).otherwise(name)
    r = r.withColumn("look", swapped)
    dotted = ~F.col("look").contains("::") & F.col("look").contains(".")
    head = F.when(F.col("look").contains("::"), F.expr("substring(look, 1, length(look) - length(substring_index(look, '::', -1)) - 2)")).when(dotted, F.expr("substring(look, 1, length(look) - length(substring_index(look, '.', -1)) - 1)"))
    tail = F.when(F.col("look").contains("::"), _last(F.col("look"))).when(dotted, F.substring_index("look", ".", -1))
    r = r.withColumns({"qual": F.regexp_replace(head, r"\.", "::"), "qlast": tail, "last": F.when(F.col("look").contains("::"), _last(F.col("look"))).otherwise(F.col("look"))})
    ids = nodes.select(F.col("id").alias("cand"), profile.rank_of(F.col("kind")).alias("krank"), _last(F.col("id")).alias("seg"))
    named = ids.join(hosts.select(F.col("id").alias("cand"), F.col("module").alias("host")), "cand", "left")
    exact = r.select("rid", F.explode(F.array_distinct(F.array("name", "look"))).alias("cand")).join(ids.select("cand"), "cand").select("rid", "cand", F.lit(0).alias("prio"), F.lit(0).alias("tier"), F.lit(0).alias("krank"))
    by_seg = named.where(F.col("seg") != F.col("cand"))
    qual = r.where("qual is not null").join(by_seg, F.col("qlast") == F.col("seg")).where((F.col("host") == F.col("qual")) | F.col("host").endswith(F.concat(F.lit("::"), F.col("qual")))).select("rid", "cand", F.lit(1).alias("prio"), F.lit(0).alias("tier"), "krank")
    tier = F.when(F.col("cand").startswith(F.concat("module", F.lit("::"))), 0).when(F.col("cand").startswith(F.concat("package", F.lit("::"))), 1).otherwise(2)
    loose = r.join(by_seg, F.col("last") == F.col("seg")).select("rid", "cand", F.lit(2).alias("prio"), tier.alias("tier"), "krank")
    best = union([exact, qual, loose]).groupBy("rid").agg(F.min(F.struct("prio", "tier", "krank", "cand")).alias("m")).select("rid", F.col("m.cand").alias("target"))
    return refs.join(best, "rid", "left")


def import_targets(raw: Raw, nodes: DataFrame, symbols: DataFrame, profile: Profile) -> DataFrame:
    """imports with target: module, longest module prefix, sibling module, workspace package, else a boundary id."""
    modules = raw.files.select(F.col("module_id").alias("m")).distinct()
    packages = raw.files.select("package").distinct().groupBy(F.translate("package", "-", "_").alias("norm")).agg(F.min("package").alias("pkg"))
    i = raw.imports.withColumn("rid", F.struct("file_seq", "seq"))
    bare = F.regexp_replace("to_module_id", f"^{profile.boundary_prefix}", "")
    i = i.withColumns({"bare": bare, "path": F.replace(bare, F.lit("/"), F.lit("::"))})
    segs = F.split("path", "::")
    width = F.when(F.col("path").startswith("@") & (F.size(segs) > 1), 2).otherwise(1)
    i = i.withColumns({"root": F.array_join(F.slice(segs, F.lit(1), width), "::"), "rest": F.array_join(F.slice(segs, width + 1, F.greatest(F.size(segs), F.lit(1))), "::")})

    def prefixes(df: DataFrame, col: str) -> DataFrame:
        s = F.split(col, "::")
        every = F.transform(F.sequence(F.lit(1), F.size(s)), lambda n: F.array_join(F.slice(s, F.lit(1), n), "::"))
        return df.select("rid", F.explode(every).alias("m")).join(modules, "m").groupBy("rid").agg(F.max_by("m", F.length("m")).alias("cand"))

    exact = i.select("rid", F.col("to_module_id").alias("m")).join(modules, "m").select("rid", F.col("m").alias("cand"), F.lit(0).alias("prio"))
    longest = prefixes(i, "path").select("rid", "cand", F.lit(1).alias("prio"))
    beside = i.where(~F.col("path").contains("::") & F.col("from_module_id").contains("::")).select("rid", F.concat(F.regexp_replace("from_module_id", "::[^:]+$", ""), F.lit("::"), "path").alias("m"))
    beside = beside.join(modules, "m").select("rid", F.col("m").alias("cand"), F.lit(2).alias("prio"))
    known = i.join(packages, F.translate("root", "-", "_") == F.col("norm"))
    deep = prefixes(known.where("rest <> ''").withColumn("_p", F.concat("pkg", F.lit("::"), "rest")), "_p").select("rid", "cand", F.lit(3).alias("prio"))
    top = known.where("rest = ''")
    sym = symbols.select("id", F.col("module_id").alias("cand"), F.col("package").alias("pkg"), _last(F.col("id")).alias("b"))
    bound = top.select("rid", "pkg", F.posexplode("bindings").alias("nth", "b")).join(sym, ["pkg", "b"]).groupBy("rid").agg(F.min(F.struct("nth", "id", "cand")).alias("x")).select("rid", F.col("x.cand").alias("cand"), F.lit(4).alias("prio"))
    root = top.select("rid", F.col("pkg").alias("cand"), F.lit(5).alias("prio"))
    best = union([exact, longest, beside, deep, bound, root]).groupBy("rid").agg(F.min_by("cand", "prio").alias("cand"))
    return i.join(best, "rid", "left").withColumn("target", F.coalesce("cand", F.concat(F.lit(profile.boundary_prefix), "bare")))


def gate(edges: DataFrame, profile: Profile) -> tuple[DataFrame, DataFrame]:
    """Edges that have the attributes their kind must carry, without ones it must not; and a diagnostic per breach."""
    attrs = F.coalesce("attrs", F.create_map().cast("map<string,string>"))
    need = F.lit(None).cast("array<string>")
    allow = F.lit(None).cast("array<string>")
    for k in profile.edge_kinds:
        lit = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
        need = F.when(F.col("kind") == k, lit(profile.required(k))).otherwise(need)
        allow = F.when(F.col("kind") == k, lit(profile.allowed(k))).otherwise(allow)
    e = edges.withColumns({"_need": F.coalesce(need, F.array().cast("array<string>")), "_allow": F.coalesce(allow, F.array().cast("array<string>")), "_attrs": attrs})
    e = e.withColumn("_lack", F.array_except("_need", F.map_keys("_attrs"))).withColumn("_extra", F.array_except(F.map_keys("_attrs"), "_allow"))
    bad = e.where(F.size("_lack") > 0).select(F.lit("MissingProvenance").alias("kind"), F.to_json(F.struct("src", "dst", "kind", F.col("_lack").alias("missing"))).alias("payload"))
    odd = e.where(F.size("_lack") == 0).select("src", "dst", F.col("kind").alias("edge_kind"), F.explode("_extra").alias("attribute"))
    odd = odd.select(F.lit("InvalidAttribute").alias("kind"), F.to_json(F.struct("src", "dst", "edge_kind", "attribute")).alias("payload"))
    kept = e.where(F.size("_lack") == 0).withColumn("attrs", F.when(F.size("_attrs") > 0, F.map_filter("_attrs", lambda k, v: F.array_contains(F.col("_allow"), k))))
    return kept.drop("_need", "_allow", "_attrs", "_lack", "_extra"), bad.unionByName(odd)


def add_node(g: Graph, id: str, kind: str, label: str | None = None, **fields) -> Graph:
    """The graph with one more node; the node that has the id already stays as it is."""
    if kind not in g.profile.node_kinds:
        raise ValueError(f"unknown node kind: {kind}")
    if g.has(id):
        return g
    row = {"id": id, "kind": kind, "label": label or id.rsplit("::", 1)[-1]} | fields
    cols = [F.lit(row.get(f.name)).cast(f.dataType).alias(f.name) if not isinstance(row.get(f.name), (list, dict)) else F.from_json(F.lit(json.dumps(row[f.name])), f.dataType).alias(f.name) for f in g.nodes.schema]
    return Graph(g.nodes.unionByName(g.spark.range(1).select(*cols)), g.edges, g.profile)


def add_typed_edge(g: Graph, src: str, dst: str, kind: str, line: int | None = None, attrs: dict[str, str] | None = None) -> tuple[Graph, DataFrame]:
    """The graph with one more edge, and diagnostics(kind, payload) of what is wrong with it.

    An end that is no node, or an attribute that the kind must carry and does
    not, keeps the edge out; an edge between the same ends of the same kind
    stays as it is.
    """
    if kind not in g.profile.edge_kinds:
        raise ValueError(f"unknown edge kind: {kind}")
    e = g.spark.createDataFrame([(src, dst, kind, line, attrs)], schema.EDGES)
    kept, wrong = gate(e, g.profile)
    ids = g.nodes.select("id")
    lost = e.select(F.explode(F.array("src", "dst")).alias("id")).join(ids, "id", "left_anti").select(F.lit("UnknownSymbol").alias("kind"), F.to_json(F.struct("id")).alias("payload"))
    kept = kept.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    kept = kept.join(g.edges.select("src", "dst", "kind"), ["src", "dst", "kind"], "left_anti")
    return Graph(g.nodes, g.edges.unionByName(kept.select(*g.edges.columns)), g.profile), wrong.unionByName(lost)


def build(raw: Raw, profile: Profile = CODE) -> tuple[Graph, DataFrame]:
    """The graph, and diagnostics(seq, kind, payload) in order."""
    g, diagnostics = graph_of(raw, profile)
    return g, diagnostics()


def graph_of(raw: Raw, profile: Profile = CODE) -> tuple[Graph, Callable[[], DataFrame]]:
    """The graph, and what makes its diagnostics once they are asked for.

    A call's target follows from the caller's module and package, so a name is
    looked up once for each of them, and calls are read with their places only
    for the diagnostics of names that nothing bears and callers that are not there.
    """
    symbols, dup = definitions(raw)
    symbols = checkpointed(symbols)
    nodes, contains = scaffold(raw, symbols, profile)
    nodes = checkpointed(nodes)
    hosts = checkpointed(_hosts(raw, symbols))
    none = F.lit(None).cast("map<string,string>")
    ids = nodes.select("id")

    imp = import_targets(raw, nodes, symbols, profile)
    lost = imp.join(ids, imp["from_module_id"] == ids["id"], "left_anti").select("file_seq", F.col("seq").alias("sym_seq"), F.lit("UnknownSymbol").alias("kind"), F.to_json(F.struct(F.col("from_module_id").alias("id"))).alias("payload"))
    imp = imp.join(ids, imp["from_module_id"] == ids["id"], "left_semi").where("from_module_id <> target")
    bind = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("bindings", F.array().cast("array<string>"))))))
    imports = imp.groupBy(F.col("from_module_id").alias("src"), F.col("target").alias("dst")).agg(F.min("line").alias("line"), bind.alias("_b"))
    imports = imports.select("src", "dst", F.lit("imports").alias("kind"), "line", F.when(F.size("_b") > 0, F.create_map(F.lit("bindings"), F.to_json("_b"))).alias("attrs"))

    callers = ids.join(hosts, "id", "left").select(F.col("id").alias("from_id"), "module", "package", F.lit(True).alias("known"))
    # Shuffled by caller; the same partitions hold each pair.
    pairs = checkpointed(raw.calls.select("from_id", "to_name", "line").join(callers, "from_id", "left").groupBy("from_id", "to_name", "module", "package", "known").agg(F.min("line").alias("line")))
    asking = checkpointed(pairs.where("known").groupBy("module", "package", "to_name").agg(F.min("from_id").alias("from_id")))
    asking = asking.withColumn("rid", F.concat_ws("\x00", F.lit("c"), "from_id", "to_name"))
    names = symbols.select("id", "line", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(c, F.array().cast("array<string>")).alias("names")) for k, c in (("defines", "defines"), ("reads", "refs"), ("writes", "writes"))])).alias("x"))
    names = names.select(F.col("id").alias("from_id"), "line", "x.kind", F.explode("x.names").alias("name")).withColumn("rid", F.concat_ws("\x00", F.lit("n"), "from_id", "kind", "name"))
    her = raw.heritage.where("kind in ('inherits', 'implements')").withColumn("_r", F.concat_ws("/", "file_seq", "seq"))
    asked = union([
        asking.select("rid", "from_id", F.col("to_name").alias("name")), names.select("rid", "from_id", "name"),
        her.select(F.concat(F.lit("a"), "_r").alias("rid"), F.lit("").alias("from_id"), F.col("type_name").alias("name")),
        her.select(F.concat(F.lit("b"), "_r").alias("rid"), F.lit("").alias("from_id"), F.col("target_name").alias("name")),
    ])
    found = checkpointed(resolve(asked, nodes, hosts, profile).select("rid", "target"))

    answers = checkpointed(asking.join(found, "rid", "left").select(F.col("module").alias("_m"), F.col("package").alias("_p"), F.col("to_name").alias("_name"), "target"))
    same = F.col("to_name").eqNullSafe(F.col("_name")) & F.col("module").eqNullSafe(F.col("_m")) & F.col("package").eqNullSafe(F.col("_p"))
    called = pairs.where("known").join(answers, same).withColumn("dst", F.coalesce("target", F.concat(F.lit(profile.boundary_prefix), "to_name")))
    call_edges = called.groupBy(F.col("from_id").alias("src"), "dst").agg(F.min("line").alias("line")).select("src", "dst", F.lit("calls").alias("kind"), "line", none.alias("attrs"))
    ref_edges = names.join(found, "rid").where("target is not null").groupBy(F.col("from_id").alias("src"), F.col("target").alias("dst"), "kind").agg(F.min("line").alias("line")).select("src", "dst", "kind", "line", none.alias("attrs"))
    a = found.select(F.col("rid").alias("_a"), F.col("target").alias("src"))
    b = found.select(F.col("rid").alias("_b"), F.col("target").alias("dst"))
    h = her.join(a, F.concat(F.lit("a"), "_r") == F.col("_a")).join(b, F.concat(F.lit("b"), "_r") == F.col("_b")).where("src is not null and dst is not null and src <> dst")
    her_edges = h.groupBy("src", "dst", "kind").agg(F.min("line").alias("line")).select("src", "dst", "kind", "line", none.alias("attrs"))

    edges = union([contains, imports, call_edges, ref_edges, her_edges])
    edges, breaches = gate(checkpointed(edges), profile)
    stubs = edges.where(F.col("dst").startswith(profile.boundary_prefix)).select(F.col("dst").alias("id")).distinct().join(ids, "id", "left_anti")
    ext = stubs.withColumns({"kind": F.lit(profile.boundary_kind), "label": F.substring("id", len(profile.boundary_prefix) + 1, 1 << 30), "tier": profile.tier_of(F.lit(profile.boundary_kind))})
    g = Graph(checkpointed(nodes.unionByName(ext, allowMissingColumns=True)), edges, profile)

    def diagnostics() -> DataFrame:
        calls = raw.calls.select("file_seq", "seq", "from_id", "to_name", "line")
        early, late = [dup, lost], []
        strange = pairs.where("known is null").select(F.col("from_id").alias("_from")).distinct()
        if not strange.isEmpty():
            early.append(calls.join(strange, F.col("from_id").eqNullSafe(F.col("_from")), "left_semi").select("file_seq", F.col("seq").alias("sym_seq"), F.lit("UnknownSymbol").alias("kind"), F.to_json(F.struct(F.col("from_id").alias("id"))).alias("payload")))
        borne = answers.groupBy("_name").agg(F.count_if(F.col("target").isNull()).alias("no"), F.count("target").alias("yes")).where("no > 0")
        if not borne.isEmpty():
            asked = calls.join(borne.select("_name"), F.col("to_name").eqNullSafe(F.col("_name")), "left_semi")
            if not strange.isEmpty() or not borne.where("yes > 0").isEmpty():
                vain = called.where("target is null").select(F.col("from_id").alias("_from"), F.col("to_name").alias("_to"))
                asked = asked.join(vain, (F.col("from_id") == F.col("_from")) & F.col("to_name").eqNullSafe(F.col("_to")), "left_semi")
            late.append(_missed(asked))
        early = union(early).select(F.lit(0).alias("part"), F.concat(F.lpad(F.col("file_seq").cast("string"), 12, "0"), F.lit("/"), F.lpad(F.col("sym_seq").cast("string"), 12, "0")).alias("o"), "kind", "payload")
        rings = cycles(g).select(F.lit(3).alias("part"), F.array_join("members", "\x00").alias("o"), F.lit("Cycle").alias("kind"), F.to_json(F.struct("edge_kind", "members")).alias("payload"))
        wrong = breaches.select(F.lit(1).alias("part"), F.col("payload").alias("o"), "kind", "payload")
        return numbered(union([early, wrong, *late, rings]), ["part", "o", "kind", "payload"], "seq").select("seq", "kind", "payload")

    return g, diagnostics


def _missed(calls: DataFrame) -> DataFrame:
    """A diagnostic for each name that calls ask for in vain, of its first call."""
    first = calls.groupBy("to_name").agg(F.min(F.struct("file_seq", "seq", "from_id", "line")).alias("f")).select("to_name", "f.from_id", "f.line")
    return first.select(F.lit(2).alias("part"), F.struct("from_id", "to_name", F.lpad(F.col("line").cast("string"), 12, "0")).cast("string").alias("o"), F.lit("UnresolvedCall").alias("kind"), F.to_json(F.struct(F.col("from_id").alias("from"), F.col("to_name").alias("target"), "line")).alias("payload"))
