"""One entry for all queries on a graph, and questions in words."""

from __future__ import annotations

import inspect
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import build, schema, store
from .graph import Graph
from .operators import closure, communities, coupling, diff, history, layout, measures, topology
from .operators.project import projection
from .operators.rank import rank, rank_answer
from .sources import repo


def _found(rows: DataFrame, limit: int, expand: bool = False) -> dict:
    """The total first, then as many rows as asked for; expand lifts the limit."""
    rows = rows.cache()
    total = rows.count()
    if expand:
        return {"total": total, "truncated": False, "rows": rows}
    limit = measures.check_limit(limit)
    return {"total": total, "truncated": total > limit, "rows": rows.limit(limit)}


def _walk(f):
    return lambda g, node, limit=measures.LIMIT, expand=False: _found(f(g, node).orderBy("level", "id"), limit, expand)


def _rank(g, by, limit=measures.LIMIT):
    a = rank_answer(g, by, limit)
    return {"metric": by, "measured": a.measured, "total": a.total, "rows": a.rows, "reason": a.reason}


def _history(g, transactions=None, min_support=2, limit=measures.LIMIT):
    if transactions is None:
        return {"measured": False, "reason": "no change history was given"}
    functions = g.nodes.where(F.col("kind").isin("function", "method")).select("id", F.col("loc.file").alias("file"), "decisions")
    spots = history.hotspots(transactions, functions).orderBy(F.col("score").desc_nulls_last(), F.col("changes").desc(), "file")
    pairs = history.change_coupling(transactions, functions, min_support).orderBy(F.col("support").desc(), "a", "b")
    return {"measured": True, "hotspots": spots.limit(measures.check_limit(limit)), "coupling": pairs.limit(limit)}


def _communities(g):
    p = projection(g)
    labels = communities.communities(p).cache()
    return {"labels": labels, "summary": communities.summaries(p, labels).orderBy("community"), "modularity": communities.modularity(p, labels)}


def _render(g, kind="layered"):
    if kind == "force":
        got = layout.force(projection(g))
        return {"measured": got is not None, "rows": got}
    if kind == "clustered":
        rows = layout.clustered(g)
        size = rows.agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height")).first()
        return {"measured": True, "rows": rows, "width": size["width"] or 0, "height": size["height"] or 0}
    s = layout.structure(g)
    return {"measured": True, "rows": layout.layered(s.nodes.select("id"), s.edges.where("kind <> 'contains'").select("src", "dst").distinct())}


QUERIES = {
    "descendants": _walk(closure.descendants), "ancestors": _walk(closure.ancestors), "blast_radius": _walk(closure.blast_radius),
    "path": lambda g, a, b: closure.path(g, a, b), "neighborhood": lambda g, node, depth=1: measures.neighborhood(g, node, depth),
    "search": lambda g, query, limit=measures.LIMIT: measures.search(g, query, limit), "symbol": lambda g, node: measures.dossier(g, node),
    "stats": measures.stats, "rank": _rank, "metrics": lambda g: {"types": coupling.type_metrics(g), "cohesion": coupling.cohesion(g), "packages": coupling.package_metrics(g)},
    "history": _history, "communities": _communities, "topo_sort": lambda g, order="ready": topology.topo_sort(projection(g), order), "cycles": topology.cycles, "render": _render,
    "diff": lambda g, other: diff.answer(g, other), "snapshot": lambda g, audit=(), diagnostics=None: store.snapshot(g, audit, diagnostics),
    "diagnose_hotspot": lambda g, node, by="fan_in", diagnostics=None: diff.diagnose(g, rank(g, by), node, diagnostics),
    "schema": lambda g: {"node_kinds": g.profile.node_kinds, "edge_kinds": g.profile.edge_kinds, "queries": sorted(QUERIES), "commands": sorted(COMMANDS)},
}


def index(spark: SparkSession, root: str, path: str, name: str) -> dict:
    """Reads a source tree, builds its graph and stores it as a new generation; what was found, by number."""
    found = repo.with_packages(repo.files(spark, root), name)
    raw = repo.extract(found)
    g, diagnostics = build.build(raw)
    s = store.Store(spark, path)
    log = s.load_audit()
    generation = s.replace_graph(g, diagnostics, store.audit_append(log, "index", json.dumps({"root": root})))
    nodes, edges = s.counts()
    kinds = {r["kind"]: r["count"] for r in s.diagnostics().groupBy("kind").count().collect()}
    return {"generation": generation, "files": raw.files.count(), "symbols": raw.symbols.count(), "nodes": nodes, "edges": edges, "diagnostics": dict(sorted(kinds.items()))}


def verify(spark: SparkSession, path: str) -> dict:
    """Whether what is stored is what was written: the trail holds, ids are unique, links lead to nodes."""
    s = store.Store(spark, path)
    trail = store.audit_verify(spark.createDataFrame(s.load_audit(), schema.AUDIT)).first()
    g = s.load_graph()
    double = g.nodes.groupBy("id").count().where("count > 1").count()
    ids = g.nodes.select("id")
    loose = g.edges.select(F.explode(F.array("src", "dst")).alias("id")).join(ids, "id", "left_anti").count()
    return {"valid": bool(trail["valid"]) and not double and not loose, "entries": trail["entries"], "head": trail["head"], "repeated_ids": double, "loose_ends": loose, "format": s.meta().get("schema_version")}


#: What works on a folder of stored graphs, or makes one.
COMMANDS = {
    "index": index, "verify": verify, "diagnostics": lambda spark, path: store.Store(spark, path).diagnostics(),
    "restore": lambda spark, text, cert, key, now=None: store.restore_certified(spark, text, cert, key, now), "verify_proof": lambda spark, text, cert, key, now=None: {"wrong": store.verify_certificate(text, cert, key, now)},
}


def command(spark: SparkSession, op: str, **args):
    """Runs a command by name; unknown names and unknown arguments are refused."""
    if op not in COMMANDS:
        raise ValueError(f"unknown command: {op}")
    return _called(op, COMMANDS[op], spark, args)


def _called(op: str, f, first, args: dict):
    try:
        inspect.signature(f).bind(first, **args)
    except TypeError as e:
        raise ValueError(f"{op}: {e}") from None
    return f(first, **args)


def query(g: Graph, op: str, **args):
    """Runs a query by name; unknown names and unknown arguments are refused."""
    if op not in QUERIES:
        raise ValueError(f"unknown query: {op}")
    return _called(op, QUERIES[op], g, args)


#: What words ask for; the first that fits wins.
ROUTES = (
    (r"\b(?:rename|refactor|fix|change|edit|delete)\s", None),
    (r"(?:blast[ -]radius of|what breaks if)\s+(\S+)", lambda m: ("blast_radius", {"node": m[1]})),
    (r"path from\s+(\S+)\s+to\s+(\S+)", lambda m: ("path", {"a": m[1], "b": m[2]})),
    (r"(?:ancestors of|what depends on|who calls)\s+(\S+)", lambda m: ("ancestors", {"node": m[1]})),
    (r"(?:descendants of|what does)\s+(\S+)", lambda m: ("descendants", {"node": m[1]})),
    (r"(?:search for|find)\s+(\S+)", lambda m: ("search", {"query": m[1]})),
    (r"(?:most|top|rank)\D*(pagerank|betweenness|closeness|katz|eigenvector|complexity)", lambda m: ("rank", {"by": m[1]})),
    (r"most (?:used|called|depended)", lambda m: ("rank", {"by": "fan_in"})),
    (r"communit|cluster", lambda m: ("communities", {})),
    (r"cycle", lambda m: ("cycles", {})),
    (r"\border\b|topolog", lambda m: ("topo_sort", {})),
    (r"stats|overview|summari[sz]e|how many", lambda m: ("stats", {})),
)


def route(question: str) -> tuple[str, dict] | None:
    """The query a question asks for; None for none; requests to change something are refused."""
    for pattern, make in ROUTES:
        if m := re.search(pattern, question.strip().rstrip("?."), re.I):
            if make is None:
                raise PermissionError("questions only: nothing is changed here")
            return make(m)
    return None


def ask(g: Graph, question: str):
    found = route(question)
    if found is None:
        raise ValueError("no query fits the question")
    return query(g, found[0], **found[1])
