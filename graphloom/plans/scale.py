"""The graph that published timings are given for: one call chain through all files, made as raw rows.

File i has two functions, step and help. A step calls the next file's step and
its own help, every 997th also the step 997 files back, which makes one large
cycle. Every file imports the next one's module, three of five under a name
that nothing here bears. 10,000 files give 46,001 nodes and 90,017 edges.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .. import build, schema
from ..graph import Graph, union
from ..operators import centrality, closure, communities, measures, topology
from ..operators.project import projection

BACK = 997


def raw(spark: SparkSession, files: int = 10_000) -> build.Raw:
    i = F.col("id")
    name = lambda kind, n: F.concat(F.lit(kind), F.lpad(n.cast("string"), 5, "0"))
    module = lambda n: F.concat(F.lit("scale::dir"), F.lpad(F.floor(n / 100).cast("string"), 4, "0"), F.lit("::"), name("file", n))
    base = spark.range(files).select("id", F.lit("scale").alias("package"), F.concat(F.lit("dir"), F.lpad(F.floor(i / 100).cast("string"), 4, "0"), F.lit("/"), name("file", i), F.lit(".x")).alias("file"), module(i).alias("module_id"), i.alias("file_seq"))
    called = F.array_compact(F.array(F.when(i + 1 < files, name("step", i + 1)), F.when((i >= BACK) & (i % BACK == 0), name("step", i - BACK)), name("help", i)))
    none = F.array().cast("array<string>")

    def symbol(kind: str, seq: int, refs):
        row = {"sym_seq": F.lit(seq), "id": F.concat("module_id", F.lit("::"), name(kind, i)), "kind": F.lit("function"), "label": name(kind, i), "line": F.lit(seq + 1), "column": F.lit(1), "defines": none, "refs": refs, "writes": none, "decisions": F.lit(0)}
        return base.select(*[(row.get(f.name, F.col(f.name) if f.name in base.columns else F.lit(None))).cast(f.dataType).alias(f.name) for f in schema.SYMBOLS])

    symbols = union([symbol("step", 0, called), symbol("help", 1, none)])
    calls = base.select("file_seq", F.posexplode(called).alias("seq", "to_name"), F.concat("module_id", F.lit("::"), name("step", i)).alias("from_id")).select("file_seq", "seq", "from_id", "to_name", F.lit(1).alias("line"))
    target = F.when(i % 5 < 3, F.concat(F.lit("external::gone"), i)).otherwise(module(i + 1))
    imports = base.where((i + 1 < files) | (i % 5 < 3)).select("file_seq", F.lit(0).alias("seq"), F.col("module_id").alias("from_module_id"), target.alias("to_module_id"), none.alias("bindings"), F.lit(1).alias("line"))
    return build.Raw(base.select("package", "file", "module_id", "file_seq"), symbols, imports, calls, spark.createDataFrame([], schema.HERITAGE))


def timed(spark: SparkSession, files: int = 10_000):
    """(name, what to run) one after the other; the graph is built by the first."""
    g: dict[str, Graph] = {}
    head, tail = "scale::dir0000::file00000::step00000", f"scale::dir{(files - 1) // 100:04d}::file{files - 1:05d}::step{files - 1:05d}"

    def make():
        g["g"], _ = build.build(raw(spark, files))
        return g["g"].edges

    of = lambda f: lambda: f(g["g"])
    yield "base_build", make
    yield "base_stats", of(measures.stats)
    yield "base_descendants", of(lambda x: closure.descendants(x, head))
    yield "base_blast_radius", of(lambda x: closure.blast_radius(x, tail))
    yield "base_path", of(lambda x: closure.path(x, head, tail))
    yield "base_pagerank", of(lambda x: centrality.pagerank(projection(x)))
    yield "base_katz", of(lambda x: centrality.katz(projection(x)))
    yield "base_communities", of(lambda x: communities.communities(projection(x)))
    yield "base_topo_sort", of(lambda x: topology.topo_sort(projection(x)))
