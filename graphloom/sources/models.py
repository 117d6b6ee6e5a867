"""Financial models as graphs: declared workbook cells, what they compute, where they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sheet import reads
from ..graph import Graph, union
from ..profile import RA

FORMAT = "graphloom.ra-decl/1"
S, D = T.StringType(), T.DoubleType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


CELL = _struct(kind=S, label=S, period=S, unit=S, presented_as=S, source=_struct(stub=S, label=S, source=S, as_of=S))
DECLARATION = _struct(
    format=S, model_id=S, artifact=S, label=S, tolerance=D,
    sheets=T.ArrayType(_struct(name=S, label=S, label_column=S, cells=T.MapType(S, CELL))),
    identities=T.ArrayType(_struct(name=S, rule_name=S, lhs=S, rhs=T.MapType(S, D), tolerance=D)),
    scenarios=T.ArrayType(_struct(name=S, label=S, binds=T.MapType(S, D))),
    estimates=T.ArrayType(T.StructType([T.StructField(x, S) for x in ("from", "to", "method", "window", "error")])),
    references=T.ArrayType(T.StructType([T.StructField(x, S) for x in ("from", "to", "claimant")])),
)


def declarations(texts: DataFrame) -> DataFrame:
    """One row per declaration text(text) of the known format; others are refused."""
    d = texts.select(F.from_json("text", DECLARATION, {"mode": "FAILFAST"}).alias("d")).select("d.*")
    return d.where(F.when(F.col("format") == FORMAT, F.lit(True)).otherwise(F.raise_error(F.lit(f"declaration format is not {FORMAT}")).cast("boolean")))


def declared_cells(decl: DataFrame) -> DataFrame:
    """(model, sheet, reference, kind, label, period, unit, presented_as, source)."""
    d = decl.select(F.col("model_id").alias("model"), F.explode("sheets").alias("s")).select("model", F.col("s.name").alias("sheet"), F.explode("s.cells").alias("reference", "c"))
    return d.select("model", "sheet", "reference", "c.*")


def unaccounted(cells: DataFrame, decl: DataFrame) -> DataFrame:
    """(model, sheet, reference, problem): undeclared cells other than label columns, and declared ones that are not there. Must be empty."""
    want = declared_cells(decl).select("model", "sheet", "reference")
    label = decl.select(F.col("model_id").alias("model"), F.explode("sheets").alias("s")).select("model", F.col("s.name").alias("sheet"), F.upper("s.label_column").alias("_l"))
    have = cells.join(label, ["model", "sheet"], "left").where(~F.coalesce(F.regexp_extract("reference", "^([A-Z]+)", 1) == F.col("_l"), F.lit(False))).select("model", "sheet", "reference")
    extra = have.join(want, ["model", "sheet", "reference"], "left_anti").withColumn("problem", F.lit("undeclared"))
    gone = want.join(cells, ["model", "sheet", "reference"], "left_anti").withColumn("problem", F.lit("missing"))
    return extra.unionByName(gone)


def _id(*parts) -> Column:
    return F.concat_ws("::", *parts)


def _attrs(**cols) -> Column:
    pairs = F.map_from_arrays(F.array(*map(F.lit, cols)), F.array(*cols.values()))
    kept = F.map_filter(pairs, lambda k, v: v.isNotNull())
    return F.when(F.size(kept) > 0, kept)


def model_graph(cells: DataFrame, decl: DataFrame, evaluated: DataFrame, scenario: str = "") -> tuple[Graph, DataFrame]:
    """A model's graph under one scenario, and diagnostics(kind, payload) of outputs that are declared twice.

    Cells are known as model::sheet::A1. A value that could not be computed is
    an absent measure.
    """
    none = lambda t: F.lit(None).cast(t)
    c = declared_cells(decl).withColumns({"id": _id("model", "sheet", "reference"), "at": F.concat("sheet", F.lit("!"), "reference")})
    v = evaluated.where(F.col("scenario") == scenario).select("model", "sheet", "reference", "value")
    f = cells.select("model", "sheet", "reference", "formula")
    c = c.join(v, ["model", "sheet", "reference"], "left").join(f, ["model", "sheet", "reference"], "left")
    empty = none("map<string,string>")

    def node(df: DataFrame, id, kind, label, measures=empty) -> DataFrame:
        return df.select(id.alias("id"), kind.alias("kind"), label.alias("label"), none("int").alias("decisions"), none("array<string>").alias("refs"), measures.alias("measures"))

    model = decl.select(F.col("model_id").alias("model"), "label")
    sheets = decl.select(F.col("model_id").alias("model"), F.explode("sheets").alias("s"))
    runs = decl.select(F.col("model_id").alias("model"), F.explode("scenarios").alias("s"))
    measures = _attrs(value=F.col("value").cast("string"), formula=F.col("formula"), unit=F.col("unit"), period=F.col("period"))
    periods = c.where("period is not null").select("model", "period").distinct()
    src = c.where("source is not null")
    nodes = union([
        node(model, F.col("model"), F.lit("model"), F.col("label")), node(sheets, _id("model", "s.name"), F.lit("statement"), F.col("s.label")),
        node(c, F.col("id"), F.col("kind"), F.col("label"), measures), node(periods, _id("model", F.lit("period"), "period"), F.lit("period"), F.col("period")),
        node(runs, _id("model", F.lit("scenario"), "s.name"), F.lit("scenario"), F.col("s.label")), node(src, F.concat(F.lit(RA.boundary_prefix), "source.stub"), F.lit("source"), F.col("source.label")).dropDuplicates(["id"]),
    ])

    def edge(df: DataFrame, a, b, kind: str, attrs=empty) -> DataFrame:
        return df.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("kind"), none("int").alias("line"), attrs.alias("attrs"))

    ids = c.select("model", "at", "id")
    by_ref = lambda df, a, b: df.join(ids.select("model", F.col("at").alias(a), F.col("id").alias("_a")), ["model", a]).join(ids.select("model", F.col("at").alias(b), F.col("id").alias("_b")), ["model", b])
    terms = decl.select(F.col("model_id").alias("model"), F.explode("identities").alias("i")).select("model", F.col("i.lhs").alias("y"), F.explode("i.rhs").alias("x", "sign"))
    binds = runs.select("model", "s.name", F.explode("s.binds").alias("at", "value")).join(ids, ["model", "at"])
    est = decl.select(F.col("model_id").alias("model"), F.explode("estimates").alias("e")).select("model", F.col("e.from").alias("x"), F.col("e.to").alias("y"), "e.method", "e.window", "e.error")
    ref = decl.select(F.col("model_id").alias("model"), F.explode("references").alias("e")).select("model", F.col("e.from").alias("x"), F.col("e.to").alias("y"), "e.claimant")
    edges = union([
        edge(sheets, F.col("model"), _id("model", "s.name"), "contains"), edge(c, _id("model", "sheet"), F.col("id"), "contains"),
        edge(periods, F.col("model"), _id("model", F.lit("period"), "period"), "contains"), edge(runs, F.col("model"), _id("model", F.lit("scenario"), "s.name"), "contains"),
        edge(src, F.col("id"), F.concat(F.lit(RA.boundary_prefix), "source.stub"), "sourced_from", _attrs(source=F.col("source.source"), as_of=F.col("source.as_of"))),
        edge(by_ref(reads(cells).select("model", F.col("src").alias("x"), F.col("dst").alias("y")), "x", "y"), F.col("_a"), F.col("_b"), "computes_into"),
        edge(by_ref(terms, "x", "y"), F.col("_a"), F.col("_b"), "articulates"),
        edge(binds, _id("model", F.lit("scenario"), "name"), F.col("id"), "assumes"),
        edge(by_ref(est, "x", "y"), F.col("_a"), F.col("_b"), "estimates", _attrs(method=F.col("method"), window=F.col("window"), error=F.col("error"))),
        edge(by_ref(ref, "x", "y"), F.col("_a"), F.col("_b"), "references", _attrs(claimant=F.col("claimant"))),
    ]).dropDuplicates(["src", "dst", "kind"])
    twice = c.where("kind = 'output'").groupBy("model", "label").agg(F.array_sort(F.collect_list("id")).alias("locations")).where(F.size("locations") > 1)
    return Graph(nodes, edges, RA), twice.select(F.lit("MultiDefinition").alias("kind"), F.to_json(F.struct("model", "label", "locations")).alias("payload"))
