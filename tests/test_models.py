"""A declared workbook as a graph."""

import json

import pytest
from graphloom import build, schema
from graphloom.functions import sheet
from graphloom.profile import RA
from graphloom.sources import models

DECL = {
    "format": models.FORMAT, "model_id": "m", "artifact": "f.xlsx", "label": "Model", "tolerance": 0.01,
    "sheets": [{"name": "v", "label": "Valuation", "label_column": "A", "cells": {
        "B1": {"kind": "driver", "label": "growth", "source": {"stub": "filing", "label": "10-K", "source": "url", "as_of": "2026"}},
        "B2": {"kind": "line_item", "label": "revenue", "period": "FY1", "unit": "USD"}, "B3": {"kind": "output", "label": "value"}, "B4": {"kind": "output", "label": "value"}}}],
    "identities": [{"name": "i", "lhs": "v!B3", "rhs": {"v!B2": 1.1}}],
    "scenarios": [{"name": "bull", "label": "Bull", "binds": {"v!B1": 0.3}}],
    "estimates": [{"from": "v!B2", "to": "v!B4", "method": "fit", "window": "5y"}],
    "references": [{"from": "v!B4", "to": "v!B3", "claimant": "analyst"}],
}


def cells(spark, odd=()):
    rows = [("A1", None, None, "growth"), ("B1", None, 0.1, None), ("B2", None, 100.0, None), ("B3", "=B2*(1+B1)", None, None), ("B4", "=B3/0", None, None), *odd]
    return spark.createDataFrame([("m", "v", r, 1, 1, f, n, t, None, None) for r, f, n, t in rows], schema.CELLS)


def test_model_graph(spark):
    decl = models.declarations(spark.createDataFrame([(json.dumps(DECL),)], "text string"))
    c = cells(spark)
    g, twice = models.model_graph(c, decl, sheet.evaluate(c))
    nodes = {r["id"]: r for r in g.nodes.collect()}
    assert nodes["m"]["kind"] == "model" and nodes["source::filing"]["kind"] == "source" and nodes["m::period::FY1"]["label"] == "FY1"
    assert float(nodes["m::v::B3"]["measures"]["value"]) == pytest.approx(110) and "value" not in nodes["m::v::B4"]["measures"]
    e = {(r["src"], r["dst"], r["kind"]) for r in g.edges.collect()}
    assert {("m::v::B1", "m::v::B3", "computes_into"), ("m::v::B2", "m::v::B3", "articulates"), ("m::scenario::bull", "m::v::B1", "assumes"), ("m::v::B1", "source::filing", "sourced_from"), ("m::v::B2", "m::v::B4", "estimates")} <= e
    assert json.loads(twice.first()["payload"])["locations"] == ["m::v::B3", "m::v::B4"]
    kept, bad = build.gate(g.edges, RA)
    assert [json.loads(r["payload"])["missing"] for r in bad.collect()] == [["error"]] and kept.count() == g.edges.count() - 1


def test_strict_accounting(spark):
    decl = models.declarations(spark.createDataFrame([(json.dumps(DECL),)], "text string"))
    assert models.unaccounted(cells(spark), decl).count() == 0
    got = models.unaccounted(cells(spark, [("C9", None, 1.0, None)]).where("reference <> 'B2'"), decl).collect()
    assert {(r["reference"], r["problem"]) for r in got} == {("C9", "undeclared"), ("B2", "missing")}
    with pytest.raises(Exception, match="format"):
        models.declarations(spark.createDataFrame([('{"format": "x"}',)], "text string")).collect()


def test_many_models_share_a_call_and_their_formulas(spark):
    from graphloom.functions import sheet

    rows = [(str(m), "v", r, f, n, None) for m in range(50) for r, f, n in (("A1", None, float(m)), ("B1", "=A1*2", None), ("C1", "=1+", None), ("D1", "=C1", None))]
    cells = spark.createDataFrame(rows, "model string, sheet string, reference string, formula string, number double, text string")
    got = sheet.evaluate(cells)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan
    have = {(r["model"], r["reference"]): (r["value"], r["error"]) for r in got.collect()}
    assert have == {(str(m), c): x for m in range(50) for c, x in (("A1", (float(m), None)), ("B1", (2.0 * m, None)), ("C1", (None, "Parse")), ("D1", (None, "AbsentInput")))}
