"""Registered queries against their SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import __spark_entry__
import duckdb
import pytest
from graphloom.plans import queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in Path(DIR).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", "stats rank_fan_in rank_blast_radius search metrics_packages metrics_cohesion history_coupling descendants path_checked rank_pagerank rank_eigenvector rank_betweenness rank_blast_radius_waves rank_closeness rank_closeness_waves rank_betweenness_waves diagnose_hotspot strong_components cycles topo_sort_checked topo_layers modularity build_imports diagnostics_planted document_sentences document_graph filed_rollforward filed_balance sheet_values sheet_reads model_graphs audit_trail structure git_log layout_layered layout_clustered asked_in_words".split())
def test_against_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, DIR)
    want = duck.sql(queries.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = sorted(str(tuple(r[c] for c in cols)) for r in got.collect())
    assert rows == sorted(str(tuple(r[want.columns.index(c)] for c in cols)) for r in want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_beyond_the_ceiling_is_marked_as_not_measured(spark, monkeypatch):
    """Each query declines on its own: a graph of two parts, so that its components are too many as well."""
    from graphloom.graph import Graph
    from graphloom.operators import centrality, layout
    from graphloom.plans import queries

    nodes = spark.createDataFrame([("a", "function"), ("b", "function")], "id string, kind string")
    edges = spark.createDataFrame([], "src string, dst string, kind string, line int")
    monkeypatch.setattr(queries.views, "followers", lambda spark, sf: Graph(nodes, edges))
    sf = "/root/testdata/sf0.001"
    assert queries.rank_betweenness(spark, sf).count() == 2 and queries.layout_force(spark, sf).count() == 2
    monkeypatch.setattr(centrality, "BETWEENNESS_NODES", 1)
    assert [tuple(r) for r in queries.rank_betweenness(spark, sf).collect()] == [(None, None)]
    monkeypatch.setattr(layout, "FORCE_NODES", 1)
    assert [tuple(r) for r in queries.layout_force(spark, sf).collect()] == [(None, None, None)]
