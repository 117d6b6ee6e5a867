"""What keeps disk and shuffles small, on small tables, and that the results stay what the SQL says."""

import duckdb
from graphloom import views
from graphloom.operators import measures

DIR = "/root/testdata/sf0.001"


def _odd(tmp_path) -> str:
    """Orders without lines, lines without orders, rows twice, an order of two customers, null keys."""
    c, out = duckdb.connect(), tmp_path / "odd"
    out.mkdir()
    for t in "nation customer supplier part orders lineitem events".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    odd = {
        "orders": "SELECT * FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT * REPLACE (o_custkey + 1 AS o_custkey) FROM orders WHERE o_orderkey % 7 = 1",
        "lineitem": "SELECT * FROM lineitem WHERE l_orderkey % 3 <> 0 UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 4 = 1 UNION ALL SELECT * REPLACE (NULL AS l_suppkey) FROM lineitem WHERE l_orderkey % 11 = 1",
        "events": "SELECT * FROM events UNION ALL SELECT * REPLACE (user_id + 1 AS user_id) FROM events WHERE event_id % 9 = 0",
    }
    for t in "nation customer supplier part orders lineitem events".split():
        c.execute(f"COPY ({odd.get(t, f'SELECT * FROM {t}')}) TO '{out}/{t}.parquet'")
    return str(out)


def test_views_are_their_sql_and_compressed(spark, tmp_path):
    sf, c = _odd(tmp_path), duckdb.connect()
    for t in "nation customer supplier part orders lineitem events".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for view, parts in ((views.trade, views.TRADE), (views.journeys, views.JOURNEYS)):
        g = view(spark, sf)
        for name, cols in (("nodes", ["id", "kind", "label", "decisions"]), ("edges", ["src", "dst", "kind", "line"])):
            want = c.execute(f"WITH {views.sql_of(parts)} SELECT {', '.join(cols)} FROM {name}").fetchall()
            df = getattr(g, name).select(*cols)
            assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))
            assert all(f.endswith(".zstd.parquet") for f in df.inputFiles())


def test_unresolved_does_not_shuffle_the_edges(spark):
    g = views.trade(spark, DIR)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")
    try:
        df = measures.unresolved(g)
        assert "SortMergeJoin" not in df._jdf.queryExecution().toString()
        assert df.count() == g.edges.where("dst like 'external::%'").select("src").distinct().count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_closeness_walks_many_starts_at_once(spark):
    """Distances of plain walks, on a dense graph and a chain; few bytes of starts are not put into one task."""
    import random

    import numpy as np
    from graphloom.graph import dealt
    from graphloom.operators import centrality
    from graphloom.operators.closure import Adjacency

    rnd = random.Random(5)
    for n, links in ((150, {(rnd.randrange(150), rnd.randrange(150)) for _ in range(400)}), (200, {(i, i + 1) for i in range(199)})):
        links = sorted((a, b) for a, b in links if a != b)
        graph = Adjacency(np.array([f"n{i:03}" for i in range(n)], dtype=object), np.array([a for a, _ in links]), np.array([b for _, b in links]))
        r, s = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        centrality._distances(graph, list(range(n)), r, s)
        walks = [graph.walk(i) for i in range(n)]
        assert r.tolist() == [sum(i in w and i != j for j, w in enumerate(walks)) for i in range(n)]
        assert s.tolist() == [sum(w.get(i, 0) for w in walks) for i in range(n)]
    some = spark.range(40).selectExpr("cast(id as string) as id")
    assert dealt(some, "id").mapInPandas(lambda b: b, "id string").rdd.getNumPartitions() > 1


def test_stored_tables_are_compressed_and_inserts_take_first_rows(spark, tmp_path):
    from graphloom.graph import Graph
    from graphloom.store import Store

    nodes = lambda rows: spark.createDataFrame(rows, "id string, kind string, label string").coalesce(1)
    edges = lambda rows: spark.createDataFrame(rows, "src string, dst string, kind string, line int").coalesce(1)
    s = Store(spark, str(tmp_path / "store"))
    s.replace_graph(Graph(nodes([("a", "function", "old")]), edges([("a", "a", "calls", 1)])))
    assert s.insert_graph(Graph(nodes([("a", "function", "new"), ("b", "function", "first"), ("b", "function", "second")]), edges([("a", "a", "calls", 9), ("b", "a", "calls", 7), ("b", "a", "calls", 3)]))) == (1, 1)
    g = s.load_graph()
    assert sorted((r["id"], r["label"]) for r in g.nodes.collect()) == [("a", "old"), ("b", "first")]
    assert sorted((r["src"], r["line"]) for r in g.edges.collect()) == [("a", 1), ("b", 7)]
    assert all(f.endswith(".zstd.parquet") for f in [*g.nodes.inputFiles(), *g.edges.inputFiles()])
