"""Graphs over the driver's tables, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import Graph, checkpointed, dropped, freed, shared_folder

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Regions, nations, customers, suppliers, orders, parts and brands as a code graph, table by table.
TRADE = {
    "places": "SELECT n_nationkey AS nk, concat('r', n_regionkey) AS package, concat('r', n_regionkey, '::n', n_nationkey) AS module FROM nation",
    "cust": "SELECT c_custkey AS ck, c_name AS label, module, concat(module, '::c', c_custkey) AS id FROM customer JOIN places ON c_nationkey = nk",
    "supp": "SELECT s_suppkey AS sk, s_name AS label, module, concat(module, '::s', s_suppkey) AS id FROM supplier JOIN places ON s_nationkey = nk",
    "lines": "SELECT l_orderkey AS ok, l_partkey AS pk, l_suppkey AS sk, min(l_linenumber) AS line, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey",
    "ords": "SELECT o.o_orderkey AS ok, o.o_orderstatus AS status, cust.id AS owner, concat(cust.id, '::o', o.o_orderkey) AS id FROM orders o JOIN cust ON o.o_custkey = cust.ck",
    "lengths": "SELECT ok, sum(n) AS n FROM lines GROUP BY ok",
    "sold": "SELECT ords.id AS oid, lines.pk, lines.sk, lines.line FROM lines JOIN ords ON lines.ok = ords.ok",
    "offers": "SELECT pairs.pk, pairs.sk, supp.id AS owner, concat(supp.id, '::p', pairs.pk) AS id FROM (SELECT DISTINCT pk, sk FROM lines) pairs JOIN supp ON pairs.sk = supp.sk",
    "nodes": """SELECT DISTINCT package AS id, 'package' AS kind, package AS label, CAST(NULL AS INT) AS decisions FROM places
  UNION ALL SELECT module, 'module', module, CAST(NULL AS INT) FROM places
  UNION ALL SELECT id, 'class', label, CAST(NULL AS INT) FROM cust
  UNION ALL SELECT id, 'interface', label, CAST(NULL AS INT) FROM supp
  UNION ALL SELECT ords.id, 'method', concat('o', ords.ok), CASE WHEN status <> 'P' THEN CAST(coalesce(lengths.n, 0) AS INT) END FROM ords LEFT JOIN lengths ON ords.ok = lengths.ok
  UNION ALL SELECT id, 'method', concat('p', pk), CAST(NULL AS INT) FROM offers
  UNION ALL SELECT concat('part::p', p_partkey), 'variable', concat('p', p_partkey), p_size FROM part
  UNION ALL SELECT DISTINCT concat('external::', p_brand), 'external', p_brand, CAST(NULL AS INT) FROM part""",
    "edges": """SELECT package AS src, module AS dst, 'contains' AS kind, CAST(NULL AS INT) AS line FROM places
  UNION ALL SELECT module, id, 'contains', CAST(NULL AS INT) FROM cust
  UNION ALL SELECT module, id, 'contains', CAST(NULL AS INT) FROM supp
  UNION ALL SELECT owner, id, 'contains', CAST(NULL AS INT) FROM ords
  UNION ALL SELECT owner, id, 'contains', CAST(NULL AS INT) FROM offers
  UNION ALL SELECT sold.oid, concat(supp.id, '::p', sold.pk), 'calls', sold.line FROM sold JOIN supp ON sold.sk = supp.sk
  UNION ALL SELECT oid, concat('part::p', pk), 'writes', min(line) FROM sold GROUP BY oid, pk
  UNION ALL SELECT id, concat('part::p', pk), 'reads', CAST(NULL AS INT) FROM offers
  UNION ALL SELECT concat('part::p', p_partkey), concat('external::', p_brand), 'references', CAST(NULL AS INT) FROM part""",
}

#: Who bought after whom on the same day: one node per user, one link per pair; all purchases, each day in order.
FOLLOWERS = {
    "steps": "SELECT lag(user_id) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS a, user_id AS b FROM events WHERE event_type = 'purchase'",
    "edges": "SELECT DISTINCT concat('u::', a) AS src, concat('u::', b) AS dst, 'calls' AS kind, CAST(NULL AS INT) AS line FROM steps WHERE a IS NOT NULL AND a <> b",
    "nodes": "SELECT DISTINCT concat('u::', user_id) AS id, 'function' AS kind, concat('u', user_id) AS label, CAST(NULL AS INT) AS decisions FROM events",
}

#: All events as nodes: each leads to the user's next one, a signup or a view also back to the one before,
#: and the last of a day to the first of the next user on the day after. Users only lead to larger ones.
JOURNEYS = {
    "seen": "SELECT user_id AS u, event_type AS t, CAST(ts AS DATE) AS d, ts, event_id AS e, concat('u', user_id, '::e', event_id) AS id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events",
    "edges_": "SELECT concat('u', u, '::e', before) AS src, id AS dst FROM seen WHERE before IS NOT NULL UNION ALL SELECT id, concat('u', u, '::e', before) FROM seen WHERE before IS NOT NULL AND t IN ('signup', 'view')",
    "ends": "SELECT u, d, id FROM (SELECT u, d, id, row_number() OVER (PARTITION BY u, d ORDER BY ts DESC, e DESC) AS n FROM seen) x WHERE n = 1",
    "begins": "SELECT u, d, id FROM (SELECT u, d, id, row_number() OVER (PARTITION BY u, d ORDER BY ts, e) AS n FROM seen) x WHERE n = 1",
    "edges": "SELECT src, dst, 'calls' AS kind, CAST(NULL AS INT) AS line FROM edges_ UNION ALL SELECT x.id, y.id, 'calls', CAST(NULL AS INT) FROM ends x JOIN begins y ON y.u = x.u + 1 AND y.d = x.d + INTERVAL 1 DAY",
    "nodes": "SELECT id, 'function' AS kind, t AS label, CAST(NULL AS INT) AS decisions FROM seen",
}

#: How Spark makes the same two tables: lines are shuffled once, by order, and as numbers; names are spelled where a row is written.
#: `base` has each order with its lines, or alone; of the lines of an order and part one is `first`, of an order's one is `head`.
_SUPP = "/*+ BROADCAST(supp) */"
TRADE_MADE = {
    "places": TRADE["places"],
    "cust": TRADE["cust"],
    "supp": TRADE["supp"],
    "lines": "SELECT ok, pk, sk, line, sum(n) OVER (PARTITION BY ok) AS total FROM (SELECT ok, pk, sk, min(l_linenumber) AS line, count(*) AS n FROM (SELECT /*+ REPARTITION(ok) */ l_orderkey AS ok, l_partkey AS pk, l_suppkey AS sk, l_linenumber FROM lineitem WHERE l_orderkey IS NOT NULL) x GROUP BY ok, pk, sk) y",
    "ords": "SELECT o.o_orderkey AS ok, o.o_orderstatus AS status, cust.id AS owner, monotonically_increasing_id() AS nth FROM orders o JOIN cust ON o.o_custkey = cust.ck",
    "base": """SELECT ok, status, owner, pk, sk, line, total, row_number() OVER (PARTITION BY ok, nth ORDER BY pk, sk) = 1 AS head, total IS NOT NULL AND row_number() OVER (PARTITION BY ok, owner, pk ORDER BY line NULLS LAST) = 1 AS first
  FROM (SELECT ords.ok, status, owner, nth, pk, sk, line, total FROM ords LEFT JOIN lines ON ords.ok = lines.ok) x""",
    "offers": "SELECT DISTINCT sk, pk FROM (SELECT /*+ REPARTITION_BY_RANGE(sk, pk) */ l_suppkey AS sk, l_partkey AS pk FROM lineitem WHERE l_suppkey IS NOT NULL) x SORT BY sk, pk",
    "nodes": f"""SELECT DISTINCT package AS id, 'package' AS kind, package AS label, CAST(NULL AS INT) AS decisions FROM places
  UNION ALL SELECT module, 'module', module, CAST(NULL AS INT) FROM places
  UNION ALL SELECT id, 'class', label, CAST(NULL AS INT) FROM cust
  UNION ALL SELECT id, 'interface', label, CAST(NULL AS INT) FROM supp
  UNION ALL SELECT concat(owner, '::o', ok), 'method', concat('o', ok), CASE WHEN status <> 'P' THEN CAST(coalesce(total, 0) AS INT) END FROM base WHERE head
  UNION ALL SELECT {_SUPP} concat(supp.id, '::p', pk), 'method', concat('p', pk), CAST(NULL AS INT) FROM offers JOIN supp ON offers.sk = supp.sk
  UNION ALL SELECT concat('part::p', p_partkey), 'variable', concat('p', p_partkey), p_size FROM part
  UNION ALL SELECT DISTINCT concat('external::', p_brand), 'external', p_brand, CAST(NULL AS INT) FROM part""",
    "edges": f"""SELECT package AS src, module AS dst, 'contains' AS kind, CAST(NULL AS INT) AS line FROM places
  UNION ALL SELECT module, id, 'contains', CAST(NULL AS INT) FROM cust
  UNION ALL SELECT module, id, 'contains', CAST(NULL AS INT) FROM supp
  UNION ALL SELECT owner, concat(owner, '::o', ok), 'contains', CAST(NULL AS INT) FROM base WHERE head
  UNION ALL SELECT {_SUPP} supp.id, concat(supp.id, '::p', pk), 'contains', CAST(NULL AS INT) FROM offers JOIN supp ON offers.sk = supp.sk
  UNION ALL SELECT {_SUPP} concat(owner, '::o', ok), concat(supp.id, '::p', pk), 'calls', line FROM base JOIN supp ON base.sk = supp.sk WHERE total IS NOT NULL
  UNION ALL SELECT concat(owner, '::o', ok), concat('part::p', pk), 'writes', line FROM base WHERE first
  UNION ALL SELECT {_SUPP} concat(supp.id, '::p', pk), concat('part::p', pk), 'reads', CAST(NULL AS INT) FROM offers JOIN supp ON offers.sk = supp.sk
  UNION ALL SELECT concat('part::p', p_partkey), concat('external::', p_brand), 'references', CAST(NULL AS INT) FROM part""",
}

#: The events are shuffled once, by user; which of them begin and end a day is found on the way.
JOURNEYS_MADE = {
    "seen": """SELECT u, t, d, e, prior, row_number() OVER (PARTITION BY u, d ORDER BY ts DESC, e DESC) = 1 AS ends, row_number() OVER (PARTITION BY u, d ORDER BY ts, e) = 1 AS begins
  FROM (SELECT user_id AS u, event_type AS t, CAST(ts AS DATE) AS d, ts, event_id AS e, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prior FROM events) x""",
    "edges": """SELECT concat('u', u, '::e', prior) AS src, concat('u', u, '::e', e) AS dst, 'calls' AS kind, CAST(NULL AS INT) AS line FROM seen WHERE prior IS NOT NULL
  UNION ALL SELECT concat('u', u, '::e', e), concat('u', u, '::e', prior), 'calls', CAST(NULL AS INT) FROM seen WHERE prior IS NOT NULL AND t IN ('signup', 'view')
  UNION ALL SELECT concat('u', x.u, '::e', x.e), concat('u', y.u, '::e', y.e), 'calls', CAST(NULL AS INT) FROM (SELECT u, d, e FROM seen WHERE ends) x JOIN (SELECT u, d, e FROM seen WHERE begins) y ON y.u = x.u + 1 AND y.d = x.d + INTERVAL 1 DAY""",
    "nodes": "SELECT concat('u', u, '::e', e) AS id, 'function' AS kind, t AS label, CAST(NULL AS INT) AS decisions FROM seen",
}

#: Suppliers up to which their names are sent to all tasks that spell an offer.
SENT_ROWS = 500_000
#: Tables that several others are built from: written while a graph is made, so that they are made once.
SHARED = ("base", "offers", "seen")
#: Finished graphs of this process by application, folder and view: their nodes and edges, written to the shared folder.
_MADE: dict[tuple, tuple[DataFrame, DataFrame]] = {}


def sql_of(parts: dict[str, str]) -> str:
    """The tables as common table expressions for another SQL engine."""
    return ", ".join(f"{name} AS MATERIALIZED ({text})" for name, text in parts.items())


def register(spark: SparkSession, sf_dir: str, tables: list[str]) -> None:
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def _graph(spark: SparkSession, sf_dir: str, parts: dict[str, str], tables: list[str]) -> Graph:
    """Made once for a session and folder; afterwards a query starts from two written tables, not from the view's plan.

    While it is made its tables have names of their own, so no view of the user's is touched.
    """
    key = (spark.sparkContext.applicationId, sf_dir, *parts)
    if key not in _MADE:
        mark = f"graphloom_{uuid.uuid4().hex[:8]}_"
        named = re.compile(rf"\b(?:{'|'.join([*parts, *tables])})\b(?!::)")
        kept, made = [], {}
        try:
            for t in tables:
                spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(mark + t)
            few = "supplier" not in tables or spark.table(f"{mark}supplier").count() <= SENT_ROWS
            for name, text in parts.items():
                df = spark.sql(named.sub(lambda m: mark + m[0], text if few else text.replace(_SUPP, "")))
                if name in SHARED:
                    kept.append(df := checkpointed(df))
                    freed(spark)
                df.createOrReplaceTempView(mark + name)
                if name in ("nodes", "edges"):
                    path = f"{shared_folder(spark)}/graphloom/{mark}{name}"
                    df.write.option("compression", "zstd").parquet(path)
                    made[name] = spark.read.schema(df.schema).parquet(path)
        finally:
            for name in [*tables, *parts]:
                spark.catalog.dropTempView(mark + name)
            dropped(*kept)
        # What the view was made with is not beside what a query writes.
        kept.clear()
        df = None
        freed(spark)
        _MADE[key] = made["nodes"], made["edges"]
    nodes, edges = _MADE[key]
    none = F.lit(None)
    nodes = nodes.withColumns({"refs": none.cast("array<string>"), "measures": none.cast("map<string,string>")})
    return Graph(nodes, edges.withColumn("attrs", none.cast("map<string,string>")))


def trade(spark: SparkSession, sf_dir: str) -> Graph:
    return _graph(spark, sf_dir, TRADE_MADE, ["nation", "customer", "supplier", "part", "orders", "lineitem"])


def followers(spark: SparkSession, sf_dir: str) -> Graph:
    return _graph(spark, sf_dir, FOLLOWERS, ["events"])


def journeys(spark: SparkSession, sf_dir: str) -> Graph:
    return _graph(spark, sf_dir, JOURNEYS_MADE, ["events"])


def purchases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """transactions(tx_id, file) and functions(id, file, decisions): orders as commits, parts as files."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    tx = line.select(F.col("l_orderkey").alias("tx_id"), F.concat(F.lit("p"), F.col("l_partkey")).alias("file"))
    return tx, part.select(F.col("p_name").alias("id"), F.concat(F.lit("p"), F.col("p_partkey")).alias("file"), F.col("p_size").alias("decisions"))


def sellers(spark: SparkSession, sf_dir: str):
    """Raw extractor rows: nations as files, customers and suppliers as classes, order lines as calls by bare name."""
    from .build import Raw

    register(spark, sf_dir, ["nation", "customer", "supplier", "orders", "lineitem"])
    none = "CAST(NULL AS ARRAY<STRING>)"
    files = spark.sql("SELECT concat('r', n_regionkey) AS package, concat('n', n_nationkey, '.py') AS file, concat('r', n_regionkey, '::n', n_nationkey) AS module_id, CAST(n_nationkey AS BIGINT) AS file_seq FROM nation")
    symbol = "SELECT CAST(n_nationkey AS BIGINT) AS file_seq, CAST({k} AS INT) AS sym_seq, concat('r', n_regionkey) AS package, concat('n', n_nationkey, '.py') AS file, concat('r', n_regionkey, '::n', n_nationkey) AS module_id, concat('r', n_regionkey, '::n', n_nationkey, '::{p}', {k}) AS id, 'class' AS kind, concat('{p}', {k}) AS label, CAST({k} AS INT) AS line, 1 AS column, {none} AS defines, {none} AS refs, {none} AS writes, CAST(NULL AS INT) AS end_line, CAST(NULL AS STRING) AS signature, CAST(NULL AS INT) AS decisions, CAST(NULL AS MAP<STRING, STRING>) AS measures FROM {t} JOIN nation ON {n} = n_nationkey"
    symbols = spark.sql(symbol.format(k="c_custkey", p="c", t="customer", n="c_nationkey", none=none)).union(spark.sql(symbol.format(k="s_suppkey", p="s", t="supplier", n="s_nationkey", none=none)))
    calls = spark.sql("""SELECT CAST(n_nationkey AS BIGINT) AS file_seq, CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS INT) AS seq,
      concat('r', n_regionkey, '::n', n_nationkey, '::c', c_custkey) AS from_id, CASE WHEN l_returnflag = 'R' THEN concat('gone', l_suppkey) ELSE concat('s', l_suppkey) END AS to_name, l_linenumber AS line
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
    from . import schema

    return Raw(files, symbols, spark.createDataFrame([], schema.IMPORTS), calls, spark.createDataFrame([], schema.HERITAGE))
