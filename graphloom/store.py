"""Stored graphs: generations of Parquet tables behind a pointer, audit chain, annotations, snapshots, certificates."""

from __future__ import annotations

import hashlib
import hmac
import json
import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .graph import FREE_EVERY, Graph, checkpointed, freed
from .profile import embedded

VERSION = "2.0"
YEAR = 365 * 24 * 3600
#: Tables written in order, so that a lookup skips files and row groups by their bounds; edges are there by either end.
ORDER = {"nodes": ["id"], "edges": ["src", "dst"], "edges_in": ["dst", "src"]}
#: An insert into a graph of so many parts makes it one part again.
PARTS = 16


def entry_hash(seq: int, ts: str, op: str, payload: str, prev: str) -> str:
    return hashlib.sha256(f"{seq}|{ts}|{op}|{payload}|{prev}".encode()).hexdigest()


def audit_append(log: list[tuple], op: str, payload: str, ts: str | None = None) -> list[tuple]:
    """A longer log; an empty one begins with a genesis entry."""
    now = ts or str(int(time.time()))
    log = log or [(0, now, "genesis", "{}", "GENESIS", entry_hash(0, now, "genesis", "{}", "GENESIS"))]
    seq, prev = len(log), log[-1][5]
    return [*log, (seq, now, op, payload, prev, entry_hash(seq, now, op, payload, prev))]


def genesis(ts: str | None = None) -> list[tuple]:
    """A trail that only begins."""
    return audit_append([], "open", "{}", ts)[:1]


def audit_verify(log: DataFrame) -> DataFrame:
    """(entries, valid, head): dense from 0, every hash recomputes, every link holds.

    Links are checked by joining each entry with the one before it, so a long
    log is not sorted into one task.
    """
    want = F.sha2(F.concat_ws("|", F.col("seq").cast("string"), "ts", "op", "payload", "prev_hash"), 256)
    before = log.select((F.col("seq") + 1).alias("seq"), F.col("hash").alias("_prev"))
    d = log.join(before, "seq", "left")
    good = (want == F.col("hash")) & (F.col("prev_hash") == F.when(F.col("seq") == 0, F.lit("GENESIS")).otherwise(F.col("_prev")))
    n = F.count(F.lit(1))
    dense = (F.min("seq") == 0) & (F.max("seq") == n - 1) & (F.count_distinct("seq") == n)
    return d.agg(n.alias("entries"), (F.every(F.coalesce(good, F.lit(False))) & dense).alias("valid"), F.max_by("hash", "seq").alias("head"))


def check_version(version: str) -> None:
    major = version.split(".")[0]
    if not major.isdigit() or int(major) > int(VERSION.split(".")[0]):
        raise ValueError(f"format {version} is newer than {VERSION}")


def migrated(df: DataFrame, want) -> DataFrame:
    """df with the fields of a schema, in its order: null where df lacks one; further fields stay behind them."""
    have = set(df.columns)
    cols = [(F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in want]
    return df.select(*cols, *[c for c in df.columns if c not in want.names])


def first_rows(df: DataFrame, keys: list[str], known: DataFrame) -> DataFrame:
    """Of rows whose keys known lacks, and that share them, the one that comes first in df. What is known goes first: each row is shuffled once, by its keys."""
    more = [c for c in df.columns if c not in keys]
    d = df.withColumn("_nth", F.monotonically_increasing_id()).join(known.select(*keys), keys, "left_anti")
    return d.groupBy(*keys).agg(F.min_by(F.struct(*more), "_nth").alias("_row")).select(*keys, "_row.*").select(*df.columns)


class Store:
    """A folder with one sub-folder per generation. A new generation counts once the pointer names it.

    A generation's tables have parts: what replaced the graph, and what each
    insert since then has added. An insert writes only its own part; older
    generations keep theirs.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def remove(self) -> None:
        fs, p = self._fs(self.path)
        fs.delete(p, True)

    def generation(self) -> int:
        """The newest one whose marker is there; 0 for none."""
        fs, p = self._fs(f"{self.path}/current")
        return max((int(s.getPath().getName()) for s in fs.listStatus(p)), default=0) if fs.exists(p) else 0

    def _point(self, n: int) -> None:
        fs, p = self._fs(f"{self.path}/current/{n}")
        if not fs.createNewFile(p):
            raise RuntimeError(f"generation {n} was written by another")

    def _table(self, name: str, n: int | None = None) -> str:
        return f"{self.path}/gen={n or self.generation()}/{name}"

    def _put(self, name: str, df: DataFrame, n: int) -> None:
        by = ORDER.get(name)
        df = df.repartitionByRange(*by).sortWithinPartitions(*by) if by else df
        df.write.mode("overwrite").option("compression", "zstd").parquet(self._table(name, n))
        freed(self.spark, FREE_EVERY)

    def _put_graph(self, nodes: DataFrame, edges: DataFrame, n: int) -> None:
        self._put("nodes", nodes, n)
        self._put("edges", edges, n)
        self._put("edges_in", self.spark.read.parquet(self._table("edges", n)), n)

    def _close(self, n: int, profile: str, parts: dict[str, list[int]]) -> int:
        meta = [("profile", profile), ("schema_version", VERSION), ("generation", str(n)), ("parts", json.dumps(parts))]
        self._put("meta", self.spark.createDataFrame(meta, schema.META), n)
        self._point(n)
        return n

    def replace_graph(self, g: Graph, diagnostics: DataFrame | None = None, audit: list[tuple] | None = None) -> int:
        n = self.generation() + 1
        self._put_graph(g.nodes, g.edges, n)
        self._put("diagnostics", diagnostics if diagnostics is not None else self.spark.createDataFrame([], schema.DIAGNOSTICS), n)
        self._put("audit", self.spark.createDataFrame(audit or [], schema.AUDIT), n)
        return self._close(n, g.profile.id, {k: [n] for k in (*ORDER, "diagnostics", "audit")})

    def compact(self) -> int:
        """The newest generation again, in one part."""
        return self.replace_graph(self.load_graph(), self.read("diagnostics"), self.load_audit())

    def parts(self) -> dict[str, list[int]]:
        """The generations that hold the parts of each table; a store made before there were parts has one."""
        n, said = self.generation(), self.meta().get("parts")
        return json.loads(said) if said else {k: [n] for k in ("nodes", "edges", "diagnostics", "audit")}

    def read(self, name: str) -> DataFrame:
        parts = self.parts()
        if name not in parts and name == "edges_in":
            name = "edges"
        each = [self.spark.read.parquet(self._table(name, n)) for n in parts[name]]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each)

    def meta(self) -> dict[str, str]:
        return {r["key"]: r["value"] for r in self.spark.read.parquet(self._table("meta")).collect()}

    def load_graph(self) -> Graph:
        """The newest generation. One of an older format gets the fields it lacks as nulls; a newer format is refused."""
        meta = self.meta()
        check_version(meta.get("schema_version", "1.0"))
        return Graph(migrated(self.read("nodes"), schema.NODES), migrated(self.read("edges"), schema.EDGES), embedded(meta["profile"]))

    def diagnostics(self) -> DataFrame:
        return self.read("diagnostics").orderBy("seq")

    def get_node(self, id: str) -> DataFrame:
        return self.read("nodes").where(F.col("id") == id)

    def get_links(self, id: str, incoming: bool = False) -> DataFrame:
        """A node's links, from the copy of the edges that lies in the order of this end."""
        return self.read("edges_in" if incoming else "edges").where(F.col("dst" if incoming else "src") == id)

    def counts(self) -> tuple[int, int]:
        return self.read("nodes").count(), self.read("edges").count()

    def load_audit(self) -> list[tuple]:
        """The trail in order; a fresh one where nothing is stored yet."""
        log = [tuple(r) for r in self.read("audit").orderBy("seq").collect()] if self.generation() else []
        return log or genesis()

    def insert_graph(self, g: Graph) -> tuple[int, int]:
        """Adds what is not there yet, as a new part and generation; how many nodes and edges that was."""
        if len(self.parts()["nodes"]) >= PARTS:
            self.compact()
        old, parts = self.load_graph(), self.parts()
        new_nodes, new_edges = migrated(g.nodes, old.nodes.schema), migrated(g.edges, old.edges.schema)
        nodes = checkpointed(first_rows(new_nodes, ["id"], old.nodes).select(*old.nodes.columns))
        edges = checkpointed(first_rows(new_edges, ["src", "dst", "kind"], old.edges).select(*old.edges.columns))
        added = nodes.count(), edges.count()
        n = self.generation() + 1
        self._put_graph(nodes, edges, n)
        if "edges_in" not in parts:  # an older store has no edges by target yet
            self._put("edges_in", old.edges.unionByName(edges), n)
        self._close(n, old.profile.id, parts | {k: [*parts.get(k, []), n] for k in ORDER})
        return added

    def add_annotation(self, target: str, body: str, ts: str | None = None) -> None:
        id = (self.annotations().agg(F.max("id")).first()[0] or 0) + 1
        while True:  # a number is taken by making its file, so two writers get two
            fs, p = self._fs(f"{self.path}/annotation-ids/{id}")
            if fs.createNewFile(p):
                break
            id += 1
        self.spark.createDataFrame([(id, target, body, ts or str(int(time.time())))], schema.ANNOTATIONS).write.mode("append").parquet(f"{self.path}/annotations")

    def annotations(self, target: str | None = None) -> DataFrame:
        fs, p = self._fs(f"{self.path}/annotations")
        d = self.spark.read.schema(schema.ANNOTATIONS).parquet(f"{self.path}/annotations") if fs.exists(p) else self.spark.createDataFrame([], schema.ANNOTATIONS)
        return (d if target is None else d.where(F.col("target_id") == target)).orderBy("id")


def snapshot_lines(g: Graph, audit: list[tuple] = (), diagnostics: DataFrame | None = None):
    """The portable document of a graph, piece by piece: nodes by id, edges by (from, to, kind)."""
    from .operators.measures import graph_class

    classes = {r["class"]: r["n"] for r in graph_class(g).collect()}
    claims = set(classes) - {"extracted_truth", "sourced_fact"}
    head = {"schema_version": VERSION, "profile_id": g.profile.id, "graph_class": {"class": "claims-bearing" if claims else "truths", "counts": dict(sorted(classes.items()))}}
    yield json.dumps(head)[:-1] + ', "nodes": ['
    keep = {k: F.col(k) for k in ("id", "kind", "label", "loc", "tier", "defines", "refs", "end_line", "signature", "decisions", "measures") if k in g.nodes.columns}
    for i, r in enumerate(g.nodes.orderBy("id").select(F.to_json(F.struct(*keep.values())).alias("j")).toLocalIterator()):
        yield (", " if i else "") + r["j"]
    yield '], "edges": ['
    e = g.edges.orderBy("src", "dst", "kind").select(F.to_json(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), "kind", "line", "attrs")).alias("j"))
    for i, r in enumerate(e.toLocalIterator()):
        yield (", " if i else "") + r["j"]
    names = ("seq", "ts", "op", "payload", "prev_hash", "hash")
    yield '], "audit_log": ' + json.dumps([dict(zip(names, a)) for a in audit])
    if diagnostics is not None:
        yield ', "diagnostics": ' + json.dumps([{"kind": r["kind"], **json.loads(r["payload"])} for r in diagnostics.orderBy("seq").toLocalIterator()])
    yield "}"


def snapshot(g: Graph, audit: list[tuple] = (), diagnostics: DataFrame | None = None) -> str:
    return "".join(snapshot_lines(g, audit, diagnostics))


def restore(spark: SparkSession, text: str) -> tuple[Graph, list[tuple]]:
    """A graph and its audit trail; refused for another major version, an unknown profile or a broken trail."""
    raw = json.loads(text)
    try:
        check_version(str(raw.get("schema_version", "")))
    except ValueError:
        raise ValueError(f"snapshot version {raw.get('schema_version')} is not supported") from None
    profile = embedded(raw.get("profile_id", "code"))
    lines = spark.createDataFrame([(json.dumps(n),) for n in raw["nodes"]], "j string")
    nodes = lines.select(F.from_json("j", schema.NODES).alias("x")).select("x.*")
    edges = spark.createDataFrame([(json.dumps({"src": e["from"], "dst": e["to"], **{k: e.get(k) for k in ("kind", "line", "attrs")}}),) for e in raw["edges"]], "j string")
    edges = edges.select(F.from_json("j", schema.EDGES).alias("x")).select("x.*")
    audit = [tuple(a[k] for k in ("seq", "ts", "op", "payload", "prev_hash", "hash")) for a in raw.get("audit_log", [])]
    if audit and not audit_verify(spark.createDataFrame(audit, schema.AUDIT)).first()["valid"]:
        raise ValueError("the audit trail does not verify")
    return Graph(nodes, edges, profile), audit


def write_snapshot(g: Graph, path: str, audit: list[tuple] = (), diagnostics: DataFrame | None = None) -> str:
    """Writes the document piece by piece, to any file system that Spark knows; its SHA-256. No more than a megabyte of it is held."""
    spark = g.spark
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    digest, held, size = hashlib.sha256(), [], 0

    def put():
        nonlocal held, size
        data = "".join(held).encode()
        digest.update(data)
        out.write(bytearray(data))
        held, size = [], 0

    for piece in snapshot_lines(g, audit, diagnostics):
        held.append(piece)
        size += len(piece)
        if size > 1 << 20:
            put()
    put()
    out.close()
    return digest.hexdigest()


def read_snapshot(spark: SparkSession, path: str) -> tuple[Graph, list[tuple]]:
    """restore() from a file: the document is parsed by a task, not by the driver."""
    from pyspark.sql import types as T

    edge = T.StructType([T.StructField("from", T.StringType()), T.StructField("to", T.StringType()), *[f for f in schema.EDGES if f.name in ("kind", "line", "attrs")]])
    want = T.StructType([T.StructField(k, t) for k, t in (("schema_version", T.StringType()), ("profile_id", T.StringType()), ("nodes", T.ArrayType(schema.NODES)), ("edges", T.ArrayType(edge)), ("audit_log", T.ArrayType(schema.AUDIT)))])
    d = checkpointed(spark.read.schema(want).json(path, multiLine=True))
    head = d.select("schema_version", "profile_id", "audit_log").first()
    check_version(head["schema_version"] or "")
    nodes = d.select(F.explode("nodes").alias("x")).select("x.*")
    edges = d.select(F.explode("edges").alias("x")).select(F.col("x.from").alias("src"), F.col("x.to").alias("dst"), "x.kind", "x.line", "x.attrs")
    audit = [tuple(a) for a in head["audit_log"] or []]
    if audit and not audit_verify(spark.createDataFrame(audit, schema.AUDIT)).first()["valid"]:
        raise ValueError("the audit trail does not verify")
    return Graph(nodes, edges, embedded(head["profile_id"] or "code")), audit


def restore_certified(spark: SparkSession, text: str, cert: dict, key: bytes, now: int | None = None) -> tuple[Graph, list[tuple]]:
    """restore() behind a gate: the certificate must be of this text, by this key, of this trail, and in its time."""
    if wrong := verify_certificate(text, cert, key, now):
        raise PermissionError(f"the certificate does not hold: {', '.join(wrong)}")
    g, audit = restore(spark, text)
    if cert.get("version", 2) >= 2 and (audit[-1][5] if audit else "") != cert["audit_head"]:
        raise PermissionError("the certificate does not hold: audit head")
    return g, audit


def certify(text: str, head: str, key: bytes, now: int | None = None) -> dict:
    """A certificate over a snapshot's digest and its audit head, good for a year."""
    now = int(time.time()) if now is None else now
    digest = hashlib.sha256(text.encode()).hexdigest()
    body = {"version": 2, "serial": f"CT-{digest[:16]}", "digest": digest, "audit_head": head, "key_id": hashlib.sha256(key).hexdigest()[:16], "issued": now, "expires": now + YEAR}
    return body | {"signature": hmac.new(key, json.dumps(body, sort_keys=True).encode(), "sha256").hexdigest()}


def verify_certificate(text: str, cert: dict, key: bytes, now: int | None = None) -> list[str]:
    """What is wrong with it; empty if nothing is. Version 1 signs the digest alone and says nothing of a trail."""
    if cert.get("version", 2) == 1:
        signed = cert.get("digest", "").encode()
    elif cert.get("version", 2) != 2:
        return ["version"]
    else:
        signed = None
    body = {k: v for k, v in cert.items() if k != "signature"}
    wrong = []
    if hashlib.sha256(text.encode()).hexdigest() != cert.get("digest"):
        wrong.append("digest")
    if not hmac.compare_digest(hmac.new(key, signed or json.dumps(body, sort_keys=True).encode(), "sha256").hexdigest(), cert.get("signature", "")):
        wrong.append("signature")
    if (int(time.time()) if now is None else now) > cert.get("expires", 0):
        wrong.append("expired")
    return wrong
