"""WARC archives and a two-level capture index.

Writing: each task writes archives of gzip members, one record each, and
reports where every record lies. Of pages with equal payloads those with the
smallest id are responses, the others revisits without a payload.

Index: captures sorted by reversed-host URL key lie in range shards. A shard is
a file of compressed blocks of lines and a sparse directory, one line per block.
The first keys of the shards are the level above. A lookup finds its shards by
binary search in these, its block by binary search in the shard's directory,
reads that block's range and searches in it; what it finds is read from the
archive by its range.

Files go to the shared folder through its own file system, under names that no
other attempt of a task has; only what a finished task reports is read.

Defined results: a null payload is empty; null URLs have the empty key; rows
that repeat the smallest id of their payload are responses too; rows without an
id revisit one with an id if there is one, else are responses; an empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import fresh_path, partitions, written

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:x-page-id:"
CAPTURES = "key string, record string, kind string, digest string, url string, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """Reversed host, then the rest: http://b.a.org:80/x?y -> org,a,b:80)/x?y"""
    m = re.match(r"^(?:[A-Za-z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)(.*)$", url or "", re.S)
    if not m:
        return clean(url)
    host, _, port = m[1].lower().partition(":")
    return clean(",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (m[2] or "/"))


def clean(url: str | None) -> str:
    """No blanks or control characters: these would end a header or an index field."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page: str, url: str, date: str, payload: bytes | None, size: int, mark: str, refers: str | None = None, refers_url: str | None = None) -> bytes:
    """One record; a revisit has no payload, only its size."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    body = http + (payload if kind == "response" else b"")
    head = {"WARC-Type": kind, "WARC-Target-URI": clean(url), "WARC-Date": date, "WARC-Record-ID": f"<{ID}{page}>", "WARC-Payload-Digest": f"sha1:{mark}"}
    if kind == "revisit":
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{ID}{refers}>", "WARC-Refers-To-Target-URI": clean(refers_url), "WARC-Refers-To-Date": date}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(body))}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members one after the other; input goes in by small pieces, as what a member leaves over is copied."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, out, step = zlib.decompressobj(31), [], 1 << 11
        while not z.eof and at < len(view):
            piece = view[at : at + step]
            out.append(z.decompress(piece))
            at, step = at + len(piece), min(2 * step, 1 << 20)
        at -= len(z.unused_data)
        yield b"".join(out)


def parse(data: bytes) -> dict:
    """Headers and payload of one record; the payload of a revisit is None."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[: int(h["Content-Length"])]
    h["payload"] = body.partition(b"\r\n\r\n")[2] if h["WARC-Type"] == "response" else None
    return h


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _page(ref: str) -> str | None:
    got = ref.strip("<>").removeprefix(ID)
    return got or None


def write(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z", file_bytes: int = 64 << 20) -> DataFrame:
    """Writes the archives; one row per record says where it lies.

    Which record of equal payloads is the response is settled on digests alone.
    Payloads move once, to tasks by digest and id, so that copies of one page do
    not meet; revisits move without theirs.
    """
    spark = pages.sparkSession
    d = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("p"))
    d = d.withColumn("d", F.sha1("p"))
    first = d.groupBy("d").agg(F.min("k").alias("first"), F.min(F.when(F.col("k").isNotNull(), F.struct("k", "u"))).alias("_b"))
    first = written(first.select("d", "first", F.col("_b.u").alias("first_url")), "payloads")
    base = fresh_path(spark, "warc")

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = _fs(base)
        store.create_dir(root, recursive=True)
        f, at, n = None, 0, 0
        for b in batches:
            out = []
            for k, u, p, size, mark, first, first_url in zip(b["k"], b["u"], b["p"], b["n"], b["d"], b["first"], b["first_url"]):
                if f is None or at >= file_bytes:
                    if f is not None:
                        f.close()
                    name, at, n = f"{task.stageId()}-{task.partitionId():06d}-{task.taskAttemptId()}-{n}.warc.gz", 0, n + 1
                    f = store.open_output_stream(f"{root}/{name}", compression=None)
                kind = "response" if p is not None else "revisit"
                mark = base64.b32encode(bytes.fromhex(mark)).decode()
                z = member(record(kind, k or "", u, date, p, size, mark, first, first_url))
                f.write(z)
                out.append((url_key(u), k or "", kind, mark, u, name, at, len(z)))
                at += len(z)
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in CAPTURES.split(", ")])
        if f is not None:
            f.close()

    def saved(rows: DataFrame, payload) -> DataFrame:
        rows = rows.select(F.col("k").cast("string").alias("k"), "u", payload.alias("p"), "n", "d", F.col("first").cast("string").alias("first"), "first_url")
        return rows.mapInPandas(save, CAPTURES)

    n = F.octet_length("p").cast("long")
    own = d.withColumn("n", n).join(first.select("d", F.col("first").alias("k"), "first", "first_url").where("k is not null"), ["d", "k"])
    # Payloads that no row with an id has: all their rows are responses.
    nameless = d.withColumn("n", n).where("k is null").join(first.where("first is null"), "d")
    again = d.select("k", "u", "d", n.alias("n")).join(first.where("first is not null"), "d").where("k is null or k <> first")
    rows = saved(own, F.col("p")).union(saved(nameless, F.col("p"))).union(saved(again, F.lit(None).cast("binary")))
    return written(rows.withColumn("folder", F.lit(base)), "captures")


RECORD = "page string, record_type string, url string, payload_digest string, payload_bytes long, checked_digest string, refers_to string, refers_url string"


def _seen(data: bytes) -> tuple:
    """A row of RECORD for one record's bytes: what its headers say, and its payload's size and digest."""
    h = parse(data)
    p = h["payload"]
    return _page(h["WARC-Record-ID"]), h["WARC-Type"], h["WARC-Target-URI"], h["WARC-Payload-Digest"].removeprefix("sha1:"), None if p is None else len(p), None if p is None else digest(p), _page(h.get("WARC-Refers-To", "")), h.get("WARC-Refers-To-Target-URI")


def _frame(rows: list, schema: str) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
    return out.astype({"payload_bytes": "Int64"}) if "payload_bytes" in out else out


def read(captures: DataFrame) -> DataFrame:
    """Every record of the archives that captures names, read from start to end."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for folder, file in zip(b["folder"], b["file"]):
                store, root = _fs(folder)
                with store.open_input_stream(f"{root}/{file}", compression=None) as f:
                    data = f.read()
                out = [_seen(m) for m in members(data)]
                if out:
                    yield _frame(out, RECORD)

    files = captures.select("folder", "file").distinct()
    return files.repartition(partitions(captures.sparkSession), "file").mapInPandas(load, RECORD)


def index(captures: DataFrame, *, block_lines: int = 512) -> DataFrame:
    """Writes the index; one row per shard: folder, file, first, last, and the length of its directory."""
    spark = captures.sparkSession
    base = fresh_path(spark, "index")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, store, root = TaskContext.get(), *_fs(base)
        name, f, at, held, ends, sparse = f"{task.partitionId():06d}-{task.taskAttemptId()}", None, 0, [], [], []

        def put(lines):
            nonlocal at
            z = member("".join(lines).encode("utf-8", "surrogatepass"))
            f.write(z)
            sparse.append(f"{lines[0].split(' ', 1)[0]} {at} {len(z)}\n")
            at += len(z)

        for b in batches:
            for r in b.itertuples(index=False):
                if f is None:
                    store.create_dir(root, recursive=True)
                    f = store.open_output_stream(f"{root}/{name}.cdx.gz", compression=None)
                    ends = [r.key]
                ends[1:] = [r.key]
                held.append(f"{r.key} {r.record or '-'} {r.kind} {r.digest} {r.file} {r.offset} {r.length}\n")
                if len(held) >= block_lines:
                    put(held)
                    held = []
        if f is not None:
            if held:
                put(held)
            f.close()
            with store.open_output_stream(f"{root}/{name}.dir") as d:
                d.write("".join(sparse).encode("utf-8", "surrogatepass"))
            yield pd.DataFrame([(base, name, ends[0], ends[-1], len(sparse))], columns=["folder", "file", "first", "last", "blocks"])

    order = [F.col(c) for c in ("key", "record", "file", "offset")]
    rows = captures.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    return written(rows.mapInPandas(build, "folder string, file string, first string, last string, blocks long"), "shards")


FOUND = "key string, record string, kind string, digest string, file string, offset long, length long"


def lookup(shards: DataFrame, queries: DataFrame) -> DataFrame:
    """The captures of each key in queries(key), keys taken once."""
    tops = sorted((r["first"], r["last"], r["folder"], r["file"]) for r in shards.collect())
    firsts, lasts = [t[0] for t in tops], [t[1] for t in tops]

    def shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, i) for k in b["key"] for i in range(bisect.bisect_left(lasts, k), bisect.bisect_right(firsts, k))]
            if out:
                yield pd.DataFrame(out, columns=["key", "shard"])

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, near = None, (None, None)
        for b in batches:
            out = []
            for k, i in zip(b["key"], b["shard"]):
                if i != now:
                    now, (store, root) = i, _fs(tops[i][2])
                    with store.open_input_stream(f"{root}/{tops[i][3]}.dir") as f:
                        sparse = [x.rsplit(" ", 2) for x in f.read().decode("utf-8", "surrogatepass").splitlines()]
                    keys, near = [x[0] for x in sparse], (None, None)
                    data = store.open_input_file(f"{root}/{tops[i][3]}.cdx.gz")
                # The block before the first one that begins at or after the key may end with it.
                for j in range(max(0, bisect.bisect_left(keys, k) - 1), bisect.bisect_right(keys, k)):
                    if near[0] != j:
                        data.seek(int(sparse[j][1]))
                        lines = zlib.decompress(data.read(int(sparse[j][2])), 31).decode("utf-8", "surrogatepass").splitlines()
                        near = (j, [x.split(" ") for x in lines])
                    at = bisect.bisect_left(near[1], k, key=lambda x: x[0])
                    while at < len(near[1]) and near[1][at][0] == k:
                        x = near[1][at]
                        out.append((k, "" if x[1] == "-" else x[1], x[2], x[3], x[4], int(x[5]), int(x[6])))
                        at += 1
                    if len(out) >= 20_000:
                        yield _frame(out, FOUND)
                        out = []
            if out:
                yield _frame(out, FOUND)

    q = queries.select("key").distinct().mapInPandas(shard, "key string, shard int")
    n = partitions(shards.sparkSession)
    return q.repartition(n, "shard", "key").sortWithinPartitions("shard", "key").mapInPandas(find, FOUND)


def fetch(found: DataFrame, folder: str, *, span: int = 4 << 20) -> DataFrame:
    """The records of found, read from the archives by range; ranges that follow each other are read up to span at once."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _fs(folder)
        name, f = None, None

        def ranges(b):
            """(file, offset, lengths) of rows that lie side by side."""
            now = None
            for file, at, n in zip(b["file"], b["offset"], b["length"]):
                if now and now[0] == file and now[1] + now[3] == at and now[3] + n <= span:
                    now[2].append(n)
                    now[3] += n
                else:
                    if now:
                        yield now
                    now = [file, at, [n], n]
            if now:
                yield now

        for b in batches:
            out = []
            for file, at, lengths, total in ranges(b):
                if file != name:
                    if f is not None:
                        f.close()
                    name, f = file, store.open_input_file(f"{root}/{file}")
                f.seek(at)
                data, used = memoryview(f.read(total)), 0
                for n in lengths:
                    out.append(_seen(zlib.decompress(data[used : used + n], 31)))
                    used += n
            if out:
                yield _frame(out, RECORD)

    rows = found.select("file", "offset", "length").repartitionByRange(partitions(found.sparkSession), "file", "offset").sortWithinPartitions("file", "offset")
    return rows.mapInPandas(load, RECORD)


def round_trip(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes pages to archives, indexes these, and reads every record back through the index.

    The keys of all URLs are looked up; every capture found is read by its range.
    What a revisit leaves out, it gets from the response that it refers to.
    """
    spark = pages.sparkSession
    kind = dict(pages.select(F.col(key).alias("k")).dtypes)["k"]
    captures = write(pages, key=key, url=url, html=html)
    folder = captures.select("folder").first()
    as_key = F.pandas_udf(lambda s: s.map(url_key), "string")
    found = lookup(index(captures), pages.select(F.col(url).alias("u")).distinct().select(as_key("u").alias("key")))
    records = written(fetch(found, folder[0]), "records") if folder else spark.createDataFrame([], RECORD)
    full = records.where("record_type = 'response' and page is not null").select(F.col("page").alias("_page"), F.col("payload_bytes").alias("_n"), F.col("checked_digest").alias("_d"))
    full = full.groupBy("_page", "_d").agg(F.max("_n").alias("_n"))
    revisits = records.where("record_type = 'revisit'").join(full, (F.col("refers_to") == F.col("_page")) & (F.col("payload_digest") == F.col("_d")), "left")
    responses = records.where("record_type = 'response'").select("*", *[F.lit(None).alias(c) for c in full.columns])
    got = responses.unionByName(revisits)
    return got.select(
        F.col("page").cast(kind).alias(key), F.coalesce("payload_bytes", "_n").alias("payload_bytes"), F.coalesce("checked_digest", "_d").alias("payload_digest"),
        "record_type", F.col("refers_to").cast(kind).alias("refers_to"), F.col("payload_digest").alias("recorded_digest"), "url",
    )
