"""Source trees as raw rows: file scan, package discovery, extraction by language."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..build import Raw
from ..graph import checkpointed, numbered, running
from . import lexed

#: Suffixes of files that are read; fixed values, as graphs of the same tree must have the same files.
EXTENSIONS = "bash c cc cjs cpp cs cts cxx ex exs go h hh hpp hs hxx java jl js jsx kt kts lua md mjs mts php py pyi r rb rs sc scala sh swift ts tsx".split()
SKIP = r"/(?:target|node_modules|\.[^/]+)/"


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of the supported files below root, paths relative to it; dot folders and build output left out."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/").split(":")[-1]) + "/", "")
    d = d.select(rel.alias("path"), F.decode("content", "UTF-8").alias("text"))
    ok = F.lower(F.substring_index("path", ".", -1)).isin(EXTENSIONS) | F.substring_index("path", "/", -1).isin("Cargo.toml", "package.json", "pyproject.toml")
    return d.where(ok & ~F.concat(F.lit("/"), "path").rlike(SKIP))


def manifest_name(path: str, text: str) -> str | None:
    """The package name that a manifest declares."""
    file = path.rsplit("/", 1)[-1]
    if file == "package.json":
        try:
            got = json.loads(text)
            return got.get("name") if isinstance(got, dict) else None
        except ValueError:
            return None
    wanted = {"Cargo.toml": ("package",), "pyproject.toml": ("project", "tool.poetry")}.get(file)
    section = None
    for line in text.splitlines() if wanted else ():
        if m := re.match(r"\s*\[([^\]]+)\]", line):
            section = m[1].strip()
        elif section in wanted and (m := re.match(r"""\s*name\s*=\s*["']([^"']+)["']""", line)):
            return m[1]
    return None


def with_packages(found: DataFrame, fallback: str) -> DataFrame:
    """(package, file, text): each file below its nearest manifest, its path from there."""
    name = F.udf(manifest_name, "string")
    is_manifest = F.substring_index("path", "/", -1).isin("Cargo.toml", "package.json", "pyproject.toml")
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
    roots = found.where(is_manifest).select(folder.alias("dir"), name("path", "text").alias("package")).where("package is not null").groupBy("dir").agg(F.min("package").alias("package"))
    src = found.where(F.lower(F.substring_index("path", ".", -1)).isin(EXTENSIONS))
    segs = F.split(folder, "/")
    up = F.transform(F.sequence(F.lit(0), F.size(segs)), lambda n: F.array_join(F.slice(segs, F.lit(1), n), "/"))
    best = src.select("path", F.explode(F.array_distinct(up)).alias("dir")).join(roots, "dir").groupBy("path").agg(F.max_by(F.struct("dir", "package"), F.length("dir")).alias("m"))
    d = src.join(best, "path", "left")
    below = F.when(F.length("m.dir") > 0, F.expr("substring(path, length(m.dir) + 2)")).otherwise(F.col("path"))
    return d.select(F.coalesce("m.package", F.lit(fallback)).alias("package"), below.alias("file"), "text", "path")


def module_id(package: str, file: str) -> str:
    parts = file.rsplit(".", 1)[0].split("/")
    if parts[-1] == "__init__":
        parts.pop()
    return "::".join([package, *parts])


class Extractor:
    """Symbols, imports, calls and heritage of one Python file, without recursion limits on depth of blocks."""

    def __init__(self, package: str, file: str, text: str):
        self.package, self.file, self.module = package, file, module_id(package, file)
        self.text, self.symbols, self.imports, self.calls, self.heritage = text, [], [], [], []
        self.lines = text.splitlines()
        tree = ast.parse(text)
        self.visit(tree.body, self.module, None)

    def visit(self, body, owner: str, kind: str | None) -> None:
        todo = [(x, owner, kind) for x in reversed(body)]
        while todo:
            node, at, inside = todo.pop()
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                id = self.symbol(node, at, "method" if inside == "class" else "function")
                outer = [*node.decorator_list, *node.args.defaults, *filter(None, node.args.kw_defaults)]
                todo += [(x, id, "function") for x in reversed(node.body)]
            elif isinstance(node, ast.ClassDef):
                bases = [b.attr if isinstance(b, ast.Attribute) else b.id if isinstance(b, ast.Name) else self.base(b) for b in node.bases]
                bases = [b for b in bases if b]
                id = self.symbol(node, at, "interface" if "Protocol" in bases else "class")
                self.heritage += [(node.name, b, "inherits", node.lineno) for b in bases]
                outer = [*node.decorator_list, *node.bases, *(k.value for k in node.keywords)]
                todo += [(x, id, "class") for x in reversed(node.body)]
            else:
                if isinstance(node, (ast.Assign, ast.AnnAssign)) and at == self.module:
                    for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
                        if isinstance(t, ast.Name):
                            self.add(f"{at}::{t.id}", "variable", t.id, node, ast.unparse(t), None, [], [], [])
                elif isinstance(node, (ast.Import, ast.ImportFrom)):
                    self.imported(node)
                outer = [c for c in ast.iter_child_nodes(node) if not isinstance(c, ast.stmt) and not hasattr(c, "body")]
                blocks = [c for c in ast.iter_child_nodes(node) if isinstance(c, ast.stmt)]
                for c in ast.iter_child_nodes(node):
                    if isinstance(c, (ast.ExceptHandler, ast.match_case)):
                        blocks += c.body
                        outer += [x for x in ast.iter_child_nodes(c) if not isinstance(x, ast.stmt)]
                    elif hasattr(c, "body") and not isinstance(c, ast.stmt):
                        outer.append(c)
                todo += [(x, at, inside if isinstance(node, ast.If) else None) for x in reversed(blocks)]
            for x in outer:
                for c in ast.walk(x):
                    if isinstance(c, ast.Call):
                        self.calls.append((at, ast.unparse(c.func), c.lineno))

    @staticmethod
    def base(b) -> str | None:
        v = b.value if isinstance(b, ast.Subscript) else None
        return v.id if isinstance(v, ast.Name) else v.attr if isinstance(v, ast.Attribute) else None

    def add(self, id, kind, label, node, signature, decisions, defines, refs, writes) -> str:
        self.symbols.append((id, kind, label, node.lineno, node.col_offset + 1, sorted(set(defines)), sorted(set(refs)), sorted(set(writes)), node.end_lineno, signature, decisions))
        return id

    def symbol(self, node, at: str, kind: str) -> str:
        head = " ".join(" ".join(self.lines[node.lineno - 1 : max(node.lineno, node.body[0].lineno - (node.body[0].lineno > node.lineno))]).split())
        head = head.split(": ")[0] if node.body[0].lineno == node.lineno else head
        names = ([], [], [])
        marks = [d.attr if isinstance(d, ast.Attribute) else d.id for d in node.decorator_list if isinstance(d, (ast.Name, ast.Attribute))]
        decisions = None
        if kind in ("function", "method"):
            names, decisions = self.names(node), self.decisions(node)
        return self.add(f"{at}::{node.name}", kind, node.name, node, re.sub(r"\s*:\s*$", "", head), decisions, names[0], [*names[1], *marks], names[2])

    @staticmethod
    def decisions(node) -> int:
        n, todo = 0, list(node.body)
        while todo:
            x = todo.pop()
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue
            n += isinstance(x, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp))
            n += len(x.values) - 1 if isinstance(x, ast.BoolOp) else len(x.cases) - 1 if isinstance(x, ast.Match) else 1 + len(x.ifs) if isinstance(x, ast.comprehension) else 0
            todo += ast.iter_child_nodes(x)
        return n

    @staticmethod
    def names(node):
        args = node.args
        every = [*args.posonlyargs, *args.args, *args.kwonlyargs, *filter(None, (args.vararg, args.kwarg))]
        defines, refs, writes, barred = [a.arg for a in every], [], [], set()
        todo = [*node.body, *(a.annotation for a in every if a.annotation), *([node.returns] if node.returns else [])]
        while todo:
            x = todo.pop()
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue
            if isinstance(x, (ast.Global, ast.Nonlocal)):
                barred.update(x.names)
            elif isinstance(x, ast.Assign):
                for t in x.targets:
                    for y in ast.walk(t):
                        if isinstance(y, ast.Name) and isinstance(y.ctx, ast.Store):
                            writes.append(y.id)
                        elif isinstance(y, ast.Attribute) and isinstance(y.ctx, ast.Store):
                            writes.append(y.attr)
            elif isinstance(x, ast.AugAssign) and isinstance(x.target, ast.Name):
                refs.append(x.target.id)
                todo.append(x.value)
                continue
            if isinstance(x, ast.Name):
                (defines if isinstance(x.ctx, ast.Store) else refs).append(x.id)
            elif isinstance(x, ast.ExceptHandler) and x.name:
                defines.append(x.name)
            todo += ast.iter_child_nodes(x)
        defines = [d for d in defines if d not in barred]
        return defines, [r for r in refs if r not in set(defines)], writes

    def imported(self, node) -> None:
        own = self.module.split("::")
        if isinstance(node, ast.Import):
            for a in node.names:
                self.imports.append((self.target(a.name), [a.asname or a.name.split(".")[0]], node.lineno))
            return
        names = [a.asname or a.name for a in node.names if a.name != "*"]
        if node.level:
            here = own if self.file.rsplit("/", 1)[-1] == "__init__.py" else own[:-1]
            base = here[: len(here) - node.level + 1]
            to = "::".join(base + (node.module.split(".") if node.module else [])) if base else "external::unresolved"
        else:
            to = self.target(node.module)
        self.imports.append((to, names, node.lineno))

    def target(self, dotted: str) -> str:
        parts = dotted.split(".")
        return "::".join(parts) if parts[0] == self.package else f"external::{parts[0]}"


_OUT = "part string, file_seq long, seq int, package string, file string, module_id string, a string, b string, kind string, line int, column int, x array<string>, y array<string>, z array<string>, end_line int, signature string, decisions int"


def extract(found: DataFrame) -> Raw:
    """Raw tables of (package, file, text, path): Python through its syntax tree, Markdown as one document symbol, other languages by lexing.

    Files that do not parse give their file row only. Files are numbered by path.
    """
    number = numbered(found.select("path").distinct(), ["path"], "file_seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.split(" ", 1)[0] for c in _OUT.split(", ")]
        for b in batches:
            out = []
            for seq, package, file, text in zip(b["file_seq"], b["package"], b["file"], b["text"]):
                suffix = file.rsplit(".", 1)[-1].lower()
                m = lexed.module_id(package, file, text) if suffix in lexed.BY_SUFFIX else module_id(package, file)
                head = (package, file, m)
                out.append(("file", seq, 0, *head, None, None, None, None, None, None, None, None, None, None, None))
                if suffix == "md":
                    stem = m.rsplit("::", 1)[-1]
                    out.append(("symbol", seq, 0, *head, f"{m}::{stem}", stem, "doc", 1, 1, [], [], [], None, None, None))
                    continue
                try:
                    x = lexed.Lexed(package, file, text, m) if suffix in lexed.BY_SUFFIX else Extractor(package, file, text)
                except (SyntaxError, ValueError):
                    continue
                out += [("symbol", seq, n, *head, s[0], s[2], s[1], s[3], s[4], s[5], s[6], s[7], s[8], s[9], s[10]) for n, s in enumerate(x.symbols)]
                out += [("import", seq, n, *head, m, t, None, line, None, names, None, None, None, None, None) for n, (t, names, line) in enumerate(x.imports)]
                out += [("call", seq, n, *head, f, t, None, line, None, None, None, None, None, None, None) for n, (f, t, line) in enumerate(x.calls)]
                out += [("heritage", seq, n, *head, t, base, k, line, None, None, None, None, None, None, None) for n, (t, base, k, line) in enumerate(x.heritage)]
            d = pd.DataFrame(out, columns=cols)
            for c in ("line", "column", "end_line", "decisions"):
                d[c] = d[c].astype("Int32")
            yield d

    rows = checkpointed(found.join(number, "path").select("file_seq", "package", "file", "text").mapInPandas(run, _OUT))
    of = lambda p, *cols: rows.where(F.col("part") == p).select(*cols)
    c = F.col
    symbols = of("symbol", "file_seq", c("seq").alias("sym_seq"), "package", "file", "module_id", c("a").alias("id"), "kind", c("b").alias("label"), "line", "column", c("x").alias("defines"), c("y").alias("refs"), c("z").alias("writes"), "end_line", "signature", "decisions", F.lit(None).cast(schema.SYMBOLS["measures"].dataType).alias("measures"))
    return Raw(
        of("file", "package", "file", "module_id", "file_seq"), symbols,
        of("import", "file_seq", "seq", c("a").alias("from_module_id"), c("b").alias("to_module_id"), c("x").alias("bindings"), "line"),
        of("call", "file_seq", "seq", c("a").alias("from_id"), c("b").alias("to_name"), "line"),
        of("heritage", "file_seq", "seq", c("a").alias("type_name"), c("b").alias("target_name"), "kind", "line"),
    )


def commits(spark: SparkSession, lines: DataFrame, since: str | None = None) -> DataFrame:
    """transactions(tx_id, file) from log text (line_no, value): a line `commit ID DATE` starts one, others name files.

    With since, commits with an earlier date (yyyy-mm-dd) or without one are left out.
    """
    d = running(lines, ["line_no"], F.col("value").startswith("commit ").cast("long"), "tx_id")
    if since is not None:
        dated = d.where(F.col("value").startswith("commit ")).select("tx_id", F.regexp_extract("value", r"(\d{4}-\d{2}-\d{2})", 1).alias("day"))
        d = d.join(dated.where(F.col("day") >= since).select("tx_id"), "tx_id", "left_semi")
    return d.where(~F.col("value").startswith("commit ") & (F.trim("value") != "") & (F.col("tx_id") > 0)).select("tx_id", F.trim("value").alias("file"))


def to_graph_files(transactions: DataFrame, known: DataFrame) -> DataFrame:
    """transactions with paths replaced by the longest suffix that known(file) has."""
    s = F.split("file", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(s)), lambda n: F.array_join(F.slice(s, n, F.size(s)), "/"))
    d = transactions.select("tx_id", "file", F.explode(ends).alias("_end")).join(known.select(F.col("file").alias("_end")).distinct(), "_end")
    return d.groupBy("tx_id", "file").agg(F.max_by("_end", F.length("_end")).alias("_f")).select("tx_id", F.col("_f").alias("file")).distinct()
