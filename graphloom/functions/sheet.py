"""A small spreadsheet evaluator: formulas over cells, absence as a typed result."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import checkpointed

TOKEN = re.compile(r"""\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|("(?:[^"]|"")*")|((?:'(?:[^']|'')+'|[A-Za-z_][\w.]*)!)?(\$?[A-Za-z]{1,3}\$?\d+)(?![\w(])|([A-Za-z_][\w.]*)|(<>|<=|>=|[-+*/^%=<>(),:&]))""")
COMPARE = ("=", "<>", "<", ">", "<=", ">=")


class Absent(Exception):
    """A value that cannot be had: Parse, UnknownFunction, UnresolvedRef, AbsentInput, Cycle, DivByZero or Type."""


@lru_cache(maxsize=1 << 16)
def parse_ref(text: str) -> tuple[int, int]:
    """A1 or $A$1 to (row, column), from 1."""
    m = re.fullmatch(r"\$?([A-Za-z]{1,3})\$?(\d+)", text)
    if not m or m[2] == "0":
        raise Absent("Parse")
    col = 0
    for c in m[1].upper():
        col = col * 26 + ord(c) - 64
    return int(m[2]), col


@lru_cache(maxsize=1 << 16)
def render_ref(row: int, col: int) -> str:
    letters = ""
    while col:
        col, r = divmod(col - 1, 26)
        letters = chr(65 + r) + letters
    return f"{letters}{row}"


def tokens(text: str) -> list[tuple[str, str]]:
    out, at, text = [], 0, text.removeprefix("=")
    while text[at:].strip():
        m = TOKEN.match(text, at)
        if not m:
            raise Absent("Parse")
        if m[1]:
            out.append(("num", m[1]))
        elif m[2]:
            out.append(("str", m[2][1:-1].replace('""', '"')))
        elif m[4]:
            out.append(("ref", ((m[3] or "")[:-1].strip("'").replace("''", "'") + "!" if m[3] else "") + m[4].replace("$", "").upper()))
        elif m[5]:
            out.append(("name", m[5].upper()))
        else:
            out.append(("op", m[6]))
        at = m.end()
    return out


class Parser:
    """Comparison, then + and -, then * / %, then ^ to the right, then sign: so -2^2 is 4."""

    def __init__(self, text: str, sheet: str):
        self.t, self.i, self.sheet = tokens(text), 0, sheet
        self.tree = self.binary(0)
        if self.i < len(self.t):
            raise Absent("Parse")

    def peek(self) -> str | None:
        return self.t[self.i][1] if self.i < len(self.t) and self.t[self.i][0] == "op" else None

    def need(self, op: str) -> None:
        if self.peek() != op:
            raise Absent("Parse")
        self.i += 1

    def binary(self, level: int):
        if level == 3:
            return self.power()
        ops = (COMPARE, ("+", "-"), ("*", "/", "%"))[level]
        left = self.binary(level + 1)
        while (op := self.peek()) in ops:
            self.i += 1
            left = (op, left, self.binary(level + 1))
        return left

    def power(self):
        left = self.unary()
        if self.peek() == "^":
            self.i += 1
            return ("^", left, self.power())
        return left

    def unary(self):
        if (op := self.peek()) in ("+", "-"):
            self.i += 1
            return ("neg", self.unary()) if op == "-" else self.unary()
        return self.primary()

    def ref(self, text: str):
        sheet, _, cell = text.rpartition("!")
        return (sheet or self.sheet, *parse_ref(cell))

    def primary(self):
        if self.i >= len(self.t):
            raise Absent("Parse")
        kind, text = self.t[self.i]
        self.i += 1
        if kind == "num":
            return ("value", float(text))
        if kind == "str":
            return ("value", text)
        if kind == "ref":
            first = self.ref(text)
            if self.peek() == ":":
                self.i += 1
                kind, text = self.t[self.i] if self.i < len(self.t) else ("", "")
                if kind != "ref":
                    raise Absent("Parse")
                self.i += 1
                return ("range", first, self.ref(text))
            return ("ref", first)
        if kind == "name":
            self.need("(")
            args = []
            if self.peek() != ")":
                args.append(self.binary(0))
                while self.peek() == ",":
                    self.i += 1
                    args.append(self.binary(0))
            self.need(")")
            return ("call", text, args)
        if text == "(":
            inner = self.binary(0)
            self.need(")")
            return inner
        raise Absent("Parse")


@lru_cache(maxsize=1 << 14)
def parsed(text: str, sheet: str):
    """(tree, what is wrong with the formula): models of one kind share their formulas."""
    try:
        return Parser(text, sheet).tree, None
    except Absent as e:
        return None, str(e)


def cells_of(a, b):
    for r in range(min(a[1], b[1]), max(a[1], b[1]) + 1):
        for c in range(min(a[2], b[2]), max(a[2], b[2]) + 1):
            yield a[0], r, c


def formula_reads(text: str, sheet: str) -> list[str]:
    """The distinct cells a formula names, ranges spelled out, in order; also where it cannot be evaluated."""
    p = Parser.__new__(Parser)
    p.sheet = sheet
    t, out, i = tokens(text), {}, 0
    while i < len(t):
        if t[i][0] == "ref":
            a = b = p.ref(t[i][1])
            if i + 2 < len(t) and t[i + 1] == ("op", ":") and t[i + 2][0] == "ref":
                b, i = p.ref(t[i + 2][1]), i + 2
            out |= dict.fromkeys(f"{s}!{render_ref(r, c)}" for s, r, c in cells_of(a, b))
        i += 1
    return list(out)


class Book:
    """Cells of one model: overrides before literals before formulas; stored results of formulas are never used."""

    def __init__(self, literals: dict, formulas: dict, overrides: dict | None = None):
        self.literals, self.formulas, self.memo = literals | (overrides or {}), {k: v for k, v in formulas.items() if k not in (overrides or {})}, {}
        self.open: set = set()

    def cell(self, key):
        if key in self.memo:
            got = self.memo[key]
            if isinstance(got, Absent):
                raise got
            return got
        if key in self.literals:
            return self.literals[key]
        if key not in self.formulas:
            raise Absent("UnresolvedRef")
        if key in self.open:
            raise Absent("Cycle")
        self.open.add(key)
        try:
            tree, wrong = parsed(self.formulas[key], key[0])
            if wrong:
                raise Absent(wrong)
            got = self.memo[key] = self.run(tree)
            return got
        except Absent as e:
            if str(e) == "Cycle":
                raise
            self.memo[key] = e
            raise
        except RecursionError:
            raise Absent("Cycle") from None
        finally:
            self.open.discard(key)

    def number(self, x) -> float:
        v = self.run(x)
        if isinstance(v, bool):
            return float(v)
        if not isinstance(v, float):
            raise Absent("Type")
        return v

    def values(self, args) -> list[float]:
        out = []
        for a in args:
            if a[0] == "range":
                for key in cells_of(a[1], a[2]):
                    if key in self.literals or key in self.formulas:
                        v = self.reach(key)
                        if isinstance(v, float):
                            out.append(v)
            else:
                out.append(self.number(a))
        return out

    def reach(self, key):
        """A cell as an input: what is absent there is an absent input here."""
        try:
            return self.cell(key)
        except Absent as e:
            raise e if str(e) in ("UnresolvedRef", "Cycle") else Absent("AbsentInput") from None

    def run(self, x):
        op = x[0]
        if op == "value":
            return x[1]
        if op == "ref":
            return self.reach(x[1])
        if op == "range":
            raise Absent("Type")
        if op == "neg":
            return -self.number(x[1])
        if op == "call":
            return self.call(x[1], x[2])
        if op in COMPARE:
            a, b = self.run(x[1]), self.run(x[2])
            if isinstance(a, str) != isinstance(b, str):
                raise Absent("Type")
            return {"=": a == b, "<>": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
        a, b = self.number(x[1]), self.number(x[2])
        try:
            if op == "%" or op == "/":
                if b == 0:
                    raise Absent("DivByZero")
                return a / b if op == "/" else a - b * (a // b)
            got = a + b if op == "+" else a - b if op == "-" else a * b if op == "*" else a**b
        except (OverflowError, ZeroDivisionError):
            raise Absent("DivByZero" if op == "^" and a == 0 else "Type") from None
        if isinstance(got, complex):
            raise Absent("Type")
        return got

    def call(self, name: str, args):
        if name == "IF":
            if len(args) not in (2, 3):
                raise Absent("Parse")
            c = self.run(args[0])
            if isinstance(c, str):
                raise Absent("Type")
            return self.run(args[1]) if c else self.run(args[2]) if len(args) == 3 else 0.0
        if name not in ("SUM", "AVERAGE", "MIN", "MAX", "ABS", "SQRT", "ROUND", "NPV"):
            raise Absent("UnknownFunction")
        v = self.values(args)
        if name == "SUM":
            return float(sum(v))
        if not v:
            raise Absent("AbsentInput")
        if name in ("AVERAGE", "MIN", "MAX"):
            return sum(v) / len(v) if name == "AVERAGE" else min(v) if name == "MIN" else max(v)
        if name == "ABS":
            return abs(v[0])
        if name == "SQRT":
            if v[0] < 0:
                raise Absent("Type")
            return v[0] ** 0.5
        if name == "ROUND":
            scale = 10.0 ** int(v[1] if len(v) > 1 else 0)
            return (1 if v[0] >= 0 else -1) * float(int(abs(v[0]) * scale + 0.5)) / scale
        return sum(x / (1 + v[0]) ** (i + 1) for i, x in enumerate(v[1:]))


EVALUATED = "model string, scenario string, sheet string, reference string, value double, text string, error string"


def evaluate(cells: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(model, scenario, sheet, reference, value, text, error) of every cell of every model and scenario.

    overrides(model, scenario, sheet, reference, value) replaces cells; the
    plain model is the scenario ''. One model is one task's work.
    """

    def results(model, scenario, rows) -> Iterator[tuple]:
        literals, formulas, over = {}, {}, {}
        for sheet, reference, formula, number, text, value in rows:
            key = (sheet, *parse_ref(reference))
            if value == value:
                over[key] = value
            elif isinstance(formula, str):
                formulas[key] = formula
            elif number == number:
                literals[key] = number
            elif isinstance(text, str):
                literals[key] = text
        book = Book(literals, formulas, over)
        for k in sorted(book.literals.keys() | book.formulas.keys()):
            value = text = error = None
            try:
                v = book.cell(k)
                value, text = (None, v) if isinstance(v, str) else (float(v), None)
            except Absent as e:
                error = str(e)
            yield model, scenario, k[0], render_ref(k[1], k[2]), value, text, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = lambda out: pd.DataFrame(out, columns=[c.split()[0] for c in EVALUATED.split(", ")]).astype({"value": "float64"})
        open_, rows, out = None, [], []
        for b in batches:
            own = [b[c].astype("float64").tolist() if c in ("number", "value") else b[c].tolist() for c in ("model", "scenario", "sheet", "reference", "formula", "number", "text", "value")]
            for model, scenario, *row in zip(*own):
                if (model, scenario) != open_:
                    if rows:
                        out += results(*open_, rows)
                    open_, rows = (model, scenario), []
                    if len(out) > 10_000:
                        yield frame(out)
                        out = []
                rows.append(row)
        if rows:
            out += results(*open_, rows)
        if out:
            yield frame(out)

    cols = ["model", "sheet", "reference", "formula", "number", "text"]
    base = cells.select(*cols).withColumns({"scenario": F.lit(""), "value": F.lit(None).cast("double")})
    if overrides is not None:
        names = overrides.select("model", "scenario").distinct()
        base = base.unionByName(cells.select(*cols).join(names, "model").withColumn("value", F.lit(None).cast("double")))
        base = base.unionByName(overrides.select("model", "scenario", "sheet", "reference", "value"), allowMissingColumns=True)
    # A model's rows lie together; many models are evaluated in one call.
    return base.repartition("model", "scenario").sortWithinPartitions("model", "scenario").mapInPandas(run, EVALUATED)


def reads(cells: DataFrame) -> DataFrame:
    """(model, src, dst): dst is computed from src, cells as sheet!A1."""

    @F.pandas_udf("array<string>")
    def of(formulas: pd.Series, sheets: pd.Series) -> pd.Series:
        out = []
        for f, s in zip(formulas, sheets):
            try:
                out.append(formula_reads(f, s) if f is not None else [])
            except Absent:
                out.append([])
        return pd.Series(out)

    at = F.concat("sheet", F.lit("!"), F.replace("reference", F.lit("$"), F.lit("")))
    return cells.where("formula is not null").select("model", F.explode(of("formula", "sheet")).alias("src"), at.alias("dst"))


def sensitivity(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(model, output_sheet, output, driver_sheet, driver) with step, slope and elasticity.

    The step is 0.01 for drivers up to 1, else one hundredth of the driver.
    Elasticity is null where either base is 0.
    """
    base = checkpointed(evaluate(cells).select("model", "sheet", "reference", "value"))
    d = pairs.join(base.select("model", F.col("sheet").alias("driver_sheet"), F.col("reference").alias("driver"), F.col("value").alias("x")), ["model", "driver_sheet", "driver"])
    d = d.join(base.select("model", F.col("sheet").alias("output_sheet"), F.col("reference").alias("output"), F.col("value").alias("y")), ["model", "output_sheet", "output"])
    d = d.withColumn("step", F.when(F.abs("x") <= 1, 0.01).otherwise(F.abs("x") * 0.01)).withColumn("scenario", F.concat("driver_sheet", F.lit("!"), "driver"))
    moved = d.select("model", "scenario", F.col("driver_sheet").alias("sheet"), F.col("driver").alias("reference"), (F.col("x") + F.col("step")).alias("value")).distinct()
    after = evaluate(cells, moved).where("scenario <> ''").select("model", "scenario", F.col("sheet").alias("output_sheet"), F.col("reference").alias("output"), F.col("value").alias("y2"))
    d = d.join(after, ["model", "scenario", "output_sheet", "output"])
    slope = (F.col("y2") - F.col("y")) / F.col("step")
    return d.select("model", "output_sheet", "output", "driver_sheet", "driver", "step", slope.alias("slope"), F.when((F.col("x") != 0) & (F.col("y") != 0), slope * F.col("x") / F.col("y")).alias("elasticity"))


def scenario_spread(evaluated: DataFrame, outputs: DataFrame) -> DataFrame:
    """Per output(model, sheet, reference): lowest, highest, range (two values at least), and each scenario's distance from the base."""
    e = checkpointed(evaluated.join(outputs, ["model", "sheet", "reference"]))
    named = e.where("scenario <> ''")
    base = e.where("scenario = ''").select("model", "sheet", "reference", F.col("value").alias("base"))
    agg = named.groupBy("model", "sheet", "reference").agg(F.when(F.count("value") >= 2, F.max("value") - F.min("value")).alias("range"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("scenario", "value")))).alias("values"))
    return agg.join(base, ["model", "sheet", "reference"], "left").withColumn("deviation", F.transform_values("values", lambda k, v: v - F.col("base")))


def identities(evaluated: DataFrame, rules: DataFrame) -> DataFrame:
    """Diagnostics of rules(model, name, lhs, rhs map<string,double>, tolerance): cells as sheet!A1, signed sums; a missing side is not judged."""
    cell = checkpointed(evaluated.where("scenario = ''").select("model", F.concat("sheet", F.lit("!"), "reference").alias("at"), "value"))
    left = rules.join(cell.withColumnRenamed("at", "lhs"), ["model", "lhs"]).select("model", "name", F.col("value").alias("l"), "tolerance")
    terms = rules.select("model", "name", F.explode("rhs").alias("at", "sign")).join(cell, ["model", "at"], "left")
    right = terms.groupBy("model", "name").agg(F.when(F.count("value") == F.count(F.lit(1)), F.sum(F.col("value") * F.col("sign"))).alias("r"))
    bad = left.join(right, ["model", "name"]).where(F.abs(F.col("l") - F.col("r")) > F.col("tolerance"))
    return bad.select(F.lit("ArticulationIdentity").alias("kind"), F.to_json(F.struct("model", "name", F.col("l").alias("lhs"), F.col("r").alias("rhs"))).alias("payload"))
