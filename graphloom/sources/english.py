"""English text as a graph, from supplied parses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, union
from ..profile import ENGLISH

#: Dependency relations and the grammar edges that they become; fixed values.
GRAMMAR = {"nsubj": "subject", "nsubjpass": "subject", "dobj": "object", "obj": "object", "pobj": "object", "amod": "modifies", "advmod": "modifies", "prep": "attaches-to", "conj": "coordinated-with", "relcl": "refers-to"}


#: A line's container and block marks, by the rules of CommonMark: up to three blanks of indent, quote marks, a bullet or number.
_INDENT = r" {0,3}"
_MARKS = rf"^(?:{_INDENT}>[ \t]?)*(?:{_INDENT}(?:[-+*]|\d{{1,9}}[.)])(?:[ \t]+|$))?(?:{_INDENT}#{{1,6}}(?:[ \t]+|$))?"
_RULE = rf"^{_INDENT}(?:(?:-[ \t]*){{3,}}|(?:_[ \t]*){{3,}}|(?:\*[ \t]*){{3,}}|=+[ \t]*)$"
_FENCE = rf"^{_INDENT}(?:```|~~~)"
#: Code spans, images and links (inline and by reference), automatic links and tags, and runs of emphasis around words.
_SPANS = ((r"(`+)[ ]?([^`]+?)[ ]?\1", "$2"), (r"!?\[((?:[^\[\]]|\[[^\]]*\])*)\](?:\([^()\s]*(?:\s+[^()]*)?\)|\[[^\]]*\])", "$1"), (r"<((?:https?|mailto):[^\s<>]+)>", "$1"), (r"(?<![\w\\])(\*{1,3}|_{1,3})(?=\S)([^*_]+?)(?<=\S)\1(?!\w)", "$2"), (r"\\([!-/:-@\[-`{-~])", "$1"))


def clean_lines(text: Column) -> Column:
    """The lines of a Markdown text that hold prose, as an array of (line, text): line is the place in the input, from 1.

    Fenced code, rules and empty lines are left out; marks of quotes, lists and
    headings are taken off; spans keep what a reader sees.
    """
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n")
    start = F.struct(F.lit(False).alias("code"), F.array().cast("array<struct<line:int,text:string>>").alias("kept"))

    def step(s, x):
        fence = x["value"].rlike(_FENCE)
        plain = F.regexp_replace(x["value"], _MARKS, "")
        for pattern, put in _SPANS:
            plain = F.regexp_replace(plain, pattern, put)
        prose = ~s["code"] & ~fence & ~x["value"].rlike(_RULE) & (F.trim(plain) != "")
        kept = F.when(prose, F.concat(s["kept"], F.array(F.struct(x["line"].alias("line"), F.trim(plain).alias("text"))))).otherwise(s["kept"])
        return F.struct((s["code"] != fence).alias("code"), kept.alias("kept"))

    numbered = F.transform(lines, lambda x, i: F.struct((i + 1).cast("int").alias("line"), x.alias("value")))
    return F.aggregate(numbered, start, step, lambda s: s["kept"])


def clean_markdown(text: Column) -> Column:
    """The prose of a Markdown text, a line for each line of it."""
    return F.array_join(F.transform(clean_lines(text), lambda x: x["text"]), "\n")


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, seq, sentence): split after . ! or ? before a blank, and at line ends."""
    parts = F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"([.!?])[ \t\n\r]+", "$1\n"), r"\n+")
    d = docs.select(F.col(key).alias("doc"), F.posexplode(parts).alias("pos", "sentence")).where("trim(sentence) <> ''")
    return d.select("doc", F.col("pos").cast("int").alias("seq"), F.trim("sentence").alias("sentence"))


def containment(docs: DataFrame, package: str = "text") -> Graph:
    """Documents and their sentences."""
    s = sentences(docs)
    doc = F.concat(F.lit(f"{package}::d"), F.col("doc"))
    sid = F.concat(doc, F.lit("::s"), F.col("seq"))
    nodes = s.select(doc.alias("id"), F.lit("document").alias("kind"), F.col("doc").cast("string").alias("label"), F.lit(None).cast("int").alias("decisions")).distinct()
    nodes = nodes.union(s.select(sid, F.lit("sentence"), F.col("sentence"), F.lit(None).cast("int")))
    edges = s.select(doc.alias("src"), sid.alias("dst"), F.lit("contains").alias("kind"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("map<string,string>").alias("attrs"))
    return Graph(nodes.withColumns({"refs": F.lit(None).cast("array<string>"), "measures": F.lit(None).cast("map<string,string>")}), edges, ENGLISH)


def parsed(tokens: DataFrame, package: str = "text") -> Graph:
    """A graph of tokens(doc, sentence, token, lemma, pos, relation, head).

    Verbs are predicates, nouns entities; relations between them become grammar
    edges, predicates of a sentence precede each other in order. No claim
    kinds: these need a claimant and are refused by the build's gate.
    """
    t = tokens.withColumn("sid", F.concat(F.lit(f"{package}::d"), "doc", F.lit("::s"), "sentence"))
    kind = F.when(F.col("pos").isin("VERB", "AUX"), "predicate").when(F.col("pos").isin("NOUN", "PROPN", "PRON"), "entity")
    t = t.withColumns({"kind": kind, "id": F.concat("sid", F.lit("::t"), "token")})
    none = {"decisions": F.lit(None).cast("int"), "refs": F.lit(None).cast("array<string>"), "measures": F.lit(None).cast("map<string,string>")}
    doc = F.concat(F.lit(f"{package}::d"), F.col("doc"))
    nodes = union([t.select(doc.alias("id"), F.lit("document").alias("kind"), F.col("doc").cast("string").alias("label")).distinct(), t.select(F.col("sid").alias("id"), F.lit("sentence").alias("kind"), F.col("sid").alias("label")).distinct(), t.where("kind is not null").select("id", "kind", F.col("lemma").alias("label"))])
    kept = t.where("kind is not null")
    inside = union([t.select(doc.alias("src"), F.col("sid").alias("dst")).distinct(), kept.select(F.col("sid").alias("src"), F.col("id").alias("dst"))]).withColumn("kind", F.lit("contains"))
    rel = F.create_map(*[F.lit(x) for kv in GRAMMAR.items() for x in kv])
    heads = kept.select("sid", F.col("token").alias("head"), F.col("id").alias("src"))
    gram = kept.select("sid", "head", F.col("id").alias("dst"), F.element_at(rel, F.col("relation")).alias("kind")).where("kind is not null").join(heads, ["sid", "head"]).where("src <> dst").select("src", "dst", "kind")
    from pyspark.sql import Window

    nxt = F.lead("id").over(Window.partitionBy("sid").orderBy("token"))
    order = kept.where("kind = 'predicate'").select(F.col("id").alias("src"), nxt.alias("dst"), F.lit("precedes").alias("kind")).where("dst is not null")
    edges = union([inside, gram, order]).distinct().withColumns({"line": F.lit(None).cast("int"), "attrs": F.lit(None).cast("map<string,string>")})
    return Graph(nodes.withColumns(none), edges, ENGLISH)
