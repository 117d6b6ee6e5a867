"""Fill-in-the-middle: documents with a passage moved behind what follows it.

A text is a row of units, `[A-Za-z]+|[^A-Za-z]` from left to right. Two cuts
are chosen by unit, so the units must be counted first and then a unit be found
by its number, without a list of all units. A character starts a unit unless it
and the one before it are both letters; so a text falls into chunks that each
also see the character before them, and every chunk counts its starts alone.
Sums over the counts before a chunk tell which chunk a cut's number falls into,
and only that chunk is read again.

Chunks of CHUNK characters are counted inside the row. A text of more than
PIECE characters is dealt out first: its pieces, each with the character before
it, are rows of their own that any task may take, and only counts and the two
places found come back to the text. Everything runs in the JVM.

Defined results: null is the empty text and an empty text is plain; so are
texts that hold a marker. A null key is drawn as an empty one; rows with equal
keys and texts get equal results, each for itself; an empty table gives no
rows; columns of docs other than the ones this adds stay as they are, and a
column of an added name is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import boxed, col, written

CHUNK, PIECE = 2048, 1 << 18
MARKERS = PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: In a hundred: texts that stay plain from this draw on; of the others, spm below that one.
PLAIN_FROM, SPM_BELOW = 90, 20

_UNIT = "[A-Za-z]+|[^A-Za-z]"


def _starts(text: Column, before: Column) -> Column:
    """How many units start in text, which follows the character before (empty at the beginning)."""
    seen = F.concat(F.when(before == "", " ").otherwise(before), text)
    return F.char_length(F.regexp_replace(seen, "(?<=[A-Za-z])[A-Za-z]+", "")) - 1


def _counts(text: Column, before: Column) -> Column:
    """The starts of each chunk of text."""
    chunks = F.ceil(F.char_length(text) / CHUNK).cast("int")

    def of(i: Column) -> Column:
        last = F.when(i == 0, before).otherwise(F.substring(text, i * CHUNK, F.lit(1)))
        return _starts(F.substring(text, i * CHUNK + 1, F.lit(CHUNK)), last)

    return F.when(chunks > 0, F.transform(F.sequence(F.lit(0), chunks - 1), of)).otherwise(F.array().cast("array<int>"))


def _place(text: str, before: str, counts: str, rank: str) -> Column:
    """At which character of text its unit number `rank` starts; the end of text where it has none of that number."""
    text, before, counts, rank = map(F.col, (text, before, counts, rank))
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).alias("chunk"), F.lit(0).cast("long").alias("rank"), F.lit(0).alias("i"))

    def step(a: Column, c: Column) -> Column:
        here = (a["chunk"] < 0) & (a["sum"] + c > rank)
        return F.struct(
            (a["sum"] + c).alias("sum"),
            F.when(here, a["i"]).otherwise(a["chunk"]).alias("chunk"),
            F.when(here, rank - a["sum"]).otherwise(a["rank"]).alias("rank"),
            (a["i"] + 1).alias("i"),
        )

    def inside(at: Column) -> Column:
        i = at["chunk"]
        chunk = F.substring(text, i * CHUNK + 1, F.lit(CHUNK))
        last = F.when(i == 0, before).otherwise(F.substring(text, i * CHUNK, F.lit(1)))
        # The first match belongs to a unit that starts earlier where letters go on.
        carried = (last.rlike("^[A-Za-z]$") & chunk.rlike("^[A-Za-z]")).cast("int")
        ahead = F.slice(F.regexp_extract_all(chunk, F.lit(_UNIT), F.lit(0)), F.lit(1), (at["rank"] + carried).cast("int"))
        return F.when(i < 0, F.char_length(text)).otherwise(i * CHUNK + F.aggregate(ahead, F.lit(0), lambda n, u: n + F.char_length(u)))

    return F.element_at(F.transform(F.array(F.aggregate(counts, zero, step)), inside), 1).cast("long")


def _draws(key: Column) -> list[Column]:
    """Four numbers below 2**32 that only the key decides."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _ranked(df: DataFrame) -> DataFrame:
    """df(h1, h2, n) with the numbers of both cuts."""
    a, b = F.pmod("h1", F.col("n") + 1), F.pmod("h2", F.col("n") + 1)
    return df.withColumns({"r1": F.least(a, b), "r2": F.greatest(a, b)})


def _short(d: DataFrame) -> DataFrame:
    """d(text, h1, h2) with n and both places, counted and read again inside the row."""
    d = d.withColumn("before", F.lit("")).withColumn("counts", _counts(F.col("text"), F.col("before")))
    d = _ranked(d.withColumn("n", F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c)))
    d = d.withColumns({f"p{k}": _place("text", "before", "counts", f"r{k}") for k in (1, 2)})
    return d.drop("before", "counts", "r1", "r2")


def _long(d: DataFrame) -> DataFrame:
    """The same for texts of many pieces: counted by any task, read again where a cut's piece is."""
    d = written(d.withColumn("rid", F.monotonically_increasing_id()), "long-texts")
    pieces = F.ceil(F.char_length("text") / PIECE).cast("int")
    numbers = d.select("rid", "h1", "h2", "text", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("no"))
    piece = numbers.select(
        "rid", "h1", "h2", "no",
        F.substring(F.col("text"), F.col("no") * PIECE + 1, F.lit(PIECE)).alias("text"),
        F.when(F.col("no") == 0, "").otherwise(F.substring(F.col("text"), F.col("no") * PIECE, F.lit(1))).alias("before"),
    ).repartition("rid", "no")
    piece = piece.withColumn("counts", _counts(F.col("text"), F.col("before")))
    piece = written(piece.withColumn("m", F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c)), "pieces")
    w = Window.partitionBy("rid")
    ends = piece.select("rid", "no", "h1", "h2", "m").withColumns({"n": F.sum("m").over(w), "upto": F.sum("m").over(w.orderBy("no"))})
    ends = _ranked(ends).withColumn("base", F.col("upto") - F.col("m"))
    # A cut behind the last unit is the text's end and has no piece.
    owned = [ends.where((F.col(f"r{k}") >= F.col("base")) & (F.col(f"r{k}") < F.col("upto"))).select("rid", "no", F.lit(k).alias("k"), (F.col(f"r{k}") - F.col("base")).alias("r")) for k in (1, 2)]
    found = piece.join(owned[0].union(owned[1]), ["rid", "no"]).select("rid", "k", (F.col("no").cast("long") * PIECE + _place("text", "before", "counts", "r")).alias("p"))
    n = ends.groupBy("rid").agg(F.first("n").alias("n"))
    at = found.groupBy("rid").agg(*[F.max(F.when(F.col("k") == k, F.col("p"))).alias(f"p{k}") for k in (1, 2)])
    end = F.char_length("text").cast("long")
    return d.join(n.join(at, "rid", "left"), "rid").withColumns({f"p{k}": F.coalesce(f"p{k}", end) for k in (1, 2)}).drop("rid")


def restored(output: Column, form: Column) -> Column:
    """The text again, from the output and its form alone."""
    body = F.substring(output, F.lit(4), F.char_length(output))

    def behind(s: Column, mark: str) -> Column:
        return F.substring(s, F.char_length(F.substring_index(s, mark, 1)) + 4, F.char_length(s))

    psm = F.concat(F.substring_index(body, SUFFIX, 1), behind(body, MIDDLE), F.substring_index(behind(body, SUFFIX), MIDDLE, 1))
    spm = F.concat(F.substring_index(behind(body, PREFIX), MIDDLE, 1), behind(body, MIDDLE), F.substring_index(body, PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def transform(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars and output."""
    h = _draws(col(key))
    d = boxed(docs, text=F.coalesce(col(text), F.lit("")), **{f"h{i + 1}": x for i, x in enumerate(h)})
    length = F.char_length("text")
    d = _short(d.where(length <= PIECE)).unionByName(_long(d.where(length > PIECE)))
    marked = F.lit(False)
    for m in MARKERS:
        marked = marked | F.contains("text", F.lit(m))
    form = F.when((F.col("text") == "") | marked | (F.pmod("h3", F.lit(100)) >= PLAIN_FROM), "plain").when(F.pmod("h4", F.lit(100)) < SPM_BELOW, "spm").otherwise("psm")
    d = d.withColumn("form", form)
    part = {
        "a": F.substring(F.col("text"), F.lit(1), F.col("p1").cast("int")),
        "b": F.substring(F.col("text"), F.col("p1").cast("int") + 1, (F.col("p2") - F.col("p1")).cast("int")),
        "c": F.substring(F.col("text"), F.col("p2").cast("int") + 1, F.char_length("text")),
    }
    out = F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), part["a"], F.lit(SUFFIX), part["c"], F.lit(MIDDLE), part["b"]))
    out = out.when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), part["c"], F.lit(PREFIX), part["a"], F.lit(MIDDLE), part["b"])).otherwise(F.col("text"))
    cut = F.col("form") != "plain"
    added = {"n": F.col("n"), "form": F.col("form"), "prefix_chars": F.when(cut, F.col("p1")), "middle_chars": F.when(cut, F.col("p2") - F.col("p1")), "output": out}
    rest = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in added]
    return d.select(*rest, *[c.alias(name) for name, c in added.items()])
