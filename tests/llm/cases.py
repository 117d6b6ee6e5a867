"""Small tables with the awkward cases: nulls, empty and long texts, copies, ties, clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, score string, start string, kept string"


def words(r, n, letters="abcdefgh"):
    return " ".join("".join(r.choices(letters, k=r.randint(2, 7))) for _ in range(n))


def rows(seed=0):
    r = random.Random(seed)
    shared = words(r, 60)
    out = []
    for i in range(40):
        text = words(r, r.randint(1, 120), "abcdefgh" if i % 2 else "mnopqrst")
        if i % 5 == 0:
            text = f"{text}\n{shared}  {words(r, 10)}"
        out.append((i, text, "xx" if i % 2 else "yy", f"s{i % 3}"))
    out += [(100, None, "xx", "s0"), (101, "", None, None), (102, " \t\n ", "yy", "s1"), (103, "!!! 123", "xx", "s1"), (104, "one", "xx", None)]
    out += [(105 + i, out[7][1], "xx", "s2") for i in range(12)]  # exact copies
    out += [(120, out[9][1] + " tail", "xx", "s2"), (121, words(r, 6000), "xx", "s0"), (None, "no key here", "xx", "s0"), (None, None, None, None)]
    out += [out[3], out[3]]  # repeated rows
    return [(i, t, lang, s, None, 1, "q", "q", "q", "q") for i, t, lang, s in out]


def docs(spark, seed=0):
    return spark.createDataFrame(rows(seed), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
