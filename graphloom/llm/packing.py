"""Best-fit packing with certified bin counts.

Documents are tokenized whole, each ends with id 0, and only documents longer
than a sequence are cut. Pieces are dealt to groups of about `group_rows`; each
group is packed best-fit decreasing. A lower bound from dual feasible functions
says how few sequences any packing of a group needs. Groups that reach theirs
are done. Groups with a gap put the pieces of their unfilled sequences into a
pool, dealt anew to groups in which they meet pieces of other groups, and
best-fit decreasing runs again there; an exchange is kept if the pool then takes
fewer sequences. Rounds end when no gap is left, when one saves no sequence, or
after `rounds` of them; a gap that is then left costs sequences, no piece.

A group is a bounded number of rows of three numbers, whatever the input size;
texts are read once and leave only lengths and checksums.

Defined results: null and empty texts are the single id 0; repeated rows are
documents of their own; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, written

LENGTH = 2048
#: Words remembered in a task; beyond it the memory starts afresh.
MEMO = 400_000


#: The steps that the encoder knows how to take itself; fixed values of the tokenizer's format.
STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def encoder(path: str):
    """texts -> their ids as arrays of 32-bit numbers, as the tokenizer itself gives them.

    A tokenizer whose normalizer and split are exactly STEPS lets nothing cross
    a blank or line end, so what stands between them is encoded once and
    remembered; its steps are done here for scripts whose letters no Unicode
    version disputes, and only runs that are new reach its merges. Any other
    tokenizer gets whole texts.
    """
    import json
    import unicodedata
    from array import array

    import numpy as np
    import regex
    from tokenizers import Tokenizer

    tok, memo, runs = Tokenizer.from_file(path), {}, {}
    tok.no_truncation()
    tok.no_padding()
    with open(path, encoding="utf-8") as f:
        parts = json.load(f)
    known = all(parts.get(k) == v for k, v in STEPS.items()) and parts["model"]["type"] == "BPE" and not parts["model"].get("dropout")
    marks = [x["content"] for x in parts["added_tokens"]]
    known = known and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in parts["added_tokens"])
    del parts
    if not known:
        return lambda texts: [np.array(x.ids, dtype="<u4") for x in tok.encode_batch(list(texts), add_special_tokens=False)]
    find = regex.compile(STEPS["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")).findall
    merge = tok.model.tokenize
    # The byte-level alphabet: printable bytes stand for themselves, the others for 256 and on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    alphabet = {b: chr(b if b in plain else next(rest)) for b in range(256)}

    def run(r):
        got = runs.get(r)
        if got is None:
            s = r if r.isascii() and r.isprintable() else r.encode().decode("latin-1").translate(alphabet)
            got = runs[r] = array("I", [t.id for t in merge(s)]).tobytes()
        return got

    def word(w):
        if not (w.isascii() or max(w) < "\u0530"):
            return array("I", tok.encode(w, add_special_tokens=False).ids).tobytes()
        if w.isascii():
            w = w.lower()
            if w.isalpha():
                return run(w)
        else:
            w = unicodedata.normalize("NFC", w).replace("\u03a3", "\u03c3").lower()
        return b"".join(map(run, find(w)))

    def encode(texts):
        out, split = [None] * len(texts), []
        for i, t in enumerate(texts):
            if any(m in t for m in marks):
                out[i] = np.array(tok.encode(t, add_special_tokens=False).ids, dtype="<u4")
                split.append(())
            else:
                split.append(t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))
        if len(memo) > MEMO:
            memo.clear()
            runs.clear()
        for w in set().union(*split) - memo.keys():
            memo[w] = word(w)
        get = memo.__getitem__
        return [np.frombuffer(b"".join(map(get, ws)), dtype="<u4") if o is None else o for o, ws in zip(out, split)]

    return encode


def pieces(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = 0) -> DataFrame:
    """(rid, key, piece, start, length, ids_crc32): whole documents cut only where longer than length."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    d = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).cast("string").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, end = encoder(tokenizer), np.array([end_id], dtype="<u4")
        for b in batches:
            for at in range(0, len(b), 500):
                some, out = b.iloc[at : at + 500], []
                for rid, k, ids in zip(some["rid"], some["k"], encode(some["t"])):
                    ids = np.concatenate([ids, end])
                    for n, s in enumerate(range(0, len(ids), length)):
                        p = ids[s : s + length]
                        out.append((rid, k, n, s, len(p), zlib.crc32(p.tobytes())))
                yield pd.DataFrame(out, columns=["rid", "k", "piece", "start", "length", "ids_crc32"])

    kind = dict(docs.select(F.col(key).alias("k")).dtypes)["k"]
    got = d.mapInPandas(cut, "rid long, k string, piece int, start long, length long, ids_crc32 long")
    return got.select("rid", F.col("k").cast(kind).alias(key), *got.columns[2:])


def best_fit(lengths, room: int) -> tuple[list[int], list[int]]:
    """Best-fit of lengths in the order given: each one's sequence and place; ties to the sequence that got there first."""
    open_by: list[list[int]] = [[] for _ in range(room + 1)]  # by room left
    mask, seq, place, n = 0, [], [], 0
    for x in lengths:
        fits = mask >> x
        if x < room and fits:
            left = x + (fits & -fits).bit_length() - 1
            s = open_by[left].pop()
            if not open_by[left]:
                mask &= ~(1 << left)
        else:
            s, left, n = n, room, n + 1
        seq.append(s)
        place.append(room - left)
        left -= x
        if left:
            open_by[left].append(s)
            mask |= 1 << left
    return seq, place


def lower_bound(counts, room: int) -> int:
    """Fewest sequences for counts[x] pieces of length x, by two families of dual feasible functions.

    For a threshold t in (0, room/2]: pieces above room - t count whole, pieces
    below t not at all, others by length. For k: pieces count floor((k + 1) x /
    room) / k, and x / room where (k + 1) x / room is whole.
    """
    import numpy as np

    x = np.arange(len(counts))
    best = ceil(int((counts * x).sum()) / room)
    above = np.concatenate([np.cumsum(counts[::-1])[::-1], [0]])
    mass = np.concatenate([[0], np.cumsum(counts * x)])
    for t in range(1, room // 2 + 1):
        total = int(above[room - t + 1]) * room + int(mass[room - t + 1] - mass[t])
        best = max(best, ceil(total / room))
    for k in range(1, 21):
        num = (k + 1) * x
        f = np.where(num % room == 0, x * k, (num // room) * room)  # in 1 / (k * room)
        best = max(best, ceil(int((counts * f).sum()) / (k * room)))
    return best


def _packer(room: int):
    def pack(g: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        g = g.sort_values(["length", "rid", "piece"], ascending=[False, True, True], kind="stable")
        seq, place = best_fit(g["length"].tolist(), room)
        counts = np.bincount(g["length"].to_numpy(dtype=np.int64), minlength=room + 1)
        used = np.bincount(seq, weights=g["length"].to_numpy(dtype=float))
        n = len(used)
        return g.assign(seq=np.array(seq, dtype=np.int64), offset=np.array(place, dtype=np.int64), bins=n, bound=lower_bound(counts, room), full=(used[seq] == room))[["rid", "piece", "length", "g", "seq", "offset", "bins", "bound", "full"]]

    return pack


PACKED = "rid long, piece int, length long, g long, seq long, offset long, bins long, bound long, full boolean"


def pack(cut: DataFrame, *, length: int = LENGTH, group_rows: int = 16_384, rounds: int = 12) -> DataFrame:
    """cut (rid, piece, length, ...) with sequence_id and offset."""
    spark = cut.sparkSession
    small = cut.where(F.col("length") < length)
    n = small.count()
    todo = small.select("rid", "piece", "length")
    done, scratch = [], Scratch(spark)
    before = None
    for turn in range(rounds + 1):
        groups = max(1, ceil(n / group_rows))
        dealt = todo.withColumn("g", F.pmod(F.xxhash64("rid", "piece", F.lit(turn)), F.lit(groups)).cast("long"))
        now = scratch.keep(dealt.groupBy("g").applyInPandas(_packer(length), PACKED).withColumn("turn", F.lit(turn)), "packed")
        s = now.groupBy("g").agg(F.first("bins").alias("bins"), F.first("bound").alias("bound")).agg(F.sum("bins").alias("bins"), F.sum("bound").alias("bound"), F.count(F.lit(1)).alias("groups")).first()
        if before is not None:
            # The pool took before[0] sequences; the new packing counts only if it takes fewer.
            if (s["bins"] or 0) >= before[0]:
                done.append(before[1])
                break
        gap = F.col("bins") > F.col("bound")
        loose = gap & ~F.col("full")
        done.append(now.where(~loose))
        if turn == rounds or s["bins"] == s["bound"] or groups == 1:
            done.append(now.where(loose))
            break
        pool = now.where(loose)
        c = pool.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("g", "seq").alias("bins")).first()
        n, before, todo = c["n"], (c["bins"], pool), pool.select("rid", "piece", "length")
    got = done[0]
    for d in done[1:]:
        got = got.union(d)
    # Numbers that no other turn or group has: a group has fewer than 2**24 sequences, there are fewer than 16 turns.
    code = F.col("turn").cast("long") * (1 << 59) + F.col("g") * (1 << 24) + F.col("seq")
    got = got.select("rid", "piece", code.alias("sequence_id"), "offset")
    whole = cut.where(F.col("length") == length).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return small.join(got, ["rid", "piece"]).select(*cut.columns, "sequence_id", "offset").union(whole.select(*cut.columns, "sequence_id", "offset"))


def packed(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, **options) -> DataFrame:
    cut = written(pieces(docs, tokenizer, key=key, text=text, length=length), "pieces")
    return pack(cut, length=length, **options).select(key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
