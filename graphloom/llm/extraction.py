"""Main-text extraction: a linear-chain conditional random field over leaf blocks.

A page becomes its leaf blocks in order: the text between block-level tags,
with the tags, classes and ids above it. Each block is article or not; a block's
score comes from features of its ancestors and its text, neighbours are tied by
transition weights, and Viterbi picks the best labelling of the whole page. The
weights are fitted by gradient ascent on labelled pages. Where the best
labelling keeps nothing, the best one with one article is taken if it is nearly
as likely (LEAN).

Scripts, styles, titles, drawings, templates, frames and comments of the markup
are no blocks; each ends at its end tag. One that is never closed ends where the
markup goes on: a comment at its first `>`, a title at the next tag, a script
or style at the next block tag, a drawing or template with the element around
it. What stands for media and formulas (video, object, canvas, math) is text of
its block, and noscript a block of its own. Inside a block white space becomes
one space; a line break counts as a space.

Pages are read in one pass. Paths are shared nodes of a tree that remember what
their ancestors' features weigh, so the cost of a page grows with its length
however deep its markup is.

Defined results: null and empty pages have the empty text; markup that is not
closed or wrongly nested is read as far as it goes; text without any tags is
one block; repeated rows get equal texts; an empty table gives no rows; other
columns stay as they are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled_pages

#: Tags that begin and end blocks; fixed values of the markup language.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td textarea tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page: raw text up to the end tag, and elements with elements in them.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in ("script", "style", "title")}
SILENT = frozenset(("svg", "template"))
#: Opening the tag ends an open one of these, as far as the nearest of STOP.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOP = frozenset("article aside body div fieldset footer form header main nav ol section table ul td th dl blockquote".split())
STRONG = frozenset("article main nav header footer aside form section".split())

MARK = re.compile(r"<(?:(/?)([A-Za-z][^\s/>]*)|(!--)|[!?/])")
#: A quote opens a value only after `=`.
REST = re.compile(r"""(?>[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>""")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
COMMENT_END = re.compile(r"--!?>")
BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(sorted(BLOCK))})(?=[\s/>])", re.I)
FRAME = re.compile(r"<(/?)iframe(?=[\s/>])[^>]*>?", re.I)


#: Pages that the standard model is fitted on.
TRAINING_PAGES = 2000
#: Nats by which keeping something may be less likely than an empty text: pages are read for their texts.
LEAN = 3.0


class Place:
    """A path from the root; own holds the features that no ancestor has."""

    __slots__ = ("up", "tag", "own", "strong", "quiet", "next", "score", "base")

    def __init__(self, up=None, tag="", own=(), quiet=False):
        self.up, self.tag, self.own, self.quiet, self.next, self.score, self.base = up, tag, own, quiet, {}, None, None
        self.strong = () if up is None else (*up.strong[-1:], tag) if tag in STRONG else up.strong

    def form(self) -> bool:
        return "form" in self.strong

    def leaf(self) -> list[str]:
        """Features of the path's end."""
        out = [f"leaf={'' if self.tag in ('html', 'body') else self.tag}"]
        if self.strong:
            out += [f"near={self.strong[-1]}", "chain=" + ">".join(self.strong)]
        if self.form():
            out.append(f"form>{self.tag}")
        return out


def path_features(place: Place) -> list[str]:
    out = place.leaf()
    while place is not None:
        out += place.own
        place = place.up
    return sorted(out)


def names_of(attributes: str) -> tuple[tuple[str, ...], int | None]:
    """Classes, id and role, lower-cased, and the label of a training page."""
    got: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(attributes):
        got.setdefault(name.lower(), "".join(values))
    names = " ".join(filter(None, (got.get("class"), got.get("id"), got.get("role"))))
    return tuple(sorted(set(unescape(names).lower().split()))), int(got["data-keep"]) if "data-keep" in got else None


def block_parser():
    """html -> blocks (place, text, characters in links, label or None)."""
    root, size = Place(), 0
    known: dict[str, tuple] = {}

    def features(tag, names):
        # What a form means depends on what lies between it and the block: see leaf().
        out = {f"in={tag}"} if tag not in ("html", "body", "form") else set()
        if tag in ("section", "div") and not names:
            out.add(f"bare={tag}")
        for n in names if tag not in ("html", "body") else ():
            out.add(f"name={n}")
            out.update(f"word={w}" for w in n.replace("_", "-").split("-") if w and not w.isdigit())
        return out

    def blocks(html):
        nonlocal root, size
        if size > 50_000:
            root, size = Place(), 0
            known.clear()
        html = html or ""
        out, parts, linked, link = [], [], 0, 0
        place, label, inner = root, None, None
        stack: list[tuple] = []  # (tag, place before, its label, its features)
        where: dict[str, list[int]] = {}
        there: dict[str, int] = {}  # features of the open elements
        no_end, broken = set(), False

        def flush():
            nonlocal parts, linked
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    at = place
                    while at.quiet:
                        at = at.up
                    out.append((at, text, linked, label if inner is None else inner))
                parts, linked = [], 0

        def push(tag, names, mark):
            nonlocal place, label, size
            fs = features(tag, names)
            at = place.next.get((tag, names))
            if at is None:
                own = tuple(sorted(f for f in fs if not there.get(f)))
                at = place.next[tag, names] = Place(place, tag, own, place.quiet or tag in SILENT)
                size += 1
            stack.append((tag, place, label, fs))
            where.setdefault(tag, []).append(len(stack) - 1)
            for f in fs:
                there[f] = there.get(f, 0) + 1
            place, label = at, label if mark is None else mark

        def pop(to):
            nonlocal place, label, link
            while len(stack) > to:
                tag, place, label, fs = stack.pop()
                where[tag].pop()
                for f in fs:
                    there[f] -= 1
            if link > to + 1:
                link = 0

        def last(tags):
            return max((w[-1] for t in tags if (w := where.get(t))), default=-1)

        at, n = 0, len(html)
        while True:
            m = MARK.search(html, at)
            start = m.start() if m else n
            if start > at and not place.quiet:
                text = html[at:start]
                parts.append(unescape(text) if "&" in text else text)
                if link:
                    linked += len(parts[-1])
            if not m:
                break
            end = html.find(">", m.end())
            if m[3] and not html.startswith((">", "->"), m.end()):
                done = None if "--" in no_end else COMMENT_END.search(html, m.end())
                if done:
                    at = done.end()
                    continue
                no_end.add("--")
            if end < 0:
                # No tag ends any more: the rest is text.
                if not place.quiet:
                    parts.append(unescape(html[m.end() if m[3] else start :]))
                break
            tag = (m[2] or "").lower()
            if not tag:
                at = end + 1
                continue
            attributes = html[m.end() : end]
            if "=" in attributes and ('"' in attributes or "'" in attributes) and not broken:
                rest = REST.match(html, m.end())
                if rest:
                    end = rest.end() - 1
                    attributes = html[m.end() : end]
                else:
                    broken = True
            at = end + 1
            closing, closed = bool(m[1]), attributes.endswith("/")
            if tag in RAW and not closing:
                done = None if tag in no_end else RAW[tag].search(html, at)
                if done:
                    at = done.end()
                else:
                    no_end.add(tag)
                    done = (MARK if tag == "title" else BLOCK_TAG).search(html, at)
                    at = done.start() if done else n
            elif tag == "iframe":
                done = None if closing else FRAME.search(html, at)
                if done and done[1]:
                    at = done.end()
            elif tag in SILENT:
                if closing and where.get(tag):
                    pop(where[tag][-1])
                elif not closing and not closed:
                    push(tag, (), None)
            elif tag == "br":
                if not place.quiet:
                    parts.append(" ")
            elif tag in BLOCK:
                flush()
                if closing:
                    if where.get(tag):
                        pop(where[tag][-1])
                    inner = None
                    continue
                inner = None
                while where.get("svg"):  # a block tag ends a drawing
                    pop(where["svg"][0])
                if tag in ENDS:
                    i = last(ENDS[tag])
                    if i >= 0 and i > last(STOP - ENDS[tag]):
                        pop(i)
                elif tag not in VOID and stack and stack[-1][0] == "p":
                    pop(len(stack) - 1)
                if tag not in VOID:
                    names, mark = (), None
                    if "=" in attributes:
                        got = known.get(attributes)
                        if got is None:
                            got = known[attributes] = names_of(attributes)
                        names, mark = got
                    push(tag, names, mark)
                    if closed:
                        pop(len(stack) - 1)
            elif tag == "a":
                link = 0 if closing else len(stack) + 1
            elif not closing and "data-keep" in attributes:
                inner = names_of(attributes)[1]
        flush()
        return out

    return blocks


def text_features(text: str, linked: int, form: bool = False) -> list[str]:
    n = text.count(" ") + 1
    share = linked / len(text)
    words = 0 if n < 3 else 1 if n < 6 else 2 if n < 15 else 3 if n < 40 else 4
    return [
        f"words={words}",
        f"links={0 if share < 0.05 else 1 if share < 0.4 else 2 if share < 0.9 else 3}",
        f"end={text[-1] in '.!?:…'}",
        *(["copyright"] if "©" in text else []),
        *([f"form&words={words}"] if form else []),
    ]


@dataclass
class Model:
    weights: dict[str, float]  # for `article` against `not`
    moves: list[list[float]]  # from, to
    first: float

    def viterbi(self, scores) -> list[int]:
        a, b = 0.0, None
        back = []
        m = self.moves
        for i, s in enumerate(scores):
            if not i:
                a, b = 0.0, s + self.first
                continue
            s0 = (a + m[0][0], b + m[1][0])
            s1 = (a + m[0][1], b + m[1][1])
            back.append((s0[1] > s0[0], s1[1] > s1[0]))
            a, b = max(s0), max(s1) + s
        if b is None:
            return []
        at = int(b > a)
        out = [at]
        for x in reversed(back):
            at = int(x[at])
            out.append(at)
        return out[::-1]

    def some(self, scores) -> list[int]:
        """The best labelling; where that keeps nothing, the best one that keeps something, if it is not worse by more than LEAN."""
        best = self.viterbi(scores)
        if any(best) or not best:
            return best
        # Nothing kept so far, in the article, behind it; each with where its article began and ended.
        m, none = self.moves, 0.0
        inside, behind = (-math.inf, 0), (-math.inf, 0, 0)
        for i, s in enumerate(scores):
            begin = (none + m[0][1] if i else self.first) + s
            stay = inside[0] + m[1][1] + s
            leave, rest = inside[0] + m[1][0], behind[0] + m[0][0]
            behind = (leave, inside[1], i) if leave > rest else (rest, *behind[1:])
            inside = (begin, i) if begin > stay else (stay, inside[1])
            none += m[0][0] if i else 0.0
        value, lo, hi = max((inside[0], inside[1], len(scores)), behind)
        return [int(lo <= i < hi) for i in range(len(scores))] if value >= none - LEAN else best


def train(pages: list[str] | None = None, *, steps: int = 150, rate: float = 0.5, decay: float = 1e-3) -> Model:
    """Maximum likelihood of the labels on labelled pages, pages side by side."""
    import numpy as np

    blocks = block_parser()
    found = [[(path_features(p) + text_features(t, a, p.form()), y) for p, t, a, y in blocks(h) if y is not None] for h in (pages or labelled_pages.pages(TRAINING_PAGES))]
    found = [x for x in found if x]
    index: dict[str, int] = {}
    for page in found:
        for fs, _ in page:
            for f in fs:
                index.setdefault(f, len(index))
    n, longest = len(found), max(map(len, found))
    row, col = [], []
    y, there = np.zeros((n, longest), dtype=int), np.zeros((n, longest), dtype=bool)
    for i, page in enumerate(found):
        for j, (fs, label) in enumerate(page):
            y[i, j], there[i, j] = label, True
            row += [i * longest + j] * len(fs)
            col += [index[f] for f in fs]
    row, col = np.array(row), np.array(col)
    w, m, first = np.zeros(len(index)), np.zeros((2, 2)), 0.0
    seen = [np.full(len(index), 1e-6), np.full((2, 2), 1e-6), 1e-6]
    for _ in range(steps):
        s = np.bincount(row, weights=w[col], minlength=n * longest).reshape(n, longest)
        e = np.stack([np.zeros_like(s), s], axis=2)
        e[:, 0, 1] += first
        fwd, bwd = np.zeros_like(e), np.zeros_like(e)
        fwd[:, 0] = e[:, 0]
        for j in range(1, longest):
            step = np.logaddexp(fwd[:, j - 1, 0, None] + m[0], fwd[:, j - 1, 1, None] + m[1]) + e[:, j]
            fwd[:, j] = np.where(there[:, j, None], step, fwd[:, j - 1])
        z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        for j in range(longest - 2, -1, -1):
            nxt = e[:, j + 1] + bwd[:, j + 1]
            step = np.logaddexp(m[:, 0] + nxt[:, 0, None], m[:, 1] + nxt[:, 1, None])
            bwd[:, j] = np.where(there[:, j + 1, None], step, 0.0)
        p = np.exp(np.clip(fwd + bwd - z[:, None, None], -60, 0))[:, :, 1]
        miss = np.where(there, y - p, 0.0)
        g = np.bincount(col, weights=miss.reshape(-1)[row], minlength=len(index)) / n - decay * w
        gm = np.zeros((2, 2))
        both = there[:, 1:]
        for a in (0, 1):
            for b in (0, 1):
                pair = np.exp(np.clip(fwd[:, :-1, a] + m[a, b] + e[:, 1:, b] + bwd[:, 1:, b] - z[:, None], -60, 0))
                gm[a, b] = (np.where(both, (y[:, :-1] == a) & (y[:, 1:] == b), 0) - np.where(both, pair, 0)).sum() / n - decay * m[a, b]
        gf = miss[:, 0].sum() / n
        for i, x in enumerate((g, gm, gf)):
            seen[i] = seen[i] + x * x
        w, m, first = w + rate * g / np.sqrt(seen[0]), m + rate * gm / np.sqrt(seen[1]), first + rate * gf / np.sqrt(seen[2])
    return Model({f: float(w[i]) for f, i in index.items()}, m.tolist(), float(first))


def extractor(model: Model):
    """html -> main text."""
    blocks = block_parser()
    weight = model.weights.get

    def score(place):
        """The weight of a path's features: a node knows its own and adds its parent's."""
        todo, at = [], place
        while at is not None and at.base is None:
            todo.append(at)
            at = at.up
        for p in reversed(todo):
            p.base = (p.up.base if p.up is not None else 0.0) + sum(weight(f, 0.0) for f in p.own)
        place.score = place.base + sum(weight(f, 0.0) for f in place.leaf())
        return place.score

    def extract(html):
        found = blocks(html)
        scores = [(score(p) if p.score is None else p.score) + sum(weight(f, 0.0) for f in text_features(t, linked, p.form())) for p, t, linked, _ in found]
        return "\n\n".join(b[1] for b, keep in zip(found, model.some(scores)) if keep)

    return extract


@lru_cache(maxsize=1)
def standard() -> Model:
    """The model that the labelled pages give; fitted once in a process."""
    return train()


def main_text(pages: DataFrame, *, html: str = "html", out: str = "text", model: Model | None = None) -> DataFrame:
    """pages with their main text; a column of the name `out` is replaced."""
    fitted = model or standard()

    @F.pandas_udf("string")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        extract = extractor(fitted)
        for p in parts:
            yield pd.Series([extract(h) for h in p], dtype=object)

    return pages.withColumn(out, of(F.col(html)))
