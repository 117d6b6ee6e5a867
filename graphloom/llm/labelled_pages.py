"""Labelled pages, made by rule, to train the block classifier on.

A page is a random layout of parts as pages have them: menus, headers, adverts,
notices, forms, sidebars, reader comments and footers around or inside an
article. Most pages say little by their names: on two thirds all names are left
out or made up, parts lie in nested wrappers without a meaning or in the columns
of a grid, and a page may be an article and reader comments and nothing else.
Some are untidy, as real ones are: a form around everything, articles without a
name or without any tags, end tags left out. Each leaf block carries its label in the attribute data-keep, which
the trainer reads and no feature does.
"""

from __future__ import annotations

import random

SYLLABLES = "ba de fi go ku la me ni po ru sa te vi wo ze tion er in an re".split()
#: Names that markup commonly gives to parts; fixed values.
NAMES = {
    "menu": "menu nav navbar navigation main-menu topnav breadcrumbs breadcrumb tabs pagination toc site-nav".split(),
    "header": "header site-header page-header masthead banner top topbar branding logo".split(),
    "footer": "footer site-footer page-footer bottom copyright colophon legal".split(),
    "sidebar": "sidebar side aside related related-posts widget widgets rail right-column recommended more-stories".split(),
    "notice": "notice cookie cookie-notice cookie-banner consent gdpr alert warning modal popup disclaimer".split(),
    "advert": "ad ads advert advertisement adsbygoogle sponsored sponsor promo promotion ad-slot ad-container".split(),
    "form": "search search-form newsletter subscribe signup login contact-form".split(),
    "comments": "comments comment comment-list commentlist comment-body responses replies disqus reply discussion".split(),
    "share": "share social social-links sharing tags meta byline".split(),
    "article": "article content main main-content post post-content entry entry-content story story-body article-body text body-text page-content".split(),
}


#: Names of wrappers that say how a part is placed and not what it is; fixed values.
LAYOUT = "container container-fluid row col col-md-8 col-md-4 col-sm-12 wrapper wrap inner outer grid flex box block section left right center clearfix a b c x".split()


class Page:
    def __init__(self, seed: int, names: dict[str, list[str]]):
        self.r, self.out, self.names = random.Random(seed), [], names
        #: Share of the names that say nothing, and of parts without one: of the whole page, mostly.
        self.made_up, self.nameless = self.r.choice([(0.2, 0.2), (1.0, 0.2), (0.5, 1.0)])

    def named(self, part: str) -> str:
        """A usual name of the part, or one that says nothing: prose in a part that nothing marks as another is an article's."""
        if self.r.random() < (self.made_up if part in ("article", "menu", "share") else 0.12):
            return "".join(self.r.choices(SYLLABLES, k=2)) + self.r.choice(["", "-1", "_x"])
        return self.r.choice(self.names[part])

    def words(self, lo: int, hi: int, end: str = "") -> str:
        n = self.r.randint(lo, hi)
        return " ".join("".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 4))) for _ in range(n)).capitalize() + end

    def name(self, part: str) -> str:
        if self.r.random() < (self.nameless if part in ("article", "menu") else 0.2):
            return ""
        return f' {self.r.choice(["class", "class", "id"])}="{self.named(part)}"'

    def leaf(self, tag: str, text: str, keep: bool) -> None:
        self.out.append(f'<{tag} data-keep="{int(keep)}">{text}</{tag}>')

    def inside(self, tag: str, attrs: str, body) -> None:
        self.out.append(f"<{tag}{attrs}>")
        body()
        self.out.append(f"</{tag}>")

    def box(self, part: str, tags: list[str], body) -> None:
        tag = self.r.choice(tags)
        named = self.name(part) if tag in ("nav", "header", "footer", "aside", "form", "ul", "article", "main") else f' class="{self.named(part)}"'
        self.inside(tag, named, body)

    def wrapped(self, body, most: int = 6) -> None:
        """Inside wrappers that mean nothing, sometimes many of them."""
        deep = self.r.randint(7, 40) if self.r.random() < 0.05 else self.r.randint(0, most)
        tags = [self.r.choice(["div", "div", "div", "div", "section"]) for _ in range(deep)]
        for t in tags:
            self.out.append(f"<{t}{self.neutral()}>")
        body()
        self.out += [f"</{t}>" for t in reversed(tags)]

    def neutral(self) -> str:
        kind = self.r.random()
        if kind < 0.4:
            return ""
        if kind < 0.7:
            return f' class="{self.r.choice(LAYOUT)}"'
        return f' {self.r.choice(["class", "id"])}="{"".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 3)))}"'

    def grid(self, bodies) -> None:
        """Columns in a row, each a part of the page."""
        def row():
            for body in bodies:
                self.inside("div", self.neutral(), body)

        self.inside("div", self.neutral(), lambda: self.inside("div", self.neutral(), row))

    def links(self) -> None:
        for _ in range(self.r.randint(2, 7)):
            self.leaf("li", f'<a href="/x">{self.words(1, 3)}</a>', False)

    def links_column(self) -> None:
        self.inside("ul", "", self.links)

    def menu(self) -> None:
        self.box("menu", ["nav", "nav", "div", "ul"], self.links)

    def header(self) -> None:
        def body():
            self.leaf(self.r.choice(["div", "h1", "p", "h2"]), self.words(1, 5), False)
            if self.r.random() < 0.5:
                self.menu()

        self.box("header", ["header", "header", "div"], body)

    def advert(self) -> None:
        self.box("advert", ["div", "aside", "ins"], lambda: self.leaf(self.r.choice(["p", "div", "div"]), self.words(3, 30, "."), False))

    def bare(self, part: str) -> None:
        """A part that is one leaf itself."""
        tag = "footer" if part == "footer" and self.r.random() < 0.6 else "div"
        named = "" if tag == "footer" and self.r.random() < 0.5 else f' class="{self.named(part)}"'
        self.out.append(f'<{tag}{named} data-keep="0">{"&copy; " * (part == "footer")}{self.words(3, 25, ".")}</{tag}>')

    def notice(self) -> None:
        def body():
            self.leaf("p", self.words(5, 30, "."), False)
            if self.r.random() < 0.5:
                self.leaf("button", self.words(1, 2), False)

        self.box("notice", ["div", "section"], body)

    def form(self) -> None:
        def body():
            self.leaf("label", self.words(1, 4), False)
            if self.r.random() < 0.5:
                self.leaf("p", self.words(4, 20, "."), False)
            self.leaf("button", self.words(1, 2), False)

        self.inside("form", self.name("form"), body)

    def sidebar(self) -> None:
        def body():
            self.leaf(self.r.choice(["h2", "h3"]), self.words(1, 4), False)
            if self.r.random() < 0.6:
                self.links()
            else:
                self.leaf("p", self.words(5, 50, "."), False)

        self.box("sidebar", ["aside", "aside", "div"], body)

    def comments(self) -> None:
        def body():
            self.leaf(self.r.choice(["h2", "h3"]), self.words(1, 3), False)
            for _ in range(self.r.randint(1, 5)):
                self.inside(self.r.choice(["div", "li", "article"]), f' class="{self.named("comments")}"', lambda: (self.leaf("span", self.words(1, 2), False), self.leaf("p", self.words(3, 60, "."), False)))

        self.box("comments", ["section", "div", "ol"], body)

    def footer(self) -> None:
        def body():
            if self.r.random() < 0.5:
                self.links()
            self.leaf("p", "&copy; " + self.words(2, 20, "."), False)

        self.box("footer", ["footer", "footer", "div"], body)

    def article(self) -> None:
        def prose():
            for _ in range(self.r.choice([1, 1, 2, 3, 4, 6, 9])):
                kind = self.r.random()
                if kind < 0.7:
                    text = self.words(1, 90, ".")
                    self.leaf("p", f'<b>{text}</b> <a href="/y">{self.words(1, 3)}</a>' if self.r.random() < 0.2 else text, True)
                elif kind < 0.78:
                    self.leaf(self.r.choice(["h2", "h3", "h4"]), self.words(1, 8), True)
                elif kind < 0.84:
                    self.inside("ul", "", lambda: [self.leaf("li", self.words(1, 15), True) for _ in range(3)])
                elif kind < 0.87:
                    self.leaf("blockquote", self.words(5, 40, "."), True)
                elif kind < 0.9:
                    self.inside("table", "", lambda: self.inside("tr", "", lambda: [self.leaf("td", self.words(1, 4), True) for _ in range(3)]))
                elif kind < 0.92:
                    self.leaf("pre", self.words(2, 20), True)
                elif kind < 0.94:
                    self.inside("figure", "", lambda: self.leaf("figcaption", self.words(3, 12), True))
                elif kind < 0.97:
                    self.r.choice([self.advert, self.notice, self.form, self.sidebar, lambda: self.bare("advert")])()
                else:
                    self.inside("div", f' class="{self.named("share")}"', lambda: self.leaf("span", f'<a href="/s">{self.words(1, 2)}</a>', False))

        def body():
            if self.r.random() < 0.6:
                self.leaf(self.r.choice(["h1", "h1", "h2"]), self.words(1, 12), True)
            if self.r.random() < 0.2:
                self.inside("div", f' class="{self.named("article")}"', prose)
            else:
                prose()
            if self.r.random() < 0.2:
                self.comments()

        def bare():
            """Text between line breaks, with no tag of its own."""
            return "<br><br>".join(self.words(5, 90, ".") for _ in range(self.r.randint(1, 5)))

        kind = self.r.random()
        tag = self.r.choice(["article", "article", "article", "main", "div", "div", "section"])
        name = f' class="{self.named("article")}"'
        if self.nameless == 1.0 and self.r.random() < 0.7:
            name = ""
        if kind < 0.06:
            self.out.append(f'<{tag}{name} data-keep="1">{bare()}</{tag}>')
        elif kind < 0.1:
            self.out.append(bare())
        elif kind < 0.22:
            self.inside(self.r.choice(["section", "section", "div", "td"]), "", body)
        elif kind < 0.26:
            body()
        else:
            self.inside(tag, name if tag in ("div", "section") or self.r.random() < 0.4 else "", body)

    def html(self) -> str:
        r = self.r
        if r.random() < 0.02:  # text with hardly a tag
            return f'<body data-keep="1">{self.words(5, 200, ".")}'
        if r.random() < 0.05:
            self.out.append('<noscript data-keep="0">' + self.words(4, 20, ".") + "</noscript>")
        if r.random() < 0.35:  # nothing but the article, and perhaps comments on it
            self.wrapped(self.article)
            if r.random() < 0.5:
                self.box("comments", ["div", "section"], lambda: [self.leaf("p", self.words(3, 60, "."), False) for _ in range(r.randint(1, 4))])
            return f'<html><body data-keep="1">{"".join(self.out)}</body></html>'
        around = r.random() < 0.1
        if around:
            self.out.append(f'<form id="{self.r.choice(["aspnetForm", "form1", "mainform"])}">')
        for part, chance in ((self.notice, 0.2), (self.header, 0.4), (self.menu, 0.7), (self.form, 0 if around else 0.2), (self.advert, 0.3), (lambda: self.bare("advert"), 0.5), (lambda: self.bare("notice"), 0.2), (self.sidebar, 0.2)):
            if r.random() < chance:
                part()
        shape = r.random()
        if shape < 0.2:
            self.inside("main", "", self.article)
        elif shape < 0.4:
            self.grid(r.sample([self.article, r.choice([self.links_column, self.sidebar, self.menu])], 2))
        elif shape < 0.65:
            self.wrapped(self.article)
        elif shape < 0.96:
            self.article()
        for part, chance in ((self.comments, 0.35), (self.sidebar, 0.35), (self.advert, 0.2), (lambda: self.bare("advert"), 0.2), (self.form, 0 if around else 0.2), (self.menu, 0.2), (self.footer, 0.5), (lambda: self.bare("footer"), 0.5), (self.notice, 0.1)):
            if r.random() < chance:
                part()
        html = "".join(self.out)
        if r.random() < 0.2:  # end tags that the language lets authors leave out
            for tag in ("p", "li", "td", "tr"):
                if r.random() < 0.6:
                    html = html.replace(f"</{tag}>", "")
        # Text outside all parts is the article's.
        return f'<html><body data-keep="1">{html}' + ("</form>" if around else "") + "</body></html>"


def pages(n: int, seed: int = 0, names: dict[str, list[str]] | None = None) -> list[str]:
    return [Page(seed * 1_000_003 + i, names or NAMES).html() for i in range(n)]


def halves(seed: int = 0) -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    """Two sets of names without a common one, to train on the one and measure on the other."""
    out = {}, {}
    for part, names in NAMES.items():
        names = random.Random(f"{seed}{part}").sample(names, len(names))
        out[0][part], out[1][part] = names[::2], names[1::2]
    return out
