"""Symbols, imports, calls and heritage of languages without a parser here, by lexing.

A file is read in three passes. Comments and the insides of strings are blanked,
place for place, so that later passes see code only and imports can still read
their literals. Openers of the language (braces, keywords with `end`, or
columns) are matched to their ends. Patterns then find definitions; what lies
between a definition's head and its end belongs to it, and definitions nest as
their spans do. Calls, decisions and names are read from what no inner
definition holds.

This knows a language's words, not its grammar: macros are not expanded, types
are not inferred, and a construct that no pattern knows gives no symbol.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

NAME = r"[A-Za-z_$][\w$]*"
CHAIN = rf"{NAME}(?:(?:\.|::|->|\?\.){NAME})*"
#: `(...)` with parentheses up to three deep.
_P = r"\([^()]*\)"
for _ in range(2):
    _P = rf"\((?:[^()]|{_P})*\)"
PARENS = _P
GENERIC = r"(?:<[^<>;{}]*(?:<[^<>]*>[^<>;{}]*)*>)?"


@dataclass(frozen=True)
class Language:
    suffixes: tuple[str, ...]
    #: (kind, pattern): kind is a node kind, or `scope` for what opens a name but is no symbol.
    defs: tuple[tuple[str, str], ...]
    line: tuple[str, ...] = ("//",)
    block: tuple[tuple[str, str], ...] = (("/*", "*/"),)
    quotes: str = "\"'"
    style: str = "brace"  # brace, end or column
    branch: str = r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?(?![.:?])"
    short: bool = False  # callees by their last name
    top: str = ""  # pattern of a file's own variables
    local: str = rf"\b(?:let|var|val|const|mut|auto)\s+({NAME})|\b(?:int|long|double|float|char|bool|size_t|string|String)\s+\*?({NAME})\s*[=;]|({NAME})\s*:="
    inherits: tuple[tuple[str, str], ...] = field(default=())  # (relation, pattern over a type's head)


#: Words that no function has as its name, in any of the languages.
CONTROL = frozenset("if else for while do switch case return catch new throw sizeof await yield foreach using lock synchronized elif elsif elseif unless until when guard function fn func def fun typeof delete super this base self assert and or not in is where constexpr decltype alignof static_assert raise defer select import".split())
#: Words that are no names of variables, in any of the languages.
WORDS = CONTROL | frozenset("default break continue try of as instanceof class interface enum struct union static const final public private protected void int long short double float char bool boolean unsigned signed true false null extends implements import package namespace template typename typedef extern inline virtual override operator async let mut match impl trait pub mod use loop move ref Self crate var val object companion chan map range type string echo print then end local nil None True False lambda with pass except from global nonlocal undefined volatile abstract throws record sealed open data suspend inout protocol extension fi done esac begin module require do".split())
_TYPES = (("inherits", r"\bextends\s+([\w.,\s<>]+?)(?=\bimplements\b|\{|$)"), ("implements", r"\bimplements\s+([\w.,\s<>]+?)(?=\{|$)"))
_COLON = (("inherits", r"^[^:]*?(?:\([^)]*\))?\s*:(?!:)\s*([^{=]+?)(?=\{|\bwhere\b|$)"),)
_MEMBER = rf"(?m)(?:^|[{{,])\s*({NAME})\s*(?=[,;}}=(]|$)"

LANGUAGES = (
    Language(
        ("rs",),
        (
            ("function", rf"\bfn\s+({NAME})"), ("class", rf"\b(?:struct|enum|union)\s+({NAME})"), ("interface", rf"\btrait\s+({NAME})"),
            ("scope", rf"\bimpl\b{GENERIC}\s+(?:[^{{;]*?\bfor\s+)?(?:&\s*)?(?:{NAME}::)*({NAME})"), ("scope", rf"\bmod\s+({NAME})\s*(?=\{{)"),
        ),
        quotes='"', branch=r"\b(?:if|for|while|loop)\b|=>|&&|\|\||\?(?=[;.)\s])", top=rf"(?m)^(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?({NAME})\s*:",
        inherits=(("inherits", r"\btrait\s+\w+[^:{]*:\s*([^{]+?)(?=\{|\bwhere\b|$)"),),
    ),
    Language(
        ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs"),
        (
            ("function", rf"\bfunction\s*\*?\s*({NAME})"), ("class", rf"\bclass\s+({NAME})"), ("interface", rf"\binterface\s+({NAME})"), ("class", rf"\benum\s+({NAME})"),
            ("method", rf"(?m)^[ \t]+(?:(?:public|private|protected|static|async|readonly|get|set|abstract|override)\s+)*\*?(#?{NAME})\s*{GENERIC}{PARENS}\s*(?::[^;{{}}=]+)?(?=[{{;])"),
        ),
        quotes="\"'`", top=rf"(?m)^(?:export\s+)?(?:const|let|var)\s+({NAME})", inherits=_TYPES,
    ),
    Language(
        ("kt", "kts"),
        (
            ("function", rf"\bfun\s+{GENERIC}\s*(?:[\w<>?]+\.)?({NAME})\s*(?=\()"), ("interface", rf"\binterface\s+({NAME})"), ("class", rf"\b(?:class|object)\s+({NAME})"), ("class", r"\bcompanion\s+object\b()(?!\s+\w)"),
        ),
        branch=r"\b(?:if|for|while|catch)\b|->|&&|\|\||\?:", top=rf"(?m)^(?:(?:private|internal|public|const|lateinit)\s+)*va[lr]\s+({NAME})", inherits=_COLON,
    ),
    Language(
        ("c", "h"),
        (
            ("function", rf"(?m)^(?!\s*(?:return|else|typedef|if|for|while|switch)\b)[A-Za-z_][\w \t\*]*?[\s\*]({NAME})\s*{PARENS}\s*(?=[{{;])"), ("class", rf"\b(?:struct|union|enum)\s+({NAME})\s*(?=\{{)"), ("class", rf"\btypedef\b(?:[^;{{}}]|\{{[^{{}}]*\}})*?({NAME})\s*(?=;)"),
            ("function", rf"(?m)^#[ \t]*define[ \t]+({NAME})(?=\()"), ("variable", rf"(?m)^#[ \t]*define[ \t]+({NAME})[ \t]+(?=\S)"),
        ),
        top=rf"(?m)^(?!\s*(?:return|typedef|struct\s+\w+\s*;|enum\s+\w+\s*;))(?:(?:static|extern|const|unsigned|struct)\s+)*{NAME}[\s\*]+({NAME})\s*(?:\[[^\]]*\]\s*)*(?:=[^;{{]*|=\s*\{{[^}}]*\}}\s*)?;",
    ),
    Language(
        ("java",),
        (
            ("class", rf"\b(?:class|enum|record)\s+({NAME})"), ("interface", rf"@?\binterface\s+({NAME})"),
            ("method", rf"(?m)^[ \t]+(?:@\w+(?:{PARENS})?\s*)*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)*(?:<[^>]*>\s*)?(?:[\w.]+{GENERIC}(?:\[\])*\s+)?({NAME})\s*{PARENS}\s*(?:throws\s+[\w.,\s]+)?(?=[{{;])"),
        ),
        short=True, inherits=(("inherits", r"\bextends\s+([\w.,\s<>]+?)(?=\bimplements\b|\bpermits\b|\{|$)"), ("implements", r"\bimplements\s+([\w.,\s<>]+?)(?=\{|$)")),
    ),
    Language(
        ("go",),
        (
            ("function", rf"(?m)^func\s+({NAME})\s*(?=[(\[])"), ("method", rf"(?m)^func\s+\(\s*(?:{NAME}\s+)?\*?(?P<owner>{NAME})(?:\[[^\]]*\])?\s*\)\s*({NAME})"),
            ("interface", rf"(?m)^type\s+({NAME})(?:\[[^\]]*\])?\s+interface\b"), ("class", rf"(?m)^type\s+({NAME})(?:\[[^\]]*\])?\s+(?!interface\b)(?=\S)"),
        ),
        quotes="\"'`", branch=r"\b(?:if|for|case)\b|&&|\|\|", short=True, top=rf"(?m)^(?:var|const)\s+({NAME})|(?<=\n)(?:var|const)\s*\(\s*({NAME})",
    ),
    Language(
        ("sh", "bash"), (("function", r"(?m)^[ \t]*(?:function[ \t]+)?([\w-]+)[ \t]*\([ \t]*\)\s*(?=\{)"), ("function", r"(?m)^[ \t]*function[ \t]+([\w-]+)\s*(?=\{)")),
        line=("#",), block=(), branch=r"\b(?:if|elif|for|while|until)\b|&&|\|\||;;", top=rf"(?m)^(?:export\s+|readonly\s+|declare\s+(?:-\w+\s+)*)?({NAME})=",
    ),
    Language(
        ("cpp", "cc", "cxx", "hpp", "hh", "hxx"),
        (
            ("scope", r"\bnamespace\s+([\w:]+)\s*(?=\{)"), ("class", rf"\b(?:class|struct|union)\s+({NAME})\s*(?:final\s*)?(?=[:{{])"), ("class", rf"\benum\s+(?:class\s+|struct\s+)?({NAME})\s*(?=[:{{])"),
            ("method", rf"(?m)^[\w:<>,&\* \t~]*?(?P<owner>{NAME})::(~?{NAME})\s*{PARENS}[^;{{}}()]*(?=\{{)"),
            ("function", rf"(?m)^(?!\s*(?:return|else|typedef|if|for|while|switch|using|new|delete|throw)\b)[ \t]*(?:[A-Za-z_~][\w:<>,&\* \t]*?[\s\*&~])?({NAME})\s*{PARENS}(?:\s*(?:const|noexcept|override|final|->\s*[\w:<>]+))*\s*(?::[^;{{}}]*?)?(?=\{{|;|=\s*(?:0|default|delete)\s*;)"),
            ("class", rf"\btypedef\b(?:[^;{{}}]|\{{[^{{}}]*\}})*?({NAME})\s*(?=;)"), ("class", rf"\busing\s+({NAME})\s*(?==)"),
            ("function", rf"(?m)^#[ \t]*define[ \t]+({NAME})(?=\()"), ("variable", rf"(?m)^#[ \t]*define[ \t]+({NAME})[ \t]+(?=\S)"),
        ),
        top=rf"(?m)^(?!(?:return|typedef|using|class|struct|enum)\b)(?:(?:static|extern|const|constexpr|inline|unsigned)\s+)*[\w:<>]+[\s\*&]+({NAME})\s*(?:\[[^\]]*\]\s*)*(?:=[^;{{]*)?;", inherits=_COLON,
    ),
    Language(
        ("swift",),
        (
            ("class", rf"\b(?:class|struct|actor|enum)\s+(?!func\b|var\b)({NAME})"), ("interface", rf"\bprotocol\s+({NAME})"), ("scope", rf"\bextension\s+(?:{NAME}\.)*({NAME})"), ("function", rf"\bfunc\s+({NAME}|[^\s\w(]+)\s*{GENERIC}(?=\()"),
            ("method", r"\b(init|deinit|subscript)\b[?!]?\s*(?=[({<])"), ("class", rf"\btypealias\s+({NAME})"),
        ),
        quotes='"', branch=r"\b(?:if|guard|for|while|case|catch)\b|&&|\|\||\?\?|\?(?=\s)", top=rf"(?m)^(?:(?:public|private|internal|fileprivate)\s+)*(?:let|var)\s+({NAME})", inherits=_COLON,
    ),
    Language(
        ("rb",), (("class", rf"(?m)^[ \t]*(?:module|class)[ \t]+(?:{NAME}::)*({NAME})"), ("function", rf"(?m)^[ \t]*(?:private[ \t]+)?def[ \t]+(?:(?:self|(?P<owner>[A-Z]\w*))\.)?({NAME}[?!=]?)")),
        line=("#",), block=(("\n=begin", "\n=end"),), style="end", short=True, branch=r"\b(?:if|elsif|unless|while|until|when|rescue|for)\b|&&|\|\||\?(?=\s)", top=rf"(?m)^({NAME})\s*=(?![=~>])",
        local=rf"(?m)(?:^|\s)({NAME})\s*=(?![=~>])", inherits=(("inherits", r"\bclass\s+\w+\s*<\s*([\w:]+)"),),
    ),
    Language(
        ("r",), (("function", r"(?m)^[ \t]*([\w.]+)[ \t]*(?:<-|=)[ \t]*function\s*(?=\()"),), line=("#",), block=(), short=True, quotes="\"'`",
        branch=r"\b(?:if|for|while|repeat)\b|&&|\|\|", top=r"(?m)^([\w.]+)[ \t]*(?:<-|=)(?![ \t]*function\b|=)", local=r"(?m)([\w.]+)\s*<-",
    ),
    Language(
        ("jl",),
        (
            ("class", rf"(?m)^[ \t]*(?:bare)?module[ \t]+({NAME})"), ("class", rf"(?m)^[ \t]*(?:mutable[ \t]+)?struct[ \t]+({NAME})"), ("class", rf"(?m)^[ \t]*primitive[ \t]+type[ \t]+({NAME})"), ("interface", rf"(?m)^[ \t]*abstract[ \t]+type[ \t]+({NAME})"),
            ("method", rf"(?m)^[ \t]*function[ \t]+(?:{NAME}\.)+({NAME}!?)"), ("function", rf"(?m)^[ \t]*(?:function|macro)[ \t]+({NAME}!?)(?!\.)"), ("method", rf"(?m)^[ \t]*(?:{NAME}\.)+({NAME}!?)(?={PARENS}[ \t]*(?:where\b[^=\n]*)?=(?!=))"), ("function", rf"(?m)^[ \t]*({NAME}!?)(?={PARENS}[ \t]*(?:where\b[^=\n]*)?=(?!=))"),
        ),
        line=("#",), block=(("#=", "=#"),), style="end", quotes='"', branch=r"\b(?:if|elseif|for|while|catch)\b|&&|\|\||\?(?=\s)", top=rf"(?m)^(?:const[ \t]+)?({NAME})[ \t]*=(?!=)",
        local=rf"(?m)^\s+(?:local\s+)?({NAME})\s*=(?!=)", inherits=(("inherits", r"<:\s*([\w.]+)"),),
    ),
    Language(
        ("cs",),
        (
            ("scope", r"\bnamespace\s+([\w.]+)\s*(?=[{;])"), ("class", rf"\b(?:class|struct|record(?:\s+(?:class|struct))?|enum)\s+({NAME})"), ("interface", rf"\binterface\s+({NAME})"),
            ("method", rf"(?m)^[ \t]+(?:\[[^\]]*\]\s*)*(?:(?:public|private|protected|internal|static|virtual|override|abstract|sealed|async|extern|partial|new)\s+)*(?:[\w.]+{GENERIC}(?:\[\])*\??\s+)?({NAME})\s*{GENERIC}{PARENS}\s*(?::\s*(?:base|this){PARENS}\s*)?(?:where[^{{;]*)?(?=\{{|;|=>)"),
        ),
        top=rf"(?m)^(?:var|const\s+\w+|int|string|double|bool)\s+({NAME})\s*=", inherits=_COLON,
    ),
    Language(
        ("php",),
        (
            ("scope", r"\bnamespace\s+([\w\\]+)\s*(?=[{;])"), ("class", rf"\b(?:class|trait|enum)\s+({NAME})"), ("interface", rf"\binterface\s+({NAME})"), ("function", rf"\bfunction\s+&?\s*({NAME})\s*(?=\()"),
        ),
        line=("//", "#"), branch=r"\b(?:if|elseif|for|foreach|while|case|catch)\b|&&|\|\||\?(?![:>?-])|\?\?", top=r"(?m)^\$(\w+)\s*=(?!=)|(?m:^const\s+(\w+)\s*=)", local=r"\$(\w+)\s*=(?![=>])", inherits=_TYPES,
    ),
    Language(
        ("scala", "sc"),
        (
            ("class", rf"\b(?:class|object|enum)\s+({NAME})"), ("interface", rf"\btrait\s+({NAME})"), ("function", rf"\bdef\s+({NAME}|[^\s\w(\[:=]+)"), ("class", rf"(?m)^[ \t]*(?:opaque\s+)?type\s+({NAME})"),
        ),
        branch=r"\b(?:if|for|while|case|catch)\b|&&|\|\|", top=rf"(?m)^(?:(?:private|lazy|implicit|final)\s+)*va[lr]\s+({NAME})",
        inherits=(("inherits", r"\bextends\s+([\w.\[\],\s]+?)(?=\(|\bwith\b|\{|:|$)"), ("implements", r"\bwith\s+([\w.]+)")),
    ),
    Language(
        ("hs",),
        (
            ("class", r"(?m)^(?:data|newtype|type)\s+(?:family\s+|instance\s+)?(?:[^=>\n]*=>\s*)?([A-Z]\w*)"), ("interface", r"(?m)^class\s+(?:[^=>\n]*=>\s*)?([A-Z]\w*)"), ("scope", r"(?m)^instance\s+(?:[^=>\n]*=>\s*)?[A-Z][\w.]*\s+\(?([A-Z]\w*)"),
            ("method", r"(?m)^[ \t]+([a-z_][\w']*)\s*::"), ("function", r"(?m)^(?!(?:data|newtype|type|class|instance|import|module|deriving|infix[lr]?)\b)([a-z_][\w']*)[ \t]+[^=:\n|][^=\n]*?(?:=(?!=)|\|)"), ("variable", r"(?m)^([a-z_][\w']*)[ \t]*=(?!=)"),
        ),
        line=("--",), block=(("{-", "-}"),), quotes='"', style="column", branch=r"\b(?:if|case)\b|->|&&|\|\||^\s*\|", local=r"\blet\s+([a-z_][\w']*)|([a-z_][\w']*)\s*<-",
    ),
    Language(
        ("ex", "exs"),
        (
            ("class", r"(?m)^[ \t]*defmodule[ \t]+(?:[A-Z]\w*\.)*([A-Z]\w*)"), ("interface", r"(?m)^[ \t]*defprotocol[ \t]+(?:[A-Z]\w*\.)*([A-Z]\w*)"), ("class", r"(?m)^[ \t]*defimpl[ \t]+(?:[A-Z]\w*\.)*([A-Z]\w*)"),
            ("function", r"(?m)^[ \t]*def(?:p|macro|macrop)?[ \t]+([a-z_]\w*[?!]?)"),
        ),
        line=("#",), block=(('@moduledoc """', '"""'), ('@doc """', '"""')), style="end", short=True, quotes="\"'", branch=r"\b(?:if|unless|cond|for|while|rescue|catch)\b|->|&&|\|\||\band\b|\bor\b", local=r"(?m)^\s+([a-z_]\w*)\s*=(?![=~>])",
    ),
    Language(
        ("lua",),
        (
            ("class", rf"(?m)^local[ \t]+({NAME})[ \t]*=[ \t]*\{{(?=[^\n]*function\b)"), ("method", rf"(?m)^[ \t]*function[ \t]+(?P<owner>{NAME})[.:]({NAME})"), ("function", rf"(?m)^[ \t]*(?:local[ \t]+)?function[ \t]+({NAME})\s*(?=\()"),
            ("function", rf"(?m)^[ \t]*local[ \t]+({NAME})[ \t]*=[ \t]*function\s*(?=\()"),
        ),
        line=("--",), block=(("--[[", "]]"),), style="end", branch=r"\b(?:if|elseif|for|while|until)\b|\band\b|\bor\b", top=rf"(?m)^local[ \t]+({NAME})[ \t]*=(?![ \t]*function\b|=)", local=rf"\blocal\s+({NAME})",
    ),
)
BY_SUFFIX = {s: lang for lang in LANGUAGES for s in lang.suffixes}

#: Words that open what `end` closes. Those of _TAIL open nothing behind a statement.
_OPEN = {"rb": r"\b(?:class|module|def|begin|case|do)\b|(?m:^[ \t]*(?:\w+\s*=\s*)?(?:if|unless|while|until|for)\b)", "jl": r"\b(?:module|baremodule|struct|function|macro|begin|let|quote|do|try)\b|\b(?:abstract|primitive)\s+type\b|(?m:^[ \t]*(?:\w+\s*=\s*)?(?:if|for|while)\b)", "ex": r"\b(?:do(?!:)|fn)\b", "lua": r"\b(?:function|do|then|repeat)\b"}
_CLOSE = {"lua": r"\b(?:end|until|elseif)\b"}


def blank(text: str, lang: Language) -> str:
    """The text with comments and the insides of strings as blanks; places and lines stay."""
    parts = [re.escape(a) + r"[\s\S]*?(?:" + re.escape(b) + r"|\Z)" for a, b in lang.block]
    parts += [(r"(?<![\w$])" if m == "#" else "") + re.escape(m) + r"[^\n]*" for m in lang.line] if lang.suffixes[0] not in ("c", "cpp", "php") else [re.escape(m) + r"[^\n]*" for m in lang.line]
    for q in lang.quotes:
        inner = rf"(?:[^{q}\\]|\\.)*" if q == "`" else rf"(?:[^{q}\\\n]|\\.)*"
        parts.append((rf"{q}{q}{q}[\s\S]*?{q}{q}{q}|" if q == '"' else "") + f"{q}{inner}{q}")

    def space(m):
        s = m[0]
        if s[0] in lang.quotes and len(s) > 1:
            return s[0] + re.sub(r"[^\n]", " ", s[1:-1]) + s[-1]
        return re.sub(r"[^\n]", " ", s)

    return re.sub("|".join(parts), space, text)


def spans(code: str, lang: Language) -> dict[int, int]:
    """Where what is opened at a place ends."""
    ends, stack = {}, []
    if lang.style == "end":
        key = lang.suffixes[0]
        close = re.compile(_CLOSE.get(key, r"\bend\b"))
        for m in re.finditer(f"({_OPEN[key]})|{close.pattern}", code):
            if m[1]:
                stack.append(m.start(1) + len(m[1]) - len(m[1].lstrip()))
            elif stack:
                ends[stack.pop()] = m.end()
        return ends
    for m in re.finditer(r"[{}]", code):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            ends[stack.pop()] = m.end()
    return ends


@dataclass
class Symbol:
    kind: str
    name: str
    start: int
    head: int  # where the head ends
    end: int
    id: str = ""
    module: bool = False


class Lexed:
    """What a file of a known suffix holds, in the shape that the Python extractor has too."""

    def __init__(self, package: str, file: str, text: str, module: str):
        self.package, self.file, self.module, self.text = package, file, module, text
        self.suffix = file.rsplit(".", 1)[-1].lower()
        self.lang = BY_SUFFIX[self.suffix]
        self.code = blank(text, self.lang)
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.symbols, self.imports, self.calls, self.heritage = [], [], [], []
        self.ends = spans(self.code, self.lang)
        self.found = self._definitions()
        self._describe()
        self._imports()

    def line(self, at: int) -> int:
        return bisect_right(self.lines, at)

    def _end(self, start: int, head: int) -> tuple[int, int]:
        """Where a definition's head ends, and the definition itself."""
        code, lang = self.code, self.lang
        if code[start] == "#":
            m = re.compile(r"(?:[^\\\n]|\\[\s\S])*").match(code, head)
            return head, m.end()
        if lang.style == "column":
            m = re.search(r"\n(?=[^\s])", code[head:])
            end = head + m.start() if m else len(code)
            eq = re.search(r"=(?!=)|\bwhere\b|\|", code[start:end])
            return (start + eq.start() if eq else end), end
        stop = code.find("\n", head)
        stop = len(code) if stop < 0 else stop
        params = re.compile(rf"\s*{GENERIC}\s*{PARENS}").match(code, head)
        after = params.end() if params else head
        if lang.style == "end":
            elixir = self.suffix in ("ex", "exs")
            if elixir and (m := re.compile(r"(?:(?!\n\s*(?:def|@|end\b))[\s\S])*?\bdo(:?)(?!\w)").match(code, head)):
                return (m.end(), stop if m.end() < stop else code.find("\n", m.end())) if m[1] else (m.end() - 2, self.ends.get(m.end() - 2, stop))
            opener = next((p for p in sorted(self.ends) if start <= p < stop), None)
            if opener is None:
                eq = re.compile(r"[^=\n]*=(?![=>])").match(code, after if self.suffix == "jl" else stop)
                return (eq.end(), stop) if eq and eq.end() < stop else (stop, stop)
            return (after if params else stop if self.ends[opener] > stop else head), self.ends[opener]
        loose = self.suffix in ("kt", "kts", "scala", "sc", "r", "go", "swift")
        m = re.compile(r"[{};]|\n(?=\s*\n|\S|\s*(?:fun|def|val|var|let|func|class|case|override|private|public)\b)" if loose else "[{;]").search(code, after)
        at = m.start() if m else len(code)
        short = re.compile(r"[^={}\n;]*=>" if self.suffix == "cs" else r"[^={};\n]*=(?![=>])").match(code, after) if self.suffix in ("kt", "kts", "scala", "sc", "cs") else None
        if short and short.end() <= at:
            return short.end(), self.ends.get(at, at) if code[at : at + 1] == "{" else at
        if not m:
            return len(code), len(code)
        if self.suffix == "r" and code[at] != "{":
            return after, at
        # A call's parentheses in a head may span lines; the brace after them is the body's.
        if code[at] == "{":
            return at, self.ends.get(at, len(code))
        if code[at] == "\n" and (b := re.match(r"\s*\{", code[at:])):
            return at, self.ends.get(at + b.end() - 1, len(code))
        return at, at

    def _definitions(self) -> list[Symbol]:
        code, lang, out, taken = self.code, self.lang, [], set()
        for kind, pattern in lang.defs:
            for m in re.finditer(pattern, code):
                groups = [g for i, g in enumerate(m.groups(), 1) if g is not None and i != m.re.groupindex.get("owner")]
                name = groups[-1] if groups else ""
                if "companion" in m[0] and not name:
                    name = "Companion"
                if not name or name in CONTROL and kind != "scope":
                    continue
                at = m.start() + len(m[0]) - len(m[0].lstrip())
                where = m.start(m.lastindex) if m.lastindex and m[m.lastindex] == name else at
                if where in taken:
                    continue
                taken.add(where)
                head, end = self._end(at, m.end())
                owner = m.groupdict().get("owner")
                out.append(Symbol(kind, f"{owner}::{name}" if owner else re.sub(r"[.\\]|::", "::", name), at, head, max(end, head)))
        if lang.top:
            inside = sorted((s.start, s.end) for s in out if s.kind != "scope")
            for m in re.finditer(lang.top, code):
                name = next((g for g in m.groups() if g), None)
                at = m.start() + len(m[0]) - len(m[0].lstrip("\n"))
                if name and name not in WORDS and not any(a <= at < b for a, b in inside):
                    out.append(Symbol("variable", name, at, m.end(), m.end()))
        out.sort(key=lambda s: (s.start, -s.end))
        return self._nested(out)

    def _nested(self, found: list[Symbol]) -> list[Symbol]:
        """Ids by nesting; functions in types become methods, entries of enums variables of them."""
        kept, stack = [], []
        whole = [s for s in found if s.kind == "scope" and self.code[s.head : s.head + 1] == ";"]
        prefix = f"{self.module}::{whole[0].name}" if whole else self.module
        for s in found:
            if s in whole:
                continue
            while stack and stack[-1].end <= s.start:
                stack.pop()
            over = stack[-1] if stack else None
            typed = over is not None and (over.kind in ("class", "interface") or over.kind == "scope" and not self.code[over.start :].startswith(("mod", "namespace")))
            if s.kind == "function" and typed and self.suffix != "jl":
                s.kind = "method"
            if s.kind == "method" and not typed and "::" not in s.name and self.suffix not in ("jl",):
                continue  # a call that looks like a method's head, or a signature outside of types
            if s.kind == "method" and over is not None and over.kind in ("function", "method"):
                continue
            s.id = f"{over.id if over else prefix}::{s.name}"
            s.name = s.name.rsplit("::", 1)[-1]
            if s.end > s.head or s.kind == "scope":
                stack.append(s)
            if s.kind == "scope":
                s.module = True
                kept.append(s)
                continue
            kept.append(s)
            if s.kind == "class" and re.match(r"(?:\w+\s+)*enum\b", self.code[s.start : s.head]):
                kept += self._entries(s)
        return kept

    def _entries(self, s: Symbol) -> list[Symbol]:
        body, out = self.code[s.head + 1 : s.end - 1], []
        if self.suffix in ("rs",):
            return out
        found = re.finditer(rf"\bcase\s+({NAME}(?:\s*,\s*{NAME})*)", body) if self.suffix in ("swift", "php", "scala", "sc") else re.finditer(_MEMBER, body.split(";")[0])
        for m in found:
            for name in re.split(r"\s*,\s*", m[1]):
                out.append(Symbol("variable", name, s.head + 1 + m.start(1), s.head + 1 + m.end(1), s.head + 1 + m.end(1), f"{s.id}::{name}"))
        return out

    def _describe(self) -> None:
        """Symbols with their names and decisions, and every call under its innermost symbol."""
        code, lang, words = self.code, self.lang, WORDS
        open_ = [s for s in self.found if not s.module]
        holders = sorted((s for s in open_ if s.end > s.head and s.kind in ("function", "method", "class", "interface")), key=lambda s: s.start)

        bodies = [s for s in holders if s.kind in ("function", "method")]
        furthest = max((s.end for s in bodies), default=0)

        def own(s: Symbol) -> str:
            """A body without the definitions in it."""
            out, at = [], s.head
            for x in holders[bisect_right(holders, s.start, key=lambda h: h.start) :]:
                if x.start >= s.end:
                    break
                if s.head <= x.start and x.end <= s.end and x.start >= at:
                    out.append(code[at : x.start])
                    at = x.end
            return "".join([*out, code[at : s.end]])

        for s in open_:
            head = " ".join(self.text[s.start : s.head].split()).rstrip("{;=: ")
            defines, refs, writes, decisions = [], [], [], None
            if s.kind in ("function", "method"):
                body = own(s)
                m = re.search(PARENS, code[s.start : max(s.head, s.start + 1)])
                params = m[0][1:-1] if m else ""
                for p in re.split(r",(?![^<(]*[>)])", params):
                    names = [x for x in re.findall(NAME, p.split("=")[0]) if x not in words]
                    if names:
                        first = ":" in p or self.suffix in ("go", "kt", "swift", "rs", "ts", "scala", "r", "jl", "lua", "ex", "rb")
                        defines.append(names[0] if first else names[-1])
                if lang.style == "column":
                    defines += re.findall(r"\b[a-z_]\w*", code[s.start : s.head])[1:] if "::" not in code[s.start : s.head] else []
                defines += [x for m in re.finditer(lang.local, body) for x in m.groups() if x and x not in words]
                writes = [m[1] for m in re.finditer(rf"({NAME})\s*=(?![=~>])", body) if m[1] not in words]
                known = set(defines)
                refs = [x for x in re.findall(rf"(?<![\w$.>]){NAME}", body) if x not in words and x not in known]
                decisions = len(re.findall(lang.branch, body, re.M)) if s.end > s.head else None
                writes = [] if lang.style == "column" else writes
            end = self.line(max(s.start, s.end - 1)) if s.end > s.start else None
            column = s.start - self.lines[self.line(s.start) - 1] + 1
            defines, refs, writes = ([x.lstrip("$") for x in xs if not re.fullmatch(r"\$\d*", x)] for xs in (defines, refs, writes))
            refs = [x for x in refs if x not in defines]
            self.symbols.append((s.id, s.kind, s.name, self.line(s.start), column, sorted(set(defines)), sorted(set(refs)), sorted(set(writes)), end, head, decisions))
            if s.kind in ("class", "interface"):
                self._heritage(s)
        for s in self.found:
            if s.module and self.suffix in ("rs", "swift", "hs"):
                self._scope_heritage(s)
        heads = [(s.start, s.head) for s in open_ if s.kind != "variable"]
        starts = [a for a, _ in heads]
        pattern = rf"(?<![\w$.>])(new\s+)?(\$?{CHAIN}[!?]?)\s*{GENERIC}\(" if self.suffix != "jl" else rf"(?<![\w.])()({CHAIN}!?)\("
        found = self._commands() if self.suffix in ("sh", "bash") else self._applied() if lang.style == "column" else re.finditer(pattern, code)
        for m in found:
            at, name = (m.start(2), m[2]) if isinstance(m, re.Match) else m
            plain = re.split(r"\.|::|->|\?\.", name)[-1]
            if name in CONTROL:
                continue
            i = bisect_right(starts, at) - 1
            if i >= 0 and heads[i][0] <= at < heads[i][1]:
                continue  # in the head of a definition
            who = next((s for s in reversed(bodies[: bisect_right(bodies, at, key=lambda s: s.start)]) if at < s.end), None) if at < furthest else None
            short = lang.short or self.suffix == "php" and "->" in name
            self.calls.append((who.id if who else self.module, plain if short else name.lstrip("$"), self.line(at)))

    def _commands(self):
        """The command names of a shell script."""
        skip = set("if then else elif fi for while until do done case esac in function return local export readonly declare unset shift exit break continue true false [ [[ { } ! source . eval test set echo".split()) - {"echo", "eval", "set", "test"}
        for m in re.finditer(r"(?m)(?:^|[;|&(`]|\bthen\b|\bdo\b|\belse\b|!)[ \t]*([\w./-]+)(?=[ \t;\n|&)]|$)(?![ \t]*\()", self.code):
            if m[1] not in skip and not re.match(r"\d|-", m[1]):
                yield m.start(1), m[1]

    def _applied(self):
        """Functions that are applied to something."""
        skip = set("if then else case of let in where do import module data type newtype class instance deriving qualified as hiding infixl infixr infix".split())
        for m in re.finditer(r"(?<![\w.'])((?:[A-Z]\w*\.)*[a-z_][\w']*)(?=[ \t]+(?!(?:then|else|of|in|where)\b)[\w(\"\[])", self.code):
            around = self.code[self.code.rfind("\n", 0, m.start()) + 1 : (self.code.find("\n", m.end()) + 1 or len(self.code))]
            if "::" not in around and not re.match(r"(?:data|newtype|type|class|instance|import|module)\b", around) and m[1] not in skip and not any(s.start == m.start() for s in self.found):
                yield m.start(), m[1]

    def _heritage(self, s: Symbol) -> None:
        head = self.code[s.start : s.head]
        line = self.line(s.start)
        ts = self.suffix
        for relation, pattern in self.lang.inherits:
            for m in re.finditer(pattern, head, re.S):
                plain = re.sub(r"[<\[(][^<>\[\]()]*(?:[<\[(][^<>\[\]()]*[>\])])*[^<>\[\]()]*[>\])]", "", m[1])
                bases = [re.split(r"\.|::", b)[-1] for b in re.findall(rf"(?:{NAME})(?:(?:\.|::){NAME})*", plain) if b not in ("public", "private", "protected", "virtual", "with", "by", "any", "some", "static")]
                for n, b in enumerate(bases):
                    r = "implements" if ts == "cs" and s.kind == "class" and n else relation
                    r = "inherits" if s.kind == "interface" else r
                    self.heritage.append((s.name, b, r, line))
        body = self.code[s.head : s.end]
        if ts == "go" and s.kind == "interface":
            self.heritage += [(s.name, m[1], "inherits", self.line(s.head + m.start(1))) for m in re.finditer(r"(?m)^\s+(?:\w+\.)?([A-Z]\w*)\s*$", body)]
        if ts == "php":
            self.heritage += [(s.name, b, "implements", self.line(s.head + m.start())) for m in re.finditer(r"(?m)^\s+use\s+([\w\\,\s]+);", body) for b in re.findall(r"(\w+)\s*(?:,|$)", m[1])]
        if ts in ("ex", "exs"):
            self.heritage += [(s.name, m[1], "implements", self.line(s.head + m.start())) for m in re.finditer(r"@behaviour\s+(?:[A-Z]\w*\.)*([A-Z]\w*)", body)]
            if m := re.match(r"\s*defimpl\s+(?:[A-Z]\w*\.)*([A-Z]\w*)\s*,\s*for:\s*(?:[A-Z]\w*\.)*([A-Z]\w*)", self.code[s.start :]):
                self.heritage.append((m[2], m[1], "implements", line))

    def _scope_heritage(self, s: Symbol) -> None:
        head = self.code[s.start : s.head]
        if self.suffix == "rs" and (m := re.match(rf"impl\b{GENERIC}\s+(?:{NAME}::)*({NAME}){GENERIC}\s+for\b", head)):
            self.heritage.append((s.name, m[1], "implements", self.line(s.start)))
        if self.suffix == "swift" and (m := re.match(r"extension\s+[\w.]+\s*:\s*([\w.,\s]+)", head)):
            self.heritage += [(s.name, b, "inherits", self.line(s.start)) for b in re.findall(NAME, m[1]) if b != "where"]
        if self.suffix == "hs" and (m := re.match(r"instance\s+(?:[^=>\n]*=>\s*)?(?:\w+\.)*([A-Z]\w*)", head)):
            self.heritage.append((s.name, m[1], "inherits", self.line(s.start)))

    # --- imports

    def _add(self, to: str, names, at: int) -> None:
        self.imports.append((to, [n for n in names if n], self.line(at)))

    def _folder(self) -> list[str]:
        return self.file.split("/")[:-1]

    def _relative(self, path: str, strip: bool = True) -> str:
        """The module of a path that is written from this file's folder."""
        parts = self._folder()
        for x in path.split("/"):
            if x == "..":
                if not parts:
                    return "external::unresolved"
                parts.pop()
            elif x not in ("", "."):
                parts.append(x)
        if strip and parts:
            parts[-1] = re.sub(r"\.\w+$", "", parts[-1])
        return "::".join([self.package, *parts])

    def _rooted(self, dotted: str, sep: str = ".", fold: bool = False, root: str | None = None) -> str:
        """A name that begins with the own package leads inside, any other to its first segment outside."""
        parts = [p for p in dotted.split(sep) if p]
        same = (lambda a, b: a.lower() == b.lower()) if fold else (lambda a, b: a == b)
        if parts and same(parts[0], self.package):
            return "::".join([self.package, *parts[1:]])
        if parts and root and same(parts[0], root):
            return "::".join(parts)
        return f"external::{parts[0] if parts else dotted}"

    def _imports(self) -> None:
        known = {"rs": self._rust, "ts": self._script, "kt": self._kotlin, "c": self._include, "cpp": self._include, "java": self._java, "go": self._go, "sh": self._shell, "swift": self._swift, "rb": self._ruby, "r": self._r, "jl": self._julia, "cs": self._csharp, "php": self._php, "scala": self._scala, "hs": self._haskell, "ex": self._elixir, "lua": self._lua}
        known[self.lang.suffixes[0]]()

    def _each(self, pattern: str):
        """Matches in the text whose start is code, not comment or string."""
        for m in re.finditer(pattern, self.text, re.M):
            at = m.start() + len(m[0]) - len(m[0].lstrip())
            if self.code[at : at + 1].strip():
                yield m, at

    def _rust(self) -> None:
        here = self.module.split("::")
        for m, at in self._each(r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);"):
            path = re.sub(r"\s+", " ", m[1]).strip()
            base, _, group = path.partition("{")
            alias = re.search(r"\bas\s+(\w+)$", path)
            segs = [x for x in re.sub(r"\s+as\s+\w+$", "", base).strip().rstrip(":").split("::") if x]
            names = [(re.search(r"\bas\s+(\w+)$", x.strip()) or re.search(r"(\w+)\s*$", x)) for x in group.rstrip("} ").split(",")] if group else []
            names = [n[1] for n in names if n and n[1] != "self"] if group else [] if path.endswith("*") else [alias[1] if alias else segs[-1]]
            segs = [x for x in segs if x != "*"]
            if segs[0] in ("crate", self.package.replace("-", "_")):
                to = [self.package, *segs[1:]]
            elif segs[0] in ("self", "super"):
                up = list(here)
                for x in segs:
                    if x == "super":
                        up = up[:-1]
                to = [*up, *(x for x in segs if x not in ("self", "super"))] if up else ["external", "unresolved"]
            else:
                to = ["external", segs[0]]
            self._add("::".join(to), names, at)

    def _script(self) -> None:
        for m, at in self._each(r"""^\s*(?:import|export)\b([^'";]*?)(?:\bfrom\s*)?['"]([^'"]+)['"]"""):
            names = [(x.split(" as ")[-1]).strip() for x in re.findall(r"[\w$]+(?:\s+as\s+[\w$]+)?|\*\s+as\s+[\w$]+", re.sub(r"\b(?:type|from)\b", "", m[1])) if x.strip()]
            self._script_target(m[2], names, at)
        for m, at in self._each(r"""(?:^|[^\w.])(?:(?:const|let|var)\s+(\{[^}]*\}|[\w$]+)\s*=\s*)?require\(\s*['"]([^'"]+)['"]\s*\)"""):
            self._script_target(m[2], re.findall(r"[\w$]+", re.sub(r"[\w$]+\s*:", "", m[1] or "")), at)

    def _script_target(self, path: str, names, at: int) -> None:
        if path.startswith("."):
            to = re.sub(r"\.(?:[cm]?[jt]sx?)$", "", self._relative(path, strip=False))
            self._add(re.sub(r"::index$", "", to), names, at)
        else:
            parts = path.split("/")
            self._add("external::" + ("::".join(parts[:2]) if path.startswith("@") else parts[0]), names, at)

    def _kotlin(self) -> None:
        for m, at in self._each(r"^import\s+([\w.]+?)(\.\*)?(?:\s+as\s+(\w+))?\s*$"):
            self._add(self._rooted(m[1]), [] if m[2] else [m[3] or m[1].rsplit(".", 1)[-1]], at)

    def _include(self) -> None:
        for m, at in self._each(r'^[ \t]*#[ \t]*include[ \t]+(?:"([^"]+)"|<([^>]+)>)'):
            self._add(self._relative(m[1]) if m[1] else "external::" + m[2].split("/")[0], [], at)
        if self.lang.suffixes[0] == "cpp":
            for m, at in self._each(r"^\s*using\s+(namespace\s+)?([\w:]+)\s*;"):
                segs = m[2].split("::")
                self._add(self._rooted("::".join(segs if m[1] else segs[:-1] or segs), "::"), [] if m[1] else [segs[-1]], at)

    def _java(self) -> None:
        own = (re.search(r"(?m)^\s*package\s+([\w.]+)\s*;", self.code) or [None, ""])[1].split(".")[0]
        for m, at in self._each(r"^\s*import\s+(static\s+)?([\w.]+?)(\.\*)?\s*;"):
            segs = m[2].split(".")
            if m[1] and not m[3]:
                segs, name = segs[:-1], segs[-1]
            else:
                name = None if m[3] else segs[-1]
            self._add("::".join(segs) if own and segs[0] == own else f"external::{segs[0]}", [name], at)

    def _go(self) -> None:
        lines = [(m[1], at) for m, at in self._each(r'^import\s+((?:[\w.]+\s+)?"[^"]+")')]
        for m, at in self._each(r"^import\s*\(([^)]*)\)"):
            lines += [(x, at) for x in m[1].split("\n") if '"' in x]
        for x, at in lines:
            m = re.search(r'(?:([\w.]+)\s+)?"([^"]+)"', x)
            segs = m[2].split("/")
            to = "::".join([self.package, *segs[1:]]) if segs[0] == self.package else f"external::{segs[0]}"
            self._add(to, [] if m[1] in (".", "_") else [m[1] or segs[-1]], at)

    def _shell(self) -> None:
        for m, at in self._each(r"""^[ \t]*(?:source|\.)[ \t]+["']?([\w./-]+)["']?"""):
            self._add(self._relative(m[1]), [], at)

    def _swift(self) -> None:
        for m, at in self._each(r"^\s*(?:@\w+\s+)?import\s+(?:(?:class|struct|func|enum|protocol|let|var|typealias)\s+)?([\w.]+)"):
            segs = m[1].split(".")
            self._add(f"external::{segs[0]}", [segs[-1]], at)

    def _ruby(self) -> None:
        for m, at in self._each(r"""^\s*require(_relative)?[ (]+['"]([^'"]+)['"]"""):
            self._add(self._relative(m[2]) if m[1] else self._rooted(m[2], "/"), [], at)

    def _r(self) -> None:
        for m, at in self._each(r"""^\s*(?:source\(\s*["']([^"']+)["']|(?:library|require)\(\s*["']?([\w.]+))"""):
            self._add(self._relative(m[1]) if m[1] else f"external::{m[2]}", [] if m[1] else [m[2]], at)

    def _julia(self) -> None:
        for m, at in self._each(r"^\s*(?:using|import)\s+(\.*)([\w.]+)(?:\s*:\s*([^\n]+))?"):
            names = [x.strip().split(" as ")[-1] for x in (m[3] or "").split(",") if x.strip()]
            if m[1]:
                up = self._folder()
                up = up[: len(up) - len(m[1]) + 1]
                self._add("::".join([self.package, *up, *m[2].split(".")]), names, at)
            else:
                self._add(self._rooted(m[2]), names, at)

    def _csharp(self) -> None:
        root = (re.search(r"\bnamespace\s+(\w+)", self.code) or [None, None])[1]
        for m, at in self._each(r"^\s*(?:global\s+)?using\s+(static\s+)?(?:(\w+)\s*=\s*)?([\w.]+)\s*;"):
            segs = m[3].split(".")
            inside = segs[0].lower() in (self.package.lower(), (root or self.package).lower())
            self._add("::".join([self.package, *segs[1:]]) if inside else f"external::{segs[0]}", [m[2] or (segs[-1] if m[1] else None)], at)

    def _php(self) -> None:
        root = (re.search(r"\bnamespace\s+(\w+)", self.code) or [None, None])[1]
        for m, at in self._each(r"^use\s+(?:function\s+|const\s+)?\\?([\w\\]+)(?:\s+as\s+(\w+))?\s*;"):
            segs = m[1].split("\\")
            inside = segs[0].lower() in (self.package.lower(), (root or self.package).lower())
            self._add("::".join([self.package, *segs[1:]]) if inside else f"external::{segs[0]}", [m[2] or segs[-1]], at)
        for m, at in self._each(r"""\b(?:require|include)(?:_once)?\b[ (]*(?:__DIR__\s*\.\s*)?['"]/?([^'"]+)['"]"""):
            self._add(self._relative(m[1]), [], at)

    def _scala(self) -> None:
        root = (re.search(r"(?m)^package\s+(\w+)", self.code) or [None, None])[1]
        for m, at in self._each(r"^\s*import\s+([\w.]+?)(?:\.(?:\{([^}]*)\}|(_|\*)))?\s*$"):
            segs = m[1].split(".")
            inside = segs[0] in (self.package, root)
            to = lambda rest: "::".join([self.package, *rest[1:]]) if inside else f"external::{rest[0]}"  # noqa: E731, B023
            if m[2] is None:
                self._add(to(segs), [] if m[3] else [segs[-1]], at)
            for x in (m[2] or "").split(",") if m[2] else ():
                name, _, new = re.sub(r"\s*(?:=>|\bas\b)\s*", "\0", x.strip()).partition("\0")
                self._add(to([*segs, *([] if name in ("_", "*") else [name])]), [] if name in ("_", "*") or new == "_" else [new or name], at)

    def _haskell(self) -> None:
        root = (re.search(r"(?m)^module\s+([\w.]+)", self.code) or [None, ""])[1].split(".")[0]
        for m, at in self._each(r"^import\s+(?:qualified\s+)?([\w.]+)(?:\s+qualified)?(?:\s+as\s+([\w.]+))?\s*(hiding)?\s*(?:\(([^)\n]*)\))?"):
            names = [] if m[3] else [x.strip().split("(")[0] for x in (m[4] or "").split(",") if x.strip()] or [m[2]]
            segs = m[1].split(".")
            inside = segs[0].lower() in (self.package.lower(), root.lower()) and root
            self._add("::".join([self.package, *segs[1:]]) if inside and len(segs) > 1 else f"external::{segs[0]}", names, at)

    def _elixir(self) -> None:
        for m, at in self._each(r"^\s*(alias|import|require|use)\s+([A-Z][\w.]*)(?:\.\{([^}]*)\})?(?:\s*,\s*(?:as:\s*(\w+)|only:\s*\[([^\]]*)\]))?"):
            last = m[2].rsplit(".", 1)[-1]
            if m[3]:
                for x in m[3].split(","):
                    self._add(self._rooted(f"{m[2]}.{x.strip()}", fold=True), [x.strip().rsplit(".", 1)[-1]], at)
                continue
            names = {"alias": [m[4] or last], "require": [m[4] or last], "import": re.findall(r"(\w+[?!]?):", m[5] or ""), "use": []}[m[1]]
            self._add(self._rooted(m[2], fold=True), names, at)

    def _lua(self) -> None:
        for m, at in self._each(r"""^[ \t]*(?:local\s+(\w+)\s*=\s*)?require\s*\(?\s*['"]([^'"]+)['"]"""):
            segs = re.split(r"[./]", m[2])
            self._add("::".join(segs if segs[0] == self.package else [self.package, *segs]), [m[1]], at)
        self.heritage += [(m[1], m[2], "inherits", self.line(m.start())) for m in re.finditer(r"setmetatable\(\s*(\w+)\s*,\s*\{\s*__index\s*=\s*(\w+)", self.code)]


def module_id(package: str, file: str, text: str) -> str:
    """A file's module by its language's rule."""
    suffix = file.rsplit(".", 1)[-1].lower()
    parts = file.rsplit(".", 1)[0].split("/")
    if suffix == "rs":
        parts = parts[1:] if parts[0] == "src" and len(parts) > 1 else parts
        parts = parts[:-1] if parts[-1] in ("mod", "lib") else parts
    elif suffix in BY_SUFFIX and BY_SUFFIX[suffix].suffixes[0] == "ts":
        parts = parts[:-1] if parts[-1] == "index" else parts
    elif suffix == "go":
        parts = parts[:-1]
    elif suffix == "java" and (m := re.search(r"(?m)^\s*package\s+([\w.]+)\s*;", blank(text, BY_SUFFIX["java"]))):
        return "::".join([*m[1].split("."), parts[-1]])
    return "::".join([package, *parts])
