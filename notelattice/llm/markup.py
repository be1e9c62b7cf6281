"""Markup residue: HTML, Markdown, wiki and LaTeX text to clean text that keeps its structure.

A text is read in three steps. The lexer sets Markdown code and formulas aside, finds the constructs
of each kind and turns them into plain text, headings (``#``), list items (``-``), fenced code and
``$`` formulas. The words and HTML tags it leaves are scored, words positive and tags of page furniture
negative, by log odds fitted on labelled pages, and one linear scan finds the contiguous region of the highest
total: menus and other rims fall outside it. What stays is that region.

Scores are summed by block (between block tags or empty lines), and a region begins and ends at
blocks. Inline and structure tags (``b``, ``li``, ``td``, ...) have no weight. A link counts against
its block only where the block has no other words, and leaving a rim out costs what keeps all
labelled content whole. So a text with words outside of links in its first and last block and without furniture keeps every
word; where nothing scores above zero, such as in a text of links alone, all is kept.

The kinds of markup in a text come from the lexer, over the whole text: the region alone could not
tell them, since constructs outside it count as well.

Defined results: a text without constructs comes out unchanged, to the character; null gives null
and no kinds, empty gives empty; rows with a repeated key each give a row.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .labelled import pages as labelled_pages

KINDS = ("html", "latex", "markdown", "wiki")

# Element names of the HTML standard and common older ones.
HTML_NAMES = (
    "a abbr acronym address applet area article aside audio b base bdi bdo big blockquote body br button canvas "
    "caption center cite code col colgroup data datalist dd del details dfn dialog div dl dt em embed fieldset "
    "figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins "
    "kbd label legend li link main map mark menu meta meter nav noscript object ol optgroup option output p param "
    "picture pre progress q rp rt ruby s samp script section select small source span strike strong style sub "
    "summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr"
).split()
# LaTeX commands that stand without an argument.
BARE_COMMANDS = (
    "item hline toprule midrule bottomrule maketitle tableofcontents noindent newline newpage clearpage pagebreak "
    "par centering bigskip medskip smallskip ldots dots cdots LaTeX TeX appendix bfseries itshape alpha beta gamma "
    "delta epsilon lambda mu pi sigma theta omega sum prod int frac sqrt cdot times le leq ge geq neq infty log cos sin exp"
).split()

_FENCE = re.compile(r"^[ ]{0,3}(?P<f>`{3,}|~{3,})(?P<info>[^\n`]*)\n(?P<body>.*?)(?:^[ ]{0,3}(?P=f)[`~]*[ \t]*$|\Z)", re.M | re.S)
_CODE = re.compile(r"(?<!`)(`+)(?!`)((?:(?!\n\s*\n).)+?)(?<!`)\1(?!`)", re.S)
_MATH = [
    (re.compile(r"\$\$(?!\s*\$)((?:(?!\n\s*\n)[^$])+)\$\$"), "$${}$$"),
    (re.compile(r"\\\[((?:(?!\n\s*\n|\\\[).)+?)\\\]", re.S), "$${}$$"),
    (re.compile(r"\\\(((?:(?!\n\s*\n|\\\().)+?)\\\)", re.S), "${}$"),
    (re.compile(r"\\begin\{((?:equation|align|gather|multline|eqnarray|displaymath|math)\*?)\}(.*?)\\end\{\1\}", re.S), "$${}$$"),
    (re.compile(r"(?<![\\$\w])\$(?![\s$])([^$\n]*?[^\s$\\]|[^\s$\\])\$(?![\d$])"), "${}$"),
]
_VERBATIM = re.compile(r"\\begin\{(verbatim\*?|lstlisting|minted)\}(?:\[[^\]\n]*\]|\{[^}\n]*\})*[ \t]*\n?(.*?)\\end\{\1\}", re.S)

_COMMENT = re.compile(r"<!--(?:(?!<!--).)*?-->|<!DOCTYPE[^>]*>|<\?xml[^>]*\?>", re.S | re.I)
_SCRIPT = re.compile(r"<(script|style)\b[^>]*>(?:(?!<\1\b).)*?</\1\s*>", re.S | re.I)
_PRE = re.compile(r"<pre\b[^>]*>(?:\s*<code\b[^>]*>)?((?:(?!<pre\b).)*?)(?:</code\s*>\s*)?</pre\s*>", re.S | re.I)
_TAG = re.compile(r"<(/?)(" + "|".join(sorted(HTML_NAMES, key=len, reverse=True)) + r")(?:\s[^<>]*|/)?>", re.I)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|([A-Za-z][A-Za-z0-9]{1,31}));")

_WIKI_TABLE = re.compile(r"^\{\|[^\n]*\n(.*?)(?:^\|\}[ \t]*$|\Z)", re.M | re.S)
_WIKI_HEADING = re.compile(r"^(={2,6})[ \t]*([^=\n](?:[^\n]*?[^=\n])??)[ \t]*\1[ \t]*$", re.M)
_WIKI_LINK = re.compile(r"(!?)\[\[([^\[\]\n]+)\]\]")
_TEMPLATE = re.compile(r"\{\{(?!\{)([^{}]+)\}\}")
_WIKI_URL = re.compile(r"(?<!\])\[(?:https?|ftp|mailto):[^\s\[\]]+[ \t]+([^\[\]\n]+)\](?!\()")
_WIKI_QUOTES = re.compile(r"(?<!')('{5}|'{2,3})(?!')([^\n]+?)(?<!')\1(?!')")
_SWITCH = re.compile(r"(?<!\w)__[A-Z]{3,}__(?!\w)")

_MD_IMAGE = re.compile(r"!\[([^\]\n]*)\]\([^()\n]*\)")
_MD_LINK = re.compile(r"\[([^\[\]\n]+)\]\([^()\n]*\)")
_MD_REFERENCE = re.compile(r"(?<![\w\]])\[([^\[\]^\n]+)\]\[[^\[\]\n]*\]")
_MD_DEFINITION = re.compile(r"^ {0,3}\[([^\[\]^\n]+)\]:[ \t]+\S[^\n]*$", re.M)
_MD_NOTE_TEXT = re.compile(r"^ {0,3}\[\^([^\]\s]+)\]:[ \t]*", re.M)
_MD_NOTE = re.compile(r"\[\^[^\]\s]+\]")
_AUTOLINK = re.compile(r"<((?:[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*)|[\w.+-]+@[\w-]+(?:\.[\w-]+)+)>")
_MD_TABLE = re.compile(r"^(?=[^\n]*\|)[^\n]++\n {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)+\|?[ \t]*$(?:\n(?=[^\n]*\|)[^\n]++)*", re.M)
_MD_HEADING = re.compile(r"^ {0,3}(#{1,6})[ \t]+(\S[^\n]*?)[ \t]*#*[ \t]*$", re.M)
_MD_SETEXT = re.compile(r"^(?![ \t]*(?:[-+*>|#]|\d+[.)]))(?=[^\n]*\S)([^\n]++)\n(={3,}|-{3,})[ \t]*$", re.M)
_MD_RULE = re.compile(r"^ {0,3}(?:-{3,}|\*{3,}|_{3,}|(?:\* ){2,}\*|(?:- ){2,}-|(?:_ ){2,}_)[ \t]*$", re.M)
_MD_QUOTE = re.compile(r"^ {0,3}>[ \t]?(?=\S)", re.M)
_MD_BULLET = re.compile(r"^([ \t]*)[-+*][ \t]+(?:\[[ xX]\][ \t]+)?(?=\S)", re.M)
_MD_NUMBER = re.compile(r"^([ \t]*)(\d{1,3})[.)][ \t]+(?=\S)", re.M)
# Delimiter runs of emphasis, with whether each may open and may close; matched by ``emphasis``.
_STARS = re.compile(r"(?<![*\\])(?P<open>(?<!\w)(?=\*+[^\s*]))?(?P<run>\*{1,3})(?!\*)(?P<close>(?<=[^\s*]\*)(?!\w)|(?<=[^\s*]\*\*)(?!\w)|(?<=[^\s*]\*\*\*)(?!\w))?")
_BARS = re.compile(r"(?<![_\\])(?P<open>(?<!\w)(?=_+[^\s_]))?(?P<run>_{1,3})(?!_)(?P<close>(?<=[^\s_]_)(?!\w)|(?<=[^\s_]__)(?!\w)|(?<=[^\s_]___)(?!\w))?")
_MD_STRIKE = re.compile(r"(?<!~)~~(?=[^\s~])([^\n]+?)(?<=[^\s~])~~(?!~)")

_ARGUMENT = r"\{((?:[^{}]|\{[^{}]*\})*)\}"
_LATEX_HEADING = re.compile(r"\\(part|chapter|section|subsection|subsubsection|paragraph)\*?" + _ARGUMENT)
_LATEX_DROP = re.compile(r"[ \t]?\\(?:label|ref|eqref|cite[pt]?|pageref|index|vspace|hspace|usepackage|documentclass)\*?(?:\[[^\]\n]*\])*" + _ARGUMENT)
_LATEX_TABULAR = re.compile(r"\\begin\{(tabular\*?|array)\}(?:\[[^\]\n]*\]|" + _ARGUMENT + r")*(.*?)\\end\{\1\}", re.S)
_LATEX_ENV = re.compile(r"\\(?:begin|end)\{[^}\n]*\}(?:\[[^\]\n]*\])?[ \t]*\n?")
_LATEX_OPEN = re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])*\{")
_LATEX_BARE = re.compile(r"(?<![\w:\\/.~])\\(" + "|".join(BARE_COMMANDS) + r")(?![A-Za-z\\])[ \t]*")

_LEVELS = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
_BLOCK = {"p", "div", "br", "tr", "ul", "ol", "table", "section", "article", "blockquote", "details", "summary", "dl", "dt", "dd", "hr"}
#: Where a block of the region scan begins (opening tag) or ends (closing tag).
_BORDER = _BLOCK | set("li td th h1 h2 h3 h4 h5 h6 pre figure figcaption nav header footer aside main form menu fieldset body html head select option script".split())
#: Tags that say nothing of furniture: text-level tags and those of the structure of content.
_NEUTRAL = frozenset(
    "abbr acronym address article b bdi bdo big blockquote body br caption center cite code col colgroup dd del details dfn div dl dt em figcaption figure "
    "font h1 h2 h3 h4 h5 h6 hr html i ins kbd li main mark ol p pre q rp rt ruby s samp section small span strike strong sub summary sup table tbody td tfoot th thead "
    "time title tr tt u ul var wbr".split()
)


class Reader:
    """Lexer of one text: ``kinds`` found, and the text with constructs turned into plain structure.

    HTML tags become a mark with the number of their name, so that the region scan can see them.
    """

    def __init__(self, text: str) -> None:
        self.kinds: set[str] = set()
        self.kept: list[str] = []
        used = set(text)
        free = (c for c in map(chr, range(0xE000, 0xF8FF)) if c not in used)
        self.open, self.close, self.tag = next(free), next(free), next(free)
        self.text = self.read(text.replace("\r\n", "\n").replace("\r", "\n"))

    def mark(self, name: str, closing: bool = False) -> str:
        return f"{self.tag}{2 * HTML_NAMES.index(name) + closing}{self.tag}"

    def keep(self, kind: str | None, content: str) -> str:
        """Set content aside; nothing further is found in it."""
        if kind:
            self.kinds.add(kind)
        self.kept.append(content)
        return f"{self.open}{len(self.kept) - 1}{self.close}"

    def replace(self, kind: str, pattern: re.Pattern, text: str, by, need: str = "") -> str:
        """Replace constructs of a kind; a text without the needed characters is not searched."""
        if need not in text:
            return text

        def one(m: re.Match) -> str:
            self.kinds.add(kind)
            return by(m) if callable(by) else by

        return pattern.sub(one, text)

    def read(self, t: str) -> str:
        if "```" in t or "~~~" in t:
            t = _FENCE.sub(lambda m: self.keep("markdown", f"```{m['info'].strip()}\n{m['body'].rstrip(chr(10))}\n```"), t)
        if "`" in t:
            t = _CODE.sub(lambda m: self.keep("markdown", f"`{m[2]}`"), t)
        if "\\begin{" in t:
            t = _VERBATIM.sub(lambda m: self.keep("latex", f"```\n{m[2].strip(chr(10))}\n```"), t)
        for pattern, shape in _MATH if "$" in t or "\\" in t else ():
            t = pattern.sub(lambda m, s=shape: self.keep("latex", s.format(m[m.lastindex].strip())), t)
        if "<" in t or "&" in t:
            t = self.html(t)
        t = self.wiki(t)
        if "\\" in t:
            t = self.latex(t)
        return self.markdown(t)

    def html(self, t: str) -> str:
        t = self.replace("html", _COMMENT, t, "")
        t = self.replace("html", _SCRIPT, t, lambda m: self.mark(m[1].lower()))
        t = _PRE.sub(lambda m: "\n" + self.keep("html", f"```\n{html.unescape(_TAG.sub('', m[1])).strip(chr(10))}\n```") + "\n", t)
        t = self.replace("markdown", _AUTOLINK, t, lambda m: self.keep(None, m[1]))

        def tag(m: re.Match) -> str:
            closing, name = m[1], m[2].lower()
            mark = self.mark(name, bool(closing))
            if name[0] == "h" and name[1:].isdigit():
                return mark + "\n" if closing else "\n" + mark + self.keep(None, "#" * int(name[1]) + " ")
            if name == "li":
                return mark if closing else "\n" + mark + self.keep(None, "- ")
            if name in ("td", "th"):
                return self.keep(None, " | ") + mark if closing else mark
            return mark + "\n" if name in _BLOCK else mark

        t = self.replace("html", _TAG, t, tag)

        def entity(m: re.Match) -> str:
            if m[1] and m[1] + ";" not in html5:
                return m[0]
            self.kinds.add("html")
            return self.keep(None, html.unescape(m[0]))

        return _ENTITY.sub(entity, t)

    def wiki(self, t: str) -> str:
        def table(m: re.Match) -> str:
            rows = [" | ".join(re.split(r"\|\||!!", line.lstrip("|!+ "))) for line in m[1].split("\n") if line.strip() and not line.startswith("|-")]
            return "\n".join(re.sub(r"\s*\|\s*", " | ", r).strip() for r in rows)

        def link(m: re.Match) -> str:
            target, *labels = m[2].split("|")
            if target.strip().lower().startswith("category:"):
                return ""
            return (labels[-1] if labels else target.lstrip(":")).strip()

        t = self.replace("wiki", _WIKI_TABLE, t, table, "{|")
        t = self.replace("wiki", _WIKI_HEADING, t, lambda m: self.keep(None, "#" * len(m[1]) + " ") + m[2].strip(), "==")
        before = None
        while t != before:  # innermost first; each round makes the text shorter
            before = t
            t = self.replace("wiki", _WIKI_LINK, t, link, "[[")
            t = self.replace("wiki", _TEMPLATE, t, "", "{{")
        t = self.replace("wiki", _WIKI_URL, t, lambda m: m[1], "[")
        t = self.replace("wiki", _SWITCH, t, "", "__")
        before = None
        while t != before:
            before = t
            t = self.replace("wiki", _WIKI_QUOTES, t, lambda m: m[2], "''")
        return t

    def latex(self, t: str) -> str:
        def tabular(m: re.Match) -> str:
            rows = [re.sub(r"\s*&\s*", " | ", r).strip() for r in re.split(r"\\\\|\\hline", m[3])]
            return "\n".join(r for r in rows if r)

        t = self.replace("latex", _LATEX_TABULAR, t, tabular)
        t = self.replace("latex", _LATEX_HEADING, t, lambda m: self.keep(None, "#" * _LEVELS[m[1]] + " ") + m[2].strip() + "\n")
        t = self.replace("latex", _LATEX_DROP, t, "")
        t = self.replace("latex", _LATEX_ENV, t, "")
        t = self.replace("latex", re.compile(r"\\footnote" + _ARGUMENT), t, lambda m: f" ({m[1].strip()})")
        before = None
        while t != before:  # taking a command off may join another to its argument
            before = t
            t = self.unwrap(t)
        t = self.replace("latex", _LATEX_OPEN, t, "")  # cut off before its end
        return self.replace("latex", _LATEX_BARE, t, lambda m: self.keep(None, "- ") if m[1] == "item" else "")

    def unwrap(self, t: str) -> str:
        """Take commands off their arguments, at any depth, by one scan over the braces."""
        pairs, waiting = {}, []
        for m in re.finditer(r"[{}]", t):
            if m[0] == "{":
                waiting.append(m.start())
            elif waiting:
                pairs[waiting.pop()] = m.start()
        heads = [m.span() for m in _LATEX_OPEN.finditer(t) if m.end() - 1 in pairs]
        if not heads:
            return t
        self.kinds.add("latex")
        out, at = [], 0
        for a, b in sorted(heads + [(pairs[b - 1], pairs[b - 1] + 1) for _, b in heads]):
            out.append(t[at:a])
            at = max(at, b)
        return "".join(out) + t[at:]

    def markdown(self, t: str) -> str:
        def table(m: re.Match) -> str:
            rows = [line.strip().strip("|").strip() for i, line in enumerate(m[0].split("\n")) if i != 1]
            return "\n".join(re.sub(r"\s*\|\s*", " | ", r) for r in rows)

        heading = lambda m: self.keep(None, m[1] + " ") + m[2].strip()
        t = self.replace("markdown", _MD_TABLE, t, table, "|")
        t = self.replace("markdown", _MD_HEADING, t, heading, "#")
        t = self.replace("markdown", _MD_SETEXT, t, lambda m: self.keep(None, "# " if m[2][0] == "=" else "## ") + m[1].strip())
        t = self.replace("markdown", _MD_RULE, t, "")
        t = self.replace("markdown", _MD_QUOTE, t, "", ">")
        t = self.replace("markdown", _MD_BULLET, t, lambda m: m[1] + self.keep(None, "- "))
        t = self.replace("markdown", _MD_NUMBER, t, lambda m: m[1] + self.keep(None, m[2] + ". "))
        t = self.replace("markdown", _MD_IMAGE, t, lambda m: m[1], "![")
        t = self.replace("markdown", _MD_LINK, t, lambda m: m[1], "](")
        t = self.replace("markdown", _MD_DEFINITION, t, "", "]:")
        t = self.replace("markdown", _MD_NOTE_TEXT, t, "", "[^")
        t = self.replace("markdown", _MD_NOTE, t, "", "[^")
        t = self.replace("markdown", _MD_REFERENCE, t, lambda m: m[1], "][")
        t = self.emphasis(t, "*", _STARS)
        t = self.emphasis(t, "_", _BARS)
        return self.replace("markdown", _MD_STRIKE, t, lambda m: m[1], "~~")

    def emphasis(self, t: str, mark: str, runs: re.Pattern) -> str:
        """Take matching delimiter runs off: a closing run meets the last open one of its length in its line."""
        if t.count(mark) < 2:
            return t
        lines = t.split("\n")
        for i, line in enumerate(lines):
            if line.count(mark) < 2:
                continue
            waiting: dict[int, list[tuple[int, int]]] = {1: [], 2: [], 3: []}
            cut: list[tuple[int, int]] = []
            for m in runs.finditer(line):
                span, same = m.span("run"), waiting[len(m["run"])]
                if m["close"] is not None and same and span[0] > same[-1][1]:
                    begun = same.pop()
                    cut += [begun, span]
                    for other in waiting.values():  # what opened inside stays open no longer
                        while other and other[-1][0] > begun[0]:
                            other.pop()
                elif m["open"] is not None:
                    same.append(span)
            if cut:
                self.kinds.add("markdown")
                at, kept = 0, []
                for a, b in sorted(cut):
                    kept.append(line[at:a])
                    at = b
                lines[i] = "".join(kept) + line[at:]
        return "\n".join(lines)

    def blocks(self) -> list[tuple[list[str], int, int]]:
        """(token classes, start, end) of each block, in order.

        Classes: ``word``, ``kept`` structure, tag names, and for what stands in links of a block without other
        words ``menu`` (words) and ``a.menu`` (tags); ``a`` and ``link`` elsewhere.
        """
        o, c, g = map(re.escape, (self.open, self.close, self.tag))
        out: list[tuple[list[str], int, int]] = []
        own: list[str] = []
        begin = end = 0
        linked = False

        def close() -> None:
            nonlocal own
            if own:
                alone = "word" not in own
                turned = {"a": "a.menu", "link": "menu"} if alone else {}
                out.append(([turned.get(x, x) for x in own], begin, end))
            own = []

        for m in re.finditer(f"{o}\\d+{c}|{g}(\\d+){g}|[^\\s{o}{c}{g}]+|\n\\s*\n", self.text):
            number = m[1]
            if number is None and m[0][0] == "\n":
                close()
                continue
            name, closing = (HTML_NAMES[int(number) // 2], int(number) % 2) if number else ("", 0)
            if name in _BORDER and not closing:
                close()
            if not own:
                begin = m.start()
            if name:
                linked = not closing if name == "a" else linked
                own.append(name)
            elif m[0][0] == self.open:
                own.append("kept")
            elif any(x.isalnum() for x in m[0]):
                own.append("link" if linked else "word")
            end = m.end()
            if name in _BORDER and (closing or name in ("br", "hr", "script")):
                linked = linked and name == "br"
                close()
        close()
        return out

    def finish(self, region: tuple[int, int]) -> str:
        t = re.sub(f"{re.escape(self.tag)}\\d+{re.escape(self.tag)}", "", self.text[region[0] : region[1]])
        mark = re.compile(f"{re.escape(self.open)}(\\d+){re.escape(self.close)}")
        n = 1
        while n:  # what is set aside may hold what was set aside before it
            t, n = mark.subn(lambda m: self.kept[int(m[1])], t)
        t = re.sub(r"(?<![ \t])[ \t]++(?=\n|\Z)", "", t)
        return re.sub(r"\n{3,}", "\n\n", t).strip("\n")


def best_region(scores: list[float], cost: float = 0.0) -> tuple[int, int]:
    """Bounds of the contiguous run of the highest sum, the longest of equals, by one linear scan.

    Each end that leaves something out costs ``cost``. Where no run scores above zero all is kept.
    """
    best, run, start, where = 0.0, 0.0, 0, (0, len(scores))
    for i, s in enumerate(scores):
        if i and run < -cost:
            run, start = -cost, i
        run += s
        total = run - (cost if i + 1 < len(scores) else 0.0)
        if total > best or (total == best and total > 0):
            best, where = total, (start, i + 1)
    return where


@dataclass(frozen=True)
class Weights:
    """Weight of each token class (others have none), and the cost of leaving a rim out."""

    classes: dict[str, float]
    cost: float

    def score(self, own: list[str]) -> float:
        return sum(self.classes.get(x, 0.0) for x in own)


def _labelled(page: str) -> list[tuple[list[str], int]]:
    """(token classes, share of label) of the blocks of a page: 1 inside, 0 outside its marks."""
    before, rest = page.split("«")
    content, after = rest.split("»")
    return [(own, label) for part, label in ((before, 0), (content, 1), (after, 0)) for own, _, _ in Reader(part).blocks()]


def fit_weights(pages: list[str]) -> Weights:
    """Log odds of each token class inside against outside the labelled content, add-one smoothed.

    Words can't count against a block, tags can't count for it, neutral tags have no weight. The
    cost of a cut is the least power of two at which no word of labelled content is lost.
    """
    parts = [_labelled(p) for p in pages]
    counts: dict[str, list[int]] = {}
    for page in parts:
        for own, label in page:
            for x in own:
                counts.setdefault(x, [1, 1])[label] += 1
    total = [sum(c[label] for c in counts.values()) or 1 for label in (0, 1)]
    odds = {x: math.log(c[1] / total[1]) - math.log(c[0] / total[0]) for x, c in counts.items()}
    classes = {x: max(v, 0.01) if x in ("word", "kept") else min(v, 0.0) for x, v in odds.items() if x not in _NEUTRAL}
    cost = 0.5
    while cost < 1 << 20:
        weights = Weights(classes, cost)
        if not any(_lost(page, weights) for page in parts):
            break
        cost *= 2
    return weights


def _lost(page: list[tuple[list[str], int]], weights: Weights) -> int:
    """Content words that a cut of the page leaves out."""
    a, b = best_region([weights.score(own) for own, _ in page], weights.cost)
    return sum(x in ("word", "link", "menu") for i, (own, label) in enumerate(page) if label and not a <= i < b for x in own)


@lru_cache(maxsize=1)
def default_weights() -> Weights:
    """Weights of the generated labelled pages."""
    return fit_weights(labelled_pages())


def clean(text: str, weights: Weights) -> tuple[str, list[str], int]:
    """(clean text, kinds found, words and tags left out at the rims)."""
    reader = Reader(text)
    if not reader.kinds:
        return text, [], 0
    if reader.tag not in reader.text:
        return reader.finish((0, len(reader.text))), sorted(reader.kinds), 0
    blocks = reader.blocks()
    a, b = best_region([weights.score(own) for own, _, _ in blocks], weights.cost)
    region = (0 if a == 0 else blocks[a][1], len(reader.text) if b == len(blocks) else blocks[b - 1][2])
    return reader.finish(region), sorted(reader.kinds), sum(len(own) for i, (own, _, _) in enumerate(blocks) if not a <= i < b)


def clean_markup(df: DataFrame, key: str, text: str, pages: list[str] | None = None) -> DataFrame:
    """Rows (key, text, kinds, outside), one for each row; no shuffle."""
    weights = fit_weights(pages) if pages else default_weights()
    schema = T.StructType(
        [df.schema[key], T.StructField("text", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType(), False)), T.StructField("outside", T.IntegerType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(None, [], 0) if t is None else clean(t, weights) for t in batch.column(1).to_pylist()]
            kinds = (pa.string(), pa.list_(pa.string()), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], kinds[i]) for i in range(3))], names=schema.fieldNames())

    return df.select(key, df[text].cast("string")).mapInArrow(run, schema)
