"""Labelled pages for the weights of the region scan: «» encloses the content of each.

Pages are put together by a seeded generator from forms of content (prose with inline tags, headings,
lists, tables, quotes, code, figures, notes with a stray tag) and forms of page furniture (menus, bread crumbs, forms,
sidebars, share bars, notices, footers). Four in ten have no furniture at all, as most texts
of a note collection. A collection with labelled pages of its own passes those instead.
"""

from __future__ import annotations

import random

WORDS = (
    "note index chunk reader graph token section query vector answer heading margin letter garden river stone winter harbour engine report paper market "
    "small quiet long early careful open plain steady broken late keeps finds reads moves holds turns shows leaves builds follows often never slowly "
    "below above after before between under again the a of and to in it with for from this that when"
).split()
MENU = "Home About News Archive Topics Contact Login Register Help Search Tags Feed Shop Blog Team Docs Next Previous Share Print Imprint Privacy Terms Sitemap".split()


class Pages:
    """Pages of a seed: ``page()`` gives one after another."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def words(self, least: int, most: int) -> str:
        return " ".join(self.r.choice(WORDS) for _ in range(self.r.randint(least, most)))

    def inline(self, text: str) -> str:
        """Prose with a few inline tags, links among them."""
        out = []
        for word in text.split():
            x = self.r.random()
            if x < 0.03:
                word = f"<a href='/{word}'>{word} {self.words(1, 2)}</a>"
            elif x < 0.12:
                tag = self.r.choice(("b", "i", "em", "strong", "code", "sup", "sub", "span", "mark", "u", "small", "kbd", "font"))
                word = f"<{tag}>{word}</{tag}>"
            elif x < 0.14:
                word += "<br>"
            out.append(word)
        return " ".join(out)

    def sentence(self) -> str:
        return self.inline(self.words(5, 16)).capitalize() + "."

    def block(self) -> str:
        """One form of content."""
        r = self.r
        prose = " ".join(self.sentence() for _ in range(r.randint(1, 4)))
        item = lambda: self.inline(self.words(1, 7))
        form = r.randrange(10)
        if form < 3:
            return f"<p>{prose}</p>"
        if form == 3:
            return f"<h{(n := r.randint(1, 4))}>{self.words(1, 5)}</h{n}><p>{prose}</p>"
        if form == 4:
            kind = r.choice(("ul", "ol"))
            return f"<{kind}>" + "".join(f"<li>{item()}</li>" for _ in range(r.randint(2, 5))) + f"</{kind}>"
        if form == 5:
            row = lambda t: "<tr>" + "".join(f"<{t}>{item()}</{t}>" for _ in range(2)) + "</tr>"
            return "<table>" + row("th") + "".join(row("td") for _ in range(r.randint(1, 4))) + "</table>"
        if form == 6:
            return f"<blockquote>{prose}</blockquote>"
        if form == 7:
            return f"<figure><img src='{r.choice(WORDS)}.png'><figcaption>{item()}</figcaption></figure>"
        if form == 8:
            return f"<pre><code>{self.words(2, 6)}</code></pre>"
        return f"<div>{prose}</div>"

    def note(self) -> str:
        """A plain text of a note with few tags in it: all content."""
        lines = [self.r.choice((self.sentence, self.block, lambda: self.words(3, 9) + ".", lambda: f"See {self.inline(self.words(1, 3))}", lambda: f"See <a href='{self.r.choice(WORDS)}'>{self.words(1, 2)}</a>."))() for _ in range(self.r.randint(1, 8))]
        return "\n\n".join(lines)

    def links(self, n: int) -> list[str]:
        return [f"<a href='/{i}'>{self.r.choice(MENU)}</a>" for i in range(n)]

    def rim(self) -> str:
        """One form of page furniture."""
        r = self.r
        some = self.links(r.randint(3, 9))
        form = r.randrange(11)
        listed = "<ul>" + "".join(f"<li>{a}</li>" for a in some) + "</ul>"
        if form == 0:
            return f"<nav>{listed}</nav>"
        if form == 1:
            return f"<div class='menu'>{listed}</div>"
        if form == 2:
            return "<div class='path'>" + r.choice((" | ", " &gt; ", " / ", " ")).join(some) + "</div>"
        if form == 3:
            return f"<form action='/s'><label>{r.choice(MENU)}</label><input name='q'><button>{r.choice(MENU)}</button></form>"
        if form == 4:
            return f"<aside><div>{r.choice(MENU)}</div>{listed}</aside>"
        if form == 5:
            return "<div class='share'>" + "".join(f"<a href='#'><img src='{i}.gif'></a>" for i in range(r.randint(2, 5))) + "".join(some[:2]) + "</div>"
        if form == 6:
            return f"<footer><div>{' '.join(some)}</div><small>{r.choice(MENU)} {r.randint(1990, 2030)}</small></footer>"
        if form == 7:
            return "<table><tr>" + "".join(f"<td>{a}</td>" for a in some) + "</tr></table>"
        if form == 8:
            return "<select>" + "".join(f"<option>{r.choice(MENU)}</option>" for _ in some) + "</select>"
        if form == 9:
            return "<script>var a = 1;</script><iframe src='/ad'></iframe><div>" + "<br>".join(some) + "</div>"
        return "<div>" + "".join(f"<span>{a}</span>" for a in some) + "</div>"

    def page(self) -> str:
        r = self.r
        if r.random() < 0.4:
            return f"«{self.note()}»"
        gap = r.choice(("", "\n"))
        rims = lambda: gap.join(self.rim() for _ in range(r.randint(0, 3)))
        content = gap.join(self.block() for _ in range(r.randint(1, 7)))
        # content that is bare code or a figure at its rim would be labelled by its neighbours alone
        return f"{rims()}{gap}«<p>{self.sentence()}</p>{gap}{content}{gap}<p>{self.sentence()}</p>»{gap}{rims()}"


def pages(n: int = 300, seed: int = 11) -> list[str]:
    """``n`` labelled pages of a seed; ``n`` is the bound of the sample the weights are fitted on."""
    made = Pages(seed)
    return [made.page() for _ in range(n)]
