import pytest

from notelattice.llm import markup as mk
from notelattice.llm.labelled import pages

WEIGHTS = mk.default_weights()
PLAIN = [
    "The C# sentence and the F# snippet share issue #12. Tag it #review and #graph-walk.",
    "Failures and retries > Embedding drift > Notes",
    "Put it in ~/notes or C:\\vault\\item as section.md.",
    "If posting < 9 and query > 33, it is deep. x <= 50 holds, and so does y <> 18; a == b fails.",
    "Its size is 2^24 and f(x) = x*x + 10. Set max_chunk_size to 32 * 36 * 36.",
    "The batch costs $5 to $55 per entity. It costs $7.",
    "A set like {a, b} keeps 35% of it (a_b_c). Read row[60] and entity[0] of the R&D edge.",
    "Key=value; path=/a/b?c=14&d=54 stays. Rule 1. of it: keep it -- always; *see below.",
    "It isn't the readers' vault, it's the index's \"linked\" side... maybe. The range 30 - 29 -> done.",
    "",
]
KINDS = {
    "html": ["A <b>b</b> c", "x<br/>y", "<span\n  data-x=\"1\">a</span>", "<IMG SRC=a.png ALT=\"b\">", "<!-- a -->", "a &amp; b", "a&#8217;s", "<h3 id='x'>T</h3>", "<details><summary>a</summary></details>"],
    "latex": ["\\textbf{a} b", "\\section{A}", "$x^2$ a", "$$\\sum_j x$$", "\\[ a \\]", "with \\(k = 3\\)", "\\begin{itemize}\n\\item a\n\\end{itemize}", "a\\footnote{b}", "see \\ref{sec:a}", "\\begin{verbatim}\na = b\n\\end{verbatim}"],
    "markdown": [
        "**a** b", "a *b* c", "a ***b*** c", "__a__ and _b c_ d", "~~a~~", "# A\nb", "A\n===\nb", "A\n---\nb", "- a\n- b", "* a\n* b", "+ a", "1. a\n2. b", "1) a\n   - b", "- [ ] a",
        "> a\n> b", "[a](b.md)", "![a](b.png \"c\")", "[a][b]", "[a]: https://x.example/y", "a.[^2]", "[^2]: a", "<https://x.example/y>", "| a | b |\n|---|:--:|\n| c | 1 |", "`a`",
        "```sql\n[[x]] {{y}} <b> \\section{a} $x$\n```", "~~~\n<div>a</div>\n~~~", "````\n# a\n````", "Use `<column>` or `$PATH`.", "---", "a\r\n\r\n# b",
    ],
    "wiki": ["[[a]]", "[[a/b|c d]]", "![[a#b]]", "[[File:a.png|thumb|b]]", "{{a|b=1|c}}", "[https://x.example/y some label]", "== A ==", "=== A b ===", "'''a b'''", "a ''b'' c", "__NOTOC__", "{| class=\"a\"\n|-\n! a !! b\n|-\n| c || 1\n|}", "[[Category:A]]"],
}


@pytest.mark.parametrize("text", PLAIN)
def test_plain_text_stays(text):
    assert mk.clean(text, WEIGHTS) == (text, [], 0)


@pytest.mark.parametrize(("kind", "text"), [(k, t) for k, ts in KINDS.items() for t in ts])
def test_kinds(kind, text):
    assert mk.clean(text, WEIGHTS)[1] == [kind]
    assert mk.clean(f"Some words go before.\n\n{text}\n\nAnd some after it.", WEIGHTS)[1] == [kind]


def test_structure_is_kept():
    text = "<h2>Head</h2><ul><li>one</li><li>two &amp; three</li></ul>\n\n\\section{Sec}\nwith $x^2$ and \\textbf{bold}\n\n== Wiki ==\n[[a|label]]\n\n- *item*\n\n```py\nx = '**'\n```\n\n\\begin{tabular}{ll}\na & b \\\\\n\\end{tabular}"
    out, kinds, _ = mk.clean(text, WEIGHTS)
    assert kinds == ["html", "latex", "markdown", "wiki"]
    for part in ("## Head", "- one", "- two & three", "# Sec", "$x^2$", "bold", "## Wiki", "label", "- item", "```py\nx = '**'\n```", "a | b"):
        assert part in out
    for part in ("<li", "textbf", "[[", "==", "*item*"):
        assert part not in out


def test_region_leaves_navigation_out():
    page = "<ul><li><a href='/'>Home</a></li><li><a href='/x'>Notes</a></li><li><a href='/y'>Tags</a></li></ul><p>The text itself has many words and it goes on for a while, so that it wins.</p><div><a href='z'>Share</a><img src='q'><br></div>"
    out, _, outside = mk.clean(page, WEIGHTS)
    assert "The text itself" in out and "Home" not in out and "Share" not in out and outside > 5


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("<ul><li>alpha</li><li>beta</li></ul>", "- alpha\n- beta"),
        ("Use <b>one</b>.<br><br><br>Then two.", "Use one.\n\nThen two."),
        ("<b>A</b> <i>B</i> and <u>C</u> then plain words here", "A B and C then plain words here"),
        ("A <b>early</b> writer", "A early writer"),
        ("See <a href='x'>A b</a>.", "See A b."),
        ("<a href='x'>A</a>", "A"),
        ("<table><tr><th>head</th><td>cell</td></tr></table>\n\nwords", "head |  cell |\n\nwords"),
    ],
)
def test_without_a_rim_every_word_stays(text, want):
    out, _, outside = mk.clean(text, WEIGHTS)
    assert outside == 0 and out.split() == want.split()


def test_best_region():
    assert mk.best_region([-1, 2, -1, 3, -5, 1]) == (1, 4)
    assert mk.best_region([1.0, 1.0]) == (0, 2)
    assert mk.best_region([]) == (0, 0)
    assert mk.best_region([-1, 2, -1], cost=2) == (0, 3)
    assert mk.best_region([-9, 5, -1, 5, -9], cost=2) == (1, 4)


def test_held_out_pages():
    """Precision and recall of the words of held-out labelled pages; the printed figures are those of the README."""
    kept = lost = left = gone = 0
    for page in pages(600, seed=99):
        parts = mk._labelled(page)
        a, b = mk.best_region([WEIGHTS.score(own) for own, _ in parts], WEIGHTS.cost)
        for i, (own, label) in enumerate(parts):
            n = sum(x in ("word", "link", "menu") for x in own)
            inside = a <= i < b
            kept, lost, left, gone = kept + n * (label and inside), lost + n * (label and not inside), left + n * (not label and inside), gone + n * (not label and not inside)
    print("content kept", kept, "lost", lost, "rim left", left, "removed", gone)
    assert lost <= 0.001 * (kept + lost) and gone >= 0.97 * (gone + left)


def test_pages_written_by_hand():
    pages_ = [
        "<html><head><title>x</title></head><body><header><nav><a href='/'>Start</a> | <a href='/n'>Notes</a> | <a href='/w'>Who</a></nav></header><main>«<h1>Chunk sizes</h1><p>A chunk of five hundred tokens keeps a heading.</p>"
        "<p>Longer sections are cut at <b>sentences</b>.</p>»</main><footer><a href='/i'>Imprint</a><a href='/p'>Privacy</a></footer></body></html>",
        "<div id='m'><a href='a'>Start</a><span>|</span><a href='b'>Tags</a><span>|</span><a href='c'>More</a></div>«<p>The ranker reads three scores for each of them.</p><ul><li>ranks are kept</li><li>ties go to the smaller key</li></ul>»"
        "<div><img src='x'><a href='d'>Share</a><a href='e'>Print</a><a href='e'>Mail</a></div>",
        "«One <i>short</i> line, <a href='x'>with a link</a>»",
    ]
    for page in pages_:
        parts = mk._labelled(page)
        assert mk._lost(parts, WEIGHTS) == 0
        a, b = mk.best_region([WEIGHTS.score(own) for own, _ in parts], WEIGHTS.cost)
        words = [sum(x in ("word", "link", "menu") for x in own) * (a <= i < b) for i, (own, label) in enumerate(parts) if not label]
        assert sum(words) <= 1


def test_weights_follow_the_labels():
    assert WEIGHTS.classes["word"] > 0 > WEIGHTS.classes["a.menu"] and WEIGHTS.classes["nav"] < 0 and "li" not in WEIGHTS.classes


def test_dirty_rows(spark):
    long = "Plain words. " * 30_000 + "**end**"
    df = spark.createDataFrame([("a", None, 1), ("b", "", 1), ("c", long, 1), ("c", long, 1), (None, "<b>x</b>", 1)], "chunk_id string, text string, kinds int")
    got = mk.clean_markup(df, "chunk_id", "text").collect()
    assert len(got) == 5
    by = {r.chunk_id: r for r in got}
    assert by["a"].text is None and by["a"].kinds == [] and by["b"].text == "" and by["c"].kinds == ["markdown"] and by[None].text == "x"
    assert by["c"].text.endswith("Plain words. end")
    assert mk.clean_markup(df.limit(0), "chunk_id", "text").collect() == []
