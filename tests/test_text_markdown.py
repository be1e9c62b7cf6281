import json
import random

import pytest
from pyspark.sql import functions as F

from notelattice.functions import text as tx
from notelattice.functions.noise import NoiseWords
from notelattice.functions.vector import cosine, store_similarity
from notelattice.operators import extraction
from notelattice.operators import markdown as md
from notelattice.sources.exclude import matches, matches_directory


def value(spark, column, **names):
    schema = ", ".join(f"{k} {'array<double>' if isinstance(v, list) else 'string'}" for k, v in names.items())
    return spark.createDataFrame([tuple(names.values())], schema).select(column.alias("v")).first()["v"]


def test_tokenize(spark):
    got = value(spark, tx.tokenize(F.col("t")), t="The quick CSS fox jumps over ff6b6b tokens, ÉTÉ x_1")
    assert got == ["quick", "css", "fox", "jumps", "tokens", "x_1"]
    assert value(spark, tx.tokenize(F.col("t"), NoiseWords(stop=("fox",), upper=())), t="the fox") == ["the"]
    assert value(spark, tx.tokenize(F.col("t")), t=None) == []


def test_sizes_and_cleaning(spark):
    assert value(spark, tx.estimate_tokens(F.col("t")), t="") == 1
    assert value(spark, tx.estimate_tokens(F.col("t")), t="x" * 11) == 2
    assert value(spark, tx.clean_text(F.col("t")), t="  a \t\r\n\n\n\nb \n") == "a\n\nb"
    assert value(spark, tx.clean_text(F.col("t")), t="a" + " " * 200_000 + "b") == "a" + " " * 200_000 + "b"
    assert value(spark, tx.split_sentences(F.col("t")), t="First sentence. Second starts. third lower.") == ["First sentence.", "Second starts. third lower."]
    assert value(spark, tx.preprocess_query(F.col("t")), t="  A\t B  c ") == "a b c"


def test_ngrams(spark):
    assert value(spark, tx.ngrams(F.split("t", " ")), t="a b c") == ["a", "b", "c", "a b", "b c", "a b c"]
    assert value(spark, tx.ngrams(F.split("t", " ")), t="a") == ["a"]


def test_snippet(spark):
    long = "x" * 400 + " Needle " + "y" * 400
    got = value(spark, tx.snippet(F.col("t"), F.split("q", " ")), t=long, q="absent needle")
    assert "Needle" in got and len(got) <= 300
    assert value(spark, tx.snippet(F.col("t"), F.split("q", " ")), t=" " + "z" * 400, q="absent") == " " + "z" * 299
    assert value(spark, tx.snippet(F.col("t"), F.split("q", " ")), t=None, q="a") == ""


def test_query_analysis(spark):
    got = value(spark, tx.analyze_query(F.col("q"), F.col("q")), q="How does New York use RAG in London")
    assert got.entity_hints == ["How", "New York", "London"] and got.has_acronyms and "york" in got.tokens


def test_vectors(spark):
    assert value(spark, cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 1.0]) == pytest.approx(2**-0.5)
    assert value(spark, cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 1.0]) == 0.0
    assert value(spark, cosine(F.col("a"), F.col("b")), a=[1.0], b=[1.0, 1.0]) == 0.0
    assert value(spark, store_similarity(cosine(F.col("a"), F.col("b"))), a=[1.0], b=[-1.0]) == 0.0


def test_sections():
    got = list(md.with_paths(md.parse_sections("pre\n\n# A\none\n\n## B\ntwo\n# C\n### D\nx")))
    assert [(p, lv) for p, lv, _, _ in got] == [([], 0), (["A"], 1), (["A", "B"], 2), (["C"], 1), (["C", "B", "D"], 3)]
    assert [b for _, _, b, _ in got] == ["pre", "one", "two", "", "x"] and got[1][3] == 5
    assert list(md.parse_sections(" a\n\nb ")) == [(0, "", "a\n\nb", 0)]
    assert list(md.parse_sections("# T\r\nx")) == [(0, "", "# T\r\nx", 0)]
    assert list(md.parse_sections("")) == [(0, "", "", 0)]


def test_packing_by_properties():
    """Each chunk is within its budget unless it is one sentence; an overlap is the longest that fits; nothing is lost."""
    r = random.Random(1)
    size = md.tokens_of
    for _ in range(400):
        sentences = [f"W{i}" + "o" * r.randint(0, 60) + r.choice(".!?") for i in range(r.randint(1, 30))]
        path, most, overlap = r.choice(["", "A > B"]), r.randint(3, 60), r.randint(0, 30)
        got = list(md.pack(path, " ".join(sentences), most, overlap))
        head = f"{path}\n\n" if path else ""
        if size(head + " ".join(sentences)) <= most:
            assert got == [head + " ".join(sentences)]
            continue
        lists = [g.removeprefix(head).split(" ") for g in got]
        assert all(g.startswith(head) for g in got)
        fixed = size(path) + 10 if path else 0
        done = 0
        for i, own in enumerate(lists):
            first = sentences.index(own[0])
            assert own == sentences[first : first + len(own)] and first <= done
            repeated = done - first
            if i:
                assert not repeated or size("".join([" ".join(own[1:repeated]), own[0]]) if repeated > 1 else own[0]) <= overlap
            fresh = own[repeated:]
            assert fresh  # every chunk brings something new
            budget = fixed + (size(" ".join(own[:repeated])) if repeated else 0)
            assert len(own) == 1 or budget + sum(size(s) for s in fresh[:-1]) <= most or len(fresh) == 1
            done = first + len(own)
        assert done == len(sentences)


def test_packing_by_hand():
    body = "Aaa aaa. Bbb bbb. Ccc ccc. Ddd ddd."  # two tokens a sentence
    assert list(md.pack("", body, 4, 0)) == ["Aaa aaa. Bbb bbb.", "Ccc ccc.", "Ddd ddd."]  # an empty overlap counts as a token
    assert list(md.pack("", body, 5, 0)) == ["Aaa aaa. Bbb bbb.", "Ccc ccc. Ddd ddd."]
    assert list(md.pack("", body, 4, 2)) == ["Aaa aaa. Bbb bbb.", "Bbb bbb. Ccc ccc.", "Ccc ccc. Ddd ddd."]
    assert list(md.pack("", body, 8, 2)) == [body]
    assert list(md.pack("P", "Aaa aaa. " * 3 + "Bbb.", 5, 0)) == ["P\n\nAaa aaa."] * 3 + ["P\n\nBbb."]
    assert list(md.pack("", "no end of it " * 9, 5, 2)) == [("no end of it " * 9).strip()]
    assert list(md.pack("", " " * 99, 5, 2)) == []


def test_chunks(spark):
    df = spark.createDataFrame([("/a.md", "# Title\nIntro text.\n## Section A\nContent A.\n### Sub\nDetail."), ("/b.md", None), ("/c.md", "W. " * 4000)], "path string, content string")
    rows = md.chunks(df, "path", "content").orderBy("file_path", "chunk_index").collect()
    assert [r.heading_hierarchy for r in rows if r.file_path == "/a.md"] == [["Title"], ["Title", "Section A"], ["Title", "Section A", "Sub"]]
    assert [r.text for r in rows if r.file_path == "/b.md"] == [""]
    assert sum(r.file_path == "/c.md" for r in rows) > 3
    assert len({r.chunk_id for r in rows}) == len(rows)
    assert md.chunks(df.limit(0), "path", "content").collect() == []


def test_frontmatter(spark):
    text = '---\nname: "A b"\nn: 12.5\nyes: true\nlist: ["a"]\nobj: {"k": 1}\nbad: [x\nempty:\nname: last\n: none\n---\nBody #tag'
    got = {e.key: (e.kind, e.value) for e in value(spark, md.frontmatter(F.col("t")), t=text)}
    assert got == {"name": ("string", "last"), "n": ("number", "12.5"), "yes": ("boolean", "true"), "list": ("json", '["a"]'), "obj": ("json", '{"k": 1}'), "bad": ("string", "[x"), "empty": ("number", "0")}
    assert value(spark, md.body(F.col("t")), t=text) == "Body #tag"
    assert value(spark, md.frontmatter(F.col("t")), t="---\na: b\n---\n") == []
    assert value(spark, md.frontmatter(F.col("t")), t=None) == []


def test_links(spark):
    t = "[[A|b]] [[ A ]] ![i](u.png) [x]( y ) #t-1 ##t_2 [[C]]"
    assert value(spark, md.wikilinks(F.col("t")), t=t) == ["A", "C"]
    assert [(x.text, x.url) for x in value(spark, md.markdown_links(F.col("t")), t=t)] == [("i", "u.png"), ("x", "y")]
    assert value(spark, md.tags(F.col("t")), t=t) == ["t-1", "t_2"]


def test_parents(spark):
    t = "# A\n## B\n### C\n# D\n### E\n## F\n### G"
    df = spark.createDataFrame([(t,)], "t string").select(md.headings(F.col("t")).alias("h"))
    got = df.select(md.heading_parents(F.col("h")).alias("p")).first().p
    assert [(x.parent, x.child) for x in got] == [("A", "B"), ("B", "C"), ("D", "F"), ("F", "G")]


def test_title(spark):
    assert value(spark, md.title(F.col("t"), F.col("p")), t="x\n# Head \n", p="/a/b.md") == "Head"
    assert value(spark, md.title(F.col("t"), F.col("p")), t=None, p="/a/b.md") == "b"


def test_acronyms(spark):
    t = "Resource Description Framework (RDF) and NASA (National Space Agency), Other Long Name - OLN. CSS (Cascading Sheets). Full Ad (FAD)"
    got = [(x.acronym, x.expansion) for x in value(spark, extraction.acronyms(F.col("t")), t=t)]
    assert got == [("RDF", "Resource Description Framework"), ("NASA", "National Space Agency"), ("OLN", "Other Long Name")]
    rows = spark.createDataFrame([(1, "Short Name (SN)"), (2, "Much Longer Secret Name (SN)"), (3, None)], "k int, t string")
    assert [(r.acronym, r.expansion) for r in extraction.acronym_dictionary(rows, "k", "t").collect()] == [("SN", "Much Longer Secret Name")]


def test_expansion(spark):
    d = spark.createDataFrame([("RAG", "Retrieval Augmented Generation", 0), ("RAGS", "Other", 1)], "acronym string, expansion string, ord bigint")
    q = spark.createDataFrame([(1, "what is RAGG what"), (2, "rag"), (3, "none")], "k int, q string")
    got = {r.k: r.expanded for r in extraction.expand_queries(q, "k", "q", d).collect()}
    assert got == {1: "what is RAGG Retrieval Augmented Generation", 2: "rag Retrieval Augmented Generation", 3: "none"}
    assert {r.k: r.expanded for r in extraction.expand_queries(q, "k", "q", d.limit(0)).collect()}[1] == "what is RAGG what"


def test_exclude():
    for path, patterns, want in [
        ("draft.md", ["draft.md"], True), ("a/draft.md", ["draft.md"], True), ("evidence/raw.md", ["evidence/**"], True), ("keep.md", ["evidence/**", " "], False),
        ("a/b/c.md", ["**/c.md"], True), ("c.md", ["**/c.md"], True), ("a/b.md", ["a/?.md"], True), ("a\\b.md", ["./a/"], True), ("ab/c.md", ["a/"], False), ("a+b.md", ["a+b.md"], True),
    ]:
        assert matches(path, patterns) is want, (path, patterns)
    assert matches_directory("evidence", ["evidence/**"]) and not matches_directory("evid", ["evidence/**"])


def test_json_stays_json(spark):
    assert json.loads(value(spark, md.frontmatter(F.col("t")), t='---\na: {"x": [1]}\n---\nb')[0].value) == {"x": [1]}
