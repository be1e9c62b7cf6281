import numpy as np
import pytest

from notelattice.llm import neighbours as nb
from notelattice.llm.markup import Reader
from notelattice.llm.queries import _judged
from notelattice.llm.queries import queries as llm


def test_every_document_is_judged(spark, tmp_path):
    word = lambda i, j: f"w{(i * 7919 + j * 104729) % 3001}"
    plain = [(i, " ".join(word(i, j) for j in range(80 + i % 9)) + " w1 w2" * (i % 4), "en", f"s{i % 60}") for i in range(300)]
    spam = [(1000 + i, "buy this now and again please friends. " * 30, lang, source) for i, (lang, source) in enumerate([("en", "s1"), (" EN", "rare"), ("xx", "rare"), (None, None)])]
    spark.createDataFrame(plain + spam, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in _judged(spark, str(tmp_path)).collect()}
    assert len(got) == 304 and all(r.distance is not None for r in got.values())
    assert {1000, 1001, 1002, 1003} <= {r.doc_id for r in llm()["p10_outliers"](spark, str(tmp_path)).collect()}
    assert sum(got[i].outlier for i in range(300)) < 60


@pytest.mark.parametrize("crowd", [8192, 700])
def test_near_copies_keep_their_neighbours(spark, monkeypatch, crowd):
    monkeypatch.setattr(nb, "CROWD", crowd)
    r = np.random.default_rng(3)
    x = r.normal(size=(4500, 32))
    x[:1500] = x[0] + r.normal(size=(1500, 32)) * 1e-3
    x = x.astype(np.float32)
    df = spark.createDataFrame([(f"k{i:05d}", v.tolist(), None) for i, v in enumerate(x)], "chunk_id string, embedding array<float>, embedded_at timestamp")
    got = {}
    for row in nb.nearest_neighbours(df, "chunk_id", "embedding", "embedded_at", 32, 5).collect():
        got.setdefault(row.chunk_id, set()).add(row.neighbour)
    own = x[:1500].astype(np.float64)
    own /= np.linalg.norm(own, axis=1, keepdims=True)
    s = own @ own.T
    np.fill_diagonal(s, -9)
    best = np.argsort(-s, axis=1)[:, :5]
    hits = sum(len(got[f"k{i:05d}"] & {f"k{j:05d}" for j in best[i]}) for i in range(1500))
    print("recall", hits / 7500)
    assert hits >= 0.999 * 7500


def test_markup_of_any_depth():
    depth = 9
    wiki = Reader("a " + "{{x|" * depth + "y" + "}}" * depth + " b")
    assert "{" not in wiki.text and "}" not in wiki.text and "wiki" in wiki.kinds
    latex = Reader("a " + "\\emph{\\textbf{" * depth + "word" + "}}" * depth + " b")
    assert latex.text.split() == ["a", "word", "b"] and "latex" in latex.kinds
