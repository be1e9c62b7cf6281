import numpy as np
import pytest
import regex

from notelattice.llm import mixture as mx
from notelattice.llm import repetition as rp
from notelattice.llm.queries import vocabulary


def test_flight_keeps_totals():
    r = np.random.default_rng(0)
    sizes = r.integers(0, 900, 4000)
    chance = np.full(4000, 0.37)
    p = mx.flight(chance, sizes, np.random.default_rng(1))
    open_ = (p > 0) & (p < 1)
    assert open_.sum() <= 2
    assert abs(p.sum() - chance.sum()) < 1e-6 and abs((p * sizes).sum() - (chance * sizes).sum()) < 1e-3
    done = mx.landing(p, sizes)
    assert set(np.unique(done)) <= {0.0, 1.0}
    assert abs((done * sizes).sum() - (chance * sizes).sum()) < 900


def test_flight_is_fair():
    r = np.random.default_rng(0)
    sizes = r.integers(1, 50, 12)
    mean = np.mean([mx.landing(mx.flight(np.full(12, 0.5), sizes, np.random.default_rng(i)), sizes) for i in range(3000)], axis=0)
    assert np.abs(mean - 0.5).max() < 0.1


def documents(spark, n=900):
    names = ["big", " Big", "BIG", "small", "none", None, "tiny"]
    rows = [(i, "word " * (i % 60), names[i % 3] if i % 10 < 8 else names[3 + i % 4]) for i in range(n)]
    return spark.createDataFrame(rows + [(n, None, "small"), (n + 1, "", "tiny"), (n + 2, "word " * 4000, "small")], "doc_id bigint, text string, source string")


@pytest.mark.parametrize("block", [5000, 40])
def test_mix(spark, block):
    docs = documents(spark)
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 3), ("tiny", 0.15, 1), ("absent", 0.05, 4)], "source string, target_share double, max_repeats int")
    sized = mx.source_sizes(docs, targets, vocabulary())
    planned = mx.plan(sized, targets)
    drawn = mx.draw(sized, planned, block=block)
    out = {r.source: r for r in mx.report(planned, drawn).collect()}
    total = sum(out[s].size for s in ("big", "small", "tiny"))
    biggest = sized.agg({"size": "max"}).first()[0]
    for s, share, most in (("big", 0.5, 1), ("small", 0.3, 3), ("tiny", 0.15, 1), ("absent", 0.05, 4)):
        r = out[s]
        assert r.total == total and r.most_uses <= most
        assert r.short == r.exhausted == (most * r.size < share * total)
        assert abs(r.tokens - min(share * total, most * r.size)) <= biggest
    assert out["absent"].short and out["absent"].tokens == 0 and out["absent"].size == 0
    assert drawn.count() == sized.count() == drawn.select("k").distinct().count()


def test_mix_of_nothing(spark):
    targets = spark.createDataFrame([("big", 1.0, 1)], "source string, target_share double, max_repeats int")
    for docs in (documents(spark).limit(0), documents(spark).filter("source = 'none'")):
        sized = mx.source_sizes(docs, targets, vocabulary())
        planned = mx.plan(sized, targets)
        (r,) = mx.report(planned, mx.draw(sized, planned)).collect()
        assert (r.size, r.tokens, r.short) == (0, 0, False)


def brute(words, run):
    marked, seen = set(), set()
    for i in range(len(words) - run + 1):
        gram = tuple(words[i : i + run])
        if gram in seen:
            marked.update(range(i, i + run))
        seen.add(gram)
    return len(marked)


def test_repeated_words(rng):
    for _ in range(300):
        words = [rng.choice("abc") for _ in range(rng.randint(0, 60))]
        for run in (1, 3, 6):
            assert rp.repeated_words(words, run) == brute(words, run)


def test_repetition_rows(spark, long_text):
    texts = [None, "", " \r\n ", "one two three", "A b c d e f. a B c d e f!", long_text, "e\u0301te\u0301 x² 中文 _ " * 10]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(0, None, 1)], "doc_id bigint, text string, words int")
    got = rp.repetition(df, ["doc_id"], "text").collect()
    assert len(got) == len(texts) + 1
    for r in got:
        words = regex.findall(r"[\p{L}\p{N}]+", (texts[r.doc_id] or "").lower())
        assert r.words == len(words) and r.repeated == brute(words, 6)
        assert r.words_share == (r.repeated / r.words if r.words else 0.0)
    assert rp.repetition(df.limit(0), ["doc_id"], "text").collect() == []


def test_outliers(spark, rng):
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(120)) + ". " + " ".join(rng.choice(words) for _ in range(8 + i % 5)) * (1 + (i % 7 == 0)), "en", "x" if i % 2 else None) for i in range(400)]
    spam = [(1000 + i, "buy this now and again please friends. " * (20 + i), "en", "x") for i in range(20)]
    df = spark.createDataFrame([*rows, *spam, (2000, None, None, None)], "doc_id bigint, text string, lang string, source string")
    measured = rp.repetition(df, ["doc_id", "lang", "source"], "text")
    got = {r.doc_id: r for r in rp.outliers(measured, "doc_id", ["lang", "source"]).collect()}
    assert len(got) == 421
    assert all(got[1000 + i].outlier for i in range(20))
    assert sum(got[i].outlier for i in range(400)) < 60
    assert got[2000].outlier is False and got[2000].distance is None
    assert rp.outliers(measured.limit(0), "doc_id", ["lang", "source"]).collect() == []
