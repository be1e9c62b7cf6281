import math
import re
from collections import Counter, defaultdict

import pytest

from notelattice.llm import distinctive, frequency, records, together
from notelattice.operators import skew


def docs_of(rows):
    out = {}
    for k, t in rows:
        if k is not None and t is not None:
            out[k] = max(out.get(k, ""), t)
    return out


@pytest.fixture(scope="module")
def rows(rng, long_text):
    words = [f"w{i}" for i in range(400)] + ["the", "The", "a_b", "x9"]
    out = [(f"c{i}", " ".join(rng.choice(words[: 5 + i * 2]) for _ in range(rng.randint(0, 40))) + rng.choice(["", " the", "\r\nÉté the"])) for i in range(150)]
    return out + out[:20] + [("n", None), ("e", ""), ("big", long_text), (None, "lost words"), ("c3", None)]


def brute(rows):
    count, df = Counter(), Counter()
    docs = docs_of(rows)
    for t in docs.values():
        terms = re.findall(r"[a-z0-9_]+", t.lower())
        count.update(terms)
        df.update(set(terms))
    return docs, count, df


def test_frequencies(spark, rows, monkeypatch):
    docs, count, df = brute(rows)
    table = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "chunk_id string, text string, count int, term string").repartition(6)
    got = {r.term: r for r in frequency.term_frequencies(table, "chunk_id", "text").collect()}
    assert {t: (r["count"], r.document_count) for t, r in got.items()} == {t: (count[t], df[t]) for t in count}
    for t, r in got.items():
        assert r["mark"] == ("rare" if df[t] <= 2 else "common" if 2 * df[t] > len(docs) else None)


def test_frequencies_over_many_ranges(spark, rows, monkeypatch):
    monkeypatch.setattr(frequency, "RANGE_LEAST", 20)
    monkeypatch.setattr(frequency, "RANGE_MOST", 30)
    _, count, df = brute(rows)
    table = spark.createDataFrame(rows, "chunk_id string, text string").repartition(5)
    got = frequency.term_frequencies(table, "chunk_id", "text").collect()
    assert len(got) == len(count)
    assert {r.term: (r["count"], r.document_count) for r in got} == {t: (count[t], df[t]) for t in count}


@pytest.mark.parametrize("most", [200_000, 0])
def test_one_text_of_each_key(spark, rows, monkeypatch, most):
    monkeypatch.setattr(records, "REPEATED", most)
    table = spark.createDataFrame([(k, t, 1) for k, t in rows], "chunk_id string, text string, k int")
    got = [(r.k, r.t) for r in records.texts(table, "chunk_id", "text").collect()]
    assert len(got) == len(dict(got)) and dict(got) == docs_of(rows)


def test_trie_bursts():
    trie = frequency.BurstTrie(burst=3)
    terms = [f"prefix{i}" for i in range(50)] + ["prefix", "p", "", "zeta"]
    for t in terms * 2:
        trie.add(t, 2, 1)
    got = {p + s: (c, r) for p, ss, cs, rs in trie.rows() for s, c, r in zip(ss, cs, rs)}
    assert got == {t: (4, 2) for t in terms}
    assert trie.size == len(terms) and len(trie.inner) > 3


def test_empty(spark):
    none = spark.createDataFrame([], "chunk_id string, text string")
    assert frequency.term_frequencies(none, "chunk_id", "text").collect() == []
    assert distinctive.top_terms(distinctive.term_scores(none, "chunk_id", "text"), "chunk_id", 3).collect() == []
    pairs, marginals, total = together.tie_gram(spark.createDataFrame([], "c string, a string, b string"), "c", "a", "b")
    assert together.with_lift(pairs, marginals, total).collect() == []
    assert together.gram_matrix(spark.createDataFrame([], "r string, i string"), "r", "i").collect() == []


@pytest.mark.parametrize("hot_keys", [100_000, 3, 0])
def test_distinctive(spark, rows, monkeypatch, hot_keys):
    monkeypatch.setattr(skew, "HOT_KEYS", hot_keys)
    docs, _, df = brute(rows)
    n = len(docs)
    want = {}
    for k, t in docs.items():
        tf = Counter(re.findall(r"[a-z0-9_]+", t.lower()))
        score = {x: round(c * math.log((n - df[x] + 0.5) / (df[x] + 0.5) + 1), 6) for x, c in tf.items()}
        want[k] = sorted(score, key=lambda x: (-score[x], x))[:3]
    table = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "chunk_id string, text string, tf int, k int")
    found = distinctive.top_terms(distinctive.term_scores(table, "chunk_id", "text", length_norm=False), "chunk_id", 3, 6)
    got = defaultdict(list)
    for r in found.orderBy("chunk_id", "place").collect():
        got[r.chunk_id].append(r.term)
    assert dict(got) == {k: v for k, v in want.items() if v}


def gram(rows):
    baskets = defaultdict(set)
    for r, i in rows:
        if r is not None and i is not None:
            baskets[r].add(i)
    out = Counter()
    for b in baskets.values():
        b = sorted(b)
        out.update((x, y) for j, x in enumerate(b) for y in b[j + 1 :])
    return out


@pytest.mark.parametrize("wide", [512, 4])
def test_gram(spark, rng, wide, monkeypatch):
    monkeypatch.setattr(together, "WIDE", wide)
    rows = [(rng.choice([*range(40), 0, 0, 0]), f"i{rng.randint(0, 60)}") for _ in range(900)]
    rows += rows[:50] + [(None, "x"), (1, None)]
    df = spark.createDataFrame([(r, i, "q", 1) for r, i in rows], "rec int, item string, left string, r int")
    got = together.gram_matrix(df, "rec", "item").collect()
    assert {(r.a, r.b): r.n_ab for r in got} == dict(gram(rows))


@pytest.mark.parametrize("wide", [512, 8])
def test_ties(spark, rng, wide, monkeypatch):
    monkeypatch.setattr(together, "WIDE", wide)
    rows = [(rng.choice([None, *range(15), 0, 0, 0]), f"n{rng.randint(0, 9)}", rng.choice([None, *[f"n{i}" for i in range(9)]])) for _ in range(600)]
    rows += [(c, x, y) for c in (20, 21, 22) for x in ("n1", "n2", "n3", "n4") for y in ("n1", "n2", "n3", "n4")]  # all pairs tied
    clean = {(c, min(a, b), max(a, b)) for c, a, b in rows if c is not None and b is not None and a != b}
    n_ab = Counter((a, b) for _, a, b in clean)
    n = Counter(i for i, _ in {(x, c) for c, a, b in clean for x in (a, b)})
    m = len({c for c, _, _ in clean})
    df = spark.createDataFrame(rows, "c int, x string, y string")
    out = together.with_lift(*together.tie_gram(df, "c", "x", "y")).collect()
    assert {(r.a, r.b): (r.n_ab, r.n_a, r.n_b, r.m) for r in out} == {(a, b): (v, n[a], n[b], m) for (a, b), v in n_ab.items()}
    for r in out:
        assert math.isclose(r.lift, r.n_ab * m / r.n_a / r.n_b)
