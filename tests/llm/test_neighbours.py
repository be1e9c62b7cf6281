from datetime import datetime

import numpy as np
import pytest

from notelattice.llm import neighbours as nb

DIM = 24


@pytest.fixture(scope="module")
def data():
    r = np.random.default_rng(2)
    centres = r.normal(size=(60, DIM))
    rows = []
    for i in range(900):
        v = centres[i % 60] + r.normal(size=DIM) * 0.25
        rows.append((f"k{i:04d}", (v * r.uniform(0.1, 9)).astype(np.float32).tolist(), datetime(2024, 1, 2)))
    copies = rows[0][1]
    rows += [(f"copy{i:02d}", copies, None) for i in range(30)]  # more than k equal embeddings
    bad = [("nan", [float("nan")] * DIM), ("inf", [float("inf")] * DIM), ("zero", [0.0] * DIM), ("short", [1.0]), ("none", None), ("empty", []), ("holes", [None] * DIM), (None, copies)]
    return rows, rows[:50] + [("k0001", r.normal(size=DIM).astype(np.float32).tolist(), datetime(2023, 1, 1)), *[(k, e, datetime(2025, 1, 1)) for k, e in bad]]


def brute(rows, k):
    names = [r[0] for r in rows]
    x = np.array([r[1] for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 12)
    return {n: sorted((-s[i, j], names[j]) for j in range(len(names)) if j != i)[:k] for i, n in enumerate(names)}


@pytest.mark.parametrize("surplus", [200_000, 0])
def test_recall_and_copies(spark, data, monkeypatch, surplus):
    monkeypatch.setattr(nb, "COPIES", surplus)
    rows, dirty = data
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + dirty], "chunk_id string, embedding array<float>, embedded_at timestamp, h string, cell int")
    out = nb.nearest_neighbours(df, "chunk_id", "embedding", "embedded_at", DIM, 5)
    got = {}
    for r in out.collect():
        assert r.chunk_id != r.neighbour
        got.setdefault(r.chunk_id, set()).add(r.neighbour)
    want = brute(rows, 5)
    assert set(got) == set(want) and all(len(v) <= 5 for v in got.values())
    hits = sum(len(got[n] & {b for _, b in near}) for n, near in want.items())
    assert hits >= 0.95 * sum(map(len, want.values()))
    equal = {r[0] for r in rows if r[1] == rows[0][1]}
    for n in equal:  # ties of copies go to the smaller keys
        assert got[n] == set(sorted(equal - {n})[:5])


def test_pairs(spark, data):
    rows, _ = data
    df = spark.createDataFrame(rows, "chunk_id string, embedding array<float>, embedded_at timestamp")
    pairs = nb.similar_pairs(nb.nearest_neighbours(df, "chunk_id", "embedding", "embedded_at", DIM, 5), "chunk_id", 0.65).collect()
    assert all(r.a < r.b for r in pairs) and len({(r.a, r.b) for r in pairs}) == len(pairs)
    want = {tuple(sorted((n, b))) for n, near in brute(rows, 5).items() for s, b in near if -s >= 0.65}
    assert len(want & {(r.a, r.b) for r in pairs}) >= 0.95 * len(want)


def test_two_levels_and_tables():
    r = np.random.default_rng(4)
    x = r.normal(size=(4000, DIM)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = nb.Quantiser(x, 400, parts=6, words=16)
    assert q.top is not None
    row, cell = q.file(x, 3, 0.05)
    best = np.argmax(x @ q.centroids.T, axis=1)
    home = {}
    for i, c in zip(row.tolist(), cell.tolist()):
        home.setdefault(i, set()).add(c)
    assert len(home) == len(x) and np.mean([best[i] in home[i] for i in range(len(x))]) > 0.9
    # a table product is the inner product with the decoded vector
    own = x[:50]
    codes = q.codes(own - q.centroids[7])
    decoded = np.concatenate([book[codes[:, p]] for p, book in enumerate(q.books)], axis=1) + q.centroids[7]
    exact = x[:50].astype(np.float64) @ x[:50].astype(np.float64).T
    np.fill_diagonal(exact, -9)
    for at, found, cosine in q.search(own, 7, 49, 5):
        np.testing.assert_allclose(np.sort(exact[at : at + len(found)], axis=1)[:, ::-1][:, :5], cosine, atol=1e-6)
    assert np.abs((own @ decoded.T) - own @ own.T).mean() < 0.2


@pytest.mark.parametrize("n", [0, 1, 2])
def test_tiny(spark, n):
    df = spark.createDataFrame([(f"k{i}", [1.0 + i, 2.0, 3.0], None) for i in range(n)], "chunk_id string, embedding array<float>, embedded_at timestamp")
    assert nb.nearest_neighbours(df, "chunk_id", "embedding", "embedded_at", 3, 5).count() == (2 if n == 2 else 0)


@pytest.mark.parametrize("crowd", [8192, 150])
def test_crowded_cells_are_cut_again(spark, monkeypatch, crowd):
    """Recall of the true five nearest, with cells of their own and cut once more."""
    monkeypatch.setattr(nb, "CROWD", crowd)
    monkeypatch.setattr(nb, "FINE", 64)
    monkeypatch.setattr(nb, "CELL", 512)
    r = np.random.default_rng(9)
    centres = r.normal(size=(200, DIM))
    x = (centres[r.integers(0, 200, 4000)] + r.normal(size=(4000, DIM)) * 0.2).astype(np.float32)
    names = [f"k{i:04d}" for i in range(len(x))]
    df = spark.createDataFrame([(n, v.tolist(), None) for n, v in zip(names, x)], "chunk_id string, embedding array<float>, embedded_at timestamp")
    got = {}
    for row in nb.nearest_neighbours(df, "chunk_id", "embedding", "embedded_at", DIM, 5).collect():
        got.setdefault(row.chunk_id, set()).add(row.neighbour)
    assert all(len(v) == 5 for v in got.values())
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -9)
    best = np.argsort(-s, axis=1)[:, :5]
    hits = sum(len(got[n] & {names[j] for j in best[i]}) for i, n in enumerate(names))
    print("recall", hits / (5 * len(x)))
    assert hits >= 0.97 * 5 * len(x)
