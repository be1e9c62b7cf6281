"""What leaves the tasks: rows that grow with queries times chunks must not."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from notelattice import schemas
from notelattice.config import Settings
from notelattice.operators import bm25, fusion, graph, knn
from notelattice.plans.searching import search
from notelattice.session import scratch_path
from notelattice.sources.index_store import IndexStore


def shuffled(spark, action):
    """Result of an action, and the rows that it shuffled."""
    sc = spark.sparkContext._jsc.sc()

    def rows():
        sc.listenerBus().waitUntilEmpty(30_000)
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), spark.sparkContext._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = rows()
    return action(), rows() - before


@pytest.mark.parametrize("block", [32_768, 7])
def test_bm25_hands_on_only_the_best(spark, monkeypatch, block):
    monkeypatch.setattr(bm25, "BLOCK", block)
    r = random.Random(1)
    texts = {f"c{i:03}": "hot " * r.randint(1, 3) + " ".join(r.choices(["wax", "yew", "zinc"], k=3)) for i in range(200)}
    asked = {i: r.choice(["hot", "hot hot wax", "hot yew zinc", "hot wax yew zinc"]) for i in range(100)}
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id string, text string")
    queries = spark.createDataFrame(list(asked.items()), "query_id int, query string")
    index = bm25.build_index(chunks, "chunk_id", "text")
    found, rows = shuffled(spark, lambda: bm25.search(queries, "query_id", "query", index, 3).collect())
    assert rows < 5_000  # of 20,000 pairs
    idf = {x.term: x.idf for x in index.idf.collect()}
    mean = sum(len(t.split()) for t in texts.values()) / len(texts)
    want = {}
    for q, query in asked.items():
        scores = []
        for c, text in texts.items():
            w = text.split()
            gain = {t: w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / mean)) for t in set(w)}
            scores.append((-round(sum(idf[t] * gain.get(t, 0) for t in query.split()), 9), c))
        want |= {(q, c): (i, -s) for i, (s, c) in enumerate(sorted(scores)[:3])}
    assert {(x.query_id, x.chunk_id) for x in found} == set(want) and len(found) == 300
    assert all(x["rank"] == want[x.query_id, x.chunk_id][0] and x.score == pytest.approx(want[x.query_id, x.chunk_id][1]) for x in found)
    every = bm25.search(queries.filter("query_id = 0"), "query_id", "query", index, None)
    assert every.count() == 200 and sorted(x["rank"] for x in every.collect()) == list(range(200))


def test_bm25_index_keeps_a_row_for_each_chunk(spark):
    rows = spark.createDataFrame([("a", "wax wax yew"), ("b", None), ("c", "")], "chunk_id string, text string")
    index = bm25.build_index(rows, "chunk_id", "text")
    assert sorted(map(tuple, index.postings.collect())) == [("wax", "a", 2), ("yew", "a", 1)]
    assert sorted(map(tuple, index.lengths.collect())) == [("a", 3), ("b", 0), ("c", 0)]
    assert index.packed.select(F.size("terms").alias("n")).agg(F.sum("n")).first()[0] == 2


@pytest.mark.parametrize("hops", [1, 2])
def test_graph_search_hands_on_only_what_counts(spark, hops):
    r = random.Random(2)
    edges = [(f"section:c{i:03}", f"tag:t{i % 2}", "HAS_TAG", None if i % 7 == 0 else r.choice([0.5, 1.0])) for i in range(200)]
    edges += [(f"section:c{i:03}", f"section:c{(i * 3 + 1) % 200:03}", "LINKS_TO", 1.0) for i in range(50)]
    edges = spark.createDataFrame(edges, "source_id string, target_id string, relation_type string, weight double")
    seeds = spark.createDataFrame([(q, o, f"c{(q * 5 + o * 11) % 210:03}") for q in range(20) for o in range(3)], "query_id int, ord int, chunk_id string")
    known = spark.createDataFrame([(f"c{i:03}",) for i in range(100, 150)], "chunk_id string")
    wanted = spark.createDataFrame([(1, "c007"), (2, "c199"), (3, "none")], "query_id int, chunk_id string")
    every = {}
    for x in fusion.ranks(graph.graph_search(seeds, edges, hops), ["query_id"], "score", "chunk_id").collect():
        every.setdefault(x.query_id, []).append((x["rank"], x.chunk_id, x.score))
    found, rows = shuffled(spark, lambda: graph.graph_ranked(seeds, edges, hops, wanted, known, 4, lambda rank: 1.5 / (61 + rank)).collect())
    assert rows < 3_000
    got = {(x.query_id, x["rank"], x.chunk_id): (x.score, x.lo, x.hi) for x in found}
    want = {}
    for q, own in every.items():
        scores = [s for _, _, s in own if s is not None]
        there = [x for x in sorted(own) if "c100" <= x[1] < "c150"][:4]
        also = [x for x in own if (q, x[1]) in {(1, "c007"), (2, "c199")}]
        want |= {(q, at, c): (s, min(scores), max(scores)) for at, c, s in [*sorted(own)[:4], *there, *also]}
    assert got == want


def test_queries_of_equal_seeds_share_a_ranking():
    class Sent:  # two nodes that visit four and two of eight sections
        value = (np.array([0, 4, 6]), np.array([0, 2, 4, 6, 1, 2]), np.ones(6), None, np.ones(8, dtype=bool))

    made = []

    def value(rank):
        made.append(len(rank))
        return 1.0 / (61 + rank)

    # rows (kind, ord, n): nodes visited, seeds, codes wanted
    lists = [[(0, 0, 0), (1, 0, 2), (2, 0, 6)], [(0, 0, 1), (1, 0, 2)], [(0, 0, 0), (1, 0, 2), (2, 0, 0), (2, 0, 5)]]
    columns = [pa.array([[x[i] for x in own] for own in lists], pa.list_(pa.int32())) for i in range(3)]
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8, 9]), *columns], names=["query_id", "kind", "ord", "n"])
    rows = [tuple(x.values()) for x in next(graph._ranker(Sent, 1, value)(iter([batch]))).to_pylist()]
    assert sorted(rows) == [(7, 0, 1.0, 0, 1.0, 1.0), (7, 6, 1.0, 3, 1.0, 1.0), (8, 1, 1.0, 0, 1.0, 1.0), (9, 0, 1.0, 0, 1.0, 1.0)]
    assert sorted(made) == [2, 4]


def test_search_of_an_index_with_postings_by_term(spark, monkeypatch):
    store = IndexStore(spark, scratch_path(spark, "ix"), Settings(embedding_dim=8))
    store.replace("chunks", spark.createDataFrame([(f"c{i}", "/a.md", ["H"], 1, "wax " * (i + 1), i, 0) for i in range(3)], schemas.CHUNKS))
    with monkeypatch.context() as m:
        m.setitem(schemas.TABLES, "postings", "term string, chunk_id string, tf bigint")
        store.replace("postings", spark.createDataFrame([("wax", "c0", 1)], schemas.TABLES["postings"]))
        store.replace("idf", spark.createDataFrame([("wax", 1, 1.0)], schemas.IDF))
    assert not store.readable("postings")
    q = spark.createDataFrame([(1, "wax")], "query_id int, query string")
    assert search(store, q, mode="bm25").count() == 3 and store.readable("postings")


@pytest.mark.parametrize("block", [knn.BLOCK, 50])
def test_nearest_hands_on_only_the_best_of_each_vector(spark, monkeypatch, block):
    monkeypatch.setattr(knn, "CANDIDATES", 300)
    monkeypatch.setattr(knn, "PRODUCT", 7 * block)
    r = random.Random(3)
    # few directions, so that most places are ties
    table = [(f"c{i:04}", r.choice([[1.0, 0.0, 0.5], [0.5, 1.0, 0.0], [0.0, 0.5, 1.0], [r.random(), r.random(), 0.1]])) for i in range(1200)]
    vectors = [[r.random() - 0.3, r.random() - 0.3, r.random()] for _ in range(20)] + [[1.0, 0.0, 0.5], [0.0, 0.0, 0.0]]
    asked = [(i, vectors[i % 22]) for i in range(220)]
    rows = spark.createDataFrame(table, "k string, e array<float>").repartition(16)
    queries = spark.createDataFrame(asked, "q bigint, v array<double>")
    found, sent = shuffled(spark, lambda: knn.nearest(queries, "q", "v", rows, "k", "e", 5, 3, block=block).collect())
    assert sent < 3_000  # of 17,600 that 16 tasks would hand on for 220 queries
    e = np.array([v for _, v in table], dtype=np.float32).astype(np.float64)
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    want = {}
    for q, v in asked:
        s = np.round(e @ (np.array(v) / (np.linalg.norm(v) or 1)), 9)
        want |= {(q, k): (i, -c) for i, (c, k) in enumerate(sorted(zip((-s).tolist(), [k for k, _ in table]))[:5])}
    assert {(x.q, x.k): x["rank"] for x in found} == {k: i for k, (i, _) in want.items()} and len(found) == 1100
    assert all(x.cosine == pytest.approx(want[x.q, x.k][1], abs=2e-9) for x in found)
