import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from notelattice import schemas
from notelattice.config import ReadOnlyError, Settings, load_env, load_settings
from notelattice.functions import models, noise
from notelattice.operators import bm25, counting, diff, fusion, graph, knn, skew
from notelattice.plans.indexing import index_directory
from notelattice.plans.searching import NoIndexError, search
from notelattice.session import scratch_path
from notelattice.sources.index_store import IndexStore
from notelattice.sources.markdown_dir import list_markdown, read_markdown
from notelattice.sources.versions import ConcurrentWriteError


def test_bm25(spark, monkeypatch):
    rows = spark.createDataFrame([("c1", "alpha beta beta"), ("c2", "gamma delta"), ("c3", None), ("c4", "the of")], "chunk_id string, text string")
    index = bm25.build_index(rows, "chunk_id", "text")
    q = spark.createDataFrame([(1, "alpha"), (2, "beta beta gamma"), (3, "the"), (4, None)], "query_id int, query string")
    got = {(r.query_id, r.chunk_id): r.score for r in bm25.search(q, "query_id", "query", index, 5).collect()}
    assert set(got) == {(1, "c1"), (2, "c1"), (2, "c2")}
    idf = np.log((4 - 1 + 0.5) / 1.5 + 1)
    tf = lambda n, length: n * 2.5 / (n + 1.5 * (0.25 + 0.75 * length / (5 / 4)))
    assert got[1, "c1"] == pytest.approx(idf * tf(1, 3)) and got[2, "c1"] == pytest.approx(2 * idf * tf(2, 3))
    sliced = sorted(map(tuple, bm25.search(q, "query_id", "query", index, 5).collect()))
    monkeypatch.setattr(bm25, "BROADCAST_TERMS", 1)  # a slice for about each row
    assert sorted(map(tuple, bm25.search(q, "query_id", "query", index, 5).collect())) == sliced
    empty = bm25.build_index(rows.limit(0), "chunk_id", "text")
    assert bm25.search(q, "query_id", "query", empty, 5).collect() == []


@pytest.mark.parametrize("block", [2048, 7])
def test_knn(spark, block):
    r = np.random.default_rng(1)
    x = r.integers(-2, 3, (60, 4)).astype(float)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None), (98, [1.0])], "k int, e array<double>")
    q = rows.filter("k % 20 = 0").select(F.col("k").alias("q"), F.col("e").alias("v"))
    got = knn.nearest(q, "q", "v", rows, "k", "e", 5, 4, block=block, slice_=4 if block == 7 else knn.SLICE).collect()
    norm = np.linalg.norm(x, axis=1)
    for i in (0, 20, 40):
        s = [(-round(float(x[i] @ x[j] / (norm[i] * norm[j])) if norm[i] * norm[j] else 0.0, 9) + 0.0, j) for j in range(60)] + [(0.0, 98)]
        assert [(g.k) for g in sorted((g for g in got if g.q == i), key=lambda g: g.rank)] == [j for _, j in sorted(s)[:5]]


def test_fusion(spark):
    lists = spark.createDataFrame(
        [(1, 0, "semantic", 0, "a", 1.0), (1, 0, "semantic", 1, "b", 1.0), (1, 1, "graph", 0, "b", 1.0), (1, 1, "graph", 1, "c", 1.0)], "q int, list_idx int, engine string, rank int, id string, weight double"
    )
    got = {r.id: (r.score, r.engines) for r in fusion.weighted_rrf(lists, "q", "id").collect()}
    assert got["b"] == (pytest.approx(1 / 62 + 1.5 / 61, abs=1e-8), ["semantic", "graph"]) and got["a"][0] == pytest.approx(1 / 61, abs=1e-8)
    scores = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0), (2, "x", 5.0)], "q int, id string, s double")
    assert {r.id: r.normalized for r in fusion.normalize(scores, ["q"], "s").collect()} == {"a": 1.0, "b": 0.0, "x": 1.0}
    fused = spark.createDataFrame([(1, f"i{n:02d}", 1.0 / (n + 1)) for n in range(25)], "q int, id string, score double")
    both = {r.id: r.blended for r in fusion.blend(fused, fusion.fallback_rerank(fused, "q", "id"), "q", "id").collect()}
    assert both["i00"] == pytest.approx(1.0) and both["i24"] == pytest.approx(0.4 / 25)


def sequential(seeds, edges, hops):
    """The score by its definition: seed after seed, each setting itself to 1 at the end."""
    score = {}
    for seed in seeds:
        frontier, visited = {seed}, set()
        for _ in range(hops):
            nxt = set()
            for node in frontier:
                if node in visited:
                    continue
                visited.add(node)
                for s, t, r, w in edges:
                    if node in (s, t):
                        other = t if node == s else s
                        nxt.add(other)
                        if other.startswith("section:"):
                            score[other] = score.get(other, 0.0) + w * (1.5 if r in ("LINKS_TO", "MENTIONS") else 1.0)
            frontier = nxt
        score[seed] = 1.0
    return score


@pytest.mark.parametrize("seed", range(3))
def test_graph_search(spark, seed):
    r = random.Random(seed)
    nodes = [f"section:s{i}" for i in range(6)] + [f"entity:concept:e{i}" for i in range(4)]
    edges = list({(r.choice(nodes), r.choice(nodes), r.choice(["LINKS_TO", "HAS_TAG"])): None for _ in range(14)})
    edges = [(*e, 0.5 + i) for i, e in enumerate(edges)]
    df = spark.createDataFrame(edges, "source_id string, target_id string, relation_type string, weight double")
    seeds = [(q, i, f"s{c}") for q in range(2) for i, c in enumerate(r.sample(range(6), 3))]
    got = graph.graph_search(spark.createDataFrame(seeds, "query_id int, ord int, chunk_id string"), df, 2).collect()
    for q in range(2):
        want = sequential([f"section:{c}" for x, _, c in seeds if x == q], edges, 2)
        assert {f"section:{g.chunk_id}": pytest.approx(g.score) for g in got if g.query_id == q} == want


def test_hot_keys_are_split(spark, monkeypatch):
    hub = [("hub", f"n{i}", 1) for i in range(300)] + [("cold", "x", 2)]
    right = spark.createDataFrame(hub, "node string, other string, v int")
    left = spark.createDataFrame([("hub", "a"), ("hub", "b"), ("cold", "a"), ("none", "c")], "node string, s string")
    got = sorted(map(tuple, skew.spread_join(left, right, "node", "other", split=40).select("s", "other", "v").collect()))
    assert got == sorted([(s, o, v) for n, s in (("hub", "a"), ("hub", "b"), ("cold", "a")) for m, o, v in hub if m == n])
    assert skew.spread_join(left, right.limit(0), "node", "other").collect() == []
    rows = spark.createDataFrame([(f"t{i % 5}", i) for i in range(50)] + [("odd", 1)], "term string, k int")
    corpus = spark.createDataFrame([(f"t{i}", 10 * i + 1) for i in range(5)], "term string, df bigint")
    for keys in (100_000, 2, 0):
        monkeypatch.setattr(skew, "HOT_KEYS", keys)
        out = skew.with_frequency(rows, corpus, 50).collect()
        assert sorted((r.k, r.term, r.df) for r in out if r.df) == sorted((i, f"t{i % 5}", 10 * (i % 5) + 1) for i in range(50)) and [r.k for r in out if r.df is None] == [1]
    order = skew.numbered(rows.repartition(3), ["term", "k"], "at").collect()
    assert [(r.term, r.k) for r in sorted(order, key=lambda r: r["at"])] == sorted((r.term, r.k) for r in rows.collect()) and sorted(r["at"] for r in order) == list(range(51))


def test_counting_of_grams(spark, monkeypatch):
    from collections import Counter

    r = random.Random(3)
    rows = [(i, None if i == 3 else [r.choice("abc") for _ in range(r.randint(0, 9))]) for i in range(40)] + [(0, ["a"])]
    df = spark.createDataFrame(rows, "k int, w array<string>").coalesce(1)
    for piece in (1_000_000, 10):
        monkeypatch.setattr(counting, "PIECE", piece)
        got = sorted((x.k, x.term, x.tf, x.first, x.len) for x in counting.count_terms(df, "k", F.col("w"), 3).collect())
        want = []
        for k, w in rows:
            w = w or []
            grams = [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
            want += [(k, t, n, grams.index(t), len(w)) for t, n in Counter(grams).items()]
        assert got == sorted(want)


def test_provenance(spark):
    e = "source_id string, target_id string, relation_type string"
    edges = spark.createDataFrame([("a", "b", "CO_OCCURS", 0.5), ("b", "c", "CO_OCCURS", 0.5), ("x", "y", "LINKS_TO", 1.0)], e + ", weight double")
    prov = spark.createDataFrame([("a", "b", "CO_OCCURS", "1"), ("b", "c", "CO_OCCURS", "1"), ("b", "c", "CO_OCCURS", "2")], e + ", chunk_id string")
    left, rest = graph.delete_by_chunks(edges, prov, spark.createDataFrame([("1",)], "chunk_id string"))
    assert sorted(r.source_id for r in left.collect()) == ["b", "x"] and rest.count() == 1


def test_diff(spark):
    s = "file_path string, checksum string"
    cur = spark.createDataFrame([("a", "1"), ("b", "9"), ("new", "3"), ("n", None), (None, "z")], s)
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("was", "3"), ("gone", "4"), ("n", None)], s)
    got = {r.file_path: r.status for r in diff.file_diff(cur, old).collect()}
    assert got == {"a": "unchanged", "b": "changed", "new": "new", "was": "moved", "gone": "deleted", "n": "unchanged"}
    assert [tuple(r) for r in diff.moves(cur, old).collect()] == [("was", "new")]


def test_walk_of_a_tree(spark, tmp_path):
    for name in ("keep.md", "draft.md", "evidence/raw.md", "b/UP.MD", "b/no.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("# T\nx")
    os.symlink(tmp_path / "keep.md", tmp_path / "link.md")
    os.symlink(tmp_path, tmp_path / "b" / "loop")
    os.symlink("/etc", tmp_path / "outside")
    found = [os.path.relpath(p, tmp_path) for p in list_markdown(str(tmp_path), ["draft.md", "evidence/**"])]
    assert found == ["b/UP.MD", "keep.md"]
    rows = read_markdown(spark, str(tmp_path), ["draft.md"]).orderBy("file_path").collect()
    assert [r.title for r in rows] == ["T", "T", "T"] and rows[0].size_bytes == 5 and len(rows[0].checksum) == 32
    assert read_markdown(spark, str(tmp_path / "missing")).collect() == []


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_names_of_any_kind(spark, tmp_path, scheme):
    root = tmp_path / "va[u]lt {x}"
    names = ["[draft] b.md", "{x}.md", "a*?.md", "b c%20d.md", "back\\slash.md", "#h.md", "é.md", "[y]/z.MD", "out/o.md", *([] if scheme else ["q:r.md"])]
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"# T {name}")
    (root / "bytes.md").write_bytes(b"\xff\xfe")
    rows = {r.file_path: r for r in read_markdown(spark, f"{scheme}{root}", ["out/**"]).collect()}
    assert set(rows) == {f"{root}/{n}" for n in names if n != "out/o.md"} | {f"{root}/bytes.md"}
    assert all(r.title == f"T {p[len(str(root)) + 1:]}" for p, r in rows.items() if not p.endswith("bytes.md"))
    assert set(rows[f"{root}/bytes.md"].content) == {"\ufffd"} and len(rows[f"{root}/bytes.md"].checksum) == 32


def test_a_file_that_vanishes(spark, tmp_path, monkeypatch):
    from notelattice.sources import markdown_dir

    write(tmp_path, a="# A", b="# B")
    listed = markdown_dir.list_markdown(str(tmp_path))
    monkeypatch.setattr(markdown_dir, "list_markdown", lambda *_: [*listed, f"{tmp_path}/gone.md"])
    assert [r.title for r in read_markdown(spark, str(tmp_path)).orderBy("title").collect()] == ["A", "B"]


def write(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.md").write_text(text)


def test_index_and_search(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    write(docs, a="---\nauthor: Ann\n---\n# Alpha\nThe Vector Search Engine (VSE) ranks chunks. See [[Beta]] and #tagged.\n## Child\nMore words on ranking.", b="# Beta\nGraph walks visit neighbours of chunks.")
    store = IndexStore(spark, scratch_path(spark, "ix"), Settings(embedding_dim=32, semantic_floor=0.0))
    with pytest.raises(NoIndexError):
        search(store, spark.createDataFrame([(1, "x")], "query_id int, query string"))
    people = lambda texts: [[("PER", "Alice"), ("XX", "Thing")] if "walks" in t else [] for t in texts]
    phases = []
    first = index_directory(spark, store, str(docs), recogniser=people, progress=phases.append)
    assert first.files_processed == 2 and first.chunks_created == 4 and phases[0] == "discovering"
    nodes = {r.node_id for r in store.read("nodes").collect()}
    assert {"tag:tagged", "entity:concept:Beta", "entity:person:Alice", "entity:metadata:author: Ann", f"file:{docs}/a.md"} <= nodes
    kinds = {r.relation_type for r in store.read("edges").collect()}
    assert {"CONTAINS", "HAS_TAG", "LINKS_TO", "MENTIONS", "CO_OCCURS", "PARENT_OF", "HAS_FRONTMATTER"} == kinds
    assert [r.acronym for r in store.read("acronyms").collect()] == ["VSE"]
    q = spark.createDataFrame([(1, "graph neighbours"), (2, "vse")], "query_id int, query string")
    for mode in ("semantic", "bm25", "graph", "hybrid"):
        rows = search(store, q, mode=mode, top_k=3).orderBy("query_id", "place").collect()
        assert rows and len({(r.query_id, r.chunk_id) for r in rows}) == len(rows)
        if mode != "semantic":
            assert rows[0].file_path.endswith("b.md")
    plain = search(store, q, mode="bm25", rerank=False).filter("query_id = 2").collect()
    assert plain and "VSE" in plain[0].snippet and plain[0].matched_engines == ["bm25"]
    high = lambda qs, ts: [1.0 if "Child" in t else 0.0 for t in ts]
    assert search(store, q, mode="hybrid", reranker=high).filter("place = 0").first().heading_path.endswith("Child")
    # nothing changed, then a rename and a change
    assert index_directory(spark, store, str(docs)).files_processed == 0
    (docs / "b.md").rename(docs / "b2.md")
    assert index_directory(spark, store, str(docs)).files_processed == 1
    assert sorted(os.path.basename(r.file_path) for r in store.read("files").collect()) == ["a.md", "b2.md"]
    assert store.read("chunks").filter("file_path like '%/b.md'").count() == 0
    assert store.read("vectors").join(store.read("chunks"), "chunk_id", "left_anti").count() == 0
    stats = store.statistics().first()
    assert stats.total_files == 2 and stats.total_chunks == 4 and store.vector_stats()["dimension"] == 32
    locked = IndexStore(spark, store.root, Settings(read_only=True))
    with pytest.raises(ReadOnlyError):
        locked.clear()
    store.clear()
    assert store.statistics().first().total_files == 0


def test_models(spark):
    df = spark.createDataFrame([("a", "some words"), ("b", "")], "k string, t string")
    got = {r.k: r.e for r in df.select("k", models.embed(F.col("t"), models.hashing_embedder(8)).alias("e")).collect()}
    assert got["b"] is None and np.linalg.norm(got["a"]) == pytest.approx(1, abs=1e-6)

    def broken(_):
        raise ValueError

    assert models.named_entities(df, "k", "t", broken, ("person",)).collect() == []
    assert models.named_entities(df, "k", "t", None, ("person",)).collect() == []


def test_hooks_and_noise_files(tmp_path):
    model = lambda texts: [[1.0]] * len(texts)
    models.set_hook("embedder", model)
    assert models.get_hook("embedder") is model and models.get_hook("reranker") is None
    models.reset_hooks()
    assert models.get_hook("embedder") is None
    with pytest.raises(ValueError):
        models.set_hook("other", model)
    (tmp_path / "stop").write_text("der die\ndas")
    got = noise.of_settings(f"{tmp_path}/stop")
    assert got.stop == ("das", "der", "die") and got.upper == ("DAS", "DER", "DIE") and noise.of_settings("") is noise.DEFAULT


def test_settings(tmp_path):
    got = load_settings({"NOTELATTICE_DEFAULT_TOP_K": "7x", "NOTELATTICE_FUSION_K": "no", "NOTELATTICE_READ_ONLY": "TRUE", "NOTELATTICE_SEMANTIC_FLOOR": "0.25", "NOTELATTICE_NER_ENTITY_TYPES": "a, b"})
    assert (got.default_top_k, got.fusion_k, got.read_only, got.semantic_floor, got.ner_entity_types) == (7, 60, True, 0.25, ("a", "b"))
    (tmp_path / ".env").write_text("# c\nA='x y'\nexport B=2 # note\nC=3\n")
    assert load_env(str(tmp_path / ".env"), {"C": "kept"}) == {"A": "x y", "B": "2", "C": "kept"}


def contents(store):
    """All tables but the times of a run."""
    drop = {"files": "last_modified", "stats": "last_indexed"}
    return {t: sorted(map(str, store.read(t).drop(drop.get(t, "")).collect())) for t in schemas.TABLES}


def test_a_run_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    docs = tmp_path / "docs"
    docs.mkdir()
    write(docs, a="# Alpha\nOne [[Beta]] #tag.", b="# Beta\nTwo words.")
    settings = Settings(embedding_dim=8)
    store, smooth = (IndexStore(spark, scratch_path(spark, n), settings) for n in ("ix", "ix"))
    for s in (store, smooth):
        index_directory(spark, s, str(docs))
    before = contents(store)
    write(docs, a="# Alpha\nChanged [[Gamma]] text.", c="# New\nThree.")
    (docs / "b.md").unlink()
    replace = IndexStore.replace
    for at in (2, 11):
        calls = []

        def dying(self, table, rows):
            calls.append(table)
            if len(calls) == at:
                raise OSError("lost")
            replace(self, table, rows)

        monkeypatch.setattr(IndexStore, "replace", dying)
        with pytest.raises(OSError):
            index_directory(spark, store, str(docs))
        assert len(calls) == at
        monkeypatch.setattr(IndexStore, "replace", replace)
        assert contents(IndexStore(spark, store.root, settings)) == before
    # another writer commits while this run works
    with pytest.raises(ConcurrentWriteError), store.transaction():
        store.replace("chunks", store.read("chunks").limit(0))
        IndexStore(spark, store.root, settings).replace("stats", smooth.read("stats"))
    assert store.read("chunks").count() == len(before["chunks"])
    for s in (store, smooth):
        assert index_directory(spark, s, str(docs)).files_processed == 2
    assert contents(store) == contents(smooth) != before


def test_unreadable_tables(spark, tmp_path):
    store = IndexStore(spark, scratch_path(spark, "ix"), Settings(embedding_dim=8))
    store.replace("chunks", spark.createDataFrame([("c", "/a.md", ["H"], 1, "alpha beta", 0, 0)], schemas.CHUNKS))
    q = spark.createDataFrame([(1, "alpha")], "query_id int, query string")
    assert search(store, q, mode="bm25").count() == 1  # built and stored
    store.replace("acronyms", spark.createDataFrame([("AB", "Alpha Beta", 0)], schemas.ACRONYMS))
    for table in ("postings", "acronyms"):
        folder = store._folder(table).removeprefix("file://")
        for name in os.listdir(folder):
            if name.endswith(".parquet"):
                open(f"{folder}/{name}", "wb").write(b"not parquet")
                if os.path.exists(f"{folder}/.{name}.crc"):
                    os.remove(f"{folder}/.{name}.crc")
    assert not store.readable("postings") and search(store, q, mode="bm25").count() == 1 and store.readable("postings")
    assert store.get_chunk("c")["text"] == "alpha beta" and store.get_chunk("x") is None and store.get_chunks(["c", "x"]).count() == 1
    assert store.get_file("/a.md") is None and [r.chunk_id for r in store.chunk_ids_of("/a.md").collect()] == ["c"]
    assert [tuple(r) for r in store.chunk_ids_by_file().collect()] == [("/a.md", ["c"])]


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    from notelattice import cli, config

    docs = tmp_path / "docs"
    docs.mkdir()
    write(docs, a="# Alpha\nGraph walks visit neighbours.")
    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("NOTELATTICE_INDEX_DIR", f"{tmp_path}/index")
    monkeypatch.setenv("NOTELATTICE_EMBEDDING_DIM", "8")
    config.reset_settings()
    try:
        assert cli.main(["index", str(docs), "--extract-depth", "structural"]) == 0
        assert "files_processed=1" in capsys.readouterr().out
        assert cli.main(["search", "graph walks", "--mode", "bm25", "--top", "1"]) == 0
        assert "Alpha" in capsys.readouterr().out
        assert cli.main(["status"]) == 0 and "'total_files': 1" in capsys.readouterr().out
        assert cli.main(["clear"]) == 0 and cli.main(["status"]) == 0 and "'total_files': 0" in capsys.readouterr().out
    finally:
        config.reset_settings()
