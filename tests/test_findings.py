from datetime import datetime

from pyspark.sql import functions as F

from notelattice.functions import models
from notelattice.plans.queries import QUERIES


def test_acronyms_of_captured_texts(spark, tmp_path):
    docs = "doc_id bigint, text string, file_path string"
    spark.createDataFrame([(1, "The Query Seed Expansion (QSE) is used.", "/a.md"), (2, None, "/b.md"), (20, "# On qse", "/c.md")], docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("c", "See RRT (Ranked Result Table) here.")] * 2, "chunk_id string, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    rows = QUERIES["acronyms"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, rows)) == [("chunk:c", "RRT", "Ranked Result Table"), ("document:1", "QSE", "The Query Seed Expansion")]
    assert {r.acronym for r in QUERIES["acronym_dict"](spark, str(tmp_path)).collect()} == {"QSE", "RRT"}
    expanded = [r.expanded for r in QUERIES["expand_query"](spark, str(tmp_path)).collect()]
    assert any("qse The Query Seed Expansion" in e for e in expanded) and "On qse The Query Seed Expansion" in expanded


def test_neighbours_of_every_seed(spark, tmp_path):
    scores = [(20, f"c{i}", 1.0 - i / 20, None, None) for i in range(12)]
    spark.createDataFrame(scores, "query_id bigint, chunk_id string, semantic_score double, bm25_score double, graph_score double").write.parquet(f"{tmp_path}/search_results.parquet")
    edges = [(i, f"section:c{i}", f"tag:t{i}", "HAS_TAG", 1.0) for i in range(12)]
    spark.createDataFrame(edges, "edge_id bigint, source_id string, target_id string, relation_type string, weight double").write.parquet(f"{tmp_path}/edges.parquet")
    for hops in (1, 2):
        rows = QUERIES[f"neighbors_{hops}hop"](spark, str(tmp_path)).collect()
        assert {r.seed for r in rows} == {f"section:c{i}" for i in range(10)}


def test_every_pair_of_scans(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [(1, "a", at, "1"), (2, "a", at, "2"), (2, "b", at, "3"), (7, "c", at, "3"), (7, "a", at, "2")]
    spark.createDataFrame(rows, "scan_id int, file_path string, last_modified timestamp, checksum string").write.parquet(f"{tmp_path}/files.parquet")
    got = lambda name: sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect()))
    assert got("file_diff") == [(2, "a", "changed"), (2, "b", "new"), (7, "a", "unchanged"), (7, "b", "moved"), (7, "c", "new")]
    assert got("moved_files") == [(7, "b", "c")]
    assert got("removed_paths") == [(2, "a"), (7, "b")]


def test_a_failing_text_loses_only_itself(spark):
    def people(texts):
        if "bad" in texts:
            raise ValueError
        return [[("PER", t)] for t in texts]

    df = spark.createDataFrame([("a", "Ann"), ("b", "bad"), ("c", "Cy")], "k string, t string").coalesce(1)
    got = models.named_entities(df, "k", "t", people, ("person",)).collect()
    assert sorted((r.k, r.name) for r in got) == [("a", "Ann"), ("c", "Cy")]

    def score(queries, texts):
        if "bad" in texts:
            raise ValueError
        return [1.0] * len(texts)

    rows = df.select("k", models.rerank_scores(F.lit("q"), F.col("t"), score).alias("s")).collect()
    assert {r.k: r.s for r in rows} == {"a": 1.0, "b": None, "c": 1.0}
