"""Search over an index for batches of queries, in the modes semantic, bm25, graph and hybrid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelattice.config import Settings
from notelattice.functions import models
from notelattice.functions import text as tx
from notelattice.functions.noise import DEFAULT, NoiseWords, of_settings
from notelattice.operators import bm25, extraction, fusion, graph, knn
from notelattice.schemas import ACRONYMS
from notelattice.session import materialize
from notelattice.sources.index_store import IndexStore

MODES = ("semantic", "bm25", "graph", "hybrid")
SEEDS = ("bm25", "semantic", "hybrid")


class NoIndexError(RuntimeError):
    """The index has no chunks."""


def _list(scored: DataFrame, engine: str, idx: int) -> DataFrame:
    """A ranked list with min-max scores; ranks follow the scores before normalisation."""
    rows = fusion.normalize(scored, ["query_id"], "score")
    return rows.select("query_id", "chunk_id", F.lit(idx).alias("list_idx"), F.lit(engine).alias("engine"), "rank", "normalized")


def load_bm25(store: IndexStore, noise: NoiseWords = DEFAULT) -> bm25.Bm25Index:
    """The stored inverted index; rebuilt from the chunks (and stored, unless read-only) if it is missing or unreadable."""
    if all(store.readable(t) for t in ("postings", "idf")):
        return bm25.Bm25Index(store.read("postings"), store.read("idf"))
    index = bm25.build_index(store.read("chunks"), "chunk_id", "text", noise)
    if not store.settings.read_only:
        with store.transaction():
            store.replace("postings", index.packed)
            store.replace("idf", index.idf)
    return index


def load_acronyms(store: IndexStore) -> DataFrame:
    """The stored acronyms; none if the table is missing or unreadable."""
    if store.readable("acronyms"):
        return store.read("acronyms")
    return store.spark.createDataFrame([], ACRONYMS)


def rerank_pool(fused: DataFrame, asked: DataFrame, texts: DataFrame, reranker: models.Reranker, settings: Settings) -> DataFrame:
    """Rows (query_id, chunk_id, rerank): the model's scores of the pool of each query, scaled down for short texts, those above the threshold."""
    pool = fusion.ranks(fused, ["query_id"], "score", "chunk_id").filter(F.col("rank") < settings.rerank_pool_size)
    pairs = pool.join(asked.select("query_id", "query"), "query_id").join(texts.select("chunk_id", "text"), "chunk_id")
    score = models.rerank_scores(F.col("query"), F.col("text"), reranker) * tx.length_penalty(F.col("text"), settings.reranker_min_length)
    return pairs.select("query_id", "chunk_id", score.alias("rerank")).filter(F.col("rerank") > settings.reranker_score_threshold)


def search(
    store: IndexStore,
    queries: DataFrame,
    mode: str = "hybrid",
    top_k: int | None = None,
    rerank: bool = True,
    expand: bool = True,
    graph_seed: str = "bm25",
    embedder: models.Embedder | None = None,
    reranker: models.Reranker | None = None,
    noise: NoiseWords | None = None,
) -> DataFrame:
    """Results of queries (query_id, query): query_id, chunk_id, file_path, heading_path, snippet, fused_score,
    semantic_score, bm25_score, graph_score, matched_engines, place.

    The engines' scores are reported normalised per list; the fused ranking uses ranks only. Ties go to the smaller chunk_id.
    """
    if mode not in MODES or graph_seed not in SEEDS:
        raise ValueError(f"mode is one of {MODES}, graph_seed one of {SEEDS}")
    settings: Settings = store.settings
    embedder, reranker = embedder or models.get_hook("embedder"), reranker or models.get_hook("reranker")
    noise = noise or of_settings(settings.stop_words_file, settings.skip_upper_file)
    k = top_k or settings.default_top_k
    chunks = store.read("chunks")
    if chunks.isEmpty():
        raise NoIndexError("the index has no chunks; index a directory first")
    asked = queries.select("query_id", "query")
    if expand:
        expanded = extraction.expand_queries(asked, "query_id", "query", load_acronyms(store))
        asked = asked.join(expanded, "query_id")
    else:
        asked = asked.withColumn("expanded", F.col("query"))
    asked = materialize(asked.withColumn("tokens", F.array_distinct(tx.tokenize(F.col("expanded"), noise))), "queries")

    def semantic() -> DataFrame:
        model = embedder or models.hashing_embedder(settings.embedding_dim)
        vectors = asked.select("query_id", models.embed(F.col("expanded"), model).alias("v"))
        return knn.store_search(vectors, "query_id", "v", store.read("vectors"), "chunk_id", "embedding", 2 * k, settings.embedding_dim, settings.semantic_floor)

    def words() -> DataFrame:
        return bm25.search(asked, "query_id", "expanded", load_bm25(store, noise), 2 * k, noise).select("query_id", "chunk_id", "score", "rank")

    lists: list[DataFrame] = []
    if mode in ("semantic", "hybrid"):
        lists.append(materialize(_list(semantic(), "semantic", len(lists)), "list"))
    if mode in ("bm25", "hybrid"):
        lists.append(materialize(_list(words(), "bm25", len(lists)), "list"))
    if mode in ("graph", "hybrid"):
        sources = lists
        if not sources:
            make = {"bm25": [words], "semantic": [semantic], "hybrid": [words, semantic]}[graph_seed]
            sources = [m().select("query_id", "chunk_id", "rank", F.lit(i).alias("list_idx")) for i, m in enumerate(make)]
        flat = sources[0].select("query_id", "list_idx", "rank", "chunk_id")
        for s in sources[1:]:
            flat = flat.unionByName(s.select("query_id", "list_idx", "rank", "chunk_id"))
        seeds = materialize(graph.distinct_seeds(flat, "query_id", "chunk_id", k), "seeds")
        # of the list only what the best k of the fusion can depend on: others rank behind ``best`` rows that no other list has
        others = 2 * k * len(lists)
        wanted = None
        for one in lists:
            own = one.select("query_id", "chunk_id")
            wanted = own if wanted is None else wanted.unionByName(own)
        weight, after = settings.graph_rrf_weight, settings.fusion_k + 1
        best = k + settings.rerank_pool_size + others
        ranked = graph.graph_ranked(seeds, store.read("edges"), settings.graph_max_hops, wanted, chunks, best, lambda rank: weight / (after + rank))
        spread = F.col("hi") - F.col("lo")
        normalized = F.when(spread == 0, 1.0).otherwise((F.col("score") - F.col("lo")) / F.nullif(spread, F.lit(0.0)))
        lists.append(materialize(ranked.select("query_id", "chunk_id", F.lit(len(lists)).alias("list_idx"), F.lit("graph").alias("engine"), "rank", normalized.alias("normalized")), "list"))
    ranked = lists[0]
    for one in lists[1:]:
        ranked = ranked.unionByName(one)
    fused = materialize(fusion.weighted_rrf(ranked.withColumn("weight", F.lit(1.0)), "query_id", "chunk_id", settings.fusion_k, settings.graph_rrf_weight), "fused")
    per_engine = ranked.groupBy("query_id", "chunk_id").agg(*[F.max(F.when(F.col("engine") == e, F.col("normalized"))).alias(f"{e}_score") for e in ("semantic", "bm25", "graph")])
    about = chunks.select("chunk_id", "file_path", F.array_join("heading_hierarchy", " > ").alias("heading_path"), "text")
    if rerank:
        if reranker is None:
            second = fusion.fallback_rerank(fused, "query_id", "chunk_id", settings.rerank_pool_size)
        else:
            second = rerank_pool(fused, asked, about, reranker, settings)
        final = fusion.blend(fused, second, "query_id", "chunk_id").withColumnRenamed("blended", "fused_score").join(fused.select("query_id", "chunk_id", "engines"), ["query_id", "chunk_id"], "left")
        # chunks that are gone are dropped before the best are taken
        final = final.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    else:
        final = fused.withColumnRenamed("score", "fused_score")
    best = fusion.ranks(final, ["query_id"], "fused_score", "chunk_id").filter(F.col("rank") < k)
    rows = best.join(about, "chunk_id", "left").join(per_engine, ["query_id", "chunk_id"], "left").join(asked.select("query_id", "tokens"), "query_id")
    blank = lambda c: F.coalesce(c, F.lit(""))
    return rows.select(
        "query_id", "chunk_id", blank(F.col("file_path")).alias("file_path"), blank(F.col("heading_path")).alias("heading_path"),
        tx.snippet(F.col("text"), F.col("tokens"), settings.snippet_length).alias("snippet"), "fused_score", "semantic_score", "bm25_score", "graph_score",
        F.coalesce("engines", F.expr("cast(array() as array<string>)")).alias("matched_engines"), F.col("rank").alias("place"),
    )


def format_results(results: DataFrame) -> DataFrame:
    """Adds ``line``: place, heading path (``Untitled`` if empty), score to four places and in per cent, snippet on one line."""
    head = F.when(F.col("heading_path") == "", "Untitled").otherwise(F.col("heading_path"))
    flat = F.regexp_replace("snippet", r"\n", " ")
    line = F.concat_ws(" ", F.concat((F.col("place") + 1).cast("string"), F.lit(".")), head, F.format_string("(%.4f, %.1f%%)", F.col("fused_score"), F.col("fused_score") * 100), flat)
    return results.withColumn("line", line)
