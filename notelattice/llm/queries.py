"""Queries of this subpackage: name to callable of (session, folder of tables)."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, distinctive, frequency, markup, mixture, neighbours, ranking, records, repetition, together

#: Folder of the public vocabulary files; a parameter of the queries that encode.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
#: Weights of the engines in the reciprocal ranking.
ENGINES = {"semantic_score": 1.0, "bm25_score": 1.0, "graph_score": 1.5}


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def vocabulary(name: str = "byte_bpe_50k") -> str:
    """Rank file of a byte-level vocabulary."""
    return f"{TOKENIZERS}/{name}.tiktoken"


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    terms = frequency.term_frequencies(_read(spark, folder, "chunks"), "chunk_id", "text")
    return terms.filter("mark is not null").select("term", "mark")


def p2_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    return frequency.term_frequencies(_read(spark, folder, "chunks"), "chunk_id", "text").select("term", "count", "document_count")


def _tied(spark: SparkSession, folder: str) -> DataFrame:
    rows = _read(spark, folder, "edge_provenance").filter(F.upper("relation_type") == "CO_OCCURS")
    return rows.select("chunk_id", "source_id", "target_id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs, marginals, total = together.tie_gram(_tied(spark, folder), "chunk_id", "source_id", "target_id")
    often = together.with_lift(pairs.filter("n_ab >= 5"), marginals, total)
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    return often.filter(exact("n_ab") * exact("m") >= 6 * exact("n_a") * exact("n_b")).select(F.col("a").alias("node_a"), F.col("b").alias("node_b"))


def p3_baskets(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of nodes of a chunk, tied or not, by the blocked product of whole baskets."""
    rows = _tied(spark, folder).filter("chunk_id is not null")
    baskets = rows.select("chunk_id", F.explode(F.array("source_id", "target_id")).alias("node"))
    pairs = together.gram_matrix(baskets, "chunk_id", "node")
    return pairs.select(F.col("a").alias("node_a"), F.col("b").alias("node_b"), "n_ab")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    # repeated rows are equal in every column, so a row per chunk_id is each text once
    chunks = records.texts(_read(spark, folder, "chunks"), "chunk_id", "text")
    return markup.clean_markup(chunks, "k", "t").select(F.col("k").alias("chunk_id"), F.explode("kinds").alias("markup"))


def p4_clean(spark: SparkSession, folder: str) -> DataFrame:
    return markup.clean_markup(records.spread(_read(spark, folder, "chunks")), "chunk_id", "text").select("chunk_id", "text", "outside")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    scores = distinctive.term_scores(_read(spark, folder, "chunks"), "chunk_id", "text", length_norm=False)
    return distinctive.top_terms(scores, "chunk_id", 3, digits=6).select("chunk_id", "term")


def p5_normalised(spark: SparkSession, folder: str) -> DataFrame:
    scores = distinctive.term_scores(_read(spark, folder, "chunks"), "chunk_id", "text")
    return distinctive.top_terms(scores, "chunk_id", 3, digits=6).select("chunk_id", "term", "score")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    near = neighbours.nearest_neighbours(_read(spark, folder, "vectors"), "chunk_id", "embedding", "embedded_at", dim=384, k=5)
    pairs = neighbours.similar_pairs(near, "chunk_id", 0.65)
    return pairs.select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    best = ranking.reciprocal_rank(_read(spark, folder, "search_results"), "query_id", "chunk_id", ENGINES, "scored_at", k=5)
    return best.select("query_id", "chunk_id")


def p7_leximin(spark: SparkSession, folder: str) -> DataFrame:
    best = ranking.leximin(_read(spark, folder, "search_results"), "query_id", "chunk_id", list(ENGINES), "scored_at", k=None)
    return best.select("query_id", "chunk_id", "place")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_texts(records.spread(_read(spark, folder, "documents")), "doc_id", "text", vocabulary())


def _mix(spark: SparkSession, folder: str) -> DataFrame:
    targets = _read(spark, folder, "mix_targets")
    sized = mixture.source_sizes(_read(spark, folder, "documents"), targets, vocabulary())
    planned = mixture.plan(sized, targets)
    return mixture.report(planned, mixture.draw(sized, planned))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder).filter("exhausted").select("source")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder).select("source", "target_share", "max_repeats", "documents", "size", "tokens", "uses", "most_uses", "reached_share", "mix_share", "short")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    measured = repetition.repetition(records.spread(_read(spark, folder, "documents")), ["doc_id"], "text")
    return measured.filter("words > 0 and 10 * repeated >= 3 * words").select("doc_id")


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    """Every document, by its language and source, else its language, else all documents."""
    name = lambda c: F.nullif(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), F.lit(""))
    docs = _read(spark, folder, "documents").withColumn("lang", name("lang")).withColumn("source", name("source"))
    measured = repetition.repetition(docs, ["doc_id", "lang", "source"], "text")
    return repetition.outliers(measured, "doc_id", ["lang", "source"], broader=[["lang"], []])


def p10_outliers(spark: SparkSession, folder: str) -> DataFrame:
    return _judged(spark, folder).filter("outlier").select("doc_id", "distance")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        p2_found, p2_frequencies, p3_found, p3_baskets, p4_found, p4_clean, p5_found, p5_normalised, p6_found,
        p7_found, p7_leximin, p8_ids, p9_found, p9_shares, p10_found, p10_outliers,
    )
    return {f.__name__: f for f in every}
