"""Fusion of ranked lists: min-max scores, reciprocal ranks, blending with a second score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranks(df: DataFrame, by: list[str], score: str, tie: str) -> DataFrame:
    """Adds ``rank`` from 0 within ``by``, by score descending, then ``tie``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie)) - 1)


def normalize(df: DataFrame, by: list[str], score: str, out: str = "normalized") -> DataFrame:
    """Adds the min-max score within ``by``; 1 where all scores are equal. Bounds are aggregated, then joined."""
    bounds = df.groupBy(*by).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    spread = F.col("_hi") - F.col("_lo")
    value = F.when(spread == 0, 1.0).otherwise((F.col(score) - F.col("_lo")) / F.nullif(spread, F.lit(0.0)))
    return df.join(bounds, by).withColumn(out, value).drop("_lo", "_hi")


def reciprocal_rank_fusion(lists: DataFrame, query: str, item: str, k: float = 60, weight: Column | float = 1.0) -> DataFrame:
    """Rows (query, item, score, engines) of lists (query, list_idx, engine, rank, item): sum of weight / (k + rank + 1).

    ``engines`` are distinct, in order of their list.
    """
    w = F.lit(weight) if isinstance(weight, (int, float)) else weight
    rows = lists.groupBy(query, item).agg(
        F.round(F.sum(w / (F.lit(float(k)) + F.col("rank") + 1)), 9).alias("score"), F.sort_array(F.collect_set(F.struct("list_idx", "engine"))).alias("e")
    )
    return rows.select(query, item, "score", F.array_distinct(F.transform("e", lambda x: x["engine"])).alias("engines"))


def weighted_rrf(lists: DataFrame, query: str, item: str, k: float = 60, graph_weight: float = 1.5) -> DataFrame:
    """As ``reciprocal_rank_fusion``; a list whose first item is of the engine ``graph`` has the graph weight."""
    first = lists.filter("rank = 0").select(query, "list_idx", F.when(F.col("engine") == "graph", graph_weight).otherwise(F.coalesce("weight", F.lit(1.0))).alias("w"))
    return reciprocal_rank_fusion(lists.join(first, [query, "list_idx"]), query, item, k, F.col("w"))


def fallback_rerank(fused: DataFrame, query: str, item: str, pool: int = 20) -> DataFrame:
    """Without a model: 1 - 0.01 * position for the pool of best fused items, positions from 0."""
    return ranks(fused, [query], "score", item).filter(F.col("rank") < pool).select(query, item, (1 - F.col("rank") * 0.01).alias("rerank"))


def blend(fused: DataFrame, reranked: DataFrame, query: str, item: str, fused_weight: float = 0.4, rerank_weight: float = 0.6) -> DataFrame:
    """Rows (query, item, blended): both scores over their maximum (at least 1), missing ones 0, weighted."""
    both = fused.select(query, item, "score").join(reranked.select(query, item, "rerank"), [query, item], "full_outer")
    most = both.groupBy(query).agg(F.greatest(F.max("score"), F.lit(1.0)).alias("_f"), F.greatest(F.max("rerank"), F.lit(1.0)).alias("_r"))
    part = lambda c, m: F.coalesce(F.col(c), F.lit(0.0)) / F.coalesce(F.col(m), F.lit(1.0))
    value = F.round(fused_weight * part("score", "_f") + rerank_weight * part("rerank", "_r"), 9)
    return both.join(most, query).select(query, item, value.alias("blended"))
