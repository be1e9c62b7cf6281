"""One ranking from several differently-scaled scores.

Only the order within an engine is used, so no engine dominates by its range. ``numbered`` gives
each row its exact position within (query, engine) however large the group: rows are range
partitioned by the whole order, numbered within their partition, and the few groups that straddle
partitions are moved on by a table with at most one row per partition.

``leximin`` turns positions into percentiles, sorts each item's own percentiles ascending and
compares the arrays lexicographically, so a weak score cannot be masked by strong ones.
``reciprocal_rank`` sums weighted reciprocal positions.

Defined results: null, NaN and negative scores mean that the engine did not return the item; an
item that no engine returned has the worst percentiles and the reciprocal value 0; of several rows
of an item the latest counts (null is earliest, then the larger scores); ties go to the smaller item key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelattice.session import materialize


def latest(df: DataFrame, query: str, item: str, scores: list[str], at: str) -> DataFrame:
    """Rows (q, c, *scores): the latest row of each query and item; aggregated before the shuffle."""
    rows = df.filter(F.col(query).isNotNull() & F.col(item).isNotNull())
    best = rows.groupBy(F.col(query).alias("q"), F.col(item).alias("c")).agg(F.max(F.struct(at, *scores)).alias("s"))
    return best.select("q", "c", *[F.col("s")[s].cast("double").alias(s) for s in scores])


def numbered(rows: DataFrame, scores: list[str]) -> DataFrame:
    """Rows (q, c, engine, number): position from 0 by score descending, then item, of each returned item."""
    valid: list[Column] = [
        F.when(F.col(s).isNotNull() & ~F.isnan(s) & (F.col(s) >= 0), F.struct(F.lit(i).alias("engine"), F.col(s).alias("score"))) for i, s in enumerate(scores)
    ]
    long = rows.select("q", "c", F.explode(F.array_compact(F.array(*valid))).alias("e")).select("q", "e.engine", (-F.col("e.score")).alias("down"), "c")
    order = ["q", "engine", "down", "c"]
    laid = long.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = T.StructType([laid.schema["q"], laid.schema["c"], T.StructField("engine", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("local", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, group, run = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            q, engine = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            local = np.empty(len(q), dtype=np.int64)
            for i, key in enumerate(zip(q, engine)):
                run = run + 1 if key == group else 0
                group = key
                local[i] = run
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(3), batch.column(1), pa.array(np.full(len(q), part, np.int32)), pa.array(local)], names=kind.fieldNames()
            )

    local = materialize(laid.mapInArrow(number, kind), "numbered")
    ends = local.groupBy("q", "engine", "part").agg((F.max("local") + 1).alias("n"))
    earlier = Window.partitionBy("q", "engine").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a group that spans partitions fills all but its first and last: at most one row per partition remains
    moved = ends.withColumn("ahead", F.sum("n").over(earlier)).filter("ahead > 0").select("q", "engine", "part", "ahead")
    joined = local.join(F.broadcast(moved), ["q", "engine", "part"], "left")
    return joined.select("q", "c", "engine", (F.col("local") + F.coalesce("ahead", F.lit(0))).alias("number"))


def top(values: DataFrame, order: list[Column], k: int | None) -> DataFrame:
    """Adds ``place``; with k only the first k of each query, pruned before the shuffle."""
    ranked = values.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(*order)))
    return ranked if k is None else ranked.filter(F.col("place") <= k)


def reciprocal_rank(df: DataFrame, query: str, item: str, weights: dict[str, float], at: str, k: int | None, offset: float = 61, digits: int = 9) -> DataFrame:
    """Rows (query, item, value, place): weighted reciprocal ranks, the k best of each query."""
    scores = list(weights)
    positions = numbered(latest(df, query, item, scores, at), scores)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights.values()]), F.col("engine") + 1)
    values = positions.groupBy("q", "c").agg(F.round(F.sum(weight / (F.lit(float(offset)) + F.col("number"))), digits).alias("value"))
    return top(values, [F.desc("value"), F.asc("c")], k).select(F.col("q").alias(query), F.col("c").alias(item), "value", "place")


def leximin(df: DataFrame, query: str, item: str, scores: list[str], at: str, k: int | None) -> DataFrame:
    """Rows (query, item, percentiles, place): percentiles ascending, compared lexicographically.

    The percentile of an item is the share of the engine's returned items that are not ranked above
    it, 1 for the first; an engine that did not return it gives 0.
    """
    rows = materialize(latest(df, query, item, scores, at), "latest")
    positions = numbered(rows, scores)
    sizes = positions.groupBy("q", "engine").agg((F.max("number") + 1).alias("n"))
    places = positions.groupBy("q", "c").agg(*[F.max(F.when(F.col("engine") == i, F.col("number"))).alias(f"p{i}") for i in range(len(scores))])
    totals = sizes.groupBy("q").agg(*[F.max(F.when(F.col("engine") == i, F.col("n"))).alias(f"n{i}") for i in range(len(scores))])
    every = rows.select("q", "c").join(places, ["q", "c"], "left").join(totals, "q", "left")
    share = [F.coalesce(F.round((F.col(f"n{i}") - F.col(f"p{i}")) / F.col(f"n{i}"), 9), F.lit(0.0)) for i in range(len(scores))]
    values = every.select("q", "c", F.array_sort(F.array(*share)).alias("percentiles"))
    return top(values, [F.desc("percentiles"), F.asc("c")], k).select(F.col("q").alias(query), F.col("c").alias(item), "percentiles", "place")
