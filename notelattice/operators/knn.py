"""Exact nearest neighbours of a stated query set, in blocks.

The queries go to the rows, not the rows to the queries: slices of the query matrix of bounded size
are broadcast, and the vector table is read where it lies, Arrow buffers as matrices. Of each product only
the best of each query leave the task. Nothing but these is shuffled, and no row pair is ever materialised.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelattice.session import materialize

#: Numbers in a slice of the query matrix that is broadcast (64 MB), rows of the table and numbers of a product at once.
SLICE, BLOCK, PRODUCT = 8_000_000, 2_048, 4_000_000
#: More than rounding to nine digits moves a cosine, candidates between two cuts, and rows that a task hands on at once.
SLACK, CANDIDATES, ROWS = 1e-8, 1_000_000, 100_000


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit rows; a vector of another length, with a component that is null or not finite, or of norm zero is a zero row, so its similarity is 0."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = np.nan_to_num(pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64), nan=np.nan, posinf=np.nan, neginf=np.nan)
    x = np.zeros((len(column), dim))
    fit = sizes == dim
    x[fit] = flat.reshape(-1, dim) if fit.all() else flat[np.repeat(fit, sizes)].reshape(-1, dim)
    x[~np.isfinite(x).all(axis=1)] = 0
    x /= np.maximum(np.abs(x).max(axis=1, keepdims=True, initial=0), 1e-300)  # before squaring: no overflow, no underflow
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _near(s: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of all cosines that may be among the k best of their row, ties by column. Raises ``floor`` where k better ones are seen."""
    near = s > floor[:, None] - SLACK
    crowded = np.flatnonzero(near.sum(axis=1) > 4 * k)
    if len(crowded):
        value = np.round(s[crowded], 9)
        best = np.argsort(-value, axis=1, kind="stable")[:, :k]
        near[crowded] = False
        near[crowded[:, None], best] = True
        floor[crowded] = np.maximum(floor[crowded], np.take_along_axis(value, best[:, -1:], axis=1)[:, 0])
    return np.nonzero(near)


def _cut(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], names: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list, np.ndarray]:
    """Of candidates (row, number of the name, cosine) the k best of each row in order, ties by name; their names; the places of the k-th."""
    row, at, value = map(np.concatenate, zip(*held))
    used, at = np.unique(at, return_inverse=True)
    names = [names[i] for i in used.tolist()]
    order = sorted(range(len(names)), key=names.__getitem__)
    place = np.empty(len(names), dtype=np.int64)
    place[order] = np.arange(len(names))
    by = np.lexsort((place[at], -value, row))
    nth = np.arange(len(row)) - np.searchsorted(row[by], row[by])
    by, nth = by[nth < k], nth[nth < k]
    return row[by], place[at[by]], value[by], [names[i] for i in order], np.flatnonzero(nth == k - 1)


def nearest(queries: DataFrame, query_id: str, query_vector: str, rows: DataFrame, key: str, vector: str, k: int, dim: int, floor: float | None = None, block: int = BLOCK, slice_: int = SLICE) -> DataFrame:
    """Rows (query_id, key, cosine, rank): the k most similar rows of each query, ranks from 0, ties by key.

    Cosines are rounded to 9 digits. With a floor only cosines of at least so much count. Null keys and vectors are left out.
    """
    spark = rows.sparkSession
    asked = queries.filter(F.col(query_vector).isNotNull() & F.col(query_id).isNotNull()).select(F.col(query_id).alias("q"), F.col(query_vector).cast("array<double>").alias("e"))
    # queries of equal vector have equal neighbours: each vector is sought once
    distinct = materialize(asked.groupBy("e").agg(F.collect_set("q").alias("qs")).withColumn("v", F.monotonically_increasing_id()), "queries")
    # each task hands on the best of each query, so there are no more tasks than run at once
    table = rows.filter(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("e")).coalesce(spark.sparkContext.defaultParallelism)
    schema = T.StructType([T.StructField("v", T.LongType()), T.StructField("k", rows.schema[key].dataType), T.StructField("cosine", T.DoubleType())])
    slices = max(1, -(-distinct.count() * dim // slice_))

    def product(sent) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            kind, names, held, fresh, least, step = None, [], [], 0, np.full(len(q), -np.inf), max(1, PRODUCT // block)

            def cut() -> None:
                nonlocal names, held, fresh
                row, at, value, names, last = _cut(held, names, k)
                least[row[last]] = np.maximum(least[row[last]], value[last])
                held, fresh = [(row, at, value)], 0

            for batch in batches:
                kind = batch.schema.field(0).type
                for begin in range(0, batch.num_rows, block):
                    part = batch.slice(begin, block)
                    own = part.column(0).to_pylist()
                    order = sorted(range(len(own)), key=own.__getitem__)
                    x, before = _matrix(part.column(1), dim)[order].T, len(names)
                    names += [own[i] for i in order]
                    for a in range(0, len(q), step):
                        s = q[a : a + step] @ x
                        row, column = _near(s, least[a : a + step], k)
                        held.append((row + a, column + before, np.round(s[row, column], 9)))
                        fresh += len(row)
                        if fresh >= CANDIDATES:
                            cut()
                            names, before = names + [own[i] for i in order], len(names)
                    if len(names) >= CANDIDATES:
                        cut()
            if held:
                cut()
                row, at, value = held[0]
                for a in range(0, len(row), ROWS):
                    found = [names[i] for i in at[a : a + ROWS].tolist()]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[a : a + ROWS])), pa.array(found, kind), pa.array(value[a : a + ROWS])], names=["v", "k", "cosine"])

        return table.mapInArrow(run, schema)

    found = None
    for i in range(slices):
        own = (distinct if slices == 1 else distinct.filter(F.pmod(F.xxhash64("v"), F.lit(slices)) == i)).select("v", "e").toArrow()  # at most about ``slice_`` numbers
        if own.num_rows:
            sent = spark.sparkContext.broadcast((own.column(0).combine_chunks(), _matrix(own.column(1).combine_chunks(), dim)))
            part = product(sent) if slices == 1 else materialize(product(sent), "near")
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    if floor is not None:
        found = found.filter(F.col("cosine") >= floor)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("cosine"), "k")) - 1).filter(F.col("rank") < k)
    named = ranked.join(distinct.select("v", F.explode("qs").alias("q")), "v")
    return named.select(F.col("q").alias(query_id), F.col("k").alias(key), "cosine", "rank")


def store_search(queries: DataFrame, query_id: str, query_vector: str, rows: DataFrame, key: str, vector: str, top_k: int, dim: int, floor: float = 0.4) -> DataFrame:
    """As the indexed store: 2 * top_k nearest, similarity (1 + cosine) / 2, then the floor, then top_k."""
    near = nearest(queries, query_id, query_vector, rows, key, vector, 2 * top_k, dim)
    scored = near.withColumn("score", F.round((1 + F.col("cosine")) / 2, 9))
    return scored.filter((F.col("score") >= floor) & (F.col("rank") < top_k)).select(query_id, key, "score", "rank")


def brute_search(queries: DataFrame, query_id: str, query_vector: str, rows: DataFrame, key: str, vector: str, top_k: int, dim: int, floor: float = 0.4) -> DataFrame:
    """As the brute store: the floor applies to the cosine, first."""
    near = nearest(queries, query_id, query_vector, rows, key, vector, top_k, dim, floor)
    return near.select(query_id, key, F.col("cosine").alias("score"), "rank")
