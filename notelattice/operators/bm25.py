"""BM25 over an inverted index of postings, for batches of queries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelattice.functions import text as tx
from notelattice.functions.noise import DEFAULT, NoiseWords
from notelattice.operators.counting import pack_terms
from notelattice.session import materialize

K1, B = 1.5, 0.75
#: Rows (query, term) that are broadcast at once.
BROADCAST_TERMS = 200_000
#: Chunks scored at once, and chunks of a task at least, since each task hands on the best of each query.
BLOCK, PART = 32_768, 16_384
#: More than rounding to nine digits moves a score, and rows that a task hands on at once.
SLACK, ROWS = 1e-8, 100_000


@dataclass
class Bm25Index:
    """Postings packed by chunk (chunk_id, terms, tfs, len) and idf (term, df, idf); texts without tokens have length 0."""

    packed: DataFrame
    idf: DataFrame

    @property
    def postings(self) -> DataFrame:
        """Rows (term, chunk_id, tf)."""
        rows = self.packed.select("chunk_id", F.explode(F.arrays_zip("terms", "tfs")).alias("p"))
        return rows.select(F.col("p.terms").alias("term"), "chunk_id", F.col("p.tfs").alias("tf"))

    @property
    def lengths(self) -> DataFrame:
        """Rows (chunk_id, len)."""
        return self.packed.select("chunk_id", "len")

    def statistics(self) -> DataFrame:
        """One row (doc_count, avg_len)."""
        return self.lengths.agg(F.count("*").alias("doc_count"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avg_len"))


def build_index(df: DataFrame, key: str, text: str, noise: NoiseWords = DEFAULT) -> Bm25Index:
    """Index rows of a table with one row per key; null texts have no tokens. Tokens are counted where their row lies."""
    packed = materialize(pack_terms(df, key, tx.tokenize(F.col(text), noise)).withColumnRenamed(key, "chunk_id"), "postings")
    n = packed.agg(F.count("*").alias("n"))
    df_ = packed.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = df_.crossJoin(F.broadcast(n)).select("term", "df", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
    return Bm25Index(packed, materialize(idf, "idf"))


def search(queries: DataFrame, query_id: str, query: str, index: Bm25Index, k: int | None, noise: NoiseWords = DEFAULT) -> DataFrame:
    """Rows (query_id, chunk_id, score, rank): the k best of each query, ranks from 0, ties by chunk_id.

    A token repeated in a query counts as often. The postings stay where they lie: the terms of the queries are sent to
    them, in slices of whole queries of at most about ``BROADCAST_TERMS`` rows. Every chunk with a term of the query is
    scored, but only the best of each task leave it, so no table of (query, chunk) is written.
    """
    terms = queries.select(F.col(query_id).alias("q"), F.explode(tx.tokenize(F.col(query), noise)).alias("term")).groupBy("q", "term").agg(F.count("*").alias("qtf"))
    weighted = materialize(terms.join(index.idf, "term").select("q", "term", (F.col("qtf") * F.col("idf")).alias("w")), "weighted")
    slices = max(1, -(-weighted.count() // BROADCAST_TERMS))
    corpus = index.statistics().first()
    found = None
    for i in range(slices):
        own = weighted if slices == 1 else weighted.filter(F.pmod(F.xxhash64("q"), F.lit(slices)) == i)
        # scoring is what costs, so its result is written, however often it is read
        part = materialize(_scored(own, index, corpus, k), "scored")
        found = part if found is None else found.unionByName(part)
    return found.withColumnRenamed("q", query_id)


def _scored(weighted: DataFrame, index: Bm25Index, corpus, k: int | None) -> DataFrame:
    """Scores of a slice of queries."""
    spark = index.packed.sparkSession
    sums = T.StructType([T.StructField("q", weighted.schema["q"].dataType), T.StructField("chunk_id", index.packed.schema["chunk_id"].dataType), T.StructField("score", T.DoubleType())])
    # in order of the terms, so that equal chunks have equal sums
    asked = weighted.select("q", "term", "w").toArrow().sort_by([("q", "ascending"), ("term", "ascending")]).combine_chunks()  # at most about ``BROADCAST_TERMS`` rows
    if not asked.num_rows:
        return spark.createDataFrame([], T.StructType([*sums.fields, T.StructField("rank", T.IntegerType())]))
    q, term = (pa.concat_arrays(asked.column(c).chunks) for c in ("q", "term"))
    q = q.dictionary_encode(null_encoding="encode")
    code = q.indices.to_numpy()
    begins = np.flatnonzero(np.diff(code, prepend=-1))
    vocabulary = pc.unique(term)
    ids = q.dictionary.take(pa.array(code[begins]))
    sent = spark.sparkContext.broadcast((ids, [*begins.tolist(), len(code)], pc.index_in(term, vocabulary).to_pylist(), asked.column("w").to_pylist(), vocabulary))
    tasks = max(1, min(spark.sparkContext.defaultParallelism, -(-corpus["doc_count"] // PART)))
    rows = index.packed.filter("chunk_id is not null and len > 0").select("chunk_id", "terms", "tfs", "len").coalesce(tasks)
    scores = rows.mapInArrow(_scorer(sent, float(corpus["avg_len"]) or 1.0, k), sums)
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "chunk_id")) - 1)
    return ranked if k is None else ranked.filter(F.col("rank") < k)


def _block(batches: list[pa.RecordBatch], vocabulary: pa.Array, mean: float) -> tuple[list, list[int], np.ndarray, np.ndarray]:
    """(names in order, bounds of each term, places among the names, gains) of the postings of some chunks."""
    names, term, row, gain, before = [], [], [], [], 0
    for batch in batches:
        size = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
        own = pc.fill_null(pc.index_in(pc.list_flatten(batch.column(1)), vocabulary), -1).to_numpy(zero_copy_only=False)
        asked = own >= 0
        at = np.repeat(np.arange(batch.num_rows), size)[asked]
        tf = pc.list_flatten(batch.column(2)).to_numpy(zero_copy_only=False)[asked]
        length = batch.column(3).to_numpy(zero_copy_only=False)[at]
        names += batch.column(0).to_pylist()
        term.append(own[asked])
        row.append(at + before)
        gain.append(tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean)))
        before += batch.num_rows
    order = sorted(range(len(names)), key=names.__getitem__)
    place = np.empty(len(names), dtype=np.int64)
    place[order] = np.arange(len(names))
    term, row, gain = np.concatenate(term), place[np.concatenate(row)], np.concatenate(gain)
    by = np.lexsort((row, term))
    bounds = np.searchsorted(term[by], np.arange(len(vocabulary) + 1)).tolist()
    return [names[i] for i in order], bounds, row[by], gain[by]


def _scorer(sent, mean: float, k: int | None):
    """Rows (q, chunk_id, score) of chunks (chunk_id, terms, tfs, len): the k best of each query among those of the task, ties by chunk_id."""

    def score(batches: list[pa.RecordBatch], floor: list[float]) -> Iterator[tuple[int, np.ndarray, list]]:
        """(query, scores, names) of a block, best first; scores that can't be among the best are left out."""
        ids, begins, terms, weights, vocabulary = sent.value
        names, bounds, row, gain = _block(batches, vocabulary, mean)
        total = np.zeros(len(names))
        for q in range(len(ids)):
            own = [(bounds[t], bounds[t + 1], w) for t, w in zip(terms[begins[q] : begins[q + 1]], weights[begins[q] : begins[q + 1]]) if bounds[t] < bounds[t + 1]]
            if not own:
                continue
            total.fill(0)
            for a, b, w in own:  # a chunk has a term once
                total[row[a:b]] += w * gain[a:b]
            near = np.flatnonzero(total > max(floor[q] - SLACK, 0))
            value = total[near]
            if k is not None and len(near) > k:
                fine = value >= np.partition(value, len(near) - k)[len(near) - k] - SLACK
                near, value = near[fine], value[fine]
            value = np.round(value, 9)
            order = np.argsort(-value, kind="stable")[:k]
            order = order[value[order] > 0]
            if len(order):
                yield q, value[order], [names[i] for i in near[order].tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, kind = sent.value[0], None
        best: list[list[tuple[float, object]]] = [[] for _ in range(len(ids))]
        floor = [0.0] * len(ids)

        def rows(found: list[tuple[int, list, list]]) -> pa.RecordBatch:
            q = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
            return pa.RecordBatch.from_arrays([ids.take(pa.array(q)), pa.array([n for f in found for n in f[2]], kind), pa.array([s for f in found for s in f[1]], pa.float64())], names=["q", "chunk_id", "score"])

        def in_parts(found: Iterator[tuple[int, list, list]]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for f in found:
                held.append(f)
                size += len(f[1])
                if size >= ROWS:
                    yield rows(held)
                    held, size = [], 0
            if held:
                yield rows(held)

        for block in _blocks(batches):
            kind = block[0].schema.field(0).type
            if k is None:
                yield from in_parts((q, value.tolist(), names) for q, value, names in score(block, floor))
                continue
            for q, value, names in score(block, floor):
                best[q] = sorted([*best[q], *zip((-value).tolist(), names)])[:k]
                if len(best[q]) == k:
                    floor[q] = -best[q][-1][0]
        yield from in_parts((q, [-s for s, _ in own], [n for _, n in own]) for q, own in enumerate(best) if own)

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches in groups of about ``BLOCK`` rows."""
    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            held.append(batch.slice(at, BLOCK))
            size += held[-1].num_rows
            if size >= BLOCK:
                yield held
                held, size = [], 0
    if held:
        yield held
