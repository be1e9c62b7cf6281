"""Property graph: upserts, provenance, neighbourhoods and the graph score.

Nodes have ids ``type:identifier``, edges are unique by (source, target, relation). Walks are
undirected joins with a frontier that is aggregated after each hop, so that the number of rows is
bounded by nodes, not by paths.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelattice.operators.skew import numbered, spread_join
from notelattice.session import materialize

#: More than rounding to nine digits moves a value of a rank.
SLACK = 1e-8
KEY = ["source_id", "target_id", "relation_type"]


def upsert_edges(log: DataFrame, order: str) -> DataFrame:
    """The last row of each (source, target, relation) by ``order``; its weight counts even if null."""
    last = log.groupBy(*KEY).agg(F.max(F.struct(order, "weight")).alias("s"))
    return last.select(*KEY, F.col("s.weight").alias("weight"))


def upsert_nodes(log: DataFrame, order: str) -> DataFrame:
    """The last row of each node_id by ``order``."""
    rest = [c for c in log.columns if c not in ("node_id", order)]
    last = log.groupBy("node_id").agg(F.max_by(F.struct(*rest), order).alias("s"))
    return last.select("node_id", "s.*")


def node_type(node: Column) -> Column:
    """The part of a node id before its first colon."""
    return F.substring_index(node, ":", 1)


def incident(edges: DataFrame) -> DataFrame:
    """Rows (node, neighbour, relation_type, weight): each edge from both ends, a self-loop once."""
    there = edges.select(F.col("source_id").alias("node"), F.col("target_id").alias("neighbour"), "relation_type", "weight")
    back = edges.filter("source_id <> target_id").select(F.col("target_id").alias("node"), F.col("source_id").alias("neighbour"), "relation_type", "weight")
    return there.unionByName(back)


def delete_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without the given node_ids, edges without any end among them."""
    gone = ids.select(F.col("node_id").alias("_id")).distinct()
    left = edges.join(gone, F.col("source_id") == F.col("_id"), "left_anti").join(gone, F.col("target_id") == F.col("_id"), "left_anti")
    return nodes.join(gone, F.col("node_id") == F.col("_id"), "left_anti"), left


def delete_by_chunks(edges: DataFrame, provenance: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove the provenance of chunks; an edge goes only if nothing else justifies it.

    Edges that no provenance of these chunks names stay. Returns (edges, provenance).
    """
    ids = chunks.select("chunk_id").distinct()
    impacted = provenance.join(ids, "chunk_id", "left_semi").select(*KEY).distinct()
    remaining = provenance.join(ids, "chunk_id", "left_anti")
    gone = impacted.join(remaining.select(*KEY).distinct(), KEY, "left_anti")
    return edges.join(gone, KEY, "left_anti"), remaining


def walk(seeds: DataFrame, seed: str, edges: DataFrame, hops: int) -> DataFrame:
    """Rows (seed, neighbour, relation_type, weight) of every incident edge of each node nearer than ``hops``.

    Each such node is expanded once per seed, also back to visited nodes: a bag. Seeds may be any
    column; the frontier holds distinct (seed, node).
    """
    both = materialize(incident(edges), "incident")
    frontier = seeds.select(F.col(seed).alias("s")).distinct().withColumn("node", F.col("s"))
    visited, out = frontier, None
    for hop in range(hops):
        emitted = spread_join(frontier, both, "node", "neighbour").select("s", "neighbour", "relation_type", "weight")
        out = emitted if out is None else out.unionByName(emitted)
        if hop + 1 < hops:
            fresh = emitted.select("s", F.col("neighbour").alias("node")).distinct().join(visited, ["s", "node"], "left_anti")
            frontier = materialize(fresh, "frontier")
            visited = visited.unionByName(frontier)
    empty = both.limit(0).select(F.col("node").alias("s"), "neighbour", "relation_type", "weight")
    return (out if out is not None else empty).withColumnRenamed("s", "seed")


def _reach(seeds: DataFrame, edges: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    """Rows (s, node) of the nodes nearer than ``hops`` to each seed, and (node, neighbour, gain) of all edges."""
    ids = seeds.select(F.concat(F.lit("section:"), "chunk_id").alias("s")).distinct()
    both = incident(edges)
    factor = F.when(F.col("relation_type").isin("LINKS_TO", "MENTIONS"), 1.5).otherwise(1.0)
    # what a node gives its neighbouring sections is summed before any walk meets it
    sums = both.groupBy("node", "neighbour").agg(F.sum(F.col("weight") * factor).alias("gain"))
    links = materialize(sums, "links")
    frontier = ids.withColumn("node", F.col("s"))
    visited = frontier
    for _ in range(hops - 1):
        fresh = spread_join(frontier, links.select("node", "neighbour"), "node", "neighbour").select("s", F.col("neighbour").alias("node")).distinct().join(visited, ["s", "node"], "left_anti")
        frontier = materialize(fresh, "frontier")
        visited = visited.unionByName(frontier)
    return visited, links


def graph_search(seeds: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """Rows (query_id, chunk_id, score) for ordered seeds (query_id, ord, chunk_id).

    Every walk step to a section adds its weight, 1.5 times for LINKS_TO and MENTIONS, and a seed is
    set to 1 when its turn ends. So a section that is no seed has the sum over all seeds, and a seed
    has 1 plus the sum over the seeds after it: a sum without sequential state.
    """
    visited, links = _reach(seeds, edges, hops)
    given_by = links.filter(F.col("neighbour").startswith("section:"))
    gains = spread_join(visited, given_by, "node", "neighbour").groupBy(F.col("s").alias("seed"), "neighbour").agg(F.sum("gain").alias("gain"))
    own = seeds.select("query_id", "ord", F.concat(F.lit("section:"), "chunk_id").alias("node"))
    given = own.withColumnRenamed("node", "seed").join(gains, "seed").select("query_id", F.col("ord").alias("from"), F.col("neighbour").alias("node"), "gain")
    met = given.join(own, ["query_id", "node"], "left").filter("ord is null or `from` > ord").groupBy("query_id", "node").agg(F.sum("gain").alias("score"))
    base = own.select("query_id", "node", F.lit(1.0).alias("score"))
    total = met.unionByName(base).groupBy("query_id", "node").agg(F.round(F.sum("score"), 9).alias("score"))
    return total.select("query_id", F.substring("node", len("section:") + 1, 1_000_000).alias("chunk_id"), "score")


def graph_ranked(seeds: DataFrame, edges: DataFrame, hops: int, wanted: DataFrame | None, known: DataFrame, best: int, value: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Rows (query_id, chunk_id, score, rank, lo, hi) of ``graph_search``, ranked, with the bounds of all scores of the query.

    Of each query these rows are kept: the ``best`` first of all and the ``best`` first of those in ``known``
    (chunk_id), each with all after them whose ``value`` (of the rank) is as good but for rounding, and
    those in ``wanted`` (query_id, chunk_id). All sections are scored and ranked, in the task of their query: rows
    (query, section) are as many as queries times sections near a hub and never leave it. To it go the links of the
    nodes that the seeds visit, as numbers: 12 bytes for each link to a section.
    """
    spark = seeds.sparkSession
    visited, links = _reach(seeds, edges, hops)
    visited = materialize(visited, "visited")
    given = materialize(links.filter(F.col("neighbour").startswith("section:")).join(visited.select("node").distinct(), "node", "left_semi"), "given")
    own = seeds.select("query_id", "ord", F.concat(F.lit("section:"), "chunk_id").alias("section"))
    # numbers in the order of the names, which decides ties
    sections = materialize(numbered(given.select(F.col("neighbour").alias("section")).union(own.select("section")).distinct(), ["section"], "code"), "sections")
    nodes = materialize(numbered(given.select("node").distinct(), ["node"], "at"), "nodes")
    there = known.select(F.concat(F.lit("section:"), "chunk_id").alias("section"), F.lit(True).alias("there")).distinct()
    names = sections.join(there, "section", "left").select("code", F.coalesce("there", F.lit(False)).alias("there")).toArrow()
    flags = np.zeros(names.num_rows, dtype=bool)
    flags[names.column("code").to_numpy()] = names.column("there").to_numpy()
    table = given.join(sections, given["neighbour"] == sections["section"]).join(nodes, "node").select(F.col("at").cast("int").alias("at"), F.col("code").cast("int").alias("code"), "gain").toArrow()
    at, code = table.column("at").to_numpy(), table.column("code").to_numpy()
    by = np.lexsort((code, at))
    gain = table.column("gain").to_numpy(zero_copy_only=False).astype(np.float64)[by]
    null = table.column("gain").is_null().to_numpy()[by]
    sent = spark.sparkContext.broadcast((np.searchsorted(at[by], np.arange(nodes.count() + 1)), code[by], np.where(null, 0.0, gain), ~null if null.any() else None, flags))
    number = lambda rows, kind, n: rows.select("query_id", F.col("ord").cast("int").alias("ord"), F.lit(kind).alias("kind"), F.col(n).cast("int").alias("n"))
    rows = number(own.join(visited, own["section"] == visited["s"]).join(nodes, "node"), 0, "at").unionByName(number(own.join(sections, "section"), 1, "code"))
    if wanted is not None:
        asked = wanted.select("query_id", F.lit(0).alias("ord"), F.concat(F.lit("section:"), "chunk_id").alias("section")).distinct()
        rows = rows.unionByName(number(asked.join(sections, "section"), 2, "code"))
    tasks = 4 * spark.sparkContext.defaultParallelism
    lists = rows.repartition(tasks, "query_id").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("kind", "ord", "n"))).alias("r"))
    lists = lists.select("query_id", *[F.col(f"r.{c}").alias(c) for c in ("kind", "ord", "n")])
    schema = T.StructType([T.StructField("query_id", seeds.schema["query_id"].dataType), T.StructField("code", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType()), T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())])
    ranked = materialize(lists.mapInArrow(_ranker(sent, best, value), schema), "ranked")
    return ranked.join(sections, "code").select("query_id", F.substring("section", len("section:") + 1, 1_000_000).alias("chunk_id"), "score", "rank", "lo", "hi")


def _ranker(sent, best: int, value: Callable[[np.ndarray], np.ndarray]):
    """Rows (query_id, code, score, rank, lo, hi) of queries (query_id, kind, ord, n); kinds are nodes visited, seeds, codes wanted."""

    def ranking(ord_: np.ndarray, n: np.ndarray, visited: np.ndarray, total: np.ndarray, met: np.ndarray, fine: np.ndarray) -> tuple:
        """(codes in order, rank of each, codes and scores by rank, ranks kept, lo, hi) of seeds and the nodes they visit."""
        bounds, section, gain, scored, flags = sent.value
        seed = dict(zip(ord_[~visited].tolist(), n[~visited].tolist()))
        visits: dict[int, list[int]] = {}
        for o, v in zip(ord_[visited].tolist(), n[visited].tolist()):
            visits.setdefault(o, []).append(v)
        for o in sorted(seed):
            for v in visits.get(o, ()):
                own = section[bounds[v] : bounds[v + 1]]  # a node has a section once
                total[own] += gain[bounds[v] : bounds[v + 1]]
                met[own] = True
                if scored is not None:
                    fine[own] |= scored[bounds[v] : bounds[v + 1]]
            total[seed[o]], met[seed[o]], fine[seed[o]] = 1.0, True, True  # its turn ends
        every = np.flatnonzero(met)
        score = np.round(total[every], 9)
        if scored is not None:
            score[~fine[every]] = -np.inf  # null: behind all others
        total[every], met[every], fine[every] = 0, False, False
        order = np.argsort(-score, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        code, score = every[order], score[order]
        worth, there = value(np.arange(len(code))), np.flatnonzero(flags[code])
        kept = worth >= worth[min(best, len(code)) - 1] - SLACK
        if len(there):
            kept |= flags[code] & (worth >= worth[there[min(best, len(there)) - 1]] - SLACK)
        real = score[score > -np.inf]
        lo, hi = (real.min(), real.max()) if len(real) else (np.nan, np.nan)
        return every, place, code, score, np.flatnonzero(kept), lo, hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(sent.value[4])
        total, met, fine = np.zeros(size), np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            sizes = batch.column(1).value_lengths().to_numpy()
            ends = np.cumsum(sizes)
            kinds, ords, ns = (batch.column(i).flatten().to_numpy() for i in (1, 2, 3))
            # wanted codes come last; queries of equal seeds share a ranking
            middles = (ends - np.bincount(np.repeat(np.arange(len(sizes)), sizes)[kinds == 2], minlength=len(sizes))).tolist()
            begins, ends = (ends - sizes).tolist(), ends.tolist()
            keys = [b"".join(x[a:m].tobytes() for x in (kinds, ords, ns)) for a, m in zip(begins, middles)]
            last = None
            for i in sorted(range(len(keys)), key=keys.__getitem__):
                a, m = begins[i], middles[i]
                if keys[i] != last:
                    every, place, code, score, kept, lo, hi = ranking(ords[a:m], ns[a:m], kinds[a:m] == 0, total, met, fine)
                    last = keys[i]
                asked = ns[m : ends[i]]
                at = np.searchsorted(every, asked)
                at = at[every[np.minimum(at, len(every) - 1)] == asked]
                rank = np.union1d(kept, place[at])
                out.append((np.full(len(rank), i), code[rank], score[rank], rank, np.full(len(rank), lo), np.full(len(rank), hi)))
            if out:
                i, code, score, rank, lo, hi = map(np.concatenate, zip(*out))
                columns = [batch.column(0).take(pa.array(i)), pa.array(code), pa.array(score, mask=score == -np.inf), pa.array(rank.astype(np.int32)), pa.array(lo, mask=np.isnan(lo)), pa.array(hi, mask=np.isnan(hi))]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "code", "score", "rank", "lo", "hi"])

    return run


def distinct_seeds(lists: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """Rows (query, ord, item): items of concatenated lists (query, list_idx, rank, item), first places kept, k at most."""
    first = lists.groupBy(query, item).agg(F.min(F.struct("list_idx", "rank")).alias("at"))
    return first.withColumn("ord", F.row_number().over(Window.partitionBy(query).orderBy("at", item)) - 1).filter(F.col("ord") < k).select(query, "ord", item)


def cooccurrences(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, provenance) of rows (chunk_id, ord, entity): each ordered pair of a chunk's entities, weight 0.5.

    The output is quadratic in the entities of a chunk by definition; a chunk has a bounded text.
    """
    first = entities.groupBy("chunk_id", "entity").agg(F.min("ord").alias("ord"))
    # pairs come from one ordered list per chunk, so no join repeats the rows
    lists = first.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("ord", "entity"))).alias("e"))
    left = lists.select("chunk_id", "e", F.posexplode(F.transform("e", lambda x: x["entity"])).alias("i", "source_id"))
    rest = left.select("chunk_id", "source_id", F.explode(F.expr("transform(slice(e, i + 2, size(e)), x -> x.entity)")).alias("target_id"))
    provenance = rest.select("source_id", "target_id", F.lit("CO_OCCURS").alias("relation_type"), "chunk_id").distinct()
    return provenance.select(*KEY).distinct().withColumn("weight", F.lit(0.5)), provenance


def section_parents(chunks: DataFrame) -> DataFrame:
    """PARENT_OF edges between the first chunk of each heading path of a file and that of the path above it."""
    path = F.array_join("heading_hierarchy", " > ")
    up = F.array_join(F.slice("heading_hierarchy", 1, F.greatest(F.size("heading_hierarchy") - 1, F.lit(0))), " > ")
    rows = chunks.filter("heading_hierarchy is not null").select("file_path", path.alias("path"), up.alias("up"), "chunk_index", "chunk_id")
    first = rows.groupBy("file_path", "path").agg(F.min(F.struct("chunk_index", "chunk_id", "up")).alias("c"))
    child = first.select("file_path", F.col("c.up").alias("up"), F.col("c.chunk_id").alias("child")).filter("up <> ''")
    parent = first.select("file_path", F.col("path").alias("up"), F.col("c.chunk_id").alias("parent"))
    node = lambda c: F.concat(F.lit("section:"), c)
    joined = child.join(parent, ["file_path", "up"])
    return joined.select(node("parent").alias("source_id"), node("child").alias("target_id"), F.lit("PARENT_OF").alias("relation_type"), F.lit(1.0).alias("weight"))
