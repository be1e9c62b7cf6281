"""Queries of the reference operators over the test tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notelattice.functions import models
from notelattice.functions import text as tx
from notelattice.operators import bm25, diff, extraction, fusion, graph, knn
from notelattice.operators import markdown as md
from notelattice.plans import indexing, searching
from notelattice.session import materialize, scratch_path
from notelattice.sources.exclude import excluded
from notelattice.sources.index_store import IndexStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def chunk_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A row per chunk: repeated rows are equal in every column. One shuffle, into as many tasks as set."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return read(spark, folder, "chunks").repartition(parts, "chunk_id").dropDuplicates(["chunk_id"])


def titles(spark: SparkSession, folder: str) -> DataFrame:
    """Queries (query_id, query): titles of the documents whose id is divisible by 20."""
    docs = read(spark, folder, "documents").filter("doc_id % 20 = 0")
    return docs.select(F.col("doc_id").alias("query_id"), md.title(F.col("text"), F.col("file_path")).alias("query"))


# -- text


@query
def tok_counts(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("text")
    return chunk_rows(spark, folder).select("chunk_id", F.size(tx.raw_tokens(t)).alias("raw"), F.size(tx.tokenize(t)).alias("kept"))


@query
def tokens_top(spark: SparkSession, folder: str) -> DataFrame:
    words = chunk_rows(spark, folder).select(F.explode(tx.tokenize(F.col("text"))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(100)


@query
def estimate_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return chunk_rows(spark, folder).select("chunk_id", tx.estimate_tokens(F.col("text")).alias("tokens"), tx.length_penalty(F.col("text")).alias("penalty"))


@query
def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").select("doc_id", tx.clean_text(F.col("text")).alias("text"))


@query
def sentence_split(spark: SparkSession, folder: str) -> DataFrame:
    return chunk_rows(spark, folder).select("chunk_id", F.posexplode(tx.split_sentences(F.col("text"))).alias("i", "sentence"))


@query
def preprocess_query(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").select("doc_id", tx.preprocess_query(F.col("text")).alias("query"))


@query
def query_analysis(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "files").select(F.col("title").alias("q")).filter("q is not null").distinct()
    a = tx.analyze_query(F.col("q"), F.col("q"))
    return rows.select("q", F.array_join(a["tokens"], " ").alias("tokens"), F.array_join(a["entity_hints"], "|").alias("hints"), a["has_acronyms"].alias("has_acronyms"))


@query
def snippets(spark: SparkSession, folder: str) -> DataFrame:
    """Snippets of each title's three best chunks."""
    asked = titles(spark, folder)
    index = bm25.build_index(chunk_rows(spark, folder), "chunk_id", "text")
    best = bm25.search(asked, "query_id", "query", index, 3)
    rows = best.join(asked, "query_id").join(chunk_rows(spark, folder).select("chunk_id", "text"), "chunk_id")
    rows = rows.withColumn("tokens", F.array_distinct(tx.tokenize(F.col("query"))))
    return rows.select("query_id", "chunk_id", tx.snippet(F.col("text"), F.col("tokens")).alias("snippet"))


@query
def chunk_ids(spark: SparkSession, folder: str) -> DataFrame:
    return chunk_rows(spark, folder).select("chunk_id", tx.chunk_id(F.col("file_path"), F.col("chunk_index")).alias("derived"))


# -- key terms


def _terms(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Term rows and document frequencies, both written once, and the number of chunks."""
    rows = chunk_rows(spark, folder).filter("text is not null")
    terms = materialize(extraction.term_rows(rows, "chunk_id", "text"), "terms")
    return terms, materialize(extraction.document_frequencies(terms), "frequencies"), rows.agg(F.count("*").alias("n"))


@query
def tfidf_doc_topk(spark: SparkSession, folder: str) -> DataFrame:
    terms, frequencies, total = _terms(spark, folder)
    best = extraction.tfidf_per_document(terms, "chunk_id", frequencies, total)
    return best.select("chunk_id", "term", F.round("score", 6).alias("score"))


@query
def tfidf_corpus_topk(spark: SparkSession, folder: str) -> DataFrame:
    terms, _, total = _terms(spark, folder)
    return extraction.tfidf_corpus(terms, total)


@query
def keyterms(spark: SparkSession, folder: str) -> DataFrame:
    terms, frequencies, total = _terms(spark, folder)
    rows = chunk_rows(spark, folder).filter("text is not null")
    found = extraction.key_terms(rows, "chunk_id", "text", frequencies, total, rows=terms)
    return found.select("chunk_id", "name").distinct()


# -- BM25


@query
def bm25_idf(spark: SparkSession, folder: str) -> DataFrame:
    return bm25.build_index(chunk_rows(spark, folder), "chunk_id", "text").idf.select("term", "df", F.round("idf", 6).alias("idf"))


@query
def bm25_doclen(spark: SparkSession, folder: str) -> DataFrame:
    return bm25.build_index(chunk_rows(spark, folder), "chunk_id", "text").lengths


@query
def bm25_postings(spark: SparkSession, folder: str) -> DataFrame:
    return bm25.build_index(chunk_rows(spark, folder), "chunk_id", "text").postings


@query
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    index = bm25.build_index(chunk_rows(spark, folder), "chunk_id", "text")
    best = bm25.search(titles(spark, folder), "query_id", "query", index, 10)
    return best.select("query_id", "chunk_id", F.round("score", 6).alias("score"))


# -- vectors


def _vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, folder, "embeddings").select("vec_id", "embedding")
    return rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), rows


@query
def knn_cosine(spark: SparkSession, folder: str) -> DataFrame:
    asked, rows = _vectors(spark, folder)
    return knn.nearest(asked, "query_id", "q", rows, "vec_id", "embedding", 10, 64).select("query_id", "vec_id", F.round("cosine", 6).alias("cosine"))


@query
def knn_floor_store(spark: SparkSession, folder: str) -> DataFrame:
    asked, rows = _vectors(spark, folder)
    return knn.store_search(asked, "query_id", "q", rows, "vec_id", "embedding", 10, 64, 0.6).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query
def knn_floor_brute(spark: SparkSession, folder: str) -> DataFrame:
    asked, rows = _vectors(spark, folder)
    return knn.brute_search(asked, "query_id", "q", rows, "vec_id", "embedding", 10, 64, 0.4).select("query_id", "vec_id", F.round("score", 6).alias("score"))


# -- fusion


def _lists(spark: SparkSession, folder: str) -> DataFrame:
    """The engines' lists of logged queries: valid scores of distinct rows, the largest per chunk."""
    rows = read(spark, folder, "search_results")
    engines = ("semantic", "bm25", "graph")
    pairs = F.array(*[F.struct(F.lit(i).alias("list_idx"), F.lit(e).alias("engine"), F.col(f"{e}_score").alias("score")) for i, e in enumerate(engines)])
    long = rows.select("query_id", "chunk_id", F.explode(pairs).alias("p")).select("query_id", "chunk_id", "p.*")
    valid = long.filter("score is not null and not isnan(score) and score >= 0")
    best = valid.groupBy("query_id", "list_idx", "engine", "chunk_id").agg(F.max("score").alias("score"))
    return fusion.ranks(best, ["query_id", "engine"], "score", "chunk_id")


@query
def minmax_norm(spark: SparkSession, folder: str) -> DataFrame:
    rows = fusion.normalize(_lists(spark, folder), ["query_id", "engine"], "score")
    return rows.select("query_id", "engine", "chunk_id", F.round("normalized", 6).alias("normalized"))


@query
def rrf(spark: SparkSession, folder: str) -> DataFrame:
    rows = fusion.reciprocal_rank_fusion(_lists(spark, folder), "query_id", "chunk_id")
    return rows.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.array_join("engines", ",").alias("engines"))


@query
def weighted_rrf(spark: SparkSession, folder: str) -> DataFrame:
    rows = fusion.weighted_rrf(_lists(spark, folder).withColumn("weight", F.lit(1.0)), "query_id", "chunk_id")
    return rows.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.array_join("engines", ",").alias("engines"))


@query
def blend_fallback(spark: SparkSession, folder: str) -> DataFrame:
    fused = fusion.weighted_rrf(_lists(spark, folder).withColumn("weight", F.lit(1.0)), "query_id", "chunk_id")
    both = fusion.blend(fused, fusion.fallback_rerank(fused, "query_id", "chunk_id"), "query_id", "chunk_id")
    return both.select("query_id", "chunk_id", F.round("blended", 6).alias("blended"))


@query
def seed_union(spark: SparkSession, folder: str) -> DataFrame:
    return graph.distinct_seeds(_lists(spark, folder).filter("engine <> 'graph'"), "query_id", "chunk_id", 10)


# -- Markdown


@query
def md_sections(spark: SparkSession, folder: str) -> DataFrame:
    rows = md.sections(read(spark, folder, "documents"), "doc_id", "text")
    return rows.select("doc_id", "section", "level", F.array_join("hierarchy", " > ").alias("path"), F.md5("body").alias("body"), "char_offset")


@query
def md_chunks(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    return md.chunks(docs, "path", "text").select("file_path", "chunk_index", "chunk_id", "level", F.array_join("heading_hierarchy", " > ").alias("path"), F.md5("text").alias("text"))


@query
def frontmatter(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "documents").select("doc_id", F.explode(md.frontmatter(F.col("text"))).alias("e"))
    return rows.select("doc_id", "e.key", "e.kind", "e.value")


@query
def wikilinks(spark: SparkSession, folder: str) -> DataFrame:
    return chunk_rows(spark, folder).select("chunk_id", F.explode(md.wikilinks(F.col("text"))).alias("target"))


@query
def mdlinks(spark: SparkSession, folder: str) -> DataFrame:
    rows = chunk_rows(spark, folder).select("chunk_id", F.posexplode(md.markdown_links(F.col("text"))).alias("i", "l"))
    return rows.select("chunk_id", "i", F.col("l.text").alias("label"), F.col("l.url").alias("url"))


@query
def tags(spark: SparkSession, folder: str) -> DataFrame:
    return chunk_rows(spark, folder).select("chunk_id", F.explode(md.tags(F.col("text"))).alias("tag"))


@query
def headings(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "documents").select("doc_id", F.posexplode(md.headings(F.col("text"))).alias("i", "h"))
    return rows.select("doc_id", "i", F.col("h.level").alias("level"), F.col("h.text").alias("heading"))


@query
def parent_headings(spark: SparkSession, folder: str) -> DataFrame:
    heads = read(spark, folder, "documents").select("doc_id", md.headings(F.col("text")).alias("h"))
    rows = heads.select("doc_id", F.explode(md.heading_parents(F.col("h"))).alias("p"))
    return rows.select("doc_id", "p.parent", "p.child").groupBy("doc_id", "parent", "child").agg(F.count("*").alias("n"))


@query
def structural_entities(spark: SparkSession, folder: str) -> DataFrame:
    rows = extraction.structural_entities(chunk_rows(spark, folder), ["chunk_id"], "text")
    return rows.groupBy("type", "name").agg(F.count("*").alias("n"))


@query
def structural_relations(spark: SparkSession, folder: str) -> DataFrame:
    rows = extraction.structural_relations(read(spark, folder, "documents"), ["doc_id"], "text", "file_path")
    return rows.groupBy("source_id", "target_id", "relation_type", "weight").agg(F.count("*").alias("n"))


@query
def title_from_content(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").select("doc_id", md.title(F.col("text"), F.col("file_path")).alias("title"), F.md5("text").alias("checksum"))


@query
def exclude_globs(spark: SparkSession, folder: str) -> DataFrame:
    paths = read(spark, folder, "files").select("file_path").filter("file_path is not null").distinct()
    relative = F.regexp_replace("file_path", "^/vault/", "")
    patterns = ["drafts/", "**/link-*.md", "*-failure-*", "people/**", "how-to/?ypothesis*"]
    return paths.select("file_path", excluded(relative, patterns).alias("excluded"))


# -- acronyms


def _captured_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts (doc, text) of all documents and chunks, as captured."""
    docs = read(spark, folder, "documents").select(F.concat(F.lit("document:"), "doc_id").alias("doc"), "text")
    return docs.unionByName(chunk_rows(spark, folder).select(F.concat(F.lit("chunk:"), "chunk_id").alias("doc"), "text"))


@query
def acronyms(spark: SparkSession, folder: str) -> DataFrame:
    rows = _captured_texts(spark, folder).select("doc", F.explode(extraction.acronyms(F.col("text"))).alias("x"))
    return rows.select("doc", "x.acronym", "x.expansion")


@query
def acronym_dict(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.acronym_dictionary(_captured_texts(spark, folder), "doc", "text").select("acronym", "expansion", "ord")


@query
def expand_query(spark: SparkSession, folder: str) -> DataFrame:
    """Titles of the documents whose id is divisible by 20, and for each acronym a query that has it and words one edit away."""
    dictionary = materialize(extraction.acronym_dictionary(_captured_texts(spark, folder), "doc", "text"), "acronyms")
    own = dictionary.select((-F.col("ord") - 1).alias("query_id"), F.concat(F.lit("about "), F.lower("acronym"), F.lit(" and "), "acronym", F.lit("x or about Zz")).alias("query"))
    return extraction.expand_queries(titles(spark, folder).unionByName(own), "query_id", "query", dictionary)


# -- graph


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.upsert_edges(read(spark, folder, "edges"), "edge_id")


@query
def edges_upsert(spark: SparkSession, folder: str) -> DataFrame:
    return _edges(spark, folder)


@query
def edge_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _edges(spark, folder).groupBy("relation_type").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


@query
def node_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = _edges(spark, folder)
    nodes = rows.select(F.explode(F.array("source_id", "target_id")).alias("node")).distinct()
    return nodes.groupBy(graph.node_type(F.col("node")).alias("node_type")).agg(F.count("*").alias("n"))


@query
def edge_degree(spark: SparkSession, folder: str) -> DataFrame:
    return graph.incident(_edges(spark, folder)).groupBy("node").agg(F.count("*").alias("degree"))


def _seeds(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best chunks by semantic score of each logged query whose id is divisible by 20."""
    rows = _lists(spark, folder).filter("engine = 'semantic' and query_id % 20 = 0 and rank < 10")
    return rows.select("query_id", F.col("rank").alias("ord"), "chunk_id")


def _neighbours(spark: SparkSession, folder: str, hops: int) -> DataFrame:
    """Neighbourhoods of all ten seeds of each query."""
    seeds = _seeds(spark, folder).select(F.concat(F.lit("section:"), "chunk_id").alias("seed")).distinct()
    steps = graph.walk(seeds, "seed", _edges(spark, folder), hops)
    return steps.groupBy("seed", "neighbour", "relation_type").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


@query
def neighbors_1hop(spark: SparkSession, folder: str) -> DataFrame:
    return _neighbours(spark, folder, 1)


@query
def neighbors_2hop(spark: SparkSession, folder: str) -> DataFrame:
    return _neighbours(spark, folder, 2)


@query
def graph_search(spark: SparkSession, folder: str) -> DataFrame:
    rows = graph.graph_search(_seeds(spark, folder), _edges(spark, folder))
    return rows.select("query_id", "chunk_id", F.round("score", 6).alias("score"))


def _gone(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of files that the last scan does not hold."""
    files = read(spark, folder, "files")
    last = files.agg(F.max("scan_id").alias("scan_id"))
    there = files.join(F.broadcast(last), "scan_id").select("file_path").distinct()  # one row
    return chunk_rows(spark, folder).join(there, "file_path", "left_anti").select("chunk_id")


@query
def provenance_delete(spark: SparkSession, folder: str) -> DataFrame:
    provenance = read(spark, folder, "edge_provenance").select("source_id", "target_id", "relation_type", "chunk_id").distinct()
    return graph.delete_by_chunks(_edges(spark, folder), provenance, _gone(spark, folder))[0]


@query
def delete_cascade(spark: SparkSession, folder: str) -> DataFrame:
    rows = _edges(spark, folder)
    nodes = rows.select(F.explode(F.array("source_id", "target_id")).alias("node_id")).distinct()
    ids = _gone(spark, folder).select(F.concat(F.lit("section:"), "chunk_id").alias("node_id"))
    left, edges = graph.delete_nodes(nodes, rows, ids)
    none = F.lit(None).cast("string")
    return left.select(F.lit("node").alias("what"), F.col("node_id").alias("a"), none.alias("b"), none.alias("c")).unionByName(
        edges.select(F.lit("edge").alias("what"), F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.col("relation_type").alias("c"))
    )


@query
def cooccur_pairs(spark: SparkSession, folder: str) -> DataFrame:
    rows = extraction.structural_entities(chunk_rows(spark, folder), ["chunk_id"], "text").filter("type <> 'tag'")
    named = rows.select("chunk_id", "ord", F.concat(F.lit("entity:"), "type", F.lit(":"), "name").alias("entity"))
    return graph.cooccurrences(named)[1]


@query
def parent_edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.section_parents(chunk_rows(spark, folder))


# -- files and index


def _scan_pairs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Snapshots (scan_id, file_path, checksum) of all scans but the first, and of the scan before each."""
    rows = read(spark, folder, "files").filter("scan_id is not null and file_path is not null")
    best = rows.groupBy("scan_id", "file_path").agg(F.max(F.struct("last_modified", F.lower("checksum").alias("c"))).alias("s"))
    snapshots = best.select("scan_id", "file_path", F.col("s.c").alias("checksum"))
    near = Window.orderBy("scan_id")  # a row per scan
    scans = rows.select("scan_id").distinct().select("scan_id", F.lag("scan_id").over(near).alias("before"))
    pairs = F.broadcast(scans.filter("before is not null"))
    current = snapshots.join(pairs.select("scan_id"), "scan_id")
    before = snapshots.withColumnRenamed("scan_id", "before").join(pairs, "before").drop("before")
    return current.select("scan_id", "file_path", "checksum"), before.select("scan_id", "file_path", "checksum")


@query
def file_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Every scan against the one before."""
    return diff.file_diff(*_scan_pairs(spark, folder), ["scan_id"])


@query
def moved_files(spark: SparkSession, folder: str) -> DataFrame:
    return diff.moves(*_scan_pairs(spark, folder), ["scan_id"])


@query
def removed_paths(spark: SparkSession, folder: str) -> DataFrame:
    return diff.paths_to_remove(diff.file_diff(*_scan_pairs(spark, folder), ["scan_id"]), ["scan_id"])


def _latest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (chunk_id, embedding): the latest embedding of finite components of each chunk, of any length."""
    vectors = read(spark, folder, "vectors").filter("chunk_id is not null and embedding is not null and forall(embedding, x -> not isnan(x) and abs(x) < float('inf'))")
    latest = vectors.groupBy("chunk_id").agg(F.max(F.struct("embedded_at", "embedding")).alias("s"))
    return latest.select("chunk_id", F.col("s.embedding").alias("embedding"))


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes that the edges name."""
    ids = _edges(spark, folder).select(F.explode(F.array("source_id", "target_id")).alias("node_id")).distinct()
    return ids.select("node_id", graph.node_type(F.col("node_id")).alias("node_type"), F.lit("").alias("name"), F.expr("cast(map() as map<string,string>)").alias("properties"))


def _snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """One row per scan and path, the latest, all columns."""
    rows = read(spark, folder, "files").filter("scan_id is not null and file_path is not null")
    best = rows.groupBy("scan_id", "file_path").agg(F.max(F.struct("last_modified", F.lower("checksum").alias("checksum"), "title", "size_bytes")).alias("s"))
    return best.select("scan_id", "file_path", "s.title", "s.last_modified", "s.size_bytes", "s.checksum")


_STORES: dict[tuple[str, str], IndexStore] = {}


def _store(spark: SparkSession, folder: str) -> IndexStore:
    """A new index over the given tables, in the scratch folder."""
    store = IndexStore(spark, scratch_path(spark, "index"))
    with store.transaction():
        store.upsert("chunks", read(spark, folder, "chunks").filter("text is not null"))
        store.add_vectors(_latest_vectors(spark, folder))
        store.replace("edges", _edges(spark, folder))
    return store


def _indexed(spark: SparkSession, folder: str) -> IndexStore:
    """The index over the given tables, built once in a session, as an index is, and searched often."""
    at = spark.sparkContext.applicationId, folder
    if at not in _STORES or not _STORES[at].exists("chunks"):
        _STORES[at] = _store(spark, folder)
    return _STORES[at]


@query
def store_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors through the store: those of another dimension are left out, stored ones stay unless replaced."""
    store = IndexStore(spark, scratch_path(spark, "index"))
    rows = _latest_vectors(spark, folder)
    doubled = rows.select("chunk_id", F.transform("embedding", lambda x: x * 2).alias("embedding"))
    store.add_vectors(rows.filter("chunk_id < '8'"))
    store.add_vectors(doubled.filter("chunk_id >= '4'"))
    store.add_vectors(rows.filter("chunk_id >= 'c'"), replace=True)
    store.delete("vectors", rows.filter("chunk_id >= 'e'").select("chunk_id"))
    sums = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return store.read("vectors").select("chunk_id", F.size("embedding").alias("dim"), F.round(sums, 4).alias("total"))


@query
def store_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every scan in turn upserted into the files of a store, with the paths that the last scan lacks deleted."""
    store = IndexStore(spark, scratch_path(spark, "index"))
    rows = materialize(_snapshots(spark, folder), "snapshots")
    scans = [r[0] for r in rows.select("scan_id").distinct().orderBy("scan_id").collect()]  # a row per scan
    for scan in scans:
        store.upsert("files", rows.filter(F.col("scan_id") == scan).drop("scan_id"))
    if scans:
        store.delete("files", store.read("files").join(rows.filter(F.col("scan_id") == scans[-1]), "file_path", "left_anti").select("file_path"))
    return store.read("files").select("file_path", "title", "size_bytes", "checksum")


@query
def store_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks through the store: upserted twice, those of files that are gone deleted, ids by file."""
    store = IndexStore(spark, scratch_path(spark, "index"))
    store.upsert("chunks", read(spark, folder, "chunks"))
    store.upsert("chunks", chunk_rows(spark, folder).filter("level > 1"))
    store.delete("chunks", _gone(spark, folder))
    ids = store.chunk_ids_by_file()
    return ids.select("file_path", F.array_join("chunk_ids", ",").alias("ids"))


@query
def store_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges and their provenance through the store: upserted in two halves of the log, provenance appended."""
    store = IndexStore(spark, scratch_path(spark, "index"))
    log = read(spark, folder, "edges")
    middle = log.agg(F.percentile_approx("edge_id", 0.5)).first()[0] or 0  # one row
    provenance = read(spark, folder, "edge_provenance").filter("chunk_id is not null")
    for half in (log.filter(F.col("edge_id") <= middle), log.filter(F.col("edge_id") > middle)):
        store.upsert("edges", graph.upsert_edges(half, "edge_id"))
        store.append_new("edge_provenance", provenance)
    known = store.read("edge_provenance").groupBy(*graph.KEY).agg(F.count("*").alias("chunks"))
    return store.read("edges").join(known, graph.KEY, "left").select(*graph.KEY, "weight", F.coalesce("chunks", F.lit(0)).alias("chunks"))


@query
def index_stats(spark: SparkSession, folder: str) -> DataFrame:
    store = _store(spark, folder)
    store.upsert("files", _snapshots(spark, folder).drop("scan_id"))
    store.upsert("nodes", _nodes(spark, folder))
    return store.statistics()


@query
def nodes_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """File nodes of every scan as a log of upserts: the name is the title of the last."""
    rows = _snapshots(spark, folder)
    log = rows.select(F.concat(F.lit("file:"), "file_path").alias("node_id"), F.lit("file").alias("node_type"), F.col("title").alias("name"), "scan_id")
    return graph.upsert_nodes(log, "scan_id").select("node_id", "node_type", "name")


def _built(spark: SparkSession, folder: str) -> tuple[DataFrame, ...]:
    """The graph of all chunks and the files of the last scan."""
    rows = _snapshots(spark, folder)
    last = rows.agg(F.max("scan_id").alias("scan_id"))
    files = rows.join(F.broadcast(last), "scan_id").select("file_path", "title", "checksum", F.lit("").alias("content"))  # one row
    return indexing.build_graph(chunk_rows(spark, folder).filter("text is not null"), files, None, None)


@query
def graph_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return _built(spark, folder)[0].select("node_id", "node_type", "name", F.element_at("properties", "entity_type").alias("entity_type"), F.element_at("properties", "level").alias("level"))


@query
def graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    return _built(spark, folder)[1]


@query
def heading_terms(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "documents").select("doc_id", F.posexplode(extraction.heading_terms(F.col("text"))).alias("i", "t"))
    return rows.select("doc_id", "i", "t.name", "t.type", "t.source")


def shape_entities(texts: list[str]) -> list[list[tuple[str, str]]]:
    """A recogniser by shape, for the check of what is done with labels: capitalised words, labelled by their length."""
    return [[(("PER", "ORG", "LOC", "XYZ")[len(w) % 4], w) for w in re.findall(r"[A-Z][a-z]+", t)] for t in texts]


@query
def named_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Labels mapped to kinds, kinds not allowed left out, distinct per chunk."""
    found = models.named_entities(chunk_rows(spark, folder), "chunk_id", "text", shape_entities, ("person", "organization", "concept"))
    return found.select("chunk_id", "type", "name")


def length_scores(queries: list[str], texts: list[str]) -> list[float]:
    """A reranker by length, for the check of what is done with scores."""
    return [float(len(t) * 7 % 23 - 12) for t in texts]


@query
def rerank_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """The pool of each query scored by a model over text and query, short texts scaled down, low scores left out, blended."""
    fused = materialize(fusion.weighted_rrf(_lists(spark, folder).withColumn("weight", F.lit(1.0)), "query_id", "chunk_id"), "fused")
    asked = fused.select("query_id").distinct().withColumn("query", F.lit("q"))
    second = searching.rerank_pool(fused, asked, chunk_rows(spark, folder).select("chunk_id", "text"), length_scores, searching.Settings())
    return fusion.blend(fused, second, "query_id", "chunk_id").select("query_id", "chunk_id", F.round("blended", 6).alias("blended"))


def length_embedder(texts: list[str]) -> list[list[float]]:
    """An embedder by length, for the check of what is done with vectors."""
    return [[float(len(t) * (i + 1) % 97 - 48) for i in range(384)] for t in texts]


def _search(spark: SparkSession, folder: str, mode: str, seed: str = "bm25") -> DataFrame:
    found = searching.search(_indexed(spark, folder), titles(spark, folder), mode=mode, graph_seed=seed, embedder=length_embedder)
    scores = [F.round(f"{e}_score", 5).alias(f"{e}_score") for e in ("fused", "semantic", "bm25", "graph")]
    return found.select("query_id", "chunk_id", "place", "file_path", "heading_path", F.array_join("matched_engines", ",").alias("engines"), *scores)


@query
def search_semantic(spark: SparkSession, folder: str) -> DataFrame:
    return _search(spark, folder, "semantic")


@query
def search_bm25(spark: SparkSession, folder: str) -> DataFrame:
    return _search(spark, folder, "bm25")


@query
def search_graph(spark: SparkSession, folder: str) -> DataFrame:
    return _search(spark, folder, "graph")


@query
def search_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    return _search(spark, folder, "hybrid")


@query
def search_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Formatted results of the BM25 search, not reranked."""
    found = searching.search(_indexed(spark, folder), titles(spark, folder), mode="bm25", rerank=False)
    return searching.format_results(found).select("query_id", "place", "line")
