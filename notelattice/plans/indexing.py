"""Building and updating an index from files: difference, chunks, vectors, graph, postings, statistics."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelattice.config import Settings, assert_writable
from notelattice.functions import models
from notelattice.functions.noise import NoiseWords, of_settings
from notelattice.operators import bm25, diff, extraction, graph
from notelattice.operators import markdown as md
from notelattice.session import materialize, scratch_scope
from notelattice.sources.index_store import IndexStore
from notelattice.sources.markdown_dir import read_markdown

EMPTY_MAP = "cast(map() as map<string,string>)"


@dataclass
class IndexingResult:
    files_processed: int = 0
    chunks_created: int = 0
    entities_extracted: int = 0
    edges_created: int = 0
    duration_ms: int = 0


def _node(node_id, kind: str, name, order: int, properties=None) -> list:
    return [node_id.alias("node_id"), F.lit(kind).alias("node_type"), name.alias("name"), (properties if properties is not None else F.expr(EMPTY_MAP)).alias("properties"), F.lit(order).alias("phase")]


def build_graph(chunks: DataFrame, files: DataFrame, ner: DataFrame | None, keyterms: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, provenance, counts) of new chunks and files (file_path, title, checksum, content).

    Writers are ordered by phase: file nodes, sections, structure of chunks, relations of files, named
    entities, key terms, heading parents, co-occurrences; the last writer of a node or edge wins.
    ``counts`` has one row: entities extracted and edges created, repeats included.
    """
    section = F.concat(F.lit("section:"), "chunk_id")
    own = extraction.structural_entities(chunks, ["chunk_id"], "text").withColumn("phase", F.lit(3))
    entities = own
    if ner is not None:
        entities = entities.unionByName(ner.select("chunk_id", "ord", "name", "type", F.lit("ner").alias("source"), F.lit(5).alias("phase")))
    if keyterms is not None:
        entities = entities.unionByName(keyterms.select("chunk_id", "ord", "name", F.lit("keyterm").alias("type"), F.lit("keyterm").alias("source"), F.lit(6).alias("phase")))
    is_tag = F.col("type") == "tag"
    entities = materialize(entities.withColumn("node", F.when(is_tag, F.concat(F.lit("tag:"), "name")).otherwise(F.concat(F.lit("entity:"), "type", F.lit(":"), "name"))), "entities")

    relations = extraction.structural_relations(files, ["file_path"], "content", "file_path").filter("relation_type <> 'PARENT_OF'")
    kind = F.when(F.col("relation_type") == "HAS_TAG", "tag:").when(F.col("relation_type") == "LINKS_TO", "entity:concept:").otherwise("entity:metadata:")
    relations = relations.withColumn("node", F.concat(kind, "target_id"))

    heading = F.coalesce(F.try_element_at("heading_hierarchy", F.lit(-1)), F.lit(""))
    about = F.create_map(F.lit("level"), F.col("level").cast("string"), F.lit("file_path"), F.col("file_path"), F.lit("text_preview"), F.substring("text", 1, 200))
    of_node = F.create_map(F.lit("entity_type"), F.col("type"), F.lit("source"), F.col("source"))
    nodes = (
        files.select(*_node(F.concat(F.lit("file:"), "file_path"), "file", F.col("title"), 1, F.create_map(F.lit("checksum"), F.col("checksum"))))
        .unionByName(chunks.select(*_node(section, "section", heading, 2, about)))
        .unionByName(entities.filter(is_tag).select(*_node(F.col("node"), "tag", F.col("name"), 3)))
        .unionByName(entities.filter(~is_tag).select(F.col("node").alias("node_id"), F.lit("entity").alias("node_type"), "name", of_node.alias("properties"), "phase"))
        .unionByName(relations.select(F.col("node").alias("node_id"), F.substring_index("node", ":", 1).alias("node_type"), F.col("target_id").alias("name"), F.expr(EMPTY_MAP).alias("properties"), F.lit(4).alias("phase")))
    )
    nodes = graph.upsert_nodes(nodes, "phase")

    relation = F.when(is_tag, "HAS_TAG").when((F.col("type") == "concept") & (F.col("phase") == 3), "LINKS_TO").otherwise("MENTIONS")
    weight = F.when(F.col("phase") == 6, 0.8).otherwise(1.0)
    edge = lambda s, t, r, w, phase, ord_: [s.alias("source_id"), t.alias("target_id"), r.alias("relation_type"), w.alias("weight"), F.struct(phase.alias("phase"), ord_.cast("int").alias("ord")).alias("at")]
    parents = graph.section_parents(chunks)
    pairs, provenance = graph.cooccurrences(entities.filter(~is_tag).select("chunk_id", F.struct("phase", "ord").alias("ord"), F.col("node").alias("entity")))
    provenance = materialize(provenance, "provenance")
    counted = (
        entities.select(*edge(section, F.col("node"), relation, weight, F.col("phase"), F.col("ord")))
        .unionByName(relations.select(*edge(F.concat(F.lit("file:"), "file_path"), F.col("node"), F.col("relation_type"), F.col("weight"), F.lit(4), F.col("ord"))))
        .unionByName(parents.select(*edge(F.col("source_id"), F.col("target_id"), F.col("relation_type"), F.col("weight"), F.lit(7), F.lit(0))))
    )
    counted = materialize(counted, "edges")
    contains = chunks.select(*edge(F.concat(F.lit("file:"), "file_path"), section, F.lit("CONTAINS"), F.lit(1.0), F.lit(2), F.lit(0)))
    linked = provenance.select(*graph.KEY).distinct().select(*edge(F.col("source_id"), F.col("target_id"), F.col("relation_type"), F.lit(0.5), F.lit(8), F.lit(0)))
    edges = graph.upsert_edges(counted.unionByName(contains).unionByName(linked), "at")
    one = lambda df, name: df.agg(F.count("*").alias(name))
    counts = one(entities, "entities").crossJoin(one(counted, "a")).crossJoin(one(provenance, "b")).select("entities", (F.col("a") + F.col("b")).alias("edges"))
    return nodes, edges, provenance, counts


def index_directory(
    spark: SparkSession,
    store: IndexStore,
    root: str,
    exclude: list[str] | None = None,
    rebuild: bool = False,
    depth: str | None = None,
    embedder: models.Embedder | None = None,
    recogniser: models.Recogniser | None = None,
    noise: NoiseWords | None = None,
    progress=None,
) -> IndexingResult:
    """Bring an index up to date with a directory; files of the index that this walk does not see are removed.

    ``depth`` ``structural`` leaves out named entities and key terms. ``progress`` is called with the name of
    each phase. All tables change in one transaction: a run that dies leaves the index as it was, and the
    next run finds the same files new, changed or gone. Models that are not passed are those of ``set_hook``, noise
    words those of the settings.
    """
    assert_writable("index", store.settings)
    own = store.settings
    embedder, recogniser = embedder or models.get_hook("embedder"), recogniser or models.get_hook("recogniser")
    noise = noise or of_settings(own.stop_words_file, own.skip_upper_file)
    with scratch_scope(), store.transaction():
        return _index(spark, store, root, exclude, rebuild, depth or store.settings.extract_depth, embedder, recogniser, noise, progress or (lambda phase: None))


def _index(spark: SparkSession, store: IndexStore, root: str, exclude, rebuild: bool, depth: str, embedder, recogniser, noise: NoiseWords, tell) -> IndexingResult:
    settings: Settings = store.settings
    began = time.time()
    if rebuild:
        store.clear()
    tell("discovering")
    found = materialize(read_markdown(spark, root, exclude), "found")
    changes = materialize(diff.file_diff(found, store.read("files")), "changes")
    gone = materialize(diff.paths_to_remove(changes), "gone")
    wanted = diff.paths_to_index(changes)
    if gone.isEmpty() and wanted.isEmpty():
        return IndexingResult(duration_ms=int((time.time() - began) * 1000))

    ids = materialize(store.read("chunks").join(gone, "file_path", "left_semi").select("chunk_id", "file_path"), "removed")
    if not ids.isEmpty():
        node_ids = ids.select(F.concat(F.lit("section:"), "chunk_id").alias("node_id")).unionByName(ids.select(F.concat(F.lit("file:"), "file_path").alias("node_id")))
        nodes, edges = graph.delete_nodes(store.read("nodes"), store.read("edges"), node_ids)
        edges, provenance = graph.delete_by_chunks(materialize(edges, "kept"), store.read("edge_provenance"), ids)
        edges, provenance = materialize(edges, "kept"), materialize(provenance, "kept")
        store.replace("nodes", materialize(nodes, "kept"))
        store.replace("edges", edges)
        store.replace("edge_provenance", provenance)
        store.delete("chunks", ids.select("chunk_id"))
        store.delete("vectors", ids.select("chunk_id"))
    store.delete("files", gone)

    tell("chunking")
    files = materialize(found.join(wanted, "file_path", "left_semi"), "files")
    chunks = materialize(md.chunks(files, "file_path", "content", settings.max_chunk_tokens, settings.chunk_overlap_tokens), "chunks")
    tell("embedding")
    vectors = chunks.select("chunk_id", models.embed(F.col("text"), embedder or models.hashing_embedder(settings.embedding_dim)).alias("embedding")).filter("embedding is not null")
    tell("storing")
    store.add_vectors(materialize(vectors, "vectors"))
    store.upsert("files", files)
    store.upsert("chunks", chunks)

    tell("extracting")
    ner = terms = None
    if depth == "ner":
        ner = models.named_entities(chunks, "chunk_id", "text", recogniser, settings.ner_entity_types)
        corpus = materialize(extraction.term_rows(store.read("chunks"), "chunk_id", "text", noise), "terms")
        total = store.read("chunks").agg(F.count("*").alias("n"))
        own = materialize(corpus.join(chunks.select("chunk_id"), "chunk_id", "left_semi"), "terms")
        terms = extraction.key_terms(chunks, "chunk_id", "text", materialize(extraction.document_frequencies(corpus), "frequencies"), total, noise, rows=own)
    nodes, edges, provenance, counts = build_graph(chunks, files, ner, terms)
    nodes, edges, provenance = materialize(nodes, "nodes"), materialize(edges, "edges"), materialize(provenance, "provenance")
    store.upsert("nodes", nodes)
    store.upsert("edges", edges)
    store.append_new("edge_provenance", provenance)
    row = counts.first()

    every = store.read("chunks")
    dictionary = extraction.acronym_dictionary(every.withColumn("at", F.struct("file_path", "chunk_index", "chunk_id")), "at", "text", noise)
    store.replace("acronyms", dictionary)
    index = bm25.build_index(every, "chunk_id", "text", noise)
    for name, rows in (("postings", index.packed), ("idf", index.idf)):
        store.replace(name, rows)
    stats = store.statistics().select("total_files", "total_chunks", "total_entities", "total_edges", F.current_timestamp().alias("last_indexed"))
    store.replace("stats", stats)
    return IndexingResult(files.count(), chunks.count(), row["entities"], row["edges"], int((time.time() - began) * 1000))
