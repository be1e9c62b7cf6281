"""Schemas of the index tables."""

CHUNKS = "chunk_id string, file_path string, heading_hierarchy array<string>, level int, text string, chunk_index int, char_offset int"
FILES = "file_path string, title string, last_modified timestamp, size_bytes bigint, checksum string"
NODES = "node_id string, node_type string, name string, properties map<string,string>"
EDGES = "source_id string, target_id string, relation_type string, weight double"
PROVENANCE = "source_id string, target_id string, relation_type string, chunk_id string"
VECTORS = "chunk_id string, embedding array<float>"
POSTINGS = "chunk_id string, terms array<string>, tfs array<bigint>, len bigint"
IDF = "term string, df bigint, idf double"
ACRONYMS = "acronym string, expansion string, ord bigint"
STATS = "total_files bigint, total_chunks bigint, total_entities bigint, total_edges bigint, last_indexed timestamp"
TABLES = {
    "chunks": CHUNKS, "files": FILES, "nodes": NODES, "edges": EDGES, "edge_provenance": PROVENANCE, "vectors": VECTORS,
    "postings": POSTINGS, "idf": IDF, "acronyms": ACRONYMS, "stats": STATS,
}
