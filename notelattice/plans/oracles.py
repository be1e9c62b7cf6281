"""SQL of the queries of the reference operators."""

# Fixed values, stated here on their own so that a change of the engine's list shows: the common English stop words, and capitals that are no acronyms.
_STOP = (
    "a about above after again against ain all am an and any are aren as at be because been before being below between both but by can couldn d did didn "
    "do does doesn doing don down during each few for from further had hadn has hasn have haven having he her here hers herself him himself his how i if "
    "in into is isn it its itself just ll m ma me mightn more most mustn my myself needn no nor not now o of off on once only or other our ours ourselves "
    "out over own re s same shan she should shouldn so some such t than that the their theirs them themselves then there these they this those through to "
    "too under until up ve very was wasn we were weren what when where which while who whom why will with won wouldn y you your yours yourself yourselves"
).split()
_UPPER = [w.upper() for w in _STOP] + (
    "CSS DIV DOM EOF FIG GIT HEX IMG INT LOG MAX MIN MOD MUT NIL NUL OBJ OPT PNG PRE PTR RAW REF REL RES RET ROW SRC STD STR SUB SUM SVG TAB TAG "
    "TMP URL VAL VAR XML EG IE VS OK NA NB PS FYI TBD TBA WIP FAQ KB MB GB TB MS NS HZ MHZ GHZ"
).split()

_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_WS = r"[\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_WS_IN_LINE = _WS.replace(r"\n", "")
_trim = lambda x: f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"
_noise = lambda w: f"({w} = '' OR list_contains({_LIST(_STOP)}, {w}) OR regexp_full_match({w}, '[0-9a-f]{{3,8}}'))"
_raw = lambda t: f"regexp_extract_all(lower(coalesce({t}, '')), '[a-z0-9_]+')"
_tok = lambda t: f"list_filter({_raw(t)}, lambda w: NOT {_noise('w')})"
_title = r"""CASE WHEN {0} <> '' THEN {0} ELSE regexp_replace(list_last(string_split(file_path, '/')), '\.md$', '') END""".format(
    _trim(r"regexp_extract(coalesce(text, ''), '(?m)^#[\t\n\x0b\f\r ]+([^\r\n]+)\r?$', 1)")
)

_CHUNKS = "WITH c AS (SELECT DISTINCT * FROM chunks)\n"
_TITLES = f", asked AS (SELECT doc_id AS query_id, {_title} AS query FROM documents WHERE doc_id % 20 = 0)\n"
_INDEX = f"""
WITH c AS (SELECT DISTINCT * FROM chunks),
words AS (SELECT chunk_id, {_tok('text')} AS w FROM c),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(w) AS term FROM words) GROUP BY ALL),
len AS (SELECT chunk_id, len(w) AS len FROM words),
n AS (SELECT count(*) AS n, avg(len) AS mean FROM len),
idf AS (SELECT term, count(*) AS df, ln((max(n) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM tf, n GROUP BY term)
"""
_BM25 = (
    _INDEX
    + _TITLES
    + f""", q AS (SELECT query_id, unnest({_tok('query')}) AS term FROM asked),
score AS (SELECT query_id, chunk_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))), 9) AS score
  FROM q JOIN idf USING (term) JOIN tf USING (term) JOIN len USING (chunk_id), n GROUP BY query_id, chunk_id HAVING score > 0)
"""
)
_TERMS = f"""
WITH c AS (SELECT DISTINCT * FROM chunks), d AS (SELECT chunk_id, text, list_filter({_tok('text')}, lambda w: length(w) >= 3) AS w FROM c WHERE text IS NOT NULL),
g AS (SELECT chunk_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS term
  FROM (SELECT chunk_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (VALUES (1), (2), (3)) AS t(k) WHERE len(w) >= k)),
tf AS (SELECT chunk_id, term, count(*) AS tf, min(k::BIGINT * 1000000000 + i) AS first FROM g GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
n AS (SELECT count(*) AS n FROM d)
"""
_BEST_TERMS = _TERMS + """, best AS (SELECT chunk_id, term, round(tf * ln(n / df), 9) AS score FROM tf JOIN df USING (term), n
  QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY round(tf * ln(n / df), 9) DESC, first) <= 10)
"""
_NEAR = """
WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS cosine
  FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0),
"""
_RANKED = """
WITH long AS (
  SELECT query_id, chunk_id, 0 AS list_idx, 'semantic' AS engine, semantic_score AS score FROM search_results
  UNION ALL SELECT query_id, chunk_id, 1, 'bm25', bm25_score FROM search_results UNION ALL SELECT query_id, chunk_id, 2, 'graph', graph_score FROM search_results),
best AS (SELECT query_id, list_idx, engine, chunk_id, max(score) AS score FROM long WHERE score IS NOT NULL AND NOT isnan(score) AND score >= 0 GROUP BY ALL),
l AS (SELECT *, row_number() OVER (PARTITION BY query_id, engine ORDER BY score DESC, chunk_id) - 1 AS rank FROM best)
"""
_FUSED = _RANKED + """, f AS (SELECT query_id, chunk_id, round(sum(CASE engine WHEN 'graph' THEN 1.5 ELSE 1 END / (60.0::DOUBLE + rank + 1)), 9) AS score,
  string_agg(engine, ',' ORDER BY list_idx) AS engines FROM l GROUP BY query_id, chunk_id)
"""
_EDGES = """e AS (SELECT source_id, target_id, relation_type, weight FROM edges QUALIFY row_number() OVER (PARTITION BY source_id, target_id, relation_type ORDER BY edge_id DESC) = 1),
inc AS (SELECT source_id AS node, target_id AS neighbour, relation_type, weight FROM e UNION ALL
  SELECT target_id, source_id, relation_type, weight FROM e WHERE source_id <> target_id)
"""
_SEEDS = _RANKED + ", seeds AS (SELECT query_id, rank AS ord, 'section:' || chunk_id AS node FROM l WHERE engine = 'semantic' AND query_id % 20 = 0 AND rank < 10), " + _EDGES
_GONE = "gone AS (SELECT DISTINCT chunk_id FROM chunks WHERE file_path NOT IN (SELECT file_path FROM files WHERE scan_id = (SELECT max(scan_id) FROM files) AND file_path IS NOT NULL))"
_SNAPSHOTS = """s AS (SELECT scan_id, file_path, title, last_modified, size_bytes, lower(checksum) AS checksum FROM files WHERE file_path IS NOT NULL AND scan_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY scan_id, file_path ORDER BY last_modified DESC NULLS LAST, lower(checksum) DESC NULLS LAST, title DESC NULLS LAST, size_bytes DESC NULLS LAST) = 1)"""
_SCANS = f"""
WITH {_SNAPSHOTS},
near AS (SELECT scan_id, lag(scan_id) OVER (ORDER BY scan_id) AS before FROM (SELECT DISTINCT scan_id FROM s)),
cur AS (SELECT scan_id, file_path, checksum FROM s JOIN near USING (scan_id) WHERE before IS NOT NULL),
old AS (SELECT near.scan_id, file_path, checksum FROM s JOIN near ON s.scan_id = near.before),
d AS (SELECT coalesce(cur.scan_id, old.scan_id) AS scan_id, coalesce(cur.file_path, old.file_path) AS file_path, coalesce(cur.checksum, old.checksum) AS checksum,
  CASE WHEN cur.file_path IS NULL THEN 'gone' WHEN old.file_path IS NULL THEN 'new' WHEN cur.checksum IS NOT DISTINCT FROM old.checksum THEN 'unchanged' ELSE 'changed' END AS st
  FROM cur FULL JOIN old ON cur.file_path = old.file_path AND cur.scan_id = old.scan_id),
diff AS (SELECT scan_id, file_path, checksum, CASE WHEN st <> 'gone' THEN st WHEN (scan_id, checksum) IN (SELECT (scan_id, checksum) FROM d WHERE st = 'new' AND checksum IS NOT NULL) THEN 'moved' ELSE 'deleted' END AS status FROM d)
"""
_VECTORS = """lv AS (SELECT chunk_id, embedding FROM vectors WHERE chunk_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
  QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY embedded_at DESC NULLS LAST, embedding DESC) = 1)"""
_SHAPES = (
    (r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\s*\(([A-Z]{2,})\)", 2, 1),
    (r"([A-Z]{2,})\s*\(([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\)", 1, 2),
    (r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\s*[-—]\s*([A-Z]{2,})", 2, 1),
)
_ACRONYMS = """
WITH t AS (SELECT 'document:' || doc_id AS doc, text FROM documents WHERE text IS NOT NULL UNION ALL
  SELECT 'chunk:' || chunk_id, text FROM (SELECT DISTINCT * FROM chunks) WHERE text IS NOT NULL),
""" + f"""m AS ({" UNION ALL ".join(
    f"SELECT doc, {s} AS s, unnest(range(len(regexp_extract_all(text, '{p}', {a})))) AS i, unnest(regexp_extract_all(text, '{p}', {a})) AS x, unnest(regexp_extract_all(text, '{p}', {b})) AS y FROM t"
    for s, (p, a, b) in enumerate(_SHAPES))}),
a AS (SELECT doc, s, i, x AS acronym, trim(y) AS expansion FROM m WHERE NOT list_contains({_LIST(_UPPER)}, x) AND NOT {_noise("lower(x)")})
"""
_DICTIONARY = (
    _ACRONYMS
    + """, per AS (SELECT doc, acronym, arg_max(expansion, row(s, i)) AS expansion, min(row(s, i)) AS i FROM a GROUP BY doc, acronym),
dict AS (SELECT acronym, arg_min(expansion, row(-length(expansion), doc)) AS expansion, row_number() OVER (ORDER BY min(row(doc, i)), acronym) - 1 AS ord FROM per GROUP BY acronym)
"""
)

_H = r"(?m)^(#{1,6})[\t\n\f\r ]+([^\r\n]+)\r?$"
_FM = r"^---\n((?s:.*?))\n---\n((?s:.+))$"
_BODY = f"CASE WHEN regexp_extract(text, '{_FM}', 1) <> '' THEN regexp_extract(text, '{_FM}', 2) ELSE text END"
_WIKI = r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"
_LINK = r"\[([^\]]+)\]\(([^)]+)\)"
_heads = lambda src: f"""SELECT k, unnest(range(len(l))) AS i, unnest(l) AS level, unnest(h) AS heading FROM (
  SELECT k, list_transform(regexp_extract_all(text, '{_H}', 1), lambda x: length(x)) AS l, list_transform(regexp_extract_all(text, '{_H}', 2), lambda x: {_trim('x')}) AS h FROM ({src}))"""  # noqa: E731
_FRONT = f"""
fl AS (SELECT k, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM (SELECT k, string_split(regexp_extract(text, '{_FM}', 1), chr(10)) AS ls FROM src)),
fe AS (SELECT k, i, {_trim("line[: instr(line, ':') - 1]")} AS key, {_trim("line[instr(line, ':') + 1 :]")} AS raw FROM fl WHERE instr(line, ':') > 1),
fk AS (SELECT k, key, CASE WHEN raw[1:1] IN ('[', '{{') THEN CASE WHEN try_cast(raw AS JSON) IS NOT NULL THEN 'json' ELSE 'string' END
    WHEN length(raw) > 1 AND raw[1:1] = '"' AND raw[-1:] = '"' THEN 'string' WHEN raw IN ('true', 'false') THEN 'boolean'
    WHEN regexp_full_match(raw, '|[+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?|0[xX][0-9a-fA-F]+|[+-]?Infinity') THEN 'number' ELSE 'string' END AS kind,
  CASE WHEN length(raw) > 1 AND raw[1:1] = '"' AND raw[-1:] = '"' THEN raw[2:-2] WHEN raw = '' THEN '0' ELSE raw END AS value
  FROM fe QUALIFY row_number() OVER (PARTITION BY k, key ORDER BY i DESC) = 1)"""
_structure = lambda src: f"""WITH src AS ({src}), b AS (SELECT k, p, {_BODY} AS text FROM src),
w AS (SELECT k, p, unnest(list_distinct(list_transform(regexp_extract_all(text, '{_WIKI}', 1), lambda x: {_trim('x')}))) AS name FROM b),
ln AS (SELECT k, p, unnest(list_transform(regexp_extract_all(text, '{_LINK}', 2), lambda x: {_trim('x')})) AS name FROM b),
tg AS (SELECT k, p, unnest(list_distinct(regexp_extract_all(text, '#([a-zA-Z0-9_-]+)', 1))) AS name FROM b),
h AS ({_heads('SELECT k, text FROM b')}),{_FRONT}
"""  # noqa: E731
_PARENT = """SELECT c.k, (SELECT p.heading FROM h p WHERE p.k = c.k AND p.i < c.i AND p.level = c.level - 1
    AND NOT EXISTS (SELECT 1 FROM h x WHERE x.k = c.k AND x.i > p.i AND x.i < c.i AND x.level < c.level - 1) ORDER BY p.i DESC LIMIT 1) AS parent, c.heading AS child FROM h c"""

ORACLES = {
    "tok_counts": _CHUNKS + f"SELECT chunk_id, len({_raw('text')}) AS raw, len({_tok('text')}) AS kept FROM c",
    "tokens_top": _CHUNKS + f"SELECT term, count(*) AS n FROM (SELECT unnest({_tok('text')}) AS term FROM c) GROUP BY term ORDER BY n DESC, term LIMIT 100",
    "estimate_tokens": _CHUNKS + "SELECT chunk_id, greatest(1, length(text) // 4)::INT AS tokens, CASE WHEN greatest(1, length(text) // 4) < 20 THEN 0.8 ELSE 1.0 END::DOUBLE AS penalty FROM c WHERE text IS NOT NULL UNION ALL SELECT chunk_id, 1, 0.8 FROM c WHERE text IS NULL",
    "clean_text": rf"SELECT doc_id, {_trim(f"regexp_replace(regexp_replace(text, '{_WS_IN_LINE}+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")} AS text FROM documents",
    "sentence_split": _CHUNKS
    + rf", s AS (SELECT chunk_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){_WS}+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: {_trim('x')}), lambda x: x <> '') AS s FROM c WHERE text IS NOT NULL) "
    + "SELECT chunk_id, unnest(range(len(s)))::INT AS i, unnest(s) AS sentence FROM s",
    "preprocess_query": f"SELECT doc_id, lower({_trim(f"regexp_replace(text, '{_WS}+', ' ', 'g')")}) AS query FROM documents",
    "query_analysis": rf"""WITH t AS (SELECT DISTINCT title AS q FROM files WHERE title IS NOT NULL),
d AS (SELECT q, {_tok('q')} AS w, regexp_extract_all(q, '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b') AS h FROM t),
u AS (SELECT q, list_filter(w, lambda x, i: list_position(w, x) = i) AS w, list_filter(h, lambda x, i: list_position(h, x) = i) AS h FROM d)
SELECT q, array_to_string(w, ' ') AS tokens, array_to_string(h, '|') AS hints, regexp_matches(q, '\b[A-Z]{{2,5}}\b') AS has_acronyms FROM u""",
    "snippets": _BM25
    + f""", top AS (SELECT query_id, chunk_id FROM score QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 3),
p AS (SELECT query_id, chunk_id, text, list_min(list_filter(list_transform({_tok('query')}, lambda x: instr(lower(text), x)), lambda x: x > 0)) AS pos FROM top JOIN asked USING (query_id) JOIN c USING (chunk_id))
SELECT query_id, chunk_id, CASE WHEN pos IS NULL THEN text[1:300] ELSE {_trim('substring(text, greatest(0, pos - 151) + 1, 300)')} END AS snippet FROM p""",
    "chunk_ids": _CHUNKS + "SELECT chunk_id, md5(file_path || ':' || chunk_index) AS derived FROM c",
    "tfidf_doc_topk": _BEST_TERMS + "SELECT chunk_id, term, round(score, 6) AS score FROM best",
    "tfidf_corpus_topk": _TERMS + "SELECT term, round(sum(tf) * ln(max(n) / count(*)), 6) AS score FROM tf, n GROUP BY term ORDER BY score DESC, term LIMIT 20",
    "keyterms": _BEST_TERMS
    + f", h AS ({_heads('SELECT chunk_id AS k, text FROM d')}) SELECT DISTINCT k AS chunk_id, name FROM (SELECT k, unnest(list_filter({_tok('heading')}, lambda w: length(w) >= 3)) AS name FROM h UNION ALL SELECT chunk_id, term FROM best)",
    "bm25_idf": _INDEX + "SELECT term, df, round(idf, 6) AS idf FROM idf",
    "bm25_doclen": _INDEX + "SELECT chunk_id, len FROM len",
    "bm25_postings": _INDEX + "SELECT term, chunk_id, tf FROM tf",
    "bm25_topk": _BM25 + "SELECT query_id, chunk_id, round(score, 6) AS score FROM score QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 10",
    "knn_cosine": _NEAR + "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS i FROM s) SELECT query_id, vec_id, round(cosine, 6) AS cosine FROM r WHERE i <= 10",
    "knn_floor_store": _NEAR + "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS i FROM s) SELECT query_id, vec_id, round((1 + cosine) / 2, 6) AS score FROM r WHERE i <= 10 AND (1 + cosine) / 2 >= 0.6",
    "knn_floor_brute": _NEAR + "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS i FROM s WHERE cosine >= 0.4) SELECT query_id, vec_id, round(cosine, 6) AS score FROM r WHERE i <= 10",
    "minmax_norm": _RANKED
    + """SELECT query_id, engine, chunk_id, round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS normalized
FROM l WINDOW w AS (PARTITION BY query_id, engine)""",
    "rrf": _RANKED + "SELECT query_id, chunk_id, round(round(sum(1 / (60.0::DOUBLE + rank + 1)), 9), 6) AS score, string_agg(engine, ',' ORDER BY list_idx) AS engines FROM l GROUP BY query_id, chunk_id",
    "weighted_rrf": _FUSED + "SELECT query_id, chunk_id, round(score, 6) AS score, engines FROM f",
    "blend_fallback": _FUSED
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM f),
b AS (SELECT *, CASE WHEN rank < 20 THEN 1 - rank * 0.01 END AS rr FROM r)
SELECT query_id, chunk_id, round(round(0.4 * score / greatest(max(score) OVER w, 1) + 0.6 * coalesce(rr, 0) / greatest(max(rr) OVER w, 1), 9)::DOUBLE, 6) AS blended FROM b WINDOW w AS (PARTITION BY query_id)""",
    "seed_union": _RANKED
    + """, first AS (SELECT query_id, chunk_id, min(list_idx::BIGINT * 1000000000 + rank) AS pos FROM l WHERE engine <> 'graph' GROUP BY ALL),
o AS (SELECT query_id, chunk_id, (row_number() OVER (PARTITION BY query_id ORDER BY pos, chunk_id) - 1)::INT AS ord FROM first) SELECT query_id, ord, chunk_id FROM o WHERE ord < 10""",
    "md_sections": rf"""
WITH ls AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l, coalesce(text, '') AS text FROM documents),
li AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM ls),
ln AS (SELECT *, regexp_full_match(line, '(#{{1,6}})[\t\x0b\f\r ]+([^\r\x{{2028}}\x{{2029}}]+)') AS h, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM li),
se AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM ln),
g AS (SELECT doc_id, sec, coalesce(max(length(regexp_extract(line, '^(#+)', 1))) FILTER (h), 0) AS level, coalesce(max({_trim(r"regexp_extract(line, '^#+[\t\x0b\f\r ]+(.+)$', 1)")}) FILTER (h), '') AS heading,
  coalesce(max(pos) FILTER (h), 0)::INT AS char_offset, count(*) FILTER (NOT h AND line <> '') AS n, {_trim("coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT h AND line <> ''), '')")} AS body FROM se GROUP BY ALL),
m AS (SELECT *, max(sec) OVER (PARTITION BY doc_id) AS last FROM g),
k AS (SELECT * FROM m WHERE sec > 0 OR last = 0 OR n > 0),
p AS (SELECT doc_id, sec, level, heading, char_offset, last, body, row_number() OVER w - 1 AS section, [{', '.join(f"CASE WHEN level > {n} THEN last_value(CASE WHEN level = {n} AND heading <> '' THEN heading END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END" for n in range(1, 6))}, CASE WHEN heading <> '' THEN heading END] AS path
  FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY sec))
SELECT doc_id, section::INT AS section, level::INT AS level, array_to_string(list_filter(path, lambda x: x IS NOT NULL), ' > ') AS path, md5(CASE WHEN last = 0 THEN {_trim('text')} ELSE body END) AS body, char_offset FROM p JOIN ls USING (doc_id)""",
    "frontmatter": "WITH src AS (SELECT doc_id AS k, text FROM documents)," + _FRONT + " SELECT k AS doc_id, key, kind, value FROM fk",
    "wikilinks": _CHUNKS + f"SELECT chunk_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '{_WIKI}', 1), lambda x: {_trim('x')}))) AS target FROM c",
    "mdlinks": _CHUNKS
    + f", x AS (SELECT chunk_id, regexp_extract_all(text, '{_LINK}', 1) AS a, regexp_extract_all(text, '{_LINK}', 2) AS b FROM c) SELECT chunk_id, i::INT AS i, {_trim('a')} AS label, {_trim('b')} AS url FROM (SELECT chunk_id, unnest(range(len(a))) AS i, unnest(a) AS a, unnest(b) AS b FROM x)",
    "tags": _CHUNKS + "SELECT chunk_id, unnest(list_distinct(regexp_extract_all(text, '#([a-zA-Z0-9_-]+)', 1))) AS tag FROM c",
    "headings": f"SELECT k AS doc_id, i::INT AS i, level::INT AS level, heading FROM ({_heads('SELECT doc_id AS k, text FROM documents')})",
    "parent_headings": f"WITH h AS ({_heads('SELECT doc_id AS k, text FROM documents')}), x AS ({_PARENT}) SELECT k AS doc_id, parent, child, count(*) AS n FROM x WHERE parent IS NOT NULL GROUP BY ALL",
    "structural_entities": _structure("SELECT DISTINCT chunk_id AS k, file_path AS p, text FROM chunks WHERE text IS NOT NULL")
    + """SELECT type, name, count(*) AS n FROM (SELECT 'concept' AS type, name FROM w UNION ALL SELECT 'concept', name FROM ln UNION ALL SELECT 'tag', name FROM tg UNION ALL SELECT 'section', heading FROM h
UNION ALL SELECT 'metadata', key || ': ' || value FROM fk WHERE kind = 'string') GROUP BY ALL""",
    "structural_relations": _structure("SELECT doc_id AS k, file_path AS p, text FROM documents WHERE text IS NOT NULL")
    + f""", x AS ({_PARENT}), r AS (SELECT p AS source_id, name AS target_id, 'LINKS_TO' AS relation_type, 1.0 AS weight FROM w UNION ALL SELECT p, name, 'LINKS_TO', 0.8 FROM ln UNION ALL SELECT p, name, 'HAS_TAG', 1.0 FROM tg
UNION ALL SELECT parent, child, 'PARENT_OF', 1.0 FROM x WHERE parent IS NOT NULL UNION ALL SELECT s.p, key || ': ' || value, 'HAS_FRONTMATTER', 1.0 FROM fk JOIN src s USING (k) WHERE kind = 'string')
SELECT source_id, target_id, relation_type, weight::DOUBLE AS weight, count(*) AS n FROM r GROUP BY ALL""",
    "title_from_content": f"SELECT doc_id, {_title} AS title, md5(text) AS checksum FROM documents",
    "exclude_globs": r"""WITH p AS (SELECT DISTINCT file_path, regexp_replace(file_path, '^/vault/', '') AS r, list_last(string_split(file_path, '/')) AS b FROM files WHERE file_path IS NOT NULL)
SELECT file_path, starts_with(r, 'drafts/') OR regexp_full_match(r, '(?:.*/)?link-[^/]*\.md') OR contains(b, '-failure-') OR starts_with(r, 'people/') OR regexp_full_match(r, 'how-to/[^/]ypothesis[^/]*') AS excluded FROM p""",
    "acronyms": _ACRONYMS + "SELECT doc, acronym, expansion FROM a",
    "acronym_dict": _DICTIONARY + "SELECT acronym, expansion, ord FROM dict",
    "expand_query": _DICTIONARY
    + _TITLES
    + """, src AS (SELECT query_id AS k, query FROM asked UNION ALL SELECT -ord - 1, 'about ' || lower(acronym) || ' and ' || acronym || 'x or about Zz' FROM dict),
q AS (SELECT k, unnest(range(len(w))) AS i, unnest(w) AS term FROM (SELECT k, regexp_split_to_array(query, '\\s+') AS w FROM src)),
hit AS (SELECT k, i, term, (SELECT expansion FROM dict d WHERE levenshtein(upper(term), d.acronym) <= 1 ORDER BY d.acronym <> upper(term), ord LIMIT 1) AS x FROM q),
flat AS (SELECT k, unnest(CASE WHEN x IS NULL THEN [term] ELSE [term, x] END) AS t, i FROM hit),
u AS (SELECT k, t, min(i * 2 + CASE WHEN EXISTS (SELECT 1 FROM q WHERE q.k = flat.k AND q.i = flat.i AND q.term = flat.t) THEN 0 ELSE 1 END) AS o FROM flat GROUP BY k, t)
SELECT k AS query_id, string_agg(t, ' ' ORDER BY o) AS expanded FROM u GROUP BY k""",
    "edges_upsert": "WITH " + _EDGES + "SELECT source_id, target_id, relation_type, weight FROM e",
    "edge_counts": "WITH " + _EDGES + "SELECT relation_type, count(*) AS n, round(sum(weight), 6) AS weight FROM e GROUP BY relation_type",
    "node_counts": "WITH " + _EDGES + "SELECT string_split(node, ':')[1] AS node_type, count(DISTINCT node) AS n FROM inc GROUP BY 1",
    "edge_degree": "WITH " + _EDGES + "SELECT node, count(*) AS degree FROM inc GROUP BY node",
    "neighbors_1hop": _SEEDS + ", s AS (SELECT DISTINCT node AS seed FROM seeds) SELECT seed, neighbour, relation_type, count(*) AS n, round(sum(weight), 6) AS weight FROM s JOIN inc ON inc.node = seed GROUP BY ALL",
    "neighbors_2hop": _SEEDS
    + """, s AS (SELECT DISTINCT node AS seed FROM seeds), v AS (SELECT seed, seed AS node FROM s UNION SELECT seed, neighbour FROM s JOIN inc ON inc.node = seed)
SELECT seed, neighbour, relation_type, count(*) AS n, round(sum(weight), 6) AS weight FROM v JOIN inc USING (node) GROUP BY ALL""",
    "graph_search": _SEEDS
    + """, v AS (SELECT DISTINCT node AS seed, node FROM seeds UNION SELECT s.node, neighbour FROM seeds s JOIN inc ON inc.node = s.node),
g AS (SELECT seed, neighbour, sum(weight * CASE WHEN relation_type IN ('LINKS_TO', 'MENTIONS') THEN 1.5 ELSE 1 END) AS gain FROM v JOIN inc USING (node) WHERE starts_with(neighbour, 'section:') GROUP BY ALL),
m AS (SELECT f.query_id, neighbour AS node, sum(gain) AS score FROM seeds f JOIN g ON g.seed = f.node LEFT JOIN seeds o ON o.query_id = f.query_id AND o.node = neighbour WHERE o.ord IS NULL OR f.ord > o.ord GROUP BY ALL)
SELECT query_id, substr(node, 9) AS chunk_id, round(round(sum(score), 9), 6) AS score FROM (SELECT * FROM m UNION ALL SELECT query_id, node, 1.0 FROM seeds) GROUP BY ALL""",
    "provenance_delete": "WITH "
    + _EDGES
    + ", "
    + _GONE
    + """, k AS (SELECT DISTINCT source_id, target_id, relation_type FROM edge_provenance WHERE chunk_id IN (SELECT chunk_id FROM gone)),
r AS (SELECT DISTINCT source_id, target_id, relation_type FROM edge_provenance WHERE chunk_id IS NULL OR chunk_id NOT IN (SELECT chunk_id FROM gone)),
x AS (SELECT * FROM k EXCEPT SELECT * FROM r) SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.source_id = e.source_id AND x.target_id = e.target_id AND x.relation_type = e.relation_type)""",
    "delete_cascade": "WITH "
    + _EDGES
    + ", "
    + _GONE
    + """, s AS (SELECT 'section:' || chunk_id AS n FROM gone)
SELECT DISTINCT 'node' AS what, node AS a, NULL::VARCHAR AS b, NULL::VARCHAR AS c FROM inc WHERE node NOT IN (SELECT n FROM s)
UNION ALL SELECT 'edge', source_id, target_id, relation_type FROM e WHERE source_id NOT IN (SELECT n FROM s) AND target_id NOT IN (SELECT n FROM s)""",
    "cooccur_pairs": _structure("SELECT DISTINCT chunk_id AS k, file_path AS p, text FROM chunks WHERE text IS NOT NULL").replace("unnest(list_distinct(list_transform(", "unnest((list_transform(")
    + """, a AS (SELECT k, 'entity:concept:' || name AS e, 0 AS br, i FROM (SELECT k, name, row_number() OVER (PARTITION BY k) AS i FROM w)
UNION ALL SELECT k, 'entity:concept:' || name, 1, i FROM (SELECT k, name, row_number() OVER (PARTITION BY k) AS i FROM ln) UNION ALL SELECT k, 'entity:section:' || heading, 2, i FROM h
UNION ALL SELECT k, 'entity:metadata:' || key || ': ' || value, 3, 0 FROM fk WHERE kind = 'string'),
f AS (SELECT k, e, min(br::BIGINT * 1000000000 + i) AS o FROM a GROUP BY k, e)
SELECT x.e AS source_id, y.e AS target_id, 'CO_OCCURS' AS relation_type, x.k AS chunk_id FROM f x JOIN f y ON x.k = y.k AND x.o < y.o""",
    "parent_edges": _CHUNKS
    + """, r AS (SELECT file_path, array_to_string(heading_hierarchy, ' > ') AS path, array_to_string(heading_hierarchy[: -2], ' > ') AS up, chunk_index, chunk_id FROM c WHERE heading_hierarchy IS NOT NULL),
f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY file_path, path ORDER BY chunk_index, chunk_id) = 1)
SELECT 'section:' || p.chunk_id AS source_id, 'section:' || k.chunk_id AS target_id, 'PARENT_OF' AS relation_type, 1.0::DOUBLE AS weight FROM f k JOIN f p ON p.file_path = k.file_path AND p.path = k.up WHERE k.up <> ''""",
    "file_diff": _SCANS + "SELECT scan_id, file_path, status FROM diff",
    "moved_files": _SCANS + "SELECT o.scan_id, o.file_path AS moved_from, n.file_path AS moved_to FROM diff o JOIN diff n ON o.checksum = n.checksum AND o.scan_id = n.scan_id WHERE o.status = 'moved' AND n.status = 'new'",
    "removed_paths": _SCANS + "SELECT scan_id, file_path FROM diff WHERE status IN ('deleted', 'moved', 'changed')",
    "index_stats": "WITH "
    + _EDGES
    + f", {_VECTORS}, {_SNAPSHOTS} "
    + """SELECT (SELECT count(DISTINCT file_path) FROM s) AS total_files, (SELECT count(DISTINCT chunk_id) FROM chunks WHERE text IS NOT NULL) AS total_chunks,
(SELECT count(DISTINCT node) FROM inc WHERE node LIKE 'entity:%') AS total_entities, (SELECT count(DISTINCT node) FROM inc) AS total_nodes, (SELECT count(*) FROM e) AS total_edges, (SELECT count(*) FROM lv WHERE len(embedding) = 384) AS total_vectors""",
    "store_vectors": "WITH "
    + _VECTORS
    + """ SELECT chunk_id, 384 AS dim, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) * CASE WHEN chunk_id >= '8' AND chunk_id < 'c' THEN 2 ELSE 1 END, 4) AS total FROM lv WHERE len(embedding) = 384 AND chunk_id < 'e'""",
    "store_files": f"WITH {_SNAPSHOTS} SELECT file_path, title, size_bytes, checksum FROM s WHERE scan_id = (SELECT max(scan_id) FROM s)",
    "store_chunks": "WITH " + _GONE + ", c AS (SELECT DISTINCT * FROM chunks) SELECT file_path, string_agg(chunk_id, ',' ORDER BY chunk_index, chunk_id) AS ids FROM c WHERE chunk_id NOT IN (SELECT chunk_id FROM gone) GROUP BY file_path",
    "store_edges": "WITH "
    + _EDGES
    + """, p AS (SELECT source_id, target_id, relation_type, count(DISTINCT chunk_id) AS chunks FROM edge_provenance WHERE chunk_id IS NOT NULL GROUP BY ALL)
SELECT e.source_id, e.target_id, e.relation_type, weight, coalesce(chunks, 0) AS chunks FROM e LEFT JOIN p ON p.source_id = e.source_id AND p.target_id = e.target_id AND p.relation_type = e.relation_type""",
    "nodes_upsert": f"WITH {_SNAPSHOTS} SELECT 'file:' || file_path AS node_id, 'file' AS node_type, title AS name FROM s QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY scan_id DESC) = 1",
    "heading_terms": f"SELECT k AS doc_id, i::INT AS i, heading AS name, 'heading' AS type, 'keyterm' AS source FROM ({_heads('SELECT doc_id AS k, text FROM documents')})",
    "named_entities": _CHUNKS
    + """, w AS (SELECT DISTINCT chunk_id, w FROM (SELECT chunk_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS w FROM c)),
l AS (SELECT chunk_id, w, ['person', 'organization', 'location', 'concept'][length(w) % 4 + 1] AS type FROM w) SELECT chunk_id, type, w AS name FROM l WHERE type <> 'location'""",
    "rerank_threshold": _FUSED
    + """, c AS (SELECT DISTINCT * FROM chunks), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM f),
x AS (SELECT query_id, chunk_id, (length(coalesce(text, '')[:512]) * 7 % 23 - 12) * CASE WHEN greatest(1, length(text) // 4) < 20 THEN 0.8 ELSE 1.0 END::DOUBLE AS rr FROM r JOIN c USING (chunk_id) WHERE rank < 20),
b AS (SELECT f.query_id, f.chunk_id, score, rr FROM f LEFT JOIN (SELECT * FROM x WHERE rr > -8) y ON y.query_id = f.query_id AND y.chunk_id = f.chunk_id)
SELECT query_id, chunk_id, round(round(0.4 * score / greatest(max(score) OVER w, 1) + 0.6 * coalesce(rr, 0) / greatest(coalesce(max(rr) OVER w, 1), 1), 9)::DOUBLE, 6) AS blended FROM b WINDOW w AS (PARTITION BY query_id)""",
}

# the graph of all chunks and the files of the last scan
_BUILT = _structure("SELECT DISTINCT chunk_id AS k, file_path AS p, text FROM chunks WHERE text IS NOT NULL").replace("unnest(list_distinct(list_transform(", "unnest((list_transform(") + f""", {_SNAPSHOTS}, ch AS (SELECT DISTINCT * FROM chunks WHERE text IS NOT NULL),
ent AS (SELECT k, 'concept' AS type, name FROM w UNION SELECT k, 'concept', name FROM ln UNION SELECT k, 'tag', name FROM tg UNION SELECT k, 'section', heading FROM h UNION SELECT k, 'metadata', key || ': ' || value FROM fk WHERE kind = 'string'),
nod AS (SELECT k, type, CASE type WHEN 'tag' THEN 'tag:' ELSE 'entity:' || type || ':' END || name AS node, name FROM ent)
"""
ORACLES |= {
    "graph_nodes": _BUILT
    + """SELECT 'file:' || file_path AS node_id, 'file' AS node_type, title AS name, NULL::VARCHAR AS entity_type, NULL::VARCHAR AS level FROM s WHERE scan_id = (SELECT max(scan_id) FROM s)
UNION ALL SELECT 'section:' || chunk_id, 'section', coalesce(heading_hierarchy[-1], ''), NULL, level::VARCHAR FROM ch
UNION ALL SELECT DISTINCT node, CASE type WHEN 'tag' THEN 'tag' ELSE 'entity' END, name, CASE WHEN type <> 'tag' THEN type END, NULL FROM nod""",
    "graph_edges": _BUILT
    + """, r AS (SELECT file_path, array_to_string(heading_hierarchy, ' > ') AS path, array_to_string(heading_hierarchy[: -2], ' > ') AS up, chunk_index, chunk_id FROM ch WHERE heading_hierarchy IS NOT NULL),
f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY file_path, path ORDER BY chunk_index, chunk_id) = 1),
o AS (SELECT k, node, min(spot) AS spot FROM (
  SELECT k, 'entity:concept:' || name AS node, row(0, i) AS spot FROM (SELECT k, name, row_number() OVER (PARTITION BY k) AS i FROM w)
  UNION ALL SELECT k, 'entity:concept:' || name, row(1, i) FROM (SELECT k, name, row_number() OVER (PARTITION BY k) AS i FROM ln)
  UNION ALL SELECT k, 'entity:section:' || heading, row(2, i) FROM h UNION ALL SELECT k, 'entity:metadata:' || key || ': ' || value, row(3, 0) FROM fk WHERE kind = 'string') GROUP BY ALL)
SELECT 'file:' || file_path AS source_id, 'section:' || chunk_id AS target_id, 'CONTAINS' AS relation_type, 1.0::DOUBLE AS weight FROM ch
UNION ALL SELECT DISTINCT 'section:' || k, node, CASE type WHEN 'tag' THEN 'HAS_TAG' WHEN 'concept' THEN 'LINKS_TO' ELSE 'MENTIONS' END, 1.0 FROM nod
UNION ALL SELECT 'section:' || p.chunk_id, 'section:' || k.chunk_id, 'PARENT_OF', 1.0 FROM f k JOIN f p ON p.file_path = k.file_path AND p.path = k.up WHERE k.up <> ''
UNION ALL SELECT DISTINCT x.node, y.node, 'CO_OCCURS', 0.5 FROM o x JOIN o y ON x.k = y.k AND x.spot < y.spot""",
}

# searches: lists of the engines, fused, reranked by place, blended
_TEXTS = "WITH c AS (SELECT DISTINCT * FROM chunks WHERE text IS NOT NULL)"
_ENGINES = (
    _BM25.replace("WITH c AS (SELECT DISTINCT * FROM chunks)", _TEXTS)
    + f""", {_VECTORS},
qv AS (SELECT query_id, list_transform(range(384), lambda i: (length(query) * (i + 1) % 97 - 48)::DOUBLE) AS v FROM asked),
cs AS (SELECT query_id, chunk_id, list_cosine_similarity(v, embedding::DOUBLE[]) AS cs FROM qv, lv WHERE len(embedding) = 384),
near AS (SELECT query_id, chunk_id, round((1 + CASE WHEN cs IS NULL OR isnan(cs) THEN 0 ELSE round(cs, 9) END) / 2, 9) AS score FROM cs),
l1 AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM score QUALIFY rank < 20),
l0 AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM near QUALIFY rank < 20 AND score >= 0.4),
"""
    + _EDGES
)
_GRAPH_LIST = """, first AS (SELECT query_id, chunk_id, min(row(i, rank)) AS spot FROM ({0}) GROUP BY ALL),
seeds AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY spot, chunk_id) - 1 AS ord, 'section:' || chunk_id AS node FROM first QUALIFY ord < 10),
v AS (SELECT DISTINCT node AS seed, node FROM seeds UNION SELECT s.node, neighbour FROM seeds s JOIN inc ON inc.node = s.node),
g AS (SELECT seed, neighbour, sum(weight * CASE WHEN relation_type IN ('LINKS_TO', 'MENTIONS') THEN 1.5 ELSE 1 END) AS gain FROM v JOIN inc USING (node) WHERE starts_with(neighbour, 'section:') GROUP BY ALL),
m AS (SELECT f.query_id, neighbour AS node, sum(gain) AS score FROM seeds f JOIN g ON g.seed = f.node LEFT JOIN seeds o ON o.query_id = f.query_id AND o.node = neighbour WHERE o.ord IS NULL OR f.ord > o.ord GROUP BY ALL),
gs AS (SELECT query_id, substr(node, 9) AS chunk_id, round(sum(score), 9) AS score FROM (SELECT * FROM m UNION ALL SELECT query_id, node, 1.0 FROM seeds) GROUP BY ALL),
l2 AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM gs)
"""
_FINAL = """, every AS ({0}),
nrm AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS normal FROM every WINDOW w AS (PARTITION BY query_id, engine)),
fu AS (SELECT query_id, chunk_id, round(sum(CASE engine WHEN 'graph' THEN 1.5 ELSE 1 END / (61.0::DOUBLE + rank)), 9) AS score, string_agg(engine, ',' ORDER BY i) AS engines,
  max(normal) FILTER (engine = 'semantic') AS semantic_score, max(normal) FILTER (engine = 'bm25') AS bm25_score, max(normal) FILTER (engine = 'graph') AS graph_score FROM nrm GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM fu),
bl AS (SELECT *, CASE WHEN rank < 20 THEN 1 - rank * 0.01 END AS rr FROM rk),
sc AS (SELECT *, round((0.4 * score / greatest(max(score) OVER w, 1) + 0.6 * coalesce(rr, 0) / greatest(max(rr) OVER w, 1))::DOUBLE, 9) AS fused FROM bl WINDOW w AS (PARTITION BY query_id)),
pl AS (SELECT sc.*, file_path, heading_hierarchy, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, chunk_id) - 1 AS place FROM sc JOIN c USING (chunk_id) QUALIFY place < 10)
SELECT query_id, chunk_id, place::INT AS place, file_path, coalesce(array_to_string(heading_hierarchy, ' > '), '') AS heading_path, engines, round(fused, 5) AS fused_score,
  round(semantic_score, 5) AS semantic_score, round(bm25_score, 5) AS bm25_score, round(graph_score, 5) AS graph_score FROM pl"""
_one = lambda i, l, e: f"SELECT {i} AS i, '{e}' AS engine, query_id, chunk_id, score, rank FROM {l}"  # noqa: E731, E741
_S, _B = _one(0, "l0", "semantic"), _one(1, "l1", "bm25")
ORACLES |= {
    "search_semantic": _ENGINES + _FINAL.format(_S),
    "search_bm25": _ENGINES + _FINAL.format(_B),
    "search_graph": _ENGINES + _GRAPH_LIST.format(_B) + _FINAL.format(_one(2, "l2", "graph")),
    "search_hybrid": _ENGINES + _GRAPH_LIST.format(f"{_S} UNION ALL {_B}") + _FINAL.format(f"{_S} UNION ALL {_B} UNION ALL {_one(2, 'l2', 'graph')}"),
    "search_lines": _BM25.replace("WITH c AS (SELECT DISTINCT * FROM chunks)", _TEXTS)
    + f""", r AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS place FROM score QUALIFY place < 10),
p AS (SELECT query_id, place, round(1 / (61.0::DOUBLE + place), 9) AS fused, array_to_string(heading_hierarchy, ' > ') AS head, text, list_min(list_filter(list_transform({_tok('query')}, lambda x: instr(lower(text), x)), lambda x: x > 0)) AS pos
  FROM r JOIN asked USING (query_id) JOIN c USING (chunk_id))
SELECT query_id, place::INT AS place, concat((place + 1), '. ', CASE WHEN coalesce(head, '') = '' THEN 'Untitled' ELSE head END, ' (', printf('%.4f', fused), ', ', printf('%.1f', fused * 100), '%) ',
  replace(CASE WHEN pos IS NULL THEN text[1:300] ELSE {_trim('substring(text, greatest(0, pos - 151) + 1, 300)')} END, chr(10), ' ')) AS line FROM p""",
}

# chunks: the sections above; over-long ones are folded sentence by sentence, held sentences and their budget carried on
_size = lambda x: f"greatest(1, length({x}) // 4)"
ORACLES["md_chunks"] = (
    ORACLES["md_sections"].split("SELECT doc_id, section::INT")[0].replace("WITH ls", "WITH RECURSIVE ls")
    + rf""", sec AS (SELECT doc_id, section, level, array_to_string(list_filter(path, lambda x: x IS NOT NULL), ' > ') AS path, CASE WHEN last = 0 THEN {_trim('text')} ELSE body END AS body FROM p JOIN ls USING (doc_id)),
hd AS (SELECT *, CASE WHEN path <> '' THEN path || chr(10) || chr(10) ELSE '' END AS head, CASE WHEN path <> '' THEN {_size('path')} + 10 ELSE 0 END AS fixed FROM sec),
fold AS (
  SELECT doc_id, section, fixed, list_filter(list_transform(string_split(regexp_replace(body, '([.!?]){_WS}+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: {_trim('x')}), lambda x: x <> '') AS s,
    0 AS i, []::VARCHAR[] AS held, fixed AS budget, NULL::VARCHAR AS emitted FROM hd WHERE {_size('head || body')} > 512
  UNION ALL
  SELECT doc_id, section, fixed, s, i + 1, CASE WHEN i = len(s) THEN [] WHEN over THEN list_append(kept, s[i + 1]) ELSE list_append(held, s[i + 1]) END,
    CASE WHEN i = len(s) THEN 0 WHEN over THEN fixed + {_size("array_to_string(kept, ' ')")} + size ELSE budget + size END, CASE WHEN over OR (i = len(s) AND len(held) > 0) THEN array_to_string(held, ' ') END
  FROM (SELECT *, held[len(held) - CASE WHEN list_contains(fits, false) THEN list_position(fits, false) - 1 ELSE len(held) END + 1 :] AS kept FROM (
    SELECT *, {_size('s[i + 1]')} AS size, i < len(s) AND len(held) > 0 AND budget + {_size('s[i + 1]')} > 512 AS over,
      list_transform(range(1, len(held) + 1), lambda n: greatest(1, (length(array_to_string(held[len(held) - n + 2 :], ' ')) + length(held[len(held) - n + 1])) // 4) <= 50) AS fits FROM fold WHERE i <= len(s)))),
ck AS (SELECT doc_id, section, 0 AS i, head || body AS text FROM hd WHERE {_size('head || body')} <= 512 UNION ALL SELECT doc_id, section, i, head || emitted FROM fold JOIN hd USING (doc_id, section) WHERE emitted IS NOT NULL),
ix AS (SELECT ck.doc_id::VARCHAR AS file_path, row_number() OVER (PARTITION BY ck.doc_id ORDER BY ck.section, ck.i) - 1 AS chunk_index, level, path, text FROM ck JOIN hd USING (doc_id, section))
SELECT file_path, chunk_index::INT AS chunk_index, md5(file_path || ':' || chunk_index) AS chunk_id, level::INT AS level, path, md5(text) AS text FROM ix"""
)
