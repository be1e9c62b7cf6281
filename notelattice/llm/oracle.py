"""SQL of the queries of this subpackage that SQL can express over whole tables."""

_TERMS = """
WITH docs AS (SELECT chunk_id, max(text) AS text FROM chunks WHERE text IS NOT NULL AND chunk_id IS NOT NULL GROUP BY chunk_id),
tok AS (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM docs),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM tok GROUP BY ALL),
df AS (SELECT term, sum(tf)::BIGINT AS cnt, count(*) AS df FROM tf GROUP BY term),
n AS (SELECT count(*) AS n FROM docs)
"""

_SCORES = """
WITH last AS (
  SELECT query_id AS q, chunk_id AS c, semantic_score, bm25_score, graph_score FROM search_results
  WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY scored_at DESC NULLS LAST, semantic_score DESC NULLS LAST, bm25_score DESC NULLS LAST, graph_score DESC NULLS LAST) = 1),
long AS (
  SELECT q, c, 0 AS e, semantic_score AS s FROM last UNION ALL SELECT q, c, 1, bm25_score FROM last UNION ALL SELECT q, c, 2, graph_score FROM last),
num AS (
  SELECT q, c, e, row_number() OVER (PARTITION BY q, e ORDER BY s DESC, c) - 1 AS i, count(*) OVER (PARTITION BY q, e) AS n
  FROM long WHERE s IS NOT NULL AND NOT isnan(s) AND s >= 0)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _TERMS + "SELECT term, CASE WHEN df <= 2 THEN 'rare' ELSE 'common' END AS mark FROM df, n WHERE df <= 2 OR 2 * df > n",
        "p2_frequencies": _TERMS + 'SELECT term, cnt AS "count", df AS document_count FROM df',
        "p3_found": """
WITH t AS (SELECT DISTINCT chunk_id, least(source_id, target_id) AS a, greatest(source_id, target_id) AS b FROM edge_provenance
  WHERE upper(relation_type) = 'CO_OCCURS' AND chunk_id IS NOT NULL AND source_id <> target_id),
ab AS (SELECT a, b, count(*) AS n_ab FROM t GROUP BY ALL),
i AS (SELECT x, count(DISTINCT chunk_id) AS n FROM (SELECT a AS x, chunk_id FROM t UNION ALL SELECT b, chunk_id FROM t) GROUP BY x),
m AS (SELECT count(DISTINCT chunk_id) AS m FROM t)
SELECT a AS node_a, b AS node_b FROM ab JOIN i ia ON ia.x = a JOIN i ib ON ib.x = b, m WHERE n_ab >= 5 AND n_ab * m >= 6 * ia.n * ib.n""",
        "p3_baskets": """
WITH r AS (SELECT chunk_id, source_id, target_id FROM edge_provenance WHERE upper(relation_type) = 'CO_OCCURS' AND chunk_id IS NOT NULL),
i AS (SELECT DISTINCT chunk_id, x FROM (SELECT chunk_id, source_id AS x FROM r UNION ALL SELECT chunk_id, target_id FROM r) WHERE x IS NOT NULL)
SELECT l.x AS node_a, g.x AS node_b, count(*) AS n_ab FROM i l JOIN i g ON l.chunk_id = g.chunk_id AND l.x < g.x GROUP BY ALL""",
        "p5_found": _TERMS
        + """SELECT chunk_id, term FROM (
  SELECT chunk_id, term, row_number() OVER (PARTITION BY chunk_id ORDER BY round(tf * ln((n - df + 0.5) / (df + 0.5) + 1), 6) DESC, term) AS i
  FROM tf JOIN df USING (term), n) WHERE i <= 3""",
        "p5_normalised": _TERMS
        + """, len AS (SELECT chunk_id, sum(tf)::DOUBLE AS len FROM tf GROUP BY chunk_id), mean AS (SELECT sum(len) / max(n) AS mean FROM len, n),
s AS (SELECT chunk_id, term, round(tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean)) * ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS score
  FROM tf JOIN df USING (term) JOIN len USING (chunk_id), n, mean)
SELECT chunk_id, term, score FROM s QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC, term) <= 3""",
        "p6_found": """
WITH u AS (SELECT chunk_id AS k, embedding::DOUBLE[] AS e FROM vectors
  WHERE chunk_id IS NOT NULL AND len(embedding) = 384 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY embedded_at DESC NULLS LAST, embedding DESC) = 1),
v AS (SELECT k, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e)))::DOUBLE[384] AS e FROM u),
s AS (SELECT a.k AS k, b.k AS o, array_inner_product(a.e, b.e) AS c FROM v a JOIN v b ON a.k <> b.k),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY c DESC, o) <= 5)
SELECT DISTINCT least(k, o) AS chunk_a, greatest(k, o) AS chunk_b FROM best WHERE c >= 0.65""",
        "p7_found": _SCORES
        + """, val AS (SELECT q, c, round(sum(CASE WHEN e = 2 THEN 1.5 ELSE 1 END / (61.0::DOUBLE + i)), 9) AS v FROM num GROUP BY q, c)
SELECT q AS query_id, c AS chunk_id FROM val QUALIFY row_number() OVER (PARTITION BY q ORDER BY v DESC, c) <= 5""",
        "p7_leximin": _SCORES
        + """, p AS (SELECT q, c, coalesce(max(CASE WHEN e = 0 THEN x END), 0) AS p0, coalesce(max(CASE WHEN e = 1 THEN x END), 0) AS p1, coalesce(max(CASE WHEN e = 2 THEN x END), 0) AS p2
  FROM last LEFT JOIN (SELECT q, c, e, round((n - i)::DOUBLE / n, 9) AS x FROM num) USING (q, c) GROUP BY q, c),
l AS (SELECT q, c, list_sort([p0, p1, p2]) AS x FROM p)
SELECT q AS query_id, c AS chunk_id, row_number() OVER (PARTITION BY q ORDER BY x[1] DESC, x[2] DESC, x[3] DESC, c)::INT AS place FROM l""",
        "p10_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 5], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 4)) AS i FROM d)),
again AS (SELECT doc_id, i FROM g QUALIFY row_number() OVER (PARTITION BY doc_id, gram ORDER BY i) > 1),
words AS (SELECT DISTINCT doc_id, unnest(range(i, i + 6)) AS j FROM again)
SELECT doc_id FROM words JOIN d USING (doc_id) GROUP BY doc_id HAVING 10 * count(*) >= 3 * max(len(w))""",
    }
