"""Entities and relations of texts: structure, key terms, acronyms and pluggable named entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelattice.functions import text as tx
from notelattice.functions.noise import DEFAULT, NoiseWords
from notelattice.operators import markdown as md
from notelattice.operators.counting import count_terms
from notelattice.operators.skew import numbered, with_frequency
from notelattice.session import materialize

LEAST_TERM = 3


def structure(df: DataFrame, keys: list[str], content: str) -> DataFrame:
    """Rows (*keys, links, urls, tags, heads, strings): what a text declares, each extracted once."""
    rows = df.select(*keys, F.col(content).alias("_c")).select(*keys, "_c", md.body(F.col("_c")).alias("_b"))
    own = F.col("_b")
    rows = rows.select(*keys, md.wikilinks(own).alias("links"), md.markdown_links(own).alias("_l"), md.tags(own).alias("tags"), md.headings(own).alias("heads"), md.frontmatter(F.col("_c")).alias("_f"))
    strings = F.transform(F.filter("_f", lambda e: e["kind"] == "string"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return rows.select(*keys, "links", F.col("_l.url").alias("urls"), "tags", "heads", strings.alias("strings"))


def structural_entities(df: DataFrame, keys: list[str], content: str) -> DataFrame:
    """Rows (*keys, ord, name, type, source) in the order wikilinks, links, tags, headings, frontmatter strings."""
    of = lambda names, kind: F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(kind).alias("type"), F.lit("structural").alias("source")))
    every = F.concat(of("links", "concept"), of("urls", "concept"), of("tags", "tag"), of(F.col("heads.text"), "section"), of("strings", "metadata"))
    rows = structure(df, keys, content).select(*keys, every.alias("_e")).select(*keys, F.posexplode("_e").alias("ord", "_e"))
    return rows.select(*keys, "ord", "_e.*")


def structural_relations(df: DataFrame, keys: list[str], content: str, path: str) -> DataFrame:
    """Rows (*keys, ord, source_id, target_id, relation_type, weight) of files, in order of emission."""
    own = structure(df, [*dict.fromkeys([*keys, path])], content).withColumn("pairs", md.heading_parents(F.col("heads")))

    def of(names: str, kind: str, weight: float) -> Column:
        return F.transform(names, lambda n: F.struct(F.col(path).alias("source_id"), n.alias("target_id"), F.lit(kind).alias("relation_type"), F.lit(weight).alias("weight")))

    parents = F.transform("pairs", lambda p: F.struct(p["parent"].alias("source_id"), p["child"].alias("target_id"), F.lit("PARENT_OF").alias("relation_type"), F.lit(1.0).alias("weight")))
    every = F.concat(of("links", "LINKS_TO", 1.0), of("urls", "LINKS_TO", 0.8), of("tags", "HAS_TAG", 1.0), parents, of("strings", "HAS_FRONTMATTER", 1.0))
    return own.select(*keys, every.alias("_r")).select(*keys, F.posexplode("_r").alias("ord", "_r")).select(*keys, "ord", "_r.*")


def term_rows(df: DataFrame, key: str, text: str, noise: NoiseWords = DEFAULT, most: int = 3) -> DataFrame:
    """Rows (key, term, tf, first) of the 1- to 3-grams of each text; ``first`` orders equal terms. One row per key.

    Tokens shorter than three characters are left out before n-grams are formed.
    """
    words = F.filter(tx.tokenize(F.col(text), noise), lambda w: F.length(w) >= LEAST_TERM)
    return count_terms(df, key, words, most).select(key, "term", "tf", "first")


def tfidf_per_document(rows: DataFrame, key: str, corpus: DataFrame, total: DataFrame | int, k: int = 10) -> DataFrame:
    """Rows (key, term, tf, score, place): the k best terms by ``tf * ln(N / df)``, earlier terms first among equals.

    ``corpus`` has the document frequencies (term, df); a term without one counts as 1. Both should be written tables.
    """
    n = total if isinstance(total, int) else total.first()["n"]  # one row
    joined = with_frequency(rows, corpus, n)
    score = F.round(F.col("tf") * F.log(F.lit(n) / F.coalesce("df", F.lit(1))), 9)
    order = Window.partitionBy(key).orderBy(F.desc("score"), F.asc("first"))
    return joined.withColumn("score", score).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select(key, "term", "tf", "score", "place")


def document_frequencies(rows: DataFrame) -> DataFrame:
    """Rows (term, df) of ``term_rows``."""
    return rows.groupBy("term").agg(F.count("*").alias("df"))


def tfidf_corpus(rows: DataFrame, total: DataFrame, k: int = 20) -> DataFrame:
    """Rows (term, score): the k terms of highest ``count * ln(N / df)`` over the whole collection, ties by term."""
    sums = rows.groupBy("term").agg(F.sum("tf").alias("count"), F.count("*").alias("df")).crossJoin(F.broadcast(total))
    return sums.select("term", F.round(F.col("count") * F.log(F.col("n") / F.col("df")), 6).alias("score")).orderBy(F.desc("score"), "term").limit(k)


def heading_terms(content: Column) -> Column:
    """Array of (name, type, source) of the headings themselves."""
    return F.transform(md.headings(content)["text"], lambda t: F.struct(t.alias("name"), F.lit("heading").alias("type"), F.lit("keyterm").alias("source")))


def key_terms(df: DataFrame, key: str, text: str, corpus: DataFrame, total: DataFrame | int, noise: NoiseWords = DEFAULT, k: int = 10, rows: DataFrame | None = None) -> DataFrame:
    """Rows (key, ord, name): words of the headings, then the k best n-grams. ``rows`` are the ``term_rows`` of these texts, if taken already."""
    words = F.flatten(F.transform(F.col("_h.text"), lambda t: F.filter(tx.tokenize(t, noise), lambda w: F.length(w) >= LEAST_TERM)))
    from_headings = df.select(key, md.headings(F.col(text)).alias("_h")).select(key, F.posexplode(words).alias("ord", "name"))
    rows = materialize(term_rows(df, key, text, noise), "terms") if rows is None else rows
    best = tfidf_per_document(rows, key, corpus, total, k)
    return from_headings.unionByName(best.select(key, (F.col("place") + 1_000_000).alias("ord"), F.col("term").alias("name")))


# The three shapes of an acronym next to its long form.
ACRONYM_SHAPES = (
    (r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\s*\(([A-Z]{2,})\)", 2, 1),
    (r"([A-Z]{2,})\s*\(([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\)", 1, 2),
    (r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\s*[-—]\s*([A-Z]{2,})", 2, 1),
)


def acronyms(text: Column, noise: NoiseWords = DEFAULT) -> Column:
    """Array of (acronym, expansion) in order of shape and place; noise in capitals is left out."""
    found = []
    for shape, short, long in ACRONYM_SHAPES:
        a = F.regexp_extract_all(text, F.lit(shape), F.lit(short))
        b = F.transform(F.regexp_extract_all(text, F.lit(shape), F.lit(long)), tx.trim)
        found.append(F.arrays_zip(a.alias("acronym"), b.alias("expansion")))
    return F.filter(F.concat(*found), lambda x: ~tx.is_noise_upper(x["acronym"], noise))


def acronym_dictionary(df: DataFrame, key: str, text: str, noise: NoiseWords = DEFAULT) -> DataFrame:
    """Rows (acronym, expansion, ord): within a text the last expansion counts, over texts the longest, the first of equals.

    ``ord`` numbers acronyms by their first text, which decides fuzzy matches.
    """
    rows = df.select(F.col(key).alias("k"), F.posexplode(acronyms(F.col(text), noise)).alias("i", "a")).select("k", "i", "a.*")
    per_text = rows.groupBy("k", "acronym").agg(F.max_by("expansion", "i").alias("expansion"), F.min("i").alias("i"))
    best = per_text.groupBy("acronym").agg(
        F.min(F.struct((-F.length("expansion")).alias("l"), "k", "expansion")).alias("b"), F.min(F.struct("k", "i")).alias("first")
    )
    rows = best.select("acronym", F.col("b.expansion").alias("expansion"), F.col("first.k").alias("_k"), F.col("first.i").alias("_i"))
    return numbered(rows, ["_k", "_i", "acronym"], "ord").select("acronym", "expansion", "ord")


def _variants(word: Column, distance: int) -> Column:
    """A word with 0 to ``distance`` of its characters left out: words within so many edits have one in common."""
    out = F.array(word)
    for _ in range(distance):
        shorter = F.flatten(F.transform(out, lambda w: F.transform(F.filter(F.sequence(F.lit(0), F.length(w)), lambda i: i > 0), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))))
        out = F.array_distinct(F.concat(out, shorter))
    return out


def expand_queries(queries: DataFrame, key: str, query: str, dictionary: DataFrame, distance: int = 1) -> DataFrame:
    """Rows (key, expanded): each blank-separated term, followed by the expansion of its acronym.

    The acronym is the term in capitals, else the first of the dictionary within ``distance`` edits.
    Terms are distinct after expansion; with an empty dictionary queries stay as they are.
    """
    terms = queries.select(F.col(key).alias("k"), F.posexplode(F.split(query, r"\s+")).alias("i", "term"))
    words = terms.select(F.upper("term").alias("u")).distinct()
    # words and acronyms meet at a common variant with characters left out, and the distance is checked
    a = dictionary.select("acronym", "expansion", "ord", F.explode(_variants(F.col("acronym"), distance)).alias("v"))
    hits = words.select("u", F.explode(_variants(F.col("u"), distance)).alias("v")).join(a, "v").filter(F.levenshtein("u", "acronym", distance) >= 0)
    best = hits.groupBy("u").agg(F.min(F.struct((F.col("u") != F.col("acronym")).alias("far"), "ord", "expansion")).alias("b"))
    joined = terms.withColumn("u", F.upper("term")).join(best.select("u", F.col("b.expansion").alias("expansion")), "u", "left")
    lists = joined.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("i", "term", "expansion"))).alias("t"))
    flat = F.flatten(F.transform("t", lambda x: F.array_compact(F.array(x["term"], x["expansion"]))))
    expanded = lists.select(F.col("k").alias(key), F.array_join(F.array_distinct(flat), " ").alias("expanded"))
    if dictionary.isEmpty():
        return queries.select(key, F.col(query).alias("expanded"))
    return expanded
