"""How distinctive a term is of a record: term frequency times smoothed inverse document frequency.

Distinct (term, record) counts are taken where the record lies and written once; document frequencies come from them
and are joined back: those of hot terms by broadcast, all others by shuffle, where no term has more
than a fixed share of the records (``with_frequency``).

A term is a maximal run of ``[a-z0-9_]`` in the lower-cased text. Defined results: null texts are
no record, a record without terms counts in N and has no rows, repeated rows of a key are one
record (the largest text by code point if they differ), ties go to the smaller term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelattice.operators.counting import count_terms
from notelattice.operators.skew import with_frequency
from notelattice.session import materialize

from .records import texts

def term_scores(df: DataFrame, key: str, text: str, length_norm: bool = True, slope: float = 0.75, k1: float = 1.5) -> DataFrame:
    """Rows (key, term, tf, df, n, len, score) for every term of every record.

    The score is ``tf * ln((n - df + 0.5) / (df + 0.5) + 1)``; with length normalisation ``tf``
    is replaced by ``tf * (k1 + 1) / (tf + k1 * (1 - slope + slope * len / mean len))``.
    """
    rows = texts(df, key, text)
    words = F.regexp_extract_all(F.lower("t"), F.lit("[a-z0-9_]+"), F.lit(0))
    postings = materialize(count_terms(rows, "k", words).select("k", "term", "tf", "len"), "postings")
    n = rows.count()
    mean = postings.agg((F.sum("tf") / F.lit(max(n, 1))).alias("m")).first()["m"] or 1.0
    frequencies = materialize(postings.groupBy("term").agg(F.count("*").alias("df")), "frequencies")
    joined = with_frequency(postings, frequencies, n)
    tf: Column = F.col("tf")
    if length_norm:
        tf = tf * (k1 + 1) / (tf + k1 * (1 - slope + slope * F.col("len") / F.lit(float(mean))))
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return joined.select(F.col("k").alias(key), "term", "tf", "df", F.lit(n).alias("n"), "len", (tf * idf).alias("score"))


def top_terms(scores: DataFrame, key: str, k: int, digits: int | None = None) -> DataFrame:
    """The k terms of highest score of each record; ties by term. A top-k per record, pruned before the shuffle."""
    score = F.col("score") if digits is None else F.round("score", digits)
    ranked = scores.withColumn("score", score)
    w = Window.partitionBy(key).orderBy(F.desc("score"), F.asc("term"))
    return ranked.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
