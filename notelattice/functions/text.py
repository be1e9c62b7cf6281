"""Text functions as column expressions; all run inside the JVM.

White space of ``trim`` is the whole Unicode class, not the blank alone. Lengths are code points.
A null text gives null unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .noise import DEFAULT, HEX_WORD, NoiseWords

_WS = r"[\s   -     　﻿]"


def trim(c: Column) -> Column:
    """Strip white space of every kind from both ends."""
    return F.regexp_replace(c, rf"\A{_WS}++|(?<!{_WS}){_WS}++\z", "")


def is_noise(word: Column, noise: NoiseWords = DEFAULT) -> Column:
    """Whether a lower-case word is empty, a stop word or hex-like."""
    return (word == "") | word.isin(*noise.stop) | word.rlike(HEX_WORD)


def is_noise_upper(word: Column, noise: NoiseWords = DEFAULT) -> Column:
    """Whether a word in capitals is no acronym."""
    return word.isin(*noise.upper) | is_noise(F.lower(word), noise)


def raw_tokens(text: Column) -> Column:
    """Maximal runs of ASCII letters, digits and underscore of the lower-cased text; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))


def tokenize(text: Column, noise: NoiseWords = DEFAULT) -> Column:
    """``raw_tokens`` without noise, in order, repeats kept."""
    return F.filter(raw_tokens(text), lambda w: ~is_noise(w, noise))


def estimate_tokens(text: Column) -> Column:
    """A quarter of the length, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def clean_text(text: Column) -> Column:
    """Lines trimmed on the right, at most one empty line in a row, trimmed."""
    lines = F.regexp_replace(F.regexp_replace(text, r"\r\n", "\n"), rf"(?<!{_WS[:-1]}&&[^\n]]){_WS[:-1]}&&[^\n]]++(?=\n|\z)", "")
    return trim(F.regexp_replace(lines, r"\n{3,}", "\n\n"))


def split_sentences(text: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` where white space and a capital follow; trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(text, rf"(?<=[.!?]){_WS}+(?=[A-Z])"), trim), lambda s: s != "")


def ngrams(tokens: Column, most: int = 3) -> Column:
    """All runs of 1 to ``most`` tokens joined by a blank, shorter ones first, in order."""

    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(tokens) - n + 1)
        return F.when(F.size(tokens) >= n, F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(n) for n in range(1, most + 1)])


def preprocess_query(query: Column) -> Column:
    """Trimmed, white space collapsed, lower case."""
    return F.lower(trim(F.regexp_replace(query, rf"{_WS}+", " ")))


def entity_hints(query: Column) -> Column:
    """Runs of capitalised words, distinct, in order."""
    pattern = r"(?<![A-Za-z0-9_])[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*(?![A-Za-z0-9_])"
    return F.array_distinct(F.regexp_extract_all(query, F.lit(pattern), F.lit(0)))


def has_acronyms(query: Column) -> Column:
    """Whether a word of two to five capitals occurs."""
    return query.rlike(r"(?<![A-Za-z0-9_])[A-Z]{2,5}(?![A-Za-z0-9_])")


def analyze_query(original: Column, expanded: Column, noise: NoiseWords = DEFAULT) -> Column:
    """Struct of the original, the expanded query, its distinct tokens, entity hints and whether it has acronyms."""
    return F.struct(
        original.alias("original"),
        expanded.alias("expanded"),
        F.array_distinct(tokenize(expanded, noise)).alias("tokens"),
        entity_hints(original).alias("entity_hints"),
        has_acronyms(original).alias("has_acronyms"),
    )


def snippet(text: Column, tokens: Column, width: int = 300) -> Column:
    """A window around the earliest of the tokens, trimmed; without a hit the first characters, untrimmed.

    Null and empty texts give the empty string.
    """
    places = F.filter(F.transform(tokens, lambda t: F.when(t != "", F.instr(F.lower(text), t))), lambda i: i > 0)
    start = F.greatest(F.lit(0), F.array_min(places) - 1 - width // 2)
    window = trim(F.substring(text, start + 1, F.lit(width)))
    return F.when(F.coalesce(text, F.lit("")) == "", "").when(F.size(places) > 0, window).otherwise(F.substring(text, 1, width))


def length_penalty(text: Column, least: int = 20) -> Column:
    """0.8 for texts of fewer than ``least`` estimated tokens, else 1."""
    return F.when(estimate_tokens(text) < least, 0.8).otherwise(1.0)


def chunk_id(path: Column, index: Column) -> Column:
    """md5 of path and running number."""
    return F.md5(F.concat(path, F.lit(":"), index.cast("string")))
