"""Terms of a record, counted where the record lies: no explosion and no shuffle of single tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tokens that are counted at once; a record with more is counted whole.
PIECE = 1_000_000


def _counted(keys: pa.Array, tokens: pa.ListArray, most: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, term, tf, first, len) of records, one batch for each length of n-gram."""
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = pc.list_flatten(tokens).dictionary_encode()
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    code, names = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary
    ends = np.cumsum(sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    gram, spelled, offset = code, names, np.zeros(len(sizes), dtype=np.int64)
    for n in range(1, most + 1):
        if n > 1:
            # a gram of n tokens is one of n - 1 and the token after it, in the same record
            at = np.arange(max(len(code) - n + 1, 0))
            at = at[at + n <= ends[row[at]]]
            pair, gram_of = np.unique(before[at] * max(len(names), 1) + code[at + n - 1], return_inverse=True)
            spelled = pc.binary_join_element_wise(spelled.take(pa.array(pair // max(len(names), 1))), names.take(pa.array(pair % max(len(names), 1))), " ")
            gram = np.full(len(code), -1, dtype=np.int64)
            gram[at] = gram_of
        else:
            at = np.arange(len(code))
        own, first, counts = np.unique(row[at] * max(len(spelled), 1) + gram[at], return_index=True, return_counts=True)
        r, g = own // max(len(spelled), 1), own % max(len(spelled), 1)
        place = at[first] - (ends[r] - sizes[r]) + offset[r]
        yield pa.RecordBatch.from_arrays(
            [keys.take(pa.array(r)), spelled.take(pa.array(g)).cast(pa.string()), pa.array(counts.astype(np.int64)), pa.array(place), pa.array(sizes[r])],
            names=["k", "term", "tf", "first", "len"],
        )
        offset += np.maximum(sizes - n + 1, 0)
        before = gram


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.ListArray]]:
    """Keys and token lists of runs of records with at most ``PIECE`` tokens."""
    for batch in batches:
        keys, lists = batch.column(0), batch.column(1)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        begin = held = 0
        for end, size in enumerate(sizes.tolist() + [0], 1):
            if end > len(sizes) or (held and held + size > PIECE):
                if end - 1 > begin:
                    yield keys.slice(begin, end - 1 - begin), lists.slice(begin, end - 1 - begin)
                begin, held = end - 1, 0
            held += size


def count_terms(df: DataFrame, key: str, tokens: Column, most: int = 1) -> DataFrame:
    """Rows (key, term, tf, first, len): the 1- to ``most``-grams of the tokens of each row.

    ``tf`` is their number in the row, ``first`` the place of the first among all its grams, shorter grams before longer
    ones, ``len`` the number of its tokens. Null and empty token lists give no rows; rows of equal key are counted apart.
    """
    schema = T.StructType(
        [T.StructField("k", df.schema[key].dataType), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("first", T.LongType()), T.StructField("len", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, lists in _pieces(batches):
            yield from _counted(keys, lists, most)

    return df.select(F.col(key).alias("k"), tokens.alias("w")).mapInArrow(run, schema).withColumnRenamed("k", key)


def pack_terms(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """Rows (key, terms, tfs, len), one for each row: its distinct tokens, the number of each, and of all; null lists are empty."""
    schema = T.StructType(
        [T.StructField("k", df.schema[key].dataType), T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("tfs", T.ArrayType(T.LongType())), T.StructField("len", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, lists in _pieces(batches):
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            words = pc.list_flatten(lists).dictionary_encode()
            code, names = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary
            own, counts = np.unique(np.repeat(np.arange(len(sizes)), sizes) * max(len(names), 1) + code, return_counts=True)
            ends = pa.array(np.searchsorted(own, np.arange(len(sizes) + 1) * max(len(names), 1)).astype(np.int32))
            terms = names.take(pa.array(own % max(len(names), 1))).cast(pa.string())
            packed = [pa.ListArray.from_arrays(ends, x) for x in (terms, pa.array(counts.astype(np.int64)))]
            yield pa.RecordBatch.from_arrays([keys, *packed, pa.array(sizes)], names=["k", "terms", "tfs", "len"])

    return df.select(F.col(key).alias("k"), tokens.alias("w")).mapInArrow(run, schema).withColumnRenamed("k", key)
