"""Frequency of every distinct term: burst-trie counting.

Each task accumulates occurrences and record counts in a burst trie: terms are routed by the
shortest prefix whose container is still small, and a container that grows too large bursts into
one container per next character. The containers are written as compact sub-tries. Cut points
from a bounded sample of their entries then divide the term space into ranges of similar size, the
matching pieces of the sub-tries meet by range, and each range is merged in one task's memory.

A term is a maximal run of ``[a-z0-9_]`` in the lower-cased text. Defined results: null texts are
no record, the empty text is a record without terms, repeated rows of a key are one record (the
largest text by code point if they differ), an empty table gives no terms.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelattice.session import materialize

from .records import texts

#: Distinct suffixes a container holds before it bursts.
BURST = 2_000
#: Distinct terms a task holds before it writes its trie and starts another.
TRIE_TERMS = 400_000
#: Summed sub-trie entries that one merge range aims at, least and most, unless there would be more than so many ranges.
RANGE_LEAST, RANGE_MOST, RANGES = 20_000, 400_000, 10_000
#: Sampled terms for each range.
PER_RANGE = 20

TERM = re.compile(r"[a-z0-9_]+")

SUBTRIE = T.StructType(
    [
        T.StructField("prefix", T.StringType()),
        T.StructField("suffixes", T.ArrayType(T.StringType(), False)),
        T.StructField("counts", T.ArrayType(T.LongType(), False)),
        T.StructField("records", T.ArrayType(T.LongType(), False)),
    ]
)


class BurstTrie:
    """Prefixes that burst route a term to the container of its longest routed prefix plus one character."""

    def __init__(self, burst: int = BURST) -> None:
        self.burst = burst
        self.inner: set[str] = set()
        self.containers: dict[str, dict[str, list[int]]] = {"": {}}
        self.size = 0

    def route(self, term: str) -> str:
        depth, inner = 0, self.inner
        prefix = ""
        while prefix in inner and depth < len(term):
            depth += 1
            prefix = term[:depth]
        return prefix

    def add(self, term: str, count: int, records: int) -> None:
        prefix = self.route(term)
        container = self.containers.get(prefix)
        if container is None:
            container = self.containers[prefix] = {}
        suffix = term[len(prefix) :]
        cell = container.get(suffix)
        if cell is None:
            container[suffix] = [count, records]
            self.size += 1
            if len(container) > self.burst and prefix not in self.inner:
                self.split(prefix)
        else:
            cell[0] += count
            cell[1] += records

    def split(self, prefix: str) -> None:
        """One container per next character; what ends at the prefix stays in its own container."""
        self.inner.add(prefix)
        container = self.containers.pop(prefix)
        for suffix, cell in container.items():
            self.containers.setdefault(prefix + suffix[:1], {})[suffix[1:]] = cell
        for grown in {prefix + suffix[:1] for suffix in container if suffix}:
            if len(self.containers[grown]) > self.burst:
                self.split(grown)

    def rows(self) -> Iterator[tuple[str, list[str], list[int], list[int]]]:
        """Sub-tries with their suffixes in order."""
        for prefix in sorted(self.containers):
            cells = sorted(self.containers[prefix].items())
            if cells:
                yield prefix, [s for s, _ in cells], [c[0] for _, c in cells], [c[1] for _, c in cells]


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = {"prefix": pa.string(), "suffixes": pa.list_(pa.string()), "counts": pa.list_(pa.int64()), "records": pa.list_(pa.int64()), "range": pa.int32()}
    names = schema.fieldNames()
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[n]) for i, n in enumerate(names)], names=names)


def _accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie, records = BurstTrie(), 0
    for batch in batches:
        occurrences, present = Counter(), Counter()
        for text in batch.column(0).to_pylist():
            if text is None:
                continue
            records += 1
            terms = TERM.findall(text.lower())
            occurrences.update(terms)
            present.update(set(terms))
        for term, count in occurrences.items():
            trie.add(term, count, present[term])
        if trie.size > TRIE_TERMS:
            yield _batch(list(trie.rows()), SUBTRIE)
            trie = BurstTrie()
    rows = list(trie.rows())
    rows.append((None, [], [], [records]))
    yield _batch(rows, SUBTRIE)


def _cut_points(subtries: DataFrame, target: int) -> list[str]:
    """Terms at which merge ranges begin, about ``target`` entries apart.

    They are every ``PER_RANGE``-th of a sample of the entries by hash, about ``PER_RANGE`` for each range. With at most ``RANGES``
    ranges the sample is bounded at any size of the vocabulary, and equal prefixes of any length do no harm.
    """
    share = min(1.0, PER_RANGE / target)
    words = F.transform("suffixes", lambda s: F.concat(F.col("prefix"), s))
    chosen = F.filter(words, lambda w: F.pmod(F.xxhash64(w, F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = sorted(r["w"] for r in subtries.filter("prefix is not null").select(F.explode(chosen).alias("w")).distinct().collect())
    return sample[PER_RANGE - 1 :: PER_RANGE]


def term_frequencies(df: DataFrame, key: str, text: str, common_share: float = 0.5, rare_records: int = 2) -> DataFrame:
    """Rows (term, count, document_count, mark) of every distinct term.

    ``mark`` is ``rare`` for terms in at most ``rare_records`` records, ``common`` for terms in more
    than ``common_share`` of them, else null. A term that is both is ``rare``.
    """
    spark = df.sparkSession
    rows = texts(df, key, text)
    records = rows.select("t")
    subtries = materialize(records.mapInArrow(_accumulate, SUBTRIE), "subtries")
    total = subtries.agg(
        F.sum(F.when(F.col("prefix").isNull(), F.col("records")[0])).alias("n"), F.sum(F.size("suffixes")).alias("terms")
    ).first()
    n, terms = total["n"] or 0, total["terms"] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    target = max(min(RANGE_MOST, max(RANGE_LEAST, terms // (2 * parts) + 1)), terms // RANGES)
    cuts = _cut_points(subtries, target)
    spread = T.StructType([T.StructField("range", T.IntegerType()), *SUBTRIE.fields])
    counted = T.StructType([T.StructField("term", T.StringType()), T.StructField("count", T.LongType()), T.StructField("document_count", T.LongType())])

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cut each sub-trie where ranges begin; most lie in one range whole."""
        for batch in batches:
            out = []
            for prefix, suffixes, counts, records in zip(*(c.to_pylist() for c in batch.columns)):
                if not suffixes:
                    continue
                shared = [prefix + s for s in suffixes]
                at = 0
                r = bisect_left(cuts, shared[0] + "\0")
                while at < len(shared):
                    end = bisect_left(shared, cuts[r], at) if r < len(cuts) else len(shared)
                    if end > at:
                        out.append((r, prefix, suffixes[at:end], counts[at:end], records[at:end]))
                    at, r = end, r + 1
            if out:
                yield _batch(out, spread)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Merge matching sub-tries, one range at a time; rows arrive in order of range."""
        held: dict[str, list[int]] = {}
        current = None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array([c[0] for c in held.values()], pa.int64()), pa.array([c[1] for c in held.values()], pa.int64())],
                names=counted.fieldNames(),
            )

        for batch in batches:
            for r, prefix, suffixes, counts, records in zip(*(c.to_pylist() for c in batch.columns)):
                if r != current and held:
                    yield done()
                    held = {}
                current = r
                for suffix, count, n_records in zip(suffixes, counts, records):
                    cell = held.get(prefix + suffix)
                    if cell is None:
                        held[prefix + suffix] = [count, n_records]
                    else:
                        cell[0] += count
                        cell[1] += n_records
        if held:
            yield done()

    ranges = subtries.mapInArrow(divide, spread).repartition(min(parts, len(cuts) + 1), "range").sortWithinPartitions("range")
    merged = ranges.mapInArrow(merge, counted)
    mark = F.when(F.col("document_count") <= rare_records, "rare").when(F.col("document_count") > common_share * F.lit(n), "common")
    return merged.withColumn("mark", mark)
