"""Repetition inside a document, and documents whose repetition is out of line.

``repetition`` measures each document exactly, over its whole text: the share of words in runs of
``run`` words that also start earlier in the text, and the shares of repeated lines, sentences and
word pairs. ``outliers`` rejects documents by robust multivariate distance: per language and
source a minimum-covariance-determinant estimate of centre and scatter of the transformed statistics is
reached by concentration steps over all documents of the group (each step an aggregation), from several starts of which
the one of least determinant counts, and documents beyond a chi-square quantile of the Mahalanobis distance are marked.

Words are maximal runs of Unicode letters and digits of the lower-cased text. Defined results: a
text without words (null, empty, blank) has the shares 0; documents of a group too small for an
estimate take that of a broader group where the caller names one, else they are not marked; null language
and source form groups of their own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelattice.session import materialize

WORD = regex.compile(r"[\p{L}\p{N}]+")
SENTENCE = regex.compile(r"[^.!?\n\r。！？]+")
STATISTICS = ["words_share", "lines_share", "sentences_share", "pairs_share"]
#: 0.999 quantile of chi-square by degrees of freedom, fixed values.
CHI_SQUARE_999 = {1: 10.828, 2: 13.816, 3: 16.266, 4: 18.467}
#: Documents a group needs for an estimate, steps of concentration, and the share they concentrate on.
GROUP_LEAST, STEPS, HALF = 30, 6, 0.75


def repeated_words(words: list[str], run: int) -> int:
    """How many words lie in a run that also starts at an earlier word."""
    seen, total, covered = set(), 0, 0
    for i, gram in enumerate(zip(*(words[j:] for j in range(run)))):
        if gram in seen:
            total += i + run - max(i, covered)
            covered = i + run
        else:
            seen.add(gram)
    return total


def _share(parts: list[str]) -> float:
    """Share of characters in parts that occurred before."""
    seen, again, every = set(), 0, 0
    for part in parts:
        part = part.strip()
        if part:
            every += len(part)
            if part in seen:
                again += len(part)
            seen.add(part)
    return again / every if every else 0.0


def repetition(df: DataFrame, keys: list[str], text: str, run: int = 6) -> DataFrame:
    """Rows (*keys, words, repeated, and the four shares), one for each row; no shuffle."""
    fields = [df.schema[k] for k in keys] + [T.StructField("words", T.LongType()), T.StructField("repeated", T.LongType())] + [T.StructField(s, T.DoubleType()) for s in STATISTICS]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(len(keys)).to_pylist():
                value = value or ""
                words = WORD.findall(value.lower())
                repeated = repeated_words(words, run)
                pairs = max(len(words) - 1, 0)
                again = pairs - len(set(zip(words, words[1:])))
                out.append((len(words), repeated, repeated / len(words) if words else 0.0, _share(value.splitlines()), _share(SENTENCE.findall(value)), again / pairs if pairs else 0.0))
            columns = list(zip(*out)) if out else [()] * 6
            kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 4]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=[f.name for f in fields])

    return df.select(*keys, df[text].cast("string")).mapInArrow(measure, T.StructType(fields))


def _moments(rows: DataFrame, groups: list[str], names: list[str]) -> DataFrame:
    """Count, sums and products of the statistics by group: one aggregation, combined before the shuffle."""
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(names)]
    products = [F.sum(F.col(x) * F.col(y)).alias(f"p{i}_{j}") for i, x in enumerate(names) for j, y in enumerate(names) if i <= j]
    return rows.groupBy(*groups).agg(F.count("*").alias("n"), *sums, *products)


def _estimates(moments: DataFrame, groups: list[str], d: int, least: int) -> DataFrame:
    """Centre, inverse and log determinant of the scatter of each group; groups without an estimate are left out."""
    doubles = T.ArrayType(T.DoubleType())
    schema = T.StructType([*(moments.schema[g] for g in groups), T.StructField("centre", doubles), T.StructField("inverse", doubles), T.StructField("determinant", T.DoubleType())])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                n = r["n"]
                if n < least:
                    continue
                centre = np.array([r[f"s{i}"] for i in range(d)]) / n
                scatter = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]) / n - np.outer(centre, centre)
                scatter += np.eye(d) * 1e-6
                rows.append((*[r[g] for g in groups], centre.tolist(), np.linalg.inv(scatter).ravel().tolist(), float(np.linalg.slogdet(scatter)[1])))
            columns = list(zip(*rows)) if rows else [()] * len(schema)
            kinds = [*(batch.schema.field(g).type for g in groups), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=schema.fieldNames())

    return moments.mapInArrow(solve, schema)


def _levels(rows: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Rows (*by, centre, inverse, level) of the groups large enough for an estimate."""
    d = len(names)
    # starts: the documents nearest the coordinate-wise median by sum and by largest gap, those of the least sum, and by hash
    middle = rows.groupBy(*by).agg(*[F.percentile_approx(x, 0.5, 1000).alias(f"m{i}") for i, x in enumerate(names)])
    gaps = [F.abs(F.col(x) - F.col(f"m{i}")) for i, x in enumerate(names)]
    begins = F.array(sum(gaps, F.lit(0.0)), F.greatest(*gaps), sum((F.col(x) for x in names), F.lit(0.0)), F.pmod(F.xxhash64("k"), F.lit(1 << 20)).cast("double"))
    far = rows.join(middle, by).select(*rows.columns, F.posexplode(begins).alias("start", "d2"))
    each = [*by, "start"]
    for _ in range(STEPS):
        cut = far.groupBy(*each).agg(F.percentile_approx("d2", HALF, 1000).alias("cut"))
        kept = far.join(cut, each).filter("d2 <= cut")
        estimates = materialize(_estimates(_moments(kept, each, names), each, d, int(GROUP_LEAST * HALF)), "estimate")  # a row per group and start
        far = rows.join(estimates, by).withColumn("d2", _squared(names)).select(*rows.columns, "start", "d2")
    best = materialize(estimates.groupBy(*by).agg(F.min_by(F.struct("centre", "inverse"), F.struct("determinant", "start")).alias("e")).select(*by, "e.*"), "estimate")
    # median of chi-square with d degrees of freedom, by the Wilson-Hilferty rule
    expected = d * (1 - 2 / (9 * d)) ** 3
    judged = rows.join(best, by).withColumn("d2", _squared(names))
    level = judged.groupBy(*by).agg(F.greatest(F.percentile_approx("d2", 0.5, 1000) / expected, F.lit(1.0)).alias("level"))
    return best.join(level, by)


def _squared(names: list[str]) -> Column:
    """Squared distance of a row from its estimate."""
    d = len(names)
    offset = [F.col(x) - F.col("centre")[i] for i, x in enumerate(names)]
    return sum((offset[i] * offset[j] * F.col("inverse")[i * d + j] for i in range(d) for j in range(d)), F.lit(0.0))


def outliers(measured: DataFrame, key: str, groups: list[str], broader: Sequence[list[str]] = ()) -> DataFrame:
    """Rows (key, *groups, distance, outlier) of every row of ``measured``.

    Statistics are transformed by log1p(20 x). The scatter of the concentrated part is widened by the
    ratio of the median squared distance to its chi-square median, the usual consistency step.
    A document whose group has no estimate takes that of the first of the ``broader`` groupings (parts
    of ``groups``, ``[]`` for all documents) that has one; these are estimated over all their documents.
    """
    names = [f"x{i}" for i in range(len(STATISTICS))]
    d = len(names)
    own = measured.select(F.col(key).alias("k"), F.lit("").alias("g"), *[F.coalesce(F.col(g).cast("string"), F.lit("\0null")).alias(f"g{i}") for i, g in enumerate(groups)], *[F.log1p(F.lit(20.0) * F.col(s)).alias(x) for s, x in zip(STATISTICS, names)])
    by = [f"g{i}" for i in range(len(groups))]
    rows = materialize(own, "statistics")
    out, parts = rows, []
    for level in (groups, *broader):
        near = ["g", *[f"g{groups.index(g)}" for g in level]]
        part = materialize(_levels(rows, near, names), "level")  # a row per group
        judged = out.join(part, near).withColumn("d2", _squared(names)).withColumn("distance", F.sqrt(F.col("d2") / F.col("level")))
        parts.append(judged.select(*rows.columns, "distance"))
        out = out.join(part, near, "left_anti").select(*rows.columns)
    parts.append(out.withColumn("distance", F.lit(None).cast("double")))
    every = reduce(DataFrame.unionAll, parts)
    outlier = F.coalesce(F.col("distance") > F.lit(CHI_SQUARE_999[d] ** 0.5), F.lit(False))
    return every.select(F.col("k").alias(key), *[F.when(F.col(b) != "\0null", F.col(b)).alias(g) for b, g in zip(by, groups)], F.round("distance", 6).alias("distance"), outlier.alias("outlier"))
