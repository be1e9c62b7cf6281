"""One row per key, without a shuffle of the rows whose key is not repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelattice.session import materialize

#: Repeated keys that are broadcast; with more, all rows meet by key.
REPEATED = 200_000


def once(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """Rows (key, name): of several rows of a key the largest value; rows of null key are left out.

    Keys alone are counted first. Where few are repeated, only their values are shuffled (combined before), and all
    others stay where they lie; ``rows`` is read twice.
    """
    rows = rows.filter(F.col(key).isNotNull()).select(key, value.alias(name))
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    repeated = materialize(counts.filter("n > 1").select(key), "repeated")
    most = F.max(name).alias(name)
    if repeated.count() > REPEATED:
        return rows.groupBy(key).agg(most)
    again = rows.join(F.broadcast(repeated), key, "left_semi").groupBy(key).agg(most)
    return rows.join(F.broadcast(repeated), key, "left_anti").unionByName(again)


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores, so a small one, in as many tasks as cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (k, t): one text of each key, the largest by code point of several; null texts are left out."""
    rows = spread(df.select(F.col(key).alias("k"), df[text].cast("string").alias("t"))).filter("t is not null")
    return once(rows, "k", F.col("t"), "t")
