"""Joins and numbering that no hot key or whole order brings into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notelattice.session import materialize

#: Rows of a key that one task takes at least before the key is split, and hot keys that are broadcast at most.
SPLIT_ROWS, HOT_KEYS = 50_000, 100_000
#: A term is hot if it is in at least 1 of so many records; the first share that leaves few enough terms counts.
HOT_SHARES = (256, 64, 16, 4, 1)


def spread_join(left: DataFrame, right: DataFrame, on: str, other: str, split: int = SPLIT_ROWS) -> DataFrame:
    """Inner join on ``on``; a key with more than ``split`` rows at the right is cut into parts by the hash of ``other``.

    Rows of the left with such a key go to each of its parts, so its rows should be few. At most ``HOT_KEYS`` keys are
    split: in a very large table the parts are larger instead. The right is read twice and should be a written table.
    """
    counts = right.groupBy(on).agg(F.count("*").alias("_n"))
    least = F.greatest(F.lit(split), F.ceil(F.sum("_n") / HOT_KEYS))
    limit = counts.agg(F.coalesce(least, F.lit(split)).alias("l")).first()["l"]
    hot = materialize(counts.filter(F.col("_n") > F.lit(limit)).select(on, F.ceil(F.col("_n") / F.lit(limit)).cast("int").alias("_parts")), "hot")
    if hot.isEmpty():
        return left.join(right, on)
    parts = F.coalesce("_parts", F.lit(1))
    cut = right.join(F.broadcast(hot), on, "left").withColumn("_part", F.pmod(F.xxhash64(other), parts).cast("int")).drop("_parts")
    copies = left.join(F.broadcast(hot), on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return copies.join(cut, [on, "_part"]).drop("_part")


def with_frequency(rows: DataFrame, corpus: DataFrame, n: int) -> DataFrame:
    """Rows with the column ``df`` of ``corpus`` (term, df), null where the corpus has no such term.

    Frequencies of hot terms are broadcast and their rows stay where they are; all other terms meet by shuffle, and none
    of these is in more than 1 of the share's records. A share of 1 in s leaves at most s times the mean number of
    distinct terms of a record, whatever the size of the collection. Both tables are read more than once and should be written ones.
    """
    found = corpus.agg(*[F.count(F.when(F.col("df") * s >= n, 1)).alias(str(s)) for s in HOT_SHARES]).first()
    share = next((s for s in HOT_SHARES if found[str(s)] <= HOT_KEYS), None)
    if share is None:  # more than HOT_KEYS terms in every record: each is in all, so any split by record is even
        return rows.join(corpus, "term", "left")
    is_hot = F.col("df") * share >= n
    marked = rows.join(F.broadcast(corpus.filter(is_hot)), "term", "left")
    cold = marked.filter("df is null").drop("df").join(corpus.filter(~is_hot), "term", "left")
    return marked.filter("df is not null").unionByName(cold)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``name``: the position from 0 in the whole order, by range partitions and a count for each."""
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    laid = materialize(laid, "ordered")
    part = F.shiftright("_at", 33)
    sizes = laid.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row per partition
    ahead = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")).alias("_ahead"))
    at = F.col("_at") - F.shiftleft(part, 33)
    return laid.withColumn("_part", part).join(F.broadcast(ahead), "_part").withColumn(name, F.col("_ahead") + at).drop("_part", "_ahead", "_at")
