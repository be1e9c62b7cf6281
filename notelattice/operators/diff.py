"""Difference of two file snapshots: unchanged, changed, new, moved, deleted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_diff(current: DataFrame, existing: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows (file_path, status) of two snapshots (file_path, checksum), one row per path in each.

    Status of current paths: unchanged, changed or new (``checksum`` compared null-safe). Of paths that are gone: moved
    if a new path has their checksum, else deleted. A path of null is left out. With ``by``, pairs of snapshots are told
    apart by these columns, which lead the rows.
    """
    cur = current.filter("file_path is not null").select(*by, "file_path", F.col("checksum").alias("c"), F.lit(True).alias("in_c"))
    old = existing.filter("file_path is not null").select(*by, "file_path", F.col("checksum").alias("o"), F.lit(True).alias("in_o"))
    both = cur.join(old, [*by, "file_path"], "full_outer")
    status = (
        F.when(F.col("in_c").isNull(), "gone").when(F.col("in_o").isNull(), "new").when(F.col("c").eqNullSafe(F.col("o")), "unchanged").otherwise("changed")
    )
    marked = both.select(*by, "file_path", F.coalesce("c", "o").alias("checksum"), status.alias("status"))
    fresh = marked.filter("status = 'new' and checksum is not null").select(*by, "checksum").distinct().withColumn("moved", F.lit(True))
    gone = marked.filter("status = 'gone'").join(fresh, [*by, "checksum"], "left")
    lost = gone.select(*by, "file_path", F.when(F.col("moved"), "moved").otherwise("deleted").alias("status"))
    return marked.filter("status <> 'gone'").select(*by, "file_path", "status").unionByName(lost)


def moves(current: DataFrame, existing: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows (moved_from, moved_to): gone paths and new paths of the same checksum."""
    marked = file_diff(current, existing, by)
    new = marked.filter("status = 'new'").join(current, [*by, "file_path"]).select(*by, F.col("file_path").alias("moved_to"), "checksum")
    gone = marked.filter("status = 'moved'").join(existing, [*by, "file_path"]).select(*by, F.col("file_path").alias("moved_from"), "checksum")
    return gone.join(new, [*by, "checksum"]).select(*by, "moved_from", "moved_to")


def paths_to_remove(diff: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Paths whose stored data goes: deleted, moved and changed ones."""
    return diff.filter(F.col("status").isin("deleted", "moved", "changed")).select(*by, "file_path").distinct()


def paths_to_index(diff: DataFrame) -> DataFrame:
    """Paths to read: new and changed ones."""
    return diff.filter(F.col("status").isin("new", "changed")).select("file_path")
