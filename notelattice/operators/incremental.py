"""Processing only new or changed records.

The state is a table of (key, content hash) in a folder per version, and a log names the
version that counts. A run hashes its current rows, joins them with the state and writes what is new or changed
together with the next version (``begin``); the work is done on these keys; then one atomic step makes the version count
(``commit``). A run that dies before its commit, in its own steps or in the work, has changed nothing that counts, so
the next run, whatever its id, finds the same records again; a run that is repeated after its commit gets what it
committed. Of two runs over the same version the second to commit fails. Nothing is skipped, and nothing
committed is processed twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelattice.session import remove_path
from notelattice.sources.versions import VersionLog

STATE_SCHEMA = "key string, hash string"


@dataclass
class Pending:
    """A run that has begun: the keys to process and the version that counts once it is committed."""

    run: object
    keys: DataFrame
    version: int
    folder: str
    done: bool = False


class StateStore:
    """Versioned (key, hash) tables below one folder, and the log of those that count."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.log = VersionLog(spark, f"{self.path}/log")

    @property
    def version(self) -> int:
        return self.log.latest()[0]

    @property
    def last_run(self):
        """The run committed last, or null."""
        entry = self.log.latest()[1]
        return entry["run"] if entry else None

    def _read(self, folder: str) -> DataFrame:
        return self.spark.read.schema("key string, hash string, changed boolean").parquet(f"{self.path}/{folder}")

    def current(self) -> DataFrame:
        """The stored (key, hash) rows; empty before the first commit."""
        entry = self.log.latest()[1]
        return self._read(entry["folder"]).select("key", "hash") if entry else self.spark.createDataFrame([], STATE_SCHEMA)

    def committed(self, version: int | None = None) -> DataFrame:
        """Keys that the run of a version (the last by default) had to process; reads only these."""
        entry = self.log.entry(version) if version else self.log.latest()[1]
        return self._read(entry["folder"]).filter("changed").select("key") if entry else self.spark.createDataFrame([], "key string")

    def begin(self, run, current: DataFrame) -> Pending:
        """Join a full snapshot (key, hash) with the state; nothing counts before ``commit``.

        One row per key. A null hash means that the content could not be read: nothing is processed
        and what is stored for the key stays. Keys of the state missing from the snapshot are
        forgotten. Null keys are left out; an empty snapshot empties the state.
        """
        version, entry = self.log.latest()
        if entry and run is not None and entry["run"] == run:
            return Pending(run, self.committed(), version, entry["folder"], done=True)
        stored = self.current().withColumnRenamed("hash", "old")
        joined = current.filter("key is not null").select("key", "hash").join(stored, "key", "left")
        changed = F.col("hash").isNotNull() & ~F.col("hash").eqNullSafe(F.col("old"))
        after = joined.select("key", F.coalesce("hash", "old").alias("hash"), changed.alias("changed")).filter("hash is not null")
        # a folder of its own: no writer touches that of another. One table is both the next state and, as a partition, what is to be processed
        folder = f"v{version + 1:08d}-{uuid.uuid4().hex[:8]}"
        after.write.partitionBy("changed").parquet(f"{self.path}/{folder}")
        return Pending(run, self._read(folder).filter("changed").select("key"), version + 1, folder)

    def commit(self, pending: Pending, keep: int | None = 2) -> None:
        """Make a begun run count; ``keep`` versions remain on disk (null: all).

        Raises ``ConcurrentWriteError`` if another run was committed since this one began.
        """
        if pending.done:
            return
        self.log.commit(pending.version, {"run": pending.run, "folder": pending.folder})
        if keep is not None and pending.version > keep:
            for number in self.log.numbers()[:-keep]:
                remove_path(self.spark, f"{self.path}/{self.log.entry(number)['folder']}")
            self.log.prune(keep)

    def abandon(self, pending: Pending) -> None:
        """Remove what a run wrote that will not be committed."""
        if not pending.done:
            remove_path(self.spark, f"{self.path}/{pending.folder}")

    def run(self, run, current: DataFrame, keep: int | None = 2, work: Callable[[DataFrame], object] | None = None) -> DataFrame:
        """Begin, do the work on the keys, commit; returns the keys. If the work fails nothing counts."""
        pending = self.begin(run, current)
        if work is not None:
            try:
                work(pending.keys)
            except BaseException:
                self.abandon(pending)
                raise
        self.commit(pending, keep)
        return pending.keys


def latest_snapshot(rows: DataFrame, by: list[str], key: str, at: str, hash_: str) -> DataFrame:
    """Rows (*by, key, hash): of several rows of a key the latest, null being earliest, then the larger hash.

    The hash is lower-cased. Combined before the shuffle.
    """
    best = F.max(F.struct(F.col(at).alias("t"), F.lower(hash_).alias("h")))
    return rows.filter(F.col(key).isNotNull()).groupBy(*by, F.col(key).alias("key")).agg(best.alias("s")).select(*by, "key", F.col("s.h").alias("hash"))


def replay_runs(store: StateStore, snapshots: DataFrame, scan: str, runs: list[tuple]) -> DataFrame | None:
    """Commit runs (run, scan) in order, each over the snapshot of its scan; rows (run, key) of all of them.

    ``snapshots`` is written once, a folder per scan, so that each run reads its scan alone.
    """
    spark = store.spark
    path = f"{store.path}/snapshots"
    snapshots.write.mode("overwrite").partitionBy(scan).parquet(path)
    laid = spark.read.schema(snapshots.schema).parquet(path)
    out = None
    for run, own in runs:
        keys = store.run(run, laid.filter(F.col(scan) == own).select("key", "hash"), keep=None).select(F.lit(run).alias("run"), "key")
        out = keys if out is None else out.unionByName(keys)
    return out
