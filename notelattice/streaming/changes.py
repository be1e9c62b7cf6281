"""The incremental diff over a stream of snapshots: each snapshot is a run and is committed exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from notelattice.operators.incremental import StateStore, latest_snapshot
from notelattice.session import hadoop_fs

Sink = Callable[[DataFrame, object], None]


class SnapshotStream:
    """Snapshots that arrive as parquet files, in any number of files each, told apart by the column ``snapshot``.

    Arrived rows are kept by batch below the state, so a batch offered again after a failure takes its own place. A
    snapshot is complete when rows of a later one have arrived, or at ``finish``; complete snapshots are taken in
    order. The changed keys of each go to ``sink``, and only then is the snapshot committed: if the sink fails the
    same keys come again. Rows of a snapshot that is committed already, or older than that, change nothing.
    """

    def __init__(self, spark: SparkSession, schema: str, state: str, sink: Sink, snapshot: str = "scan_id", key: str = "file_path", at: str = "last_modified", hash_: str = "checksum") -> None:
        self.spark, self.schema, self.sink = spark, schema, sink
        self.snapshot, self.key, self.at, self.hash = snapshot, key, at, hash_
        self.store, self.arrived = StateStore(spark, state), f"{state.rstrip('/')}/arrived"

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, batch bigint").parquet(self.arrived)

    def batch(self, rows: DataFrame, number: int) -> None:
        """Take a batch: keep it, then run every snapshot that it completes."""
        rows.write.mode("overwrite").parquet(f"{self.arrived}/batch={number}")
        self._run(complete=False)

    def _run(self, complete: bool) -> None:
        fs, p = hadoop_fs(self.spark, self.arrived)
        if not fs.exists(p):
            return
        rows, last = self._rows(), self.store.last_run
        fresh = rows.filter(F.col(self.snapshot) > F.lit(last)) if last is not None else rows
        # a row per snapshot that waits: few
        waiting = sorted(r[0] for r in fresh.select(self.snapshot).filter(F.col(self.snapshot).isNotNull()).distinct().collect())
        for one in waiting if complete else waiting[:-1]:
            own = rows.filter(F.col(self.snapshot) == F.lit(one))
            self.store.run(one, latest_snapshot(own, [], self.key, self.at, self.hash), work=lambda keys, one=one: self.sink(keys, one))

    def finish(self) -> None:
        """Run what is left, the last snapshot included: its writer has ended."""
        self._run(complete=True)


def stream_changes(stream: SnapshotStream, source: str, checkpoint: str, files_per_trigger: int | None = None) -> StreamingQuery:
    """Read what has arrived below ``source`` and stop; call again for more, and ``finish`` after the last snapshot."""
    reader = stream.spark.readStream.schema(stream.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.parquet(source)
    return rows.writeStream.foreachBatch(stream.batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
