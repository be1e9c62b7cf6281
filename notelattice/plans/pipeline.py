"""Queries of the general training-data operators of the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelattice.operators.incremental import StateStore, latest_snapshot, replay_runs
from notelattice.session import scratch_path


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.parquet(f"{folder}/files.parquet")
    runs = spark.read.parquet(f"{folder}/index_runs.parquet").filter("status = 'ok'").select("run_id", "scan_id").orderBy("run_id")
    snapshots = latest_snapshot(files, ["scan_id"], "file_path", "last_modified", "checksum")
    order = [(r["run_id"], r["scan_id"]) for r in runs.collect()]  # a row per run: fixed and small
    store = StateStore(spark, scratch_path(spark, "runs"))
    found = replay_runs(store, snapshots, "scan_id", order)
    if found is None:
        return spark.createDataFrame([], "run_id int, file_path string")
    return found.select(F.col("run").cast("int").alias("run_id"), F.col("key").alias("file_path"))


QUERIES = {"p1_found": p1_found}

ORACLES = {
    "p1_found": """
WITH RECURSIVE snap AS (
  SELECT scan_id, file_path, lower(checksum) AS h FROM files WHERE file_path IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY scan_id, file_path ORDER BY last_modified DESC NULLS LAST, lower(checksum) DESC NULLS LAST) = 1),
runs AS (SELECT run_id, scan_id, row_number() OVER (ORDER BY run_id) AS i FROM index_runs WHERE status = 'ok'),
walk AS (
  SELECT 0 AS i, NULL::VARCHAR AS file_path, NULL::VARCHAR AS h, NULL::VARCHAR AS old, NULL::INT AS run_id
  UNION ALL
  SELECT r.i, s.file_path, coalesce(s.h, w.h), w.h, r.run_id
  FROM (SELECT max(i) AS i FROM walk) c JOIN runs r ON r.i = c.i + 1 JOIN snap s ON s.scan_id = r.scan_id
  LEFT JOIN walk w ON w.file_path = s.file_path AND w.h IS NOT NULL)
SELECT run_id, file_path FROM walk WHERE i > 0 AND h IS NOT NULL AND h IS DISTINCT FROM old""",
}
