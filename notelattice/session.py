"""Session helpers: the shared scratch folder and durable intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN_ROOT: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """Folder every executor can read and write.

    The cluster names it in ``spark.checkpoint.dir``. Only a local-mode session without that
    setting gets a folder of its own; elsewhere a missing setting is an error, because a
    machine-local folder would be lost with its executor.
    """
    global _OWN_ROOT
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if _OWN_ROOT is None:
        _OWN_ROOT = tempfile.mkdtemp(prefix="notelattice-")
        atexit.register(shutil.rmtree, _OWN_ROOT, ignore_errors=True)
    return "file://" + _OWN_ROOT


_SCOPES: list[list[tuple[SparkSession, str]]] = []
_LOOSE: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch folder, removed with its scope or at the end of the process."""
    path = f"{scratch_root(spark)}/notelattice/{name}-{uuid.uuid4().hex[:12]}"
    (_SCOPES[-1] if _SCOPES else _LOOSE).append((spark, path))
    return path


def hadoop_fs(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as a Hadoop object."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path recursively; a missing path is fine."""
    fs, p = hadoop_fs(spark, path)
    fs.delete(p, True)


def _remove(tables: list[tuple[SparkSession, str]]) -> None:
    while tables:
        spark, path = tables.pop()
        try:
            remove_path(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone; what is left lies in the scratch folder
            pass


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Intermediate tables written inside are removed at the end; run the actions that read them inside.

    Tables written outside of any scope are read by a result that is not computed yet; they go with
    ``clear_scratch`` or at the end of the process.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        _remove(_SCOPES.pop())


@atexit.register
def clear_scratch() -> None:
    """Remove the intermediate tables written outside of scopes; results that read them can't be computed afterwards."""
    _remove(_LOOSE)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table that is read more than once to the shared scratch folder and read it back.

    This cuts the lineage durably: a lost executor costs a re-read of files, not a recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_text_file(spark: SparkSession, path: str) -> str | None:
    """The content of a small file; null if it does not exist."""
    fs, p = hadoop_fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()
