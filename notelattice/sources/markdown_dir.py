"""Scan of a directory tree of Markdown files.

Of a local tree the driver lists the paths and the tasks read them; symbolic links to files are skipped,
links to folders are followed inside the root only, and a folder is visited once. A root with a
scheme (a shared file system) is listed and read by the file source itself, which has no links. Names may
hold any character the file system takes. A file that vanishes or can't be read is left out with a warning, and only that file.
"""

from __future__ import annotations

import logging
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelattice.operators import markdown as md
from notelattice.session import hadoop_fs

from .exclude import excluded, matches, matches_directory

FILES = "file_path string, title string, last_modified timestamp, size_bytes bigint, checksum string, content string"
#: Bytes of contents that a task passes on at once.
READ_BYTES = 16_000_000


def list_markdown(root: str, exclude: list[str] | None = None) -> list[str]:
    """Paths of the ``.md`` files below a root in order; a missing root gives none, unreadable folders are skipped."""
    exclude = exclude or []
    root = os.path.abspath(root)
    real_root = os.path.realpath(root)
    seen: set[str] = set()
    found: list[str] = []

    def inside(path: str) -> bool:
        return path == real_root or path.startswith(real_root + os.sep)

    stack = [root]
    while stack:
        folder = stack.pop()
        real = os.path.realpath(folder)
        if real in seen or not inside(real):
            continue
        seen.add(real)
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError as e:
            logging.getLogger(__name__).warning("left out: %s", e)
            continue
        for entry in entries:
            relative = os.path.relpath(entry.path, root)
            if entry.is_dir(follow_symlinks=True):
                if not matches_directory(relative, exclude):
                    stack.append(entry.path)
            elif not entry.is_symlink() and entry.name.lower().endswith(".md") and not matches(relative, exclude):
                if os.access(entry.path, os.R_OK):
                    found.append(entry.path)
                else:
                    logging.getLogger(__name__).warning("left out, not readable: %s", entry.path)
    return sorted(found)


def literal(path: str) -> str:
    """A path that the file source takes as it is, not as a pattern."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def _read_local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stat and content of each path; files that fail are left out."""
    for batch in batches:
        rows = []
        for path in batch.column(0).to_pylist():
            try:
                with open(path, "rb") as f:
                    content = f.read()
                rows.append((path, int(os.stat(path).st_mtime * 1e6), len(content), content))
            except OSError as e:
                logging.getLogger(__name__).warning("left out: %s", e)
            if sum(r[2] for r in rows) > READ_BYTES:
                yield _batch(rows)
                rows = []
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["path", "modificationTime", "length", "content"])


def read_markdown(spark: SparkSession, root: str, exclude: list[str] | None = None) -> DataFrame:
    """Rows of the files below a root with title, times, size, md5 of the content, and the content.

    Bytes that are not UTF-8 become replacement characters; the checksum is that of the bytes.
    """
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]+://", root):
        fs, p = hadoop_fs(spark, root)
        if not fs.exists(p):
            return spark.createDataFrame([], FILES)
        top = fs.makeQualified(p).toUri().getPath().rstrip("/")
        source = spark.read.format("binaryFile").options(ignoreMissingFiles=True, ignoreCorruptFiles=True, recursiveFileLookup=True, pathGlobFilter="*.[mM][dD]")
        path = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?/*", "/")
        files = source.load(literal(root)).withColumn("path", path)
        if exclude:
            files = files.filter(~excluded(F.substr("path", F.lit(len(top) + 2)), exclude))
    else:
        paths = list_markdown(root, exclude)
        if not paths:
            return spark.createDataFrame([], FILES)
        tasks = min(len(paths), 4 * spark.sparkContext.defaultParallelism)
        listed = spark.createDataFrame(pa.table({"path": pa.array(paths, pa.string())})).repartition(tasks)
        files = listed.mapInArrow(_read_local, "path string, modificationTime timestamp, length bigint, content binary")
    text = F.make_valid_utf8(F.col("content").cast("string"))
    rows = files.select(F.col("path").alias("file_path"), F.col("modificationTime").alias("last_modified"), F.col("length").alias("size_bytes"), text.alias("content"), F.md5("content").alias("checksum"))
    return rows.select("file_path", md.title(F.col("content"), F.col("file_path")).alias("title"), "last_modified", "size_bytes", "checksum", "content")
