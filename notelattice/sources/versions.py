"""A log of versions: which folders of a state or an index count.

A version is one small file, written aside and renamed to its number without overwriting. So a
version counts wholly or not at all, and of two writers that read the same version the second fails.
Renames are atomic on HDFS and local file systems; an object store needs a client with conditional writes.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from notelattice.session import hadoop_fs, read_text_file


class ConcurrentWriteError(RuntimeError):
    """Another writer has stored this version."""


class VersionLog:
    """Numbered entries below a folder; the highest number counts."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def numbers(self) -> list[int]:
        fs, p = hadoop_fs(self.spark, self.path)
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit())

    def entry(self, number: int) -> dict | None:
        text = read_text_file(self.spark, f"{self.path}/{number:012d}")
        return None if text is None else json.loads(text)

    def latest(self) -> tuple[int, dict | None]:
        """(number, entry) of the version that counts; (0, null) before the first."""
        numbers = self.numbers()
        return (numbers[-1], self.entry(numbers[-1])) if numbers else (0, None)

    def commit(self, number: int, entry: dict) -> None:
        """Store an entry under a free number: the one atomic step."""
        jvm = self.spark.sparkContext._jvm
        fs, target = hadoop_fs(self.spark, f"{self.path}/{number:012d}")
        fresh = jvm.org.apache.hadoop.fs.Path(f"{self.path}/.{uuid.uuid4().hex}")
        out = fs.create(fresh, True)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            if fs.exists(target):
                raise ConcurrentWriteError(f"version {number} of {self.path} is stored already")
            context.rename(fresh, target, options)
        except Exception as e:
            fs.delete(fresh, False)
            if not isinstance(e, ConcurrentWriteError) and fs.exists(target):
                raise ConcurrentWriteError(f"version {number} of {self.path} is stored already") from e
            raise

    def prune(self, keep: int) -> None:
        """Forget all but the last ``keep`` entries."""
        for number in self.numbers()[:-keep]:
            fs, p = hadoop_fs(self.spark, f"{self.path}/{number:012d}")
            fs.delete(p, False)
