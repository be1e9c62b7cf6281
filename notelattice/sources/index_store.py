"""The index: parquet tables below a root, and a log of manifests that name the folder of each table.

Plain parquet has no row updates. A change is an anti-join with the old rows and a union with the new ones,
written to a folder of its own; the next manifest makes it count. Inside a transaction all changes
of all tables count together, with one manifest, or not at all. Readers of the version before are not
disturbed, and a failed write leaves nothing that counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelattice import schemas
from notelattice.config import Settings, assert_writable
from notelattice.session import hadoop_fs, remove_path
from notelattice.sources.versions import VersionLog


class IndexStore:
    """Tables of an index; in read-only mode every change raises, and missing tables raise when the index is opened."""

    KEYS = {
        "chunks": ["chunk_id"], "files": ["file_path"], "nodes": ["node_id"], "edges": ["source_id", "target_id", "relation_type"],
        "edge_provenance": ["source_id", "target_id", "relation_type", "chunk_id"], "vectors": ["chunk_id"], "acronyms": ["acronym"],
    }

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None) -> None:
        self.spark, self.root, self.settings = spark, root.rstrip("/"), settings or Settings()
        self.log = VersionLog(spark, f"{self.root}/log")
        self._staged: dict[str, str] | None = None
        self._base: tuple[int, dict[str, str]] = (0, {})
        if self.settings.read_only:
            held = self._manifest()[1]
            missing = [t for t in ("chunks", "files", "nodes", "edges") if t not in held]
            if missing:
                raise RuntimeError(f"the index has no table {', '.join(missing)}")

    def _manifest(self) -> tuple[int, dict[str, str]]:
        """(version, folder of each table); inside a transaction that of its beginning."""
        if self._staged is not None:
            return self._base
        number, entry = self.log.latest()
        return number, entry or {}

    def _folder(self, table: str) -> str | None:
        if self._staged is not None and table in self._staged:
            return f"{self.root}/{self._staged[table]}"
        folder = self._manifest()[1].get(table)
        return None if folder is None else f"{self.root}/{folder}"

    def exists(self, table: str) -> bool:
        return self._folder(table) is not None

    def readable(self, table: str) -> bool:
        """Whether a table is there, has the columns of today and each of its files a readable footer."""
        try:
            folder = self._folder(table)
            return folder is not None and set(self.read(table).columns) <= set(self.spark.read.parquet(folder).columns) and self.read(table).count() >= 0
        except Exception:  # noqa: BLE001 - whatever makes it unreadable
            return False

    def read(self, table: str) -> DataFrame:
        """The rows of a table; an unknown or unwritten one is empty."""
        folder = self._folder(table)
        if folder is None:
            return self.spark.createDataFrame([], schemas.TABLES[table])
        return self.spark.read.schema(schemas.TABLES[table]).parquet(folder)

    @contextmanager
    def transaction(self) -> Iterator[IndexStore]:
        """All changes inside count together at its end; an exception undoes them.

        Raises ``ConcurrentWriteError`` at its end if another writer has changed the index since it began. An
        inner transaction is part of the outer one.
        """
        if self._staged is not None:
            yield self
            return
        assert_writable("change the index", self.settings)
        self._base, self._staged = self._manifest(), {}
        number, held = self._base
        try:
            yield self
            if self._staged:
                self.log.commit(number + 1, held | self._staged)
        except BaseException:
            for folder in self._staged.values():
                remove_path(self.spark, f"{self.root}/{folder}")
            raise
        else:
            # readers of the version before still have its tables
            older = [self.log.entry(n) or {} for n in self.log.numbers() if n < number]
            kept = set(held.values()) | set(self._staged.values())
            for folder in {f for entry in older for f in entry.values()} - kept:
                remove_path(self.spark, f"{self.root}/{folder}")
            self.log.prune(2)
        finally:
            self._staged = None

    def replace(self, table: str, rows: DataFrame) -> None:
        """Write all rows of a table."""
        assert_writable(f"replace {table}", self.settings)
        with self.transaction():
            folder = f"{table}/{uuid.uuid4().hex[:12]}"
            columns = self.spark.createDataFrame([], schemas.TABLES[table]).schema
            rows.select(*[F.col(f.name).cast(f.dataType) for f in columns]).write.parquet(f"{self.root}/{folder}")
            before = self._staged.get(table)
            self._staged[table] = folder
            if before is not None:  # written in this transaction and never counted; what was read from it is written by now
                remove_path(self.spark, f"{self.root}/{before}")

    def upsert(self, table: str, rows: DataFrame) -> None:
        """Rows replace those of equal key; the last of several new rows of a key is not defined, so pass one."""
        keys = self.KEYS[table]
        fresh = rows.dropDuplicates(keys)
        self.replace(table, self.read(table).join(fresh.select(*keys), keys, "left_anti").unionByName(fresh.select(*self.read(table).columns)))

    def append_new(self, table: str, rows: DataFrame) -> None:
        """Rows whose key is not stored yet; stored rows stay."""
        keys = self.KEYS[table]
        old = self.read(table)
        self.replace(table, old.unionByName(rows.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns)))

    def add_vectors(self, rows: DataFrame, replace: bool = False) -> None:
        """Vectors of the configured dimension; others are left out. Stored ones stay unless ``replace``."""
        fine = rows.filter(F.size("embedding") == self.settings.embedding_dim)
        (self.upsert if replace else self.append_new)("vectors", fine)

    def delete(self, table: str, keys: DataFrame) -> None:
        """Rows whose key columns, those of ``keys``, are listed."""
        self.replace(table, self.read(table).join(keys.distinct(), keys.columns, "left_anti"))

    def clear(self) -> None:
        """Empty every table."""
        with self.transaction():
            for table, schema in schemas.TABLES.items():
                self.replace(table, self.spark.createDataFrame([], schema))

    def get_chunks(self, ids: list[str]) -> DataFrame:
        """Chunks of these ids; the filter reaches the scan."""
        return self.read("chunks").filter(F.col("chunk_id").isin(ids))

    def get_chunk(self, chunk_id: str) -> dict | None:
        """One chunk, or null."""
        row = self.get_chunks([chunk_id]).first()
        return row.asDict() if row else None

    def get_file(self, path: str) -> dict | None:
        """The file of a path, or null."""
        row = self.read("files").filter(F.col("file_path") == path).first()
        return row.asDict() if row else None

    def chunk_ids_of(self, path: str) -> DataFrame:
        """Ids of the chunks of a file, in their order."""
        return self.read("chunks").filter(F.col("file_path") == path).orderBy("chunk_index").select("chunk_id")

    def chunk_ids_by_file(self) -> DataFrame:
        """Rows (file_path, chunk_ids) of all files, ids in the order of the chunks."""
        own = self.read("chunks").groupBy("file_path").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "chunk_id"))).alias("c"))
        return own.select("file_path", F.col("c.chunk_id").alias("chunk_ids"))

    def statistics(self) -> DataFrame:
        """One row: files, chunks, nodes of type entity, edges, vectors; counted now."""
        count = lambda t, name, where="true": self.read(t).filter(where).agg(F.count("*").alias(name))
        out = count("files", "total_files")
        for t, name, where in (("chunks", "total_chunks", "true"), ("nodes", "total_entities", "node_type = 'entity'"), ("nodes", "total_nodes", "true"), ("edges", "total_edges", "true"), ("vectors", "total_vectors", "true")):
            out = out.crossJoin(count(t, name, where))  # one row each
        return out

    def vector_stats(self) -> dict:
        """Count, dimension and size in MB of the vector table."""
        row = self.read("vectors").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
        folder, size = self._folder("vectors"), 0
        if folder is not None:
            fs, p = hadoop_fs(self.spark, folder)
            size = fs.getContentSummary(p).getLength()
        return {"count": row["n"], "dimension": row["d"] or self.settings.embedding_dim, "size_mb": round(size / 1e6, 2)}

