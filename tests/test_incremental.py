from datetime import datetime

import pytest

from notelattice.operators.incremental import StateStore, latest_snapshot, replay_runs
from notelattice.plans.pipeline import p1_found
from notelattice.session import scratch_path
from notelattice.sources.versions import ConcurrentWriteError

SNAPSHOT = "key string, hash string"


def keys(df):
    return sorted(r.key for r in df.collect())


def test_runs(spark):
    store = StateStore(spark, scratch_path(spark, "t"))
    snap = lambda *rows: spark.createDataFrame(list(rows), SNAPSHOT)
    assert store.current().count() == 0 and store.last_run is None
    assert keys(store.run(1, snap(("a", "1"), ("b", "2"), ("c", None), (None, "9")))) == ["a", "b"]
    # unreadable b keeps its state, c becomes readable, d is new
    assert keys(store.run(2, snap(("a", "1"), ("b", None), ("c", "3"), ("d", "4")))) == ["c", "d"]
    assert keys(store.run(3, snap(("a", "x"), ("b", "2")))) == ["a"]
    assert sorted(map(tuple, store.current().collect())) == [("a", "x"), ("b", "2")]
    # forgotten and come back
    assert keys(store.run(4, snap(("c", "3")))) == ["c"]
    assert keys(store.run(5, snap().limit(0) if False else spark.createDataFrame([], SNAPSHOT))) == []
    assert store.current().count() == 0


def test_failure_in_the_work_loses_nothing(spark):
    store = StateStore(spark, scratch_path(spark, "t"))
    one = spark.createDataFrame([("a", "1"), ("b", "2")], SNAPSHOT)
    store.run(1, one)
    two = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4")], SNAPSHOT)

    def die(keys_):
        assert keys(keys_) == ["b", "c"]
        raise OSError("lost")

    with pytest.raises(OSError):
        store.run(2, two, work=die)
    assert store.last_run == 1 and store.version == 1
    # the next run, under another id, finds the same keys
    assert keys(store.run(3, two)) == ["b", "c"]
    # repeated after the commit: the same keys, no new version
    assert keys(store.run(3, two)) == ["b", "c"] and store.version == 2
    assert keys(store.run(4, two)) == []


def test_second_writer_fails(spark):
    store = StateStore(spark, scratch_path(spark, "t"))
    snap = lambda *rows: spark.createDataFrame(list(rows), SNAPSHOT)
    store.run(1, snap(("a", "1")))
    first, second = store.begin(2, snap(("a", "2"))), StateStore(spark, store.path).begin(3, snap(("a", "3")))
    store.commit(first)
    with pytest.raises(ConcurrentWriteError):
        store.commit(second)
    assert store.last_run == 2 and [tuple(r) for r in store.current().collect()] == [("a", "2")]
    assert keys(store.run(3, snap(("a", "3")))) == ["a"]
    for i in range(4, 8):
        store.run(i, snap(("a", str(i))))
    assert len(store.log.numbers()) == 2 and [tuple(r) for r in store.current().collect()] == [("a", "7")]


def brute(files, runs):
    stored, out = {}, set()
    for run, scan in runs:
        rows = {}
        for s, path, at, checksum in files:
            if s == scan and path is not None:
                k = (at is not None, at or datetime.min, checksum is not None, (checksum or "").lower())
                if path not in rows or k > rows[path][0]:
                    rows[path] = (k, checksum and checksum.lower())
        for path, (_, checksum) in rows.items():
            if checksum is not None and stored.get(path) != checksum:
                out.add((run, path))
                stored[path] = checksum
        stored = {p: c for p, c in stored.items() if p in rows}
    return out


def test_dirty_scans(spark):
    import random

    r = random.Random(7)
    files = [
        (r.randint(1, 5), r.choice([None, *"abcdefgh"]), r.choice([None, datetime(2024, 1, r.randint(1, 5))]), r.choice([None, "AB", "ab", "cd", "Ef", ""]))
        for _ in range(300)
    ]
    df = spark.createDataFrame([(*f, "x", 1) for f in files], "scan_id int, file_path string, last_modified timestamp, checksum string, key string, hash int")
    order = [(1, 1), (4, 2), (5, 2), (7, 9), (8, 4), (9, 1)]  # scan 9 holds nothing
    store = StateStore(spark, scratch_path(spark, "t"))
    found = replay_runs(store, latest_snapshot(df, ["scan_id"], "file_path", "last_modified", "checksum"), "scan_id", order)
    got = [(x.run, x.key) for x in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(files, order)


def test_no_runs(spark, tmp_path):
    spark.createDataFrame([], "scan_id int, file_path string, title string, last_modified timestamp, size_bytes bigint, checksum string").write.parquet(f"{tmp_path}/files.parquet")
    spark.createDataFrame([], "run_id int, scan_id int, started_at timestamp, finished_at timestamp, status string").write.parquet(f"{tmp_path}/index_runs.parquet")
    out = p1_found(spark, str(tmp_path))
    assert out.columns == ["run_id", "file_path"] and out.collect() == []


def test_stream(spark, tmp_path):
    from notelattice.streaming.changes import SnapshotStream, stream_changes

    schema = "scan_id int, file_path string, last_modified timestamp, checksum string"
    got, fail = [], [True]

    def sink(df, scan):
        if scan == 2 and fail.pop():
            fail.append(False)
            raise OSError("lost")
        got.append((scan, keys(df)))

    make = lambda: SnapshotStream(spark, schema, f"{tmp_path}/state", sink)

    def arrive(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = stream_changes(make(), f"{tmp_path}/in", f"{tmp_path}/check", 1)
        q.awaitTermination()

    arrive((1, "a", None, "1"), (1, "b", None, "2"))
    arrive((1, "c", None, "3"))  # the same snapshot, in a second file
    arrive((2, "a", None, "1"))
    arrive((2, "b", None, "4"), (2, "c", None, "3"))
    assert got == [(1, ["a", "b", "c"])]
    with pytest.raises(Exception):
        arrive((3, "b", None, "4"))
    arrive((3, "d", None, "4"))  # the failed batch is offered again
    make().finish()
    assert got == [(1, ["a", "b", "c"]), (2, ["b"]), (3, ["d"])]
