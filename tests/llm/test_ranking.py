import math
from collections import defaultdict
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from notelattice.llm import ranking

ENGINES = ["s", "b", "g"]


@pytest.fixture(scope="module")
def rows(rng):
    value = lambda: rng.choice([None, float("nan"), -1.0, 0.0, round(rng.random() * 3, 1), rng.random() * 1000])
    out = [(rng.choice([1, 1, 1, 1, 2, 3, 4]), f"c{rng.randint(0, 120)}", value(), value(), value(), rng.choice([None, datetime(2024, 1, rng.randint(1, 9))])) for _ in range(900)]
    return out + out[:60] + [(None, "c1", 1.0, 1.0, 1.0, None), (1, None, 1.0, 1.0, 1.0, None), (9, "only", None, None, None, None)]


def brute(rows):
    low = lambda x: (0, 0) if x is None else (2, 0) if x != x else (1, x)
    last = {}
    for q, c, *scores, at in rows:
        if q is None or c is None:
            continue
        key = ((at is not None, at or datetime.min), *map(low, scores))
        if (q, c) not in last or key > last[q, c][0]:
            last[q, c] = (key, scores)
    place = {}
    for e in range(3):
        by = defaultdict(list)
        for (q, c), (_, s) in last.items():
            if s[e] is not None and not math.isnan(s[e]) and s[e] >= 0:
                by[q].append((-s[e], c))
        for q, items in by.items():
            for i, (_, c) in enumerate(sorted(items)):
                place[q, c, e] = (i, len(items))
    return last, place


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], "query_id int, chunk_id string, s double, b double, g double, at timestamp, q string, number int")


def test_reciprocal(spark, rows):
    last, place = brute(rows)
    value = defaultdict(float)
    for (q, c, e), (i, _) in place.items():
        value[q, c] += (1.5 if e == 2 else 1.0) / (61 + i)
    want = defaultdict(list)
    for (q, c), v in value.items():
        want[q].append((-round(v, 9), c))
    found = ranking.reciprocal_rank(table(spark, rows), "query_id", "chunk_id", {"s": 1.0, "b": 1.0, "g": 1.5}, "at", 5)
    got = defaultdict(list)
    for r in found.orderBy("query_id", "place").collect():
        got[r.query_id].append(r.chunk_id)
    assert dict(got) == {q: [c for _, c in sorted(v)[:5]] for q, v in want.items()}


def test_numbers_of_a_hot_group(spark):
    """One query with all rows and all ties: positions must run on across partitions."""
    n = 5000
    df = spark.range(n).select(F.lit(1).alias("q"), F.format_string("%05d", "id").alias("c"), F.lit(1.0).alias("s"))
    got = ranking.numbered(df, ["s"]).select("c", "number").collect()
    assert sorted((r.c, r.number) for r in got) == [(f"{i:05d}", i) for i in range(n)]


def test_leximin(spark, rows):
    last, place = brute(rows)
    want = defaultdict(list)
    for q, c in last:
        share = sorted(round((place[q, c, e][1] - place[q, c, e][0]) / place[q, c, e][1], 9) if (q, c, e) in place else 0.0 for e in range(3))
        want[q].append(([-x for x in share], c))
    got = defaultdict(list)
    for r in ranking.leximin(table(spark, rows), "query_id", "chunk_id", ENGINES, "at", None).orderBy("query_id", "place").collect():
        got[r.query_id].append(r.chunk_id)
    assert dict(got) == {q: [c for _, c in sorted(v)] for q, v in want.items()}


def test_a_weak_score_is_not_masked(spark):
    rows = [(1, "even", 0.5, 50.0, 5.0, None), (1, "spiky", 0.9, 1e9, 0.1, None), (1, "low", 0.1, 1.0, 1.0, None)]
    out = ranking.leximin(table(spark, rows), "query_id", "chunk_id", ENGINES, "at", 1).collect()
    assert [r.chunk_id for r in out] == ["even"]


def test_empty(spark, rows):
    none = table(spark, rows).limit(0)
    assert ranking.leximin(none, "query_id", "chunk_id", ENGINES, "at", 5).collect() == []
    assert ranking.reciprocal_rank(none, "query_id", "chunk_id", {"s": 1.0}, "at", 5).collect() == []
