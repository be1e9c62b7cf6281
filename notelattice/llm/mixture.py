"""Mixing sources to target weights by cube-method balanced sampling.

Sizes are tokens of a public vocabulary, T is the size of all documents of the listed sources, and
a source is to fill target_share * T with no document used more than max_repeats times. What a
source can reach fixes its rate r = min(share * T / size, max_repeats): every document is used
floor(r) times, and once more with probability f = r - floor(r). The extra uses are drawn by the
cube method: inclusion probabilities move through the null space of the balancing constraints
(token total and document total), one document settling at each step, until fewer documents than
constraints + 1 are open. This flight runs in blocks of (source, bucket) in parallel, each block
passing on at most two open documents; the rest meet again in coarser blocks until one small
landing problem per source remains, which is settled so that the token total is closest.

Source names are trimmed and lower-cased. Defined results: a null text has size 0 and its document
is used like any other, documents without a listed source are left out, a source without documents
has size 0 and reaches 0, an empty table reaches 0 everywhere.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelattice.session import materialize

from .bpe import count_tokens
from .records import spread

#: Documents in a block of a flight, and in a lane of it at least.
BLOCK, LANE = 5_000, 24
_NEAR = 1e-9


def _step(q: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """One step of each row of three open probabilities, along the vector orthogonal to their sizes and to (1, 1, 1)."""
    a, b, c = size.T
    v = np.stack([b - c, c - a, a - b], axis=1)
    v[~(np.abs(v) > 1e-12).any(axis=1)] = (1.0, -1.0, 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        up = np.where(v > 0, (1 - q) / v, np.where(v < 0, -q / v, np.inf)).min(axis=1)
        down = np.where(v > 0, q / v, np.where(v < 0, (q - 1) / v, np.inf)).min(axis=1)
    return np.clip(q + np.where(draw * (up + down) < down, up, -down)[:, None] * v, 0, 1)


def _is_open(p: np.ndarray) -> np.ndarray:
    return (p > _NEAR) & (p < 1 - _NEAR)


def flight(chance: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move probabilities within the null space of (size total, count total) until at most two are open.

    The open documents fly in lanes, one step of every lane at a time; what the lanes leave open flies on in fewer lanes.
    """
    p = chance.astype(float).copy()
    scaled = sizes / max(float(sizes.max(initial=0)), 1.0)
    while True:
        queue = np.flatnonzero(_is_open(p))
        if len(queue) < 3:
            return np.where(p < _NEAR, 0.0, np.where(p > 1 - _NEAR, 1.0, p))
        lanes = max(1, len(queue) // LANE)
        bounds = np.linspace(0, len(queue), lanes + 1).astype(int)
        window, at, end = queue[bounds[:-1, None] + np.arange(3)], bounds[:-1] + 3, bounds[1:]
        while len(window):
            moved = _step(p[window], scaled[window], rng.random(len(window)))
            p[window] = moved
            for j in range(3):
                fresh = ~_is_open(moved[:, j]) & (at < end)
                window[fresh, j] = queue[at[fresh]]
                at = at + fresh
            going = _is_open(p[window]).all(axis=1)
            window, at, end = window[going], at[going], end[going]


def landing(chance: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Settle at most a few open documents so that the size total stays closest to its expectation."""
    p = chance.copy()
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if len(open_):
        goal = float((p[open_] * sizes[open_]).sum())
        choices = [[(m >> j) & 1 for j in range(len(open_))] for m in range(1 << len(open_))]
        p[open_] = min(choices, key=lambda c: (abs(float(np.dot(c, sizes[open_])) - goal), c))
    return p


def _clean(name: str):
    return F.lower(F.regexp_replace(name, r"^\s+|\s+$", ""))


def source_sizes(documents: DataFrame, targets: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Rows (key, source, size) of the documents of listed sources, written once: the encoding is the dear part."""
    rows = spread(documents.select(key, source, text)).select(F.col(key).alias("k"), _clean(source).alias("source"), F.col(text).cast("string").alias("t"))
    names = targets.select(_clean("source").alias("source")).distinct()
    kept = rows.join(F.broadcast(names), "source", "left_semi")  # mix_targets has a row per source: fixed and small
    return materialize(count_tokens(kept.select("k", "source", "t"), ["k", "source"], "t", vocabulary, "size"), "sizes")


def plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows (source, target_share, max_repeats, documents, size, total, wanted, rate, short), one per target."""
    own = sized.groupBy("source").agg(F.count("*").alias("documents"), F.sum("size").alias("size"))
    total = own.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    goal = targets.select(_clean("source").alias("source"), "target_share", "max_repeats")
    rows = goal.join(own, "source", "left").crossJoin(total).fillna(0, ["documents", "size"])
    wanted = F.col("target_share") * F.col("total")
    rate = F.when(F.col("size") > 0, F.least(wanted / F.nullif("size", F.lit(0)), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return rows.withColumns({"wanted": wanted, "rate": rate, "short": F.col("max_repeats") * F.col("size") < wanted})


def draw(sized: DataFrame, planned: DataFrame, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """Rows (k, source, size, uses): how often each document is used. Same input and seed, same result."""
    rates = planned.select("source", F.floor("rate").alias("whole"), (F.col("rate") - F.floor("rate")).alias("chance"))
    rows = sized.join(F.broadcast(rates), "source")  # a row per target
    counts = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.count("*").alias("n")).collect()}  # a row per target
    order = F.xxhash64(F.col("k").cast("string"), F.lit(seed))
    blocks = F.create_map(*[x for s, n in counts.items() for x in (F.lit(s), F.lit(-(-n // block)))]) if counts else F.create_map(F.lit(""), F.lit(1))
    rows = rows.withColumns({"h": order, "b": F.pmod(order, F.try_element_at(blocks, F.col("source"))).cast("int")})
    schema = "k {0}, source string, size long, whole long, chance double, h long".format(sized.schema["k"].dataType.simpleString())
    names = ["k", "source", "size", "whole", "chance", "h"]

    def fly(last: bool):
        def run(table: pa.Table) -> pa.Table:
            table = table.select(names).sort_by([("h", "ascending"), ("k", "ascending")])
            sizes = table["size"].to_numpy()
            seeds = [seed, int(pd.util.hash_array(np.array([table["source"][0].as_py()], dtype=object))[0] % (1 << 32)), int(table["h"][0].as_py() % (1 << 32))]
            p = flight(table["chance"].to_numpy(), sizes, np.random.default_rng(seeds))
            if last:
                p = landing(p, sizes)
            return table.set_column(4, "chance", pa.array(p))

        return run

    most = max(counts.values(), default=0)
    parts = int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    settled = None
    while True:
        last = most <= block
        # a task for each block, as far as there are so many: blocks are small in bytes and would be joined
        blocks = sum(-(-min(n, most) // block) for n in counts.values()) or 1
        flown = rows.repartition(min(blocks, parts), "source", "b").groupBy("source", "b").applyInArrow(fly(last), schema)
        if last:
            out = flown if settled is None else settled.unionByName(flown)
            return out.select("k", "source", "size", (F.col("whole") + F.round("chance").cast("long")).alias("uses"))
        flown = materialize(flown, "flight")
        done = flown.filter("chance = 0 or chance = 1")
        settled = done if settled is None else settled.unionByName(done)
        most = -(-most // block) * 2  # each block passes on two documents at most
        rows = flown.filter("chance > 0 and chance < 1").withColumn("b", F.pmod("h", F.lit(-(-most // block))).cast("int"))


def report(planned: DataFrame, drawn: DataFrame) -> DataFrame:
    """The plan with what was reached: tokens and documents with repeats, share of T and share of the mix.

    ``exhausted``: the draw stays below what is wanted although every document is used as often as allowed.
    """
    got = drawn.groupBy("source").agg(F.sum(F.col("size") * F.col("uses")).alias("tokens"), F.sum("uses").alias("uses"), F.max("uses").alias("most_uses"))
    rows = planned.join(got, "source", "left").fillna(0, ["tokens", "uses", "most_uses"])
    mix = got.agg(F.sum("tokens").alias("mix"))
    exhausted = (F.col("tokens") < F.col("wanted")) & (F.col("tokens") == F.col("max_repeats") * F.col("size"))
    return rows.crossJoin(F.broadcast(mix)).select(
        "*", exhausted.alias("exhausted"), (F.col("tokens") / F.nullif("total", F.lit(0))).alias("reached_share"), (F.col("tokens") / F.nullif("mix", F.lit(0))).alias("mix_share")
    )
