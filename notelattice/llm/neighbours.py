"""Most similar vectors for every vector: inverted file with product-quantised residuals.

Coarse centroids, and codebooks of the residuals' sub-vectors, are fitted on a bounded sample
(``SAMPLE`` vectors, chosen by key hash); every vector is indexed. A vector is filed under its
nearest centroid and, near a border, under each further centroid at most ``margin`` less similar
(``probes`` in all). A cell is searched by asymmetric distance: for each vector of the cell a table
of its products with all code words, summed over the codes of the others; the ``pool`` best are
reranked by exact cosine in double precision from the vectors in the cell. Where more of the cell than the
pool lie within the quantisation error of the k-th best, the whole cell is scored exactly, in blocks. Results of the cells of a vector are
merged into its k best.

Cells of more than ``CROWD`` vectors are cut again: each has centroids of its own, fitted on a bounded sample of the cell where
it lies, about one for ``FINE`` vectors, and its vectors are filed under these by the same rule. So the vectors searched
together stay a few hundred, and the work in proportion, as the collection grows; what is still crowded then (near
copies, which no centroid tells apart) is searched in pairs of parts, a task for each.

Exact copies are searched once: a class of equal embeddings has one representative and its k + 1
smallest keys, which is all that ties by key can let into a k-best list.

Usable embeddings have exactly ``dim`` components, all finite, not all zero; of several usable
rows of a key the one with the latest timestamp counts (null is earliest, then the larger array).
Defined results: keys without a usable row are in no result; ties of similarity go to the smaller
key; null keys are left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelattice.operators.skew import spread_join
from notelattice.session import materialize

from .records import once, spread

#: Vectors the quantisers are fitted on at most; vectors per cell aimed at; coarse centroids at most.
SAMPLE, CELL, CELLS = 16_384, 128, 4_096
#: Sub-vectors of a residual, code words of each, and centroids a vector is filed under at most.
PARTS, WORDS, PROBES = 32, 64, 4
#: Similarity by which a further centroid may be behind the nearest; candidates reranked exactly.
MARGIN, POOL = 0.08, 48
#: Filings of a cell beyond which it is cut again, and that one task searches at most (of a larger cell, about twice as many).
CROWD = 8_192
#: Filings of a finer cell aimed at, and vectors of a cell that its finer centroids are fitted on, for each of them.
FINE, FINE_SAMPLE = 256, 12
#: Cells, or parts of cells, that are broadcast with their sizes; of more, sizes meet by shuffle.
CROWDED = 100_000
#: Keys of surplus copies that may be broadcast; more are left out by a shuffle join.
COPIES = 200_000


def usable(df: DataFrame, key: str, embedding: str, at: str, dim: int) -> DataFrame:
    """Rows (k, h, e): the usable embedding of each key, and a digest of it; the rows are checked once and written."""
    rows = df.filter(F.col(key).isNotNull() & (F.size(embedding) == dim)).select(F.col(key).cast("string").alias("k"), F.col(at).alias("t"), F.col(embedding).cast("array<float>").alias("e"))
    schema = T.StructType([rows.schema["k"], rows.schema["t"], T.StructField("h", T.StringType()), T.StructField("e", T.ArrayType(T.FloatType()))])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = pc.list_flatten(batch.column(2))
            x = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)  # nulls become NaN
            fine = np.flatnonzero(np.isfinite(x).all(axis=1) & (x != 0).any(axis=1))
            own = x[fine] + np.float32(0)  # one zero
            digest = [hashlib.blake2b(v.tobytes(), digest_size=16).hexdigest() for v in own]
            kept = batch.take(pa.array(fine))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(digest, pa.string()), kept.column(2)], names=["k", "t", "h", "e"])

    checked = materialize(spread(rows).mapInArrow(check, schema), "usable")
    best = once(checked, "k", F.struct("t", "e", "h"), "s")
    return best.select("k", F.col("s.h").alias("h"), F.col("s.e").alias("e"))


def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """The vectors of an Arrow column without nulls as rows of unit length."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # before squaring: no overflow, no underflow
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 8, unit: bool = False) -> np.ndarray:
    """Centroids by Lloyd's steps; an empty cluster takes a random vector."""
    centroids = x[rng.choice(len(x), size=k, replace=len(x) < k)].copy()
    for _ in range(steps):
        near = nearest(x, centroids)
        order = np.argsort(near, kind="stable")
        counts = np.bincount(near, minlength=k)
        filled = np.flatnonzero(counts)
        starts = (np.cumsum(counts) - counts)[filled]
        centroids[filled] = np.add.reduceat(x[order], starts, axis=0) / counts[filled][:, None]
        empty = np.flatnonzero(counts == 0)
        centroids[empty] = x[rng.choice(len(x), size=len(empty))]
        if unit:
            centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray, block: int = 4_096) -> np.ndarray:
    bias = 0.5 * (centroids**2).sum(axis=1)
    return np.concatenate([np.argmax(x[i : i + block] @ centroids.T - bias, axis=1) for i in range(0, len(x), block)] or [np.zeros(0, np.int64)])


def within(near: np.ndarray, probes: int, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the at most ``probes`` best of each row that are at most ``margin`` behind the best."""
    k = min(probes, near.shape[1])
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    value = np.take_along_axis(near, best, axis=1)
    row, slot = np.nonzero(value >= value.max(axis=1, keepdims=True) - margin)
    return row, best[row, slot]


class Quantiser:
    """Coarse centroids in two levels, and codebooks of residuals."""

    def __init__(self, sample: np.ndarray, cells: int, parts: int = PARTS, words: int = WORDS, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.centroids = k_means(sample, cells, rng, unit=True) if cells > 1 else np.zeros((1, sample.shape[1]), np.float32)
        self.top = self.members = None
        if cells > 256:  # centroids are found through groups of centroids
            groups = int(np.sqrt(cells))
            self.top = k_means(self.centroids, groups, rng, unit=True)
            self.members = np.argsort(nearest(self.centroids, self.top), kind="stable")
            self.bounds = np.searchsorted(nearest(self.centroids, self.top)[self.members], np.arange(groups + 1))
        dim = sample.shape[1]
        self.cut = np.linspace(0, dim, parts + 1).astype(int)
        residuals = sample - self.centroids[nearest(sample, self.centroids)]
        self.books = [k_means(residuals[:, a:b], min(words, max(1, len(sample))), rng, steps=5) for a, b in zip(self.cut, self.cut[1:])]

    def file(self, x: np.ndarray, probes: int, margin: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of every filing, by similarity to the centroids of the nearest groups."""
        if self.top is None:
            near = x @ self.centroids.T
            columns = np.broadcast_to(np.arange(near.shape[1]), near.shape)
        else:
            look = min(6, len(self.top))
            groups = np.argpartition(-(x @ self.top.T), look - 1, axis=1)[:, :look]
            longest = int(np.diff(self.bounds).max())
            near = np.full((len(x), look * longest), -np.inf, np.float32)
            columns = np.zeros((len(x), look * longest), np.int64)
            for g in range(len(self.top)):
                own = self.members[self.bounds[g] : self.bounds[g + 1]]
                if len(own):
                    row, slot = np.nonzero(groups == g)
                    if len(row):
                        at = slot[:, None] * longest + np.arange(len(own))
                        near[row[:, None], at] = x[row] @ self.centroids[own].T
                        columns[row[:, None], at] = own
        row, best = within(near, probes, margin)
        return row, columns[row, best]

    def codes(self, residuals: np.ndarray) -> np.ndarray:
        return np.stack([nearest(residuals[:, a:b], book) for a, b, book in zip(self.cut, self.cut[1:], self.books)], axis=1).astype(np.uint8)

    def search(self, x: np.ndarray, cell: int, pool: int, k: int, block: int = 256) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For blocks of the cell's vectors: (first row, positions of the k best others, their cosines)."""
        centre = self.centroids[cell]
        codes = self.codes(x - centre)
        exact = x.astype(np.float64)
        exact /= np.linalg.norm(exact, axis=1, keepdims=True)
        n, pool = len(x), min(pool, len(x) - 1)
        k = min(k, pool)
        decoded = np.concatenate([book[codes[:, part]] for part, book in enumerate(self.books)], axis=1)
        left = np.linalg.norm(x - centre - decoded, axis=1)
        for at in range(0, n, block):
            q = x[at : at + block]
            estimate = np.repeat((q @ centre)[:, None], n, axis=1)
            for part, (a, b) in enumerate(zip(self.cut, self.cut[1:])):
                estimate += (q[:, a:b] @ self.books[part].T)[:, codes[:, part]]
            rows = np.arange(len(q))
            estimate[rows, at + rows] = -np.inf
            found = np.argpartition(-estimate, pool - 1, axis=1)[:, :pool] if pool < n - 1 else np.argsort(-estimate, axis=1)[:, :pool]
            cosine = np.einsum("qd,qpd->qp", exact[at : at + block], exact[found])
            order = np.argsort(-cosine, axis=1, kind="stable")[:, :k]
            found, cosine = np.take_along_axis(found, order, axis=1), np.take_along_axis(cosine, order, axis=1)
            # |q.x - estimate| is at most the length of what the codes leave of x, so others below the k-th best are ruled out
            open_ = np.flatnonzero((estimate + left >= cosine[:, -1:] - 1e-5).sum(axis=1) > pool)
            if len(open_) and pool < n - 1:
                every = exact[at + open_] @ exact.T
                every[np.arange(len(open_)), at + open_] = -np.inf
                best = np.argpartition(-every, k - 1, axis=1)[:, :k]
                value = np.take_along_axis(every, best, axis=1)
                order = np.argsort(-value, axis=1, kind="stable")
                found[open_], cosine[open_] = np.take_along_axis(best, order, axis=1), np.take_along_axis(value, order, axis=1)
            yield at, found, cosine


def fit(vectors: DataFrame, n: int, dim: int, sample: int = SAMPLE, cell: int = CELL, cells: int = CELLS) -> Quantiser:
    """Fit on at most about ``sample`` vectors, chosen by key hash and collected to the driver (bounded)."""
    share = min(1.0, sample / max(n, 1))
    chosen = vectors.filter(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int(share * (1 << 30))).select("e").limit(2 * sample)
    x = matrix(chosen.toArrow().column(0).combine_chunks(), dim)
    x = x[np.lexsort(x.T[:4])]  # the same sample in any order gives the same quantiser
    if not len(x):
        x = np.ones((1, dim), np.float32) / np.float32(np.sqrt(dim))
    return Quantiser(x, int(min(cells, max(1, n // cell), max(1, len(x) // 8))))


def _finer(filed: DataFrame, large: DataFrame, dim: int, probes: int, margin: float) -> DataFrame:
    """Filings (cell, sub, h, e) of the crowded cells ``large`` (cell, n) under centroids of their own."""
    crowd = filed.join(F.broadcast(large), "cell")  # at most CELLS rows
    # one centroid for FINE filings, fitted on FINE_SAMPLE vectors for each: a task per cell, of a share of the cell that is bounded by the share
    share = FINE_SAMPLE / FINE
    sample = crowd.filter(F.pmod(F.xxhash64("h", F.lit(2)), F.lit(1 << 30)) < int(share * (1 << 30))).select("cell", "n", "e")

    def centres(table: pa.Table) -> pa.Table:
        x = matrix(table["e"].combine_chunks(), dim)
        k = max(1, min(-(-table["n"][0].as_py() // FINE), len(x)))
        found = k_means(x, k, np.random.default_rng(table["cell"][0].as_py()), unit=True)
        return pa.table({"cell": pa.array([table["cell"][0].as_py()], pa.int32()), "centres": pa.array([found.astype(np.float32).tobytes()], pa.binary())})

    fitted = materialize(sample.groupBy("cell").applyInArrow(centres, "cell int, centres binary"), "centres")
    # a cell is filed in parts, so that no task holds it whole; its centroids go to each part
    parts = F.ceil(F.col("n") / CROWD).cast("int")
    left = crowd.select("cell", F.pmod(F.xxhash64("h", F.lit(3)), parts).cast("int").alias("part"), "h", "e")
    right = fitted.join(F.broadcast(large), "cell").select("cell", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "centres")

    def assign(own: pa.Table, centres_: pa.Table) -> pa.Table:
        if not own.num_rows or not centres_.num_rows:
            return pa.table({"cell": pa.array([], pa.int32()), "sub": pa.array([], pa.int32()), "h": pa.array([], pa.string()), "e": pa.array([], pa.list_(pa.float32()))})
        c = np.frombuffer(centres_["centres"][0].as_py(), dtype=np.float32).reshape(-1, dim)
        row, sub = within(matrix(own["e"].combine_chunks(), dim) @ c.T, probes, margin)
        kept = own.take(pa.array(row))
        return pa.table({"cell": kept["cell"], "sub": pa.array(sub.astype(np.int32)), "h": kept["h"], "e": kept["e"]})

    return left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part")).applyInArrow(assign, "cell int, sub int, h string, e array<float>")


def nearest_neighbours(df: DataFrame, key: str, embedding: str, at: str, dim: int, k: int, probes: int = PROBES, margin: float = MARGIN, pool: int = POOL) -> DataFrame:
    """Rows (key, neighbour, cosine, place): the k most similar others of every key, by exact cosine among those found."""
    spark = df.sparkSession
    vectors = usable(df, key, embedding, at, dim)
    keys = materialize(vectors.select("h", "k"), "keys")
    # classes of exact copies: the k + 1 smallest keys of each, pruned before the shuffle
    first = keys.withColumn("i", F.row_number().over(Window.partitionBy("h").orderBy("k"))).filter(F.col("i") <= k + 1)
    classes = first.groupBy("h").agg(F.array_sort(F.collect_list("k")).alias("keys"))
    least = keys.groupBy("h").agg(F.min("k").alias("least"))
    n, distinct = keys.count(), least.count()
    quantiser = spark.sparkContext.broadcast(fit(vectors, n, dim))  # at most CELLS centroids and the codebooks
    representatives = vectors
    if distinct < n:
        if n - distinct <= COPIES:
            copies = keys.join(least, "h").filter("k <> least").select("k")
            representatives = vectors.join(F.broadcast(copies), "k", "left_anti")
        else:
            representatives = vectors.join(least.select(F.col("least").alias("k")), "k", "left_semi")
    representatives = representatives.select("h", "e")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, cell = quantiser.value.file(matrix(batch.column(1), dim), probes, margin)
                kept = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), kept.column(0), kept.column(1)], names=["cell", "h", "e"])

    def search(table: pa.Table) -> pa.Table:
        cell, names, x = table["cell"][0].as_py(), table["h"].to_numpy(), matrix(table["e"].combine_chunks(), dim)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(x) > 1:
            for begin, found, cosine in quantiser.value.search(x, cell, pool, k):
                out.append((np.repeat(names[begin : begin + len(found)], found.shape[1]), names[found.ravel()], cosine.ravel()))
        a, b, c = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, object) for i in range(3))
        return pa.table({"h": pa.array(a, pa.string()), "o": pa.array(b, pa.string()), "cosine": pa.array(c.astype(np.float64))})

    filed = representatives.mapInArrow(assign, "cell int, h string, e array<float>")
    groups = ["cell"]
    if n > CROWD:
        # cells are counted by filing twice, not by a copy on disk
        large = materialize(filed.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD), "large")
        if not large.isEmpty():
            small = filed.join(F.broadcast(large), "cell", "left_anti").select("cell", F.lit(-1).alias("sub"), "h", "e")
            filed = materialize(small.unionByName(_finer(filed, large, dim, probes, margin)), "filed")
            sizes = filed.groupBy("cell", "sub").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD)
            crowded = materialize(sizes.select("cell", "sub", F.ceil(F.col("n") / CROWD).cast("int").alias("parts")), "crowded")
            # what is crowded still is cut into parts, and each two of them are a task
            mine_ = F.pmod(F.xxhash64("h", F.lit(1)), F.col("parts")).cast("int")
            two = F.transform(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != mine_), lambda x: F.concat_ws("-", F.least(x, mine_), F.greatest(x, mine_)))
            filed = filed.join(F.broadcast(crowded) if crowded.count() <= CROWDED else crowded, ["cell", "sub"], "left")
            filed = filed.select("cell", "sub", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(""))).otherwise(two)).alias("two"), "h", "e")
            groups = ["cell", "sub", "two"]
    # a pair found in several cells may differ in its last digit
    pairs = filed.groupBy(*groups).applyInArrow(search, "h string, o string, cosine double").groupBy("h", "o").agg(F.max("cosine").alias("cosine"))
    best = pairs.withColumn("i", F.row_number().over(Window.partitionBy("h").orderBy(F.desc("cosine"), "o"))).filter(F.col("i") <= k)
    named = best.join(classes.select(F.col("h").alias("o"), "keys"), "o").select("h", F.struct("cosine", "keys").alias("s"))
    others = named.groupBy("h").agg(F.collect_list("s").alias("others"))  # at most k entries
    lists = classes.join(others, "h", "left")
    spread = F.flatten(F.transform("others", lambda s: F.transform(s["keys"], lambda x: F.struct((-s["cosine"]).alias("down"), x.alias("o")))))
    own = F.transform("keys", lambda x: F.struct(F.lit(-1.0).alias("down"), x.alias("o")))
    lists = lists.select("h", F.slice(F.array_sort(F.concat(own, F.coalesce(spread, F.expr("array()")))), 1, 2 * k + 2).alias("list"))
    members = spread_join(lists, keys, "h", "k")  # a class of very many copies is split
    mine = F.slice(F.filter("list", lambda s: s["o"] != F.col("k")), 1, k)
    rows = members.select("k", F.posexplode(mine).alias("place", "s"))
    return rows.select(F.col("k").alias(key), F.col("s.o").alias("neighbour"), (-F.col("s.down")).alias("cosine"), (F.col("place") + 1).alias("place"))


def similar_pairs(neighbours: DataFrame, key: str, least: float) -> DataFrame:
    """Rows (a, b), the smaller key first: pairs of which one is among the best of the other, at least so similar."""
    close = neighbours.filter(F.col("cosine") >= least)
    return close.select(F.least(key, "neighbour").alias("a"), F.greatest(key, "neighbour").alias("b")).distinct()
