"""Items that appear together: a blocked Gram matrix.

With X the binary matrix of records by items, the number of records two items share is an entry
of transpose(X) X, and the sum over blocks of records of transpose(Xr) Xr. A block of records is
a piece of a task's Arrow batch; within it items get local numbers, rows of equal size are
multiplied as one sparse block, and equal entries are added before anything is shuffled. A record
with more than ``WIDE`` items is cut into item blocks, and each pair of item blocks is a product
of its own, so no record is held whole by a task. Nothing is capped or sampled.

Where only given ties count (``tie_gram``), a record whose ties join all its items is multiplied
whole, as a basket. Of any other record each item is multiplied with the items tied to it only: its
row of the product, masked by the ties.

Counts are normalised by what the marginals lead one to expect: lift = n_ab * M / (n_a * n_b).
Pairs have the smaller key first (by code point). Repeated rows count once, rows with a null
record or item not at all, an item is never paired with itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelattice.session import materialize

#: Items (or ties) of a record up to which it is gathered whole, and items in a block of a wider one.
WIDE = 512
#: Entries of products that are made at once, and wide records that are broadcast at most.
ENTRIES, WIDE_RECORDS = 2_000_000, 200_000
#: What a row of the product is: all pairs within left, left times right, or the ties left[i] - right[i] of a record.
WITHIN, TIMES, TIES = 0, 1, 2

PAIRS = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("n_ab", T.LongType())])


def _rows_of(code: np.ndarray, starts: np.ndarray, sizes: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of their codes) of the wanted rows, for each size."""
    for size in np.unique(sizes[wanted]):
        rows = wanted[sizes[wanted] == size]
        yield rows, code[starts[rows][:, None] + np.arange(size)]


def _products(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, shape: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the non-zero entries, one pair of arrays for all rows of the same shape and size."""
    at_left, at_right = np.cumsum(n_left) - n_left, np.cumsum(n_right) - n_right
    whole = np.flatnonzero((shape == WITHIN) & (n_left > 1))
    tied = np.flatnonzero((shape == TIES) & (n_left > 0))
    if len(tied):
        # items of each record; if its ties are all their pairs, the record is a basket
        row = np.repeat(np.arange(len(shape)), n_left * (shape == TIES))
        x, y = left[np.repeat(shape == TIES, n_left)], right[np.repeat(shape == TIES, n_right)]
        base = int(max(left.max(initial=0), right.max(initial=0))) + 1
        items = np.unique(np.concatenate([row * base + x, row * base + y]))
        n_items = np.bincount(items // base, minlength=len(shape))
        complete = (n_left == n_items * (n_items - 1) // 2) & (shape == TIES)
        begin = np.cumsum(n_items) - n_items
        for rows, matrix in _rows_of(items % base, begin, n_items, np.flatnonzero(complete)):
            i, j = np.triu_indices(matrix.shape[1], 1)
            yield matrix[:, i].ravel(), matrix[:, j].ravel()
        masked = ~complete[row]
        if masked.any():
            yield x[masked], y[masked]
    for rows, matrix in _rows_of(left, at_left, n_left, whole):
        i, j = np.triu_indices(matrix.shape[1], 1)
        yield matrix[:, i].ravel(), matrix[:, j].ravel()
    times = np.flatnonzero((shape == TIMES) & (n_left > 0) & (n_right > 0))
    for rows, x in _rows_of(left, at_left, n_left, times):
        for tall in np.unique(n_right[rows]):
            same = n_right[rows] == tall
            y = right[at_right[rows[same]][:, None] + np.arange(tall)]
            yield np.repeat(x[same], tall, axis=1).ravel(), np.tile(y, (1, x.shape[1])).ravel()


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial Gram matrices of rows (left, right, shape)."""
    for batch in batches:
        sizes = [pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:2]]
        shape = batch.column(2).to_numpy(zero_copy_only=False)
        cells = np.cumsum(np.where(shape == TIES, sizes[0], np.where(shape == WITHIN, sizes[0] ** 2, sizes[0] * sizes[1])))
        at = 0
        while at < batch.num_rows:
            done = cells[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(cells, done + ENTRIES, side="right")))  # a piece whose product stays small
            piece = slice(at, end)
            flat = [pc.list_flatten(batch.column(i).slice(at, end - at)) for i in (0, 1)]
            coded = pa.concat_arrays([f.cast(pa.string()) for f in flat]).dictionary_encode()
            names = np.array(coded.dictionary.to_pylist(), dtype=object)
            order = np.argsort(names, kind="stable") if len(names) else np.zeros(0, np.int64)
            rank = np.empty(len(names), dtype=np.int64)
            rank[order] = np.arange(len(names))
            code = rank[coded.indices.to_numpy(zero_copy_only=False)] if len(names) else np.zeros(0, np.int64)
            left, right = code[: len(flat[0])], code[len(flat[0]) :]
            found = [np.minimum(a, b) * len(names) + np.maximum(a, b) for a, b in _products(left, right, sizes[0][piece], sizes[1][piece], shape[piece])]
            at = end
            if found:
                pair, count = np.unique(np.concatenate(found), return_counts=True)
                in_order = coded.dictionary.take(pa.array(order))
                yield pa.RecordBatch.from_arrays([in_order.take(pa.array(pair // len(names))), in_order.take(pa.array(pair % len(names))), pa.array(count.astype(np.int64))], names=PAIRS.fieldNames())


def _wide(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(rows of narrow records, rows of wide ones with their number ``n``, the wide records or null if there are none)."""
    wide = materialize(rows.groupBy("r").agg(F.count("*").alias("n")).filter(F.col("n") > WIDE), "wide")
    count = wide.count()
    if not count:
        return rows, rows.limit(0).withColumn("n", F.lit(0).cast("bigint")), None
    few = F.broadcast(wide) if count <= WIDE_RECORDS else wide
    return rows.join(few.select("r"), "r", "left_anti"), rows.join(few, "r"), wide


_NONE = "cast(array() as array<string>)"


def gram_matrix(baskets: DataFrame, record: str, item: str) -> DataFrame:
    """Rows (a, b, n_ab): how many records hold both items, for all pairs that occur together."""
    cells = baskets.select(F.col(record).alias("r"), F.col(item).cast("string").alias("i")).filter("r is not null and i is not null")
    narrow, wide, some = _wide(cells)
    rows = narrow.groupBy("r").agg(F.collect_set("i").alias("left")).select("left", F.expr(_NONE).alias("right"), F.lit(WITHIN).alias("shape"))
    if some is not None:
        blocks = F.ceil(F.col("n") / WIDE).cast("int")
        split = wide.distinct().withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("i"), F.col("blocks")).cast("int"))
        ends = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        pairs = ends.select("r", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "i")
        grouped = pairs.groupBy("r", "p", "q").agg(
            F.collect_list(F.when(F.col("block") == F.col("p"), F.col("i"))).alias("left"), F.collect_list(F.when(F.col("block") != F.col("p"), F.col("i"))).alias("right")
        )
        rows = rows.unionByName(grouped.select("left", "right", F.when(F.col("p") == F.col("q"), WITHIN).otherwise(TIMES).alias("shape")))
    return rows.mapInArrow(_gram, PAIRS).groupBy("a", "b").agg(F.sum("n_ab").alias("n_ab"))


def tie_gram(ties: DataFrame, record: str, a: str, b: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same for records whose ties are given: a pair counts in a record only if a row ties it there.

    Marginals count distinct (record, item) of ties, the total distinct records. Returns (pairs, marginals, total).
    """
    rows = ties.select(F.col(record).alias("r"), F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y"))
    rows = rows.filter("r is not null and x <> y").select("r", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    narrow, wide, some = _wide(rows)
    # one shuffle: repeated ties go as a record is gathered
    gathered = narrow.groupBy("r").agg(F.collect_set(F.struct("x", "y")).alias("t")).select(F.col("t.x").alias("left"), F.col("t.y").alias("right"), F.lit(TIES).alias("shape"))
    records = materialize(gathered, "records")
    items = records.select(F.explode(F.array_union("left", "right")).alias("i"))
    total = records.agg(F.count("*").alias("m"))
    products = records
    if some is not None:
        own = materialize(wide.distinct(), "ties")
        blocks = F.pmod(F.xxhash64("y"), F.ceil(F.col("n") / WIDE))
        stars = own.groupBy("r", "x", blocks.alias("block")).agg(F.collect_list("y").alias("right"))
        products = records.unionByName(stars.select(F.array("x").alias("left"), "right", F.lit(TIMES).alias("shape")))
        items = items.unionByName(own.select("r", F.explode(F.array("x", "y")).alias("i")).distinct().select("i"))
        total = total.unionByName(some.agg(F.count("*").alias("m"))).agg(F.sum("m").alias("m"))
    pairs = products.mapInArrow(_gram, PAIRS).groupBy("a", "b").agg(F.sum("n_ab").alias("n_ab"))
    return pairs, items.groupBy("i").agg(F.count("*").alias("n_i")), total


def with_lift(pairs: DataFrame, marginals: DataFrame, total: DataFrame) -> DataFrame:
    """Rows (a, b, n_ab, n_a, n_b, m, lift). ``total`` has one row."""
    side = lambda i, n: marginals.select(F.col("i").alias(i), F.col("n_i").alias(n))
    out = pairs.join(side("a", "n_a"), "a").join(side("b", "n_b"), "b").crossJoin(F.broadcast(total))
    return out.withColumn("lift", F.col("n_ab") * F.col("m") / F.col("n_a") / F.col("n_b"))
