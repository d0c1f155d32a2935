"""The nearest neighbour of every vector among all others: all pairs, in tiles, without an approximation.

Vectors that are equal are looked for once. A block of them at a time goes to every task, which meets its part of this block
and of the blocks after it; a tile's products serve the rows of both its sides. They are made in single precision, with a
bound on their error, and cosines that may be the largest are made anew in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import stored

#: Bytes of the vectors that go to every task at a time, rows on a side of a tile, and pairs whose cosines are made anew at once.
HELD_BYTES, TILE, AGAIN = 64 << 20, 512, 4096


class Best:
    """Of so many rows the nearest other one so far: cosine to nine decimals, key and row; ties by key, then row."""

    def __init__(self, n: int) -> None:
        self.score, self.key, self.row = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)

    def take(self, i: np.ndarray, score: np.ndarray, key: np.ndarray, row: np.ndarray) -> None:
        order = np.lexsort((row, key, -score, i))
        order = order[np.diff(i[order], prepend=-1) > 0]
        i, score, key, row = i[order], score[order], key[order], row[order]
        tied = (score == self.score[i]) & ((key < self.key[i]) | ((key == self.key[i]) & (row < self.row[i])))
        new = (score > self.score[i]) | tied
        self.score[i[new]], self.key[i[new]], self.row[i[new]] = score[new], key[new], row[new]

    def table(self, rows: np.ndarray) -> pa.RecordBatch:
        some = self.score > -np.inf
        return pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (rows, self.score, self.key, self.row)], ["row", "score", "key", "at"])


class Side:
    """Rows with their keys and vectors, also at unit length in single precision."""

    def __init__(self, rows: np.ndarray, keys: np.ndarray, vectors: np.ndarray) -> None:
        self.rows, self.keys, self.vectors, self.best = rows, keys, vectors, Best(len(rows))
        self.length = np.maximum(np.sqrt(np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64)), 1e-300)
        self.unit = np.empty(vectors.shape, np.float32)
        for k in range(0, len(rows), TILE):
            self.unit[k : k + TILE] = vectors[k : k + TILE] / self.length[k : k + TILE, None]


def met(a: Side, b: Side, one_side: bool) -> None:
    """Each row's best among those of the other side; one_side: b's rows are among a's, and only a's are looked at."""
    slack = 2 * (a.vectors.shape[1] + 16) * 2.0**-24 + 1e-9  # twice what a product may be off, and half a counted decimal
    for i in range(0, len(a.rows), TILE):
        for j in range(0, len(b.rows), TILE):
            products = a.unit[i : i + TILE] @ b.unit[j : j + TILE].T
            if one_side:
                _, own, same = np.intersect1d(a.rows[i : i + TILE], b.rows[j : j + TILE], True, return_indices=True)
                products[own, same] = -np.inf
            _kept(a, i, b, j, products, slack)
            if not one_side:
                _kept(b, j, a, i, products.T, slack)


def _kept(a: Side, i: int, b: Side, j: int, products: np.ndarray, slack: float) -> None:
    """What may be the best of a's rows from i on, among b's from j on, counted exactly."""
    most = products.max(axis=1)
    least = np.maximum(most, a.best.score[i : i + len(most)]) - slack
    some = np.flatnonzero((most >= least) & (most > -np.inf))
    left, right = np.nonzero(products[some] >= least[some, None].astype(np.float32) - np.float32(1e-7))
    left, right = some[left] + i, right + j
    for k in range(0, len(left), AGAIN):
        x, y = left[k : k + AGAIN], right[k : k + AGAIN]
        own = a.rows[x] != b.rows[y]
        x, y = x[own], y[own]
        exact = np.einsum("ij,ij->i", a.vectors[x] / a.length[x, None], b.vectors[y] / b.length[y, None])
        a.best.take(x, np.round(exact, 9), b.keys[y], b.rows[y])


def nearest_others(vectors: DataFrame) -> DataFrame:
    """row, at and score: of each row (row, key, embedding; rows are distinct, and known by their number alone) the row nearest by cosine, and that cosine to nine decimals; ties by key. vectors: a table that is kept."""
    marks = stored(_marked(vectors))
    copies = np.sort(np.asarray(marks.where("row <> first").select("row").toArrow()["row"]))  # a number for each copy
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    wide = 8 if "double" in vectors.schema["embedding"].dataType.simpleString() else 4
    blocks = max(1, -(-size["n"] * (size["dim"] or 0) * wide // HELD_BYTES))
    dealt = vectors.select("row", "key", F.col("embedding").alias("v"), F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"))
    found = None
    for k in range(blocks if size["n"] else 0):
        one = _round(dealt, k, copies)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "row bigint, at bigint, score double")
    best = found.groupBy(F.col("row").alias("first")).agg(F.max(F.struct("score", (-F.col("key")).alias("key"), (-F.col("at")).alias("at"))).alias("other"))
    # A copy's own group has its nearest, unless another vector comes as near and has a lesser key.
    all_ = marks.join(best, "first", "left")
    copy = F.when(F.col("second").isNotNull(), F.struct("own", F.when(F.col("row") == F.col("first"), -F.col("second_key")).otherwise(-F.col("first_key")).alias("key"), F.when(F.col("row") == F.col("first"), -F.col("second")).otherwise(-F.col("first")).alias("at")))
    other = F.struct(F.col("other.score").alias("own"), F.col("other.key").alias("key"), F.col("other.at").alias("at"))
    nearer = F.greatest(copy, F.when(F.col("other").isNotNull(), other))
    return all_.select("row", nearer.alias("x")).where("x IS NOT NULL").select("row", (-F.col("x.at")).alias("at"), F.col("x.own").alias("score"))


def _marked(vectors: DataFrame) -> DataFrame:
    """row, the cosine of its vector with itself, and of all rows with this vector the first two by key: first, first_key, second, second_key. Vectors are told apart by 128 bits of hashes."""
    by = ["h", "g"]
    hashed = vectors.select("row", "key", F.xxhash64("embedding").alias("h"), F.xxhash64(F.lit(1), "embedding").alias("g"), F.exists("embedding", lambda x: x != 0).cast("double").alias("own"))
    heads = hashed.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("key", "row"))).where("n <= 2")
    nth = lambda n, c: F.max(F.when(F.col("n") == n, F.col(c)))
    pairs = heads.groupBy(*by).agg(nth(1, "row").alias("first"), nth(1, "key").alias("first_key"), nth(2, "row").alias("second"), nth(2, "key").alias("second_key"))
    return hashed.join(pairs, by).drop(*by, "key")


def _round(dealt: DataFrame, k: int, copies: np.ndarray) -> DataFrame:
    """row, score, key and at: the best of each part for the rows of block k among all from it on, and for these among block k."""
    context = dealt.sparkSession.sparkContext

    def side(t: pa.Table | pa.RecordBatch, left_out: np.ndarray) -> Side:
        rows = np.asarray(t["row"])
        at = np.searchsorted(left_out, rows)
        kept = np.flatnonzero(left_out[np.minimum(at, len(left_out) - 1)] != rows) if len(left_out) else np.arange(len(rows))
        v = t["v"].combine_chunks() if isinstance(t, pa.Table) else t["v"]
        return Side(rows[kept], np.asarray(t["key"])[kept], np.asarray(v.flatten()).reshape(len(rows), -1 if len(rows) else 0)[kept])

    block = side(dealt.where(F.col("block") == k).select("row", "key", "v").toArrow(), copies)  # HELD_BYTES at most
    held = context.broadcast((block.rows, block.keys, block.vectors, copies))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *of_block, left_out = held.value
        a = Side(*of_block)
        for batch in batches:
            if batch.num_rows and len(a.rows):
                for own in (True, False):
                    part = batch.filter(pa.array(np.asarray(batch["block"]) == k) if own else pa.array(np.asarray(batch["block"]) != k))
                    if part.num_rows:
                        met(a, b := side(part, left_out), own)
                        yield b.best.table(b.rows)
        yield a.best.table(a.rows)

    out = stored(dealt.where(F.col("block") >= k).mapInArrow(scan, "row bigint, score double, key bigint, at bigint"))
    held.destroy()
    return out
