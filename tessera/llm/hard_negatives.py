"""Hard negatives by a secondary sort: rows of other labels whose scores lie just below those of an anchor's positives.

Anchors and rows are dealt into blocks; a cell is one block of each, and every pair of an anchor and a row is scored in just
one cell. A pair is packed into a key of bytes, (anchor, descending score, positives first, id), and the keys are
repartitioned by anchor and sorted within partitions. An iterator then reads an anchor's keys in order: a positive opens a
window that reaches from its score down to a share of it, a negative is given out for every window that is open and not yet
full. Nothing of an anchor is held but its open windows.

Cells send no more than can come out: of positives the first few of each anchor; of negatives, once an anchor's positives
are known from a first pass of the same kind, the first few of each of its windows. What is first among all rows is first in
its cell, so nothing is lost, and an anchor's keys grow with the number of blocks and not of rows.

Defined cases: rows with a null id, a null label, a null vector, or a null or non-finite component take no part; of rows that
share an id the one with the least label, then the least vector, stands for all; vectors of unequal lengths are filled up
with zeros; components saturate at 2^22 (|x| of 16,384), so that scores are exact in vectors of up to 2,048 components;
equal scores go by id; an anchor without positives gives no rows, nor does a positive with a score below zero, whose window
is empty; an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import stored

#: Rows and anchors of a block; anchors scored at a time; keys of a sorted partition.
BLOCK, SLICE, KEYS = 8192, 128, 1 << 20
SCALE, SATURATED = 256, 1 << 22
_SIGN, _ALL = 1 << 63, (1 << 64) - 1
_KEY = struct.Struct(">QQBQ")


def usable(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: F.Column | None = None) -> DataFrame:
    """vec_id, label and integer components of the rows that take part, one for each id."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(embedding, lambda x: F.greatest(F.least(F.floor(x.cast("double") * SCALE), F.lit(SATURATED)), F.lit(-SATURATED)).cast("int"))
    rows = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), (F.col("label") if label is None else label).cast("bigint").alias("label"), F.when(F.coalesce(finite, F.lit(False)), whole).alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull())
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("x")).select("vec_id", "x.label", "x.vector")


def pack(anchor: np.ndarray, score: np.ndarray, kind: int, other: np.ndarray) -> list[bytes]:
    """Keys whose order as bytes is anchor, descending score, kind, id."""
    key = np.zeros(len(anchor), dtype=[("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("other", ">u8")])
    sign = np.uint64(_SIGN)
    key["anchor"], key["score"], key["kind"], key["other"] = anchor.astype(np.int64).view(np.uint64) ^ sign, ~(score.astype(np.int64).view(np.uint64) ^ sign), kind, other.astype(np.int64).view(np.uint64) ^ sign
    data, width = key.tobytes(), key.itemsize
    return [data[k : k + width] for k in range(0, len(data), width)]


def unpack(key: bytes) -> tuple[int, int, int, int]:
    """anchor, score, kind, id."""
    anchor, score, kind, other = _KEY.unpack(key)
    return anchor - _SIGN, (score ^ _ALL) - _SIGN, kind, other - _SIGN


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for row, values in zip(out, column.to_pylist(), strict=True):
        row[: len(values)] = values
    return out


def _first(scores: np.ndarray, mask: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first few marked columns of each row, by score, then by column."""
    scores = np.where(mask, scores, -np.inf)
    if scores.shape[1] > most:
        mask = mask & (scores >= np.partition(scores, -most, axis=1)[:, -most, None])
    row, column = np.nonzero(mask)
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    return row[nth < most], column[nth < most]


def _cell(rows: pa.Table, anchors: pa.Table, keys: Callable) -> Iterator[list[bytes]]:
    """Score the cell's pairs, a slice of anchors at a time; columns stand in order of ids."""
    rows = rows.sort_by("vec_id")
    width = max((len(v) for t in (rows, anchors) for v in t["vector"].to_pylist()), default=0)
    right, ids, labels = _matrix(rows["vector"], width), rows["vec_id"].to_numpy(), rows["label"].to_numpy()
    for at in range(0, anchors.num_rows, SLICE):
        part = anchors.slice(at, SLICE)
        left = _matrix(part["vector"], width)
        # Doubles are exact as long as scores, times a hundred, stay below 2^53.
        exact = 100.0 * width * np.abs(left).max(initial=0) * np.abs(right).max(initial=0) < 2.0**53
        scores = left @ right.T if exact else (left.astype(np.int64) @ right.astype(np.int64).T)
        yield keys(part, scores, part["label"].to_numpy()[:, None] == labels, ids)


def _scored(rows: DataFrame, anchors: DataFrame, size: tuple[int, int], keys: Callable) -> DataFrame:
    """Keys from every cell. size: the numbers of blocks of rows and of anchors."""
    slab, block = F.pmod(F.xxhash64("vec_id"), F.lit(size[0])), F.pmod(F.xxhash64("vec_id"), F.lit(size[1]))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    left = rows.select("*", slab.alias("slab"), every(size[1]).alias("block"))
    right = anchors.select("*", block.alias("block"), every(size[0]).alias("slab"))

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        return pa.table({"key": pa.array([k for part in _cell(x, y, keys) for k in part], pa.binary())})

    return left.groupBy("slab", "block").cogroup(right.groupBy("slab", "block")).applyInArrow(run, "key binary")


def positive_keys(most: int) -> Callable:
    def keys(anchors: pa.Table, scores: np.ndarray, same: np.ndarray, ids: np.ndarray) -> list[bytes]:
        own = anchors["vec_id"].to_numpy()
        row, column = _first(scores, same & (own[:, None] != ids), most)
        return pack(own[row], scores[row, column], 0, ids[column])

    return keys


def negative_keys(most: int, least_percent: int) -> Callable:
    def keys(anchors: pa.Table, scores: np.ndarray, same: np.ndarray, ids: np.ndarray) -> list[bytes]:
        own, lists = anchors["vec_id"].to_numpy(), anchors["positives"].to_pylist()
        found = np.zeros(scores.shape, bool)
        for k in range(max(map(len, lists), default=0)):
            # A window that isn't there holds nothing.
            top, there = np.asarray([x[k] if len(x) > k else 0 for x in lists])[:, None], np.asarray([len(x) > k for x in lists])[:, None]
            found[_first(scores, there & ~same & (100 * scores <= 100 * top) & (100 * scores >= least_percent * top), most)] = True
        row, column = np.nonzero(found)
        return pack(own[row], scores[row, column], 1, ids[column])

    return keys


def sorted_keys(keys: DataFrame, partitions: int) -> RDD:
    """The keys of an anchor in one partition, each partition in order."""
    pairs = keys.rdd.map(lambda r: (bytes(r[0]), None))
    return pairs.repartitionAndSortWithinPartitions(partitions, lambda key: zlib.crc32(key[:8])).keys()


def first_of_anchor(most: int) -> Callable:
    """An anchor's first keys."""
    return lambda keys: (unpack(k) for _, of in groupby(keys, lambda k: k[:8]) for k in islice(of, most))


def open_windows(most: int, least_percent: int) -> Callable:
    """Read sorted keys: positives open windows, negatives go to those that are open."""

    def run(keys: Iterable[bytes]) -> Iterator[tuple[int, int, int, int, int, int]]:
        now, windows = None, []
        for key in keys:
            anchor, score, kind, other = unpack(key)
            if anchor != now:
                now, windows = anchor, []
            if not kind:
                windows.append([other, score, 0])
                continue
            windows = [w for w in windows if w[2] < most and least_percent * w[1] <= 100 * score]
            for w in windows:
                w[2] += 1
                yield anchor, w[0], w[2], other, w[1], score

    return run


def hard_negatives(rows: DataFrame, is_anchor: F.Column, positives: int = 5, negatives: int = 5, least_percent: int = 80) -> DataFrame:
    """For every anchor among usable() rows and each of its first positives, the first rows of other labels that score from least_percent of the positive's score up to it."""
    spark = rows.sparkSession
    rows = stored(rows, "vectors")
    n, n_anchors = rows.select(F.count("*"), F.count(F.when(is_anchor, 1))).first()
    size = (max(1, -(-n // BLOCK)), max(1, -(-n_anchors // BLOCK)))
    least = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    partitions = lambda each: max(least, n_anchors * size[0] * each // KEYS)
    anchors = stored(rows.where(is_anchor), "anchors")
    first = sorted_keys(_scored(rows, anchors, size, positive_keys(positives)), partitions(positives)).mapPartitions(first_of_anchor(positives))
    found = stored(spark.createDataFrame(first, "anchor bigint, score bigint, kind int, other bigint"), "positives")
    known = found.groupBy("anchor").agg(F.collect_list("score").alias("positives")).withColumnRenamed("anchor", "vec_id")
    below = _scored(rows, stored(anchors.join(known, "vec_id"), "anchors"), size, negative_keys(negatives, least_percent))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(pack(b["anchor"].to_numpy(), b["score"].to_numpy(), 0, b["other"].to_numpy()), pa.binary())], names=["key"])

    keys = below.union(found.mapInArrow(packed, "key binary"))
    out = sorted_keys(keys, partitions(positives * (1 + negatives))).mapPartitions(open_windows(negatives, least_percent))
    return spark.createDataFrame(out, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")


def op11_sorted_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh has the next label first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label=label)
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)
