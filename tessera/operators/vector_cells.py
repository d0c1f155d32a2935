"""A kept collection of vectors in cells, of which a search reads those nearest to each query.

Cells are the means of a bounded sample. Every vector lies in the cell of its nearest mean, and the collection is written in
order of cells. A query asks its nearest cells; a cell's rows are dealt into parts of bounded size, so that a large cell is
read by many tasks. Asking all cells gives exactly what a search over all rows gives. How many cells a search asks is
measured when the collection is written: as many as hold the wanted share of the true neighbours of a few sampled rows.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import constants as c
from tessera.operators.retrieval import best_of, nearest, ranked
from tessera.sources.tables import valid_vectors

METRICS = ("cosine", "dot", "euclid")
#: Rows that cells are learned from, most cells, rounds of learning, rows of a part.
SAMPLE, MOST_CELLS, ROUNDS, PART = 20_000, 4_096, 8, 20_000
#: Rows whose true neighbours tell how many cells to ask, and the share of these to be found.
TRIED, WANTED = 300, 0.97


def _rows(column: pa.Array | pa.ChunkedArray, metric: str) -> np.ndarray:
    """Vectors as a matrix, at unit length for cosine; a zero vector stays."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.asarray(flat.flatten(), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    if metric == "cosine" and out.size:
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        out = out / np.where(norm == 0, 1, norm)
    return out


def closeness(left: np.ndarray, right: np.ndarray, metric: str) -> np.ndarray:
    """The greater, the nearer: products, or distances with their sign turned."""
    products = left @ right.T
    if metric != "euclid":
        return products
    return -np.sqrt(np.maximum(0.0, (left**2).sum(1)[:, None] + (right**2).sum(1)[None, :] - 2 * products))


def learned_cells(vectors: DataFrame, cells: int, metric: str, key: str, vector: str, sample: int = SAMPLE, seed: int = 0) -> np.ndarray:
    """Means of a sample of at most so many rows (those with the least hashes), by rounds of assignment and averaging; an empty cell takes the row farthest from its mean."""
    rows = vectors.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(sample).select(vector).toArrow()  # bounded by sample
    x = _rows(rows[vector], metric)
    draw = np.random.default_rng(seed)
    means = x[np.sort(draw.choice(len(x), min(cells, len(x)), replace=False))]
    for _ in range(ROUNDS):
        near = closeness(x, means, "dot" if metric == "cosine" else "euclid")
        of, n = near.argmax(1), len(means)
        sums, counts = np.zeros_like(means), np.bincount(of, minlength=n)
        np.add.at(sums, of, x)
        empty = np.flatnonzero(counts == 0)
        means = sums / np.maximum(counts, 1)[:, None]
        means[empty] = x[np.argsort(near.max(1), kind="stable")[: len(empty)]]
        if metric == "cosine":
            norm = np.linalg.norm(means, axis=1, keepdims=True)
            means = means / np.where(norm == 0, 1, norm)
    return means


def _assigned(vectors: DataFrame, key: str, vector: str, means: np.ndarray, metric: str, probes: int = 1) -> DataFrame:
    """key, vector and cell: each row with its nearest cells. The means, at most MOST_CELLS of them, go to every task."""
    held = vectors.sparkSession.sparkContext.broadcast(means)
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                near = closeness(_rows(b.column(1), metric), held.value, "dot" if metric == "cosine" else "euclid")
                best = np.argsort(-near, axis=1, kind="stable")[:, :probes]
                of = pa.array(np.repeat(np.arange(b.num_rows), best.shape[1]))
                yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of).cast(pa.list_(pa.float32())), pa.array(best.ravel().astype(np.int32))], names=[key, vector, "cell"])

    return vectors.select(key, F.col(vector).cast("array<float>").alias(vector)).mapInArrow(run, f"{key} {kind}, {vector} array<float>, cell int")


def _probes(good: DataFrame, placed: DataFrame, means: np.ndarray, metric: str, key: str, vector: str, wanted: float, k: int = c.TOP_K, seed: int = 1) -> int:
    """Cells to ask so that the wanted share of the k true neighbours of TRIED rows is found: their neighbours are searched for among all rows, and it counts how near the cell of each is to the row."""
    tried = good.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(TRIED)
    rows = tried.select(key, vector).toArrow()  # bounded by TRIED
    spark = good.sparkSession
    again = spark.createDataFrame(rows, f"{key} bigint, {vector} array<float>")
    truth = nearest(again, good, k, key, vector) if metric == "cosine" else _scan(again, good, k, key, vector, metric)
    found = truth.select("query_id", key).join(placed.select(key, "cell"), key).select("query_id", "cell").toArrow()  # TRIED * k rows
    if not found.num_rows:
        return len(means)
    near = closeness(_rows(rows[vector], metric), means, "dot" if metric == "cosine" else "euclid")
    order = np.argsort(np.argsort(-near, axis=1, kind="stable"), axis=1, kind="stable")
    at = {q: n for n, q in enumerate(rows[key].to_pylist())}
    needed = np.sort([order[at[q], cell] + 1 for q, cell in zip(found["query_id"].to_pylist(), found["cell"].to_pylist(), strict=True)])
    return int(needed[min(len(needed) - 1, int(np.ceil(wanted * len(needed))) - 1)])


def _scan(queries: DataFrame, corpus: DataFrame, k: int, key: str, vector: str, metric: str) -> DataFrame:
    """The k nearest rows of few queries by any metric, by a scan of all rows; a row does not find itself."""
    rows = queries.select(key, vector).toArrow()
    held = corpus.sparkSession.sparkContext.broadcast((np.asarray(rows[key]), _rows(rows[vector], metric)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, left = held.value
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                ids = np.asarray(b.column(0))
                scores = np.round(closeness(left, _rows(b.column(1), metric), metric), 9)
                scores[who[:, None] == ids[None, :]] = -np.inf
                top, found = best_of(scores, ids, k)
                row, place = np.nonzero(top > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(who[row]), pa.array(found[row, place]), pa.array(top[row, place])], names=["query_id", key, "score"])

    return ranked(corpus.select(F.col(key).cast("bigint").alias(key), vector).mapInArrow(run, f"query_id bigint, {key} bigint, score double"), "query_id", key, k=k)


def create(vectors: DataFrame, path: str, metric: str = "cosine", cells: int | None = None, key: str = "vec_id", vector: str = "embedding", wanted: float = WANTED) -> None:
    """Write a collection anew: its vectors, its cells, as many as the root of its rows by default, and how many of them a search asks to find the wanted share of neighbours. Vectors that are null, of another length than the first's or not finite are left out."""
    if metric not in METRICS:
        raise ValueError(f"no metric {metric}: {METRICS}")
    first = vectors.where(F.size(vector) > 0).select(F.size(vector)).first()
    dim = first[0] if first else 0
    good = valid_vectors(vectors, vector, dim) if dim else vectors.limit(0)
    n = good.count()
    spark = vectors.sparkSession
    means = learned_cells(good, max(1, min(MOST_CELLS, cells or round(n**0.5))), metric, key, vector) if n else np.zeros((0, 0))
    placed = _assigned(good, key, vector, means, metric) if n else good.select(key, F.col(vector).cast("array<float>").alias(vector), F.lit(0).alias("cell"))
    placed.repartitionByRange("cell", key).sortWithinPartitions("cell", key).write.mode("overwrite").parquet(f"{path}/vectors")
    probes = _probes(good, spark.read.parquet(f"{path}/vectors"), means, metric, key, vector, wanted) if n else 0
    same = lambda value, kind: pa.array([value] * len(means), kind)
    table = pa.table({"cell": pa.array(np.arange(len(means), dtype=np.int32)), "mean": pa.array(list(map(list, means)), pa.list_(pa.float64())), "metric": same(metric, pa.string()), "dim": same(dim, pa.int32()), "probes": same(probes, pa.int32())})
    spark.createDataFrame(table, "cell int, mean array<double>, metric string, dim int, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


def _cells(spark: SparkSession, path: str) -> tuple[np.ndarray, str, int, int]:
    """Means, metric, dimension and the number of cells to ask."""
    rows = spark.read.parquet(f"{path}/cells").orderBy("cell").toArrow()  # at most MOST_CELLS
    return (np.asarray(rows["mean"].to_pylist(), np.float64), *(rows[c][0].as_py() for c in ("metric", "dim", "probes"))) if rows.num_rows else (np.zeros((0, 0)), "cosine", 0, 0)


def add(spark: SparkSession, vectors: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding") -> None:
    """Append vectors to the cells that are there; those of another length or not finite are left out."""
    means, metric, dim, _ = _cells(spark, path)
    if not dim:
        raise ValueError(f"the collection at {path} has no vectors to take cells from: create it anew")
    _assigned(valid_vectors(vectors, vector, dim), key, vector, means, metric).write.mode("append").parquet(f"{path}/vectors")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = c.TOP_K, probes: int | None = None, key: str = "vec_id", vector: str = "embedding", same: bool = False) -> DataFrame:
    """query_id, key, score (to nine decimals; distances below zero) and rank. probes: cells asked for each query, by default as many as were measured. same: whether a row may find itself."""
    means, metric, dim, measured = _cells(spark, path)
    shape = f"query_id bigint, {key} bigint, score double"
    if not dim:
        return ranked(spark.createDataFrame([], shape), "query_id", key, k=k)
    probes = min(len(means), probes or measured)
    rows = spark.read.parquet(f"{path}/vectors")
    parts = rows.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    asked = _assigned(valid_vectors(queries, vector, dim), key, vector, means, metric, probes).join(parts, "cell")
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("cell", "part", F.col(key).cast("bigint").alias("query_id"), F.col(vector).alias("q"))
    held = rows.join(parts, "cell").select("cell", F.pmod(F.xxhash64(key), F.col("parts")).cast("int").alias("part"), F.col(key).cast("bigint").alias(key), vector)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not (a.num_rows and b.num_rows):
            return pa.table({"query_id": pa.array([], pa.int64()), key: pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        who, ids, right = np.asarray(a["query_id"]), np.asarray(b[key]), _rows(b[vector], metric)
        out = []
        for at in range(0, len(who), 256):
            scores = np.round(closeness(_rows(a["q"].slice(at, 256), metric), right, metric), 9)
            if not same:
                scores[who[at : at + 256, None] == ids[None, :]] = -np.inf
            top, found = best_of(scores, ids, k)
            row, place = np.nonzero(top > -np.inf)
            out.append((who[at : at + 256][row], found[row, place], top[row, place]))
        return pa.table(dict(zip(("query_id", key, "score"), (np.concatenate(x) for x in zip(*out, strict=True)), strict=True)))

    found = asked.groupBy("cell", "part").cogroup(held.groupBy("cell", "part")).applyInArrow(run, shape)
    return ranked(found, "query_id", key, k=k)


def recall(found: DataFrame, truth: DataFrame, key: str = "vec_id") -> DataFrame:
    """One row: queries, and the share of the true neighbours that were found."""
    both = truth.select("query_id", key).join(found.select("query_id", key, F.lit(1).alias("hit")), ["query_id", key], "left")
    return both.agg(F.countDistinct("query_id").alias("queries"), F.round(F.count("hit") / F.count("*"), 6).alias("recall"))


def scalability(vectors: DataFrame, queries: DataFrame, folder: str, sizes: list[int], key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Of each size: vectors written a second, milliseconds a query, and recall against the search over all rows. Times are wall times."""
    spark, out = vectors.sparkSession, []
    for n in sizes:
        part = vectors.orderBy(F.xxhash64(key), key).limit(n)
        began = time.perf_counter()
        create(part, f"{folder}/{n}", key=key, vector=vector)
        written = time.perf_counter() - began
        began = time.perf_counter()
        found = search(spark, f"{folder}/{n}", queries, key=key, vector=vector).collect()
        asked = time.perf_counter() - began
        found = spark.createDataFrame(found, f"query_id bigint, {key} bigint, score double, rank int")
        share = recall(found, nearest(queries, part, key=key, vector=vector), key).first()
        out.append((n, n / written, 1000 * asked / max(1, share["queries"]), share["recall"]))
    return spark.createDataFrame(out, "n bigint, inserted_a_second double, milliseconds_a_query double, recall double")
