"""Covariance, principal components and heatmaps of vectors, from sums that tasks make of their batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most dimensions whose square matrix the driver takes apart (128 MB of doubles).
MOST_DIMENSIONS = 4096


def outer_sums(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """i, j, n, s and p: over all vectors of the first one's length their number, the sum of component i, and the sum of products of components i and j (j up to i). A task sends one matrix, whatever it reads. Null vectors and those with nulls take no part."""
    first = vectors.where(F.size(vector) > 0).select(F.size(vector)).first()
    dim = first[0] if first else 0
    rows = vectors.where((F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull())).select(F.col(vector).cast("array<double>").alias("v"))
    i, j = np.tril_indices(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column(0).flatten()).reshape(b.num_rows, dim)
                n, total, products = n + len(x), total + x.sum(0), products + x.T @ x
        if n:
            for at in range(0, len(i), 100_000):
                a, c = i[at : at + 100_000], j[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(np.full(len(a), n)), pa.array(total[a]), pa.array(total[c]), pa.array(products[a, c])], names=["i", "j", "n", "s", "t", "p"])

    parts = rows.mapInArrow(run, "i int, j int, n bigint, s double, t double, p double")
    return parts.groupBy("i", "j").agg(*(F.sum(x).alias(x) for x in ("n", "s", "t", "p")))


def covariance(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """i, j (up to i) and the sample covariance of these components; of fewer than two vectors null."""
    value = F.when(F.col("n") > 1, (F.col("p") - F.col("s") * F.col("t") / F.col("n")) / (F.col("n") - 1))
    return outer_sums(vectors, vector).select("i", "j", value.alias("covariance"))


def means(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """i and the mean of this component."""
    return outer_sums(vectors, vector).where("i = j").select("i", (F.col("s") / F.col("n")).alias("mean"))


def principal_components(vectors: DataFrame, k: int = 2, vector: str = "embedding") -> tuple[DataFrame, list[float], np.ndarray]:
    """The k directions of most variance: a table (component, variance, share, direction), the vectors' mean, and the directions as a matrix. The direction's component of greatest size is positive. Only the square matrix of the dimensions comes to the driver."""
    spark = vectors.sparkSession
    rows = outer_sums(vectors, vector).toArrow()  # dim * (dim + 1) / 2 rows
    schema = "component int, variance double, share double, direction array<double>"
    dim = 1 + max(rows["i"].to_pylist(), default=-1)
    if dim > MOST_DIMENSIONS:
        raise ValueError(f"more than {MOST_DIMENSIONS} dimensions")
    if not dim or rows["n"][0].as_py() < 2:
        return spark.createDataFrame([], schema), [], np.zeros((0, dim))
    i, j, n, s, t, p = (np.asarray(rows[c]) for c in ("i", "j", "n", "s", "t", "p"))
    square, mean = np.zeros((dim, dim)), np.zeros(dim)
    square[i, j] = square[j, i] = (p - s * t / n) / (n - 1)
    mean[i] = s / n
    values, directions = np.linalg.eigh(square)
    order = np.argsort(-values, kind="stable")[:k]
    directions = directions[:, order].T
    directions *= np.sign(directions[np.arange(len(order)), np.abs(directions).argmax(1)])[:, None]
    whole = float(values.sum())
    table = [(m, float(values[o]), float(values[o] / whole) if whole else 0.0, [float(x) for x in d]) for m, (o, d) in enumerate(zip(order, directions, strict=True))]
    return spark.createDataFrame(table, schema), [float(x) for x in mean], directions


def projected(vectors: DataFrame, mean: list[float], directions: np.ndarray, vector: str = "embedding", to: str = "projection") -> DataFrame:
    """The rows with their vector's places along the directions; null for null vectors and vectors of another length."""
    away = F.transform(F.col(vector), lambda x, k: x.cast("double") - F.get(F.array(*map(F.lit, mean)), k))
    along = lambda d: F.aggregate(F.zip_with(away, F.array(*(F.lit(float(x)) for x in d)), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return vectors.withColumn(to, F.when(F.size(vector) == len(mean), F.array(*map(along, directions))))


def cosine_heatmap(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """a, b (from a on), pairs and cosine: the mean cosine of all pairs of different rows with these labels, from the labels' sums of unit vectors; no pairs are formed. Zero vectors have cosine 0 with all; null labels and vectors take no part."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = vectors.where(F.col(label).isNotNull() & (F.size(vector) > 0)).withColumn("__norm", norm)
    unit = F.when(F.col("__norm") > 0, F.col(vector).cast("array<double>")).otherwise(F.transform(vector, lambda x: F.lit(0.0)))
    parts = rows.select(F.col(label).alias("a"), (F.col("__norm") > 0).cast("bigint").alias("own"), F.posexplode(F.transform(unit, lambda x: x / F.when(F.col("__norm") > 0, F.col("__norm")).otherwise(1.0))).alias("d", "x"))
    sums = parts.groupBy("a", "d").agg(F.sum("x").alias("s"))
    counts = rows.groupBy(F.col(label).alias("a")).agg(F.count("*").alias("n"), F.sum((F.col("__norm") > 0).cast("bigint")).alias("own"))
    both = sums.join(sums.select(F.col("a").alias("b"), "d", F.col("s").alias("t")), "d").where("a <= b").groupBy("a", "b").agg(F.sum(F.col("s") * F.col("t")).alias("dot"))
    other = counts.select(F.col("a").alias("b"), F.col("n").alias("m"))
    pairs = F.when(F.col("a") == F.col("b"), F.col("n") * (F.col("n") - 1)).otherwise(F.col("n") * F.col("m"))
    dots = F.when(F.col("a") == F.col("b"), F.col("dot") - F.col("own")).otherwise(F.col("dot"))
    return both.join(counts, "a").join(other, "b").select("a", "b", pairs.alias("pairs"), F.when(pairs > 0, dots / pairs).alias("cosine"))
