"""A quality classifier: support vectors over n-gram indicators scaled by naive Bayes log-count ratios.

A document's indicators say which n-grams it has: of words (one and two), of its characters (three bytes), of word shapes
(one to three; a shape writes each run of small letters, capitals, digits or one mark as one character) and of whether a
word repeats the one before. They are hashed into fixed tables. Each indicator is scaled by the log ratio of its smoothed
share in the two classes, documents are brought to unit length, and a linear model with hinge loss is fitted by dual
coordinate descent. A logistic curve, fitted on margins of rows that were left out, turns margins into scores.

The model is fitted on at most MOST_ROWS labelled rows, those with the least hashes of their ids; a row has WIDTH bits, so
the one task that fits it holds at most 100 MB. Every document is scored, whole, with its text as the only input.

Defined cases: null texts are empty ones and score by the bias alone; rows without a label, or whose label isn't 0 or 1,
teach nothing; rows that repeat a doc_id teach once for each of its labels, by their least text; without labels of both classes the score is the smoothed share of
class 1; a null doc_id is never held out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import documents, fold, mix, pieces_of, texts_of, word_hashes

#: Places of word n-grams, of character n-grams, and of shape n-grams and repeats.
WORD_PLACES, CHAR_PLACES, SHAPE_PLACES = 1 << 15, 1 << 14, 1 << 14
WIDTH = WORD_PLACES + CHAR_PLACES + SHAPE_PLACES
MOST_ROWS, SMOOTH, COST, EPOCHS, FOLDS, THRESHOLD = 12_000, 1.0, 1.0, 8, 5, 0.3
_STEP = np.uint64(0x2545F4914F6CDD1D)


def _classes() -> bytes:
    """What stands for each byte in a shape."""
    table = np.arange(256, dtype=np.uint8)
    table[97:123], table[65:91], table[48:58], table[128:] = 97, 65, 48, 97
    table[[9, 10, 11, 12, 13]] = 32
    return table.tobytes()


_CLASS = _classes()


def shapes_of(texts: list[bytes]) -> list[bytes]:
    data = np.frombuffer(b"\n".join([t.translate(_CLASS) for t in texts]), np.uint8)
    if not len(data):
        return texts
    new = np.ones(len(data), bool)
    new[1:] = (data[1:] != data[:-1]) | (data[1:] == 10)
    return data[new].tobytes().split(b"\n")


def _grams(words: np.ndarray, n: int, seed: int) -> np.ndarray:
    out = np.full(max(0, len(words) - n + 1), seed, np.uint64)
    for k in range(n):
        out = out * _STEP + words[k : k + len(out)]
    return mix(out)


def indicators(texts: list[bytes]) -> np.ndarray:
    """A row of WIDTH truth values for each text."""
    out = np.zeros((len(texts), WIDTH), bool)
    words, firsts, _, _ = word_hashes(texts, lower=True)
    shapes, shape_firsts, _, _ = word_hashes(shapes_of(texts))
    for row, text in enumerate(texts):
        w, s = words[firsts[row] : firsts[row + 1]], shapes[shape_firsts[row] : shape_firsts[row + 1]]
        for n in (1, 2):
            out[row, (_grams(w, n, n) % np.uint64(WORD_PLACES)).astype(np.int64)] = True
        same = np.zeros(len(w), np.uint64)
        same[1:] = w[1:] == w[:-1]
        for n in (1, 2, 3):
            out[row, WORD_PLACES + CHAR_PLACES + (_grams(s, n, 16 + n) % np.uint64(SHAPE_PLACES)).astype(np.int64)] = True
            out[row, WORD_PLACES + CHAR_PLACES + (_grams(same, n, 32 + n) % np.uint64(SHAPE_PLACES)).astype(np.int64)] = True
        data = np.frombuffer(text, np.uint8).astype(np.uint32)
        if len(data) > 2:
            three = (data[2:] | data[1:-1] << np.uint32(8) | data[:-2] << np.uint32(16)) * np.uint32(2654435761)
            out[row, WORD_PLACES + (three >> np.uint32(18)).astype(np.int64)] = True
    return out


def log_count_ratios(rows: np.ndarray, labels: np.ndarray, smooth: float = SMOOTH) -> np.ndarray:
    """rows: packed indicators."""
    sums = []
    for c in (1, 0):
        total = np.full(WIDTH, smooth)
        for row in rows[labels == c]:
            total += np.unpackbits(row)
        sums.append(total / total.sum())
    return np.log(sums[0] / sums[1])


def dual_coordinate_descent(rows: np.ndarray, labels: np.ndarray, scale: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 0) -> np.ndarray:
    """Weights (the bias last) of the hinge-loss model over scaled indicators of unit length with a constant 1 added."""
    draw, weights, dual = np.random.Generator(np.random.PCG64(seed)), np.zeros(WIDTH + 1), np.zeros(len(rows))
    places = [np.flatnonzero(np.unpackbits(r)).astype(np.uint16) for r in rows]
    norms = [float(np.sqrt(np.sum(scale[p] ** 2))) or 1.0 for p in places]
    for _ in range(epochs):
        moved = 0.0
        for k in draw.permutation(len(rows)):
            p, y = places[k], 1.0 if labels[k] else -1.0
            x = scale[p] / norms[k]
            gradient = y * (weights[p] @ x + weights[-1]) - 1
            new = min(max(dual[k] - gradient / (2 if len(p) else 1), 0.0), cost)
            if change := new - dual[k]:
                weights[p] += change * y * x
                weights[-1] += change * y
                dual[k], moved = new, max(moved, abs(change))
        if moved < 1e-3:
            break
    return weights


def margins(rows: np.ndarray, scale: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """rows: truth values."""
    floats = rows.astype(np.float32)
    norms = np.sqrt(floats @ (scale**2).astype(np.float32))
    return floats @ (scale * weights[:-1]).astype(np.float32) / np.where(norms > 0, norms, 1) + weights[-1]


def logistic_curve(margin: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the score by margin: Newton's steps on smoothed targets."""
    n1, n0 = labels.sum(), (labels == 0).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, theta = np.stack([margin, np.ones(len(margin))]), np.asarray([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2), x @ (p - target) + 1e-6 * theta)
        theta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def fit(rows: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights (scaled, the bias last, then slope and offset) and scale, from packed indicators."""
    if len(np.unique(labels)) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        return np.concatenate([np.zeros(WIDTH + 2), [np.log(share / (1 - share))]]), np.ones(WIDTH)
    left_out = np.arange(len(rows)) % FOLDS == 0
    slope, offset = 1.0, 0.0
    if len(np.unique(labels[~left_out])) == 2:
        scale = log_count_ratios(rows[~left_out], labels[~left_out])
        weights = dual_coordinate_descent(rows[~left_out], labels[~left_out], scale)
        slope, offset = logistic_curve(np.concatenate([margins(np.unpackbits(r)[None], scale, weights) for r in rows[left_out]]), labels[left_out])
    scale = log_count_ratios(rows, labels)
    return np.concatenate([dual_coordinate_descent(rows, labels, scale), [max(slope, 0.0), offset]]), scale


def train(df: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Fit the model on the documents of labels (doc_id and label; at most so many rows, by the hashes of their ids)."""
    some = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    some = some.withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id", "label").limit(most)

    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(batches, most=1 << 20):
            bits = np.packbits(indicators(texts_of(b)), axis=1)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([r.tobytes() for r in bits], pa.binary())], names=["label", "order", "bits"])

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("order", "ascending"), ("label", "ascending"), ("bits", "ascending")])
        rows = np.frombuffer(b"".join(table["bits"].to_pylist()), np.uint8).reshape(-1, WIDTH // 8)
        weights, scale = fit(rows, np.asarray(table["label"]))
        return pa.table({"weights": pa.array([weights.tobytes()], pa.binary()), "scale": pa.array([scale.tobytes()], pa.binary())})

    # At most so many ids: small whatever the size of the tables.
    taught = df.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "label", "order").agg(F.min("text").alias("text"))
    rows = taught.select("text", "label", "order").mapInArrow(see, "label int, order bigint, bits binary")
    model = rows.groupBy(F.lit(1).alias("one")).applyInArrow(learn, "weights binary, scale binary").first()
    if model is None:
        return fit(np.zeros((0, WIDTH // 8), np.uint8), np.zeros(0, np.int64))
    return np.frombuffer(model["weights"]), np.frombuffer(model["scale"])


def scored(df: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id and score of every row."""
    weights, scale = model
    slope, offset = weights[-2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(batches, most=1 << 20):
            texts = texts_of(b)
            margin = np.concatenate([margins(indicators(texts[p : p + 128]), scale, weights[:-2]) for p in range(0, len(texts), 128)])
            score = 1 / (1 + np.exp(-np.clip(slope * margin.astype(np.float64) + offset, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], names=["doc_id", "score"])

    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, score double")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's score for quality 1, learned from labels outside the held-out fold."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels.where(fold("doc_id", 5) != 0))
    out = scored(docs, model)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
