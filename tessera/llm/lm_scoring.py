"""Log probabilities of whole documents by a gated recurrent language model.

Counts. Every word of every training document is counted. The most frequent words make the model's vocabulary, all others
share one place in it and are told apart by their smoothed counts, so that each word has its probability.

Training. Each task trains the model on all of its documents in turn, by truncated backpropagation, from the same weights;
then the weights are averaged over tasks, weighted by words, in groups of at most FAN; some rounds of this, each over
another part of the documents, go through every training document once.

Scoring. Documents are dealt into groups of some megabytes. A group asks for the counts of its distinct words only, and
runs its documents through the model side by side, each from its first word to its end with its state carried along.

Defined cases: a null or empty text is its end alone; very long texts run to their end; rows that repeat are scored each;
a null doc_id is never held out; without training documents the counts are 0 and the model stays at its first weights; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import gru
from tessera.llm.shared import documents, fold, pieces_of, stored, texts_of, word_hashes

VOCABULARY, CLASSES, ROUNDS, FAN = 1024, 24, 3, 32
GROUP_BYTES = 12 << 20
#: What stands for the end among words' hashes; the id of the words outside the vocabulary.
END_HASH, OTHER = np.uint64(1), 1
SMOOTH = 0.1


def hashes_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, A-Z in lower case, and an end after each; where each text begins, and the end."""
    parts, sizes, at = [], [], 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) < 2 << 20):
            size += len(texts[to])
            to += 1
        hashes, firsts, _, _ = word_hashes(texts[at:to], lower=True)
        parts.append(np.insert(hashes, firsts[1:], END_HASH))
        sizes.append(np.diff(firsts) + 1)
        at = to
    starts = np.zeros(len(texts) + 1, np.int64)
    if texts:
        np.cumsum(np.concatenate(sizes), out=starts[1:])
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), starts


def word_counts(df: DataFrame) -> DataFrame:
    """hash and c: how often each word, and the end, is in the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(batches, most=6 << 20):
            values, counts = np.unique(hashes_of(texts_of(b))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], names=["hash", "c"])

    return df.select("text").mapInArrow(run, "hash bigint, c bigint").groupBy("hash").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The end, all other words, and the most frequent words."""

    def __init__(self, words: list[tuple[int, int]], total: int, distinct: int, ends: int):
        """words: hashes and counts of the most frequent words, without the end."""
        hashes = np.asarray([h for h, _ in words], np.int64).view(np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order + 2
        listed = sum(c for _, c in words)
        self.counts = np.asarray([ends, total - ends - listed, *(c for _, c in words)], np.float64)
        self.total, self.distinct = total, distinct
        self.other_total, self.other_distinct = total - ends - listed, distinct - len(words) - (ends > 0)

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), OTHER, np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            found = self.hashes[at] == hashes
            out[found] = self.ids[at[found]]
        out[hashes == END_HASH] = gru.END
        return out


def vocabulary(counts: DataFrame, size: int = VOCABULARY) -> Vocabulary:
    end = int(np.int64(END_HASH))
    total, distinct, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("hash") == end, F.col("c"))), F.lit(0))).first()
    top = counts.where(F.col("hash") != end).orderBy(F.desc("c"), "hash").limit(size - 2).collect()  # as many as the vocabulary has
    return Vocabulary([(r["hash"], r["c"]) for r in top], total, distinct, ends)


def _round(df: DataFrame, words: Vocabulary, weights: dict[str, np.ndarray], borders: np.ndarray) -> dict[str, np.ndarray]:
    """Weights after every task has learned from its documents once, averaged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = gru.Trainer({k: v.copy() for k, v in weights.items()}, borders)
        for b in pieces_of(batches):
            trainer.learn(words.look_up(hashes_of(texts_of(b))[0]))
        if trainer.words:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([float(trainer.words)]), pa.array([gru.pack(trainer.w).tobytes()], pa.binary())], names=["slot", "words", "flat"])

    def average(table: pa.Table) -> pa.Table:
        sizes = np.asarray(table["words"])
        flat = sum(np.frombuffer(x, np.float32).astype(np.float64) * (n / sizes.sum()) for x, n in zip(table.sort_by("slot")["flat"].to_pylist(), np.asarray(table.sort_by("slot")["words"]), strict=True))
        return pa.table({"slot": pa.array([min(table["slot"].to_pylist()) // FAN], pa.int64()), "words": pa.array([float(sizes.sum())]), "flat": pa.array([flat.astype(np.float32).tobytes()], pa.binary())})

    shape = "slot bigint, words double, flat binary"
    # At most FAN weights meet in a task, level by level, however many tasks there were.
    out = stored(df.select("text").mapInArrow(run, shape), "weights")
    while (out.agg(F.max("slot")).first()[0] or 0) >= FAN:
        out = stored(out.groupBy(F.floor(F.col("slot") / FAN).alias("g")).applyInArrow(average, shape), "weights")
    mean = out.groupBy(F.lit(0).alias("g")).applyInArrow(average, shape).first()
    return weights if mean is None else gru.unpack(np.frombuffer(mean["flat"], np.float32), weights)


def train(df: DataFrame, words: Vocabulary, rounds: int = ROUNDS) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The model's weights and class borders after all documents."""
    borders = gru.class_borders(words.counts, CLASSES)
    weights = gru.fresh(words.counts, borders)
    for k in range(rounds):
        weights = _round(df.where(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(rounds)) == k), words, weights, borders)
    return weights, borders


def scored(df: DataFrame, counts: DataFrame, words: Vocabulary, weights: dict[str, np.ndarray], borders: np.ndarray) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score (both in log10) of every row."""
    kind = df.schema["doc_id"].dataType.simpleString()
    size = df.agg(F.sum(F.coalesce(F.octet_length("text").cast("bigint"), F.lit(0)) + 64)).first()[0] or 0
    group = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(-(-size // GROUP_BYTES) or 1)).cast("int")
    docs = df.select("doc_id", "text", group.alias("g")).repartition("g")

    def ask(table: pa.Table) -> pa.Table:
        values = np.unique(hashes_of(table_texts(table))[0])
        return pa.table({"g": pa.array(np.full(len(values), table["g"][0].as_py(), np.int32)), "hash": pa.array(values.view(np.int64))})

    def score(table: pa.Table, known: pa.Table) -> pa.Table:
        hashes, starts = hashes_of(table_texts(table))
        # The group has asked for exactly its distinct words.
        distinct, at = np.unique(hashes, return_inverse=True)
        asked = np.asarray(known["hash"]).view(np.uint64)
        order = np.argsort(asked)
        if not np.array_equal(asked[order], distinct):
            raise ValueError("a group's answers are not those to its words")
        count, ids = np.asarray(known["c"])[order][at].astype(np.float64), words.look_up(distinct)[at]
        base = np.log10((count + SMOOTH) / (words.total + SMOOTH * (words.distinct + 1)))
        model = gru.document_scores(weights, borders, ids, starts) / np.log(10)
        model += np.where(ids == OTHER, np.log10((count + SMOOTH) / (words.other_total + SMOOTH * (words.other_distinct + 1))), 0.0)
        sums = lambda x: np.add.reduceat(x, starts[:-1]) if len(x) else x[:0]
        return pa.table({"doc_id": table["doc_id"], "n_tokens": pa.array(np.diff(starts)), "n_known": pa.array(sums((count > 0).astype(np.int64))), "base_score": pa.array(sums(base)), "score": pa.array(sums(model))})

    asked = docs.groupBy("g").applyInArrow(ask, "g int, hash bigint")
    answers = asked.join(counts, "hash", "left").select("g", "hash", F.coalesce("c", F.lit(0)).alias("c"))
    return docs.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(score, f"doc_id {kind}, n_tokens bigint, n_known bigint, base_score double, score double")


def table_texts(table: pa.Table) -> list[bytes]:
    return [x or b"" for x in table["text"].cast(pa.binary()).to_pylist()]


def language_model_scores(df: DataFrame, training: Column) -> DataFrame:
    """scored() by a model of the rows for which training holds, and train_tokens."""
    learned = df.where(training).select("doc_id", "text")
    counts = stored(word_counts(learned), "counts")
    words = vocabulary(counts)
    weights, borders = train(learned, words)
    return scored(df, counts, words, weights, borders).withColumn("train_tokens", F.lit(words.total).cast("bigint"))


def op4_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's base score and the model's, learned outside the held-out tenth."""
    out = language_model_scores(documents(spark, sf_dir), fold("doc_id", 10) != 0)
    return out.select("doc_id", (fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
