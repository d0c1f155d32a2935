"""Work and memory that stay bounded where one piece, one passage or many tasks are large; packings no worse than by size."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F


def test_one_very_long_piece():
    """A run of letters without a break: time in proportion, states bounded within the piece, the ids those of the library."""
    import tiktoken

    from tessera.llm import byte_bpe as B

    ranks = B.read_ranks(B.RANKS)
    draw = random.Random(1)
    letters = lambda n: "".join(draw.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n)).encode()
    transducer = B.Transducer(ranks, kept_states=5_000)
    short, long = letters(50_000), letters(400_000)
    began = time.process_time()
    transducer.encode(short)
    once = time.process_time() - began
    began = time.process_time()
    ids = transducer.encode(long)
    assert time.process_time() - began < 8 * once * 3 + 1 and len(transducer.number) < 5_000 + 2 * B.RUN
    assert b"".join(transducer.bytes_of[t] for t in ids) == long
    library = tiktoken.Encoding("test", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    for piece in (letters(6_000), b"a" * 3_000 + letters(40), bytes(range(97, 123)) * 100, letters(B.RUN), letters(B.RUN + 1)):
        assert list(transducer.encode(piece)) == library.encode_ordinary(piece.decode())


LENGTHS = {
    "uniform": lambda d: d.integers(1, 2048, 4096), "300 to 900": lambda d: d.integers(300, 900, 4096), "400 to 1,100": lambda d: d.integers(400, 1100, 2000), "700 to 1,300": lambda d: d.integers(700, 1300, 4096),
    "log-normal": lambda d: np.clip(d.lognormal(5, 1, 4096).astype(int), 1, 2047), "short": lambda d: d.integers(1, 200, 4096), "exponential": lambda d: np.clip(d.exponential(400, 4096).astype(int), 1, 2047),
}


@pytest.mark.parametrize("kind", LENGTHS)
def test_islands_are_never_worse_than_packing_by_size(kind):
    """By the query's own settings: three islands, their elites moving on after each epoch."""
    from tessera.llm import packing as P

    sizes = LENGTHS[kind](np.random.default_rng(4))
    islands = [[] for _ in range(P.ISLANDS)]
    for epoch in range(P.EPOCHS):
        if epoch:
            islands = [[islands[k][0], *islands[(k + 1) % P.ISLANDS]] for k in range(P.ISLANDS)]
        islands = [P.evolve(sizes, x, 10 * epoch + k, by_size=epoch == P.EPOCHS - 1) for k, x in enumerate(islands)]
    best = min(len(np.unique(x[0])) for x in islands)
    plain = len(P.Packing(P.best_fit(sizes, np.argsort(-sizes, kind="stable"), np.full(len(sizes), -1), [], P.CAPACITY), sizes).fill)
    assert -(-int(sizes.sum()) // P.CAPACITY) <= best <= plain


def test_copies_of_an_index_stay_below_what_is_streamed(spark, monkeypatch):
    """Very many small documents of one passage: its index is cut out of its document once, and its copies have no more words than the documents."""
    from tessera.llm import substring_dedup as S

    passage = " ".join(f"p{k}" for k in range(30))
    monkeypatch.setattr(S, "SHARD_WORDS", 2_000)
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit(passage).alias("text"))
    docs = S.identified(df).select(F.col("__tessera_k").alias("k"), F.col("__tessera_h").alias("h"), "text")
    rows = S.shards_of(docs)
    words = F.sum(F.when(F.col("first"), 30).otherwise(0))
    loads = rows.groupBy("shard").agg(words.alias("index"), F.count("*").alias("n")).collect()
    assert sum(x["index"] for x in loads) <= 6000 * 30 and max(x["n"] for x in loads) * 30 < 4 * 2_000
    kept = S.remove_repeats(df).where("text <> ''").collect()
    assert [(x.doc_id, x.text) for x in kept] == [(0, passage)]


def test_weights_of_many_tasks_are_averaged_by_levels(spark, monkeypatch):
    """More tasks than meet at once: the mean is that of all, weighed by their words."""
    from tessera.llm import gru, lm_scoring as L

    monkeypatch.setattr(L, "FAN", 3)
    df = spark.createDataFrame([(k, f"a b c d{k % 3} " * 20) for k in range(40)], "doc_id bigint, text string").repartition(20)
    words = L.vocabulary(L.word_counts(df))
    borders = gru.class_borders(words.counts, L.CLASSES)
    fresh = gru.fresh(words.counts, borders)
    by_levels = gru.pack(L._round(df, words, fresh, borders))
    monkeypatch.setattr(L, "FAN", 1000)
    at_once = gru.pack(L._round(df, words, fresh, borders))
    assert np.allclose(by_levels, at_once, atol=1e-4) and not np.allclose(by_levels, gru.pack(fresh), atol=1e-4)
