"""Hard negatives, mixing and ranked search against plain versions, and on empty and odd tables."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hard_negatives as hard
from tessera.llm import mixing, ranked_search

VECTORS = "vec_id bigint, embedding array<float>, label int, rank string, score int"


def plain_negatives(rows, positives=5, negatives=5, percent=80, every=100):
    """rows: {id: (label, components)}"""
    out = []
    score = lambda a, b: sum(x * y for x, y in zip(rows[a][1], rows[b][1], strict=False))
    for a in (k for k in rows if k % every == 0):
        ordered = sorted((k for k in rows if k != a), key=lambda k: (-score(a, k), k))
        for p in [k for k in ordered if rows[k][0] == rows[a][0]][:positives]:
            s = score(a, p)
            below = [k for k in ordered if rows[k][0] != rows[a][0] and percent * s <= 100 * score(a, k) <= 100 * s][:negatives]
            out += [(a, p, n + 1, k, s, score(a, k)) for n, k in enumerate(below)]
    return sorted(out)


def whole(v):
    return [int(np.floor(float(np.float32(x)) * 256)) for x in v]


def test_negatives_of_a_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    rows = {r.vec_id: ((r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, whole(r.embedding)) for r in table}
    found = hard.op11_sorted_hard_negatives(spark, "/root/testdata/sf0.001").collect()
    assert sorted(tuple(r) for r in found) == plain_negatives(rows) and found


@pytest.mark.parametrize("block", [4, 1000])
def test_negatives_with_ties_and_odd_rows(spark, monkeypatch, block):
    """Small components make many ties, scores at and below zero and full windows; blocks of few rows make many cells."""
    monkeypatch.setattr(hard, "BLOCK", block)
    draw = np.random.default_rng(3)
    good = {int(k): (int(draw.integers(0, 3)), [float(x) for x in draw.integers(-2, 4, 3) / 256]) for k in range(-5, 60)}
    good[70] = (1, [0.01, 0.02])  # a shorter vector
    odd = [(None, [0.1], 1), (71, None, 1), (72, [0.1, None], 1), (73, [0.1, float("nan")], 1), (74, [float("inf")], 1), (75, [0.1], None), (80, [], 2)]
    again = [(3, good[3][1], good[3][0]), (4, [9.0] * 3, 9)]  # an equal row, and one with a greater label: not counted
    rows = [(k, v, n) for k, (n, v) in good.items()] + odd + again
    df = spark.createDataFrame([(*r, None, 1) for r in rows], VECTORS)
    found = sorted(tuple(r) for r in hard.hard_negatives(hard.usable(df), F.col("vec_id") % 10 == 0, 3, 2, 50).collect())
    usable = {k: (n, whole(v)) for k, (n, v) in good.items()} | {80: (2, [])}
    assert found == plain_negatives(usable, 3, 2, 50, every=10) and len(found) > 20


def test_negatives_of_wild_components_and_of_nothing(spark):
    big = [(0, [1e30, 1.0], 1), (1, [16000.0, 16000.0], 1), (2, [16000.0, 15999.0], 2), (3, [-1e30, 0.0], 1)]
    df = spark.createDataFrame([(*r, None, None) for r in big], VECTORS)
    saturated = lambda v: [max(-(1 << 22), min(1 << 22, int(x * 256))) for x in v]
    expected = plain_negatives({k: (n, saturated(v)) for k, v, n in big})
    assert sorted(tuple(r) for r in hard.hard_negatives(hard.usable(df), F.col("vec_id") % 100 == 0).collect()) == expected and expected
    assert hard.hard_negatives(hard.usable(df.limit(0)), F.col("vec_id") % 100 == 0).collect() == []


def test_keys_sort_as_pairs_do():
    draw = np.random.default_rng(5)
    a, s, o = (draw.integers(-(1 << 62), 1 << 62, 400) // 10 ** draw.integers(0, 19, 400) for _ in range(3))
    keys = hard.pack(a, s, 0, o) + hard.pack(a, s, 1, o)
    read = [hard.unpack(k) for k in sorted(keys)]
    assert read == sorted(read, key=lambda x: (x[0], -x[1], x[2], x[3])) and set(read) == {(int(x), int(y), k, int(z)) for x, y, z in zip(a, s, o, strict=True) for k in (0, 1)}


def plain_targets(sizes, weights, most):
    level, clamped = 0.0, set()
    while True:
        room, left = sum(sizes.values()) - sum(most * sizes[s] for s in clamped), sum(weights[s] for s in sizes if s not in clamped)
        if not left:
            return {s: float(most * sizes[s]) for s in sizes}
        level = room / left
        now = {s for s in sizes if weights[s] * level > most * sizes[s]}
        if now == clamped:
            return {s: float(most * sizes[s]) if s in clamped else weights[s] * level for s in sizes}
        clamped = now


def mixed_rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, taken string, size int, row int")


@pytest.mark.parametrize(("broadcast", "digits"), [(100, 3), (0, 1)])
def test_mix(spark, monkeypatch, broadcast, digits):
    monkeypatch.setattr(mixing, "MOST_BROADCAST", broadcast)
    monkeypatch.setattr(mixing, "DIGITS", digits)
    draw = np.random.default_rng(8)
    names = ["a", "b", "é", "Z", "hot", None, "empty"]
    rows = [(k, " ".join(["w"] * int(draw.integers(0, 40))) + "\t", "hot" if k % 3 else names[int(draw.integers(0, 6))], "x", 1, k) for k in range(300)]
    rows += [(None, "one two", "hot", "x", 1, 2), (5, rows[5][1], rows[5][2], "x", 1, 5), (7, None, "empty", None, None, None), (8, " \n", "empty", None, None, None), (9, "long " * 3000, "b", None, None, 1)]
    out = mixing.mix(mixed_rows(spark, rows), text="text").collect()
    assert len(out) == len(rows)
    size_of, sums = {}, Counter()
    for _, text, source, *_ in rows:
        size_of[source] = size_of.get(source, 0) + len((text or "").split())
    order = sorted(size_of, key=lambda s: (s is None, s or ""))
    target = plain_targets(size_of, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 3)
    for r in out:
        assert r["size"] == len((r.text or "").split()) and r.source_size == size_of[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 3 * r["size"]
        sums[r.source] += r.taken
    assert all(abs(sums[s] - target[s]) <= 1 for s in size_of)
    again = mixing.mix(mixed_rows(spark, rows).repartition(5), text="text").collect()
    assert Counter(map(str, again)) == Counter(map(str, out))
    # The order is seeded: another seed takes other documents, as many words.
    other = mixing.mix(mixed_rows(spark, rows), seed=1, carry=["doc_id", "source"]).collect()
    assert {(r.doc_id, r.taken) for r in other} != {(r.doc_id, r.taken) for r in out} and sum(r.taken for r in other) == sum(r.taken for r in out)


def test_mix_repeats_texts(spark):
    rows = [(k, f"w{k} " * (k + 1), "a" if k < 12 else "b", None, None, None) for k in range(14)] + [(50, "", "c", None, None, None), (51, None, None, None, None, None)]
    mixed = mixing.mix(mixed_rows(spark, rows))
    words = Counter()
    for r in mixing.repeated(mixed).collect():
        words[r.doc_id] += len(r.text.split())
        assert set(r.text.split()) == {f"w{r.doc_id}"}
    assert words == Counter({r.doc_id: r.taken for r in mixed.collect()})
    assert mixing.mix(mixed_rows(spark, rows).limit(0)).collect() == []


def test_words_of_texts(spark):
    texts = ["", " ", "\n\t", "a", " a  b c\x0b\x0cd\r\n", "é ü x"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "text string").select(mixing.words())
    assert [r[0] for r in df.collect()] == [len(re.findall("[^\x20\x09-\x0d]+", t)) for t in texts] + [0]


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def split_terms(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, top=10):
    split = [(d, split_terms(t)) for d, t in docs]
    n_docs, total = sum(bool(w) for _, w in split), sum(len(w) for _, w in split)
    df = Counter(t for _, w in split for t in set(w))
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(split_terms(text))
    out = []
    for item, wanted in asked.items():
        found = []
        for doc, words in split:
            tf, m = Counter(words), 10 + (90 * len(words) * n_docs) // max(1, total)
            score = sum(int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df[t] + 1)))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in wanted if tf[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, k + 1, None if null else doc, -s) for k, (s, null, doc) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


def searched(spark, docs, items, **sizes):
    index = ranked_search.index_documents(spark.createDataFrame(docs, "doc_id bigint, text string, score string, shard int").repartition(3), **sizes)
    found = ranked_search.search(index, spark.createDataFrame(items, "item_id bigint, text string, rank int"))
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.mark.parametrize(("sizes", "broadcast", "items"), [({}, 200_000, 256), ({"shard": 7}, 0, 3), ({"shard_bytes": 300}, 200_000, 2)])
def test_search(spark, corpus, monkeypatch, sizes, broadcast, items):
    monkeypatch.setattr(ranked_search, "MOST_BROADCAST", broadcast)
    monkeypatch.setattr(ranked_search, "MOST_ITEMS", broadcast)
    monkeypatch.setattr(ranked_search, "ITEMS", items)
    docs = [(r[0], r[1]) for r in corpus] + [(None, corpus[3][1]), (3, corpus[3][1]), (3, "other text"), (77, "ÀÉ İ straße STRASSE x_y-z 12a")]
    asked = [(k, " ".join((corpus[k][1] or "").split()[10:30])) for k in range(0, 75, 5)] + [(1, "the of"), (1, "and"), (2, ""), (3, None), (4, "nowhere-at-all"), (None, "İ STRASSE"), (6, "  "), (9, "é" * 30_000)]
    assert searched(spark, [(*d, None, 1) for d in docs], [(*x, 1) for x in asked], **sizes) == plain_search(docs, asked)


def test_search_of_nothing(spark):
    assert searched(spark, [(1, "some text", None, 1)], []) == [] == searched(spark, [], [(1, "some text", 1)]) == searched(spark, [(1, None, None, 1), (2, "?", None, 1)], [(1, "some text", 1)])


@pytest.mark.parametrize("seed", range(30))
def test_best_first_finds_what_a_full_scan_does(seed):
    """Random lists with many ties; where a few documents stand out, most are never scored."""
    draw = np.random.default_rng(seed)
    n = int(draw.integers(1, 400))
    lists = []
    for _ in range(int(draw.integers(1, 9))):
        places = np.flatnonzero(draw.random(n) < draw.random())
        lists.append((places, draw.integers(0, 3 if seed % 2 else 1000, len(places))))
    scores = np.zeros(n, np.int64)
    for p, i in lists:
        scores[p] += i
    expected = sorted((-int(s), k) for k, s in enumerate(scores) if s > 0)[:10]
    assert ranked_search.best_documents(lists, n, 10)[0] == expected


def test_most_documents_are_never_scored():
    draw = np.random.default_rng(2)
    lists = [(p, draw.integers(1, 100, len(p))) for p in (np.flatnonzero(draw.random(20_000) < 0.05) for _ in range(20))]
    for k in range(len(lists)):
        lists[k] = (np.union1d(lists[k][0], np.arange(500, 520)), np.concatenate([draw.integers(1, 100, len(np.union1d(lists[k][0], np.arange(500, 520))))]))
        lists[k][1][np.isin(lists[k][0], np.arange(500, 520))] += 60
    best, scored = ranked_search.best_documents(lists, 20_000, 10)
    assert all(500 <= place < 520 for _, place in best) and scored < 2_000


def test_terms_of_a_long_text_in_pieces():
    text = ("Ab1 é_" * 5000).encode()
    assert [w for part in ranked_search.terms(text, 64) for w in part] == ranked_search._TERM.findall(text.lower())
