"""What used to grow faster than its input."""

import time
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.operators import evaluation as ev
from tessera.operators import evidence as evd
from tessera.operators import graph_retrieval as gr
from tessera.operators import mining as mn
from tessera.operators import retrieval as r
from tessera.sources import blocks as bl
from tessera.sources import datasets as ds
from tessera.sources import versions


def test_long_text_is_taken_in_proportion(spark, tmp_path):
    """A text's length was summed anew for each of its distinct words."""
    texts = [(k, "t", " ".join(f"w{k}x{i}" for i in range(24_000))) for k in range(4)]
    docs = spark.createDataFrame(texts, "resource_id bigint, title string, text string")
    begun = time.monotonic()
    versions.take_in(spark, tmp_path.as_uri(), docs, 0)
    assert time.monotonic() - begun < 60
    rows = versions.part(spark, tmp_path.as_uri(), "postings")
    assert rows.count() == 4 * 24_000 and {x["dl"] for x in rows.select("dl").distinct().collect()} == {24_000}


def test_embeddings_counted_together(spark, monkeypatch):
    """Texts of a batch are counted together, in slices, with the same vectors as one by one."""
    texts = ["the cat sat", None, "", "é ß xy", "cat " * 700, "a b", " ".join(f"w{k}" for k in range(500))]

    def one(text, dim=64):
        out = np.zeros(dim)
        for w in (x for x in (text or "").split() if len(x) > 1):
            for f in (w, *(f"#{w}#"[i : i + n] for n in (3, 4, 5) for i in range(len(w) + 3 - n))):
                h = int.from_bytes(blake2b(f.encode(), digest_size=8).digest(), "big")
                out[h % dim] += -1 if h >> 63 else 1
        return (out / (np.linalg.norm(out) or 1)).astype(np.float32)

    monkeypatch.setattr(r, "SLICE_WORDS", 100)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    for row in docs.select("doc_id", r.hash_embedding(F.col("text"), 64).alias("v")).collect():
        assert np.array_equal(np.array(row["v"], np.float32), one(texts[row["doc_id"]]))


def test_weak_resources_of_asked_pairs(spark):
    """Only pairs that are asked for are made; without them students with equal weak concepts share one list."""
    who = spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.2), (2, "b", 0.1), (2, "a", 0.3), (3, "a", 0.9), (4, None, 0.1), (5, "c", 0.0)], "student int, concept string, mastery double")
    links = spark.createDataFrame([("a", "1", "x"), ("a", "1", "y"), ("b", "1", "x"), ("b", "2", "x"), ("c", "3", "x"), ("d", "4", "x")], "concept string, resource string, kind string")
    whole = sorted(map(tuple, gr.weak_resources(who, links, 0.4).collect()))
    assert whole == [(1, "1"), (1, "2"), (2, "1"), (2, "2"), (5, "3")]
    among = spark.createDataFrame([(1, "2"), (1, "2"), (2, "3"), (3, "1"), (5, "3"), (None, "1")], "student int, resource string")
    assert sorted(map(tuple, gr.weak_resources(who, links, 0.4, among).collect())) == [(1, "2"), (5, "3")]


def test_weak_resources_of_many_students(spark, tmp_path, monkeypatch):
    """Students times resources rows make small files, as resources come in one order time and again; ids that are null, packs and tasks of any size, and no rows at all are right."""
    who = spark.range(2000).select(F.col("id").alias("student"), F.explode(F.array(*map(F.lit, "abc"))).alias("concept")).select("*", F.when(F.pmod(F.hash("student", "concept"), F.lit(3)) == 0, 0.9).otherwise(0.1).alias("mastery"))
    links = spark.range(3001).select(F.explode(F.array(*map(F.lit, "abcd"))).alias("concept"), F.sha2(F.col("id").cast("string"), 256).alias("resource"), F.lit("x").alias("kind")).where(F.pmod(F.hash("resource", "concept"), F.lit(3)) > 0)
    gr.weak_resources(who, links, 0.4).write.parquet((tmp_path / "out").as_uri())
    out = spark.read.parquet((tmp_path / "out").as_uri())
    rows = out.count()
    expected = who.where("mastery < 0.4").join(links, "concept").select("student", "resource").distinct()
    total = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("student", "resource").cast("decimal(38,0)"))).first()
    assert rows > 4_000_000 and tuple(total(out)) == tuple(total(expected))
    assert sum(x.stat().st_size for x in (tmp_path / "out").glob("*.parquet")) < 0.5 * rows
    for name, value in (("PACKED_STUDENTS", 2), ("PACKED_RESOURCES", 3), ("TASK_ROWS", 5), ("UNPACKED_ROWS", 4), ("RUN", 8)):
        monkeypatch.setattr(gr, name, value)
    few = spark.createDataFrame([(k, c, 0.1) for k in (1, 2, 3, 4, 5, None) for c in "ab"], "student int, concept string, mastery double")
    some = spark.createDataFrame([(c, r, "x") for c in "ab" for r in (*map(str, range(21)), None)] + [(None, "q", "x"), ("z", "r", "x")], "concept string, resource string, kind string")
    got = [tuple(x) for x in gr.weak_resources(few, some, 0.4).collect()]
    assert len(got) == 6 * 22 and set(got) == {(k, r) for k in (1, 2, 3, 4, 5, None) for r in (*map(str, range(21)), None)}
    assert gr.weak_resources(few, some, 0.01).count() == 0 and gr.weak_resources(few, some.where("concept = 'z'"), 0.4).count() == 0


def test_coherence_of_wide_vectors(spark):
    """A vector's length was taken anew for each of its values; pairs that there are none of have no mean."""
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 2000)) + np.repeat(np.eye(2000)[:3] * 30, 100, axis=0)
    v[5] = 0
    labels = [None if k < 20 else "ab"[k % 2] for k in range(300)]
    rows = spark.createDataFrame([(w, x.tolist()) for w, x in zip(labels, v, strict=True)], "label string, embedding array<double>").repartition(4)
    begun = time.monotonic()
    got = ev.coherence_gap(rows).first()
    assert time.monotonic() - begun < 25
    x = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    cosines, own, off = x @ x.T, np.array([[i == j for j in labels] for i in labels]), ~np.eye(300, dtype=bool)
    assert np.allclose(tuple(got), (cosines[own & off].mean(), cosines[~own].mean(), cosines[own & off].mean() - cosines[~own].mean()), atol=1e-6)
    assert tuple(ev.coherence_gap(rows.where("label IS NULL").limit(1)).first()) == (None, None, None) and ev.coherence_gap(rows.where("label = 'a'")).first()["other_label"] is None


def test_aliases_are_found_where_texts_are(spark, monkeypatch):
    """Every run of words of every text was shuffled to meet a few aliases; the mentions are the same either way."""
    texts = ["the nn of the nn, THE NN", None, "", "nn", "a b c a b c d", "of", "the " * 50, "é b the of é", "b c"]
    docs = spark.createDataFrame([*enumerate(texts), (None, "the nn"), (3, "nn of"), (8, "of the")], "doc_id int, text string").repartition(3)
    pairs = [("nn", "net"), ("the nn", "net"), ("the", "article"), ("the", "word"), ("of the", "link"), ("a b c", "abc"), ("c a b", "cab"), ("b c d", "x"), ("é", "e"), ("a b c d", "four"), ("nn", "net"), ("", "none"), (None, "none"), ("NN", "none"), ("nn of the", "long")]
    lexicon = spark.createDataFrame(pairs, "alias string, concept string")
    rows = lambda: sorted(map(str, mn.aliases(docs, lexicon).collect()))
    got = rows()
    monkeypatch.setattr(mn, "SLICE_WORDS", 5)
    assert got == rows()
    plan = mn.aliases(docs, lexicon)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    monkeypatch.setattr(mn, "NAMED_ALIASES", 3)
    assert got == rows() and len(got) > 12
    assert mn.aliases(docs, lexicon.where("alias = ''")).count() == 0 and mn.aliases(docs, lexicon.where("false")).count() == 0


def test_only_candidates_are_scored(spark, monkeypatch):
    """The ranking is that of all resources' scores; the largest may be of a resource that is no candidate, and what all queries reach is not made."""
    top = spark.createDataFrame([(1, 10, 0.5, 1), (1, 11, 0.4, 2), (1, 12, 0.3, 3), (2, 10, 0.2, 1)], "item_id int, doc_id bigint, score double, rank int")
    links = spark.createDataFrame([("a", "12", "x"), ("a", "12", "y"), ("b", "11", "x"), ("c", "99", "x"), ("d", "10", "x")], "concept string, resource string, kind string")
    reached = spark.createDataFrame([(1, "a", 0.5, 1), (1, "b", 0.1, 2), (1, "c", 0.8, 0), (1, "nowhere", 2.0, 0), (2, "c", 1.0, 0)], "query int, node string, score double, hop int")
    rows = lambda df: sorted((x["item_id"], x["rank"], x["doc_id"], round(x["score"], 9)) for x in df.collect())
    whole = rows(gr.graph_ranked(top, gr.resource_scores(reached, links)))
    assert rows(gr.graph_reranked(top, reached, links)) == whole and whole[0][2] == 12
    gold = spark.createDataFrame([(1, "12"), (1, "11"), (1, "12"), (2, "12")], "item_id int, resource string")
    assert [tuple(x) for x in gr.hop_distribution(reached, links, gold).collect()] == [(1, 1)]


def test_a_sentence_keeps_the_digit_that_is_its_place(spark):
    """transform() gave trim() each sentence's place as the characters to take away."""
    df = spark.createDataFrame([("One two three four. 1 is the first of all. 22 is the third of all 2.",)], "text string")
    assert df.select(evd.plain_sentences(F.col("text")).alias("s")).first()["s"] == ["One two three four.", "1 is the first of all.", "22 is the third of all 2."]
    pages = spark.createDataFrame([(1, p, "a\n1x\nb") for p in (1, 2)] + [(1, 3, "x")], "g int, p int, text string")
    assert sorted(x["line"] for x in mn.repeated_lines(pages, "g", "p").collect()) == ["1x", "a", "b"]


def test_many_distinct_values_are_counted():
    rows = ds.profile_of("/a.csv", ("k,c\n" + "\n".join(f"{i},x" for i in range(30_000))).encode())
    assert [r["distinct"] for r in rows] == [30_000, 1]


def test_held_items_give_the_ranking_of_the_join(spark, monkeypatch):
    """One pass with the items held gives what the join gives, with ties, copies and documents without a term; beyond the bounds and for shared ids the join is taken."""
    texts = [" ".join(f"w{(k * j) % 11}x" for j in range(1, 2 + k % 9)) for k in range(60)] + ["w1x w2x"] * 12 + ["", None, "zz"]
    docs = spark.createDataFrame([(k, t, "en" if k % 3 else "de") for k, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    items = spark.createDataFrame([(1, "w1x w2x w3x"), (2, "w5x nowhere"), (3, ""), (4, "w2x W2X w0x")], "item_id int, text string")
    some = docs.where("lang = 'en'").select("doc_id")
    monkeypatch.setattr(r, "HELD_PARTS", 40)
    rows = lambda df: sorted((x["item_id"], x["rank"], x["doc_id"], round(x["score"], 9)) for x in df.collect())
    every = lambda: [rows(f(items, docs, 5)) for f in (r.bm25, r.set_cosine)] + [rows(r.bm25(items, docs, 5, allowed=some)), rows(r.hybrid(items, docs, 5, 7))]
    assert r.held_terms(items, r.counted(docs, queries=items)) is not None
    assert r.held_terms(items, r.counted(docs.union(docs.limit(1)), queries=items)) is None
    held = every()
    monkeypatch.setattr(r, "HELD_ITEMS", 1)
    assert held == every() and len(held[0]) == 15


def test_a_block_of_queries_is_compared_in_slices(spark, monkeypatch):
    """Blocks give what a scan gives; a corpus is copied once for 8,000 queries, where it was for 1,000."""
    v = spark.createDataFrame([(k, [float((k * j) % 7 + 1) for j in range(1, 9)]) for k in range(300)], "vec_id bigint, embedding array<float>")
    rows = lambda: sorted(map(tuple, r.nearest(v.where("vec_id % 3 = 0"), v, 2).collect()))
    whole = rows()
    monkeypatch.setattr(r, "QUERY_BYTES", 0)
    assert rows() == whole and len(whole) == 200 and r.QUERY_BLOCK == 8_000


def test_tokens_of_a_least_length(spark):
    df = spark.createDataFrame([("A bc \U0001d4b3 \U0001d4b3\U0001d4b3 d_e é ßß 1 22 x-yz",)], "text string")
    assert df.select(tokens(F.col("text")).alias("w")).first()["w"] == ["bc", "\U0001d4b3\U0001d4b3", "d_e", "ßß", "22", "yz"]
    assert df.select(tokens(F.col("text"), 1).alias("w")).first()["w"][:2] == ["a", "bc"]


def test_texts_are_read_in_slices(monkeypatch):
    monkeypatch.setattr(bl, "SLICE_BYTES", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(["aaaa", None, "aaaaa", "a" * 30, "a", "é" * 4, "aa"])], ["k", "t"])
    parts = list(bl.text_slices(iter([batch, batch.slice(0, 0)])))
    assert [p.num_rows for p in parts] == [3, 1, 2, 1] and pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
