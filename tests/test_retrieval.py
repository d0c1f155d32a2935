import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluation as ev
from tessera.operators import evidence as evd
from tessera.operators import retrieval as r


@pytest.fixture(scope="module")
def toy(spark):
    return spark.createDataFrame([(1, "the cat sat on the mat", "x"), (2, "the dog sat on the log", "y"), (3, "quantum physics and relativity", "x"), (4, None, "x")], "doc_id bigint, text string, source string")


def ask(spark, text):
    return spark.createDataFrame([(0, text)], "item_id bigint, text string")


def ids(df):
    return [x[0] for x in df.orderBy("rank").select("doc_id").collect()]


def test_bm25(spark, toy):
    assert ids(r.bm25(ask(spark, "cat mat"), toy))[0] == 1
    assert ids(r.bm25(ask(spark, "sat"), toy, allowed=toy.where("source = 'y'"))) == [2]
    assert ids(r.bm25(ask(spark, "nothing like it"), toy)) == []
    assert ids(r.bm25(ask(spark, "cat"), toy.where("doc_id != 1"))) == []


def test_scores_ignore_filters_and_repeated_query_terms(spark, toy):
    whole = {x["doc_id"]: x["score"] for x in r.bm25(ask(spark, "sat sat dog"), toy).collect()}
    some = {x["doc_id"]: x["score"] for x in r.bm25(ask(spark, "sat dog"), toy, allowed=toy.where("doc_id = 2")).collect()}
    assert some[2] == whole[2]


def test_fusion(spark):
    arm = lambda xs: spark.createDataFrame([(0, x, k + 1) for k, x in enumerate(xs)], "item_id bigint, doc_id bigint, rank int")
    out = {x["doc_id"]: x["score"] for x in r.fused([(arm([1, 2, 3]), 1.0), (arm([2, 1, 4]), 1.0)]).collect()}
    assert out[1] == pytest.approx(out[2]) and out[1] > out[3] and out[1] == pytest.approx(1 / 61 + 1 / 62)


def metrics(spark, ranked, relevant, k=10):
    ranking = spark.createDataFrame([(0, x, n + 1) for n, x in enumerate(ranked)], "item_id bigint, doc_id bigint, rank int")
    gold = spark.createDataFrame([(0, x) for x in relevant], "item_id bigint, doc_id bigint")
    return ev.retrieval_metrics(ranking, gold, spark.createDataFrame([(0,), (9,)], "item_id bigint"), k).where("item_id = 0").first()


def test_metrics(spark):
    m = metrics(spark, [1, 2, 3, 4], [3], 3)
    assert (m["hit"], m["recall"]) == (1.0, 1.0) and m["reciprocal_rank"] == pytest.approx(1 / 3, abs=1e-6) and m["precision"] == pytest.approx(1 / 3, abs=1e-6)
    assert metrics(spark, [1, 2, 3, 4], [3], 2)["hit"] == 0.0
    assert metrics(spark, [1, 9, 3], [1, 3])["average_precision"] == pytest.approx((1 + 2 / 3) / 2, abs=1e-6)
    assert metrics(spark, [9, 1], [1], 2)["ndcg"] == pytest.approx(0.63093, abs=1e-5)


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.9, 0.1], 0), (3, [0.0, 1.0], 1), (4, [0.1, 0.9], 1)], "vec_id bigint, embedding array<double>, label int")
    old = r.QUERY_BLOCK, r.CORPUS_BLOCK, r.QUERY_BYTES
    for r.QUERY_BLOCK, r.CORPUS_BLOCK, r.QUERY_BYTES in ((1000, 20_000, 1 << 20), (1000, 20_000, 0), (2, 1, 0)):
        near = r.nearest(v, v, k=1)
        assert {(x["query_id"], x["vec_id"]) for x in near.collect()} == {(1, 2), (2, 1), (3, 4), (4, 3)}
    r.QUERY_BLOCK, r.CORPUS_BLOCK, r.QUERY_BYTES = old
    tied = spark.createDataFrame([(k, [1.0, 1.0]) for k in range(9)], "vec_id bigint, embedding array<double>")
    assert [x["vec_id"] for x in r.nearest(tied.where("vec_id = 4"), tied, k=3).orderBy("rank").collect()] == [0, 1, 2]
    assert ev.purity(near, v).first()["purity"] == 1.0
    assert ev.coherence_gap(v).first()["gap"] > 0.7
    assert r.nearest(v.where("vec_id > 9"), v).collect() == []


def test_hashed_embedding(spark):
    e = spark.createDataFrame([("cats and dogs",), ("cat and dog",), ("",), (None,)], "t string").select(r.hash_embedding(F.col("t"))).collect()
    dot = lambda a, b: sum(x * y for x, y in zip(a[0], b[0]))
    assert dot(e[0], e[0]) == pytest.approx(1, abs=1e-5) and 0.2 < dot(e[0], e[1]) < 1 and not any(e[2][0]) and not any(e[3][0])


def test_containment(spark):
    docs = spark.createDataFrame([(1, "xx one two three four five six seven yy"), (2, "one two three four"), (3, "none")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "one two three four five six seven"), (2, "three four"), (3, "x one two three four five six"), (4, "our"), (5, "e four"), (6, " "), (7, "one two three"), (8, "")], "item_id bigint, text string")
    assert {tuple(x) for x in r.containing(items, docs).collect()} == {(1, 1), (2, 1), (2, 2), (3, 1), (4, 1), (4, 2), (5, 1), (5, 2), (6, 1), (6, 2), (7, 1), (7, 2), (8, 1), (8, 2), (8, 3)}


def test_auc(spark):
    s = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0), (0.5, None)], "s double, l int")
    assert ev.auc(s, "s", "l").first()["auc"] == pytest.approx((2 + 1.5) / 4)
    assert ev.auc(s.where("l = 1"), "s", "l").first()["auc"] is None


def test_context_stops_at_the_budget(spark):
    e = spark.createDataFrame([(0, 1, 0.9, "a " * 4, "p"), (0, 2, 0.8, "b " * 4, "p"), (0, 3, 0.7, "c " * 40, "q"), (0, 4, 0.6, "d", "r")], "item_id bigint, doc_id bigint, confidence double, text string, source string")
    assert [x["doc_id"] for x in evd.context(e, budget=6).collect()] == [1]
    assert [x["doc_id"] for x in evd.context(e, budget=600).orderBy("place").collect()] == [1, 3, 4]
    assert [x["doc_id"] for x in evd.context(e, budget=1).collect()] == [1]
    long = evd.context(spark.createDataFrame([(0, 1, 0.9, "w " * 400, "p")], "item_id bigint, doc_id bigint, confidence double, text string, source string")).first()
    assert long["tokens"] == 321 and long["text"].endswith("w …")


def test_grounding(spark):
    a = spark.createDataFrame([(1, "CNNs pool features [C1]. Pooling shrinks maps [C2].", ["C1", "C2"]), (2, "So it is [C9]. Nothing here.", ["C1"])], "k int, t string, v array<string>")
    out = {x["k"]: x for x in ev.grounding(a, "k", "t", "v").collect()}
    assert out[1]["ratio"] == 1.0 and out[1]["invalid"] == "" and out[2]["ratio"] == 0.0 and out[2]["invalid"] == "C9"


def test_answers_cite_their_items(spark):
    chosen = spark.createDataFrame([(0, 1, "Cats sleep. A pool shrinks maps. Dogs bark.")], "item_id bigint, place int, text string")
    out = evd.answers(evd.best_sentences(chosen, ask(spark, "what shrinks maps"))).first()
    assert out["answer"] == "[C1] A pool shrinks maps." and out["valid"] == ["C1"]
    concepts = spark.createDataFrame([(0, 1, "Pool", 0, "seed", ["Pool"], 0.5), (0, 2, "Map", 1, "related_to", ["Pool", "Map"], 0.5)], "item_id bigint, place int, concept string, hop int, relationship string, path array<string>, confidence double")
    both = evd.answers(evd.best_sentences(chosen, ask(spark, "what shrinks maps")), concepts=concepts, queries=ask(spark, "x").union(spark.createDataFrame([(9, "y")], "item_id bigint, text string")))
    said = {x["item_id"]: x for x in both.collect()}
    assert said[0]["answer"] == "Key concepts: Pool [K1], Map [K2]. [C1] A pool shrinks maps." and said[0]["valid"] == ["C1", "K1", "K2"] and said[9]["answer"] == evd.NO_ANSWER
    assert [tuple(x)[:4] for x in evd.relations(concepts).collect()] == [(0, "Pool", "related_to", "Map")]
    rows = chosen.withColumn("doc_id", F.lit(5))
    text = evd.prompts(rows, ask(spark, "what?"), concepts).first()["prompt"]
    assert "[K2] Map (1-hop via related_to, conf 0.50)" in text and "- Pool --related_to--> Map" in text and "[C1] #5" in text and text.endswith("# ANSWER")


def test_running_totals_over_many_ranges(spark):
    from tessera.storage import running_total

    df = spark.range(500).selectExpr("(id * 37) % 501 AS k", "id % 7 AS v").repartition(5)
    rows = sorted((r["k"], r["v"], r["s"]) for r in running_total(df, "k", "v", "s").collect())
    total = 0
    for _, v, s in rows:
        assert s == total
        total += v
