"""Concept graphs, personal rankings, policies, planning, ingestion, kept indexes and seams on small cases."""

import pytest
from pyspark.sql import functions as F

from tessera import seams
from tessera.operators import concepts as cp
from tessera.operators import graph_retrieval as gr
from tessera.operators import ingest as ig
from tessera.operators import learner as ln
from tessera.operators import planning as pl
from tessera.operators import policy as po
from tessera.operators import retrieval as r
from tessera.sources import index as ix


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame([("concept:cnn", "Convolutional Neural Network", "ml", ["cnn"]), ("concept:nn", "Neural Network", "ml", ["nn"]), ("concept:sql", "SQL", "db", ["sql"])], "concept_id string, canonical string, domain string, aliases array<string>")


@pytest.fixture(scope="module")
def resources(spark):
    rows = [("a", "Neural nets", "ml", "w01", ["cnn"], "A convolutional neural network is a neural network. CNNs"), ("b", "Databases", "db", "w02", [], "sql and nn"), ("c", "More", "ml", "w03", [], "nn, sql"), ("d", "Cnné", "ml", "x", [], "cnné nn_ none")]
    return spark.createDataFrame(rows, "resource_id string, title string, course string, module string, topics array<string>, text string")


def test_mentions_prefer_the_longest_alias(lexicon, resources):
    found = {(x["resource_id"], x["concept_id"]): x["hits"] for x in cp.mentions(resources, lexicon, "resource_id").collect()}
    assert found == {("a", "concept:cnn"): 1, ("a", "concept:nn"): 1, ("b", "concept:sql"): 1, ("b", "concept:nn"): 1, ("c", "concept:nn"): 1, ("c", "concept:sql"): 1}


def test_graph_and_linking(spark, lexicon, resources):
    nodes, edges = cp.concept_graph(resources, lexicon, spark.createDataFrame([("a", "b", "extends"), ("a", "c", "likes"), ("b", "c", "part_of")], "source string, target string, relation string"))
    kinds = {(x["src"], x["dst"], x["kind"]) for x in edges.collect()}
    assert ("concept:nn", "resource:a", "appears_in") in kinds and ("resource:a", "concept:nn", "explains") in kinds and ("concept:cnn", "resource:a", "appears_in") in kinds and ("concept:sql", "resource:b", "mentioned_in") in kinds
    assert ("concept:nn", "concept:sql", "related_to") in kinds and ("module:ml/w01", "module:ml/w03", "prerequisite") in kinds and ("resource:b", "resource:c", "contains") in kinds and not any(k == "likes" for _, _, k in kinds)
    assert nodes.where("kind = 'concept'").count() == 3
    provenance = gr.provenance_of(edges)
    queries = spark.createDataFrame([(0, "what is a convolutional neural network"), (1, "tables")], "item_id int, text string")
    ranking = spark.createDataFrame([(0, "b", 1), (1, "b", 1), (1, "c", 2)], "item_id int, resource string, rank int")
    seeds = {(x["query"], x["node"]): x["score"] for x in gr.linked_concepts(queries, lexicon, ranking, provenance).collect()}
    assert seeds == {(0, "concept:cnn"): 1.0, (0, "concept:sql"): 0.6, (0, "concept:nn"): 0.6, (1, "concept:sql"): 0.6, (1, "concept:nn"): 0.6}
    more, links = cp.linked(nodes, edges, resources.where("resource_id = 'b'").withColumn("resource_id", F.lit("e")), lexicon)
    assert more.count() == nodes.count() + 1 and links.where("dst = 'resource:e'").count() == 3


def test_folded_phrases(spark, lexicon):
    p = spark.createDataFrame([("deep neural network",), ("neural",), ("join order",)], "phrase string")
    got = dict(tuple(x) for x in cp.folded_phrases(p, lexicon.withColumn("aliases", F.array().cast("array<string>"))).collect())
    assert got == {"deep neural network": "concept:nn", "neural": "concept:cnn"}


def test_personal_rankings(spark):
    top = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.6), (0, 3, 0.5)], "item_id int, doc_id bigint, score double")
    docs = spark.createDataFrame([(1, "de", "page"), (2, "en", "notebook"), (3, "de", "page")], "doc_id bigint, language string, doc_type string")
    who = spark.createDataFrame([(7, 0, "en", "example-driven"), (8, 0, "fr", "")], "student bigint, item_id int, preferred_language string, explanation_style string")
    out = [(x["student"], x["doc_id"], round(x["score"], 3), x["source"]) for x in gr.personalized(top, docs, who, spark.createDataFrame([(7, "3")], "student bigint, resource string")).orderBy("student", "rank").collect()]
    assert out == [(7, 3, 1.0, "personalized"), (7, 1, 0.9, "hybrid"), (7, 2, 0.8, "hybrid"), (8, 1, 0.9, "hybrid"), (8, 2, 0.6, "hybrid"), (8, 3, 0.5, "hybrid")]


def test_policies(spark):
    import numpy as np

    draw = np.random.default_rng(3)
    rows = [(1, "difficulty", int(draw.integers(5)), draw.random(4).tolist(), float(draw.random())) for _ in range(40)]
    states = po.learned_states(po.first_states(spark.createDataFrame([(1,)], "student bigint")), spark.createDataFrame(rows, "student bigint, decision string, arm int, x array<double>, reward double"))
    bandit = ln.LinearBandit(5, 4, 0.6)
    for _, _, arm, x, reward in rows:
        bandit.update(arm, np.asarray(x), reward)
    mean, bonus = bandit.values(np.asarray([0.3, 0.5, 0.2, 1.0]))
    got = po.valued(states, spark.createDataFrame([(1, "c", [0.3, 0.5, 0.2, 1.0])], "student bigint, concept string, x array<double>"), alpha=0.6).where("decision = 'difficulty'").orderBy("arm").collect()
    assert [x["mean"] for x in got] == pytest.approx(mean, abs=1e-6) and [x["bonus"] for x in got] == pytest.approx(bonus, abs=1e-6) and [x["chosen"] for x in got].index(True) == int(np.argmax(mean + bonus))
    scores = {x["policy"]: x["regret"] for x in po.policy_evaluation(spark.createDataFrame([(k / 20,) for k in range(2, 18)], "ability double")).collect()}
    assert scores["oracle"] == 0 and min(v for k, v in scores.items() if k != "oracle") > 0.1
    trained, curve = po.trained(400)
    assert len(curve) >= 60 and curve[-1] > curve[0]
    last = {x["policy"]: x["ability"] for x in po.trajectories(spark, 60, bandit=trained).where("round = 60").collect()}
    assert last["oracle"] >= max(v for k, v in last.items() if k != "oracle") - 1e-9
    faded = po.forgotten(spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.002)], "student int, concept string, ability double"), spark.createDataFrame([(1, "a")], "student int, concept string"))
    assert {x["concept"]: x["ability"] for x in faded.collect()} == {"a": 0.5, "b": 0.0}


def test_quizzes_and_sessions(spark):
    text = "Short one. A join combines the rows of two tables by keys. Another sentence about something else here."
    asked = spark.createDataFrame([(1, "join", text, "hard"), (2, "join", "tiny", "easy")], "student bigint, concept string, text string, difficulty string")
    quiz = pl.quizzes(asked).orderBy("student").collect()
    assert quiz[0]["question"] == "Explain in detail and give an example of the concept of 'join'." and quiz[0]["answer_key"] == "A join combines the rows of two tables by keys." and quiz[0]["key_terms"] == ["join", "combines", "tables", "keys", "rows", "two"]
    assert quiz[1]["answer_key"] == "tiny" and quiz[1]["key_terms"] == ["join", "tiny"]
    answers = spark.createDataFrame([(1, "join", "it combines rows and tables"), (2, "join", "no idea")], "student bigint, concept string, answer string")
    done = {x["student"]: x for x in pl.study_session(asked, answers, spark.createDataFrame([(1, "join", 0.5)], "student bigint, concept string, mastery double")).collect()}
    assert done[1]["score"] == 0.5 and done[1]["correct"] and done[1]["mastery_after"] == 0.625 and not done[2]["correct"] and done[2]["mastery_before"] == 0.3


def test_stages_fail_by_row(spark):
    rows = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, "worse")], "k int, v string")
    stages = [("soft", lambda x: F.when(x != "bad", F.upper(x)), False), ("hard", lambda x: F.when(x != "WORSE", F.concat(x, F.lit("!"))), True), ("last", lambda x: F.concat(x, F.lit("?")), False)]
    assert {tuple(x) for x in ig.staged(rows, stages, "v").select("k", "v", "status", F.array_join("failed", ",")).collect()} == {(1, "OK!?", "SUCCESS", ""), (2, "bad!?", "PARTIAL", "soft"), (3, "WORSE", "FAILED", "hard")}


def test_media_and_frames(spark):
    files = spark.createDataFrame([("/m/a.srt",), ("/m/a.vtt",), ("/m/b.json",)], "path string")
    assert {tuple(x) for x in ig.caption_files(spark.createDataFrame([("/m/a.mp4",), ("/m/b.mp4",), ("/m/c.mp4",)], "path string"), files).collect()} == {("/m/a.mp4", "/m/a.vtt"), ("/m/b.mp4", "/m/b.json"), ("/m/c.mp4", None)}
    frames = spark.createDataFrame([(1, 0, "x" * 40 + "a"), (1, 1, "x" * 40 + "b"), (1, 2, "y")], "k int, t int, text string")
    assert [x["t"] for x in ig.slide_changes(frames, "k").orderBy("t").collect()] == [0, 2]
    assert spark.createDataFrame([("my_flow1",), ("bar plot",), ("x",)], "s string").select(ig.image_kind(F.col("s"))).collect() == [("diagram",), ("chart",), ("figure",)]


def test_kept_postings(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "the dog sat down"), (3, None), (4, "quantum cat")], "doc_id bigint, text string")
    asked = spark.createDataFrame([(0, "cat down"), (1, "zz")], "item_id bigint, text string")
    path = tmp_path.as_uri() + "/i"
    ix.save_postings(docs.where("doc_id < 4"), path)
    ix.add_documents(docs.where("doc_id = 4"), path)
    rows = lambda df: [(x["item_id"], x["doc_id"], round(x["score"], 9)) for x in df.orderBy("item_id", "rank").collect()]
    assert rows(ix.bm25(spark, path, asked)) == rows(r.bm25(asked, docs)) and ix.statistics(spark, path).first()["vocabulary"] == 6
    ix.without_documents(spark, path, docs.where("doc_id = 2"), tmp_path.as_uri() + "/j")
    assert rows(ix.bm25(spark, tmp_path.as_uri() + "/j", asked)) == rows(r.bm25(asked, docs.where("doc_id != 2")))


def test_seams(spark):
    with pytest.raises(LookupError, match="a model file"):
        seams.part("reranker", "cross-encoder")
    with pytest.raises(ValueError):
        seams.register("nothing", "x", len)
    assert seams.fail_soft("web_search", "search-api", seams.part("web_search", "disabled")) is seams.part("web_search", "disabled") and {k for k, _ in seams.ABSENT} <= set(seams.CONTRACTS)
    seams.register("reranker", "by-length", lambda ranking: ranking)
    assert seams.names("reranker") == ["by-length", "identity"]
