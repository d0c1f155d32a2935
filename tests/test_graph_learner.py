import pytest
from pyspark.sql import functions as F

from tessera.operators import catalog as cat
from tessera.operators import graph as g
from tessera.operators import learner as ln


def edges(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, kind string, weight double")


def test_expansion_prefers_strong_edges(spark):
    e = edges(spark, [("cnn", "nn", "related_to", 1.0), ("cnn", "sql", "prerequisite", 1.0), ("nn", "relu", "related_to", 1.0)])
    seeds = spark.createDataFrame([(0, "cnn", 1.0)], "query int, node string, score double")
    out = {x["node"]: x for x in g.expanded(seeds, e, decay=1.0).collect()}
    assert out["sql"]["score"] > out["nn"]["score"] and out["relu"]["path"] == ["cnn", "nn", "relu"] and out["relu"]["hop"] == 2
    assert out["relu"]["score"] == pytest.approx(0.36)


def test_later_hops_better_a_node(spark):
    e = edges(spark, [("a", "b", "contains", 1.0), ("a", "c", "prerequisite", 1.0), ("c", "b", "prerequisite", 1.0)])
    seeds = spark.createDataFrame([(0, "a", 1.0)], "query int, node string, score double")
    out = {x["node"]: x for x in g.expanded(seeds, e, decay=1.0).collect()}
    assert out["b"]["score"] == 1.0 and out["b"]["path"] == ["a", "c", "b"]


def test_components_and_statistics(spark):
    e = edges(spark, [(f"n{k:02}", f"n{k + 1:02}", "x", 1.0) for k in range(12)] + [("p", "q", "x", 1.0)])
    got = dict(tuple(x) for x in g.components(e).collect())
    assert set(got.values()) == {"n00", "p"} and got["n12"] == "n00"
    nodes = spark.createDataFrame([(x,) for x in got], "id string")
    s = g.statistics(nodes, e).first()
    assert (s["nodes"], s["edges"]) == (15, 13) and s["density"] == pytest.approx(13 / 210)


def test_cooccurrence_and_merging(spark):
    m = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (3, "c"), (2, "b")], "grp int, item string")
    assert [tuple(x) for x in g.cooccurrence(m, "grp", "item", sources=1).collect()] == [("a", "b", 2, [1])]
    assert [tuple(x) for x in g.cooccurrence(m, "grp", "item").collect()] == [("a", "b", 2)]
    e = spark.createDataFrame([("a", "b", "x", 1.0, "s2"), ("a", "b", "x", 2.0, "s1")], "src string, dst string, kind string, weight double, source string")
    assert tuple(g.merged_edges(e).first()) == ("a", "b", "x", 3.0, 2, "s1")
    near = g.neighbours(edges(spark, [("a", "b", "x", 1.0), ("c", "a", "y", 1.0)]), spark.createDataFrame([("a",)], "id string"))
    assert {x["neighbour"] for x in near.collect()} == {"b", "c"}


def log(spark, rows):
    return spark.createDataFrame([(k, k, 1, c, s, d) for k, (c, s, d) in enumerate(rows)], "event_id bigint, ts bigint, student bigint, concept string, score double, difficulty double")


def test_mastery_trajectory(spark):
    expected = [0.217, 0.158, 0.114, 0.358, 0.259, 0.463, 0.611, 0.718, 0.795]
    outcomes = [0.0, 0.0, 0.0, 1.0, 0.0, 1.0, 1.0, 1.0, 1.0]
    for n in (1, 4, 9):
        m = ln.mastery(log(spark, [("c", s, 0.6) for s in outcomes[:n]])).first()
        assert m["mastery"] == pytest.approx(expected[n - 1], abs=6e-4) and m["assessments"] == n


def test_exposure_and_levels(spark):
    m = {x["concept"]: x for x in ln.mastery(log(spark, [("hard", 0.0, 0.5)] * 3 + [("easy", 1.0, 0.9)] * 4 + [("seen", None, 0.5)])).withColumn("level", ln.level(F.col("mastery"))).collect()}
    assert m["hard"]["level"] == "weak" and m["easy"]["level"] == "strong" and m["seen"]["mastery"] == pytest.approx(0.335)


def test_windows_over_scores(spark):
    e = log(spark, [("c", float(k % 2), 0.5) for k in range(7)])
    run = [x["accuracy"] for x in ln.running_accuracy(e).orderBy("event_id").collect()]
    assert run[:3] == [0.0, 0.5, pytest.approx(1 / 3, abs=1e-6)]
    last = ln.recent_accuracy(e).orderBy("event_id").collect()
    assert last[0]["exposure"] == 0.2 and last[6]["exposure"] == 1.0 and last[6]["recent"] == 0.4


def test_plans_fit_their_days(spark):
    m = spark.createDataFrame([(1, f"c{k}", k / 100, 1, 1) for k in range(12)], "student bigint, concept string, mastery double, events bigint, assessments bigint")
    plan = ln.study_plan(m)
    assert plan.groupBy("student", "day").agg(F.sum("minutes").alias("m")).agg(F.max("m")).first()[0] <= 60
    assert plan.where("day = 1").orderBy("concept").first()["concept"] == "c0"
    ics = ln.calendar(plan, "2024-01-31").first()["ics"]
    assert ics.startswith("BEGIN:VCALENDAR") and "DTSTART;VALUE=DATE:20240201" in ics and ics.count("BEGIN:VEVENT") == ln.plan_statistics(plan).first()["days"]


def test_bandit_learns_the_paying_arm():
    import numpy as np

    b, draw = ln.LinearBandit(3, 2, alpha=0.6), np.random.default_rng(0)
    for _ in range(60):
        x = draw.random(2)
        arm = b.select(x)
        b.update(arm, x, 1.0 if arm == 2 else 0.0)
    assert b.select(np.asarray([0.5, 0.5]), explore=False) == 2


def test_recommendations(spark):
    m = spark.createDataFrame([(1, "a", 0.1, 1, 1), (1, "b", 0.2, 5, 5), (1, "c", 0.9, 4, 4)], "student bigint, concept string, mastery double, events bigint, assessments bigint")
    out = {(x["kind"], x["concept"]) for x in ln.recommendations(m, spark.createDataFrame([("c", "a"), ("c", "e"), ("c", "d")], "src string, dst string")).collect()}
    assert out == {("practice", "a"), ("review", "b"), ("explore", "d")}


def test_catalog(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, t string")
    new = spark.createDataFrame([(2, "b"), (3, "x"), (4, "d")], "k int, t string")
    assert dict(tuple(x) for x in cat.changes(old, new, "k", "t").collect()) == {1: "MISSING", 2: "UNCHANGED", 3: "MODIFIED", 4: "NEW"}
    stats = {(x["dimension"], x["value"]): x["n"] for x in cat.statistics(spark.createDataFrame([("a", ""), (None, "x")], "p string, q string"), ["p", "q"]).collect()}
    assert stats == {("p", "a"): 1, ("p", "unknown"): 1, ("q", "unknown"): 1, ("q", "x"): 1}
    with pytest.raises(ValueError):
        cat.filtered(old, {"k"}, z=1)
    v = cat.validated(old, {"even": ("warning", F.col("k") % 2 == 0), "small": ("error", F.col("k") < 3)})
    assert [x["status"] for x in v.orderBy("k").collect()] == ["WARNING", "VALID", "INVALID"]
    said = ["plan my week", "quiz me on sql", "give me a mcq", "create a study plan", "save this page to knowledge", "search the web for news", "find resources on joins", "what are my preferences", None]
    routes = [r[0] for r in spark.createDataFrame([(x,) for x in said], "t string").select(cat.routed(F.col("t"))).collect()]
    assert routes == ["planner", "quiz", "quiz", "planner", "curator", "web_research", "research", "tutor", "tutor"]


def test_rewards_and_transitions(spark):
    r = spark.range(1).select(ln.reward(F.lit(1.0), F.lit(0.1), F.lit(15.0), F.lit(0), F.lit(1)), ln.reward(F.lit(0.0), F.lit(-0.1), F.lit(90.0), F.lit(1), F.lit(0), F.lit(0.2))).first()
    assert r[0] == pytest.approx(0.4 + 0.1 - 0.075 - 0.3) and r[1] == pytest.approx(-0.1 - 0.15 - 0.3 - 0.2)
    log_ = spark.createDataFrame([(1, 1, "a", None), (1, 2, None, 5), (1, 3, "b", None), (2, 1, None, None)], "k int, at int, s string, n int")
    assert {tuple(x) for x in cat.transitions(log_, "k", ["s", "n"], ["at"]).collect()} == {(1, "b", 5, 3), (2, None, None, 1)}
