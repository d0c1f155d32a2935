import pytest
from pyspark.sql import functions as F

from tessera.functions.library import Function, Library, calculate, engine_library, safe_calculation
from tessera.operators import research as rs
from tessera.sources import files as fl
from tessera.sources import tables as tb


@pytest.mark.parametrize("text,value", [("1 + 2 * 3", 7), ("-(2 ** 3) / 4", -2), ("sqrt(16) + max(1, 2)", 6), ("pi", 3.14159)])
def test_calculator(text, value):
    assert calculate(text) == pytest.approx(value, abs=1e-4)


@pytest.mark.parametrize("text", ["__import__('os')", "1 / 0", "a + 1", "9 ** 9 ** 9", "'x' * 3", "(", "1" * 300, "[1][0]", "True"])
def test_calculator_refuses(text):
    with pytest.raises(ValueError):
        calculate(text)


def test_calculations_as_a_column(spark):
    df = spark.createDataFrame([("1+1",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(safe_calculation(F.col("t"))).collect()] == [2.0, None, None]


def test_library(spark):
    lib = Library([Function("add", lambda a, b=1: a + b, {"a": int, "b": int}, frozenset({"b"}))])
    assert lib.call("add", {"a": "2"}) == {"ok": True, "value": 3} and not lib.call("none", {})["ok"]
    assert lib.call("add", {})["error"] == "missing: a" and lib.call("add", {"a": 1, "z": 2})["error"] == "unknown: z" and "ValueError" in lib.call("add", {"a": "x"})["error"]
    assert lib.schemas()[0]["parameters"]["required"] == ["a"]
    assert len(engine_library(spark, "/root/testdata/sf0.001").call("sources", {"limit": 2})["value"]) == 2


def test_files(spark, tmp_path):
    (tmp_path / "void.md").write_text("")
    for name in ("math/algebra/w1/A b.md", "math/algebra/w1/a-b.txt", "top.md", "math/x.meta.json", "math/y.exe"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    found = fl.classified(fl.listing(spark, tmp_path.as_uri()), str(tmp_path))
    assert sorted(r["resource_id"] for r in found.collect()) == ["math.algebra.w1.a-b", "math.algebra.w1.a-b-2", "technical.misc.m00.top", "technical.misc.m00.void"]
    issues = {r["path"].split("/")[-1]: r["issues"] for r in fl.file_issues(fl.listing(spark, tmp_path.as_uri())).collect()}
    assert issues == {"y.exe": ["error: ending"], "void.md": ["warning: empty"]}
    empty = spark.createDataFrame([("/a/b.md", 0)], "path string, length bigint")
    assert fl.file_issues(empty).first()["issues"] == ["warning: empty"]
    names = spark.createDataFrame([("../a/.b c?.md",)], "n string").select(fl.safe_name(F.col("n")), fl.is_resource_id(F.lit("a.b.c.d-1"))).first()
    assert tuple(names) == ("b_c_.md", True)


def test_tables(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert {tuple(r) for r in tb.upserted(old, spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string"), ["k"]).collect()} == {(1, "a"), (2, "B"), (3, "c")}
    assert [r["k"] for r in tb.deleted(old, old.where("k = 1"), ["k"]).collect()] == [2]
    path = tmp_path.as_uri() + "/t"
    tb.append(old, path, "k")
    tb.append(old.where("k = 1"), path, "k")
    tb.replace(spark.createDataFrame([(2, "z")], "k int, v string"), path, "k")
    assert sorted((r["k"], r["v"]) for r in tb.read(spark, path).collect()) == [(1, "a"), (1, "a"), (2, "z")] and tb.read(spark, path, k=2).count() == 1
    v = spark.createDataFrame([([1.0, 2.0],), ([1.0],), ([float("nan"), 1.0],), ([float("inf"), 1.0],), ([None, 1.0],)], "v array<double>")
    assert tb.valid_vectors(v, "v", 2).count() == 1
    rows, new = tb.cached(old.union(old), spark.createDataFrame([], "digest string, version string, value int"), "v", "1", F.length("v"))
    assert rows.where("value = 1").count() == 4 and new.count() == 2
    s = tb.superseded(old.selectExpr("*", "'on' AS status", "CAST(NULL AS INT) AS superseded_by"), "k", 1, 2).where("k = 1").first()
    assert (s["status"], s["superseded_by"]) == ("superseded", 2) and tb.as_json(old, "k").first()["bytes"] == 15


def test_trust_and_selection(spark):
    rows = [(1, "https://arxiv.org/abs/1", "A tutorial", "introduction and guide, 2024-05"), (2, "https://spam.biz/x", "buy now", "click here, casino"), (3, "https://www.arxiv.org/abs/1/", "t", ""), (4, "https://x.ac.uk/?q", "t", "of 2013-01"), (5, "https://docs.github.com/a", "t", "2024-99")]
    got = {r["page_id"]: r for r in rs.scored_sources(spark.createDataFrame(rows, "page_id bigint, url string, title string, snippet string"), "2024-06-01", deny=("spam.biz",)).collect()}
    fresh = 1 - 31 / 1825
    assert got[1]["trust"] == pytest.approx(0.4 + 0.15 * fresh + 0.2 * 0.85 + 0.15 * 0.8, abs=1e-3) and not got[1]["duplicate"]
    assert got[2]["trust"] == 0 and got[2]["spam"] == 1.0 and got[4]["authority"] == 0.85 and got[4]["fresh"] == 0.0 and got[5]["authority"] == 0.7 and got[5]["fresh"] == 0.5
    again = rs.scored_sources(spark.createDataFrame([rows[0], (9, "HTTPS://arxiv.org/abs/1", "t", "")], "page_id bigint, url string, title string, snippet string"), "2024-06-01")
    assert {r["page_id"]: r["duplicate"] for r in again.collect()} == {1: False, 9: True}
    found = rs.term_search(spark.createDataFrame([(0, "Cat the on of"), (1, "zz")], "item_id int, text string"), spark.createDataFrame([(1, "cats concat CAT", ), (2, "then other"), (3, None)], "page_id int, text string"))
    assert {(r["page_id"], r["hits"]) for r in found.collect()} == {(1, 3), (2, 2)}
    s = spark.createDataFrame([(0, 1, 0.9, False), (0, 2, 0.95, True), (0, 3, 0.3, False)], "item_id int, page_id int, trust double, duplicate boolean")
    assert [r["page_id"] for r in rs.selected(s).collect()] == [1]
    q = spark.createDataFrame([(0, "gradient descent")], "item_id int, text string")
    rows = spark.createDataFrame([(0, 1, "short\n\n" + "filler " * 20 + "\n\n" + "gradient descent works by steps " * 4)], "item_id int, page_id int, text string")
    assert rs.passages(rows, q, 1).first()["terms"] == 2


def test_confidence_and_merging(spark):
    e = spark.createDataFrame([(0, 1, 0.9, 22.0, "a"), (0, 2, 0.5, 3.0, "c"), (0, 9, 1.0, 99.0, "b")], "item_id int, rank int, semantic double, lexical double, source string")
    c = rs.confidence(e).first()
    assert c["confidence"] == pytest.approx(0.55 * 0.9 + 0.3 * 0.5 + 0.15) and c["level"] == "high" and c["answered"]
    rows = lambda x: spark.createDataFrame(x, "item_id int, ref string, confidence double")
    assert [r["ref"] for r in rs.merged_evidence(rows([(0, "a", 0.5)]), rows([(0, "w", 0.9)])).orderBy("rank").collect()] == ["w", "a"]
    assert spark.createDataFrame([("cats cat",)], "t string").select(rs.occurrences(F.col("t"), F.lit("cat"))).first()[0] == 2.0
