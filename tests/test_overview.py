"""Status, touched nodes, resources of recommendations, learning curves, embedders, coverage."""

import numpy as np
from pyspark.sql import functions as F

from tessera import plans
from tessera.operators import ingest as ig
from tessera.operators import neighbours as nb
from tessera.operators import overview as ov
from tessera.operators.retrieval import hash_embedding
from tessera.storage import stored


def test_status_of_a_knowledge_base(spark):
    rows = spark.createDataFrame([("db", "en", "slides", "indexed", 10, "2024-01-02"), ("db", None, "slides", "pending", 5, "2024-01-03"), ("ml", "", "notes", "failed", None, None)], "course string, language string, doc_type string, processing_status string, bytes int, updated_at string")
    one = ov.knowledge_status(rows).first()
    assert (one.total_resources, one.total_bytes, one.indexed, one.pending, one.last_updated) == (3, 15, 1, 1, "2024-01-03")
    assert one.by_course == {"db": 2, "ml": 1} and one.by_language == {"en": 1, "unknown": 2} and one.by_processing_status == {"indexed": 1, "pending": 1, "failed": 1}
    none = ov.knowledge_status(rows.limit(0)).first()
    assert (none.total_resources, none.total_bytes, none.indexed, none.by_course) == (0, 0, 0, {})


def test_published_learning_curve(spark):
    """The published trajectory of quizzes at difficulty .6; also when the history is cut into parts."""
    rows = [(1, "c", k, float(s), 0.6) for k, s in enumerate([0, 0, 0, 1, 0, 1, 1, 1, 1])] + [(2, "c", 0, None, 0.5)]
    df = spark.createDataFrame(rows, "student int, concept string, n_event int, score double, difficulty double").withColumnRenamed("n_event", "ts").withColumn("event_id", F.col("ts"))
    for part in (1000, 4, 1):
        curve = [r.mastery for r in ov.learning_curves(df, part=part).where("student = 1").orderBy("n").collect()]
        assert [round(x, 3) for x in curve] == [0.3, 0.217, 0.158, 0.114, 0.358, 0.259, 0.463, 0.611, 0.718, 0.795]
    assert [r.n for r in ov.learning_curves(df).where("student = 2").orderBy("n").collect()] == [0, 1] and ov.learning_curves(df.limit(0)).collect() == []


def test_resources_of_recommendations_and_touched_nodes(spark):
    advised = spark.createDataFrame([(1, "practice", "k1"), (2, "explore", "k9")], "student int, kind string, concept string")
    provenance = spark.createDataFrame([("k1", x) for x in ["r3", "r1", "r1", "r2", "r4"]], "concept string, resource string")
    titles = spark.createDataFrame([("r1", "One"), ("r2", None)], "resource string, title string")
    got = {r.student: [tuple(x) for x in r.resources] for r in ov.recommended_resources(advised, provenance, titles).collect()}
    assert got == {1: [("r1", "One"), ("r2", None), ("r3", None)], 2: []}
    reached = spark.createDataFrame([(1, "a", 0.5, 1), (2, "a", 1.0, 0), (2, "a", 0.2, 2), (2, "b", 0.1, 2)], "item_id int, node string, score double, hop int")
    assert {tuple(r) for r in ov.touched_nodes(reached).collect()} == {("a", 2, 0, 1.0), ("b", 1, 2, 0.1)}
    log = spark.createDataFrame([("r", 2), ("r", 1), ("q", 3)], "resource_id string, event_id int")
    assert [r.event_id for r in ov.resource_events(log, "r").collect()] == [1, 2]


def test_embedders_side_by_side(spark):
    texts = spark.createDataFrame([(k, "x" if k < 4 else "y", float(k)) for k in range(8)], "vec_id bigint, label string, v double")
    good = F.when(F.col("label") == "x", F.array(F.lit(1.0), F.col("v") / 100)).otherwise(F.array(F.col("v") / 100, F.lit(1.0)))
    rows = {r.embedder: r for r in ov.compared_embedders(texts, {"good": good, "flat": F.array(F.lit(1.0))}).collect()}
    assert rows["good"].purity == 1.0 and rows["good"].gap > 0.8 and rows["flat"].gap == 0.0 and (rows["good"].texts, rows["good"].dim) == (8, 2)


def test_embedders_ask_for_every_text(spark, monkeypatch):
    """Every text looks for its nearest among all others, not only those whose id is divisible by 20; in one block or many, with copies, vectors of zeros, shared and null ids."""
    rng = np.random.default_rng(4)
    v = (rng.normal(size=(300, 6)) + np.repeat(np.eye(6)[:3], 100, axis=0)).astype(np.float32)
    v[40:60], v[7], v[250], v[90:95] = v[240], v[3] * 2, v[3], 0
    ids = [None if k == 11 else k // 2 if k < 20 else k * 7 % 311 for k in range(300)]
    order, labels = np.array([i or 0 for i in ids]), ["xyz"[k % 3 if 40 <= k < 60 else k // 100] for k in range(300)]
    x = v.astype(np.float64)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    cosines = np.round(x @ x.T, 9)
    np.fill_diagonal(cosines, -2)
    near = [min(np.flatnonzero(c == c.max()), key=lambda j: order[j]) for c in cosines]
    texts = spark.createDataFrame([(i, w, list(map(float, r))) for i, w, r in zip(ids, labels, v, strict=True)], "vec_id bigint, label string, v array<float>").coalesce(1)
    for held, tile in ((64 << 20, 512), (2_000, 7)):
        monkeypatch.setattr(nb, "HELD_BYTES", held)
        monkeypatch.setattr(nb, "TILE", tile)
        rows = stored(texts.select(F.monotonically_increasing_id().alias("row"), F.coalesce("vec_id", F.lit(0)).alias("key"), F.col("v").alias("embedding")))
        got = {r["row"]: r for r in nb.nearest_others(rows).collect()}
        assert [got[k]["score"] for k in range(300)] == [c.max() for c in cosines]
        assert [order[got[k]["at"]] for k in range(300)] == [order[j] for j in near]
    unlike = F.when(F.col("label") == "x", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
    few = spark.createDataFrame([(20, "x"), (40, "x"), (41, "y"), (42, "z"), (43, "y")], "vec_id bigint, label string")
    assert ov.compared_embedders(few, {"a": unlike}).first()["purity"] == 0.6 and ov.compared_embedders(few.where("vec_id = 20"), {"a": unlike}).first()["purity"] is None
    assert ov.compared_embedders(few.where("false"), {"a": unlike}).first()["texts"] == 0
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").select("lang", hash_embedding(F.col("text"), 64).alias("v")).toPandas()
    x = np.stack(docs["v"]).astype(np.float64)
    cosines = np.round(x @ x.T, 9)
    np.fill_diagonal(cosines, -2)
    same = np.mean(docs["lang"].to_numpy() == docs["lang"].to_numpy()[cosines.argmax(axis=1)])
    assert {r["embedder"]: r["purity"] for r in plans.QUERIES["embedder_comparison"](spark, "/root/testdata/sf0.001").collect()}["hashing-64"] == round(same, 6)


def test_flags_of_resources(spark):
    blocks = spark.createDataFrame([("a", 0, "heading", ["s"], ["l"], [], 1), ("b", 0, "table", [], [], ["i"], None)], "rid string, n int, kind string, section array<string>, links array<string>, images array<string>, page int")
    known = spark.createDataFrame([("a", "text", "en", 3, None), ("b", "", None, None, ["t"]), ("c", "ocr", "de", None, [])], "rid string, extraction_method string, language string, week int, topics array<string>")
    got = {r.rid: {k for k, v in r.asDict().items() if v is True} for r in ig.coverage(blocks, "rid", known).collect()}
    assert got == {"a": {"headings", "sections", "hyperlinks", "pages", "hierarchy", "anchors", "provenance", "language", "academic"}, "b": {"tables", "figures", "hierarchy", "anchors", "academic"}, "c": {"provenance", "language"}}
    assert len(ig.coverage(blocks, "rid", known).columns) == 19
