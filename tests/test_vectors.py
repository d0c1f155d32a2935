"""Collections in cells, and projections."""

import numpy as np
import pytest

from tessera.operators import projection as pj
from tessera.operators import vector_cells as vc
from tessera.operators.retrieval import nearest

VECTOR = "vec_id bigint, embedding array<float>, label int"


def table(spark, x, first=0):
    return spark.createDataFrame([(first + k, [float(v) for v in row], k % 3) for k, row in enumerate(x)], VECTOR)


def exact(x, queries, metric, k):
    """Ids of the k nearest rows, by a plain scan."""
    x = np.float32(x).astype(float)
    if metric == "cosine":
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    out = set()
    for q in queries:
        scores = x @ x[q] if metric != "euclid" else -np.sqrt(((x - x[q]) ** 2).sum(1))
        scores[q] = -np.inf
        out |= {(q, int(i)) for i in np.lexsort((np.arange(len(x)), -np.round(scores, 9)))[:k]}
    return out


@pytest.mark.parametrize("metric", vc.METRICS)
def test_all_cells_give_all_neighbours(spark, tmp_path, metric, monkeypatch):
    monkeypatch.setattr(vc, "PART", 20)  # a cell in several parts
    draw = np.random.default_rng(1)
    x = np.concatenate([draw.normal(size=(150, 8)), draw.normal(size=(150, 8)) * 0.1 + 2, np.zeros((2, 8))])
    vc.create(table(spark, x), str(tmp_path), metric, cells=9)
    asked = table(spark, x).where("vec_id % 40 = 0")
    found = vc.search(spark, str(tmp_path), asked, k=5, probes=9)
    assert {(r.query_id, r.vec_id) for r in found.collect()} == exact(x, range(0, 302, 40), metric, 5)
    some = vc.search(spark, str(tmp_path), asked, k=5)
    share = vc.recall(some, found).first()
    assert share["queries"] == 8 and share["recall"] >= 0.9


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_recall_at_three_sizes(spark, tmp_path, sf):
    x = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
    vc.create(x, str(tmp_path))
    asked = x.where("vec_id % 20 = 0")
    assert vc.recall(vc.search(spark, str(tmp_path), asked), nearest(asked, x)).first()["recall"] >= 0.95


def test_near_cells_are_enough_where_vectors_cluster(spark, tmp_path):
    draw = np.random.default_rng(2)
    centers = draw.normal(size=(30, 16)) * 10
    x = table(spark, np.concatenate([c + draw.normal(size=(40, 16)) for c in centers]))
    vc.create(x, str(tmp_path), "euclid", cells=30)
    asked = x.where("vec_id % 50 = 0")
    assert spark.read.parquet(f"{tmp_path}/cells").first()["probes"] <= 3
    assert vc.recall(vc.search(spark, str(tmp_path), asked), vc.search(spark, str(tmp_path), asked, probes=30)).first()["recall"] >= 0.95


def test_added_odd_and_no_vectors(spark, tmp_path):
    odd = spark.createDataFrame([(900, None, 1), (901, [1.0, 2.0], 1), (902, [float("nan")] * 4, 1), (903, [], 1)], VECTOR)
    x = np.random.default_rng(3).normal(size=(40, 4))
    vc.create(table(spark, x).union(odd), f"{tmp_path}/a", cells=4)
    vc.add(spark, table(spark, x[:3] * 1.001, 500).union(odd), f"{tmp_path}/a")
    found = vc.search(spark, f"{tmp_path}/a", table(spark, x).where("vec_id < 3").union(odd), k=1, probes=4).collect()
    assert {(r.query_id, r.vec_id) for r in found} == {(0, 500), (1, 501), (2, 502)}
    assert spark.read.parquet(f"{tmp_path}/a/vectors").count() == 43
    vc.create(odd.limit(0), f"{tmp_path}/b")
    assert vc.search(spark, f"{tmp_path}/b", table(spark, x)).collect() == []
    with pytest.raises(ValueError, match="create it anew"):
        vc.add(spark, table(spark, x), f"{tmp_path}/b")
    with pytest.raises(ValueError, match="no metric"):
        vc.create(odd, f"{tmp_path}/c", "hamming")


def test_scalability(spark, tmp_path):
    x = table(spark, np.random.default_rng(4).normal(size=(120, 4)))
    rows = vc.scalability(x, x.where("vec_id < 5"), str(tmp_path), [50, 120]).collect()
    assert [r.n for r in rows] == [50, 120] and all(r.inserted_a_second > 0 and r.milliseconds_a_query > 0 and r.recall >= 0.9 for r in rows)


def test_components_against_numpy(spark):
    x = np.float32(np.random.default_rng(5).normal(size=(300, 6)) @ np.diag([5, 3, 1, 1, 0.5, 0.1])).astype(float)
    df = table(spark, x).union(spark.createDataFrame([(900, None, 1), (901, [1.0], 1)], VECTOR)).repartition(5)
    square = np.cov(x.T)
    assert all(abs(r.covariance - square[r.i, r.j]) < 1e-9 for r in pj.covariance(df).collect()) and pj.covariance(df).count() == 21
    rows, mean, directions = pj.principal_components(df, 3)
    values = np.linalg.eigvalsh(square)[::-1]
    assert np.allclose([r.variance for r in rows.orderBy("component").collect()], values[:3]) and np.allclose(mean, x.mean(0)) and np.allclose(directions @ directions.T, np.eye(3))
    places = np.array([r.projection for r in pj.projected(df, mean, directions).where("vec_id < 300").orderBy("vec_id").collect()])
    assert np.allclose(places, (x - x.mean(0)) @ directions.T) and pj.projected(df, mean, directions).where("vec_id >= 900 AND projection IS NOT NULL").count() == 0
    assert pj.principal_components(df.limit(0))[0].collect() == [] and pj.covariance(df.where("vec_id = 3")).where("covariance IS NOT NULL").count() == 0


def test_heatmap_is_the_mean_of_all_pairs(spark):
    x = np.random.default_rng(6).normal(size=(30, 5))
    x[7] = 0
    rows = table(spark, x).union(spark.createDataFrame([(900, [1.0] * 5, None), (901, None, 1), (902, [1.0] * 5, 9)], VECTOR))
    unit = np.float32(x).astype(float)
    unit = unit / np.where((n := np.linalg.norm(unit, axis=1, keepdims=True)) == 0, 1, n)
    for r in pj.cosine_heatmap(rows).where("a < 9 AND b < 9").collect():
        own = [unit[a] @ unit[b] for a in range(r.a, 30, 3) for b in range(r.b, 30, 3) if a != b]
        assert r.pairs == len(own) and abs(r.cosine - np.mean(own)) < 1e-9
    assert pj.cosine_heatmap(rows).where("a = 9 AND b = 9").first()["cosine"] is None and pj.cosine_heatmap(rows.limit(0)).collect() == []
