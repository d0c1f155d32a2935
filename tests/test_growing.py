"""Folders taken in, indexes that grow by batches, and feeds of changes."""

import json

import pytest

from tessera.operators import retrieval as r
from tessera.sources import feed, tree, versions


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    (root / "a" / "b c").mkdir(parents=True)
    notebook = {"cells": [{"cell_type": "markdown", "source": ["# Title\n", "\n", "text"]}, {"cell_type": "code", "source": "x = 1"}]}
    files = {
        "a/one.md": b"# Head\n\nbody [l](http://x)\n", "a/two.txt": b"first\n\nsecond \xff\n", "a/b c/page.HTML": b"<h1>T</h1><p>p</p>", "a/nb.ipynb": json.dumps(notebook).encode(), "a/cues.vtt": b"WEBVTT\n\n00:00.000 --> 00:02.000\nhello\n",
        "a/broken.ipynb": b"{not json", "a/list.ipynb": b"[1, 2]", "a/bad.vtt": b"nothing here", "a/tool.exe": b"MZ", "a/none": b"x", "a/big.txt": b"long " * 300, "a/empty.md": b"", "a/blank.txt": b" \n\n ", "a/one.meta.json": b"{}",
    }
    for name, content in files.items():
        (root / name).write_bytes(content)
    return root


def test_a_folder_with_broken_files(spark, folder, tmp_path):
    """Blocks of what can be read, a row for each failure, and no file stops another."""
    to = (tmp_path / "out").as_uri()
    summary = {(x.kind, x.status): (x.files, x.blocks, x.warnings) for x in tree.ingest_tree(spark, folder.as_uri(), to, most_bytes=1000).collect()}
    assert summary["md", "SUCCESS"] == (2, 2, 1) and summary["txt", "SUCCESS"] == (2, 2, 1) and summary["txt", "FAILED"] == (1, 0, 0) and summary["ipynb", "FAILED"] == (2, 0, 0)
    name = lambda p: p.rsplit("/", 1)[1].replace("%20", " ")
    dead = {name(x.path): (x.stage, x.error, x.attempts) for x in spark.read.parquet(f"{to}/dead_letters").collect()}
    assert dead == {
        "broken.ipynb": ("extraction", "JSONDecodeError", 2), "list.ipynb": ("extraction", "AttributeError", 2), "bad.vtt": ("extraction", "ValueError", 2),
        "tool.exe": ("loader_selection", "UnsupportedEnding", 0), "none": ("loader_selection", "UnsupportedEnding", 0), "big.txt": ("validation", "TooLarge", 0),
    }
    blocks = {}
    for x in spark.read.parquet(f"{to}/blocks").orderBy("path", "n").collect():
        blocks.setdefault(name(x.path), []).append((x.kind, x.text))
    assert blocks["two.txt"] == [("paragraph", "first"), ("paragraph", "second �")] and blocks["page.HTML"] == [("heading", "T"), ("paragraph", "p")]
    assert blocks["nb.ipynb"][-1] == ("code", "x = 1") and blocks["cues.vtt"] == [("transcript", "hello")] and set(blocks) == {"one.md", "two.txt", "page.HTML", "nb.ipynb", "cues.vtt"}


def test_dead_letters_are_tried_again(spark, folder, tmp_path):
    to = (tmp_path / "out").as_uri()
    tree.ingest_tree(spark, folder.as_uri(), to)
    (folder / "a" / "broken.ipynb").write_text(json.dumps({"cells": []}))
    again = {x.path.rsplit("/", 1)[1]: x.status for x in tree.retried(spark, to, {**tree.LOADERS, "exe": lambda t: []}).collect()}
    assert again == {"broken.ipynb": "SUCCESS", "tool.exe": "SUCCESS", "list.ipynb": "FAILED", "bad.vtt": "FAILED", "none": "FAILED"}


def test_loaders_may_fail_once(spark):
    """A second try that succeeds is a success; it counts as two attempts."""

    def flaky(text, tried=[]):  # noqa: B006 - one worker's memory
        tried.append(text)
        if len(tried) % 2:
            raise OSError("not now")
        return tree.plain_blocks(text)

    assert tree.attempt(flaky, b"text", 1) == (tree.plain_blocks("text"), None, None, 2) and tree.attempt(flaky, b"text", 0)[1:] == ("OSError", "not now", 1)
    rows = spark.createDataFrame([("a.txt", 1, None), ("b.txt", 3, bytearray(b"x y")), (None, 0, None)], "path string, length bigint, content binary")
    assert {(x.path, x.status, x.error) for x in tree.loaded(rows).collect()} == {("a.txt", "FAILED", "NoContent"), ("b.txt", "SUCCESS", None), (None, "FAILED", "UnsupportedEnding")}
    assert tree.loaded(rows.limit(0)).collect() == []


def texts(spark, rows):
    return spark.createDataFrame(rows, "resource_id string, title string, text string")


def answers(spark, root, query="cats", version=None):
    found = versions.search(spark, root, spark.createDataFrame([(1, query)], "item_id bigint, text string"), version=version)
    return [(x.chunk_id, round(x.score, 9)) for x in found.orderBy("rank").collect()]


def test_batches_make_the_same_index_as_one(spark, tmp_path):
    root = tmp_path.as_uri()
    first, second = [("r1", "one", "cats sleep"), ("r2", "two", "dogs bark at cats"), ("r3", None, None)], [("r2", "two", "birds sing"), ("r4", "four", "cats cats cats"), ("r4", "four", "cats")]
    assert versions.manifest(spark, root) is None and answers(spark, root) == []
    assert versions.take_in(spark, root, texts(spark, first), 0) == 1
    before = answers(spark, root)
    assert versions.take_in(spark, root, texts(spark, second), 1) == 2
    after = answers(spark, root)
    # Again: nothing changes. The old version can still be asked.
    assert versions.take_in(spark, root, texts(spark, second), 1) == 2 and answers(spark, root) == after and answers(spark, root, version=1) == before
    docs = spark.createDataFrame([("r1", "cats sleep"), ("r2", "birds sing"), ("r4", "cats cats cats"), ("r3", None)], "doc_id string, text string")
    whole = r.bm25(spark.createDataFrame([(1, "cats")], "item_id bigint, text string"), docs)
    assert after == [(x.doc_id, round(x.score, 9)) for x in whole.orderBy("rank").collect()] and {x for x, _ in before} == {"r1", "r2"}
    assert versions.take_in(spark, root, texts(spark, []), 2, removed=spark.createDataFrame([("r1",), (None,)], "resource_id string")) == 3
    assert [x for x, _ in answers(spark, root)] == ["r4"]
    assert versions.compacted(spark, root) == 4 and [x for x, _ in answers(spark, root)] == ["r4"] and len(versions.manifest(spark, root)["parts"]["postings"]) == 1
    assert {x.resource_id for x in versions.part(spark, root, "vectors").collect()} == {"r2", "r4"} and versions.part(spark, root, "edges") is None


def test_a_failed_attempt_is_not_seen(spark, tmp_path):
    root = tmp_path.as_uri()
    versions.take_in(spark, root, texts(spark, [("a", "t", "cats")]), 0)

    def broken(chunks):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        versions.take_in(spark, root, texts(spark, [("b", "t", "cats")]), 1, edges=broken)
    assert [x for x, _ in answers(spark, root)] == ["a"]
    edges = lambda chunks: chunks.selectExpr("resource_id", "concat('concept:', text) AS src", "resource_id AS dst", "'mentioned_in' AS kind")
    assert versions.take_in(spark, root, texts(spark, [("b", "t", "cats")]), 1, edges=edges) == 2
    assert sorted(x for x, _ in answers(spark, root)) == ["a", "b"] and versions.part(spark, root, "edges").first().src == "concept:cats"
    with pytest.raises(FileExistsError):
        versions.publish(spark, root, {"version": 2, "batches": {}, "parts": {}})


def test_a_stream_takes_each_batch_in_once(spark, tmp_path):
    root, inbox, at = f"{tmp_path.as_uri()}/ix", f"{tmp_path.as_uri()}/inbox", f"{tmp_path.as_uri()}/at"
    schema = "resource_id string, title string, text string"
    run = lambda checkpoint: versions.follow(spark.readStream.schema(schema).parquet(inbox), root, checkpoint, "inbox").awaitTermination()
    texts(spark, [("a", "t", "cats")]).write.parquet(inbox)
    run(at)
    texts(spark, [("b", "t", "cats too")]).write.mode("append").parquet(inbox)
    run(at)
    assert versions.manifest(spark, root)["batches"] == {"inbox": 1} and sorted(x for x, _ in answers(spark, root)) == ["a", "b"]
    # A checkpoint that is lost makes the stream begin anew: its first batch is known already.
    run(f"{at}-new")
    assert versions.manifest(spark, root)["version"] == 2 and sorted(x for x, _ in answers(spark, root)) == ["a", "b"]


def catalog(spark, rows):
    return spark.createDataFrame(rows, "id string, part int, status string, n int")


def test_changes_are_read_once(spark, tmp_path):
    root = f"{tmp_path.as_uri()}/feed"
    keys = ["id", "part"]
    assert feed.state(spark, root, keys) is None
    assert feed.commit(spark, root, catalog(spark, [("a", 1, "new", 1), ("b", 1, None, 2), ("c", None, "new", 3)]), keys) == 1

    seen = []

    def run():
        read = feed.follow(spark, root).writeStream.foreachBatch(lambda df, n: seen.extend(tuple(x) for x in df.select("version", "change", "id", "part", "status", "n").collect()))
        read.option("checkpointLocation", f"{tmp_path.as_uri()}/at").trigger(availableNow=True).start().awaitTermination()

    run()
    second = catalog(spark, [("a", 1, "done", 1), ("b", 1, None, 2), ("d", 1, "new", 4)])
    assert feed.commit(spark, root, second, keys, batch=7) == 2 and feed.commit(spark, root, second, keys, batch=7) == 2 and feed.commit(spark, root, second, keys) == 2
    run()
    assert feed.commit(spark, root, second.limit(0), keys) == 3
    run()
    run()
    rows = sorted((x for x in seen), key=repr)
    assert rows == sorted([
        (1, "insert", "a", 1, "new", 1), (1, "insert", "b", 1, None, 2), (1, "insert", "c", None, "new", 3), (2, "update_before", "a", 1, "new", 1), (2, "update_after", "a", 1, "done", 1), (2, "delete", "c", None, "new", 3),
        (2, "insert", "d", 1, "new", 4), (3, "delete", "a", 1, "done", 1), (3, "delete", "b", 1, None, 2), (3, "delete", "d", 1, "new", 4),
    ], key=repr)
    assert sorted(map(tuple, feed.state(spark, root, keys, 2).collect()), key=repr) == sorted(map(tuple, second.collect()), key=repr) and feed.state(spark, root, keys).count() == 0
    assert {tuple(x) for x in feed.summary(spark, root).collect()} == {(1, 3, 0, 0), (2, 1, 1, 1), (3, 0, 0, 3)}
