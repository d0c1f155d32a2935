"""A table of requests, each answered by its part."""

import pytest

from tessera.operators import dispatch as d
from tessera.operators import planning as pl
from tessera.sources import versions

REQUEST = "request_id bigint, student bigint, text string, concept string"


@pytest.fixture(scope="module")
def services(spark):
    docs = [(1, "Gradient descent minimises a loss function by following the negative gradient. It is used to train models of many kinds.", "ml", "en"), (2, "Backpropagation trains a neural network by the chain rule of gradients. It needs stored activations.", "ml", "en"), (3, "Cooking pasta takes ten minutes in boiling water with salt.", "food", "en")]
    pages = [(1, "https://arxiv.org/abs/1", "Gradient descent notes", "gradient descent explained for a course and lecture"), (2, "https://spam.example.com/x", "Buy now", "gradient gradient buy now cheap click here"), (3, "https://mit.edu/pasta", "Pasta", "pasta water")]
    return d.Services(
        spark.createDataFrame(docs, "doc_id bigint, text string, source string, lang string"), spark.createDataFrame([(1, "gradient descent", 0.8), (1, "sql", 0.1), (2, "sql", 0.9)], "student bigint, concept string, mastery double"),
        spark.createDataFrame([(*p, p[3][:200]) for p in pages], "page_id bigint, url string, title string, text string, snippet string"), "2024-06-01",
    )


def test_every_route_in_one_table(spark, services, tmp_path):
    rows = [
        (1, 1, "what is gradient descent", None), (2, 1, "quiz me on it", "gradient descent"), (3, 2, "quiz me on it", "gradient descent"), (4, 1, "make a study plan", None), (5, 2, "make a study plan", None), (6, None, "search the web for gradient descent", None),
        (7, 1, "research the latest on pasta water", None), (8, 1, "ingest this: https://mit.edu/pasta please", None), (9, 1, "ingest this: nothing", None), (10, 1, None, None), (11, 1, "", None),
    ]
    root = tmp_path.as_uri()
    keep = lambda pages: versions.take_in(spark, root, pages, 0)
    out = {x.request_id: x for x in d.dispatched(spark.createDataFrame(rows, REQUEST), d.parts(services, keep)).collect()}
    assert {k: x.route for k, x in out.items()} == {1: "tutor", 2: "quiz", 3: "quiz", 4: "planner", 5: "planner", 6: "web_research", 7: "research", 8: "curator", 9: "curator", 10: "tutor", 11: "tutor"}
    assert out[1].output.startswith("[C1] Gradient descent minimises") and "C1" in out[1].data["citations"] and float(out[1].data["confidence"]) > 0 and out[1].tools == ["retrieval_qa"]
    assert "gradient descent" in out[2].output and out[2].data["difficulty"] == "hard" and out[3].data["difficulty"] == "easy" and "gradient" in out[2].data["key_terms"]
    graded = pl.graded(spark.createDataFrame([(out[2].data["answer_key"], out[2].data["key_terms"].split(","))], "answer string, key_terms array<string>")).first()
    assert graded.correct
    assert out[4].output.startswith("Study plan: ") and int(out[4].data["minutes"]) > 0 and out[5].output == "Study plan: 0 days, 0 min total."
    assert "arxiv.org" in out[6].output and "spam" not in out[6].output
    assert out[7].data["used_web"] in ("true", "false") and float(out[7].data["confidence"]) > 0
    assert out[8].output == "Added resource page:3." and out[9].output == "Could not ingest the source." and versions.part(spark, root, "chunks").first().text.startswith("# Pasta")
    assert all(x.status == "answered" for x in out.values())


def test_parts_that_are_missing_or_silent(spark, services):
    rows = spark.createDataFrame([(1, 1, "quiz me", None), (2, 1, "make a study plan", None), (3, 1, "hello", None)], REQUEST)
    silent = lambda requests: requests.limit(0).select(*d.answer_row(d.F.lit(""), []))
    out = {x.request_id: (x.route, x.status, x.output) for x in d.dispatched(rows, {"quiz": silent, "planner": d.planner(services)}).collect()}
    assert out[1] == ("quiz", "no answer", None) and out[2][1] == "answered" and out[3] == ("tutor", "no part", None)
    assert d.dispatched(rows.limit(0), d.parts(services)).collect() == [] and {x.status for x in d.dispatched(rows, {}).collect()} == {"no part"}


def test_a_part_alone_gives_what_the_table_gives(spark, services):
    rows = spark.createDataFrame([(k, 1, t, None) for k, t in enumerate(["what is gradient descent", "explain the chain rule", "make a study plan"])], REQUEST)
    whole = {x.request_id: (x.output, tuple(sorted(x.data.items()))) for x in d.dispatched(rows, d.parts(services)).collect()}
    alone = {x.request_id: (x.output, tuple(sorted(x.data.items()))) for x in d.tutor(services)(rows.where("request_id < 2")).union(d.planner(services)(rows.where("request_id = 2"))).collect()}
    assert whole == alone
