"""The whole pipeline against a plain version of its deterministic parts."""

import corpus_pipeline
from pyspark.sql import functions as F
from tests.llm.test_operators import base_counts, base_spans, brute_groups, brute_repeats, sha

from tessera.llm.shared import documents, stored


def test_stages_against_plain_versions(spark, tables, corpus):
    docs, rows = documents(spark, tables), list(corpus)
    stages = dict(corpus_pipeline.STAGES)
    docs = stored(stages["quality rules"](spark, docs, tables), "t")
    kept = {r["doc_id"] for r in docs.collect()}
    assert kept <= {r[0] for r in rows if not base_counts(r[1])[5]} and set(range(60)) <= kept
    rows = [r for r in rows if r[0] in kept]
    docs = stored(stages["near-duplicate removal"](spark, docs, tables), "t")
    first = {k for k, v in brute_groups(rows, 5, 80).items() if v[2]}
    assert {r["doc_id"] for r in docs.collect()} == first
    rows = [r for r in rows if r[0] in first]
    docs = stored(stages["substring deduplication"](spark, docs, tables), "t")
    left = brute_repeats(rows)
    got = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {k: sha(b" ".join(t.encode().split())) for k, t in got.items()} == {k: v[2] for k, v in left.items()}
    docs = stored(stages["personal data"](spark, docs, tables), "t")
    clean = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(clean) == set(got) and all(not base_spans(t) for t in clean.values())
    placed = stages["best-fit packing"](spark, docs, tables)
    assert {r[0] for r in placed.select("doc_id").distinct().collect()} == set(clean)


def test_run(spark, tables):
    out = corpus_pipeline.run(spark, tables)
    sums = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert 0 < sums <= 2048 and corpus_pipeline.ORACLE_SQL is None
