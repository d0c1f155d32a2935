"""Limits that used to stop or to bound a result."""

import random

from tessera.operators import concepts as cp
from tessera.operators import research as rs
from tessera.sources import index as ix


def test_any_number_of_aliases(spark, monkeypatch):
    """Beyond the length of a pattern aliases meet the texts in a join, with the same finds."""
    draw = random.Random(3)
    parts = ["ab", "c++", "é", "x_y", ".net", "ab c", "12", "b-d", "ab c++"]
    texts = [" ".join(draw.choice([*parts, "abc", "zz", "c", "(ab)", "AB,"]) for _ in range(draw.randint(0, 30))) for _ in range(40)]
    docs = spark.createDataFrame([*enumerate(texts), (90, None), (91, ""), (None, "ab x"), (3, "ab")], "doc_id bigint, text string")
    lexicon = spark.createDataFrame([(f"k{k}", a, [a.upper(), f"{a} zz"], "d") for k, a in enumerate(parts)], "concept_id string, canonical string, aliases array<string>, domain string")
    rows = lambda: sorted(map(str, cp.mentions(docs, lexicon).collect()))
    by_pattern = rows()
    monkeypatch.setattr(cp, "MOST_ALIASES", 3)
    assert cp.alias_pattern(cp.aliases(lexicon)) is None and rows() == by_pattern and len(by_pattern) > 50


def test_publication_date_comes_first(spark):
    pages = spark.createDataFrame([(1, "http://a.org/1", "Notes 2019-01", "", "2024-05-01"), (2, "http://a.org/2", "Notes 2019-01", "", ""), (3, "http://a.org/3", "Notes 2019-01", "", None)], "page_id int, url string, title string, snippet string, published string")
    fresh = {r["page_id"]: r["fresh"] for r in rs.scored_sources(pages, "2024-06-01").collect()}
    assert fresh[1] > 0.9 and fresh[2] == fresh[3] == 0.0
    assert rs.scored_sources(pages.drop("published"), "2024-06-01").where("page_id = 1").first()["fresh"] == 0.0


def test_many_documents_spread_a_part(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(k, f"common word{k % 5} and more") for k in range(60)], "doc_id bigint, text string")
    one, many = f"{tmp_path.as_uri()}/one", f"{tmp_path.as_uri()}/many"
    ix.save_postings(docs, one)
    monkeypatch.setattr(ix, "TOGETHER", 10)
    ix.save_postings(docs, many)
    rows = lambda p: sorted(map(tuple, ix.postings(spark, p).collect()))
    files = lambda p: spark.read.parquet(f"{p}/postings").where("term = 'common'").selectExpr("_metadata.file_path AS f").distinct().count()
    assert rows(one) == rows(many) and files(one) == 1 and files(many) > 3


def test_mastery_in_parts_is_the_fold_in_order(spark, monkeypatch):
    """Histories over many hours, scores outside of 0 to 1, hard tasks, ties in time: what one event after the other gives."""
    import datetime

    from tessera import constants as c
    from tessera.operators import learner as ln

    draw = random.Random(11)
    start = datetime.datetime(2024, 1, 1)
    rows = [(k % 3, f"c{k % 2}", start + datetime.timedelta(minutes=draw.choice([0, 1, 30]) + 17 * (k % 400)), k, draw.choice([None, 0.0, 1.0, draw.random(), -2.0, 3.0]), draw.choice([0.0, 0.5, 1.0, 4.0])) for k in range(1200)]
    expected = {}
    for s, concept, _, _, score, difficulty in sorted(rows, key=lambda r: (r[2], r[3])):
        m = expected.get((s, concept), c.MASTERY_START)
        m = m + c.EXPOSURE_GAIN * (1 - m) if score is None else m + c.MASTERY_K * (0.5 + difficulty) * (score - m)
        expected[s, concept] = min(1.0, max(0.0, m))
    for kind in ("timestamp", "timestamp_ntz"):
        df = spark.createDataFrame(rows, "student int, concept string, ts timestamp, event_id int, score double, difficulty double").withColumn("ts", _cast("ts", kind))
        got = {(r.student, r.concept): (r.mastery, r.events) for r in ln.mastery(df).collect()}
        assert set(got) == set(expected) and all(abs(got[k][0] - v) < 1e-6 for k, v in expected.items()) and sum(v[1] for v in got.values()) == 1200
    by_number = {(r.student, r.concept): r.events for r in ln.mastery(df.drop("ts"), ("event_id",)).collect()}
    assert sum(by_number.values()) == 1200 and ln.mastery(df.limit(0)).collect() == []


def _cast(name, kind):
    from pyspark.sql import functions as F

    return F.col(name).cast(kind)


def test_pairs_of_large_groups_block_by_block(spark, monkeypatch):
    from tessera.operators import graph as g

    draw = random.Random(4)
    rows = [("big", k) for k in range(60)] + [(f"g{draw.randint(0, 9)}", draw.randint(0, 40)) for _ in range(200)] + [(None, 1), (None, 2)]
    df = spark.createDataFrame(rows, "room string, item int")
    whole = sorted(map(str, g.cooccurrence(df, "room", "item", sources=2).collect()))
    monkeypatch.setattr(g, "BLOCK", 7)
    assert sorted(map(str, g.cooccurrence(df, "room", "item", sources=2).collect())) == whole and len(whole) > 100


def test_counts_of_asked_terms_rank_as_all_counts_do(spark, monkeypatch):
    from tessera.operators import retrieval as r

    draw = random.Random(7)
    docs = spark.createDataFrame([(k, " ".join(draw.choice(["cat", "dog", "é", "a1", "tree", "b"]) for _ in range(draw.randint(0, 30)))) for k in range(80)] + [(90, None)], "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "cat tree"), (2, "é é dog"), (3, ""), (4, "none")], "item_id bigint, text string")
    rows = lambda: sorted(map(str, r.hybrid(asked, docs).collect()))
    named = rows()
    monkeypatch.setattr(r, "NAMED_TERMS", 1)
    assert rows() == named == sorted(map(str, r.fused([(r.set_cosine(asked, docs, 50, r.counted(docs)), r.c.W_DENSE), (r.bm25(asked, docs, 50, counts=r.counted(docs)), r.c.W_LEXICAL)]).collect())) and len(named) > 10


def test_phrases_of_the_most_frequent_pairs_are_those_of_all(spark, monkeypatch):
    """The bound by pairs loses no phrase: also where the most frequent pairs are in too few documents, hold generic words, or are as frequent as others."""
    from collections import Counter

    from tessera.operators import mining as mn

    draw = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "data", "kappa", "the", "omega", "x"]
    texts = [" ".join(draw.choice(words) for _ in range(draw.randint(0, 40))) for _ in range(60)] + ["lone pair " * 90, "pair lone " * 50, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    n, where = Counter(), {}
    for k, text in enumerate(texts):
        w = [x for x in (text or "").split() if len(x) >= 3]
        for size in (2, 3, 4):
            for i in range(len(w) - size + 1):
                part = w[i : i + size]
                if "the" not in part and part[0] != "data" and part[-1] != "data":
                    n[" ".join(part)] += 1
                    where.setdefault(" ".join(part), set()).add(k)
    every = sorted(((p, m, len(where[p])) for p, m in n.items() if m >= 4 and len(where[p]) >= 3), key=lambda x: (-x[1], x[0]))
    built = []
    whole = mn.candidate_phrases
    monkeypatch.setattr(mn, "candidate_phrases", lambda runs, sizes, pairs: built.append(pairs.count()) or whole(runs, sizes, pairs))
    for first, most in ((1, 2), (4, 5), (1, 40), (4, 360)):
        monkeypatch.setattr(mn, "FIRST_PAIRS", first)
        assert [tuple(r) for r in mn.phrases(docs, most=most).collect()] == every[:most]
    assert len(every) > 60 and built[0] < built[-1]


def test_plans_of_many_students(spark):
    """Every student's plan is that of the rule, planned by batches of students; one pandas frame a student took milliseconds each."""
    from pyspark.sql import functions as F

    from tessera import constants as c
    from tessera.operators import learner as ln

    draw = random.Random(5)
    rows = [(s, draw.choice(["a", "b", "c", "d", "é"]) + str(k), draw.choice([0.0, 0.1, 0.25, 0.39, 0.4, 0.9])) for s in range(700) for k in range(s % 9)]
    expected = []
    for s in range(700):
        left = [60] * 10
        for m, name in sorted((m, n) for t, n, m in rows if t == s and m < c.WEAK):
            start = 0
            for activity, base in c.PLAN_MINUTES.items():
                need = base if activity == "quiz" else int(round(base * (1 + 0.6 * (1 - m))))
                day = next((d for d in range(start, 10) if left[d] >= need), None)
                if day is not None:
                    left[day] -= need
                    expected.append((s, day + 1, name, activity, need))
                    start = min(day + 2, 9) if activity == "quiz" else day
    plan = ln.study_plan(spark.createDataFrame(rows, "student bigint, concept string, mastery double"))
    assert sorted(map(tuple, plan.collect())) == sorted(expected) and len(expected) > 5000
    assert "FlatMapGroupsInPandas" not in plan._jdf.queryExecution().toString()
    assert ln.study_plan(spark.createDataFrame([], "student bigint, concept string, mastery double")).where(F.lit(True)).collect() == []


def test_mastery_over_batches_is_that_of_the_whole_stream(spark, tmp_path):
    """Batches in order of time, null keys, keys that some batches don't touch: what one fold over all events gives; no key is a Python call of its own."""
    from tessera.operators import learner as ln
    from tessera.streaming import learner as st

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("event_id", "event_type", "ts", "props", "value", "nullif(user_id, 3) AS user_id")
    events.orderBy("ts", "event_id").coalesce(1).write.option("maxRecordsPerFile", 150).parquet(f"{tmp_path}/events.parquet")
    whole = sorted(map(str, ln.mastery(ln.learner_events(events)).select("student", "concept", "mastery", "events").collect()))
    known, n = spark.createDataFrame([], "student bigint, concept string, mastery double, events bigint"), events.count()
    for low in range(0, n, 400):
        known = st.advanced(known, events.where(f"event_id >= {low} AND event_id < {low + 400}")).localCheckpoint()
    assert sorted(map(str, known.selectExpr("student", "concept", "round(mastery, 6) AS mastery", "events").collect())) == whole
    parts = st.streamed_mastery(spark, f"file://{tmp_path}/events.parquet", 100)
    assert sorted(map(str, parts.collect())) == whole and len(whole) > 10


def test_tasks_grow_in_number_with_pairs(spark, monkeypatch):
    """Ten times the pairs go to ten times the tasks, with the same pairs; large groups, repeats and nulls too."""
    from collections import Counter
    from itertools import combinations

    from tessera.operators import graph as g

    draw = random.Random(6)
    rows = [(f"g{draw.randint(0, 60)}", draw.choice([*range(40), None])) for _ in range(900)] + [("big", k) for k in range(45)] + [(None, 1), (None, 2)]
    groups = {}
    for room, k in rows:
        if room is not None and k is not None:
            groups.setdefault(room, set()).add(k)
    n = Counter(p for s in groups.values() for p in combinations(sorted(s), 2))
    expected = sorted((a, b, m) for (a, b), m in n.items() if m >= 2)
    df = spark.createDataFrame(rows, "room string, item int")
    parts = []
    for block, pairs in ((1000, 500_000), (1000, 400), (20, 40)):
        monkeypatch.setattr(g, "BLOCK", block)
        monkeypatch.setattr(g, "TASK_PAIRS", pairs)
        out = g.cooccurrence(df, "room", "item")
        parts.append(out.rdd.getNumPartitions())
        assert sorted(map(tuple, out.collect())) == expected
        first = {(r.a, r.b): r.groups for r in g.cooccurrence(df, "room", "item", sources=2).collect()}
        assert all(first[a, b] == sorted(r for r, s in groups.items() if {a, b} <= s)[:2] for a, b, _ in expected)
    assert parts[0] == 4 and 10 < parts[1] and 8 * parts[1] < parts[2] and len(expected) > 300


def test_postings_of_a_common_word_are_not_dealt_by_word(spark):
    """All postings of one word went to one task; the scores are those of the formula."""
    import math

    from tessera import constants as c
    from tessera.operators import retrieval as r
    from tessera.storage import stored

    draw = random.Random(8)
    rows = [(term, k, draw.randint(1, 5), draw.randint(5, 40)) for term, share in (("common", 1.0), ("other", 0.3), ("rare", 0.01)) for k in range(6000) if draw.random() < share]
    hits = stored(spark.createDataFrame(rows, "term string, doc_id bigint, tf bigint, dl bigint"))
    asked = spark.createDataFrame([(1, "common"), (1, "rare"), (2, "other"), (2, "none")], "item_id bigint, term string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")
    try:
        out = r.scored_terms(hits, asked, 6000, 20.0)
        got = {(x.item_id, x.doc_id): x.score for x in out.collect()}
        assert "hashpartitioning(term" not in out._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    expected, of = {}, {"common": 1, "rare": 1, "other": 2}
    for term, k, tf, dl in rows:
        df = sum(x[0] == term for x in rows) if term not in (known := expected.setdefault("df", {})) else known[term]
        known[term] = df
        w = math.log(1 + (6000 - df + 0.5) / (df + 0.5)) * tf * (c.BM25_K1 + 1) / (tf + c.BM25_K1 * (1 - c.BM25_B + c.BM25_B * dl / 20))
        expected[of[term], k] = expected.get((of[term], k), 0.0) + w
    expected.pop("df")
    assert set(got) == set(expected) and all(abs(got[k] - v) < 1e-9 for k, v in expected.items())


def test_graph_answers_make_one_ranking(spark, monkeypatch):
    """Texts were cut into tokens and ranked twice, for evidence and for concepts; the best sentences are asked for twice, too, and made once."""
    from tessera.operators import evidence as evd
    from tessera.operators import retrieval as r
    from tessera.plans import assistant

    made, kept = [], []
    hybrid, stored = r.hybrid, evd.stored
    monkeypatch.setattr(r, "hybrid", lambda *a, **b: made.append(a) or hybrid(*a, **b))
    monkeypatch.setattr(evd, "stored", lambda df: kept.append(df.columns) or stored(df))
    out = assistant.graph_answers(spark, "/root/testdata/sf0.001").collect()
    assert len(made) == 1 and any("sentence" in c for c in kept) and out and all(x.answer for x in out)


def test_words_are_counted_by_batch(spark, monkeypatch):
    """Counts of asked words by batches are those of all words; nulls, texts without words, shared ids."""
    from tessera.operators import retrieval as r

    rows = [(1, "Zug zug ab, äh äh ÄH _x_ zz"), (1, "zug"), (2, None), (3, ""), (None, "ab ab ab a 😀 ab"), (4, "none of them"), (5, "zz " * 700 + "äh")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    asked = {"zug", "ab", "äh", "zz", "missing"}
    items = spark.createDataFrame([(1, " ".join(asked))], "item_id bigint, text string")
    kind = lambda df: sorted((str(x.doc_id), x.dl, x.nd, [tuple(y) for y in x.t if y.term in asked]) for x in df.collect())
    some = r.counted(docs, queries=items)
    assert kind(some) == kind(r.counted(docs)) and "MapInArrow" not in r.counted(docs)._jdf.queryExecution().toString()
    assert [x.t for x in some.where("doc_id = 5").collect()] == [[("zz", 700), ("äh", 1)]]
    few = r.counted(docs, queries=spark.createDataFrame([(1, "?")], "item_id bigint, text string"))
    assert [x[:3] for x in kind(few)] == [x[:3] for x in kind(some)] and not any(x[3] for x in kind(few))


def test_evidence_texts_are_not_shuffled_for_a_few_rows(spark):
    """A ranking of unknown size met the texts of all documents in a shuffle."""
    from tessera.operators import evidence as evd
    from tessera.operators import retrieval as r

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    plan = evd.evidence_rows(r.hybrid(items, docs), docs)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
