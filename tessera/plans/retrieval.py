"""Retrieval queries: passages of benchmark as queries over documents, vectors over vectors, and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import ANSWER_STOP, EVALUATION_STOP, tokens
from tessera.operators import evaluation as ev
from tessera.operators import evidence as evd
from tessera.operators import retrieval as r
from tessera.plans.registry import query
from tessera.session import table
from tessera.sources import index as ix
from tessera.storage import scratch, stored

TOKENS = r"list_filter(regexp_extract_all(lower(coalesce({t}, '')), '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) >= {n})"
POSTINGS = f"""
words AS (SELECT doc_id, {TOKENS.format(t="text", n=2)} AS w FROM documents),
posting_rows AS (SELECT doc_id, unnest(w) AS term, len(w) AS dl FROM words WHERE len(w) > 0),
postings AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM posting_rows GROUP BY ALL),
stats AS (SELECT count(*) AS n, avg(len(w)) AS mean_length, CAST(sum(len(w)) AS BIGINT) AS total_length FROM words WHERE len(w) > 0),
asked AS (SELECT item_id, unnest(list_distinct({TOKENS.format(t="text", n=2)})) AS term FROM benchmark),
df AS (SELECT term, count(*) AS df FROM postings WHERE term IN (SELECT term FROM asked) GROUP BY 1)"""
BM25 = (
    POSTINGS
    + """,
weights AS (SELECT p.doc_id, p.term, ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * (p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.dl / s.mean_length))) AS w FROM postings p JOIN df d USING (term), stats s),
lexical_scores AS (SELECT a.item_id, w.doc_id, sum(w.w) AS score FROM weights w JOIN asked a USING (term) {where} GROUP BY ALL),
lexical AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM lexical_scores)"""
)
SETS = """,
sizes AS (SELECT item_id, count(*) AS nq FROM asked GROUP BY 1),
doc_sizes AS (SELECT doc_id, count(*) AS nd FROM postings GROUP BY 1),
shared AS (SELECT a.item_id, p.doc_id, count(*) AS n FROM postings p JOIN asked a USING (term) GROUP BY ALL),
set_scores AS (SELECT item_id, doc_id, n / sqrt(nq * nd) AS score FROM shared JOIN sizes USING (item_id) JOIN doc_sizes USING (doc_id)),
sets AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM set_scores)"""
HYBRID = (
    BM25.replace("{where}", "")
    + SETS
    + """,
fused_scores AS (SELECT item_id, doc_id, sum(s) AS score FROM (SELECT item_id, doc_id, CAST(1.0 AS DOUBLE) / (60 + rank) AS s FROM lexical WHERE rank <= 50 UNION ALL SELECT item_id, doc_id, CAST(0.4 AS DOUBLE) / (60 + rank) FROM sets WHERE rank <= 50) GROUP BY ALL),
fused AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM fused_scores)"""
)
OUT = "SELECT item_id, doc_id, rank, round(score, 6) AS score FROM {name} WHERE rank <= {k}"
GOLD = ",\ngold AS (SELECT DISTINCT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
METRICS = (
    GOLD
    + """,
marked AS (SELECT f.item_id, f.rank, CASE WHEN g.doc_id IS NULL THEN 0 ELSE 1 END AS rel FROM fused f LEFT JOIN gold g USING (item_id, doc_id) WHERE f.rank <= 10),
cumulated AS (SELECT *, sum(rel) OVER (PARTITION BY item_id ORDER BY rank ROWS UNBOUNDED PRECEDING) * rel / rank AS p FROM marked),
found AS (SELECT item_id, sum(rel) AS hits, min(CASE WHEN rel = 1 THEN rank END) AS first, sum(p) AS ap, sum(CASE WHEN rel = 1 THEN 1 / log2(rank + 1.0) ELSE 0.0 END) AS dcg FROM cumulated GROUP BY 1),
n_gold AS (SELECT item_id, count(*) AS n FROM gold GROUP BY 1),
per_query AS (SELECT b.item_id, coalesce(n, 0) AS n_relevant,
  round(CASE WHEN coalesce(hits, 0) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE, 6) AS hit, round(coalesce(hits / n, 0)::DOUBLE, 6) AS recall, round(CASE WHEN n > 0 THEN coalesce(hits, 0) / 10 ELSE 0 END::DOUBLE, 6) AS precision,
  round(coalesce(1 / first, 0)::DOUBLE, 6) AS reciprocal_rank, round(coalesce(ap / n, 0)::DOUBLE, 6) AS average_precision,
  round(coalesce(dcg / list_sum(list_transform(range(1, least(10, n) + 1), lambda i: 1 / log2(i + 1.0))), 0)::DOUBLE, 6) AS ndcg
  FROM benchmark b LEFT JOIN n_gold USING (item_id) LEFT JOIN found USING (item_id))"""
)
COSINE = """
q AS (SELECT vec_id AS query_id, embedding AS a FROM embeddings WHERE vec_id % 20 = 0),
sims AS (SELECT query_id, e.vec_id, label, list_sum(list_transform(list_zip(a, embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / sqrt(list_sum(list_transform(a, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS score FROM q, embeddings e WHERE e.vec_id <> query_id),
near AS (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS INTEGER) AS rank FROM sims)"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark")


def _out(df: DataFrame) -> DataFrame:
    return df.select("item_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS.format(t='text', n=2)}) AS term FROM documents) GROUP BY ALL")
def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.postings(_docs(spark, sf_dir)).select("doc_id", "term", "tf")


@query(f"WITH {POSTINGS} SELECT n AS documents, round(mean_length, 6) AS mean_length, total_length, (SELECT count(DISTINCT term) FROM postings) AS vocabulary FROM stats")
def bm25_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    terms = docs.select(F.explode(tokens(F.col("text"))).alias("term")).distinct().agg(F.count("*").alias("vocabulary"))
    return r.corpus_statistics(docs).withColumn("mean_length", F.round("mean_length", 6)).join(terms, F.lit(True))  # one row each


@query(f"WITH {BM25.replace('{where}', '')} {OUT.format(name='lexical', k=10)}")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(r.bm25(_items(spark, sf_dir), _docs(spark, sf_dir)))


@query(f"WITH {BM25.replace('{where}', '')} {OUT.format(name='lexical', k=10)}")
def bm25_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a kept index, which is built first."""
    path = scratch(spark)
    ix.save_postings(_docs(spark, sf_dir), path)
    return _out(ix.bm25(spark, path, _items(spark, sf_dir)))


@query(f"WITH {BM25.replace('{where}', "JOIN documents d ON d.doc_id = w.doc_id AND d.lang = 'en'")} {OUT.format(name='lexical', k=10)}")
def bm25_filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    return _out(r.bm25(_items(spark, sf_dir), _docs(spark, sf_dir), allowed=allowed))


@query(f"WITH {BM25.replace('{where}', '').replace('FROM documents)', "FROM documents WHERE source <> 'src1')", 1)} {OUT.format(name='lexical', k=10)}")
def bm25_delete_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index without a deleted source."""
    docs = table(spark, sf_dir, "documents")
    gone = docs.where("source = 'src1'").select("doc_id")
    return _out(r.bm25(_items(spark, sf_dir), docs.join(gone, "doc_id", "left_anti").select("doc_id", "text")))


@query(f"WITH {POSTINGS} {SETS} {OUT.format(name='sets', k=10)}")
def set_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(r.set_cosine(_items(spark, sf_dir), _docs(spark, sf_dir)))


@query(f"WITH {HYBRID} SELECT item_id, doc_id, rank, round(score, 6) AS score FROM fused")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(r.hybrid(_items(spark, sf_dir), _docs(spark, sf_dir), k=None))


@query(f"WITH {HYBRID} {OUT.format(name='fused', k=10)}")
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(r.hybrid(_items(spark, sf_dir), _docs(spark, sf_dir)))


@query("SELECT DISTINCT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def passage_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.containing(_items(spark, sf_dir), _docs(spark, sf_dir))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, docs = _items(spark, sf_dir), _docs(spark, sf_dir)
    return ev.retrieval_metrics(r.hybrid(items, docs), r.containing(items, docs), items)


@query(f"WITH {HYBRID} {METRICS} SELECT * FROM per_query")
def ir_metrics_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir)


MACRO = "count(*) AS queries, CAST(count(*) FILTER (n_relevant > 0) AS BIGINT) AS evaluated, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in ev.METRICS)


@query(f"WITH {HYBRID} {METRICS} SELECT {MACRO} FROM per_query")
def ir_metrics_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.macro(_metrics(spark, sf_dir))


@query(f"WITH {HYBRID} {METRICS} SELECT 'all' AS task, {MACRO} FROM per_query")
def hybrid_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval with evaluation, in one job."""
    return ev.macro(_metrics(spark, sf_dir)).select(F.lit("all").alias("task"), "*")


@query(f"""WITH {HYBRID},
boosts AS (SELECT f.item_id, f.doc_id, CAST(len(list_distinct({TOKENS.format(t="d.text", n=8)})) AS DOUBLE) AS boost FROM fused f JOIN documents d USING (doc_id) WHERE rank <= 50 AND d.lang = 'en'),
most AS (SELECT item_id, max(boost) AS most FROM boosts GROUP BY 1),
again AS (SELECT f.item_id, f.doc_id, f.score + 0.5 * coalesce(CASE WHEN most > 0 THEN boost / most ELSE 0 END, 0) AS score FROM fused f LEFT JOIN boosts USING (item_id, doc_id) LEFT JOIN most ON most.item_id = f.item_id WHERE f.rank <= 50),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM again)
{OUT.format(name="placed", k=10)}""")
def graph_boost_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid candidates ranked again with a boost for documents that hold many long terms."""
    docs = table(spark, sf_dir, "documents")
    top = r.hybrid(_items(spark, sf_dir), docs, k=50)
    boosts = top.join(docs.where("lang = 'en'"), "doc_id").select("item_id", "doc_id", F.size(F.array_distinct(tokens(F.col("text"), 8))).cast("double").alias("boost"))
    return _out(r.boosted(top, boosts))


@query(f"WITH {COSINE} SELECT query_id, vec_id, rank, round(score, 6) AS score FROM near WHERE rank <= 10")
def knn_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return r.nearest(v.where("vec_id % 20 = 0"), v).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query(f"""WITH {COSINE} SELECT count(*) AS queries, round(avg(CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END), 6) AS purity
FROM near n JOIN embeddings a ON a.vec_id = n.vec_id JOIN embeddings b ON b.vec_id = n.query_id WHERE rank = 1""")
def nn_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return ev.purity(r.nearest(v.where("vec_id % 20 = 0"), v, k=1), v)


@query("""WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
n AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM u),
p AS (SELECT a.label = b.label AS same, list_sum(list_transform(list_zip(a.e, b.e), lambda x: x[1] * x[2])) AS s FROM n a JOIN n b ON a.vec_id < b.vec_id)
SELECT round(avg(s) FILTER (same), 6) AS same_label, round(avg(s) FILTER (NOT same), 6) AS other_label, round(avg(s) FILTER (same) - avg(s) FILTER (NOT same), 6) AS gap FROM p""")
def coherence_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.coherence_gap(table(spark, sf_dir, "embeddings"))


@query()
def hash_embed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as queries over hashed embeddings of documents."""
    docs = _docs(spark, sf_dir).select(F.col("doc_id"), r.hash_embedding(F.col("text")).alias("embedding"))
    items = _items(spark, sf_dir).select(F.col("item_id").alias("doc_id"), r.hash_embedding(F.col("text")).alias("embedding"))
    found = r.nearest(items, docs, key="doc_id", same=True)
    return found.select(F.col("query_id").alias("item_id"), "doc_id", "rank", F.round("score", 6).alias("score"))


@query("""WITH s AS (SELECT length(text)::DOUBLE AS score, quality AS label FROM documents JOIN labels USING (doc_id)),
g AS (SELECT score, CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos, CAST(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS neg FROM s WHERE label IS NOT NULL GROUP BY 1),
w AS (SELECT pos, neg, pos * (coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg / 2) AS won FROM g)
SELECT CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives, round(CAST(sum(won) / (sum(pos) * sum(neg)) AS DOUBLE), 6) AS auc FROM w""")
def auc_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well length tells quality."""
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return ev.auc(both.select(F.length("text").cast("double").alias("score"), "quality"), "score", "quality")


EVIDENCE = (
    HYBRID
    + """,
evidence AS (SELECT f.item_id, f.doc_id, f.rank, d.source, d.text, CASE WHEN contains(d.text, '|') THEN 'table' ELSE 'document' END AS source_type,
  upper(d.source[1]) || lower(d.source[2:]) AS title, upper(d.source[1]) || lower(d.source[2:]) || ' (#' || d.doc_id || ')' AS citation,
  round(least(1.0, greatest(0.0, 0.5 * CASE WHEN most > 0 THEN f.score / most ELSE 0 END + 0.5 * (1 - (f.rank - 1) / 10))), 6) AS confidence
  FROM (SELECT *, max(score) OVER (PARTITION BY item_id) AS most FROM fused WHERE rank <= 10) f JOIN documents d USING (doc_id))"""
)
CONTEXT = """,
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, source ORDER BY confidence DESC, doc_id) AS nth FROM evidence WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '') WHERE nth = 1),
counted AS (SELECT *, regexp_extract_all(text, '\\S+') AS w FROM firsts),
sized AS (SELECT * EXCLUDE (text, w), CASE WHEN len(w) <= 246 THEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) ELSE array_to_string(w[1:246], ' ') || ' …' END AS text, CAST(CASE WHEN len(w) <= 246 THEN greatest(1, floor(len(w) * CAST(1.3 AS DOUBLE))) ELSE 321 END AS INTEGER) AS tokens FROM counted),
summed AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY item_id ORDER BY confidence DESC, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tokens_so_far, CAST(row_number() OVER (PARTITION BY item_id ORDER BY confidence DESC, doc_id) AS INTEGER) AS place FROM sized),
chosen AS (SELECT * FROM summed WHERE (tokens_so_far <= 1200 OR place = 1) AND place <= 5)"""
_STOP = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
TERMS = lambda t, words: rf"list_distinct(list_filter(regexp_extract_all(lower(coalesce({t}, '')), '[a-z][a-z\-]+'), lambda w: length(w) > 2 AND w NOT IN {_STOP(words)}))"
SENTENCES = lambda t: rf"string_split(regexp_replace(trim({t}, ' ' || chr(9) || chr(10) || chr(13)), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
ANSWERS = (
    CONTEXT.replace("1200", "1800")
    + rf""",
sentence_lists AS (SELECT item_id, place, c.text, {TERMS("b.text", ANSWER_STOP)} AS q, list_filter(list_transform({SENTENCES("c.text")}, lambda x: trim(x)), lambda x: len(regexp_extract_all(x, '\S+')) >= 4) AS s FROM chosen c JOIN benchmark b USING (item_id)),
sentence_rows AS (SELECT item_id, place, q, unnest(CASE WHEN len(s) = 0 THEN [text] ELSE s END) AS x, unnest(range(greatest(1, len(s)))) AS i FROM sentence_lists),
best_rows AS (SELECT item_id, place, arg_max(x, len(list_intersect({TERMS("x", ANSWER_STOP)}, q)) * 1000000 - i) AS s FROM sentence_rows GROUP BY ALL),
one_line AS (SELECT item_id, place, trim(array_to_string(regexp_extract_all(replace(s, '•', ' '), '\S+'), ' '), ' -:;,') AS s FROM best_rows),
said AS (SELECT item_id, place, regexp_replace(CASE WHEN length(s) <= 260 THEN s ELSE regexp_replace(left(s, 260), ' [^ ]*$', '') || ' …' END, '\.+$', '') AS s FROM one_line),
once AS (SELECT item_id, s, min(place) AS place FROM said WHERE place <= 3 AND s <> '' GROUP BY ALL),
answers AS (SELECT item_id, string_agg('[C' || place || '] ' || s || '.', ' ' ORDER BY place) AS answer FROM once GROUP BY 1),
valid AS (SELECT item_id, list('C' || place ORDER BY place) AS valid FROM best_rows GROUP BY 1)"""
)
GROUNDED = (
    ANSWERS
    + rf""",
marked_sentences AS (SELECT item_id, s, list_distinct(regexp_extract_all(s, '\[([CK][0-9]+)\]', 1)) AS marks, valid FROM (SELECT item_id, unnest({SENTENCES("answer")}) AS s FROM answers) JOIN valid USING (item_id) WHERE trim(s) <> ''),
grounded AS (SELECT item_id, count(*) AS sentences, CAST(sum(CASE WHEN len(marks) > 0 AND len(list_filter(marks, lambda m: NOT list_contains(valid, m))) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS grounded,
  array_to_string(list_sort(list_distinct(flatten(list(list_filter(marks, lambda m: NOT list_contains(valid, m)))))), ',') AS invalid FROM marked_sentences GROUP BY 1)"""
)


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return evd.evidence_rows(r.hybrid(_items(spark, sf_dir), docs), docs)


@query(f"WITH {EVIDENCE} SELECT item_id, doc_id, rank, title, source_type, citation, confidence FROM evidence")
def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).drop("text", "source")


@query(f"WITH {EVIDENCE} {CONTEXT} SELECT item_id, doc_id, place, tokens, tokens_so_far, confidence FROM chosen")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evd.context(_evidence(spark, sf_dir), budget=1200).drop("text")


@query(f"WITH {EVIDENCE} {ANSWERS} SELECT item_id, answer, array_to_string(valid, ',') AS valid FROM answers JOIN valid USING (item_id)")
def extractive_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = evd.context(_evidence(spark, sf_dir))
    return evd.answers(evd.best_sentences(chosen, _items(spark, sf_dir))).select("item_id", "answer", F.array_join("valid", ",").alias("valid"))


@query(f"WITH {EVIDENCE} {GROUNDED} SELECT *, round(grounded / sentences, 4) AS ratio FROM grounded")
def grounding_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = evd.context(_evidence(spark, sf_dir))
    return ev.grounding(evd.answers(evd.best_sentences(chosen, _items(spark, sf_dir))), "item_id", "answer", "valid")


@query(f"WITH {EVIDENCE} SELECT source, count(*) AS citations, count(DISTINCT item_id) AS queries, round(avg(confidence), 6) AS mean_confidence FROM evidence GROUP BY 1")
def citation_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evd.citation_sources(_evidence(spark, sf_dir))


FAITHFUL = (
    GROUNDED
    + rf""",
gold AS (SELECT DISTINCT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
near_gold AS (SELECT c.item_id, avg(CASE WHEN g.doc_id IS NULL THEN 0 ELSE 1 END) AS context_precision, CAST(max(CASE WHEN g.doc_id IS NULL THEN 0 ELSE 1 END) AS DOUBLE) AS context_recall FROM chosen c LEFT JOIN gold g ON g.item_id = c.item_id AND g.doc_id = c.doc_id GROUP BY 1),
cited_rows AS (SELECT item_id, pos, s, CAST(unnest(regexp_extract_all(s, '\[C([0-9]+)\]', 1)) AS INTEGER) AS place FROM (SELECT item_id, unnest({SENTENCES("answer")}) AS s, unnest(range(len({SENTENCES("answer")}))) AS pos FROM answers) WHERE trim(s) <> ''),
held_rows AS (SELECT r.item_id, pos, {TERMS("s", EVALUATION_STOP)} AS w, {TERMS("c.text", EVALUATION_STOP)} AS t FROM cited_rows r LEFT JOIN chosen c ON c.item_id = r.item_id AND c.place = r.place),
faithful AS (SELECT item_id, avg(ok) AS faithfulness FROM (SELECT item_id, pos, max(CASE WHEN len(w) > 0 AND len(list_intersect(w, t)) / len(w) >= 0.5 THEN 1 ELSE 0 END) AS ok FROM held_rows GROUP BY ALL) GROUP BY 1),
complete AS (SELECT a.item_id, CASE WHEN len({TERMS("b.text", EVALUATION_STOP)}) > 0 THEN len(list_intersect({TERMS("b.text", EVALUATION_STOP)}, {TERMS("answer", EVALUATION_STOP)})) / len({TERMS("b.text", EVALUATION_STOP)}) ELSE 0 END AS completeness FROM answers a JOIN benchmark b USING (item_id)),
answer_rows AS (SELECT item_id, round(context_precision, 6) AS context_precision, context_recall, CASE WHEN invalid = '' THEN 1 ELSE 0 END::DOUBLE AS citation_accuracy, round(grounded / sentences, 4) AS grounding, round(coalesce(faithfulness, 1), 6) AS faithfulness, CAST(0 AS DOUBLE) AS multi_hop, round(1 - round(grounded / sentences, 4), 4) AS hallucination, round(completeness, 6) AS completeness FROM near_gold JOIN grounded USING (item_id) JOIN complete USING (item_id) LEFT JOIN faithful USING (item_id))"""
)


def _answered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Answers, contexts and what is right."""
    items = _items(spark, sf_dir)
    chosen = stored(evd.context(_evidence(spark, sf_dir)))
    return stored(evd.answers(evd.best_sentences(chosen, items))), chosen, r.containing(items, _docs(spark, sf_dir))


@query(f"WITH {EVIDENCE} {FAITHFUL} SELECT * FROM answer_rows")
def answer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    said, chosen, gold = _answered(spark, sf_dir)
    return ev.answer_metrics(said, chosen, _items(spark, sf_dir), gold)


@query(f"WITH {EVIDENCE} {FAITHFUL} SELECT 'answers' AS arm, {', '.join(f'round(avg({m}), 4) AS {m}' for m in ev.ANSWER_METRICS)} FROM answer_rows")
def answer_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    said, chosen, gold = _answered(spark, sf_dir)
    return ev.tagged_means({"answers": ev.answer_metrics(said, chosen, _items(spark, sf_dir), gold)}, ev.ANSWER_METRICS)


_ARM = "SELECT '{arm}' AS arm, round(avg(hit), 4) AS hit, round(avg(reciprocal_rank), 4) AS reciprocal_rank, round(avg(ndcg), 4) AS ndcg FROM (SELECT CASE WHEN coalesce(hits, 0) > 0 THEN 1.0 ELSE 0.0 END AS hit, round(coalesce(1 / first, 0)::DOUBLE, 6) AS reciprocal_rank, round(coalesce(dcg / list_sum(list_transform(range(1, least(10, n) + 1), lambda i: 1 / log2(i + 1.0))), 0)::DOUBLE, 6) AS ndcg FROM benchmark b LEFT JOIN (SELECT item_id, count(*) AS n FROM gold GROUP BY 1) USING (item_id) LEFT JOIN (SELECT item_id, sum(rel) AS hits, min(CASE WHEN rel = 1 THEN rank END) AS first, sum(CASE WHEN rel = 1 THEN 1 / log2(rank + 1.0) ELSE 0.0 END) AS dcg FROM (SELECT f.item_id, f.rank, CASE WHEN g.doc_id IS NULL THEN 0 ELSE 1 END AS rel FROM {table} f LEFT JOIN gold g USING (item_id, doc_id) WHERE f.rank <= 10) GROUP BY 1) USING (item_id))"


@query(f"WITH {HYBRID} {GOLD} " + " UNION ALL ".join(_ARM.format(arm=a, table=t) for a, t in (("lexical", "lexical"), ("sets", "sets"), ("hybrid", "fused"))))
def retrieval_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arms of hybrid retrieval side by side."""
    items, docs = _items(spark, sf_dir), _docs(spark, sf_dir)
    counts, gold = r.counted(docs, queries=items), stored(r.containing(items, docs))
    sets, lexical = stored(r.set_cosine(items, docs, 50, counts)), stored(r.bm25(items, docs, 50, counts=counts))
    arms = {"lexical": lexical, "sets": sets, "hybrid": r.fused([(sets, r.c.W_DENSE), (lexical, r.c.W_LEXICAL)])}
    return ev.tagged_means({a: ev.retrieval_metrics(x.where("rank <= 10"), gold, items) for a, x in arms.items()}, ("hit", "reciprocal_rank", "ndcg"))
