"""Queries on evidence and answers: statistics, checks, citations, prompts, concepts in the context, unified search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import concepts as cp
from tessera.operators import evaluation as ev
from tessera.operators import evidence as evd
from tessera.operators import graph_retrieval as gr
from tessera.operators import retrieval as r
from tessera.operators.catalog import ROUTES, routed
from tessera.plans.analytics import ROUTE_SQL
from tessera.plans.concepts import EXPANDED, HYBRID, MENTIONS, _linked, lexicon, resources
from tessera.plans.registry import query
from tessera.plans.retrieval import ANSWERS, CONTEXT, EVIDENCE
from tessera.session import table
from tessera.storage import stored


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return evd.evidence_rows(r.hybrid(table(spark, sf_dir, "benchmark"), docs), docs)


@query(f"""WITH {EVIDENCE}, k AS (SELECT item_id, string_agg(source_type || ':' || n, ',' ORDER BY source_type || ':' || n) AS by_source_type FROM (SELECT item_id, source_type, count(*) AS n FROM evidence GROUP BY ALL) GROUP BY 1),
b AS (SELECT item_id, round(avg(confidence), 4) AS overall_confidence FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY confidence DESC) AS n FROM evidence) WHERE n <= 3 GROUP BY 1)
SELECT item_id, count(*) AS items, count(DISTINCT source) AS sources, any_value(by_source_type) AS by_source_type, any_value(overall_confidence) AS overall_confidence FROM evidence JOIN k USING (item_id) JOIN b USING (item_id) GROUP BY 1""")
def evidence_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evd.evidence_statistics(stored(_evidence(spark, sf_dir)))


#: Documents as evidence rows with places, some of which break a rule.
PLACED = """placed AS (SELECT doc_id // 10 AS item_id, CAST(doc_id % 10 + 1 AS INTEGER) AS rank, (1000 - (doc_id % 10) * 90 + CASE WHEN doc_id % 37 = 5 THEN 200 ELSE 0 END) / 1000 AS score, (n_chars % 113) / 100 AS confidence, CASE WHEN doc_id % 23 = 0 THEN '' ELSE source END AS resource_id, CASE WHEN doc_id % 29 = 0 THEN NULL ELSE '[' || source || ']' END AS citation,
CASE WHEN doc_id % 31 = 0 THEN ' ' ELSE text END AS text, CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'slide' WHEN 2 THEN 'video' WHEN 3 THEN 'web' ELSE 'document' END AS source_type, CASE WHEN doc_id % 5 = 0 AND doc_id % 3 > 0 THEN CAST(doc_id % 90 + 1 AS INTEGER) END AS page, CASE WHEN doc_id % 5 = 0 AND doc_id % 3 > 0 THEN CAST(doc_id % 90 + 1 + doc_id % 2 AS INTEGER) END AS page_end,
CASE WHEN doc_id % 5 = 1 THEN CAST(doc_id % 40 AS INTEGER) END AS slide, CASE WHEN doc_id % 5 = 2 THEN CAST(doc_id % 4000 AS DOUBLE) + 0.5 END AS timestamp, CASE WHEN doc_id % 5 = 3 THEN 'https://example.org/' || doc_id END AS url, CASE WHEN doc_id % 5 = 3 THEN 'example.org' END AS domain FROM documents)"""


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, none = F.col("doc_id"), F.lit(None)
    five = i % 5
    on = lambda k, value: F.when(five == k, value)
    page = F.when((five == 0) & (i % 3 > 0), (i % 90 + 1).cast("int"))
    kind = on(0, "pdf").when(five == 1, "slide").when(five == 2, "video").when(five == 3, "web").otherwise("document")
    return table(spark, sf_dir, "documents").select(
        F.floor(i / 10).alias("item_id"), (i % 10 + 1).cast("int").alias("rank"), ((1000 - (i % 10) * 90 + F.when(i % 37 == 5, 200).otherwise(0)) / 1000).alias("score"), ((F.col("n_chars") % 113) / 100).alias("confidence"), F.when(i % 23 == 0, "").otherwise(F.col("source")).alias("resource_id"),
        F.when(i % 29 == 0, none).otherwise(F.concat(F.lit("["), "source", F.lit("]"))).alias("citation"), F.when(i % 31 == 0, " ").otherwise(F.col("text")).alias("text"), kind.alias("source_type"), page.alias("page"), (page + (i % 2).cast("int")).alias("page_end"),
        on(1, (i % 40).cast("int")).alias("slide"), on(2, (i % 4000).cast("double") + 0.5).alias("timestamp"), on(3, F.concat(F.lit("https://example.org/"), i)).alias("url"), on(3, F.lit("example.org")).alias("domain"),
    )


@query(f"""WITH {PLACED}, o AS (SELECT *, lag(score) OVER (PARTITION BY item_id ORDER BY rank) AS before FROM placed),
i AS (SELECT item_id, rank, list_filter([CASE WHEN score > before + 1e-9 THEN 'error: order' END, CASE WHEN NOT confidence BETWEEN 0 AND 1 THEN 'error: confidence' END, CASE WHEN trim(resource_id) = '' THEN 'error: resource' END, CASE WHEN coalesce(trim(citation), '') = '' THEN 'error: citation' END, CASE WHEN trim(text) = '' THEN 'warning: text' END,
  CASE WHEN source_type = 'pdf' AND page IS NULL THEN 'error: pdf without page' END], lambda x: x IS NOT NULL) AS issues FROM o)
SELECT item_id, rank, array_to_string(issues, ',') AS issues FROM i WHERE len(issues) > 0""")
def evidence_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evd.evidence_issues(_placed(spark, sf_dir)).select("item_id", "rank", F.array_join("issues", ",").alias("issues"))


_CLOCK = "CAST(CAST(floor(timestamp / 60) AS BIGINT) AS VARCHAR) || ':' || lpad(CAST(CAST(floor(timestamp) AS BIGINT) % 60 AS VARCHAR), 2, '0')"
_PLACE = f"CASE WHEN slide IS NOT NULL THEN 'slide ' || slide WHEN timestamp IS NOT NULL THEN {_CLOCK} WHEN page IS NOT NULL THEN 'p.' || page || CASE WHEN page_end <> page THEN '-' || page_end ELSE '' END ELSE '' END"
NODES = f"""{PLACED}, n AS (SELECT *, row_number() OVER (PARTITION BY item_id, source_type = 'web' ORDER BY rank) AS nth FROM placed),
nodes AS (SELECT item_id, CASE WHEN source_type = 'web' THEN 'W' ELSE 'C' END || nth AS mark, CASE WHEN source_type = 'web' THEN 'web' ELSE 'chunk' END AS kind, source_type, resource_id, confidence, CASE WHEN source_type = 'web' THEN domain ELSE {_PLACE} END AS locator,
  CASE WHEN source_type = 'web' THEN url WHEN resource_id IN ('', 'src1') THEN '' ELSE 'file:/raw/' || resource_id || CASE WHEN page IS NOT NULL THEN '#page=' || page WHEN slide IS NOT NULL THEN '#slide=' || slide WHEN timestamp IS NOT NULL THEN '#t=' || CAST(floor(timestamp) AS BIGINT) ELSE '' END END AS link FROM n)"""


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "documents").where("source != 'src1'").select(F.col("source").alias("resource_id")).distinct()
    return evd.resolved(evd.citation_nodes(_placed(spark, sf_dir)), source.withColumn("uri", F.concat(F.lit("file:/raw/"), "resource_id")))


@query(f"WITH {NODES} SELECT item_id, mark, kind, locator, link, link <> '' AS resolvable FROM nodes")
def citation_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be cited, where it is, and a link to the place."""
    return _nodes(spark, sf_dir).select("item_id", "mark", "kind", "locator", "link", "resolvable")


@query(f"""WITH {NODES} SELECT item_id, count(*) AS citations, count(DISTINCT nullif(resource_id, '')) AS sources, round(avg(CASE WHEN link <> '' THEN 1.0 ELSE 0.0 END), 4) AS resolvable_rate, round(coalesce(avg(CASE WHEN kind = 'chunk' THEN CASE WHEN locator <> '' THEN 1.0 ELSE 0.0 END END), 0), 4) AS locator_coverage,
CAST(sum(CASE WHEN kind = 'web' THEN 1 ELSE 0 END) AS BIGINT) AS web_citations, round(avg(confidence), 4) AS mean_confidence FROM nodes GROUP BY 1""")
def citation_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evd.node_statistics(_nodes(spark, sf_dir))


@query(f"WITH {NODES} SELECT item_id, mark FROM nodes WHERE kind = 'chunk' AND confidence >= 0.5 AND link <> ''")
def citation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evd.filtered_nodes(_nodes(spark, sf_dir), kind="chunk", min_confidence=0.5, resolvable=True).select("item_id", "mark")


@query(f"""WITH {PLACED} SELECT item_id, rank, '[' || source || CASE WHEN place = '' THEN '' ELSE ', ' || place END || CASE WHEN heading = '' THEN '' ELSE ', ' || heading END || ']' AS citation, kind, anchor, 'dense #' || rank || ' (cos ' || printf('%.3f', score) || ')' || CASE WHEN rank > 5 THEN '' ELSE ' + BM25 #' || rank * 2 || ' (score ' || printf('%.2f', confidence) || ')' END || ' -> fused ' || printf('%.4f', score) AS reason FROM (
SELECT item_id, rank, score, confidence, resource_id AS source, {_PLACE} AS place, CASE WHEN rank % 2 = 0 THEN 'Part ' || rank ELSE '' END AS heading, CASE WHEN slide IS NOT NULL THEN 'slide' WHEN timestamp IS NOT NULL THEN 'video' WHEN url IS NOT NULL THEN 'web' WHEN page IS NOT NULL THEN 'pdf' ELSE 'document' END AS kind,
CASE WHEN slide IS NOT NULL THEN 'slide ' || slide WHEN page IS NOT NULL THEN 'p.' || page WHEN timestamp IS NOT NULL THEN {_CLOCK} ELSE '@' || rank END AS anchor FROM placed)""")
def citation_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations, anchors, source types and reasons as they are shown."""
    c: dict[str, Column] = {n: F.col(n) for n in ("slide", "timestamp", "page", "page_end", "url", "rank", "score", "confidence", "resource_id")}
    place = evd.locator(c["slide"], c["timestamp"], c["page"], c["page_end"])
    heading = F.when(c["rank"] % 2 == 0, F.concat(F.lit("Part "), c["rank"])).otherwise("")
    anchor = evd.anchor(c["slide"], c["page"], F.lit(None).cast("int"), c["timestamp"], c["rank"])
    lexical = F.when(c["rank"] <= 5, c["rank"] * 2)
    return _placed(spark, sf_dir).select("item_id", "rank", evd.citation(c["resource_id"], place, heading).alias("citation"), evd.source_type(c["slide"], c["timestamp"], c["url"], c["page"], F.lit(None).cast("string")).alias("kind"), anchor.alias("anchor"), evd.reason(c["rank"], c["score"], lexical, c["confidence"], c["score"]).alias("reason"))


@query(f"""WITH {EVIDENCE}, t AS (SELECT item_id, rank, citation, replace(trim(text, ' ' || chr(9) || chr(10) || chr(13)), chr(10), ' ') AS line FROM evidence)
SELECT b.item_id, 'QUESTION: ' || b.text || chr(10) || chr(10) || string_agg('[' || rank || '] ' || citation || chr(10) || '    ' || CASE WHEN length(line) > 800 THEN rtrim(left(line, 800)) || ' …' ELSE line END, chr(10) || chr(10) ORDER BY rank) || chr(10) AS text FROM benchmark b JOIN t USING (item_id) GROUP BY b.item_id, b.text""")
def evidence_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evd.evidence_text(_evidence(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query(f"""WITH {EVIDENCE} {CONTEXT.replace("1200", "1800")} SELECT b.item_id, '{evd.INSTRUCTION}' || chr(10) || chr(10) || '# EVIDENCE' || chr(10) || coalesce(string_agg('[C' || place || '] #' || doc_id || chr(10) || c.text, chr(10) ORDER BY place), '') || chr(10) || chr(10) || '# QUESTION' || chr(10) || b.text || chr(10) || chr(10) || '# ANSWER' AS prompt
FROM benchmark b LEFT JOIN chosen c USING (item_id) GROUP BY b.item_id, b.text""")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evd.prompts(evd.context(_evidence(spark, sf_dir)), table(spark, sf_dir, "benchmark"))


@query(rf"""WITH {EVIDENCE} {ANSWERS}, m AS (SELECT item_id, list_distinct(regexp_extract_all(answer, '\[([CK][0-9]+)\]', 1)) AS marks FROM answers), u AS (SELECT item_id, unnest(regexp_extract_all(answer, '\[([CK][0-9]+)\]', 1)) AS mark, unnest(range(len(regexp_extract_all(answer, '\[([CK][0-9]+)\]', 1)))) AS pos FROM answers),
f AS (SELECT item_id, mark, min(pos) AS pos FROM u WHERE mark <> 'C2' GROUP BY ALL) SELECT item_id, mark, CAST(row_number() OVER (PARTITION BY item_id ORDER BY pos) AS INTEGER) AS place FROM f""")
def used_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The citations that answers use, where the index has all but the second."""
    said = stored(evd.answers(evd.best_sentences(evd.context(_evidence(spark, sf_dir)), table(spark, sf_dir, "benchmark"))))
    index = said.select("item_id", F.explode("valid").alias("mark")).where("mark != 'C2'")
    return evd.used_citations(said, index).select("item_id", "mark", "place")


GRAPH_CONTEXT = f"""{EXPANDED}, top_concepts AS (SELECT query AS item_id, canonical AS concept, round(score, 4) AS score, hop FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, node) AS place FROM expanded) JOIN lexicon ON concept_id = node WHERE place <= 15),
numbered AS (SELECT *, row_number() OVER (PARTITION BY item_id, hop = 0 ORDER BY round(score, 9) DESC, concept) AS nth, least(2, sum(CASE WHEN hop > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY item_id)) AS kept FROM top_concepts),
context_rows AS (SELECT item_id, concept, hop, CAST(row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN hop = 0 THEN 0 ELSE 1 END, nth) AS INTEGER) AS place FROM numbered WHERE CASE WHEN hop = 0 THEN nth <= 8 - kept ELSE nth <= kept END)"""


def _graph_context(spark: SparkSession, linked: tuple[DataFrame, DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """Concepts of the contexts, from what _linked() gives; their sources are not looked up."""
    _, edges, provenance, seeds = linked
    concepts = lexicon(spark).select("concept_id", "canonical", F.lit(1.0).alias("confidence"))
    return stored(evd.context_concepts(gr.graph_evidence(gr.expansion(seeds, gr.concept_relations(edges)), concepts, provenance).drop("sources")))


@query(f"WITH {HYBRID}, {GRAPH_CONTEXT} SELECT item_id, concept, hop, place FROM context_rows")
def context_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts that go into a context: the query's own, and two places for those reached over edges."""
    return _graph_context(spark, _linked(spark, sf_dir)).select("item_id", "concept", "hop", "place")


@query(f"""WITH {EVIDENCE} {ANSWERS}, {GRAPH_CONTEXT}, leads AS (SELECT item_id, string_agg(concept || ' [K' || place || ']', ', ' ORDER BY place) AS lead FROM context_rows WHERE place <= 3 GROUP BY 1), marks AS (SELECT item_id, string_agg('K' || place, ',' ORDER BY place) AS k FROM context_rows GROUP BY 1)
SELECT b.item_id, CASE WHEN answer IS NULL THEN '{evd.NO_ANSWER}' WHEN lead IS NULL THEN answer ELSE 'Key concepts: ' || lead || '. ' || answer END AS answer, CASE WHEN answer IS NULL THEN '' ELSE concat_ws(',', array_to_string(valid, ','), k) END AS valid FROM benchmark b LEFT JOIN answers USING (item_id) LEFT JOIN valid USING (item_id) LEFT JOIN leads USING (item_id) LEFT JOIN marks USING (item_id)""")
def graph_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that begin with the context's concepts. Evidence is the first rows of the candidates that concepts are linked by: one ranking is made."""
    items, linked = table(spark, sf_dir, "benchmark"), _linked(spark, sf_dir)
    best = evd.best_sentences(evd.context(evd.evidence_rows(linked[0], table(spark, sf_dir, "documents"))), items)
    return evd.answers(best, concepts=_graph_context(spark, linked), queries=items).select("item_id", "answer", F.array_join("valid", ",").alias("valid"))


@query(f"WITH {HYBRID}, {GRAPH_CONTEXT} SELECT item_id, count(*) AS concepts, CAST(sum(CASE WHEN hop > 0 THEN 1 ELSE 0 END) AS BIGINT) AS steps FROM context_rows GROUP BY 1")
def context_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many concepts and steps between concepts each context has."""
    chosen = _graph_context(spark, _linked(spark, sf_dir))
    steps = evd.relations(chosen).groupBy("item_id").agg(F.count("*").alias("steps"))
    return chosen.groupBy("item_id").agg(F.count("*").alias("concepts")).join(steps, "item_id", "left").fillna(0, ["steps"])


@query(f"""WITH {MENTIONS} SELECT * FROM (SELECT 'resource' AS found, CAST(resource_id AS VARCHAR) AS ref, title AS label FROM res WHERE contains(lower(title), 'the') ORDER BY resource_id LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'concept', concept_id, canonical FROM lexicon WHERE concept_id IN (SELECT concept_id FROM aliases WHERE contains(alias, 'the')) ORDER BY concept_id LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'evidence', CAST(doc_id AS VARCHAR), source FROM documents ORDER BY doc_id LIMIT 10)""")
def unified_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resources, concepts and evidence for one text."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ref"), F.col("source").alias("label"), F.col("doc_id").alias("rank"))
    return cp.unified_search("The", resources(spark, sf_dir), lexicon(spark), rows)


@query(f"SELECT role, count(*) AS rows, round(avg(CASE WHEN {ROUTE_SQL} = 'tutor' THEN 1.0 ELSE 0.0 END), 6) AS to_tutor, round(avg(CASE WHEN length(text) > 100 THEN 1.0 ELSE 0.0 END), 6) AS long FROM conversations GROUP BY 1")
def routing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What share of turns goes to the tutor, and is long."""
    return ev.rates(table(spark, sf_dir, "conversations"), "role", to_tutor=routed(F.col("text")) == "tutor", long=F.length("text") > 100)


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def latency_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.latencies(table(spark, sf_dir, "events"), "event_type", "value")


@query(f"SELECT {ROUTE_SQL} AS route, role, count(*) AS turns, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY ALL")
def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many turns of each role, and of how many conversations, go by each route."""
    return table(spark, sf_dir, "conversations").groupBy(routed(F.col("text")).alias("route"), "role").agg(F.count("*").alias("turns"), F.countDistinct("conv_id").alias("conversations"))
