"""Queries over the state of the knowledge base, what queries touch, learning curves and embedders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graph_retrieval as gr
from tessera.operators import ingest as ig
from tessera.operators import learner as ln
from tessera.operators import overview as ov
from tessera.operators.retrieval import hash_embedding
from tessera.plans.analytics import LOG
from tessera.plans.concepts import EXPANDED, HYBRID, _linked
from tessera.plans.registry import query
from tessera.session import table
from tessera.sources import blocks as bl
from tessera.storage import stored

_MAP = "(SELECT string_agg(v || '=' || n, ',' ORDER BY v) FROM (SELECT {d} AS v, count(*) AS n FROM r GROUP BY 1))"


@query(f"""WITH r AS (SELECT doc_id, source AS course, lang AS language, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'indexed' ELSE 'pending' END AS processing_status, strlen(text) AS bytes FROM documents)
SELECT count(*) AS total_resources, CAST(sum(bytes) AS BIGINT) AS total_bytes, CAST(sum(CASE WHEN processing_status = 'indexed' THEN 1 ELSE 0 END) AS BIGINT) AS indexed, CAST(sum(CASE WHEN processing_status = 'pending' THEN 1 ELSE 0 END) AS BIGINT) AS pending, max(doc_id) AS last_updated,
{_MAP.format(d="course")} AS by_course, {_MAP.format(d="language")} AS by_language, {_MAP.format(d="processing_status")} AS by_status FROM r""")
def knowledge_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roll-up of documents as resources, those with labels indexed."""
    done = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("done", F.lit(True))
    rows = table(spark, sf_dir, "documents").join(done, "doc_id", "left")
    rows = rows.select(F.col("source").alias("course"), F.col("lang").alias("language"), F.when(F.col("done"), "indexed").otherwise("pending").alias("processing_status"), F.octet_length("text").alias("bytes"), F.col("doc_id").alias("updated_at"))
    text = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    out = ov.knowledge_status(rows, ("course", "language", "processing_status"))
    return out.select("total_resources", "total_bytes", "indexed", "pending", "last_updated", text("by_course").alias("by_course"), text("by_language").alias("by_language"), text("by_processing_status").alias("by_status"))


@query(f"WITH {HYBRID}, {EXPANDED} SELECT node, count(DISTINCT query) AS queries, CAST(min(hop) AS INTEGER) AS hop, round(max(score), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, node) AS place FROM expanded) WHERE place <= 60 GROUP BY 1")
def touched_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every concept that some passage's expansion reaches."""
    _, edges, _, seeds = _linked(spark, sf_dir)
    reached = gr.expansion(seeds, gr.concept_relations(edges))
    return ov.touched_nodes(reached, reached.columns[0]).select("node", "queries", F.col("hop").cast("int").alias("hop"), F.round("score", 6).alias("score"))


@query(f"""WITH {LOG}, l AS (SELECT student, concept, list({{'s': score, 'd': difficulty}} ORDER BY ts, event_id) AS x FROM log GROUP BY ALL),
s AS (SELECT student, concept, unnest(range(len(x) + 1)) AS n, x FROM l)
SELECT student, concept, CAST(n AS INTEGER) AS n, round(1e-9 + list_reduce(list_prepend(CAST(0.3 AS DOUBLE), list_transform(x[1:n], lambda e: CASE WHEN e.s IS NULL THEN CAST(-1 AS DOUBLE) ELSE e.s * 1000 + e.d END)),
lambda m, e: least(1.0, greatest(0.0, CASE WHEN e < 0 THEN m + 0.05 * (1 - m) ELSE m + 0.25 * (0.5 + (e - CASE WHEN e >= 1000 THEN 1000 ELSE 0 END)) * (CASE WHEN e >= 1000 THEN 1 ELSE 0 END - m) END))), 6) AS mastery FROM s""")
def learning_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mastery of every learner and concept after each of their events."""
    curves = ov.learning_curves(ln.learner_events(table(spark, sf_dir, "events")))
    return curves.select("student", "concept", "n", F.round(F.col("mastery") + 1e-9, 6).alias("mastery"))  # halves are rounded alike everywhere


@query()
def embedder_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature hashing in two sizes: how well documents of one language lie together, and how many have one of theirs as the nearest among all."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("lang").alias("label"), "text")
    return ov.compared_embedders(docs, {f"hashing-{d}": hash_embedding(F.col("text"), d) for d in (64, 384)})


@query("""SELECT page_id, true AS hierarchy, true AS anchors, true AS provenance, regexp_extract(html, '<html lang="([a-z]*)"', 1) <> '' AS language, false AS academic, false AS pages, false AS slides, false AS timestamps FROM pages""")
def page_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of pages: where their text comes from, their language, and which kinds of places they have."""
    pages = table(spark, sf_dir, "pages")
    known = pages.select("page_id", F.lit("html").alias("extraction_method"), F.regexp_extract("html", '<html lang="([a-z]*)"', 1).alias("language"), F.lit(None).cast("int").alias("week"), F.lit(None).cast("array<string>").alias("topics"))
    return ig.coverage(stored(bl.blocks(pages, "page_id", "html", "html")), "page_id", known).select("page_id", "hierarchy", "anchors", "provenance", "language", "academic", "pages", "slides", "timestamps")
