"""Queries over files taken in, indexes that grow by batches, and feeds of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import research as rs
from tessera.plans.corpus import GATED, SELECTED, _pages, _selected, gate
from tessera.plans.registry import query
from tessera.plans.retrieval import BM25, OUT
from tessera.session import table
from tessera.sources import feed, tree, versions
from tessera.storage import scratch, stored


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text files and conversations as transcripts: path, length and content."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("/"), "source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("content"))
    turn = F.struct(F.col("turn").cast("double").alias("start"), "text")
    talks = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.array_sort(F.collect_list(turn))).cast("binary").alias("content"))
    files = docs.unionByName(talks.select(F.concat(F.lit("/talks/"), "conv_id", F.lit(".json")).alias("path"), "content"))
    return files.select("path", F.octet_length("content").cast("bigint").alias("length"), "content")


@query(r"""SELECT '/' || source || '/' || doc_id || '.txt' AS path, 'txt' AS kind, 'SUCCESS' AS status, 1 AS attempts, CAST(len(list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda x: regexp_matches(x, '\S'))) AS INTEGER) AS blocks FROM documents WHERE text <> ''
UNION ALL SELECT '/talks/' || conv_id || '.json', 'json', 'SUCCESS', 1, CAST(count(*) AS INTEGER) FROM conversations GROUP BY conv_id""")
def ingested_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file with the loader that its ending chooses, its outcome and its number of blocks."""
    return tree.loaded(_files(spark, sf_dir)).where("length > 0").select("path", "kind", "status", "attempts", F.size("blocks").alias("blocks"))


@query()
def ingested_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as HTML files: outcomes, blocks by kind, and links."""
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("/pages/"), "page_id", F.lit(".html")).alias("path"), F.octet_length("html").cast("bigint").alias("length"), F.col("html").cast("binary").alias("content"))
    files = stored(tree.loaded(pages))
    n = lambda kind: F.size(F.filter("blocks", lambda b: b["kind"] == kind))
    links = F.size(F.array_distinct(F.flatten(F.transform("blocks", lambda b: b["links"]))))
    return files.select("path", "status", "warning", F.size("blocks").alias("blocks"), n("heading").alias("headings"), n("paragraph").alias("paragraphs"), links.alias("links"))


@query(f"WITH {BM25.replace('{where}', '')} {OUT.format(name='lexical', k=10)}")
def incremental_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents taken in language by language, the first batch with some to be replaced later and the last batch twice, ranked as if they had come at once."""
    docs, root = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("resource_id"), F.col("source").alias("title"), "text", "lang"), scratch(spark)
    english = docs.where("lang = 'en'")
    drafts = docs.where("lang = 'de'").withColumn("text", F.concat(F.lit("draft "), F.reverse("text")))
    versions.take_in(spark, root, english.unionByName(drafts), 0)
    versions.take_in(spark, root, docs.where("lang = 'de'"), 1)
    versions.take_in(spark, root, docs.where("lang NOT IN ('en', 'de') OR lang IS NULL"), 2)
    versions.take_in(spark, root, docs.where("lang NOT IN ('en', 'de') OR lang IS NULL"), 2)
    found = versions.search(spark, root, table(spark, sf_dir, "benchmark"))
    return found.select("item_id", F.col("chunk_id").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


@query("""WITH was AS (SELECT c_custkey, c_name, c_acctbal FROM customer), new AS (SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN c_name || '!' ELSE c_name END AS c_name, c_acctbal FROM customer WHERE c_nationkey <> 4)
SELECT 1 AS version, 'insert' AS change, * FROM was UNION ALL SELECT 2, 'delete', * FROM was WHERE c_custkey NOT IN (SELECT c_custkey FROM new) UNION ALL SELECT 2, 'update_before', w.* FROM was w JOIN new n USING (c_custkey) WHERE w.c_name <> n.c_name
UNION ALL SELECT 2, 'update_after', n.* FROM was w JOIN new n USING (c_custkey) WHERE w.c_name <> n.c_name""")
def catalog_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream reads of two versions of a catalog, when it is stopped and started between them."""
    rows, root = table(spark, sf_dir, "customer"), scratch(spark)
    first = rows.select("c_custkey", "c_name", "c_acctbal")
    second = rows.where("c_nationkey <> 4").select("c_custkey", F.when(F.col("c_nationkey") == 3, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")).alias("c_name"), "c_acctbal")
    for state in (first, second):
        feed.commit(spark, f"{root}/feed", state, ["c_custkey"])
        stream = feed.follow(spark, f"{root}/feed").writeStream.format("parquet").option("path", f"{root}/read").option("checkpointLocation", f"{root}/at")
        stream.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/read").select(F.col("version").cast("int").alias("version"), "change", "c_custkey", "c_name", "c_acctbal")


AGAIN = f"""before AS (SELECT * FROM (WITH {GATED} SELECT * FROM gate)),
asked_pages AS (SELECT item_id, page_id FROM (WITH {SELECTED} SELECT * FROM chosen_pages) JOIN before USING (item_id) WHERE NOT answered),
approved AS (SELECT page_id, '# ' || title || chr(10) || chr(10) || 'Source: ' || url || chr(10) || chr(10) || trim(text) || chr(10) AS text FROM (WITH {SELECTED} SELECT * FROM page_texts) WHERE page_id IN (SELECT page_id FROM asked_pages)),
known_texts AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, source FROM documents UNION ALL SELECT 'page:' || page_id, text, 'web' FROM approved),
after AS (SELECT * FROM (WITH {GATED.replace("documents", "known_texts")} SELECT * FROM gate))"""


@query(f"""WITH {AGAIN}, n AS (SELECT item_id, count(*) AS pages FROM asked_pages GROUP BY 1)
SELECT b.item_id, b.confidence AS confidence_before, a.confidence AS confidence_after, b.answered AS answered_before, a.answered AS answered_after, coalesce(pages, 0) AS pages FROM before b JOIN after a USING (item_id) LEFT JOIN n USING (item_id)""")
def answered_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries below the gate choose pages, these are taken in beside the documents, and all queries are asked again."""
    items, root = table(spark, sf_dir, "benchmark"), scratch(spark)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "source")
    before = stored(gate(items, table(spark, sf_dir, "documents")))
    chosen = stored(_selected(spark, sf_dir).join(before.where("NOT answered").select("item_id"), "item_id", "left_semi"))
    pages = _pages(spark, sf_dir).join(chosen.select("page_id").distinct(), "page_id", "left_semi")
    versions.take_in(spark, root, docs.select(F.col("doc_id").alias("resource_id"), F.col("source").alias("title"), "text"), 0)
    versions.take_in(spark, root, pages.select(F.concat(F.lit("page:"), "page_id").alias("resource_id"), F.lit("web").alias("title"), rs.page_markdown(F.col("title"), F.col("url"), F.col("text")).alias("text")), 1)
    live = versions.part(spark, root, "chunks").join(versions.part(spark, root, "resources").select("resource_id", "title"), "resource_id")
    after = gate(items, stored(live.select(F.col("chunk_id").alias("doc_id"), "text", F.col("title").alias("source"))))
    out = before.select("item_id", F.col("confidence").alias("confidence_before"), F.col("answered").alias("answered_before"))
    out = out.join(after.select("item_id", F.col("confidence").alias("confidence_after"), F.col("answered").alias("answered_after")), "item_id")
    return out.join(chosen.groupBy("item_id").agg(F.count("*").alias("pages")), "item_id", "left").fillna(0, ["pages"])
