"""Queries over data files, sidecars, SQL statements and tables of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import sql
from tessera.operators import dispatch as dp
from tessera.operators import learner as ln
from tessera.plans.corpus import _pages
from tessera.plans.registry import query
from tessera.session import table
from tessera.sources import datasets as ds
from tessera.sources import sidecars as sc
from tessera.storage import stored


@query("""WITH c AS (SELECT *, '/data/nation-' || c_nationkey || '.csv' AS path FROM customer), f AS (
SELECT path, 'c_custkey' AS "column", 0 AS position, 'bigint' AS type, count(*) AS rows, count(DISTINCT c_custkey) AS "distinct", CAST(min(c_custkey) AS VARCHAR) AS least, CAST(max(c_custkey) AS VARCHAR) AS greatest, round(avg(c_custkey), 6) AS mean FROM c GROUP BY path
UNION ALL SELECT path, 'c_name', 1, 'string', count(*), count(DISTINCT c_name), min(c_name), max(c_name), NULL FROM c GROUP BY path
UNION ALL SELECT path, 'c_mktsegment', 2, 'string', count(*), count(DISTINCT c_mktsegment), min(c_mktsegment), max(c_mktsegment), NULL FROM c GROUP BY path) SELECT * FROM f""")
def dataset_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a data file for each nation, and the profile of its columns."""
    rows = table(spark, sf_dir, "customer")
    line = F.to_csv(F.struct("c_custkey", "c_name", "c_mktsegment"))
    files = rows.groupBy("c_nationkey").agg(F.concat(F.lit("c_custkey,c_name,c_mktsegment\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n")).cast("binary").alias("content"))
    found = ds.profiled(files.select(F.concat(F.lit("/data/nation-"), "c_nationkey", F.lit(".csv")).alias("path"), "content"))
    return found.select("path", "column", "position", "type", "rows", "distinct", "least", "greatest", F.round("mean", 6).alias("mean"))


@query("SELECT 'd' || doc_id AS resource_id, lang AS language, source AS doc_type, '1' AS schema_version, n_chars AS characters, CAST(NULL AS VARCHAR) AS error FROM documents")
def sidecar_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidecars of documents in the first version's names, read as the present version, with a field that it does not know."""
    text = F.to_json(F.struct(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("lang"), F.col("source").alias("type"), F.col("n_chars").alias("characters")))
    rows = sc.parsed(table(spark, sf_dir, "documents").select(text.alias("text")))
    return rows.select("resource_id", "language", "doc_type", "schema_version", F.try_variant_get(F.col("extra")["characters"], "$", "bigint").alias("characters"), "error")


_STATEMENT = """WITH long AS (SELECT * FROM documents WHERE n_chars >= {least}) SELECT lang, source, count(*) AS documents, sum(n_chars) AS characters, count(quality) AS labelled
FROM long LEFT JOIN labels USING (doc_id) WHERE lang <> {lang} GROUP BY lang, source"""


@query(_STATEMENT.format(least="500", lang="'es'"))
def sql_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement with parameters over two named tables."""
    tables = {name: table(spark, sf_dir, name) for name in ("documents", "labels")}
    return sql.run(spark, _STATEMENT.format(least=":least", lang=":lang"), tables, least=500, lang="es")


@query()
def answered_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages as requests of learners, a sixth of them by each route, all answered in one plan; answers are texts made from rankings, which the routes' own queries hold against SQL."""
    events = ln.learner_events(table(spark, sf_dir, "events"))
    docs = table(spark, sf_dir, "documents")
    n = F.col("item_id") % 6
    start = F.when(n == 0, "explain ").when(n == 1, "quiz me on ").when(n == 2, "make a study plan for ").when(n == 3, "search the web for ").when(n == 4, "research ").otherwise("save this ")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("request_id"), (F.col("item_id") % 150).alias("student"), F.concat(start, "text").alias("text"), F.lit(None).cast("string").alias("concept"))
    known = stored(ln.mastery(events).select("student", "concept", "mastery"))
    services = dp.Services(docs, known, _pages(spark, sf_dir), "2024-06-01")
    return dp.dispatched(asked, dp.parts(services)).select("request_id", "route", "status", "output", F.array_join("tools", ",").alias("tools"))
