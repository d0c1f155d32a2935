"""Queries over files, kept tables, sources and confidence gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions.library import safe_calculation
from tessera.operators import evidence as evd
from tessera.operators import research as rs
from tessera.operators import retrieval as r
from tessera.plans.registry import query
from tessera.plans.retrieval import HYBRID
from tessera.session import table
from tessera.sources import files as fl
from tessera.sources import tables as tb
from tessera.storage import stored

PATHS = "'/data/' || lang || '/' || source || '/Week ' || (doc_id % 12 + 1) || '/doc ' || (doc_id % 40) || CASE WHEN doc_id % 9 = 0 THEN '.csv' WHEN doc_id % 10 = 0 THEN '.tmp' WHEN doc_id % 11 = 0 THEN '.exe' ELSE '.md' END"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: where each would lie, and its length."""
    end = F.when(F.col("doc_id") % 9 == 0, ".csv").when(F.col("doc_id") % 10 == 0, ".tmp").when(F.col("doc_id") % 11 == 0, ".exe").otherwise(".md")
    path = F.concat(F.lit("/data/"), "lang", F.lit("/"), "source", F.lit("/Week "), (F.col("doc_id") % 12 + 1).cast("string"), F.lit("/doc "), (F.col("doc_id") % 40).cast("string"), end)
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.length("text").cast("bigint").alias("length"))


@query(f"""SELECT doc_id, CASE WHEN regexp_matches(string_split(path, '/')[-1], '^[.~]|\\.tmp$|^Thumbs\\.db$') THEN 'SKIP' WHEN path LIKE '%.md' THEN 'COPY' WHEN path LIKE '%.csv' THEN 'COPY_DATASET' ELSE 'QUARANTINE' END AS disposition,
'w' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') AS module FROM (SELECT doc_id, {PATHS} AS path FROM documents)""")
def import_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    module = fl.module_slug(F.element_at(F.split("path", "/"), -2))
    return _paths(spark, sf_dir).select("doc_id", fl.disposition(F.col("path")).alias("disposition"), module.alias("module"))


@query(f"""WITH p AS (SELECT doc_id, {PATHS} AS path, lang, source FROM documents), b AS (SELECT *, lang || '.' || source || '.week-' || (doc_id % 12 + 1) || '.doc-' || (doc_id % 40) AS base FROM p WHERE path LIKE '%.md' OR path LIKE '%.csv'),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY path, doc_id) AS n FROM b) SELECT base AS resource, count(*) AS files, CAST(max(n) AS INTEGER) AS last FROM n GROUP BY 1""")
def file_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fl.classified(_paths(spark, sf_dir), "/data")
    suffix = F.regexp_extract("resource_id", r"^(.*?doc-\d+)(?:-(\d+))?$", 2)
    named = found.select(F.regexp_extract("resource_id", r"^(.*?doc-\d+)(?:-(\d+))?$", 1).alias("resource"), F.when(suffix == "", 1).otherwise(suffix.try_cast("int")).alias("n"))
    return named.groupBy("resource").agg(F.count("*").alias("files"), F.max("n").alias("last"))


@query(f"SELECT path, CASE WHEN path LIKE '%.tmp' OR path LIKE '%.exe' THEN 'error: ending' ELSE 'warning: empty' END AS issues FROM (SELECT {PATHS} AS path, length(text) AS n FROM documents) WHERE path LIKE '%.tmp' OR path LIKE '%.exe' OR n = 0")
def file_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.file_issues(_paths(spark, sf_dir)).select("path", F.array_join("issues", ",").alias("issues"))


@query("""WITH new AS (SELECT c_custkey, c_name || '!' AS c_name, c_acctbal FROM customer WHERE c_nationkey = 3), gone AS (SELECT c_custkey FROM customer WHERE c_nationkey = 4)
SELECT c_custkey, c_name, c_acctbal FROM (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM new) UNION ALL SELECT * FROM new) WHERE c_custkey NOT IN (SELECT c_custkey FROM gone)""")
def upsert_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer")
    new = old.where("c_nationkey = 3").select("c_custkey", F.concat("c_name", F.lit("!")).alias("c_name"), "c_acctbal")
    whole = tb.upserted(old.select("c_custkey", "c_name", "c_acctbal"), new, ["c_custkey"])
    return tb.deleted(whole, old.where("c_nationkey = 4"), ["c_custkey"])


@query("SELECT vec_id FROM embeddings WHERE len(embedding) = 64")
def vector_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.valid_vectors(table(spark, sf_dir, "embeddings"), "embedding", 64).select("vec_id")


@query("SELECT doc_id, length(text) AS value FROM documents")
def value_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths by a cache that knows the English texts."""
    docs = table(spark, sf_dir, "documents")
    known = docs.where("lang = 'en'").select(F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.lit("v1").alias("version"), F.length("text").cast("bigint").alias("value")).dropDuplicates(["digest"])
    return tb.cached(docs, known, "text", "v1", F.length("text").cast("bigint"))[0].select("doc_id", "value")


_PAGE = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"



def _case(column: str, values: dict[str, float], otherwise: str, like: bool = False) -> str:
    return " ".join(f"WHEN {column} LIKE '%.{k}' THEN {v}" if like else f"WHEN {column} = '{k}' THEN {v}" for k, v in values.items()) + otherwise


SEARCH = rf"""page_texts AS (SELECT page_id, url, {_PAGE} AS text, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages),
page_words AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: length(x) > 2)) AS term FROM benchmark),
page_hits AS (SELECT item_id, page_id, CAST(sum((length(lower(text)) - length(replace(lower(text), term, ''))) // length(term)) AS BIGINT) AS hits FROM page_words, page_texts WHERE contains(lower(text), term) GROUP BY ALL),
found_pages AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, page_id) AS INTEGER) AS rank FROM page_hits)"""
TRUST = rf"""hosts AS (SELECT *, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '^www\.', '') AS host, lower(regexp_replace(regexp_replace(url, '/+$', ''), '[?#].*$', '')) AS url_key, title || ' ' || left(text, 200) AS said FROM page_texts),
signs AS (SELECT *, CAST(CASE {_case("host", rs.AUTHORITY, "")} {_case("host", rs.AUTHORITY, "", True)} {_case(r"regexp_extract(host, '([^.]+)\.[^.]+$', 1)", rs.ENDING_AUTHORITY, "")} {_case(r"regexp_extract(host, '\.([^.]+)$', 1)", rs.ENDING_AUTHORITY, "")} ELSE 0.45 END AS DOUBLE) AS authority,
  least(1.0::DOUBLE, 0.4::DOUBLE + 0.15::DOUBLE * len(regexp_extract_all(said, '{rs.TEACHING}'))) AS teaching, least(1.0::DOUBLE, 0.25::DOUBLE * len(regexp_extract_all(said, '{rs.SPAM}'))) AS spam,
  try_strptime(regexp_extract(said, '{rs.DATE}', 1) || '-' || lpad(regexp_extract(said, '{rs.DATE}', 2), 2, '0') || '-01', '%Y-%m-%d') AS dated, host IN ({", ".join(f"'{k}'" for k in rs.AUTHORITY)}) AS listed FROM hosts),
sources AS (SELECT *, round(least(1.0, greatest(0.0, 0.4::DOUBLE * authority + 0.15::DOUBLE * CASE WHEN dated IS NULL THEN 0.5 ELSE least(1.0, greatest(0.0, 1 - datediff('day', dated, TIMESTAMP '2024-06-01') / 1825)) END + 0.2::DOUBLE * teaching + 0.15::DOUBLE * CASE WHEN listed THEN 0.8 WHEN authority >= 0.7 THEN 0.5 ELSE 0.3 END - 0.5::DOUBLE * spam)), 3) AS trust FROM signs)"""
SELECTED = f"""{SEARCH}, {TRUST}, per_item AS (SELECT f.item_id, f.page_id, f.rank, s.trust, row_number() OVER (PARTITION BY f.item_id, s.url_key ORDER BY f.rank) > 1 AS duplicate FROM found_pages f JOIN sources s USING (page_id) WHERE f.rank <= 10),
chosen_pages AS (SELECT * FROM (SELECT item_id, page_id, trust, CAST(row_number() OVER (PARTITION BY item_id ORDER BY trust DESC, rank) AS INTEGER) AS place FROM per_item WHERE NOT duplicate AND trust >= 0.4) WHERE place <= 3)"""
GATED = f"""{HYBRID}, gate_rows AS (SELECT f.item_id, f.rank, coalesce(s.score, 0) AS semantic, coalesce(l.score, 0) AS lexical, d.source FROM fused f JOIN documents d USING (doc_id)
LEFT JOIN (SELECT * FROM sets WHERE rank <= 50) s ON s.item_id = f.item_id AND s.doc_id = f.doc_id LEFT JOIN (SELECT * FROM lexical WHERE rank <= 50) l ON l.item_id = f.item_id AND l.doc_id = f.doc_id WHERE f.rank <= 5),
gate_best AS (SELECT item_id, max(semantic) AS semantic, max(lexical) AS lexical, count(*) AS n FROM gate_rows GROUP BY 1), gate_mode AS (SELECT item_id, max(m) AS m FROM (SELECT item_id, source, count(*) AS m FROM gate_rows GROUP BY ALL) GROUP BY 1),
gate_values AS (SELECT item_id, round(least(1.0, 0.55::DOUBLE * round(semantic, 4) + 0.30::DOUBLE * round(m / n, 4) + 0.15::DOUBLE * round(least(1.0, lexical / 22.0), 4)), 4) AS confidence FROM gate_best JOIN gate_mode USING (item_id)),
gate AS (SELECT item_id, confidence, CASE WHEN confidence >= 0.72 THEN 'high' WHEN confidence >= 0.55 THEN 'medium' ELSE 'low' END AS level, confidence >= 0.7 AS answered FROM gate_values)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), rs.page_text(F.col("html")).alias("text"))
    return pages.withColumn("snippet", F.left("text", F.lit(rs.SNIPPET)))


def gate(items: DataFrame, docs: DataFrame) -> DataFrame:
    """item_id, confidence, level and answered of queries over documents (doc_id, text, source)."""
    counts = r.counted(docs, queries=items)
    sets, lexical = stored(r.set_cosine(items, docs, 50, counts)), stored(r.bm25(items, docs, 50, counts=counts))
    top = r.fused([(sets, r.c.W_DENSE), (lexical, r.c.W_LEXICAL)], 5).select("item_id", "doc_id", "rank")
    both = top.join(sets.select("item_id", "doc_id", F.col("score").alias("semantic")), ["item_id", "doc_id"], "left").join(lexical.select("item_id", "doc_id", F.col("score").alias("lexical")), ["item_id", "doc_id"], "left")
    return rs.confidence(both.fillna(0.0, ["semantic", "lexical"]).join(docs.select("doc_id", "source"), "doc_id"))


def _gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    found = rs.term_search(table(spark, sf_dir, "benchmark"), pages, 10)
    return rs.selected(rs.scored_sources(found.join(pages, "page_id"), "2024-06-01", by="item_id", order="rank"), order="rank").select("item_id", "page_id", "place", "trust")


@query(f"WITH {SEARCH} SELECT item_id, page_id, hits, rank FROM found_pages WHERE rank <= 6")
def page_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.term_search(table(spark, sf_dir, "benchmark"), _pages(spark, sf_dir))


@query(f"WITH {SEARCH.split(',' + chr(10))[0]}, {TRUST} SELECT page_id, host AS domain, url_key, authority, trust, row_number() OVER (PARTITION BY url_key ORDER BY page_id) > 1 AS duplicate FROM sources")
def source_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each page's source is trusted, and whether an earlier page is the same."""
    return rs.scored_sources(_pages(spark, sf_dir), "2024-06-01").select("page_id", "domain", "url_key", "authority", "trust", "duplicate")


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '^www\\.', '') AS domain FROM pages")
def url_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.domain(F.col("url")).alias("domain"))


@query(f"WITH {SELECTED} SELECT item_id, page_id, place, trust FROM chosen_pages")
def source_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the pages found for each passage the most trusted ones."""
    return _selected(spark, sf_dir)


@query(f"WITH {GATED} SELECT * FROM gate")
def confidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gate(spark, sf_dir)


@query(f"""WITH {GATED}, {SELECTED}, asked_web AS (SELECT c.* FROM chosen_pages c JOIN gate g ON g.item_id = c.item_id WHERE NOT answered),
kept_rows AS (SELECT item_id, 'kept' AS origin, CAST(doc_id AS VARCHAR) AS ref, round(least(1.0, greatest(0.0, 0.5 * CASE WHEN most > 0 THEN score / most ELSE 0 END + 0.5 * (1 - (rank - 1) / 10))), 6) AS confidence FROM (SELECT *, max(score) OVER (PARTITION BY item_id) AS most FROM fused WHERE rank <= 10)),
both_rows AS (SELECT * FROM kept_rows UNION ALL SELECT item_id, 'web', CAST(page_id AS VARCHAR), trust FROM asked_web), ranked_rows AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY confidence DESC, origin, ref) AS rank FROM both_rows),
lists AS (SELECT item_id, string_agg(origin || ':' || ref, ',' ORDER BY rank) AS evidence FROM ranked_rows WHERE rank <= 10 GROUP BY 1), n AS (SELECT item_id, count(*) AS sources FROM asked_web GROUP BY 1)
SELECT item_id, confidence, level, coalesce(sources, 0) > 0 AS used_web, false AS approved, coalesce(sources, 0) AS sources, evidence FROM gate LEFT JOIN lists USING (item_id) LEFT JOIN n USING (item_id)""")
def research_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that the corpus does not answer well enough go on to kept pages, whose evidence is merged."""
    docs = table(spark, sf_dir, "documents")
    kept = evd.evidence_rows(r.hybrid(table(spark, sf_dir, "benchmark"), docs), docs).select("item_id", F.col("doc_id").cast("string").alias("ref"), "confidence")
    web = _selected(spark, sf_dir).select("item_id", F.col("page_id").cast("string").alias("ref"), F.col("trust").alias("confidence"))
    return rs.researched(stored(_gate(spark, sf_dir)), stored(kept), stored(web)).withColumn("evidence", F.array_join("evidence", ","))


@query("""SELECT count(*) AS sessions, CAST(sum(CASE WHEN turn > 1 THEN 1 ELSE 0 END) AS BIGINT) AS web_triggered, CAST(sum(CASE WHEN turn > 3 THEN 1 ELSE 0 END) AS BIGINT) AS approved, CAST(sum(CASE WHEN turn > 1 THEN 1 ELSE 0 END) - sum(CASE WHEN turn > 3 THEN 1 ELSE 0 END) AS BIGINT) AS rejected, CAST(sum(CASE WHEN turn > 3 THEN 2 ELSE 0 END) AS BIGINT) AS resources_ingested FROM conversations""")
def research_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as research sessions: later ones went to the web, the last were approved with two resources each."""
    turn = F.col("turn")
    return rs.session_statistics(table(spark, sf_dir, "conversations").select((turn > 1).alias("used_web"), (turn > 3).alias("approved"), F.when(turn > 3, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("ingested")))


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[\\x{0600}-\\x{06FF}]') THEN 'ar' ELSE 'en' END AS language FROM conversations")
def query_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", rs.query_language(F.col("text")).alias("language"))


@query(f"SELECT page_id, '# ' || regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) || chr(10) || chr(10) || 'Source: ' || url || chr(10) || chr(10) || trim({_PAGE}) || chr(10) AS markdown FROM pages")
def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", rs.page_markdown(F.col("title"), F.col("url"), F.col("text")).alias("markdown"))


@query("SELECT o_orderkey, o_totalprice * 2 + 1 AS value FROM orders")
def calculator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions made of the orders' prices."""
    text = F.concat(F.col("o_totalprice").cast("string"), F.lit(" * 2 + 1"))
    return table(spark, sf_dir, "orders").select("o_orderkey", safe_calculation(text).alias("value"))
