"""Queries on resources as they come in: places, structure, coverage, stages, validation, kept indexes and test sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import catalog as cat
from tessera.operators import ingest as ig
from tessera.plans.registry import query
from tessera.session import table
from tessera.sources import blocks as bl
from tessera.sources import index as ix
from tessera.storage import scratch, stored

COURSES = [("lang-d", "nontechnical", "german"), ("lang", "technical", "languages")]
_FOLDER = "CASE WHEN doc_id % 7 = 0 THEN 'takeout-20240101T000000Z-1-001/' ELSE '' END || 'Lang-' || lang || '/' || CASE doc_id % 4 WHEN 0 THEN 'Week ' || (doc_id % 12 + 1) || '/' WHEN 1 THEN 'week 0' || (doc_id % 9 + 1) || '/Session ' || (doc_id % 3 + 1) || '/' WHEN 2 THEN 'Extra Stuff/' ELSE '' END || 'f' || doc_id || '.md'"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    wrapper = F.when(i % 7 == 0, "takeout-20240101T000000Z-1-001/").otherwise("")
    folder = F.when(i % 4 == 0, F.concat(F.lit("Week "), i % 12 + 1, F.lit("/"))).when(i % 4 == 1, F.concat(F.lit("week 0"), i % 9 + 1, F.lit("/Session "), i % 3 + 1, F.lit("/"))).when(i % 4 == 2, "Extra Stuff/").otherwise("")
    path = F.concat(F.lit("/data/"), wrapper, F.lit("Lang-"), "lang", F.lit("/"), folder, F.lit("f"), i, F.lit(".md"))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"))


@query(f"""SELECT doc_id, CASE WHEN lang LIKE 'd%' THEN 'nontechnical' ELSE 'technical' END AS track, CASE WHEN lang LIKE 'd%' THEN 'german' ELSE 'languages' END AS course,
CASE doc_id % 4 WHEN 0 THEN 'w' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') WHEN 1 THEN 'w0' || (doc_id % 9 + 1) || '-s' || (doc_id % 3 + 1) WHEN 2 THEN 'extra-stuff' ELSE 'general' END AS module FROM (SELECT *, {_FOLDER} AS path FROM documents)""")
def import_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track, course and module of files by their folders."""
    return ig.located(_files(spark, sf_dir), COURSES, "/data").select("doc_id", "track", "course", "module")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as blocks; the first one is a heading."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text")).where(F.trim("text") != "")
    level = F.when(F.col("n") == 0, F.col("doc_id") % 3 + 1).otherwise(0).cast("int")
    return lines.select("doc_id", "n", F.when(F.col("n") == 0, "heading").otherwise("paragraph").alias("kind"), "text", level.alias("level"))


BLOCKS = "b AS (SELECT doc_id, n, x AS text, CASE WHEN n = 0 THEN 'heading' ELSE 'paragraph' END AS kind, CASE WHEN n = 0 THEN doc_id % 3 + 1 ELSE 0 END AS level FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents) WHERE trim(x) <> '')"



@query(rf"""WITH {BLOCKS}, first AS (SELECT doc_id, min(n) AS n FROM b GROUP BY 1), numbers AS (SELECT doc_id, arg_min(TRY_CAST(regexp_extract(text, '(?i)week\s*0*(\d+)', 1) AS INTEGER), n) FILTER (regexp_matches(text, '(?i)week\s*0*\d')) AS week FROM b GROUP BY 1)
SELECT b.doc_id, CASE WHEN b.doc_id % 2 = 0 THEN CAST(b.doc_id % 12 + 1 AS INTEGER) ELSE any_value(week) END AS week, CASE WHEN b.doc_id % 2 = 0 THEN CAST(b.doc_id % 5 + 1 AS VARCHAR) END AS lecture,
coalesce(array_to_string(list_distinct(list(trim(text) ORDER BY b.n) FILTER (kind = 'heading' AND level <= 2)), '|'), '') AS topics, coalesce(array_to_string(list_distinct(list(trim(text) ORDER BY b.n) FILTER (kind = 'heading' AND level > 2)), '|'), '') AS subtopics FROM b JOIN numbers USING (doc_id) GROUP BY b.doc_id""")
def academic_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Week, lecture and topics of documents; every second one has both numbers in its title."""
    i = F.col("doc_id")
    titles = table(spark, sf_dir, "documents").select("doc_id", F.when(i % 2 == 0, F.concat(F.lit("Week 0"), i % 12 + 1, F.lit(" Lecture "), i % 5 + 1)).otherwise("Notes").alias("title"))
    joined = [F.array_join(c, "|").alias(c) for c in ("topics", "subtopics")]
    return ig.academic_structure(_blocks(spark, sf_dir), titles, "doc_id").where(F.size(F.array_union("topics", "subtopics")) > 0).select("doc_id", "week", "lecture", *joined)


@query(f"""WITH {BLOCKS}, k AS (SELECT doc_id, string_agg(kind || ':' || n, ',' ORDER BY kind || ':' || n) AS by_kind FROM (SELECT doc_id, kind, count(*) AS n FROM b GROUP BY ALL) GROUP BY 1)
SELECT doc_id, count(*) AS blocks, CAST(sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) AS BIGINT) AS headings, CAST(sum(length(text)) AS BIGINT) AS characters, CAST(sum(len(regexp_extract_all(text, '\\S+'))) AS BIGINT) AS words, CAST(greatest(1, round_even(sum(len(regexp_extract_all(text, '\\S+'))) / 200, 0)) AS INTEGER) AS minutes, any_value(by_kind) AS by_kind FROM b JOIN k USING (doc_id) GROUP BY 1""")
def block_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ig.block_statistics(_blocks(spark, sf_dir), "doc_id")


@query()
def page_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which kinds of elements each page has; pages are parsed by a reader, which has no SQL."""
    return ig.coverage(bl.blocks(table(spark, sf_dir, "pages"), "page_id", "html", "html"), "page_id")


@query("""WITH b AS (SELECT doc_id // 8 AS g, CAST(doc_id % 8 AS INTEGER) AS n, CASE WHEN doc_id % 8 = 0 THEN 'heading' WHEN doc_id % 3 = 0 THEN 'code' ELSE 'paragraph' END AS kind, lang, CASE WHEN doc_id % 24 BETWEEN 8 AND 15 THEN CAST(doc_id % 8 + 1 AS INTEGER) END AS page, CASE WHEN doc_id % 48 > 40 THEN CAST(doc_id AS INTEGER) END AS slide FROM documents),
c AS (SELECT g, lang, count(*) AS c FROM b GROUP BY ALL), l AS (SELECT g, lang AS language FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY c DESC, lang DESC) AS k FROM c) WHERE k = 1),
f AS (SELECT g, count(*) FILTER (kind <> 'heading') AS bodies, list_distinct(list(kind) FILTER (kind <> 'heading')) AS kinds, bool_or(kind = 'heading') AS headed, bool_or(slide IS NOT NULL) AS on_slide, min(page) AS page, max(page) AS page_end, arg_min(slide, n) FILTER (slide IS NOT NULL) AS slide, string_agg(n, ',' ORDER BY n) AS block_ids FROM b GROUP BY 1)
SELECT g, CASE WHEN on_slide THEN 'slide' WHEN bodies = 1 THEN kinds[1] WHEN headed THEN 'section' WHEN len(kinds) = 1 THEN kinds[1] ELSE 'mixed' END AS chunk_type, language, page, page_end, slide, block_ids FROM f JOIN l USING (g)""")
def parent_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight documents at a time as a group of blocks: its type, language and place."""
    i, none = F.col("doc_id"), F.lit(None)
    kind = F.when(i % 8 == 0, "heading").when(i % 3 == 0, "code").otherwise("paragraph")
    blocks = table(spark, sf_dir, "documents").select(
        F.floor(i / 8).alias("g"), (i % 8).cast("int").alias("n"), kind.alias("kind"), F.col("lang").alias("language"), F.when((i % 24).between(8, 15), (i % 8 + 1).cast("int")).alias("page"), F.when(i % 48 > 40, i.cast("int")).alias("slide"),
        none.cast("int").alias("cell"), none.cast("double").alias("start"), F.array().cast("array<string>").alias("section"),
    )
    return ig.parent_facts(blocks, ["g"]).select("g", "chunk_type", "language", "page", "page_end", "slide", F.array_join(F.transform("block_ids", lambda x: x.cast("string")), ",").alias("block_ids"))


@query("""SELECT doc_id, CASE WHEN length(text) % 5 = 0 THEN 'FAILED' WHEN lang = 'de' OR doc_id % 11 = 0 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status, CASE WHEN length(text) % 5 = 0 THEN CASE WHEN lang = 'de' THEN 'languages,lengths' ELSE 'lengths' END ELSE concat_ws(',', CASE WHEN lang = 'de' THEN 'languages' END, CASE WHEN doc_id % 11 = 0 THEN 'ids' END) END AS failed,
length(CASE WHEN length(text) % 5 = 0 THEN CASE WHEN lang = 'de' THEN text ELSE upper(text) END ELSE CASE WHEN lang = 'de' THEN text ELSE upper(text) END || CASE WHEN doc_id % 11 = 0 THEN '' ELSE '!' END END) AS n FROM (SELECT * FROM documents WHERE NOT contains(text, 'ß'))""")
def stage_runner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages that fail for some rows: no row fails another, a critical failure ends a row's way."""
    stages = [("languages", lambda x: F.when(F.col("lang") != "de", F.upper(x)), False), ("lengths", lambda x: F.when(F.length("text0") % 5 != 0, x), True), ("ids", lambda x: F.when(F.col("doc_id") % 11 != 0, F.concat(x, F.lit("!"))), False)]
    docs = table(spark, sf_dir, "documents").where(~F.contains("text", F.lit("ß"))).withColumn("text0", F.col("text"))
    return ig.staged(docs, stages, "text").select("doc_id", "status", F.array_join("failed", ",").alias("failed"), F.length("text").cast("bigint").alias("n"))


_ROWS = """r AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN ' ' ELSE source END AS title, 'f' || doc_id AS file_name, CASE WHEN doc_id % 13 = 0 THEN '' ELSE 'h' || doc_id END AS sha256, lang AS language, source <> 'src2' AS known_track, lang <> 'es' AS known_course, doc_id % 19 <> 0 AS on_disk, CASE WHEN doc_id % 23 = 0 THEN 'other' ELSE 'h' || doc_id END AS disk_hash,
CASE WHEN doc_id % 6 = 0 THEN 'ocr' ELSE 'text' END AS extraction_method, CASE WHEN doc_id % 4 = 0 THEN 'not_required' ELSE 'done' END AS ocr_status, CASE WHEN doc_id % 5 = 0 THEN 'indexed' WHEN doc_id % 5 = 1 THEN 'pending' ELSE 'extracted' END AS processing_status, CASE WHEN doc_id % 10 = 0 THEN 'pending' ELSE 'done' END AS embedding_status, CAST(doc_id % 3 AS INTEGER) AS chunk_count, CASE WHEN doc_id % 29 = 0 THEN '9' ELSE '1' END AS schema_version FROM documents)"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as catalog rows, some of which break rules."""
    i = F.col("doc_id")
    h = F.concat(F.lit("h"), i)
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.when(i % 17 == 0, " ").otherwise(F.col("source")).alias("title"), F.concat(F.lit("f"), i).alias("file_name"), F.when(i % 13 == 0, "").otherwise(h).alias("sha256"), F.col("lang").alias("language"), (F.col("source") != "src2").alias("known_track"), (F.col("lang") != "es").alias("known_course"), (i % 19 != 0).alias("on_disk"),
        F.when(i % 23 == 0, "other").otherwise(h).alias("disk_hash"), F.when(i % 6 == 0, "ocr").otherwise("text").alias("extraction_method"), F.when(i % 4 == 0, "not_required").otherwise("done").alias("ocr_status"), F.when(i % 5 == 0, "indexed").when(i % 5 == 1, "pending").otherwise("extracted").alias("processing_status"),
        F.when(i % 10 == 0, "pending").otherwise("done").alias("embedding_status"), (i % 3).cast("int").alias("chunk_count"), F.when(i % 29 == 0, "9").otherwise("1").alias("schema_version"),
    )


@query(f"""WITH {_ROWS}, i AS (SELECT doc_id, list_filter([CASE WHEN trim(title) = '' THEN 'title' END, CASE WHEN sha256 = '' THEN 'no_hash' END, CASE WHEN language NOT IN ('en', 'de', 'fr') THEN 'language' END, CASE WHEN NOT known_track THEN 'track' END, CASE WHEN NOT known_course THEN 'course' END, CASE WHEN NOT on_disk THEN 'file_exists' END, CASE WHEN on_disk AND sha256 <> '' AND disk_hash <> sha256 THEN 'hash_integrity' END,
CASE WHEN extraction_method = 'ocr' AND ocr_status = 'not_required' THEN 'ocr_stage' END, CASE WHEN processing_status = 'indexed' AND embedding_status <> 'done' THEN 'indexed_embeddings' END, CASE WHEN processing_status = 'indexed' AND chunk_count <= 0 THEN 'indexed_chunks' END, CASE WHEN schema_version <> '1' THEN 'schema_version' END], lambda x: x IS NOT NULL) AS issues FROM r)
SELECT doc_id, array_to_string(issues, ',') AS issues, CASE WHEN len(list_filter(issues, lambda x: x NOT IN ('no_hash', 'ocr_stage', 'schema_version'))) > 0 THEN 'INVALID' WHEN len(issues) > 0 THEN 'WARNING' ELSE 'VALID' END AS status FROM i""")
def catalog_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default rules over catalog rows."""
    return cat.validated(_rows(spark, sf_dir), cat.default_rules(["en", "de", "fr"], ["1"])).select("doc_id", F.array_join("issues", ",").alias("issues"), "status")


_CHANGES = "c AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'NEW' WHEN b.doc_id IS NULL THEN 'MISSING' WHEN a.text <> b.text THEN 'MODIFIED' ELSE 'UNCHANGED' END AS status FROM (SELECT doc_id, text FROM documents WHERE source <> 'src2') a FULL JOIN (SELECT doc_id, CASE WHEN lang = 'de' THEN text || '!' ELSE text END AS text FROM documents WHERE source <> 'src3') b ON a.doc_id = b.doc_id)"


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    after = docs.where("source != 'src3'").select("doc_id", F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return cat.changes(docs.where("source != 'src2'"), after, "doc_id", "text")


@query(f"WITH {_CHANGES}, {_ROWS} SELECT doc_id, status, processing_status FROM r LEFT JOIN c USING (doc_id) WHERE status = 'MODIFIED' OR processing_status IN ('pending', 'failed')")
def reprocess_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.reprocessing(_changes(spark, sf_dir), _rows(spark, sf_dir), "doc_id").select("doc_id", "status", "processing_status")


@query(f"WITH {_CHANGES}, {_ROWS} SELECT {', '.join(f"CAST(sum(CASE WHEN status = '{s}' THEN 1 ELSE 0 END) AS BIGINT) AS {s.lower()}" for s in ('NEW', 'MODIFIED', 'UNCHANGED', 'MISSING'))}, (SELECT count(*) FROM r WHERE processing_status IN ('pending', 'failed')) AS needs_status_reprocess FROM c")
def change_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.change_summary(_changes(spark, sf_dir), _rows(spark, sf_dir), "doc_id")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) FILTER (event_type <> 'view') AS last_act, arg_max(value, (ts, event_id)) FILTER (value > 50) AS last_high, count(*) AS changes FROM events GROUP BY 1")
def status_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state that a log of changes leaves: of each field the last value that was set."""
    log = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("last_act"), F.when(F.col("value") > 50, F.col("value")).alias("last_high"))
    return cat.transitions(log, "user_id", ["last_act", "last_high"], ["ts", "event_id"])


@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id, array_to_string(w[CAST(floor(len(w) / 3) AS BIGINT) + 1:CAST(floor(len(w) / 3) AS BIGINT) + 12], ' ') AS query FROM w WHERE len(w) >= 25""")
def known_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A test set of all documents that are long enough, in an order that a seed gives."""
    return ig.known_items(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), 1 << 30).select(F.col("chunk_id").alias("doc_id"), "query")


@query("WITH s AS (SELECT source, least(8, count(*)) AS n FROM documents GROUP BY 1) SELECT source, n FROM s")
def chunk_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each source's documents a sample of eight each has."""
    chosen = ig.sampled(table(spark, sf_dir, "documents").select(F.col("source").alias("resource_id"), F.col("doc_id").alias("chunk_id")), 1 << 30)
    return chosen.groupBy(F.col("resource_id").alias("source")).agg(F.count("*").alias("n"))


def _chunk_index(spark: SparkSession, sf_dir: str) -> str:
    path = scratch(spark)
    docs, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    rows = docs.select(i.alias("chunk_id"), F.concat_ws(".", F.lit("tech"), "lang", "source").alias("resource_id"), F.when(i % 5 == 0, "parent").otherwise("child").alias("kind"), i.alias("seq"), F.when(i % 7 > 0, F.col("text")).alias("text"))
    ix.save_chunks(rows, path)
    return path


@query("SELECT doc_id AS chunk_id, 'tech' AS track, lang AS course, source AS module, CASE WHEN doc_id % 7 > 0 THEN length(text) ELSE 0 END AS n FROM documents WHERE doc_id % 5 > 0")
def chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child chunks from a kept store, with what their resource's id says."""
    rows = ix.chunks(spark, _chunk_index(spark, sf_dir), "child")
    return ig.payload(rows).select("chunk_id", "track", "course", "module", F.length("text").cast("bigint").alias("n"))


@query("""WITH v AS (SELECT vec_id, label, 'r' || (vec_id % 20) AS resource FROM embeddings), c AS (SELECT resource, count(*) AS n FROM v WHERE vec_id % 3 > 0 GROUP BY 1), m AS (SELECT resource, count(*) AS n FROM v WHERE vec_id % 3 > 0 AND vec_id % 20 < 10 GROUP BY 1)
SELECT c.resource AS resource_id, c.n AS child_chunks FROM c LEFT JOIN m USING (resource) WHERE m.n IS NULL OR m.n <> c.n""")
def embedding_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resources whose vectors the kept manifest does not have."""
    path, v = scratch(spark), table(spark, sf_dir, "embeddings")
    rows = stored(v.select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("r"), F.col("vec_id") % 20).alias("resource_id"), F.col("embedding").alias("vector")).where("chunk_id % 3 > 0"))
    ix.save_vectors(rows.where("chunk_id % 20 < 10"), path, "m", "v1", 64)
    counts = rows.groupBy("resource_id").agg(F.count("*").alias("child_chunks"))
    return ix.to_embed(counts, ix.manifest(spark, path, "m"), "v1")


@query("SELECT vec_id AS chunk_id, label FROM embeddings WHERE vec_id % 2 = 0 AND label IN (1, 2) AND vec_id % 3 IN (0, 1)")
def vector_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept vectors with their metadata, by values and by members of arrays."""
    path, v = scratch(spark), table(spark, sf_dir, "embeddings")
    ix.save_vectors(v.select(F.col("vec_id").alias("chunk_id"), F.lit("r").alias("resource_id"), F.col("embedding").alias("vector")), path, "m", "v1", 64)
    about = v.where("vec_id % 2 = 0").select(F.col("vec_id").alias("chunk_id"), F.lit("r").alias("resource_id"), "label", F.array((F.col("vec_id") % 3).cast("string"), F.lit("x")).alias("topics"))
    points = ix.indexed(spark, ix.vectors(spark, path, "m"), about)
    return ix.filtered_points(points, label=[1, 2], topics=["0", "1"]).select("chunk_id", "label")


@query("SELECT doc_id, substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) || '-' || substr(md5(CAST(doc_id AS VARCHAR)), 9, 4) || '-' || substr(md5(CAST(doc_id AS VARCHAR)), 13, 4) || '-' || substr(md5(CAST(doc_id AS VARCHAR)), 17, 4) || '-' || substr(md5(CAST(doc_id AS VARCHAR)), 21, 12) AS point_id, strftime(to_timestamp(doc_id * 86400), '%Y-%m-%dT%H:%M:%SZ') AS made FROM documents")
def point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable ids, and times in ISO form."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.point_id(F.col("doc_id").cast("string")).alias("point_id"), tx.iso_time(F.col("doc_id") * 86400).alias("made"))


@query("SELECT page_id, 'https' AS scheme FROM pages WHERE url LIKE 'https:%'")
def existing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which page ids are there among those of secure pages."""
    pages = table(spark, sf_dir, "pages")
    return cat.existing(pages.select("page_id"), pages.where(F.col("url").startswith("https:")), "page_id").withColumn("scheme", F.lit("https"))


@query("""WITH f AS (SELECT conv_id, turn, text, lag(left(trim(text), 10)) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE trim(text) <> '') SELECT conv_id, turn FROM f WHERE before IS NULL OR left(trim(text), 10) <> before""")
def slide_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that do not begin like the one before."""
    return ig.slide_changes(table(spark, sf_dir, "conversations").withColumn("t", F.col("turn")), "conv_id", 10).select("conv_id", "turn")
