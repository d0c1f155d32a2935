"""Catalog analytics: statistics, filters, changes, versions, validation, inventories, routing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a request is routed by, in order.
ROUTES = [
    ("quiz", ["quiz", "test me", "ask me", "practice question", "question me", "mcq", "multiple choice", "true or false", "assessment", "exam question", "give me questions"]),
    ("planner", ["study plan", "learning plan", "revision plan", "study schedule", "study roadmap", "study timeline", "plan my", "plan for", "make a plan", "create a plan", "build a plan", "roadmap", "road map", "schedule", "timeline", "curriculum", "learning path", "prepare for", "day plan", "week plan", "weekly plan", "daily plan"]),
    ("curator", ["save this", "ingest", "add to knowledge", "add to the knowledge base", "curate", "remember this page", "save to knowledge"]),
    ("web_research", ["search the web", "web sources", "find online", "look online", "on the web", "web search", "google", "from the internet", "online sources"]),
    ("research", ["find resources", "resources", "papers", "literature", "documentation", "articles", "reading list", "citations", "research", "latest", "recent advances", "look up", "find out about", "read about", "sources on"]),
]


def statistics(df: DataFrame, dimensions: list[str]) -> DataFrame:
    """dimension, value and n: counts by each of several columns in one pass; null and empty values as unknown."""
    pairs = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.coalesce(F.nullif(F.col(d).cast("string"), F.lit("")), F.lit("unknown")).alias("value")) for d in dimensions)))
    return df.select(pairs.alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


def filtered(df: DataFrame, allowed: set[str], **criteria: object) -> DataFrame:
    """Rows that equal all criteria; a column that isn't allowed is an error."""
    if unknown := set(criteria) - allowed:
        raise ValueError(f"no such filter: {', '.join(sorted(unknown))}")
    return df.where(reduce(lambda a, b: a & b, (F.col(k) == v for k, v in criteria.items()), F.lit(True)))


def search(df: DataFrame, text: str, columns: list[str], key: str, limit: int = 50) -> DataFrame:
    """The first rows by key whose columns contain the text in any case."""
    return df.where(reduce(lambda a, b: a | b, (F.lower(c).contains(text.lower()) for c in columns))).orderBy(key).limit(limit)


def changes(before: DataFrame, after: DataFrame, key: str, content: str) -> DataFrame:
    """key and status: NEW, MISSING, MODIFIED or UNCHANGED between two states, by digests of the content."""
    digest = lambda df, name: df.select(key, F.sha2(F.coalesce(F.col(content), F.lit("")).cast("binary"), 256).alias(name))
    both = digest(before, "old").join(digest(after, "new"), key, "full_outer")
    status = F.when(F.col("old").isNull(), "NEW").when(F.col("new").isNull(), "MISSING").when(F.col("old") != F.col("new"), "MODIFIED").otherwise("UNCHANGED")
    return both.select(key, status.alias("status"))


def latest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key, with the number of its versions."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("nth", nth).withColumn("versions", F.count("*").over(Window.partitionBy(*by))).where("nth = 1").drop("nth")


def reprocessing(changes_: DataFrame, statuses: DataFrame, key: str) -> DataFrame:
    """key, status and processing_status of what must be processed again: modified content, or processing pending or failed."""
    both = statuses.select(key, "processing_status").join(changes_.select(key, "status"), key, "left")
    return both.where((F.col("status") == "MODIFIED") | F.col("processing_status").isin("pending", "failed"))


def change_summary(changes_: DataFrame, statuses: DataFrame, key: str) -> DataFrame:
    """One row: how many are new, modified, unchanged and missing, and how many await processing."""
    n = changes_.agg(*(F.sum((F.col("status") == s).cast("bigint")).alias(s.lower()) for s in ("NEW", "MODIFIED", "UNCHANGED", "MISSING")))
    waiting = statuses.agg(F.sum(F.col("processing_status").isin("pending", "failed").cast("bigint")).alias("needs_status_reprocess"))
    return n.join(waiting, F.lit(True))  # one row each


def transitions(log: DataFrame, key: str, fields: list[str], order: list[str]) -> DataFrame:
    """The state of each key after all entries of a log of changes: of each field the last value that is not null."""
    last = lambda f: F.max_by(f, F.when(F.col(f).isNotNull(), F.struct(*order))).alias(f)
    return log.groupBy(key).agg(*map(last, fields), F.count("*").alias("changes"))


def existing(keys: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """The keys that df has."""
    return keys.join(df.select(key).distinct(), key, "left_semi")


def flat(df: DataFrame, nested: dict[str, str]) -> DataFrame:
    """Fields of structs as columns of their own: name to path."""
    return df.select("*", *(F.col(path).alias(name) for name, path in nested.items()))


def default_rules(languages: list[str], versions: list[str]) -> dict[str, tuple[str, Column]]:
    """The rules of a catalog row, in order: what must be filled in, languages, taxonomy (known_track, known_course), the file on disk (on_disk, disk_hash), stages that agree with each other, the schema's version."""
    filled = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) != ""
    indexed = F.col("processing_status") == "indexed"
    return {
        "title": ("error", filled("title")), "file_name": ("error", filled("file_name")), "no_hash": ("warning", filled("sha256")), "language": ("error", F.col("language").isin(languages)),
        "track": ("error", F.col("known_track")), "course": ("error", F.col("known_course")), "file_exists": ("error", F.col("on_disk")),
        "hash_integrity": ("error", ~F.col("on_disk") | ~filled("sha256") | (F.col("disk_hash") == F.col("sha256"))), "ocr_stage": ("warning", ~((F.col("extraction_method") == "ocr") & (F.col("ocr_status") == "not_required"))),
        "indexed_embeddings": ("error", ~indexed | (F.col("embedding_status") == "done")), "indexed_chunks": ("error", ~indexed | (F.col("chunk_count") > 0)), "schema_version": ("warning", F.col("schema_version").isin(versions)),
    }


def validated(df: DataFrame, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add issues (names of broken rules, in order) and status: INVALID with a broken error rule, WARNING with another, else VALID. rules: name to (severity, condition that must hold)."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, (_, ok) in rules.items())))
    errors = F.array(*(F.lit(n) for n, (severity, _) in rules.items() if severity == "error"))
    status = F.when(F.arrays_overlap("issues", errors), "INVALID").when(F.size("issues") > 0, "WARNING").otherwise("VALID")
    return df.withColumn("issues", broken).withColumn("status", status)


def routed(text: Column) -> Column:
    """The first route with a word of its own in the text, else tutor."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit("tutor")
    for route, words in reversed(ROUTES):
        out = F.when(reduce(lambda a, b: a | b, (low.contains(w) for w in words)), route).otherwise(out)
    return out
