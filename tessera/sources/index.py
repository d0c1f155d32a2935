"""Kept indexes: postings with their statistics, chunks with their texts, vectors with a manifest. Built once, read by many queries.

Postings lie in parts by their term's hash and in order of terms, so a reader that asks for some terms skips the other
parts, and by the statistics of row groups most of these. A document's terms are counted where its text is read; only the
postings move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import constants as c
from tessera.functions.text import term_counts
from tessera.operators.retrieval import query_terms, ranked, scored_terms
from tessera.sources.tables import valid_vectors

#: Parts of the postings, and terms up to which a reader names them to the scan. Documents that share a file of a part.
PARTS, NAMED_TERMS, TOGETHER = 64, 5_000, 100_000


def part_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


def _dealt(rows: DataFrame, n_docs: int) -> DataFrame:
    """Rows by part, and within a part by document, into as many tasks as there are documents for: a part's files grow in number, not in size, and a frequent term's postings lie in several."""
    spread = max(1, -(-n_docs // TOGETHER))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(spread))
    dealt = rows.repartition("part") if spread == 1 else rows.repartition(PARTS * spread, "part", salt)
    return dealt.sortWithinPartitions("part", "term", "doc_id")


def save_postings(docs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write postings (part, term, doc_id, tf, dl) and lengths (doc_id, dl, terms) of documents."""
    counted = docs.select("doc_id", term_counts(F.col("text")).alias("t"))
    sizes = counted.withColumns({"dl": F.aggregate("t", F.lit(0).cast("bigint"), lambda a, x: a + x["tf"]), "terms": F.size("t")})
    rows = sizes.select("doc_id", "dl", F.inline("t")).select(part_of(F.col("term")).alias("part"), "term", "doc_id", "tf", "dl")
    _dealt(rows, docs.count()).write.mode(mode).partitionBy("part").parquet(f"{path}/postings")
    sizes.select("doc_id", "dl", "terms").write.mode(mode).parquet(f"{path}/lengths")


def postings(spark: SparkSession, path: str, asked: DataFrame | None = None) -> DataFrame:
    """The kept postings, or those of the terms asked for (term): up to NAMED_TERMS of them are named to the scan, more meet it in a join."""
    rows = spark.read.parquet(f"{path}/postings")
    if asked is None:
        return rows
    terms = [r[0] for r in asked.select("term").distinct().limit(NAMED_TERMS + 1).collect()]  # a bounded number of words
    if len(terms) <= NAMED_TERMS:
        return rows.where(F.col("term").isin(terms)) if terms else rows.limit(0)
    return rows.join(asked.select("term").distinct().withColumn("part", part_of(F.col("term"))), ["part", "term"], "left_semi")


def lengths(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/lengths")


def statistics(spark: SparkSession, path: str) -> DataFrame:
    """One row: documents with tokens, their mean and total length, and how many terms there are."""
    n = lengths(spark, path).where("dl > 0").agg(F.count("*").alias("documents"), F.avg("dl").alias("mean_length"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_length"))
    return n.join(postings(spark, path).select("term").distinct().agg(F.count("*").alias("vocabulary")), F.lit(True))  # one row each


def bm25(spark: SparkSession, path: str, queries: DataFrame, k: int = c.TOP_K, allowed: DataFrame | None = None) -> DataFrame:
    """item_id, doc_id, score and rank from the kept postings: texts aren't read again."""
    figures = lengths(spark, path).where("dl > 0").agg(F.count("*").alias("n"), F.avg("dl").alias("mean")).first()
    asked = query_terms(queries)
    hits = postings(spark, path, asked).select("doc_id", "term", "tf", "dl")
    return ranked(scored_terms(hits, asked, figures["n"], figures["mean"] or 1.0, allowed), "item_id", "doc_id", k=k)


def add_documents(docs: DataFrame, path: str) -> None:
    """Append new documents' postings and lengths."""
    save_postings(docs, path, "append")


def without_documents(spark: SparkSession, path: str, gone: DataFrame, to: str) -> None:
    """Write the index without some documents (doc_id) to a new folder."""
    keep = lambda df: df.join(gone.select("doc_id").distinct(), "doc_id", "left_anti")
    _dealt(keep(postings(spark, path)), lengths(spark, path).count()).write.partitionBy("part").parquet(f"{to}/postings")
    keep(lengths(spark, path)).write.parquet(f"{to}/lengths")


def save_chunks(chunks: DataFrame, path: str) -> None:
    """Write chunks (chunk_id, resource_id, kind, seq, text and what else) as metadata by kind, and texts apart from them."""
    chunks.drop("text").write.mode("overwrite").partitionBy("kind").parquet(f"{path}/meta")
    chunks.select("chunk_id", "kind", "text").write.mode("overwrite").partitionBy("kind").parquet(f"{path}/text")


def chunk_metadata(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    rows = spark.read.parquet(f"{path}/meta")
    return rows if kind is None else rows.where(F.col("kind") == kind)


def chunk_texts(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    rows = spark.read.parquet(f"{path}/text")
    return (rows if kind is None else rows.where(F.col("kind") == kind)).select("chunk_id", "text")


def chunks(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Metadata with texts; a chunk without a text has an empty one."""
    return chunk_metadata(spark, path, kind).join(chunk_texts(spark, path, kind), "chunk_id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def chunk_counts(spark: SparkSession, path: str) -> DataFrame:
    """Of each resource how many chunks of each kind."""
    rows = chunk_metadata(spark, path)
    n = lambda kind: F.sum((F.col("kind") == kind).cast("bigint")).alias(f"{kind}_chunks")
    return rows.groupBy("resource_id").agg(n("parent"), n("child"))


def save_vectors(vectors: DataFrame, path: str, model: str, version: str, dim: int) -> None:
    """Write valid vectors (chunk_id, resource_id, vector) of a model, and its manifest: of each resource model, version, dim and count."""
    good = valid_vectors(vectors, "vector", dim)
    good.withColumn("model", F.lit(model)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(f"{path}/vectors")
    manifest = good.groupBy("resource_id").agg(F.count("*").alias("n")).select("resource_id", F.lit(version).alias("version"), F.lit(dim).alias("dim"), "n", F.lit(model).alias("model"))
    manifest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(f"{path}/manifest")


def vectors(spark: SparkSession, path: str, model: str) -> DataFrame:
    return spark.read.parquet(f"{path}/vectors").where(F.col("model") == model)


def manifest(spark: SparkSession, path: str, model: str) -> DataFrame:
    return spark.read.parquet(f"{path}/manifest").where(F.col("model") == model)


def to_embed(counts: DataFrame, known: DataFrame, version: str) -> DataFrame:
    """Resources (resource_id, child_chunks) that the manifest does not have in this version with this many vectors."""
    done = known.where(F.col("version") == version).select("resource_id", F.col("n").alias("child_chunks"))
    return counts.select("resource_id", "child_chunks").join(done, ["resource_id", "child_chunks"], "left_anti")


def indexed(spark: SparkSession, vectors_: DataFrame, metadata: DataFrame) -> DataFrame:
    """Vectors with their chunks' metadata and point ids; vectors without a chunk are left out."""
    from tessera.functions.text import point_id

    return vectors_.join(metadata.drop("resource_id"), "chunk_id").withColumn("point_id", point_id(F.col("chunk_id").cast("string")))


def filtered_points(points: DataFrame, **filters: object) -> DataFrame:
    """Points for which every filter holds: a list means any of its values; a column of arrays matches where it has one of them."""
    for name, value in filters.items():
        values = list(value) if isinstance(value, list | tuple | set) else [value]
        listed = points.schema[name].dataType.typeName() == "array"
        points = points.where(F.arrays_overlap(name, F.array(*map(F.lit, values))) if listed else F.col(name).isin(values))
    return points


def point_statistics(points: DataFrame, dim: int) -> DataFrame:
    """One row: points, resources, and those whose vector isn't of the dimension."""
    return points.agg(F.count("*").alias("points"), F.countDistinct("resource_id").alias("resources"), F.sum((F.size("vector") != dim).cast("bigint")).alias("wrong_dimension"))
