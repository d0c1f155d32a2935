"""A kept index that grows batch by batch: a manifest names the folders of each version, and is replaced in one step.

A batch of resources becomes chunks, postings, vectors and graph edges in new folders, then one manifest file that names
them together with those of the version before. Readers take the newest manifest, so they see a batch whole or not at all.
A resource taken in again, or removed, is superseded: rows count only if they are of their resource's newest version. A
batch that its source has already committed changes nothing, so a stream may repeat one after a failure; folders of an
attempt that never came to a manifest are seen by nobody. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera import constants as c
from tessera.functions.text import term_counts
from tessera.operators.retrieval import hash_embedding, query_terms, ranked, scored_terms

PARTS = ("resources", "chunks", "postings", "vectors", "edges")
Chunker = Callable[[DataFrame], DataFrame]


def _files(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """Hadoop's path and file system: the manifest lies where the tables lie."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict | None:
    """The newest manifest, or that of a version: version, batches (of each source its last batch), parts (of each its folders). None if there is none."""
    at, fs = _files(spark, f"{root}/manifest")
    if version is None:
        there = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        numbers = [int(n.removesuffix(".json")) for n in there if n.endswith(".json")]
        if not numbers:
            return None
        version = max(numbers)
    stream = fs.open(_files(spark, f"{root}/manifest/{version:012d}.json")[0])
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish(spark: SparkSession, root: str, state: dict) -> None:
    """Make a manifest the newest one, by the rename of a whole file; a version that is there already is an error."""
    to, fs = _files(spark, f"{root}/manifest/{state['version']:012d}.json")
    new, _ = _files(spark, f"{root}/manifest/.{uuid.uuid4().hex}.tmp")
    out = fs.create(new, True)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    if fs.exists(to) or not fs.rename(new, to):
        fs.delete(new, False)
        raise FileExistsError(f"version {state['version']} of {root} was written by another")


def whole_texts(resources: DataFrame) -> DataFrame:
    """Each resource as one chunk with the resource's id."""
    return resources.select(F.col("resource_id").alias("chunk_id"), "resource_id", F.lit(0).alias("seq"), "text")


def newest(resources: DataFrame) -> DataFrame:
    """One row for each resource: the last by text, so that a batch with one resource twice has a defined result."""
    nth = F.row_number().over(Window.partitionBy("resource_id").orderBy(F.desc_nulls_last("text"), F.desc_nulls_last("title")))
    return resources.where(F.col("resource_id").isNotNull()).withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def take_in(
    spark: SparkSession, root: str, resources: DataFrame, batch: int, source: str = "batches", chunker: Chunker = whole_texts, edges: Callable[[DataFrame], DataFrame] | None = None, dim: int = 384, removed: DataFrame | None = None,
) -> int:
    """Take in a batch of resources (resource_id, title, text), and take out those removed (resource_id): the version that has the batch. A source's batches are numbered upwards.

    edges: from chunks (chunk_id, resource_id, seq, text) to graph edges (resource_id, src, dst, kind).
    """
    state = manifest(spark, root) or {"version": 0, "batches": {}, "parts": {p: [] for p in PARTS}}
    if state["batches"].get(source, -1) >= batch:
        return state["version"]
    version, attempt = state["version"] + 1, uuid.uuid4().hex[:12]
    folder = lambda part: f"{part}/{version:012d}-{attempt}"
    stamp = F.lit(version).cast("bigint").alias("version")

    def write(part: str, rows: DataFrame) -> DataFrame:
        rows.write.parquet(f"{root}/{folder(part)}")
        return spark.read.schema(rows.schema).parquet(f"{root}/{folder(part)}")

    rows = newest(resources.select("resource_id", F.col("title").cast("string").alias("title"), F.col("text").cast("string").alias("text")))
    kept = rows.select("resource_id", "title", F.lit(False).alias("removed"), stamp)
    if removed is not None:
        gone = removed.select("resource_id").where("resource_id IS NOT NULL").distinct().join(kept.select("resource_id"), "resource_id", "left_anti")
        kept = kept.unionByName(gone.select("resource_id", F.lit(None).cast("string").alias("title"), F.lit(True).alias("removed"), stamp))
    write("resources", kept)
    chunks = write("chunks", chunker(rows).select("chunk_id", "resource_id", "seq", "text", stamp))
    counted = chunks.select("chunk_id", "resource_id", "version", term_counts(F.col("text")).alias("t")).where(F.size("t") > 0)
    total = F.aggregate("t", F.lit(0).cast("bigint"), lambda a, x: a + x["tf"])
    # The length is taken beside the counts: beside inline it would be summed for each row that comes out of it.
    write("postings", counted.withColumn("dl", total).select("chunk_id", "resource_id", "version", "dl", F.inline("t")).sortWithinPartitions("term"))
    write("vectors", chunks.where(F.trim(F.coalesce("text", F.lit(""))) != "").select("chunk_id", "resource_id", "version", hash_embedding(F.col("text"), dim).alias("vector")))
    new = {p: folder(p) for p in ("resources", "chunks", "postings", "vectors")}
    if edges is not None:
        write("edges", edges(chunks).select("resource_id", "src", "dst", "kind", stamp))
        new["edges"] = folder("edges")
    publish(spark, root, {"version": version, "batches": {**state["batches"], source: batch}, "parts": {p: [*state["parts"][p], *([new[p]] if p in new else [])] for p in PARTS}})
    return version


def _live(spark: SparkSession, root: str, state: dict) -> DataFrame:
    """resource_id and version of the resources that are there as of a manifest."""
    resources = spark.read.parquet(*(f"{root}/{f}" for f in state["parts"]["resources"]))
    last = resources.groupBy("resource_id").agg(F.max("version").alias("version"), F.max_by("removed", "version").alias("removed"))
    return last.where("NOT removed").select("resource_id", "version")


def part(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame | None:
    """A part's rows as of a version (the newest by default), without those superseded; None before anything of it was taken in."""
    state = manifest(spark, root, version)
    if state is None or not state["parts"][name]:
        return None
    return spark.read.parquet(*(f"{root}/{f}" for f in state["parts"][name])).join(_live(spark, root, state), ["resource_id", "version"])


def search(spark: SparkSession, root: str, queries: DataFrame, k: int = c.TOP_K, version: int | None = None) -> DataFrame:
    """item_id, chunk_id, score and rank: BM25 over the live chunks, as of a version. Postings become chunks' lengths, or those of the terms asked for, before they meet the live resources: the whole of them is never shuffled."""
    state = manifest(spark, root, version)
    if state is None or not state["parts"]["postings"]:
        return queries.select("item_id", F.lit(None).cast("string").alias("chunk_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    postings, live = spark.read.parquet(*(f"{root}/{f}" for f in state["parts"]["postings"])), _live(spark, root, state)
    lengths = postings.groupBy("resource_id", "version", "chunk_id").agg(F.first("dl").alias("dl"))
    n, mean = lengths.join(live, ["resource_id", "version"]).agg(F.count("*"), F.avg("dl")).first()
    asked = query_terms(queries)
    hits = postings.join(asked.select("term").distinct(), "term", "left_semi").join(live, ["resource_id", "version"]).select(F.col("chunk_id").alias("doc_id"), "term", "tf", "dl")
    return ranked(scored_terms(hits, asked, n, mean or 1.0), "item_id", "doc_id", k=k).withColumnRenamed("doc_id", "chunk_id")


def compacted(spark: SparkSession, root: str) -> int:
    """Write what is live of each part into one folder, as a new version; readers of old versions keep their folders."""
    state = manifest(spark, root)
    version, attempt = state["version"] + 1, uuid.uuid4().hex[:12]
    parts: dict[str, list[str]] = {}
    for p in PARTS:
        rows = part(spark, root, p)
        parts[p] = []
        if rows is not None:
            parts[p] = [f"{p}/{version:012d}-{attempt}"]
            rows.write.parquet(f"{root}/{parts[p][0]}")
    publish(spark, root, {"version": version, "batches": state["batches"], "parts": parts})
    return version


def follow(stream: DataFrame, root: str, checkpoint: str, source: str, chunker: Chunker = whole_texts, edges: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Take in a stream of resources, batch by batch, until what is there is done. A batch that was committed before a failure is not taken in again."""
    batch = lambda df, n: take_in(df.sparkSession, root, df, n, source, chunker, edges)
    return stream.writeStream.foreachBatch(lambda df, n: None if batch(df, n) else None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
