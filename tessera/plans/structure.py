"""Queries over parents and children of typed blocks, vectors in cells, and projections of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import chunking as ch
from tessera.operators import projection as pj
from tessera.operators import vector_cells as vc
from tessera.operators.retrieval import nearest
from tessera.plans.registry import query
from tessera.plans.retrieval import COSINE
from tessera.session import table
from tessera.sources import blocks as bl
from tessera.storage import scratch, stored


@query("""WITH t AS (SELECT conv_id, turn, trim(text) AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations WHERE trim(text) <> '')
SELECT CAST(conv_id AS VARCHAR) || '::p' || lpad(CAST(k AS VARCHAR), 4, '0') AS chunk_id, conv_id, CAST(turn AS INTEGER) AS slide, 'slide' AS chunk_type, text FROM t""")
def turn_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations, each a place of its own like a slide: one parent a turn, numbered through the conversation."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("n"), F.lit("paragraph").alias("kind"), "text", F.col("turn").cast("int").alias("slide"))
    return ch.parent_chunks(ch.with_parents(turns, "conv_id"), "conv_id").select("chunk_id", "conv_id", "slide", "chunk_type", "text")


@query()
def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents by section, and their children, of the typed blocks of HTML pages."""
    made = bl.blocks(table(spark, sf_dir, "pages"), "page_id", "html", "html")
    return ch.chunked(stored(made), "page_id").select("chunk_id", "parent_id", "resource_id", "kind", "seq", "text", "n_tokens", "chunk_type", "heading", "child_ids")


def _collection(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame, DataFrame]:
    path, rows = scratch(spark), table(spark, sf_dir, "embeddings")
    vc.create(rows, path)
    return path, rows, rows.where("vec_id % 20 = 0")


@query(f"WITH {COSINE} SELECT query_id, vec_id, rank, round(score, 6) AS score FROM near WHERE rank <= 10")
def vector_cells_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours from a kept collection when all its cells are asked: what a search over all rows gives."""
    path, _, asked = _collection(spark, sf_dir)
    return vc.search(spark, path, asked, probes=vc.MOST_CELLS).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query()
def vector_cells_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which share of the true neighbours the cells nearest to each query hold, and how many of the cells are asked."""
    path, rows, asked = _collection(spark, sf_dir)
    share = spark.read.parquet(f"{path}/cells").agg(F.count("*").alias("cells"), F.first("probes").alias("probes"))
    return vc.recall(vc.search(spark, path, asked), nearest(asked, rows)).join(share, F.lit(True))  # one row each


_PARTS = "v AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(len(embedding))) AS d FROM embeddings)"


@query(f"""WITH {_PARTS}, n AS (SELECT count(*) AS n FROM embeddings), s AS (SELECT d, sum(x) AS s FROM v GROUP BY 1)
SELECT CAST(a.d AS INTEGER) AS i, CAST(b.d AS INTEGER) AS j, round((p - a.s * b.s / n) / (n - 1), 9) AS covariance FROM (SELECT v.d AS i, w.d AS j, sum(v.x * w.x) AS p FROM v JOIN v w ON v.vec_id = w.vec_id AND v.d >= w.d GROUP BY ALL) JOIN s a ON a.d = i JOIN s b ON b.d = j, n""")
def embedding_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pj.covariance(table(spark, sf_dir, "embeddings")).select("i", "j", F.round("covariance", 9).alias("covariance"))


@query()
def principal_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's places along the two directions of most variance, with the share of variance that these explain. The eigenvectors have no SQL."""
    rows = table(spark, sf_dir, "embeddings")
    found, mean, directions = pj.principal_components(rows, 2)
    places = pj.projected(rows, mean, directions)
    return places.select("vec_id", "label", *(F.round(F.get("projection", F.lit(k)), 6).alias(f"pc{k + 1}") for k in range(2)), F.lit(round(sum(r["share"] for r in found.collect()), 6)).alias("share"))


@query(f"""WITH {_PARTS}, norms AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM v GROUP BY 1), s AS (SELECT label, d, sum(x / n) AS s FROM v JOIN norms USING (vec_id) GROUP BY ALL), c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1),
p AS (SELECT x.label AS a, y.label AS b, sum(x.s * y.s) AS dot FROM s x JOIN s y ON x.d = y.d AND x.label <= y.label GROUP BY ALL)
SELECT a, b, CASE WHEN a = b THEN m.n * (m.n - 1) ELSE m.n * k.n END AS pairs, round(CASE WHEN a = b THEN (dot - m.n) / (m.n * (m.n - 1)) ELSE dot / (m.n * k.n) END, 6) AS cosine FROM p JOIN c m ON m.label = a JOIN c k ON k.label = b""")
def label_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean cosine of all pairs of vectors with two labels."""
    return pj.cosine_heatmap(table(spark, sf_dir, "embeddings")).select("a", "b", "pairs", F.round("cosine", 6).alias("cosine"))
