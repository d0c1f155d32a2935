"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import stored


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node that it reaches) of every node of links (a, b).

    Each round lets every node tie its larger neighbours, then its smaller ones, to the smallest that it sees; rounds grow
    with the logarithm of the longest path. Groups are only reduced to their minimum, so a node with very many links is
    split among tasks like any skewed join. Links of nulls and of a node with itself tie nothing; no links, no rows.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links")
    before = None
    while True:
        # The links only change downwards, so equal sums mean equal links.
        now = edges.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        before = now
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = stored(small.union(least).where("u > v").distinct(), "links")
