"""Tables that are kept: appended, replaced by key, deleted from, versioned, cached."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; of a key in both, the new one's."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def deleted(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def superseded(rows: DataFrame, key: str, old: object, new: object) -> DataFrame:
    """The row with the old key marked as replaced by the new one."""
    hit = F.col(key) == old
    return rows.withColumns({"status": F.when(hit, "superseded").otherwise(F.col("status")), "superseded_by": F.when(hit, F.lit(new)).otherwise(F.col("superseded_by"))})


def valid_vectors(rows: DataFrame, vector: str, dim: int) -> DataFrame:
    """Rows whose vector has so many finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return rows.where((F.size(vector) == dim) & finite)


def cached(rows: DataFrame, cache: DataFrame, text: str, version: str, compute: Column) -> tuple[DataFrame, DataFrame]:
    """Values by digest of the text: those in the cache (digest, version, value) are taken from it, each other text is computed once. Returns the rows with value, and what is new to the cache."""
    keyed = rows.withColumn("digest", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    known = cache.where(F.col("version") == version).select("digest", "value")
    new = keyed.join(known, "digest", "left_anti").select("digest", text).dropDuplicates(["digest"]).select("digest", F.lit(version).alias("version"), compute.alias("value"))
    return keyed.join(known.unionByName(new.select("digest", "value")), "digest", "left").drop("digest"), new


def append(rows: DataFrame, path: str, partition: str | None = None) -> None:
    writer = rows.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def replace(rows: DataFrame, path: str, partition: str | None = None) -> None:
    """Write the table anew; with a partition column only the partitions that rows has."""
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if partition else "static")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def read(spark: SparkSession, path: str, **equal: object) -> DataFrame:
    """A kept table, narrowed before it is read where columns are partitions."""
    df = spark.read.parquet(path)
    for name, value in equal.items():
        df = df.where(F.col(name) == value)
    return df


def as_json(rows: DataFrame, key: str) -> DataFrame:
    """key, json and its bytes."""
    text = F.to_json(F.struct(*rows.columns))
    return rows.select(key, text.alias("json"), F.octet_length(text).cast("bigint").alias("bytes"))
