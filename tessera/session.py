"""A session with the settings that the engine expects, and access to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", partitions: int | None = None) -> SparkSession:
    """Adaptive execution, UTC, ANSI and Arrow on; partitions: shuffle partitions, Spark's default if not given."""
    builder = SparkSession.builder.master(master).appName("tessera").config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.execution.arrow.pyspark.enabled", "true").config("spark.ui.enabled", "false").config("spark.sql.ansi.enabled", "true")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
