"""Tables kept for the length of a query, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder name under the one that driver and executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        named = spark.sparkContext.getCheckpointDir()
    return f"{named.rstrip('/')}/table-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_total(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Add the sum of value over all rows with a lesser order (distinct values). Rows are dealt out by ranges of order: sums within a range come after the totals of the ranges before it, so only one row a range meets in one task."""
    dealt = stored(df.repartitionByRange(order).withColumn("__range", F.spark_partition_id()))
    before = F.sum("__total").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = dealt.groupBy("__range").agg(F.sum(value).alias("__total")).select("__range", F.coalesce(before, F.lit(0)).alias("__base"))
    within = F.sum(value).over(Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return dealt.withColumn("__within", F.coalesce(within, F.lit(0))).join(ranges, "__range").withColumn(name, F.col("__base") + F.col("__within")).drop("__range", "__base", "__within")
