"""The event log as a stream: mastery kept as a table from batch to batch, windows with a watermark, and incremental merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera import constants as c
from tessera.operators.learner import learner_events, mapped, mastery_maps
from tessera.storage import scratch


def event_stream(spark: SparkSession, path: str, files_a_batch: int | None = None) -> DataFrame:
    """The events table as a stream of its files."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    # As a pattern, since a plain path must be a folder here.
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def run_to_table(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that is there and return what it wrote, with batch_id. Every batch is a folder of its own, so one that is run again replaces itself."""
    spark, path = stream.sparkSession, scratch(stream.sparkSession)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch_id={batch_id}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("batch_id", LongType())])
    try:
        return spark.read.schema(schema).option("basePath", f"{path}/out").parquet(f"{path}/out")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def advanced(known: DataFrame, events: DataFrame) -> DataFrame:
    """known (student, concept, mastery, events) after a batch of events of the events table: a key's events, by time and id, make one map, which is done to what was known of it."""
    maps = mastery_maps(learner_events(events).withColumn("ts", F.col("ts").cast("timestamp"))).select("student", "concept", F.struct("f", "events").alias("new"))
    old = known.select("student", "concept", F.struct("mastery", "events").alias("old"))
    both = old.withColumn("new", F.lit(None).cast(maps.schema["new"].dataType)).unionByName(maps.withColumn("old", F.lit(None).cast(old.schema["old"].dataType)))
    row = both.groupBy("student", "concept").agg(F.first("old", ignorenulls=True).alias("old"), F.first("new", ignorenulls=True).alias("new"))
    before = F.coalesce("old.mastery", F.lit(c.MASTERY_START))
    value = F.when(F.col("new").isNull(), before).otherwise(mapped(F.col("new.f"), before))
    return row.select("student", "concept", value.alias("mastery"), (F.coalesce("old.events", F.lit(0)) + F.coalesce("new.events", F.lit(0))).cast("bigint").alias("events"))


def streamed_mastery(spark: SparkSession, path: str, files_a_batch: int | None = None) -> DataFrame:
    """Each key's mastery after the whole stream. What is known after a batch is a table of its own, made from the one before it, so a batch that is run again makes the same."""
    place, done, shape = scratch(spark), [], "student bigint, concept string, mastery double, events bigint"

    def write(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        known = own.read.schema(shape).parquet(f"{place}/known-{batch_id - 1}") if batch_id else own.createDataFrame([], shape)
        advanced(known, batch).write.mode("overwrite").parquet(f"{place}/known-{batch_id}")
        done.append(batch_id)

    event_stream(spark, path, files_a_batch).writeStream.foreachBatch(write).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.schema(shape).parquet(f"{place}/known-{done[-1]}") if done else spark.createDataFrame([], shape)
    return last.select("student", "concept", F.round("mastery", 6).alias("mastery"), "events")


def streamed_windows(spark: SparkSession, path: str, seconds: int = c.BUCKET_SECONDS, late: str = "1 hour") -> DataFrame:
    """Events and mean value of each window and kind; events later than the watermark are left out."""
    events = event_stream(spark, path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = events.groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "event_type").agg(F.count("*").alias("events"), F.avg("value").alias("mean_value"))
    out = run_to_table(counts.select(F.col("w.start").alias("start"), "event_type", "events", "mean_value"), "update")
    last = F.row_number().over(Window.partitionBy("start", "event_type").orderBy(F.desc("batch_id")))
    return out.withColumn("n", last).where("n = 1").select("start", "event_type", "events", F.round("mean_value", 6).alias("mean_value"))


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both, the new ones in place of old ones with the same key: what a batch does to a table."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)
