"""A table's numbered versions as a feed of changes, which streams read on from where they stopped.

A commit holds the new state of a table against the last one, key by key, and appends the rows that differ to the feed:
inserted, updated (as they were and as they are) or deleted. The state itself is what the feed adds up to, so that each
version can be read again. A stream over the feed has each change once, also after a restart, by its own checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.versions import manifest, publish

INSERT, BEFORE, AFTER, DELETE = "insert", "update_before", "update_after", "delete"


def _changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of the table and change, for each row that differs. Null keys are keys; values compare with nulls equal."""
    columns = new.columns
    side = lambda df, name: df.select(F.struct(*keys).alias(f"k_{name}"), F.struct(*columns).alias(name))
    same_key = F.to_json(F.col("k_was")) == F.to_json(F.col("k_is"))
    both = side(old, "was").join(side(new, "is"), same_key, "full_outer")
    was, is_ = F.col("was").isNotNull(), F.col("is").isNotNull()
    one = lambda change, row: F.struct(F.lit(change).alias("change"), F.col(row).alias("row"))
    differ = was & is_ & ~F.col("was").eqNullSafe(F.col("is"))
    rows = F.when(~was, F.array(one(INSERT, "is"))).when(~is_, F.array(one(DELETE, "was"))).when(differ, F.array(one(BEFORE, "was"), one(AFTER, "is")))
    return both.select(F.explode(rows).alias("x")).select("x.change", "x.row.*")


def state(spark: SparkSession, root: str, keys: list[str], version: int | None = None) -> DataFrame | None:
    """The table as of a version (the newest by default): the last that the feed says of each key."""
    at = manifest(spark, root, version)
    if at is None:
        return None
    feed = spark.read.parquet(*(f"{root}/{f}" for f in at["parts"]["changes"])).where(F.col("change") != BEFORE)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("version")))
    return feed.withColumn("__nth", nth).where((F.col("__nth") == 1) & (F.col("change") != DELETE)).drop("__nth", "change", "version")


def commit(spark: SparkSession, root: str, table: DataFrame, keys: list[str], batch: int | None = None) -> int:
    """Make the table (one row a key) the new state: the version that has it. A table without a change makes no version; a batch that is committed already changes nothing."""
    at = manifest(spark, root) or {"version": 0, "batches": {}, "parts": {"changes": []}}
    if batch is not None and at["batches"].get("batches", -1) >= batch:
        return at["version"]
    old = state(spark, root, keys)
    version = at["version"] + 1
    found = _changes(spark.createDataFrame([], table.schema) if old is None else old.select(*table.columns), table, keys)
    folder = f"changes/version-{version:012d}"
    # A failed attempt's folder is written over; streams see a folder's files once they are whole.
    found.withColumn("version", F.lit(version).cast("bigint")).write.mode("overwrite").parquet(f"{root}/{folder}")
    changed = not spark.read.parquet(f"{root}/{folder}").isEmpty()
    batches = at["batches"] if batch is None else {**at["batches"], "batches": batch}
    if changed or batch is not None or not at["version"]:
        publish(spark, root, {"version": version, "batches": batches, "parts": {"changes": [*at["parts"]["changes"], folder]}})
        return version
    return at["version"]


def follow(spark: SparkSession, root: str) -> DataFrame:
    """The feed as a stream: change, the table's columns and version. The feed must have a version, from which the columns are taken."""
    first = spark.read.parquet(f"{root}/{manifest(spark, root)['parts']['changes'][0]}")
    return spark.readStream.schema(first.schema).parquet(f"{root}/changes/version-*")


def summary(spark: SparkSession, root: str) -> DataFrame:
    """Of each version: rows inserted, updated and deleted."""
    feed = spark.read.parquet(*(f"{root}/{f}" for f in manifest(spark, root)["parts"]["changes"]))
    n = lambda change: F.sum((F.col("change") == change).cast("bigint"))
    return feed.groupBy("version").agg(n(INSERT).alias("inserted"), n(AFTER).alias("updated"), n(DELETE).alias("deleted"))
