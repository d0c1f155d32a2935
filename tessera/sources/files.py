"""Files as rows: discovery, classification by path, import plans, validation, sidecars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What is read, what is a dataset, and how large a file may be.
TEXT_ENDINGS = ["md", "txt", "html", "htm", "ipynb", "vtt", "srt", "json", "pdf", "pptx", "docx"]
DATA_ENDINGS = ["csv", "sql", "xlsx", "parquet"]
MOST_BYTES = 150 << 20
SIDECAR = ".meta."


def listing(spark: SparkSession, root: str, empty: bool = True) -> DataFrame:
    """path, length and modified of every file below a folder; contents aren't read. Spark's reader lists the files, with a job of its own where folders are many; it passes over empty ones (and those whose names begin with . or _), which the driver finds by walking the folders, unless told not to: only their names it holds."""
    filled = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    if not empty:
        return filled
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    found, rows = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True), []
    while found.hasNext():
        f = found.next()
        if not f.getLen() and f.getPath().getName()[0] not in "._":
            rows.append((f.getPath().toString(), 0, f.getModificationTime() / 1000))
    return filled.unionByName(spark.createDataFrame(rows, "path string, length bigint, modified double").withColumn("modified", F.timestamp_seconds("modified")))


def ending(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def classified(files: DataFrame, root: str) -> DataFrame:
    """track, course, module and title by the folders below root (technical, misc and m00 where missing), the kind by the ending, and an id; colliding ids get -2, -3 in order of their paths. Sidecars and unknown endings are left out."""
    relative = F.regexp_replace(F.substring_index("path", root.rstrip("/") + "/", -1), "^/+", "")
    parts = F.split(relative, "/")
    folder = lambda n, other: F.when(F.size(parts) > n, F.get(parts, F.lit(n - 1))).otherwise(F.lit(other))
    slug = lambda x: F.btrim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), F.lit("-"))
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]+$", "")
    out = files.where(~F.col("path").contains(SIDECAR)).withColumn("kind", ending(F.col("path"))).where(F.col("kind").isin(TEXT_ENDINGS + DATA_ENDINGS))
    out = out.select("*", folder(1, "technical").alias("track"), folder(2, "misc").alias("course"), folder(3, "m00").alias("module"), stem.alias("title"))
    out = out.withColumn("base", F.concat_ws(".", slug(F.col("track")), slug(F.col("course")), slug(F.col("module")), slug(F.col("title"))))
    nth = F.row_number().over(Window.partitionBy("base").orderBy("path"))
    return out.withColumn("n", nth).withColumn("resource_id", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("n").cast("string")))).drop("n", "base")


def disposition(path: Column) -> Column:
    """What an import does with a file: skip hidden and temporary ones, copy texts and datasets, set others apart."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.rlike(r"^[.~]|\.tmp$|^Thumbs\.db$"), "SKIP").when(ending(path).isin(TEXT_ENDINGS), "COPY").when(ending(path).isin(DATA_ENDINGS), "COPY_DATASET").otherwise("QUARANTINE")


def module_slug(folder: Column) -> Column:
    """w05 for a folder named after week or session 5."""
    number = F.regexp_extract(F.lower(folder), r"(?:week|session)[\s_-]*(\d+)", 1)
    return F.when(number == "", "m00").otherwise(F.concat(F.lit("w"), F.lpad(number, 2, "0")))


def file_issues(files: DataFrame) -> DataFrame:
    """Files with issues: unsupported endings and files too large are errors, empty ones a warning."""
    found = F.array_compact(F.array(F.when(~ending(F.col("path")).isin(TEXT_ENDINGS + DATA_ENDINGS), "error: ending"), F.when(F.col("length") > MOST_BYTES, "error: size"), F.when(F.col("length") == 0, "warning: empty")))
    return files.select("path", found.alias("issues")).where(F.size("issues") > 0)


def is_resource_id(value: Column) -> Column:
    return value.rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+){3}$")


def safe_name(name: Column) -> Column:
    """An upload's file name without folders and odd characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.element_at(F.split(name, r"[/\\]"), -1), r"[^A-Za-z0-9._-]+", "_"), r"^\.+", ""), 1, 120)
