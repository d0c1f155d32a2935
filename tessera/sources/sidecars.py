"""Sidecars: JSON files beside resources, and JSONL artifacts, under one schema with versions.

Known fields are columns; what a file has beside them is kept as it is and written back with them. Older versions are read
as the present one: fields that have been renamed are taken over. A text that is no JSON object gives a row with an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "2"
KNOWN = "resource_id string, title string, doc_type string, language string, tags array<string>, week int, sha256 string, schema_version string"
#: Fields by their names in earlier versions.
RENAMED = {"id": "resource_id", "type": "doc_type", "lang": "language", "topics": "tags", "hash": "sha256"}
NAMES = [x.strip().split(" ")[0] for x in KNOWN.split(", ")]


def parsed(texts: DataFrame, text: str = "text") -> DataFrame:
    """The rows of texts with the known fields, extra (all others, a map of variants) and error; texts are JSON objects. A field that is there under both names counts by the newer; a known field of another type is an error."""
    row = F.struct(*(F.col(c) for c in texts.columns if c != text)) if len(texts.columns) > 1 else F.struct(F.lit(None).alias("none"))
    whole = F.from_json(F.col(text), "map<string,variant>", {"mode": "PERMISSIVE"})
    rows = texts.select(row.alias("__row"), F.col(text).alias("__text"), whole.alias("__all"))
    plain = lambda v, kind: F.try_variant_get(v, "$", kind)
    wrong, fields = [], {}
    for part in KNOWN.split(", "):
        name, kind = part.split(" ", 1)
        old = next((k for k, v in RENAMED.items() if v == name), None)
        found = F.try_element_at("__all", F.lit(name))
        found = F.coalesce(found, F.try_element_at("__all", F.lit(old))) if old else found
        fields[name] = plain(found, kind)
        filled = found.isNotNull() & ~F.is_variant_null(found)
        wrong.append(F.when(filled & fields[name].isNull(), F.lit(name)))
    bad = F.array_compact(F.array(*wrong))
    error = F.when(F.col("__all").isNull(), "not a JSON object").when(F.size(bad) > 0, F.concat(F.lit("wrong type: "), F.array_join(bad, ", ")))
    version = F.coalesce(fields["schema_version"], F.lit("1"))
    extra = F.map_filter("__all", lambda k, v: ~k.isin([*NAMES, *RENAMED]))
    kept = [F.col("__row")[c].alias(c) for c in texts.columns if c != text]
    return rows.select(*kept, *(v.alias(k) for k, v in fields.items() if k != "schema_version"), version.alias("schema_version"), extra.alias("extra"), error.alias("error"))


def as_text(extra: Column | None = None) -> Column:
    """A row's known fields and extra as one JSON object of the present version; null fields are left out."""
    known = F.from_json(F.to_json(F.struct(*(F.col(n) for n in NAMES if n != "schema_version"), F.lit(VERSION).alias("schema_version"))), "map<string,variant>")
    more = F.coalesce(extra, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))) if extra is not None else None
    return F.to_json(known if more is None else F.map_concat(known, F.map_filter(more, lambda k, v: ~k.isin(NAMES))))


def read_sidecars(spark: SparkSession, root: str, pattern: str = "*.meta.json") -> DataFrame:
    """path and the fields of every sidecar below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return parsed(files.select("path", F.col("content").cast("string").alias("text")))


def write_sidecars(rows: DataFrame, path: str) -> None:
    """One text file for each resource, in a folder named by its id; what was there of these resources is replaced. Rows with an error or without an id are left out."""
    good = rows.where("error IS NULL AND resource_id IS NOT NULL") if "error" in rows.columns else rows.where("resource_id IS NOT NULL")
    texts = good.select("resource_id", as_text(F.col("extra")).alias("value")).dropDuplicates(["resource_id"])
    texts.repartition("resource_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("resource_id").text(path)


def read_written(spark: SparkSession, path: str) -> DataFrame:
    """The sidecars that write_sidecars wrote, those of some resources by their folders."""
    return parsed(spark.read.text(path).select(F.col("resource_id").alias("folder"), F.col("value").alias("text")))


def append_lines(rows: DataFrame, path: str) -> None:
    """Append an artifact's rows as lines of JSON (figures, session logs): every column as it is."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("append").text(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An artifact's rows by a schema, with extra (other fields) and error; blank lines are passed over."""
    names = [x.strip().split(" ")[0].strip("`") for x in _top_level(schema)]
    lines = spark.read.text(path).where(F.trim("value") != "")
    whole = F.from_json("value", "map<string,variant>")
    made = lines.select(F.from_json("value", schema).alias("x"), whole.alias("all"))
    return made.select("x.*", F.map_filter("all", lambda k, v: ~k.isin(names)).alias("extra"), F.when(F.col("all").isNull(), "not a JSON object").alias("error"))


def _top_level(schema: str) -> list[str]:
    """The fields of a schema, split at commas outside of brackets."""
    out, depth, start = [], 0, 0
    for k, x in enumerate(schema):
        depth += (x in "<(") - (x in ">)")
        if x == "," and not depth:
            out, start = [*out, schema[start:k]], k + 1
    return [*out, schema[start:]]
