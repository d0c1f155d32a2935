"""Data files (CSV) that are catalogued with their schema and profile and never cut into chunks.

A file is read once, row by row, by one task: files are independent and of bounded size, which the scan enforces; a column's
figures are kept while its rows go by, its distinct values with them: they are no more than the file holds.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.files import MOST_BYTES, ending

PROFILE = "path string, column string, position int, type string, rows bigint, nulls bigint, distinct bigint, least string, greatest string, mean double"
_KINDS = ("boolean", "bigint", "double", "date", "string")


def value_type(value: str) -> str:
    """The narrowest type of one value."""
    low = value.lower()
    if low in ("true", "false"):
        return "boolean"
    digits = value.removeprefix("-").removeprefix("+")
    if digits.isdecimal() and digits.isascii() and len(digits) <= 18:
        return "bigint"
    try:
        float(value)
        return "double" if "_" not in value else "string"
    except ValueError:
        parts = value.split("-")
        dated = len(value) == 10 and [len(p) for p in parts] == [4, 2, 2] and all(p.isdecimal() for p in parts) and 1 <= int(parts[1]) <= 12 and 1 <= int(parts[2]) <= 31
        return "date" if dated else "string"


class Column:
    """Figures of a column as its values go by. Its type is the narrowest that all of its values have: whole numbers become doubles beside doubles, all other mixtures strings."""

    def __init__(self, name: str):
        self.name, self.kinds, self.rows, self.nulls, self.total = name, set(), 0, 0, 0.0
        self.seen: set[str] = set()
        self.texts: tuple[str, str] | None = None
        self.numbers: tuple[float, float, str, str] | None = None

    def add(self, value: str) -> None:
        self.rows += 1
        if value == "":
            self.nulls += 1
            return
        kind = value_type(value)
        self.kinds.add(kind)
        self.seen.add(value)
        self.texts = (value, value) if self.texts is None else (min(self.texts[0], value), max(self.texts[1], value))
        if kind in ("bigint", "double"):
            x = float(value)
            self.total += x
            low, high, low_text, high_text = self.numbers or (x, x, value, value)
            self.numbers = (x, high, value, high_text) if x < low else (low, x, low_text, value) if x > high else (low, high, low_text, high_text)

    def row(self, path: str, position: int) -> dict:
        kind = next(iter(self.kinds)) if len(self.kinds) == 1 else "double" if self.kinds == {"bigint", "double"} else "string"
        numeric = kind in ("bigint", "double") and self.numbers is not None
        least, greatest = (self.numbers[2:] if numeric else self.texts) or (None, None)
        filled = self.rows - self.nulls
        return {"path": path, "column": self.name, "position": position, "type": kind if self.kinds else "string", "rows": self.rows, "nulls": self.nulls, "distinct": len(self.seen), "least": least, "greatest": greatest, "mean": self.total / filled if numeric else None}


def profile_of(path: str, content: bytes) -> list[dict]:
    """A row for each column of a CSV file with a header; short rows are filled up with empty values, values beyond the header left out; a file without a header has no columns."""
    rows = csv.reader(io.StringIO(content.decode("utf-8-sig", errors="replace"), newline=""))
    columns = [Column(name.strip() or f"column_{k + 1}") for k, name in enumerate(next(rows, []))]
    for row in rows:
        if row:
            for k, column in enumerate(columns):
                column.add(row[k] if k < len(row) else "")
    return [column.row(path, k) for k, column in enumerate(columns)]


def profiled(files: DataFrame) -> DataFrame:
    """The profile of every column of CSV files (path, content); files without content have none."""
    schema = pa.schema([("path", pa.string()), ("column", pa.string()), ("position", pa.int32()), ("type", pa.string()), ("rows", pa.int64()), ("nulls", pa.int64()), ("distinct", pa.int64()), ("least", pa.string()), ("greatest", pa.string()), ("mean", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b["path"].to_pylist(), b["content"], strict=True):
                if content.is_valid and (found := profile_of(path, content.as_py())):
                    yield pa.RecordBatch.from_pylist(found, schema)

    return files.select("path", "content").mapInArrow(run, PROFILE)


def registered(profile: DataFrame) -> DataFrame:
    """A catalog row for each file: resource_id, path, kind, columns, rows, schema (as Spark reads it) and status, which keeps it from being chunked."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "column", "type")))
    out = profile.groupBy("path").agg(ordered.alias("c"), F.max("rows").alias("rows"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]+$", "")
    slug = F.btrim(F.regexp_replace(F.lower(stem), "[^a-z0-9]+", "-"), F.lit("-"))
    ddl = F.array_join(F.transform("c", lambda x: F.concat(F.lit("`"), F.replace(x["column"], F.lit("`"), F.lit("``")), F.lit("` "), x["type"])), ", ")
    return out.select(F.concat(F.lit("dataset."), slug).alias("resource_id"), "path", F.lit("dataset").alias("kind"), F.size("c").alias("columns"), "rows", ddl.alias("schema"), F.lit("catalogued").alias("status"))


def register(spark: SparkSession, root: str, to: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Profile the CSV files below a folder and keep profile and catalog rows below `to`: the catalog rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where((F.col("length") <= most_bytes) & (ending(F.col("path")) == "csv"))
    profiled(files).write.mode("overwrite").parquet(f"{to}/profile")
    registered(spark.read.parquet(f"{to}/profile")).write.mode("overwrite").parquet(f"{to}/catalog")
    return spark.read.parquet(f"{to}/catalog")
