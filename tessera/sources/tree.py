"""A folder of files taken in by one scan: each file goes to the loader that handles its ending, and fails alone.

Spark lists and reads the files; a task loads its files one after the other. Validation, choice of a loader and extraction
are the stages of a file. A file that a stage gives up on keeps its row, with the stage, the error and how often it was
tried, and goes to a table of dead letters instead of the blocks; no file stops another. Files beyond the size limit are
never read: the limit is part of the scan.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.blocks import BLOCK, caption_cues, html_blocks, markdown_blocks, notebook_blocks, plain_blocks
from tessera.sources.files import MOST_BYTES, SIDECAR, ending, listing

Loader = Callable[[str], list[dict]]
#: Characters of an error's message that are kept, and files that a repair names at a time, about.
MESSAGE, BATCH = 300, 10_000


def load_notebook(text: str) -> list[dict]:
    """Blocks of a notebook; a text that is none is an error."""
    if not isinstance(json.loads(text).get("cells"), list):
        raise ValueError("no cells: not a notebook")
    return notebook_blocks(text)


def load_captions(text: str) -> list[dict]:
    """A block for each cue; a text with no cue at all is an error."""
    cues = caption_cues(text)
    if not cues and text.strip():
        raise ValueError("no cues: not captions")
    return [{"n": n, "kind": "transcript", "text": c["text"], "level": 0, "section": [], "links": [], "images": []} for n, c in enumerate(cues)]


#: Loaders by ending.
LOADERS: dict[str, Loader] = {"txt": plain_blocks, "md": markdown_blocks, "markdown": markdown_blocks, "html": html_blocks, "htm": html_blocks, "ipynb": load_notebook, "vtt": load_captions, "srt": load_captions, "json": load_captions}
_BLOCKS = pa.list_(pa.struct([("n", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("level", pa.int32()), ("section", pa.list_(pa.string())), ("links", pa.list_(pa.string())), ("images", pa.list_(pa.string()))]))
_STRUCT = f"array<struct<{', '.join(x.replace(' ', ': ', 1) for x in BLOCK.split(', '))}>>"


def attempt(load: Loader, content: bytes, retries: int) -> tuple[list[dict] | None, str | None, str | None, int]:
    """Blocks, or the error's kind and message, and the number of tries. Bytes that aren't UTF-8 are replaced."""
    text = content.decode("utf-8", errors="replace").removeprefix("﻿")
    for tried in range(1, retries + 2):
        try:
            return load(text), None, None, tried
        except Exception as e:  # noqa: BLE001 - a loader may fail in any way: the file's row tells how
            kind, message = type(e).__name__, str(e)[:MESSAGE]
    return None, kind, message, tried


def loaded(files: DataFrame, loaders: dict[str, Loader] | None = None, retries: int = 1, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Files (path, length, content) with kind, status (SUCCESS, FAILED), warning, stage, error, message, attempts and blocks. stage: where a file failed (validation, loader_selection, extraction). content may be null for files that fail before it is asked for; null content of others is an extraction error."""
    known = LOADERS if loaders is None else loaders
    kinds = list(known)
    rows = files.withColumn("kind", F.coalesce(ending(F.col("path")), F.lit("")))
    stage = F.when(F.col("length") > most_bytes, "validation").when(~F.col("kind").isin(kinds), "loader_selection")
    error = F.when(F.col("length") > most_bytes, "TooLarge").when(~F.col("kind").isin(kinds), "UnsupportedEnding")
    message = F.when(F.col("length") > most_bytes, F.concat(F.col("length").cast("string"), F.lit(" bytes"))).when(~F.col("kind").isin(kinds), F.concat(F.lit("no loader for ."), F.col("kind")))
    rows = rows.select("path", "length", "kind", stage.alias("stage"), error.alias("error"), message.alias("message"), F.when(stage.isNull(), F.col("content")).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stages, errors, messages, attempts, blocks = (b[c].to_pylist() if c else [0] * b.num_rows for c in ("stage", "error", "message", None, None))
            for k, (kind, content) in enumerate(zip(b["kind"].to_pylist(), b["content"], strict=True)):
                blocks[k] = None
                if stages[k] is None:
                    made, errors[k], messages[k], attempts[k] = attempt(known[kind], content.as_py(), retries) if content.is_valid else (None, "NoContent", "no content", 1)
                    blocks[k], stages[k] = made, None if made is not None else "extraction"
            columns = [b["path"], b["length"], b["kind"], pa.array(stages, pa.string()), pa.array(errors, pa.string()), pa.array(messages, pa.string()), pa.array(attempts, pa.int32()), pa.array(blocks, _BLOCKS)]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "length", "kind", "stage", "error", "message", "attempts", "blocks"])

    out = rows.mapInArrow(run, f"path string, length bigint, kind string, stage string, error string, message string, attempts int, blocks {_STRUCT}")
    status = F.when(F.col("stage").isNull(), "SUCCESS").otherwise("FAILED")
    warning = F.when(F.col("length") == 0, "file is empty").when(F.col("stage").isNull() & (F.size("blocks") == 0), "no content blocks")
    return out.select("path", "length", "kind", status.alias("status"), warning.alias("warning"), "stage", "error", "message", "attempts", "blocks")


def scanned(spark: SparkSession, root: str, empty: bool = True, most_bytes: int = MOST_BYTES) -> DataFrame:
    """path, length and content of every file below root but sidecars; content is null where the file is larger than the limit. empty: with empty files, too."""
    read = lambda: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    small = read().where(F.col("length") <= most_bytes).select("path", "length", "content")
    large = read().where(F.col("length") > most_bytes).select("path", "length", F.lit(None).cast("binary").alias("content"))
    files = small.unionByName(large)
    if empty:
        files = files.unionByName(listing(spark, root).where("length = 0").select("path", "length", F.lit("").cast("binary").alias("content")))
    return files.where(~F.col("path").contains(SIDECAR))


def tree_blocks(files: DataFrame) -> DataFrame:
    """path, kind and a row for each block of the loaded files."""
    return files.where("status = 'SUCCESS'").select("path", F.col("kind").alias("file_kind"), F.inline("blocks"))


def dead_letters(files: DataFrame) -> DataFrame:
    """A row for each file that failed: where, why, and how often it was tried."""
    return files.where("status = 'FAILED'").select("path", "length", "kind", "stage", "error", "message", "attempts")


def ingest_tree(spark: SparkSession, root: str, to: str, loaders: dict[str, Loader] | None = None, retries: int = 1, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Take in a folder: blocks and dead letters are written below `to`, and each file's outcome; a row for each kind and status: files, blocks, warnings. Files are read once."""
    files = loaded(scanned(spark, root, most_bytes=most_bytes), loaders, retries, most_bytes)
    files.write.mode("overwrite").parquet(f"{to}/files")
    files = spark.read.parquet(f"{to}/files")
    tree_blocks(files).write.mode("overwrite").parquet(f"{to}/blocks")
    dead_letters(files).write.mode("overwrite").parquet(f"{to}/dead_letters")
    return outcomes(files)


def outcomes(files: DataFrame) -> DataFrame:
    """Of each kind and status: files, blocks and warnings."""
    n = F.sum(F.coalesce(F.size("blocks"), F.lit(0)).cast("bigint"))
    return files.groupBy("kind", "status").agg(F.count("*").alias("files"), n.alias("blocks"), F.count("warning").alias("warnings"))


def retried(spark: SparkSession, to: str, loaders: dict[str, Loader] | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Load again what is among the dead letters of an ingest, with other loaders or after a repair: the files' new outcomes."""
    gone = spark.read.parquet(f"{to}/dead_letters").where("length > 0").select("path")
    again = spark.createDataFrame([], "path string, length bigint, content binary")
    batches = -(-gone.count() // BATCH)
    for k in range(batches):  # the driver names a bounded number of failed files at a time
        names = [r[0] for r in gone.where(F.pmod(F.xxhash64("path"), F.lit(batches)) == k).collect()]
        if names:
            again = again.unionByName(spark.read.format("binaryFile").load(names).select("path", "length", "content"))
    return loaded(again, loaders, 0, most_bytes)
