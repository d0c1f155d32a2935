"""Parent and child chunks. Packing to a token budget depends on what was packed before, so each document's blocks or text are folded by one function, run by Arrow; documents are independent."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import constants as c
from tessera.functions.text import chunk_tokens
from tessera.operators.ingest import parent_facts, parent_keys

_ENDS = re.compile(r"(?<=[.!?;:؟؛،…])\s+|\n+")


def n_tokens(text: str) -> int:
    return round(len(text.split()) * c.TOKENS_A_WORD)


def units(text: str, most: int) -> list[str]:
    """Sentences; those over the budget are cut at words."""
    out = []
    for s in (x.strip() for x in _ENDS.split(text)):
        if not s:
            continue
        words, step = s.split(), max(1, int(most / c.TOKENS_A_WORD))
        out += [s] if n_tokens(s) <= most else [" ".join(words[i : i + step]) for i in range(0, len(words), step)]
    return out


def windows(text: str, most: int = c.CHILD_TOKENS, overlap: int = c.OVERLAP_TOKENS, least: int = c.LEAST_TOKENS) -> list[str]:
    """Sentences packed to the budget, each window beginning with the last ones of the window before as far as the overlap goes; a tail below the least joins its predecessor."""
    out: list[list[str]] = []
    held: list[str] = []
    for u in units(text, most):
        if held and n_tokens(" ".join([*held, u])) > most:
            out.append(held)
            tail: list[str] = []
            for x in reversed(held):
                if n_tokens(" ".join([x, *tail])) > overlap or n_tokens(" ".join([x, *tail, u])) > most:
                    break
                tail.insert(0, x)
            held = tail
        held = [*held, u]
    if held:
        out.append(held)
    made = [" ".join(x) for x in out]
    if len(made) > 1 and n_tokens(made[-1]) < least:
        made[-2:] = [f"{made[-2]} {made[-1]}"]
    return made


def groups(keys: list[str], sizes: list[int], most: int) -> list[int]:
    """The parent of each block: a new one where the key changes or the budget would be passed."""
    out, n, held = [], -1, 0
    for k, size in enumerate(sizes):
        if k == 0 or keys[k] != keys[k - 1] or held + size > most:
            n, held = n + 1, 0
        held += size
        out.append(n)
    return out


def parents(texts: list[str], keys: list[str], most: int = c.PARENT_TOKENS) -> list[int]:
    return groups(keys, [n_tokens(t) for t in texts], most)


_CHUNK = "parent int, child int, text string, n_tokens int"


def chunks(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, parent, child, text and n_tokens of every child chunk: paragraphs are grouped into parents, parents' texts cut into windows."""
    kind = pa.list_(pa.struct([("parent", pa.int32()), ("child", pa.int32()), ("text", pa.string()), ("n_tokens", pa.int32())]))

    def of(t: str) -> list[dict]:
        blocks = [p.strip() for p in re.split(r"\n\s*\n", t) if p.strip()]
        group: dict[int, list[str]] = {}
        for n, b in zip(parents(blocks, [""] * len(blocks)), blocks, strict=True):
            group.setdefault(n, []).append(b)
        return [{"parent": n, "child": k, "text": w, "n_tokens": n_tokens(w)} for n, bs in group.items() for k, w in enumerate(windows("\n\n".join(bs)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([of(t or "") for t in b.column(1).to_pylist()], kind)], names=[key, "c"])

    made = df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, c array<struct<{', '.join(x.replace(' ', ': ', 1) for x in _CHUNK.split(', '))}>>")
    return made.select(key, F.inline("c"))


_PLACES = {"language": "string", "page": "int", "slide": "int", "cell": "int", "start": "double", "section": "array<string>", "kind": "string"}


def with_parents(blocks: DataFrame, key: str, most: int = c.PARENT_TOKENS, seconds: int = c.BUCKET_SECONDS) -> DataFrame:
    """Typed blocks (key, n, text; kind, section, language, page, slide, cell and start where there are such columns, null where not) with the number of their parent: consecutive blocks of one slide, cell, window of time or section, up to the budget. Blank blocks are left out; n numbers a resource's blocks in order.

    Only numbers, keys and token counts of a resource's blocks meet in one fold, not their texts.
    """
    rows = blocks.withColumns({name: F.lit(None).cast(kind) for name, kind in _PLACES.items() if name not in blocks.columns})
    rows = rows.where(F.col(key).isNotNull() & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    place = parent_keys(F.col("slide"), F.col("cell"), F.col("start"), F.coalesce("section", F.array().cast("array<string>")), seconds)
    facts = rows.select(key, F.struct("n", place.alias("place"), chunk_tokens(F.col("text")).alias("tokens")).alias("x"))
    facts = facts.groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("x"))
    kind = pa.list_(pa.struct([("n", pa.int64()), ("parent", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            folded = []
            for x in b["x"].to_pylist():
                numbers = groups([r["place"] for r in x], [r["tokens"] for r in x], most)
                folded.append([{"n": r["n"], "parent": p} for r, p in zip(x, numbers, strict=True)])
            yield pa.RecordBatch.from_arrays([b[key], pa.array(folded, kind)], names=[key, "x"])

    numbered = facts.mapInArrow(run, f"{key} {blocks.schema[key].dataType.simpleString()}, x array<struct<n: bigint, parent: int>>").select(key, F.inline("x"))
    return rows.join(numbered, [key, "n"])


def parent_chunks(numbered: DataFrame, key: str) -> DataFrame:
    """Parents of numbered blocks: key, parent, chunk_id, text, n_tokens, and their facts: chunk_type, language, heading, page, page_end, slide, timestamp, block_ids."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.trim("text").alias("t")))), lambda x: x["t"]), "\n\n")
    whole = numbered.groupBy(key, "parent").agg(text.alias("text")).withColumn("n_tokens", chunk_tokens(F.col("text")))
    facts = parent_facts(numbered, [key, "parent"])
    return whole.join(facts, [key, "parent"]).withColumn("chunk_id", F.format_string("%s::p%04d", F.col(key).cast("string"), F.col("parent")))


def child_chunks(parents_: DataFrame, key: str, most: int = c.CHILD_TOKENS, overlap: int = c.OVERLAP_TOKENS, least: int = c.LEAST_TOKENS) -> DataFrame:
    """Children of parents: key, parent, chunk_id (numbered through the resource), parent_id, order, text, n_tokens, and the parent's facts. Every parent has one."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: windows(t, most, overlap, least) or [t])

    facts = ["chunk_type", "language", "heading", "page", "page_end", "slide", "timestamp", "block_ids"]
    rows = parents_.select(key, "parent", F.col("chunk_id").alias("parent_id"), *facts, F.posexplode(cut("text")).alias("child", "text"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy("parent", "child"))
    rows = rows.withColumns({"order": nth, "n_tokens": chunk_tokens(F.col("text"))})
    return rows.withColumn("chunk_id", F.format_string("%s::c%05d", F.col(key).cast("string"), F.col("order") - 1)).drop("child")


def chunked(blocks: DataFrame, key: str, parent_tokens: int = c.PARENT_TOKENS, child_tokens: int = c.CHILD_TOKENS, overlap: int = c.OVERLAP_TOKENS, least: int = c.LEAST_TOKENS) -> DataFrame:
    """Parents and children of typed blocks in one table, as index.save_chunks takes it: chunk_id, parent_id (null of parents), the resource as resource_id, kind (parent or child), seq, text, n_tokens, facts, and child_ids of parents. Ids depend on the resource, the blocks and the budgets alone."""
    over = parent_chunks(with_parents(blocks, key, parent_tokens), key)
    under = child_chunks(over, key, child_tokens, overlap, least)
    ids = under.groupBy("parent_id").agg(F.array_sort(F.collect_list("chunk_id")).alias("child_ids"))
    facts = ["chunk_type", "language", "heading", "page", "page_end", "slide", "timestamp", "block_ids"]
    tops = over.join(ids.withColumnRenamed("parent_id", "chunk_id"), "chunk_id").select("chunk_id", F.lit(None).cast("string").alias("parent_id"), F.col(key).alias("resource_id"), F.lit("parent").alias("kind"), F.col("parent").alias("seq"), "text", "n_tokens", *facts, "child_ids")
    return tops.unionByName(under.select("chunk_id", "parent_id", F.col(key).alias("resource_id"), F.lit("child").alias("kind"), F.col("order").alias("seq"), "text", "n_tokens", *facts, F.lit(None).cast("array<string>").alias("child_ids")))


def section_paths(blocks: DataFrame, key: str) -> DataFrame:
    """key, depth and path of every section that is on a block's path."""
    path = F.explode(F.transform(F.sequence(F.lit(1), F.size("section")), lambda i: F.slice("section", 1, i)))
    return blocks.where(F.size("section") > 0).select(key, path.alias("p")).select(key, F.size("p").alias("depth"), F.array_join("p", " / ").alias("path")).distinct()


def segments(cues: DataFrame, key: str, gap: float = c.SEGMENT_GAP, words: int = c.SEGMENT_WORDS) -> DataFrame:
    """key, segment, start, end, cues and text: cues joined until a pause or so many words. A word budget resets with each segment, so each transcript is folded in turn."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for r in rows.sort_values(["start", "n"]).itertuples():
            n = len(r.text.split())
            if not out or r.start - out[-1][3] > gap or out[-1][6] + n > words:
                out.append([getattr(r, key), len(out), r.start, r.end, 0, "", 0])
            s = out[-1]
            s[3], s[4], s[5], s[6] = max(s[3], r.end), s[4] + 1, f"{s[5]} {r.text}".strip(), s[6] + n
        return pd.DataFrame([x[:6] for x in out], columns=[key, "segment", "start", "end", "cues", "text"])

    return cues.groupBy(key).applyInPandas(fold, f"{key} {cues.schema[key].dataType.simpleString()}, segment int, start double, end double, cues int, text string")


def sessions(events: DataFrame, key: str, ts: str, gap_seconds: float) -> DataFrame:
    """Events with the number of their session: a new one after a pause longer than the gap. Columns only."""
    order = Window.partitionBy(key).orderBy(ts, "event_id")
    pause = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(order).cast("timestamp"))
    new = F.when(pause.isNull() | (pause > gap_seconds * 1_000_000), 1).otherwise(0)
    return events.withColumn("new", new).withColumn("session", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")).drop("new")
