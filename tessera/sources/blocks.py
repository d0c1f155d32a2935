"""Readers that turn texts into typed blocks: plain text, Markdown, HTML, notebooks and captions.

A block has kind, text, level (of headings), section (headings above it) and the links and images in it. Scans that need
a line's context are Python functions over one text, run by Arrow in batches; everything around them is columns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of text that are read into blocks at once.
SLICE_BYTES = 1 << 20
BLOCK = "n int, kind string, text string, level int, section array<string>, links array<string>, images array<string>"
CHROME = {"script", "style", "nav", "footer", "header", "aside", "form", "noscript"}
KINDS = {"p": "paragraph", "li": "list_item", "pre": "code", "table": "table", "blockquote": "quote", "figcaption": "caption"}


def _sections(blocks: list[dict]) -> list[dict]:
    """Number the blocks and give each the headings above it."""
    stack: list[tuple[int, str]] = []
    for n, b in enumerate(blocks):
        if b["kind"] == "heading":
            stack = [x for x in stack if x[0] < b["level"]]
        b |= {"n": n, "section": [t for _, t in stack]}
        if b["kind"] == "heading":
            stack.append((b["level"], b["text"]))
    return blocks


def _block(kind: str, text: str, level: int = 0, links: list[str] | None = None, images: list[str] | None = None) -> dict:
    return {"kind": kind, "text": text, "level": level, "links": links or [], "images": images or []}


def markdown_blocks(text: str) -> list[dict]:
    """Fences, headings, lists, tables, quotes and paragraphs; links and images of each."""
    blocks, kind, held, fence = [], "", [], ""

    def close() -> None:
        nonlocal kind, held
        if held:
            whole = "\n".join(held)
            images = re.findall(r"!\[[^\]]*\]\(([^)\s]+)[^)]*\)", whole)
            links = re.findall(r"(?<!!)\[[^\]]*\]\(([^)\s]+)[^)]*\)", whole)
            blocks.append(_block(kind, whole, links=links, images=images))
        kind, held = "", []

    for line in text.split("\n"):
        bare = line.strip()
        if fence:
            if bare.startswith(fence):
                close()
                fence = ""
            else:
                held.append(line)
        elif m := re.match(r"(`{3,}|~{3,})", bare):
            close()
            kind, fence = "code", m[1]
        elif m := re.match(r"(#{1,6})\s+(.*?)\s*#*$", bare):
            close()
            blocks.append(_block("heading", m[2], len(m[1])))
        elif not bare:
            close()
        else:
            new = "quote" if bare.startswith(">") else "table" if bare.startswith("|") else "list_item" if re.match(r"([-*+]|\d+[.)])\s+", bare) else "paragraph"
            if new == "list_item" or new != kind and not (kind == "list_item" and new == "paragraph"):
                close()
                kind = new
            held.append(re.sub(r"^(>\s?|([-*+]|\d+[.)])\s+)", "", bare))
    close()
    return _sections(blocks)


class _Page(HTMLParser):
    """Collects blocks in order; text outside known elements counts as paragraphs."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[dict] = []
        self.title, self.hidden, self.kind, self.level, self.in_title = "", 0, "", 0, False
        self.parts: list[str] = []
        self.links: list[str] = []
        self.images: list[str] = []

    def close_block(self) -> None:
        raw = "".join(self.parts)
        text = raw.strip("\n") if self.kind == "code" else re.sub(r"\s+", " ", raw).strip()
        if text or self.images:
            self.blocks.append(_block(self.kind or "paragraph", text, self.level, self.links, self.images))
        self.parts, self.links, self.images, self.kind, self.level = [], [], [], "", 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag in CHROME:
            self.hidden += 1
        elif tag == "title":
            self.in_title = True
        elif self.hidden:
            return
        elif re.fullmatch("h[1-6]", tag):
            self.close_block()
            self.kind, self.level = "heading", int(tag[1])
        elif tag in KINDS:
            self.close_block()
            self.kind = KINDS[tag]
        elif tag in ("td", "th") and self.parts:
            self.parts.append(" | ")
        elif tag == "br":
            self.parts.append("\n")
        elif tag in ("div", "section", "article", "main", "ul", "ol") and self.kind in ("", "paragraph"):
            self.close_block()
        elif tag == "a" and a.get("href"):
            self.links.append(a["href"])
        elif tag == "img" and a.get("src"):
            self.images.append(a["src"])

    def handle_endtag(self, tag: str) -> None:
        if tag in CHROME:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "title":
            self.in_title = False
        elif not self.hidden and (tag in KINDS or re.fullmatch("h[1-6]", tag)):
            self.close_block()

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif not self.hidden:
            self.parts.append(data)


def html_blocks(html: str) -> list[dict]:
    page = _Page()
    page.feed(html)
    page.close()
    page.close_block()
    return _sections(page.blocks)


def html_title(html: str) -> str:
    page = _Page()
    page.feed(html)
    return re.sub(r"\s+", " ", page.title).strip()


def notebook_blocks(text: str) -> list[dict]:
    """Markdown cells as Markdown, code cells as code. A text that isn't a notebook has no blocks."""
    try:
        cells = json.loads(text).get("cells", [])
    except (ValueError, AttributeError):
        return []
    blocks: list[dict] = []
    for cell in cells:
        source = cell.get("source", "")
        source = "".join(source) if isinstance(source, list) else source
        if source.strip():
            blocks += markdown_blocks(source) if cell.get("cell_type") == "markdown" else [_block("code", source)] if cell.get("cell_type") == "code" else []
    return _sections(blocks)


def plain_blocks(text: str) -> list[dict]:
    return _sections([_block("paragraph", p.strip()) for p in re.split(r"\n\s*\n", text) if p.strip()])


READERS: dict[str, Callable[[str], list[dict]]] = {"md": markdown_blocks, "html": html_blocks, "htm": html_blocks, "ipynb": notebook_blocks, "txt": plain_blocks}


def text_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (key, text) in slices of at most SLICE_BYTES of text, or one row: what is made of a slice is all that is held at once."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
            yield b.slice(at, to - at)
            at = to


def blocks(df: DataFrame, key: str, text: str, reader: str | Callable[[str], list[dict]]) -> DataFrame:
    """key and a row for each block of each text; a null text has none."""
    read = READERS[reader] if isinstance(reader, str) else reader
    kinds = pa.list_(pa.struct([("n", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("level", pa.int32()), ("section", pa.list_(pa.string())), ("links", pa.list_(pa.string())), ("images", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([read(t or "") for t in b.column(1).to_pylist()], kinds)], names=[key, "b"])

    made = df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, b array<struct<{', '.join(x.replace(' ', ': ', 1) for x in BLOCK.split(', '))}>>")
    return made.select(key, F.inline("b"))


def plain_paragraphs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Paragraphs between empty lines, in columns only: n, text, and the characters from which to which they go."""
    parts = df.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n\n")).alias("n", "text"))
    before = F.sum(F.length("text") + 2).over(Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    out = parts.withColumn("char_start", F.coalesce(before, F.lit(0))).withColumn("char_end", F.col("char_start") + F.length("text"))
    return out.where(F.trim("text") != "")


_TIME = re.compile(r"(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{3})")


def seconds(stamp: str) -> float | None:
    m = _TIME.search(stamp)
    return None if not m else int(m[1] or 0) * 3600 + int(m[2]) * 60 + int(m[3]) + int(m[4]) / 1000


def caption_cues(text: str) -> list[dict]:
    """Cues of WebVTT, SRT or a JSON list: start, end and text. Tags go, rolling captions are joined, repeats dropped."""
    cues: list[dict] = []
    if text.lstrip()[:1] in ("[", "{"):
        found = json.loads(text)
        found = found.get("segments", []) if isinstance(found, dict) else found
        return [{"start": float(x.get("start", 0)), "end": float(x.get("end", x.get("start", 0))), "text": str(x.get("text", "")).strip()} for x in found]
    for part in re.split(r"\n\s*\n", text.replace("\r\n", "\n")):
        lines = part.strip().split("\n")
        at = next((k for k, x in enumerate(lines) if "-->" in x), None)
        if at is None:
            continue
        start, end = (seconds(x) for x in lines[at].split("-->"))
        said = " ".join(re.sub(r"<[^>]+>", "", x).strip() for x in lines[at + 1 :]).strip()
        if start is None or end is None or not said:
            continue
        if cues and said == cues[-1]["text"]:
            cues[-1]["end"] = end
        elif cues and start - cues[-1]["end"] < 0.5 and said.startswith(cues[-1]["text"][:20]):
            cues[-1] |= {"text": said, "end": end}
        else:
            cues.append({"start": start, "end": end, "text": said})
    return cues


def captions(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, n, start, end and text of every cue."""
    kind = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([caption_cues(t or "") for t in b.column(1).to_pylist()], kind)], names=[key, "c"])

    made = df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, c array<struct<start: double, end: double, text: string>>")
    return made.select(key, F.posexplode("c").alias("n", "c")).select(key, "n", "c.start", "c.end", "c.text")


def webvtt(cues: DataFrame, key: str) -> DataFrame:
    """key and vtt: cues (n, start, end, text) as a WebVTT text."""
    at = lambda s: F.concat(F.date_format(F.timestamp_seconds(s), "HH:mm:ss"), F.lit("."), F.lpad((F.floor(s * 1000) % 1000).cast("string"), 3, "0"))
    one = F.concat(at(F.col("start")), F.lit(" --> "), at(F.col("end")), F.lit("\n"), F.col("text"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", one.alias("c")))), lambda x: x["c"]), "\n\n")
    return cues.groupBy(key).agg(F.concat(F.lit("WEBVTT\n\n"), body, F.lit("\n")).alias("vtt"))
