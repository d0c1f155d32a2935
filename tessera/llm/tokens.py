"""Token ids by a public tokenizer, and their Parquet form: list columns in id order with bounded row groups and page indexes.

The file format. One row is one document: doc_id, n_tokens, tokens (list of int). Files and rows ascend by doc_id, so a
reader that asks for a range of ids skips files, row groups and, by the page index, pages; one that asks for metadata
never touches the token column. Ids use dictionary encoding where a column chunk's dictionary fits and the format's
version 2 encodings (delta) beyond it; chunks are compressed with zstd.

Defined cases: a null text is an empty one (the end id alone); a null doc_id comes first; rows with equal doc_id are
neighbours, ordered by text; very long texts are one row; an empty table gives a table without rows.
"""

from __future__ import annotations

import codecs
import functools
import gc
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import Remembered, documents, pieces_of, shared_dir, stored, texts_of

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
#: Words whose ids a Python worker keeps in each of two generations.
CACHED_WORDS = 250_000
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 16 << 20, 64 << 10, 2_000


#: Bytes that the byte-level alphabet writes as other characters than Latin-1 does: in order, those from U+0100 on.
_OTHER = {byte: 256 + k for k, byte in enumerate(x for x in range(256) if not (33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255))}
_ALPHABET = "".join(chr(_OTHER.get(byte, byte)) for byte in range(256))
#: Bytes of texts without characters beyond U+027F: none of these joins its neighbours, so a text may be put in lower case before it is composed.
_APART = bytes([*range(0xC0), *range(0xC2, 0xCA)])
#: Numbers of ids that are written most often.
_PACKED = [struct.Struct(f"<{n}I").pack for n in range(33)]
_SIMPLE = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F]+)([!-&(-/:-@\[-`{-~]*)").fullmatch


class WordEncoder:
    """A tokenizers file whose pre-tokenizer drops white space, so that a text's ids are its words' ids in turn.

    Each word is encoded by the library when it comes up, and remembered for a while. A word of Latin letters in composed form, with or without
    marks behind it, is just what the normalizer and pre-tokenizer cut in two, and goes straight to the library's model;
    every other word goes through the whole tokenizer, which also finds the strings of special tokens in it, as the library
    does unless told otherwise.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words = Remembered(self._word, CACHED_WORDS)
        self.plain = self._is_plain(path)
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    @staticmethod
    def _is_plain(path: str) -> bool:
        """Whether the file has the steps that the short way stands for: compose, lower case; cut at letters and marks, byte-level alphabet."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [x["type"] for part in (spec["normalizer"], spec["pre_tokenizer"]) for x in (part or {}).get("normalizers", (part or {}).get("pretokenizers", []))]
        # A special token must begin with a mark, hold a letter and no blank: then none spans words, or is in a word of letters and the marks behind it.
        if any(t["lstrip"] or t["rstrip"] or t["normalized"] or t["content"][:1].isalpha() or not any(map(str.isalpha, t["content"])) or len(t["content"].split()) != 1 for t in spec["added_tokens"]):
            return False
        return steps == ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"] and "[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]

    def _part(self, key: bytes) -> bytes:
        """The ids of letters in lower case."""
        written = key.decode("ascii") if key.isascii() else codecs.charmap_decode(key, "strict", _ALPHABET)[0]
        found = [t.id for t in self.model.tokenize(written)]
        return _PACKED[len(found)](*found) if len(found) < len(_PACKED) else struct.pack(f"<{len(found)}I", *found)

    def _letters(self, low: bytes) -> bytes:
        """The same, remembered: what a word of such letters alone would be."""
        found = self.words.get(low)
        if found is None:
            found = self.words.older.get(low) or self._part(low)
            if len(low) <= self.words.longest:
                self.words[low] = found
        return found

    def _word(self, word: bytes) -> bytes:
        if self.plain:
            if word.isalpha():
                low = word.lower()
                return self._part(word) if low == word else self._letters(low)
            if word[:-1].isalpha() and word[-1] in b".,;:!?":
                return self._letters(word[:-1].lower()) + self.words[word[-1:]]
            if m := _SIMPLE(word.decode()):
                letters, marks = m.groups()
                low = letters.lower().encode()
                return self._part(word) if low == word else self._letters(low) + (self.words[marks.encode()] if marks else b"")
        found = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
        return struct.pack(f"<{len(found)}I", *found)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        ids = self.words.__getitem__
        return [b"".join(map(ids, self._lowered(t).split())) for t in texts]

    def _lowered(self, text: bytes) -> bytes:
        """A text with A to Z in lower case, where this leaves its ids as they are: fewer words are told apart."""
        if not self.plain or text.translate(None, _APART):
            return text
        low = text.lower()
        return text if any(s in low for s in self.special) else low


@functools.lru_cache(2)
def encoder(path: str) -> WordEncoder:
    made = WordEncoder(path)
    gc.freeze()  # what is there now stays; looking for cycles in it again and again would cost
    return made


def encode_documents(df: DataFrame, end_id: int | None = END_ID, tokenizer: str = WORD_BPE) -> DataFrame:
    """doc_id and tokens (array of int) of each row, in the order of the rows; the end id closes each document."""
    tail = b"" if end_id is None else np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in pieces_of(batches):
            ids = [x + tail for x in enc.encode(texts_of(b))]
            ends = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) // 4 for x in ids], out=ends[1:])
            values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], names=["doc_id", "tokens"])

    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, tokens array<int>")


def write_tokens(df: DataFrame, path: str, end_id: int | None = END_ID, tokenizer: str = WORD_BPE) -> None:
    """Write the token table of documents. Texts are dealt out by ranges of doc_id and sorted before they are encoded, so that ids are never shuffled."""
    dealt = df.select("doc_id", "text").repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    out = encode_documents(dealt, end_id, tokenizer).select("doc_id", F.size("tokens").alias("n_tokens"), "tokens")
    (
        out.write.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "true")
        .option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES).option("parquet.page.row.count.limit", PAGE_ROWS).parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None, columns: tuple[str, ...] = ("doc_id", "n_tokens", "tokens")) -> DataFrame:
    """Rows whose doc_id lies between the bounds (both kept), and only the named columns; the bounds reach the scan."""
    df = spark.read.schema("doc_id bigint, n_tokens int, tokens array<int>").parquet(path)
    if low is not None:
        df = df.where(F.col("doc_id") >= low)
    if high is not None:
        df = df.where(F.col("doc_id") <= high)
    return df.select(*columns)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row the number of ids and the crc32 of their bytes."""
    for b in batches:
        tokens = b.column(b.schema.get_field_index("tokens"))
        values, ends = np.asarray(tokens.values, dtype="<u4"), np.asarray(tokens.offsets)
        sums = [zlib.crc32(values[p:q].tobytes()) for p, q in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(3)), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())], names=["doc_id", "file", "line", "n_tokens", "ids_crc32"])


def token_positions(spark: SparkSession, path: str) -> DataFrame:
    """Of each row of a token table: doc_id, start (ids before it in the whole table), n_tokens and ids_crc32, from the stored ids.

    Starts are sums within each file after the sums of the files before it; the only ordering over everything is of one row a file.
    """
    read = spark.read.schema("doc_id bigint, tokens array<int>").parquet(path)
    read = read.select("doc_id", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)-", 1).cast("long").alias("file"), F.col("_metadata.row_index").alias("line"), "tokens")
    rows = stored(read.mapInArrow(_sums, "doc_id bigint, file bigint, line bigint, n_tokens bigint, ids_crc32 bigint"), "token-sums")
    before = F.sum("total").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("total")).select("file", F.coalesce(before, F.lit(0)).alias("base"))
    within = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("within", F.coalesce(within, F.lit(0))).join(files, "file").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded, written in doc_id order and read back. A null text has the end id alone."""
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(documents(spark, sf_dir), path)
    return token_positions(spark, path)
