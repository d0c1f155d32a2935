"""Removal of repeated passages by compressed FM-indexes.

A window is so many words of one document. Its key is the least hash among its runs of six words, so equal windows have
equal keys. A segment is a run of windows of one document with the same key. A key that comes up once holds nothing that
repeats, and that is all that keys decide. The segments of the others are dealt to shards by key: of each distinct segment
the first (least doc_id, then start) goes into the shard's FM-index (a wavelet matrix of the BWT, sampled places), and
every segment with the key, of whatever document, is streamed through it. Backward search gives the matching statistics;
the places in the interval of a match as long as a window tell where the window is first, and windows that start
elsewhere go. Words are compared as they are, hashes only say which words to compare. Segments equal word for word are
searched once a shard. So a document is only ever held against what shares a key with it, never against all shards.

A key that very many documents hold is salted: its index stands in several shards, each of which streams a part of its
segments. A key with more distinct text than a shard (a passage in ever other surroundings) is replaced by keys of single
windows, of which those that come up once drop out, so that no index outgrows a shard.

Defined cases: null and empty texts and those shorter than a window lose nothing; very long texts are one document; a row
is known by its doc_id and its text, so rows that share a doc_id but not the text are different documents, in order of the
texts' hashes, and rows equal in both are one document, whose copies lose the same words; a null doc_id counts as the
largest; repeated passages within a document go as well; other columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.fm_index import FMIndex
from tessera.llm.shared import _BLANK, _powers, documents, mix, pieces_of, stored, texts_of, trim, word_hashes, word_places

WINDOW, GRAM = 20, 6
#: Words of a shard, of an index, and of what a key streams through one index.
SHARD_WORDS = 250_000
#: Segments that a task gathers before it joins equal keys.
GATHERED = 250_000
_STEP = np.uint64(0x2545F4914F6CDD1D)
_LAST = (1 << 63) - 1
_K, _H = "__tessera_k", "__tessera_h"


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every run of so many values."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (width - have)], values[width - have :]) if have < width else values


def codes_of(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of words."""
    up, down = _powers(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] ^ mix((ends - starts).astype(np.uint64)))


def segments_of(words: np.ndarray, firsts: np.ndarray, window: int = WINDOW, coded: bool = True) -> tuple[np.ndarray, ...]:
    """Of the word hashes of some documents (firsts: where each begins, and the end): each segment's document, key, code (if asked for), start, number of words, and whether a window may occur in it twice."""
    if len(words) < window:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, bool))
    grams = np.zeros(len(words) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        grams = grams * _STEP + words[k : k + len(grams)]
    grams = mix(grams)
    keys = least_of(grams, window - GRAM + 1)
    of = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    at = np.flatnonzero(of[: len(keys)] == of[window - 1 :])  # windows within a document
    new = np.ones(len(at), bool)
    new[1:] = (keys[at[1:]] != keys[at[:-1]]) | (of[at[1:]] != of[at[:-1]])
    head = np.flatnonzero(new)
    starts, ends = at[head], at[np.append(head[1:], len(at))[: len(head)] - 1] + window
    # A window that is there twice has its key's run there twice.
    sizes = ends - starts - GRAM + 1
    segment = np.repeat(np.arange(len(starts)), sizes)
    runs = np.arange(len(segment)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[segment]
    twice = np.bincount(segment[grams[runs] == keys[starts][segment]], minlength=len(starts)) > 1
    return of[starts], keys[starts], codes_of(words, starts, ends) if coded else keys[:0], starts - firsts[of[starts]], ends - starts, twice


def identified(df: DataFrame) -> DataFrame:
    """df with what tells its documents apart, in their order: the doc_id (null: the largest bigint) and a hash of doc_id and text."""
    return df.withColumns({_K: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)), _H: F.xxhash64("doc_id", "text")})


def _keys(docs: DataFrame, window: int) -> DataFrame:
    """gram, n and twice: how many segments have each key, and whether a window may be twice in one; summed in parts of a task."""

    def joined(gram: list[np.ndarray], twice: list[np.ndarray]) -> pa.RecordBatch:
        keys, at, n = np.unique(np.concatenate(gram), return_inverse=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n), pa.array(np.bincount(at, np.concatenate(twice)) > 0)], names=["gram", "n", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, twices, n = [], [], 0
        for b in pieces_of(batches):
            hashes, firsts, _, _ = word_hashes(texts_of(b))
            _, gram, _, _, _, twice = segments_of(hashes, firsts, window, coded=False)
            grams.append(gram)
            twices.append(twice)
            n += len(gram)
            if n > GATHERED:
                yield joined(grams, twices)
                grams, twices, n = [], [], 0
        if n:
            yield joined(grams, twices)

    return docs.select("text").mapInArrow(run, "gram bigint, n bigint, twice boolean")


def _segments(docs: DataFrame, window: int) -> DataFrame:
    """gram (the key), code, k, h, start and words of every segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(batches):
            hashes, firsts, _, _ = word_hashes(texts_of(b))
            row, gram, code, start, words, _ = segments_of(hashes, firsts, window)
            k, h = (np.asarray(b.column(c))[row] for c in (0, 1))
            columns = [gram.view(np.int64), code.view(np.int64), k, h, start.astype(np.int32), words.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["gram", "code", "k", "h", "start", "words"])

    return docs.select("k", "h", "text").mapInArrow(run, "gram bigint, code bigint, k bigint, h bigint, start int, words int")


def _windows(docs: DataFrame, met: DataFrame, window: int) -> DataFrame:
    """The windows of segments as segments of their own, each with itself as the key; those that come up once drop out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(batches):
            hashes, firsts, _, _ = word_hashes(texts_of(b))
            for k, h, at, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), firsts, b.column(3).to_pylist(), strict=False):
                for x in wanted:
                    for p in range(x["start"], x["start"] + x["words"] - window + 1, 20_000):
                        start = np.arange(p, min(p + 20_000, x["start"] + x["words"] - window + 1))
                        code = pa.array(codes_of(hashes[at + p : at + start[-1] + window], start - p, start - p + window).view(np.int64))
                        fixed = [pa.array(np.full(len(start), v, t)) for v, t in ((k, np.int64), (h, np.int64), (window, np.int32))]
                        yield pa.RecordBatch.from_arrays([code, code, fixed[0], fixed[1], pa.array(start.astype(np.int32)), fixed[2]], names=["gram", "code", "k", "h", "start", "words"])

    wanted = met.groupBy("k", "h").agg(F.collect_list(F.struct("start", "words")).alias("wanted"))
    rows = docs.join(wanted, ["k", "h"]).select("k", "h", "text", "wanted").mapInArrow(run, "gram bigint, code bigint, k bigint, h bigint, start int, words int")
    rows = stored(rows.distinct(), "windows", cleaned=True)  # copies of a row have the same windows
    return rows.join(rows.groupBy("gram").count().where("count > 1"), "gram", "left_semi")


def _first(met: DataFrame) -> DataFrame:
    """Of each distinct segment the first one, and how many there are."""
    return met.groupBy("gram", "code").agg(F.min(F.struct("k", "h", "start")).alias("at"), F.max("words").alias("words"), F.count("*").alias("n"))


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Of a column of lists of structs: the row of each struct, and the structs' fields."""
    structs = lists.flatten()
    return np.repeat(np.arange(len(lists)), np.asarray(pc.fill_null(pc.list_value_length(lists), 0))), dict(zip([f.name for f in structs.type], structs.flatten(), strict=True))


def _texts(docs: DataFrame) -> DataFrame:
    """shard, first (it goes into the index), k, h, start and words of every segment listed in the column wanted, with gram and salts where it goes to a shard for each salt."""
    names = ["shard", "first", "k", "h", "start", "words", "gram", "salts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(batches):
            data, firsts, starts, ends = word_places(texts_of(b))
            # Words with one blank after each.
            line, inside = data.copy(), ~_BLANK[data]
            line[ends], inside[ends] = ord(" "), True
            line, begins = line[inside].tobytes(), np.append(0, np.cumsum(ends - starts + 1))
            of, fields = _flat(b.column(3))
            shard, start, words, first = (np.asarray(fields[c]) for c in ("shard", "start", "words", "first"))
            # A segment that is streamed and in the index of one shard goes there once.
            same = of, start, words, shard, np.asarray(pc.fill_null(fields["gram"], 0)), np.asarray(pc.fill_null(fields["salts"], 0))
            order = np.lexsort((~first, *same))
            new = np.ones(len(order), bool)
            new[1:] = np.any([c[order[1:]] != c[order[:-1]] for c in same], axis=0)
            picked = order[new]
            for p in range(0, len(picked), 20_000):
                part = picked[p : p + 20_000]
                row, at = of[part], firsts[of[part]] + start[part]
                texts = [line[p:q] for p, q in zip(begins[at].tolist(), (begins[at + words[part]] - 1).tolist(), strict=True)]
                columns = [pa.array(shard[part]), pa.array(first[part]), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(start[part]), pa.array(texts, pa.binary()), fields["gram"].take(pa.array(part)), fields["salts"].take(pa.array(part))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("k", "h", "text", "wanted").mapInArrow(run, "shard int, first boolean, k bigint, h bigint, start int, words binary, gram bigint, salts int")


def shard_spans(shard: pa.Table, window: int = WINDOW) -> pa.Table:
    """The spans (k, h, start, words) of a shard's segments whose windows start earlier, by the index of the shard's first ones."""
    shard = shard.combine_chunks()
    # Distinct segments, and their words, numbered by what they are.
    encoded = shard["words"].combine_chunks().dictionary_encode()
    of, split = np.asarray(encoded.indices), pc.split_pattern(encoded.dictionary.cast(pa.string()), " ")
    sizes = np.asarray(pc.list_value_length(split), np.int64)
    at = np.cumsum(sizes) - sizes
    symbols = np.asarray(split.flatten().dictionary_encode().indices, np.int64) + 1
    ks, hs, starts, first = (np.asarray(shard[c]) for c in ("k", "h", "start", "first"))
    # The index: segments stand in the order of documents and places, a 0 after each.
    inside = np.flatnonzero(first)
    inside = inside[np.lexsort((starts[inside], hs[inside], ks[inside]))]
    own = sizes[of[inside]] + 1
    begins = np.cumsum(own) - own
    within = np.arange(int(own.sum())) - np.repeat(begins, own)
    text = np.append(symbols, 0)[np.where(within < np.repeat(own - 1, own), np.repeat(at[of[inside]], own) + within, -1)]
    index = FMIndex(text, window)
    # Distinct segments are streamed through it.
    queries = np.where(symbols < index.size, symbols, 0)
    length, lows, _ = index.matching_statistics(queries, at, at + sizes)
    # Where each window found is first: the least of its interval's places.
    hits = np.flatnonzero(length == window)
    groups, member = np.unique(lows[hits].astype(np.int64), return_inverse=True)
    width = index.group(groups, window)[1] - groups
    edge = np.cumsum(width) - width
    rows = np.arange(int(width.sum())) - np.repeat(edge - groups, width)
    earliest = np.full(len(queries), -1, np.int64)
    if len(hits):
        earliest[hits] = np.minimum.reduceat(index.locate(rows), edge)[member]
    # Every segment, copies too, is held against these places.
    n = sizes[of] - window + 1
    row = np.repeat(np.arange(len(of)), n)
    off = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    place = earliest[at[of[row]] + off]
    source = np.searchsorted(begins, place, "right") - 1
    lead = inside[np.maximum(source, 0)]
    own = (ks[lead] == ks[row]) & (hs[lead] == hs[row]) & (starts[lead] + place - begins[np.maximum(source, 0)] == starts[row] + off)
    gone = np.flatnonzero((place >= 0) & ~own)
    # Windows that follow one another make one span.
    new = np.ones(len(gone), bool)
    new[1:] = (row[gone][1:] != row[gone][:-1]) | (gone[1:] - gone[:-1] > 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(gone))[: len(head)] - 1
    rows = row[gone[head]]
    spans = {"k": ks[rows], "h": hs[rows], "start": (starts[rows] + off[gone[head]]).astype(np.int32), "words": (gone[tail] - gone[head] + window).astype(np.int32)}
    return pa.table({c: pa.array(v) for c, v in spans.items()})


def shards_of(docs: DataFrame, window: int = WINDOW) -> DataFrame | None:
    """The rows of _texts() for documents (k, h, text): every segment whose key comes up again, dealt to shards; None where there is none."""
    keys = _keys(docs, window).groupBy("gram").agg(F.sum("n").alias("n"), F.max("twice").alias("twice")).where("n > 1 OR twice")
    met = stored(_segments(docs, window).join(keys, "gram", "left_semi"), "segments", cleaned=True)
    codes = stored(_first(met), "codes", cleaned=True)
    loads = lambda codes: codes.groupBy("gram").agg(F.sum("words").alias("own"), F.sum(F.col("words") * F.col("n")).alias("streamed"))
    wide = loads(codes).where(F.col("own") > SHARD_WORDS)
    if not wide.isEmpty():
        wide = stored(wide.select("gram"), "wide")
        windows = stored(_windows(docs, met.join(wide, "gram", "left_semi"), window), "windows", cleaned=True)
        met = met.join(wide, "gram", "left_anti").union(windows)
        codes = stored(codes.join(wide, "gram", "left_anti").union(_first(windows)), "codes", cleaned=True)
    # The copies of a key's index never have more words than what is streamed through them.
    salts = F.greatest(F.lit(1), F.least(F.ceil(16 * F.col("streamed") / SHARD_WORDS), F.floor(F.col("streamed") / F.col("own")))).cast("int")
    sizes = stored(loads(codes).withColumn("salts", salts), "loads", cleaned=True)
    total = sizes.agg(F.sum(F.col("streamed") + F.col("own") * F.col("salts"))).first()[0]
    if not total:
        return None
    many, n = sizes.where("salts > 1").select("gram", "salts"), F.coalesce("salts", F.lit(1))
    n_shards = F.lit(-(-total // SHARD_WORDS))
    shard = lambda salt: F.pmod(F.xxhash64("gram", salt), n_shards).cast("int")
    nothing = [F.lit(None).cast("bigint").alias("gram"), F.lit(None).cast("int").alias("salts")]
    place = ["k", "h", "start", "words"]
    streamed = met.join(many, "gram", "left").select(*place, shard(F.pmod(F.xxhash64("k", "h", "start"), n).cast("int")).alias("shard"), F.lit(False).alias("first"), *nothing)
    # A first segment of a salted key is cut out of its document once; its copies are made as rows.
    index = codes.select("gram", "at.*", "words").join(many, "gram", "left").select(*place, F.when(n > 1, -1).otherwise(shard(F.lit(0))).alias("shard"), F.lit(True).alias("first"), F.when(n > 1, F.col("gram")).alias("gram"), "salts")
    wanted = streamed.union(index).groupBy("k", "h").agg(F.collect_list(F.struct("shard", "start", "words", "first", "gram", "salts")).alias("wanted"))
    if not docs.groupBy("k", "h").count().where("count > 1").isEmpty():
        docs = docs.dropDuplicates(["k", "h"])
    rows = _texts(docs.join(wanted, ["k", "h"]))
    copies = F.when(F.col("shard") >= 0, F.array("shard")).otherwise(F.transform(F.sequence(F.lit(0), F.col("salts") - 1), shard))
    return rows.select(F.explode(copies).alias("shard"), "first", *place)


def repeated_spans(df: DataFrame, window: int = WINDOW) -> DataFrame:
    """k and h (see identified()), start and words of spans of words whose windows also start earlier. Spans may overlap."""
    parts = shards_of(identified(df).select(F.col(_K).alias("k"), F.col(_H).alias("h"), "text"), window)
    shape = "k bigint, h bigint, start int, words int"
    if parts is None:
        return df.sparkSession.createDataFrame([], shape)

    def search(shard: pa.Table) -> pa.Table:
        out = shard_spans(shard, window)
        trim()
        return out

    return stored(parts.groupBy("shard").applyInArrow(search, shape), "spans", cleaned=True)


def _with_spans(df: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """df with the array of its documents' spans; nothing else tells rows apart than what identified() says."""
    by_doc = spans.groupBy(F.col("k").alias(_K), F.col("h").alias(_H)).agg(F.collect_list(F.struct("start", "words")).alias(key))
    return identified(df).join(by_doc, [_K, _H], "left").drop(_K, _H)


def _edges(spans: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """Where each row's spans begin and end; None where there is none."""
    of, fields = _flat(spans)
    if not len(of):
        return [None] * len(spans)
    starts = np.asarray(fields["start"])
    ends = starts + np.asarray(fields["words"])
    at = np.searchsorted(of, np.arange(len(spans) + 1)).tolist()
    return [(starts[p:q], ends[p:q]) if p < q else None for p, q in zip(at[:-1], at[1:], strict=True)]


def _keep(text: bytes, edges: tuple[np.ndarray, np.ndarray] | None) -> tuple[list[bytes], int]:
    """The words that stay, and how many go."""
    words = text.split()
    if edges is None:
        return words, 0
    begun, ended = (np.bincount(e, minlength=len(words) + 1) for e in edges)
    stay = np.cumsum(begun - ended)[:-1] == 0
    return list(compress(words, stay.tolist())), int(len(words) - stay.sum())


def remove_repeats(df: DataFrame, window: int = WINDOW) -> DataFrame:
    """df with the repeated spans taken out of its texts; what stays of such a text is joined by blanks, and n_chars (if there) is its length."""
    key = "__tessera_spans"
    marked = _with_spans(df, repeated_spans(df, window), key)
    names = df.columns
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(batches):
            spans = _edges(b.column(b.schema.get_field_index(key)))
            old = b.column(b.schema.get_field_index("text")).to_pylist()
            text = [b" ".join(_keep(t.encode(), s)[0]).decode() if s else t for t, s in zip(old, spans, strict=True)]
            columns = {c: b.column(b.schema.get_field_index(c)) for c in names} | {"text": pa.array(text, pa.string())}
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([len(t) if s else n for t, s, n in zip(text, spans, columns["n_chars"].to_pylist(), strict=True)], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return marked.select(*df.columns, key).mapInArrow(run, schema)


def op2_fm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, how many go, and the digest of those that stay."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    marked = _with_spans(docs, repeated_spans(docs), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(batches):
            rows = []
            for text, spans in zip(texts_of(b), _edges(b.column(2)), strict=True):
                stay, gone = _keep(text, spans)
                rows.append((len(stay) + gone, gone, hashlib.sha256(b" ".join(stay)).hexdigest()))
            n, gone, digest = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return marked.select("doc_id", "text", "spans").mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
