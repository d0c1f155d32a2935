"""Ranked lexical search: best-first over document intervals, bounded by range maxima of posting lists.

The index is a table: runs of documents make shards, and a row holds one term's posting list in one shard (places in order of
doc_id, and how often it occurs), another each shard's documents. Tasks that read the documents write it without a shuffle.

A search meets the index with its items' terms, and each shard with each block of items. In a shard a posting list becomes
impacts, the terms' exact contributions to a document's score, with a sparse table of range maxima over them. An item begins
with the interval of all documents. The maxima of its lists within an interval sum to a bound of every score in it; the
interval of the highest bound is taken next and split at its maximum-impact document, whose score is computed, into the
intervals before and after. Intervals that can't reach the best documents found so far are dropped, so that most documents are
never scored. Shards' best documents are ranked together at the end.

Defined cases: null, empty and blank texts have no terms; such documents count for nothing and are never found, such items
find nothing; an item's terms count once each; item ids that several rows share are one item with all their terms; a null
item_id is one too; documents that share an id are ranked each; a null doc_id stands after all others among equal scores; a
text of any length is read whole, a piece at a time; empty tables give no rows. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import CHUNK_BYTES, documents, pieces_of, stored, texts_of, trim

#: Documents and bytes of text of a shard; items of a block; intervals split at a time.
SHARD, SHARD_BYTES, ITEMS, SPLIT = 8192, 24 << 20, 256, 32
#: Up to so many terms, or items, their table is broadcast (some 10 MB at most); beyond, it is salted.
MOST_BROADCAST, MOST_ITEMS, SALTS = 200_000, 20_000, 32
_TERM, _GAP = re.compile(rb"[0-9A-Za-z\x80-\xff]+"), re.compile(rb"[^0-9A-Za-z\x80-\xff]")
_FOUND = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
_INDEX = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("held", pa.int64()), ("total", pa.int64()), ("places", pa.binary()), ("counts", pa.binary()), ("ids", pa.list_(pa.int64()))])


def terms(text: bytes, most: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """The text's terms, piece by piece: runs of ASCII letters, digits and characters beyond ASCII, A-Z in lower case."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + most) if at + most < len(text) else None
        end = gap.start() if gap else len(text)
        yield _TERM.findall(text[at:end].lower())
        at = end


class Shard:
    """Postings of the documents added so far."""

    def __init__(self) -> None:
        self.ids, self.bytes, self.found, self.lengths = [], 0, [], []
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__

    def add(self, doc_id: int | None, text: bytes) -> None:
        n = 0
        for words in terms(text):
            n += len(words)
            of, tf = np.unique(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)), return_counts=True)
            self.found.append((of << 32 | len(self.ids), tf))
        self.ids.append(doc_id)
        self.lengths.append(n)
        self.bytes += len(text)

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        """A row for the documents, then one for each term."""
        order = sorted(range(len(self.ids)), key=lambda k: (self.ids[k] is None, self.ids[k] or 0))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        lengths = np.asarray(self.lengths, np.int64)[order]
        head = [[shard], [None], [int((lengths > 0).sum())], [int(lengths.sum())], [lengths.tobytes()], [None], [[self.ids[k] for k in order]]]
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(head, _INDEX, strict=True)], schema=_INDEX)
        if not self.numbers:
            return
        keys, tf = (np.concatenate(x) for x in zip(*self.found, strict=True))
        keys = keys & ~np.int64(0xFFFFFFFF) | place[keys & 0xFFFFFFFF]
        by = np.argsort(keys, kind="stable")
        keys, tf = keys[by], tf[by]
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))  # a long document's pieces meet
        keys, tf = keys[new], np.add.reduceat(tf, new)
        starts = np.searchsorted(keys, np.arange(len(self.numbers) + 1, dtype=np.int64) << 32)
        names = pa.array(list(self.numbers), pa.binary()).cast(pa.string())
        offsets = pa.py_buffer((4 * starts).astype(np.int32))
        lists = [pa.BinaryArray.from_buffers(pa.binary(), len(names), [None, offsets, pa.py_buffer(x.astype(np.int32))]) for x in (keys & 0xFFFFFFFF, tf)]
        columns = [pa.array(np.full(len(names), shard)), names, pa.array(np.diff(starts)), pa.array(np.add.reduceat(tf, starts[:-1])), *lists, pa.nulls(len(names), _INDEX.field("ids").type)]
        rows = pa.RecordBatch.from_arrays(columns, schema=_INDEX)
        for at in range(0, len(names), 50_000):
            yield rows.slice(at, 50_000)


def index_documents(docs: DataFrame, text: str = "text", shard: int = SHARD, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of all terms of all documents, written to the shared folder: shard, term (null: the shard's documents), held (documents with the term, or with any), total (its occurrences, or all), places, counts, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done, now = TaskContext.get().partitionId(), 0, Shard()
        for b in pieces_of(batches):
            for doc_id, t in zip(b.column(0).to_pylist(), texts_of(b), strict=True):
                now.add(doc_id, t)
                if len(now.ids) >= shard or now.bytes >= shard_bytes:
                    yield from now.rows(task << 32 | done)
                    done, now = done + 1, Shard()
        if now.ids:
            yield from now.rows(task << 32 | done)
        del now
        trim()

    kinds = "shard bigint, term string, held bigint, total bigint, places binary, counts binary, ids array<bigint>"
    return stored(docs.select(F.col("doc_id").cast("bigint"), F.col(text).alias("text")).mapInArrow(run, kinds), "postings")


def item_terms(items: DataFrame, text: str = "text") -> DataFrame:
    """item_id and each of its terms, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(batches):
            found = [list({w for part in terms(t) for w in part}) for t in texts_of(b)]
            of = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), pa.array([w for x in found for w in x], pa.binary()).cast(pa.string())], names=["item_id", "term"])

    return items.select(F.col("item_id").cast("bigint"), F.col(text).alias("text")).mapInArrow(run, "item_id bigint, term string").distinct()


class Ranges:
    """An item's posting lists, end to end, with a sparse table of their range maxima: level k has the place of the greatest impact among 2^k postings. Windows are asked only within one list."""

    def __init__(self, lists: list[tuple[np.ndarray, np.ndarray]], documents: int):
        self.stride = documents + 1
        self.base = np.arange(len(lists)) * self.stride
        self.firsts = np.concatenate([[0], np.cumsum([len(p) for p, _ in lists])])
        self.places = np.concatenate([p + b for (p, _), b in zip(lists, self.base, strict=True)])
        self.impacts = np.append(np.concatenate([i for _, i in lists]), 0)
        level = np.arange(len(self.places))
        levels, width = [level], 1
        longest = max(len(p) for p, _ in lists)
        while 2 * width <= longest:
            a, b = level[:-width], level[width:]
            level = np.where(self.impacts[b] > self.impacts[a], b, a)
            levels.append(level)
            width *= 2
        self.table = np.concatenate(levels)
        self.at = np.cumsum([0, *map(len, levels)])[:-1]
        self.log = np.zeros(longest + 1, np.int64)
        for k in range(1, len(levels)):
            self.log[1 << k :] = k

    def greatest(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and value of the greatest impact from lo to hi (exclusive), list by list; an empty range has value 0."""
        k = self.log[hi - lo]
        base, full = self.at[k], hi > lo
        a, b = self.table[np.where(full, base + lo, 0)], self.table[np.where(full, base + hi - (1 << k), 0)]
        best = np.where(self.impacts[b] > self.impacts[a], b, a)
        return best, np.where(full, self.impacts[best], 0)

    def split(self, lo: np.ndarray, hi: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of the documents, and where each list's range divides: up to, and from after, the document."""
        wanted = document[:, None] + self.base
        to = np.searchsorted(self.places, wanted)
        there = (to < hi) & (self.places[np.minimum(to, len(self.places) - 1)] == wanted)
        return np.where(there, self.impacts[to], 0).sum(axis=1), to, to + there


def best_documents(lists: list[tuple[np.ndarray, np.ndarray]], documents: int, top: int) -> tuple[list[tuple[int, int]], int]:
    """(-score, place) of the top documents with a score, best first, and how many documents were scored. lists: places (ascending) and impacts of each term."""
    lists = [x for x in lists if len(x[0])]
    if not lists:
        return [], 0
    ranges, best, scored = Ranges(lists, documents), [], 0
    lo, hi = ranges.firsts[:-1], ranges.firsts[1:]
    where, value = ranges.greatest(lo, hi)
    # An interval: its bound, its first document, a serial number, each list's range, and the ranges' maxima.
    heap: list[tuple] = [(-int(value.sum()), 0, 0, lo, hi, where, value)]
    serial = 1
    least = lambda: best[-1] if len(best) == top else (-1, documents)
    while heap and heap[0][:2] <= least():
        taken = []
        while heap and len(taken) < SPLIT and heap[0][:2] <= least():
            taken.append(heappop(heap))
        lo, hi, where, value = (np.stack([x[k] for x in taken]) for k in range(3, 7))
        lists_of_max = value.argmax(axis=1)
        document = ranges.places[where[np.arange(len(taken)), lists_of_max]] - ranges.base[lists_of_max]
        score, to, after = ranges.split(lo, hi, document)
        scored += len(taken)
        best = sorted([*best, *((-int(s), int(d)) for s, d in zip(score, document, strict=True) if s > 0)])[:top]
        lo, hi = np.concatenate([lo, after]), np.concatenate([to, hi])
        where, value = ranges.greatest(lo, hi)
        bound = -value.sum(axis=1)
        first = np.concatenate([[x[1] for x in taken], document + 1])
        worst = least()
        for k in np.flatnonzero((bound < worst[0]) | (bound == worst[0]) & (first < worst[1])):
            heappush(heap, (int(bound[k]), int(first[k]), serial, lo[k], hi[k], where[k], value[k]))
            serial += 1
    return best, scored


def _met(index: DataFrame, wanted: DataFrame, key: str, small: bool) -> DataFrame:
    """Index rows with the columns of each row of wanted that has their key. A key of many shards is salted unless wanted is small."""
    if small:
        return index.join(F.broadcast(wanted), key)
    salted = index.withColumn("__salt", F.pmod(F.xxhash64("shard"), F.lit(SALTS)).cast("int"))
    return salted.join(wanted.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, "__salt"]).drop("__salt")


def _ranked_in_shard(cell: pa.Table, n: int, total: int, top: int) -> pa.Table:
    """Best documents of each item of a block in a shard. n, total: documents with terms, and all their terms, of the whole index."""
    rows, out, postings = cell.to_pylist(), [], {}
    head = next(x for x in rows if x["term"] is None)
    lengths, ids = np.frombuffer(head["places"], np.int64), head["ids"]
    m = 100 - 90 + (90 * lengths * n) // max(1, total)
    for x in rows:
        if x["term"] is not None:
            places, tf = (np.frombuffer(x[c], np.int32).astype(np.int64) for c in ("places", "counts"))
            postings[x["term"]] = (places, x["weight"] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[places])))
    for item in head["items"]:
        best, _ = best_documents([postings[t] for t in item["terms"] if t in postings], len(ids), top)
        out += [{"item_id": item["item_id"], "doc_id": ids[place], "score": -score} for score, place in best]
    return pa.Table.from_pylist(out, schema=_FOUND)


def search(index: DataFrame, items: DataFrame, top: int = 10) -> DataFrame:
    """item_id, rank, doc_id and score of each item's best documents, by score, then by doc_id."""
    found = stored(item_terms(items), "item-terms")
    wanted = stored(found.select("term").distinct(), "terms")
    n_terms, n_items = wanted.count(), found.select("item_id").distinct().count()
    n_blocks = max(1, -(-n_items // ITEMS))
    heads = index.where(F.col("term").isNull())
    hits = stored(_met(index.where(F.col("term").isNotNull()), wanted, "term", n_terms <= MOST_BROADCAST), "hits")
    n, total = heads.agg(F.coalesce(F.sum("held"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    weight = F.floor(1000 * F.log((2.0 * n + 2) / (2 * F.sum("held") + 1))).cast("bigint")
    weights = stored(hits.groupBy("term").agg(weight.alias("weight")), "weights")
    block = F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)).cast("bigint").alias("block")
    by_block = stored(found.select(block, "term").distinct().join(weights, "term"), "block-terms")
    cells = _met(hits.select("shard", "term", "places", "counts"), by_block, "term", n_terms * n_blocks <= MOST_BROADCAST)
    asked = found.groupBy(block, "item_id").agg(F.collect_list("term").alias("terms")).groupBy("block").agg(F.collect_list(F.struct("item_id", "terms")).alias("items"))
    # Every shard meets every block of items: the items against all documents, in blocks.
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint"))).alias("block")
    heads = _met(heads.select("shard", "places", "ids", every), stored(asked, "items"), "block", n_items <= MOST_ITEMS)
    both = cells.select("shard", "block", "term", "weight", "places", "counts").unionByName(heads.select("shard", "block", "places", "ids", "items"), allowMissingColumns=True)
    best = both.groupBy("shard", "block").applyInArrow(lambda cell: _ranked_in_shard(cell, n, total, top), "item_id bigint, doc_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return best.withColumn("rank", rank).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def op13_range_maximum_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of all for every benchmark item."""
    return search(index_documents(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
