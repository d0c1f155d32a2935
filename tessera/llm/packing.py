"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm on islands.

Documents are encoded and closed by an end id; only those longer than a sequence are cut. Whole pieces fill a sequence
alone. The others are dealt at random into shards of some thousands, each packed by several islands: an island's members
are packings, at first of the pieces in random orders; crossover injects whole well-filled bins of one parent into another,
removes the bins that hold any of the same pieces and those filled badly, and best-fits the pieces thus displaced, largest
first. After each epoch an island's elites move on to the next island of its shard, where they meet new random members. In
the last epoch a packing by size joins them, so that a shard never comes to more sequences than by best fit decreasing.
Pieces from the bins that stay badly filled are gathered from all shards and packed again the same way, as long as they
fill more than one shard and get fewer, so that a shard leaves no remainder of its own.

Defined cases: a null text is an empty one and has the end id alone; rows that repeat are packed each; ties in length are
told apart by doc_id, piece and start; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import documents, pieces_of, stored, texts_of
from tessera.llm.tokens import WORD_BPE, encode_documents, encoder

CAPACITY, END_ID = 2048, 0
#: Pieces of a shard, islands, epochs, children an island and epoch, members and elites of an island.
SHARD, ISLANDS, EPOCHS, CHILDREN, MEMBERS, ELITES = 4096, 3, 3, 10, 6, 2
#: Bins below this share of the capacity are broken up by crossover, and at the end packed once more across shards.
WELL_FILLED = 0.97
#: How steeply the chance to be injected grows with how full a bin is.
STEEP = 16


def cut_pieces(df: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str = WORD_BPE) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece."""
    tail = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in pieces_of(batches):
            rows: list[tuple[int, int, int, int, int]] = []
            for k, ids in enumerate(enc.encode(texts_of(b))):
                ids += tail
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((k, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            of, piece, start, length, crc = (np.asarray(x, np.int64) for x in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint")


class Packing:
    """A member: the bin of each piece, and each bin's content."""

    def __init__(self, bins: np.ndarray, sizes: np.ndarray):
        _, self.bins = np.unique(bins, return_inverse=True)
        self.fill = np.bincount(self.bins, weights=sizes).astype(np.int64)

    def score(self, capacity: int) -> tuple[int, float]:
        """Fewer bins first, then unevenly filled ones: the better, the less."""
        return len(self.fill), -float(np.mean((self.fill / capacity) ** 2)) if len(self.fill) else 0.0


def best_fit(sizes: np.ndarray, order: np.ndarray, bins: np.ndarray, fill: list[int], capacity: int) -> np.ndarray:
    """Put the pieces, in the order given, each into the bin that it leaves the least room in; bins and fill are completed."""
    room = sorted((capacity - f) << 32 | b for b, f in enumerate(fill) if f < capacity)
    for k in order.tolist():
        size = int(sizes[k])
        at = bisect_left(room, size << 32)
        if at < len(room):
            left, b = room[at] >> 32, room[at] & 0xFFFFFFFF
            del room[at]
        else:
            left, b = capacity, len(fill)
            fill.append(0)
        bins[k] = b
        fill[b] += size
        if left > size:
            insort(room, left - size << 32 | b)
    return bins


def crossover(a: Packing, b: Packing, sizes: np.ndarray, capacity: int, draw: np.random.Generator) -> Packing:
    """Inject bins of b, the fuller the likelier, into a; bins of a that hold any of their pieces go, badly filled ones too, and what else was in those is best-fitted, largest first."""
    chosen = draw.random(len(b.fill)) < 0.5 * (b.fill / capacity) ** STEEP
    inside = chosen[b.bins]
    struck = a.fill < WELL_FILLED * capacity
    struck[a.bins[inside]] = True
    displaced = np.flatnonzero(struck[a.bins] & ~inside)
    bins = np.where(inside, len(a.fill) + b.bins, a.bins)
    bins[displaced] = -1
    held = bins >= 0
    _, bins[held] = np.unique(bins[held], return_inverse=True)
    fill = np.bincount(bins[held], weights=sizes[held]).astype(np.int64).tolist()
    return Packing(best_fit(sizes, displaced[np.argsort(-sizes[displaced], kind="stable")], bins, fill, capacity), sizes)


def evolve(sizes: np.ndarray, elites: list[np.ndarray], seed: int, capacity: int = CAPACITY, children: int = CHILDREN, members: int = MEMBERS, kept: int = ELITES, by_size: bool = False) -> list[np.ndarray]:
    """One epoch of one island, from the elites given and random members, one of them packed by size if asked for: its elites, the best first. It stops early where no bin can be saved any more."""
    draw = np.random.Generator(np.random.PCG64(seed))
    least = -(-int(sizes.sum()) // capacity)
    people = [Packing(e, sizes) for e in elites]
    if by_size:
        people.append(Packing(best_fit(sizes, np.argsort(-sizes, kind="stable"), np.full(len(sizes), -1, np.int64), [], capacity), sizes))
    while len(people) < members:
        people.append(Packing(best_fit(sizes, draw.permutation(len(sizes)), np.full(len(sizes), -1, np.int64), [], capacity), sizes))
    rank = lambda p: p.score(capacity)
    people.sort(key=rank)
    for _ in range(children):
        if len(people[0].fill) <= least:
            break
        i, j = draw.choice(len(people), 2, replace=False) if len(people) > 1 else (0, 0)
        child = crossover(people[i], people[j], sizes, capacity, draw)
        if rank(child) < rank(people[-1]) and all(rank(child) != rank(p) for p in people):
            people[-1] = child
            people.sort(key=rank)
    return [p.bins.astype(np.int32) for p in people[:kept]]


_ITEM = "struct<length:bigint,doc_id:{id},piece:int,start:bigint,ids_crc32:bigint>"


def _epoch(islands: DataFrame, epoch: int, capacity: int) -> DataFrame:
    """Every island's next elites (array of packings as binary) and the score of the best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, bins, score = [], [], []
            for shard, island, items, elites in zip(b["shard"].to_pylist(), b["island"].to_pylist(), b["items"], b["elites"].to_pylist(), strict=True):
                sizes = np.asarray(items.values.field("length"), np.int64)
                best = evolve(sizes, [np.frombuffer(e, np.int32) for e in elites or []], hash((shard, island, epoch)) & 0x7FFFFFFF, capacity, by_size=epoch == EPOCHS - 1)
                out.append([x.tobytes() for x in best])
                n, s = Packing(best[0], sizes).score(capacity)
                bins.append(n)
                score.append(s)
            yield pa.RecordBatch.from_arrays([b["shard"], b["island"], b["items"], pa.array(out, pa.list_(pa.binary())), pa.array(bins, pa.int64()), pa.array(score, pa.float64())], names=["shard", "island", "items", "elites", "bins", "score"])

    kind = islands.schema["items"].dataType.simpleString()
    return islands.select("shard", "island", "items", "elites").mapInArrow(run, f"shard bigint, island int, items {kind}, elites array<binary>, bins bigint, score double")


def _placed(shards: DataFrame, kind: str) -> DataFrame:
    """A row for each piece: its place, and how full its sequence is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, items, best in zip(b["shard"].to_pylist(), b["items"], b["best"].to_pylist(), strict=True):
                item, bins = items.values, np.frombuffer(best, np.int32).astype(np.int64)
                sizes = np.asarray(item.field("length"), np.int64)
                order = np.argsort(bins, kind="stable")
                before = np.cumsum(sizes[order]) - sizes[order]
                firsts = np.flatnonzero(np.diff(bins[order], prepend=-1))
                offset = np.empty(len(bins), np.int64)
                offset[order] = before - np.repeat(before[firsts], np.diff(np.append(firsts, len(bins))))
                fill = np.bincount(bins, weights=sizes).astype(np.int64)[bins]
                columns = [item.field(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(shard << 32 | bins), pa.array(offset), pa.array(fill)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "fill"])

    return shards.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint, fill bigint")


def pack(pieces: DataFrame, capacity: int = CAPACITY, first_shard: int = 0) -> DataFrame:
    """Pack pieces (of a stored table) shard by shard: their columns, sequence_id, offset and fill."""
    kind = pieces.schema["doc_id"].dataType.simpleString()
    n = max(1, -(-pieces.count() // SHARD))
    item = F.struct("length", "doc_id", "piece", "start", "ids_crc32").cast(_ITEM.format(id=kind))
    # Where a row stands in a stored table tells repeated rows apart.
    shard = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)) + first_shard
    shards = pieces.select(shard.alias("shard"), item.alias("item")).groupBy("shard").agg(F.array_sort(F.collect_list("item")).alias("items"))
    islands = stored(shards.select("shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "items", F.lit(None).cast("array<binary>").alias("elites")), "islands").repartition("shard", "island")
    for epoch in range(EPOCHS):
        if epoch:
            came = islands.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("elites").alias("came"))
            islands = islands.join(came, ["shard", "island"]).withColumn("elites", F.concat(F.slice("elites", 1, 1), "came"))
        islands = stored(_epoch(islands, epoch, capacity), "islands")
    best = islands.groupBy("shard").agg(F.min_by(F.struct("items", F.col("elites")[0].alias("best")), F.struct("bins", "score", "island")).alias("x"))
    return _placed(best.select("shard", "x.items", "x.best"), kind)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Every piece's sequence_id and offset. Pieces are at most as long as a sequence."""
    pieces = stored(pieces, "pieces")
    columns = [*pieces.columns, "sequence_id", "offset"]
    whole = pieces.where(F.col("length") >= capacity).select(*pieces.columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    well, done, shard, before = F.col("fill") >= WELL_FILLED * capacity, whole, 0, None
    rest = pieces.where(F.col("length") < capacity)
    while True:
        packed = stored(pack(rest, capacity, first_shard=shard), "packed")
        left = packed.where(~well).count()
        if before is not None and (left <= SHARD or left > 0.9 * before) or not left:
            return done.union(packed.select(*columns))
        done = done.union(packed.where(well).select(*columns))
        rest, before, shard = stored(packed.where(~well).select(*pieces.columns), "pieces"), left, shard + (1 << 26)


def packed_ids(df: DataFrame, placed: DataFrame, end_id: int = END_ID, tokenizer: str = WORD_BPE) -> DataFrame:
    """The sequences themselves: sequence_id and tokens, its pieces' ids in order of their offsets. Documents must have distinct ids."""
    ids = encode_documents(df, end_id, tokenizer)
    parts = placed.join(ids, "doc_id").select("sequence_id", "offset", F.slice("tokens", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("tokens"))
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "tokens"))), lambda x: x["tokens"])).alias("tokens"))


def op10_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences of 2048 ids."""
    return pack_pieces(cut_pieces(documents(spark, sf_dir)))
