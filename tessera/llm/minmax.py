"""Near-duplicates by min-max hashing, confirmed on full shingle sets.

Each permutation hashes a document's shingles once and keeps both the least and the greatest value, two values of the
signature for one evaluation. Bands of values deal documents into buckets. Documents with the same set stand for one
another from the beginning, so groups of copies never meet in a bucket. Within a bucket every member is held against the
least one, and the links so confirmed give components. Documents tied by buckets that still hold several components form a
family; in it, all that are outside the largest component are held against all of the family, block by block. So each pair
of a bucket is either compared or already joined, and no pair is ever a row.

With 40 bands of 3 least and 3 greatest values, a pair of similarity 0.8 shares no bucket with probability 5e-6.

Defined cases: null and empty texts, and texts without words, have an empty set and link with nothing; fewer words than a
shingle count as one shingle; rows that repeat a doc_id are one document, by its least set; a null doc_id links with
nothing and is kept; an empty table gives no rows. The full sets are of 64-bit hashes of the shingles: two texts are
linked wrongly only where such hashes meet by chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.shared import documents, mix, pieces_of, stored, texts_of, word_hashes

#: Bands, and permutations a band; a band has twice as many values.
BANDS, PERMUTATIONS_A_BAND = 40, 3
#: Shingles on each side of a block; a longer document is a side of its own.
BLOCK = 150_000
#: Parts that each family's documents are dealt to while they learn how large it is.
SALTS = 32
_STEP = np.uint64(0x2545F4914F6CDD1D)


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles of so many words, A-Z in lower case."""
    hashes, firsts, _, _ = word_hashes(texts, lower=True)
    n = max(0, len(hashes) - words + 1)
    sums = np.full(n, words, np.uint64)
    for k in range(words):
        sums = sums * _STEP + hashes[k : k + n]
    sums, out = mix(sums), []
    for a, b in zip(firsts[:-1], firsts[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(sums[a : b - words + 1]))
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for h in hashes[a:b]:
                whole = whole * _STEP + h
            out.append(mix(whole))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def min_max_bands(sets: list[np.ndarray], bands: int = BANDS, permutations: int = PERMUTATIONS_A_BAND) -> np.ndarray:
    """A row for each set (none empty): the bucket keys of its bands, each from so many least and greatest values."""
    draw = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, (bands, permutations, 2), dtype=np.uint64)
    values = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    keys = np.empty((len(sets), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(sets), band, np.uint64)
        for a, b in draw[band]:
            turned = values * (a << np.uint64(1) | np.uint64(1)) + b
            for kept in (np.minimum, np.maximum):
                key = mix(key * _STEP + kept.reduceat(turned, starts))
        keys[:, band] = key
    return keys


def signatures(df: DataFrame, words: int, bands: int = BANDS, permutations: int = PERMUTATIONS_A_BAND) -> DataFrame:
    """doc_id, n (size of the set), one and two (128 bits that stand for the set), and keys (array of bigint, empty for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(batches):
            sets = shingle_sets(texts_of(b), words)
            sizes = np.asarray([len(s) for s in sets], np.int64)
            keys = np.zeros((0, bands), np.uint64)
            if sizes.any():
                keys = min_max_bands([s for s in sets if len(s)], bands, permutations)
            ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))]).astype(np.int32)
            one = np.asarray([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            two = np.asarray([mix(s ^ _STEP).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), pa.array(one), pa.array(two), lists], names=["doc_id", "n", "one", "two", "keys"])

    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n bigint, one bigint, two bigint, keys array<bigint>")


def full_sets(df: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """id and items (the sorted 64-bit hashes of its shingles) of the documents named by ids (doc_id)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in shingle_sets(texts_of(b), words)], pa.binary())], names=["id", "items"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return stored(df.select("doc_id", "text").join(ids, "doc_id", "left_semi").mapInArrow(build, f"id {kind}, items binary"), "sets")


def confirmed(pairs: DataFrame, df: DataFrame, words: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose full sets have 100 * intersection >= percent * union."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(batches, "items_a", 1 << 20):
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = 0
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    shared = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sets = full_sets(df, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), words)
    kind = df.schema["doc_id"].dataType.simpleString()
    with_b = pairs.join(sets.select(F.col("id").alias("b"), F.col("items").alias("items_b")), "b")
    both = with_b.join(sets.select(F.col("id").alias("a"), F.col("items").alias("items_a")), "a")
    return both.select("a", "b", "items_a", "items_b").mapInArrow(compare, f"a {kind}, b {kind}").distinct()


def block_links(block: pa.Table, percent: int) -> pa.Table:
    """Links (a, b) between the block's outer documents and all its documents, one at most to each component.

    One look-up of an outer document's shingles among those of all documents counts its intersections with all of them.
    """
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in block["items"].combine_chunks()]
    ids, parts, outer = block["doc_id"].to_pylist(), block["part"].to_pylist(), block["outer"].to_pylist()
    inner = [k for k in range(len(sets)) if not outer[k]]
    links: list[tuple] = []
    if inner:
        sizes = np.asarray([len(sets[k]) for k in inner])
        values, owner = np.concatenate([sets[k] for k in inner]), np.repeat(np.arange(len(inner)), sizes)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        for k in range(len(sets)):
            if outer[k]:
                low, high = np.searchsorted(values, sets[k], "left"), np.searchsorted(values, sets[k], "right")
                hits = np.concatenate([owner[p:q] for p, q in zip(low, high, strict=True) if q > p] or [owner[:0]])
                shared = np.bincount(hits, minlength=len(inner))
                near = np.flatnonzero(100 * shared >= percent * (sizes + len(sets[k]) - shared))
                links += {parts[inner[j]]: (ids[k], ids[inner[j]]) for j in near if parts[inner[j]] != parts[k]}.values()
    return pa.table({"a": pa.array([x for x, _ in links], block.schema.field("doc_id").type), "b": pa.array([y for _, y in links], block.schema.field("doc_id").type)})


def family_links(placed: DataFrame, df: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between the components that meet in buckets. placed: key, doc_id and part (its component so far)."""
    kind = df.schema["doc_id"].dataType.simpleString()
    apart = placed.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.min("doc_id").alias("lead")).where("p != q").select("key", "lead")
    placed = stored(placed.join(apart, "key"), "apart")
    families = components(placed.select(F.col("lead").alias("a"), F.col("doc_id").alias("b"))).select(F.col("node").alias("doc_id"), F.col("component").alias("family"))
    docs = stored(placed.select("doc_id", "part").distinct().join(families, "doc_id"), "families")
    sets = full_sets(df, docs.select("doc_id"), words)
    docs = docs.join(sets.select(F.col("id").alias("doc_id"), (F.octet_length("items") / 8).alias("size")), "doc_id")
    parts = docs.groupBy("family", "part").agg(F.sum("size").alias("size"))
    wide = parts.groupBy("family").agg(F.sum("size").alias("whole"), F.max(F.struct("size", "part")).alias("main"))
    # A family may hold a large share of all documents, so nothing is dealt by family alone: first by family and salt, without
    # the sets; then by document, to get the sets; then by block.
    wide = wide.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    docs = docs.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(wide, ["family", "salt"]).withColumn("is_outer", F.col("part") != F.col("main.part"))
    n_inner, n_outer = F.ceil(F.col("whole") / BLOCK), F.ceil((F.col("whole") - F.col("main.size")) / BLOCK)
    own, upto = lambda n: F.pmod(F.xxhash64(F.lit(1), "doc_id"), n), lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    # Of each document the blocks in which it is an inner and an outer one.
    inner = F.transform(upto(n_outer), lambda j: F.struct(own(n_inner).alias("i"), j.alias("j"), F.lit(False).alias("outer")))
    outer = F.transform(upto(n_inner), lambda i: F.struct(i.alias("i"), own(n_outer).alias("j"), F.lit(True).alias("outer")))
    blocks = docs.select("doc_id", "family", "part", F.when(F.col("is_outer"), F.concat(inner, outer)).otherwise(inner).alias("blocks"))
    dealt = blocks.join(sets.withColumnRenamed("id", "doc_id"), "doc_id").select("family", F.explode("blocks").alias("x"), "doc_id", "part", "items").select("family", "x.*", "doc_id", "part", "items")
    return dealt.repartition("family", "i", "j").groupBy("family", "i", "j").applyInArrow(lambda block: block_links(block, percent), f"a {kind}, b {kind}")


def near_duplicates(df: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, permutations: int = PERMUTATIONS_A_BAND) -> DataFrame:
    """Of each document doc_id, n_shingles, component_id (the least doc_id that it reaches by links, its own included) and kept (it is that one)."""
    marks = stored(signatures(df, words, bands, permutations), "signatures")
    if not marks.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        known = marks.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("n", "one", "two", "keys")).alias("s")).select("doc_id", "s.*")
        marks = stored(known.union(marks.where("doc_id IS NULL")), "signatures")
    linked = marks.where("n > 0 AND doc_id IS NOT NULL")
    same = linked.groupBy("n", "one", "two").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    copies = stored(linked.select("doc_id", "n", "one", "two").join(same.where("copies > 1"), ["n", "one", "two"]).where("doc_id != rep").select("doc_id", "rep"), "copies")
    members = linked.join(copies, "doc_id", "left_anti").select("doc_id", F.explode("keys").alias("key"))
    buckets = members.groupBy("key").agg(F.min("doc_id").alias("lead"), F.count("*").alias("size")).where("size > 1")
    members = stored(members.join(buckets, "key").select("key", "doc_id", "lead"), "members")
    tested = stored(members.where("doc_id != lead").select(F.col("lead").alias("a"), F.col("doc_id").alias("b")).distinct(), "pairs")
    texts = df.where("doc_id IS NOT NULL")
    links = stored(confirmed(tested, texts, words, percent), "confirmed")
    found = components(links)
    placed = members.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("part"))
    more = family_links(placed, texts, words, percent)
    found = stored(components(links.union(more)), "components")
    by_rep = copies.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    all_ = found.withColumnRenamed("node", "doc_id").select("doc_id", "component").union(by_rep)
    out = marks.select("doc_id", "n").join(all_, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def without_near_duplicates(df: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of df, with its columns, of one document of each group. Of rows that repeat a doc_id the one with the least text stays; rows with a null doc_id stay."""
    found = near_duplicates(df, words, percent).where("doc_id IS NOT NULL AND kept").select("doc_id")
    out = df.join(found, "doc_id", "left_semi").select(*df.columns)
    nth = "__tessera_nth"
    rest = [c for c in df.columns if c not in ("doc_id", "text") and df.schema[c].dataType.typeName() not in ("map", "variant")]
    out = out.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id").orderBy("text", *rest))).where(F.col(nth) == 1).drop(nth)
    return out.union(df.where("doc_id IS NULL"))


def op9_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles of four words at similarity 0.8 over every whole text."""
    return near_duplicates(documents(spark, sf_dir), words=4, percent=80)
