"""Ranking: BM25, set and vector similarity, fusion, graph and learner boosts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import constants as c
from tessera.functions.text import term_counts, tokens
from tessera.storage import stored

#: Rows of a block on the query and on the corpus side of a vector search, bytes of query vectors that may go to every task, and words whose features a worker remembers.
QUERY_BLOCK, CORPUS_BLOCK, QUERY_BYTES, KEPT_WORDS = 8_000, 20_000, 64 << 20, 200_000
#: N-grams that a worker remembers; words and texts whose features are counted at once.
KEPT_GRAMS, SLICE_WORDS, SLICE_ROWS = 1_000_000, 50_000, 500
#: Distinct terms of queries up to which they are named to the scan of the texts.
NAMED_TERMS = 5_000
#: Items and their terms up to which every task holds them while it goes through the documents' counts; scores and parts of scores that are held at once.
HELD_ITEMS, HELD_PAIRS, HELD_SCORES, HELD_PARTS = 2_000, 200_000, 4_000_000, 4_000_000


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, term and tf, and the document's length dl. Texts without tokens have no rows."""
    words = docs.select(key, tokens(F.col(text)).alias("w")).select(key, F.size("w").alias("dl"), F.explode("w").alias("term"))
    return words.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def corpus_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: documents with tokens, their mean length and total length."""
    n = docs.select(F.size(tokens(F.col(text))).alias("n")).where("n > 0")
    return n.agg(F.count("*").alias("documents"), F.avg("n").alias("mean_length"), F.sum("n").cast("bigint").alias("total_length"))


def query_terms(queries: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """key and term: a query's distinct terms."""
    return queries.select(key, F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))


def ranked(scores: DataFrame, by: str, key: str, score: str = "score", k: int | None = None, rank: str = "rank") -> DataFrame:
    """Rank from 1 within by; ties in the score, which counts to nine decimals, by key."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.round(score, 9).desc(), key))
    out = scores.withColumn(rank, place)
    return out.where(F.col(rank) <= k) if k else out


def counted(docs: DataFrame, text: str = "text", queries: DataFrame | None = None) -> DataFrame:
    """doc_id, dl (tokens), nd (distinct terms) and t (terms with their counts) of every document, kept: texts are cut into tokens once for all that is asked of them. With queries t has only their terms, so that the others are neither sorted nor written; beyond NAMED_TERMS of them it has all."""
    if queries is not None:
        asked = [x[0] for x in query_terms(queries).select("term").distinct().limit(NAMED_TERMS + 1).collect()]  # a bounded number of words
        if len(asked) <= NAMED_TERMS:
            some = lambda w: F.filter(w, lambda x: x.isin(asked)) if asked else F.array().cast("array<string>")
            figures = lambda w: F.struct(F.size(w).cast("bigint").alias("dl"), F.size(F.array_distinct(w)).alias("nd"), some(w).alias("t"))
            return stored(counted_terms(docs.select("doc_id", F.element_at(F.transform(F.array(tokens(F.col(text))), figures), 1).alias("x")), asked))
    counts = docs.select("doc_id", term_counts(F.col(text)).alias("t"))
    return stored(counts.select("doc_id", F.aggregate("t", F.lit(0).cast("bigint"), lambda a, x: a + x["tf"]).alias("dl"), F.size("t").alias("nd"), "t"))


def counted_terms(docs: DataFrame, known: list[str]) -> DataFrame:
    """doc_id, dl, nd and t from doc_id and a struct x of them: the words of t, all of which are known, become terms with their counts, in order; a batch's words are counted at once by their numbers."""
    named = pa.array(sorted(known, key=str.encode), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dl, nd, words = (b["x"].field(c) for c in ("dl", "nd", "t"))
            term = pc.index_in(words.flatten(), value_set=named).to_numpy().astype(np.int64)
            row = pc.list_parent_indices(words).to_numpy().astype(np.int64)
            pairs, tf = np.unique(row * max(1, len(named)) + term, return_counts=True)
            row, term = np.divmod(pairs, max(1, len(named)))
            ends = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32))
            t = pa.StructArray.from_arrays([named.take(pa.array(term)), pa.array(tf.astype(np.int64))], names=["term", "tf"])
            yield pa.RecordBatch.from_arrays([b["doc_id"], dl, nd, pa.ListArray.from_arrays(ends, t)], names=["doc_id", "dl", "nd", "t"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, dl bigint, nd int, t array<struct<term:string,tf:bigint>>")


def asked_terms(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """doc_id, dl, nd, term and tf of the terms that are asked for (item_id, term)."""
    return counts.select("doc_id", "dl", "nd", F.inline("t")).join(asked.select("term").distinct(), "term", "left_semi")


def scored_terms(hits: DataFrame, asked: DataFrame, n: int, mean: float, allowed: DataFrame | None = None, k1: float = c.BM25_K1, b: float = c.BM25_B) -> DataFrame:
    """item_id, doc_id and score from the postings (doc_id, term, tf, dl) of the terms asked for, in a corpus of n documents of a mean length."""
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    rarity = F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    if allowed is not None:
        hits = hits.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi")
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / mean))
    # What is asked is kept with its rarity; where it is small, postings meet it dealt by document, as their scores are summed, and not by word: a common word has very many.
    wanted = stored(asked.join(df, "term").select("item_id", "term", rarity.alias("rarity")))
    weighed = hits.repartition("doc_id").join(wanted, "term").select("item_id", "doc_id", (F.col("rarity") * weight).alias("w"))
    return weighed.groupBy("item_id", "doc_id").agg(F.sum("w").alias("score"))


def held_terms(queries: DataFrame, counts: DataFrame) -> pa.Table | None:
    """item_id and term of queries that every task may hold; None beyond the bounds, and where ids are null or several documents share one, whose scores then meet by their ids."""
    pairs = query_terms(queries).limit(HELD_PAIRS + 1).toArrow()  # a bounded number of words
    if pairs.num_rows > HELD_PAIRS or pairs["item_id"].null_count or pc.count_distinct(pairs["item_id"]).as_py() > HELD_ITEMS or pc.count_distinct(pairs["term"]).as_py() > NAMED_TERMS:
        return None
    n = counts.agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("ids")).first()
    return pairs if n["rows"] == n["ids"] else None


def scanned(counts: DataFrame, pairs: pa.Table, item_type: str, k: int, rarity: dict[str, float] | None = None, k1: float = c.BM25_K1, b: float = c.BM25_B, mean: float = 1.0) -> DataFrame:
    """item_id, doc_id and score of at least the k best documents of each part of the documents' counts, in one pass without pairs of items and documents going on: by BM25 where terms' rarities are given, else by the cosine of term sets. All within the last counted decimal of the k-th go on, so that ties are decided by whoever ranks them."""
    terms = pairs["term"].combine_chunks().dictionary_encode()
    items = pairs["item_id"].combine_chunks().dictionary_encode()
    by_term = np.argsort(terms.indices.to_numpy(), kind="stable")
    own, sizes = items.indices.to_numpy()[by_term].astype(np.int64), np.bincount(terms.indices.to_numpy(), minlength=len(terms.dictionary))
    asked = np.bincount(items.indices.to_numpy(), minlength=len(items.dictionary)).astype(np.float64)
    rare = None if rarity is None else np.array([rarity.get(w, 0.0) for w in terms.dictionary.to_pylist()])
    held = counts.sparkSession.sparkContext.broadcast((terms.dictionary, items.dictionary, own, sizes, np.cumsum(sizes) - sizes, asked, rare))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, names, own, sizes, starts, asked, rare = held.value
        for batch in batches:
            flat = batch["t"].flatten()
            term = pc.index_in(flat.field("term"), value_set=words)
            known = term.is_valid().to_numpy(zero_copy_only=False)
            doc, tf = pc.list_parent_indices(batch["t"]).to_numpy()[known], flat.field("tf").to_numpy()[known]
            term = pc.drop_null(term).to_numpy()
            dl, nd = batch["dl"].to_numpy(), batch["nd"].to_numpy()
            weight = np.ones(len(term)) if rare is None else rare[term] * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[doc] / mean)))
            parts = np.concatenate([[0], np.cumsum(np.bincount(doc, weights=sizes[term], minlength=batch.num_rows))])
            ends = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, min(batch.num_rows, at + HELD_SCORES // len(names), int(np.searchsorted(parts, parts[at] + HELD_PARTS, "right")) - 1))
                x = slice(ends[at], ends[to])
                n = sizes[term[x]]
                where = np.repeat(starts[term[x]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                bins = np.repeat((doc[x] - at) * len(names), n) + own[where]
                scores = np.bincount(bins, weights=np.repeat(weight[x], n), minlength=(to - at) * len(names)).reshape(to - at, len(names))
                found = scores > 0
                if rare is None:
                    scores = scores / np.sqrt(np.maximum(1, asked[None, :] * nd[at:to, None]))
                bound = np.partition(scores, to - at - k, axis=0)[to - at - k] if to - at > k else np.zeros(len(names))
                row, item = np.nonzero(found & (scores >= bound - 2e-9))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(item)), batch["doc_id"].take(pa.array(at + row)), pa.array(scores[row, item])], ["item_id", "doc_id", "score"])
                at = to

    return counts.select("doc_id", "dl", "nd", "t").mapInArrow(scan, f"item_id {item_type}, doc_id {counts.schema['doc_id'].dataType.simpleString()}, score double")


def bm25(queries: DataFrame, docs: DataFrame, k: int = c.TOP_K, allowed: DataFrame | None = None, k1: float = c.BM25_K1, b: float = c.BM25_B, counts: DataFrame | None = None) -> DataFrame:
    """item_id, doc_id, score and rank. Corpus figures are those of all documents; allowed (doc_id) narrows what is ranked. counts: counted(docs), where it is there."""
    counts = counted(docs, queries=queries) if counts is None else counts
    stats = counts.where("dl > 0").agg(F.count("*").alias("documents"), F.avg("dl").alias("mean_length")).first()
    asked = query_terms(queries)
    n, mean = stats["documents"], stats["mean_length"] or 1.0
    pairs = held_terms(queries, counts) if k else None
    if pairs is None or not pairs.num_rows:
        return ranked(scored_terms(asked_terms(counts, asked), asked, n, mean, allowed, k1, b), "item_id", "doc_id", k=k)
    df = asked_terms(counts, asked).groupBy("term").agg(F.count("*").alias("df")).select("term", F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    rarity = dict(map(tuple, df.collect()))  # of the terms held, a bounded number
    some = counts if allowed is None else counts.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi")
    return ranked(scanned(some, pairs, queries.schema["item_id"].dataType.simpleString(), k, rarity, k1, b, mean), "item_id", "doc_id", k=k)


def set_cosine(queries: DataFrame, docs: DataFrame, k: int = c.TOP_K, counts: DataFrame | None = None) -> DataFrame:
    """item_id, doc_id, score and rank by the cosine of term sets."""
    asked = query_terms(queries)
    counts = counted(docs, queries=queries) if counts is None else counts
    pairs = held_terms(queries, counts) if k else None
    if pairs is not None and pairs.num_rows:
        return ranked(scanned(counts, pairs, queries.schema["item_id"].dataType.simpleString(), k), "item_id", "doc_id", k=k)
    sizes = asked.groupBy("item_id").agg(F.count("*").alias("nq"))
    both = asked_terms(counts, asked).join(asked, "term").groupBy("item_id", "doc_id").agg(F.count("*").alias("n"), F.max("nd").alias("nd"))
    scored = both.join(sizes, "item_id").select("item_id", "doc_id", (F.col("n") / F.sqrt(F.col("nq") * F.col("nd"))).alias("score"))
    return ranked(scored, "item_id", "doc_id", k=k)


def fused(arms: Iterable[tuple[DataFrame, float]], k: int | None = c.TOP_K, rrf_k: int = c.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of rankings (item_id, doc_id, rank) with weights: item_id, doc_id, score and rank."""
    parts = [arm.select("item_id", "doc_id", (F.lit(weight) / (rrf_k + F.col("rank"))).alias("s")) for arm, weight in arms]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return ranked(both.groupBy("item_id", "doc_id").agg(F.sum("s").alias("score")), "item_id", "doc_id", k=k)


def hybrid(queries: DataFrame, docs: DataFrame, k: int = c.TOP_K, candidates: int = c.CANDIDATES, allowed: DataFrame | None = None) -> DataFrame:
    """BM25 and the cosine of term sets (in place of a model's vectors; see nearest() for those), fused."""
    counts = counted(docs, queries=queries)
    return fused([(set_cosine(queries, docs, candidates, counts), c.W_DENSE), (bm25(queries, docs, candidates, allowed, counts=counts), c.W_LEXICAL)], k)


def boosted(ranking: DataFrame, boosts: DataFrame, weight: float = c.GRAPH_WEIGHT, k: int | None = c.TOP_K, most: DataFrame | None = None) -> DataFrame:
    """Add weight times a document's boost (item_id, doc_id, boost; as a share of the query's largest) and rank again. most (item_id, most): the largest, where boosts has not all of a query's."""
    most = boosts.groupBy("item_id").agg(F.max("boost").alias("most")) if most is None else most
    shares = boosts.join(most, "item_id").select("item_id", "doc_id", F.when(F.col("most") > 0, F.col("boost") / F.col("most")).otherwise(0.0).alias("share"))
    out = ranking.drop("rank").join(shares, ["item_id", "doc_id"], "left").withColumn("score", F.col("score") + weight * F.coalesce("share", F.lit(0.0))).drop("share")
    return ranked(out, "item_id", "doc_id", k=k)


def _matrix(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of lists of one length as rows at unit length."""
    column = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    rows = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of scores the k best with their ids (a row of ids each, or one for all), ties by id; padded with minus infinity."""
    n, m = scores.shape
    bound = np.partition(scores, m - k, axis=1)[:, m - k] if m > k else np.full(n, -np.inf)
    rows, columns = np.nonzero((scores >= bound[:, None]) & (scores > -np.inf))
    values, names = scores[rows, columns], ids[columns] if ids.ndim == 1 else ids[rows, columns]
    order = np.lexsort((names, -values, rows))
    rows, values, names = rows[order], values[order], names[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    top, who = np.full((n, k), -np.inf), np.zeros((n, k), np.int64)
    kept = place < k
    top[rows[kept], place[kept]], who[rows[kept], place[kept]] = values[kept], names[kept]
    return top, who


def nearest(queries: DataFrame, corpus: DataFrame, k: int = c.TOP_K, key: str = "vec_id", vector: str = "embedding", same: bool = False) -> DataFrame:
    """query_id, key, score (to nine decimals) and rank: the k nearest rows by cosine of each query; same: whether a row may find itself.

    Up to QUERY_BYTES of query vectors go to every task, which reads its part of the corpus once and keeps each query's
    best. More queries are dealt into blocks, the corpus too, and each pair of blocks is one matrix product. Either way
    only the best k of a part go on.
    """
    q, d = queries.select(F.col(key).alias("id"), F.col(vector).alias("v")), corpus.select(F.col(key).alias("id"), F.col(vector).alias("v"))
    shape, names = f"query_id bigint, {key} bigint, score double", ["query_id", key, "score"]

    def rows_of(asked: np.ndarray, top: np.ndarray, who: np.ndarray) -> pa.Table:
        at, place = np.nonzero(top > -np.inf)
        return pa.table([pa.array(asked[at]), pa.array(who[at, place]), pa.array(top[at, place])], names=names)

    def compared(asked: np.ndarray, left: np.ndarray, ids: np.ndarray, right: np.ndarray) -> np.ndarray:
        scores = np.round(left @ right.T, 9)
        if not same:
            scores[asked[:, None] == ids[None, :]] = -np.inf
        return scores

    size = q.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dim")).first()
    if not size["n"]:
        return queries.sparkSession.createDataFrame([], f"{shape}, rank int")
    if size["n"] * size["dim"] * 8 <= QUERY_BYTES:
        rows = q.toArrow()  # checked above
        held = queries.sparkSession.sparkContext.broadcast((np.asarray(rows["id"]), _matrix(rows["v"])))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, left = held.value
            step = max(64, min(CORPUS_BLOCK, (32 << 20) // (8 * len(asked))))
            top, who = np.full((len(asked), k), -np.inf), np.zeros((len(asked), k), np.int64)
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    ids = np.asarray(part.column(0))
                    new, new_ids = best_of(compared(asked, left, ids, _matrix(part.column(1))), ids, k)
                    top, who = best_of(np.hstack([top, new]), np.hstack([who, new_ids]), k)
            yield from rows_of(asked, top, who).to_batches()

        return ranked(d.mapInArrow(scan, shape), "query_id", key, k=k)

    n_q, n_c = -(-size["n"] // QUERY_BLOCK), max(1, -(-d.count() // CORPUS_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        if not (a.num_rows and b.num_rows):
            return rows_of(np.zeros(0, np.int64), np.zeros((0, k)), np.zeros((0, k), np.int64))
        asked, ids, left, right = np.asarray(a["id"]), np.asarray(b["id"]), _matrix(a["v"]), _matrix(b["v"])
        step = max(64, (32 << 20) // (8 * len(ids)))
        found = [rows_of(asked[i : i + step], *best_of(compared(asked[i : i + step], left[i : i + step], ids, right), ids, k)) for i in range(0, len(asked), step)]
        return pa.concat_tables(found)

    left = q.select("id", "v", own(n_q).alias("i"), every(n_c).alias("j"))
    right = d.select("id", "v", every(n_q).alias("i"), own(n_c).alias("j"))
    return ranked(left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(search, shape), "query_id", key, k=k)


def hash_embedding(text: Column, dim: int = 384) -> Column:
    """Signed feature hashing of words and their 3- to 5-grams, at unit length. A batch's distinct words are hashed once, and its texts' features counted together; a worker remembers the places of recent words' features and of n-grams."""

    @F.arrow_udf("array<float>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, np.ndarray] = {}
        grams: dict[str, int] = {}

        def place(feature: str) -> int:
            h = int.from_bytes(blake2b(feature.encode(), digest_size=8).digest(), "big")
            grams[feature] = out = h % dim * 2 + (h >> 63)
            return out

        def places(word: str) -> np.ndarray:
            marked = f"#{word}#"
            features = [word, *(marked[i : i + n] for n in (3, 4, 5) for i in range(len(word) + 3 - n))]
            known[word] = out = np.array([grams[f] if f in grams else place(f) for f in features], np.int32)
            return out

        def vectors(rows: pa.Array) -> np.ndarray:
            """Rows of counts by the features' places, in slices of a bounded number of words."""
            out = np.zeros((len(rows), dim), np.float32)
            words = rows.flatten().dictionary_encode()
            parent, index = pc.list_parent_indices(rows).to_numpy(), words.indices.to_numpy()
            found = [known[w] if w in known else places(w) for w in words.dictionary.to_pylist()]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            starts, features = np.cumsum(sizes) - sizes, np.concatenate(found) if found else np.zeros(0, np.int32)
            ends = np.searchsorted(parent, np.arange(1, len(rows) + 1))
            at = 0
            while at < len(rows):
                first = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends[: at + SLICE_ROWS], first + SLICE_WORDS, "right")))
                total = np.zeros((to - at) * 2 * dim, np.int64)
                for k in range(first, ends[to - 1], SLICE_WORDS):
                    own = index[k : min(k + SLICE_WORDS, ends[to - 1])]
                    n = sizes[own]
                    where = np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    total += np.bincount(np.repeat((parent[k : k + len(own)] - at) * (2 * dim), n) + features[where], minlength=len(total))
                counts = total.reshape(to - at, dim, 2)
                signed = (counts[:, :, 0] - counts[:, :, 1]).astype(np.float64)
                length = np.sqrt((signed * signed).sum(axis=1, keepdims=True))
                out[at:to] = signed / np.where(length > 0, length, 1.0)
                at = to
            return out

        for rows in batches:
            if len(known) > KEPT_WORDS or len(grams) > KEPT_GRAMS:
                known.clear()
                grams.clear()
            made = vectors(rows)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * dim), pa.array(made.ravel()))

    return embed(tokens(text))


def containing(passages: DataFrame, docs: DataFrame, words: int = 4) -> DataFrame:
    """item_id and doc_id where the document's text contains the passage's.

    A passage's inner words (without its first and last, which may be parts of words) are whole words of the document, so
    a run of them meets the document's runs in an equi-join, and the texts of such pairs are compared. A passage of two
    words meets documents by the end of its first word, one of a single word by that as a part of a word. Passages of
    blanks alone, of which there are few kinds, are looked for one kind at a time.
    """
    split = lambda t: F.filter(F.split(t, r"\s+"), lambda w: w != "")
    run = lambda w, i, n: F.array_join(F.slice(w, i, n), " ")
    p = passages.where("text IS NOT NULL").select("item_id", F.col("text").alias("passage"), split(F.col("text")).alias("w"))
    d = docs.select("doc_id", "text", split(F.col("text")).alias("w"))
    sizes = {r[0] for r in p.select(F.least(F.size("w"), F.lit(words + 2))).distinct().collect()}  # one for each number up to words + 2
    pairs = []
    for n in sorted(x - 2 for x in sizes if x > 2):
        own = p.where(F.least(F.size("w"), F.lit(words + 2)) == n + 2).select("item_id", "passage", run(F.col("w"), F.lit(2), F.lit(n)).alias("run"))
        every = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: run(F.col("w"), i, F.lit(n)))  # noqa: B023
        runs = d.where(F.size("w") >= n).select("doc_id", F.explode(F.array_distinct(every)).alias("run"))
        pairs.append(runs.join(own, "run").select("item_id", "doc_id", "passage"))
    for n in sizes & {1, 2}:
        own = p.where(F.size("w") == n).select("item_id", "passage", F.col("w")[0].alias("part"))
        lengths = [r[0] for r in own.select(F.length("part")).distinct().collect()]  # one for each length of a word
        seen = d.select("doc_id", F.explode(F.array_distinct("w")).alias("word"))
        ends = lambda m: F.array(F.right("word", F.lit(m))) if n == 2 else F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("word") - (m - 1))), lambda i: F.substring("word", i, F.lit(m)))  # noqa: B023, E731
        parts = seen.select("word").distinct().select("word", F.explode(F.array_distinct(F.concat(*map(ends, lengths)))).alias("part")).join(own.select("part").distinct(), "part", "left_semi")
        pairs.append(seen.join(parts, "word").join(own, "part").select("item_id", "doc_id", "passage"))
    out = [x.distinct().join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", "passage")).select("item_id", "doc_id") for x in pairs]
    for blank in [r[0] for r in p.where(F.size("w") == 0).select("passage").distinct().collect()] if 0 in sizes else []:
        items = p.where(F.col("passage") == blank).agg(F.collect_set("item_id").alias("items")).first()["items"]
        out.append(docs.where(F.contains("text", F.lit(blank))).select(F.explode(F.array(*map(F.lit, items))).alias("item_id"), "doc_id"))
    if not out:
        return passages.sparkSession.createDataFrame([], f"item_id {passages.schema['item_id'].dataType.simpleString()}, doc_id {docs.schema['doc_id'].dataType.simpleString()}")
    whole = out[0]
    for x in out[1:]:
        whole = whole.union(x)
    return whole.distinct()
