"""Terms and phrases of texts: keywords, repeated lines, candidate phrases, aliases, figures."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import STOPWORDS, tokens
from tessera.storage import stored

#: For each phrase asked for, how many of the most frequent pairs of neighbours are looked at first.
FIRST_PAIRS = 4
#: Aliases up to which every task knows them all, and words of texts that are looked at together.
NAMED_ALIASES, SLICE_WORDS = 5_000, 500_000
# Words that no phrase holds, and words that none begins or ends with.
PHRASE_STOP = (
    "the a an and or of to in on for with by as is are be this that these those it its we you can will using used use uses such each which when "
    "how from into than then some any all more most our based given shown called defined following follows different various many also one two new via per "
    "between within about above below over under same"
).split()
GENERIC = (
    "data example examples information result results chapter section model models value values number numbers name names set sets step steps table tables column columns "
    "figure figures introduction overview summary note notes answer answers question questions problem problems goal goals practice sample samples score range first find "
    "print create function functions code output input type types list row rows case point points part way thing things lecture lesson week session slide page"
).split()


def without_repeated_lines(pages: DataFrame, repeated: DataFrame, group: str, page: str, text: str = "text") -> DataFrame:
    """Pages without their group's repeated lines (headers and footers); what else is in the text stays as it is."""
    gone = repeated.groupBy(group).agg(F.collect_set("line").alias("gone"))
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("gone", F.trim(x))), "\n")
    return pages.join(gone, group, "left").withColumn(text, F.when(F.col("gone").isNull(), F.col(text)).otherwise(left)).drop("gone")


def keywords(docs: DataFrame, k: int = 10) -> DataFrame:
    """doc_id, word, n and place: the most frequent words of three letters and more; ties by first occurrence."""
    words = docs.select("doc_id", F.posexplode(tokens(F.col("text"), 3)).alias("pos", "word")).where(~F.col("word").isin(STOPWORDS))
    counts = words.groupBy("doc_id", "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "first"))
    return counts.withColumn("place", place).where(F.col("place") <= k).select("doc_id", "word", "n", "place")


def repeated_lines(pages: DataFrame, group: str, page: str, text: str = "text", ratio: float = 0.5, longest: int = 120) -> DataFrame:
    """Lines on at least max(2, pages * ratio) pages of a group."""
    lines = pages.select(group, page, F.explode(F.array_distinct(F.transform(F.split(text, "\n"), lambda x: F.trim(x)))).alias("line")).where((F.col("line") != "") & (F.length("line") < longest))
    n = pages.groupBy(group).agg(F.countDistinct(page).alias("pages"))
    on = lines.groupBy(group, "line").agg(F.countDistinct(page).alias("on_pages"))
    return on.join(n, group).where(F.col("on_pages") >= F.greatest(F.lit(2), F.floor(F.col("pages") * ratio))).select(group, "line", "on_pages", "pages")


def phrase_runs(docs: DataFrame) -> DataFrame:
    """doc_id and w: runs of Latin words of three letters and more, none of them a common one. A common word ends a run, so texts are cut there first; a run of one word, and there are many, makes no phrase at all."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[a-z][a-z\-]+"), F.lit(0)), lambda w: F.length(w) >= 3)
    line = F.array_join(F.transform(words, lambda w: F.when(w.isin(PHRASE_STOP), "|").otherwise(w)), " ")
    return docs.select("doc_id", F.explode(F.split(line, r" ?\|(?: \|)* ?")).alias("run")).where(F.contains("run", F.lit(" "))).select("doc_id", F.split("run", " ").alias("w"))


def candidate_phrases(runs: DataFrame, sizes: tuple[int, ...] = (2, 3, 4), pairs: DataFrame | None = None) -> DataFrame:
    """doc_id, phrase and n: parts of runs, their outer words not generic. pairs (pair): hashes of neighbouring words; only phrases that begin and end with one of these are built."""
    # A row holds the few words from a place on, not its whole run: a run may be as long as a text.
    start = lambda i: F.struct(F.xxhash64(F.get("w", i), F.get("w", i + 1)).alias("pair"), F.slice("w", i + 1, max(sizes)).alias("x"))
    firsts = runs.where(F.size("w") > 1).select("doc_id", F.inline(F.transform(F.sequence(F.lit(0), F.size("w") - 2), start)))
    if pairs is not None:
        firsts = firsts.join(pairs, "pair", "left_semi")
    firsts = firsts.where(~F.get("x", F.lit(0)).isin(GENERIC))
    ends = lambda n: (F.size("x") >= n) & ~F.get("x", F.lit(n - 1)).isin(GENERIC)
    one = lambda n: F.struct(F.xxhash64(F.get("x", F.lit(n - 2)), F.get("x", F.lit(n - 1))).alias("pair"), F.array_join(F.slice("x", 1, n), " ").alias("phrase"))
    made = firsts.select("doc_id", F.inline(F.array_compact(F.array(*(F.when(F.coalesce(ends(n), F.lit(False)), one(n)) for n in sizes)))))
    if pairs is not None:
        made = made.join(pairs, "pair", "left_semi")
    # Counted by document first, so that a document's repeats never leave its task apart.
    return made.groupBy("phrase", "doc_id").agg(F.count("*").alias("n"))


def phrases(docs: DataFrame, least: int = 4, documents: int = 3, sizes: tuple[int, ...] = (2, 3, 4), most: int = 360) -> DataFrame:
    """phrase, n and documents: candidate phrases found often enough, the most frequent first.

    A phrase is no more frequent than its first and its last two words, so pairs of neighbours are counted first, by their
    hashes, and texts of phrases built only from the most frequent ones. If so many phrases are found that the last of them
    is as frequent as the rarest of these pairs, no other phrase comes before it; else rarer pairs are taken in, down to least.
    """
    runs = stored(phrase_runs(docs))
    neighbours = runs.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1)))).alias("pair"))
    pairs = stored(neighbours.groupBy("pair").agg(F.count("*").alias("n")).where(F.col("n") >= least))
    taken = FIRST_PAIRS * most
    while True:
        rarest = pairs.orderBy(F.desc("n")).limit(taken).agg(F.min("n"), F.count("*")).first()
        bound = rarest[0] if rarest[1] == taken else least
        # Kept, so that the few pairs are known to be few and go to every task.
        counted = candidate_phrases(runs, sizes, stored(pairs.where(F.col("n") >= bound).select("pair"))).groupBy("phrase").agg(F.sum("n").alias("n"), F.count("*").alias("documents"))
        found = stored(counted.where((F.col("n") >= least) & (F.col("documents") >= documents)).orderBy(F.desc("n"), "phrase").limit(most))
        last = found.agg(F.min("n"), F.count("*")).first()
        if bound <= least or last[1] == most and last[0] >= bound:
            return found.orderBy(F.desc("n"), "phrase")
        taken *= 16


def calibrated(similarity: Column, n: Column) -> Column:
    """Confidence of a mined concept: similarity, and frequency up to 50."""
    return F.round(0.7 * similarity + 0.3 * F.least(F.lit(1.0), F.log1p(n) / math.log(50)), 6)


def aliases(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """doc_id, concept and hits: mentions of aliases (alias, concept) of up to three words, as runs of whole words. Up to NAMED_ALIASES of them are looked for where the texts are, so that only what is found goes on."""
    w = docs.select("doc_id", tokens(F.col("text"), 1).alias("w"))
    known = [x[0] for x in lexicon.where("alias IS NOT NULL").select("alias").distinct().limit(NAMED_ALIASES + 1).collect()]  # a bounded number
    if len(known) <= NAMED_ALIASES:
        return named_runs(w, known).join(lexicon, "alias").groupBy("doc_id", "concept").agg(F.sum("n").alias("hits"))
    parts = [w.select("doc_id", F.explode(_runs(n)).alias("alias")) for n in (1, 2, 3)]
    found = parts[0].union(parts[1]).union(parts[2])
    return found.join(lexicon, "alias").groupBy("doc_id", "concept").agg(F.count("*").alias("hits"))


def named_runs(words: DataFrame, known: list[str]) -> DataFrame:
    """doc_id, alias and n: how often each known run of one to three words is among a text's words (doc_id, w). Words are told apart by their numbers, a batch of texts at once."""
    runs = sorted(x for x in known if len(x.split(" ")) <= 3)
    vocabulary = sorted({word for x in runs for word in x.split(" ")})
    number = {word: k for k, word in enumerate(vocabulary)}
    base = len(vocabulary) + 1
    by_size = {}
    for n in (1, 2, 3):
        coded = sorted((sum(number[word] * base ** (n - 1 - k) for k, word in enumerate(x.split(" "))), i) for i, x in enumerate(runs) if x.count(" ") == n - 1)
        if coded:
            by_size[n] = tuple(np.array(c, np.int64) for c in zip(*coded, strict=True))

    def slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ends, at = np.concatenate([[0], np.cumsum(pc.list_value_length(b["w"]).to_numpy())]), 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_WORDS, "right")) - 1)
            yield b.slice(at, to - at)
            at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named, names = pa.array(vocabulary, pa.string()), pa.array(runs, pa.string())
        for b in (part for whole in batches for part in slices(whole)):
            parent = pc.list_parent_indices(b["w"]).to_numpy().astype(np.int64)
            word = pc.fill_null(pc.index_in(b["w"].flatten(), value_set=named), -1).to_numpy().astype(np.int64)
            first, pairs = np.flatnonzero(word >= 0), []
            for n, (codes, which) in by_size.items():
                at, code = first, word[first]
                for k in range(1, n):
                    on = at + k < len(word)
                    at, code = at[on], code[on]
                    on = (word[at + k] >= 0) & (parent[at + k] == parent[at])
                    at, code = at[on], code[on] * base + word[at[on] + k]
                place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                hit = codes[place] == code
                pairs.append(parent[at[hit]] * len(runs) + which[place[hit]])
            found, n = np.unique(np.concatenate(pairs) if pairs else np.zeros(0, np.int64), return_counts=True)
            row, alias = np.divmod(found, max(1, len(runs)))
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(row)), names.take(pa.array(alias)), pa.array(n.astype(np.int64))], ["doc_id", "alias", "n"])

    return words.mapInArrow(run, f"doc_id {words.schema['doc_id'].dataType.simpleString()}, alias string, n bigint")


def _runs(n: int) -> Column:
    return F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), _join(n))).otherwise(F.array().cast("array<string>"))


def _join(n: int):
    return lambda i: F.array_join(F.slice("w", i, n), " ")


def figures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, kind, number and caption of figures and tables: a marker and at least three words up to the sentence's or line's end; of equal ones the first."""
    pattern = r"(?i)\b(figure|fig\.|table)\s+(\d+(?:\.\d+)?)\s*[:.]\s*([^.\n]+)"
    part = lambda n: F.regexp_extract_all(text, F.lit(pattern), F.lit(n))
    rows = df_explode(docs, key, F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c")))
    kind = F.when(F.lower("a").startswith("fig"), "figure").otherwise("table")
    out = rows.select(key, "pos", kind.alias("kind"), F.col("b").alias("number"), F.trim("c").alias("caption")).where(F.size(F.split("caption", r"\s+")) >= 3)
    return out.groupBy(key, "kind", "number").agg(F.min_by("caption", "pos").alias("caption"))


def df_explode(df: DataFrame, key: str, array: Column) -> DataFrame:
    return df.select(key, F.posexplode(array).alias("pos", "x")).select(key, "pos", F.col("x.a"), F.col("x.b"), F.col("x.c"))
