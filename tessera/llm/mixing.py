"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

A budget of words is shared out among sources by weight. A source whose share would make it repeat more often than the most
epochs allowed is clamped there, and its excess is shared again among the others by weight, until no source is above.
A source's target then is some whole repetitions of all its documents and a fraction of one more. The fraction goes to its
documents in a seeded random order up to the last word: the document where it ends gives its first words only, so that a
source comes to its target within a word. Where the order's cut lies is found by sums over the hash order's leading digits,
a few digits at a time, so that no source's documents ever meet in one task.

Defined cases: a null source is a source of its own, the last; null, empty and blank texts have size 0 and give nothing;
a source without words has target 0; rows that repeat are documents each, and which of equal rows is cut is the same to the
result; null ids are ordered by size alone; an empty table gives no rows; columns named as those added are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import documents, stored
from tessera.storage import running_total

WEIGHTS, MOST_EPOCHS, SEED = (5, 2, 1), 3, 20240229
#: Up to so many sources their targets are broadcast (below 10 MB); beyond, sources are salted.
MOST_BROADCAST, SALTS = 100_000, 64
#: Leading hex digits of the order looked at in one step, and the steps.
DIGITS, STEPS = 3, 2
_WORD = r"[^\x20\x09-\x0D]+"


def words(text: str = "text") -> F.Column:
    """Number of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(_WORD)), F.lit(0)).cast("bigint")


def source_weights(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size and weight of every source: weights repeat along the sources in order of code points, null last."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = running_total(sources.withColumns({"__order": F.struct(F.col("source").isNull(), F.coalesce("source", F.lit(""))), "__one": F.lit(1)}), "__order", "__one", "__rank")
    return ranked.select("source", "source_size", F.array(*map(F.lit, weights))[(F.col("__rank") % len(weights)).cast("int")].alias("weight"))


def water_fill(sources: DataFrame, total: int | None = None, most_epochs: float = MOST_EPOCHS) -> DataFrame:
    """Add each source's target. total: words to share out, all sizes' sum by default. A round is one aggregate over the table of sources; only four numbers of it reach the driver.

    The level (words a unit of weight) never falls from round to round, so the clamped sources are those that the present level puts above their cap.
    """
    cap, clamped = F.col("source_size") * most_epochs, -1
    level = F.lit(0.0)
    while True:
        above = F.col("weight") * level > cap
        full, left, n, every = sources.agg(F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight"))), F.count(F.when(above, 1)), F.sum("source_size")).first()
        if n == clamped or not left:
            return sources.withColumn("target", F.when(above | F.lit(not left), cap.cast("double")).otherwise(F.col("weight") * level))
        clamped, level = n, F.lit(((every if total is None else total) - (full or 0)) / left)


def _joined(rows: DataFrame, by_source: DataFrame, n_sources: int) -> DataFrame:
    """Rows with their source's columns; null sources meet."""
    by_source = by_source.withColumnRenamed("source", "__source")
    met = F.col("source").eqNullSafe(F.col("__source"))
    if n_sources <= MOST_BROADCAST:
        return rows.join(F.broadcast(by_source), met, "left").drop("__source")
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("__order"), F.lit(SALTS)))
    copies = by_source.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, met & (F.col("__salt") == F.col("__copy")), "left").drop("__source", "__salt", "__copy")


def _cuts(rows: DataFrame, step: int, rest: F.Column) -> DataFrame:
    """For each source the digits of this step at which the rest ends (null: it doesn't), and the words before them. At most 16^DIGITS sums a source meet in a task."""
    digits = F.substring("__order", 1 + step * DIGITS, DIGITS)
    sums = rows.groupBy("source", rest.alias("__rest"), digits.alias("__digits")).agg(F.sum("size").alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.partitionBy("source").orderBy("__digits").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = sums.withColumn("__before", before).where((F.col("__before") < F.col("__rest")) & (F.col("__before") + F.col("__sum") >= F.col("__rest")))
    return ends.select("source", F.col("__digits").alias(f"__cut{step}"), F.col("__before").alias(f"__before{step}"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS, total: int | None = None, seed: int = SEED, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all by default) of every document, with its size, its source's source_size and target, and taken: the words that the mix takes of it, repeats counted."""
    carry = docs.columns if carry is None else carry
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = docs.select(F.struct(*carry).alias("__row"), F.col("source").cast("string").alias("source"), words(text).alias("size"), order.alias("__order"))
    rows = stored(rows, "sized")
    sources = stored(water_fill(stored(source_weights(rows), "sources"), total, most_epochs), "targets")
    n_sources = sources.count()
    aims = sources.withColumn("__whole", F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0)))
    aims = aims.withColumn("__rest", F.round("target").cast("bigint") - F.col("__whole") * F.col("source_size")).drop("weight")
    inside = _joined(rows.select("source", "size", "__order"), aims.select("source", "__rest"), n_sources)
    rest = F.col("__rest")
    for step in range(STEPS):
        ends = stored(_cuts(inside, step, rest), "cuts")
        aims = aims.join(ends.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
        inside = _joined(inside, ends, n_sources).where(F.substring("__order", 1 + step * DIGITS, DIGITS) == F.col(f"__cut{step}"))
        rest = rest - F.col(f"__before{step}")
    rows = _joined(rows, stored(aims, "aims"), n_sources)
    part, at_cut = F.lit(0).cast("bigint"), F.lit(True)
    for step in range(STEPS):
        digits, cut = F.substring("__order", 1 + step * DIGITS, DIGITS), F.col(f"__cut{step}")
        part = F.when(at_cut & (digits < cut), F.col("size")).otherwise(part)
        at_cut = at_cut & F.coalesce(digits == cut, F.lit(False))
    # The few rows that share all the digits of a cut: one of 16^(DIGITS * STEPS) of a source.
    sure = rows.where(~at_cut).withColumn("__part", part)
    before = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("__order", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.col("__rest") - sum((F.col(f"__before{s}") for s in range(STEPS)), F.lit(0)) - before
    cut = rows.where(at_cut).withColumn("__part", F.least("size", F.greatest(left, F.lit(0))))
    added = {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "taken": (F.col("__whole") * F.col("size") + F.col("__part")).cast("bigint")}
    return sure.unionByName(cut).select(*(F.col("__row")[c].alias(c) for c in carry if c not in added), *(x.alias(c) for c, x in added.items()))


def repeated(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself: a row for each repetition of a document, with its number as copy; a fractional one has the document's first words, joined by blanks."""
    size, taken = F.col("size"), F.col("taken")
    copies = mixed.where(taken > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), F.ceil(taken / size).cast("int") - 1)))
    left = F.least(size, taken - F.col("copy") * size)
    first = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(f"({_WORD})")), F.lit(1), left.cast("int")), " ")
    return copies.withColumn(text, F.when(left < size, first).otherwise(F.col(text)))


def op12_water_filled_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size, its source's size and target, and the words that the mix takes of it."""
    return mix(documents(spark, sf_dir), carry=["doc_id"])
