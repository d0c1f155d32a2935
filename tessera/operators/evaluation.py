"""Quality of rankings, vectors, scores and answers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import EVALUATION_STOP, cited, terms
from tessera.storage import running_total


def retrieval_metrics(ranking: DataFrame, gold: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """A row for each query (item_id): hit, recall, precision and nDCG at k, reciprocal rank and average precision; 0 without relevant documents."""
    marked = ranking.select("item_id", "doc_id", "rank").join(gold.withColumn("relevant", F.lit(1)), ["item_id", "doc_id"], "left").withColumn("relevant", F.coalesce("relevant", F.lit(0)))
    so_far = F.sum("relevant").over(Window.partitionBy("item_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("precision_here", F.col("relevant") * so_far / F.col("rank"))
    top = (F.col("rank") <= k) & (F.col("relevant") == 1)
    found = marked.groupBy("item_id").agg(
        F.sum(top.cast("int")).alias("hits"), F.min(F.when(F.col("relevant") == 1, F.col("rank"))).alias("first"), F.sum("precision_here").alias("ap"), F.sum(F.when(top, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg")
    )
    relevant = gold.groupBy("item_id").agg(F.count("*").alias("n_relevant"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_relevant").cast("int"))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    out = queries.select("item_id").join(relevant, "item_id", "left").join(found, "item_id", "left").fillna(0, ["n_relevant", "hits"])
    some = F.col("n_relevant") > 0
    value = lambda x: F.round(F.when(some, F.coalesce(x, F.lit(0.0))).otherwise(0.0), 6)
    return out.select(
        "item_id", "n_relevant", value((F.col("hits") > 0).cast("double")).alias("hit"), value(F.col("hits") / F.col("n_relevant")).alias("recall"), value(F.col("hits") / F.lit(k)).alias("precision"),
        value(1 / F.col("first")).alias("reciprocal_rank"), value(F.col("ap") / F.col("n_relevant")).alias("average_precision"), value(F.col("dcg") / ideal).alias("ndcg"),
    )


METRICS = ("hit", "recall", "precision", "reciprocal_rank", "average_precision", "ndcg")


def macro(metrics: DataFrame) -> DataFrame:
    """Means over all queries, those without relevant documents included, and how many have some."""
    return metrics.agg(F.count("*").alias("queries"), F.sum((F.col("n_relevant") > 0).cast("bigint")).alias("evaluated"), *(F.round(F.avg(m), 6).alias(m) for m in METRICS))


def auc(scores: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve by rank sums, ties counted half. Equal scores are counted first, so no pair is ever a row."""
    counts = scores.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(score).agg(F.sum((F.col(label) == 1).cast("bigint")).alias("pos"), F.sum((F.col(label) == 0).cast("bigint")).alias("neg"))
    won = running_total(counts, score, "neg", "below").withColumn("won", F.col("pos") * (F.col("below") + F.col("neg") / 2))
    return won.agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.round(F.sum("won") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0)), 6).alias("auc"))


def label_sums(vectors: DataFrame) -> DataFrame:
    """label, d, s, q and n: by label and dimension the sums of unit vectors' values and of their squares, and how many, of label and v; one row a batch. A batch is counted at once: a row for each value, with a length taken anew for each, grows with the square of the dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch["v"]
            labels = batch["label"].dictionary_encode("encode")
            x, parent = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64), pc.list_parent_indices(v).to_numpy()
            size = np.sqrt(np.bincount(parent, weights=x * x, minlength=batch.num_rows))[parent]
            x = np.divide(x, size, out=np.zeros(len(x)), where=size > 0)
            d = np.arange(len(x)) - np.searchsorted(parent, parent)
            wide = int(d.max(initial=0)) + 1
            place = labels.indices.to_numpy()[parent].astype(np.int64) * wide + d
            n = np.bincount(place)
            some = np.flatnonzero(n)
            sums = [np.bincount(place, weights=w)[some] for w in (x, x * x)]
            yield pa.RecordBatch.from_arrays([labels.dictionary.take(pa.array(some // wide)), pa.array((some % wide).astype(np.int32)), *map(pa.array, sums), pa.array(n[some])], ["label", "d", "s", "q", "n"])

    return vectors.mapInArrow(run, f"label {vectors.schema['label'].dataType.simpleString()}, d int, s double, q double, n bigint")


def coherence_gap(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """Mean cosine of pairs with the same label, of pairs with different ones, and the gap.

    The sum over pairs of unit vectors is the squared length of their sum less the vectors' own, so one pass of sums by
    label and dimension gives what all pairs would.
    """
    by = label_sums(vectors.select(F.col(label).alias("label"), F.col(vector).alias("v"))).groupBy(F.col("label").alias(label), "d").agg(*(F.sum(x).alias(x) for x in "sqn"))
    own = by.groupBy(label).agg(F.sum(F.col("s") * F.col("s") - F.col("q")).alias("pairs"), F.max("n").alias("n"))
    whole = by.groupBy("d").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n")).agg(F.sum(F.col("s") * F.col("s") - F.col("q")).alias("every"), F.max("n").alias("total"))
    same = own.agg(F.sum("pairs").alias("same"), F.sum(F.col("n") * (F.col("n") - 1)).alias("n_same"))
    both = same.join(whole, F.lit(True))  # one row each
    mean_same = F.col("same") / F.nullif(F.col("n_same"), F.lit(0))
    mean_other = (F.col("every") - F.col("same")) / F.nullif(F.col("total") * (F.col("total") - 1) - F.col("n_same"), F.lit(0))
    return both.select(F.round(mean_same, 6).alias("same_label"), F.round(mean_other, 6).alias("other_label"), F.round(mean_same - mean_other, 6).alias("gap"))


def purity(neighbours: DataFrame, vectors: DataFrame, key: str = "vec_id", label: str = "label") -> DataFrame:
    """The share of queries (query_id; rank 1 used) whose nearest neighbour has their label."""
    labels = vectors.select(key, label)
    near = neighbours.where("rank = 1").join(labels, key).select("query_id", F.col(label).alias("theirs"))
    both = near.join(labels.select(F.col(key).alias("query_id"), F.col(label).alias("own")), "query_id")
    return both.agg(F.count("*").alias("queries"), F.round(F.avg((F.col("own") == F.col("theirs")).cast("double")), 6).alias("purity"))


def grounding(answers: DataFrame, key: str, text: str, valid: str) -> DataFrame:
    """Of each answer: its sentences, how many cite only valid marks and at least one, the ratio, and the invalid marks in order."""
    marks = answers.select(key, valid, F.explode(answer_sentences(F.col(text))).alias("s")).withColumn("marks", F.array_distinct(cited(F.col("s"))))
    bad = F.array_except("marks", valid)
    rows = marks.withColumn("bad", bad).withColumn("ok", ((F.size("marks") > 0) & (F.size("bad") == 0)).cast("bigint"))
    out = rows.groupBy(key).agg(F.count("*").alias("sentences"), F.sum("ok").alias("grounded"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("bad")))), ",").alias("invalid"))
    return out.withColumn("ratio", F.round(F.col("grounded") / F.col("sentences"), 4))


def answer_sentences(text: Column) -> Column:
    return F.filter(F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r")), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def answer_metrics(answers: DataFrame, chosen: DataFrame, queries: DataFrame, gold: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """A row for each answer (item_id, answer, valid) with its context (item_id, place, doc_id, text): the share of the context that is right (item_id, doc_id) and whether any is, whether all citations are valid, grounding and what is not grounded, the share of cited sentences of which half the terms are in a passage they cite, whether relations between concepts are there, and the share of the question's terms in the answer."""
    near = chosen.join(gold.select("item_id", "doc_id").distinct().withColumn("right", F.lit(1)), ["item_id", "doc_id"], "left").groupBy("item_id").agg(F.avg(F.coalesce("right", F.lit(0))).alias("context_precision"), F.max(F.coalesce("right", F.lit(0))).cast("double").alias("context_recall"))
    ground = grounding(answers, "item_id", "answer", "valid").select("item_id", (F.col("invalid") == "").cast("double").alias("citation_accuracy"), F.col("ratio").alias("grounding"), F.round(1 - F.col("ratio"), 4).alias("hallucination"))
    words = lambda c: terms(c, EVALUATION_STOP)
    said = answers.select("item_id", F.posexplode(answer_sentences(F.col("answer"))).alias("pos", "s")).withColumn("place", F.explode(F.transform(F.filter(cited(F.col("s")), lambda m: m.startswith("C")), lambda m: F.substring(m, 2, 9).cast("int"))))
    held = said.join(chosen.select("item_id", "place", words(F.col("text")).alias("t")), ["item_id", "place"], "left").withColumn("w", words(F.col("s")))
    share = F.size(F.array_intersect("w", F.coalesce("t", F.array().cast("array<string>")))) / F.nullif(F.size("w"), F.lit(0))
    faithful = held.groupBy("item_id", "pos").agg(F.max(F.coalesce(share >= 0.5, F.lit(False)).cast("int")).alias("ok")).groupBy("item_id").agg(F.avg("ok").alias("faithfulness"))
    asked = queries.select("item_id", words(F.col("text")).alias("q")).join(answers.select("item_id", words(F.col("answer")).alias("a")), "item_id")
    complete = asked.select("item_id", F.coalesce(F.size(F.array_intersect("q", "a")) / F.nullif(F.size("q"), F.lit(0)), F.lit(0.0)).alias("completeness"))
    out = near.join(ground, "item_id").join(complete, "item_id").join(faithful, "item_id", "left")
    hops = relations.select("item_id").distinct().withColumn("multi_hop", F.lit(1.0)) if relations is not None else queries.select("item_id", F.lit(0.0).alias("multi_hop")).limit(0)
    out = out.join(hops, "item_id", "left")
    six = lambda c, other=0.0: F.round(F.coalesce(c, F.lit(other)), 6).alias(c)
    return out.select("item_id", six("context_precision"), six("context_recall"), six("citation_accuracy"), six("grounding"), six("faithfulness", 1.0), six("multi_hop"), six("hallucination"), six("completeness"))


ANSWER_METRICS = ("context_precision", "context_recall", "citation_accuracy", "grounding", "faithfulness", "multi_hop", "hallucination", "completeness")


def tagged_means(arms: dict[str, DataFrame], metrics: tuple[str, ...]) -> DataFrame:
    """arm and the mean of each metric (four decimals): evaluations side by side."""
    out = None
    for name, rows in arms.items():
        one = rows.agg(*(F.round(F.avg(m), 4).alias(m) for m in metrics)).select(F.lit(name).alias("arm"), *metrics)
        out = one if out is None else out.unionByName(one)
    return out


def without_gold(ranking: DataFrame, gold: DataFrame) -> DataFrame:
    """A ranking without the very rows that queries were made from (item_id, doc_id), ranks closed up: the harder task of finding related ones."""
    left = ranking.join(gold.select("item_id", "doc_id").distinct(), ["item_id", "doc_id"], "left_anti")
    return left.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("rank")))


def rates(rows: DataFrame, by: str | None, **conditions: Column) -> DataFrame:
    """The share of rows for which each condition holds, of each group if there is one: routing accuracy, safety, dispatch, discrimination."""
    share = [F.round(F.avg(F.coalesce(x, F.lit(False)).cast("double")), 6).alias(name) for name, x in conditions.items()]
    return (rows.groupBy(by) if by else rows.groupBy()).agg(F.count("*").alias("rows"), *share)


def latencies(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Mean and 95th percentile of each group."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.percentile(value, F.lit(0.95)), 6).alias("p95"))
