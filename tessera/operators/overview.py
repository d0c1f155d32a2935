"""What a knowledge base has and how its parts do: status, what queries touch, resources to recommend, learning curves, embedders side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import constants as c
from tessera.operators import evaluation as ev
from tessera.operators.learner import folded_map, mapped, update_map, updated
from tessera.operators.neighbours import nearest_others
from tessera.storage import stored

#: Resources named with a recommendation.
RESOURCES = 3


def knowledge_status(resources: DataFrame, dimensions: tuple[str, ...] = ("course", "language", "doc_type", "processing_status"), size: str = "bytes", updated_at: str = "updated_at") -> DataFrame:
    """One row: total_resources, total_bytes, indexed, pending, last_updated, and by each dimension a map of its values to their counts; null and empty values count as unknown. Counted in two steps, so that a row holds as many entries as a dimension has values."""
    named = lambda d: F.coalesce(F.nullif(F.col(d).cast("string"), F.lit("")), F.lit("unknown"))
    is_in = lambda value: F.sum((F.col("processing_status") == value).cast("bigint"))
    totals = resources.agg(F.count("*").alias("total_resources"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("total_bytes"), F.coalesce(is_in("indexed"), F.lit(0)).alias("indexed"), F.coalesce(is_in("pending"), F.lit(0)).alias("pending"), F.max(updated_at).alias("last_updated"))
    counts = resources.select(F.explode(F.array(*(F.struct(F.lit(d).alias("d"), named(d).alias("v")) for d in dimensions))).alias("x")).groupBy("x.d", "x.v").agg(F.count("*").alias("n"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    maps = counts.groupBy().agg(*(F.coalesce(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("d") == d, F.struct("v", "n"))))), empty).alias(f"by_{d}") for d in dimensions))
    return totals.join(maps, F.lit(True))  # one row each


def touched_nodes(expanded: DataFrame, query: str = "item_id", node: str = "node") -> DataFrame:
    """Each node that queries reach: how many of them, over how many hops at least, and its best score."""
    return expanded.groupBy(node).agg(F.countDistinct(query).alias("queries"), F.min("hop").alias("hop"), F.max("score").alias("score"))


def recommended_resources(recommendations: DataFrame, provenance: DataFrame, resources: DataFrame, k: int = RESOURCES) -> DataFrame:
    """Recommendations (student, kind, concept and what else) with the first k distinct resources of their concept (concept, resource) as an array of resource and title; without any an empty one."""
    pairs = provenance.select("concept", "resource").distinct()
    nth = F.row_number().over(Window.partitionBy("concept").orderBy("resource"))
    first = pairs.withColumn("n", nth).where(F.col("n") <= k).join(resources.select("resource", "title"), "resource", "left")
    lists = first.groupBy("concept").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "resource", "title"))), lambda x: F.struct(x["resource"].alias("resource"), x["title"].alias("title"))).alias("resources"))
    out = recommendations.join(lists, "concept", "left")
    return out.withColumn("resources", F.coalesce("resources", F.array().cast(lists.schema["resources"].dataType)))


def learning_curves(events: DataFrame, order: tuple[str, ...] = ("ts", "event_id"), part: int = 1000) -> DataFrame:
    """student, concept, n and mastery before the first event (n = 0) and after each. A key's events are folded in parts of so many; where a part begins follows from the maps of those before it."""
    numbered = events.withColumn("n", F.row_number().over(Window.partitionBy("student", "concept").orderBy(*order)))
    key = ["student", "concept"]
    log = numbered.groupBy(*key, F.floor((F.col("n") - 1) / part).cast("int").alias("part")).agg(F.array_sort(F.collect_list(F.struct("n", "score", "difficulty"))).alias("log"))
    log = stored(log.withColumn("f", folded_map("log", lambda e: update_map(e["score"], e["difficulty"]))))
    starts = F.aggregate("x", F.array(F.lit(c.MASTERY_START)), lambda a, x: F.array_append(a, mapped(x["f"], F.element_at(a, -1))))
    begun = log.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("part", "f"))).alias("x")).select(*key, F.posexplode(starts).alias("part", "start"))
    steps = F.aggregate("log", F.array("start"), lambda a, e: F.array_append(a, updated(F.element_at(a, -1), e["score"], e["difficulty"])))
    made = log.drop("f").join(begun, [*key, "part"]).select(*key, "part", F.posexplode(steps).alias("k", "mastery"))
    return made.where((F.col("k") > 0) | (F.col("part") == 0)).select(*key, (F.col("part") * part + F.col("k")).cast("int").alias("n"), "mastery")


def compared_embedders(texts: DataFrame, embedders: dict[str, Column], label: str = "label", key: str = "vec_id") -> DataFrame:
    """Of each embedder (a column of vectors over texts: key, label): texts, dim, same_label, other_label and gap of mean cosines, and purity, the share of texts whose nearest neighbour among all others has their label; ties by key. Rows that share a key are texts of their own."""
    made = stored(texts.select(F.coalesce(F.col(key).cast("bigint"), F.lit(0)).alias("key"), F.col(label).alias("label"), F.monotonically_increasing_id().alias("row"), *(v.alias(f"v{k}") for k, v in enumerate(embedders.values()))))
    out = None
    for k, name in enumerate(embedders):
        rows = made.select("row", "key", "label", F.col(f"v{k}").alias("embedding"))
        size = rows.agg(F.count("*").alias("texts"), F.max(F.size("embedding")).alias("dim"))
        labels = rows.select("row", "label")
        pairs = nearest_others(rows).join(labels, "row").join(labels.select(F.col("row").alias("at"), F.col("label").alias("theirs")), "at")
        same = pairs.agg(F.round(F.avg((F.col("label") == F.col("theirs")).cast("double")), 6).alias("purity"))
        one = size.join(ev.coherence_gap(rows), F.lit(True)).join(same, F.lit(True)).select(F.lit(name).alias("embedder"), "texts", "dim", "same_label", "other_label", "gap", "purity")  # one row each
        out = one if out is None else out.unionByName(one)
    return out


def resource_events(log: DataFrame, resource_id: object, order: str = "event_id") -> DataFrame:
    """A resource's events in order of their ids; the filter reaches the scan."""
    return log.where(F.col("resource_id") == resource_id).orderBy(order)
