"""Retrieval through the concept graph: queries linked to concepts, concepts to resources, boosts, evidence by paths, and a learner's weak concepts.

provenance: concept, resource and kind of the edges between concepts and resources. related: edges between concepts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import graph as g
from tessera.operators.concepts import CONCEPT_EDGES, PROVENANCE_EDGES, mentions
from tessera.operators.retrieval import boosted, ranked
from tessera.storage import stored

# What a concept of a found resource counts for, how many concepts begin an expansion and are returned, the learner's weights and the kinds of documents for a style.
SEED_WEIGHT, SEEDS, EVIDENCE, SOURCES = 0.6, 8, 15, 10
WEAK_WEIGHT, PREFERENCE_WEIGHT, PREFERENCE = 0.5, 0.2, 0.5
#: Students and resources of a set of concepts that go on together, rows that a task makes of them, rows that it makes at once, and resources that are named for one student after the other.
PACKED_STUDENTS, PACKED_RESOURCES, TASK_ROWS, UNPACKED_ROWS, RUN = 4_000, 1_000, 10_000_000, 16_384, 256
STYLE_KINDS = {"example-driven": ["assessment", "worksheet", "notebook"], "detailed": ["textbook", "lesson_page"]}


def provenance_of(edges: DataFrame, kinds: list[str] | None = PROVENANCE_EDGES) -> DataFrame:
    """concept, resource and kind of the graph's edges between concepts and resources, in either direction."""
    e = edges if kinds is None else edges.where(F.col("kind").isin(kinds))
    both = e.select("src", "dst", "kind").union(e.select("dst", "src", "kind"))
    return both.where(F.col("dst").startswith("resource:") & ~F.col("src").rlike("^(resource|module|course|topic):")).select(F.col("src").alias("concept"), F.regexp_replace("dst", "^resource:", "").alias("resource"), "kind").distinct()


def concept_relations(edges: DataFrame) -> DataFrame:
    """The edges between concepts that an expansion follows."""
    own = lambda c: ~F.col(c).rlike("^(resource|module|course|topic):")
    return edges.where(F.col("kind").isin(CONCEPT_EDGES) & own("src") & own("dst")).select("src", "dst", "kind", "weight")


def linked_concepts(queries: DataFrame, lexicon: DataFrame, ranking: DataFrame, provenance: DataFrame, k: int = SEEDS, least: int = 3) -> DataFrame:
    """query, node and score of the k concepts that each query begins with: those it names count 1, those of the resources found (item_id, resource, rank from 1) less the later the resource; the best of each."""
    named = mentions(queries, lexicon, "item_id", least=least).select("item_id", F.col("concept_id").alias("node"), F.lit(1.0).alias("score"))
    found = ranking.withColumn("n", F.count("*").over(Window.partitionBy("item_id"))).groupBy("item_id", "resource").agg(F.min("rank").alias("rank"), F.first("n").alias("n"))
    weighed = found.select("item_id", "resource", (SEED_WEIGHT * (1 - (F.col("rank") - 1) / F.col("n"))).alias("score"))
    # Only what leads to the resources found is made distinct, not all provenance.
    links = provenance.select("concept", "resource").join(found.select("resource"), "resource", "left_semi").distinct()
    near = weighed.join(links, "resource").select("item_id", F.col("concept").alias("node"), "score")
    best = named.union(near).groupBy("item_id", "node").agg(F.max("score").alias("score"))
    return ranked(best, "item_id", "node", k=k, rank="place").select(F.col("item_id").alias("query"), "node", "score")


def resource_scores(expanded: DataFrame, provenance: DataFrame) -> DataFrame:
    """item_id, resource and boost: of each resource the best score of a concept that leads to it."""
    hit = expanded.select("query", F.col("node").alias("concept"), "score").join(provenance.select("concept", "resource").distinct(), "concept")
    return hit.groupBy(F.col("query").alias("item_id"), "resource").agg(F.max("score").alias("boost"))


def graph_ranked(ranking: DataFrame, scores: DataFrame, k: int = 10) -> DataFrame:
    """A ranking (item_id, doc_id, score, rank; the doc_id names the resource) with half a share of the graph's score added."""
    return boosted(ranking, scores.select("item_id", F.col("resource").cast(ranking.schema["doc_id"].dataType).alias("doc_id"), "boost"), k=k)


def graph_reranked(ranking: DataFrame, expanded: DataFrame, provenance: DataFrame, k: int = 10) -> DataFrame:
    """graph_ranked() by resource_scores(), made for the ranking's own resources only: a query's largest score is that of its best concept that leads anywhere, so no other resource needs to be scored."""
    reached = expanded.select(F.col("query").alias("item_id"), F.col("node").alias("concept"), "score")
    most = reached.join(provenance.select("concept").distinct(), "concept", "left_semi").groupBy("item_id").agg(F.max("score").alias("most"))
    own = ranking.select("item_id", "doc_id", F.col("doc_id").cast("string").alias("resource")).distinct()
    links = provenance.select("concept", "resource").join(own.select("resource").distinct(), "resource", "left_semi").distinct()
    scores = own.join(links, "resource").join(reached, ["item_id", "concept"]).groupBy("item_id", "doc_id").agg(F.max("score").alias("boost"))
    return boosted(ranking, scores, k=k, most=most)


def graph_evidence(expanded: DataFrame, concepts: DataFrame, provenance: DataFrame, k: int = EVIDENCE) -> DataFrame:
    """item_id, concept_id, concept, score, hop, relationship, path (labels), sources and confidence of the k best concepts of each query. concepts: concept_id, canonical, confidence."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.round("score", 9).desc(), "node"))
    top = expanded.withColumn("place", place).where(F.col("place") <= k)
    label = concepts.select("concept_id", F.col("canonical").alias("concept"), "confidence")
    # Of each concept its first resources only; a window with a limit keeps no more.
    first = provenance.select("concept", "resource").distinct().withColumn("n", F.row_number().over(Window.partitionBy("concept").orderBy("resource"))).where(F.col("n") <= SOURCES)
    sources = first.groupBy("concept").agg(F.array_sort(F.collect_list("resource")).alias("sources")).withColumnRenamed("concept", "concept_id")
    steps = top.select("query", "node", F.posexplode("path").alias("i", "step")).join(label.select(F.col("concept_id").alias("step"), F.col("concept").alias("name")), "step", "left")
    paths = steps.groupBy("query", "node").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("name", "step").alias("name")))), lambda x: x["name"]).alias("names"))
    out = top.join(paths, ["query", "node"]).withColumnRenamed("node", "concept_id").join(label, "concept_id", "left").join(sources, "concept_id", "left")
    return out.select(F.col("query").alias("item_id"), "concept_id", F.coalesce("concept", "concept_id").alias("concept"), F.round("score", 4).alias("score"), "hop", "relationship", F.col("names").alias("path"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), F.round(F.coalesce("confidence", F.lit(0.0)), 4).alias("confidence"))


def graph_metrics(queries: DataFrame, seeds: DataFrame, expanded: DataFrame, provenance: DataFrame, evidence: DataFrame, gold: DataFrame, totals: dict[str, int]) -> DataFrame:
    """One row: the share of queries with a concept, of those whose right resource (item_id, resource) is reached, mean numbers of concepts, the shares of nodes, edges and concepts touched by any query, and how much of the evidence leads to the right resource. totals: nodes, edges and concepts of the graph."""
    reached = expanded.select("query", F.col("node").alias("concept"), "hop").join(provenance, "concept")
    right = reached.join(gold.select(F.col("item_id").alias("query"), "resource").distinct(), ["query", "resource"], "left_semi").select("query").distinct()
    per = queries.select(F.col("item_id").alias("query")).join(seeds.groupBy("query").agg(F.count("*").alias("seeds")), "query", "left").join(expanded.groupBy("query").agg(F.count("*").alias("expanded")), "query", "left").join(right.withColumn("hit", F.lit(1)), "query", "left").fillna(0)
    rate = evidence.select("item_id", F.explode_outer("sources").alias("resource"), "concept_id").join(gold.select("item_id", "resource").distinct().withColumn("ok", F.lit(1)), ["item_id", "resource"], "left")
    rate = rate.groupBy("item_id", "concept_id").agg(F.max(F.coalesce("ok", F.lit(0))).alias("ok")).groupBy("item_id").agg(F.avg("ok").alias("rate")).agg(F.round(F.coalesce(F.avg("rate"), F.lit(0.0)), 3).alias("gold_rate"))
    share = lambda x: F.round(F.avg((x > 0).cast("double")), 3)
    means = per.agg(share(F.col("seeds")).alias("link_coverage"), share(F.col("hit")).alias("graph_recall"), F.round(F.avg("seeds"), 2).alias("mean_seeds"), F.round(F.avg("expanded"), 2).alias("mean_expanded"))
    touched = expanded.select("node").union(reached.select(F.concat(F.lit("resource:"), "resource"))).distinct().agg(F.round(F.count("*") / max(1, totals["nodes"]), 3).alias("node_coverage"))
    edges = reached.select("concept", "resource", "kind").distinct().agg(F.round(F.count("*") / max(1, totals["edges"]), 3).alias("edge_coverage"))
    known = expanded.select("node").distinct().agg(F.round(F.count("*") / max(1, totals["concepts"]), 3).alias("concept_coverage"))
    out = means
    for one in (touched, edges, known, rate):
        out = out.join(one, F.lit(True))  # one row each
    return out


def hop_distribution(expanded: DataFrame, provenance: DataFrame, gold: DataFrame) -> DataFrame:
    """hop and queries: over how many hops the right resource was reached first."""
    # From the right resources, which are few, to the concepts that lead to them: what all queries reach is never made.
    right = gold.select("item_id", "resource").distinct()
    links = provenance.select("concept", "resource").join(right.select("resource").distinct(), "resource", "left_semi").distinct()
    reached = expanded.select(F.col("query").alias("item_id"), F.col("node").alias("concept"), "hop")
    first = right.join(links, "resource").join(reached, ["item_id", "concept"]).groupBy("item_id").agg(F.min("hop").alias("hop"))
    return first.groupBy("hop").agg(F.count("*").alias("queries"))


def weak_resources(masteries: DataFrame, provenance: DataFrame, weak: float, among: DataFrame | None = None) -> DataFrame:
    """student and resource: what leads to the student's weak concepts. among (student, resource): only these pairs are asked, so that nothing else is made.

    Without them students with the same weak concepts are packed together, and resources that lead to the same ones. Packs
    that share a concept meet, and become rows last of all: what is shuffled has a row for millions that come out, and a
    student's resources stand in one order time and again, so that a file of them is small.
    """
    low = masteries.where((F.col("mastery") < weak) & F.col("concept").isNotNull()).select("student", "concept")
    links = provenance.select("concept", "resource")
    if among is not None:
        asked = among.select("student", "resource").distinct()
        own = links.join(asked.select("resource").distinct(), "resource", "left_semi").distinct()
        return asked.join(own, "resource").join(low.distinct(), ["student", "concept"], "left_semi").select("student", "resource").distinct()
    low = stored(low)
    own = links.join(low.select("concept").distinct(), "concept", "left_semi")
    students, n_students = _packed(low, "student", "weak", PACKED_STUDENTS)
    resources, n_resources = _packed(own, "resource", "led", PACKED_RESOURCES)
    by_concept = lambda sets, name: sets.select("*", F.explode(name).alias("concept"))
    met = stored(by_concept(n_students, "weak").join(by_concept(n_resources, "led"), "concept").drop("concept").distinct())
    rows = met.agg(F.sum(F.col("n_weak") * F.col("n_led"))).first()[0] or 0
    packs = lambda name, most: F.explode(F.sequence(F.lit(0), F.ceil(F.col(f"n_{name}") / most).cast("int") - 1)).alias(f"{name}_part")
    pairs = met.select("weak", "led", "n_led", packs("weak", PACKED_STUDENTS)).select("weak", "weak_part", "led", packs("led", PACKED_RESOURCES))
    both = pairs.join(students, ["weak", "weak_part"]).join(resources, ["led", "led_part"])
    kind = lambda df, name: df.schema[name].dataType.simpleString()
    dealt = both.repartition(max(1, -(-rows // TASK_ROWS)), "weak", "weak_part", "led", "led_part").select("students", "resources")
    return dealt.mapInArrow(_unpacked, f"student {kind(low, 'student')}, resource {kind(own, 'resource')}")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each student and resource of a row of both, in columns: rows made from lists by Spark itself are all held at once. Resources go in runs of a multiple of eight, as files pack their places in eights: else a run that comes again is not found to be equal."""
    for batch in batches:
        for students, resources in zip(batch["students"], batch["resources"], strict=True):
            who, every = students.values, resources.values
            even = len(every) // 8 * 8
            for first, last in [*((k, min(k + RUN, even)) for k in range(0, even, RUN)), (even, len(every))]:
                what = every.slice(first, last - first)
                step = max(1, UNPACKED_ROWS // max(1, len(what)))
                for at in range(0, len(who) if len(what) else 0, step):
                    some = who.slice(at, step)
                    yield pa.RecordBatch.from_arrays([some.take(pa.array(np.repeat(np.arange(len(some)), len(what)))), pa.concat_arrays([what] * len(some))], ["student", "resource"])


def _packed(pairs: DataFrame, who: str, name: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Of who and concept: sets of concepts (name) with about so many of those that have just this set, and the sets with how many have them."""
    sets = stored(pairs.groupBy(who).agg(F.array_sort(F.collect_set("concept")).alias(name)))
    sizes = stored(sets.groupBy(name).agg(F.count("*").alias(f"n_{name}")))
    part = F.pmod(F.xxhash64(who), F.ceil(F.col(f"n_{name}") / most)).cast("int").alias(f"{name}_part")
    return sets.join(sizes, name).select(who, name, part).groupBy(name, f"{name}_part").agg(F.transform(F.collect_list(F.struct(who)), lambda x: x[who]).alias(f"{who}s")), sizes  # a list of structs keeps a null


def preference(profile_language: Column, style: Column, language: Column, doc_type: Column) -> Column:
    """Half for the language, half for a kind of document that the style of explanation asks for."""
    kind = F.lit(False)
    for name, kinds in STYLE_KINDS.items():
        kind = F.when(style == name, doc_type.isin(kinds)).otherwise(kind)
    yes = lambda x: F.when(F.coalesce(x, F.lit(False)), PREFERENCE).otherwise(0.0)
    return F.least(F.lit(1.0), yes(language == profile_language) + yes(kind))


def personalized(ranking: DataFrame, docs: DataFrame, profiles: DataFrame, weak: DataFrame, k: int = 10) -> DataFrame:
    """student, item_id, doc_id, score, adjustment, source and rank: each student's ranking of each query's candidates, with what leads to weak concepts and what fits the profile moved up.

    ranking: item_id, doc_id, score; docs: doc_id, language, doc_type; profiles: student, item_id (whose queries these are),
    preferred_language, explanation_style; weak: student, resource.
    """
    rows = profiles.join(ranking.select("item_id", "doc_id", "score"), "item_id").join(docs.select("doc_id", "language", "doc_type"), "doc_id")
    marked = rows.join(weak.select("student", F.col("resource").cast(ranking.schema["doc_id"].dataType).alias("doc_id"), F.lit(1.0).alias("weak")), ["student", "doc_id"], "left").withColumn("weak", F.coalesce("weak", F.lit(0.0)))
    adjustment = F.round(WEAK_WEIGHT * F.col("weak") + PREFERENCE_WEIGHT * preference(F.col("preferred_language"), F.col("explanation_style"), F.col("language"), F.col("doc_type")), 4)
    scored = marked.withColumn("adjustment", adjustment).withColumn("score", F.col("score") + F.col("adjustment"))
    place = F.row_number().over(Window.partitionBy("student", "item_id").orderBy(F.round("score", 9).desc(), "doc_id"))
    return scored.withColumn("rank", place).where(F.col("rank") <= k).select("student", "item_id", "doc_id", "score", "adjustment", F.when(F.col("weak") > 0, "personalized").otherwise("hybrid").alias("source"), "rank")


def personalization_lift(base: DataFrame, personal: DataFrame, weak: DataFrame) -> DataFrame:
    """Of each student: which share of the base ranking and of the personal one leads to weak concepts, and the difference."""
    hit = weak.select("student", F.col("resource").cast(personal.schema["doc_id"].dataType).alias("doc_id"), F.lit(1.0).alias("hit"))
    share = lambda df, name: df.select("student", "item_id", "doc_id").join(hit, ["student", "doc_id"], "left").groupBy("student").agg(F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 4).alias(name))
    both = share(base, "base_coverage").join(share(personal, "personal_coverage"), "student")
    return both.withColumn("lift", F.round(F.col("personal_coverage") - F.col("base_coverage"), 4))


def expansion(seeds: DataFrame, related: DataFrame) -> DataFrame:
    return g.expanded(seeds, related)
