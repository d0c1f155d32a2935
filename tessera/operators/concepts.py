"""Concepts of a corpus: a lexicon's mentions, mined phrases, and the graph of concepts, resources, modules and courses.

A lexicon is a curated table of bounded size (concept_id, canonical, domain, aliases); it is checked before its aliases
become one pattern. Resources are rows (resource_id, title, course, module, topics, text).
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import graph as g
from tessera.operators import mining as mn
from tessera.operators.retrieval import hash_embedding, nearest
from tessera.storage import stored

#: Aliases that may be in one pattern, and mined candidates that are folded in one task.
MOST_ALIASES, MOST_CANDIDATES = 20_000, 360
# From what similarity a phrase is a concept, how many are mined, characters of a resource that are searched, what relations between resources become.
LEAST_SIMILARITY, MOST_MINED, DOCUMENT_CHARACTERS = 0.55, 60, 30_000
RELATIONS = {"extends": "extends", "depends_on": "depends_on", "part_of": "contains", "related_to": "related_to", "similar_to": "related_to"}
CONCEPT_EDGES = ["related_to", "prerequisite", "depends_on", "extends"]
PROVENANCE_EDGES = ["appears_in", "mentioned_in", "explains", "example_of"]


def aliases(lexicon: DataFrame, least: int = 1) -> DataFrame:
    """alias and concept_id: all aliases and the canonical names in lower case; one that several concepts have belongs to the least of them."""
    both = F.array_union(F.transform("aliases", lambda a: F.lower(F.trim(a))), F.array(F.lower("canonical")))
    return lexicon.select("concept_id", F.explode(both).alias("alias")).where(F.length("alias") >= least).groupBy("alias").agg(F.min("concept_id").alias("concept_id"))


def alias_pattern(known: DataFrame) -> str | None:
    """One pattern of all aliases as whole words, the longest first, so that of aliases that begin at one place the longest is found; None beyond MOST_ALIASES."""
    words = [r[0] for r in known.select("alias").limit(MOST_ALIASES + 1).collect()]  # a curated list, checked
    if len(words) > MOST_ALIASES:
        return None
    ordered = sorted(words, key=lambda w: (-len(w), w))
    return rf"(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(re.escape(w) for w in ordered) or '(?!)'})(?![\p{{L}}\p{{N}}_])"


def joined_aliases(docs: DataFrame, known: DataFrame, key: str, text: str) -> DataFrame:
    """key and alias of every find, as the pattern of all aliases would give them, for any number of aliases: the texts' parts from each place where a word may begin, as long as aliases are, meet the aliases in a join; of those that overlap the first stays, and of those that begin at one place the longest. What a document's finds are folded over is the finds alone."""
    low = docs.select(F.monotonically_increasing_id().alias("__row"), key, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("__text"))
    low = stored(low)
    lengths = [r[0] for r in known.select(F.length("alias")).distinct().orderBy(F.length("alias")).collect()]  # few: lengths of names
    word = r"[\p{L}\p{N}_]"
    begins = F.filter(F.sequence(F.lit(1), F.length("__text")), lambda i: ~F.substr(F.col("__text"), i - 1, F.when(i > 1, 1).otherwise(0)).rlike(word))
    places = low.where(F.length("__text") > 0).select("__row", "__text", F.explode(begins).alias("at"))
    parts = places.select("__row", "at", F.explode(F.array(*map(F.lit, lengths))).alias("n"), "__text").where(F.col("at") + F.col("n") - 1 <= F.length("__text"))
    parts = parts.where(~F.substr("__text", F.col("at") + F.col("n"), F.lit(1)).rlike(word)).select("__row", "at", "n", F.substr("__text", "at", "n").alias("alias"))
    hits = parts.join(known.select("alias"), "alias").groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("at", (-F.col("n")).alias("n"), "alias"))).alias("hits"))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("kept"))
    kept = F.aggregate("hits", start, lambda a, h: F.when(h["at"] > a["end"], F.struct((h["at"] - h["n"] - 1).alias("end"), F.array_append(a["kept"], h["alias"]).alias("kept"))).otherwise(a))["kept"]
    return low.select("__row", key).join(hits.select("__row", kept.alias("kept")), "__row").select(key, F.explode("kept").alias("alias"))


def mentions(docs: DataFrame, lexicon: DataFrame, key: str = "doc_id", text: str = "text", least: int = 1) -> DataFrame:
    """key, concept_id, alias and hits: aliases in the texts from left to right, none overlapping."""
    known = aliases(lexicon, least)
    pattern = alias_pattern(known)
    if pattern is None:
        found = joined_aliases(docs, known, key, text)
    else:
        found = docs.select(key, F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(pattern), F.lit(0))).alias("alias"))
        known = F.broadcast(known)
    return found.groupBy(key, "alias").agg(F.count("*").alias("hits")).join(known, "alias").select(key, "concept_id", "alias", "hits")


def lexicon_concepts(found: DataFrame, lexicon: DataFrame, key: str = "doc_id") -> DataFrame:
    """concept_id, canonical, domain, aliases (those found), frequency, n_resources, confidence and seed of each concept with mentions."""
    counted = found.groupBy("concept_id").agg(F.array_sort(F.collect_set("alias")).alias("aliases"), F.sum("hits").alias("frequency"), F.countDistinct(key).alias("n_resources"))
    return lexicon.select("concept_id", "canonical", "domain").join(counted, "concept_id").select("concept_id", "canonical", "domain", "aliases", "frequency", "n_resources", F.lit(1.0).alias("confidence"), F.lit(True).alias("seed"))


def folded_phrases(phrases: DataFrame, concepts: DataFrame) -> DataFrame:
    """phrase and concept_id: phrases whose words are all a concept's words, or among which all of a concept's words are; the least concept on a choice. Sets that contain each other share a word, by which they meet."""
    words = lambda c: F.array_distinct(F.flatten(F.transform(c, lambda x: F.split(F.lower(x), " "))))
    p = phrases.select("phrase", F.array_distinct(F.split("phrase", " ")).alias("w")).select("phrase", F.size("w").alias("np"), F.explode("w").alias("word"))
    own = concepts.select("concept_id", words(F.concat(F.array("canonical"), F.col("aliases"))).alias("w")).select("concept_id", F.size("w").alias("nc"), F.explode("w").alias("word"))
    shared = p.join(own, "word").groupBy("phrase", "concept_id", "np", "nc").agg(F.count("*").alias("n"))
    return shared.where((F.col("n") == F.col("np")) | (F.col("n") == F.col("nc"))).groupBy("phrase").agg(F.min("concept_id").alias("concept_id"))


def similarity_to(phrases: DataFrame, anchors: DataFrame) -> DataFrame:
    """phrase and similarity: the largest cosine of a phrase's hashed embedding with an anchor's (name)."""
    named = lambda df, c: df.select(F.xxhash64(c).alias("vec_id"), F.col(c).alias("name")).withColumn("embedding", hash_embedding(F.col("name")))
    left = named(phrases.select("phrase").distinct(), "phrase")
    best = nearest(left, named(anchors.select("name").distinct(), "name"), k=1, same=True)
    return left.select(F.col("vec_id").alias("query_id"), F.col("name").alias("phrase")).join(best.select("query_id", "score"), "query_id").select("phrase", F.col("score").alias("similarity"))


def mined_concepts(docs: DataFrame, lexicon: DataFrame, concepts: DataFrame, least: float = LEAST_SIMILARITY, most: int = MOST_MINED) -> tuple[DataFrame, DataFrame]:
    """Phrases as concepts: those folded into the lexicon's (phrase, concept_id, n, documents), and new ones (concept_id, canonical, domain, aliases, frequency, n_resources, confidence, seed).

    Candidates are the MOST_CANDIDATES most frequent phrases, the most similar to the lexicon first. Each is taken unless
    its words contain, or are contained in, those of one taken before, whose alias it then becomes: this needs an order, and
    is one fold over that bounded number of rows.
    """
    candidates = mn.phrases(docs, most=MOST_CANDIDATES).join(aliases(lexicon).select(F.col("alias").alias("phrase")), "phrase", "left_anti")
    folded = candidates.join(folded_phrases(candidates, concepts), "phrase")
    rest = stored(candidates.join(folded.select("phrase"), "phrase", "left_anti"))
    scored = rest.join(similarity_to(rest, lexicon.select(F.col("canonical").alias("name"))), "phrase").where(F.col("similarity") >= least)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        taken: list[dict] = []
        for r in rows.sort_values(["similarity", "phrase"], ascending=[False, True]).itertuples():
            words = set(r.phrase.split())
            if len(taken) >= most:
                break
            same = next((t for t in taken if words <= t["words"] or t["words"] <= words), None)
            if same is None:
                taken.append({"words": words, "phrase": r.phrase, "aliases": [r.phrase], "n": r.n, "documents": r.documents, "similarity": r.similarity, "first": r.n})
            else:
                same["aliases"].append(r.phrase)
                same["n"] += r.n
        return pd.DataFrame([(t["phrase"], t["aliases"], t["n"], t["documents"], t["similarity"], t["first"]) for t in taken], columns=["phrase", "aliases", "frequency", "n_resources", "similarity", "first"])

    made = scored.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(fold, "phrase string, aliases array<string>, frequency bigint, n_resources bigint, similarity double, first bigint")
    confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), mn.calibrated(F.col("similarity"), F.col("first"))))
    slug = F.concat(F.lit("concept:"), F.regexp_replace("phrase", "[^a-z0-9]+", "-"))
    return folded, made.select(slug.alias("concept_id"), F.initcap("phrase").alias("canonical"), F.lit("mined").alias("domain"), F.array_sort("aliases").alias("aliases"), "frequency", "n_resources", F.round(confidence, 4).alias("confidence"), F.lit(False).alias("seed"))


def title_tokens(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z][a-z\-]+"), F.lit(0)), lambda w: F.length(w) >= 3)


def concept_edges(found: DataFrame, concepts: DataFrame, resources: DataFrame) -> DataFrame:
    """Edges (src, dst, kind, weight, source) of concepts to the resources that mention them (resource_id, concept_id, alias): appears_in where the title has a word of the concept's name or the topics an alias, else mentioned_in; and explains back from the former."""
    topics = F.transform(F.coalesce("topics", F.array().cast("array<string>")), lambda t: F.lower(t))
    marked = found.join(concepts.select("concept_id", title_tokens(F.col("canonical")).alias("name")), "concept_id")
    marked = marked.join(resources.select("resource_id", title_tokens(F.col("title")).alias("title"), topics.alias("topics")), "resource_id")
    strong = F.arrays_overlap("name", "title") | F.array_contains("topics", F.col("alias"))
    pairs = marked.groupBy("concept_id", "resource_id").agg(F.max(F.coalesce(strong, F.lit(False))).alias("strong"))
    node = F.concat(F.lit("resource:"), F.col("resource_id").cast("string"))
    edge = lambda a, b, kind: F.struct(a.alias("src"), b.alias("dst"), kind.alias("kind"))
    to = edge(F.col("concept_id"), node, F.when(F.col("strong"), "appears_in").otherwise("mentioned_in"))
    back = F.when(F.col("strong"), edge(node, F.col("concept_id"), F.lit("explains")))
    rows = pairs.select(F.col("resource_id").cast("string").alias("source"), F.explode(F.array_compact(F.array(to, back))).alias("e"))
    return rows.select("e.*", F.lit(1.0).alias("weight"), "source")


def related_edges(found: DataFrame, least: int = 2) -> DataFrame:
    """related_to edges between concepts that share at least so many resources."""
    pairs = g.cooccurrence(found, "resource_id", "concept_id", least)
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("related_to").alias("kind"), F.col("weight").cast("double").alias("weight"), F.lit(None).cast("string").alias("source"))


def relation_edges(relations: DataFrame) -> DataFrame:
    """Edges of stated relations between resources (source, target, relation); relations without a kind are left out."""
    kind = F.lit(None).cast("string")
    for name, to in RELATIONS.items():
        kind = F.when(F.col("relation") == name, to).otherwise(kind)
    node = lambda c: F.concat(F.lit("resource:"), F.col(c).cast("string"))
    return relations.select(node("source").alias("src"), node("target").alias("dst"), kind.alias("kind"), F.lit(1.0).alias("weight"), F.col("source").cast("string").alias("source")).where("kind IS NOT NULL")


def structure(resources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, label) and edges of courses, their modules, resources and their topics."""
    course, module = F.concat(F.lit("course:"), "course"), F.concat(F.lit("module:"), "course", F.lit("/"), "module")
    node = F.concat(F.lit("resource:"), F.col("resource_id").cast("string"))
    topic = lambda t: F.concat(F.lit("topic:"), F.btrim(F.regexp_replace(F.lower(t), "[^a-z0-9]+", "-"), F.lit("-")))
    topics = resources.select(node.alias("src"), F.col("resource_id").cast("string").alias("source"), F.explode("topics").alias("topic")).select("src", topic(F.col("topic")).alias("dst"), "topic", "source").where("dst != 'topic:'")
    named = lambda i, kind, label: resources.select(i.alias("id"), F.lit(kind).alias("kind"), label.alias("label")).distinct()
    nodes = named(course, "course", F.col("course")).union(named(module, "module", F.col("module"))).union(named(node, "resource", F.col("title"))).union(topics.groupBy(F.col("dst").alias("id")).agg(F.lit("topic").alias("kind"), F.min("topic").alias("label")))
    contains = lambda df: df.select("src", "dst", F.lit("contains").alias("kind"), F.lit(1.0).alias("weight"), "source")
    none = F.lit(None).cast("string").alias("source")
    edges = contains(resources.select(course.alias("src"), module.alias("dst"), none).distinct()).union(contains(resources.select(module.alias("src"), node.alias("dst"), none).distinct())).union(contains(topics).distinct())
    return nodes, edges


def module_edges(resources: DataFrame) -> DataFrame:
    """prerequisite edges from each week's module to the next one of its course, and depends_on edges back."""
    weeks = resources.select("course", "module", F.regexp_extract("module", r"^w(\d+)", 1).alias("week")).where("week != ''").distinct()
    named = weeks.select("course", F.col("week").cast("int").alias("week"), F.concat(F.lit("module:"), "course", F.lit("/"), "module").alias("node"))
    return g.prerequisites(named, "course", ["week", "node"], "node").select("src", "dst", "kind", F.lit(1.0).alias("weight"), F.lit(None).cast("string").alias("source"))


def concept_graph(resources: DataFrame, lexicon: DataFrame, relations: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, label) and edges (src, dst, kind, weight, source) of the whole graph."""
    found = mentions(resources, lexicon, "resource_id")
    concepts = lexicon_concepts(found, lexicon, "resource_id")
    nodes, edges = structure(resources)
    nodes = nodes.union(concepts.select("concept_id", F.lit("concept"), "canonical"))
    edges = edges.union(concept_edges(found, concepts, resources)).union(related_edges(found)).union(module_edges(resources))
    return nodes, edges.union(relation_edges(relations)) if relations is not None else edges


def linked(nodes: DataFrame, edges: DataFrame, new: DataFrame, lexicon: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with new resources: their nodes and edges are added, what is there stays as it is; related_to edges wait for the next whole build."""
    found = mentions(new, lexicon, "resource_id")
    more, links = structure(new)
    links = links.union(concept_edges(found, lexicon_concepts(found, lexicon, "resource_id"), new))
    return nodes.unionByName(more.join(nodes, "id", "left_anti")), edges.unionByName(links.join(edges, ["src", "dst", "kind"], "left_anti"))


def resource_documents(resources: DataFrame, chunks: DataFrame) -> DataFrame:
    """resource_id and text: a resource's chunks (resource_id, seq, text) in order, its first DOCUMENT_CHARACTERS characters; without chunks its title, keywords and topics."""
    joined = chunks.groupBy("resource_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ").alias("text"))
    listed = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), " ")
    other = F.concat_ws(" ", "title", listed("keywords"), listed("topics"))
    out = resources.join(joined, "resource_id", "left")
    return out.select("resource_id", F.when(F.trim(F.coalesce("text", F.lit(""))) != "", F.left("text", F.lit(DOCUMENT_CHARACTERS))).otherwise(other).alias("text"))


def concept_report(concepts: DataFrame, related: DataFrame) -> DataFrame:
    """Of each domain: concepts, those of several words, seeds and mined ones, and the mean number of related concepts."""
    degree = g.degrees(related).withColumnRenamed("node", "concept_id")
    rows = concepts.join(degree, "concept_id", "left")
    n = lambda c: F.sum(c.cast("bigint"))
    return rows.groupBy("domain").agg(F.count("*").alias("concepts"), n(F.contains("canonical", F.lit(" "))).alias("multi_word"), n(F.col("seed")).alias("seeds"), n(~F.col("seed")).alias("mined"), F.round(F.avg(F.coalesce("degree", F.lit(0))), 6).alias("mean_related"))


def well_covered(concepts: DataFrame, least: int = 3, most: int = 12) -> DataFrame:
    """The most frequent concepts that at least so many resources mention."""
    return concepts.where(F.col("n_resources") >= least).orderBy(F.desc("frequency"), "concept_id").limit(most)


def first_concepts(provenance: DataFrame) -> DataFrame:
    """Of each resource the concept that is linked first (resource, concept)."""
    return provenance.groupBy("resource").agg(F.min("concept").alias("concept"))


def unified_search(text: str, resources: DataFrame, lexicon: DataFrame, evidence: DataFrame, limit: int = 10) -> DataFrame:
    """found, ref and label: resources with the text in their title, concepts with it in a name, and the best evidence rows (ref, label, rank), so many of each."""
    low = text.lower()
    a = resources.where(F.lower("title").contains(low)).orderBy("resource_id").limit(limit).select(F.lit("resource").alias("found"), F.col("resource_id").cast("string").alias("ref"), F.col("title").alias("label"))
    names = F.concat(F.array("canonical"), F.col("aliases"))
    b = lexicon.where(F.exists(names, lambda x: F.lower(x).contains(low))).orderBy("concept_id").limit(limit).select(F.lit("concept"), "concept_id", "canonical")
    return a.union(b).union(evidence.orderBy("rank").limit(limit).select(F.lit("evidence"), F.col("ref").cast("string"), "label"))
