"""Queries over the concept graph of the documents: mentions, edges, linking, expansion, evidence and personal rankings."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import concepts as cp
from tessera.operators import graph as g
from tessera.operators import graph_retrieval as gr
from tessera.operators import learner as ln
from tessera.operators import mining as mn
from tessera.operators import retrieval as r
from tessera.plans.analytics import MASTERY
from tessera.plans.registry import query
from tessera.plans.retrieval import HYBRID
from tessera.session import table
from tessera.storage import stored

#: A small lexicon of words that the documents have: id, name, domain, aliases.
LEXICON = [
    ("concept:tion", "Tion", "nouns", ["tion", "attion"]), ("concept:of-the", "Of The", "links", ["of the", "the of"]), ("concept:the", "The", "links", ["the"]), ("concept:that-with", "That With", "links", ["that with", "that"]),
    ("concept:this", "This", "links", ["this", "this from"]), ("concept:ther", "Ther", "nouns", ["ther", "thing"]), ("concept:thon", "Thon", "nouns", ["thon", "thth"]), ("concept:der-die", "Der Die", "links", ["der die", "die", "und"]),
    ("concept:que", "Que", "links", ["que", "les que"]), ("concept:erer", "Erer", "nouns", ["erer", "eren", "eron"]), ("concept:anea", "Anea", "nouns", ["anea", "anon"]),
]
#: Which concept an event is about, and what the students of these queries prefer.
ABOUT = {"view": "concept:the", "click": "concept:tion", "error": "concept:ther", "purchase": "concept:erer", "signup": "concept:anea"}
LANGUAGES, STYLES, DOC_TYPES = ["en", "de", "fr"], ["example-driven", "detailed"], ["notebook", "textbook", "video", "lesson_page"]


@lru_cache(1)
def _alias_rows() -> list[tuple[str, str]]:
    out: dict[str, str] = {}
    for concept, name, _, names in LEXICON:
        for alias in {*names, name.lower()}:
            out[alias] = min(concept, out.get(alias, concept))
    return sorted(out.items())


_PATTERN = rf"\b(?:{'|'.join(sorted((a for a, _ in _alias_rows()), key=lambda a: (-len(a), a)))})\b"
_PLAIN = r"regexp_replace(regexp_replace(lower({t}), '[^\p{{L}}\p{{N}}\x00-\x7F]', '-', 'g'), '[\x{{80}}-\x{{10FFFF}}]', 'z', 'g')"


def _values(rows: list[tuple]) -> str:
    return ", ".join(str(x) for x in rows)


ALIASES = f"aliases AS (SELECT * FROM (VALUES {_values(_alias_rows())}) t(alias, concept_id)), lexicon AS (SELECT * FROM (VALUES {_values([x[:3] for x in LEXICON])}) t(concept_id, canonical, domain))"
RESOURCES = r"""res AS (SELECT doc_id AS resource_id, lang AS course, 'w' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') AS module, array_to_string(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')[1:4], ' ') AS title, source AS topic, text FROM documents)"""
MENTIONS = f"""{ALIASES}, {RESOURCES},
mentions AS (SELECT resource_id, concept_id, alias, count(*) AS hits FROM (SELECT resource_id, unnest(regexp_extract_all({_PLAIN.format(t="text")}, '{_PATTERN}')) AS alias FROM res) JOIN aliases USING (alias) GROUP BY ALL),
found_concepts AS (SELECT concept_id, string_agg(DISTINCT alias, ',' ORDER BY alias) AS aliases, CAST(sum(hits) AS BIGINT) AS frequency, count(DISTINCT resource_id) AS n_resources FROM mentions GROUP BY 1)"""
EDGES = (
    MENTIONS
    + r""",
title_words AS (SELECT resource_id, unnest(list_filter(regexp_extract_all(lower(title), '[a-z][a-z\-]+'), lambda w: length(w) >= 3)) AS word FROM res),
name_words AS (SELECT concept_id, unnest(list_filter(regexp_extract_all(lower(canonical), '[a-z][a-z\-]+'), lambda w: length(w) >= 3)) AS word FROM lexicon),
titled AS (SELECT DISTINCT resource_id, concept_id FROM title_words JOIN name_words USING (word)),
pairs AS (SELECT m.concept_id, m.resource_id, bool_or(t.concept_id IS NOT NULL OR lower(res.topic) = m.alias) AS strong FROM mentions m JOIN res USING (resource_id) LEFT JOIN titled t ON t.resource_id = m.resource_id AND t.concept_id = m.concept_id GROUP BY ALL),
provenance AS (SELECT concept_id AS concept, CAST(resource_id AS VARCHAR) AS resource, CASE WHEN strong THEN 'appears_in' ELSE 'mentioned_in' END AS kind FROM pairs UNION ALL SELECT concept_id, CAST(resource_id AS VARCHAR), 'explains' FROM pairs WHERE strong),
related AS (SELECT a.concept_id AS src, b.concept_id AS dst, count(DISTINCT a.resource_id) AS weight FROM mentions a JOIN mentions b ON a.resource_id = b.resource_id AND a.concept_id < b.concept_id GROUP BY ALL HAVING count(DISTINCT a.resource_id) >= 2)"""
)
LINKED = (
    EDGES
    + f""",
candidates AS (SELECT item_id, doc_id, rank, count(*) OVER (PARTITION BY item_id) AS n FROM fused WHERE rank <= 30),
named AS (SELECT DISTINCT item_id, concept_id AS node, CAST(1 AS DOUBLE) AS score FROM (SELECT item_id, unnest(regexp_extract_all({_PLAIN.format(t="text")}, '{_PATTERN}')) AS alias FROM benchmark) JOIN aliases USING (alias)),
near_concepts AS (SELECT item_id, concept AS node, max(CAST(0.6 AS DOUBLE) * (1 - (rank - 1) / n)) AS score FROM candidates JOIN (SELECT DISTINCT concept, resource FROM provenance) ON resource = CAST(doc_id AS VARCHAR) GROUP BY ALL),
linked AS (SELECT item_id AS query, node, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, node) AS place FROM (SELECT item_id, node, max(score) AS score FROM (SELECT * FROM named UNION ALL SELECT * FROM near_concepts) GROUP BY ALL)) WHERE place <= 8)"""
)
EXPANDED = (
    LINKED
    + """,
moves AS (SELECT src AS node, dst AS too FROM related UNION ALL SELECT dst, src FROM related),
r1 AS (SELECT query, too AS node, max(score * (CAST(0.6 AS DOUBLE) * 0.5)) AS score FROM linked JOIN moves USING (node) GROUP BY ALL),
f1 AS (SELECT r1.* FROM r1 LEFT JOIN linked s ON s.query = r1.query AND s.node = r1.node WHERE s.node IS NULL OR r1.score > s.score),
k1 AS (SELECT query, node, score, 0 AS hop FROM linked s WHERE NOT EXISTS (SELECT 1 FROM f1 WHERE f1.query = s.query AND f1.node = s.node) UNION ALL SELECT query, node, score, 1 FROM f1),
front AS (SELECT query, node, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, node) AS n FROM f1) WHERE n <= 24),
r2 AS (SELECT query, too AS node, max(score * (CAST(0.6 AS DOUBLE) * 0.5)) AS score FROM front JOIN moves USING (node) GROUP BY ALL),
f2 AS (SELECT r2.* FROM r2 LEFT JOIN k1 ON k1.query = r2.query AND k1.node = r2.node WHERE k1.node IS NULL OR r2.score > k1.score),
expanded AS (SELECT query, node, score, hop FROM k1 WHERE NOT EXISTS (SELECT 1 FROM f2 WHERE f2.query = k1.query AND f2.node = k1.node) UNION ALL SELECT query, node, score, 2 FROM f2)"""
)
BOOSTS = (
    EXPANDED
    + """,
boosts AS (SELECT query AS item_id, resource, max(score) AS boost FROM expanded JOIN (SELECT DISTINCT concept, resource FROM provenance) ON concept = node GROUP BY ALL)"""
)


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON, "concept_id string, canonical string, domain string, aliases array<string>")


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a course's resources: the language is the course, the first words are the title."""
    words = F.filter(F.split("text", r"\s+", 6), lambda w: w != "")  # the first four, behind an empty one where the text begins with blanks
    module = F.concat(F.lit("w"), F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("resource_id"), F.col("lang").alias("course"), module.alias("module"), F.array_join(F.slice(words, 1, 4), " ").alias("title"), F.array("source").alias("topics"), "text")


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of concepts to resources and to each other, kept for the query."""
    res, lex = resources(spark, sf_dir), lexicon(spark)
    found = stored(cp.mentions(res, lex, "resource_id"))
    concepts = cp.lexicon_concepts(found, lex, "resource_id")
    return stored(cp.concept_edges(found, concepts, res).union(cp.related_edges(found)))


def _candidates(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return stored(r.hybrid(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), k=k))


def _linked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Candidates, edges, provenance and the concepts that queries begin with."""
    top, edges = _candidates(spark, sf_dir, 30), graph_edges(spark, sf_dir)
    provenance = gr.provenance_of(edges)
    ranking = top.select("item_id", F.col("doc_id").cast("string").alias("resource"), "rank")
    return top, edges, provenance, stored(gr.linked_concepts(table(spark, sf_dir, "benchmark"), lexicon(spark), ranking, provenance))


@query(f"WITH {MENTIONS} SELECT resource_id, concept_id, alias, hits FROM mentions")
def concept_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.mentions(resources(spark, sf_dir), lexicon(spark), "resource_id")


@query(f"WITH {MENTIONS} SELECT concept_id, canonical, domain, aliases, frequency, n_resources FROM found_concepts JOIN lexicon USING (concept_id)")
def lexicon_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cp.mentions(resources(spark, sf_dir), lexicon(spark), "resource_id")
    return cp.lexicon_concepts(found, lexicon(spark), "resource_id").select("concept_id", "canonical", "domain", F.array_join("aliases", ",").alias("aliases"), "frequency", "n_resources")


@query(f"WITH {EDGES} SELECT concept AS src, 'resource:' || resource AS dst, kind FROM provenance WHERE kind <> 'explains' UNION ALL SELECT 'resource:' || resource, concept, kind FROM provenance WHERE kind = 'explains' UNION ALL SELECT src, dst, 'related_to' FROM related")
def concept_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_edges(spark, sf_dir).select("src", "dst", "kind")


@query(f"WITH {EDGES} SELECT domain, count(*) AS concepts, CAST(sum(CASE WHEN contains(canonical, ' ') THEN 1 ELSE 0 END) AS BIGINT) AS multi_word, count(*) AS seeds, CAST(0 AS BIGINT) AS mined, round(avg(coalesce(degree, 0)), 6) AS mean_related FROM found_concepts JOIN lexicon USING (concept_id) LEFT JOIN (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM related UNION ALL SELECT dst FROM related) GROUP BY 1) ON node = concept_id GROUP BY 1")
def concept_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stored(cp.mentions(resources(spark, sf_dir), lexicon(spark), "resource_id"))
    return cp.concept_report(cp.lexicon_concepts(found, lexicon(spark), "resource_id"), cp.related_edges(found))


@query(f"""WITH {RESOURCES}, w AS (SELECT DISTINCT course, module, CAST(module[2:] AS INTEGER) AS week FROM res), p AS (SELECT 'module:' || course || '/' || module AS src, lead('module:' || course || '/' || module) OVER (PARTITION BY course ORDER BY week) AS dst FROM w)
SELECT 'module' AS kind, 'module:' || course || '/' || module AS a, '' AS b FROM w UNION ALL SELECT 'course', 'course:' || course, '' FROM (SELECT DISTINCT course FROM res) UNION ALL SELECT 'resource', 'resource:' || resource_id, '' FROM res UNION ALL SELECT 'topic', 'topic:' || topic, '' FROM (SELECT DISTINCT topic FROM res)
UNION ALL SELECT 'prerequisite', src, dst FROM p WHERE dst IS NOT NULL UNION ALL SELECT 'depends_on', dst, src FROM p WHERE dst IS NOT NULL UNION ALL SELECT 'contains', 'module:' || course || '/' || module, 'resource:' || resource_id FROM res
UNION ALL SELECT 'contains', 'course:' || course, 'module:' || course || '/' || module FROM w UNION ALL SELECT 'contains', 'resource:' || resource_id, 'topic:' || topic FROM res""")
def course_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges of courses, modules, resources and topics, with weeks in order."""
    res = resources(spark, sf_dir)
    nodes, edges = cp.structure(res)
    return nodes.select("kind", F.col("id").alias("a"), F.lit("").alias("b")).union(cp.module_edges(res).select("kind", "src", "dst")).union(edges.select("kind", "src", "dst"))


@query(f"WITH {EDGES}, p AS (SELECT resource, concept FROM (SELECT resource, concept, row_number() OVER (PARTITION BY resource ORDER BY concept) AS n FROM (SELECT DISTINCT resource, concept FROM provenance)) WHERE n <= 12), b AS (SELECT src AS concept, dst AS related, weight FROM related UNION ALL SELECT dst, src, weight FROM related), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY weight DESC, related) AS n FROM b) WHERE n <= 5) SELECT resource, concept, related, CAST(weight AS DOUBLE) AS weight FROM p JOIN t USING (concept)")
def related_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each resource's concepts the most related ones."""
    edges = graph_edges(spark, sf_dir)
    provenance = gr.provenance_of(edges).select("resource", "concept").distinct()
    return g.related_of_resources(provenance, gr.concept_relations(edges))


@query(f"WITH {HYBRID}, {LINKED} SELECT query, node, round(score, 6) AS score FROM linked")
def query_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The concepts that each query begins with."""
    return _linked(spark, sf_dir)[3].select("query", "node", F.round("score", 6).alias("score"))


@query(f"WITH {HYBRID}, {EXPANDED} SELECT query, node, round(score, 6) AS score, hop FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, node) AS place FROM expanded) WHERE place <= 60")
def concept_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges, _, seeds = _linked(spark, sf_dir)
    return gr.expansion(seeds, gr.concept_relations(edges)).select("query", "node", F.round("score", 6).alias("score"), "hop")


@query(f"""WITH {HYBRID}, {BOOSTS}, most AS (SELECT item_id, max(boost) AS most FROM boosts GROUP BY 1),
again AS (SELECT f.item_id, f.doc_id, f.score + 0.5 * coalesce(boost / most, 0) AS score FROM (SELECT * FROM fused WHERE rank <= 30) f LEFT JOIN boosts b ON b.item_id = f.item_id AND b.resource = CAST(f.doc_id AS VARCHAR) LEFT JOIN most m ON m.item_id = f.item_id)
SELECT item_id, doc_id, rank, round(score, 6) AS score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank FROM again) WHERE rank <= 10""")
def graph_retrieval_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid candidates ranked again by how near their concepts are to the query's."""
    top, edges, provenance, seeds = _linked(spark, sf_dir)
    return gr.graph_reranked(top, gr.expansion(seeds, gr.concept_relations(edges)), provenance).select("item_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(f"""WITH {HYBRID}, {EXPANDED}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, node) AS place FROM expanded) WHERE place <= 15),
firsts AS (SELECT concept, string_agg(resource, ',' ORDER BY resource) AS sources FROM (SELECT concept, resource, row_number() OVER (PARTITION BY concept ORDER BY resource) AS n FROM (SELECT DISTINCT concept, resource FROM provenance)) WHERE n <= 10 GROUP BY 1)
SELECT query AS item_id, node AS concept_id, canonical AS concept, round(score, 4) AS score, hop, CASE WHEN hop = 0 THEN 'seed' ELSE 'related_to' END AS relationship, coalesce(sources, '') AS sources, CAST(1 AS DOUBLE) AS confidence FROM top JOIN lexicon ON concept_id = node LEFT JOIN firsts ON concept = node""")
def graph_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The concepts that a query reaches, and where they come from."""
    _, edges, provenance, seeds = _linked(spark, sf_dir)
    concepts = lexicon(spark).select("concept_id", "canonical", F.lit(1.0).alias("confidence"))
    return gr.graph_evidence(gr.expansion(seeds, gr.concept_relations(edges)), concepts, provenance).select("item_id", "concept_id", "concept", "score", "hop", "relationship", F.array_join("sources", ",").alias("sources"), "confidence")


@query(f"""WITH {HYBRID}, {EXPANDED}, gold AS (SELECT DISTINCT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
reached AS (SELECT query, min(hop) AS hop FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, node) AS place FROM expanded) WHERE place <= 60) e JOIN provenance ON concept = node JOIN gold ON item_id = query AND CAST(gold.doc_id AS VARCHAR) = resource GROUP BY 1)
SELECT hop, count(*) AS queries FROM reached GROUP BY 1""")
def hop_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over how many hops the documents that hold a passage are reached."""
    _, edges, provenance, seeds = _linked(spark, sf_dir)
    gold = r.containing(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")).select("item_id", F.col("doc_id").cast("string").alias("resource"))
    return gr.hop_distribution(gr.expansion(seeds, gr.concept_relations(edges)), provenance, gold)


_ABOUT = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ABOUT.items()) + " END"
_PICK = lambda what, names: f"CASE {what} % {len(names)} " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(names)) + " END"
WEAK = f"""{MASTERY}, weak_concepts AS (SELECT student, {_ABOUT.replace("event_type", "concept")} AS concept FROM mastery WHERE mastery < 0.4), weak AS (SELECT DISTINCT student, resource FROM weak_concepts JOIN provenance USING (concept))"""


def _pick(what, names: list[str]):
    out = F.lit(None).cast("string")
    for k, n in enumerate(names):
        out = F.when(what % len(names) == k, n).otherwise(out)
    return out


def masteries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mastery of the lexicon's concepts that events are about."""
    about = F.lit(None).cast("string")
    for event, concept in ABOUT.items():
        about = F.when(F.col("concept") == event, concept).otherwise(about)
    return ln.mastery(ln.learner_events(table(spark, sf_dir, "events"))).withColumn("concept", about)


def _personal(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    provenance = gr.provenance_of(graph_edges(spark, sf_dir))
    n = table(spark, sf_dir, "benchmark").count()
    student = F.col("student")
    profiles = table(spark, sf_dir, "events").select(F.col("user_id").alias("student")).distinct().select("student", (student % n).alias("item_id"), _pick(student, LANGUAGES).alias("preferred_language"), _pick(student, STYLES).alias("explanation_style"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("language"), _pick(F.col("doc_id"), DOC_TYPES).alias("doc_type"))
    top = _candidates(spark, sf_dir, 40)
    among = profiles.join(top.select("item_id", F.col("doc_id").cast("string").alias("resource")), "item_id")
    return stored(gr.weak_resources(masteries(spark, sf_dir), provenance, ln.c.WEAK, among)), profiles, docs, top


PERSONAL = f"""{HYBRID}, {EDGES}, {WEAK},
profiles AS (SELECT DISTINCT user_id AS student, user_id % (SELECT count(*) FROM benchmark) AS item_id, {_PICK("user_id", LANGUAGES)} AS preferred_language, {_PICK("user_id", STYLES)} AS style FROM events),
candidates AS (SELECT p.student, f.item_id, f.doc_id, f.score, f.rank AS base_rank, w.resource IS NOT NULL AS weak, d.lang = p.preferred_language AS spoken, {_PICK("f.doc_id", DOC_TYPES)} AS doc_type, style FROM profiles p JOIN fused f ON f.item_id = p.item_id AND f.rank <= 40 JOIN documents d ON d.doc_id = f.doc_id LEFT JOIN weak w ON w.student = p.student AND w.resource = CAST(f.doc_id AS VARCHAR)),
adjusted AS (SELECT *, round(CASE WHEN weak THEN 0.5::DOUBLE ELSE 0 END + 0.2::DOUBLE * least(1.0, CASE WHEN spoken THEN 0.5 ELSE 0 END + CASE WHEN style = 'example-driven' AND doc_type IN ('assessment', 'worksheet', 'notebook') OR style = 'detailed' AND doc_type IN ('textbook', 'lesson_page') THEN 0.5 ELSE 0 END), 4) AS adjustment FROM candidates),
personal AS (SELECT *, CAST(row_number() OVER (PARTITION BY student, item_id ORDER BY round(score + adjustment, 9) DESC, doc_id) AS INTEGER) AS rank FROM adjusted)"""


@query(f"WITH {PERSONAL} SELECT student, item_id, doc_id, round(score + adjustment, 6) AS score, adjustment, CASE WHEN weak THEN 'personalized' ELSE 'hybrid' END AS source, rank FROM personal WHERE rank <= 10")
def personalized_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each student's ranking for a query: documents on weak concepts and of a preferred kind move up."""
    weak, profiles, docs, top = _personal(spark, sf_dir)
    return gr.personalized(top, docs, profiles, weak).withColumn("score", F.round("score", 6))


@query(f"""WITH {PERSONAL}, a AS (SELECT student, round(avg(CASE WHEN weak THEN 1.0 ELSE 0.0 END), 4) AS base_coverage FROM personal WHERE base_rank <= 10 GROUP BY 1), b AS (SELECT student, round(avg(CASE WHEN weak THEN 1.0 ELSE 0.0 END), 4) AS personal_coverage FROM personal WHERE rank <= 10 GROUP BY 1)
SELECT student, base_coverage, personal_coverage, round(personal_coverage - base_coverage, 4) AS lift FROM a JOIN b USING (student)""")
def personalization_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    weak, profiles, docs, top = _personal(spark, sf_dir)
    base = profiles.select("student", "item_id").join(top.where("rank <= 10"), "item_id")
    return gr.personalization_lift(base, stored(gr.personalized(top, docs, profiles, weak)), weak)


@query(f"WITH {EDGES}, {WEAK} SELECT student, resource FROM weak")
def weak_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each student's weak concepts are taught by."""
    return gr.weak_resources(masteries(spark, sf_dir), gr.provenance_of(graph_edges(spark, sf_dir)), ln.c.WEAK)


@query()
def mined_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of the documents that are near the lexicon; a fold over at most 360 candidates."""
    docs, lex = table(spark, sf_dir, "documents"), lexicon(spark)
    found = cp.lexicon_concepts(cp.mentions(docs, lex), lex)
    return cp.mined_concepts(docs, lex, found)[1].select("concept_id", "canonical", F.array_join("aliases", ",").alias("aliases"), "frequency", "confidence")


@query("""SELECT DISTINCT d.source, trim(x) AS line FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) d WHERE length(trim(x)) > 400""")
def long_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that no header or footer is: what is left of long lines when repeated ones are taken out."""
    docs = table(spark, sf_dir, "documents")
    left = mn.without_repeated_lines(docs, mn.repeated_lines(docs, "source", "doc_id", ratio=0.02), "source", "doc_id")
    lines = left.select("source", F.explode(F.split("text", "\n")).alias("x")).select("source", F.trim("x").alias("line"))
    return lines.where(F.length("line") > 400).distinct()
