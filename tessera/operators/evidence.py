"""Evidence for answers: typed rows and citations, context under a token budget, concepts and relations, prompts, extractive answers, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import constants as c
from tessera.functions.text import ANSWER_STOP, cited, clock, context_tokens, terms
from tessera.storage import stored

# What a prompt says, what an answer says without evidence.
INSTRUCTION = "Answer the question using only the numbered evidence. Cite every claim with its tag, such as [C1] for a passage or [K1] for a concept. If the evidence does not suffice, say what is missing."
NO_ANSWER = "The available course materials do not contain enough information to answer this question."
LOCATED_BY = {"pdf": "page", "slide": "slide", "video": "timestamp"}
PREREQUISITE_KINDS = ("prerequisite", "depends_on")


def source_type(slide: Column, timestamp: Column, url: Column, page: Column, chunk_type: Column) -> Column:
    """What a row comes from: the first of its places that is there."""
    return F.when(slide.isNotNull(), "slide").when(timestamp.isNotNull(), "video").when(F.coalesce(url, F.lit("")) != "", "web").when(page.isNotNull(), "pdf").when(chunk_type == "notebook_cell", "notebook").otherwise("document")


def anchor(slide: Column, page: Column, cell: Column, start: Column, char_start: Column) -> Column:
    """A place in a source, the first that is there."""
    out = F.when(slide.isNotNull(), F.concat(F.lit("slide "), slide)).when(page.isNotNull(), F.concat(F.lit("p."), page)).when(cell.isNotNull(), F.concat(F.lit("cell "), cell))
    return out.when(start.isNotNull(), clock(start)).when(char_start.isNotNull(), F.concat(F.lit("@"), char_start)).otherwise("")


def locator(slide: Column, timestamp: Column, page: Column, page_end: Column) -> Column:
    """The place that a citation names; a range of pages where there are several."""
    pages = F.concat(F.lit("p."), page, F.when(page_end.isNotNull() & (page_end != 0) & (page_end != page), F.concat(F.lit("-"), page_end)).otherwise(""))
    return F.when(slide.isNotNull(), F.concat(F.lit("slide "), slide)).when(timestamp.isNotNull(), clock(timestamp)).when(page.isNotNull(), pages).otherwise("")


def citation(source: Column, place: Column, heading: Column) -> Column:
    """[source, place, heading], without what is empty."""
    part = lambda x: F.when(F.coalesce(x, F.lit("")) == "", "").otherwise(F.concat(F.lit(", "), x))
    return F.concat(F.lit("["), source, part(place), part(heading), F.lit("]"))


def title_of(resource: Column, title: Column | None = None) -> Column:
    """The catalog's title, or the last part of the id in title case."""
    made = F.initcap(F.replace(F.element_at(F.split(resource, r"\."), -1), F.lit("-"), F.lit(" ")))
    return made if title is None else F.coalesce(F.nullif(title, F.lit("")), made)


def reason(dense_rank: Column, dense: Column, lexical_rank: Column, lexical: Column, fused: Column) -> Column:
    """How a row was found: its places and scores in the rankings that have it."""
    a = F.when(dense_rank.isNotNull(), F.format_string("dense #%d (cos %.3f)", dense_rank, dense))
    b = F.when(lexical_rank.isNotNull(), F.format_string("BM25 #%d (score %.2f)", lexical_rank, lexical))
    return F.concat(F.coalesce(F.nullif(F.concat_ws(" + ", a, b), F.lit("")), F.lit("retrieved")), F.lit(" -> fused "), F.format_string("%.4f", fused))


def evidence_confidence(score: Column, most: Column, place: Column, k: int, semantic: Column | None = None) -> Column:
    """Half by the semantic score, or without one by the share of the best score; half by the place (from 0)."""
    shared = F.when(most > 0, score / most).otherwise(0.0)
    value = 0.5 * (shared if semantic is None else F.coalesce(semantic, shared)) + 0.5 * (1 - place / F.lit(k))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def evidence_rows(ranking: DataFrame, docs: DataFrame, k: int = c.TOP_K) -> DataFrame:
    """The k best rows of each query with title, text, source type, citation and confidence. Texts are joined only after the limit, to rows that are kept, so that their number is known and texts need not be shuffled for a few; a column semantic of the ranking takes part where it is there."""
    most = F.max("score").over(Window.partitionBy("item_id"))
    top = stored(ranking.where(F.col("rank") <= k).withColumn("most", most))
    value = evidence_confidence(F.col("score"), F.col("most"), F.col("rank") - 1, k, F.col("semantic") if "semantic" in ranking.columns else None)
    out = top.join(docs.select("doc_id", "text", "source", "lang"), "doc_id")
    title = title_of(F.col("source"))
    kind = F.when(F.col("text").contains("|"), "table").otherwise("document")
    mark = F.concat(title, F.lit(" (#"), F.col("doc_id"), F.lit(")"))
    return out.select("item_id", "doc_id", "rank", title.alias("title"), kind.alias("source_type"), mark.alias("citation"), F.round(value, 6).alias("confidence"), "text", "source")


def evidence_statistics(evidence: DataFrame) -> DataFrame:
    """Of each query: items, distinct sources, items by source type, and the mean of the three best confidences."""
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("confidence")))
    best = evidence.withColumn("n", place).where("n <= 3").groupBy("item_id").agg(F.round(F.avg("confidence"), 4).alias("overall_confidence"))
    kinds = evidence.groupBy("item_id", "source_type").agg(F.count("*").alias("n")).groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "source_type", "n"))), ",").alias("by_source_type"))
    return evidence.groupBy("item_id").agg(F.count("*").alias("items"), F.countDistinct("source").alias("sources")).join(kinds, "item_id").join(best, "item_id")


def evidence_issues(evidence: DataFrame, score: str = "score", resource: str = "resource_id") -> DataFrame:
    """item_id, rank and issues of rows (rank, score, confidence, resource, citation, text, source_type, page, slide, timestamp) that break a rule: order by score, range of the confidence, what must be there, and the place that the source type asks for."""
    before = F.lag(score).over(Window.partitionBy("item_id").orderBy("rank"))
    missing = F.lit(None).cast("string")
    for kind, place in LOCATED_BY.items():
        missing = F.when((F.col("source_type") == kind) & F.col(place).isNull(), f"error: {kind} without {place}").otherwise(missing)
    empty = lambda x: F.coalesce(F.trim(F.col(x).cast("string")), F.lit("")) == ""
    rules = [
        F.when(F.col(score) > before + 1e-9, "error: order"), F.when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "error: confidence"), F.when(empty(resource), "error: resource"),
        F.when(empty("citation"), "error: citation"), F.when(empty("text"), "warning: text"), missing,
    ]
    return evidence.select("item_id", "rank", F.array_compact(F.array(*rules)).alias("issues")).where(F.size("issues") > 0)


def truncated(text: Column, most: int = c.CHUNK_TOKENS) -> Column:
    """A text's first words as far as a budget of tokens goes, with an ellipsis where some are left."""
    words, limit = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""), int(most / c.TOKENS_A_WORD)
    return F.when(F.size(words) <= limit, F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r"))).otherwise(F.concat(F.array_join(F.slice(words, 1, limit), " "), F.lit(" …")))


def context(evidence: DataFrame, budget: int = c.CONTEXT_TOKENS, items: int = c.CONTEXT_ITEMS, key: str = "source", least: float = 0.0) -> DataFrame:
    """The context of each query: by confidence, the first of each key, cut to its share, up to the first item that would pass the budget; the first item stays in any case. Numbered from 1."""
    order = [F.desc("confidence"), F.asc("doc_id")]
    some = evidence.where((F.col("confidence") >= least) & (F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\r")) != ""))
    first = some.withColumn("nth", F.row_number().over(Window.partitionBy("item_id", key).orderBy(*order))).where("nth = 1")
    sized = first.withColumn("text", truncated(F.col("text"))).withColumn("tokens", context_tokens(F.col("text")))
    so_far = Window.partitionBy("item_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # Sums only grow, so the items within the budget are the first ones.
    summed = sized.withColumn("sum", F.sum("tokens").over(so_far)).withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
    return summed.where(((F.col("sum") <= budget) | (F.col("place") == 1)) & (F.col("place") <= items)).select("item_id", "doc_id", "place", "tokens", F.col("sum").cast("bigint").alias("tokens_so_far"), "confidence", "text")


def context_concepts(graph_evidence: DataFrame, most: int = 8) -> DataFrame:
    """item_id, place, and the concept's row: the first ones of the query's own concepts, with a third of the places kept for those reached over edges. graph_evidence: item_id, concept, score, hop, relationship, path, confidence."""
    near = F.col("hop") == 0
    nth = F.row_number().over(Window.partitionBy("item_id", near).orderBy(F.round("score", 9).desc(), "concept"))
    far = F.sum((~near).cast("int")).over(Window.partitionBy("item_id"))
    kept = F.least(F.coalesce(far, F.lit(0)), F.lit(most // 3))
    chosen = graph_evidence.withColumns({"nth": nth, "kept": kept}).where(F.when(near, F.col("nth") <= most - F.col("kept")).otherwise(F.col("nth") <= F.col("kept")))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.when(near, 0).otherwise(1), "nth"))
    return chosen.withColumn("place", place).drop("nth", "kept")


def relations(concepts: DataFrame) -> DataFrame:
    """item_id, source, relationship and target: the last step of each concept's path, each once, none from a concept to itself."""
    step = concepts.where(F.size("path") >= 2).select("item_id", "place", F.element_at("path", -2).alias("source"), "relationship", F.element_at("path", -1).alias("target"))
    return step.where("source != target").groupBy("item_id", "source", "relationship", "target").agg(F.min("place").alias("place"))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def plain_sentences(text: Column, least: int = 4) -> Column:
    """Sentences by Latin terminators, those of so many words."""
    return F.filter(F.transform(F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r")), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")) >= least)


def clean_sentence(text: Column, most: int = 260) -> Column:
    """On one line, without bullets and marks around, and cut at a word."""
    line = F.btrim(F.array_join(F.filter(F.split(F.replace(text, F.lit("•"), F.lit(" ")), r"\s+"), lambda w: w != ""), " "), F.lit(" -:;,"))
    start = F.left(line, F.lit(most))
    return F.when(F.length(line) <= most, line).otherwise(F.concat(F.regexp_replace(start, r" [^ ]*$", ""), F.lit(" …")))


def best_sentences(chosen: DataFrame, queries: DataFrame) -> DataFrame:
    """item_id, place and sentence: of each context item the sentence of four words and more with most of the query's terms, the first on a tie; the whole text where there is none."""
    asked = queries.select("item_id", terms(F.col("text"), ANSWER_STOP).alias("q"))
    rows = chosen.join(asked, "item_id").withColumn("s", plain_sentences(F.col("text"))).withColumn("s", F.when(F.size("s") == 0, F.array("text")).otherwise(F.col("s")))
    scored = rows.select("item_id", "place", "q", F.posexplode("s").alias("pos", "s")).withColumn("o", overlap(terms(F.col("s"), ANSWER_STOP), F.col("q")))
    return scored.groupBy("item_id", "place").agg(F.max_by("s", F.struct("o", -F.col("pos"))).alias("s")).select("item_id", "place", clean_sentence(F.col("s")).alias("sentence"))


def answers(best: DataFrame, most: int = 3, concepts: DataFrame | None = None, queries: DataFrame | None = None) -> DataFrame:
    """item_id, answer and valid: the first three concepts, then the best sentences of the first items, each behind its mark and each once; queries without any say so. valid: the marks that may be cited."""
    best = stored(best)  # asked for twice, and made from whole texts
    said = F.regexp_replace("sentence", r"\.+$", "")
    first = best.where(F.col("place") <= most).select("item_id", "place", said.alias("s")).where("s != ''").groupBy("item_id", "s").agg(F.min("place").alias("place"))
    out = first.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("place", F.concat(F.lit("[C"), F.col("place"), F.lit("] "), F.col("s"), F.lit(".")).alias("s")))).alias("x"))
    out = out.select("item_id", F.array_join(F.transform("x", lambda x: x["s"]), " ").alias("answer"))
    valid = best.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_set("place")), lambda p: F.concat(F.lit("C"), p)).alias("valid"))
    out = out.join(valid, "item_id")
    if concepts is not None:
        named = F.transform(F.array_sort(F.collect_list(F.struct("place", "concept"))), lambda x: F.struct(x["place"].alias("place"), F.concat(x["concept"], F.lit(" [K"), x["place"], F.lit("]")).alias("s")))
        lead = concepts.groupBy("item_id").agg(named.alias("k"))
        out = out.join(lead, "item_id", "left").withColumn("k", F.coalesce("k", F.array().cast(lead.schema["k"].dataType)))
        line = F.concat(F.lit("Key concepts: "), F.array_join(F.transform(F.slice("k", 1, 3), lambda x: x["s"]), ", "), F.lit(". "), F.col("answer"))
        out = out.select("item_id", F.when(F.size("k") == 0, F.col("answer")).otherwise(line).alias("answer"), F.concat("valid", F.transform("k", lambda x: F.concat(F.lit("K"), x["place"]))).alias("valid"))
    if queries is not None:
        out = queries.select("item_id").join(out, "item_id", "left").select("item_id", F.coalesce("answer", F.lit(NO_ANSWER)).alias("answer"), F.coalesce("valid", F.array().cast("array<string>")).alias("valid"))
    return out


def prompts(chosen: DataFrame, queries: DataFrame, concepts: DataFrame | None = None) -> DataFrame:
    """item_id and prompt: the instruction, concepts, relations and prerequisites where there are some, the numbered evidence, and the question."""
    lines = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(x)), lambda y: y["s"]), "\n")
    passages = chosen.groupBy("item_id").agg(lines(F.struct("place", F.concat(F.lit("[C"), "place", F.lit("] #"), F.col("doc_id"), F.lit("\n"), "text").alias("s"))).alias("passages"))
    out = queries.select("item_id", F.col("text").alias("question")).join(passages, "item_id", "left")
    parts = [F.lit(INSTRUCTION)]
    if concepts is not None:
        how = F.when(F.col("hop") == 0, "seed").otherwise(F.concat(F.col("hop"), F.lit("-hop via "), "relationship"))
        named = F.concat(F.lit("[K"), "place", F.lit("] "), "concept", F.lit(" ("), how, F.lit(", conf "), F.format_string("%.2f", F.col("confidence")), F.lit(")"))
        steps = relations(concepts).groupBy("item_id").agg(lines(F.struct("place", F.concat(F.lit("- "), "source", F.lit(" --"), "relationship", F.lit("--> "), "target").alias("s"))).alias("relations"))
        before = concepts.where(F.col("relationship").isin(*PREREQUISITE_KINDS)).groupBy("item_id").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("place", "concept"))), lambda x: x["concept"])), ", ").alias("before"))
        out = out.join(concepts.groupBy("item_id").agg(lines(F.struct("place", named.alias("s"))).alias("concepts")), "item_id", "left").join(steps, "item_id", "left").join(before, "item_id", "left")
        parts += [F.concat(F.lit("# CONCEPTS\n"), "concepts"), F.concat(F.lit("# RELATIONS\n"), "relations"), F.concat(F.lit("# PREREQUISITES: "), "before")]
    parts += [F.concat(F.lit("# EVIDENCE\n"), F.coalesce("passages", F.lit(""))), F.concat(F.lit("# QUESTION\n"), "question"), F.lit("# ANSWER")]
    return out.select("item_id", F.concat_ws("\n\n", *parts).alias("prompt"))


def evidence_text(evidence: DataFrame, queries: DataFrame, most: int = 800) -> DataFrame:
    """item_id and text: the question and its numbered evidence, each item on one line of so many characters."""
    line = F.replace(F.btrim("text", F.lit(" \t\n\r")), F.lit("\n"), F.lit(" "))
    cut = F.when(F.length(line) > most, F.concat(F.rtrim(F.left(line, F.lit(most))), F.lit(" …"))).otherwise(line)
    rows = evidence.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("["), F.col("rank"), F.lit("] "), "citation", F.lit("\n    "), cut).alias("s")))).alias("x"))
    return queries.select("item_id", F.col("text").alias("question")).join(rows, "item_id").select("item_id", F.concat(F.lit("QUESTION: "), "question", F.lit("\n\n"), F.array_join(F.transform("x", lambda x: x["s"]), "\n\n"), F.lit("\n")).alias("text"))


def used_citations(answers_: DataFrame, index: DataFrame) -> DataFrame:
    """item_id, place and mark of the citations that an answer uses and the index (item_id, mark) has, in order of their first use."""
    marks = answers_.select("item_id", F.posexplode(F.array_distinct(cited(F.col("answer")))).alias("pos", "mark"))
    known = marks.join(index.select("item_id", "mark").distinct(), ["item_id", "mark"], "left_semi")
    return known.withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy("pos"))).drop("pos")


def citation_sources(evidence: DataFrame) -> DataFrame:
    """Citations of each source: how many, and their mean confidence."""
    return evidence.groupBy("source").agg(F.count("*").alias("citations"), F.countDistinct("item_id").alias("queries"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def citation_nodes(evidence: DataFrame, graph_evidence: DataFrame | None = None, least: float = 0.0, most: int = 40) -> DataFrame:
    """item_id, mark, kind, label, source_type, resource_id, locator, link, confidence and text of what can be cited: chunks C1 on and web pages W1 on, up to a number, and concepts K1 on. evidence: item_id, rank, resource_id, citation, source_type, url, domain, page, page_end, slide, timestamp, confidence, text."""
    web = F.col("source_type") == "web"
    rows = evidence.where(F.col("confidence") >= least).withColumn("n", F.row_number().over(Window.partitionBy("item_id").orderBy("rank"))).where(F.col("n") <= most)
    nth = F.row_number().over(Window.partitionBy("item_id", web).orderBy("rank"))
    place = F.when(web, F.coalesce("domain", F.lit(""))).otherwise(locator(F.col("slide"), F.col("timestamp"), F.col("page"), F.col("page_end")))
    out = rows.select(
        "item_id", F.concat(F.when(web, "W").otherwise("C"), nth).alias("mark"), F.when(web, "web").otherwise("chunk").alias("kind"), F.coalesce(F.nullif("citation", F.lit("")), F.when(web, F.col("url")).otherwise(F.col("resource_id"))).alias("label"),
        "source_type", "resource_id", place.alias("locator"), F.when(web, F.coalesce("url", F.lit(""))).otherwise("").alias("link"), "confidence", F.left("text", F.lit(280)).alias("text"), "page", "slide", "timestamp",
    )
    if graph_evidence is None:
        return out
    kth = F.row_number().over(Window.partitionBy("item_id").orderBy(F.round("score", 9).desc(), "concept_id"))
    how = F.when(F.col("hop") == 0, "seed").otherwise(F.concat(F.col("hop"), F.lit("-hop via "), "relationship"))
    shown = F.concat(F.array_join("path", " -> "), F.when(F.size("sources") > 0, F.concat(F.lit("  (sources: "), F.array_join(F.slice("sources", 1, 3), ", "), F.lit(")"))).otherwise(""))
    concepts = graph_evidence.select("item_id", F.concat(F.lit("K"), kth).alias("mark"), F.lit("concept").alias("kind"), F.col("concept").alias("label"), F.lit("concept").alias("source_type"), F.lit("").alias("resource_id"), how.alias("locator"), F.col("concept_id").alias("link"), "confidence", shown.alias("text"))
    return out.unionByName(concepts, allowMissingColumns=True)


def resolved(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Citation nodes with links into files (resource_id, uri) and whether they lead anywhere: a page, slide or time becomes the link's fragment; web and concept nodes have their links."""
    fragment = F.when(F.col("page").isNotNull(), F.concat(F.lit("#page="), "page")).when(F.col("slide").isNotNull(), F.concat(F.lit("#slide="), "slide")).when(F.col("timestamp").isNotNull(), F.concat(F.lit("#t="), F.col("timestamp").cast("bigint"))).otherwise("")
    own = F.when(F.col("kind") == "chunk", F.coalesce(F.concat("uri", fragment), F.lit(""))).otherwise(F.col("link"))
    out = nodes.join(files.select("resource_id", "uri"), "resource_id", "left")
    return out.withColumn("link", own).withColumn("resolvable", F.coalesce(F.col("link") != "", F.lit(False))).drop("uri", "page", "slide", "timestamp")


def filtered_nodes(nodes: DataFrame, kind: str | None = None, source_type: str | None = None, resource_id: str | None = None, min_confidence: float = 0.0, resolvable: bool | None = None) -> DataFrame:
    """The nodes for which all that is given holds."""
    out = nodes.where(F.col("confidence") >= min_confidence)
    for name, value in {"kind": kind, "source_type": source_type, "resource_id": resource_id, "resolvable": resolvable}.items():
        out = out if value is None else out.where(F.col(name) == value)
    return out


def node_statistics(nodes: DataFrame) -> DataFrame:
    """Of each query: citations, sources, the shares of resolvable nodes and of chunks with a locator, web citations, mean confidence."""
    chunk = F.col("kind") == "chunk"
    share = lambda x: F.round(F.coalesce(F.avg(x.cast("double")), F.lit(0.0)), 4)
    return nodes.groupBy("item_id").agg(
        F.count("*").alias("citations"), F.countDistinct(F.nullif("resource_id", F.lit(""))).alias("sources"), share(F.col("resolvable")).alias("resolvable_rate"), share(F.when(chunk, F.col("locator") != "")).alias("locator_coverage"),
        F.sum((F.col("kind") == "web").cast("bigint")).alias("web_citations"), share(F.col("confidence")).alias("mean_confidence"),
    )
