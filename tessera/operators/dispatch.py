"""A table of requests answered in one plan: each goes by its words to a part, each part runs once over all of its requests, and the answers come back in the requests' order.

A part takes requests (request_id, student, text, concept) and gives request_id, output, data (a map of texts) and tools. A
request whose part is not there, or gives nothing for it, has a status that says so; no request stops another.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import evidence as evd
from tessera.operators import learner as ln
from tessera.operators import planning as pl
from tessera.operators import research as rs
from tessera.operators import retrieval as r
from tessera.operators.catalog import routed
from tessera.storage import stored

Part = Callable[[DataFrame], DataFrame]
ANSWER = "request_id bigint, output string, data map<string,string>, tools array<string>"
#: Concepts whose weakness a plan is made for come from a learner's masteries; days and minutes of a plan without others.
DAYS, MINUTES, QUIZ_ROWS, SOURCES = 14, 60, 6, 3


@dataclass
class Services:
    """The tables that parts read. masteries: student, concept, mastery; docs: doc_id, text, source, lang; pages: page_id, url, title, text, snippet."""

    docs: DataFrame
    masteries: DataFrame
    pages: DataFrame
    today: str


def answer_row(output: Column, tools: list[str], **data: Column) -> list[Column]:
    """The columns of an answer."""
    parts = [x for name, value in data.items() for x in (F.lit(name), F.coalesce(value.cast("string"), F.lit("")))]
    return [F.col("request_id"), output.alias("output"), (F.create_map(*parts) if parts else F.create_map().cast("map<string,string>")).alias("data"), F.array(*map(F.lit, tools)).alias("tools")]


def _evidence(requests: DataFrame, s: Services) -> DataFrame:
    asked = requests.select(F.col("request_id").alias("item_id"), F.coalesce("concept", "text").alias("text"))
    return evd.evidence_rows(r.hybrid(asked, s.docs), s.docs)


def tutor(s: Services) -> Part:
    """An answer from the evidence, with the marks that it may cite and the mean confidence of its first three rows."""

    def run(requests: DataFrame) -> DataFrame:
        asked = requests.select(F.col("request_id").alias("item_id"), "text")
        found = stored(evd.evidence_rows(r.hybrid(asked, s.docs), s.docs))
        said = evd.answers(evd.best_sentences(evd.context(found), asked), queries=asked)
        sure = found.where("rank <= 3").groupBy("item_id").agg(F.round(F.avg("confidence"), 4).alias("confidence"))
        rows = said.join(sure, "item_id", "left").withColumnRenamed("item_id", "request_id")
        return rows.select(*answer_row(F.col("answer"), ["retrieval_qa"], citations=F.array_join("valid", ","), confidence=F.col("confidence")))

    return run


def quiz(s: Services) -> Part:
    """A question on the request's concept, or its words, from the best row of evidence; harder for those who know the concept better."""

    def run(requests: DataFrame) -> DataFrame:
        best = _evidence(requests, s).where("rank = 1").select(F.col("item_id").alias("request_id"), F.col("text").alias("found"))
        rows = requests.withColumn("concept", F.coalesce("concept", "text")).join(best, "request_id").drop("text").withColumnRenamed("found", "text")
        rows = rows.join(s.masteries.select("student", "concept", "mastery"), ["student", "concept"], "left")
        known = F.coalesce("mastery", F.lit(0.3))
        rows = rows.withColumn("difficulty", F.when(known < 0.4, "easy").when(known < 0.7, "medium").otherwise("hard"))
        return pl.quizzes(rows).select(*answer_row(F.col("question"), ["adaptive_policy", "evidence", "quiz_gen"], difficulty=F.col("difficulty"), answer_key=F.col("answer_key"), key_terms=F.array_join("key_terms", ",")))

    return run


def planner(s: Services, days: int = DAYS, minutes: int = MINUTES) -> Part:
    """A learner's study plan; learners without weak concepts have an empty one."""

    def run(requests: DataFrame) -> DataFrame:
        known = s.masteries.join(requests.select("student").where("student IS NOT NULL").distinct(), "student", "left_semi")
        planned = ln.plan_statistics(ln.study_plan(known, days, minutes)).select("student", F.col("days").alias("n"), F.col("minutes").alias("m"))
        rows = requests.join(planned, "student", "left").fillna(0, ["n", "m"])
        output = F.concat(F.lit("Study plan: "), F.col("n"), F.lit(" days, "), F.col("m"), F.lit(" min total."))
        return rows.select(*answer_row(output, ["plan"], days=F.col("n"), minutes=F.col("m")))

    return run


def _chosen(requests: DataFrame, s: Services) -> DataFrame:
    """item_id, page_id, place, trust, domain and url of the most trusted pages found for each request."""
    asked = requests.select(F.col("request_id").alias("item_id"), "text")
    found = rs.term_search(asked, s.pages, 10).join(s.pages, "page_id")
    return rs.selected(rs.scored_sources(found, s.today, by="item_id", order="rank"), k=SOURCES, order="rank")


def web_research(s: Services) -> Part:
    """The most trusted of the kept pages that a request's words are in."""

    def run(requests: DataFrame) -> DataFrame:
        one = F.format_string("%s (%.2f)", "domain", "trust")
        best = _chosen(requests, s).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("place", one.alias("s"), "page_id"))).alias("x"))
        rows = requests.join(best.withColumnRenamed("item_id", "request_id"), "request_id", "left")
        said = F.coalesce(F.array_join(F.transform("x", lambda x: x["s"]), ", "), F.lit("(none)"))
        return rows.select(*answer_row(F.concat(F.lit("Top sources: "), said), ["web_search"], pages=F.array_join(F.transform("x", lambda x: x["page_id"].cast("string")), ",")))

    return run


def research(s: Services) -> Part:
    """An answer, and whether the evidence for it is sure enough to go without pages; below the gate with the pages that were found."""

    def run(requests: DataFrame) -> DataFrame:
        asked = requests.select(F.col("request_id").alias("item_id"), "text")
        counts = r.counted(s.docs)
        sets, lexical = r.set_cosine(asked, s.docs, 50, counts), r.bm25(asked, s.docs, 50, counts=counts)
        top = stored(r.fused([(sets, r.c.W_DENSE), (lexical, r.c.W_LEXICAL)]))
        both = top.select("item_id", "doc_id", "rank").join(sets.select("item_id", "doc_id", F.col("score").alias("semantic")), ["item_id", "doc_id"], "left").join(lexical.select("item_id", "doc_id", F.col("score").alias("lexical")), ["item_id", "doc_id"], "left")
        sure = rs.confidence(both.fillna(0.0, ["semantic", "lexical"]).join(s.docs.select("doc_id", "source"), "doc_id"))
        said = evd.answers(evd.best_sentences(evd.context(evd.evidence_rows(top, s.docs)), asked), queries=asked).select("item_id", "answer")
        below = sure.where("NOT answered").select(F.col("item_id").alias("request_id"))
        pages = _chosen(requests.join(below, "request_id", "left_semi"), s).groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "page_id"))), lambda x: x["page_id"].cast("string")), ",").alias("pages"))
        rows = said.join(sure, "item_id", "left").join(pages, "item_id", "left").withColumnRenamed("item_id", "request_id")
        return rows.select(*answer_row(F.col("answer"), ["research"], confidence=F.col("confidence"), used_web=F.col("pages").isNotNull(), pages=F.col("pages")))

    return run


def curated(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """request_id, resource_id, title and text: the kept page whose address a request names, to be taken in (versions.take_in); of several the first in the text."""
    named = requests.select("request_id", F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(https?://[^\s<>\"']+)"))).alias("at", "url"))
    known = pages.select("page_id", "title", "text", "url")
    met = named.join(known, "url").groupBy("request_id").agg(F.min_by(F.struct("page_id", "title", "text", "url"), F.struct("at", "page_id")).alias("p"))
    return met.select("request_id", F.concat(F.lit("page:"), "p.page_id").alias("resource_id"), F.col("p.title").alias("title"), rs.page_markdown(F.col("p.title"), F.col("p.url"), F.col("p.text")).alias("text"))


def curator(s: Services, keep: Callable[[DataFrame], object] | None = None) -> Part:
    """Takes the pages that requests name into the corpus, through keep (resource_id, title, text), once for all of them."""

    def run(requests: DataFrame) -> DataFrame:
        found = stored(curated(requests, s.pages))
        if keep is not None:
            keep(found.select("resource_id", "title", "text").dropDuplicates(["resource_id"]))
        rows = requests.join(found.select("request_id", "resource_id"), "request_id", "left")
        output = F.when(F.col("resource_id").isNull(), "Could not ingest the source.").otherwise(F.concat(F.lit("Added resource "), "resource_id", F.lit(".")))
        return rows.select(*answer_row(output, ["knowledge_update"], resource_id=F.col("resource_id")))

    return run


def parts(s: Services, keep: Callable[[DataFrame], object] | None = None) -> dict[str, Part]:
    """The part of each route."""
    return {"tutor": tutor(s), "quiz": quiz(s), "planner": planner(s), "web_research": web_research(s), "research": research(s), "curator": curator(s, keep)}


def dispatched(requests: DataFrame, by_route: dict[str, Part]) -> DataFrame:
    """request_id, student, text, route, status, output, data and tools of every request (request_id, student, text, concept; ids are distinct). A part runs only if it has requests; which do is one small count."""
    known = stored(requests.select("request_id", "student", "text", "concept", routed(F.col("text")).alias("route")))
    asked = {x["route"] for x in known.groupBy("route").count().collect()}  # as many as there are routes
    answers = None
    for route in sorted(asked & set(by_route)):
        made = by_route[route](known.where(F.col("route") == route).drop("route"))
        made = made.select(F.col("request_id").cast("bigint").alias("request_id"), "output", "data", "tools")
        answers = made if answers is None else answers.unionByName(made)
    if answers is None:
        answers = requests.sparkSession.createDataFrame([], ANSWER)
    status = F.when(F.col("output").isNotNull(), "answered").when(F.col("route").isin(list(by_route)), "no answer").otherwise("no part")
    return known.join(answers, "request_id", "left").select("request_id", "student", "text", "route", status.alias("status"), "output", "data", "tools")
