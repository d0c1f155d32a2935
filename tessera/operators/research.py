"""Research over kept pages: term search, freshness and trust, selection, passages, confidence gates, merging, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import domain, terms, url_key
from tessera.operators.evidence import overlap

# How far domains and endings are trusted, words that speak for and against a source, weights of trust, the gate's weights and bounds.
AUTHORITY = {
    "arxiv.org": 1.0, "wikipedia.org": 0.85, "docs.python.org": 0.95, "scholar.google.com": 0.9, "nature.com": 0.95, "acm.org": 0.95, "ieee.org": 0.95, "springer.com": 0.9,
    "sciencedirect.com": 0.9, "pytorch.org": 0.95, "tensorflow.org": 0.95, "scikit-learn.org": 0.95, "developer.mozilla.org": 0.9, "khanacademy.org": 0.85, "coursera.org": 0.8, "edx.org": 0.8,
    "towardsdatascience.com": 0.6, "medium.com": 0.5, "stackoverflow.com": 0.75, "github.com": 0.7,
}
ENDING_AUTHORITY = {"edu": 0.9, "gov": 0.9, "org": 0.7, "ac": 0.85}
OTHER_AUTHORITY = 0.45
TEACHING = r"(?i)\b(tutorial|guide|introduction|lecture|course|documentation|explained|definition|concept|paper|study|reference|how to|example)\b"
SPAM = r"(?i)\b(buy now|free download|click here|cheap|casino|porn|crypto giveaway|discount|coupon|earn money|viagra)\b"
DATE = r"(20[0-9]{2})[-/]([0-9]{1,2})(?:[-/]([0-9]{1,2}))?"
TRUST = {"authority": 0.40, "fresh": 0.15, "teaching": 0.20, "citing": 0.15, "spam": -0.50}
LEAST_TRUST, GATE, HIGH, LOW, LEXICAL_REFERENCE = 0.4, 0.70, 0.72, 0.55, 22.0
GATE_WEIGHTS = {"semantic": 0.55, "agreement": 0.30, "lexical": 0.15}
SNIPPET, RESULTS, SOURCES = 200, 6, 3


def page_text(html: Column) -> Column:
    """A page's text for searching: no scripts, styles or tags."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"(?s)<[^>]+>", " ")
    return F.btrim(F.regexp_replace(bare, r"\s+", " "))


def occurrences(text: Column, term: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)


def term_search(queries: DataFrame, pages: DataFrame, k: int = RESULTS) -> DataFrame:
    """item_id, page_id, hits and rank: pages by how often a query's words of three and more characters are in them, inside words too.

    A word of a query has no blanks, so it lies within a word of the page. Each distinct word of the pages is cut into its
    parts of the lengths asked for, and these meet the queries' words in an equi-join; then words stand for their pages.
    """
    low = lambda t: F.filter(F.split(F.lower(F.coalesce(t, F.lit(""))), r"\s+"), lambda w: w != "")
    asked = queries.select("item_id", F.explode(F.array_distinct(low(F.col("text")))).alias("term")).where(F.length("term") > 2)
    sizes = [r[0] for r in asked.select(F.length("term")).distinct().collect()]  # one for each length of a word
    if not sizes:
        return queries.sparkSession.createDataFrame([], f"item_id {queries.schema['item_id'].dataType.simpleString()}, page_id {pages.schema['page_id'].dataType.simpleString()}, hits bigint, rank int")
    words = pages.select("page_id", F.explode(low(F.col("text"))).alias("word")).groupBy("page_id", "word").agg(F.count("*").alias("n"))
    cut = lambda n: F.when(F.length("word") >= n, F.transform(F.sequence(F.lit(1), F.length("word") - (n - 1)), lambda i: F.substring("word", i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    parts = words.select("word").distinct().select("word", F.explode(F.array_distinct(F.concat(*map(cut, sorted(sizes))))).alias("term"))
    found = parts.join(asked.select("term").distinct(), "term", "left_semi").withColumn("in_word", occurrences(F.col("word"), F.col("term")).cast("bigint"))
    counts = words.join(found, "word").groupBy("page_id", "term").agg(F.sum(F.col("n") * F.col("in_word")).alias("n"))
    hits = counts.join(asked, "term").groupBy("item_id", "page_id").agg(F.sum("n").alias("hits"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("hits"), "page_id"))
    return hits.withColumn("rank", place).where(F.col("rank") <= k)


def query_language(text: Column) -> Column:
    """The language whose encyclopedia a query is for: Arabic where it has a letter of that script."""
    return F.when(text.rlike(r"[\x{0600}-\x{06FF}]"), "ar").otherwise("en")


def authority(host: Column) -> Column:
    """By the domain or one above it, else by a second-level ending, else by the ending."""
    ending, second = F.regexp_extract(host, r"\.([^.]+)$", 1), F.regexp_extract(host, r"([^.]+)\.[^.]+$", 1)
    out = F.lit(OTHER_AUTHORITY)
    for part in (ending, second):
        for name, value in ENDING_AUTHORITY.items():
            out = F.when(part == name, value).otherwise(out)
    for name, value in AUTHORITY.items():
        out = F.when(host.endswith(f".{name}"), value).otherwise(out)
    for name, value in AUTHORITY.items():
        out = F.when(host == name, value).otherwise(out)
    return out


def freshness(text: Column, today: str) -> Column:
    """By the first year and month in the text: 1 now, falling to 0 in five years; one half without a date."""
    year, month = F.regexp_extract(text, DATE, 1), F.regexp_extract(text, DATE, 2)
    date = F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lit("01")), "yyyy-MM-dd")
    age = F.datediff(F.to_date(F.lit(today)), date) / F.lit(5 * 365)
    return F.when(date.isNull(), 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - age)))


def scored_sources(results: DataFrame, today: str, deny: tuple[str, ...] = (), by: str | None = None, order: str = "page_id") -> DataFrame:
    """results (page_id, url, title, snippet, published if there is such a column, and what else; the date is looked for in published where that isn't empty, else in the texts) with domain, url_key, what speaks for and against the source, trust, and duplicate: whether an earlier one in order (of the same by, if given) has the key."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")))
    count = lambda pattern: F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))
    dated = F.coalesce(F.nullif(F.col("published").cast("string"), F.lit("")), text) if "published" in results.columns else text
    denied = F.col("domain").isin(list(deny)) if deny else F.lit(False)
    out = results.withColumn("domain", domain(F.col("url")))
    out = out.withColumn("url_key", F.coalesce(F.nullif(url_key(F.col("url")), F.lit("")), F.concat_ws("::", "domain", F.lower(F.trim("title")))))
    out = out.withColumns({
        "authority": authority(F.col("domain")), "fresh": freshness(dated, today), "teaching": F.least(F.lit(1.0), 0.4 + 0.15 * count(TEACHING)),
        "spam": F.least(F.lit(1.0), 0.25 * count(SPAM) + F.when(denied, 0.5).otherwise(0.0)),
    })
    out = out.withColumn("citing", F.when(F.col("domain").isin(list(AUTHORITY)), 0.8).when(F.col("authority") >= 0.7, 0.5).otherwise(0.3))
    total = sum((F.lit(w) * F.col(k) for k, w in TRUST.items()), F.lit(0.0))
    nth = F.row_number().over(Window.partitionBy(*([by] if by else []), "url_key").orderBy(order))
    return out.withColumns({"trust": F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)), 3), "duplicate": nth > 1})


def selected(sources: DataFrame, k: int = SOURCES, by: str = "item_id", order: str = "page_id") -> DataFrame:
    """The k most trusted sources of each query that are no duplicates and trusted enough; ties by order."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("trust"), order))
    return sources.where(~F.col("duplicate") & (F.col("trust") >= LEAST_TRUST)).withColumn("place", place).where(F.col("place") <= k)


def passages(rows: DataFrame, queries: DataFrame, n: int = 2, words: int = 15) -> DataFrame:
    """The n paragraphs of each row (item_id, page_id, text) with most of the query's terms."""
    asked = queries.select("item_id", terms(F.col("text")).alias("q"))
    parts = rows.join(asked, "item_id").select("item_id", "page_id", "q", F.posexplode(F.split("text", r"\n\s*\n")).alias("pos", "passage")).where(F.size(F.split("passage", r"\s+")) >= words)
    place = F.row_number().over(Window.partitionBy("item_id", "page_id").orderBy(F.desc("o"), "pos"))
    return parts.withColumn("o", overlap(terms(F.col("passage")), F.col("q"))).withColumn("place", place).where(F.col("place") <= n).select("item_id", "page_id", "place", "passage", F.col("o").alias("terms"))


def page_markdown(title: Column, url: Column, text: Column) -> Column:
    """A cleaned page as a Markdown document: its title as heading, where it comes from, its text."""
    return F.concat(F.lit("# "), title, F.lit("\n\nSource: "), url, F.lit("\n\n"), F.btrim(text), F.lit("\n"))


def confidence(evidence: DataFrame) -> DataFrame:
    """item_id, confidence, level and answered: of the first five rows (rank, semantic, lexical, source) the best semantic and lexical scores and the share of the commonest source."""
    top = evidence.where("rank <= 5")
    best = top.groupBy("item_id").agg(F.max("semantic").alias("semantic"), F.max("lexical").alias("lexical"), F.count("*").alias("n"))
    mode = top.groupBy("item_id", "source").agg(F.count("*").alias("m")).groupBy("item_id").agg(F.max("m").alias("m"))
    signals = {"semantic": F.col("semantic"), "agreement": F.col("m") / F.col("n"), "lexical": F.least(F.lit(1.0), F.col("lexical") / LEXICAL_REFERENCE)}
    value = sum((w * F.round(signals[k], 4) for k, w in GATE_WEIGHTS.items()), F.lit(0.0)) / sum(GATE_WEIGHTS.values())
    out = best.join(mode, "item_id").select("item_id", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)), 4).alias("confidence"))
    return out.select("*", F.when(F.col("confidence") >= HIGH, "high").when(F.col("confidence") >= LOW, "medium").otherwise("low").alias("level"), (F.col("confidence") >= GATE).alias("answered"))


def merged_evidence(kept: DataFrame, web: DataFrame, k: int = 10) -> DataFrame:
    """Rows of both by confidence, ranked anew."""
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("confidence"), "origin", "ref"))
    both = kept.select("item_id", F.lit("kept").alias("origin"), "ref", "confidence").unionByName(web.select("item_id", F.lit("web").alias("origin"), "ref", "confidence"))
    return both.withColumn("rank", place).where(F.col("rank") <= k)


def researched(gate: DataFrame, kept: DataFrame, web: DataFrame, approve: bool = False) -> DataFrame:
    """The loop in one plan: queries below the gate (item_id, confidence, level, answered) that have web evidence are answered from both kinds of evidence, others from what is kept. A row each: used_web, approved, sources and evidence in order."""
    asked = web.join(gate.where("NOT answered").select("item_id"), "item_id", "left_semi")
    rows = merged_evidence(kept, asked).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", "origin", "ref"))).alias("evidence"))
    used = asked.groupBy("item_id").agg(F.count("*").alias("sources"))
    out = gate.join(rows, "item_id", "left").join(used, "item_id", "left").withColumn("sources", F.coalesce("sources", F.lit(0)))
    return out.select("item_id", "confidence", "level", (F.col("sources") > 0).alias("used_web"), ((F.col("sources") > 0) & F.lit(approve)).alias("approved"), "sources", F.transform("evidence", lambda x: F.concat_ws(":", x["origin"], x["ref"])).alias("evidence"))


def session_statistics(sessions: DataFrame) -> DataFrame:
    """One row: sessions, those that went to the web, those approved and rejected, and what was taken in (ingested: an array)."""
    n = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("bigint"))
    out = sessions.agg(F.count("*").alias("sessions"), n("used_web").alias("web_triggered"), n("approved").alias("approved"), F.sum(F.coalesce(F.size("ingested"), F.lit(0))).alias("resources_ingested"))
    return out.select("sessions", "web_triggered", "approved", (F.col("web_triggered") - F.col("approved")).alias("rejected"), "resources_ingested")
