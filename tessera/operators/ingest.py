"""Resources on their way in: import plans, academic structure, coverage, chunk types and places, stages that fail by row, packages, and what changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import first_number, study_minutes, word_count

# Patterns of numbers, and words that mark a kind of block.
WEEKS = [r"(?i)week\s*0*(\d+)"]
LECTURES = [r"(?i)lecture\s*0*(\d+)", r"(?i)lesson\s*0*(\d+)", r"(?i)session\s*0*(\d+)"]
CUES = {"examples": ["example"], "exercises": ["exercise", "practice"], "assignments": ["assignment", "homework", "project"], "labs": ["lab", "workshop"], "references": ["reference", "bibliography"]}
WRAPPER = r"-\d{8}T\d{6}Z-\d+-\d+$"
IMAGE_KINDS = [("diagram", ["diagram", "flow", "architecture"]), ("chart", ["chart", "plot", "graph"]), ("screenshot", ["screen", "capture"])]
LABEL, TOPICS, SUBTOPICS = 80, 20, 40


def located(files: DataFrame, courses: list[tuple[str, str, str]], root: str) -> DataFrame:
    """Files (path) with track, course and module by their folders: an archive's wrapper folder is dropped, the first of the courses (needle, track, course) whose needle is in the folder's name gives the course, weeks and sessions the module."""
    relative = F.regexp_replace(F.substring_index("path", root.rstrip("/") + "/", -1), "^/+", "")
    parts = F.split(relative, "/")
    parts = F.when(F.get(parts, F.lit(0)).rlike(WRAPPER), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    out = files.withColumn("parts", parts).withColumn("folder", F.when(F.size("parts") > 0, F.get("parts", F.lit(0))).otherwise("misc"))
    slug = lambda x: F.left(F.btrim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), F.lit("-")), F.lit(24))
    track, course = F.lit("technical"), F.coalesce(F.nullif(slug(F.col("folder")), F.lit("")), F.lit("misc"))
    for needle, in_track, name in reversed(courses):
        hit = F.lower("folder").contains(needle)
        track, course = F.when(hit, in_track).otherwise(track), F.when(hit, name).otherwise(course)
    between = F.array_join(F.slice("parts", 2, F.greatest(F.size("parts") - 2, F.lit(0))), " / ")
    week, session = F.regexp_extract(between, r"(?i)week\s*0*(\d+)", 1), F.regexp_extract(between, r"(?i)session\s*0*(\d+)", 1)
    numbered = F.concat(F.lit("w"), F.lpad(week, 2, "0"))
    module = F.when((week != "") & (session != ""), F.concat(numbered, F.lit("-s"), session)).when(week != "", numbered).when(between != "", F.coalesce(F.nullif(slug(between), F.lit("")), F.lit("general"))).otherwise("general")
    return out.withColumns({"track": track, "course": course, "module": module}).drop("parts", "folder")


def copied(plan: DataFrame, contents: DataFrame, path: str) -> DataFrame:
    """Carry out an import plan (path, disposition, course): the contents (path, content) of what is to be copied are written by course; returns how many of each course and disposition."""
    taken = plan.where(F.col("disposition").isin("COPY", "COPY_DATASET")).join(contents, "path")
    taken.write.mode("overwrite").partitionBy("course").parquet(path)
    return plan.groupBy("disposition", "course").agg(F.count("*").alias("files"))


def image_kind(stem: Column) -> Column:
    """By the first hint in a file's name."""
    out = F.lit("figure")
    for kind, hints in reversed(IMAGE_KINDS):
        out = F.when(F.lower(stem).rlike("|".join(hints)), kind).otherwise(out)
    return out


def academic_structure(blocks: DataFrame, titles: DataFrame, key: str) -> DataFrame:
    """Of each resource: week and lecture (the first number in the title, then in the blocks in order), topics (headings of level 1 and 2) and subtopics, and the labels of blocks with each kind of cue; each label once, in order. blocks: key, n, kind, text, level; titles: key, title."""
    rows = blocks.select(key, "n", "kind", F.trim("text").alias("text"), F.when(F.col("level") > 0, F.col("level")).otherwise(1).alias("level")).unionByName(titles.select(key, F.lit(-1).alias("n"), F.lit("title").alias("kind"), F.col("title").alias("text"), F.lit(0).alias("level")))
    number = lambda patterns: F.min_by(first_number(F.col("text"), patterns), F.when(first_number(F.col("text"), patterns).isNotNull(), F.col("n")))
    heading = F.col("kind") == "heading"
    cued = lambda words: (F.col("kind") != "title") & F.lower("text").rlike("|".join(words))
    lists = {"topics": (heading & (F.col("level") <= 2), F.col("text")), "subtopics": (heading & (F.col("level") > 2), F.col("text")), **{name: (cued(words), F.left("text", F.lit(LABEL))) for name, words in CUES.items()}}
    ordered = lambda when, text: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("n", text.alias("t"))))), lambda x: x["t"]))
    return rows.groupBy(key).agg(number(WEEKS).alias("week"), number(LECTURES).cast("string").alias("lecture"), *(ordered(*v).alias(k) for k, v in lists.items()))


def filled_in(resources: DataFrame, structure: DataFrame, key: str) -> DataFrame:
    """Resources with week, lecture, topics and subtopics from the structure where they have none."""
    some = lambda c: F.when(F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) > 0, F.col(c))
    found = structure.select(key, *(F.col(c).alias(f"__{c}") for c in ("week", "lecture", "topics", "subtopics")))
    out = resources.join(found, key, "left")
    new = {"week": F.coalesce("week", "__week"), "lecture": F.coalesce(F.nullif("lecture", F.lit("")), "__lecture"), "topics": F.coalesce(some("topics"), F.slice("__topics", 1, TOPICS)), "subtopics": F.coalesce(some("subtopics"), F.slice("__subtopics", 1, SUBTOPICS))}
    return out.withColumns(new).drop(*(f"__{c}" for c in ("week", "lecture", "topics", "subtopics")))


def block_statistics(blocks: DataFrame, key: str) -> DataFrame:
    """Of each resource: blocks, headings, characters, words, reading minutes, and blocks by kind."""
    kinds = blocks.groupBy(key, "kind").agg(F.count("*").alias("n")).groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "kind", "n"))), ",").alias("by_kind"))
    out = blocks.groupBy(key).agg(F.count("*").alias("blocks"), F.sum((F.col("kind") == "heading").cast("bigint")).alias("headings"), F.sum(F.length("text")).alias("characters"), F.sum(word_count(F.col("text"))).alias("words"))
    return out.withColumn("minutes", study_minutes(F.col("words"))).join(kinds, key)


def of_kind(blocks: DataFrame, kind: str) -> DataFrame:
    return blocks.where(F.col("kind") == kind)


def coverage(blocks: DataFrame, key: str, resources: DataFrame | None = None) -> DataFrame:
    """Which kinds of elements and places each resource has (blocks with page, slide and start where there are such columns); with resources (key, extraction_method, language, week, topics) also whether these are known of it, and a row for those without blocks."""
    has = lambda x: F.max(F.coalesce(x, F.lit(False)))
    kinds = {"headings": "heading", "paragraphs": "paragraph", "lists": "list_item", "tables": "table", "code": "code", "captions": "caption", "equations": "equation"}
    places = {"pages": "page", "slides": "slide", "timestamps": "start"}
    flags = {**{name: has(F.col("kind") == k) for name, k in kinds.items()}, "sections": has(F.size("section") > 0), "figures": has(F.size("images") > 0), "hyperlinks": has(F.size("links") > 0), **{name: has(F.col(c).isNotNull()) if c in blocks.columns else F.lit(False) for name, c in places.items()}, "hierarchy": F.count("*") > 0}
    found = blocks.groupBy(key).agg(*(v.alias(k) for k, v in flags.items()), (F.count("*") > 0).alias("anchors"))
    if resources is None:
        return found.drop("anchors")
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    known = resources.select(key, filled("extraction_method").alias("provenance"), (filled("language")).alias("language"), (F.col("week").isNotNull() | (F.size(F.coalesce("topics", F.array().cast("array<string>"))) > 0)).alias("academic"))
    return known.join(found, key, "left").fillna(False)


def parent_keys(slide: Column, cell: Column, start: Column, section: Column, seconds: int = 180) -> Column:
    """What blocks of one parent share: the slide, the cell, the window of time, or the section."""
    return F.when(slide.isNotNull(), F.concat(F.lit("slide:"), slide)).when(cell.isNotNull(), F.concat(F.lit("cell:"), cell)).when(start.isNotNull(), F.concat(F.lit("time:"), F.floor(start / seconds))).otherwise(F.concat(F.lit("section:"), F.array_join(section, "/")))


def parent_facts(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Of each group of blocks (n, kind, text, section, language, page, slide, cell, start): chunk type, language (the commonest), heading, first and last page, first slide, earliest time, and its blocks in order."""
    body = F.col("kind") != "heading"
    facts = blocks.groupBy(*keys).agg(
        F.count(F.when(body, 1)).alias("bodies"), F.collect_set(F.when(body, F.col("kind"))).alias("kinds"), F.max(~body).alias("headed"), F.max(F.col("slide").isNotNull()).alias("on_slide"), F.max(F.col("cell").isNotNull()).alias("in_cell"), F.max(F.col("start").isNotNull()).alias("timed"),
        F.min("page").alias("page"), F.max("page").alias("page_end"), F.min_by("slide", F.when(F.col("slide").isNotNull(), F.col("n"))).alias("slide"), F.min("start").alias("timestamp"), F.min_by("section", "n").alias("section"), F.array_sort(F.collect_list("n")).alias("block_ids"),
    )
    spoken = blocks.where(F.coalesce("language", F.lit("")) != "").groupBy(*keys, "language").agg(F.count("*").alias("c")).groupBy(*keys).agg(F.max_by("language", F.struct("c", "language")).alias("language"))
    one = F.size("kinds") == 1
    kind = (
        F.when(F.col("on_slide"), "slide").when(F.col("in_cell"), "notebook_cell").when(F.col("timed"), "transcript").when(one & (F.col("bodies") == 1), F.col("kinds")[0])
        .when(F.col("headed"), "section").when(one, F.col("kinds")[0]).otherwise("mixed")
    )
    out = facts.join(spoken, keys, "left").withColumn("chunk_type", kind).withColumn("heading", F.try_element_at("section", F.lit(-1)))
    return out.select(*keys, "chunk_type", F.coalesce("language", F.lit("en")).alias("language"), "heading", "page", "page_end", "slide", "timestamp", "block_ids")


def enriched(chunks: DataFrame, resources: DataFrame, key: str, columns: tuple[str, ...] = ("topics", "keywords", "prerequisites", "concepts", "objectives")) -> DataFrame:
    """Chunks with what is known of their resource."""
    return chunks.join(resources.select(key, *columns), key, "left")


def payload(chunks: DataFrame) -> DataFrame:
    """Chunks with track, course and module from their resource's id."""
    part = lambda k: F.get(F.split("resource_id", r"\."), F.lit(k))
    return chunks.withColumns({"track": part(0), "course": part(1), "module": part(2)})


def staged(rows: DataFrame, stages: list[tuple[str, Callable[[Column], Column], bool]], value: str) -> DataFrame:
    """Run stages (name, function of a column, critical) over a column, one after the other. A stage that gives null has failed for that row: it keeps the value it had; after a critical failure the later stages leave the row alone. Adds status (SUCCESS, PARTIAL, FAILED) and failed (names of failed stages). No row fails another."""
    out, stopped = rows.withColumn("failed", F.array().cast("array<string>")), F.lit(False)
    for name, stage, critical in stages:
        made = F.when(~F.col("__stopped"), stage(F.col(value)))
        out = out.withColumn("__stopped", stopped).withColumn("__made", made).withColumn("__fails", ~F.col("__stopped") & F.col("__made").isNull())
        out = out.withColumns({"failed": F.when(F.col("__fails"), F.array_append("failed", F.lit(name))).otherwise(F.col("failed")), value: F.coalesce("__made", value), "__over": F.col("__stopped") | (F.col("__fails") & F.lit(critical))})
        stopped = F.col("__over")
    status = F.when(F.col("__over"), "FAILED").when(F.size("failed") > 0, "PARTIAL").otherwise("SUCCESS")
    return out.withColumn("status", status).drop("__stopped", "__made", "__fails", "__over")


def packages(resources: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """key and package: all of a resource as JSON, its clean text, structure and statistics."""
    text = blocks.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n\n").alias("clean_text"))
    whole = resources.join(text, key, "left").join(block_statistics(blocks, key), key, "left")
    return whole.select(key, F.to_json(F.struct(*whole.columns)).alias("package"))


def caption_files(media: DataFrame, files: DataFrame) -> DataFrame:
    """Of each media file (path) the caption file of the same name beside it: .vtt before .srt before .json."""
    stem = lambda c: F.regexp_replace(c, r"\.[^./]+$", "")
    order = F.when(F.lower("path").endswith(".vtt"), 0).when(F.lower("path").endswith(".srt"), 1).when(F.lower("path").endswith(".json"), 2)
    captions = files.select(stem("path").alias("stem"), F.col("path").alias("captions"), order.alias("o")).where("o IS NOT NULL").groupBy("stem").agg(F.min_by("captions", "o").alias("captions"))
    return media.withColumn("stem", stem("path")).join(captions, "stem", "left").drop("stem")


def slide_changes(frames: DataFrame, key: str, prefix: int = 40) -> DataFrame:
    """Frames (key, t, text) whose text does not begin like that of the frame before."""
    order = Window.partitionBy(key).orderBy("t")
    start = F.left(F.trim("text"), F.lit(prefix))
    return frames.where(F.trim("text") != "").withColumn("before", F.lag(start).over(order)).where(F.col("before").isNull() | (start != F.col("before"))).drop("before")


def sampled(chunks: DataFrame, n: int, each: int = 8, seed: int = 0, key: str = "resource_id", chunk: str = "chunk_id") -> DataFrame:
    """At most n chunks, at most so many of a resource, in an order that a seed gives."""
    draw = F.xxhash64(F.col(chunk).cast("string"), F.lit(seed))
    place = F.row_number().over(Window.partitionBy(key).orderBy(draw, chunk))
    return chunks.withColumn("n", place).where(F.col("n") <= each).drop("n").orderBy(draw, chunk).limit(n)


def known_items(chunks: DataFrame, n: int, span: int = 12, least: int = 25, seed: int = 0, chunk: str = "chunk_id") -> DataFrame:
    """A test set without labels: n chunks of at least so many words in an order that a seed gives, and as query the words from a third of each on."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    rows = chunks.withColumn("w", words).where(F.size("w") >= least)
    query = F.array_join(F.slice("w", F.floor(F.size("w") / 3).cast("int") + 1, span), " ")
    return rows.withColumn("query", query).drop("w").orderBy(F.xxhash64(F.col(chunk).cast("string"), F.lit(seed)), chunk).limit(n)
