"""What a learner should do next, and how far they are: targets, order, resources by kind, completion, quizzes and dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import constants as c
from tessera.functions.text import key_terms, terms
from tessera.operators.evidence import overlap, plain_sentences

# What a kind of document is for, the kinds of events that complete a resource, how a quiz asks, and what a concept without a week counts as.
WATCHED, PRACTISED = ["video"], ["assessment", "worksheet", "notebook"]
COMPLETING = ["lesson", "video", "reading"]
STEMS = {"very-easy": "Define", "easy": "Define", "medium": "Explain", "hard": "Explain in detail and give an example of", "very-hard": "Critically analyse"}
NO_WEEK, FIRST_TARGETS, PASSED = 99, 12, 0.4


def bucket(doc_type: Column) -> Column:
    """Whether a document is read, watched or practised."""
    kind = F.lower(F.coalesce(doc_type, F.lit("")))
    return F.when(kind.isin(WATCHED), "watch").when(kind.isin(PRACTISED), "practice").otherwise("read")


def first_weeks(provenance: DataFrame, resources: DataFrame) -> DataFrame:
    """concept and week: the least number in the modules of the concept's resources, NO_WEEK without any."""
    number = F.nullif(F.regexp_extract("module", r"(\d+)", 1), F.lit("")).cast("int")
    rows = provenance.select("concept", "resource").distinct().join(resources.select(F.col("resource_id").cast("string").alias("resource"), number.alias("n")), "resource", "left")
    return rows.groupBy("concept").agg(F.coalesce(F.min("n"), F.lit(NO_WEEK)).alias("week"))


def first_courses(provenance: DataFrame, resources: DataFrame) -> DataFrame:
    """concept and course: that of the concept's first resource which has one."""
    rows = provenance.select("concept", "resource").distinct().join(resources.select(F.col("resource_id").cast("string").alias("resource"), "course"), "resource").where(F.coalesce("course", F.lit("")) != "")
    return rows.groupBy("concept").agg(F.min_by("course", "resource").alias("course"))


def concept_resources(provenance: DataFrame, resources: DataFrame, k: int = 3) -> DataFrame:
    """concept, bucket, place, resource and title: the first k resources of each concept and use."""
    rows = provenance.select("concept", "resource").distinct().join(resources.select(F.col("resource_id").cast("string").alias("resource"), "title", bucket(F.col("doc_type")).alias("bucket")), "resource")
    place = F.row_number().over(Window.partitionBy("concept", "bucket").orderBy("resource"))
    return rows.withColumn("place", place).where(F.col("place") <= k).select("concept", "bucket", "place", "resource", "title")


def plan_targets(goals: DataFrame, masteries: DataFrame, concepts: DataFrame, courses: DataFrame) -> DataFrame:
    """student, concept and chosen_by: the concepts that a goal (student, concepts: an array or null, course or null) names and that there are; else those of its course; else the student's weak ones; else the most frequent ones. concepts: concept, frequency; courses: concept, course."""
    known = concepts.select("concept")
    named = goals.where(F.size(F.coalesce("concepts", F.array().cast("array<string>"))) > 0).select("student", F.explode("concepts").alias("concept")).join(known, "concept", "left_semi").select("student", "concept", F.lit("named").alias("chosen_by"))
    others = goals.where(F.size(F.coalesce("concepts", F.array().cast("array<string>"))) == 0)
    by_course = others.where("course IS NOT NULL").join(courses, "course").select("student", "concept", F.lit("course").alias("chosen_by"))
    rest = others.where("course IS NULL").select("student")
    weak = masteries.where(F.col("mastery") < c.WEAK).join(rest, "student", "left_semi").join(known, "concept", "left_semi").select("student", "concept", F.lit("weak").alias("chosen_by"))
    top = concepts.orderBy(F.desc("frequency"), "concept").limit(FIRST_TARGETS).agg(F.collect_list("concept").alias("top"))  # FIRST_TARGETS names
    cold = rest.join(weak.select("student").distinct(), "student", "left_anti").join(F.broadcast(top), F.lit(True)).select("student", F.explode("top").alias("concept"), F.lit("frequent").alias("chosen_by"))
    return named.union(by_course).union(weak).union(cold)


def ordered_targets(targets: DataFrame, masteries: DataFrame, weeks: DataFrame) -> DataFrame:
    """student, concept, mastery, week and place: earlier weeks first, then the weaker concepts."""
    rows = targets.join(masteries.select("student", "concept", "mastery"), ["student", "concept"], "left").join(weeks, "concept", "left")
    rows = rows.withColumns({"mastery": F.coalesce("mastery", F.lit(c.MASTERY_START)), "week": F.coalesce("week", F.lit(NO_WEEK))})
    place = F.row_number().over(Window.partitionBy("student").orderBy("week", "mastery", "concept"))
    return rows.withColumn("place", place).select("student", "concept", "mastery", "week", "place")


def completion(masteries: DataFrame, events: DataFrame, concepts_total: int) -> DataFrame:
    """Of each student: concepts seen, their share of all, and distinct resources completed. events: student, kind, ref."""
    seen = masteries.groupBy("student").agg(F.countDistinct("concept").alias("concepts_seen"))
    done = events.where(F.col("kind").isin(COMPLETING) & (F.coalesce(F.col("ref").cast("string"), F.lit("")) != "")).groupBy("student").agg(F.countDistinct("ref").alias("resources_completed"))
    share = F.round(F.col("concepts_seen") / concepts_total, 4) if concepts_total else F.lit(0.0)
    return seen.join(done, "student", "left").select("student", "concepts_seen", F.lit(concepts_total).alias("concepts_total"), share.alias("concept_coverage"), F.coalesce("resources_completed", F.lit(0)).alias("resources_completed"))


def course_completion(events: DataFrame, resources: DataFrame) -> DataFrame:
    """student, course, completed, available and rate of each course with a completed resource. resources: ref, course."""
    available = resources.groupBy("course").agg(F.count("*").alias("available"))
    refs = events.where(F.col("kind").isin(COMPLETING)).select("student", "ref").distinct()
    done = refs.join(resources.select("ref", "course"), "ref").groupBy("student", "course").agg(F.count("*").alias("completed"))
    return done.join(available, "course").select("student", "course", "completed", "available", F.round(F.col("completed") / F.col("available"), 3).alias("rate"))


def labelled(masteries: DataFrame, concepts: DataFrame) -> DataFrame:
    """Masteries with the concept's label and domain; without them the concept itself and general."""
    out = masteries.join(concepts.select("concept", "label", "domain"), "concept", "left")
    return out.withColumns({"label": F.coalesce("label", "concept"), "domain": F.coalesce("domain", F.lit("general"))})


def quizzes(asked: DataFrame) -> DataFrame:
    """question, answer_key and key_terms for rows (concept, text, difficulty): the sentence of six words and more with most of the concept's terms, the first on a tie, is the answer; without one the text's beginning."""
    stem = F.lit("Explain")
    for name, verb in STEMS.items():
        stem = F.when(F.col("difficulty") == name, verb).otherwise(stem)
    found = F.transform(plain_sentences(F.col("text"), 6), lambda s, i: F.struct(overlap(terms(s), terms(F.col("concept"))).alias("o"), (-i).alias("i"), s.alias("s")))
    best = F.left(F.array_max("found")["s"], F.lit(280))
    rows = asked.withColumn("found", found).withColumn("answer_key", F.when(F.size("found") == 0, F.left(F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\r")), F.lit(240))).otherwise(best)).drop("found")
    return rows.withColumns({"question": F.concat(stem, F.lit(" the concept of '"), "concept", F.lit("'.")), "key_terms": key_terms(F.col("answer_key"), F.col("concept"))})


def graded(answers: DataFrame) -> DataFrame:
    """score, correct, covered and missing of answers (answer, key_terms): which key terms they have."""
    said = terms(F.col("answer"))
    out = answers.withColumns({"covered": F.array_sort(F.array_intersect("key_terms", said)), "missing": F.array_sort(F.array_except("key_terms", said))})
    score = F.when(F.size("key_terms") > 0, F.round(F.size("covered") / F.size("key_terms"), 3)).otherwise(0.0)
    return out.withColumn("score", score).withColumn("correct", (F.size("key_terms") > 0) & (F.col("score") >= PASSED))


def study_session(asked: DataFrame, answers: DataFrame, masteries: DataFrame) -> DataFrame:
    """A session in one plan, a row for each (student, concept): the quiz on a text (asked: student, concept, text, difficulty), the grade of the answer (answers: student, concept, answer), the mastery before and after it."""
    from tessera.operators.learner import updated

    done = graded(quizzes(asked).join(answers, ["student", "concept"])).join(masteries.select("student", "concept", "mastery"), ["student", "concept"], "left")
    before = F.coalesce("mastery", F.lit(c.MASTERY_START))
    after = updated(before, F.col("correct").cast("double"), F.lit(0.5))
    return done.select("student", "concept", "question", "score", "correct", F.round(before, 6).alias("mastery_before"), F.round(after, 6).alias("mastery_after"))


def dashboard(masteries: DataFrame, events: DataFrame, recommendations: DataFrame, concepts_total: int) -> DataFrame:
    """A row for each student with all that a dashboard shows: mean mastery, weak and strong concepts, completion, minutes, recommendations. events: student, kind, ref, minutes."""
    level = lambda x: F.sum(x.cast("bigint"))
    summary = masteries.groupBy("student").agg(F.round(F.avg("mastery"), 6).alias("mean_mastery"), level(F.col("mastery") < c.WEAK).alias("weak"), level(F.col("mastery") >= c.STRONG).alias("strong"), F.sum("events").alias("events"))
    spent = events.groupBy("student").agg(F.sum("minutes").cast("bigint").alias("minutes"))
    advised = recommendations.groupBy("student").agg(F.count("*").alias("recommendations"))
    out = summary.join(completion(masteries, events, concepts_total), "student").join(spent, "student", "left").join(advised, "student", "left")
    return out.fillna(0, ["minutes", "recommendations"])
