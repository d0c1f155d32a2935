"""Queries on what learners should do next, how far they are, and how adaptive choices learn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import constants as c
from tessera.functions import text as tx
from tessera.operators import concepts as cp
from tessera.operators import graph_retrieval as gr
from tessera.operators import learner as ln
from tessera.operators import planning as pl
from tessera.operators import policy as po
from tessera.plans.analytics import LOG, MASTERY
from tessera.plans.concepts import _ABOUT, EDGES, MENTIONS, graph_edges, lexicon, masteries, resources
from tessera.plans.registry import query
from tessera.session import table
from tessera.storage import stored

KIND = "CASE event_type WHEN 'view' THEN 'reading' WHEN 'click' THEN 'video' WHEN 'purchase' THEN 'quiz' WHEN 'signup' THEN 'lesson' ELSE 'interaction' END"
ACTIVITY = f"activity AS (SELECT user_id AS student, {KIND} AS kind, event_id % 60 AS ref FROM events)"
ABOUT_MASTERY = f"{MASTERY}, known AS (SELECT student, {_ABOUT.replace('event_type', 'concept')} AS concept, mastery, events, assessments FROM mastery)"


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as what was done (kind) with what (ref)."""
    kind = F.when(F.col("event_type") == "view", "reading").when(F.col("event_type") == "click", "video").when(F.col("event_type") == "purchase", "quiz").when(F.col("event_type") == "signup", "lesson").otherwise("interaction")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("student"), kind.alias("kind"), (F.col("event_id") % 60).alias("ref"), ln.minutes(kind).alias("minutes"))


@query(f"""WITH {MASTERY}, {ACTIVITY}, seen AS (SELECT student, count(DISTINCT concept) AS concepts_seen FROM mastery GROUP BY 1), done AS (SELECT student, count(DISTINCT ref) AS resources_completed FROM activity WHERE kind IN ('lesson', 'video', 'reading') GROUP BY 1)
SELECT student, concepts_seen, CAST(8 AS INTEGER) AS concepts_total, round(concepts_seen / 8, 4) AS concept_coverage, coalesce(resources_completed, 0) AS resources_completed FROM seen LEFT JOIN done USING (student)""")
def completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.completion(ln.mastery(ln.learner_events(table(spark, sf_dir, "events"))), activity(spark, sf_dir), 8)


@query(f"""WITH {ACTIVITY}, r AS (SELECT doc_id AS ref, source AS course FROM documents), n AS (SELECT course, count(*) AS available FROM r GROUP BY 1), d AS (SELECT student, course, count(*) AS completed FROM (SELECT DISTINCT student, ref FROM activity WHERE kind IN ('lesson', 'video', 'reading')) JOIN r USING (ref) GROUP BY ALL)
SELECT student, course, completed, available, round(completed / available, 3) AS rate FROM d JOIN n USING (course)""")
def course_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each source's documents a student has been through."""
    return pl.course_completion(activity(spark, sf_dir), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ref"), F.col("source").alias("course")))


GOALS = """goals AS (SELECT DISTINCT user_id AS student, CASE WHEN user_id % 4 = 0 THEN ['concept:tion', 'concept:none'] END AS concepts, CASE WHEN user_id % 4 = 1 THEN 'en' END AS course FROM events)"""
TARGETS = f"""{EDGES}, {ABOUT_MASTERY}, {GOALS}, found AS (SELECT concept_id AS concept, frequency FROM found_concepts),
courses AS (SELECT concept, course FROM (SELECT concept, res.course, row_number() OVER (PARTITION BY concept ORDER BY resource) AS n FROM (SELECT DISTINCT concept, resource FROM provenance) JOIN res ON CAST(resource_id AS VARCHAR) = resource) WHERE n = 1),
named AS (SELECT student, concept, 'named' AS chosen_by FROM (SELECT student, unnest(concepts) AS concept FROM goals) WHERE concept IN (SELECT concept FROM found)),
by_course AS (SELECT student, concept, 'course' AS chosen_by FROM goals JOIN courses USING (course) WHERE concepts IS NULL),
weak AS (SELECT student, concept, 'weak' AS chosen_by FROM known WHERE mastery < 0.4 AND student IN (SELECT student FROM goals WHERE concepts IS NULL AND course IS NULL) AND concept IN (SELECT concept FROM found)),
cold AS (SELECT student, concept, 'frequent' AS chosen_by FROM goals, (SELECT concept FROM found ORDER BY frequency DESC, concept LIMIT 12) WHERE concepts IS NULL AND course IS NULL AND student NOT IN (SELECT student FROM weak)),
targets AS (SELECT * FROM named UNION ALL SELECT * FROM by_course UNION ALL SELECT * FROM weak UNION ALL SELECT * FROM cold)"""


def _targets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Targets, masteries and provenance."""
    res, lex = resources(spark, sf_dir), lexicon(spark)
    provenance = gr.provenance_of(graph_edges(spark, sf_dir))
    found = cp.lexicon_concepts(cp.mentions(res, lex, "resource_id"), lex, "resource_id").select(F.col("concept_id").alias("concept"), "frequency")
    student = F.col("student")
    goals = table(spark, sf_dir, "events").select(F.col("user_id").alias("student")).distinct().select("student", F.when(student % 4 == 0, F.array(F.lit("concept:tion"), F.lit("concept:none"))).alias("concepts"), F.when(student % 4 == 1, "en").alias("course"))
    known = stored(masteries(spark, sf_dir))
    return stored(pl.plan_targets(goals, known, stored(found), pl.first_courses(provenance, res))), known, provenance


@query(f"WITH {TARGETS} SELECT * FROM targets")
def plan_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each student's plan is about: named concepts, a course's, weak ones, or the most frequent."""
    return _targets(spark, sf_dir)[0]


@query(f"""WITH {TARGETS}, weeks AS (SELECT concept, min(CAST(res.module[2:] AS INTEGER)) AS week FROM (SELECT DISTINCT concept, resource FROM provenance) JOIN res ON CAST(resource_id AS VARCHAR) = resource GROUP BY 1)
SELECT student, concept, round(mastery, 6) AS mastery, week, CAST(row_number() OVER (PARTITION BY student ORDER BY week, mastery, concept) AS INTEGER) AS place FROM (SELECT t.student, t.concept, coalesce(k.mastery, 0.3) AS mastery, coalesce(w.week, 99) AS week FROM targets t LEFT JOIN known k ON k.student = t.student AND k.concept = t.concept LEFT JOIN weeks w ON w.concept = t.concept)""")
def plan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan's concepts by week and weakness."""
    targets, known, provenance = _targets(spark, sf_dir)
    return pl.ordered_targets(targets, known, pl.first_weeks(provenance, resources(spark, sf_dir))).withColumn("mastery", F.round("mastery", 6))


DOC_TYPE = "CASE resource_id % 4 WHEN 0 THEN 'video' WHEN 1 THEN 'textbook' WHEN 2 THEN 'notebook' ELSE 'page' END"


@query(f"""WITH {EDGES}, r AS (SELECT concept, resource, title, CASE {DOC_TYPE} WHEN 'video' THEN 'watch' WHEN 'notebook' THEN 'practice' ELSE 'read' END AS bucket FROM (SELECT DISTINCT concept, resource FROM provenance) JOIN res ON CAST(resource_id AS VARCHAR) = resource)
SELECT * FROM (SELECT concept, bucket, CAST(row_number() OVER (PARTITION BY concept, bucket ORDER BY resource) AS INTEGER) AS place, resource, title FROM r) WHERE place <= 3""")
def concept_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to read, watch and practise for each concept."""
    i = F.col("resource_id") % 4
    docs = resources(spark, sf_dir).withColumn("doc_type", F.when(i == 0, "video").when(i == 1, "textbook").when(i == 2, "notebook").otherwise("page"))
    return pl.concept_resources(gr.provenance_of(graph_edges(spark, sf_dir)), docs)


_QUIZ_STOP = "(" + ", ".join(f"'{w}'" for w in tx.QUIZ_STOP) + ")"
_TERMS = lambda t: rf"list_distinct(list_filter(regexp_extract_all(lower(coalesce({t}, '')), '[a-z][a-z\-]+'), lambda w: length(w) > 2 AND w NOT IN {_QUIZ_STOP}))"
QUIZ = rf"""s0 AS (SELECT doc_id, source AS concept, doc_id % 3 AS level, text, string_split(regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents),
s1 AS (SELECT doc_id, concept, level, text, list_filter(list_transform(s, lambda x: trim(x)), lambda x: len(regexp_extract_all(x, '\S+')) >= 6) AS s FROM s0),
s2 AS (SELECT doc_id, unnest(s) AS x, unnest(range(len(s))) AS i, concept FROM s1),
s3 AS (SELECT doc_id, arg_max(x, len(list_intersect({_TERMS("x")}, {_TERMS("concept")})) * 1000000 - i) AS best FROM s2 GROUP BY 1),
quiz AS (SELECT doc_id, concept, CASE level WHEN 0 THEN 'Define' WHEN 1 THEN 'Explain' ELSE 'Critically analyse' END || ' the concept of ''' || concept || '''.' AS question, coalesce(left(best, 280), left(trim(text, ' ' || chr(9) || chr(10) || chr(13)), 240)) AS answer_key FROM s1 LEFT JOIN s3 USING (doc_id)),
k0 AS (SELECT doc_id, unnest(list_distinct(list_concat({_TERMS("concept")}, {_TERMS("answer_key")}))) AS t, {_TERMS("concept")} AS own FROM quiz),
k1 AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY NOT list_contains(own, t), -length(t), t) AS n FROM k0),
keys AS (SELECT doc_id, string_agg(t, ',' ORDER BY n) AS key_terms FROM k1 WHERE n <= 8 GROUP BY 1)"""


def _quizzes(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.col("doc_id") % 3
    return pl.quizzes(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("concept"), "text", F.when(level == 0, "easy").when(level == 1, "medium").otherwise("very-hard").alias("difficulty")))


@query(f"WITH {QUIZ} SELECT doc_id, question, answer_key, coalesce(key_terms, '') AS key_terms FROM quiz LEFT JOIN keys USING (doc_id)")
def quizzes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question, its answer and key terms from each document."""
    return _quizzes(spark, sf_dir).select("doc_id", "question", "answer_key", F.array_join("key_terms", ",").alias("key_terms"))


@query(f"""WITH {QUIZ}, g AS (SELECT q.doc_id, list_sort(list_intersect(string_split(key_terms, ','), {_TERMS("d.text")})) AS covered, string_split(key_terms, ',') AS k FROM quiz q JOIN keys USING (doc_id) JOIN documents d ON d.doc_id = q.doc_id + 1)
SELECT doc_id, round(len(covered) / len(k), 3) AS score, round(len(covered) / len(k), 3) >= 0.4 AS correct, array_to_string(covered, ',') AS covered FROM g""")
def graded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's quiz answered by the next document."""
    answers = table(spark, sf_dir, "documents").select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("answer"))
    done = pl.graded(_quizzes(spark, sf_dir).where(F.size("key_terms") > 0).join(answers, "doc_id"))
    return done.select("doc_id", "score", "correct", F.array_join("covered", ",").alias("covered"))


@query(f"WITH {ABOUT_MASTERY} SELECT student, concept, round(mastery, 6) AS mastery FROM (SELECT *, row_number() OVER (PARTITION BY student ORDER BY mastery, concept) AS n FROM known WHERE mastery < 0.4) WHERE n = 1")
def next_concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return po.next_concepts(masteries(spark, sf_dir)).withColumn("mastery", F.round("mastery", 6))


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored events as outcomes of a choice of difficulty."""
    log = ln.learner_events(table(spark, sf_dir, "events")).where("score IS NOT NULL")
    arm = F.least(F.lit(4), F.floor(F.col("difficulty") * 5)).cast("int")
    x = F.array(F.col("difficulty"), F.col("score"), F.lit(0.5), F.lit(1.0))
    return log.select("student", F.lit("difficulty").alias("decision"), arm.alias("arm"), x.alias("x"), ln.reward(F.col("score"), F.col("difficulty") - 0.5, F.lit(12.0), F.lit(0), F.lit(0)).alias("reward"))


STATE = f"""{LOG}, o AS (SELECT student, CAST(least(4, floor(difficulty * 5)) AS INTEGER) AS arm, difficulty AS x0, score AS x1, round(0.4::DOUBLE * score + 1.0::DOUBLE * (difficulty - 0.5) - 0.15::DOUBLE * least(1.0, 12.0::DOUBLE / 30), 5) AS reward FROM log WHERE score IS NOT NULL),
sums AS (SELECT student, arm, count(*) AS n, sum(x0 * x0) AS a, sum(x0 * x1) AS ab, sum(reward) AS b FROM o GROUP BY ALL), arms AS (SELECT student, 'difficulty' AS decision, arm FROM (SELECT DISTINCT user_id AS student FROM events), range(5) t(arm) UNION ALL SELECT student, 'explanation_style', arm FROM (SELECT DISTINCT user_id AS student FROM events), range(4) t(arm) UNION ALL SELECT student, 'question_type', arm FROM (SELECT DISTINCT user_id AS student FROM events), range(3) t(arm))"""


@query(f"WITH {STATE} SELECT student, decision, CAST(p.arm AS INTEGER) AS arm, coalesce(n, 0) AS n, round(1 + coalesce(a, 0), 6) AS a00, round(coalesce(ab, 0), 6) AS a01, round(coalesce(b, 0), 6) AS b3 FROM arms p LEFT JOIN (SELECT student, 'difficulty' AS decision, arm, n, a, ab, b FROM sums) s USING (student, decision, arm)")
def policy_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept state of each student's policies after the whole log."""
    states = po.learned_states(po.first_states(table(spark, sf_dir, "events").select(F.col("user_id").alias("student")).distinct()), _outcomes(spark, sf_dir))
    return states.select("student", "decision", "arm", "n", F.round(F.col("a")[0], 6).alias("a00"), F.round(F.col("a")[1], 6).alias("a01"), F.round(F.col("b")[3], 6).alias("b3"))


@query()
def adaptive_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the policies choose for each student and concept; the solving of small systems has no SQL."""
    events = ln.learner_events(table(spark, sf_dir, "events"))
    states = stored(po.learned_states(po.first_states(events.select("student").distinct()), _outcomes(spark, sf_dir)))
    asked = stored(po.contexts(events, ln.mastery(events)))
    return po.valued(states, asked).where("chosen").select("student", "concept", "decision", "label", "mean", "bonus", "bound")


@query(f"""WITH {MASTERY}, recent AS (SELECT student, concept, avg(score) AS accuracy, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY student, concept ORDER BY ts DESC, event_id DESC) AS k FROM log WHERE score IS NOT NULL) WHERE k <= 5 GROUP BY ALL)
SELECT student, concept, round(mastery, 6) AS mastery, round(coalesce(accuracy, 0.5), 6) AS accuracy, round(least(1.0, coalesce(n, 0) / 5), 6) AS exposure FROM mastery LEFT JOIN recent USING (student, concept)""")
def policy_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = ln.learner_events(table(spark, sf_dir, "events"))
    x = F.col("x")
    return po.contexts(events, ln.mastery(events)).select("student", "concept", F.round(x[0], 6).alias("mastery"), F.round(x[1], 6).alias("accuracy"), F.round(x[2], 6).alias("exposure"))


_GAIN = lambda a, d: f"exp(-pow(1 / (1 + exp(-(6.0::DOUBLE * ({a} - {d})))) - 0.6::DOUBLE, 2) / (2 * 0.0256::DOUBLE))"


@query(f"""WITH {MASTERY}, grid AS (SELECT student, concept, mastery AS ability FROM mastery), d AS (SELECT unnest([0.2, 0.35, 0.5, 0.65, 0.8])::DOUBLE AS d), best AS (SELECT ability, student, concept, max({_GAIN("ability", "d")}) AS best FROM grid, d GROUP BY ALL),
c AS (SELECT student, concept, ability, policy, CASE policy WHEN 'fixed-medium' THEN 0.5 WHEN 'always-hard' THEN 0.8 WHEN 'always-easy' THEN 0.2 END::DOUBLE AS d FROM grid, (VALUES ('fixed-medium'), ('always-hard'), ('always-easy'), ('oracle')) p(policy))
SELECT policy, round(avg(g), 4) AS mean_reward, round(avg(best - g), 4) AS regret FROM (SELECT policy, best, CASE WHEN policy = 'oracle' THEN best ELSE {_GAIN("c.ability", "c.d")} END AS g FROM c JOIN best USING (student, concept)) GROUP BY 1""")
def policy_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean reward and regret of fixed and best choices over all learners and concepts, each with its mastery as ability."""
    return po.policy_evaluation(ln.mastery(ln.learner_events(table(spark, sf_dir, "events"))).select(F.col("mastery").alias("ability")))


@query(f"""WITH {MASTERY}, {ACTIVITY.replace("event_id % 60 AS ref", "event_id % 60 AS ref, CASE event_type WHEN 'view' THEN 8 WHEN 'click' THEN 10 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 15 ELSE 2 END AS minutes")},
m AS (SELECT student, round(avg(mastery), 6) AS mean_mastery, CAST(sum(CASE WHEN mastery < 0.4 THEN 1 ELSE 0 END) AS BIGINT) AS weak, CAST(sum(CASE WHEN mastery >= 0.7 THEN 1 ELSE 0 END) AS BIGINT) AS strong, CAST(sum(events) AS BIGINT) AS events, count(DISTINCT concept) AS concepts_seen FROM mastery GROUP BY 1),
a AS (SELECT student, count(DISTINCT ref) FILTER (kind IN ('lesson', 'video', 'reading')) AS resources_completed, CAST(sum(minutes) AS BIGINT) AS minutes FROM activity GROUP BY 1)
SELECT student, mean_mastery, weak, strong, events, concepts_seen, CAST(8 AS INTEGER) AS concepts_total, round(concepts_seen / 8, 4) AS concept_coverage, resources_completed, minutes, weak AS recommendations FROM m JOIN a USING (student)""")
def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of a student's figures in one row. Without related concepts only weak ones are recommended."""
    known = stored(ln.mastery(ln.learner_events(table(spark, sf_dir, "events"))))
    none = spark.createDataFrame([], "src string, dst string")
    return pl.dashboard(known, stored(activity(spark, sf_dir)), ln.recommendations(known, none), 8)


@query(f"WITH {MENTIONS} SELECT concept_id, n_resources, frequency FROM found_concepts WHERE n_resources >= 3 ORDER BY frequency DESC, concept_id LIMIT 12")
def well_covered_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cp.mentions(resources(spark, sf_dir), lexicon(spark), "resource_id")
    return cp.well_covered(cp.lexicon_concepts(found, lexicon(spark), "resource_id")).select("concept_id", "n_resources", "frequency")


@query(f"WITH {MASTERY} SELECT student, concept, CASE WHEN mastery < 0.4 THEN 'red' WHEN mastery < 0.7 THEN 'amber' ELSE 'green' END AS band FROM mastery")
def mastery_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = ln.mastery(ln.learner_events(table(spark, sf_dir, "events")))
    return known.select("student", "concept", tx.color_band(F.col("mastery"), c.WEAK, c.STRONG).alias("band"))
