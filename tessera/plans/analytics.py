"""Catalog and learner queries over the relational tables and the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import catalog as cat
from tessera.operators import chunking as ch
from tessera.operators import learner as ln
from tessera.plans.registry import query
from tessera.session import table
from tessera.streaming import learner as st


@query("""SELECT dimension, value, count(*) AS n FROM (
SELECT 'p_brand' AS dimension, coalesce(nullif(p_brand, ''), 'unknown') AS value FROM part UNION ALL SELECT 'p_type', coalesce(nullif(p_type, ''), 'unknown') FROM part UNION ALL SELECT 'p_size', coalesce(CAST(p_size AS VARCHAR), 'unknown') FROM part) GROUP BY ALL""")
def catalog_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.statistics(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"])


@query("SELECT p_brand, p_type, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total_size FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), ())")
def catalog_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupingSets([[F.col("p_brand")], [F.col("p_type")], []], "p_brand", "p_type").agg(F.count("*").alias("n"), F.sum("p_size").cast("bigint").alias("total_size"))


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_size = 10")
def catalog_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.filtered(table(spark, sf_dir, "part"), {"p_size", "p_brand", "p_type"}, p_size=10).select("p_partkey", "p_name", "p_brand")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a') OR contains(lower(p_type), 'a') ORDER BY p_partkey LIMIT 50")
def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.search(table(spark, sf_dir, "part"), "A", ["p_name", "p_type"], "p_partkey").select("p_partkey", "p_name")


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'NEW' WHEN b.doc_id IS NULL THEN 'MISSING' WHEN a.text <> b.text THEN 'MODIFIED' ELSE 'UNCHANGED' END AS status
FROM (SELECT doc_id, text FROM documents WHERE source <> 'src2') a FULL JOIN (SELECT doc_id, CASE WHEN lang = 'de' THEN text || '!' ELSE text END AS text FROM documents WHERE source <> 'src3') b ON a.doc_id = b.doc_id""")
def change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two states of the documents: a source is new, another missing, one language edited."""
    docs = table(spark, sf_dir, "documents")
    after = docs.where("source != 'src3'").select("doc_id", F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return cat.changes(docs.where("source != 'src2'"), after, "doc_id", "text")


@query("SELECT user_id, event_type, event_id, value, versions FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS nth, count(*) OVER (PARTITION BY user_id, event_type) AS versions FROM events) WHERE nth = 1")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return cat.latest(events, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value", "versions")


@query("""SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice > 0 THEN NULL ELSE 'price' END, CASE WHEN o_orderstatus IN ('F', 'O') THEN NULL ELSE 'open' END, CASE WHEN c_custkey IS NOT NULL THEN NULL ELSE 'customer' END) AS issues,
CASE WHEN NOT (o_totalprice > 0) OR c_custkey IS NULL THEN 'INVALID' WHEN o_orderstatus NOT IN ('F', 'O') THEN 'WARNING' ELSE 'VALID' END AS status FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def validation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    known = orders.join(table(spark, sf_dir, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left")
    rules = {"price": ("error", F.col("o_totalprice") > 0), "open": ("warning", F.col("o_orderstatus").isin("F", "O")), "customer": ("error", F.col("c_custkey").isNotNull())}
    return cat.validated(known, rules).select("o_orderkey", F.array_join("issues", ",").alias("issues"), "status")


@query("SELECT r_name, n_name, count(c_custkey) AS customers, round(coalesce(sum(c_acctbal), 0), 2) AS balance FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def tree_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.sum("c_acctbal").alias("balance"))
    return nations.join(customers, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("r_name", "n_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.round(F.coalesce("balance", F.lit(0.0)), 2).alias("balance"))


@query("SELECT c_mktsegment, count(*) AS customers, count(DISTINCT c_nationkey) AS nations FROM customer GROUP BY 1")
def content_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("customers"), F.countDistinct("c_nationkey").alias("nations"))


@query("SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY 1")
def user_role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.countDistinct("conv_id").alias("conversations"))


ROUTE_SQL = "CASE " + " ".join(f"WHEN {' OR '.join(f"contains(lower(coalesce(text, '')), '{w}')" for w in words)} THEN '{route}'" for route, words in cat.ROUTES) + " ELSE 'tutor' END"


@query(f"SELECT conv_id, turn, {ROUTE_SQL} AS route FROM conversations")
def intent_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", cat.routed(F.col("text")).alias("route"))


LOG = """log AS (SELECT event_id, ts, user_id AS student, event_type AS concept, CASE WHEN event_type = 'view' THEN NULL WHEN value >= 50 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS score, coalesce(CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100, 0.5) AS difficulty FROM events)"""
MASTERY = f"""{LOG},
mastery AS (SELECT student, concept, round(list_reduce(list_prepend(CAST(0.3 AS DOUBLE), list({{'s': score, 'd': difficulty}} ORDER BY ts, event_id).list_transform(lambda e: CASE WHEN e.s IS NULL THEN CAST(-1 AS DOUBLE) ELSE e.s * 1000 + e.d END)),
  lambda m, e: least(1.0, greatest(0.0, CASE WHEN e < 0 THEN m + 0.05 * (1 - m) ELSE m + 0.25 * (0.5 + (e - CASE WHEN e >= 1000 THEN 1000 ELSE 0 END)) * (CASE WHEN e >= 1000 THEN 1 ELSE 0 END - m) END))), 6) AS mastery, count(*) AS events, count(score) AS assessments FROM log GROUP BY ALL)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ln.learner_events(table(spark, sf_dir, "events"))


@query(f"WITH {MASTERY} SELECT * FROM mastery")
def mastery_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ln.mastery(_log(spark, sf_dir))


@query(f"WITH {MASTERY} SELECT student, concept, mastery, events FROM mastery")
def streaming_mastery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fold over the events as a stream."""
    return st.streamed_mastery(spark, f"{sf_dir}/events.parquet")


@query("SELECT CAST(to_timestamp(floor(epoch(ts) / 180) * 180) AS TIMESTAMP) AS start, event_type, count(*) AS events, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL")
def streaming_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.streamed_windows(spark, f"{sf_dir}/events.parquet").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT CAST(floor(epoch(ts) / 180) AS BIGINT) AS bucket, event_type, count(*) AS events FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 180).alias("bucket")
    return table(spark, sf_dir, "events").groupBy(bucket, "event_type").agg(F.count("*").alias("events"))


@query("""SELECT user_id, session, count(*) AS events, min(event_id) AS first_event FROM (
SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM (
SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 3600000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY ALL""")
def session_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ch.sessions(table(spark, sf_dir, "events"), "user_id", "ts", 3600)
    return found.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("event_id").alias("first_event"))


@query(f"WITH {MASTERY} SELECT CAST(least(floor(mastery * 5), 4) AS INTEGER) AS bin, count(*) AS concepts FROM mastery GROUP BY 1")
def mastery_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ln.histogram(ln.mastery(_log(spark, sf_dir)))


@query(f"WITH {MASTERY} SELECT concept, count(*) AS students, round(avg(mastery), 6) AS mean_mastery, CAST(sum(CASE WHEN mastery < 0.4 THEN 1 ELSE 0 END) AS BIGINT) AS weak FROM mastery GROUP BY 1")
def domain_mastery(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ln.mastery(_log(spark, sf_dir))
    return m.groupBy("concept").agg(F.count("*").alias("students"), F.round(F.avg("mastery"), 6).alias("mean_mastery"), F.sum((ln.level(F.col("mastery")) == "weak").cast("bigint")).alias("weak"))


@query(f"WITH {MASTERY} SELECT CAST(least(floor(m * 5), 4) AS INTEGER) AS bucket, count(*) AS students, CAST(sum(events) AS BIGINT) AS events FROM (SELECT student, avg(mastery) AS m, sum(events) AS events FROM mastery GROUP BY 1) GROUP BY 1")
def cohort_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ln.mastery(_log(spark, sf_dir)).groupBy("student").agg(F.avg("mastery").alias("m"), F.sum("events").alias("events"))
    return by.groupBy(F.least(F.floor(F.col("m") * 5), F.lit(4)).cast("int").alias("bucket")).agg(F.count("*").alias("students"), F.sum("events").alias("events"))


@query(f"WITH {LOG} SELECT event_id, student, round(avg(score) OVER (PARTITION BY student ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS accuracy FROM log WHERE score IS NOT NULL")
def running_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ln.running_accuracy(_log(spark, sf_dir))


@query(f"WITH {LOG} SELECT event_id, student, concept, round(avg(score) OVER w, 6) AS recent, round(count(score) OVER w / 5, 6) AS exposure FROM log WHERE score IS NOT NULL WINDOW w AS (PARTITION BY student, concept ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def recent_accuracy_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ln.recent_accuracy(_log(spark, sf_dir))


@query("SELECT user_id AS student, CAST(sum(CASE event_type WHEN 'view' THEN 8 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 5 END) AS BIGINT) AS minutes, count(DISTINCT event_type) AS concepts_seen FROM events GROUP BY 1")
def time_spent(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "reading").when(F.col("event_type") == "click", "interaction").when(F.col("event_type") == "purchase", "quiz").otherwise("other")
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("student")).agg(F.sum(ln.minutes(kind)).cast("bigint").alias("minutes"), F.countDistinct("event_type").alias("concepts_seen"))


@query(f"""WITH {MASTERY},
related AS (SELECT * FROM (VALUES ('view', 'click'), ('view', 'signup'), ('click', 'purchase'), ('click', 'error'), ('signup', 'purchase'), ('purchase', 'refund'), ('error', 'support')) t(src, dst)),
weak AS (SELECT student, CASE WHEN assessments < 3 THEN 'practice' ELSE 'review' END AS kind, concept, mastery FROM mastery WHERE mastery < 0.4),
new AS (SELECT m.student, m.concept AS src, min(r.dst) AS concept, any_value(m.mastery) AS mastery FROM mastery m JOIN related r ON r.src = m.concept WHERE m.mastery >= 0.7 AND NOT EXISTS (SELECT 1 FROM mastery x WHERE x.student = m.student AND x.concept = r.dst) GROUP BY ALL),
one AS (SELECT student, concept, max(mastery) AS mastery FROM new GROUP BY ALL),
explore AS (SELECT student, 'explore' AS kind, concept, mastery FROM (SELECT *, row_number() OVER (PARTITION BY student ORDER BY mastery DESC, concept) AS n FROM one) WHERE n <= 3)
SELECT * FROM weak UNION ALL SELECT * FROM explore""")
def recommend_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [("view", "click"), ("view", "signup"), ("click", "purchase"), ("click", "error"), ("signup", "purchase"), ("purchase", "refund"), ("error", "support")]
    return ln.recommendations(ln.mastery(_log(spark, sf_dir)), spark.createDataFrame(pairs, "src string, dst string"))


@query()
def study_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ln.study_plan(ln.mastery(_log(spark, sf_dir)))


@query()
def plan_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ln.calendar(ln.study_plan(ln.mastery(_log(spark, sf_dir))), "2024-02-01")


@query()
def linucb_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ln.difficulty_policy(_log(spark, sf_dir))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(net), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count("*").alias("n"))
