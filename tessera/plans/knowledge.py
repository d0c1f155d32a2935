"""Graph, text and document queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import chunking as ch
from tessera.operators import graph as g
from tessera.operators import mining as mn
from tessera.operators import retrieval as r
from tessera.plans.registry import query
from tessera.plans.retrieval import TOKENS
from tessera.session import table
from tessera.sources import blocks as bl

PAIRS = "SELECT a.l_partkey AS a, b.l_partkey AS b, count(*) AS weight FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY ALL HAVING count(*) >= 2"
_list = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
STOP, QUIZ_STOP, PHRASE_STOP, GENERIC = map(_list, (tx.STOPWORDS, tx.QUIZ_STOP, mn.PHRASE_STOP, mn.GENERIC))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.cooccurrence(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("related_to").alias("kind"), F.col("weight").cast("double").alias("weight"))


@query(f"SELECT a, b, weight FROM ({PAIRS})")
def concept_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("a", "b", "weight")


@query("SELECT l_suppkey AS src, l_partkey AS dst, 'supplies' AS kind, round(sum(l_quantity), 2) AS weight, count(*) AS merged, min(l_orderkey) AS first_source FROM lineitem GROUP BY ALL")
def edge_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("supplies").alias("kind"), F.col("l_quantity").alias("weight"), F.col("l_orderkey").alias("source"))
    return g.merged_edges(lines).withColumn("weight", F.round("weight", 2))


@query(f"WITH e AS ({PAIRS}), ends AS (SELECT a AS node FROM e UNION ALL SELECT b FROM e) SELECT node, count(*) AS degree FROM ends GROUP BY 1")
def graph_degree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.degrees(_edges(spark, sf_dir))


@query(f"WITH e AS ({PAIRS}), n AS (SELECT count(*) AS nodes FROM part), m AS (SELECT count(*) AS edges FROM e) SELECT nodes, edges, round(edges / (nodes * (nodes - 1)), 9) AS density, round(2 * edges / nodes, 6) AS mean_degree FROM n, m")
def graph_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.statistics(table(spark, sf_dir, "part"), _edges(spark, sf_dir))


NATION_EDGES = """e AS (SELECT DISTINCT n_nationkey AS src, 1000 + n_regionkey AS dst FROM nation)"""


@query(f"""WITH RECURSIVE {NATION_EDGES}, both_ways AS (SELECT src AS a, dst AS b FROM e UNION ALL SELECT dst, src FROM e),
reach AS (SELECT a AS node, a AS seen FROM both_ways UNION SELECT r.node, b.b FROM reach r JOIN both_ways b ON b.a = r.seen) SELECT node, min(seen) AS component FROM reach GROUP BY 1""")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and regions as one graph."""
    edges = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("src"), (F.lit(1000) + F.col("n_regionkey")).alias("dst"), F.lit("contains").alias("kind"), F.lit(1.0).alias("weight"))
    return g.components(edges)


@query(f"""WITH e AS ({PAIRS}), moves AS (SELECT a AS node, b AS too, CAST(0.6 AS DOUBLE) * 0.5 AS f FROM e UNION ALL SELECT b, a, CAST(0.6 AS DOUBLE) * 0.5 FROM e),
seeds AS (SELECT p_partkey AS query, p_partkey AS node, CAST(1 AS DOUBLE) AS score FROM part WHERE p_partkey % 20 = 0),
hop1 AS (SELECT query, too AS node, score * f AS score, 1 AS hop FROM seeds JOIN moves USING (node) WHERE too <> query),
front AS (SELECT query, node, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, node) AS n FROM hop1) WHERE n <= 24),
hop2 AS (SELECT f.query, m.too AS node, max(f.score * m.f) AS score, 2 AS hop FROM front f JOIN moves m ON m.node = f.node WHERE m.too <> f.query AND NOT EXISTS (SELECT 1 FROM hop1 h WHERE h.query = f.query AND h.node = m.too) GROUP BY ALL),
known AS (SELECT query, node, score, 0 AS hop FROM seeds UNION ALL SELECT * FROM hop1 UNION ALL SELECT * FROM hop2)
SELECT query, node, round(score, 6) AS score, hop FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, node) AS place FROM known) WHERE place <= 60""")
def graph_expand_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query"), F.col("p_partkey").alias("node"), F.lit(1.0).alias("score"))
    return g.expanded(seeds, _edges(spark, sf_dir)).select("query", "node", F.round("score", 6).alias("score"), "hop")


@query("""WITH o AS (SELECT o_custkey, o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders)
SELECT src, dst, 'prerequisite' AS kind FROM o WHERE dst IS NOT NULL UNION ALL SELECT dst, src, 'depends_on' FROM o WHERE dst IS NOT NULL""")
def prerequisite_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.prerequisites(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey")


@query("""SELECT 'region:' || r_regionkey AS id, 'region' AS kind, r_name AS label FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name FROM customer""")
def hierarchy_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hierarchy(spark, sf_dir)[0]


@query("""SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst, 'contains' AS kind, CAST(1 AS DOUBLE) AS weight FROM nation UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'contains', CAST(1 AS DOUBLE) FROM customer""")
def hierarchy_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hierarchy(spark, sf_dir)[1]


def _hierarchy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = lambda n: table(spark, sf_dir, n)
    return g.hierarchy([(t("region"), "region", "r_regionkey", None, "r_name"), (t("nation"), "nation", "n_nationkey", "n_regionkey", "n_name"), (t("customer"), "customer", "c_custkey", "c_nationkey", "c_name")])


LEXICON = [("license", "legal"), ("apache license", "legal"), ("version", "release"), ("token", "secret"), ("the", "article"), ("der", "article"), ("apache license version", "legal")]


@query(f"""WITH w AS (SELECT doc_id, {TOKENS.format(t="text", n=1)} AS w FROM documents), lexicon AS (SELECT * FROM (VALUES {", ".join(map(str, LEXICON))}) t(alias, concept)),
runs AS (SELECT doc_id, unnest(w) AS alias FROM w UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w WHERE len(w) >= 2 UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w WHERE len(w) >= 3)
SELECT doc_id, concept, count(*) AS hits FROM runs JOIN lexicon USING (alias) GROUP BY ALL""")
def alias_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mn.aliases(table(spark, sf_dir, "documents"), spark.createDataFrame(LEXICON, "alias string, concept string"))


@query(rf"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z][a-z\-]+'), lambda x: length(x) >= 3) AS w FROM documents),
runs AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - n + 2), lambda i: w[i:i + n - 1])) AS x FROM w, (VALUES (2), (3), (4)) s(n) WHERE len(w) >= n),
edges AS (SELECT doc_id, array_to_string(x, ' ') AS phrase FROM runs WHERE len(list_filter(x, lambda t: t IN {PHRASE_STOP})) = 0 AND x[1] NOT IN {GENERIC} AND x[-1] NOT IN {GENERIC})
SELECT phrase, count(*) AS n, count(DISTINCT doc_id) AS documents FROM edges GROUP BY 1 HAVING count(*) >= 4 AND count(DISTINCT doc_id) >= 3 ORDER BY n DESC, phrase LIMIT 360""")
def phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mn.phrases(table(spark, sf_dir, "documents"))


@query(f"""WITH w AS (SELECT doc_id, {TOKENS.format(t="text", n=3)} AS w FROM documents), r AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM w),
c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first FROM r WHERE word NOT IN {STOP} GROUP BY ALL)
SELECT doc_id, word, n, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS INTEGER) AS place FROM c) WHERE place <= 10""")
def top_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mn.keywords(table(spark, sf_dir, "documents"))


@query("""WITH l AS (SELECT source, doc_id, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: trim(x)))) AS line FROM documents), p AS (SELECT source, count(DISTINCT doc_id) AS pages FROM documents GROUP BY 1)
SELECT source, line, count(DISTINCT doc_id) AS on_pages, any_value(pages) AS pages FROM l JOIN p USING (source) WHERE line <> '' AND length(line) < 120 GROUP BY ALL HAVING count(DISTINCT doc_id) >= greatest(2, floor(any_value(pages) * 0.02))""")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mn.repeated_lines(table(spark, sf_dir, "documents"), "source", "doc_id", ratio=0.02)


@query("""SELECT doc_id, CASE WHEN la + ar = 0 THEN 'en' WHEN ar >= la THEN 'ar' ELSE 'en' END AS language, CASE WHEN la + ar = 0 THEN 0.0 ELSE greatest(la, ar) / (la + ar) END::DOUBLE AS share FROM
(SELECT doc_id, length(regexp_replace(text, '[^\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}\\x{08A0}-\\x{08FF}]', '', 'g')) AS ar, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS la FROM documents)""")
def script_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    language, share = tx.script_language(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", language.alias("language"), share.alias("share"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents), w AS (SELECT *, list_filter(regexp_split_to_array(trim(line), '\s+'), lambda x: x <> '') AS w FROM l)
SELECT doc_id, CAST(n AS INTEGER) AS n, line FROM w WHERE length(trim(line)) <= 70 AND len(w) BETWEEN 1 AND 10 AND NOT regexp_matches(trim(line), '[.!?;:,]$') AND ((upper(line) = line AND regexp_matches(line, '\p{Lu}')) OR (len(w) <= 8 AND len(list_filter(w, lambda x: regexp_matches(x, '^\p{Lu}'))) >= len(w) * 0.6))""")
def heading_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.where(tx.looks_like_heading(F.col("line"))).select("doc_id", "n", "line")


@query("""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]{2,}', ' ', 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10)) AS text FROM documents""")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.collapsed(F.col("text")).alias("text"))


_PLAIN = "replace(translate(text, '{a}', '{b}'), '…', '...')".format(a="".join(tx.SMART).replace("'", "''"), b="".join(tx.SMART.values()).replace("'", "''"))
_CLEAN = rf"regexp_replace({_PLAIN}, '[\x00-\x08\x0B-\x1F\x7F]', '', 'g')"
_FLOW = rf"regexp_replace(regexp_replace({_CLEAN}, '(^|[^.!?:;\n])\n(\p{{Ll}})', '\1 \2', 'g'), '(^|[^.!?:;\n])\n(\p{{Ll}})', '\1 \2', 'g')"


@query(rf"""SELECT doc_id, CASE WHEN contains(text, '|') THEN {_CLEAN} ELSE trim(regexp_replace(regexp_replace(regexp_replace({_FLOW}, '[ \t]{{2,}}', ' ', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10)) END AS text FROM documents""")
def block_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.normalized_block(F.col("text"), F.when(F.col("text").contains("|"), "table").otherwise("paragraph")).alias("text"))


@query("SELECT doc_id, sha256(text) AS digest, count(*) OVER (PARTITION BY text) AS copies FROM documents")
def content_hash_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    return hashed.join(hashed.groupBy("digest").agg(F.count("*").alias("copies")), "digest").select("doc_id", "digest", "copies")


@query()
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bl.blocks(table(spark, sf_dir, "pages"), "page_id", "html", "html")


@query()
def section_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.section_paths(bl.blocks(table(spark, sf_dir, "pages"), "page_id", "html", "html"), "page_id")


@query()
def chunk_parent_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.chunks(table(spark, sf_dir, "documents"))


@query("""WITH t AS (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS p FROM documents), r AS (SELECT doc_id, unnest(p) AS text, unnest(range(len(p))) AS n FROM t),
o AS (SELECT doc_id, CAST(n AS INTEGER) AS n, text, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start FROM r)
SELECT doc_id, n, text, char_start, CAST(char_start + length(text) AS BIGINT) AS char_end FROM o WHERE trim(text) <> ''""")
def plain_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bl.plain_paragraphs(table(spark, sf_dir, "documents"))


@query(r"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Table ' || doc_id || '.2: ' || text WHEN doc_id % 3 = 1 THEN 'see Fig. 4: ' || text || ' figure 4: again and again' ELSE text END AS text FROM documents),
m AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\b(figure|fig\.|table)\s+(\d+(?:\.\d+)?)\s*[:.]\s*([^.\n]+)', 1)) AS a, unnest(regexp_extract_all(text, '(?i)\b(figure|fig\.|table)\s+(\d+(?:\.\d+)?)\s*[:.]\s*([^.\n]+)', 2)) AS number, unnest(regexp_extract_all(text, '(?i)\b(figure|fig\.|table)\s+(\d+(?:\.\d+)?)\s*[:.]\s*([^.\n]+)', 3)) AS c FROM t),
r AS (SELECT doc_id, CASE WHEN lower(a) LIKE 'fig%' THEN 'figure' ELSE 'table' END AS kind, number, trim(c) AS caption, row_number() OVER () AS pos FROM m)
SELECT doc_id, kind, number, arg_min(caption, pos) AS caption FROM r WHERE len(regexp_split_to_array(caption, '\s+')) >= 3 GROUP BY ALL""")
def figure_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions of documents to two thirds of which a marker is added."""
    i, text = F.col("doc_id"), F.col("text")
    made = F.when(i % 3 == 0, F.concat(F.lit("Table "), i, F.lit(".2: "), text)).when(i % 3 == 1, F.concat(F.lit("see Fig. 4: "), text, F.lit(" figure 4: again and again"))).otherwise(text)
    return mn.figures(table(spark, sf_dir, "documents").withColumn("text", made))


@query(f"""WITH t AS (SELECT conv_id, turn, role, list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z\\-]+'), lambda w: length(w) > 2 AND w NOT IN {QUIZ_STOP})) AS w FROM conversations),
u AS (SELECT conv_id, turn, w, lead(w) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM t)
SELECT conv_id, turn, len(w)::INTEGER AS terms, len(list_filter(w, lambda x: list_contains(answer, x)))::INTEGER AS covered, len(list_filter(w, lambda x: list_contains(answer, x))) >= 0.4 * len(w) AS passed FROM u WHERE answer IS NOT NULL AND len(w) > 0""")
def quiz_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's key terms, and whether the next turn covers enough of them."""
    from pyspark.sql import Window

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.terms(F.col("text")).alias("w"))
    both = turns.withColumn("answer", F.lead("w").over(Window.partitionBy("conv_id").orderBy("turn"))).where("answer IS NOT NULL AND size(w) > 0")
    covered = F.size(F.array_intersect("w", "answer"))
    return both.select("conv_id", "turn", F.size("w").alias("terms"), covered.alias("covered"), (covered >= 0.4 * F.size("w")).alias("passed"))
