"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

#: Words of a text, unchanged, as a list in DuckDB.
WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
LOWER = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {WORDS.format(text=LOWER.format(text="coalesce(text, '')"))} AS w FROM documents),
items AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= {{k}} THEN list_distinct(list_transform(range(1, len(w) - {{k}} + 2), lambda i: array_to_string(w[i:i + {{k}} - 1], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM docs),
sizes AS (SELECT doc_id, count(*) AS n FROM items GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_n FROM items a JOIN items b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * both_n >= {{p}} * (x.n + y.n - both_n)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS seen FROM edges UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.seen),
least AS (SELECT doc_id, min(seen) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(l.c, d.doc_id) AS component_id, coalesce(l.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least l USING (doc_id)
"""

REPEATS = f"""
WITH docs AS (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS start, unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i + 19], ' '))) AS k FROM docs WHERE len(w) >= 20),
late AS (SELECT doc_id, start FROM (SELECT doc_id, start, row_number() OVER (PARTITION BY k ORDER BY doc_id, start) AS nth FROM windows) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS pos FROM late),
lists AS (SELECT doc_id, list(pos) AS gone FROM gone GROUP BY 1)
SELECT doc_id, len(w) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM docs LEFT JOIN lists USING (doc_id)
"""

NEGATIVES = """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM whole a JOIN whole b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank, n.other_id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * positive_score <= 100 * n.score AND 100 * n.score <= 100 * positive_score
QUALIFY rank <= 5
"""

MIXED = f"""
WITH sized AS (SELECT doc_id, source, CAST(len({WORDS.format(text="coalesce(text, '')")}) AS BIGINT) AS size, md5('20240229:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS s, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM sized GROUP BY source),
filled AS (
  SELECT *, (SELECT sum(s) FROM sources) - coalesce(sum(3 * s) OVER before, 0) AS room, (SELECT sum(w) FROM sources) - coalesce(sum(w) OVER before, 0) AS weights
  FROM sources WINDOW before AS (ORDER BY 3 * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT max(room / weights) AS level FROM filled WHERE s > 0),
targets AS (SELECT source, s, least(CAST(3 * s AS DOUBLE), w * level) AS target FROM sources, levels),
aims AS (SELECT *, CASE WHEN s = 0 THEN 0 ELSE CAST(floor(target / s) AS BIGINT) END AS whole FROM targets),
sums AS (SELECT d.*, a.s, a.target, a.whole, CAST(round(a.target) AS BIGINT) - a.whole * a.s AS rest, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized d JOIN aims a ON d.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, s AS source_size, target, CAST(whole * size + least(size, greatest(0, rest - before)) AS BIGINT) AS taken FROM sums
"""

#: Terms of a text, A-Z in lower case, as a list.
TERMS = rf"regexp_extract_all({LOWER.format(text='coalesce(text, %s)' % repr(''))}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
RANKED = f"""
WITH words AS (SELECT doc_id, unnest({TERMS}) AS term FROM documents),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
facts AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM lengths),
postings AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), facts),
asked AS (SELECT DISTINCT item_id, unnest({TERMS}) AS term FROM benchmark),
scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // total))))) AS BIGINT) AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), facts GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0 QUALIFY rank <= 10
"""

ORACLE_SQL: dict[str, str] = {
    "op2_fm_dedup": REPEATS,
    "op9_minmax_dedup": NEAR.format(k=4, p=80),
    "op11_sorted_hard_negatives": NEGATIVES,
    "op12_water_filled_mix": MIXED,
    "op13_range_maximum_search": RANKED,
}
