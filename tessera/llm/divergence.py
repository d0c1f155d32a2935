"""Quality rules by distribution divergence, in DataFrame functions only.

A document has two histograms: shares of character classes, and shares of its language's common words among its words. They
are held against the language's references by Jensen-Shannon distance (base 2, 0 to 1). A reference is the mean histogram
of the language's distinct texts that pass the base rules and lie no farther than the median from the mean of all such
texts, so that neither copies nor junk bend it. Short documents scatter more: the bound grows with one over the square root
of the length, and below a least length a histogram has no say.

Defined cases: a null or empty text has no words and fails the base rules; a null or unlisted language has its own
reference with the words of no list; a language with too few texts has no reference and rejects nothing by divergence;
ties need no order; repeated rows are judged alike; other columns are kept, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import BLANKS, documents, stored

# Very common words of some languages.
COMMON = {
    "en": "the of and to in a is that it for on was be with as by this are at from".split(),
    "de": "der die und in den von zu das mit sich auf ist im dem nicht ein eine des für auch".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur pas au plus".split(),
    "es": "de la que el en y los se del las por un para con no una su al lo como".split(),
}
#: The classes that make up most of a text, taken away first; of the others, what to take away from the remainder so that only they are left.
PLAIN = r"[a-z\x20\x09-\x0D]+"
CLASSES = {"upper": r"[^\p{Lu}]+", "letter": r"[^\p{L}]+", "digit": r"[^\p{Nd}]+", "stop": r"[^.,;:!?'\"()-]+", "symbol": "[^#*$%&|<>]+"}
LEAST_CHARS, LEAST_WORDS, LEAST_TEXTS = 200, 50, 20
#: Bounds of the distances for long texts, and what is added over the square root of the length.
CHAR_BOUND, CHAR_SLACK = 0.14, 2.8
WORD_BOUND, WORD_SLACK = 0.16, 1.5
LEAST_BASE_WORDS, MOST_REPEAT_PERCENT, WINDOW = 50, 50, 3
#: Languages (rows of about 300 bytes) that may be broadcast; parts that each language's rows are dealt to beyond that.
BROADCAST_LANGUAGES, SALTS = 5_000, 64

_P = "__tessera_"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, BLANKS))


def repeated_words(words: Column) -> Column:
    """How many words lie in 3-word windows that are found twice or more; windows are compared by 64-bit hashes."""

    def covered(hashes: Column) -> Column:
        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        near = lambda s, j: F.get(s, j)["h"]
        twice = let(ranked, lambda s: F.sort_array(F.array_compact(F.transform(s, lambda x, j: F.when((x["h"] == near(s, j - 1)) | (x["h"] == near(s, j + 1)), x["i"])))))
        return let(twice, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("bigint"), lambda a, x: a + x))

    def counted(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(covered(h)))

    return let(words, lambda w: F.when(F.size(w) < WINDOW, F.lit(0).cast("bigint")).otherwise(counted(w)))


def base_rules(df: DataFrame, text: str = "text", prefix: str = _P) -> DataFrame:
    """Add the prefixed columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed, and rest (the text without PLAIN)."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0)
    word_facts = let(
        words_of(t), lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"), repeated_words(w).alias("n_repeat_words"))
    )
    out = df.withColumn(f"{prefix}facts", word_facts).withColumns({
        f"{prefix}n_words": F.col(f"{prefix}facts.n_words"),
        f"{prefix}word_chars": F.col(f"{prefix}facts.word_chars"),
        f"{prefix}rest": F.regexp_replace(t, PLAIN, ""),
        f"{prefix}n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")),
        f"{prefix}n_repeat_words": F.col(f"{prefix}facts.n_repeat_words"),
    })
    out = out.withColumn(f"{prefix}n_symbols", F.length(F.regexp_replace(f"{prefix}rest", CLASSES["symbol"], "")).cast("bigint"))
    n, repeats = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return out.drop(f"{prefix}facts").withColumn(f"{prefix}base_failed", (n < LEAST_BASE_WORDS) | (100 * repeats > MOST_REPEAT_PERCENT * n))


def shares(counts: Column) -> Column:
    """An array of counts as shares of their sum; all 0 where that is 0."""
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return let(total, lambda n: F.transform(counts, lambda x: F.when(n > 0, x / n).otherwise(0.0)))


def _is(k: int) -> Callable[[Column], Column]:
    return lambda x: x == k


def histograms(df: DataFrame, text: str = "text", lang: str = "lang", prefix: str = _P) -> DataFrame:
    """Add the prefixed columns n_chars, chars and words: the length and both histograms."""
    t = F.coalesce(F.col(text), F.lit(""))
    whole = F.struct(
        *(F.length(F.regexp_replace(f"{prefix}rest", pattern, "")).cast("bigint").alias(k) for k, pattern in CLASSES.items()),
        F.length(t).cast("bigint").alias("n"), F.col(f"{prefix}word_chars").alias("words"), F.length(f"{prefix}rest").cast("bigint").alias("rest"),
    )

    def classes(c: Column) -> Column:
        marks = c["digit"] + c["stop"] + c["symbol"]
        return let(F.array(c["words"] - c["rest"], c["upper"], c["letter"] - c["upper"], c["digit"], c["stop"], c["symbol"], c["n"] - c["words"], c["rest"] - c["letter"] - marks), shares)

    listed = F.array().cast("array<string>")
    for name, words in COMMON.items():
        listed = F.when(F.col(lang) == name, F.array(*map(F.lit, words))).otherwise(listed)
    tokens = F.split(F.lower(t), r"[\x20\x09-\x0D.,;:!?]+")
    hits = let(listed, lambda known: F.filter(F.transform(tokens, lambda w: F.array_position(known, w)), lambda p: p > 0))
    n = max(map(len, COMMON.values()))

    def common(found: Column) -> Column:
        counts = [F.size(F.filter(found, _is(k))).cast("bigint") for k in range(1, n + 1)]
        return let(F.array(*counts, F.greatest(F.col(f"{prefix}n_words") - F.size(found), F.lit(0))), shares)

    return df.withColumns({f"{prefix}n_chars": F.length(t).cast("bigint"), f"{prefix}chars": let(whole, classes), f"{prefix}words": let(hits, common)}).drop(f"{prefix}rest")


def distance(p: Column, q: Column) -> Column:
    """The Jensen-Shannon distance of two arrays of shares: the root of the divergence in bits; null without the second."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    return F.when(q.isNotNull(), F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), F.lit(0.0))))


def _mean(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """The mean histograms of each key's rows, and how many rows."""
    sizes = {"chars": 8, "words": max(map(len, COMMON.values())) + 1}
    sums = [F.avg(F.col(f"{prefix}{h}")[k]).alias(f"{h}{k}") for h, n in sizes.items() for k in range(n)]
    mean = df.groupBy(*keys).agg(F.count("*").alias(f"{prefix}texts"), *sums)
    return mean.select(*keys, f"{prefix}texts", *(F.array(*(f"{h}{k}" for k in range(n))).alias(f"{prefix}ref_{h}") for h, n in sizes.items()))


def with_language(rows: DataFrame, by_language: DataFrame, key: str) -> DataFrame:
    """rows with the (stored) row of their language, if there is one. Few languages are broadcast; of more than that, each language's rows are dealt over SALTS tasks, for one language may hold most rows."""
    if by_language.count() <= BROADCAST_LANGUAGES:
        return rows.join(F.broadcast(by_language), key, "left")
    salt = f"{key}_salt"
    copies = by_language.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(copies, [key, salt], "left").drop(salt)


def references(facts: DataFrame, prefix: str = _P) -> DataFrame:
    """A row for each language: its key, both references and how many distinct texts they come from."""
    key, both = f"{prefix}lang", [f"{prefix}chars", f"{prefix}words"]
    clean = facts.where(~F.col(f"{prefix}base_failed"))
    texts = clean.groupBy(key, f"{prefix}text_hash").agg(*(F.first(c).alias(c) for c in both))
    far = F.greatest(distance(F.col(both[0]), F.col(f"{prefix}ref_chars")), distance(F.col(both[1]), F.col(f"{prefix}ref_words")))
    texts = stored(texts, "histograms")
    placed = with_language(texts, stored(_mean(texts, [key], prefix), "means"), key).select(key, *both, far.alias(f"{prefix}far"))
    middle = placed.groupBy(key).agg(F.percentile_approx(f"{prefix}far", 0.5).alias(f"{prefix}middle"))
    return _mean(with_language(placed, stored(middle, "middles"), key).where(F.col(f"{prefix}far") <= F.col(f"{prefix}middle")), [key], prefix)


def judged(df: DataFrame, text: str = "text", lang: str = "lang", prefix: str = _P, carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all by default) of every row, with the prefixed facts, char_distance, word_distance (null: no say) and kept."""
    carry = df.columns if carry is None else carry
    facts = histograms(base_rules(df, text, prefix), text, lang, prefix)
    facts = facts.withColumns({f"{prefix}lang": F.coalesce(F.col(lang), F.lit("")), f"{prefix}text_hash": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    facts = stored(facts.select(*carry, *[c for c in facts.columns if c.startswith(prefix)]), "facts")
    refs = stored(references(facts, prefix), "references").where(F.col(f"{prefix}texts") >= LEAST_TEXTS)
    out = with_language(facts, refs, f"{prefix}lang")
    n_chars, n_words = F.col(f"{prefix}n_chars"), F.col(f"{prefix}n_words")
    far = {
        f"{prefix}char_distance": F.when(n_chars >= LEAST_CHARS, distance(F.col(f"{prefix}chars"), F.col(f"{prefix}ref_chars"))),
        f"{prefix}word_distance": F.when(n_words >= LEAST_WORDS, distance(F.col(f"{prefix}words"), F.col(f"{prefix}ref_words"))),
    }
    out = out.withColumns(far)
    rejected = F.coalesce(F.col(f"{prefix}char_distance") > CHAR_BOUND + CHAR_SLACK / F.sqrt(n_chars), F.lit(False)) | F.coalesce(F.col(f"{prefix}word_distance") > WORD_BOUND + WORD_SLACK / F.sqrt(n_words), F.lit(False))
    return out.withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & ~rejected)


def quality_filter(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of df that the rules keep, with its columns."""
    return judged(df, text, lang).where(F.col(f"{_P}kept")).select(*df.columns)


def op1_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base counts, distances and verdict."""
    out = judged(documents(spark, sf_dir).select("doc_id", "text", "lang"), carry=["doc_id"])
    named = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"]
    return out.select("doc_id", *(F.col(f"{_P}{c}").alias(c) for c in named))
