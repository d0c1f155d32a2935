"""Text functions as columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Common words left out of keywords.
STOPWORDS = "the and for are with that this from was were has have had not but you your they their will can its into about which when what who how why our out more than then them these those been being over under such also each other some any all".split()
# Words that are no terms of an answer, of an answer's evaluation, and of a quiz.
ANSWER_STOP = "the a an of to in on for with and or is are what how why when which does do explain".split()
EVALUATION_STOP = "the a an of to in on for with and or is are what how why which this that we you it".split()
QUIZ_STOP = "the a an of to in on for with and or is are be this that it its as by from at we you can will which when how what was were has have using used also such these those them they our your into than then".split()
TERMINALS = ".!?;:"
#: Typographic characters and what is written for them.
SMART = {"“": '"', "”": '"', "„": '"', "‘": "'", "’": "'", "‚": "'", "–": "-", "—": "-", "−": "-", " ": " ", " ": " ", " ": " ", "　": " "}


def tokens(text: Column, least: int = 2) -> Column:
    """Words of letters, digits and underscores in lower case, of a least length."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"[\p{{L}}\p{{N}}_]{{{least},}}"), F.lit(0))


def counts_of(words: Column) -> Column:
    """An array of (term, tf) of an array of words, in order: the runs of equal words among the sorted ones."""

    def runs(w: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
        pairs = F.transform(F.array(starts), lambda s: F.transform(s, lambda i, k: F.struct(F.get(w, i).alias("term"), (F.coalesce(F.get(s, k + 1), F.size(w)) - i).cast("bigint").alias("tf"))))
        return F.when(F.size(w) > 0, F.element_at(pairs, 1)).otherwise(F.array().cast("array<struct<term:string,tf:bigint>>"))

    return F.element_at(F.transform(F.array(F.sort_array(words)), runs), 1)


def term_counts(text: Column, least: int = 2) -> Column:
    """counts_of() a text's tokens."""
    return counts_of(tokens(text, least))


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), F.lit(0)))


def chunk_tokens(text: Column) -> Column:
    """Estimated tokens for chunks: words times 1.3, to the nearest integer, halves to even."""
    return F.bround(word_count(text) * F.lit(1.3)).cast("int")


def context_tokens(text: Column) -> Column:
    """Estimated tokens for the context budget: truncated, at least 1."""
    return F.greatest(F.lit(1), F.floor(word_count(text) * F.lit(1.3))).cast("int")


def plain_characters(text: Column) -> Column:
    """Typographic quotes, dashes and spaces as plain ones, the ellipsis as three dots."""
    return F.replace(F.translate(text, "".join(SMART), "".join(SMART.values())), F.lit("…"), F.lit("..."))


def without_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F\x7F]", "")


def collapsed(text: Column) -> Column:
    """Runs of blanks as one, no blanks at line ends, at most one empty line, nothing around."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[ \t]{2,}", " "), r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"), F.lit(" \t\n"))


def reflowed(text: Column) -> Column:
    """Single line breaks inside a sentence as blanks."""
    return F.regexp_replace(text, r"(?<![.!?:;\n])\n(?=\p{Ll})", " ")


def normalized_block(text: Column, kind: Column) -> Column:
    """A block's text: plain characters, no controls; prose is reflowed and collapsed, code and tables keep their layout."""
    clean = without_controls(plain_characters(text))
    return F.when(kind.isin("code", "table"), clean).otherwise(collapsed(reflowed(clean)))


@F.pandas_udf(StringType())
def composed(text: pd.Series) -> pd.Series:
    """Canonical composition, which has no built-in function."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def normalized_query(text: Column) -> Column:
    return F.btrim(F.regexp_replace(without_controls(plain_characters(composed(text))), r"\s+", " "))


def sentences(text: Column) -> Column:
    """Sentences by Latin and Arabic terminators and by lines."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?;:؟؛،…])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")


def slug(text: Column, most: int = 60) -> Column:
    """Letters and digits joined by hyphens; texts without any get a hash."""
    made = F.btrim(F.substring(F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-")), 1, most), F.lit("-"))
    return F.when(made == "", F.substring(F.sha2(text.cast("binary"), 256), 1, 12)).otherwise(made)


def looks_like_heading(text: Column) -> Column:
    """At most 70 characters and 10 words, no final punctuation, and all capitals, or capitals at 60 percent of at most 8 words."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    capital = F.size(F.filter(words, lambda w: F.substring(w, 1, 1).rlike(r"\p{Lu}")))
    n = F.size(words)
    shape = (F.upper(text) == text) & text.rlike(r"\p{Lu}") | ((n <= 8) & (capital >= n * 0.6))
    return (F.length(F.trim(text)) <= 70) & n.between(1, 10) & ~F.trim(text).rlike(r"[.!?;:,]$") & shape


def script_counts(text: Column) -> tuple[Column, Column]:
    """Letters of three Arabic blocks, and letters from a to z."""
    count = lambda keep: F.length(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{keep}]", ""))
    return count(r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}"), count("A-Za-z")


def script_language(text: Column) -> tuple[Column, Column]:
    """Language by script, and the share of its letters; Arabic on a tie, English with 0 where there are no letters."""
    arabic, latin = script_counts(text)
    total = arabic + latin
    return F.when(total == 0, "en").when(arabic >= latin, "ar").otherwise("en"), F.when(total == 0, 0.0).otherwise(F.greatest(arabic, latin) / total)


def terms(text: Column, stop: list[str] = QUIZ_STOP) -> Column:
    """Distinct Latin words of more than two letters, without common words."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z][a-z\-]+"), F.lit(0)), lambda w: (F.length(w) > 2) & ~w.isin(stop)))


def key_terms(sentence: Column, concept: Column, k: int = 8) -> Column:
    """The terms of both, the concept's first, the longer before the shorter, then by the alphabet."""
    own = terms(concept)
    ranked = F.array_sort(F.transform(F.array_union(own, terms(sentence)), lambda t: F.struct((~F.array_contains(own, t)).alias("a"), (-F.length(t)).alias("b"), t.alias("t"))))
    return F.transform(F.slice(ranked, 1, k), lambda x: x["t"])


def study_minutes(words: Column) -> Column:
    """Reading time at 200 words a minute, at least one; null without words."""
    return F.when(words > 0, F.greatest(F.lit(1), F.bround(words / 200).cast("int")))


def color_band(mastery: Column, weak: float, strong: float) -> Column:
    """What a mastery is shown in."""
    return F.when(mastery < weak, "red").when(mastery < strong, "amber").otherwise("green")


def iso_time(seconds: Column) -> Column:
    """Seconds since 1970 as a UTC time in ISO form (for sessions in UTC)."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def first_number(text: Column, patterns: list[str]) -> Column:
    """The number in the first of the patterns (with one group) that is in the text."""
    return F.coalesce(*(F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), p, 1), F.lit("")).cast("int") for p in patterns))


def point_id(key: Column) -> Column:
    """A stable id of 128 bits in the form of a UUID."""
    h = F.md5(key.cast("binary"))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def clock(seconds: Column) -> Column:
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad((F.floor(seconds) % 60).cast("string"), 2, "0"))


def cited(text: Column) -> Column:
    """Citation marks such as C1 and K2, in order."""
    return F.regexp_extract_all(text, F.lit(r"\[([CK][0-9]+)\]"), F.lit(1))


def domain(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1)), r"^www\.", "")


def url_key(url: Column) -> Column:
    """What equal pages share: no final slashes, then no query or fragment, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(url, r"/+$", ""), r"[?#].*$", ""))
