import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


def test_tokens(spark):
    assert one(spark, "Hello, WORLD! a Über_1", tx.tokens) == ["hello", "world", "über_1"]
    assert one(spark, None, tx.tokens) == []


@pytest.mark.parametrize("words,chunk,context", [(1, 1, 1), (5, 6, 6), (0, 0, 1), (15, 20, 19)])
def test_token_estimates(spark, words, chunk, context):
    assert one(spark, "w " * words, tx.chunk_tokens) == chunk
    assert one(spark, "w " * words, tx.context_tokens) == context


def test_normalization(spark):
    assert one(spark, "“Smart”  quotes—dash…\n\n\n\nand   spaces", lambda t: tx.collapsed(tx.plain_characters(t))) == '"Smart" quotes-dash...\n\nand spaces'
    assert one(spark, "foreign\nkey", tx.reflowed) == "foreign key"
    assert one(spark, "a.\nb", tx.reflowed) == "a.\nb"
    assert one(spark, "x  =  1\n\ty", lambda t: tx.normalized_block(t, F.lit("code"))) == "x  =  1\n\ty"
    assert one(spark, "é — x\x00", tx.normalized_query) == "é - x"


def test_language(spark):
    language = lambda s: tuple(spark.createDataFrame([(s,)], "t string").select(*tx.script_language(F.col("t"))).first())
    assert language("This is an English sentence.") == ("en", 1.0)
    assert language("هذه جملة عربية")[0] == "ar"
    assert language("12345")[1] == 0.0


def test_sentences_and_terms(spark):
    assert one(spark, "One. Two! Three\nFour؟ Five", tx.sentences) == ["One.", "Two!", "Three", "Four؟", "Five"]
    assert one(spark, "The Cat and the cat-like dog", tx.terms) == ["cat", "cat-like", "dog"]


@pytest.mark.parametrize("text,expected", [("Introduction To Sets", True), ("OVERVIEW", True), ("this is a plain line", False), ("It Ends.", False), ("A" * 80, False)])
def test_headings(spark, text, expected):
    assert one(spark, text, tx.looks_like_heading) is expected


def test_small_functions(spark):
    assert one(spark, "Data & Models: 101!", tx.slug) == "data-models-101"
    assert len(one(spark, "!!!", tx.slug)) == 12
    assert one(spark, "pools [C1] and [K2].", tx.cited) == ["C1", "K2"]
    assert one(spark, "https://www.Example.org:80/a/?utm=x#y", tx.domain) == "example.org"
    assert one(spark, "https://Example.org/a/?utm=x", tx.url_key) == "https://example.org/a/"
    assert one(spark, "https://Example.org/a//", tx.url_key) == "https://example.org/a"
    assert one(spark, "aé ࢠ٣ b", lambda t: F.array(*tx.script_counts(t))) == [2, 2]
    assert spark.range(1).select(tx.key_terms(F.lit("The longest words here win"), F.lit("win")), tx.study_minutes(F.lit(500)), tx.iso_time(F.lit(0)), tx.term_counts(F.lit("b a b cc"), 1)).first()[:3] == (["win", "longest", "words", "here"], 2, "1970-01-01T00:00:00Z")
    assert spark.range(1).select(tx.clock(F.lit(125.4))).first()[0] == "2:05"
