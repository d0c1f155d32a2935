import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def corpus():
    """Rows of a small corpus with copies, near copies, shared passages, personal data, nulls, empty and very long texts."""
    draw = random.Random(5)
    syllables = ["ba", "co", "di", "fu", "gra", "hel", "ing", "ly", "mo", "ne", "pra", "sti"]
    word = lambda: "".join(draw.choice(syllables) for _ in range(draw.randint(1, 4)))
    common = "the of and to in a is that it for".split()
    text = lambda n: " ".join(draw.choice(common) if draw.random() < 0.35 else word() for _ in range(n)) + "."
    passage = text(40)
    texts = [text(draw.randint(60, 160)) for _ in range(60)]
    texts += [texts[3], texts[3], texts[7]]  # copies
    for k in (10, 11, 12):  # near copies
        words = texts[k].split()
        words[5] = "changed"
        texts.append(" ".join(words))
    texts += [f"{text(50)}\n{passage} {text(30)}" for _ in range(5)]
    texts += [f"{text(30)} mail me at joe.blow@mail3.example.com or +1 (171) 555-2028, card 4111 1111 1111 1111, host 10.0.0.300 or 191.26.250.130. {text(30)}"]
    texts += ['key = "9765fab7324201a5ddfac0becd9064abbef40be1" ' + text(55), "ab " * 200, "x*** y&&& " * 60, "", "   \n\t ", None, text(6000), "é" * 30_000, "word " * 18, "Déjà vu: naïve façade — “quoted” 你好 😀\n" + text(60)]
    rows = [(k, t, "en", "src0" if k % 3 else "src1", len(t or "")) for k, t in enumerate(texts)]
    return [*rows, (900, texts[0], None, None, None), (901, texts[1], "xx", "src9", 3)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def tables(spark, corpus, tmp_path_factory):
    """A folder with the corpus as documents, and labels."""
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(corpus, SCHEMA).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], int("***" not in (r[1] or "") and len(r[1] or "") > 300), 0) for r in corpus]
    spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, repeated rows, ties, and extra columns with names that operators use."""
    rows = [(None, None, None, None, None, "a", 1), (None, "some text", None, None, 4, "b", 2), (5, "same text here", "en", "s", 14, "c", 3), (5, "same text here", "en", "s", 14, "c", 3), (6, None, "en", None, 0, "d", None), (7, "one", None, "s", 3, None, 5)]
    return spark.createDataFrame(rows, SCHEMA + ", kept string, k int").selectExpr("*", "kept AS tokens", "k AS start", "kept AS gram", "kept AS label")
