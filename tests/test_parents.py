"""Parents by slide, cell, time and section, under a budget; ids that stay."""

import random

from tessera.operators import chunking as ch
from tessera.operators.chunking import groups, n_tokens, windows
from tessera.sources import index as ix

BLOCK = "resource_id string, n int, kind string, text string, section array<string>, language string, page int, slide int, cell int, start double"


def blocks(spark, rows):
    return spark.createDataFrame(rows, BLOCK)


def block(n, text, rid="r", kind="paragraph", section=(), language=None, page=None, slide=None, cell=None, start=None):
    return (rid, n, kind, text, list(section) if section is not None else None, language, page, slide, cell, start)


def test_long_section_has_no_orphans(spark):
    text = " ".join(f"Sentence number {k} about databases and keys." for k in range(60))
    rows = ch.chunked(blocks(spark, [block(0, "Intro", kind="heading", section=["Intro"]), block(1, text, section=["Intro"])]), "resource_id", 200, 40, 8, 5).collect()
    tops, under = [x for x in rows if x.kind == "parent"], sorted((x for x in rows if x.kind == "child"), key=lambda x: x.seq)
    assert tops and len(under) > 1 and {x.parent_id for x in under} == {x.chunk_id for x in tops}
    assert all(x.resource_id == "r" and x.heading == "Intro" for x in under) and all(x.child_ids for x in tops)
    assert [x.chunk_id for x in under] == [f"r::c{k:05d}" for k in range(len(under))] and sorted(x.chunk_id for x in tops) == [f"r::p{k:04d}" for k in range(len(tops))]
    assert [x.chunk_id for x in under] == [c for t in sorted(tops, key=lambda x: x.seq) for c in t.child_ids]


def test_slides_and_pages(spark):
    slides = [block(0, "KNN", kind="heading", slide=1, section=["KNN"]), block(1, "A classifier.", slide=1, section=["KNN"]), block(2, "SVM", kind="heading", slide=2, section=["SVM"])]
    pages = [block(0, "Para A.", "p", page=1, language="fr"), block(1, "Para B.", "p", page=2, language="fr"), block(2, "  ", "p", page=9)]
    rows = ch.chunked(blocks(spark, slides + pages), "resource_id").collect()
    assert {x.slide for x in rows if x.resource_id == "r" and x.kind == "parent"} == {1, 2} and {x.chunk_type for x in rows if x.resource_id == "r" and x.kind == "child"} == {"slide"}
    page = next(x for x in rows if x.resource_id == "p" and x.kind == "parent")
    assert (page.page, page.page_end, page.language, page.text, page.block_ids) == (1, 2, "fr", "Para A.\n\nPara B.", [0, 1])


def test_many_resources_as_a_plain_fold_gives_them(spark):
    draw = random.Random(9)
    rows = []
    for r in range(25):
        for n in range(draw.randint(0, 30)):
            what = draw.choice(["slide", "cell", "start", "section"])
            place = {"slide": {"slide": draw.randint(1, 2)}, "cell": {"cell": draw.randint(1, 2)}, "start": {"start": draw.random() * 400}, "section": {"section": draw.choice([[], ["a"], ["a", "b"], None])}}[what]
            rows.append(block(n * 2, draw.choice(["", " ", "word. " * draw.randint(1, 90), "Ende der Zeile! " * draw.randint(1, 40)]), f"r{r}", draw.choice(["heading", "paragraph", "code"]), **place))
    rows += [block(0, "no resource", None), block(1, None, "r1")]
    out = ch.chunked(blocks(spark, rows).repartition(4), "resource_id", 60, 30, 8, 4).collect()
    expected = {}
    for r in {x[0] for x in rows if x[0]}:
        own = sorted((x for x in rows if x[0] == r and (x[3] or "").strip()), key=lambda x: x[1])
        key = lambda x: ("slide", x[7]) if x[7] is not None else ("cell", x[8]) if x[8] is not None else ("time", x[9] // 180) if x[9] is not None else ("section", tuple(x[4] or []))
        numbers, n = groups([str(key(x)) for x in own], [n_tokens(x[3]) for x in own], 60), 0
        for p in sorted(set(numbers)):
            text = "\n\n".join(x[3].strip() for x, q in zip(own, numbers, strict=True) if q == p)
            expected[f"{r}::p{p:04d}"] = text
            for w in windows(text, 30, 8, 4) or [text]:
                expected[f"{r}::c{n:05d}"], n = w, n + 1
    assert {x.chunk_id: x.text for x in out} == expected and len(out) == len(expected) > 100
    again = ch.chunked(blocks(spark, rows), "resource_id", 60, 30, 8, 4).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_columns_that_are_not_there_and_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "text one"), (1, 1, "text two"), (2, 0, None)], "doc_id int, n int, text string")
    out = ch.chunked(rows, "doc_id")
    assert {(x.chunk_id, x.text) for x in out.collect()} == {("1::p0000", "text one\n\ntext two"), ("1::c00000", "text one text two")}
    ix.save_chunks(out, tmp_path.as_uri())
    assert ix.chunks(spark, tmp_path.as_uri(), "child").first().text == "text one text two" and {tuple(x) for x in ix.chunk_counts(spark, tmp_path.as_uri()).collect()} == {(1, 1, 1)}
    assert ch.chunked(rows.limit(0), "doc_id").collect() == []
