import json

from tessera.operators import chunking as ch
from tessera.operators import mining as mn
from tessera.sources import blocks as bl

VTT = """WEBVTT

00:00:00.000 --> 00:00:04.000
<c>Hello and welcome</c>

00:00:04.000 --> 00:00:09.500
to the course

00:00:30.000 --> 00:00:34.000
Second part
"""


def test_markdown():
    b = bl.markdown_blocks("# Top\nintro [a](http://x)\n\n## Sub\n```py\nx = 1\n\n# no heading\n```\n- one\n- two\n\n> said\n\n| a | b |\n| 1 | 2 |\n![i](p.png)")
    assert [x["kind"] for x in b] == ["heading", "paragraph", "heading", "code", "list_item", "list_item", "quote", "table", "paragraph"]
    assert b[3]["text"] == "x = 1\n\n# no heading" and b[3]["section"] == ["Top", "Sub"] and b[1]["links"] == ["http://x"] and b[8]["images"] == ["p.png"]


def test_html():
    page = "<html><head><title>T &amp; U</title></head><body><nav><p>menu</p></nav><h1>A</h1><p>one <b>two</b> <a href='/l'>l</a><h2>B</h2><ul><li>x<li>y</ul><pre>k  =\n 1</pre><script>no()</script>tail</body></html>"
    b = bl.html_blocks(page)
    assert [(x["kind"], x["text"]) for x in b] == [("heading", "A"), ("paragraph", "one two l"), ("heading", "B"), ("list_item", "x"), ("list_item", "y"), ("code", "k  =\n 1"), ("paragraph", "tail")]
    assert b[1]["links"] == ["/l"] and b[3]["section"] == ["A", "B"] and bl.html_title(page) == "T & U" and bl.html_blocks("") == []


def test_notebooks():
    nb = json.dumps({"cells": [{"cell_type": "markdown", "source": ["# T\n", "text"]}, {"cell_type": "code", "source": "x = 1"}, {"cell_type": "raw", "source": "z"}]})
    assert [x["kind"] for x in bl.notebook_blocks(nb)] == ["heading", "paragraph", "code"] and bl.notebook_blocks("no json") == []


def test_blocks_as_rows(spark):
    df = spark.createDataFrame([(1, "# A\n\np"), (2, None)], "k bigint, t string")
    rows = bl.blocks(df, "k", "t", "md").orderBy("n").collect()
    assert [(r["k"], r["n"], r["kind"], r["section"]) for r in rows] == [(1, 0, "heading", []), (1, 1, "paragraph", ["A"])]
    assert [tuple(r) for r in ch.section_paths(bl.blocks(df, "k", "t", "md"), "k").collect()] == [(1, 1, "A")]


def test_captions_and_segments(spark):
    cues = bl.captions(spark.createDataFrame([("v", VTT), ("j", json.dumps([{"start": 0, "end": 1, "text": "x"}]))], "k string, t string"), "k", "t")
    v = cues.where("k = 'v'")
    assert [(r["start"], r["text"]) for r in v.orderBy("n").collect()] == [(0.0, "Hello and welcome"), (4.0, "to the course"), (30.0, "Second part")]
    assert [r["start"] for r in ch.segments(v, "k").orderBy("segment").collect()] == [0.0, 30.0]
    assert "00:00:04.000 --> 00:00:09.500" in bl.webvtt(v, "k").first()["vtt"]
    srt = "1\n00:00:01,000 --> 00:00:02,500\nA\n\n2\n00:00:02,600 --> 00:00:03,000\nA more\n"
    assert [(c["start"], c["end"], c["text"]) for c in bl.caption_cues(srt)] == [(1.0, 3.0, "A more")]


def test_windows_keep_to_the_budget():
    text = " ".join(f"word{k}." for k in range(40))
    parts = ch.windows(text, most=10, overlap=3, least=2)
    assert all(ch.n_tokens(p) <= 10 for p in parts) and parts[0].split()[-1] in parts[1] and " ".join(parts).split()[-1] == "word39."
    assert ch.parents(["a " * 300, "b " * 300, "c"], ["", "", "x"]) == [0, 1, 2]
    assert ch.windows("") == []


def test_chunks(spark):
    text = "\n\n".join(" ".join(f"Sentence {k} of paragraph {p} goes on for a while." for k in range(30)) for p in range(3))
    rows = ch.chunks(spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string")).collect()
    assert {r["doc_id"] for r in rows} == {1} and max(r["n_tokens"] for r in rows) <= 180 and max(r["parent"] for r in rows) >= 1


def test_paragraph_offsets(spark):
    rows = bl.plain_paragraphs(spark.createDataFrame([(1, "ab\n\ncde\n\n \n\nf")], "doc_id bigint, text string")).orderBy("n").collect()
    assert [(r["text"], r["char_start"], r["char_end"]) for r in rows] == [("ab", 0, 2), ("cde", 4, 7), ("f", 12, 13)]


def test_mining(spark):
    pages = spark.createDataFrame([(1, 1, "HEADER\na"), (1, 2, "HEADER\nb"), (1, 3, "HEADER\nc")], "doc int, page int, text string")
    assert [r["line"] for r in mn.repeated_lines(pages, "doc", "page").collect()] == ["HEADER"]
    docs = spark.createDataFrame([(1, "Figure 3: The loss falls quickly here. Table 2. Short. neural network"), (2, "neural network and neural networks")], "doc_id bigint, text string")
    assert [(r["kind"], r["number"], r["caption"]) for r in mn.figures(docs).collect()] == [("figure", "3", "The loss falls quickly here")]
    lexicon = spark.createDataFrame([("neural network", "nn"), ("loss", "loss")], "alias string, concept string")
    assert {tuple(r) for r in mn.aliases(docs, lexicon).collect()} == {(1, "nn", 1), (1, "loss", 1), (2, "nn", 1)}
    assert [r["word"] for r in mn.keywords(docs, 1).orderBy("doc_id").collect()] == ["figure", "neural"]
