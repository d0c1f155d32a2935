"""Every operator and stage on empty tables and on nulls, repeated rows and clashing names."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tessera.llm.byte_bpe import decode_ids, encode_texts
from tessera.llm.divergence import judged
from tessera.llm.lm_scoring import language_model_scores
from tessera.llm.minmax import near_duplicates
from tessera.llm.nbsvm import scored, train
from tessera.llm.packing import cut_pieces, pack_pieces
from tessera.llm.personal import all_spans, found_spans
from tessera.llm.substring_dedup import repeated_spans
from tessera.llm.tokens import token_positions, write_tokens
from tessera.llm.transport_stream import parse_media, store_media


def _tokens(df, folder):
    write_tokens(df, folder)
    return token_positions(df.sparkSession, folder)


OPERATORS = {
    "quality": lambda df, _: judged(df),
    "repeats": lambda df, _: repeated_spans(df),
    "tokens": lambda df, folder: _tokens(df, folder),
    "language model": lambda df, _: language_model_scores(df, F.lit(True)),
    "classifier": lambda df, _: scored(df, train(df, df.selectExpr("doc_id", "1 AS quality"))),
    "bpe": lambda df, _: decode_ids(encode_texts(df)),
    "media": lambda df, _: parse_media(store_media(df.select("doc_id", F.col("text").cast("binary").alias("payload")))),
    "personal": lambda df, _: all_spans(found_spans(df)),
    "near": lambda df, _: near_duplicates(df),
    "packing": lambda df, _: pack_pieces(cut_pieces(df)),
}
#: Rows on the odd table: most give one a row; spans have none here; near duplicates one for each doc_id and each null.
ROWS = {"repeats": 0, "near": 5}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(empty, tmp_path, name):
    assert OPERATORS[name](empty, f"{tmp_path.as_uri()}/t").collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_tables(odd, tmp_path, name):
    assert len(OPERATORS[name](odd, f"{tmp_path.as_uri()}/t").collect()) == ROWS.get(name, odd.count())


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, empty, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, empty, "").collect() == []
    out = stage(spark, odd, "")
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == odd.columns
        kept = {"quality rules": 0, "near-duplicate removal": 5}.get(name, 6)
        assert len(out.collect()) == kept
    else:
        assert len(out.collect()) == 6
