"""A pipeline from raw documents to packed training sequences.

Each stage takes the documents that its predecessor kept, with the columns of the table, and applies one operator. Between
stages the documents are written to the shared folder and read again, so a lost executor never costs more than a stage.

Every stage takes empty tables (and gives none), texts of any length, rows that repeat, and further columns, whatever their
names, which it hands on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.divergence import quality_filter
from tessera.llm.minmax import without_near_duplicates
from tessera.llm.packing import cut_pieces, pack_pieces
from tessera.llm.personal import redact
from tessera.llm.shared import documents, stored
from tessera.llm.substring_dedup import remove_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near their language's references. Null and empty texts fail the base rules; a null language is one of its own; equal rows are judged alike."""
    return quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group linked by shingles of five words at similarity 0.8. Null and empty texts link with nothing; of rows that share an id that with the least text stays; rows with a null id all stay."""
    return without_near_duplicates(docs, words=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 20 words or more that also stand earlier (by id, then place; null ids last). A document left empty stays, as an empty text; null texts stay null; rows equal in id and text lose the same words, other rows with one id are different documents."""
    return remove_repeats(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind in angle brackets. Null and empty texts stay as they are; of spans that overlap the first is replaced."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of 2048 ids. A null or empty text is its end id alone; rows that repeat are packed each; ties in length are told apart by id, piece and start."""
    return pack_pieces(cut_pieces(docs))


STAGES = [("quality rules", quality_rules), ("near-duplicate removal", near_dedup), ("substring deduplication", substring_dedup), ("personal data", personal_data), ("best-fit packing", packing)]
#: SQL can't express near-duplicate signatures, trained classifiers or packing; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
