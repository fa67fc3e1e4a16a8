"""Five stages from raw documents to packed training sequences.

Each stage is a function of (spark, docs, sf_dir) that calls one operator on all its predecessor kept; its
result is written as Parquet and read again for the next.

Defined cases of all stages: rows are judged by their own text, so a doc_id on several rows or without a value changes
nothing for other rows; extra columns, whatever their names, are carried to the last stage but not read; empty tables
pass through; very long texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from namefold.llm import decontaminate, jaccard_join, line_dedup, packing, toxicity
from namefold.llm.common import stored, table
from namefold.llm.queries import word_tokenizer


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below its threshold; null and empty texts have the score of its
    bias, and without labels of both kinds all stay."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the long lines that many of them share; a null text stays null, and a text may become
    empty. Rows without a doc_id are one document, which sorts below all others."""
    return line_dedup.clean(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join: the least doc_id, a row without one only where no
    other is there, of equal ids the least text hash, of equal rows one. Documents without words all stay."""
    return jaccard_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule clears; those without words are clean."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in packed sequences; a null or empty text is a piece of the end id alone."""
    return packing.packed(docs, word_tokenizer()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_common_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: SQL has no factorization machine and no tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
