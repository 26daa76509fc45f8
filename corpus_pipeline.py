"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, source mixing and
SentencePiece encoding, in this order.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet
and read again as the next stage's ``docs``.  All but the last give the columns of
``documents``.  Documents that the quality rules reject go; lines that are near-duplicates
of earlier ones go, and with them documents that lose all their lines; of each group of
near-duplicate documents the one with the least key stays; the others are replicated by
their sources' target weights; the last stage gives each copy's pieces.

Defined results: documents without ten words, null texts among them, go in the first stage; null
and repeated keys are told apart by their texts in line dedup, and each row is judged by itself in
the document stage (a null key always stays); an empty table gives an empty result; columns
besides the documents' own pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixelloom.llm import jaccard, line_dedup, mixing, pieces, quality
from pixelloom.llm.common import stage, table, unstage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_quality(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", dedup_documents),
    ("source_mixing", mix_sources),
    ("sentencepiece_encoding", encode_pieces),
]

#: Sampled segmentations are not SQL; a test compares the rows with a brute-force version of each
#: stage, on a small table with copies, near copies, junk, null and repeated keys and texts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        after = stage(f(spark, docs, sf_dir), name)
        unstage(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
