"""The corpus operators as registered queries, and their SQL where SQL can say it.

Each query applies its operator, with production parameters, to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import hnsw, jaccard, line_dedup, mixing, pieces, pii, quality, secret_scan, token_files, url_filter
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_counts(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_table(table(spark, sf_dir, "documents")).select("row.doc_id", "n_lines", "n_dropped", "text")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.personal_data(docs, pii.fit(docs))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_table(table(spark, sf_dir, "documents")).drop("rejected_by")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), with_copy=True)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, url_filter.fit(url_filter.labelled_by_terms(pages)))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return hnsw.nearest(vectors, vectors.filter("vec_id % 20 = 0"))


def op10_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_token_counts": op2_token_counts,
    "op3_line_dedup": op3_line_dedup,
    "op4_personal_data": op4_personal_data,
    "op5_quality_rules": op5_quality_rules,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_source_mixing": op7_source_mixing,
    "op8_url_filter": op8_url_filter,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_piece_sampling": op10_piece_sampling,
}
SQL: dict[str, str] = {
    "op3_line_dedup": line_dedup.SQL,
    "op5_quality_rules": quality.SQL,
    "op6_ngram_jaccard": jaccard.SQL,
    "op7_source_mixing": mixing.SQL,
}
