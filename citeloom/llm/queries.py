"""The thin opN_ queries of the corpus operators and their DuckDB counterparts."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, line_dedup, mixing, near_dedup, pii, quality, secrets, token_counts, topk
from .common import small_batches, small_reads, table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.expr("vec_id % 20 = 0"), k=20, scale=64)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_reads(spark)
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_chars=10)


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), 512)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(table(spark, sf_dir, "documents"))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def _bounded(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query with Arrow batches that suit small executors and long documents."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": _bounded(op1_secret_scan),
    "op2_top_k": _bounded(op2_top_k),
    "op3_line_dedup": _bounded(op3_line_dedup),
    "op4_source_mix": _bounded(op4_source_mix),
    "op5_token_counts": _bounded(op5_token_counts),
    "op6_quality": _bounded(op6_quality),
    "op7_pii": _bounded(op7_pii),
    "op8_bpe_round_trip": _bounded(op8_bpe_round_trip),
    "op9_exact_dedup": _bounded(op9_exact_dedup),
    "op10_near_dedup": _bounded(op10_near_dedup),
}

ORACLES: dict[str, str] = {
    "op2_top_k": topk.TOPK_SQL,
    "op3_line_dedup": line_dedup.LINES_SQL,
    "op4_source_mix": mixing.MIX_SQL,
    "op9_exact_dedup": exact_dedup.EXACT_SQL,
}
