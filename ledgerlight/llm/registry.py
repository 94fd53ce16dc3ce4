"""Queries of the subpackage over one directory of the given tables, and the SQL they are checked with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (
    byte_bpe,
    decontamination,
    jaccard_join,
    licenses,
    merkle,
    quality,
    recompression,
    revisits,
    secret_scan,
    token_files,
    top_k,
    toxicity,
    whitening,
)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql:
            SQL[name] = sql
        return build

    return register


@query("op1_token_files")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), added_tokens=True)


@query("op2_license_scan", licenses.oracle())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op3_quality_scores")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_secret_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@query("op5_decontamination")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_top_k", top_k.ORACLE)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.search(table(spark, sf_dir, "embeddings"))


@query("op7_revisits", revisits.ORACLE)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisits.listed(revisits.resolve(revisits.crawl_log(table(spark, sf_dir, "pages"))))


@query("op8_toxicity_scores")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_jaccard_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


@query("op10_byte_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query("op11_merkle_manifest", merkle.ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))


@query("op12_substring_dedup", recompression.ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.dedup(table(spark, sf_dir, "documents"))


@query("op13_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
