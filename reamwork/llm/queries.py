"""The queries of this subpackage: each operator over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_dir
from . import (
    bpe_codec, decontaminate, html_extract, jaccard_join, licenses, line_dedup, lm_scoring, private_data, quality_rules, ranked_search, token_counts,
    warc, whitening,
)
from .common import table

#: Vocabulary files of public tokenizers, on every machine.
TOKENIZERS = "/opt/tokenizers"
TOKEN_LIMIT = 2048

Job = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/word_bpe_49k.json", TOKEN_LIMIT)


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = scratch_dir(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), archives)
    return warc.records(warc.read_archives(spark, archives, payloads=False))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_score(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.private_digest(table(spark, sf_dir, "documents"))


JOBS: dict[str, Job] = {
    f.__name__: f for f in (
        op1_license_scan, op2_bpe_codec, op3_jaccard_join, op4_decontaminate, op5_line_dedup, op6_token_counts, op7_html_extract,
        op8_warc, op9_quality_rules, op10_lm_score, op11_whitening, op12_ranked_search,
        op13_private_data)
}
SQL: dict[str, str] = {
    "op1_license_scan": licenses.ORACLE_SQL,
    "op4_decontaminate": decontaminate.ORACLE_SQL,
    "op5_line_dedup": line_dedup.ORACLE_SQL,
    "op9_quality_rules": quality_rules.ORACLE_SQL,
    "op12_ranked_search": ranked_search.ORACLE_SQL,
}
