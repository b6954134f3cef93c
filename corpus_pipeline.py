"""A corpus pipeline over the table ``documents``.

Five stages, each an operator of ``reamwork.llm`` over all that the stage before it kept: quality rules (documents that
fail go), line dedup (lines of later windows are cut out), n-gram Jaccard join (of each component the document it is
named by stays), benchmark decontamination (documents with a benchmark window go) and byte-level tokens. Every stage
but the last returns the columns of ``documents``; each is written as Parquet and read again by the next.

Nulls, empty texts, ties, repeated rows, empty tables and further columns are treated as the operators' docstrings say.
The id and the text must be called ``doc_id`` and ``text``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reamwork.llm import bpe_codec, decontaminate, jaccard_join, line_dedup, quality_rules
from reamwork.llm.common import table
from reamwork.llm.queries import TOKENIZERS
from reamwork.session import settle


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_first(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(docs, f"{TOKENIZERS}/byte_bpe_50k.json")


STAGES = [
    ("quality_rules", good), ("line_dedup", new_lines), ("jaccard_join", unlike), ("decontaminate", clean), ("bpe_codec", encoded),
]

#: The last stage is byte-pair encoding, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
