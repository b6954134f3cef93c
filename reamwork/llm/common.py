"""Column helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a regular expression class and as plain characters.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def boxed(df: DataFrame) -> DataFrame:
    """The whole input row in one struct column, so that no column of the input, whatever its
    name, meets a column that an operator adds."""
    return df.select(F.struct("*").alias("row"))


def field(name: str) -> Column:
    return F.col("row").getField(name)


def unboxed(df: DataFrame, columns: list[str], **replaced: Column) -> DataFrame:
    """The columns of the input again, in their order, some of them replaced."""
    return df.select(*[replaced.get(c, field(c)).alias(c) for c in columns])


def rows_where(df: DataFrame, condition: Column) -> DataFrame:
    """The boxed rows for which a costly condition holds.

    Not a plain filter: the optimizer pushes that below the columns it is computed from and writes their
    expressions out again for every use, which multiplies from column to column.
    """
    kept = df.select(F.explode_outer(F.when(condition, F.array("row"))).alias("row"))
    return kept.filter(F.col("row").isNotNull())


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def first_n(n: Column) -> Column:
    """1..n as an array, empty for n below 1."""
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def text_chunks(df: DataFrame, text: str, target_bytes: int) -> int:
    """How many chunks of about ``target_bytes`` the texts of a table make: one aggregate row."""
    total = df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return max(1, math.ceil(total / target_bytes))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
