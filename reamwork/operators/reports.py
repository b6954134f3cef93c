"""Result reports: error isolation, size reduction, run totals, routing by size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binary import INLINE_BYTES
from .sequence import Outcome

REPORT_COLUMNS = ["op", "path", "success", "error", "rows", "bytes"]


def safe_convert(df: DataFrame, converted: Column, error: Column, out: str = "converted") -> Outcome:
    """Split rows by outcome. ``converted`` must not raise (try_ functions, PERMISSIVE parsing or a
    UDF with an error field); a row is bad when ``error`` is not null. Both sides are filters over
    one projection, so no shuffle is added."""
    done = df.withColumn(out, converted).withColumn("error", error)
    return Outcome(done.filter(F.col("error").isNull()).drop("error"), done.filter(F.col("error").isNotNull()))


def report_rows(
    df: DataFrame, op: str | Column, path: str | Column, error: Column, rows: Column | int = 1,
    size: Column | int = 0,
) -> DataFrame:
    """One report row per input, whether it went well or not."""
    path = F.col(path) if isinstance(path, str) else path
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    ok = error.isNull()
    return df.select(
        (op if isinstance(op, Column) else F.lit(op)).alias("op"), path.cast("string").alias("path"), ok.alias("success"), error.alias("error"),
        F.when(ok, as_col(rows)).otherwise(0).cast("bigint").alias("rows"),
        F.when(ok, as_col(size)).otherwise(0).cast("bigint").alias("bytes"),
    )


def conversion_totals(report: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals per operation from report rows."""
    return report.groupBy(*(by or ["op"])).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum(F.when(F.col("success"), 1).otherwise(0)).alias("succeeded"),
        F.sum(F.when(F.col("success"), 0).otherwise(1)).alias("failed"),
        F.sum("rows").alias("rows"),
        F.sum("bytes").alias("bytes"),
    )


def reduction_percent(before: Column, after: Column) -> Column:
    return F.when(before > 0, F.round((1 - after / before) * 100, 1)).otherwise(0.0)


def size_reduction(before: DataFrame, after: DataFrame, keys: list[str], size: str = "bytes") -> DataFrame:
    """Total size before and after, and the reduction in percent, of the keys that both sides have. One aggregate over both
    sides together, with partial sums, in place of an aggregate each and a join."""
    old, new = "original_size_bytes", "compressed_size_bytes"
    sides = before.select(*keys, F.col(size).alias(old), F.lit(1).alias("__old")).unionByName(
        after.select(*keys, F.col(size).alias(new), F.lit(1).alias("__new")), allowMissingColumns=True)
    sums = sides.groupBy(*keys).agg(
        F.sum(old).alias(old), F.sum(new).alias(new), F.count("__old").alias("__old"), F.count("__new").alias("__new"))
    both = sums.filter("__old > 0 AND __new > 0").drop("__old", "__new")
    return both.withColumn("size_reduction_percent", reduction_percent(F.col(old), F.col(new)))


def route_by_size(df: DataFrame, size: Column, limit: int = INLINE_BYTES) -> Outcome:
    """Rows small enough to be returned inline, and rows to be saved."""
    return Outcome(df.filter(size < limit), df.filter(size >= limit))
