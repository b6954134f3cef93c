"""Query registry: a name, the Spark job and the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Job = Callable[[SparkSession, str], DataFrame]
JOBS: dict[str, Job] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Job], Job]:
    def register(job: Job) -> Job:
        if name in JOBS:
            raise ValueError(f"query {name} is registered twice")
        JOBS[name] = job
        if sql is not None:
            SQL[name] = sql
        return job

    return register


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the corpus, with only the named columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    return df


def spread(df: DataFrame) -> DataFrame:
    """Give a table that sits in a few files to all cores before heavy work on each row.

    Where the scan already has as many files as cores - any table of real size - nothing is done.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def several(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """Deal a table to tasks of about ``rows`` rows each, and to all cores at least; costs a count.

    By the columns named, else by the rows' numbers. Both are hashed: a plain repartition sorts all rows of a task first.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    if by:
        return df.repartition(parts, *by)
    return df.withColumn("__at", F.monotonically_increasing_id()).repartition(parts, "__at").drop("__at")
