"""Arriving work: watch a landing folder, convert each record, report, and set bad ones aside."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import strip
from ..operators.ordered import last_write_wins
from ..operators.reports import conversion_totals, report_rows
from ..operators.sequence import Outcome
from ..session import settle
from ..sources import office

Converter = Callable[[DataFrame], DataFrame]


def watch_text(spark: SparkSession, landing: str, max_files: int = 1_000) -> DataFrame:
    """Lines of new files as a stream: (path, value), blank lines left out."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(landing)
    named = lines.select(F.col("_metadata.file_path").alias("path"), "value")
    return named.filter(strip(F.col("value")) != "")


def json_lines_converter(schema: str) -> Converter:
    """JSON lines to columns; ``error`` says why a line was set aside."""
    corrupt = "_corrupt_record"

    def convert(lines: DataFrame) -> DataFrame:
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}
        parsed = lines.withColumn("r", F.from_json("value", f"{schema}, {corrupt} string", options))
        error = F.when(F.col(f"r.{corrupt}").isNotNull(), "not valid JSON")
        return parsed.select("path", "value", "r.*", error.alias("error")).drop(corrupt)

    return convert


def as_they_are(rows: DataFrame) -> DataFrame:
    """The converter of rows that already have ``path``, ``value`` and ``error``, such as those of :func:`watch_csv`."""
    return rows


def stream_convert(
    lines: DataFrame, convert: Converter, out: str, checkpoint: str, fmt: str = "parquet",
    available_now: bool = True,
) -> StreamingQuery:
    """Run ``convert`` - the same DataFrame function a batch job uses - on every micro-batch.

    Good records go to ``out/data``, bad ones to ``out/quarantine`` and one report row per input
    file to ``out/report``. Each batch overwrites the folder named by its id, so a batch repeated
    after a lost driver leaves no record twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        done = convert(batch).persist()
        try:
            here = f"batch={batch_id}"
            good = done.filter("error is null").drop("error", "value", "path")
            good.write.mode("overwrite").format(fmt).save(f"{out}/data/{here}")
            done.filter("error is not null").select("path", "value", "error").write.mode("overwrite").json(
                f"{out}/quarantine/{here}"
            )
            report = report_rows(done, "stream_convert", "path", F.col("error"), 1, F.octet_length("value"))
            conversion_totals(report, ["op", "path"]).write.mode("overwrite").parquet(f"{out}/report/{here}")
        finally:
            done.unpersist()

    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


# ---------------------------------------------------------------------------- whole files

FileConverter = Callable[[DataFrame], Outcome]
_BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def watch_binary(spark: SparkSession, landing: str, glob: str = "*", max_files: int = 1_000) -> DataFrame:
    """New files of a folder as a stream: (path, content), one row per file."""
    files = spark.readStream.format("binaryFile").schema(_BINARY).option("pathGlobFilter", glob).option(
        "maxFilesPerTrigger", max_files).load(landing)
    return files.select("path", "content")


def watch_packed(spark: SparkSession, landing: str, max_files: int = 1_000) -> DataFrame:
    """Files that arrive as rows (path, content) of Parquet tables, as small files should."""
    return spark.readStream.schema("path string, content binary").option("maxFilesPerTrigger", max_files).parquet(landing)


def watch_csv(spark: SparkSession, landing: str, schema: str, delimiter: str = ",", max_files: int = 1_000) -> DataFrame:
    """Rows of new CSV files with a header as a stream: (path, value, columns of ``schema``, error).

    Quoted fields may hold line breaks. A row that does not fit the schema has its text in ``value`` and an error.
    """
    corrupt = "_corrupt_record"
    kind = T.StructType.fromDDL(schema)
    rows = (
        spark.readStream.schema(T.StructType([*kind.fields, T.StructField(corrupt, T.StringType())]))
        .options(header=True, sep=delimiter, quote='"', escape='"', multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord=corrupt)
        .option("maxFilesPerTrigger", max_files).csv(landing)
    )
    error = F.when(F.col(corrupt).isNotNull(), "not a row of the table")
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col(corrupt).alias("value"), *kind.names, error.alias("error"))


def workbook_converter(sheet_name: str | None = None) -> FileConverter:
    """Workbooks to records under the headers of their own sheets."""

    def convert(files: DataFrame) -> Outcome:
        grids = settle(office.sheet_grids(files, sheet_name), "stream-sheets")
        return Outcome(office.sheet_records(grids), grids.filter("error is not null").select("path", "error"))

    return convert


def block_converter(kind: str) -> FileConverter:
    """Word documents (``docx``), slide decks (``pptx``) or e-books (``epub``) to the rows of their batch scans."""
    scan = {"docx": office.docx_blocks, "pptx": office.pptx_text, "epub": office.epub_chapters}[kind]

    def convert(files: DataFrame) -> Outcome:
        return Outcome(scan(files), office.unreadable(files, kind))

    return convert


def stream_files(
    files: DataFrame, convert: FileConverter, out: str, checkpoint: str, fmt: str = "parquet", available_now: bool = True,
) -> StreamingQuery:
    """Run a converter of whole files - the one a batch job uses - on every micro-batch.

    Rows go to ``out/data``, and every input file has one row in ``out/report``: (path, rows, success, error). Each batch
    overwrites the folder named by its id: a batch repeated after a lost driver, or a stream started again from its checkpoint, leaves
    nothing twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, here = batch.sparkSession, f"batch={batch_id}"
        landed = settle(batch, "stream-files")
        done = convert(landed)
        done.rows.write.mode("overwrite").format(fmt).save(f"{out}/data/{here}")
        kept = spark.read.format(fmt).schema(done.rows.schema).load(f"{out}/data/{here}")
        counts = kept.groupBy("path").agg(F.count(F.lit(1)).alias("rows"))
        faults = done.errors.groupBy("path").agg(F.min("error").alias("error"))
        report = landed.select("path").distinct().join(counts, "path", "left").join(faults, "path", "left").select(
            "path", F.coalesce("rows", F.lit(0)).alias("rows"), F.col("error").isNull().alias("success"), "error")
        report.write.mode("overwrite").parquet(f"{out}/report/{here}")

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def latest_records(spark: SparkSession, out: str, keys: list[str], order: list[str] = [], fmt: str = "parquet") -> DataFrame:  # noqa: B006
    """What stands after all batches of a stream: of the rows with equal keys the one of the last batch, and within a batch
    the last by ``order``. An aggregate over the written batches, so a restart needs no state but the folder."""
    rows = spark.read.format(fmt).load(f"{out}/data")
    placed = rows.withColumn("__place", F.struct("batch", *order))
    return last_write_wins(placed, keys, "__place").drop("__place", "batch")


def compact(spark: SparkSession, out: str, keys: list[str], target: str, order: list[str] = [], fmt: str = "parquet") -> None:  # noqa: B006
    """Write :func:`latest_records` as one table."""
    latest_records(spark, out, keys, order, fmt).write.mode("overwrite").format(fmt).save(target)
