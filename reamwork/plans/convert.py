"""Conversion between data formats, chosen by name or by file extension."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.names import FORMAT_BY_EXT
from ..operators.config import render_config
from ..operators.grids import column_names, records_table
from ..operators.records import flatten_one_level, json_records
from ..session import settle
from ..sources import archives, configs, office, sinks, tabular

# The formats a conversion may name.
FORMATS = ["json", "yaml", "csv", "toml", "xlsx"]
OUTPUT_EXT = {"json": ".json", "yaml": ".yaml", "csv": ".csv", "toml": ".toml"}


def supported_formats() -> dict:
    """Formats and ordered pairs. A workbook can be read but not written."""
    return {
        "formats": FORMATS,
        "conversions": [[a, b] for a in FORMATS for b in FORMATS if a != b],
        "readable": FORMATS,
        "writable": sorted(OUTPUT_EXT),
        "notes": {
            "tables": "A struct becomes one column per field, arrays and deeper structs become JSON text.",
            "toml": "Rows of a table are written as [[items]]; null fields are left out.",
            "xlsx": "Workbooks are read, each under the header of its own sheet, and not written.",
        },
    }


def infer_path_format(path: str) -> str | None:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    dot = name.rfind(".")
    return FORMAT_BY_EXT.get(name[dot:].lower()) if dot > 0 else None


def _documents(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """(path, json, error) of a corpus of JSON, YAML or TOML files."""
    files = configs.text_corpus(spark, path)
    if fmt == "json":
        valid = F.try_parse_json("value").isNotNull()
        return files.select("path", F.when(valid, F.col("value")).alias("json"), F.when(~valid, "not valid JSON").alias("error"))
    return configs.parse_config_docs(files.withColumn("format", F.lit(fmt))).select("path", "json", "error")


def _readable_types(shape: str) -> str:
    """Types of a VARIANT as types of ``from_json``. Only types are rewritten: they stand at the start,
    after a name's colon or after an opening bracket, so a key like ``AVOID_TAX`` stays."""
    shape = re.sub(r"(^|: |<)OBJECT<", r"\1STRUCT<", shape)
    return re.sub(r"(^|: |<)VOID(?=[,>]|$)", r"\1STRING", shape)


def document_records(docs: DataFrame, schema: str | None = None) -> DataFrame:
    """Records of documents, arrays unnested and objects taken whole. Without ``schema`` the common
    shape comes from one aggregate over all records."""
    parsed = docs.filter("error is null").select(F.parse_json("json").alias("doc"))
    is_list = F.schema_of_variant("doc").startswith("ARRAY")
    items = F.when(is_list, F.try_variant_get("doc", "$", "array<variant>")).otherwise(F.array("doc"))
    rows = parsed.select(F.explode(items).alias("record"))
    if schema is None:
        shape = rows.agg(F.schema_of_variant_agg("record").alias("s")).first()["s"]
        schema = _readable_types(shape)
    return rows.select(F.from_json(F.to_json("record"), schema).alias("r")).select("r.*")


def workbooks_table(files: DataFrame, sheet_name: str | None) -> tuple[DataFrame, int, int]:
    """The named sheet of all workbooks (``path``, ``content``) as one table, the columns of all headers together; how many
    workbooks were read and how many not."""
    grids = settle(office.sheet_grids(files, sheet_name), "sheets")
    names = column_names(grids.filter("error is null"), ["path", "sheet_idx"])
    done, failed = grids.select("path", F.col("error").isNull().alias("ok")).distinct().agg(
        F.count_if("ok"), F.count_if(~F.col("ok"))).first()
    text = records_table(office.sheet_records(grids), names)
    if not names:
        return text, done, failed
    text = settle(text, "sheet-records")
    return tabular.apply_types(text, tabular.infer_types(text)), done, failed


def _rendered(data: DataFrame, target: str, path: str, mode: str) -> dict:
    """Rows written as YAML list items or TOML tables; how many were, and how many cannot be."""
    one = F.concat(F.lit("["), json_records(data), F.lit("]"))
    seen = Observation("rendered")
    rows = data.select(render_config(one, target).alias("r")).select("r.text", "r.error").observe(
        seen, F.count("text").alias("done"), F.count("error").alias("failed"))
    sinks.write_text(rows.filter("text is not null"), path, "text", mode)
    found = seen.get
    return {"rows_converted": found["done"], "rows_failed": found["failed"], "success": not found["failed"] or found["done"] > 0}


def convert(
    spark: SparkSession, input_path: str, output_format: str, output_path: str, input_format: str | None = None,
    sheet_name: str = "Sheet1", delimiter: str = ",", schema: str | None = None, mode: str = "errorifexists",
) -> dict:
    """Convert a file or a folder of files of one format; returns the report of the run.

    Tables become one record per line in JSON, list items in YAML and ``[[items]]`` in TOML: the
    part files, one after the other, are the whole document, so a table of any size is written by
    all tasks at once. Documents keep their nesting and are rendered one by one; those that cannot
    be read are left out and counted as failed. Workbooks may have different headers: the table has the
    columns of all of them, by name; a workbook that cannot be read or has no such sheet is counted as failed.
    """
    source = input_format or infer_path_format(input_path)
    if source not in FORMATS:
        return {"success": False, "error": f"Cannot detect input format from '{input_path}'. Specify input_format."}
    target = output_format.lower()
    if target not in OUTPUT_EXT:
        return {"success": False, "error": f"Unsupported output_format '{target}'. Choose from {sorted(OUTPUT_EXT)}"}

    report = {"success": True, "input_path": input_path, "output_path": output_path, "input_format": source,
              "output_format": target}
    if source in ("csv", "xlsx"):
        if source == "csv":
            data = tabular.read_csv(spark, input_path, delimiter, schema)
        else:
            data, done, failed = workbooks_table(archives.binary_corpus(spark, input_path), sheet_name)
            report = {**report, "files": done, "failed": failed}
            if not done or not data.columns:
                return {**report, "success": False, "error": f"No workbook has a header on a sheet named {sheet_name!r}."}
        if target == "csv":
            return {**report, "rows_converted": sinks.write_csv(data, output_path, delimiter, mode)}
        if target == "json":
            return {**report, "rows_converted": sinks.write_jsonl(data, output_path, mode)}
        return {**report, **_rendered(data, target, output_path, mode)}

    docs = _documents(spark, input_path, source)
    if target == "csv":
        flat = flatten_one_level(document_records(docs, schema))
        return {**report, "rows_converted": sinks.write_csv(flat, output_path, delimiter, mode)}
    if target == "json":
        out = docs.select("path", F.col("json").alias("text"), "error")
    else:
        out = docs.select("path", F.col("error").alias("e"), render_config(F.col("json"), target).alias("r")).select(
            "path", "r.text", F.coalesce("e", "r.error").alias("error"))
    out.write.mode(mode).parquet(output_path)
    totals = spark.read.parquet(output_path).agg(
        F.count("text").alias("done"), F.count("error").alias("failed")).first()
    return {**report, "success": totals["done"] > 0, "files": totals["done"], "failed": totals["failed"]}
