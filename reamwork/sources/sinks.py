"""Sinks: every writer is a plain distributed write; counts come from an observation on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import PART_ROWS
from ..operators.records import json_array_docs
from ..operators.tables import markdown_header, markdown_rows, to_html_table


def _counted(df: DataFrame, label: str) -> tuple[DataFrame, Observation]:
    seen = Observation(label)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def write_csv(df: DataFrame, path: str, delimiter: str = ",", mode: str = "errorifexists") -> int:
    """Header, no index, empty text for null. Returns the row count, without a second pass."""
    out, seen = _counted(df, "write_csv")
    (
        out.write.mode(mode).option("header", True).option("sep", delimiter).option("emptyValue", "")
        .option("nullValue", "").option("quote", '"').option("escape", '"').csv(path)
    )
    return seen.get["rows"]


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> int:
    out, seen = _counted(df, "write_jsonl")
    out.write.mode(mode).option("ignoreNullFields", False).json(path)
    return seen.get["rows"]


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", compression: str = "snappy") -> int:
    out, seen = _counted(df, "write_parquet")
    out.write.mode(mode).option("compression", compression).parquet(path)
    return seen.get["rows"]


def write_text(df: DataFrame, path: str, column: str, mode: str = "errorifexists") -> None:
    df.select(F.col(column).alias("value")).write.mode(mode).text(path)


def wrap_xml_arrays(df: DataFrame) -> DataFrame:
    """Arrays as <name><item/>..</name>, the nesting readers of the output expect."""
    cols = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        cols.append(F.struct(col.alias("item")).alias(f.name) if isinstance(f.dataType, T.ArrayType) else col)
    return df.select(*cols)


def write_xml(
    df: DataFrame, path: str, root_tag: str = "root", record_tag: str = "item", mode: str = "errorifexists"
) -> int:
    out, seen = _counted(wrap_xml_arrays(df), "write_xml")
    (
        out.write.mode(mode).format("xml").option("rootTag", root_tag).option("rowTag", record_tag)
        .option("nullValue", "None").save(path)
    )
    return seen.get["rows"]


def write_json_arrays(df: DataFrame, path: str, group: list[str], pos: str, mode: str = "errorifexists") -> None:
    """One JSON array document per group and part, laid out by group."""
    docs = json_array_docs(df, group, pos)
    docs.select(*group, F.col("json").alias("value")).write.mode(mode).partitionBy(*group).text(path)


def write_markdown(df: DataFrame, path: str, null_text: str = "nan", mode: str = "errorifexists") -> None:
    """A table of any size: the header lines in ``header``, the row lines in the files of ``rows``."""
    spark = df.sparkSession
    spark.range(1).select(F.lit(markdown_header(df.columns)).alias("value")).coalesce(1).write.mode(mode).text(
        f"{path}/header"
    )
    df.select(markdown_rows(df, df.columns, null_text).alias("value")).write.mode(mode).text(f"{path}/rows")


def export_tables(
    tables: dict[str, DataFrame], path: str, fmt: str = "csv", mode: str = "errorifexists"
) -> dict[str, int]:
    """A whole catalog in one run: one output folder per table. Returns rows per table."""
    writers = {"csv": write_csv, "json": write_jsonl, "parquet": write_parquet}
    if fmt not in writers:
        raise ValueError(f"Unsupported format '{fmt}'. Choose from {sorted(writers)}")
    for name in tables:
        if not name or name in (".", "..") or "/" in name or "\\" in name or ":" in name:
            raise ValueError(f"table name {name!r} can't be a folder")
    return {name: writers[fmt](df, f"{path}/{name}", mode=mode) for name, df in tables.items()}


def keyed_document(tables: dict[str, tuple[DataFrame, str]], first: int = 0, part_rows: int = PART_ROWS) -> DataFrame:
    """All tables as JSON arrays keyed by table name: (table_name, part_no, json, records).

    ``tables`` maps a name to its DataFrame and position column. Values that JSON lacks become text.
    """
    out = None
    for name, (df, pos) in tables.items():
        odd = (T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)
        plain = df.select(*[
            F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, odd) else F.col(f.name)
            for f in df.schema.fields
        ])
        named = plain.withColumn("table_name", F.lit(name))
        docs = json_array_docs(named, ["table_name"], pos, df.columns, first, part_rows)
        out = docs if out is None else out.unionByName(docs)
    if out is None:
        raise ValueError("no tables given")
    return out


__all__ = [
    "export_tables", "keyed_document", "to_html_table", "wrap_xml_arrays", "write_csv", "write_json_arrays",
    "write_jsonl", "write_markdown", "write_parquet", "write_text", "write_xml",
]
