"""Records: union of keys, one-level flattening, JSON rendering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import quoted
from .ordered import PART_ROWS, glue_parts


def union_records(*tables: DataFrame) -> DataFrame:
    """All records; columns are the union of the keys, null where a record lacks one."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def flatten_one_level(df: DataFrame) -> DataFrame:
    """Struct fields to dotted columns, arrays and maps to JSON text. Pure projection."""
    out: list[Column] = []
    for f in df.schema.fields:
        col = F.col(quoted(f.name))
        if isinstance(f.dataType, T.StructType):
            for inner in f.dataType.fields:
                value = col.getField(inner.name)
                if isinstance(inner.dataType, (T.StructType, T.ArrayType, T.MapType)):
                    value = F.to_json(value, {"ignoreNullFields": "false"})
                out.append(value.alias(f"{f.name}.{inner.name}"))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
            out.append(F.to_json(col, {"ignoreNullFields": "false"}).alias(f.name))
        else:
            out.append(col)
    return df.select(*out)


def json_records(df: DataFrame, columns: list[str] | None = None, epoch_millis: bool = False) -> Column:
    """One JSON object per row; nulls are kept, timestamps are ISO text or epoch milliseconds."""
    columns = columns or df.columns
    cols = []
    for c in columns:
        dtype = df.schema[c].dataType
        value = F.col(quoted(c))
        if isinstance(dtype, (T.FloatType, T.DoubleType)):
            # NaN is no JSON literal
            value = F.when(~F.isnan(value), value)
        elif epoch_millis and isinstance(dtype, T.TimestampType):
            value = F.unix_millis(value)
        elif epoch_millis and isinstance(dtype, T.TimestampNTZType):
            value = F.unix_millis(F.to_utc_timestamp(value.cast("timestamp"), F.current_timezone()))
        cols.append(value.alias(c))
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def json_array_docs(
    df: DataFrame, group: list[str], pos: str, columns: list[str] | None = None, first: int = 1,
    part_rows: int = PART_ROWS, epoch_millis: bool = False,
) -> DataFrame:
    """One JSON array per group and part. Every part is a valid array; a whole table, which no
    single cell can hold, is written as JSON Lines instead."""
    columns = columns or [c for c in df.columns if c not in group]
    body = glue_parts(
        df, group, pos, json_records(df, columns, epoch_millis), ",", "json", part_rows, first,
        records=F.lit(1),
    )
    return body.withColumn("json", F.concat(F.lit("["), F.col("json"), F.lit("]")))
