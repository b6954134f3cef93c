"""Configuration corpora: INI, .env, YAML and TOML files."""

from __future__ import annotations

import datetime
import json
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.config import env_entries, ini_entries, ini_json, ini_sections, render_config
from ..operators.ordered import last_write_wins
from ..operators.sequence import Outcome, where_present


def text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: (path, value)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def read_ini(files: DataFrame, keys: list[str], value: str = "value") -> Outcome:
    """(keys, section, key, value) rows of an INI corpus; broken files come back as errors."""
    parsed = ini_sections(files, keys, value)
    rows = parsed.select(*keys, F.explode(ini_entries()).alias("__e")).select(
        *keys, "__e.section", "__e.key", "__e.value"
    )
    return Outcome(rows, where_present(parsed.select(*keys, "error"), "error"))


def ini_to_json(files: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, json, error), one row per INI file."""
    return ini_sections(files, keys, value).select(*keys, ini_json().alias("json"), "error")


def ini_to_yaml(files: DataFrame, keys: list[str], value: str = "value") -> Outcome:
    """(keys, yaml) per INI file, and (keys, error) of the broken ones."""
    done = ini_to_json(files, keys, value)
    good = where_present(done.select(*keys, "json"), "json")
    rows = good.select(*keys, render_config(F.col("json"), "yaml")["text"].alias("yaml"))
    return Outcome(rows, where_present(done.select(*keys, "error"), "error"))


def read_env(files: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, key, value) rows of a .env corpus; of a repeated key the last line wins."""
    rows = files.select(*keys, F.posexplode(env_entries(F.col(value))).alias("__at", "__e")).select(
        *keys, F.col("__e.key").alias("key"), F.col("__e.value").alias("value"), "__at"
    )
    return last_write_wins(rows, [*keys, "key"], "__at").drop("__at")


def _plain(value):
    if isinstance(value, (datetime.datetime, datetime.date, datetime.time)):
        return value.isoformat()
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, set, tuple)):
        return [_plain(v) for v in value]
    return value


def _leaves(value, at: str = "") -> Iterator[tuple[str, str | None, str]]:
    if isinstance(value, dict) and value:
        for key, inner in value.items():
            yield from _leaves(inner, f"{at}.{key}" if at else str(key))
    elif isinstance(value, list) and value:
        for i, inner in enumerate(value):
            yield from _leaves(inner, f"{at}[{i}]")
    elif isinstance(value, (datetime.datetime, datetime.date)):
        yield at, value.isoformat(), "timestamp" if isinstance(value, datetime.datetime) else "date"
    elif value is None:
        yield at, None, "null"
    else:
        kind = {bool: "boolean", int: "bigint", float: "double", str: "string"}.get(type(value), "json")
        text = value if kind == "string" else json.dumps(_plain(value), ensure_ascii=False)
        yield at, text, kind


def load_config(text: str, fmt: str):
    """(json, leaves, error) of one YAML or TOML text."""
    import yaml

    try:
        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
        value = tomllib.loads(text) if fmt == "toml" else yaml.load(text, Loader=loader)
        leaves = [{"key_path": k, "value": v, "type": t} for k, v, t in _leaves(value)]
        return json.dumps(_plain(value), ensure_ascii=False), leaves, None
    except (yaml.YAMLError, ValueError, RecursionError) as problem:
        return None, None, str(problem)


def parse_config_docs(files: DataFrame, fmt_col: str = "format", value: str = "value", path: str = "path") -> DataFrame:
    """Parse a corpus of YAML and TOML texts: (path, json, leaves, error), one row per file."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = [load_config(v, f) for v, f in zip(frame["value"], frame["format"])]
            yield pd.DataFrame({
                "path": frame["path"], "json": [d[0] for d in done], "leaves": [d[1] for d in done],
                "error": [d[2] for d in done],
            })

    source = files.select(F.col(path).cast("string").alias("path"), F.col(fmt_col).alias("format"),
                          F.col(value).alias("value"))
    return source.mapInPandas(
        batches,
        "path string, json string, leaves array<struct<key_path string, value string, type string>>, error string",
    )


def config_variants(parsed: DataFrame) -> DataFrame:
    return parsed.filter("error is null").select("path", F.parse_json("json").alias("doc"))


def config_leaves(parsed: DataFrame) -> DataFrame:
    """Tall form: one row per leaf (path, key_path, value, type)."""
    return parsed.filter("error is null").select("path", F.explode("leaves").alias("l")).select("path", "l.*")
