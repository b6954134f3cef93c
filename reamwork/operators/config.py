"""Configuration corpora: INI and .env text to rows, rows to nested documents."""

from __future__ import annotations

import functools
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from .ordered import amount_before

_FOLD = "\x01"  # stands for the line break inside a folded value


def _ini_block(block: Column) -> Column:
    """One section block as STRUCT<section, entries ARRAY<STRUCT<key, value>>>."""
    section = F.regexp_extract(block, r"^\[([^\n]+)\]", 1)
    body = F.regexp_replace(block, r"^\[[^\n]+\][^\n]*", "")
    # Continuation lines are indented more than the first option of the section.
    indent = F.length(F.regexp_extract(body, r"^(?:[ \t]*\n)*([ \t]*)\S", 1))
    deeper = F.concat(F.lit("\n(?=(?:[ \t]*\n)*[ \t]{"), (indent + 1).cast("string"), F.lit(r",}\S)"))
    folded = F.when(
        F.regexp_like(body, F.lit(r"\n[ \t]+\S")), F.regexp_replace(body, deeper, F.lit(_FOLD))
    ).otherwise(body)
    entries = F.filter(F.split(folded, "\n"), lambda e: strip(e) != "")

    def entry(e: Column) -> Column:
        split_at = r"(?s)^\s*([^=:\n\x01]*?)\s*[=:](.*)$"
        raw = F.regexp_extract(e, split_at, 2)
        folds = F.rtrim(F.array_join(F.transform(F.split(raw, _FOLD), strip), "\n"), F.lit("\n"))
        return F.struct(
            F.lower(F.regexp_extract(e, split_at, 1)).alias("key"),
            F.when(e.contains(_FOLD), folds).otherwise(strip(raw)).alias("value"),
        )

    return F.struct(section.alias("section"), F.transform(entries, entry).alias("entries"))


def ini_sections(files: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """INI texts to (keys, __listed, __defaults, error), inside the row; :func:`ini_entries` makes
    the entries of it.

    Sections in brackets, ``=`` or ``:`` between key and value, ``#`` and ``;`` comment lines,
    indented continuation lines, lower-cased keys, DEFAULT merged into every section and not
    listed. Duplicate sections or keys, lines before the first section and lines without a
    delimiter make the file an error with no entries. Values are not interpolated.

    The steps are projections of their own, so each is computed once per file and not once per use.
    """
    text = F.regexp_replace(F.regexp_replace(value, "^\ufeff", ""), "\r\n?", "\n")
    text = F.regexp_replace(text, r"(?md)^[ \t]*[#;].*$", "")
    blocks = F.split(text, r"(?md)^(?=\[[^\n]+\])")
    parsed = files.select(*keys, F.transform(blocks, _ini_block).alias("__blocks"))
    named = parsed.select(
        *keys, "__blocks",
        F.filter("__blocks", lambda b: ~b["section"].isin("", "DEFAULT")).alias("__listed"),
        F.flatten(F.transform(
            F.filter("__blocks", lambda b: b["section"] == "DEFAULT"), lambda b: b["entries"]
        )).alias("__defaults"),
    )

    def keys_of(entries: Column) -> Column:
        return F.transform(entries, lambda e: e["key"])

    names = F.transform("__listed", lambda b: b["section"])
    headless = F.exists("__blocks", lambda b: (b["section"] == "") & (F.size(b["entries"]) > 0))
    no_key = F.exists("__blocks", lambda b: F.exists(b["entries"], lambda e: e["key"] == ""))
    same_key = F.exists(
        "__blocks", lambda b: F.size(F.array_distinct(keys_of(b["entries"]))) < F.size(b["entries"])
    )
    error = (
        F.when(headless, "file contains no section headers")
        .when(no_key, "source contains parsing errors")
        .when(F.size(F.array_distinct(names)) < F.size(names), "section already exists")
        .when(same_key, "option already exists")
    )
    return named.select(*keys, "__listed", "__defaults", error.alias("error"))


def ini_entries() -> Column:
    """ARRAY<STRUCT<section, key, value>> from the columns of :func:`ini_sections`; null for a
    broken file. Unnest this expression itself: unnesting a column computed before would make the
    optimizer check its size in a filter of its own, and parse every file again for that."""

    def rows(b: Column) -> Column:
        own = F.transform(b["entries"], lambda e: e["key"])
        inherited = F.filter("__defaults", lambda d: ~F.array_contains(own, d["key"]))
        merged = F.when(F.size("__defaults") == 0, b["entries"]).otherwise(F.concat(b["entries"], inherited))
        return F.transform(
            merged,
            lambda e: F.struct(b["section"].alias("section"), e["key"].alias("key"), e["value"].alias("value")),
        )

    return F.when(F.col("error").isNull(), F.flatten(F.transform("__listed", rows)))


def ini_json() -> Column:
    """The nested JSON document of one INI file, from the columns of :func:`ini_sections`, without a
    shuffle: a file that was read as one row is rendered as one row."""

    def pairs(entries: Column) -> Column:
        return F.transform(entries, lambda e: F.struct(e["key"], e["value"]))

    def section(b: Column) -> Column:
        own = F.transform(b["entries"], lambda e: e["key"])
        inherited = F.filter("__defaults", lambda d: ~F.array_contains(own, d["key"]))
        return F.struct(b["section"], F.map_from_entries(F.concat(pairs(b["entries"]), pairs(inherited))))

    whole = F.to_json(F.map_from_entries(F.transform("__listed", section)))
    return F.when(F.col("error").isNull(), whole)


def env_entries(value: Column) -> Column:
    """ARRAY<STRUCT<key, value>> of one .env text: blank and # lines skipped, split on the first
    ``=``, double then single quotes stripped."""
    kept = F.filter(
        F.transform(F.split(value, "\r?\n"), strip), lambda x: ~x.startswith("#") & x.contains("=")
    )

    def entry(x: Column) -> Column:
        at = F.instr(x, F.lit("="))
        raw = strip(F.substr(x, at + 1))
        bare = F.trim(F.trim(raw, F.lit('"')), F.lit("'"))
        return F.struct(strip(F.substr(x, F.lit(1), at - 1)).alias("key"), bare.alias("value"))

    return F.transform(kept, entry)


def nest_keys(
    rows: DataFrame, doc: list[str], max_keys: int = 100_000, section: str = "section",
    key: str = "key", value: str = "value", pos: str | None = None,
) -> DataFrame:
    """Tall (section, key, value) rows to one nested JSON document per file.

    A document holds ``max_keys`` keys at most; the keys of a file are counted in the order of their hashes, and a new part begins wherever that many
    have piled up. The deep merge of a file's parts is the whole; most files are part 0 alone.
    Of a key that a section repeats the row with the highest ``pos`` stands (without ``pos`` the greatest
    value), by a partial aggregate. Adds ``sections`` and ``keys`` per part.
    """
    stands = F.max(value) if pos is None else F.max_by(value, pos)
    rows = rows.groupBy(*doc, section, key).agg(stands.alias(value))
    counted = amount_before(rows, doc, [section, key], F.lit(1).cast("bigint"), "__piled")
    per_section = (
        counted.withColumn("part_no", F.floor(F.col("__piled") / max_keys).cast("bigint"))
        .groupBy(*doc, "part_no", section)
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias("__pairs"))
    )
    per_doc = per_section.groupBy(*doc, "part_no").agg(
        F.array_sort(
            F.collect_list(F.struct(F.col(section).alias("s"), F.map_entries("__pairs").alias("p")))
        ).alias("__docs")
    )
    nested = F.map_from_entries(
        F.transform("__docs", lambda d: F.struct(d["s"], F.map_from_entries(d["p"])))
    )
    return per_doc.select(
        *doc, "part_no", F.to_json(nested).alias("json"),
        F.size("__docs").cast("bigint").alias("sections"),
        F.aggregate("__docs", F.lit(0).cast("bigint"), lambda n, d: n + F.size(d["p"])).alias("keys"),
    )


def flat_document(
    rows: DataFrame, doc: list[str], max_keys: int = 100_000, key: str = "key", value: str = "value"
) -> DataFrame:
    """Flat (key, value) rows to one JSON object per file, spread like :func:`nest_keys`."""
    whole = nest_keys(rows.withColumn("__all", F.lit("")), doc, max_keys, "__all", key, value)
    inner = F.regexp_replace("json", r'^\{"":|\}$', "")
    return whole.select(*doc, "part_no", inner.alias("json"), "keys")


def flat_yaml(entries: Column) -> Column:
    """ARRAY<STRUCT<key, value>> of plain words to YAML lines in key order, inside the JVM.

    Only for values YAML reads back as the same string; anything else goes through
    :func:`render_config`, which quotes where needed.
    """
    lines = F.transform(
        F.array_sort(entries), lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit("\n"))
    )
    return F.array_join(lines, "")


def _toml_scalar(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False).replace("\x7f", "\\u007f")
    if isinstance(value, list):
        return "[ " + ", ".join(_toml_scalar(v) for v in value) + ",]" if value else "[]"
    if isinstance(value, dict):
        return "{ " + ", ".join(f"{_toml_key(k)} = {_toml_scalar(v)}" for k, v in value.items()) + " }"
    return str(value)


def _toml_key(key) -> str:
    key = str(key)
    bare = key and all(c.isascii() and (c.isalnum() or c in "-_") for c in key)
    return key if bare else json.dumps(key, ensure_ascii=False)


def _is_tables(value) -> bool:
    return isinstance(value, list) and bool(value) and all(isinstance(v, dict) for v in value)


def _toml_lines(table: dict, path: str = "") -> list[str]:
    out = [
        f"{_toml_key(k)} = {_toml_scalar(v)}" for k, v in table.items()
        if v is not None and not isinstance(v, dict) and not _is_tables(v)
    ]
    for k, v in table.items():
        name = f"{path}.{_toml_key(k)}" if path else _toml_key(k)
        if isinstance(v, dict):
            out += ["", f"[{name}]", *_toml_lines(v, name)]
        elif _is_tables(v):
            for item in v:
                out += ["", f"[[{name}]]", *_toml_lines(item, name)]
    return out


# Texts that need no more than plain or single quoted style, and how long a key can be to stand before a colon.
_YAML_WORD = re.compile(r"[A-Za-z0-9_][A-Za-z0-9_.]*")
_YAML_KEY = 100


@functools.lru_cache(65_536)
def _yaml_word(text: str) -> str | None:
    """A word as YAML writes it, quoted where it would be read as something else; none for any other text."""
    import yaml

    if not _YAML_WORD.fullmatch(text):
        return None
    kinds = yaml.SafeDumper.yaml_implicit_resolvers
    other = any(pattern.match(text) for _, pattern in kinds.get(text[0], []) + kinds.get(None, []))
    return f"'{text}'" if other else text


def _yaml_dump(value) -> str:
    import yaml

    dumper = getattr(yaml, "CSafeDumper", yaml.SafeDumper)
    return yaml.dump(value, Dumper=dumper, allow_unicode=True, default_flow_style=False)


@functools.lru_cache(4_096)
def _yaml_pair(key: str, value: str, depth: int) -> str:
    """The lines of one pair within so many mappings, as the library writes them."""
    whole = {key: value}
    for _ in range(depth):
        whole = {"x": whole}
    return "\n".join(_yaml_dump(whole).split("\n")[depth:])


def _yaml_lines(table: dict, depth: int = 0, left: int = 2) -> tuple[list[str], int] | None:
    """Mappings of texts, line by line: the same as :func:`_yaml_dump` in a fraction of its time.

    Words are written here, other texts by the library, a pair at a time; none where there are more than ``left`` of these or values of other kinds.
    """
    out = []
    for key in sorted(table):
        value, name = table[key], _yaml_word(key)
        if name is None or len(key) > _YAML_KEY:
            return None
        if type(value) is dict and value:
            inner = _yaml_lines(value, depth + 1, left)
            if inner is None:
                return None
            out += ["  " * depth, name, ":\n", *inner[0]]
            left = inner[1]
        elif type(value) is str:
            word = _yaml_word(value)
            if word is not None:
                out += ["  " * depth, name, ": ", word, "\n"]
                continue
            left -= 1
            if left < 0:
                return None
            out.append(_yaml_pair(key, value, depth))
        else:
            return None
    return out, left


def _render(text: str | None, fmt: str) -> tuple[str | None, str | None]:
    import yaml

    try:
        value = json.loads(text)
        if fmt == "yaml":
            lines = _yaml_lines(value) if type(value) is dict and value else None
            return "".join(lines[0]) if lines else _yaml_dump(value), None
        if isinstance(value, list):
            value = {"items": value}
        if not isinstance(value, dict):
            raise ValueError("TOML needs a table at the top level")
        return "\n".join(_toml_lines(value)).lstrip("\n") + "\n", None
    except (ValueError, TypeError, yaml.YAMLError) as problem:
        return None, str(problem)


def render_config(json_text: Column, fmt: str) -> Column:
    """JSON text to YAML (sorted keys, block style) or TOML: STRUCT<text, error>.

    A list at the top of a TOML document is wrapped under ``items``; nulls, which TOML lacks, are
    left out.
    """
    if fmt not in ("yaml", "toml"):
        raise ValueError(f"unknown config format {fmt}")

    @F.pandas_udf(T.StructType().add("text", "string").add("error", "string"))
    def render(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_render(t, fmt) for t in texts], columns=["text", "error"])

    return render(json_text)

