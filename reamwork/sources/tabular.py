"""Tabular and record sources: CSV, JSON, JSON Lines, XML, Parquet."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import quoted, strip
from ..operators.records import union_records
from ..operators.sequence import Outcome
from ..session import scratch_dir, settle
from .splits import csv_records, json_elements

# Cell texts read as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# Cell texts read as booleans.
TRUE_TOKENS, FALSE_TOKENS = ["True", "TRUE", "true"], ["False", "FALSE", "false"]

_WHOLE = r"^\s*[+-]?\d{1,19}\s*$"
_NUMBER = r"(?i)^\s*[+-]?(?:\d+\.?\d*(?:e[+-]?\d+)?|\.\d+(?:e[+-]?\d+)?|inf|infinity)\s*$"


def _na_to_null(name: str) -> Column:
    col = F.col(quoted(name))
    return F.when(~col.isin(*NA_TOKENS), col).alias(name)


def _bool(col: Column) -> Column:
    return F.when(col.isin(*TRUE_TOKENS), True).when(col.isin(*FALSE_TOKENS), False)


def infer_types(df: DataFrame) -> T.StructType:
    """Types of all-text columns from one aggregate over all rows: whole numbers, numbers,
    booleans, else text. The single result row holds two counters per column and kind."""
    aggs = []
    for i, c in enumerate(df.columns):
        col = F.col(quoted(c))
        aggs += [
            F.count(col).alias(f"n{i}"),
            # patterns first: a cast that fails is far slower than a pattern that does not match
            F.count(F.when(F.regexp_like(col, F.lit(_WHOLE)), col.try_cast("bigint"))).alias(f"i{i}"),
            F.count(F.when(F.regexp_like(col, F.lit(_NUMBER)), 1)).alias(f"d{i}"),
            F.count(_bool(col)).alias(f"b{i}"),
        ]
    row = df.agg(*aggs).first()
    out = T.StructType()
    for i, c in enumerate(df.columns):
        seen = row[f"n{i}"]
        if not seen:
            kind: T.DataType = T.DoubleType()
        elif row[f"i{i}"] == seen:
            kind = T.LongType()
        elif row[f"d{i}"] == seen:
            kind = T.DoubleType()
        elif row[f"b{i}"] == seen:
            kind = T.BooleanType()
        else:
            kind = T.StringType()
        out.add(c, kind)
    return out


def apply_types(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns to the wanted types; text that does not fit becomes null, never a failed job."""
    cols = []
    for f in schema.fields:
        col = F.col(quoted(f.name))
        value = _bool(col) if isinstance(f.dataType, T.BooleanType) else col.try_cast(f.dataType)
        cols.append(value.alias(f.name))
    return df.select(*cols)


def _csv_texts(spark: SparkSession, path: str, delimiter: str, quoted_newlines: bool) -> DataFrame:
    options = {"sep": delimiter, "quote": '"', "escape": '"'}
    reader = spark.read.options(header=True, enforceSchema=False, multiLine=quoted_newlines, **options)
    raw = reader.csv(path)  # of a file's first record only
    if not quoted_newlines or len(spark.read.text(path).columns) > 1:  # columns from folder names need Spark's own reader
        return raw
    places = ", ".join(f"_c{i} string" for i in range(len(raw.columns)))
    parsed = csv_records(spark, path).filter("text <> ''").select("first", "text", F.from_csv("text", F.lit(places), options).alias("r"))
    head = F.from_csv(F.lit(_csv_line(raw.columns, delimiter)), F.lit(places), options)
    wrong = F.raise_error(F.concat(F.lit("CSV files with different headers: "), F.col("text"), F.lit(" is not "), F.to_csv(head, options)))
    # repeated and empty names are given other ones by the reader, so only the first record that is no data can be wrong
    names = F.transform(F.array(*[F.col(f"r._c{i}") for i in range(len(raw.columns))]), lambda x, i: F.coalesce(x, F.concat(F.lit("_c"), i.cast("string"))))
    plain = F.forall(F.zip_with(names, F.array(*[F.lit(c) for c in raw.columns]), lambda a, b: F.startswith(b, a)), lambda ok: F.coalesce(ok, F.lit(False)))
    body = parsed.filter(F.when(F.col("first"), F.when(plain, False).otherwise(wrong.cast("boolean"))).otherwise(True))
    return body.select(*[F.col(f"r._c{i}").alias(c) for i, c in enumerate(raw.columns)])


def _csv_line(names: list[str], delimiter: str) -> str:
    return delimiter.join('"' + n.replace('"', '""') + '"' for n in names)


def read_csv(
    spark: SparkSession, path: str, delimiter: str = ",", schema: T.StructType | str | None = None,
    quoted_newlines: bool = True,
) -> DataFrame:
    """Delimited text with a header row; missing-value texts become null.

    Files are split among tasks, also where quoted fields hold line breaks (see :mod:`splits`). ``quoted_newlines=False`` says
    that none does, which saves a pass. Give ``schema`` to spare the aggregate over all rows that finds the types, and
    the table that is written for it.
    """
    raw = _csv_texts(spark, path, delimiter, quoted_newlines)
    raw = raw.select(*[_na_to_null(c) for c in raw.columns])
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if schema is None:
        raw = settle(raw, "csv-texts")
        schema = infer_types(raw)
    return apply_types(raw, schema)


def json_docs(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> Outcome:
    """Records of files holding one JSON array or object each; errors (file, error) of those that are neither.

    Big arrays are cut by all tasks, see :mod:`splits`. Without ``schema`` the elements are written as JSON Lines, from which Spark's
    reader finds the columns. A file whose brackets do not close has no records; in other files, elements that do not parse have an error
    row each.
    """
    done = json_elements(spark, path)
    line = F.regexp_replace("text", r"[\r\n]+", " ")  # JSON has no line breaks inside strings
    broken = done.rows.filter(F.try_parse_json("text").isNull()).select("file", F.lit("not valid JSON").alias("error"))
    if schema is not None:
        kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        good = done.rows.filter(F.try_parse_json("text").isNotNull())
        return Outcome(good.select(F.from_json("text", kind).alias("r")).select("r.*"), done.errors.unionByName(broken))
    lines = settle(done.rows.select("file", line.alias("value"), F.try_parse_json("text").isNotNull().alias("ok")), "json-lines")
    folder = scratch_dir(spark, "json-lines")
    lines.filter("ok").select("value").write.text(folder)
    errors = lines.filter("not ok").select("file", F.lit("not valid JSON").alias("error"))
    return Outcome(spark.read.json(folder), done.errors.unionByName(errors))


def read_json_docs(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """The records of :func:`json_docs`: files holding one JSON array or object each; an object alone is one record."""
    return json_docs(spark, path, schema).rows


def json_variant_rows(spark: SparkSession, path: str) -> DataFrame:
    """JSON files of unknown shape: (path, pos, record VARIANT), with ``error`` for broken files."""
    docs = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("path"), F.try_parse_json("value").alias("__doc")
    )
    is_list = F.schema_of_variant("__doc").startswith("ARRAY")
    items = F.when(is_list, F.try_variant_get("__doc", "$", "array<variant>")).otherwise(F.array("__doc"))
    error = F.when(F.col("__doc").isNull(), "not valid JSON")
    # a broken file gives one row with a null record
    return docs.select("path", error.alias("error"), F.posexplode_outer(items).alias("pos", "record"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One JSON object per line; blank lines are skipped and lines that do not parse are kept in
    ``_corrupt_record`` when the schema has that column."""
    reader = spark.read.option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(path)


def parse_jsonl(lines: DataFrame, schema: str, line: str = "value") -> DataFrame:
    """Lines that are already a column: blank ones dropped, broken ones in ``_corrupt_record``."""
    wanted = T.StructType.fromDDL(schema).add("_corrupt_record", "string")
    kept = lines.filter(strip(F.col(line)) != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    rest = [c for c in lines.columns if c != line]
    return kept.select(*rest, F.from_json(line, wanted, options).alias("__r")).select(*rest, "__r.*")


def _first_tags(pieces: Iterator[str]) -> tuple[str | None, str | None]:
    """Names of the root and of its first child in XML cut after each ``>``; comments, CDATA, instructions and the document type count for none."""
    root, until = None, None
    for piece in pieces:
        if until is not None:  # inside something that may hold any mark
            if piece.endswith(until):
                until = None
            continue
        at = piece.find("<")
        if at < 0:
            continue
        mark = piece[at + 1:]
        for opening, closing in (("!--", "--"), ("![CDATA[", "]]"), ("?", "?"), ("!DOCTYPE", "]")):
            if mark.startswith(opening):
                inner = mark[len(opening):]
                whole = "[" not in inner if opening == "!DOCTYPE" else inner.endswith(closing)
                until = None if whole or inner.rstrip().endswith(closing) else closing
                break
        else:
            if mark.startswith("/"):
                return root, None
            words = mark.split(None, 1)
            name = words[0].rstrip("/").rpartition(":")[2] if words else ""
            if root is not None:
                return root, name
            root = name
            if mark.endswith("/"):
                return root, None
    return root, None


# So many files are looked at for their columns without a pass over their shapes.
SHAPED_FILES = 100

# Fixed value: what an XML file without records gives.
NO_RECORDS = "XML root has no children to flatten into rows."


def record_tags(spark: SparkSession, path: str) -> DataFrame:
    """The inventory of an XML corpus: (file, tag, error), the tag being the local name of the root's first child.

    Files of any size: only the part of a file before its second split is looked at, tag by tag and only up to the child.
    Files without a single byte are no input to Spark's readers and have no row.
    """
    import pyarrow as pa

    file = _uri_path().alias("file")
    pieces = spark.read.option("lineSep", ">").option("recursiveFileLookup", True).text(path).select(
        file, "value", F.col("_metadata.file_block_start").alias("at")).filter("at = 0").select("file", "value")

    def first_tags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[str, str]]:
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())

        for file, own in itertools.groupby(rows(), key=lambda r: r[0]):
            root, tag = _first_tags(value for _, value in own)
            error = None if tag else NO_RECORDS if root else "not an XML document"
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.string()) for v in (file, tag, error)], ["file", "tag", "error"])

    return pieces.mapInArrow(first_tags, "file string, tag string, error string")


def _own_text(col: Column, kind: T.DataType) -> Column:
    """Text of a child element: the last one of a repeated child, and of a child with attributes or
    children of its own the text before the first of these."""
    if isinstance(kind, T.ArrayType):
        return _own_text(F.try_element_at(col, F.lit(-1)), kind.elementType)
    if not isinstance(kind, T.StructType):
        return strip(col.cast("string"))
    inner = F.lit("")
    if "_text" in kind.names:
        text = col["_text"]
        inner = F.try_element_at(text, F.lit(1)) if isinstance(kind["_text"].dataType, T.ArrayType) else text
    return F.when(col.isNotNull(), strip(F.coalesce(inner, F.lit(""))))


def _uri_path() -> Column:
    """The path of a row's file, which comes as a URI."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _as_patterns(files: list[str]) -> list[str]:
    """Names as the reader takes them, which are patterns to it."""
    return [re.sub(r"([\[\]{}*?\\])", r"\\\1", f) for f in files]


# The types of a variant that are one plain text to a reader that infers none.
_PLAIN = r"\b(?:BOOLEAN|BIGINT|DOUBLE|STRING|DECIMAL\(\d+,\s*\d+\)|DATE|TIMESTAMP(?:_NTZ)?)\b"


def _shape_files(reader: DataFrameReader, files: list[str]) -> list[str]:
    """Files with every shape that a child or an attribute has in any of the files: one for each name and shape.

    The reader finds the columns of a list of files in a time that grows with the square of its length, as every file is read along with the
    whole list; from these few it finds the same ones.
    """
    found = reader.option("singleVariantColumn", "record").load(files).select("record", _uri_path().alias("file"))
    whole = F.struct(F.lit(None).cast("string").alias("name"), F.schema_of_variant("record").alias("shape"))
    fields = F.transform(
        F.map_entries(F.try_variant_get("record", "$", "map<string, variant>")),
        lambda e: F.struct(e["key"].alias("name"), F.schema_of_variant(e["value"]).alias("shape")))
    shapes = found.select("file", F.explode(F.coalesce(fields, F.array(whole))).alias("s"))
    plain = F.regexp_replace("s.shape", _PLAIN, "STRING")
    kept = shapes.groupBy("s.name", plain.alias("shape")).agg(F.min("file").alias("file")).select("file").distinct().orderBy("file")
    return [r["file"] for r in kept.toLocalIterator()]


def _tagged_records(spark: SparkSession, paths: str | list[str], record_tag: str, schema: str | None) -> DataFrame:
    mark = "@"

    def reader() -> DataFrameReader:
        return (
            spark.read.format("xml").option("rowTag", record_tag)
            .option("attributePrefix", mark).option("valueTag", "_text").option("inferSchema", False)
            .option("ignoreNamespace", True)
        )

    if schema:
        wanted = T.StructType.fromDDL(schema)
        both = T.StructType(wanted.fields + [T.StructField(mark + f.name, T.StringType()) for f in wanted])
        raw = reader().schema(both).load(paths)
    elif isinstance(paths, list) and len(paths) > SHAPED_FILES:
        shaped = _shape_files(reader(), paths)
        raw = reader().schema(reader().load(_as_patterns(shaped)).schema).load(paths) if shaped else reader().load(paths)
    else:
        raw = reader().load(paths)
    have = {f.name: f.dataType for f in raw.schema.fields if f.name != "_text"}
    names = list(dict.fromkeys(n.removeprefix(mark) for n in have))
    cols = []
    for n in names:
        found = [_own_text(F.col(quoted(c)), have[c]) for c in (n, mark + n) if c in have]
        cols.append(F.coalesce(*found).alias(n))
    return raw.select(*cols)


def xml_corpus_records(spark: SparkSession, path: str, schema: str | None = None) -> Outcome:
    """Records of a corpus of XML files, each by the tag of its own root's first child; errors (file, error).

    One splittable read for every distinct tag, over its files only; the columns of all reads together, by name. The list of a
    tag's files goes to the reader, which lists the files it reads in any case.
    """
    tags = settle(record_tags(spark, path), "xml-tags")
    errors = tags.filter("error is not null").select("file", "error")
    good = tags.filter("tag is not null")
    reads = []
    for tag in [r["tag"] for r in good.select("tag").distinct().orderBy("tag").toLocalIterator()]:
        files = _as_patterns([r["file"] for r in good.filter(F.col("tag") == tag).select("file").orderBy("file").toLocalIterator()])
        reads.append(_tagged_records(spark, files, tag, schema))
    if not reads:
        return Outcome(spark.createDataFrame([], T.StructType.fromDDL(schema) if schema else T.StructType()), errors)
    return Outcome(union_records(*reads), errors)


def read_xml_records(
    spark: SparkSession, path: str, record_tag: str | None = None, schema: str | None = None
) -> DataFrame:
    """Repeating elements as rows of text columns: attributes and the direct children's own text; of
    an attribute and a child with the same name the child stands.

    Files are split at the record tag, so one huge file is read by many tasks. Without a tag each file has its own, see
    :func:`xml_corpus_records`, which also lists the files without records. Give ``schema`` (all
    STRING fields for plain children and attributes) to spare the pass that finds the columns.
    """
    if record_tag is None:
        return xml_corpus_records(spark, path, schema).rows
    return _tagged_records(spark, path, record_tag, schema)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
