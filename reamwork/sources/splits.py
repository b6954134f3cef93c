"""Records of big single files, cut by all tasks: CSV with line breaks in quotes, and JSON arrays.

A file is read in pieces that end with a separator (a line break, a closing brace), which Spark's text reader finds
in every split on its own. Whether a separator ends a record depends on everything before it: on being
inside quotes, and on the depth of brackets. Both are found in two passes:

* Pass 1 sums each split up for either start, inside quotes and outside, to one row; a window over these rows composes them
  to the true state at the start of every split.
* Pass 2 reads the splits again, each from its true state, and gives the whole records. What a split has of records
  that began before it or end after it are fragments, two a split at most, which are put together in
  the order of the splits. Splits without an open border give none and are not read for them.

The table of states has a row for each split. It is broadcast up to ``BROADCAST_BYTES``; beyond that the pieces are dealt by split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.sequence import Outcome
from ..session import settle

BROADCAST_BYTES = 32 << 20
HEAD, MIDDLE, TAIL, WHOLE = range(4)


def _file() -> Column:
    """The path of a file, which comes as a URI. Decoded at the end only: that costs more than most of a row's other work."""
    return F.url_decode(F.replace(F.col("file"), F.lit("+"), F.lit("%2B"))).alias("file")


def _pieces(spark: SparkSession, path: str, separator: str, odd: Column, outside: Column, inside: Column) -> DataFrame:
    """Pieces in the order of their split: whether the quotes are odd, and the change of depth for either start."""
    read = spark.read.option("lineSep", separator).option("recursiveFileLookup", True).text(path)
    return read.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("_metadata.file_size").alias("file_size"),
        F.monotonically_increasing_id().alias("id"), "value", odd.cast("int").alias("odd"), outside.cast("int").alias("d0"), inside.cast("int").alias("d1"))


def _number_of(text: Column, char: str) -> Column:
    """Of one of the ASCII characters."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(char), F.lit("")))


def _columns(batch, *names: str) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False).astype(np.int64) for n in names]


def _segments(batch) -> Iterator[tuple[tuple[str, int], int, int]]:
    """Runs of rows of one split: (file, start of the split), first row, row after the last."""
    if not batch.num_rows:
        return
    import pyarrow.compute as pc

    files, at = batch.column(0), _columns(batch, "at")[0]
    other = pc.not_equal(files.slice(1), files.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | other]))
    for a, b in zip(new, [*new[1:], batch.num_rows]):
        yield (files[int(a)].as_py(), int(at[a])), int(a), int(b)


def split_states(pieces: DataFrame, closes: bool) -> DataFrame:
    """The state at the start of each split: (file, at, quoted, depth, base, open_start, open_end, last, root), and the file's end (last_quoted, last_depth, file_bytes, file_size).

    ``closes``: the separator is a closing bracket. ``depth`` and ``open_end`` take records to end at depth 0 outside
    quotes, or at depth 1 where the file's first character is an opening bracket. Without brackets all depths are 0, and the
    sums of a split need no order: they are an aggregate.
    """
    import pyarrow as pa

    out = "file string, at bigint, file_size bigint, odd int, d0 bigint, d1 bigint, bytes bigint, root string"

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, row = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip([*key, *row], [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()])],
                ["file", "at", "file_size", "odd", "d0", "d1", "bytes", "root"])

        for batch in batches:
            odd, d0, d1, size, length = _columns(batch, "odd", "d0", "d1", "file_size", "length")
            values = batch.column(batch.schema.get_field_index("start"))
            for k, a, b in _segments(batch):
                if k != key:
                    if key is not None:
                        yield done()
                    key, row = k, [int(size[a]), 0, 0, 0, 0, None]
                sums = []
                for start in (0, 1):  # where pass 1 itself began, and the other case
                    first = row[1] ^ start
                    after = first ^ (np.cumsum(odd[a:b]) & 1)
                    before = after ^ odd[a:b]
                    sums.append(int((np.where(before, d1[a:b], d0[a:b]) - (closes * (after == 0))).sum()))
                row[2] += sums[0]
                row[3] += sums[1]
                row[1] ^= int(odd[a:b].sum() & 1)
                row[4] += int(length[a:b].sum()) + b - a
                if row[5] is None:
                    row[5] = next((v for v in values.slice(a, b - a).to_pylist() if v), None)
        if key is not None:
            yield done()

    length = F.octet_length("value").cast("bigint")
    if closes:
        summed = pieces.select(
            "file", "at", "file_size", "odd", "d0", "d1", length.alias("length"),
            F.substring(strip(F.col("value")), 1, 1).alias("start")).mapInArrow(of_task, out)
    else:
        nothing = F.lit(0).cast("bigint")
        summed = pieces.groupBy("file", "at", "file_size").agg(
            (F.sum("odd") % 2).cast("int").alias("odd"), nothing.alias("d0"), nothing.alias("d1"), F.sum(length + 1).alias("bytes"),
            F.lit(None).cast("string").alias("root"))
    order = Window.partitionBy("file").orderBy("at")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file")
    known = summed.withColumn("quoted", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).withColumn(
        "d", F.when(F.col("quoted") == 1, F.col("d1")).otherwise(F.col("d0"))).withColumn(
        "depth", F.coalesce(F.sum("d").over(before), F.lit(0))).withColumn("root", F.first("root", True).over(
            order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    base = F.when(F.col("root") == "[", 1).otherwise(0) if closes else F.lit(0)
    ended = known.withColumn("base", base).withColumn("end_quoted", (F.col("quoted") + F.col("odd")) % 2).withColumn(
        "end_depth", F.col("depth") + F.col("d")).withColumn("last", F.lead("at").over(order).isNull())
    return ended.select(
        "file", "at", F.col("quoted").cast("int").alias("quoted"), "depth", F.col("base").cast("int").alias("base"), "root",
        ((F.col("at") > 0) & ((F.col("quoted") != 0) | (F.col("depth") != F.col("base")))).alias("open_start"),
        (~F.col("last") & ((F.col("end_quoted") != 0) | (F.col("end_depth") != F.col("base")))).alias("open_end"), "last",
        F.max_by("end_quoted", "at").over(whole).alias("last_quoted"), F.max_by("end_depth", "at").over(whole).alias("last_depth"),
        F.sum("bytes").over(whole).alias("file_bytes"), "file_size")


def _cut(pieces: DataFrame, states: DataFrame, separator: str, closes: bool, small: bool) -> DataFrame:
    """(file, at, kind, first, text) of the whole records and the fragments of splits whose states are given."""
    import pyarrow as pa
    import pyarrow.compute as pc

    names = ["file", "at", "kind", "first", "text"]
    types = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
    closing = separator if closes else ""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, quoted, depth, base, head, held, first, last = None, 0, 0, 0, False, [], False, False

        def row(*values) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*key, *values), types)], names)

        def left() -> pa.RecordBatch:
            return row(MIDDLE if head else WHOLE if last else TAIL, first, separator.join(held))

        for batch in batches:
            odd, quoted_at, last_at = _columns(batch, "odd", "quoted", "last")
            d0, d1, depth_at, base_at = _columns(batch, "d0", "d1", "depth", "base") if closes else [np.zeros_like(odd)] * 4
            values = batch.column(batch.schema.get_field_index("value"))
            for k, a, b in _segments(batch):
                if k != key:
                    if held:
                        yield left()
                    key, quoted, depth, base, held = k, int(quoted_at[a]), int(depth_at[a]), int(base_at[a]), []
                    first, last = k[1] == 0, bool(last_at[a])
                    head = not first and bool(quoted or depth != base)
                after = quoted ^ (np.cumsum(odd[a:b]) & 1)
                depths = depth + np.cumsum(np.where(after ^ odd[a:b], d1[a:b], d0[a:b]) - (closes * (after == 0)))
                ends = np.flatnonzero((after == 0) & (depths == base))
                quoted, depth = int(after[-1]), int(depths[-1])
                texts = values.slice(a, b - a)
                rest = int(ends[-1]) + 1 if len(ends) else 0
                if len(ends):
                    # the pieces of each record as a list, and all lists joined at once
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends + 1]), pa.int32()), texts.slice(0, rest))
                    own = pc.binary_join(lists, separator)
                    if held or head or first:
                        yield row(HEAD if head else WHOLE, first, separator.join([*held, own[0].as_py()]) + closing)
                        held, head, first, own = [], False, False, own.slice(1)
                    if len(own):
                        own = pc.binary_join_element_wise(own, closing, "") if closes else own
                        same = [pa.repeat(pa.scalar(v, t), len(own)) for v, t in zip((*key, WHOLE, False), types)]
                        yield pa.RecordBatch.from_arrays([*same, own.cast(pa.string())], names)
                held += texts.slice(rest).to_pylist()
        if held:
            yield left()

    wanted = pieces.join(F.broadcast(states) if small else states, ["file", "at"]).select(
        "file", "at", "id", "value", "odd", "quoted", "last", *(("d0", "d1", "depth", "base") if closes else ()))
    if not small:  # dealt by split, and out of order
        wanted = wanted.sortWithinPartitions("file", "at", "id")
    return wanted.mapInArrow(of_task, "file string, at bigint, kind int, first boolean, text string")


def records(pieces: DataFrame, states: DataFrame, separator: str, closes: bool, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(file, first, text): the records of the files that have states; ``first`` marks the first of a file."""
    small = (states.agg(F.sum(F.octet_length("file") + 64)).first()[0] or 0) <= broadcast_bytes
    whole = _cut(pieces, states, separator, closes, small).filter(F.col("kind") == WHOLE).select("file", "first", "text")
    open_borders = states.filter("open_start or open_end")
    if not open_borders.take(1):
        return whole
    parts = _cut(pieces, open_borders, separator, closes, small).filter(F.col("kind") != WHOLE)
    order = Window.partitionBy("file").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    numbered = parts.withColumn("record", F.sum((F.col("kind") == TAIL).cast("int")).over(order))
    quoted = separator.replace("\n", "\\n")
    glued = numbered.groupBy("file", "record").agg(
        F.max("first").alias("first"), F.expr(f"listagg(text, '{quoted}') within group (order by at, kind)").alias("text"))
    return whole.unionByName(glued.select("file", "first", "text"))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, first, text): the records of CSV files, line breaks inside quotes kept. A quote is written twice inside quotes."""
    nothing = F.lit(0)
    pieces = _pieces(spark, path, "\n", _number_of(F.col("value"), '"') % 2, nothing, nothing)
    states = settle(split_states(pieces, False), "csv-splits")
    found = records(pieces, states, "\n", False)
    return found.select(_file(), "first", F.when(F.contains("text", F.lit("\r")), F.regexp_replace("text", r"\r$", "")).otherwise(F.col("text")).alias("text"))


def json_elements(spark: SparkSession, path: str) -> Outcome:
    """(file, text) of the elements of JSON files: those of an array, or the one document that a file is; errors (file, error).

    A file whose brackets or quotes do not close has an error and no elements. Elements that are no objects stay together with the next object, or, where
    there is none, with each other, until they are parsed: an array of objects is cut by all tasks, an array of plain values is one cell.
    """
    plain = F.regexp_replace("value", r"(?s)\\.", "")

    def change(text: Column) -> Column:
        bare = F.regexp_replace(text, r'"[^"]*(?:"|$)', "")
        return _number_of(bare, "{") + _number_of(bare, "[") - _number_of(bare, "]")

    pieces = _pieces(spark, path, "}", _number_of(plain, '"') % 2, change(plain), change(F.regexp_replace(plain, r'^[^"]*(?:"|$)', "")))
    states = settle(split_states(pieces, True), "json-splits")
    # a piece counts with a brace behind it; the last of a file may have none
    left = F.col("last_depth") + F.when(F.col("file_bytes") == F.col("file_size") + 1, F.when(F.col("last_quoted") == 0, 1).otherwise(0)).otherwise(0)
    packed = (F.col("file_bytes") < F.col("file_size")) | (F.col("file_bytes") > F.col("file_size") + 1)
    closed = (F.col("last_quoted") == 0) & ((left == 0) | (packed & (F.col("last_depth") == -1))) & F.col("root").isNotNull()
    errors = states.filter(~F.coalesce(closed, F.lit(False))).select("file").distinct().select(_file(), F.lit("not valid JSON").alias("error"))
    found = records(pieces, states.filter(closed), "}", True)
    one = F.col("text")
    listed = found.join(states.filter("at = 0").select("file", "root"), "file").select("file", "root", one)
    # what stands before and behind the elements of a chunk: brackets of the whole and commas
    inner = F.when(F.col("root") == "[", strip(F.regexp_replace("text", r"^\s*[\[,]?\s*", ""))).otherwise(strip(one))
    rest = listed.select("file", "root", inner.alias("text"))
    is_object = F.col("text").startswith("{") & F.col("text").endswith("}")
    end = F.when(F.col("root") == "[", F.regexp_replace("text", r"\s*\]\s*$", ""))
    chunk = F.when(is_object, F.array("text")).otherwise(F.when(
        F.col("root") == "[", F.when(F.coalesce(end, F.lit("")) != "", _elements(F.when(F.col("text").endswith("}"), F.col("text")).otherwise(end))))
        .otherwise(F.array("text")))
    return Outcome(rest.select(_file(), F.explode(chunk).alias("text")).filter("text <> ''"), errors)


def _elements(chunk: Column) -> Column:
    parsed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), chunk, F.lit("]"))), "$", "array<variant>")
    return F.coalesce(F.transform(parsed, lambda v: F.to_json(v)), F.array(chunk))
