"""Grids that bring their own header, whatever the shape of each: labels, records by name, tables of text.

A grid is an array of rows ``STRUCT<row_idx, cells ARRAY<STRUCT<col_idx, text>>>``, sparse in both directions. All
work on one grid is inside its row; only the names of all columns of a corpus are found by an aggregate, over
headers and not over rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markup import html_row_of
from ..functions.text import html_escape
from .ordered import PART_ROWS, unnest

NO_CELLS = "array<struct<col_idx:int,text:string>>"


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _places(width: Column) -> Column:
    return F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>"))


def row_texts(cells: Column, width: Column) -> Column:
    """The texts of a row by place, null where it has no cell; of two cells at one place the first stands."""
    def sparse(c: Column) -> Column:
        return F.transform(
            _places(width), lambda i: F.try_element_at(F.filter(c, lambda x: x["col_idx"] == i), F.lit(1))["text"])

    def place(c: Column) -> Column:
        # cells from the first place on, one beside the other, need no search
        return F.when(
            F.transform(c, lambda x: x["col_idx"]) == _places(width), F.transform(c, lambda x: x["text"])).otherwise(sparse(c))

    return bound(cells, place)


def grid_width(grid: Column) -> Column:
    """One more than the highest place of any cell."""
    widths = F.transform(grid, lambda r: F.coalesce(F.array_max(F.transform(r["cells"], lambda c: c["col_idx"])) + 1, F.lit(0)))
    return F.coalesce(F.array_max(widths), F.lit(0))


def _numbered(labels: Column) -> Column:
    def one(label: Column, i: Column, every: Column) -> Column:
        earlier = F.size(F.filter(F.slice(every, F.lit(1), i), lambda x: F.lower(x) == F.lower(label)))
        return F.when(earlier > 0, F.concat(label, F.lit("."), earlier.cast("string"))).otherwise(label)

    return bound(labels, lambda every: F.transform(every, lambda x, i: one(x, i, every)))


def unique_labels(texts: Column) -> Column:
    """Labels of a header: an empty one is named by its place ("Unnamed: 2"), and of labels that are equal, or differ only in
    case, the later ones are numbered ("a.1"); so also where that makes labels equal that were not."""
    named = F.transform(
        texts, lambda x, i: F.when(F.coalesce(x, F.lit("")) == "", F.concat(F.lit("Unnamed: "), i.cast("string"))).otherwise(x))
    last = bound(_numbered(_numbered(named)), lambda every: F.transform(every, lambda x, i: F.when(
        F.exists(F.slice(every, F.lit(1), i), lambda y: F.lower(y) == F.lower(x)), F.concat(x, F.lit("."), i.cast("string"), F.lit("'"))).otherwise(x)))
    return last


def sheet_labels(grid: Column) -> Column:
    """The labels in row 0 of a grid, for all places that any of its rows has."""
    first = F.try_element_at(F.filter(grid, lambda r: r["row_idx"] == 0), F.lit(1))["cells"]
    return unique_labels(row_texts(F.coalesce(first, F.array().cast(NO_CELLS)), grid_width(grid)))


def record(labels: Column, cells: Column) -> Column:
    """A row as a map of label to text, without its empty places."""
    return F.map_filter(F.map_from_arrays(labels, row_texts(cells, F.size(labels))), lambda _, v: v.isNotNull())


def grid_records(grids: DataFrame, keys: list[str], first_row: Column | int = 1) -> DataFrame:
    """Records of grids: (keys, row_idx, record MAP<label, text>). ``grids`` has the columns ``grid`` and ``labels``; rows
    before ``first_row`` are header, and rows without any text are no records."""
    rows = unnest(grids.withColumn("__first", first_row if isinstance(first_row, Column) else F.lit(first_row)),
                  [*keys, "labels", "__first"], "grid", "__at", "__row")
    body = rows.filter((F.col("__row.row_idx") >= F.col("__first")) & F.exists("__row.cells", lambda c: c["text"].isNotNull()))
    return body.select(*keys, F.col("__row.row_idx").alias("row_idx"), record(F.col("labels"), F.col("__row.cells")).alias("record"))


def column_names(grids: DataFrame, order: list[str]) -> list[str]:
    """The labels of all grids, in the order of their first appearance when the grids are ordered by ``order``.

    Labels that differ only in case are one column, spelled as the first. One partial aggregate over the headers.
    """
    labels = grids.select(F.struct(*order).alias("__o"), F.posexplode("labels").alias("__i", "__label"))
    first = labels.groupBy(F.lower("__label").alias("__key")).agg(F.min(F.struct("__o", "__i", "__label")).alias("__first"))
    return [r["name"] for r in first.orderBy("__first").select(F.col("__first.__label").alias("name")).toLocalIterator()]


def records_table(records: DataFrame, names: list[str], keep: list[str] = []) -> DataFrame:  # noqa: B006
    """Records as a table: a text column for every name, null where a record lacks it."""
    lowered = records.select(*keep, F.transform_keys("record", lambda k, _: F.lower(k)).alias("__record"))
    return lowered.select(*keep, *[F.try_element_at("__record", F.lower(F.lit(n))).alias(n) for n in names])


def _in_parts(grid: Column, line, opening: Column, closing: Column, part_rows: int) -> Column:
    """The body rows of a grid as ARRAY<STRUCT<part_no, text, rows>>: the parts joined with line breaks are the whole."""
    def whole(body: Column) -> Column:
        last = F.greatest(F.ceil(F.size(body) / part_rows).cast("int") - 1, F.lit(0))

        def part(p: Column) -> Column:
            rows = F.slice(body, p * part_rows + 1, F.lit(part_rows))
            text = F.array_join(F.transform(rows, line), "\n")
            framed = F.concat(F.when(p == 0, opening).otherwise(F.lit("")), text, F.when(p == last, closing).otherwise(F.lit("")))
            return F.struct(p.cast("bigint").alias("part_no"), framed.alias("text"), F.size(rows).cast("bigint").alias("rows"))

        return F.transform(F.sequence(F.lit(0), last), part)

    return bound(F.filter(grid, lambda r: (r["row_idx"] > 0) & F.exists(r["cells"], lambda c: c["text"].isNotNull())), whole)


def _parts_out(grids: DataFrame, keys: list[str], parts: Column, out: str) -> DataFrame:
    rows = unnest(grids, keys, parts, "__at", "__part")
    return rows.select(*keys, F.col("__part.part_no").alias("part_no"), F.col("__part.text").alias(out), F.col("__part.rows").alias("rows"))


def grid_markdown(grids: DataFrame, keys: list[str], null_text: str = "nan", part_rows: int = PART_ROWS) -> DataFrame:
    """Each grid as a Markdown table under its own header: (keys, part_no, markdown, rows). No shuffle."""
    pipes = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    labels = F.col("labels")
    rule = F.transform(labels, lambda _: F.lit("---"))
    shown = lambda r: pipes(F.transform(row_texts(r["cells"], F.size(labels)), lambda t: F.coalesce(t, F.lit(null_text))))
    head = F.concat(pipes(labels), F.lit("\n"), pipes(rule), F.lit("\n"))
    return _parts_out(grids, keys, _in_parts(F.col("grid"), shown, head, F.lit(""), part_rows), "markdown")


def grid_html(
    grids: DataFrame, keys: list[str], name: Column | None = None, null_text: str = "NaN", part_rows: int = PART_ROWS,
) -> DataFrame:
    """Each grid as an HTML table under its own header and, if given, its name: (keys, part_no, html, rows). No shuffle."""
    labels = F.col("labels")
    title = F.concat(F.lit("<h2>"), html_escape(name), F.lit("</h2>\n")) if name is not None else F.lit("")
    opening = F.concat(title, F.lit("<table border='1'>\n<thead>"), html_row_of(labels, "th"), F.lit("</thead>\n<tbody>\n"))
    shown = lambda r: html_row_of(F.transform(row_texts(r["cells"], F.size(labels)), lambda t: F.coalesce(t, F.lit(null_text))))
    return _parts_out(grids, keys, _in_parts(F.col("grid"), shown, opening, F.lit("\n</tbody>\n</table>"), part_rows), "html")

