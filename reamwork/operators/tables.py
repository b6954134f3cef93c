"""Tables as text: Markdown and HTML rendering, cell grids, table selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.markup import html_row, html_tables
from ..functions.names import page_table_name
from ..functions.text import PAGE_HEAD, PAGE_TAIL, extracted_page_html, html_escape, number_text, strip
from .blocks import extracted_blocks
from .grids import bound, grid_width, unique_labels
from .ordered import PART_ROWS, glue_framed, glue_parts, nested_positions, unnest
from .sequence import Outcome, suppress_table_text


def value_text(col: Column, dtype: T.DataType, null_text: str = "nan") -> Column:
    """One table value as text: plain numbers, True/False, JSON for nested values."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        shown = number_text(col.cast("double"))
    elif isinstance(dtype, T.BooleanType):
        shown = F.when(col, "True").when(~col, "False")
    elif isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        shown = F.to_json(col, {"ignoreNullFields": "false"})
    else:
        shown = col.cast("string")
    return F.coalesce(shown, F.lit(null_text))


def _texts(df: DataFrame, columns: list[str], null_text: str) -> list[Column]:
    return [value_text(F.col(c), df.schema[c].dataType, null_text) for c in columns]


def markdown_header(columns: list[str]) -> str:
    return "| " + " | ".join(columns) + " |\n| " + " | ".join(["---"] * len(columns)) + " |"


def _pipes(cells: list[Column]) -> Column:
    inner = [p for c in cells for p in (F.lit(" | "), c)][1:]
    return F.concat(F.lit("| "), *inner, F.lit(" |"))


def markdown_rows(df: DataFrame, columns: list[str], null_text: str = "nan") -> Column:
    """The Markdown line of each row; with the header line this is all a big table needs."""
    return _pipes(_texts(df, columns, null_text))


def to_markdown_table(
    df: DataFrame, group: list[str], pos: str, columns: list[str], null_text: str = "nan",
    first: int = 1, part_rows: int = PART_ROWS,
) -> DataFrame:
    """One Markdown table per group, in parts; the header goes before the row of the lowest position."""
    head = F.lit(markdown_header(columns) + "\n")
    line = markdown_rows(df, columns, null_text)
    return glue_framed(df, group, pos, line, head, F.lit(""), "\n", "markdown", part_rows, first, rows=F.lit(1))


def to_html_table(
    df: DataFrame, group: list[str], pos: str, columns: list[str], name: Column | None = None,
    null_text: str = "NaN", first: int = 1, part_rows: int = PART_ROWS,
) -> DataFrame:
    """One HTML table per group, in parts, headed by its name. The closing tags go after the row
    whose position is the group's highest."""
    row = html_row(_texts(df, columns, null_text))
    title = F.concat(F.lit("<h2>"), html_escape(name), F.lit("</h2>\n")) if name is not None else F.lit("")
    head = html_row([F.lit(c) for c in columns], "th")
    opening = F.concat(title, F.lit("<table border='1'>\n<thead>"), head, F.lit("</thead>\n<tbody>\n"))
    closing = F.lit("\n</tbody>\n</table>")
    return glue_framed(df, group, pos, row, opening, closing, "\n", "html", part_rows, first, rows=F.lit(1))


def _own_cells(rows: DataFrame, keep: list) -> DataFrame:
    """Cells of the placed rows in ``__rows``."""
    return (
        rows.select(*keep, F.posexplode_outer("__rows").alias("row_idx", "__cells")).filter(F.col("row_idx").isNotNull())
        .select(*keep, "row_idx", F.explode("__cells").alias("__cell"))
        .select(*keep, "row_idx", F.col("__cell.col_idx").alias("col_idx"), F.col("__cell.text").alias("text"),
                F.col("__cell.is_header").alias("is_header"))
    )


def html_table_cells(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """Every cell of every table of a page corpus, with ``tables_found`` per page.

    All work is inside the row: three unnestings and no shuffle. Indexes count from zero. The outer
    unnesting comes first because a plain one has the optimizer test the array's size in a filter
    of its own, which would parse each page twice more.
    """
    found = (
        pages.select(*keys, html_tables(F.col(html)).alias("__tables"))
        .select(*keys, F.size("__tables").cast("bigint").alias("tables_found"),
                F.posexplode_outer("__tables").alias("table_idx", "__table"))
        .filter(F.col("table_idx").isNotNull())
        .withColumn("__rows", F.col("__table.rows"))
    )
    return _own_cells(found, [*keys, "tables_found", "table_idx"])


def html_table_grids(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """Every table of a page corpus as one row: (keys, table_idx, labels, grid, first_row).

    Labels come from the table's header rows (a place's texts in several of them are joined with spaces, equal ones once); a table without
    a header has its places, from 0, as labels. ``first_row`` is the first row that is no header. See :mod:`grids`.
    """
    found = unnest(pages.select(*keys, html_tables(F.col(html)).alias("__tables")), keys, "__tables", "table_idx", "__table")
    grid = F.transform("__table.rows", lambda row, i: F.struct(
        i.alias("row_idx"), F.transform(row, lambda c: F.struct(c["col_idx"].alias("col_idx"), c["text"].alias("text"))).alias("cells")))
    made = found.select(*keys, "table_idx", F.col("__table.header_rows").alias("first_row"), grid.alias("grid"))

    def labels(width: Column) -> Column:
        places = F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>"))
        heads = F.filter("grid", lambda r: r["row_idx"] < F.col("first_row"))
        named = F.transform(places, lambda i: F.array_join(F.array_distinct(F.filter(F.flatten(F.transform(
            heads, lambda r: F.transform(F.filter(r["cells"], lambda c: c["col_idx"] == i), lambda c: c["text"]))), lambda t: t != "")), " "))
        return F.when(F.col("first_row") > 0, unique_labels(named)).otherwise(F.transform(places, lambda i: i.cast("string")))

    return made.withColumn("labels", bound(grid_width(F.col("grid")), labels)).select(*keys, "table_idx", "labels", "grid", "first_row")


def nth_table(
    pages: DataFrame, keys: list[str], table_index: int = 0, html: str = "html"
) -> Outcome:
    """Cells of one table per page; a page with fewer tables gives an error that says how many."""
    found = pages.select(*keys, html_tables(F.col(html)).alias("__tables"))
    have = F.size("__tables")
    errors = found.filter(have <= table_index).select(*keys, _too_few(have, table_index).alias("error"))
    rows = found.select(
        *keys, have.cast("bigint").alias("tables_found"), F.try_element_at("__tables", F.lit(table_index + 1))["rows"].alias("__rows"))
    return Outcome(_own_cells(rows, [*keys, "tables_found"]), errors)


# What a page without the wanted table gives.
_NO_TABLES, _ONLY, _BEYOND = "No tables found in the HTML file.", "Only ", " table(s) found; table_index {} is out of range."


def _too_few(have: Column, table_index: int) -> Column:
    return F.when(have == 0, F.lit(_NO_TABLES)).otherwise(
        F.concat(F.lit(_ONLY), have.cast("string"), F.lit(_BEYOND.format(table_index))))


def pick_table(cells: DataFrame, keys: list[str], table_index: int = 0) -> Outcome:
    """The same choice on a cell table that is already there: keep one table of each document.

    The number of tables of a document is one more than its highest table index, a partial
    aggregate; no distinct count and no window over the document is needed.
    """
    found = cells.groupBy(*keys).agg((F.max("table_idx") + 1).alias("tables_found"))
    errors = found.filter(F.col("tables_found") <= table_index).select(*keys, _too_few(F.col("tables_found"), table_index).alias("error"))
    return Outcome(cells.filter(F.col("table_idx") == table_index), errors)


def cells_to_rows(cells: DataFrame, keys: list[str], columns: list[str], header_rows: int = 1) -> DataFrame:
    """Cell grid to a table of text columns; column i of the grid becomes ``columns[i]``.

    A row of a table is bounded by its columns, so grouping by row never makes a large group.
    """
    body = cells.filter(F.col("row_idx") >= header_rows)
    return body.groupBy(*keys, "row_idx").agg(
        *[F.max(F.when(F.col("col_idx") == i, F.col("text"))).alias(c) for i, c in enumerate(columns)]
    )


def workbook_cells(cells: DataFrame, pages: DataFrame, doc: str = "doc_id", page: str = "page_no", text: str = "text") -> DataFrame:
    """Tables of extracted pages as sheet cells: (doc, sheet_name, row_idx, col_idx, text).

    Each table is a sheet named by page and table; a document without any table has its text lines
    on one sheet named Text, numbered within their page.
    """
    sheets = cells.select(
        doc, page_table_name(F.col(page), F.col("table_idx") + 1).alias("sheet_name"), F.col(page).alias("page"),
        F.col("row_idx").cast("int").alias("row_idx"), F.col("col_idx").cast("int").alias("col_idx"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    bare = pages.join(cells.select(doc), doc, "left_anti")
    lines = bare.select(doc, F.col(page).alias("page"), F.posexplode(F.split(text, "\n")).alias("row_idx", "text"))
    return sheets.unionByName(lines.select(
        doc, F.lit("Text").alias("sheet_name"), "page", "row_idx", F.lit(0).alias("col_idx"), "text"
    ))


# Fixed value: the page shell around extracted pages.
_PAGES_MID = (
    "</title>\n  <style>body{font-family:sans-serif;max-width:800px;margin:auto;padding:2em}"
    "section{border-bottom:1px solid #ccc;margin-bottom:2em}.page-label{color:#999;font-size:.8em}</style>\n"
    "</head>\n<body>\n"
)


def pages_to_html(
    pages: DataFrame, title: Column, doc: str = "doc_id", page: str = "page_no", text: str = "text",
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Extracted pages as one HTML page per document, a section per page, in parts."""
    head = F.concat(F.lit(PAGE_HEAD), html_escape(title), F.lit(_PAGES_MID))
    section = extracted_page_html(F.col(text), F.col(page))
    return glue_framed(pages, [doc], page, section, head, F.lit(PAGE_TAIL), "\n", "html", part_rows)


def pages_to_markdown(
    pages: DataFrame, cells: DataFrame, doc: str = "doc_id", page: str = "page_no", text: str = "text",
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Extracted pages with their tables as Markdown, in parts.

    Per page the tables come first, then the text lines that are no table cell; short upper-case
    lines are level-2 headings and a rule stands before every page but the first.
    """
    keys = [doc, page]
    whole = lambda c: F.coalesce(c.cast("bigint"), F.lit(0))

    def placed(df: DataFrame, part: int, first: Column, second: Column, shown: Column) -> DataFrame:
        """Lines of a page: its rule, then its tables by number and row, then its text."""
        return df.select(doc, F.col(page).alias("__page"), F.struct(
            F.lit(part).alias("part"), whole(first).alias("a"), whole(second).alias("b")).alias("__at"), shown.alias("__text"))

    rules = placed(pages.filter(F.col(page) > 1), 0, F.lit(0), F.lit(0), F.lit("\n\n---\n"))
    table_rows = cell_lines(cells.withColumn("text", strip(F.coalesce("text", F.lit("")))), [*keys, "table_idx"])
    grid = placed(table_rows, 1, F.col("table_idx"), F.col("row_idx"), F.col("line"))
    kept = suppress_table_text(extracted_blocks(pages, keys, text), cells, "text", "text", (doc, page))
    shown = F.when(F.col("kind") == "heading", F.concat(F.lit("\n## "), "text", F.lit("\n"))).otherwise(F.col("text"))
    body = placed(kept, 2, F.col("block_idx"), F.lit(0), shown)
    # the lines of a page come from one cell and its tables, so a window over a page is bounded; over a document it is not
    every = rules.unionByName(grid).unionByName(body).withColumn(
        "__no", F.row_number().over(Window.partitionBy(doc, "__page").orderBy("__at")).cast("bigint"))
    return glue_parts(nested_positions(every, [doc], "__page", "__no", "__line"), [doc], "__line", "__text", "\n", part_rows=part_rows)


def cell_lines(
    cells: DataFrame, keys: list[str], row: str = "row_idx", col: str = "col_idx", text: str = "text"
) -> DataFrame:
    """Each row of a cell grid as one Markdown line; row 0 is the header and brings its rule."""
    shown = F.coalesce(F.col(text), F.lit(""))
    per_row = cells.groupBy(*keys, row).agg(
        F.count(F.lit(1)).alias("__n"),
        F.array_sort(F.collect_list(F.struct(F.col(col), shown.alias("t")))).alias("__cells"),
    )
    line = F.concat(F.lit("| "), F.array_join(F.transform("__cells", lambda c: c["t"]), " | "), F.lit(" |"))
    rule = F.concat(F.lit("\n| "), F.array_join(F.array_repeat(F.lit("---"), F.col("__n").cast("int")), " | "), F.lit(" |"))
    return per_row.select(
        *keys, row, F.when(F.col(row) == 0, F.concat(line, rule)).otherwise(line).alias("line")
    )
