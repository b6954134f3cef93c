"""Office and e-book corpora: workbooks, Word documents, slide decks and EPUB books.

Each file is an archive of XML parts. The archive reader hands over one row per file with its text
parts; parsing (``from_xml``), shared-string, style and relationship lookups and the unnesting are
column expressions inside that row, so none of these scans shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markup import chapter_to_markdown, html_escape, html_to_text
from ..functions.names import stem
from ..functions.text import html_escape as text_escape
from ..functions.text import strip
from ..operators.blocks import block_line
from ..operators.grids import grid_html, grid_markdown, grid_records, sheet_labels
from ..operators.ordered import PART_ROWS, glue_framed, glue_parts, unnest
from .archives import archive_texts

_XML = {"ignoreNamespace": "true", "ignoreSurroundingSpaces": "false"}
_RELS = "Relationship array<struct<_Id string, _Target string>>"


# Of each kind: the parts that its scans read, and the one that a file can't do without.
_KINDS = {
    "xlsx": (r"^xl/(workbook\.xml|sharedStrings\.xml|_rels/workbook\.xml\.rels|worksheets/[^/]+\.xml)$", r"^xl/workbook\.xml$"),
    "docx": (r"^word/(document|styles)\.xml$", r"^word/document\.xml$"),
    "pptx": (r"^ppt/(presentation\.xml|_rels/presentation\.xml\.rels|slides/slide\d+\.xml)$", r"^ppt/(presentation|slides/slide\d+)\.xml$"),
    "epub": (r"(?i)(\.opf|\.x?html?|^META-INF/container\.xml)$", r"(?i)\.opf$"),
}


def _opened(files: DataFrame, kind: str) -> DataFrame:
    """(path, parts, error) of the files of a kind; chapters of books need not be well-formed."""
    wanted, main = _KINDS[kind]
    return archive_texts(files, wanted, main=main, checked=r"(?i)\.(xml|rels|opf)$")


def _readable(files: DataFrame, kind: str) -> DataFrame:
    return _opened(files, kind).filter("error is null")


def _part(name: str) -> Column:
    return F.try_element_at("parts", F.lit(name))


def _relations(name: str, base: str) -> Column:
    """Relationship id to part name, relative targets resolved against ``base``."""
    rels = F.coalesce(F.from_xml(_part(name), _RELS, _XML)["Relationship"], F.array())

    def entry(r: Column) -> Column:
        target = r["_Target"]
        full = F.when(target.startswith("/"), F.substr(target, F.lit(2))).otherwise(
            F.concat(F.lit(base), target)
        )
        return F.struct(r["_Id"], full)

    return F.map_from_entries(F.transform(rels, entry))


# ---------------------------------------------------------------------------- workbooks

_SHEET = (
    "sheetData struct<row array<struct<_r int, c array<struct<_r string, _t string, v string, "
    "`is` struct<t string, r array<struct<t string>>>>>>>>"
)
_STRINGS = "si array<struct<t string, r array<struct<t string>>>>"


def _rich(s: Column) -> Column:
    runs = F.array_join(F.transform(s["r"], lambda r: r["t"]), "")
    return F.coalesce(s["t"], runs, F.lit(""))


def _column_index(ref: Column) -> Column:
    letters = F.split(F.regexp_extract(ref, "^([A-Z]+)", 1), "(?<=.)(?=.)")
    return F.aggregate(letters, F.lit(0), lambda n, c: n * 26 + F.ascii(c) - 64) - 1


def _sheet_rows(xml: Column, shared: Column) -> Column:
    """A worksheet as a grid. Rows and cells that name no place follow the one before them."""

    def cell(c: Column, i: Column) -> Column:
        v, kind = c["v"], c["_t"]
        text = (
            F.when(kind == "s", F.try_element_at(shared, v.try_cast("int") + 1))
            .when(kind == "inlineStr", _rich(c["is"]))
            .when(kind == "b", F.when(v == "1", "True").otherwise("False"))
            .otherwise(v)
        )
        place = F.when(c["_r"].isNotNull(), _column_index(c["_r"])).otherwise(i)
        return F.struct(place.alias("col_idx"), text.alias("text"))

    def row(r: Column, i: Column) -> Column:
        cells = F.transform(F.coalesce(r["c"], F.array()), cell)
        return F.struct((F.coalesce(r["_r"], i + 1) - 1).alias("row_idx"), F.filter(cells, lambda c: c["text"].isNotNull()).alias("cells"))

    return F.transform(F.coalesce(F.from_xml(xml, _SHEET, _XML)["sheetData"]["row"], F.array()), row)


def _sheets(workbooks: DataFrame, keep: list[str]) -> DataFrame:
    """(path, sheet_idx, sheet, ...) of readable workbooks, all sheets in order; no rows are parsed yet."""
    # r:id has the only prefixed attribute name that ends in id
    sheet_tag = r'<(?:\w+:)?sheet\s[^>]*>'
    tags = F.regexp_extract_all(_part("xl/workbook.xml"), F.lit(sheet_tag), F.lit(0))
    unescaped = lambda c: F.replace(F.replace(c, F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    sheets = F.transform(
        tags,
        lambda t: F.struct(
            unescaped(F.regexp_extract(t, r'\sname="([^"]*)"', 1)).alias("name"),
            F.regexp_extract(t, r'\s\w+:id="([^"]*)"', 1).alias("rid"),
        ),
    )
    shared = F.transform(F.from_xml(_part("xl/sharedStrings.xml"), _STRINGS, _XML)["si"], _rich)
    return workbooks.select(
        *keep, "parts", shared.alias("shared"), _relations("xl/_rels/workbook.xml.rels", "xl/").alias("rels"),
        F.transform(sheets, lambda s, i: F.struct(i.alias("idx"), s["name"].alias("name"), s["rid"].alias("rid"))).alias("sheets"),
    )


def sheet_grids(workbooks: DataFrame, sheet_name: str | None = None) -> DataFrame:
    """Sheets as grids: (path, sheet_idx, sheet_name, labels, grid, error), one row per sheet.

    All sheets, or the one named. A workbook that cannot be read, or has no such sheet, is one row with an error.
    The labels are those of the sheet's own first row, see :mod:`..operators.grids`.
    """
    opened = _sheets(_opened(workbooks, "xlsx"), ["path", "error"])
    wanted = F.col("sheets") if sheet_name is None else F.filter("sheets", lambda s: s["name"] == sheet_name)
    listed = opened.select("path", "error", "parts", "shared", "rels", F.explode_outer(wanted).alias("sheet"))
    xml = F.try_element_at("parts", F.try_element_at("rels", F.col("sheet.rid")))
    missing = F.lit("The workbook has no sheet." if sheet_name is None else f"The workbook has no sheet named {sheet_name!r}.")
    grids = listed.select(
        "path", F.col("sheet.idx").alias("sheet_idx"), F.col("sheet.name").alias("sheet_name"),
        F.when(F.col("sheet").isNotNull(), _sheet_rows(xml, F.col("shared"))).alias("grid"),
        F.coalesce("error", F.when(F.col("sheet").isNull(), missing)).alias("error"))
    return grids.withColumn("labels", sheet_labels(F.col("grid"))).select("path", "sheet_idx", "sheet_name", "labels", "grid", "error")


def sheet_records(grids: DataFrame) -> DataFrame:
    """Records of sheets under their own headers: (path, sheet_idx, sheet_name, row_idx, record)."""
    return grid_records(grids.filter("error is null"), ["path", "sheet_idx", "sheet_name"])


def sheet_markdown(grids: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Sheets as Markdown tables: (path, sheet_idx, sheet_name, part_no, markdown, rows)."""
    return grid_markdown(grids.filter("error is null"), ["path", "sheet_idx", "sheet_name"], part_rows=part_rows)


def sheet_html(grids: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Sheets as HTML tables headed by their names: (path, sheet_idx, sheet_name, part_no, html, rows)."""
    return grid_html(grids.filter("error is null"), ["path", "sheet_idx", "sheet_name"], F.col("sheet_name"), part_rows=part_rows)


def xlsx_cells(workbooks: DataFrame, sheet_name: str | None = None) -> DataFrame:
    """Cells of all sheets, or of the named one: (path, sheet_idx, sheet_name, row_idx, col_idx, text).

    Row and column indexes count from zero and keep the gaps of sparse sheets. A workbook that
    cannot be read is left out here and listed by :func:`unreadable`.
    """
    opened = _sheets(_readable(workbooks, "xlsx"), ["path"])
    listed = unnest(opened, ["path", "parts", "shared", "rels"], "sheets", "__s", "sheet")
    if sheet_name is not None:
        listed = listed.filter(F.col("sheet.name") == sheet_name)
    xml = F.try_element_at("parts", F.try_element_at("rels", F.col("sheet.rid")))
    sheet = ["path", F.col("sheet.idx").alias("sheet_idx"), F.col("sheet.name").alias("sheet_name")]
    rows = unnest(listed, sheet, _sheet_rows(xml, F.col("shared")), "__r", "row")
    cells = unnest(rows, ["path", "sheet_idx", "sheet_name", "row.row_idx"], "row.cells", "__c", "c")
    return cells.select("path", "sheet_idx", "sheet_name", "row_idx", F.col("c.col_idx").alias("col_idx"), F.col("c.text").alias("text"))


def unreadable(files: DataFrame, kind: str | None = None) -> DataFrame:
    """Files that the scans leave out: (path, error).

    With ``kind`` (``xlsx``, ``docx``, ``pptx`` or ``epub``) every file that the scans of that kind
    can't read whole: no archive, no main part, a part that is not UTF-8, broken XML. Without it,
    only those that are no archive.
    """
    opened = _opened(files, kind) if kind else archive_texts(files, "^$")
    return opened.filter("error is not null").select("path", "error")


# ---------------------------------------------------------------------------- Word documents

_RUNS = "r array<struct<rPr struct<b struct<_val string>, i struct<_val string>>, t array<string>>>"
# Each scan asks for its half of the document only.
_PARAGRAPHS = f"body struct<p array<struct<pPr struct<pStyle struct<_val string>>, {_RUNS}>>>"
_TABLES = f"body struct<tbl array<struct<tr array<struct<tc array<struct<p array<struct<{_RUNS}>>>>>>>>>"
_WHOLE = f"{_PARAGRAPHS[:-1]}, {_TABLES.removeprefix('body struct<')}"
_STYLES = "style array<struct<_styleId string, name struct<_val string>>>"
_OFF = ("0", "false", "off")


def _is_on(mark: Column) -> Column:
    return mark.isNotNull() & ~F.coalesce(mark["_val"], F.lit("1")).isin(*_OFF)


def _run_structs(p: Column) -> Column:
    return F.transform(
        F.coalesce(p["r"], F.array()),
        lambda r: F.struct(
            F.array_join(F.coalesce(r["t"], F.array()), "").alias("text"),
            F.coalesce(_is_on(r["rPr"]["b"]), F.lit(False)).alias("bold"),
            F.coalesce(_is_on(r["rPr"]["i"]), F.lit(False)).alias("italic"),
            F.lit(False).alias("code"),
        ),
    )


def _joined(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: r["text"]), "")


def _word_body(schema: str) -> Column:
    return F.from_xml(_part("word/document.xml"), schema, _XML)["body"]


def _word_styles() -> Column:
    return F.map_from_entries(F.transform(
        F.coalesce(F.from_xml(_part("word/styles.xml"), _STYLES, _XML)["style"], F.array()),
        lambda s: F.struct(s["_styleId"], F.lower(s["name"]["_val"])),
    ))


def _word_block(p: Column) -> Column:
    """A paragraph as STRUCT<kind, level, runs>; its style name comes from the column ``styles``."""
    style_id = p["pPr"]["pStyle"]["_val"]
    by_id = F.lower(F.regexp_replace(style_id, r"(?<=[a-z])(?=[A-Z0-9])", " "))
    style = F.coalesce(F.try_element_at("styles", style_id), by_id, F.lit("normal"))
    level = F.regexp_extract(style, "heading ([123])", 1).try_cast("int")
    kind = (
        F.when(level.isNotNull(), "heading").when(style.contains("list bullet"), "bullet")
        .when(style.contains("list number"), "number").when(style.contains("list"), "list")
        .otherwise("paragraph")
    )
    return F.struct(kind.alias("kind"), F.coalesce(level, F.lit(0)).alias("level"), _run_structs(p).alias("runs"))


def docx_blocks(files: DataFrame) -> DataFrame:
    """Paragraphs as typed blocks (path, block_idx, kind, level, text, runs), blank ones included.

    The style name decides: headings 1 to 3, bullet or numbered lists, else a paragraph.
    """
    books = _readable(files, "docx")
    paras = unnest(books, ["path", _word_styles().alias("styles")], _word_body(_PARAGRAPHS)["p"], "__i", "p")
    made = paras.select("path", (F.col("__i") + 1).cast("bigint").alias("block_idx"), _word_block(F.col("p")).alias("b"))
    return made.select("path", "block_idx", "b.kind", "b.level", "b.runs").withColumn("text", _joined(F.col("runs")))


def _word_table_lines(table: Column, fmt: str) -> Column:
    """Lines of one table: a single HTML line, or a Markdown table and an empty line."""
    def cell_text(c: Column) -> Column:
        return strip(F.array_join(F.transform(c["p"], lambda p: _joined(_run_structs(p))), "\n"))

    rows = F.filter(F.coalesce(table["tr"], F.array()), lambda r: r["tc"].isNotNull())
    if fmt == "html":
        def row(r: Column, i: Column) -> Column:
            tag = F.when(i == 0, "th").otherwise("td")
            cells = F.transform(r["tc"], lambda c: F.concat(
                F.lit("<"), tag, F.lit(">"), text_escape(cell_text(c)), F.lit("</"), tag, F.lit(">")))
            return F.concat(F.lit("<tr>"), F.array_join(cells, ""), F.lit("</tr>"))

        body = F.array_join(F.transform(rows, row), "")
        return F.array(F.concat(F.lit("<table border='1'><tbody>"), body, F.lit("</tbody></table>")))

    def line(r: Column, i: Column) -> Column:
        cells = F.concat(F.lit("| "), F.array_join(F.transform(r["tc"], cell_text), " | "), F.lit(" |"))
        rule = F.concat(F.lit("\n| "), F.array_join(F.transform(r["tc"], lambda c: F.lit("---")), " | "), F.lit(" |"))
        return F.when(i == 0, F.concat(cells, rule)).otherwise(cells)

    lines = F.transform(rows, line)
    return F.when(F.size(rows) > 0, F.concat(lines, F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))


def docx_render(files: DataFrame, fmt: str) -> DataFrame:
    """Word files as HTML, Markdown or plain text (``txt``, without tables): (path, text), one row per
    file and no shuffle. All paragraphs come first and the tables after them."""
    books = _readable(files, "docx")
    opened = books.select("path", _word_styles().alias("styles"), _word_body(_WHOLE).alias("body"))
    # Two passes over the paragraphs: what the second uses more than once, the first has computed.
    blocks = F.transform(F.coalesce("body.p", F.array()), _word_block)
    with_text = F.transform(blocks, lambda b: F.struct(
        b["kind"].alias("kind"), b["level"].alias("level"), _joined(b["runs"]).alias("text"), b["runs"].alias("runs")))
    lines = F.transform(with_text, lambda b: block_line(fmt, b))
    if fmt != "txt":
        tables = F.transform(F.coalesce("body.tbl", F.array()), lambda t: _word_table_lines(t, fmt))
        lines = F.concat(lines, F.flatten(tables))
    return opened.select("path", F.array_join(lines, "\n\n" if fmt == "txt" else "\n").alias("text"))


def docx_cells(files: DataFrame) -> DataFrame:
    """Cells of all tables: (path, table_idx, row_idx, col_idx, text)."""
    books = _readable(files, "docx")
    tables = unnest(books, ["path"], _word_body(_TABLES)["tbl"], "table_idx", "t")
    rows = unnest(tables, ["path", "table_idx"], "t.tr", "row_idx", "r")
    cells = unnest(rows, ["path", "table_idx", "row_idx"], "r.tc", "col_idx", "c")
    text = F.array_join(F.transform("c.p", lambda p: _joined(_run_structs(p))), "\n")
    return cells.select("path", "table_idx", "row_idx", "col_idx", strip(text).alias("text"))


# ---------------------------------------------------------------------------- slide decks

_SLIDE = (
    "cSld struct<spTree struct<sp array<struct<txBody struct<p array<struct<r array<struct<t string>>>>>>>>>"
)


def _deck_parts(files: DataFrame) -> DataFrame:
    """(path, parts, slides): the names of the slides of each deck in presentation order."""
    decks = _readable(files, "pptx")
    ids = F.regexp_extract_all(
        _part("ppt/presentation.xml"), F.lit(r'<(?:\w+:)?sldId\s[^>]*?\w+:id="([^"]+)"'), F.lit(1)
    )
    rels = _relations("ppt/_rels/presentation.xml.rels", "ppt/")
    numbered = F.array_sort(F.transform(
        F.filter(F.map_keys("parts"), lambda k: k.startswith("ppt/slides/")),
        lambda k: F.struct(F.regexp_extract(k, r"(\d+)\.xml$", 1).cast("int").alias("n"), k.alias("name")),
    ))
    in_order = F.when(
        F.size(ids) > 0, F.transform(ids, lambda i: F.try_element_at("__rels", i))
    ).otherwise(F.transform(numbered, lambda s: s["name"]))
    return decks.withColumn("__rels", rels).select("path", "parts", in_order.alias("slides"))


def _slide_texts(name: Column) -> Column:
    """Non-blank paragraphs of one slide."""
    shapes = F.from_xml(F.try_element_at("parts", name), _SLIDE, _XML)["cSld"]["spTree"]["sp"]
    texts = F.flatten(F.transform(
        F.filter(F.coalesce(shapes, F.array()), lambda s: s["txBody"]["p"].isNotNull()),
        lambda s: F.transform(
            s["txBody"]["p"],
            lambda p: strip(F.array_join(F.transform(F.coalesce(p["r"], F.array()), lambda r: r["t"]), "")),
        ),
    ))
    return F.filter(texts, lambda t: t != "")


def pptx_text(files: DataFrame) -> DataFrame:
    """Paragraphs of slide decks: (path, slide_no, para_idx, text).

    Slides come in presentation order. Blank paragraphs are dropped; a slide without text keeps one
    row with null text, so that slides can be counted.
    """
    slides = unnest(_deck_parts(files), ["path", "parts"], "slides", "__i", "name")
    return slides.select(
        "path", (F.col("__i") + 1).cast("bigint").alias("slide_no"),
        F.posexplode_outer(_slide_texts(F.col("name"))).alias("__p", "text"),
    ).select(
        "path", "slide_no", (F.coalesce("__p", F.lit(0)) + 1).cast("bigint").alias("para_idx"), "text"
    )


def pptx_render(files: DataFrame, fmt: str = "txt") -> DataFrame:
    """Slide decks as text or HTML sections: (path, slides, text), one row per deck and no shuffle."""

    def section(name: Column, i: Column) -> Column:
        no, texts = (i + 1).cast("string"), _slide_texts(name)
        if fmt == "html":
            head = F.concat(F.lit('<section id="slide-'), no, F.lit('"><h2>Slide '), no, F.lit("</h2>"))
            paras = F.transform(texts, lambda t: F.concat(F.lit("<p>"), text_escape(t), F.lit("</p>")))
            return F.array_join(F.concat(F.array(head), paras, F.array(F.lit("</section>"))), "\n")
        head = F.concat(F.lit("--- Slide "), no, F.lit(" ---"))
        return F.array_join(F.concat(F.array(head), texts), "\n")

    decks = _deck_parts(files)
    return decks.select(
        "path", F.size("slides").cast("bigint").alias("slides"),
        F.array_join(F.transform("slides", section), "\n").alias("text"),
    )


# ---------------------------------------------------------------------------- e-books

_PACKAGE = (
    "metadata struct<title array<string>>, "
    "manifest struct<item array<struct<_id string, _href string, `_media-type` string>>>"
)


def epub_chapters(files: DataFrame) -> DataFrame:
    """Chapters in manifest order: (path, title, chapter_idx, html); title is the book's, else the
    file stem."""
    books = _readable(files, "epub")
    named = F.regexp_extract(_part("META-INF/container.xml"), r'full-path="([^"]+)"', 1)
    any_opf = F.filter(F.map_keys("parts"), lambda k: F.lower(k).endswith(".opf"))
    opf = F.coalesce(F.nullif(named, F.lit("")), F.try_element_at(any_opf, F.lit(1)))
    opened = books.withColumn("__opf", opf).withColumn(
        "__pkg", F.from_xml(F.try_element_at("parts", F.col("__opf")), _PACKAGE, _XML)
    )
    base = F.regexp_extract("__opf", "^(.*/)", 1)
    items = F.filter(F.col("__pkg.manifest.item"), lambda i: i["_media-type"] == "application/xhtml+xml")
    title = F.coalesce(
        F.nullif(strip(F.try_element_at("__pkg.metadata.title", F.lit(1))), F.lit("")), stem(F.col("path"))
    )
    chapters = unnest(
        opened, ["path", "parts", base.alias("__base"), title.alias("title")], items, "__i", "item"
    )
    name = F.concat("__base", F.url_decode("item._href"))
    return chapters.select(
        "path", "title", (F.col("__i") + 1).cast("bigint").alias("chapter_idx"),
        F.try_element_at("parts", name).alias("html"),
    ).filter(F.col("html").isNotNull())


def epub_text(chapters: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Plain text per book: chapters stripped, empty ones left out, blank line between."""
    text = strip(html_to_text(F.col("html")))
    return glue_parts(chapters, ["path"], "chapter_idx", F.when(text != "", text), "\n\n", part_rows=part_rows)


def epub_markdown(chapters: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    return glue_parts(
        chapters, ["path"], "chapter_idx", chapter_to_markdown(F.col("html")), "\n", part_rows=part_rows
    )


# The page shell of a book.
_BOOK_HEAD = '<!DOCTYPE html>\n<html lang="en"><head><meta charset="UTF-8"><title>'
_BOOK_MID = (
    "</title><style>body{font-family:serif;max-width:800px;margin:auto;padding:2em}</style></head><body>"
)
_BOOK_TAIL = "</body></html>"


def epub_html(chapters: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """One HTML page per book. The shell's head goes before chapter 1 and its end after the last."""
    body = F.regexp_extract("html", r"(?is)(<body\b.*</body\s*>)", 1)
    section = F.when(body != "", body).otherwise(F.col("html"))
    head = F.concat(F.lit(_BOOK_HEAD), html_escape(F.col("title")), F.lit(_BOOK_MID))
    return glue_framed(
        chapters, ["path"], "chapter_idx", section, head, F.lit(_BOOK_TAIL), "\n", part_rows=part_rows
    )
