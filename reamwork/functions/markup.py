"""HTML and XML functions."""

from __future__ import annotations

import html.entities
import json
import re
import xml.etree.ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import html_escape, strip

# ---------------------------------------------------------------------------- entities

_ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_PIECES = _ENTITY + r"|[^&]+|&"


def _entity_tables() -> tuple[str, str]:
    """The standard library's HTML5 names, grouped by first letter so that a lookup is short, and
    a pattern of the names that are valid without a semicolon, longest first."""
    groups: dict[str, dict[str, str]] = {}
    for name, value in html.entities.html5.items():
        groups.setdefault(name[0], {})[name] = value
    bare = sorted((n for n in html.entities.html5 if not n.endswith(";")), key=len, reverse=True)
    return json.dumps(groups), f"^(?:{'|'.join(bare)})"


def _char(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def _numeric_entity(body: Column) -> Column:
    """#123 or #x7B as a character; browsers' rules for the code points that are not characters."""
    is_hex = F.lower(F.substring(body, 2, 1)) == "x"
    digits = F.regexp_replace(body, "^#[xX]?0*|;$", "")
    too_big = F.length(digits) > 7
    kept = F.when(too_big | (digits == ""), "0").otherwise(digits)
    code = F.when(is_hex, F.conv(kept, 16, 10)).otherwise(kept).cast("bigint")
    low = code.bitwiseAND(0xFFFF)
    windows = json.dumps(
        {str(n): bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}
    )
    cp1252 = F.try_element_at(F.from_json(F.lit(windows), "map<string,string>"), code.cast("string"))
    no_char = (
        code.between(1, 8) | (code == 0xB) | code.between(0xE, 0x1F) | (code == 0x7F)
        | code.between(0xFDD0, 0xFDEF) | low.isin(0xFFFE, 0xFFFF)
    )
    broken = too_big | (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    return (
        F.when(broken, "�").when(code.between(0x80, 0x9F), cp1252).when(no_char, "")
        .otherwise(_char(code))
    )


def html_unescape(col: Column) -> Column:
    """All HTML5 named entities and numeric references; texts without '&' are passed through."""
    groups, bare_names = _entity_tables()
    table = F.from_json(F.lit(groups), "map<string,map<string,string>>")

    def value_of(name: Column) -> Column:
        return F.try_element_at(F.try_element_at(table, F.substring(name, 1, 1)), name)

    def decode(piece: Column) -> Column:
        body = F.substr(piece, F.lit(2))
        prefix = F.regexp_extract(body, bare_names, 0)
        by_prefix = F.when(
            prefix != "", F.concat(value_of(prefix), F.substr(body, F.length(prefix) + 1))
        )
        return (
            F.when(~piece.startswith("&") | (piece == "&"), piece)
            .when(body.startswith("#"), _numeric_entity(body))
            .otherwise(F.coalesce(value_of(body), by_prefix, piece))
        )

    pieces = F.regexp_extract_all(col, F.lit(_PIECES), F.lit(0))
    return F.when(F.contains(col, F.lit("&")), F.array_join(F.transform(pieces, decode), "")).otherwise(col)


# ---------------------------------------------------------------------------- HTML text and blocks

# Tags whose opening or closing ends an unclosed paragraph, heading or list item.
BLOCK_ENDS = (
    "h1 h2 h3 h4 h5 h6 p li ul ol dl dt dd table tr td th thead tbody tfoot div section article "
    "header footer nav main aside form fieldset blockquote pre address figure hr body html"
).split()

_SKIPPED = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>"
_END = rf"</?(?:{'|'.join(BLOCK_ENDS)})(?=[\s>/])"


def _block_pattern(tags: str) -> str:
    table = r"<table(?=[\s>])[^>]*>.*?</table\s*>|" if "table" in tags else ""
    plain = "|".join(t for t in tags.split("|") if t != "table")
    return rf"(?is){table}<(?:{plain})(?=[\s>/])[^>]*>[^<]*+(?:<(?!{_END[1:]})[^<]*+)*+"


def html_to_text(col: Column) -> Column:
    """Tags removed, entities decoded."""
    return html_unescape(F.regexp_replace(col, "<[^>]+>", ""))


def _inner_text(block: Column) -> Column:
    """Text nodes of a block, each stripped, put together without a separator."""
    glued = F.regexp_replace(block, r"\s*(?:<[^>]+>\s*)+", "")
    return strip(html_unescape(strip(glued)))


def html_block_array(col: Column, tags: str = "h1|h2|h3|h4|p|li|table") -> Column:
    """Ordered ARRAY<STRUCT<kind, level, text, html>> of the non-empty blocks of one page.

    Script, style, head and comments go first. A block ends at the next opening or closing tag of
    a block element, so unclosed paragraphs work; a table is one block.
    """
    found = F.regexp_extract_all(
        F.regexp_replace(col, _SKIPPED, ""), F.lit(_block_pattern(tags)), F.lit(0)
    )

    def block(b: Column) -> Column:
        tag = F.lower(F.regexp_extract(b, r"^<(\w+)", 1))
        kind = (
            F.when(tag.startswith("h"), "heading").when(tag == "li", "bullet")
            .when(tag == "table", "table").otherwise("paragraph")
        )
        level = F.when(
            tag.startswith("h"), F.least(F.substring(tag, 2, 1).try_cast("int"), F.lit(3))
        ).otherwise(0)
        return F.struct(
            kind.alias("kind"), level.alias("level"), _inner_text(b).alias("text"),
            F.when(tag == "table", b).alias("html"),
        )

    return F.filter(F.transform(found, block), lambda b: b["text"] != "")


def _markdown_line(b: Column) -> Column:
    mark = (
        F.when(b["kind"] == "heading", F.concat(F.repeat(F.lit("#"), b["level"]), F.lit(" ")))
        .when(b["kind"] == "bullet", "- ").otherwise("")
    )
    return F.concat(mark, b["text"])


def html_to_markdown(col: Column) -> Column:
    """Headings, list items and paragraphs of a page, put together with blank lines."""
    blocks = html_block_array(col, "h1|h2|h3|h4|p|li")
    return F.array_join(F.transform(blocks, _markdown_line), "\n\n")


def chapter_to_markdown(col: Column) -> Column:
    """The e-book variant: h1 to h3, one newline between blocks, an empty line after the chapter."""
    blocks = html_block_array(col, "h1|h2|h3|p|li")
    return F.array_join(F.concat(F.transform(blocks, _markdown_line), F.array(F.lit(""))), "\n")


def _cell_text(html: Column) -> Column:
    """Text of a table cell: line breaks for <br>, nothing for other tags, entities decoded; a run of line breaks, and
    any longer run of white space, becomes one space."""
    plain = F.regexp_replace(F.regexp_replace(html, r"(?i)<br(?=[\s>/])[^>]*>", "\n"), r"<[^>]*>", "")
    return strip(F.regexp_replace(html_unescape(plain), r"(?U)[\r\n]+|\s{2,}", " "))


def _table_sources(page: Column) -> Column:
    """The inner HTML of each table of a page, by the order of the opening tags.

    The page is cut at its table tags; a fold over the pieces keeps the stack of open tables. A table's source is made of its own
    pieces and, so that its cells keep their whole text, of the text of the tables inside it. A closing tag without an
    open table is ignored; a table that is not closed goes on to the end.
    """
    pieces = F.split(page, r"(?i)(?=<table[\s>/])|(?=</table[\s>])")
    opened = "array<struct<text:string,stack:array<int>>>"
    start = F.struct(F.array().cast("array<int>").alias("stack"), F.lit(0).alias("n"), F.array().cast(opened).alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        opens, closes = F.regexp_like(piece, F.lit(r"(?i)^<table[\s>/]")), F.regexp_like(piece, F.lit(r"(?i)^</table[\s>]"))
        depth = F.size(acc["stack"])
        stack = (
            F.when(opens, F.concat(acc["stack"], F.array(acc["n"])))
            .when(closes & (depth > 0), F.slice(acc["stack"], F.lit(1), depth - 1)).otherwise(acc["stack"])
        )
        text = F.regexp_replace(piece, r"(?i)^</?table(?=[\s>/])[^>]*>", "")
        return F.struct(
            stack.alias("stack"), (acc["n"] + opens.cast("int")).alias("n"),
            F.concat(acc["out"], F.array(F.struct(text.alias("text"), stack.alias("stack")))).alias("out"))

    def sources(done: Column) -> Column:
        return F.transform(
            F.when(done["n"] > 0, F.sequence(F.lit(0), done["n"] - 1)).otherwise(F.array().cast("array<int>")),
            lambda t: F.array_join(F.transform(
                F.filter(done["out"], lambda p: F.array_contains(p["stack"], t)),
                lambda p: F.when(F.try_element_at(p["stack"], F.lit(-1)) == t, p["text"]).otherwise(
                    F.regexp_replace(F.regexp_replace(p["text"], r"(?i)<br(?=[\s>/])[^>]*>", "<br>"), r"(?i)<(?!br>)[^>]*>", ""))), ""))

    return F.transform(F.array(F.aggregate(pieces, start, step)), sources)[0]


# The widest and the longest cell that browsers know.
_MOST_COLUMNS, _MOST_ROWS = 1_000, 65_534

_PLACED = "struct<col_idx:int,text:string,is_header:boolean,left:int>"


def _span(tag: Column, name: str, most: int) -> Column:
    found = F.regexp_extract(tag, rf"(?is)^<t[hd][^>]*?\s{name}\s*=\s*[\"']?\s*(\d+)", 1)
    number = F.coalesce(found.try_cast("bigint"), F.when(found != "", F.lit(most)), F.lit(1))
    # most cells have a tag without attributes
    return F.when(F.substring(tag, 4, 1) == ">", F.lit(1)).otherwise(F.greatest(F.lit(1), F.least(F.lit(most), number)).cast("int"))


def _placed_rows(rows: Column) -> Column:
    """Rows of raw cells to rows of placed ones: cells that reach over rows or columns stand at every place they cover.

    The fold carries the cells that reach into the next row; others take the free places in their order. Cells
    that reach below the last row make rows of their own.
    """
    wide = F.transform(rows, lambda row: F.flatten(F.transform(row, lambda c: F.array_repeat(c, c["cols"]))))
    none = F.array().cast(f"array<{_PLACED}>")

    def step(acc: Column, row: Column) -> Column:
        held = acc["held"]
        every = F.sequence(F.lit(0), F.size(row) + F.size(held))
        free = F.slice(F.array_except(every, F.transform(held, lambda h: h["col_idx"])), F.lit(1), F.size(row))
        new = F.zip_with(free, row, lambda i, c: F.struct(
            i.alias("col_idx"), c["text"].alias("text"), c["is_header"].alias("is_header"), c["rows"].alias("left")))

        def ended(now: Column) -> Column:
            on = F.transform(now, lambda c: F.struct(
                c["col_idx"].alias("col_idx"), c["text"].alias("text"), c["is_header"].alias("is_header"), (c["left"] - 1).alias("left")))
            return F.struct(
                F.concat(acc["out"], F.array(now)).alias("out"), F.filter(on, lambda c: c["left"] > 0).alias("held"))

        return F.transform(F.array(F.array_sort(F.concat(held, new))), ended)[0]

    def finished(acc: Column) -> Column:
        more = F.coalesce(F.array_max(F.transform(acc["held"], lambda c: c["left"])), F.lit(0))
        below = F.when(more > 0, F.sequence(F.lit(1), more)).otherwise(F.array().cast("array<int>"))
        return F.concat(acc["out"], F.transform(below, lambda k: F.filter(acc["held"], lambda c: c["left"] >= k)))

    start = F.struct(F.array().cast(f"array<array<{_PLACED}>>").alias("out"), none.alias("held"))
    folded = F.aggregate(wide, start, step, finished)
    plain = F.transform(wide, lambda row: F.transform(row, lambda c, i: F.struct(
        i.alias("col_idx"), c["text"].alias("text"), c["is_header"].alias("is_header"), F.lit(1).alias("left"))))
    return F.when(F.exists(rows, lambda row: F.exists(row, lambda c: c["rows"] > 1)), folded).otherwise(plain)


def html_tables(col: Column) -> Column:
    """All tables of a page: ARRAY<STRUCT<rows ARRAY<ARRAY<STRUCT<col_idx, text, is_header, left>>>, header_rows>>.

    Tables inside tables are tables of their own, listed by their opening tags; their text is also part of the cell that
    holds them. ``rowspan`` and ``colspan`` are spread. ``header_rows`` counts the rows of ``<thead>`` or, where there is none,
    the first rows whose cells are all ``<th>``. Rows without cells are left out.
    """

    def cell(c: Column) -> Column:
        return F.struct(
            _cell_text(c).alias("text"), F.regexp_like(c, F.lit(r"(?i)^<th")).alias("is_header"),
            _span(c, "colspan", _MOST_COLUMNS).alias("cols"), _span(c, "rowspan", _MOST_ROWS).alias("rows"))

    def cells(row: Column) -> Column:
        pattern = r"(?is)<t[hd](?=[\s>/])[^>]*>.*?(?=</t[hd]\s*>|<t[hd](?=[\s>/])|$)"
        return F.transform(F.regexp_extract_all(row, F.lit(pattern), F.lit(0)), cell)

    def rows(table: Column) -> Column:
        pattern = r"(?is)<tr(?=[\s>/])[^>]*>.*?(?=</tr\s*>|<tr(?=[\s>/])|$)"
        return F.filter(F.transform(F.regexp_extract_all(table, F.lit(pattern), F.lit(0)), cells), lambda row: F.size(row) > 0)

    def grid(table: Column) -> Column:
        in_head = F.size(rows(F.regexp_extract(table, r"(?is)<thead(?=[\s>]).*?</thead\s*>", 0)))

        def framed(found: Column) -> Column:
            all_head = F.transform(found, lambda row: F.forall(row, lambda c: c["is_header"]))
            leading = F.coalesce(F.nullif(F.array_position(all_head, False), F.lit(0)) - 1, F.size(all_head).cast("bigint"))
            return F.struct(
                _placed_rows(found).alias("rows"), F.when(in_head > 0, in_head).otherwise(leading.cast("int")).alias("header_rows"))

        return F.transform(F.array(rows(table)), framed)[0]

    page = F.regexp_replace(col, _SKIPPED, "")
    none = F.array().cast(f"array<struct<rows:array<array<{_PLACED}>>,header_rows:int>>")
    return F.when(F.regexp_like(col, F.lit(r"(?i)<table[\s>/]")), F.transform(_table_sources(page), grid)).otherwise(none)


# ---------------------------------------------------------------------------- XML and JSON


def xml_escape(col: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        col = F.replace(col, F.lit(char), F.lit(entity))
    return col


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _element_value(el: ET.Element):
    out: dict = dict(el.attrib)
    grouped: dict[str, list] = {}
    for child in el:
        grouped.setdefault(_local(child.tag), []).append(_element_value(child))
    if grouped:
        out.update({tag: vals if len(vals) > 1 else vals[0] for tag, vals in grouped.items()})
        return out
    text = (el.text or "").strip()
    if text and out:
        out["_text"] = text
    return text if text and not out else out


def _xml_json(xml: str | None) -> tuple[str | None, str | None]:
    if xml is None:
        return None, "no input"
    try:
        root = ET.fromstring(xml)
        return json.dumps({_local(root.tag): _element_value(root)}, ensure_ascii=False), None
    except ET.ParseError as problem:
        return None, str(problem)


@F.pandas_udf(T.StructType().add("json", "string").add("error", "string"))
def xml_to_json(xml: pd.Series) -> pd.DataFrame:
    """XML text of unknown shape to JSON text; every value stays a string, so "007" is kept.

    Where the shape is known, :func:`typed_xml_to_json` does the work inside the JVM.
    """
    return pd.DataFrame([_xml_json(x) for x in xml], columns=["json", "error"])


def typed_xml_to_json(col: Column, schema: str) -> Column:
    """XML of a known shape to JSON, without leaving the JVM; ``schema`` names the strings to keep."""
    options = {"attributePrefix": "", "valueTag": "_text", "ignoreNamespace": "true"}
    root = F.xpath_string(col, F.lit("local-name(/*)"))
    return F.to_json(F.create_map(root, F.from_xml(col, schema, options)))


def xml_value(col: Column, dtype: T.DataType) -> Column:
    """XML inside an element for a typed value: struct fields to tags, array entries to <item>."""
    if isinstance(dtype, T.StructType):
        parts = [xml_element(f.name, col[f.name], f.dataType) for f in dtype.fields]
        return F.coalesce(F.concat(*parts), F.lit("None")) if parts else F.lit("")
    if isinstance(dtype, T.ArrayType):
        items = F.transform(col, lambda x: xml_element("item", x, dtype.elementType))
        return F.coalesce(F.array_join(items, ""), F.lit("None"))
    if isinstance(dtype, T.MapType):
        entries = F.transform(
            F.map_entries(col),
            lambda e: F.concat(
                F.lit("<"), e["key"], F.lit(">"), xml_value(e["value"], dtype.valueType),
                F.lit("</"), e["key"], F.lit(">"),
            ),
        )
        return F.coalesce(F.array_join(entries, ""), F.lit("None"))
    if isinstance(dtype, T.BooleanType):
        return F.when(col, "True").when(~col, "False").otherwise("None")
    return F.coalesce(xml_escape(col.cast("string")), F.lit("None"))


def xml_element(tag: str, col: Column, dtype: T.DataType) -> Column:
    return F.concat(F.lit(f"<{tag}>"), xml_value(col, dtype), F.lit(f"</{tag}>"))


XML_DECLARATION = "<?xml version='1.0' encoding='UTF-8'?>\n"


def record_to_xml(col: Column, dtype: T.StructType, root_tag: str = "root") -> Column:
    """One XML document per row; a record with a single field uses that field as the root."""
    if len(dtype.fields) == 1:
        only = dtype.fields[0]
        return F.concat(F.lit(XML_DECLARATION), xml_element(only.name, col[only.name], only.dataType))
    return F.concat(F.lit(XML_DECLARATION), xml_element(root_tag, col, dtype))


_TAG = re.compile(r"[^\W\d][\w.\-]*")


def _tagged(tag: str, value) -> str:
    """XML text of one named value; list entries are all named item."""
    if not _TAG.fullmatch(tag):
        raise ValueError(f"Invalid tag name {tag!r}")
    if isinstance(value, (dict, list)):
        pairs = value.items() if isinstance(value, dict) else (("item", v) for v in value)
        body = "".join(_tagged(t, v) for t, v in pairs)
    else:
        body = escape(str(value))
    return f"<{tag}>{body}</{tag}>"


def _json_xml(text: str | None, root_tag: str) -> tuple[str | None, str | None]:
    try:
        value = json.loads(text)
        if isinstance(value, dict) and len(value) == 1:
            root_tag, value = next(iter(value.items()))
        return XML_DECLARATION + _tagged(root_tag, value), None
    except (ValueError, TypeError) as problem:
        return None, str(problem)


def json_to_xml(col: Column, root_tag: str = "root") -> Column:
    """JSON text of unknown shape to an XML document: STRUCT<xml, error>."""

    @F.pandas_udf(T.StructType().add("xml", "string").add("error", "string"))
    def convert(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_json_xml(t, root_tag) for t in texts], columns=["xml", "error"])

    return convert(col)


def html_row_of(cells: Column, tag: str = "td") -> Column:
    """An array of texts as a table row."""
    parts = F.transform(cells, lambda c: F.concat(F.lit(f"<{tag}>"), html_escape(c), F.lit(f"</{tag}>")))
    return F.concat(F.lit("<tr>"), F.array_join(parts, ""), F.lit("</tr>"))


def html_row(cells: list[Column], tag: str = "td") -> Column:
    parts = [F.concat(F.lit(f"<{tag}>"), html_escape(c), F.lit(f"</{tag}>")) for c in cells]
    return F.concat(F.lit("<tr>"), *parts, F.lit("</tr>"))
