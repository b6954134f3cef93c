"""Typed blocks of documents: Markdown and HTML to blocks, blocks to text formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markup import html_block_array
from ..functions.text import (
    content_line_array, html_escape, inline_runs, is_blank, is_heading, line_kind, lines, strip,
)
from .ordered import PART_ROWS, glue_parts


def content_lines(
    docs: DataFrame, keys: list[str], text: str = "text", comments: bool = False
) -> DataFrame:
    """Non-blank lines with their line numbers (from 1); optionally without # lines."""
    rows = docs.select(*keys, F.posexplode(F.split(text, "\r?\n")).alias("__i", "line"))
    kept = rows.filter(~is_blank(F.col("line")))
    if comments:
        kept = kept.filter(~strip(F.col("line")).startswith("#"))
    return kept.select(*keys, (F.col("__i") + 1).cast("bigint").alias("line_no"), "line")


def text_paragraphs(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Every line of a plain text, blank ones too, as a paragraph block."""
    rows = docs.select(*keys, F.posexplode(lines(F.col(text))).alias("__i", "text"))
    return rows.select(
        *keys, (F.col("__i") + 1).cast("bigint").alias("block_idx"), F.lit("paragraph").alias("kind"),
        F.lit(0).alias("level"), "text",
    )


def markdown_blocks(docs: DataFrame, keys: list[str], text: str = "text", runs: bool = True) -> DataFrame:
    """Markdown lines to headings, bullets, numbered items and paragraphs, blank lines dropped.

    ``block_idx`` counts the kept lines of a document from 1. Everything happens inside the row.
    """

    def block(line: Column) -> Column:
        return F.struct(line_kind(line).alias("k"), line.alias("line"))

    blocks = F.filter(F.transform(lines(F.col(text)), block), lambda b: b["k"] != "X")
    k, line = F.col("__b.k"), F.col("__b.line")
    kind = (
        F.when(k.isin("1", "2", "3"), "heading").when(k == "B", "bullet").when(k == "N", "number")
        .otherwise("paragraph")
    )
    body = (
        F.when(k.isin("1", "2", "3"), F.substr(line, k.try_cast("int") + 2))
        .when(k == "B", F.substr(line, F.lit(3)))
        .when(k == "N", F.regexp_replace(line, r"^\p{Nd}+\. ", ""))
        .otherwise(line)
    )
    plain = F.array(F.struct(
        F.col("text"), F.lit(False).alias("bold"), F.lit(False).alias("italic"), F.lit(False).alias("code")
    ))
    out = docs.select(*keys, F.posexplode(blocks).alias("__i", "__b")).select(
        *keys, (F.col("__i") + 1).cast("bigint").alias("block_idx"), kind.alias("kind"),
        F.coalesce(k.try_cast("int"), F.lit(0)).alias("level"), body.alias("text"),
    )
    if runs:
        out = out.withColumn(
            "runs", F.when(F.col("kind") == "paragraph", inline_runs(F.col("text"))).otherwise(plain)
        )
    return out


def html_blocks(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """Blocks of a page corpus: (keys, block_idx, kind, level, text), indexes from 1."""
    return pages.select(*keys, F.posexplode(html_block_array(F.col(html))).alias("__i", "__b")).select(
        *keys, (F.col("__i") + 1).cast("bigint").alias("block_idx"), F.col("__b.kind").alias("kind"),
        F.col("__b.level").alias("level"), F.col("__b.text").alias("text"),
    )


def extracted_blocks(
    pages: DataFrame, keys: list[str], text: str = "text"
) -> DataFrame:
    """Lines of extracted page text: short upper-case lines are level-2 headings."""
    rows = pages.select(*keys, F.posexplode(content_line_array(F.col(text))).alias("__i", "text"))
    head = is_heading(F.col("text"))
    return rows.select(
        *keys, (F.col("__i") + 1).cast("bigint").alias("block_idx"),
        F.when(head, "heading").otherwise("paragraph").alias("kind"),
        F.when(head, 2).otherwise(0).alias("level"), "text",
    )


def _run_text(runs: Column, fmt: str) -> Column:
    def one(r: Column) -> Column:
        if fmt == "html":
            t = html_escape(r["text"])
            both = F.concat(F.lit("<strong><em>"), t, F.lit("</em></strong>"))
            bold = F.concat(F.lit("<strong>"), t, F.lit("</strong>"))
            ital = F.concat(F.lit("<em>"), t, F.lit("</em>"))
        else:
            t = r["text"]
            both = F.concat(F.lit("***"), t, F.lit("***"))
            bold = F.concat(F.lit("**"), t, F.lit("**"))
            ital = F.concat(F.lit("*"), t, F.lit("*"))
        return F.when(r["bold"] & r["italic"], both).when(r["bold"], bold).when(r["italic"], ital).otherwise(t)

    return F.array_join(F.transform(runs, one), "")


def block_line(fmt: str, block: Column | None = None) -> Column:
    """The rendered line of a block (kind, level, text, runs), given as a struct or as the columns of
    a row; null where it renders to nothing."""
    part = (lambda n: block[n]) if block is not None else F.col
    text, kind, level = strip(part("text")), part("kind"), part("level").cast("string")
    if fmt == "txt":
        return F.when(text != "", part("text"))
    if fmt == "html":
        tag = F.concat(F.lit("h"), level)
        shown = html_escape(text)
        line = (
            F.when(kind == "heading", F.concat(F.lit("<"), tag, F.lit(">"), shown, F.lit("</"), tag, F.lit(">")))
            .when(kind.isin("bullet", "number", "list"), F.concat(F.lit("<li>"), shown, F.lit("</li>")))
            .otherwise(F.concat(F.lit("<p>"), _run_text(part("runs"), fmt), F.lit("</p>")))
        )
        return F.when(text != "", line)
    line = (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), part("level")), F.lit(" "), text))
        .when(kind == "bullet", F.concat(F.lit("- "), text))
        .when(kind == "number", F.concat(F.lit("1. "), text))
        .otherwise(_run_text(part("runs"), fmt))
    )
    return F.when(text == "", "").otherwise(line)


def render_blocks(
    blocks: DataFrame, fmt: str, keys: list[str], pos: str = "block_idx", part_rows: int = PART_ROWS
) -> DataFrame:
    """Block rows to HTML, Markdown or plain text, in parts.

    Blank blocks are dropped in HTML and text and become empty lines in Markdown. Lines are joined
    by one newline, plain text by two.
    """
    joiner = "\n\n" if fmt == "txt" else "\n"
    return glue_parts(blocks, keys, pos, block_line(fmt), joiner, part_rows=part_rows)
