"""OCR result blocks: (keys, block_idx, bbox, text, confidence) rows to text, JSON, HTML, Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_escape, preview, strip
from .ordered import PART_ROWS, glue_framed, glue_parts

# Fixed value: what stands between the pages of recognised text.
PAGE_BREAK = "\n\n--- Page Break ---\n\n"


def assemble_ocr(
    blocks: DataFrame, fmt: str, keys: list[str], pos: str = "block_idx", part_rows: int = PART_ROWS
) -> DataFrame:
    """Recognised blocks of an image put together; ``text_blocks`` counts all of them.

    Text and HTML keep every block, Markdown drops blank ones; JSON rounds confidence to 4 places.
    JSON parts are valid arrays of their own.
    """
    count = {"text_blocks": F.lit(1)}
    text = F.coalesce(F.col("text"), F.lit(""))
    if fmt == "json":
        record = F.to_json(
            F.struct(text.alias("text"), F.round("confidence", 4).alias("confidence"), "bbox"), {"ignoreNullFields": "false"})
        out = glue_parts(blocks, keys, pos, record, ",", part_rows=part_rows, **count)
        return out.withColumn("text", F.concat(F.lit("["), F.col("text"), F.lit("]")))
    if fmt == "html":
        line, joiner = F.concat(F.lit("<p>"), html_escape(text), F.lit("</p>")), "\n"
    elif fmt == "markdown":
        line, joiner = F.when(strip(text) != "", text), "\n\n"
    else:
        line, joiner = text, "\n"
    return glue_parts(blocks, keys, pos, line, joiner, part_rows=part_rows, **count)


# The page shell around recognised text.
_HTML_HEAD = '<!DOCTYPE html>\n<html lang="en"><head><meta charset="UTF-8"><title>'
_HTML_MID = (
    "</title><style>body{font-family:sans-serif;max-width:900px;margin:auto;padding:2em}"
    "p{margin:0.3em 0}</style></head><body>\n"
)
_HTML_TAIL = "\n</body></html>"


def ocr_document(
    blocks: DataFrame, fmt: str, keys: list[str], title: Column, pos: str = "block_idx",
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Recognised blocks as a titled HTML page or Markdown document, in parts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    if fmt == "html":
        line = F.concat(F.lit("<p>"), html_escape(text), F.lit("</p>"))
        head = F.concat(F.lit(_HTML_HEAD), html_escape(title), F.lit(_HTML_MID))
        return glue_framed(blocks, keys, pos, line, head, F.lit(_HTML_TAIL), "\n", part_rows=part_rows, text_blocks=F.lit(1))
    # an empty line of its own follows the title, before the first block of the lowest position that has text
    head = F.concat(F.lit("# "), title, F.lit("\n\n\n"))
    shown = F.when(strip(text) != "", text)
    glued = glue_framed(blocks, keys, pos, shown, head, F.lit(""), "\n\n", part_rows=part_rows, text_blocks=F.lit(1))
    return glued.withColumn("text", F.regexp_replace("text", r"\A(# [^\n]*\n)\n\n\z", "$1"))


def ocr_preview(assembled: DataFrame, n: int = 500) -> DataFrame:
    """First characters of each assembled text. The first part is longer than any preview or is
    all there is, so no other part is read; the count covers all parts."""
    keys = [c for c in assembled.columns if c not in ("part_no", "text", "text_blocks")]
    return assembled.groupBy(*keys).agg(
        F.max(F.when(F.col("part_no") == 0, preview(F.col("text"), n))).alias("preview"),
        F.sum(F.length("text")).alias("char_count"),
    )
