"""Page sequences: select, split, reorder, number, merge and put together.

A page table has one row per (document, page) with pages counted from 1. No operator here gathers
the pages of a document in one task: per-document facts come from partial aggregates and are joined
back, where AQE splits a join partition that one huge document would dominate.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_escape, strip
from .ordered import CHUNK_ROWS, PART_ROWS, dense_positions, glue_parts, nested_positions, running_total


class Outcome(NamedTuple):
    """Good rows, and one row per failed document with its ``error``."""

    rows: DataFrame
    errors: DataFrame


def where_present(df: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is not null, without computing the column again for the test.

    A filter on a computed column is pushed below the projection that computes it and repeats its
    work there; unnesting a one-element array does the same in one evaluation. Not for columns that
    come straight from a Python function, which an unnesting cannot hold.
    """
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.explode(F.array_compact(F.array(column))).alias(column))


def page_counts(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    return pages.groupBy(doc).agg(F.count(F.lit(1)).alias("page_count"))


def select_pages(pages: DataFrame, wanted: list[int] | None, page: str = "page_no") -> DataFrame:
    """Keep the listed pages; numbers outside the document match nothing; None or [] keeps all."""
    return pages.filter(F.col(page).isin(*wanted)) if wanted else pages


def _parse_range(text: str) -> tuple[int, int]:
    low, dash, high = text.strip().partition("-")
    return (int(low), int(high)) if dash else (int(low), int(low))


def split_pages(
    pages: DataFrame, ranges: list[str] | None = None, every: bool = False,
    doc: str = "doc_id", page: str = "page_no", name: str | Column | None = None,
) -> Outcome:
    """Cut documents into named parts: one per page, by ranges such as ``1-3`` or ``7``, or halves.

    Ranges are clamped to the document and may overlap. Halves of a one-page document are an error.
    Adds ``part_idx`` and ``part_name``.
    """
    label = F.col(name or doc) if not isinstance(name, Column) else name
    label = label.cast("string")
    counts = page_counts(pages, doc)
    if every:
        rows = pages.withColumn("part_idx", F.col(page).cast("bigint")).withColumn(
            "part_name", F.concat(label, F.lit("_page"), F.col(page).cast("string"))
        )
        return Outcome(rows, counts.filter("false").select(doc, F.lit(None).cast("string").alias("error")))

    n, here = F.col("page_count"), F.col(page)
    sized = pages.join(counts, doc)
    if not ranges:
        half = F.when(here <= F.floor(n / 2), 1).otherwise(2).cast("bigint")
        rows = (
            sized.filter(n > 1).withColumn("part_idx", half)
            .withColumn("part_name", F.concat(label, F.lit("_part"), F.col("part_idx").cast("string")))
        )
        errors = counts.filter(n < 2).select(doc, F.lit("nothing to put in the first half").alias("error"))
        return Outcome(rows.drop("page_count"), errors)

    # The list of ranges is a parameter, so the range join is an in-row filter over it.
    parts = []
    for idx, (low, high) in enumerate(map(_parse_range, ranges), 1):
        start = F.greatest(F.lit(1), F.least(F.lit(low), n))
        end = F.greatest(start, F.least(F.lit(high), n))
        parts.append(F.struct(F.lit(idx).cast("bigint").alias("idx"), start.alias("lo"), end.alias("hi")))
    hits = F.filter(F.array(*parts), lambda p: here.between(p["lo"], p["hi"]))
    rows = (
        sized.withColumn("__part", F.explode(hits))
        .withColumn("part_idx", F.col("__part.idx"))
        .withColumn(
            "part_name",
            F.concat(label, F.lit("_p"), F.col("__part.lo").cast("string"), F.lit("-"),
                     F.col("__part.hi").cast("string")),
        )
        .drop("__part", "page_count")
    )
    return Outcome(rows, counts.filter("false").select(doc, F.lit(None).cast("string").alias("error")))


def organize(
    pages: DataFrame, order: list[int] | DataFrame, doc: str = "doc_id", page: str = "page_no"
) -> Outcome:
    """Reorder, repeat (named twice) or drop (not named) pages.

    ``order`` is one list for every document or a table (doc, out_page_no, page). Any position
    outside the document fails the whole document and is listed: in one error row for a list, in a
    row per offender for a table. Adds ``out_page_no``.
    """
    counts = page_counts(pages, doc)
    n = F.col("page_count")
    if isinstance(order, list):
        wanted = F.array(*[F.lit(p) for p in order])
        bad = F.filter(wanted, lambda p: (p < 1) | (p > n))
        errors = counts.select(doc, "page_count", bad.alias("bad")).filter(F.size("bad") > 0)
        places = F.filter(
            F.transform(wanted, lambda p, i: F.when(p == F.col(page), (i + 1).cast("bigint"))),
            lambda i: i.isNotNull(),
        )
        moved = pages.withColumn("out_page_no", F.explode(places))
    else:
        # An order table has no size limit, so each offender is an error row of its own.
        outside = order.join(counts, doc).filter((F.col(page) < 1) | (F.col(page) > n))
        errors = outside.select(doc, "page_count", F.array(page).alias("bad"))
        moved = pages.join(order.select(doc, page, "out_page_no"), [doc, page])
    message = F.concat(
        F.lit("Page numbers out of range (document has "), n.cast("string"), F.lit(" pages): ["),
        F.array_join(F.transform("bad", lambda p: p.cast("string")), ", "), F.lit("]"),
    )
    errors = errors.withColumn("error", message).select(doc, "error")
    return Outcome(moved.join(errors.select(doc), doc, "left_anti"), errors)


def suppress_table_text(
    lines: DataFrame, cells: DataFrame, line: str = "line", cell: str = "text",
    on: tuple[str, ...] = ("doc_id", "page_no"),
) -> DataFrame:
    """Drop the lines that equal, after stripping, a cell of a table on the same page."""
    known = cells.select(*on, strip(F.col(cell)).alias("__text")).filter(F.col("__text") != "")
    return (
        lines.withColumn("__text", strip(F.col(line)))
        .join(known, [*on, "__text"], "left_anti").drop("__text")
    )


def concat_pages(
    pages: DataFrame, separator: str = "\n\n--- Page {page} ---\n\n", doc: str = "doc_id",
    page: str = "page_no", text: str = "text", part_rows: int = PART_ROWS,
) -> DataFrame:
    """Text of each document; the separator, with its page number, goes before every page but the
    lowest that the document has. Adds ``char_count`` of the page texts alone."""
    mark = F.coalesce(F.replace(F.lit(separator), F.lit("{page}"), F.col(page).cast("string")), F.lit(""))
    body = F.coalesce(F.col(text), F.lit(""))
    marked = pages.select(doc, page, F.concat(mark, body).alias("__marked"), F.length(body).alias("__chars"))
    # One small row per document: how long the first separator is, which goes again.
    lowest = pages.groupBy(doc).agg(F.min(page).alias(page)).select(doc, page, F.length(mark).alias("__skip"))
    every = marked.unionByName(lowest, allowMissingColumns=True)
    glued = glue_parts(every, [doc], page, "__marked", part_rows=part_rows, skip=F.col("__skip"), char_count=F.col("__chars"))
    kept = F.substring("text", F.coalesce(F.col("skip"), F.lit(0)).cast("int") + 1, F.length("text"))
    return glued.withColumn("text", kept).drop("skip")


def page_sizes(
    pages: DataFrame, doc: str = "doc_id", page: str = "page_no", width: str = "width_pt",
    height: str = "height_pt",
) -> DataFrame:
    """Page sizes rounded to two places, one row per page."""
    return pages.select(doc, page, F.round(width, 2).alias(width), F.round(height, 2).alias(height))


def document_info(pages: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Page, character and byte counts per document; sizes per page are :func:`page_sizes`."""
    return pages.groupBy(doc).agg(
        F.count(F.lit(1)).alias("page_count"),
        F.sum(F.length(text)).alias("char_count"),
        F.sum(F.octet_length(text)).alias("total_bytes"),
    )


def number_pages(
    pages: DataFrame, start: int = 1, position: str = "bottom-center", font_size: int = 11,
    margin: int = 20, doc: str = "doc_id", page: str = "page_no", width: str = "width_pt",
    height: str = "height_pt", gaps: bool = False, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Sequence number and anchor point of each page. Pages without gaps need no shuffle at all;
    set ``gaps`` when page numbers are missing."""
    src = dense_positions(pages, [doc], page, "__seq", 1, chunk_rows) if gaps else pages.withColumn(
        "__seq", F.col(page)
    )
    number = (F.col("__seq") + F.lit(start - 1)).cast("bigint")
    digits = F.length(number.cast("string"))
    place = position.lower()
    y = F.col(height) - margin if "bottom" in place else F.lit(float(margin + font_size))
    if "center" in place:
        x = F.col(width) / 2 - digits * F.lit(float(font_size)) * 0.3
    elif "right" in place:
        x = F.col(width) - margin - digits * F.lit(float(font_size)) * 0.6
    else:
        x = F.lit(float(margin))
    return (
        src.withColumn("number", number).withColumn("x", x.cast("double"))
        .withColumn("y", y.cast("double")).drop("__seq")
    )


def merge_sequences(
    pages: DataFrame, order: DataFrame, merge_keys: list[str], position: str = "position",
    doc: str = "doc_id", page: str = "page_no", chunk_rows: int = CHUNK_ROWS,
) -> Outcome:
    """Documents of each list one after the other, pages numbered on continuously.

    ``order`` holds (merge keys, position, doc). Offsets are running totals over the small
    per-document counts, not over the pages. A list of fewer than two documents is an error. Without
    merge keys there is one list: its error row says when it is too short, and no join with that one
    row is made.
    """
    counts = page_counts(pages, doc)
    sized = order.join(counts, doc)
    offsets = running_total(sized, merge_keys, position, "page_count", "page_offset", chunk_rows)
    per_list = order.groupBy(*merge_keys).agg(F.count(F.lit(1)).alias("files_merged"))
    errors = per_list.filter("files_merged < 2").select(
        *merge_keys, F.lit("Provide at least two inputs.").alias("error")
    )
    good = offsets.join(errors.select(*merge_keys), merge_keys, "left_anti") if merge_keys else offsets
    rows = (
        pages.join(good.select(*merge_keys, position, doc, "page_offset"), doc)
        .withColumn("merged_page_no", (F.col(page) + F.col("page_offset")).cast("bigint"))
        .drop("page_offset")
    )
    return Outcome(rows, errors)


def merge_totals(pages: DataFrame, order: DataFrame, merge_keys: list[str], doc: str = "doc_id") -> DataFrame:
    return (
        order.join(page_counts(pages, doc), doc).groupBy(*merge_keys)
        .agg(F.count(F.lit(1)).alias("files_merged"), F.sum("page_count").alias("total_pages"))
    )


def render_slides(
    paragraphs: DataFrame, fmt: str = "txt", doc: str = "doc_id", slide: str = "slide_no",
    para: str = "para_idx", text: str = "text", part_rows: int = PART_ROWS,
) -> DataFrame:
    """Slide decks as text (``--- Slide n ---`` headers) or HTML sections.

    Slides count from 1 and so do paragraphs; every slide has a paragraph 1, blank or null when it
    has no text, which brings the slide's header (and the end of the slide before it) along. The
    lines of a deck are numbered and put together in parts, so neither a long deck nor a long slide
    meets a size limit.
    """
    body = strip(F.coalesce(F.col(text), F.lit("")))
    no = F.col(slide).cast("string")
    if fmt == "html":
        shown = F.concat(F.lit("<p>"), html_escape(body), F.lit("</p>"))
        head = F.concat(F.lit('<section id="slide-'), no, F.lit('"><h2>Slide '), no, F.lit("</h2>"))
        head = F.when(F.col(slide) > 1, F.concat(F.lit("</section>\n"), head)).otherwise(head)
    else:
        shown, head = body, F.concat(F.lit("--- Slide "), no, F.lit(" ---"))
    line = F.concat_ws("\n", F.when(F.col(para) == 1, head), F.when(body != "", shown))
    rows = paragraphs.filter((body != "") | (F.col(para) == 1)).select(
        doc, F.col(slide).cast("bigint").alias("__slide"), F.col(para).cast("bigint").alias("__para"), line.alias("__text"))
    if fmt == "html":
        ends = paragraphs.groupBy(doc).agg(F.max(slide).cast("bigint").alias("__last"))
        rows = rows.unionByName(ends.select(
            doc, (F.col("__last") + 1).alias("__slide"), F.lit(0).cast("bigint").alias("__para"), F.lit("</section>").alias("__text")))
    numbered = nested_positions(rows, [doc], "__slide", "__para", "__line")
    return glue_parts(numbered, [doc], "__line", "__text", "\n", part_rows=part_rows)
