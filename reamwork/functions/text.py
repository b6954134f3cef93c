"""Text functions: Column in, Column out, all inside the JVM.

Regular expressions use ``(?d)`` so that only ``\\n`` ends a line, and an explicit whitespace
class, because the semantics to match are those of Unicode-aware ``strip``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters a Unicode-aware strip() removes.
SPACE = r"\s\x0b\x1c-\x1f\x85\p{Z}"

# Fixed value: the nine replacements that strip Markdown, in the order that decides the result.
# Links go before images, so "![alt](u)" leaves "!alt".
MARKDOWN_RULES = [
    (rf"(?md)^#{{1,6}}[{SPACE}]+", ""),
    (r"(?d)\*\*\*(.*?)\*\*\*", "$1"),
    (r"(?d)\*\*(.*?)\*\*", "$1"),
    (r"(?d)\*(.*?)\*", "$1"),
    (r"(?d)`(.*?)`", "$1"),
    (rf"(?md)^[-*+][{SPACE}]+", ""),
    (rf"(?md)^\p{{Nd}}+\.[{SPACE}]+", ""),
    (r"\[([^\]]+)\]\([^\)]+\)", "$1"),
    (r"!\[([^\]]*)\]\([^\)]+\)", "$1"),
]

# Fixed value: the five characters escaped in HTML text, ampersand first.
HTML_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]

# Fixed value: the page shell around a converted body.
PAGE_HEAD = '<!DOCTYPE html>\n<html lang="en">\n<head>\n  <meta charset="UTF-8">\n  <title>'
PAGE_MID = (
    "</title>\n  <style>body{font-family:sans-serif;max-width:800px;margin:auto;padding:2em}</style>\n"
    "</head>\n<body>\n"
)
PAGE_TAIL = "\n</body>\n</html>"


def quoted(name: str) -> str:
    """A column name as an expression, whatever characters it has."""
    return f"`{name.replace('`', '``')}`"


def strip(col: Column) -> Column:
    return F.regexp_replace(col, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def is_blank(col: Column) -> Column:
    return ~F.regexp_like(col, F.lit(rf"[^{SPACE}]"))


def lines(col: Column) -> Column:
    """Split on ``\\n``; a trailing newline yields a last empty line."""
    return F.split(col, "\n")


def markdown_to_text(col: Column) -> Column:
    for pattern, replacement in MARKDOWN_RULES:
        col = F.regexp_replace(col, pattern, replacement)
    return col


def html_escape(col: Column) -> Column:
    for char, entity in HTML_ESCAPES:
        col = F.replace(col, F.lit(char), F.lit(entity))
    return col


def line_kind(line: Column, numbered: bool = True) -> Column:
    """One-character kind of a Markdown line: 1-3 heading, B bullet, N numbered, X blank, T text."""
    kind = (
        F.when(line.startswith("### "), "3")
        .when(line.startswith("## "), "2")
        .when(line.startswith("# "), "1")
        .when(line.startswith("- ") | line.startswith("* "), "B")
    )
    if numbered:
        kind = kind.when(F.regexp_like(line, F.lit(r"^\p{Nd}+\. ")), "N")
    return kind.when(is_blank(line), "X").otherwise("T")


def markdown_to_html(col: Column) -> Column:
    """Headings, bullet lists and paragraphs of one Markdown text, in one pass over the row.

    The list state is found with one regular expression over the string of line kinds: a run
    starts at a bullet, goes on over bullets and headings (a heading does not close a list) and
    ends at the next text or blank line, or at the end marker Z.
    """
    ls = lines(html_escape(col))
    kinds = F.concat(
        F.array_join(F.transform(ls, lambda x: line_kind(x, numbered=False)), ""), F.lit("Z")
    )
    marks = F.regexp_replace(kinds, "B([B123]*)([TXZ])", "O$1c$2")
    for pair, mark in (("cT", "C"), ("cX", "D"), ("cZ", "E")):
        marks = F.replace(marks, F.lit(pair), F.lit(mark))
    marks = F.filter(F.split(marks, ""), lambda m: m != "")

    def render(line: Column, mark: Column) -> Column:
        item = F.concat(F.lit("<li>"), F.substr(line, F.lit(3)), F.lit("</li>"))
        para = F.concat(F.lit("<p>"), line, F.lit("</p>"))
        return (
            F.when(mark == "T", para)
            .when(mark == "B", item)
            .when(mark == "O", F.concat(F.lit("<ul>\n"), item))
            .when(mark == "C", F.concat(F.lit("</ul>\n"), para))
            .when(mark.isin("D", "E"), F.lit("</ul>"))
            .when(mark == "1", F.concat(F.lit("<h1>"), F.substr(line, F.lit(3)), F.lit("</h1>")))
            .when(mark == "2", F.concat(F.lit("<h2>"), F.substr(line, F.lit(4)), F.lit("</h2>")))
            .when(mark == "3", F.concat(F.lit("<h3>"), F.substr(line, F.lit(5)), F.lit("</h3>")))
        )

    return F.array_join(F.zip_with(ls, marks, render), "\n")


# One Markdown inline token, and a gap between tokens. Two marks of one sort always form a token,
# so a gap holds at most one star and one backtick: the repetition is bounded.
_TOKEN = r"\*\*\*.*?\*\*\*|\*\*.*?\*\*|\*.*?\*|`.*?`"
_LONE = r"(?:(?!\*.*?\*|`.*?`)[*`][^*`]*)"
_INLINE = rf"(?d){_TOKEN}|[^*`]+{_LONE}{{0,2}}|{_LONE}{{1,2}}"


def inline_runs(col: Column) -> Column:
    """Runs of one line: ARRAY<STRUCT<text, bold, italic, code>>, empty runs left out."""

    def run(part: Column) -> Column:
        def marked(mark: str) -> Column:
            return part.startswith(mark) & part.endswith(mark)

        both, bold, ital, code = (marked(m) for m in ("***", "**", "*", "`"))
        cut = F.when(both, 3).when(bold, 2).when(ital | code, 1).otherwise(0)
        body = F.substr(part, cut + 1, F.greatest(F.length(part) - cut * 2, F.lit(0)))
        return F.struct(
            body.alias("text"),
            (both | bold).alias("bold"),
            (both | (ital & ~bold)).alias("italic"),
            (code & ~ital).alias("code"),
        )

    runs = F.transform(F.regexp_extract_all(col, F.lit(_INLINE), F.lit(0)), run)
    return F.filter(runs, lambda r: r["text"] != "")


def text_to_html(col: Column) -> Column:
    """Each line to a paragraph, a blank line to a break."""
    return F.array_join(
        F.transform(
            lines(html_escape(col)),
            lambda x: F.when(is_blank(x), "<br>").otherwise(F.concat(F.lit("<p>"), x, F.lit("</p>"))),
        ),
        "\n",
    )


def wrap_html(body: Column, title: Column) -> Column:
    return F.concat(F.lit(PAGE_HEAD), html_escape(title), F.lit(PAGE_MID), body, F.lit(PAGE_TAIL))


def is_heading(line: Column) -> Column:
    """A short upper-case line: under 60 characters, at least one cased letter, none lower-case."""
    return (F.length(line) < 60) & (F.upper(line) == line) & (F.lower(line) != line)


def content_line_array(col: Column) -> Column:
    """Stripped, non-blank lines of one text, in order."""
    return F.filter(F.transform(lines(col), strip), lambda x: x != "")


def extracted_page_html(text: Column, page_no: Column) -> Column:
    """One page of extracted text as an HTML section."""
    body = F.transform(
        content_line_array(text),
        lambda x: F.when(is_heading(x), F.concat(F.lit("  <h2>"), html_escape(x), F.lit("</h2>")))
        .otherwise(F.concat(F.lit("  <p>"), html_escape(x), F.lit("</p>"))),
    )
    no = page_no.cast("string")
    return F.concat(
        F.lit('<section id="page-'), no, F.lit('">\n  <h3 class="page-label">Page '), no,
        F.lit("</h3>\n"), F.array_join(body, "\n"), F.lit("\n</section>"),
    )


def extracted_page_markdown(text: Column) -> Column:
    """One page of extracted text as Markdown: short upper-case lines become level-2 headings."""
    body = F.transform(
        content_line_array(text),
        lambda x: F.when(is_heading(x), F.concat(F.lit("\n## "), x, F.lit("\n"))).otherwise(x),
    )
    return F.array_join(body, "\n")


def preview(col: Column, n: int = 500) -> Column:
    """The first n characters; three dots follow only when something was cut off."""
    return F.concat(F.substring(col, 1, n), F.when(F.length(col) > n, "...").otherwise(""))


def number_text(col: Column) -> Column:
    """A double as text in plain notation between 1e-4 and 1e16, as str(float) prints it."""
    raw = col.cast("string")
    size = F.abs(col)
    plain = ((size >= 1e7) & (size < 1e16)) | ((size >= 1e-4) & (size < 1e-3))
    digits = F.regexp_replace(
        F.when(plain, raw).otherwise("0").cast("decimal(38,20)").cast("string"), "0+$", ""
    )
    digits = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    return F.when(F.isnan(col), "nan").when(plain, digits).otherwise(raw)
