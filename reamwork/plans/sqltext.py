"""Pieces of SQL used by the comparison queries (DuckDB dialect)."""

from __future__ import annotations

from ..functions.text import HTML_ESCAPES, MARKDOWN_RULES, PAGE_HEAD, PAGE_MID, PAGE_TAIL, SPACE


def lit(text: str) -> str:
    """A string literal; line breaks are put in by chr(10)."""
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def not_blank(x: str) -> str:
    return f"regexp_matches({x}, '[^{SPACE}]')"


def escape(x: str) -> str:
    for char, entity in HTML_ESCAPES:
        x = f"replace({x}, {lit(char)}, {lit(entity)})"
    return x


def xml_escape(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def unescape(x: str) -> str:
    """Decodes the entities the page table holds; the ampersand last, also without semicolon."""
    for entity, char in (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">")):
        x = f"replace({x}, '{entity}', {lit(char)})"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


def markdown_to_text(x: str) -> str:
    for pattern, replacement in MARKDOWN_RULES:
        flags = "(?m)" if pattern.startswith("(?md)") else ""
        bare = pattern.removeprefix("(?md)").removeprefix("(?d)")
        x = f"regexp_replace({x}, {lit(flags + bare)}, {lit(replacement.replace('$1', chr(92) + '1'))}, 'g')"
    return x


def wrap(body: str, title: str) -> str:
    return f"{lit(PAGE_HEAD)} || {escape(title)} || {lit(PAGE_MID)} || {body} || {lit(PAGE_TAIL)}"


def lines(source: str, keys: str, text: str) -> str:
    """Rows (keys, i, line) of the lines of a text column, i from 1."""
    return (
        f"SELECT {keys}, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line "
        f"FROM (SELECT {keys}, string_split({text}, chr(10)) AS ls FROM {source})"
    )
