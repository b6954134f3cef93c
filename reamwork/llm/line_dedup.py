"""Line deduplication over overlapping windows of three lines.

A line counts when it holds a word; it is compared without ASCII white space at its ends. Each
three such lines in a row make a window. Windows found more than once in the corpus, told apart by
two independent 64-bit hashes, lose all occurrences but the first by (document, position): the lines
that any later occurrence covers are merged per document and cut out. Lines without a word stay.

Only hashes and positions are shuffled to find the windows. How often a window occurs is a partial
aggregate, so a window that a third of the corpus holds costs one row per map task; the join that
marks later occurrences is an ordinary one that adaptive execution splits. A document gathers its
own positions only. The last join brings the marked lines to the texts by document.

Defined results: a null text stays null and an empty one empty; a text of fewer than three lines with
words has no window and stays as it is; between equal windows the lower document id, then the lower
position, is the first, null ids before others; rows that repeat an id are one document to this operator: the
same lines are cut from each of them, and their own equal windows are no repetition of each other;
an empty table gives an empty table; other columns are kept and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, boxed, field, first_n, unboxed

LINES_IN_WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _content(lines: str | Column) -> Column:
    """The lines with a word: position from zero, and the trimmed line."""
    return F.filter(
        F.transform(lines, lambda line, i: F.struct(i.alias("i"), F.btrim(line, F.lit(SPACE_CHARS)).alias("line"))),
        lambda x: x["line"] != "",
    )


def windows(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``id, k, a, b``: the window that begins at the k-th line with a word, and its two hashes."""
    content = boxed(df).select(field(doc_id).alias("id"), _content(_lines(field(text))).alias("content"))
    hashed = content.select(
        "id", F.transform("content", lambda x: F.xxhash64(x["line"])).alias("a"),
        F.transform("content", lambda x: F.xxhash64(F.lit(3), x["line"])).alias("b"),
    )
    each = F.transform(first_n(F.size("a") - F.lit(LINES_IN_WINDOW - 1)), lambda k: F.struct(
        k.alias("k"), F.xxhash64(F.slice("a", k, LINES_IN_WINDOW)).alias("a"),
        F.xxhash64(F.lit(3), F.slice("b", k, LINES_IN_WINDOW)).alias("b"),
    ))
    # The outer form: the plain one would test the costly array's size in a filter of its own.
    rows = hashed.select("id", F.explode_outer(each).alias("w")).filter(F.col("w").isNotNull())
    return rows.select("id", "w.k", "w.a", "w.b")


def mark_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The input boxed as ``row``, its ``lines`` and the positions ``kept`` of those that stay."""
    found = windows(df, doc_id, text)
    repeated = (
        found.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "k")).alias("first"))
        .filter("n > 1").select("a", "b", "first")
    )
    later = (
        found.join(repeated, ["a", "b"]).filter(~F.struct("id", "k").eqNullSafe(F.col("first")))
        .groupBy("id").agg(F.collect_set("k").alias("starts"))
    )
    texts = boxed(df).withColumn("id", field(doc_id))
    joined = texts.join(later, texts["id"].eqNullSafe(later["id"]), "left").select("row", "starts")
    split = joined.select("row", "starts", _lines(field(text)).alias("lines"))
    placed = split.withColumn("content", F.when(F.col("starts").isNotNull(), F.transform(_content("lines"), lambda x: x["i"])))
    cut = F.flatten(F.transform("starts", lambda k: F.slice("content", k, LINES_IN_WINDOW)))
    return placed.select("row", "lines", F.array_except(
        F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce(cut, F.array().cast("array<int>")),
    ).alias("kept"))


def _rest(text: str) -> Column:
    whole = F.size("kept") == F.size("lines")
    return F.when(whole, field(text)).otherwise(
        F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n"))


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without the lines of later windows, with the columns they came with."""
    return unboxed(mark_lines(df, doc_id, text), df.columns, **{text: _rest(text)})


def line_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: how many lines it has and loses, and the text that stays."""
    return mark_lines(df, doc_id, text).select(
        field(doc_id).alias("doc_id"), F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("bigint").alias("n_removed"), _rest(text).alias("text"),
    )


#: DuckDB SQL over any table {docs} with doc_id and text: the rows of line_dedup, on the lines themselves.
SQL = r"""
WITH lines AS (
  SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM {docs}),
placed AS (
  SELECT doc_id, unnest(range(1, len(ls) + 1)) AS p, unnest(ls) AS line FROM lines),
content AS (
  SELECT doc_id, p, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line,
    row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k
  FROM placed WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
windows AS (
  SELECT a.doc_id, a.k, a.line || chr(10) || b.line || chr(10) || c.line AS w
  FROM content a JOIN content b ON a.doc_id = b.doc_id AND b.k = a.k + 1
  JOIN content c ON a.doc_id = c.doc_id AND c.k = a.k + 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, k) AS nth FROM windows),
cut AS (
  SELECT DISTINCT c.doc_id, c.p FROM ranked r
  JOIN content c ON c.doc_id = r.doc_id AND c.k BETWEEN r.k AND r.k + 2 WHERE r.nth > 1),
rest AS (
  SELECT p.doc_id, count(*) AS n, string_agg(p.line, chr(10) ORDER BY p.p) AS t
  FROM placed p ANTI JOIN cut c ON p.doc_id = c.doc_id AND p.p = c.p GROUP BY p.doc_id)
SELECT l.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - coalesce(r.n, 0) AS BIGINT) AS n_removed,
  CASE WHEN coalesce(r.n, 0) = len(ls) THEN l.text ELSE coalesce(r.t, '') END AS text
FROM lines l LEFT JOIN rest r USING (doc_id)
"""

ORACLE_SQL = SQL.replace("{docs}", "documents")
