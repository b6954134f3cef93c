"""Page-sequence queries: a conversation is a document, a turn is a page."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..operators import blocks, ocr, ordered, sequence, tables
from . import sqltext as q
from .registry import query, spread, table

PAGED = """
p AS (SELECT conv_id AS doc_id, turn + 1 AS page_no, text, 500 + (conv_id % 7) * 16.1111::DOUBLE AS width_pt,
  700 + turn * 5.5171::DOUBLE AS height_pt FROM conversations),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM p GROUP BY doc_id)"""


def page_table(spark, sf_dir, *columns):
    conv = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    paged = conv.select(
        F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_no"), "text",
        (F.lit(500) + (F.col("conv_id") % 7) * F.lit(16.1111)).alias("width_pt"),
        (F.lit(700) + F.col("turn") * F.lit(5.5171)).alias("height_pt"),
    )
    return paged.select(*columns) if columns else paged


@query("prj02_select_pages", f"WITH {PAGED} SELECT doc_id, page_no, text FROM p WHERE page_no IN (1, 3, 99)")
def prj02(spark, sf_dir):
    return sequence.select_pages(page_table(spark, sf_dir, "doc_id", "page_no", "text"), [1, 3, 99])


@query("prj03_split_pages_ranges", f"""
WITH {PAGED}, r AS (SELECT * FROM (VALUES (1, 1, 2), (2, 2, 5), (3, 7, 7), (4, 0, 1)) v(idx, lo, hi)),
c AS (SELECT doc_id, idx, greatest(1, least(lo, n)) AS lo, greatest(greatest(1, least(lo, n)), least(hi, n)) AS hi FROM r, n)
SELECT p.doc_id, page_no, idx::BIGINT AS part_idx, p.doc_id || '_p' || lo || '-' || hi AS part_name
FROM p JOIN c ON p.doc_id = c.doc_id AND page_no BETWEEN lo AND hi""")
def prj03_ranges(spark, sf_dir):
    pages = page_table(spark, sf_dir, "doc_id", "page_no")
    return sequence.split_pages(pages, ["1-2", " 2-5", "7", "0-1"]).rows


@query("prj03_split_pages_halves", f"""
WITH {PAGED}, half AS (SELECT doc_id, page_no, CASE WHEN page_no <= n // 2 THEN 1 ELSE 2 END AS part FROM p JOIN n USING (doc_id) WHERE n > 1)
SELECT doc_id, page_no, part::BIGINT AS part_idx, doc_id || '_part' || part AS part_name, NULL::VARCHAR AS error FROM half
UNION ALL SELECT doc_id, NULL, NULL, NULL, 'nothing to put in the first half' FROM n WHERE n < 2""")
def prj03_halves(spark, sf_dir):
    done = sequence.split_pages(page_table(spark, sf_dir, "doc_id", "page_no"))
    return done.rows.unionByName(done.errors, allowMissingColumns=True)


@query("prj03_split_every_page", f"""
WITH {PAGED} SELECT doc_id, page_no, page_no AS part_idx, doc_id || '_page' || page_no AS part_name FROM p""")
def prj03_every(spark, sf_dir):
    return sequence.split_pages(page_table(spark, sf_dir, "doc_id", "page_no"), every=True).rows


@query("jn01_organize", f"""
WITH {PAGED}, o AS (SELECT * FROM (VALUES (1, 3), (2, 1), (3, 1), (4, 2)) v(out_page_no, page_no))
SELECT doc_id, p.page_no, text, out_page_no::BIGINT AS out_page_no FROM p JOIN o USING (page_no) JOIN n USING (doc_id) WHERE n >= 3""")
def jn01(spark, sf_dir):
    return sequence.organize(page_table(spark, sf_dir, "doc_id", "page_no", "text"), [3, 1, 1, 2]).rows


@query("jn01_organize_offenders", f"""
WITH {PAGED} SELECT doc_id, 'Page numbers out of range (document has ' || n || ' pages): [' ||
  CASE WHEN n < 2 THEN '2, ' ELSE '' END || CASE WHEN n < 5 THEN '5, ' ELSE '' END || '99]' AS error FROM n""")
def jn01_errors(spark, sf_dir):
    return sequence.organize(page_table(spark, sf_dir, "doc_id", "page_no"), [1, 2, 5, 99]).errors


# Every document backwards, by a table of orders; documents whose number ends in 3 ask for a page too many.
@query("jn01_organize_by_table", f"""
WITH {PAGED}, good AS (SELECT p.doc_id, page_no, n + 1 - page_no AS out_page_no, NULL::VARCHAR AS error FROM p JOIN n USING (doc_id)
  WHERE p.doc_id % 10 <> 3)
SELECT * FROM good UNION ALL SELECT doc_id, NULL, NULL, 'Page numbers out of range (document has ' || n || ' pages): [' ||
  (n + 1) || ']' FROM n WHERE doc_id % 10 = 3""")
def jn01_table(spark, sf_dir):
    pages = page_table(spark, sf_dir, "doc_id", "page_no")
    counts = sequence.page_counts(pages)
    backwards = pages.join(counts, "doc_id").select(
        "doc_id", "page_no", (F.col("page_count") + 1 - F.col("page_no")).alias("out_page_no")
    )
    beyond = counts.filter("doc_id % 10 = 3").select(
        "doc_id", (F.col("page_count") + 1).alias("page_no"), (F.col("page_count") + 1).alias("out_page_no")
    )
    done = sequence.organize(pages, backwards.unionByName(beyond))
    return done.rows.unionByName(done.errors, allowMissingColumns=True)


# Cells of a page: every third line of it, padded; the rest are its text lines.
@query("jn02_suppress_table_text", f"""
WITH ln AS ({q.lines('conversations', 'conv_id, turn', 'text')}),
c AS (SELECT conv_id, turn, {q.strip('line')} AS cell FROM ln WHERE i % 3 = 0)
SELECT conv_id AS doc_id, turn + 1 AS page_no, i::BIGINT AS line_no, line FROM ln WHERE {q.not_blank('line')} AND NOT EXISTS
  (SELECT 1 FROM c WHERE c.conv_id = ln.conv_id AND c.turn = ln.turn AND cell = {q.strip('line')} AND cell <> '')""")
def jn02(spark, sf_dir):
    pages = spread(page_table(spark, sf_dir, "doc_id", "page_no", "text"))
    lines = blocks.content_lines(pages, ["doc_id", "page_no"])
    every = pages.select("doc_id", "page_no", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    cells = every.filter((F.col("i") + 1) % 3 == 0).select(
        "doc_id", "page_no", F.concat(F.lit("  "), "line", F.lit("\t")).alias("text")
    )
    return sequence.suppress_table_text(lines, cells)


# A table on every page: its first, third, fifth line and so on, beside a column of equal cells.
@query("jn02_pages_to_markdown", f"""
WITH ln AS ({q.lines('conversations', 'conv_id, turn', 'text')}),
t AS (SELECT conv_id, turn, i, {q.strip('line')} AS line FROM ln WHERE {q.not_blank('line')}),
cell AS (SELECT conv_id, turn, (i - 1) // 2 AS row_idx, {q.strip('line')} AS cell FROM ln WHERE i % 2 = 1),
every AS (
  SELECT conv_id, turn, 0 AS k, 0 AS n, chr(10) || chr(10) || '---' || chr(10) AS s FROM conversations WHERE turn > 0
  UNION ALL SELECT conv_id, turn, 1, row_idx, '| ' || cell || ' | c |' || CASE WHEN row_idx = 0 THEN chr(10) || '| --- | --- |' ELSE '' END FROM cell
  UNION ALL SELECT conv_id, turn, 2, i, CASE WHEN length(line) < 60 AND upper(line) = line AND lower(line) <> line THEN chr(10) || '## ' || line || chr(10) ELSE line END
    FROM t WHERE line <> 'c' AND NOT EXISTS (SELECT 1 FROM cell WHERE cell.conv_id = t.conv_id AND cell.turn = t.turn AND cell = line))
SELECT conv_id AS doc_id, 0::BIGINT AS part_no, string_agg(s, chr(10) ORDER BY turn, k, n) AS text FROM every GROUP BY conv_id""")
def jn02_markdown(spark, sf_dir):
    pages = spread(page_table(spark, sf_dir, "doc_id", "page_no", "text"))
    odd = F.filter(F.split("text", "\n"), lambda _, i: i % 2 == 0)
    grid = pages.select("doc_id", "page_no", F.posexplode(odd).alias("row_idx", "line"))
    cells = grid.select("doc_id", "page_no", F.lit(0).alias("table_idx"), "row_idx",
                        F.posexplode(F.array("line", F.lit("c"))).alias("col_idx", "text"))
    return tables.pages_to_markdown(pages, cells)


# Pages of more than one line have a table of their lines; documents without any go to
# a sheet of text lines.
@query("win06_workbook_cells", f"""
WITH ln AS ({q.lines('conversations', 'conv_id, turn', 'text')}), n AS (SELECT conv_id, turn, max(i) AS n FROM ln GROUP BY ALL),
c AS (SELECT ln.* FROM ln JOIN n USING (conv_id, turn) WHERE n > 1)
SELECT conv_id AS doc_id, 'Page' || (turn + 1) || '_T1' AS sheet_name, turn + 1 AS page, (i - 1)::INT AS row_idx, 0 AS col_idx, line AS text FROM c
UNION ALL SELECT conv_id, 'Text', turn + 1, (i - 1)::INT, 0, line FROM ln WHERE conv_id NOT IN (SELECT conv_id FROM c)""")
def win06_workbook(spark, sf_dir):
    pages = spread(page_table(spark, sf_dir, "doc_id", "page_no", "text"))
    ls = F.split("text", "\n")
    grid = pages.filter(F.size(ls) > 1).select(
        "doc_id", "page_no", F.lit(0).alias("table_idx"), F.posexplode(ls).alias("row_idx", "text"))
    return tables.workbook_cells(grid.withColumn("col_idx", F.lit(0)), pages)


@query("agg01_ocr_page_break", f"""
WITH {PAGED} SELECT doc_id, 0::BIGINT AS part_no, string_agg(text, chr(10) || chr(10) || '--- Page Break ---' || chr(10) || chr(10) ORDER BY page_no) AS text,
  sum(length(text))::BIGINT AS char_count FROM p GROUP BY doc_id""")
def agg01_break(spark, sf_dir):
    return sequence.concat_pages(page_table(spark, sf_dir, "doc_id", "page_no", "text"), ocr.PAGE_BREAK)


@query("agg01_concat_pages", f"""
WITH {PAGED} SELECT doc_id, 0::BIGINT AS part_no, string_agg(CASE WHEN page_no > 1 THEN chr(10) || chr(10) || '--- Page ' || page_no || ' ---' ||
  chr(10) || chr(10) ELSE '' END || text, '' ORDER BY page_no) AS text, sum(length(text))::BIGINT AS char_count FROM p GROUP BY doc_id""")
def agg01(spark, sf_dir):
    return sequence.concat_pages(page_table(spark, sf_dir, "doc_id", "page_no", "text"))


# The same texts with two pages per part: what a document too long for one cell looks like.
@query("agg01_concat_pages_in_parts", f"""
WITH {PAGED} SELECT doc_id, ((page_no - 1) // 2)::BIGINT AS part_no, string_agg(CASE WHEN page_no > 1 THEN chr(10) || '[' || page_no || ']' ELSE '' END
  || text, '' ORDER BY page_no) AS text, sum(length(text))::BIGINT AS char_count FROM p GROUP BY ALL""")
def agg01_parts(spark, sf_dir):
    pages = page_table(spark, sf_dir, "doc_id", "page_no", "text")
    return sequence.concat_pages(pages, "\n[{page}]", part_rows=2)


@query("agg02_document_info", f"""
WITH {PAGED} SELECT doc_id, count(*)::BIGINT AS page_count, sum(length(text))::BIGINT AS char_count,
  sum(octet_length(encode(text)))::BIGINT AS total_bytes FROM p GROUP BY doc_id""")
def agg02(spark, sf_dir):
    return sequence.document_info(page_table(spark, sf_dir, "doc_id", "text"))


@query("agg02_page_sizes", f"WITH {PAGED} SELECT doc_id, page_no, round(width_pt, 2) AS width_pt, round(height_pt, 2) AS height_pt FROM p")
def agg02_sizes(spark, sf_dir):
    return sequence.page_sizes(page_table(spark, sf_dir))


@query("win03_number_pages", f"""
WITH {PAGED} SELECT doc_id, page_no, 9 + page_no AS number, width_pt - 20 - length((9 + page_no)::VARCHAR) * 11::DOUBLE * 0.6::DOUBLE AS x,
  height_pt - 20 AS y FROM p""")
def win03(spark, sf_dir):
    pages = page_table(spark, sf_dir, "doc_id", "page_no", "width_pt", "height_pt")
    return sequence.number_pages(pages, start=10, position="Bottom-Right").drop("width_pt", "height_pt")


# Pages with gaps: only those longer than 200 characters; chunks of 2 pages carry their counts on.
@query("win03_number_pages_with_gaps", f"""
WITH {PAGED} SELECT doc_id, page_no, row_number() OVER w AS number,
  width_pt / 2 - length((row_number() OVER w)::VARCHAR) * 12::DOUBLE * 0.3::DOUBLE AS x, 42::DOUBLE AS y
FROM p WHERE length(text) > 200 WINDOW w AS (PARTITION BY doc_id ORDER BY page_no)""")
def win03_gaps(spark, sf_dir):
    pages = page_table(spark, sf_dir).filter(F.length("text") > 200).drop("text")
    done = sequence.number_pages(pages, position="top-center", font_size=12, margin=30, gaps=True, chunk_rows=2)
    return done.drop("width_pt", "height_pt")


# Lists of documents to merge: ten lists, each in document order. Chunks are small so that
# offsets cross chunk borders.
MERGES = f"""{PAGED}, o AS (SELECT doc_id % 10 AS merge_id, doc_id AS position, doc_id FROM n)"""


def merge_order(pages):
    return pages.select("doc_id").distinct().select(
        (F.col("doc_id") % 10).alias("merge_id"), F.col("doc_id").alias("position"), "doc_id"
    )


@query("win04_merge_sequences", f"""
WITH {MERGES} SELECT merge_id, o.position, p.doc_id, page_no, text, row_number() OVER (PARTITION BY merge_id ORDER BY o.position, page_no) AS merged_page_no
FROM p JOIN o USING (doc_id)""")
def win04(spark, sf_dir):
    pages = page_table(spark, sf_dir, "doc_id", "page_no", "text")
    return sequence.merge_sequences(pages, merge_order(pages), ["merge_id"], chunk_rows=25).rows


# One list of all documents: the offsets come from a running total over chunks of the counts.
@query("win04_merge_all", f"""
WITH {PAGED} SELECT doc_id, page_no, row_number() OVER (ORDER BY doc_id, page_no) AS merged_page_no FROM p""")
def win04_all(spark, sf_dir):
    pages = page_table(spark, sf_dir, "doc_id", "page_no")
    order = pages.select("doc_id").distinct().select(F.col("doc_id").alias("position"), "doc_id")
    return sequence.merge_sequences(pages, order, [], chunk_rows=100).rows.drop("position")


@query("win04_merge_totals", f"""
WITH {MERGES} SELECT merge_id, count(DISTINCT doc_id)::BIGINT AS files_merged, count(*)::BIGINT AS total_pages FROM p JOIN o USING (doc_id) GROUP BY merge_id""")
def win04_totals(spark, sf_dir):
    pages = page_table(spark, sf_dir, "doc_id", "page_no")
    return sequence.merge_totals(pages, merge_order(pages), ["merge_id"])


@query("win06_name_parts", f"""
WITH {PAGED} SELECT doc_id, page_no, 'd' || doc_id || '_page' || lpad(page_no::VARCHAR, 4, '0') || '.png' AS image,
  'frame_' || lpad((page_no - 1)::VARCHAR, 4, '0') || '.gif' AS frame, 'd_slide' || lpad(page_no::VARCHAR, 3, '0') || '.jpg' AS slide_image,
  'Page' || page_no || '_T' || (page_no + 1) AS sheet, 'Slide ' || page_no AS slide, substr('a name that is cut ' || text, 1, 31) AS short_name FROM p""")
def win06(spark, sf_dir):
    pages = page_table(spark, sf_dir, "doc_id", "page_no", "text")
    no = F.col("page_no")
    return pages.select(
        "doc_id", "page_no",
        names.page_image_name(F.concat(F.lit("d"), F.col("doc_id")), no).alias("image"),
        names.frame_name(no - 1, ".gif").alias("frame"), names.slide_image_name(F.lit("d"), no, ".jpg").alias("slide_image"),
        names.page_table_name(no, no + 1).alias("sheet"), names.slide_title(no).alias("slide"),
        names.sheet_name(F.concat(F.lit("a name that is cut "), "text")).alias("short_name"),
    )


# A configuration corpus as lines: one file per customer segment and nation, a section per ten
# customers. One file holds many chunks of lines, so sections carry over chunk borders.
@query("win01_carry_section", """
WITH f AS (SELECT 'conf/' || c_mktsegment || '/' || c_nationkey || '.ini' AS path, c_custkey, c_name, c_acctbal FROM customer),
h AS (SELECT path, c_custkey * 2 AS line_no, '[s' || c_custkey // 10 || ']' AS line FROM f WHERE c_custkey % 5 = 0
  UNION ALL SELECT path, c_custkey * 2 + 1, c_name || ' = ' || c_acctbal FROM f)
SELECT path, line_no, line, last_value(CASE WHEN line LIKE '[%' THEN replace(replace(line, '[', ''), ']', '') END IGNORE NULLS)
  OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM h""")
def win01(spark, sf_dir):
    cust = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_acctbal", "c_mktsegment", "c_nationkey")
    path = F.concat(F.lit("conf/"), "c_mktsegment", F.lit("/"), F.col("c_nationkey"), F.lit(".ini"))
    key = F.col("c_custkey")
    head = F.when(key % 5 == 0, F.struct(
        (key * 2).alias("line_no"), F.concat(F.lit("[s"), F.floor(key / 10), F.lit("]")).alias("line")))
    body = F.struct((key * 2 + 1).alias("line_no"), F.concat("c_name", F.lit(" = "), F.col("c_acctbal")).alias("line"))
    rows = cust.select(path.alias("path"), F.explode(F.array_compact(F.array(head, body))).alias("l")).select("path", "l.*")
    return ordered.carry_section(rows, ["path"], chunk_rows=500)


@query("win05_last_write_wins", """
SELECT path, key, value, line_no FROM (SELECT 'env/' || event_type AS path, 'USER_' || user_id AS key, value, event_id AS line_no,
  row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1""")
def win05(spark, sf_dir):
    rows = table(spark, sf_dir, "events", "event_id", "event_type", "user_id", "value").select(
        F.concat(F.lit("env/"), "event_type").alias("path"), F.concat(F.lit("USER_"), F.col("user_id")).alias("key"),
        "value", F.col("event_id").alias("line_no"),
    )
    return ordered.last_write_wins(rows, ["path", "key"], "line_no")
