"""Binary corpora: archives, databases, office files, images and the stream.

The files are made from the tables by Spark: texts are column expressions, and only the packing
into ZIP, TAR or SQLite bytes is done by the standard library, one bounded file at a time.
"""

from __future__ import annotations

import io
import sqlite3
import tarfile
import zipfile

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import streaming
from ..functions.markup import xml_escape
from ..functions.text import lines
from ..operators import blocks, grids, sequence, tables
from ..session import scratch_dir, settle
from ..sources import archives, images, office, sinks, sqlite, tabular
from . import convert
from . import sqltext as q
from .registry import query, spread, table
from .text_jobs import _blocks_sql

ROWS_PER_FILE = 100


@F.arrow_udf(T.BinaryType())
def zip_parts(parts: pa.Array) -> pa.Array:
    """One file after the other is taken out of the batch: as pandas objects a batch takes several times its bytes."""
    def pack(entries) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as box:
            for name, text in dict(entries).items():
                box.writestr(name, text)
        return out.getvalue()

    return pa.array((pack(p.as_py()) for p in parts), pa.binary())


@F.pandas_udf(T.BinaryType())
def tar_parts(parts: pd.Series) -> pd.Series:
    def pack(entries) -> bytes:
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz") as box:
            for name, text in dict(entries).items():
                info, raw = tarfile.TarInfo(name), text.encode()
                info.size = len(raw)
                box.addfile(info, io.BytesIO(raw))
        return out.getvalue()

    return parts.map(pack)


def parts_map(**named):
    return F.create_map(*[c for k, v in named.items() for c in (F.lit(k), v)])


# ---------------------------------------------------------------------------- archives

BUNDLED = "b AS (SELECT doc_id // 50 AS bundle, 'docs/' || lang || '/' || doc_id || '.txt' AS member, text, octet_length(encode(text)) AS size FROM documents)"


def bundles(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "text").select(
        F.floor(F.col("doc_id") / 50).alias("bundle"),
        F.concat(F.lit("docs/"), "lang", F.lit("/"), F.col("doc_id"), F.lit(".txt")).alias("member"),
        F.encode("text", "utf-8").alias("content"), F.octet_length("text").cast("bigint").alias("size"),
    )
    return archives.spread_bundles(docs, "bundle", "member", 256 << 20, "size")


def document_zips(spark, sf_dir):
    packed = archives.zip_bundles(bundles(spark, sf_dir), "bundle", "member", "content")
    return packed.select(F.concat(F.lit("a/"), F.col("bundle"), F.lit(".zip")).alias("path"), "content", "files_added")


@query("src10_zip_members", f"WITH {BUNDLED} SELECT 'a/' || bundle || '.zip' AS path, member, size::BIGINT AS size, text FROM b")
def src10_zip(spark, sf_dir):
    found = archives.archive_members(document_zips(spark, sf_dir))
    return found.select("path", "member", "size", F.decode("content", "utf-8").alias("text"))


@query("src10_archive_listing", f"""
WITH {BUNDLED} SELECT 'a/' || bundle || '.zip' AS path, count(*)::BIGINT AS files_extracted, sum(size)::BIGINT AS total_bytes, NULL::VARCHAR AS error FROM b GROUP BY bundle""")
def src10_listing(spark, sf_dir):
    return archives.archive_listing(archives.archive_members(document_zips(spark, sf_dir)))


# TAR archives of two members per page; every tenth file is cut off and must become an error row.
@query("src10_tar_members", """
SELECT 'p' || page_id AS path, 'm/page.html' AS member, octet_length(encode(html))::BIGINT AS size, false AS failed FROM pages WHERE page_id % 10 <> 0
UNION ALL SELECT 'p' || page_id, 'm/url.txt', octet_length(encode(url))::BIGINT, false FROM pages WHERE page_id % 10 <> 0
UNION ALL SELECT 'p' || page_id, NULL, NULL, true FROM pages WHERE page_id % 10 = 0""")
def src10_tar(spark, sf_dir):
    raw = tar_parts(parts_map(**{"m/page.html": F.col("html"), "m/url.txt": F.col("url")}))
    files = spread(table(spark, sf_dir, "pages")).select("page_id", raw.alias("raw")).select(
        F.concat(F.lit("p"), F.col("page_id")).alias("path"),
        F.when(F.col("page_id") % 10 == 0, F.substring("raw", 30, 40)).otherwise(F.col("raw")).alias("content"))
    found = archives.archive_members(files)
    return found.select("path", "member", "size", F.col("error").isNotNull().alias("failed"))


@query("snk11_pack_manifest", f"""
WITH {BUNDLED} SELECT bundle, count(*)::BIGINT AS files_added, sum(size)::BIGINT AS total_bytes, 1::BIGINT AS containers FROM b GROUP BY bundle""")
def snk11(spark, sf_dir):
    return archives.pack_manifest(bundles(spark, sf_dir), "bundle", "size")


# One bundle per language: each is above the size limit and goes on in several containers.
@query("snk11_pack_members", "SELECT lang, doc_id, text FROM documents")
def snk11_write(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "text").select(
        "lang", F.col("doc_id").cast("string").alias("member"), "text", F.octet_length("text").cast("bigint").alias("size"))
    path = scratch_dir(spark, "packed")
    archives.write_packed(archives.spread_bundles(docs, "lang", "member", 1 << 20, "size"), path, "lang")
    return tabular.read_parquet(spark, path).select("lang", F.col("member").cast("bigint").alias("doc_id"), "text")


# ---------------------------------------------------------------------------- databases


def customer_databases(spark, sf_dir):
    """SQLite files of 100 customers each, with a second table whose name needs quoting."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        conn = sqlite3.connect(":memory:")
        conn.execute("CREATE TABLE customer (c_custkey INTEGER, c_name TEXT, c_acctbal REAL)")
        conn.execute('CREATE TABLE "by nation" (c_custkey INTEGER, nation INTEGER)')
        frame = frame.sort_values("c_custkey")
        keys = [int(k) for k in frame["c_custkey"]]
        conn.executemany("INSERT INTO customer VALUES (?, ?, ?)", zip(keys, frame["c_name"], frame["c_acctbal"]))
        conn.executemany('INSERT INTO "by nation" VALUES (?, ?)', zip(keys, [int(n) for n in frame["c_nationkey"]]))
        conn.commit()
        return pd.DataFrame({"path": [f"db{keys[0] // ROWS_PER_FILE}"], "content": [conn.serialize()]})

    rows = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_acctbal", "c_nationkey")
    grouped = rows.withColumn("grp", F.floor(F.col("c_custkey") / ROWS_PER_FILE)).groupBy("grp")
    return grouped.applyInPandas(build, "path string, content binary")


@query("src06_read_sqlite", """
SELECT 'db' || c_custkey // 100 AS path, c_custkey % 100 AS row_idx, c_custkey, c_name, c_acctbal FROM customer""")
def src06(spark, sf_dir):
    found = sqlite.sqlite_rows(customer_databases(spark, sf_dir), "customer")
    record = F.from_json("record", "c_custkey bigint, c_name string, c_acctbal double")
    return found.select("path", "row_idx", record.alias("r")).select("path", "row_idx", "r.*")


@query("src06_all_tables", """
SELECT 'db' || c_custkey // 100 AS path, unnest(['customer', 'by nation']) AS table_name, count(*)::BIGINT AS rows FROM customer GROUP BY c_custkey // 100""")
def src06_all(spark, sf_dir):
    found = sqlite.sqlite_rows(customer_databases(spark, sf_dir))
    return found.groupBy("path", "table_name").agg(F.count("record").alias("rows"))


# ---------------------------------------------------------------------------- workbooks

WORKBOOK = (
    '<workbook xmlns="m" xmlns:r="r"><sheets><sheet name="People &amp; co" sheetId="1" r:id="rId1"/>'
    '<sheet name="Nations" sheetId="2" r:id="rId9"/></sheets></workbook>'
)
WORKBOOK_RELS = (
    '<Relationships xmlns="p"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/>'
    '<Relationship Id="rId9" Target="/xl/worksheets/second.xml"/></Relationships>'
)


def workbooks(spark, sf_dir):
    """Workbooks of 100 customers: shared and inline strings, numbers, a gap in column C."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment").withColumn(
        "grp", F.floor(key / ROWS_PER_FILE)).withColumn("pos", key % ROWS_PER_FILE + 1)
    one = F.expr(
        "concat('<row r=\"', pos + 1, '\"><c r=\"A', pos + 1, '\"><v>', c_custkey, '</v></c><c r=\"B', pos + 1, '\" t=\"s\"><v>', pos - 1, "
        "'</v></c><c r=\"D', pos + 1, '\" t=\"inlineStr\"><is><t>', c_mktsegment, ' &amp; co</t></is></c></row>')")
    shared = F.when(
        F.col("pos") % 2 == 0, F.expr("concat('<si><t>', c_name, '</t></si>')")
    ).otherwise(F.expr("concat('<si><r><t>', substr(c_name, 1, 4), '</t></r><r><t>', substr(c_name, 5), '</t></r></si>')"))
    nation = F.expr("concat('<row r=\"', pos, '\"><c r=\"AB', pos, '\"><v>', c_nationkey, '</v></c></row>')")
    whole = rows.select("grp", "pos", one.alias("a"), shared.alias("b"), nation.alias("c")).groupBy("grp").agg(
        *[F.expr(f"listagg({c}, '') within group (order by pos)").alias(c) for c in "abc"])
    head = '<row r="1">' + "".join(f'<c r="{c}1" t="inlineStr"><is><t>{n}</t></is></c>' for c, n in zip("ABD", ("id", "name", "seg"))) + "</row>"
    sheet = lambda body: F.concat(F.lit('<worksheet xmlns="m"><sheetData>'), body, F.lit("</sheetData></worksheet>"))
    content = zip_parts(parts_map(**{
        "xl/workbook.xml": F.lit(WORKBOOK), "xl/_rels/workbook.xml.rels": F.lit(WORKBOOK_RELS),
        "xl/worksheets/sheet1.xml": sheet(F.concat(F.lit(head), "a")), "xl/worksheets/second.xml": sheet(F.col("c")),
        "xl/sharedStrings.xml": F.concat(F.lit('<sst xmlns="m">'), "b", F.lit("</sst>")),
    }))
    return whole.select(F.concat(F.lit("w"), F.col("grp")).alias("path"), content.alias("content"))


@query("src12_xlsx_cells", """
WITH c AS (SELECT 'w' || c_custkey // 100 AS path, (c_custkey % 100)::INT AS i, * FROM customer)
SELECT path, 0 AS sheet_idx, 'People & co' AS sheet_name, i + 1 AS row_idx, unnest([0, 1, 3]) AS col_idx, unnest([c_custkey::VARCHAR, c_name, c_mktsegment || ' & co']) AS text FROM c
UNION ALL SELECT DISTINCT path, 0, 'People & co', 0, unnest([0, 1, 3]), unnest(['id', 'name', 'seg']) FROM c
UNION ALL SELECT path, 1, 'Nations', i, 27, c_nationkey::VARCHAR FROM c""")
def src12(spark, sf_dir):
    return office.xlsx_cells(workbooks(spark, sf_dir))


@query("src12_xlsx_table", """
SELECT 'w' || c_custkey // 100 AS path, c_custkey::VARCHAR AS id, c_name AS name, NULL::VARCHAR AS "Unnamed: 2", c_mktsegment || ' & co' AS seg FROM customer""")
def src12_table(spark, sf_dir):
    sheets = settle(office.sheet_grids(workbooks(spark, sf_dir), "People & co"), "sheets")
    return grids.records_table(office.sheet_records(sheets), grids.column_names(sheets, ["path", "sheet_idx"]), ["path"])


@query("src12_all_sheets", """
WITH c AS (SELECT *, 'w' || c_custkey // 100 AS path, (c_custkey % 100)::INTEGER AS i FROM customer),
head AS (SELECT path, coalesce(max(CASE WHEN i = 0 THEN c_nationkey::VARCHAR END), 'Unnamed: 27') AS label FROM c GROUP BY path)
SELECT path, 'People & co' AS sheet_name, i + 1 AS row_idx, 'id=' || c_custkey || ';name=' || c_name || ';seg=' || c_mktsegment || ' & co' AS record FROM c
UNION ALL SELECT path, 'Nations', i, label || '=' || c_nationkey FROM c JOIN head USING (path) WHERE i > 0""")
def src12_all(spark, sf_dir):
    found = office.sheet_records(office.sheet_grids(workbooks(spark, sf_dir)))
    fields = F.transform(F.map_entries("record"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.select("path", "sheet_name", "row_idx", F.array_join(fields, ";").alias("record"))


@query("src12_xlsx_to_markdown", """
SELECT 'w' || c_custkey // 100 AS path, 0::BIGINT AS part_no, '| id | name | Unnamed: 2 | seg |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) ||
  string_agg('| ' || c_custkey || ' | ' || c_name || ' | nan | ' || c_mktsegment || ' & co |', chr(10) ORDER BY c_custkey) AS markdown, count(*)::BIGINT AS rows FROM customer GROUP BY c_custkey // 100""")
def src12_markdown(spark, sf_dir):
    return office.sheet_markdown(office.sheet_grids(workbooks(spark, sf_dir), "People & co")).drop("sheet_idx", "sheet_name")


@query("src12_xlsx_to_html", """
SELECT 'w' || c_custkey // 100 AS path, 0::BIGINT AS part_no, '<h2>People &amp; co</h2>' || chr(10) || '<table border=''1''>' || chr(10) ||
  '<thead><tr><th>id</th><th>name</th><th>Unnamed: 2</th><th>seg</th></tr></thead>' || chr(10) || '<tbody>' || chr(10) || string_agg('<tr><td>' || c_custkey || '</td><td>' || c_name ||
  '</td><td>NaN</td><td>' || c_mktsegment || ' &amp; co</td></tr>', chr(10) ORDER BY c_custkey) || chr(10) || '</tbody>' || chr(10) || '</table>' AS html, count(*)::BIGINT AS rows
FROM customer GROUP BY c_custkey // 100""")
def src12_html(spark, sf_dir):
    return office.sheet_html(office.sheet_grids(workbooks(spark, sf_dir), "People & co")).drop("sheet_idx", "sheet_name")


def mixed_workbooks(spark, sf_dir):
    """The workbooks of customers, and one for each nation with a header of other names, order and case, and a repeated one."""
    cell = lambda ref, text: f"'<c r=\"{ref}\" t=\"inlineStr\"><is><t>', {text}, '</t></is></c>'"
    head = f"concat('<row r=\"1\">', {cell('A1', repr('NAME'))}, {cell('C1', repr('region'))}, {cell('D1', repr('Region'))}, '</row>')"
    body = f"concat('<row r=\"2\">', {cell('A2', 'n_name')}, {cell('B2', repr('b'))}, {cell('C2', 'n_regionkey')}, {cell('D2', repr('x'))}, '</row>')"
    sheet = F.expr(f"concat('<worksheet xmlns=\"m\"><sheetData>', {head}, {body}, '</sheetData></worksheet>')")
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("x"), F.col("n_nationkey")).alias("path"), zip_parts(parts_map(**{
        "xl/workbook.xml": F.lit(WORKBOOK), "xl/_rels/workbook.xml.rels": F.lit(WORKBOOK_RELS), "xl/worksheets/sheet1.xml": sheet})).alias("content"))
    broken = spark.createDataFrame([("y", b"no workbook")], "path string, content binary")
    return workbooks(spark, sf_dir).unionByName(nations).unionByName(broken)


MIXED = """
SELECT c_custkey AS id, c_name AS name, NULL::{0} AS "Unnamed: 2", c_mktsegment || ' & co' AS seg, NULL::VARCHAR AS "Unnamed: 1", NULL::BIGINT AS region, NULL::VARCHAR AS "Region.1" FROM customer
UNION ALL SELECT NULL, n_name, NULL, NULL, 'b', n_regionkey, 'x' FROM nation"""


@query("snk10_convert_xlsx_to_csv", MIXED.format("VARCHAR"))
def snk10_xlsx_csv(spark, sf_dir):
    path = scratch_dir(spark, "convert")
    data, _, _ = convert.workbooks_table(mixed_workbooks(spark, sf_dir), "People & co")
    sinks.write_csv(data, path)
    kinds = {"id": "bigint", "region": "bigint"}
    return spark.read.csv(path, header=True, schema=", ".join(f"`{c}` {kinds.get(c, 'string')}" for c in data.columns))


@query("snk10_convert_xlsx_to_json", MIXED.format("DOUBLE"))
def snk10_xlsx_json(spark, sf_dir):
    path = scratch_dir(spark, "convert")
    data, _, _ = convert.workbooks_table(mixed_workbooks(spark, sf_dir), "People & co")
    sinks.write_jsonl(data, path)
    return tabular.read_jsonl(spark, path, data.schema).select(*[F.col(f"`{c}`") for c in data.columns])


# ---------------------------------------------------------------------------- Word documents

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
STYLES = (
    f'<w:styles {W}><w:style w:styleId="berschrift1"><w:name w:val="heading 1"/></w:style>'
    '<w:style w:styleId="ListBullet"><w:name w:val="List Bullet"/></w:style></w:styles>'
)


def word_files(spark, sf_dir):
    """One document per turn: a heading, a bullet, the lines with a bold start, and a table."""
    conv = spread(table(spark, sf_dir, "conversations"))
    run = lambda t, mark="": F.concat(F.lit(f'<w:r>{mark}<w:t xml:space="preserve">'), xml_escape(t), F.lit("</w:t></w:r>"))
    para = lambda inner, style=None: F.concat(
        F.lit("<w:p>" + (f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else "")), inner, F.lit("</w:p>"))
    body = F.array_join(F.transform(lines(F.col("text")), lambda x: para(F.concat(
        run(F.substring(x, 1, 5), "<w:rPr><w:b/></w:rPr>"), run(F.substr(x, F.lit(6)), '<w:rPr><w:b w:val="0"/><w:i w:val="false"/></w:rPr>')))), "")
    cell = lambda t: F.concat(F.lit("<w:tc>"), para(run(t)), F.lit("</w:tc>"))
    grid = F.concat(F.lit("<w:tbl><w:tr>"), cell(F.lit("conv")), cell(F.lit("turn")), F.lit("</w:tr><w:tr>"),
                    cell(F.col("conv_id").cast("string")), cell(F.col("turn").cast("string")), F.lit("</w:tr></w:tbl>"))
    xml = F.concat(F.lit(f"<w:document {W}><w:body>"), para(run(F.col("role")), "berschrift1"), grid,
                   para(run(F.lit("a & b")), "ListBullet"), body, F.lit("</w:body></w:document>"))
    content = zip_parts(parts_map(**{"word/document.xml": xml, "word/styles.xml": F.lit(STYLES)}))
    return conv.select(F.concat_ws("-", "conv_id", "turn").alias("path"), content.alias("content"))


WORD_CTE = f"""
ln AS ({q.lines('conversations', 'conv_id, turn', 'text')}),
word AS (SELECT conv_id || '-' || turn AS path, 1::BIGINT AS block_idx, 'heading' AS kind, 1 AS level, role AS text, '# ' || role AS md FROM conversations
  UNION ALL SELECT conv_id || '-' || turn, 2, 'bullet', 0, 'a & b', '- a & b' FROM conversations
  UNION ALL SELECT conv_id || '-' || turn, i + 2, 'paragraph', 0, line, CASE WHEN line = '' THEN '' ELSE '**' || substr(line, 1, 5) || '**' || substr(line, 6) END FROM ln)"""


@query("src13_docx_blocks", f"WITH {WORD_CTE} SELECT path, block_idx, kind, level, text FROM word")
def src13(spark, sf_dir):
    return office.docx_blocks(word_files(spark, sf_dir)).drop("runs")


@query("src13_docx_cells", """
SELECT conv_id || '-' || turn AS path, 0 AS table_idx, unnest([0, 0, 1, 1]) AS row_idx, unnest([0, 1, 0, 1]) AS col_idx,
  unnest(['conv', 'turn', conv_id::VARCHAR, turn::VARCHAR]) AS text FROM conversations""")
def src13_cells(spark, sf_dir):
    return office.docx_cells(word_files(spark, sf_dir))


@query("src13_docx_to_markdown", f"WITH {WORD_CTE} SELECT path, 0::BIGINT AS part_no, string_agg(md, chr(10) ORDER BY block_idx) AS text FROM word GROUP BY path")
def src13_markdown(spark, sf_dir):
    return blocks.render_blocks(office.docx_blocks(word_files(spark, sf_dir)), "md", ["path"])


@query("src13_docx_to_text", f"""
WITH {WORD_CTE} SELECT path, string_agg(text, chr(10) || chr(10) ORDER BY block_idx) AS text FROM word WHERE {q.not_blank('text')} GROUP BY path""")
def src13_text(spark, sf_dir):
    return office.docx_render(word_files(spark, sf_dir), "txt")


@query("src13_docx_to_markdown_file", f"""
WITH {WORD_CTE}, c AS (SELECT conv_id || '-' || turn AS path, '| conv | turn |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || conv_id || ' | ' || turn || ' |' ||
  chr(10) AS grid FROM conversations), w AS (SELECT path, string_agg(md, chr(10) ORDER BY block_idx) AS body FROM word GROUP BY path)
SELECT path, body || chr(10) || grid AS text FROM w JOIN c USING (path)""")
def src13_markdown_file(spark, sf_dir):
    return office.docx_render(word_files(spark, sf_dir), "md")


@query("src13_docx_to_html", f"""
WITH {WORD_CTE}, h AS (SELECT path, block_idx, CASE kind WHEN 'heading' THEN '<h1>' || {q.escape('text')} || '</h1>' WHEN 'bullet' THEN '<li>' || {q.escape('text')} || '</li>'
  ELSE '<p><strong>' || {q.escape('substr(text, 1, 5)')} || '</strong>' || {q.escape('substr(text, 6)')} || '</p>' END AS line FROM word WHERE {q.not_blank('text')}),
w AS (SELECT path, string_agg(line, chr(10) ORDER BY block_idx) AS body FROM h GROUP BY path),
c AS (SELECT conv_id || '-' || turn AS path, '<table border=''1''><tbody><tr><th>conv</th><th>turn</th></tr><tr><td>' || conv_id || '</td><td>' || turn ||
  '</td></tr></tbody></table>' AS grid FROM conversations)
SELECT path, body || chr(10) || grid AS text FROM w JOIN c USING (path)""")
def src13_html(spark, sf_dir):
    return office.docx_render(word_files(spark, sf_dir), "html")


# ---------------------------------------------------------------------------- slide decks


def decks(spark, sf_dir):
    """One deck per turn, one slide per line; slide files are numbered against their order."""
    conv = spread(table(spark, sf_dir, "conversations"))
    ls = lines(F.col("text"))
    n = F.size(ls)
    para = lambda t: F.concat(F.lit("<a:p><a:r><a:t>"), xml_escape(F.substring(t, 1, 3)), F.lit("</a:t></a:r><a:r><a:t>"),
                              xml_escape(F.substr(t, F.lit(4))), F.lit("</a:t></a:r></a:p>"))
    slide = lambda x, i: F.concat(
        F.lit('<p:sld xmlns:p="p" xmlns:a="a"><p:cSld><p:spTree><p:sp><p:txBody>'), para(x), F.lit("<a:p/>"), F.lit("</p:txBody></p:sp><p:sp><p:txBody>"),
        para(F.concat(F.lit("line "), i + 1)), F.lit("</p:txBody></p:sp></p:spTree></p:cSld></p:sld>"))
    slides = F.transform(ls, lambda x, i: F.struct(F.concat(F.lit("ppt/slides/slide"), n - i, F.lit(".xml")).alias("k"), slide(x, i).alias("v")))
    rels = F.array_join(F.transform(ls, lambda x, i: F.concat(
        F.lit('<Relationship Id="rId'), i, F.lit('" Target="slides/slide'), n - i, F.lit('.xml"/>'))), "")
    ids = F.array_join(F.transform(ls, lambda x, i: F.concat(F.lit('<p:sldId id="'), i + 256, F.lit('" r:id="rId'), i, F.lit('"/>'))), "")
    fixed = F.array(
        F.struct(F.lit("ppt/presentation.xml").alias("k"), F.concat(F.lit('<p:presentation xmlns:p="p" xmlns:r="r"><p:sldIdLst>'), ids,
                                                                  F.lit("</p:sldIdLst></p:presentation>")).alias("v")),
        F.struct(F.lit("ppt/_rels/presentation.xml.rels").alias("k"), F.concat(F.lit('<Relationships xmlns="p">'), rels, F.lit("</Relationships>")).alias("v")))
    content = zip_parts(F.map_from_entries(F.concat(fixed, slides)))
    return conv.select(F.concat_ws("-", "conv_id", "turn").alias("path"), content.alias("content"))


DECK_CTE = f"""
ln AS ({q.lines('conversations', 'conv_id, turn', 'text')}),
paras AS (SELECT conv_id || '-' || turn AS path, i AS slide_no, 1 AS p, line AS text FROM ln WHERE line <> ''
  UNION ALL SELECT conv_id || '-' || turn, i, CASE WHEN line = '' THEN 1 ELSE 2 END, 'line ' || i FROM ln)"""


@query("src14_pptx_text", f"WITH {DECK_CTE} SELECT path, slide_no::BIGINT AS slide_no, p::BIGINT AS para_idx, text FROM paras")
def src14(spark, sf_dir):
    return office.pptx_text(decks(spark, sf_dir))


@query("src14_pptx_to_text", f"""
WITH {DECK_CTE}, every AS (SELECT * FROM paras UNION ALL SELECT DISTINCT path, slide_no, 0, '--- Slide ' || slide_no || ' ---' FROM paras)
SELECT path, 0::BIGINT AS part_no, string_agg(text, chr(10) ORDER BY slide_no, p) AS text FROM every GROUP BY path""")
def src14_render(spark, sf_dir):
    texts = settle(office.pptx_text(decks(spark, sf_dir)), "pptx")
    return sequence.render_slides(texts, "txt", "path")


@query("src14_pptx_render_text", f"""
WITH {DECK_CTE}, every AS (SELECT * FROM paras UNION ALL SELECT DISTINCT path, slide_no, 0, '--- Slide ' || slide_no || ' ---' FROM paras)
SELECT path, max(slide_no)::BIGINT AS slides, string_agg(text, chr(10) ORDER BY slide_no, p) AS text FROM every GROUP BY path""")
def src14_file_text(spark, sf_dir):
    return office.pptx_render(decks(spark, sf_dir), "txt")


@query("src14_pptx_render_html", f"""
WITH {DECK_CTE}, n AS (SELECT DISTINCT path, slide_no FROM paras), every AS (
  SELECT path, slide_no, p, '<p>' || {q.escape('text')} || '</p>' AS line FROM paras
  UNION ALL SELECT path, slide_no, 0, '<section id="slide-' || slide_no || '"><h2>Slide ' || slide_no || '</h2>' FROM n
  UNION ALL SELECT path, slide_no, 9, '</section>' FROM n)
SELECT path, max(slide_no)::BIGINT AS slides, string_agg(line, chr(10) ORDER BY slide_no, p) AS text FROM every GROUP BY path""")
def src14_file_html(spark, sf_dir):
    return office.pptx_render(decks(spark, sf_dir), "html")


# ---------------------------------------------------------------------------- e-books


def books(spark, sf_dir):
    """One book per page: the page itself after a first chapter; every third book has no title."""
    opf = F.expr(
        "concat('<package xmlns=\"http://www.idpf.org/2007/opf\"><metadata xmlns:dc=\"d\">', CASE WHEN page_id % 3 > 0 THEN "
        "concat('<dc:title>Book &amp; ', page_id, '</dc:title>') ELSE '' END, '</metadata><manifest>"
        "<item id=\"a\" href=\"z%20first.xhtml\" media-type=\"application/xhtml+xml\"/><item id=\"s\" href=\"s.css\" media-type=\"text/css\"/>"
        "<item id=\"b\" href=\"page.html\" media-type=\"application/xhtml+xml\"/></manifest></package>')")
    first = F.expr("concat('<html><body><h1>Nr ', page_id, '</h1><p>A &lt; B</p></body></html>')")
    content = zip_parts(parts_map(**{
        "META-INF/container.xml": F.lit('<container><rootfiles><rootfile full-path="OEBPS/c.opf"/></rootfiles></container>'),
        "OEBPS/c.opf": opf, "OEBPS/z first.xhtml": first, "OEBPS/page.html": F.col("html"), "OEBPS/s.css": F.lit("p{}"),
    }))
    pages = spread(table(spark, sf_dir, "pages", "page_id", "html"))
    return pages.select(F.concat(F.lit("lib/b"), F.col("page_id"), F.lit(".epub")).alias("path"), content.alias("content"))


BOOK_CTE = """
ch AS (SELECT page_id, 1 AS n, '<html><body><h1>Nr ' || page_id || '</h1><p>A &lt; B</p></body></html>' AS html FROM pages
  UNION ALL SELECT page_id, 2, html FROM pages),
bk AS (SELECT 'lib/b' || page_id || '.epub' AS path, CASE WHEN page_id % 3 > 0 THEN 'Book & ' || page_id ELSE 'b' || page_id END AS title, n, html FROM ch)"""


@query("src15_epub_chapters", f"WITH {BOOK_CTE} SELECT path, title, n::BIGINT AS chapter_idx, html FROM bk")
def src15(spark, sf_dir):
    return office.epub_chapters(books(spark, sf_dir))


@query("src15_epub_to_text", f"""
WITH {BOOK_CTE}, t AS (SELECT path, n, {q.strip(q.unescape("regexp_replace(html, '<[^>]+>', '', 'g')"))} AS text FROM bk)
SELECT path, 0::BIGINT AS part_no, string_agg(text, chr(10) || chr(10) ORDER BY n) AS text FROM t WHERE text <> '' GROUP BY path""")
def src15_text(spark, sf_dir):
    return office.epub_text(office.epub_chapters(books(spark, sf_dir)))


def chapters_once(spark, sf_dir):
    """Chapters as a written table: the framed rendering reads them twice."""
    return settle(office.epub_chapters(books(spark, sf_dir)), "chapters")


@query("src15_epub_to_html", f"""
WITH {BOOK_CTE}, t AS (SELECT path, title, n, regexp_extract(html, '(?is)(<body\\b.*</body\\s*>)', 1) AS body, html FROM bk)
SELECT path, 0::BIGINT AS part_no, {q.lit(office._BOOK_HEAD)} || {q.escape('any_value(title)')} || {q.lit(office._BOOK_MID)} ||
  string_agg(CASE WHEN body <> '' THEN body ELSE html END, chr(10) ORDER BY n) || {q.lit(office._BOOK_TAIL)} AS text FROM t GROUP BY path""")
def src15_html(spark, sf_dir):
    return office.epub_html(chapters_once(spark, sf_dir))


@query("src15_epub_to_markdown", f"""
WITH {_blocks_sql()}, t AS (SELECT page_id, string_agg(CASE kind WHEN 'heading' THEN repeat('#', level) || ' ' WHEN 'bullet' THEN '- ' ELSE '' END
  || text, chr(10) ORDER BY block_idx) AS md FROM blocks GROUP BY page_id)
SELECT 'lib/b' || page_id || '.epub' AS path, 0::BIGINT AS part_no, '# Nr ' || page_id || chr(10) || 'A < B' || chr(10) || chr(10) || coalesce(md || chr(10), '') AS text
FROM pages LEFT JOIN t USING (page_id)""")
def src15_markdown(spark, sf_dir):
    return office.epub_markdown(office.epub_chapters(books(spark, sf_dir)))


# ---------------------------------------------------------------------------- images


def image_files(spark, sf_dir):
    """Image headers with sizes from the part table; every fifth file is junk."""
    parts = table(spark, sf_dir, "part", "p_partkey", "p_size")
    w, h = F.col("p_size") * 7, F.col("p_partkey") % 5000 + 1
    big = lambda c: F.lpad(F.hex(c), 8, "0")
    small = lambda c: F.concat(F.substring(F.lpad(F.hex(c), 4, "0"), 3, 2), F.substring(F.lpad(F.hex(c), 4, "0"), 1, 2))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(w), big(h), F.lit("0806000000"))
    gif = F.concat(F.lit("474946383961"), small(w), small(h), F.lit("000000"))
    jpeg = F.concat(F.lit("FFD8FFE000044A46FFC0000B08"), F.lpad(F.hex(h), 4, "0"), F.lpad(F.hex(w), 4, "0"), F.lit("03011100"))
    kind = F.col("p_partkey") % 5
    raw = F.when(kind == 0, png).when(kind == 1, gif).when(kind == 2, jpeg).when(kind == 3, F.concat(png, big(h))).otherwise("00FF")
    return parts.select(F.concat(F.lit("i"), F.col("p_partkey")).alias("path"), F.unhex(raw).alias("content"))


@query("src16_image_info", """
SELECT 'i' || p_partkey AS path, CASE p_partkey % 5 WHEN 1 THEN 'GIF' WHEN 2 THEN 'JPEG' ELSE 'PNG' END AS format, (p_size * 7)::BIGINT AS width, p_partkey % 5000 + 1 AS height,
  CASE p_partkey % 5 WHEN 1 THEN 'P' WHEN 2 THEN 'RGB' ELSE 'RGBA' END AS mode, CASE p_partkey % 5 WHEN 0 THEN 29 WHEN 1 THEN 13 WHEN 2 THEN 21 ELSE 33 END::BIGINT AS file_size_bytes,
  NULL::VARCHAR AS error FROM part WHERE p_partkey % 5 < 4
UNION ALL SELECT 'i' || p_partkey, NULL, NULL, NULL, NULL, NULL, 'Could not read image' FROM part WHERE p_partkey % 5 = 4""")
def src16(spark, sf_dir):
    done = images.image_info(image_files(spark, sf_dir))
    return done.rows.unionByName(done.errors, allowMissingColumns=True)


# ---------------------------------------------------------------------------- stream


def run_stream(spark, sf_dir):
    """Land the events as JSON lines, a seventh of them broken, and convert them as a stream."""
    landing, out, marks = (scratch_dir(spark, f"stream-{n}") for n in ("landing", "out", "marks"))
    events = spread(table(spark, sf_dir, "events", "event_id", "event_type", "props"))
    line = F.concat(
        F.lit('{"event_id":'), F.col("event_id"), F.lit(',"event_type":"'), "event_type", F.lit('","props":'), "props",
        F.when(F.col("event_id") % 7 == 0, "").otherwise("}"))
    events.select(line.alias("value")).write.text(landing)
    convert = streaming.json_lines_converter("event_id bigint, event_type string, props struct<k bigint>")
    job = streaming.stream_convert(streaming.watch_text(spark, landing, 4), convert, out, marks)
    job.awaitTermination()
    return out


@query("str01_stream_convert", "SELECT event_id, event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE event_id % 7 <> 0")
def str01(spark, sf_dir):
    done = spark.read.parquet(f"{run_stream(spark, sf_dir)}/data")
    return done.select("event_id", "event_type", "props.k")


@query("str01_stream_quarantine", """
SELECT '{"event_id":' || event_id || ',"event_type":"' || event_type || '","props":' || props AS value, 'not valid JSON' AS error FROM events WHERE event_id % 7 = 0""")
def str01_bad(spark, sf_dir):
    schema = "path string, value string, error string"
    return spark.read.schema(schema).json(f"{run_stream(spark, sf_dir)}/quarantine").select("value", "error")


@query("str01_stream_report", """
SELECT 'stream_convert' AS op, count(*)::BIGINT AS rows_seen, count(*) FILTER (event_id % 7 = 0)::BIGINT AS failed FROM events""")
def str01_report(spark, sf_dir):
    report = spark.read.parquet(f"{run_stream(spark, sf_dir)}/report")
    return report.groupBy("op").agg(F.sum("files").alias("rows_seen"), F.sum("failed").alias("failed"))


@query("str01_csv_stream", """
SELECT c_custkey, 'line 1' || chr(10) || '"' || c_name || '"' AS c_name, c_acctbal, NULL::VARCHAR AS error FROM customer WHERE c_custkey % 50 <> 7
UNION ALL SELECT NULL, NULL, NULL, 'not a row of the table' FROM customer WHERE c_custkey % 50 = 7""")
def str01_csv(spark, sf_dir):
    """CSV files with line breaks in quotes as a stream; rows whose key is no number go to quarantine."""
    landing, out, marks = (scratch_dir(spark, f"stream-{n}") for n in ("landing", "out", "marks"))
    key = F.col("c_custkey")
    rows = spread(table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_acctbal")).select(
        F.when(key % 50 == 7, "none").otherwise(key.cast("string")).alias("c_custkey"),
        F.concat(F.lit('line 1\n"'), "c_name", F.lit('"')).alias("c_name"), "c_acctbal")
    sinks.write_csv(rows, landing)
    found = streaming.watch_csv(spark, landing, "c_custkey bigint, c_name string, c_acctbal double", max_files=3)
    streaming.stream_convert(found, streaming.as_they_are, out, marks).awaitTermination()
    good = spark.read.parquet(f"{out}/data").drop("batch")
    bad = spark.read.schema("path string, value string, error string").json(f"{out}/quarantine").select("error")
    return good.unionByName(bad, allowMissingColumns=True)


@query("str01_office_stream", """
SELECT 'w' || c_custkey // 100 AS path, count(*)::BIGINT AS rows, true AS success, NULL::VARCHAR AS error, sum(c_custkey)::BIGINT AS ids FROM customer GROUP BY ALL
UNION ALL SELECT 'x' || n_nationkey, 1, true, NULL, NULL FROM nation UNION ALL SELECT 'y', 0, false, 'error', NULL""")
def str01_office(spark, sf_dir):
    """Workbooks of different headers, one of them broken, as a stream of files: the report beside what was found."""
    landing, out, marks = (scratch_dir(spark, f"stream-{n}") for n in ("landing", "out", "marks"))
    mixed_workbooks(spark, sf_dir).repartition(4, "path").write.parquet(landing)
    streaming.stream_files(
        streaming.watch_packed(spark, landing, 2), streaming.workbook_converter("People & co"), out, marks).awaitTermination()
    ids = spark.read.parquet(f"{out}/data").groupBy("path").agg(F.sum(F.try_element_at("record", F.lit("id")).cast("bigint")).alias("ids"))
    report = spark.read.parquet(f"{out}/report").drop("batch").join(ids, "path", "left")
    return report.withColumn("error", F.when(F.col("error").isNotNull(), "error"))


@query("str01_latest_records", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'late' ELSE event_type END AS event_type FROM events""")
def str01_latest(spark, sf_dir):
    """Two waves of files, the stream started anew for the second: of a record that comes again the later one stands."""
    landing, out, marks = (scratch_dir(spark, f"stream-{n}") for n in ("landing", "out", "marks"))
    events = table(spark, sf_dir, "events", "event_id", "event_type")
    late = events.filter("event_id % 3 = 0").withColumn("event_type", F.lit("late"))
    for wave in (spread(events), late):
        wave.select(F.to_json(F.struct("event_id", "event_type")).alias("value")).write.mode("append").text(landing)
        convert_lines = streaming.json_lines_converter("event_id bigint, event_type string")
        streaming.stream_convert(streaming.watch_text(spark, landing, 5), convert_lines, out, marks).awaitTermination()
    return streaming.latest_records(spark, out, ["event_id"])
