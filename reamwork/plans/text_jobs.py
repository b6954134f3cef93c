"""Text, markup and scalar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import binary, markup, names, text
from ..operators import blocks, ocr, ordered, records, tables
from ..operators.sequence import render_slides
from . import sqltext as q
from .registry import query, spread, table

# A Markdown corpus made from the documents: every kind of line, around the whole text.
MARKDOWN = (
    "concat('# ', source, '\\n\\n- ', lang, '\\n## Part **', doc_id, '**\\n* see `', lang, '`\\n', text, "
    "'\\n1. [home](http://x/', doc_id, ')\\n2. ![pic](http://x/i)\\n### End\\n- *last* & <one>')"
)
MARKDOWN_SQL = (
    "('# ' || source || chr(10) || chr(10) || '- ' || lang || chr(10) || '## Part **' || doc_id || '**' || chr(10) "
    "|| '* see `' || lang || '`' || chr(10) || text || chr(10) || '1. [home](http://x/' || doc_id || ')' || chr(10) "
    "|| '2. ![pic](http://x/i)' || chr(10) || '### End' || chr(10) || '- *last* & <one>')"
)
MARKDOWN_CTE = f"md AS (SELECT doc_id, {MARKDOWN_SQL} AS text FROM documents)"


def markdown_docs(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))
    return docs.select("doc_id", F.expr(MARKDOWN).alias("text"))


def documents(spark, sf_dir, *columns):
    return spread(table(spark, sf_dir, "documents", *columns))


def pages(spark, sf_dir):
    return spread(table(spark, sf_dir, "pages", "page_id", "html"))


@query("fn01_markdown_to_text", f"""
WITH {MARKDOWN_CTE}
SELECT doc_id, plain, length(plain)::BIGINT AS char_count
FROM (SELECT doc_id, {q.markdown_to_text('text')} AS plain FROM md)""")
def fn01(spark, sf_dir):
    plain = markdown_docs(spark, sf_dir).select("doc_id", text.markdown_to_text(F.col("text")).alias("plain"))
    return plain.withColumn("char_count", F.length("plain").cast("bigint"))


HTML_TEXT_SQL = q.unescape("regexp_replace(html, '<[^>]+>', '', 'g')")


@query("fn02_html_to_text", f"""
SELECT page_id, plain, length(plain)::BIGINT AS char_count
FROM (SELECT page_id, {HTML_TEXT_SQL} AS plain FROM pages)""")
def fn02(spark, sf_dir):
    plain = pages(spark, sf_dir).select("page_id", markup.html_to_text(F.col("html")).alias("plain"))
    return plain.withColumn("char_count", F.length("plain").cast("bigint"))


_SKIP = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>"
_ENDS = "|".join(markup.BLOCK_ENDS)


def _blocks_sql() -> str:
    # The same blocks by another route: mark every tag of a block element with a line of its own,
    # then give each stretch between two marks to the tag before it.
    marked = rf"regexp_replace(regexp_replace(html, {q.lit(_SKIP)}, '', 'g'), '(?i)(</?({_ENDS})([\s>/]))', chr(1) || '\1', 'g')"
    inner = q.strip(rf"regexp_replace(piece, '\s*(<[^>]+>\s*)+', '', 'g')")
    return f"""
pieces AS (
  SELECT page_id, unnest(string_split(html, chr(1))) AS piece, unnest(range(1, len(string_split(html, chr(1))) + 1)) AS i
  FROM (SELECT page_id, {marked} AS html FROM pages)
), found AS (
  SELECT page_id, i, lower(regexp_extract(piece, '^<(\\w+)', 1)) AS tag, {q.strip(q.unescape(inner))} AS text
  FROM pieces WHERE regexp_matches(piece, '(?i)^<(h[1-4]|p|li)[\\s>/]')
), blocks AS (
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS block_idx,
    CASE WHEN tag LIKE 'h%' THEN 'heading' WHEN tag = 'li' THEN 'bullet' ELSE 'paragraph' END AS kind,
    CASE WHEN tag LIKE 'h%' THEN least(substr(tag, 2, 1)::INT, 3) ELSE 0 END AS level, text
  FROM found WHERE text <> ''
)"""


@query("fn03_html_to_markdown", f"""
WITH {_blocks_sql()}
SELECT page_id, string_agg(CASE kind WHEN 'heading' THEN repeat('#', level) || ' ' WHEN 'bullet' THEN '- ' ELSE '' END
  || text, chr(10) || chr(10) ORDER BY block_idx) AS markdown
FROM blocks GROUP BY page_id""")
def fn03(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", markup.html_to_markdown(F.col("html")).alias("markdown"))


@query("fn04_html_blocks", f"WITH {_blocks_sql()} SELECT page_id, block_idx::BIGINT AS block_idx, kind, level, text FROM blocks")
def fn04(spark, sf_dir):
    return blocks.html_blocks(pages(spark, sf_dir), ["page_id"])


@query("fn05_html_escape", f"SELECT page_id, {q.escape('html')} AS escaped FROM pages")
def fn05_escape(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", text.html_escape(F.col("html")).alias("escaped"))


@query("fn05_html_unescape", f"SELECT page_id, {q.unescape('html')} AS plain FROM pages")
def fn05_unescape(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", markup.html_unescape(F.col("html")).alias("plain"))


def _kind_sql(x: str, numbered: bool = False) -> str:
    more = rf"WHEN regexp_matches({x}, '^\p{{Nd}}+\. ') THEN 'N'" if numbered else ""
    return f"""CASE WHEN {x} LIKE '### %' THEN '3' WHEN {x} LIKE '## %' THEN '2' WHEN {x} LIKE '# %' THEN '1'
  WHEN {x} LIKE '- %' OR {x} LIKE '* %' THEN 'B' {more} WHEN NOT {q.not_blank(x)} THEN 'X' ELSE 'T' END"""


RUNS_CTE = f"""
{MARKDOWN_CTE}, ln AS ({q.lines('md', 'doc_id', 'text')}),
kinds AS (SELECT doc_id, i, line, {_kind_sql('line')} AS kind FROM ln),
prior AS (SELECT *, coalesce(last_value(CASE WHEN kind IN ('1','2','3') THEN NULL ELSE kind = 'B' END IGNORE NULLS)
    OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS in_list,
    max(i) OVER (PARTITION BY doc_id) AS last_i FROM kinds),
runs AS (SELECT doc_id, i, line, kind, kind = 'B' AND NOT in_list AS opens, kind IN ('T', 'X') AND in_list AS closes,
    i = last_i AND CASE WHEN kind IN ('1','2','3') THEN in_list ELSE kind = 'B' END AS closes_after FROM prior)"""


@query("win02_list_runs", f"""
WITH {RUNS_CTE} SELECT doc_id, i::BIGINT AS line_no, line, kind, opens, closes, closes_after FROM runs""")
def win02(spark, sf_dir):
    rows = markdown_docs(spark, sf_dir).select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("i", "line"))
    numbered = rows.select("doc_id", (F.col("i") + 1).cast("bigint").alias("line_no"), "line")
    return ordered.list_runs(numbered, ["doc_id"])


def _html_line_sql() -> str:
    e = q.escape("line")
    e_from = lambda n: q.escape(f"substr(line, {n})")
    return f"""
  CASE WHEN closes THEN '</ul>' || CASE WHEN kind = 'T' THEN chr(10) ELSE '' END ELSE '' END ||
  CASE kind WHEN '1' THEN '<h1>' || {e_from(3)} || '</h1>' WHEN '2' THEN '<h2>' || {e_from(4)} || '</h2>'
    WHEN '3' THEN '<h3>' || {e_from(5)} || '</h3>' WHEN 'B' THEN CASE WHEN opens THEN '<ul>' || chr(10) ELSE '' END
    || '<li>' || {e_from(3)} || '</li>' WHEN 'T' THEN '<p>' || {e} || '</p>' ELSE '' END ||
  CASE WHEN closes_after THEN chr(10) || '</ul>' ELSE '' END"""


@query("fn06_markdown_to_html", f"""
WITH {RUNS_CTE}, out AS (SELECT doc_id, i, {_html_line_sql()} AS h FROM runs WHERE kind <> 'X' OR closes)
SELECT doc_id, string_agg(h, chr(10) ORDER BY i) AS html FROM out GROUP BY doc_id""")
def fn06(spark, sf_dir):
    return markdown_docs(spark, sf_dir).select("doc_id", text.markdown_to_html(F.col("text")).alias("html"))


MD_BLOCKS_CTE = f"""
{MARKDOWN_CTE}, ln AS ({q.lines('md', 'doc_id', 'text')}),
kinds AS (SELECT doc_id, i, line, {_kind_sql('line', True)} AS k FROM ln),
blocks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS block_idx,
  CASE WHEN k IN ('1','2','3') THEN 'heading' WHEN k = 'B' THEN 'bullet' WHEN k = 'N' THEN 'number' ELSE 'paragraph' END AS kind,
  CASE WHEN k IN ('1','2','3') THEN k::INT ELSE 0 END AS level,
  CASE WHEN k IN ('1','2','3') THEN substr(line, k::INT + 2) WHEN k = 'B' THEN substr(line, 3)
    WHEN k = 'N' THEN regexp_replace(line, '^\\p{{Nd}}+\\. ', '') ELSE line END AS text
  FROM kinds WHERE k <> 'X')"""


@query("fn07_markdown_blocks", f"WITH {MD_BLOCKS_CTE} SELECT doc_id, block_idx::BIGINT AS block_idx, kind, level, text FROM blocks")
def fn07(spark, sf_dir):
    return blocks.markdown_blocks(markdown_docs(spark, sf_dir), ["doc_id"], runs=False)


# Tokens in order of position, found by walking the alternation from the left; without lookahead,
# which the comparison engine lacks, gaps are what is left between the tokens.
_TOKENS = r"\*\*\*.*?\*\*\*|\*\*.*?\*\*|\*.*?\*|`.*?`"


@query("fn07_inline_runs", f"""
WITH {MD_BLOCKS_CTE}, split_up AS (
  SELECT doc_id, block_idx, unnest(string_split(regexp_replace(text, '({_TOKENS})', chr(1) || '\\1' || chr(1), 'g'), chr(1))) AS part,
    unnest(range(1, len(string_split(regexp_replace(text, '({_TOKENS})', chr(1) || '\\1' || chr(1), 'g'), chr(1))) + 1)) AS n
  FROM blocks WHERE kind = 'paragraph'
), marked AS (SELECT doc_id, block_idx, n, part,
    CASE WHEN part LIKE '***%' AND part LIKE '%***' THEN 3 WHEN part LIKE '**%' AND part LIKE '%**' THEN 2
    WHEN part LIKE '*%' AND part LIKE '%*' THEN 1 WHEN part LIKE '`%' AND part LIKE '%`' THEN 4 ELSE 0 END AS mark FROM split_up
), cut AS (SELECT doc_id, block_idx, n, mark,
    CASE WHEN mark = 0 THEN part ELSE substr(part, least(mark, CASE WHEN mark = 4 THEN 1 ELSE mark END) + 1,
      greatest(length(part) - 2 * CASE WHEN mark = 4 THEN 1 ELSE mark END, 0)) END AS text FROM marked)
SELECT doc_id, block_idx::BIGINT AS block_idx, row_number() OVER (PARTITION BY doc_id, block_idx ORDER BY n) AS run_idx,
  text, mark IN (2, 3) AS bold, mark IN (1, 3) AS italic, mark = 4 AS code FROM cut WHERE text <> ''""")
def fn07_runs(spark, sf_dir):
    rows = blocks.markdown_blocks(markdown_docs(spark, sf_dir), ["doc_id"]).filter("kind = 'paragraph'")
    runs = rows.select("doc_id", "block_idx", F.posexplode("runs").alias("i", "r"))
    return runs.select("doc_id", "block_idx", (F.col("i") + 1).cast("bigint").alias("run_idx"), "r.*")


@query("fn08_text_to_html", f"""
WITH ln AS ({q.lines('documents', 'doc_id', 'text')})
SELECT doc_id, string_agg(CASE WHEN {q.not_blank('line')} THEN '<p>' || {q.escape('line')} || '</p>' ELSE '<br>' END,
  chr(10) ORDER BY i) AS html FROM ln GROUP BY doc_id""")
def fn08(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text")
    return docs.select("doc_id", text.text_to_html(F.col("text")).alias("html"))


@query("fn09_wrap_html", f"SELECT doc_id, {q.wrap('text', 'source')} AS html FROM documents")
def fn09(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text", "source")
    return docs.select("doc_id", text.wrap_html(F.col("text"), F.col("source")).alias("html"))


# Extracted page text: every turn is a page; its role becomes a short upper-case line.
PAGE_TEXT_CTE = f"""
paged AS (SELECT conv_id AS doc_id, turn + 1 AS page_no, upper(role) || chr(10) || text || chr(10) || 'PAGE <' || turn || '>' AS text FROM conversations),
ln AS ({q.lines('paged', 'doc_id, page_no', 'text')}),
kept AS (SELECT doc_id, page_no, i, {q.strip('line')} AS line FROM ln WHERE {q.not_blank('line')}),
heads AS (SELECT *, length(line) < 60 AND upper(line) = line AND lower(line) <> line AS head FROM kept)"""


def page_texts(spark, sf_dir):
    conv = spread(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    body = F.concat_ws("\n", F.upper("role"), "text", F.concat(F.lit("PAGE <"), F.col("turn"), F.lit(">")))
    return conv.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_no"), body.alias("text"))


@query("fn10_classify_lines", f"""
WITH {PAGE_TEXT_CTE} SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY i) AS block_idx,
  CASE WHEN head THEN 'heading' ELSE 'paragraph' END AS kind, CASE WHEN head THEN 2 ELSE 0 END AS level, line AS text FROM heads""")
def fn10_blocks(spark, sf_dir):
    return blocks.extracted_blocks(page_texts(spark, sf_dir), ["doc_id", "page_no"])


@query("fn10_pages_to_html", f"""
WITH {PAGE_TEXT_CTE}, sections AS (SELECT doc_id, page_no, '<section id="page-' || page_no || '">' || chr(10) ||
  '  <h3 class="page-label">Page ' || page_no || '</h3>' || chr(10) || string_agg(CASE WHEN head THEN '  <h2>' || {q.escape('line')} || '</h2>'
  ELSE '  <p>' || {q.escape('line')} || '</p>' END, chr(10) ORDER BY i) || chr(10) || '</section>' AS s FROM heads GROUP BY doc_id, page_no)
SELECT doc_id, 0::BIGINT AS part_no, string_agg(s, chr(10) ORDER BY page_no) AS html FROM sections GROUP BY doc_id""")
def fn10_html(spark, sf_dir):
    section = text.extracted_page_html(F.col("text"), F.col("page_no"))
    return ordered.glue_parts(page_texts(spark, sf_dir), ["doc_id"], "page_no", section, "\n", "html")


@query("fn10_pages_to_markdown", f"""
WITH {PAGE_TEXT_CTE}, per_page AS (SELECT doc_id, page_no, string_agg(CASE WHEN head THEN chr(10) || '## ' || line || chr(10)
  ELSE line END, chr(10) ORDER BY i) AS md FROM heads GROUP BY doc_id, page_no)
SELECT doc_id, 0::BIGINT AS part_no, string_agg(CASE WHEN page_no > 1 THEN chr(10) || chr(10) || '---' || chr(10) || chr(10) ELSE '' END || md,
  chr(10) ORDER BY page_no) AS markdown FROM per_page GROUP BY doc_id""")
def fn10_markdown(spark, sf_dir):
    body = text.extracted_page_markdown(F.col("text"))
    marked = F.when(F.col("page_no") > 1, F.concat(F.lit("\n\n---\n\n"), body)).otherwise(body)
    return ordered.glue_parts(page_texts(spark, sf_dir), ["doc_id"], "page_no", marked, "\n", "markdown")


# The whole document: every page of a conversation in one HTML page.
@query("fn10_document_html", f"""
WITH {PAGE_TEXT_CTE}, sections AS (SELECT doc_id, page_no, '<section id="page-' || page_no || '">' || chr(10) ||
  '  <h3 class="page-label">Page ' || page_no || '</h3>' || chr(10) || string_agg(CASE WHEN head THEN '  <h2>' || {q.escape('line')} || '</h2>'
  ELSE '  <p>' || {q.escape('line')} || '</p>' END, chr(10) ORDER BY i) || chr(10) || '</section>' AS s FROM heads GROUP BY doc_id, page_no)
SELECT doc_id, 0::BIGINT AS part_no, {q.lit(text.PAGE_HEAD)} || 'Doc &lt;' || doc_id || '&gt;' || {q.lit(tables._PAGES_MID)} ||
  string_agg(s, chr(10) ORDER BY page_no) || {q.lit(text.PAGE_TAIL)} AS html FROM sections GROUP BY doc_id""")
def fn10_document(spark, sf_dir):
    title = F.concat(F.lit("Doc <"), F.col("doc_id"), F.lit(">"))
    return tables.pages_to_html(page_texts(spark, sf_dir), title)


@query("fn11_xml_to_json", """
SELECT c_custkey, '{"customer": {"id": "' || c_custkey || '", "tag": ["' || c_mktsegment || '", "00' || c_nationkey || '"], "name": {"lang": "en", "_text": "' || c_name || '"}, "note": {}}}' AS json
FROM customer""")
def fn11(spark, sf_dir):
    xml = F.expr(
        "concat('<x:customer xmlns:x=\"urn:c\" id=\"', c_custkey, '\"><tag>', c_mktsegment, '</tag><tag> 00', c_nationkey, "
        "' </tag><name lang=\"en\">', c_name, '</name><note/></x:customer>')"
    )
    source = spread(table(spark, sf_dir, "customer")).select("c_custkey", xml.alias("xml"))
    return source.select("c_custkey", markup.xml_to_json(F.col("xml"))["json"].alias("json"))


# The same records with a known shape stay inside the JVM.
@query("fn11_typed_xml_to_json", """
SELECT c_custkey, '{"customer":{"id":"' || c_custkey || '","tag":["' || c_mktsegment || '","00' || c_nationkey || '"],"name":{"lang":"en","_text":"' || c_name || '"}}}' AS json
FROM customer""")
def fn11_typed(spark, sf_dir):
    xml = F.expr(
        "concat('<x:customer xmlns:x=\"urn:c\" id=\"', c_custkey, '\"><tag>', c_mktsegment, '</tag><tag>00', c_nationkey, "
        "'</tag><name lang=\"en\">', c_name, '</name></x:customer>')"
    )
    source = spread(table(spark, sf_dir, "customer")).select("c_custkey", xml.alias("xml"))
    shape = "id string, tag array<string>, name struct<lang string, _text string>"
    return source.select("c_custkey", markup.typed_xml_to_json(F.col("xml"), shape).alias("json"))


@query("fn12_json_to_xml", f"""
SELECT event_id, {q.lit(markup.XML_DECLARATION)} || '<root><id>' || event_id || '</id><user><type>' || event_type ||
 '</type><k>' || json_extract_string(props, '$.k') || '</k></user><flags><item>True</item><item>None</item></flags></root>' AS xml FROM events""")
def fn12(spark, sf_dir):
    doc = F.expr(
        "concat('{\"id\": ', event_id, ', \"user\": {\"type\": \"', event_type, '\", \"k\": ', get_json_object(props, '$.k'), "
        "'}, \"flags\": [true, null]}')"
    )
    source = spread(table(spark, sf_dir, "events")).select("event_id", doc.alias("json"))
    return source.select("event_id", markup.json_to_xml(F.col("json"))["xml"].alias("xml"))


@query("fn13_to_base64", """
SELECT doc_id, to_base64(encode(text)) AS base64, 'data:image/jpeg;base64,' || to_base64(encode(text)) AS uri FROM documents""")
def fn13(spark, sf_dir):
    raw = F.encode("text", "utf-8")
    return documents(spark, sf_dir, "doc_id", "text").select(
        "doc_id", binary.to_base64(raw).alias("base64"), binary.data_uri(F.lit("/x/a.JPG"), raw).alias("uri")
    )


@query("fn14_from_base64", """
SELECT doc_id, text, octet_length(encode(text))::BIGINT AS file_size_bytes FROM documents""")
def fn14(spark, sf_dir):
    uri = binary.data_uri(F.lit("a.png"), F.encode("text", "utf-8"))
    raw = documents(spark, sf_dir, "doc_id", "text").select("doc_id", binary.from_base64(uri).alias("raw"))
    return raw.select(
        "doc_id", F.decode("raw", "utf-8").alias("text"), F.octet_length("raw").cast("bigint").alias("file_size_bytes")
    )


PATHS = (
    "concat('/in/', p_brand, '/', replace(p_name, ' ', '.'), "
    "element_at(array('.json', '.YAML', '.yml', '.Csv', '.toml', '.xlsx', '.xls', '.epub', '.gif', ''), cast(p_partkey % 10 + 1 as int)))"
)
PATHS_SQL = (
    "'/in/' || p_brand || '/' || replace(p_name, ' ', '.') || "
    "['.json', '.YAML', '.yml', '.Csv', '.toml', '.xlsx', '.xls', '.epub', '.gif', ''][(p_partkey % 10 + 1)::INT]"
)


def paths(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(PATHS).alias("path"))


@query("fn15_derive_output_name", f"""
SELECT p_partkey, regexp_replace(path, '(\\.[^./]+)$', '_to_csv.csv') AS new_ext, regexp_replace(path, '(\\.[^./]+)$', '_x\\1') AS same_ext
FROM (SELECT p_partkey, {PATHS_SQL} AS path FROM part)""")
def fn15(spark, sf_dir):
    p = F.col("path")
    return paths(spark, sf_dir).select(
        "p_partkey", names.derive_output_name(p, "_to_csv", ".csv").alias("new_ext"),
        names.derive_output_name(p, "_x").alias("same_ext"),
    )


@query("prj01_infer_format", f"""
SELECT p_partkey, CASE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) WHEN '.json' THEN 'json' WHEN '.yaml' THEN 'yaml' WHEN '.yml' THEN 'yaml'
  WHEN '.csv' THEN 'csv' WHEN '.toml' THEN 'toml' WHEN '.xlsx' THEN 'xlsx' WHEN '.xls' THEN 'xlsx' END AS format,
  CASE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) WHEN '.gif' THEN 'GIF' END AS image_format
FROM (SELECT p_partkey, {PATHS_SQL} AS path FROM part)""")
def prj01(spark, sf_dir):
    p = F.col("path")
    return paths(spark, sf_dir).select(
        "p_partkey", names.infer_format(p).alias("format"), names.infer_image_format(p).alias("image_format")
    )


@query("jn03_media_type", f"""
SELECT p_partkey, CASE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) WHEN '.yaml' THEN 'text/yaml' WHEN '.csv' THEN 'text/csv'
  WHEN '.toml' THEN 'application/toml' WHEN '.xlsx' THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet'
  WHEN '.epub' THEN 'application/epub+zip' WHEN '.gif' THEN 'image/gif' ELSE 'application/octet-stream' END AS media_type,
  CASE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) WHEN '.gif' THEN 'image/gif' ELSE 'image/png' END AS image_type
FROM (SELECT p_partkey, {PATHS_SQL} AS path FROM part)""")
def jn03(spark, sf_dir):
    p = F.col("path")
    return paths(spark, sf_dir).select(
        "p_partkey", names.media_type(p).alias("media_type"), names.image_media_type(p).alias("image_type")
    )


@query("fn16_flatten_one_level", """
SELECT event_id, event_type AS "who.type", user_id AS "who.id", json_extract_string(props, '$.k')::BIGINT AS "props.k",
  '[' || user_id || ',' || event_id || ']' AS ids FROM events""")
def fn16(spark, sf_dir):
    nested = table(spark, sf_dir, "events").select(
        "event_id", F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("id")).alias("who"),
        F.from_json("props", "k bigint").alias("props"), F.array("user_id", "event_id").alias("ids"),
    )
    return records.flatten_one_level(nested)


def _render_sql(fmt: str) -> str:
    e, s = q.escape(q.strip("text")), q.strip("text")
    if fmt == "html":
        line = f"""CASE kind WHEN 'heading' THEN '<h' || level || '>' || {e} || '</h' || level || '>'
          WHEN 'paragraph' THEN '<p>' || {q.escape('text')} || '</p>' ELSE '<li>' || {e} || '</li>' END"""
        sep = "chr(10)"
    elif fmt == "md":
        line = f"""CASE kind WHEN 'heading' THEN repeat('#', level) || ' ' || {s} WHEN 'bullet' THEN '- ' || {s}
          WHEN 'number' THEN '1. ' || {s} ELSE text END"""
        sep = "chr(10)"
    else:
        line, sep = "text", "chr(10) || chr(10)"
    return f"string_agg({line}, {sep} ORDER BY block_idx)"


# Marks inside a line would need the runs; the whole texts are rendered with their marks removed.
PLAIN_CTE = MD_BLOCKS_CTE.replace(
    MARKDOWN_CTE, f"md AS (SELECT doc_id, regexp_replace({MARKDOWN_SQL}, '[*`]', '', 'g') AS text FROM documents)"
)


@query("fn17_render_blocks", f"""
WITH {PLAIN_CTE} SELECT doc_id, 0::BIGINT AS part_no, {_render_sql('html')} AS html, {_render_sql('md')} AS markdown,
  {_render_sql('txt')} AS plain FROM blocks GROUP BY doc_id""")
def fn17(spark, sf_dir):
    docs = markdown_docs(spark, sf_dir).select("doc_id", F.regexp_replace("text", "[*`]", "").alias("text"))
    rows = blocks.markdown_blocks(docs, ["doc_id"])
    # Three renderings from one shuffle: the line of each format is a column of the same aggregate.
    lined = rows.select(
        "doc_id", ordered.chunk_of(F.col("block_idx") - 1, ordered.PART_ROWS).alias("part_no"), "block_idx",
        *[blocks.block_line(f).alias(n) for f, n in (("html", "html"), ("md", "markdown"), ("txt", "plain"))],
    )
    return lined.groupBy("doc_id", "part_no").agg(
        F.expr("listagg(html, '\\n') within group (order by block_idx)").alias("html"),
        F.expr("listagg(markdown, '\\n') within group (order by block_idx)").alias("markdown"),
        F.expr("listagg(plain, '\\n\\n') within group (order by block_idx)").alias("plain"),
    )


SLIDES_CTE = f"""
ln AS ({q.lines('conversations', 'conv_id AS doc_id, turn + 1 AS slide_no', 'text').replace('FROM (SELECT conv_id AS doc_id, turn + 1 AS slide_no,', 'FROM (SELECT conv_id, turn,')}),
kept AS (SELECT doc_id, slide_no, i, {q.strip('line')} AS line FROM ln WHERE {q.not_blank('line')}),
slides AS (SELECT conv_id AS doc_id, turn + 1 AS slide_no FROM conversations)"""


@query("fn18_render_slides_text", f"""
WITH {SLIDES_CTE}, every AS (SELECT doc_id, slide_no, 0 AS i, '--- Slide ' || slide_no || ' ---' AS line FROM slides UNION ALL SELECT * FROM kept)
SELECT doc_id, 0::BIGINT AS part_no, string_agg(line, chr(10) ORDER BY slide_no, i) AS text FROM every GROUP BY doc_id""")
def fn18_text(spark, sf_dir):
    return render_slides(slide_rows(spark, sf_dir), "txt")


@query("fn18_render_slides_html", f"""
WITH {SLIDES_CTE}, every AS (
  SELECT doc_id, slide_no, 0 AS i, '<section id="slide-' || slide_no || '"><h2>Slide ' || slide_no || '</h2>' AS line FROM slides
  UNION ALL SELECT doc_id, slide_no, i, '<p>' || {q.escape('line')} || '</p>' FROM kept
  UNION ALL SELECT doc_id, slide_no, 1000000000, '</section>' FROM slides)
SELECT doc_id, 0::BIGINT AS part_no, string_agg(line, chr(10) ORDER BY slide_no, i) AS text FROM every GROUP BY doc_id""")
def fn18_html(spark, sf_dir):
    return render_slides(slide_rows(spark, sf_dir), "html")


def slide_rows(spark, sf_dir):
    conv = spread(table(spark, sf_dir, "conversations", "conv_id", "turn", "text"))
    return conv.select(
        F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("slide_no"),
        F.posexplode(text.lines(F.col("text"))).alias("i", "text"),
    ).withColumn("para_idx", F.col("i") + 1).drop("i")


@query("ord01_preview", """
SELECT doc_id, substr(text, 1, 500) || CASE WHEN length(text) > 500 THEN '...' ELSE '' END AS preview FROM documents""")
def ord01(spark, sf_dir):
    return documents(spark, sf_dir, "doc_id", "text").select("doc_id", text.preview(F.col("text")).alias("preview"))


@query("ord02_route_by_size", """
SELECT doc_id, CASE WHEN length(text) > 2000 THEN 'saved' ELSE 'inline' END AS text_route,
  CASE WHEN octet_length(encode(text)) < 512000 THEN 'inline' ELSE 'saved' END AS binary_route FROM documents""")
def ord02(spark, sf_dir):
    return documents(spark, sf_dir, "doc_id", "text").select(
        "doc_id", F.when(binary.is_saved_text(F.col("text")), "saved").otherwise("inline").alias("text_route"),
        F.when(binary.is_inline(F.octet_length("text")), "inline").otherwise("saved").alias("binary_route"),
    )


@query("prj04_content_lines", f"""
WITH ln AS ({q.lines('documents', 'doc_id', 'text')})
SELECT doc_id, i::BIGINT AS line_no, line FROM ln WHERE {q.not_blank('line')} AND NOT starts_with({q.strip('line')}, '#')""")
def prj04(spark, sf_dir):
    return blocks.content_lines(documents(spark, sf_dir, "doc_id", "text"), ["doc_id"], comments=True)


@query("prj04_text_paragraphs", f"""
WITH ln AS ({q.lines('documents', 'doc_id', 'text')}) SELECT doc_id, i::BIGINT AS block_idx, 'paragraph' AS kind, 0 AS level, line AS text FROM ln""")
def prj04_paragraphs(spark, sf_dir):
    return blocks.text_paragraphs(documents(spark, sf_dir, "doc_id", "text"), ["doc_id"])


@query("prj06_plan_resize", """
SELECT p_partkey, w AS width, h AS height, CASE WHEN tw > 0 THEN tw WHEN th > 0 THEN (w * th) // h ELSE w END::BIGINT AS new_width,
  CASE WHEN th > 0 THEN th WHEN tw > 0 THEN (h * tw) // w ELSE h END::BIGINT AS new_height, greatest(1, least(95, p_size * 3)) AS quality
FROM (SELECT p_partkey, p_size, (p_size * 17 + 1)::BIGINT AS w, (p_partkey % 900 + 1)::BIGINT AS h,
  CASE WHEN p_partkey % 3 = 0 THEN 200 END AS tw, CASE WHEN p_partkey % 2 = 0 THEN 150 END AS th FROM part)""")
def prj06(spark, sf_dir):
    sized = table(spark, sf_dir, "part").select(
        "p_partkey", (F.col("p_size") * 17 + 1).cast("bigint").alias("width"),
        (F.col("p_partkey") % 900 + 1).alias("height"), "p_size",
        F.when(F.col("p_partkey") % 3 == 0, 200).alias("tw"), F.when(F.col("p_partkey") % 2 == 0, 150).alias("th"),
    )
    plan = binary.plan_resize(F.col("width"), F.col("height"), F.col("tw"), F.col("th"))
    return sized.withColumn("plan", plan).select(
        "p_partkey", "width", "height", F.col("plan.width").alias("new_width"), F.col("plan.height").alias("new_height"),
        binary.clamp_quality(F.col("p_size") * 3).alias("quality"),
    )


# Recognised blocks: the lines of the documents, with boxes from their place and length.
OCR_CTE = f"""
ln AS ({q.lines('documents', 'doc_id', 'text')}),
ocr AS (SELECT doc_id, i AS block_idx, i * 10.5::DOUBLE AS x, length(line)::DOUBLE AS y, line AS text,
  0.5::DOUBLE + (doc_id % 97) / 194.0::DOUBLE AS confidence FROM ln)"""


def ocr_blocks(spark, sf_dir):
    rows = documents(spark, sf_dir, "doc_id", "text").select(
        "doc_id", F.posexplode(text.lines(F.col("text"))).alias("i", "text")
    )
    idx, y = F.col("i") + 1, F.length("text").cast("double")
    x = idx * F.lit(10.5)
    return rows.select(
        "doc_id", idx.cast("bigint").alias("block_idx"),
        F.array(F.array(x, y), F.array(x + 50, y + 2), F.array(x + 48, y + 22), F.array(x - 2, y + 20)).alias("bbox"),
        "text", (F.lit(0.5) + (F.col("doc_id") % 97) / F.lit(194.0)).alias("confidence"),
    )


@query("agg04_bbox_envelope", """
SELECT l_orderkey, l_linenumber, l_partkey, (l_quantity - 2) * (72.0::DOUBLE / 200) AS x0, l_partkey::DOUBLE * (72.0::DOUBLE / 200) AS y0,
  (l_quantity + 50) * (72.0::DOUBLE / 200) AS x1, (l_partkey::DOUBLE + 22) * (72.0::DOUBLE / 200) AS y1 FROM lineitem""")
def agg04(spark, sf_dir):
    items = spread(table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"))
    x, y = F.col("l_quantity"), F.col("l_partkey").cast("double")
    box = F.array(F.array(x, y), F.array(x + 50, y + 2), F.array(x + 48, y + 22), F.array(x - 2, y + 20))
    return items.select(
        "l_orderkey", "l_linenumber", "l_partkey", binary.bbox_envelope(box, F.lit(200)).alias("e")
    ).select("l_orderkey", "l_linenumber", "l_partkey", "e.*")


@query("agg05_assemble_ocr_text", f"""
WITH {OCR_CTE} SELECT doc_id, 0::BIGINT AS part_no, string_agg(text, chr(10) ORDER BY block_idx) AS text, count(*)::BIGINT AS text_blocks
FROM ocr GROUP BY doc_id""")
def agg05_text(spark, sf_dir):
    return ocr.assemble_ocr(ocr_blocks(spark, sf_dir), "text", ["doc_id"])


@query("agg05_assemble_ocr_html", f"""
WITH {OCR_CTE} SELECT doc_id, 0::BIGINT AS part_no, string_agg('<p>' || {q.escape('text')} || '</p>', chr(10) ORDER BY block_idx) AS text,
  count(*)::BIGINT AS text_blocks FROM ocr GROUP BY doc_id""")
def agg05_html(spark, sf_dir):
    return ocr.assemble_ocr(ocr_blocks(spark, sf_dir), "html", ["doc_id"])


@query("agg05_assemble_ocr_markdown", f"""
WITH {OCR_CTE} SELECT doc_id, 0::BIGINT AS part_no, string_agg(CASE WHEN {q.not_blank('text')} THEN text END, chr(10) || chr(10) ORDER BY block_idx) AS text,
  count(*)::BIGINT AS text_blocks FROM ocr GROUP BY doc_id""")
def agg05_markdown(spark, sf_dir):
    return ocr.assemble_ocr(ocr_blocks(spark, sf_dir), "markdown", ["doc_id"])


@query("ord01_ocr_preview", f"""
WITH {OCR_CTE}, whole AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY block_idx) AS t FROM ocr GROUP BY doc_id)
SELECT doc_id, substr(t, 1, 500) || CASE WHEN length(t) > 500 THEN '...' ELSE '' END AS preview, length(t)::BIGINT AS char_count FROM whole""")
def ord01_ocr(spark, sf_dir):
    return ocr.ocr_preview(ocr.assemble_ocr(ocr_blocks(spark, sf_dir), "text", ["doc_id"]))


@query("agg05_ocr_document_html", f"""
WITH {OCR_CTE} SELECT doc_id, 0::BIGINT AS part_no, {q.lit(ocr._HTML_HEAD)} || 'd' || doc_id || {q.lit(ocr._HTML_MID)} ||
  string_agg('<p>' || {q.escape('text')} || '</p>', chr(10) ORDER BY block_idx) || {q.lit(ocr._HTML_TAIL)} AS text, count(*)::BIGINT AS text_blocks FROM ocr GROUP BY doc_id""")
def agg05_document(spark, sf_dir):
    title = F.concat(F.lit("d"), F.col("doc_id"))
    return ocr.ocr_document(ocr_blocks(spark, sf_dir), "html", ["doc_id"], title)


@query("agg05_ocr_document_markdown", f"""
WITH {OCR_CTE} SELECT doc_id, 0::BIGINT AS part_no, '# d' || doc_id || chr(10) || coalesce(chr(10) || chr(10) || string_agg(CASE WHEN {q.not_blank('text')} THEN text END,
  chr(10) || chr(10) ORDER BY block_idx), '') AS text, count(*)::BIGINT AS text_blocks FROM ocr GROUP BY doc_id""")
def agg05_document_markdown(spark, sf_dir):
    title = F.concat(F.lit("d"), F.col("doc_id"))
    return ocr.ocr_document(ocr_blocks(spark, sf_dir), "markdown", ["doc_id"], title)


@query("agg05_assemble_ocr_json", f"""
WITH {OCR_CTE} SELECT doc_id, 0::BIGINT AS part_no, '[' || string_agg('{{"text":' || to_json(text) || ',"confidence":' || round(confidence, 4) || ',"bbox":[[' ||
  x || ',' || y || '],[' || (x + 50) || ',' || (y + 2) || '],[' || (x + 48) || ',' || (y + 22) || '],[' || (x - 2) || ',' || (y + 20) || ']]}}',
  ',' ORDER BY block_idx) || ']' AS text, count(*)::BIGINT AS text_blocks FROM ocr GROUP BY doc_id""")
def agg05_json(spark, sf_dir):
    return ocr.assemble_ocr(ocr_blocks(spark, sf_dir), "json", ["doc_id"])


