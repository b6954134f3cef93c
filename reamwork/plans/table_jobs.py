"""Tables and records: sources, sinks and their round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup
from ..functions.text import markdown_to_text
from ..operators import config, grids, ordered, records, reports, sequence, tables
from ..session import scratch_dir, settle
from ..sources import configs, sinks, tabular
from . import convert
from . import sqltext as q
from .registry import query, several, spread, table

CUSTOMER = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


def customers(spark, sf_dir, *columns):
    return table(spark, sf_dir, "customer", *(columns or CUSTOMER))


# Customers in tables of 500 rows: a group key and a position from 1.
def customer_tables(spark, sf_dir):
    key = F.col("c_custkey")
    return customers(spark, sf_dir).withColumn("grp", F.floor(key / 500)).withColumn("pos", key % 500 + 1)


GROUPS = "g AS (SELECT *, c_custkey // 500 AS grp, c_custkey % 500 + 1 AS pos FROM customer)"

ITEM_COLUMNS = "l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_returnflag"


@query("src01_read_csv", """
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity, l_extendedprice, CASE WHEN l_discount = 0 THEN NULL ELSE l_discount END AS l_discount,
  l_returnflag, l_linenumber > 3 AS late, 'a "b", ' || chr(10) || l_linestatus AS note FROM lineitem""")
def src01(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem", *ITEM_COLUMNS.split(", "), "l_linestatus").select(
        *ITEM_COLUMNS.split(", ")[:4], F.when(F.col("l_discount") == 0, "N/A").otherwise(F.col("l_discount").cast("string")).alias("l_discount"),
        "l_returnflag", F.when(F.col("l_linenumber") > 3, "True").otherwise("False").alias("late"),
        F.concat(F.lit('a "b", \n'), "l_linestatus").alias("note"),
    )
    path = scratch_dir(spark, "csv")
    sinks.write_csv(spread(items), path, delimiter=";")
    return tabular.read_csv(spark, path, delimiter=";")


@query("snk01_write_csv", """
SELECT c_custkey || '|' || c_name || '|' || CASE WHEN c_nationkey = 3 THEN '' ELSE c_nationkey::VARCHAR END || '|"' || c_mktsegment || ' ""q""' || '"' AS line FROM customer
UNION ALL SELECT 'c_custkey|c_name|c_nationkey|seg' FROM region WHERE r_regionkey = 0""")
def snk01(spark, sf_dir):
    rows = customers(spark, sf_dir).select(
        "c_custkey", "c_name", F.when(F.col("c_nationkey") != 3, F.col("c_nationkey")).alias("c_nationkey"),
        F.concat("c_mktsegment", F.lit(' "q"')).alias("seg"),
    )
    path = scratch_dir(spark, "csv")
    sinks.write_csv(rows, path, delimiter="|")
    return spark.read.text(path).select(F.col("value").alias("line")).dropDuplicates(["line"])


JSON_ROW = """'{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || 'é","c_acctbal":' || c_acctbal || ',"none":null}'"""


def json_rows(spark, sf_dir):
    return customer_tables(spark, sf_dir).select(
        "grp", "pos", "c_custkey", F.concat("c_name", F.lit("é")).alias("c_name"), "c_acctbal",
        F.lit(None).cast("string").alias("none"),
    )


@query("snk02_write_json_docs", f"""
WITH {GROUPS} SELECT grp, 0::BIGINT AS part_no, '[' || string_agg({JSON_ROW}, ',' ORDER BY pos) || ']' AS json, count(*)::BIGINT AS records FROM g GROUP BY grp""")
def snk02(spark, sf_dir):
    columns = ["c_custkey", "c_name", "c_acctbal", "none"]
    return records.json_array_docs(json_rows(spark, sf_dir), ["grp"], "pos", columns)


@query("src02_read_json_docs", "SELECT c_custkey, c_name || 'é' AS c_name, c_acctbal FROM customer")
def src02(spark, sf_dir):
    path = scratch_dir(spark, "json")
    rows = json_rows(spark, sf_dir).drop("none")
    sinks.write_json_arrays(rows.withColumn("grp", F.floor(F.col("c_custkey") / 500)).withColumn(
        "pos", F.col("c_custkey") % 500 + 1), path, ["grp"], "pos")
    return tabular.read_json_docs(spark, path).select("c_custkey", "c_name", "c_acctbal")


@query("src02_json_variant_rows", """
SELECT (c_custkey % 500)::INT AS pos, c_name, c_acctbal FROM customer""")
def src02_variant(spark, sf_dir):
    path = scratch_dir(spark, "json")
    docs = json_rows(spark, sf_dir).drop("none")
    docs = docs.withColumn("grp", F.floor(F.col("c_custkey") / 500)).withColumn("pos", F.col("c_custkey") % 500 + 1)
    sinks.write_json_arrays(docs, path, ["grp"], "pos")
    found = tabular.json_variant_rows(spark, path)
    return found.select(
        "pos", F.regexp_replace(F.variant_get("record", "$.c_name", "string"), "é", "").alias("c_name"),
        F.variant_get("record", "$.c_acctbal", "double").alias("c_acctbal"),
    )


@query("snk03_write_jsonl", """
SELECT '{"event_id":' || event_id || ',"event_type":"' || event_type || '","k":' || coalesce(CASE WHEN k > 50 THEN k END::VARCHAR, 'null') || '}' AS line
FROM (SELECT event_id, event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events)""")
def snk03(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("bigint")
    rows = table(spark, sf_dir, "events", "event_id", "event_type", "props").select(
        "event_id", "event_type", F.when(k > 50, k).alias("k")
    )
    path = scratch_dir(spark, "jsonl")
    sinks.write_jsonl(rows, path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("src03_read_jsonl", """
SELECT event_id, event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE event_id % 10 <> 7""")
def src03(spark, sf_dir):
    lines = table(spark, sf_dir, "events", "event_id", "event_type", "props").select(F.expr(
        "CASE WHEN event_id % 10 = 7 THEN '   ' ELSE concat('{\"event_id\": ', event_id, ', \"event_type\": \"', event_type, "
        "'\", \"k\": ', get_json_object(props, '$.k'), '}') END").alias("line"))
    path = scratch_dir(spark, "jsonl")
    sinks.write_text(lines, path, "line")
    parsed = tabular.parse_jsonl(spark.read.text(path), "event_id bigint, event_type string, k bigint")
    return parsed.filter("_corrupt_record is null").drop("_corrupt_record")


@query("src04_read_xml_records", """
SELECT c_custkey::VARCHAR AS id, c_name AS name, '00' || c_nationkey AS nation, c_acctbal::VARCHAR AS balance FROM customer""")
def src04(spark, sf_dir):
    xml = F.expr(
        "concat('<c:rec id=\"', c_custkey, '\"><c:name> ', c_name, ' </c:name><nation>9</nation><nation>00', c_nationkey, "
        "'</nation><balance cur=\"x\">', c_acctbal, '</balance></c:rec>')")
    grouped = ordered.glue_parts(
        customer_tables(spark, sf_dir).withColumn("xml", xml), ["grp"], "pos", "xml", "\n", part_rows=100)
    doc = F.concat(F.lit('<data xmlns:c="urn:c">'), F.col("text"), F.lit("</data>"))
    path = scratch_dir(spark, "xml")
    # one document per file
    grouped.select("grp", "part_no", doc.alias("value")).write.partitionBy("grp", "part_no").text(path)
    return tabular.read_xml_records(spark, path, "rec", "id string, name string, nation array<string>, balance struct<_text string>"
    ).select("id", "name", "nation", "balance")


@query("src04_tag_per_file", """
WITH c AS (SELECT *, c_custkey // 50 AS grp FROM customer)
SELECT c_custkey::VARCHAR AS id, c_name AS name, NULL::VARCHAR AS seg, NULL::VARCHAR AS error FROM c WHERE grp % 3 = 0
UNION ALL SELECT c_custkey::VARCHAR, NULL, c_mktsegment, NULL FROM c WHERE grp % 3 = 1
UNION ALL SELECT NULL, NULL, NULL, 'XML root has no children to flatten into rows.' FROM (SELECT DISTINCT grp FROM c WHERE grp % 3 = 2)""")
def src04_tags(spark, sf_dir):
    kind = F.col("grp") % 3
    one = F.when(kind == 0, F.expr("concat('<rec id=\"', c_custkey, '\"><name>', c_name, '</name></rec>')")).when(
        kind == 1, F.expr("concat('<x:entry xmlns:x=\"u\"><id>', c_custkey, '</id><seg>', c_mktsegment, '</seg></x:entry>')")).otherwise("")
    rows = customers(spark, sf_dir).withColumn("grp", F.floor(F.col("c_custkey") / 50)).withColumn("pos", F.col("c_custkey") % 50).withColumn("xml", one)
    docs = ordered.glue_parts(rows, ["grp"], "pos", "xml", "\n", first=0).select("grp", F.concat(
        F.lit("<?xml version='1.0'?><!-- <rec> and <entry> -->\n<data>"), F.col("text"), F.lit("</data>")).alias("value"))
    path = scratch_dir(spark, "xml-tags")
    # a file for each document, from tasks that write a few hundred of them
    several(docs, 500, "grp").select("value").write.option("maxRecordsPerFile", 1).text(path)
    done = tabular.xml_corpus_records(spark, path)
    return done.rows.select("id", "name", "seg").unionByName(done.errors.select("error"), allowMissingColumns=True)


@query("snk04_write_xml", f"""
SELECT c_custkey, {q.lit(markup.XML_DECLARATION)} || '<customer><id>' || c_custkey || '</id><name>' || c_name || ' &amp; &lt;co&gt;</name>' ||
  '<tags><item>' || c_mktsegment || '</item><item>None</item></tags><rich>' || CASE WHEN c_acctbal > 0 THEN 'True' ELSE 'False' END || '</rich></customer>' AS xml FROM customer""")
def snk04(spark, sf_dir):
    rows = customers(spark, sf_dir).select("c_custkey", F.struct(
        F.col("c_custkey").alias("id"), F.concat("c_name", F.lit(" & <co>")).alias("name"),
        F.array(F.col("c_mktsegment"), F.lit(None)).alias("tags"), (F.col("c_acctbal") > 0).alias("rich"),
    ).alias("r"))
    kind = rows.schema["r"].dataType
    return rows.select("c_custkey", markup.record_to_xml(F.col("r"), kind, "customer").alias("xml"))


@query("snk04_xml_round_trip", """
SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_acctbal::VARCHAR AS c_acctbal FROM customer""")
def snk04_trip(spark, sf_dir):
    path = scratch_dir(spark, "xml")
    sinks.write_xml(customers(spark, sf_dir, "c_custkey", "c_name", "c_acctbal"), path, record_tag="customer")
    return tabular.read_xml_records(spark, path, "customer", "c_custkey string, c_name string, c_acctbal string")


@query("src05_read_parquet", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 30 AND l_returnflag = 'A'""")
def src05(spark, sf_dir):
    items = tabular.read_parquet(spark, f"{sf_dir}/lineitem.parquet")
    kept = items.filter((F.col("l_quantity") >= 30) & (F.col("l_returnflag") == "A"))
    return kept.select("l_orderkey", "l_linenumber", "l_quantity")


@query("snk05_write_parquet", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def snk05(spark, sf_dir):
    path = scratch_dir(spark, "parquet")
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    sinks.write_parquet(orders, path)
    return tabular.read_parquet(spark, path)


# INI texts, one file per order: DEFAULT, both delimiters, comments, continuation lines.
INI = (
    "concat('# head\\n[DEFAULT]\\nHost = h', o_orderkey % 7, '\\n\\n[Order]\\nKey: ', o_orderkey, '\\n; note\\nSTATUS=', o_orderstatus, "
    "'\\nText = one\\n   two\\n\\n[price]\\nhost = own\\ntotal = ', o_totalprice, CASE WHEN o_orderkey % 50 = 0 THEN '\\n[price]\\na=1' "
    "WHEN o_orderkey % 50 = 1 THEN '\\nTotal = 2' WHEN o_orderkey % 50 = 2 THEN '\\nno delimiter' ELSE '' END)"
)


def ini_files(spark, sf_dir):
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    text = F.expr(INI)
    headless = F.when(F.col("o_orderkey") % 50 == 3, F.concat(F.lit("a = 1\n"), text)).otherwise(text)
    return spread(orders).select(F.concat(F.lit("f"), F.col("o_orderkey"), F.lit(".ini")).alias("path"), headless.alias("value"))


INI_ROWS = """
good AS (SELECT 'f' || o_orderkey || '.ini' AS path, * FROM orders WHERE o_orderkey % 50 > 3),
ini AS (SELECT path, 'Order' AS section, 'key' AS key, o_orderkey::VARCHAR AS value FROM good
  UNION ALL SELECT path, 'Order', 'status', o_orderstatus FROM good
  UNION ALL SELECT path, 'Order', 'text', 'one' || chr(10) || 'two' FROM good
  UNION ALL SELECT path, 'Order', 'host', 'h' || o_orderkey % 7 FROM good
  UNION ALL SELECT path, 'price', 'host', 'own' FROM good
  UNION ALL SELECT path, 'price', 'total', o_totalprice::VARCHAR FROM good)"""


@query("src07_read_ini", f"WITH {INI_ROWS} SELECT * FROM ini")
def src07(spark, sf_dir):
    return configs.read_ini(ini_files(spark, sf_dir), ["path"]).rows


@query("src07_read_ini_errors", """
SELECT 'f' || o_orderkey || '.ini' AS path, CASE o_orderkey % 50 WHEN 0 THEN 'section already exists' WHEN 1 THEN 'option already exists'
  WHEN 2 THEN 'source contains parsing errors' ELSE 'file contains no section headers' END AS error FROM orders WHERE o_orderkey % 50 <= 3""")
def src07_errors(spark, sf_dir):
    return configs.read_ini(ini_files(spark, sf_dir), ["path"]).errors


@query("src07_ini_to_json", f"""
WITH {INI_ROWS}, s AS (SELECT path, section, '"' || section || '":{{' || string_agg('"' || key || '":' || to_json(value), ',' ORDER BY
  CASE WHEN section = 'Order' AND key = 'host' THEN 'z' ELSE key END) || '}}' AS j FROM ini GROUP BY path, section)
SELECT path, '{{' || string_agg(j, ',' ORDER BY section) || '}}' AS json, NULL::VARCHAR AS error FROM s GROUP BY path""")
def src07_json(spark, sf_dir):
    done = configs.ini_to_json(ini_files(spark, sf_dir), ["path"])
    return sequence.where_present(done, "json").select("path", "json", "error")


@query("src07_ini_to_yaml", """
SELECT 'f' || o_orderkey || '.ini' AS path, 'Order:' || chr(10) || '  host: h' || o_orderkey % 7 || chr(10) || '  key: ''' || o_orderkey || '''' || chr(10) ||
  '  status: ' || o_orderstatus || chr(10) || '  text: ''one' || chr(10) || chr(10) || '    two''' || chr(10) || 'price:' || chr(10) || '  host: own' || chr(10) ||
  '  total: ''' || o_totalprice || '''' || chr(10) AS yaml FROM orders WHERE o_orderkey % 50 > 3""")
def src07_yaml(spark, sf_dir):
    return configs.ini_to_yaml(ini_files(spark, sf_dir), ["path"]).rows


# One file per segment and nation with a section per ten customers.
CONF_ROWS = """
conf AS (SELECT 'conf/' || c_mktsegment || '/' || c_nationkey AS path, 's' || c_custkey // 10 AS section, c_name AS key, c_acctbal::VARCHAR AS value FROM customer)"""


def config_rows(spark, sf_dir):
    return customers(spark, sf_dir).select(
        F.concat(F.lit("conf/"), "c_mktsegment", F.lit("/"), F.col("c_nationkey")).alias("path"),
        F.concat(F.lit("s"), F.floor(F.col("c_custkey") / 10)).alias("section"), F.col("c_name").alias("key"),
        F.col("c_acctbal").cast("string").alias("value"))


@query("agg06_nest_keys", f"""
WITH {CONF_ROWS}, s AS (SELECT path, section, '"' || section || '":{{' || string_agg('"' || key || '":' || to_json(value), ',' ORDER BY key) || '}}' AS j,
  count(*) AS n FROM conf GROUP BY path, section)
SELECT path, 0::BIGINT AS part_no, '{{' || string_agg(j, ',' ORDER BY section) || '}}' AS json, count(*)::BIGINT AS sections, sum(n)::BIGINT AS keys FROM s GROUP BY path""")
def agg06(spark, sf_dir):
    return config.nest_keys(config_rows(spark, sf_dir), ["path"])


# Files of more than five keys go on in parts by hash, so the JSON is taken apart again and the
# keys are compared.
@query("agg06_nest_keys_in_parts", f"WITH {CONF_ROWS} SELECT * FROM conf")
def agg06_parts(spark, sf_dir):
    docs = config.nest_keys(config_rows(spark, sf_dir), ["path"], max_keys=5)
    nested = F.from_json("json", "map<string, map<string, string>>")
    sections = docs.select("path", F.explode(nested).alias("section", "pairs"))
    return sections.select("path", "section", F.explode("pairs").alias("key", "value"))


def env_files(spark, sf_dir):
    # a table of few bytes is read by few tasks, and the files' lines are sorted within a task
    parts = several(table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_size"), 100_000)
    text = F.expr(
        "concat('# env\\n\\n  NAME = \"', p_name, '\"  \\nBRAND=''', p_brand, '''\\nURL=http://x?a=', p_partkey, '\\nSIZE=0\\nno line\\n"
        "SIZE = ', p_size, '\\r\\nEMPTY=\\n')")
    return parts.select(F.concat(F.col("p_partkey"), F.lit("/.env")).alias("path"), text.alias("value"))


ENV_ROWS = """
env AS (SELECT p_partkey || '/.env' AS path, 'NAME' AS key, p_name AS value FROM part UNION ALL SELECT p_partkey || '/.env', 'BRAND', p_brand FROM part
  UNION ALL SELECT p_partkey || '/.env', 'URL', 'http://x?a=' || p_partkey FROM part
  UNION ALL SELECT p_partkey || '/.env', 'SIZE', p_size::VARCHAR FROM part UNION ALL SELECT p_partkey || '/.env', 'EMPTY', '' FROM part)"""


@query("src08_read_env", f"WITH {ENV_ROWS} SELECT * FROM env")
def src08(spark, sf_dir):
    return configs.read_env(env_files(spark, sf_dir), ["path"])


@query("agg06_flat_document", f"""
WITH {ENV_ROWS} SELECT path, 0::BIGINT AS part_no, '{{' || string_agg('"' || key || '":' || to_json(value), ',' ORDER BY key) || '}}' AS json,
  count(*)::BIGINT AS keys FROM env GROUP BY path""")
def agg06_flat(spark, sf_dir):
    return config.flat_document(configs.read_env(env_files(spark, sf_dir), ["path"]), ["path"])


YAML = "concat('id: ', c_custkey, '\\nname: ', c_name, '\\nseen: 2024-01-0', c_custkey % 9 + 1, '\\ntags:\\n  - ', c_mktsegment, '\\n  - zip: \"007\"\\n')"
TOML = "concat('id = ', c_custkey, '\\nname = \"', c_name, '\"\\nseen = 2024-01-0', c_custkey % 9 + 1, '\\ntags = [\"', c_mktsegment, '\", {zip = \"007\"}]\\n')"


def config_files(spark, sf_dir):
    text = F.expr(f"CASE WHEN c_custkey % 20 = 0 THEN 'a: [1' WHEN c_custkey % 2 = 0 THEN {YAML} ELSE {TOML} END")
    return spread(customers(spark, sf_dir)).select(
        F.concat(F.lit("c"), F.col("c_custkey")).alias("path"),
        F.when(F.col("c_custkey") % 2 == 0, "yaml").otherwise("toml").alias("format"), text.alias("value"))


@query("src09_read_config_docs", """
WITH c AS (SELECT 'c' || c_custkey AS path, * FROM customer WHERE c_custkey % 20 <> 0)
SELECT path, 'id' AS key_path, c_custkey::VARCHAR AS value, 'bigint' AS type FROM c UNION ALL SELECT path, 'name', c_name, 'string' FROM c
UNION ALL SELECT path, 'seen', '2024-01-0' || (c_custkey % 9 + 1), 'date' FROM c UNION ALL SELECT path, 'tags[0]', c_mktsegment, 'string' FROM c
UNION ALL SELECT path, 'tags[1].zip', '007', 'string' FROM c""")
def src09(spark, sf_dir):
    return configs.config_leaves(configs.parse_config_docs(config_files(spark, sf_dir)))


@query("src09_config_variants", """
SELECT 'c' || c_custkey AS path, c_custkey AS id, '007' AS zip FROM customer WHERE c_custkey % 20 <> 0""")
def src09_variant(spark, sf_dir):
    docs = configs.config_variants(configs.parse_config_docs(config_files(spark, sf_dir)))
    return docs.select("path", F.variant_get("doc", "$.id", "bigint").alias("id"),
                       F.variant_get("doc", "$.tags[1].zip", "string").alias("zip"))


@query("snk06_render_yaml", """
SELECT c_custkey, 'balance: ' || c_acctbal || chr(10) || 'name: ' || c_name || chr(10) || 'tags:' || chr(10) || '- ' || c_mktsegment || chr(10) ||
  '- ''12''' || chr(10) AS yaml FROM customer""")
def snk06_yaml(spark, sf_dir):
    doc = F.to_json(F.struct(
        F.array("c_mktsegment", F.lit("12")).alias("tags"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")))
    return spread(customers(spark, sf_dir)).select("c_custkey", config.render_config(doc, "yaml")["text"].alias("yaml"))


@query("snk06_render_yaml_flat", """
SELECT c_custkey, 'name: ' || c_name || chr(10) || 'segment: ' || c_mktsegment || chr(10) AS yaml FROM customer""")
def snk06_flat(spark, sf_dir):
    entries = F.array(
        F.struct(F.lit("segment").alias("key"), F.col("c_mktsegment").alias("value")),
        F.struct(F.lit("name").alias("key"), F.col("c_name").alias("value")))
    return customers(spark, sf_dir).select("c_custkey", config.flat_yaml(entries).alias("yaml"))


@query("snk06_render_toml", """
SELECT c_custkey, '[[items]]' || chr(10) || 'name = "' || c_name || '"' || chr(10) || 'balance = ' || c_acctbal || chr(10) || chr(10) || '[items.where]' ||
  chr(10) || 'nation = ' || c_nationkey || chr(10) AS toml FROM customer""")
def snk06_toml(spark, sf_dir):
    doc = F.to_json(F.array(F.struct(
        F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"),
        F.struct(F.col("c_nationkey").alias("nation")).alias("where"))))
    return spread(customers(spark, sf_dir)).select("c_custkey", config.render_config(doc, "toml")["text"].alias("toml"))


MD_HEAD = "'| c_custkey | c_name | c_acctbal | seg |' || chr(10) || '| --- | --- | --- | --- |' || chr(10)"
MD_ROW = "'| ' || c_custkey || ' | ' || c_name || ' | ' || c_acctbal || ' | ' || CASE WHEN c_nationkey = 3 THEN 'nan' ELSE c_mktsegment END || ' |'"


@query("snk07_to_markdown_table", f"""
WITH {GROUPS} SELECT grp, 0::BIGINT AS part_no, {MD_HEAD} || string_agg({MD_ROW}, chr(10) ORDER BY pos) AS markdown, count(*)::BIGINT AS rows FROM g GROUP BY grp""")
def snk07(spark, sf_dir):
    rows = customer_tables(spark, sf_dir).withColumn("seg", F.when(F.col("c_nationkey") != 3, F.col("c_mktsegment")))
    return tables.to_markdown_table(rows, ["grp"], "pos", ["c_custkey", "c_name", "c_acctbal", "seg"])


@query("snk07_markdown_rows", "SELECT '| ' || l_orderkey || ' | ' || l_linenumber || ' | ' || l_extendedprice || ' |' AS line FROM lineitem")
def snk07_rows(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice")
    return items.select(tables.markdown_rows(items, items.columns).alias("line"))


HTML_HEAD = """'<h2>Part <' || grp || '&gt;</h2>'""".replace("Part <", "Part &lt;")
HTML_ROW = "'<tr><td>' || c_custkey || '</td><td>' || c_name || '</td><td>' || c_mktsegment || ' &amp; &quot;co&quot;</td></tr>'"


@query("snk08_to_html_table", f"""
WITH {GROUPS} SELECT grp, 0::BIGINT AS part_no, {HTML_HEAD} || chr(10) || '<table border=''1''>' || chr(10) ||
 '<thead><tr><th>c_custkey</th><th>c_name</th><th>seg</th></tr></thead>' || chr(10) || '<tbody>' || chr(10) ||
  string_agg({HTML_ROW}, chr(10) ORDER BY pos) || chr(10) || '</tbody>' || chr(10) || '</table>' AS html, count(*)::BIGINT AS rows FROM g GROUP BY grp""")
def snk08(spark, sf_dir):
    return html_docs(spark, sf_dir)


def html_docs(spark, sf_dir):
    rows = customer_tables(spark, sf_dir).withColumn("seg", F.concat("c_mktsegment", F.lit(' & "co"')))
    name = F.concat(F.lit("Part <"), F.col("grp"), F.lit(">"))
    return tables.to_html_table(rows, ["grp"], "pos", ["c_custkey", "c_name", "seg"], name)


HTML_CELLS = f"""
WITH {GROUPS}, v AS (SELECT grp, pos AS row_idx, unnest([0, 1, 2]) AS col_idx, unnest([c_custkey::VARCHAR, c_name, c_mktsegment || ' & "co"']) AS text, false AS is_header FROM g
  UNION ALL SELECT grp, 0, unnest([0, 1, 2]), unnest(['c_custkey', 'c_name', 'seg']), true FROM (SELECT DISTINCT grp FROM g))"""


@query("src11_html_table_cells", f"""
{HTML_CELLS} SELECT grp, 1::BIGINT AS tables_found, 0 AS table_idx, row_idx::INT AS row_idx, col_idx, text, is_header FROM v""")
def src11(spark, sf_dir):
    return tables.html_table_cells(html_docs(spark, sf_dir), ["grp"])


@query("src11_cells_to_rows", "SELECT c_custkey // 500 AS grp, c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment || ' & \"co\"' AS seg FROM customer")
def src11_rows(spark, sf_dir):
    found = tables.html_table_grids(html_docs(spark, sf_dir), ["grp"])
    rows = grids.grid_records(found, ["grp", "table_idx"], F.col("first_row"))
    return grids.records_table(rows, grids.column_names(found, ["grp", "table_idx"]), ["grp"])


def spanned_pages(spark, sf_dir):
    """A page per customer: a header of two rows with cells over rows and columns, a table inside a cell, line breaks."""
    parts = (
        "'<p>x</p><table><thead><tr><th rowspan=2>k</th><th colspan=\"2\">who</th></tr><tr><th>first<br/>part</th><th>rest</th></tr></thead><tr><td>', c_custkey, "
        "'<td>in<TABLE><tr><td ROWSPAN=\"3\">', c_nationkey, '</td><td>z</td></tr></TABLE>after</td><td> New <b>York</b> &amp;\n\n ', c_mktsegment, "
        "'</td></tr><tr><td colspan=3>end</table><table><tr><td>a<td>b</table></table>'")
    return customers(spark, sf_dir).select("c_custkey", F.expr(f"concat({parts})").alias("html"))


@query("src11_html_spans", """
WITH c AS (SELECT *, c_nationkey::VARCHAR AS nk FROM customer),
cells AS (SELECT c_custkey, unnest([
  {'t': 0, 'r': 0, 'c': 0, 'x': 'k', 'h': true}, {'t': 0, 'r': 0, 'c': 1, 'x': 'who', 'h': true}, {'t': 0, 'r': 0, 'c': 2, 'x': 'who', 'h': true},
  {'t': 0, 'r': 1, 'c': 0, 'x': 'k', 'h': true}, {'t': 0, 'r': 1, 'c': 1, 'x': 'first part', 'h': true}, {'t': 0, 'r': 1, 'c': 2, 'x': 'rest', 'h': true},
  {'t': 0, 'r': 2, 'c': 0, 'x': c_custkey::VARCHAR, 'h': false}, {'t': 0, 'r': 2, 'c': 1, 'x': 'in' || nk || 'zafter', 'h': false}, {'t': 0, 'r': 2, 'c': 2, 'x': 'New York &  ' || c_mktsegment, 'h': false},
  {'t': 0, 'r': 3, 'c': 0, 'x': 'end', 'h': false}, {'t': 0, 'r': 3, 'c': 1, 'x': 'end', 'h': false}, {'t': 0, 'r': 3, 'c': 2, 'x': 'end', 'h': false},
  {'t': 1, 'r': 0, 'c': 0, 'x': nk, 'h': false}, {'t': 1, 'r': 0, 'c': 1, 'x': 'z', 'h': false}, {'t': 1, 'r': 1, 'c': 0, 'x': nk, 'h': false}, {'t': 1, 'r': 2, 'c': 0, 'x': nk, 'h': false},
  {'t': 2, 'r': 0, 'c': 0, 'x': 'a', 'h': false}, {'t': 2, 'r': 0, 'c': 1, 'x': 'b', 'h': false}]) AS s FROM c)
SELECT c_custkey, 3::BIGINT AS tables_found, s.t::INTEGER AS table_idx, s.r::INTEGER AS row_idx, s.c::INTEGER AS col_idx, s.x AS text, s.h AS is_header FROM cells""")
def src11_spans(spark, sf_dir):
    return tables.html_table_cells(spread(spanned_pages(spark, sf_dir)), ["c_custkey"])


@query("src11_html_records", """
SELECT c_custkey, 0 AS table_idx, c_custkey::VARCHAR AS k, 'in' || c_nationkey || 'zafter' AS "who first part", 'New York &  ' || c_mktsegment AS "who rest", NULL::VARCHAR AS "0", NULL::VARCHAR AS "1" FROM customer
UNION ALL SELECT c_custkey, 0, 'end', 'end', 'end', NULL, NULL FROM customer
UNION ALL SELECT c_custkey, 1, NULL, NULL, NULL, c_nationkey::VARCHAR, CASE WHEN i = 0 THEN 'z' END FROM customer, range(3) r(i)
UNION ALL SELECT c_custkey, 2, NULL, NULL, NULL, 'a', 'b' FROM customer""")
def src11_records(spark, sf_dir):
    found = settle(tables.html_table_grids(spread(spanned_pages(spark, sf_dir)), ["c_custkey"]), "html-grids")
    rows = grids.grid_records(found, ["c_custkey", "table_idx"], F.col("first_row"))
    return grids.records_table(rows, grids.column_names(found, ["c_custkey", "table_idx"]), ["c_custkey", "table_idx"])


@query("prj05_nth_table", """
SELECT page_id, page_id % 4 AS tables_found, 0 AS row_idx, 0 AS col_idx, 't1 of ' || page_id AS text, true AS is_header, NULL::VARCHAR AS error FROM pages WHERE page_id % 4 > 1
UNION ALL SELECT page_id, page_id % 4, 1, 0, url, false, NULL FROM pages WHERE page_id % 4 > 1
UNION ALL SELECT page_id, NULL, NULL, NULL, NULL, NULL, CASE WHEN page_id % 4 = 0 THEN 'No tables found in the HTML file.'
  ELSE 'Only 1 table(s) found; table_index 1 is out of range.' END FROM pages WHERE page_id % 4 <= 1""")
def prj05(spark, sf_dir):
    pages = spread(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    made = F.transform(
        F.sequence(F.lit(0), F.lit(2)),
        lambda i: F.concat(F.lit("<TABLE class='x'><tr><th> <b>t"), i, F.lit("</b> of "), F.col("page_id"), F.lit("</th></tr><tr><td>"),
                           F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</td></tr></TABLE>")))
    some = F.array_join(F.slice(made, 1, (F.col("page_id") % 4).cast("int")), "<p>x</p>")
    done = tables.nth_table(pages.select("page_id", F.concat("html", some).alias("html")), ["page_id"], 1)
    return done.rows.unionByName(done.errors, allowMissingColumns=True)


@query("prj05_pick_table", f"""
{HTML_CELLS} SELECT grp, row_idx::INT AS row_idx, col_idx, text FROM v""")
def prj05_pick(spark, sf_dir):
    cells = tables.html_table_cells(html_docs(spark, sf_dir), ["grp"])
    return tables.pick_table(cells, ["grp"], 0).rows.select("grp", "row_idx", "col_idx", "text")


@query("snk09_keyed_document", """
SELECT 'customer' AS table_name, c_custkey // 1024 AS part_no, '[' || string_agg('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}', ',' ORDER BY c_custkey) || ']' AS json,
  count(*)::BIGINT AS records FROM customer GROUP BY ALL
UNION ALL SELECT 'supplier', s_suppkey // 1024, '[' || string_agg('{"s_suppkey":' || s_suppkey || ',"s_acctbal":' || s_acctbal || '}', ',' ORDER BY s_suppkey) || ']',
  count(*)::BIGINT FROM supplier GROUP BY ALL""")
def snk09(spark, sf_dir):
    return sinks.keyed_document({
        "customer": (customers(spark, sf_dir, "c_custkey", "c_name"), "c_custkey"),
        "supplier": (table(spark, sf_dir, "supplier", "s_suppkey", "s_acctbal"), "s_suppkey"),
    })


@query("snk09_export_tables", """
SELECT 'customer' AS table_name, c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier""")
def snk09_export(spark, sf_dir):
    path = scratch_dir(spark, "export")
    sinks.export_tables({
        "customer": customers(spark, sf_dir, "c_custkey", "c_acctbal"),
        "supplier": table(spark, sf_dir, "supplier", "s_suppkey", "s_acctbal"),
    }, path)
    parts = [
        tabular.read_csv(spark, f"{path}/{n}", schema=f"{k} bigint, {b} double").select(
            F.lit(n).alias("table_name"), F.col(k).alias("id"), F.col(b).alias("balance"))
        for n, k, b in (("customer", "c_custkey", "c_acctbal"), ("supplier", "s_suppkey", "s_acctbal"))
    ]
    return parts[0].unionByName(parts[1])


@query("snk10_convert_csv_to_json", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def snk10_json(spark, sf_dir):
    path = scratch_dir(spark, "convert")
    sinks.write_csv(customers(spark, sf_dir, "c_custkey", "c_name", "c_acctbal"), f"{path}/in.csv")
    convert.convert(spark, f"{path}/in.csv", "json", f"{path}/out.json")
    return tabular.read_jsonl(spark, f"{path}/out.json", "c_custkey bigint, c_name string, c_acctbal double")


@query("snk10_convert_csv_to_yaml", """
SELECT unnest(['- c_acctbal: ' || c_acctbal, '  c_custkey: ' || c_custkey, '  c_name: ' || c_name]) AS line FROM customer""")
def snk10_yaml(spark, sf_dir):
    path = scratch_dir(spark, "convert")
    sinks.write_csv(customers(spark, sf_dir, "c_custkey", "c_name", "c_acctbal"), f"{path}/in.csv")
    convert.convert(spark, f"{path}/in.csv", "yaml", f"{path}/out.yaml")
    return spark.read.text(f"{path}/out.yaml").select(F.col("value").alias("line")).filter("line <> ''")


@query("snk10_convert_json_to_csv", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def snk10_csv(spark, sf_dir):
    path = scratch_dir(spark, "convert")
    docs = json_rows(spark, sf_dir).drop("none").withColumn("grp", F.floor(F.col("c_custkey") / 500)).withColumn(
        "pos", F.col("c_custkey") % 500 + 1)
    sinks.write_json_arrays(docs, f"{path}/in", ["grp"], "pos")
    convert.convert(spark, f"{path}/in", "csv", f"{path}/out", input_format="json")
    out = tabular.read_csv(spark, f"{path}/out")
    return out.select("c_custkey", F.regexp_replace("c_name", "é", "").alias("c_name"), "c_acctbal")


def config_documents(spark, sf_dir, line, separator, prefix=""):
    """Files of 500 customers each, a record rendered by ``line``; returns the folder."""
    path = scratch_dir(spark, "convert")
    rows = customer_tables(spark, sf_dir).withColumn("line", F.expr(line))
    docs = ordered.glue_parts(rows, ["grp"], "pos", "line", separator, first=0).select("grp", F.concat(F.lit(prefix), "text").alias("value"))
    docs.write.partitionBy("grp").text(f"{path}/in")
    return path


@query("snk10_convert_yaml_to_csv", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def snk10_yaml_csv(spark, sf_dir):
    path = config_documents(spark, sf_dir, "concat('- {c_custkey: ', c_custkey, ', c_name: \"', c_name, '\", c_acctbal: ', c_acctbal, '}')", "\n")
    convert.convert(spark, f"{path}/in", "csv", f"{path}/out", input_format="yaml")
    return tabular.read_csv(spark, f"{path}/out", schema="c_acctbal double, c_custkey bigint, c_name string")


@query("snk10_convert_toml_to_json", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def snk10_toml_json(spark, sf_dir):
    path = config_documents(
        spark, sf_dir, "concat('[[items]]\nc_custkey = ', c_custkey, '\nc_name = \"', c_name, '\"\nc_acctbal = ', c_acctbal)", "\n", "# customers\n")
    convert.convert(spark, f"{path}/in", "json", f"{path}/out", input_format="toml")
    parsed = F.from_json("text", "items array<struct<c_custkey bigint, c_name string, c_acctbal double>>")
    return spark.read.parquet(f"{path}/out").select(F.inline(parsed["items"]))


@query("snk10_convert_csv_to_toml", """
SELECT unnest(['[[items]]', 'c_custkey = ' || c_custkey, 'c_name = "' || c_name || '"', 'c_acctbal = ' || c_acctbal]) AS line FROM customer""")
def snk10_toml(spark, sf_dir):
    path = scratch_dir(spark, "convert")
    sinks.write_csv(customers(spark, sf_dir, "c_custkey", "c_name", "c_acctbal"), f"{path}/in.csv")
    convert.convert(spark, f"{path}/in.csv", "toml", f"{path}/out.toml")
    return spark.read.text(f"{path}/out.toml").select(F.col("value").alias("line")).filter("line <> ''")


@query("set01_union_records", """
SELECT event_id AS id, event_type AS kind, NULL::BIGINT AS k, value FROM events WHERE event_id % 2 = 0
UNION ALL SELECT event_id, NULL, json_extract_string(props, '$.k')::BIGINT, NULL FROM events WHERE event_id % 2 = 1""")
def set01(spark, sf_dir):
    events = table(spark, sf_dir, "events", "event_id", "event_type", "value", "props")
    even = events.filter("event_id % 2 = 0").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "value")
    odd = events.filter("event_id % 2 = 1").select(
        F.col("event_id").alias("id"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return records.union_records(even, odd)


def broken_lines(spark, sf_dir):
    events = table(spark, sf_dir, "events", "event_id", "event_type", "props")
    return events.select("event_id", "event_type", F.when(
        F.col("event_id") % 9 == 0, F.regexp_replace("props", "}$", "")).otherwise(F.col("props")).alias("props"))


@query("udf01_safe_convert", """
SELECT event_id, event_id % 9 <> 0 AS success, CASE WHEN event_id % 9 <> 0 THEN json_extract_string(props, '$.k')::BIGINT END AS k,
  CASE WHEN event_id % 9 = 0 THEN 'not valid JSON' END AS error FROM events""")
def udf01(spark, sf_dir):
    parsed = F.try_parse_json("props")
    error = F.when(F.col("converted").isNull(), "not valid JSON")
    done = reports.safe_convert(broken_lines(spark, sf_dir), parsed, error)
    good = done.rows.select("event_id", F.lit(True).alias("success"), F.try_variant_get("converted", "$.k", "bigint").alias("k"),
                            F.lit(None).cast("string").alias("error"))
    bad = done.errors.select("event_id", F.lit(False).alias("success"), F.lit(None).cast("bigint").alias("k"), "error")
    return good.unionByName(bad)


@query("agg07_conversion_totals", """
SELECT event_type AS op, count(*)::BIGINT AS files, count(*) FILTER (event_id % 9 <> 0)::BIGINT AS succeeded, count(*) FILTER (event_id % 9 = 0)::BIGINT AS failed,
  count(*) FILTER (event_id % 9 <> 0)::BIGINT AS rows, coalesce(sum(octet_length(encode(props))) FILTER (event_id % 9 <> 0), 0)::BIGINT AS bytes FROM events GROUP BY event_type""")
def agg07(spark, sf_dir):
    lines = broken_lines(spark, sf_dir)
    error = F.when(F.try_parse_json("props").isNull(), "not valid JSON")
    report = reports.report_rows(lines, F.col("event_type"), "event_id", error, 1, F.octet_length("props"))
    return reports.conversion_totals(report)


@query("agg03_size_reduction", f"""
SELECT lang, old::BIGINT AS original_size_bytes, new::BIGINT AS compressed_size_bytes, round((1 - new / old) * 100, 1) AS size_reduction_percent
FROM (SELECT lang, sum(octet_length(encode(text)))::DOUBLE AS old, sum(octet_length(encode({q.markdown_to_text('text')})))::DOUBLE AS new FROM documents GROUP BY lang)""")
def agg03(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents", "lang", "text"))
    before = docs.select("lang", F.octet_length("text").alias("bytes"))
    after = docs.select("lang", F.octet_length(markdown_to_text(F.col("text"))).alias("bytes"))
    return reports.size_reduction(before, after, ["lang"])

