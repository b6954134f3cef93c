import json
import sqlite3
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from reamwork.operators import records, tables
from reamwork.plans import convert
from reamwork.sources import archives, images, office, sinks, sqlite, tabular

RECORDS = "id bigint, name string, score double, active boolean, tags array<string>, addr struct<city string, zip string>"


@pytest.fixture
def people(frame):
    return frame(
        [(1, "Zoë, \"q\"\nline", 1.5, True, ["a", "b"], ("Köln", "007")), (2, None, None, False, [], None), (3, "x", 2e9, None, None, ("", None))],
        RECORDS)


def test_csv_missing_values_and_types(spark, tmp_path):
    (tmp_path / "a.csv").write_text('i,d,b,t,n,z\n1,1.5,True,x,NA,007a\n,2,False,"a ""b""\nc",nan,NULL\n3,N/A,true,"",None,1d\n', encoding="utf-8")
    df = tabular.read_csv(spark, str(tmp_path))
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "double", "boolean", "string", "double", "string"]
    assert [tuple(r) for r in df.collect()] == [
        (1, 1.5, True, "x", None, "007a"), (None, 2.0, False, 'a "b"\nc', None, None), (3, None, True, None, None, "1d")]
    typed = tabular.read_csv(spark, str(tmp_path), schema="i double, d string, b string, t string, n string, z bigint")
    assert [r.z for r in typed.collect()] == [None, None, None]


def test_csv_round_trip(spark, tmp_path, people):
    flat = people.select("id", "name", "score", "active")
    assert sinks.write_csv(flat, f"{tmp_path}/o", ";") == 3
    back = tabular.read_csv(spark, f"{tmp_path}/o", ";")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, flat.collect()))


def test_jsonl_keeps_nulls_and_nesting(spark, tmp_path, people):
    assert sinks.write_jsonl(people, f"{tmp_path}/o") == 3
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/o").collect()]
    assert {"id", "name", "score", "active", "tags", "addr"} == set(lines[0]) and any(x["name"] is None for x in lines)
    back = tabular.read_jsonl(spark, f"{tmp_path}/o", RECORDS)
    assert sorted(map(str, back.collect())) == sorted(map(str, people.collect()))


def test_broken_json_lines_are_kept_apart(frame):
    rows = frame([('{"a": 1}',), ("",), ("  ",), ('{"a": ',), ('{"a": "x"}',)], "value string")
    got = tabular.parse_jsonl(rows, "a int").collect()
    assert sorted((r.a or 0, r._corrupt_record is not None) for r in got) == [(0, True), (0, True), (1, False)]


def test_json_documents_arrays_and_objects(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2, "y": "z"}]')
    (tmp_path / "b.json").write_text('{"x": 3}')
    assert sorted(r.x for r in tabular.read_json_docs(spark, str(tmp_path)).collect()) == [1, 2, 3]
    (tmp_path / "c.json").write_text('[{"x": ')
    rows = tabular.json_variant_rows(spark, str(tmp_path)).select(
        "error", F.try_variant_get("record", "$.x", "int").alias("x")).collect()
    assert sorted((r.x or 0, r.error or "") for r in rows) == [(0, "not valid JSON"), (1, ""), (2, ""), (3, "")]


def test_json_arrays_in_parts(frame):
    rows = [(1, i, float("nan") if i == 2 else 0.5 * i, None) for i in range(1, 6)]
    src = frame(rows, "g int, pos int, x double, n string")
    parts = records.json_array_docs(src, ["g"], "pos", ["x", "n"], part_rows=2).orderBy("part_no").collect()
    assert [len(json.loads(p.json)) for p in parts] == [2, 2, 1] == [p.records for p in parts]
    assert json.loads(parts[0].json) == [{"x": 0.5, "n": None}, {"x": None, "n": None}]


def test_timestamps_as_epoch_millis(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-02 03:04:05.678' AS t")
    assert json.loads(df.select(records.json_records(df, epoch_millis=True)).first()[0]) == {"t": 1704164645678}
    assert json.loads(df.select(records.json_records(df)).first()[0]) == {"t": "2024-01-02T03:04:05.678"}


XML = """<data xmlns="u" xmlns:p="v"><rec id="1" k="a"><name> n1 </name><v>1</v><v>007</v><p:w q="z">t</p:w></rec>
<rec id="2" name="attr"><name>child</name><sub>own<x>in</x></sub></rec></data>"""


def test_xml_records(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    assert [(r.tag, r.error) for r in tabular.record_tags(spark, str(tmp_path)).collect()] == [("rec", None)]
    got = {r.id: r.asDict() for r in tabular.read_xml_records(spark, str(tmp_path)).collect()}
    assert got["1"]["v"] == "007" and got["1"]["w"] == "t" and got["1"]["k"] == "a" and got["1"]["name"] == "n1"
    assert got["2"]["sub"] == "own" and got["2"]["k"] is None


def test_every_xml_file_has_its_own_tag(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "sub +x").mkdir(parents=True)
    (folder / "a.xml").write_text("<?xml version='1.0'?><!-- <no> --><!DOCTYPE d [<!ELEMENT d (r)>]>\n<d><r><a>1</a></r><r><a>2</a></r></d>")
    (folder / "sub +x" / "b c.xml").write_text("<d xmlns:q='u'><!-- > --><![CDATA[<r>]]><q:s b='3'><a>4</a></q:s></d>")
    (folder / "none.xml").write_text("<d/>")
    (folder / "text.xml").write_text("<d>only text</d>")
    (folder / "bare.xml").write_text("no markup")
    (folder / "empty.xml").write_text("")
    done = tabular.xml_corpus_records(spark, str(folder))
    assert sorted((r.a, r.b) for r in done.rows.collect()) == [("1", None), ("2", None), ("4", "3")]
    assert {r.file.rsplit("/", 1)[1]: r.error for r in done.errors.collect()} == {
        "none.xml": tabular.NO_RECORDS, "text.xml": tabular.NO_RECORDS, "bare.xml": "not an XML document"}
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "e.xml").write_text("<data/>")
    none = tabular.xml_corpus_records(spark, str(tmp_path / "e"))
    assert none.rows.count() == 0 and none.errors.count() == 1


def test_tags_of_an_xml_file_in_many_splits(spark, tmp_path):
    body = "".join(f"<rec><n>{i}</n></rec>" for i in range(4_000))
    (tmp_path / "big.xml").write_text(f"<!-- {'<rec2>' * 300} --><d>{body}</d>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        assert [r.tag for r in tabular.record_tags(spark, str(tmp_path)).collect()] == ["rec"]
        assert sorted(int(r.n) for r in tabular.read_xml_records(spark, str(tmp_path)).collect()) == list(range(4_000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def workbook(path, sheets):
    """A workbook of sheets {name: {cell: text}}."""
    names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets))
    rels = "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets)))
    with zipfile.ZipFile(path, "w") as box:
        box.writestr("xl/workbook.xml", f'<workbook xmlns="m" xmlns:r="r"><sheets>{names}</sheets></workbook>')
        box.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="p">{rels}</Relationships>')
        for i, cells in enumerate(sheets.values()):
            rows = {}
            for ref, text in cells.items():
                rows.setdefault(int(ref.lstrip("ABCDEFGHIJ")), []).append(f'<c r="{ref}" t="inlineStr"><is><t>{text}</t></is></c>')
            body = "".join(f'<row r="{r}">{"".join(c)}</row>' for r, c in sorted(rows.items()))
            box.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="m"><sheetData>{body}</sheetData></worksheet>')


def test_workbooks_of_different_headers_are_converted(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    workbook(folder / "a.xlsx", {"Sheet1": {"A1": "id", "C1": "name", "A2": "1", "B2": "X", "C2": "ann", "A4": "2"}, "More": {"A1": "z", "A2": "9"}})
    workbook(folder / "b.xlsx", {"Sheet1": {"A1": "city", "B1": "pop", "A2": "rome", "B2": "5", "A3": "bonn", "B3": "7"}})
    workbook(folder / "c.xlsx", {"Other": {"A1": "lost"}})
    (folder / "d.xlsx").write_bytes(b"broken")
    done = convert.convert(spark, str(folder), "csv", f"{tmp_path}/csv", input_format="xlsx")
    assert (done["success"], done["files"], done["failed"], done["rows_converted"]) == (True, 2, 2, 4)
    got = spark.read.option("header", True).csv(f"{tmp_path}/csv")
    assert got.columns == ["id", "Unnamed: 1", "name", "city", "pop"]
    want = [("1", "X", "ann", None, None), ("2", None, None, None, None), (None, None, None, "bonn", "7"), (None, None, None, "rome", "5")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    convert.convert(spark, str(folder), "json", f"{tmp_path}/json", input_format="xlsx")
    lines = sorted(r.value for r in spark.read.text(f"{tmp_path}/json").collect())
    assert '{"id":1,"Unnamed: 1":"X","name":"ann","city":null,"pop":null}' in lines and len(lines) == 4
    done = convert.convert(spark, str(folder), "toml", f"{tmp_path}/toml", input_format="xlsx")
    assert (done["rows_converted"], done["rows_failed"], done["failed"]) == (4, 0, 2)
    missing = convert.convert(spark, str(folder), "csv", f"{tmp_path}/no", input_format="xlsx", sheet_name="None such")
    assert not missing["success"] and missing["failed"] == 4
    sheets = office.sheet_grids(archives.binary_corpus(spark, str(folder)))
    text = {(r.path.rsplit("/", 1)[1], r.sheet_name): r.markdown for r in office.sheet_markdown(sheets, part_rows=1).filter("part_no = 0").collect()}
    assert text["a.xlsx", "More"] == "| z |\n| --- |\n| 9 |" and text["c.xlsx", "Other"] == "| lost |\n| --- |\n"
    assert text["b.xlsx", "Sheet1"] == "| city | pop |\n| --- | --- |\n| rome | 5 |"


def test_xml_sink_wraps_arrays(spark, tmp_path, people):
    assert sinks.write_xml(people.select("id", "tags").filter("id = 1"), f"{tmp_path}/o") == 1
    text = "".join(r.value.strip() for r in spark.read.text(f"{tmp_path}/o").collect())
    assert "<tags><item>a</item><item>b</item></tags>" in text


def test_union_and_flatten(frame, people):
    flat = records.flatten_one_level(people)
    assert flat.columns == ["id", "name", "score", "active", "tags", "addr.city", "addr.zip"]
    assert flat.filter("id = 1").first()["tags"] == '["a","b"]'
    both = records.union_records(people.select("id"), frame([(9, "k")], "id bigint, other string"))
    assert both.columns == ["id", "other"] and both.count() == 4


def make_database(path):
    conn = sqlite3.connect(path)
    long = "a table with a name of well over 31 letters"
    conn.execute("CREATE TABLE t1 (a INTEGER, b TEXT, r REAL)")
    conn.execute(f'CREATE TABLE "{long}" (x INTEGER PRIMARY KEY, "odd name" BLOB)')
    conn.execute("CREATE TABLE nokey (k TEXT PRIMARY KEY, v INTEGER) WITHOUT ROWID")
    conn.executemany("INSERT INTO t1 VALUES (?, ?, ?)", [(i, f"b{i}" if i % 3 else None, i / 2) for i in range(1000)])
    conn.execute(f'INSERT INTO "{long}" VALUES (1, ?)', (b"\x00\x01",))
    conn.execute("INSERT INTO nokey VALUES ('a', 1)")
    conn.execute("CREATE TABLE empty (a INTEGER)")
    conn.commit()
    conn.close()
    return long


def test_sqlite_source(spark, tmp_path):
    path = str(tmp_path / "x.db")
    long = make_database(path)
    found = sqlite.read_sqlite(spark, path, partitions=3)
    assert set(found) == {"t1", long, "nokey", "empty"}
    t1 = found["t1"]
    assert t1.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, t1.collect()))[:2] == [(0, None, 0.0), (1, "b1", 0.5)] and t1.count() == 1000
    assert t1.select("r").agg(F.sum("r")).first()[0] == sum(i / 2 for i in range(1000))
    assert bytes(found[long].first()["odd name"]) == b"\x00\x01"
    assert found["nokey"].collect()[0].v == 1 and found["empty"].count() == 0
    with pytest.raises(Exception):
        sqlite.read_sqlite(spark, path, 't1" --')["t1\" --"].count()


def test_sqlite_corpus_with_a_broken_file(spark, frame, tmp_path):
    make_database(str(tmp_path / "x.db"))
    files = frame([("good", bytearray((tmp_path / "x.db").read_bytes())), ("bad", bytearray(b"no database at all" * 100))], "path string, content binary")
    got = sqlite.sqlite_rows(files).groupBy("path", "table_name").agg(F.count("record").alias("n"), F.max("error").alias("e")).collect()
    assert {(r.path, r.table_name): r.n for r in got if r.path == "good"}[("good", "t1")] == 1000
    assert [bool(r.e) for r in got if r.path == "bad"] == [True]


def test_export_and_keyed_document(spark, tmp_path, frame):
    a, b = frame([(0, "x")], "i int, s string"), frame([(0, 1.5), (1, None)], "i int, d double")
    assert sinks.export_tables({"a": a, "b": b}, f"{tmp_path}/csv") == {"a": 1, "b": 2}
    assert tabular.read_csv(spark, f"{tmp_path}/csv/b").count() == 2
    docs = {r.table_name: json.loads(r.json) for r in sinks.keyed_document({"a": (a, "i"), "b": (b, "i")}).collect()}
    assert docs == {"a": [{"i": 0, "s": "x"}], "b": [{"i": 0, "d": 1.5}, {"i": 1, "d": None}]}
    with pytest.raises(ValueError):
        sinks.export_tables({"a": a}, f"{tmp_path}/z", "xls")


def test_markdown_sink(spark, tmp_path, frame):
    sinks.write_markdown(frame([(1, None), (2, "b")], "i int, s string"), f"{tmp_path}/md")
    assert [r.value for r in spark.read.text(f"{tmp_path}/md/header").collect()] == ["| i | s |", "| --- | --- |"]
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/md/rows").collect()) == ["| 1 | nan |", "| 2 | b |"]


def test_html_table_round_trip(frame):
    rows = [(1, i, f"n<{i}>") for i in range(1, 8)]
    html = tables.to_html_table(frame(rows, "g int, pos int, name string"), ["g"], "pos", ["pos", "name"], F.lit("A & B"))
    assert html.first().html.startswith("<h2>A &amp; B</h2>\n<table border='1'>")
    back = tables.cells_to_rows(tables.html_table_cells(html, ["g"]), ["g", "table_idx"], ["pos", "name"])
    assert sorted((int(r.pos), r.name) for r in back.collect()) == [(i, n) for _, i, n in rows]


def png(width, height):
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\x00" + b"\x10\x20\x30" * width for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_image_info_agrees_with_the_decoder(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(7, 5))
    (tmp_path / "b.png").write_bytes(b"junk")
    done = images.image_info(spark.read.format("binaryFile").load(str(tmp_path)))
    row = done.rows.first()
    decoded = spark.read.format("image").option("dropInvalid", True).load(str(tmp_path)).select("image.width", "image.height").first()
    assert (row.format, row.width, row.height, row.mode) == ("PNG", decoded.width, decoded.height, "RGB")
    assert row.file_size_bytes == (tmp_path / "a.png").stat().st_size
    assert [r.path[-5:] for r in done.errors.collect()] == ["b.png"]


def test_tiff_and_bmp_headers(frame):
    from reamwork.functions.binary import image_header

    def read_image_header(raw):
        got = frame([(bytearray(raw),)], "raw binary").select(image_header(F.col("raw")).alias("h")).first().h
        return tuple(got) if got else None

    bmp = b"BM" + bytes(16) + struct.pack("<iiHH", 9, -4, 1, 24)
    assert read_image_header(bmp) == ("BMP", 9, 4, "RGB")
    entry = lambda e, tag, value: struct.pack(e + "HHIHH", tag, 3, 1, value, 0)
    for mark, e in ((b"II", "<"), (b"MM", ">")):
        tags = [(256, 11), (257, 6), (258, 8), (262, 2), (277, 3)]
        raw = mark + struct.pack(e + "HI", 42, 8) + struct.pack(e + "H", len(tags)) + b"".join(entry(e, t, v) for t, v in tags)
        assert read_image_header(raw) == ("TIFF", 11, 6, "RGB")
    assert read_image_header(b"II*\x00\xff\xff\xff\x7f") is None


def test_supported_formats():
    got = convert.supported_formats()
    assert len(got["formats"]) == 5 and len(got["conversions"]) == 20
    assert convert.infer_path_format("/a/b.YML") == "yaml" and convert.infer_path_format("/a.json/b") is None


def test_convert_between_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"name": "x", "n": {"b": [1, 2]}, "when": null}')
    (tmp_path / "in" / "b.json").write_text('[{"q": 1}]')
    (tmp_path / "in" / "c.json").write_text("{")
    done = convert.convert(spark, f"{tmp_path}/in", "YAML", f"{tmp_path}/yaml", "json")
    assert (done["success"], done["files"], done["failed"]) == (True, 2, 1)
    texts = {r.path[-6:]: r.text for r in spark.read.parquet(f"{tmp_path}/yaml").collect()}
    assert texts["a.json"] == "n:\n  b:\n  - 1\n  - 2\nname: x\nwhen: null\n" and texts["b.json"] == "- q: 1\n"
    convert.convert(spark, f"{tmp_path}/in", "toml", f"{tmp_path}/toml", "json")
    import tomllib
    tomls = {r.path[-6:]: tomllib.loads(r.text) for r in spark.read.parquet(f"{tmp_path}/toml").filter("error is null").collect()}
    assert tomls == {"a.json": {"name": "x", "n": {"b": [1, 2]}}, "b.json": {"items": [{"q": 1}]}}


def test_convert_yaml_records_to_csv_and_errors(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("- a: 1\n  s: {x: 1, y: z}\n- a: 2\n  t: [1]\n")
    done = convert.convert(spark, f"{tmp_path}/a.yaml", "csv", f"{tmp_path}/csv")
    assert done["rows_converted"] == 2
    got = {r.a: r.asDict() for r in tabular.read_csv(spark, f"{tmp_path}/csv").collect()}
    assert got[1]["s.x"] == 1 and got[1]["s.y"] == "z" and got[2]["t"] == "[1]" and got[2]["s.x"] is None
    assert not convert.convert(spark, "x.bin", "csv", "y")["success"]
    assert not convert.convert(spark, "x.csv", "xlsx", "y")["success"]
