import configparser
import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from reamwork import streaming
from reamwork.operators import config, ocr, reports
from reamwork.sources import archives, configs, office

INI = {
    "plain": "[A]\nKey = v\nother: w:x=y\n\n[b c]\nk=\n",
    "default": "[DEFAULT]\nbase = 1\nk = d\n[s]\nk = own\n[empty]\n",
    "comments": "# c\n; d\n[s]\n# in\na = 1 ; kept\n  # indented\nb = 2\n",
    "folded": "[s]\na = one\n   two\n\n   three\nb = x\n[t]\nc =\n  l1\n  l2\n",
    "indented": "[s]\n  a = 1\n  b = 2\n    more\n",
    "crlf": "[s]\r\na = 1\r\nb = 2\r\n",
    "dup key": "[s]\na = 1\nA = 2\n",
    "dup section": "[s]\na = 1\n[s]\n",
    "headless": "a = 1\n[s]\n",
    "no delimiter": "[s]\njust words\n",
    "empty": "",
}


def by_stdlib(text):
    parser = configparser.RawConfigParser()
    parser.read_string(text)
    return {s: dict(parser[s]) for s in parser.sections()}


def test_ini_like_the_standard_parser(frame):
    files = frame(list(INI.items()), "path string, value string")
    done = configs.read_ini(files, ["path"])
    got = {}
    for r in done.rows.collect():
        got.setdefault(r.path, {}).setdefault(r.section, {})[r.key] = r.value
    failed = {r.path for r in done.errors.collect()}
    as_json = {r.path: r.json for r in configs.ini_to_json(files, ["path"]).collect()}
    for name, text in INI.items():
        try:
            want = by_stdlib(text)
        except configparser.Error:
            assert name in failed and name not in got and as_json[name] is None
            continue
        assert name not in failed
        assert got.get(name, {}) == {s: kv for s, kv in want.items() if kv}, name
        assert json.loads(as_json[name]) == want


ENV = "# c\n\nA=b=c\n  Q = \"x 'y'\"  \nS='z'\nA=last\nno line\nE=\n\"K\"='\"v\"'\n"


def test_env_last_line_wins(frame):
    got = configs.read_env(frame([("f", ENV)], "path string, value string"), ["path"]).collect()
    assert {r.key: r.value for r in got} == {"A": "last", "Q": "x 'y", "S": "z", "E": "", '"K"': '"v"'}


@pytest.mark.parametrize("limit", [3, 100_000])
def test_nested_documents_merge_to_the_whole(frame, limit):
    rows = [("f", f"s{i % 4}", f"k{i}", f"v\"{i}") for i in range(40)] + [("g", "s", "k", "v")]
    docs = config.nest_keys(frame(rows, "path string, section string, key string, value string"), ["path"], limit).collect()
    whole = {}
    for d in docs:
        for s, kv in json.loads(d.json).items():
            whole.setdefault((d.path, s), {}).update(kv)
    assert whole == {("f", f"s{j}"): {f"k{i}": f"v\"{i}" for i in range(40) if i % 4 == j} for j in range(4)} | {("g", "s"): {"k": "v"}}
    assert sum(d.keys for d in docs) == 41 and (len(docs) > 2) == (limit == 3)
    flat = config.flat_document(frame([("e", "b", "2"), ("e", "a", "1")], "path string, key string, value string"), ["path"]).first()
    assert json.loads(flat.json) == {"a": "1", "b": "2"}


def test_config_corpus_with_a_broken_file(frame):
    files = frame([
        ("y", "yaml", "a: 1\nb: [x, 2024-01-02]\nc: {d: null, e: true}\n"), ("t", "toml", "a = 1.5\nd = 2024-01-02T03:04:05Z\n[t]\nq = \"007\"\n"),
        ("bad", "yaml", "a: [1"), ("unsafe", "yaml", "!!python/object/apply:os.getcwd []\n"),
    ], "path string, format string, value string")
    parsed = configs.parse_config_docs(files)
    leaves = {(r.path, r.key_path): (r.value, r.type) for r in configs.config_leaves(parsed).collect()}
    assert leaves == {
        ("y", "a"): ("1", "bigint"), ("y", "b[0]"): ("x", "string"), ("y", "b[1]"): ("2024-01-02", "date"), ("y", "c.d"): (None, "null"),
        ("y", "c.e"): ("true", "boolean"), ("t", "a"): ("1.5", "double"), ("t", "d"): ("2024-01-02T03:04:05+00:00", "timestamp"),
        ("t", "t.q"): ("007", "string")}
    assert {r.path for r in parsed.filter("error is not null").collect()} == {"bad", "unsafe"}


def zipped(members, encrypted=False):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as box:
        for name, data in members.items():
            box.writestr(name, data)
    raw = bytearray(out.getvalue())
    if encrypted:  # the flag bit alone, in the local and the central header
        raw[6] |= 1
        raw[raw.index(b"PK\x01\x02") + 8] |= 1
    return raw


def tarred(members, mode="w:gz"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as box:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            box.addfile(info, io.BytesIO(data))
    return bytearray(out.getvalue())


def test_archives_of_all_kinds(frame):
    members = {"a.txt": b"alpha", "dir/b.bin": b"\x00\x01"}
    files = [("z", zipped(members)), ("nested", zipped({"../up.txt": b"x"})), ("locked", zipped(members, True)), ("junk", bytearray(b"junk"))]
    files += [(m, tarred(members, m)) for m in ("w", "w:gz", "w:bz2", "w:xz")] + [("cut", tarred(members)[:40])]
    got = archives.archive_members(frame(files, "path string, content binary")).collect()
    for path in ("z", "w", "w:gz", "w:bz2", "w:xz"):
        assert {r.member: bytes(r.content) for r in got if r.path == path} == members
    assert [r.member for r in got if r.path == "nested"] == ["../up.txt"]
    errors = {r.path: r.error for r in got if r.error}
    assert set(errors) == {"locked", "junk", "cut"} and "password" in errors["locked"]
    listing = {r.path: r.files_extracted for r in archives.archive_listing(archives.archive_members(frame(files, "path string, content binary"))).collect()}
    assert listing["z"] == 2 and listing["junk"] == 0
    only = archives.archive_members(frame(files[:1], "path string, content binary"), r"\.txt$").collect()
    assert [r.member for r in only] == ["a.txt"]


def test_hot_bundles_are_spread_and_nothing_is_lost(frame):
    rows = [("hot", f"m{i}", 100, bytearray(b"x" * 100)) for i in range(200)] + [("cold", "m", 5, bytearray(b"y" * 5))]
    packed = archives.spread_bundles(frame(rows, "bundle string, member string, size bigint, content binary"), "bundle", "member", 2_000, "size")
    sizes = {(r.bundle, r.bundle_part): r.s for r in packed.groupBy("bundle", "bundle_part").agg(F.sum("size").alias("s")).collect()}
    assert len([k for k in sizes if k[0] == "hot"]) > 10 and max(sizes.values()) < 2_500 and sizes[("cold", 0)] == 5
    zips = archives.zip_bundles(packed, "bundle", "member", "content")
    back = archives.archive_members(zips.select(F.concat_ws("/", "bundle", "bundle_part").alias("path"), "content"))
    assert sorted(r.member for r in back.filter("path like 'hot%'").collect()) == sorted(f"m{i}" for i in range(200))


def test_word_without_styles_and_with_blank_paragraphs(frame):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda text, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'
    xml = f"<w:document {w}><w:body>{p('T', 'Heading2')}{p('i', 'ListNumber')}<w:p/>{p('x')}</w:body></w:document>"
    files = frame([("a", zipped({"word/document.xml": xml})), ("bad", bytearray(b"no"))], "path string, content binary")
    got = office.docx_blocks(files).orderBy("block_idx").collect()
    assert [(r.kind, r.level, r.text) for r in got] == [("heading", 2, "T"), ("number", 0, "i"), ("paragraph", 0, ""), ("paragraph", 0, "x")]
    assert [r.path for r in office.unreadable(files).collect()] == ["bad"]


def test_workbook_without_shared_strings(frame):
    parts = {
        "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="x"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="x" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row r="2"><c r="AA2" t="b"><v>1</v></c><c r="ZZ2"><v>1.50</v></c></row></sheetData></worksheet>',
    }
    files = frame([("a", zipped(parts))], "path string, content binary")
    assert sorted((r.row_idx, r.col_idx, r.text) for r in office.xlsx_cells(files).collect()) == [(1, 26, "True"), (1, 701, "1.50")]
    assert office.xlsx_cells(files, "other").count() == 0


def test_ocr_outputs(frame):
    rows = [("i", 1, [[0.0, 0.0], [10.0, 1.0]], "a<", 0.123456), ("i", 2, [[1.0, 1.0]], " ", 0.5), ("i", 3, [[1.0, 1.0]], "b", 1.0)]
    src = frame(rows, "doc_id string, block_idx int, bbox array<array<double>>, text string, confidence double")
    get = lambda fmt: ocr.assemble_ocr(src, fmt, ["doc_id"]).first()
    assert get("text").text == "a<\n \nb" and get("text").text_blocks == 3
    assert get("html").text == "<p>a&lt;</p>\n<p> </p>\n<p>b</p>" and get("markdown").text == "a<\n\nb"
    assert json.loads(get("json").text)[0] == {"text": "a<", "confidence": 0.1235, "bbox": [[0.0, 0.0], [10.0, 1.0]]}


def test_reports(frame):
    rows = frame([("a", None, 10), ("b", "broke", 0), ("c", None, 5)], "path string, error string, size int")
    report = reports.report_rows(rows, "op", "path", F.col("error"), 2, F.col("size"))
    total = reports.conversion_totals(report).first()
    assert (total.files, total.succeeded, total.failed, total.rows, total.bytes) == (3, 2, 1, 4, 15)
    before, after = frame([("k", 1000), ("z", 0)], "k string, bytes int"), frame([("k", 333), ("z", 7)], "k string, bytes int")
    got = {r.k: r.size_reduction_percent for r in reports.size_reduction(before, after, ["k"]).collect()}
    assert got == {"k": 66.7, "z": 0.0}
    small, big = reports.route_by_size(rows, F.col("size"), 6)
    assert small.count() == 2 and big.count() == 1


def test_stream_twice_over_a_landing_folder(spark, tmp_path):
    landing, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    (tmp_path / "in").mkdir()
    convert = streaming.json_lines_converter("a int")

    def run():
        streaming.stream_convert(streaming.watch_text(spark, landing), convert, out, marks).awaitTermination()
        return sorted(r.a for r in spark.read.parquet(f"{out}/data").collect())

    (tmp_path / "in" / "1.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n{broken\n')
    assert run() == [1, 2]
    assert run() == [1, 2]
    (tmp_path / "in" / "2.jsonl").write_text('{"a": 3}\n')
    assert run() == [1, 2, 3]
    assert [r.value for r in spark.read.json(f"{out}/quarantine").collect()] == ["{broken"]
    report = spark.read.parquet(f"{out}/report").select("files", "failed").collect()
    assert sorted(map(tuple, report)) == [(1, 0), (3, 1)]


def test_stream_of_office_files_started_again(spark, tmp_path):
    from test_sources import workbook

    landing, out, marks = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/marks"
    landing.mkdir()
    workbook(landing / "a.xlsx", {"S": {"A1": "k", "B1": "v", "A2": "1", "B2": "old", "A3": "2", "B3": "two"}})
    (landing / "bad.xlsx").write_bytes(b"junk")
    run = lambda: streaming.stream_files(
        streaming.watch_binary(spark, str(landing), "*.xlsx", 1), streaming.workbook_converter(), out, marks).awaitTermination()
    run()
    first = spark.read.parquet(f"{out}/report").collect()
    assert sorted((r.path[-8:], r.rows, r.success, bool(r.error)) for r in first) == [("/bad.xlsx"[-8:], 0, False, True), ("n/a.xlsx", 2, True, False)]
    run()  # nothing new: nothing again
    assert spark.read.parquet(f"{out}/report").count() == 2
    workbook(landing / "b.xlsx", {"S": {"A1": "k", "C1": "v", "A2": "1", "C2": "new"}})
    run()
    rows = spark.read.parquet(f"{out}/data")
    assert rows.count() == 3 and spark.read.parquet(f"{out}/report").count() == 3
    # by key over all batches: a table of the records first, then the last write of each
    keyed = rows.select("batch", F.col("record")["k"].alias("k"), F.col("record")["v"].alias("v"))
    keyed.write.partitionBy("batch").parquet(f"{tmp_path}/keyed/data")
    latest = streaming.latest_records(spark, f"{tmp_path}/keyed", ["k"])
    assert sorted(map(tuple, latest.select("k", "v").collect())) == [("1", "new"), ("2", "two")]


def test_stream_of_csv_files(spark, tmp_path):
    landing, out, marks = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/marks"
    landing.mkdir()
    (landing / "a.csv").write_text('i,t\n1,"x\ny"\nno,z\n')
    rows = lambda: streaming.watch_csv(spark, str(landing), "i int, t string")
    streaming.stream_convert(rows(), streaming.as_they_are, out, marks).awaitTermination()
    (landing / "b.csv").write_text("i,t\n2,q\n")
    streaming.stream_convert(rows(), streaming.as_they_are, out, marks).awaitTermination()
    assert sorted((r.i, r.t) for r in spark.read.parquet(f"{out}/data").collect()) == [(1, "x\ny"), (2, "q")]
    assert [r.error for r in spark.read.json(f"{out}/quarantine").collect()] == ["not a row of the table"]


def test_ocr_markdown_title_comes_before_the_lowest_position(frame):
    rows = [(1, 3, " "), (1, 5, "a"), (1, 6, None), (1, 9, "b"), (2, 2, ""), (3, 1, "x")]
    got = ocr.ocr_document(frame(rows, "doc_id int, block_idx int, text string"), "markdown", ["doc_id"], F.lit("T")).collect()
    assert {r.doc_id: (r.text, r.text_blocks) for r in got} == {1: ("# T\n\n\na\n\nb", 4), 2: ("# T\n", 1), 3: ("# T\n\n\nx", 1)}
    parts = ocr.ocr_document(frame(rows, "doc_id int, block_idx int, text string"), "markdown", ["doc_id"], F.lit("T"), part_rows=4).filter("doc_id = 1")
    assert "\n\n".join(r.text for r in parts.orderBy("part_no").collect()) == "# T\n\n\na\n\nb"


@pytest.mark.parametrize("limit", [1, 7, 8, 9, 100])
def test_bundles_stay_below_the_bound(frame, limit):
    """Members of equal and of odd sizes, in bundles below, at and above the bound; a null bundle is one too."""
    rows = [("a", f"m{i}", 1) for i in range(8)] + [("b", f"m{i}", (i * 7) % 11) for i in range(40)] + [(None, "n", 4), (None, "n", 4), ("c", "big", 1_000), ("d", "x", None)]
    packed = archives.spread_bundles(frame(rows, "bundle string, member string, size bigint"), "bundle", "member", limit, "size").collect()
    assert sorted((r.bundle or "", r.member, r["size"] or 0) for r in packed) == sorted((b or "", m, s or 0) for b, m, s in rows)
    parts = {}
    for r in packed:
        parts.setdefault((r.bundle, r.bundle_part), []).append(r["size"] or 0)
    assert all(sum(sizes) <= limit or sum(s > 0 for s in sizes) == 1 for sizes in parts.values())
    assert len([k for k in parts if k[0] == "a"]) == {1: 8, 7: 3, 8: 2, 9: 2, 100: 1}[limit]


@pytest.mark.parametrize("limit", [1, 39, 40, 41])
def test_documents_hold_at_most_their_keys(frame, limit):
    rows = [("f", f"s{i % 4}", f"k{i}", "v") for i in range(40)] + [(None, "s", "k", "v")]
    docs = config.nest_keys(frame(rows, "path string, section string, key string, value string"), ["path"], limit).collect()
    of = {p: sorted(d.keys for d in docs if d.path == p) for p in ("f", None)}
    assert max(of["f"]) <= limit and sum(of["f"]) == 40 and len(of["f"]) == -(-40 // limit) and of[None] == [1]
