"""Inputs that once were lost or stopped a whole job."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from reamwork.operators import sequence
from reamwork.operators.config import nest_keys
from reamwork.operators.ocr import assemble_ocr
from reamwork.operators.tables import to_html_table, to_markdown_table
from reamwork.plans.convert import document_records
from reamwork.sources import office
from reamwork.sources.archives import write_packed
from reamwork.sources.sinks import export_tables


def test_last_of_repeated_keys_stands(frame):
    rows = frame([("f", "s", "k", "old", 1), ("f", "s", "k", "new", 2), ("f", "s", "j", "x", 3), ("f", "t", "k", None, 4)],
                 "path string, section string, key string, value string, line_no int")
    got = nest_keys(rows, ["path"], pos="line_no").collect()
    assert len(got) == 1 and got[0]["keys"] == 3
    assert json.loads(got[0]["json"])["s"] == {"j": "x", "k": "new"}


def test_keys_that_hold_type_names(frame):
    docs = frame([('[{"AVOID_TAX": 1, "VOID": null, "OBJECT": {"b": "x", "VOIDS": 2}}]', None)], "json string, error string")
    got = document_records(docs).first().asDict(recursive=True)
    assert (got["AVOID_TAX"], got["VOID"], got["OBJECT"]) == (1, None, {"b": "x", "VOIDS": 2})


def test_recognised_null_text_keeps_its_key(frame):
    blocks = frame([("d", 1, None, 0.5, [1.0])], "doc_id string, block_idx int, text string, confidence double, bbox array<double>")
    got = json.loads(assemble_ocr(blocks, "json", ["doc_id"]).first()["text"])
    assert got == [{"text": "", "confidence": 0.5, "bbox": [1.0]}]


def test_refusals(spark, tmp_path):
    one = spark.range(1).select(F.col("id").cast("string").alias("bundle"), F.lit(0).alias("bundle_part"))
    with pytest.raises(ValueError):
        write_packed(one, str(tmp_path / "x"), "bundle", "bz2")
    for name in ("..", "a/b", ""):
        with pytest.raises(ValueError):
            export_tables({name: one}, str(tmp_path / "y"))


def box(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), data)
    return out.getvalue()


def test_every_office_file_has_rows_or_an_error(frame):
    word = b"<document><body><p><r><t>hello</t></r></p></body></document>"
    files = frame([
        ("good", box(word__document_xml=word)), ("no zip", b"junk"), ("no main part", box(word__styles_xml=b"<styles/>")),
        ("broken", box(word__document_xml=b"<document><body><p>")), ("empty part", box(word__document_xml=b"")),
        ("not utf-8", box(word__document_xml=b"<?xml version='1.0' encoding='latin-1'?><document>\xe9</document>")),
        ("broken styles", box(word__document_xml=word, word__styles_xml=b"<styles>")), ("null", None),
    ], "path string, content binary")
    errors = {r["path"]: r["error"] for r in office.unreadable(files, "docx").collect()}
    assert set(errors) == {"no zip", "no main part", "broken", "empty part", "not utf-8", "broken styles", "null"} and all(errors.values())
    assert [tuple(r) for r in office.docx_render(files, "txt").collect()] == [("good", "hello")]
    assert [r["path"] for r in office.docx_blocks(files).collect()] == ["good"]
    for kind in ("xlsx", "pptx", "epub"):
        assert office.unreadable(files, kind).count() == files.count()


def test_tables_that_do_not_start_at_the_first_row(frame):
    rows = frame([("g", 2, "x"), ("g", 3, "y"), (None, 5, "z")], "grp string, pos int, name string")
    got = {r["grp"]: (r["markdown"], r["rows"]) for r in to_markdown_table(rows, ["grp"], "pos", ["name"]).collect()}
    assert got == {"g": ("| name |\n| --- |\n| x |\n| y |", 2), None: ("| name |\n| --- |\n| z |", 1)}
    parts = to_html_table(rows.filter("grp = 'g'"), ["grp"], "pos", ["name"], part_rows=2).orderBy("part_no").collect()
    whole = "\n".join(r["html"] for r in parts)
    assert whole.count("<thead>") == whole.count("</table>") == 1 and whole.startswith("<table") and whole.endswith("</table>")
    assert len(parts) == 2


def test_selected_pages_start_without_separator(frame):
    rows = [("a", 3, "x"), ("a", 4, "y"), ("b", 1, "p"), ("b", 2, None), ("c", 2, "q")]
    pages = frame(rows, "doc_id string, page_no int, text string")
    got = {r.doc_id: (r.text, r.char_count) for r in sequence.concat_pages(pages, "[{page}]").collect()}
    assert got == {"a": ("x[4]y", 2), "b": ("p[2]", 1), "c": ("q", 1)}
