import json
import random

import pytest
from pyspark.sql import functions as F

from reamwork.functions import markup
from reamwork.operators import grids, tables


def test_xml_to_json_merges_and_keeps_strings(frame):
    docs = ['<r xmlns="u" k="2"><a>007</a><a> 8 </a><b q="1">t</b><c/><k>child</k></r>', "<r/>", "<r>text</r>", "<open"]
    got = frame([(d,) for d in docs], "x string").select(markup.xml_to_json(F.col("x")).alias("j")).select("j.*").collect()
    assert json.loads(got[0].json) == {"r": {"k": "child", "a": ["007", "8"], "b": {"q": "1", "_text": "t"}, "c": {}}}
    assert json.loads(got[1].json) == {"r": {}} and json.loads(got[2].json) == {"r": "text"}
    assert got[3].json is None and got[3].error


def test_typed_xml_to_json_in_the_jvm(frame):
    docs = frame([('<r k="2"><a>007</a><a>8</a></r>',)], "x string")
    got = docs.select(markup.typed_xml_to_json(F.col("x"), "k string, a array<string>")).first()[0]
    assert json.loads(got) == {"r": {"k": "2", "a": ["007", "8"]}}


def test_json_to_xml_rules(frame):
    docs = ['{"a": [1, null], "b": {"c": true}}', '{"only": {"x": "<&>"}}', "[1, 2]", "{", '{"a b": 1, "c": 2}']
    got = frame([(d,) for d in docs], "j string").select(markup.json_to_xml(F.col("j")).alias("x")).select("x.*").collect()
    body = [r.xml.split("\n", 1)[1] if r.xml else None for r in got]
    assert body[0] == "<root><a><item>1</item><item>None</item></a><b><c>True</c></b></root>"
    assert body[1] == "<only><x>&lt;&amp;&gt;</x></only>"
    assert body[2] == "<root><item>1</item><item>2</item></root>"
    assert body[3] is None and got[3].error
    assert body[4] is None and "a b" in got[4].error


def test_typed_record_to_xml(frame):
    rows = frame([((1, ["a", None], {"k": 2.5}, None),)], "r struct<id int, tags array<string>, m map<string, double>, none string>")
    got = rows.select(markup.record_to_xml(F.col("r"), rows.schema["r"].dataType)).first()[0]
    assert got.endswith("<root><id>1</id><tags><item>a</item><item>None</item></tags><m><k>2.5</k></m><none>None</none></root>")


PAGE = "<p>x</p><table><tr><th>a</th><th>b</th></tr><tr><td>1</td></tr></table><TABLE><tr><td>&lt;z&gt;</td></tr></TABLE><!-- <table><tr><td>no</td></tr></table> -->"


def test_cells_of_ragged_tables(frame):
    pages = frame([(1, PAGE), (2, "<p>none</p>")], "page_id int, html string")
    got = tables.html_table_cells(pages, ["page_id"]).collect()
    assert sorted((r.table_idx, r.row_idx, r.col_idx, r.text, r.is_header) for r in got) == [
        (0, 0, 0, "a", True), (0, 0, 1, "b", True), (0, 1, 0, "1", False), (1, 0, 0, "<z>", False)]
    assert {r.tables_found for r in got} == {2}


def cells_of(frame, html):
    got = tables.html_table_cells(frame([(1, html)], "page_id int, html string"), ["page_id"]).collect()
    return sorted((r.table_idx, r.row_idx, r.col_idx, r.text) for r in got)


@pytest.mark.parametrize("html, want", [
    ("<table><tr><td>New<br>York</td><td>New <b>York</b></td><td> a \n\n b&nbsp;&nbsp;c</td></tr></table>",
     [(0, 0, 0, "New York"), (0, 0, 1, "New York"), (0, 0, 2, "a b c")]),
    ("<table><tr><td rowspan=2>A</td><td>B</td></tr><tr><td>C</td></tr></table>",
     [(0, 0, 0, "A"), (0, 0, 1, "B"), (0, 1, 0, "A"), (0, 1, 1, "C")]),
    ("<table><tr><td>a</td><td rowspan='2' colspan=\"2\">b</td><td>c</td></tr><tr><td>d<td>e</tr></table>",
     [(0, 0, 0, "a"), (0, 0, 1, "b"), (0, 0, 2, "b"), (0, 0, 3, "c"), (0, 1, 0, "d"), (0, 1, 1, "b"), (0, 1, 2, "b"), (0, 1, 3, "e")]),
    ("<table><tr><td>x</td><td rowspan=3>y</td></tr></table>", [(0, 0, 0, "x"), (0, 0, 1, "y"), (0, 1, 1, "y"), (0, 2, 1, "y")]),
    ("<table><tr><td>o<table><tr><td>i<table><tr><td>d</td></tr></table></td></tr></table>after</td></tr><tr><td>p</td></tr></table><table><tr><td>q",
     [(0, 0, 0, "oidafter"), (0, 1, 0, "p"), (1, 0, 0, "id"), (2, 0, 0, "d"), (3, 0, 0, "q")]),
    ("</table><table><tr><td rowspan=0 colspan=0>z</td></tr></table></table><p>", [(0, 0, 0, "z")]),
    ("<table><tr><td colspan=99999999999999999999>w</td></tr></table>", [(0, 0, i, "w") for i in range(1000)]),
    ("<table></table><tabled><tr><td>n</td></tr></tabled>", []), ("", []), (None, []),
])
def test_spans_and_nested_tables(frame, html, want):
    assert cells_of(frame, html) == want


def placed_by_hand(rows):
    """Cells (text, rows, columns) in the order of a browser's algorithm, on a set of taken places."""
    taken, r = {}, 0
    for r, row in enumerate(rows):
        at = 0
        for text, down, right in row:
            for _ in range(right):
                while (r, at) in taken:
                    at += 1
                for d in range(down):
                    taken[r + d, at] = text
                at += 1
    return taken


def test_spans_against_taken_places(frame):
    dice = random.Random(4)
    pages, want = [], {}
    for page in range(60):
        rows = [[(f"{page}.{r}.{c}", dice.choice([1, 1, 1, 2, 3]), dice.choice([1, 1, 2])) for c in range(dice.randrange(1, 5))]
                for r in range(dice.randrange(1, 6))]
        body = "".join("<tr>" + "".join(f"<td rowspan={d} colspan={w}>{t}</td>" for t, d, w in row) + "</tr>" for row in rows)
        pages.append((page, f"<table>{body}</table>"))
        want.update({(page, *place): text for place, text in placed_by_hand(rows).items()})
    got = tables.html_table_cells(frame(pages, "page_id int, html string"), ["page_id"]).collect()
    assert {(r.page_id, r.row_idx, r.col_idx): r.text for r in got} == want and len(got) == len(want)


def test_records_of_tables_with_their_own_headers(frame):
    html = ("<table><thead><tr><th>a</th><th></th><th>A</th></tr></thead><tr><th>1</th><td>2</td><td></td></tr></table>"
            "<table><tr><th>b</th></tr><tr><td>3</td><td>4</td></tr></table><table><tr><td>5</td></tr></table>")
    found = tables.html_table_grids(frame([(1, html)], "page_id int, html string"), ["page_id"])
    assert [r.labels for r in found.orderBy("table_idx").collect()] == [["a", "Unnamed: 1", "A.1"], ["b", "Unnamed: 1"], ["0"]]
    rows = grids.grid_records(found, ["page_id", "table_idx"], F.col("first_row"))
    assert sorted((r.table_idx, r.row_idx, dict(r.record)) for r in rows.collect()) == [
        (0, 1, {"a": "1", "Unnamed: 1": "2", "A.1": ""}), (1, 1, {"b": "3", "Unnamed: 1": "4"}), (2, 0, {"0": "5"})]
    names = grids.column_names(found, ["page_id", "table_idx"])
    assert names == ["a", "Unnamed: 1", "A.1", "b", "0"]
    assert sorted(map(tuple, grids.records_table(rows, names).collect()), key=repr) == [
        ("1", "2", "", None, None), (None, "4", None, "3", None), (None, None, None, None, "5")]


@pytest.mark.parametrize("texts, want", [
    (["a", "a", "a"], ["a", "a.1", "a.2"]), (["a", "", None, "A"], ["a", "Unnamed: 1", "Unnamed: 2", "A.1"]), ([], []),
    (["x", "Unnamed: 0", ""], ["x", "Unnamed: 0", "Unnamed: 2"]),
])
def test_labels_are_unique(frame, texts, want):
    row = frame([(texts,)], "t array<string>").select(grids.unique_labels(F.col("t")).alias("l")).first()
    assert row.l == want


def test_labels_that_meet_after_numbering(frame):
    got = frame([(["a", "a", "a.1", "a.1.1", "a"],)], "t array<string>").select(grids.unique_labels(F.col("t")).alias("l")).first().l
    assert len({x.lower() for x in got}) == 5 and got[:2] == ["a", "a.1"]


@pytest.mark.parametrize("index, rows, errors", [
    (0, 3, {2: "No tables found in the HTML file."}),
    (1, 1, {2: "No tables found in the HTML file."}),
    (2, 0, {1: "Only 2 table(s) found; table_index 2 is out of range.", 2: "No tables found in the HTML file."}),
])
def test_nth_table(frame, index, rows, errors):
    pages = frame([(1, PAGE), (2, "<p>none</p>")], "page_id int, html string")
    done = tables.nth_table(pages, ["page_id"], index)
    assert done.rows.count() == rows
    assert {r.page_id: r.error for r in done.errors.collect()} == errors


def test_markdown_table_in_parts(frame):
    rows = [(1, i, None if i == 2 else i * 1.5, i % 2 == 0) for i in range(1, 6)]
    src = frame(rows, "g int, pos int, x double, ok boolean")
    whole = tables.to_markdown_table(src, ["g"], "pos", ["x", "ok"]).first().markdown
    assert whole.split("\n")[:4] == ["| x | ok |", "| --- | --- |", "| 1.5 | False |", "| nan | True |"]
    parts = tables.to_markdown_table(src, ["g"], "pos", ["x", "ok"], part_rows=2).orderBy("part_no").collect()
    assert len(parts) == 3 and "\n".join(p.markdown for p in parts) == whole
