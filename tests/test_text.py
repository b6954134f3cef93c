import html
import random
import re

import pytest
from pyspark.sql import functions as F

from reamwork.functions import binary, markup, names, text
from reamwork.operators import blocks, ordered

# The rules of the text form of Markdown, for the standard library's re.
RULES = [
    (r"^#{1,6}\s+", "", re.M), (r"\*\*\*(.*?)\*\*\*", r"\1", 0), (r"\*\*(.*?)\*\*", r"\1", 0), (r"\*(.*?)\*", r"\1", 0),
    (r"`(.*?)`", r"\1", 0), (r"^[-*+]\s+", "", re.M), (r"^\d+\.\s+", "", re.M), (r"\[([^\]]+)\]\([^\)]+\)", r"\1", 0),
    (r"!\[([^\]]*)\]\([^\)]+\)", r"\1", 0),
]


def one(frame, expr, values, schema="t string"):
    return [r[0] for r in frame([(v,) for v in values], schema).select(expr(F.col("t"))).collect()]


def test_markdown_to_text_rules_and_order(frame):
    samples = [
        "# A\n\n- x **b** ***c*** `d` [l](u) ![i](u)\n1. one\n+ p\r\n", "** a\n**", "# nbsp", "######## eight", "*a\nb*", "![](u)",
        "a # b", "12. x\n٣. y",
    ]
    want = []
    for s in samples:
        for pattern, to, flags in RULES:
            s = re.sub(pattern, to, s, flags=flags)
        want.append(s)
    assert one(frame, text.markdown_to_text, samples) == want
    assert one(frame, text.markdown_to_text, ["![alt](u)"]) == ["!alt"]


def test_html_unescape_is_the_standard_one(frame):
    rnd = random.Random(7)
    names_ = rnd.sample(sorted(html.entities.html5), 300)
    samples = [f"a &{n} b" for n in names_] + [f"&{n}x" for n in names_[:60]]
    samples += ["&#%d;" % n for n in [0, 1, 9, 11, 13, 65, 127, 128, 159, 0xD800, 0xFDD0, 0xFFFE, 0x1F600, 0x10FFFF, 0x110000]]
    samples += ["&#x%X;" % n for n in (0x80, 0x20AC, 0xDFFF)] + ["&", "&&amp;&", "&amp;lt;", "&#12345678901234;", "&#x;", "&bogus;", ""]
    assert one(frame, markup.html_unescape, samples) == [html.unescape(s) for s in samples]


def test_escape_round_trip(frame):
    samples = ["<a href=\"x\">'&amp;'</a>", "plain", ""]
    assert one(frame, text.html_escape, samples) == [html.escape(s) for s in samples]
    assert one(frame, lambda c: markup.html_unescape(text.html_escape(c)), samples) == samples


LINES = {"h": "## head", "b": "- item & <i>", "s": "* star", "t": "text", "x": "   ", "e": ""}


# Lines by their letters in LINES, and the expected page.
RENDERED = {
    "h": "<h2>head</h2>",
    "t": "<p>text</p>",
    "x": "",
    "b": "<ul>\n<li>item &amp; &lt;i&gt;</li>\n</ul>",
    "bs": "<ul>\n<li>item &amp; &lt;i&gt;</li>\n<li>star</li>\n</ul>",
    "sh": "<ul>\n<li>star</li>\n<h2>head</h2>\n</ul>",
    "shs": "<ul>\n<li>star</li>\n<h2>head</h2>\n<li>star</li>\n</ul>",
    "sht": "<ul>\n<li>star</li>\n<h2>head</h2>\n</ul>\n<p>text</p>",
    "st": "<ul>\n<li>star</li>\n</ul>\n<p>text</p>",
    "sxs": "<ul>\n<li>star</li>\n</ul>\n<ul>\n<li>star</li>\n</ul>",
    "ses": "<ul>\n<li>star</li>\n</ul>\n<ul>\n<li>star</li>\n</ul>",
    "txt": "<p>text</p>\n<p>text</p>",
    "hthb": "<h2>head</h2>\n<p>text</p>\n<h2>head</h2>\n<ul>\n<li>item &amp; &lt;i&gt;</li>\n</ul>",
    "tbes": "<p>text</p>\n<ul>\n<li>item &amp; &lt;i&gt;</li>\n</ul>\n<ul>\n<li>star</li>\n</ul>",
    "xxhe": "<h2>head</h2>",
}


def test_markdown_to_html_of_line_sequences(frame):
    samples = ["\n".join(LINES[k] for k in ks) for ks in RENDERED]
    assert one(frame, text.markdown_to_html, samples) == list(RENDERED.values())


@pytest.mark.parametrize("chunk", [1, 2, 3, 100])
def test_list_runs_over_chunk_borders(frame, chunk):
    rnd = random.Random(chunk)
    docs = {d: [LINES[rnd.choice("hbstxe")] for _ in range(rnd.randint(1, 12))] for d in range(40)}
    rows = [(d, i, line) for d, ls in docs.items() for i, line in enumerate(ls)]
    # The same lines as whole texts, rendered inside the row without chunks.
    whole = one(frame, text.markdown_to_html, ["\n".join(ls) for ls in docs.values()])
    got = ordered.list_runs(frame(rows, "doc_id int, line_no int, line string"), ["doc_id"], chunk_rows=chunk).collect()
    for d, ls in docs.items():
        mine = sorted((r for r in got if r.doc_id == d), key=lambda r: r.line_no)
        out = []
        for r in mine:
            out += ["</ul>"] if r.closes else []
            out += ["<ul>"] if r.opens else []
            out += {"B": [f"<li>{html.escape(r.line[2:])}</li>"], "T": [f"<p>{html.escape(r.line)}</p>"], "X": [],
                    "2": [f"<h2>{html.escape(r.line[3:])}</h2>"]}[r.kind]
            out += ["</ul>"] if r.closes_after else []
        assert "\n".join(out) == whole[d]


# A line and its runs: text, then B bold, I italic, C code.
RUNS = {
    "a": [("a", "")], "": [], "*": [], "**": [], "***": [], "`": [], "``": [], "`a`": [("a", "C")], "*a*": [("a", "I")],
    "**a**": [("a", "B")], "***a***": [("a", "BI")], "a*": [("a*", "")], "*a": [("*a", "")], "a**b**c": [("a", ""), ("b", "B"), ("c", "")],
    "x *y* `z`": [("x ", ""), ("y", "I"), (" ", ""), ("z", "C")], "`*a*`": [("*a*", "C")], "plain": [("plain", "")],
    "x" * 50_000 + "*y*": [("x" * 50_000, ""), ("y", "I")],
}


def test_inline_runs(frame):
    got = one(frame, text.inline_runs, list(RUNS))
    for line, have in zip(RUNS, got):
        assert [(r[0], "".join(k for k, on in zip("BIC", r[1:]) if on)) for r in have] == RUNS[line], line[:40]


def test_blocks_render_back(frame):
    md = "# T\n- a\n1. n\nplain **b** ***c*** *d*\n\n### s"
    rows = blocks.markdown_blocks(frame([(1, md)], "doc_id int, text string"), ["doc_id"])
    assert [(r.kind, r.level, r.text) for r in rows.orderBy("block_idx").collect()] == [
        ("heading", 1, "T"), ("bullet", 0, "a"), ("number", 0, "n"), ("paragraph", 0, "plain **b** ***c*** *d*"), ("heading", 3, "s")]
    back = blocks.render_blocks(rows, "md", ["doc_id"]).first().text
    assert back == "# T\n- a\n1. n\nplain **b** ***c*** *d*\n### s"
    page = blocks.render_blocks(rows, "html", ["doc_id"]).first().text
    assert "<p>plain <strong>b</strong> <strong><em>c</em></strong> <em>d</em></p>" in page
    parts = blocks.render_blocks(rows, "md", ["doc_id"], part_rows=2).orderBy("part_no").collect()
    assert len(parts) == 3 and "\n".join(p.text for p in parts) == back


def test_text_to_html_and_preview(frame):
    samples = ["a<b\n \t\nc\n", ""]
    want = ["\n".join(f"<p>{html.escape(x)}</p>" if x.strip() else "<br>" for x in s.split("\n")) for s in samples]
    assert one(frame, text.text_to_html, samples) == want
    assert one(frame, lambda c: text.preview(c, 3), ["abc", "abcd", ""]) == ["abc", "abc...", ""]


def test_headings_in_extracted_text(frame):
    samples = ["TOTAL 5", "123", "Total", "A" * 59, "A" * 60, "ÉTÉ"]
    want = [len(s) < 60 and s.isupper() for s in samples]
    assert one(frame, text.is_heading, samples) == want


def test_html_blocks_of_untidy_pages(frame):
    page = (
        "<head><title>no</title></head><body><script>var t='<p>no</p>';</script><h1>A &amp; B</h1><p>one <b>two</b> three<p>four<br>five"
        "<ul><li>x<li>y</ul><table><tr><td>c1</td><td>c2</td></tr></table></body><footer>no block</footer>"
    )
    got = blocks.html_blocks(frame([(1, page)], "page_id int, html string"), ["page_id"]).orderBy("block_idx").collect()
    assert [(r.kind, r.level, r.text) for r in got] == [
        ("heading", 1, "A & B"), ("paragraph", 0, "onetwothree"), ("paragraph", 0, "fourfive"), ("bullet", 0, "x"), ("bullet", 0, "y"),
        ("table", 0, "c1c2")]


def test_numbers_as_python_prints_them(frame):
    values = [0.0, 1.5, -2.25, 1e7, 123456789.25, 9.9e15, 0.001, 0.0001, 0.00012, 1e6]
    assert one(frame, text.number_text, values, "t double") == [repr(v) for v in values]


def test_names(frame):
    samples = ["/a/b.tar.gz", "/a.b/c", ".env", "x.YML", "/p/q.json"]
    assert one(frame, names.extension, samples) == [".gz", "", "", ".YML", ".json"]
    assert one(frame, names.stem, samples) == ["b.tar", "c", ".env", "x", "q"]
    assert one(frame, names.infer_format, samples) == [None, None, None, "yaml", "json"]
    assert one(frame, lambda c: names.derive_output_name(c, "_o", ".md"), samples)[:2] == ["/a/b.tar_o.md", "/a.b/c_o.md"]
    assert one(frame, names.media_type, ["a.md", "b"]) == ["text/markdown", "application/octet-stream"]


def test_base64_round_trip(frame):
    raw = bytes(range(256)) * 5
    rows = frame([(bytearray(raw),)], "t binary")
    got = rows.select(binary.from_base64(binary.data_uri(F.lit("x.gif"), F.col("t"))).alias("b"), binary.to_base64(F.col("t")).alias("s")).first()
    assert bytes(got.b) == raw and "\n" not in got.s and "\r" not in got.s
    assert one(frame, binary.from_base64, ["!!"]) == [None]
