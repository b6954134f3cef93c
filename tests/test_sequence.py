import random

import pytest
from pyspark.sql import functions as F

from reamwork.operators import ordered, sequence, tables

PAGES = "doc_id int, page_no int, text string"


@pytest.fixture
def pages(frame):
    rows = [(d, p, f"d{d}p{p}") for d, n in ((1, 1), (2, 3), (3, 7)) for p in range(1, n + 1)]
    return frame(rows, PAGES)


def random_rows(seed, docs=6, longest=60):
    rnd = random.Random(seed)
    out = []
    for d in range(docs):
        places = sorted(rnd.sample(range(500), rnd.randint(1, longest)))
        out += [(d, p, rnd.choice([None, None, rnd.randint(1, 9)])) for p in places]
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("chunk", [1, 7, 50, 1000])
@pytest.mark.parametrize("inclusive", [True, False])
def test_carry_last_against_brute_force(frame, chunk, inclusive):
    rows = random_rows(chunk)
    got = ordered.carry_last(frame(rows, "k int, pos int, v int"), ["k"], "pos", "v", "out", inclusive, chunk).collect()
    assert len(got) == len(rows)
    for r in got:
        before = [(p, v) for k, p, v in rows if k == r.k and v is not None and (p < r.pos or inclusive and p == r.pos)]
        assert r.out == (max(before)[1] if before else None)


@pytest.mark.parametrize("chunk", [1, 7, 50, 1000])
def test_running_total_and_dense_positions(frame, chunk):
    rows = random_rows(chunk + 1)
    src = frame(rows, "k int, pos int, v int")
    total = ordered.running_total(src, ["k"], "pos", "v", "out", chunk).collect()
    dense = ordered.dense_positions(src, ["k"], "pos", "n", 1, chunk).collect()
    for r in total:
        assert r.out == sum(v or 0 for k, p, v in rows if k == r.k and p < r.pos)
    for r in dense:
        assert r.n == 1 + sum(1 for k, p, _ in rows if k == r.k and p < r.pos)


def test_last_write_wins(frame):
    rows = [("f", "a", "1", 0), ("f", "b", "2", 1), ("f", "a", None, 2), ("g", "a", "4", 0)]
    got = ordered.last_write_wins(frame(rows, "path string, key string, value string, at int"), ["path", "key"], "at").collect()
    assert sorted((r.path, r.key, r.value or "") for r in got) == [("f", "a", ""), ("f", "b", "2"), ("g", "a", "4")]


def test_glue_parts_are_the_whole(frame):
    rows = [(1, i, f"t{i}") for i in range(1, 24)]
    src = frame(rows, "k int, pos int, t string")
    for size in (1, 5, 23, 100):
        parts = ordered.glue_parts(src, ["k"], "pos", "t", " 'q'\\\n", part_rows=size).orderBy("part_no").collect()
        assert len(parts) == -(-23 // size)
        assert " 'q'\\\n".join(p.text for p in parts) == " 'q'\\\n".join(t for *_, t in rows)


def test_select_pages(pages):
    assert sequence.select_pages(pages, [1, 9]).count() == 3
    assert sequence.select_pages(pages, None).count() == sequence.select_pages(pages, []).count() == 11


def test_split_by_ranges_clamps(pages):
    done = sequence.split_pages(pages, ["1-2", "5-9", "0"])
    got = {(r.doc_id, r.part_idx, r.part_name): [] for r in done.rows.collect()}
    for r in done.rows.collect():
        got[(r.doc_id, r.part_idx, r.part_name)].append(r.page_no)
    got = {k: sorted(v) for k, v in got.items()}
    assert got == {
        (1, 1, "1_p1-1"): [1], (1, 2, "1_p1-1"): [1], (1, 3, "1_p1-1"): [1],
        (2, 1, "2_p1-2"): [1, 2], (2, 2, "2_p3-3"): [3], (2, 3, "2_p1-1"): [1],
        (3, 1, "3_p1-2"): [1, 2], (3, 2, "3_p5-7"): [5, 6, 7], (3, 3, "3_p1-1"): [1]}
    with pytest.raises(ValueError):
        sequence.split_pages(pages, ["a-b"])


def test_split_halves_then_merge_is_the_input(pages):
    done = sequence.split_pages(pages)
    assert [(r.doc_id, bool(r.error)) for r in done.errors.collect()] == [(1, True)]
    halves = done.rows.select(
        F.col("part_name").alias("half"), "doc_id", "page_no", "text", "part_idx")
    first = halves.groupBy("half").agg(F.min("page_no").alias("lo"))
    renumbered = halves.join(first, "half").select(
        F.col("half").alias("doc"), (F.col("page_no") - F.col("lo") + 1).alias("page"), "text", "doc_id", "page_no", "part_idx")
    order = renumbered.select(F.col("doc_id").alias("merge"), F.col("part_idx").alias("position"), "doc").distinct()
    merged = sequence.merge_sequences(
        renumbered.select("doc", "page", "text", "page_no"), order, ["merge"], doc="doc", page="page")
    assert merged.rows.filter("merged_page_no <> page_no").count() == 0 and merged.rows.count() == 10


def test_merge_needs_two_inputs_and_takes_repeats(frame, pages):
    order = frame([("one", 1, 2), ("two", 1, 3), ("two", 2, 2), ("two", 3, 3)], "m string, position int, doc_id int")
    done = sequence.merge_sequences(pages, order, ["m"], chunk_rows=2)
    assert [(r.m, r.error) for r in done.errors.collect()] == [("one", "Provide at least two inputs.")]
    got = [r.text for r in done.rows.orderBy("merged_page_no").collect()]
    assert got == [f"d3p{i}" for i in range(1, 8)] + [f"d2p{i}" for i in range(1, 4)] + [f"d3p{i}" for i in range(1, 8)]
    assert [r.merged_page_no for r in done.rows.orderBy("merged_page_no").collect()] == list(range(1, 18))


def test_organize_repeats_omits_and_fails_whole_documents(frame, pages):
    done = sequence.organize(pages, [3, 1, 1])
    assert [(r.out_page_no, r.text) for r in done.rows.filter("doc_id = 2").orderBy("out_page_no").collect()] == [
        (1, "d2p3"), (2, "d2p1"), (3, "d2p1")]
    assert [(r.doc_id, r.error) for r in done.errors.collect()] == [(1, "Page numbers out of range (document has 1 pages): [3]")]
    assert done.rows.filter("doc_id = 1").count() == 0
    same = sequence.organize(pages.filter("doc_id = 3"), list(range(1, 8)))
    assert same.rows.filter("out_page_no <> page_no").count() == 0 and same.rows.count() == 7
    table = frame([(2, 1, 2), (2, 2, 9), (2, 3, 0), (3, 1, 7)], "doc_id int, out_page_no int, page_no int")
    by_table = sequence.organize(pages, table)
    assert [r.text for r in by_table.rows.collect()] == ["d3p7"]
    assert sorted(r.error[-3:] for r in by_table.errors.collect()) == ["[0]", "[9]"]


def test_number_pages_positions(frame):
    src = frame([(1, 1, 600.0, 800.0), (1, 4, 600.0, 800.0)], "doc_id int, page_no int, width_pt double, height_pt double")
    got = sequence.number_pages(src, start=9, gaps=True).orderBy("page_no").collect()
    assert [(r.number, r.y) for r in got] == [(9, 780.0), (10, 780.0)]
    assert [r.x for r in got] == [600 / 2 - 1 * 11 * 0.3, 600 / 2 - 2 * 11 * 0.3]
    left = sequence.number_pages(src, position="top-left").first()
    assert (left.x, left.y) == (20.0, 31.0)


def test_suppress_table_text(frame):
    lines = frame([(1, 1, " cell ", 1), (1, 1, "keep", 2), (1, 2, "cell", 3)], "doc_id int, page_no int, line string, n int")
    cells = frame([(1, 1, "cell"), (1, 1, None), (1, 1, "")], "doc_id int, page_no int, text string")
    assert sorted(r.n for r in sequence.suppress_table_text(lines, cells).collect()) == [2, 3]


@pytest.mark.parametrize("part_rows", [2, 1000])
def test_render_slides(frame, part_rows):
    rows = [("d", 1, 1, " a<b "), ("d", 1, 2, ""), ("d", 1, 3, "c"), ("d", 2, 1, None), ("d", 3, 1, "z")]
    src = frame(rows, "doc_id string, slide_no int, para_idx int, text string")
    joined = lambda fmt: "\n".join(
        r.text for r in sequence.render_slides(src, fmt, part_rows=part_rows).orderBy("part_no").collect())
    assert joined("txt") == "--- Slide 1 ---\na<b\nc\n--- Slide 2 ---\n--- Slide 3 ---\nz"
    assert joined("html") == (
        '<section id="slide-1"><h2>Slide 1</h2>\n<p>a&lt;b</p>\n<p>c</p>\n</section>\n<section id="slide-2"><h2>Slide 2</h2>\n</section>\n'
        '<section id="slide-3"><h2>Slide 3</h2>\n<p>z</p>\n</section>')


@pytest.mark.parametrize("keys", [["k"], []])
def test_state_over_many_groups_of_chunks(frame, monkeypatch, keys):
    """Chunks of three positions in groups of two chunks: the tree of groups has several levels."""
    monkeypatch.setattr(ordered, "GROUP_CHUNKS", 2)
    dice = random.Random(6)
    rows = [(k, pos, dice.choice([None, 1, 5])) for k in ((1, 2, 3) if keys else (1,)) for pos in dice.sample(range(300), 120 if k < 3 else 2)]
    src = frame(rows, "k int, pos int, v int")
    total = {(r.k, r.pos): r.t for r in ordered.running_total(src, keys, "pos", "v", "t", 3).collect()}
    last = {(r.k, r.pos): r.l for r in ordered.carry_last(src, keys, "pos", "v", "l", False, 3).collect()}
    for k, pos, _ in rows:
        before = sorted((p, v) for j, p, v in rows if j == k and p < pos and v is not None)
        assert total[k, pos] == sum(v for _, v in before) and last[k, pos] == (before[-1][1] if before else None)


@pytest.mark.parametrize("chunk, group", [(3, 2), (1000, 4096)])
def test_nested_positions(frame, monkeypatch, chunk, group):
    monkeypatch.setattr(ordered, "GROUP_CHUNKS", group)
    dice = random.Random(7)
    rows = sorted({(d, dice.randrange(1, 40), dice.randrange(1, 30)) for d in (1, 2) for _ in range(200)})
    got = ordered.nested_positions(frame(rows, "d int, s int, p int"), ["d"], "s", "p", "n", 1, chunk).collect()
    for d in (1, 2):
        assert [(r.s, r.p) for r in sorted((r for r in got if r.d == d), key=lambda r: r.n)] == [(s, p) for e, s, p in rows if e == d]
        assert sorted(r.n for r in got if r.d == d) == list(range(1, sum(e == d for e, _, _ in rows) + 1))


def test_list_runs_over_many_chunks(frame, monkeypatch):
    monkeypatch.setattr(ordered, "GROUP_CHUNKS", 2)
    dice = random.Random(9)
    lines = [(d, n, dice.choice(["- a", "# h", "text", "", "- b", "## i"])) for d in range(4) for n in range(1, 60)]
    src = frame(lines, "d int, line_no int, line string")
    key = lambda r: (r.d, r.line_no, r.kind, r.opens, r.closes, r.closes_after)
    whole = sorted(map(key, ordered.list_runs(src, ["d"]).collect()))
    assert sorted(map(key, ordered.list_runs(src, ["d"], chunk_rows=4).collect())) == whole
    assert {r[1] for r in whole if r[5]} <= {59}


def test_no_step_sees_all_rows_in_one_partition(frame):
    """Sequences without keys, slides and pages as Markdown: no exchange into a single partition."""
    pages = frame([(d, p, "A\ntext") for d in range(3) for p in range(1, 4)], "doc_id int, page_no int, text string")
    order = pages.select("doc_id").distinct().selectExpr("doc_id AS position", "doc_id")
    cells = frame([(1, 1, 0, 0, 0, "A")], "doc_id int, page_no int, table_idx int, row_idx int, col_idx int, text string")
    paragraphs = pages.selectExpr("doc_id", "page_no AS slide_no", "1 AS para_idx", "text")
    for df in (sequence.merge_sequences(pages, order, []).rows, sequence.render_slides(paragraphs, "html"), tables.pages_to_markdown(pages, cells)):
        assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()
