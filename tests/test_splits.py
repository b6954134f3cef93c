"""Big single files read by many tasks, against the standard library on the whole file."""

import csv
import io
import json
import random

import duckdb
import pytest

from reamwork.sources import splits, tabular


@pytest.fixture(params=["64", "997", "100000"])
def split_bytes(spark, request):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield int(request.param)
    for k, v in before.items():
        spark.conf.set(k, v)


def csv_rows(n, seed):
    dice = random.Random(seed)
    words = ["a", 'say "hi"', "two\nlines", "", "x,y", "\n\n", "é" * 30, '"', "long " * 40, "\n\"\n", " pad "]
    return [[str(i), *(dice.choice(words) + dice.choice(["", str(i)]) for _ in range(2))] for i in range(n)]


def csv_text(rows, end="\n", quoting=csv.QUOTE_MINIMAL):
    out = io.StringIO()
    csv.writer(out, lineterminator=end, quoting=quoting).writerows([["id", "p", "q \"r\""], *rows])
    return out.getvalue()


@pytest.mark.parametrize("broadcast_bytes", [splits.BROADCAST_BYTES, 0])
def test_csv_with_line_breaks_in_quotes(spark, tmp_path, split_bytes, broadcast_bytes, monkeypatch):
    monkeypatch.setattr(splits.records, "__defaults__", (broadcast_bytes,))
    one, two = csv_rows(120, 1), csv_rows(40, 2)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(csv_text(one), newline="")
    (tmp_path / "in" / "b c.csv").write_text(csv_text(two, "\r\n", csv.QUOTE_ALL).rstrip("\r\n"), newline="")
    got = tabular.read_csv(spark, str(tmp_path / "in"), schema="id string, p string, `q \"r\"` string")
    want = [tuple(v if v not in tabular.NA_TOKENS else None for v in r) for r in one + two]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    if split_bytes < 1000:
        pieces = spark.read.text(str(tmp_path / "in"))
        assert pieces.rdd.getNumPartitions() > 5


def test_csv_equals_duckdb(spark, tmp_path, split_bytes):
    (tmp_path / "a.csv").write_text(csv_text(csv_rows(200, 3)), newline="")
    want = duckdb.sql(f"SELECT id, length(p), length(\"q \"\"r\"\"\") FROM read_csv('{tmp_path}/a.csv', header=true, all_varchar=true, quote='\"', escape='\"', nullstr='')").fetchall()
    got = tabular.read_csv(spark, str(tmp_path / "a.csv"))
    assert [f.dataType.simpleString() for f in got.schema][0] == "bigint"
    rows = got.selectExpr("cast(id as string)", "length(p)", "length(`q \"r\"`)").collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))


def test_csv_files_must_have_one_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("i,j\n1,2\n")
    (tmp_path / "b.csv").write_text("i,k\n3,4\n")
    with pytest.raises(Exception, match="different headers"):
        tabular.read_csv(spark, str(tmp_path), schema="i int, j int").collect()


def json_value(dice, depth):
    kind = dice.randrange(7 if depth < 3 else 4)
    if kind == 0:
        return dice.choice([None, True, False, 0, -1.5, 12345678])
    if kind < 4:
        return dice.choice(["", "a", 'q"{', "}{][,", "\\", "\\\"}", "é\n", "x" * 70])
    if kind == 4:
        return [json_value(dice, depth + 1) for _ in range(dice.randrange(4))]
    return {dice.choice(["a", "b}", 'c"', "d"]): json_value(dice, depth + 1) for _ in range(dice.randrange(3))}


@pytest.mark.parametrize("broadcast_bytes", [splits.BROADCAST_BYTES, 0])
def test_json_arrays(spark, tmp_path, split_bytes, broadcast_bytes, monkeypatch):
    monkeypatch.setattr(splits.records, "__defaults__", (broadcast_bytes,))
    dice = random.Random(split_bytes)
    objects = [{"id": i, "v": json_value(dice, 0)} for i in range(60)]
    mixed = [json_value(dice, 0) for _ in range(40)]
    files = {
        "objects": json.dumps(objects), "spaced": json.dumps(objects[:9], indent=2, ensure_ascii=False) + "\n\n", "mixed": json.dumps(mixed),
        "one": json.dumps(objects[0]), "lines": "\n {\"a\": {\"b\": 1}}\n", "empty": "[]", "nested": "[[{\"a\":1}],[{\"b\":2}], 3 ]", "numbers": "[1, 2,3]", "scalar": "5",
        "cut": json.dumps(objects)[:-1], "cut_object": "[{\"a\": 1", "brace": "{\"a\": 1", "quote": "[\"a]", "blank": "  \n", "more": "[1]]",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.json").write_text(text)
    done = splits.json_elements(spark, str(tmp_path))
    got: dict = {}
    for r in done.rows.collect():
        got.setdefault(r.file.rsplit("/", 1)[1][:-5], []).append(json.loads(r.text))
    bad = {"cut", "cut_object", "brace", "quote", "blank", "more"}
    assert {r.file.rsplit("/", 1)[1][:-5] for r in done.errors.collect()} == bad
    key = lambda values: sorted(json.dumps(v, sort_keys=True) for v in values)
    for name in files.keys() - bad:
        want = json.loads(files[name])
        assert key(got.get(name, [])) == key(want if isinstance(want, list) else [want]), name


def test_json_docs_with_errors(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1, "y": "p\\nq"},\n {"x": 2.5}]')
    (tmp_path / "b.json").write_text('{"x": 3,\n "z": [1]}')
    (tmp_path / "c.json").write_text('[{"x": 4}, {"x": nope}]')
    (tmp_path / "d.json").write_text('[{"x": 5}')
    done = tabular.json_docs(spark, str(tmp_path))
    assert sorted((r.x, r.y, r.z) for r in done.rows.collect()) == [(1.0, "p\nq", None), (2.5, None, None), (3.0, None, [1]), (4.0, None, None)]
    assert sorted(r.file[-6:] for r in done.errors.collect()) == ["c.json", "d.json"]
    typed = tabular.json_docs(spark, str(tmp_path), "x double")
    assert sorted(r.x for r in typed.rows.collect()) == [1.0, 2.5, 3.0, 4.0] and typed.errors.count() == 2
