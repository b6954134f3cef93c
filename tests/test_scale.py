"""Plans and batches that once grew with the input."""

import io
import json
import zipfile

import yaml

from reamwork.operators import config, ordered
from reamwork.plans import registry
from reamwork.sources import archives, configs, splits, tabular


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_totals_of_small_groups_are_not_sent_through_the_driver(spark, frame, tmp_path):
    frame([(f"f{i}", "A=1\nB=2\n") for i in range(20)], "path string, value string").write.parquet(f"{tmp_path}/files")
    rows = configs.read_env(spark.read.parquet(f"{tmp_path}/files"), ["path"])
    placed = ordered.amount_before(rows, ["path"], ["key"], ordered.F.lit(1).cast("bigint"), "piled")
    assert "Broadcast" not in plan_of(placed)
    assert sorted((r.path, r.piled) for r in placed.collect()) == sorted((f"f{i}", n) for i in range(20) for n in (0, 1))


XML = [
    '<data><rec id="007"><name> a </name><v>1</v><v>02</v><e/><b cur="x">5</b><m>t1<i>k</i>t2</m><q>s</q></rec><rec><q><z>1</z></q><w a="1">p</w><w>q</w></rec></data>',
    '<data><rec id="8"><name>b</name><v>x</v></rec>plain<rec>only text</rec></data>',
    '<data><rec id="9"><name>b</name><v>x</rec></data>',
    '<data><rec><b>6</b><d>2024-01-01</d><n>true</n></rec></data>',
]


def test_columns_of_xml_files_are_found_in_one_file_a_shape(spark, tmp_path, monkeypatch):
    for i in range(30):
        (tmp_path / f"f {i}.xml").write_text(f"<data><rec id='{i}'><name>{'n' if i % 2 else i}</name></rec></data>")
    for i, text in enumerate(XML):
        (tmp_path / f"odd+{i}.xml").write_text(text)
    files = [str(f) for f in tmp_path.iterdir()]
    reader = spark.read.format("xml").options(rowTag="rec", attributePrefix="@", valueTag="_text", inferSchema=False, ignoreNamespace=True)
    assert len(tabular._shape_files(reader, tabular._as_patterns(files))) <= 1 + len(XML)
    monkeypatch.setattr(tabular, "SHAPED_FILES", 1_000)
    whole = tabular.xml_corpus_records(spark, str(tmp_path)).rows
    monkeypatch.setattr(tabular, "SHAPED_FILES", 0)
    shaped = tabular.xml_corpus_records(spark, str(tmp_path)).rows
    assert shaped.schema == whole.schema
    assert sorted(map(str, shaped.collect())) == sorted(map(str, whole.collect())) and shaped.count() > 30


def test_states_of_csv_splits_are_an_aggregate(spark, tmp_path):
    (tmp_path / "a b.csv").write_text('x,y\n1,"two\nlines"\n2,"a ""q"" b"\n')
    pieces = splits._pieces(spark, str(tmp_path), "\n", splits._number_of(splits.F.col("value"), '"') % 2, splits.F.lit(0), splits.F.lit(0))
    assert "InArrow" not in plan_of(splits.split_states(pieces, False))
    found = splits.csv_records(spark, str(tmp_path))
    assert [(r.file.endswith("/a b.csv"), r["first"], r.text) for r in found.collect()] == [
        (True, True, "x,y"), (True, False, '1,"two\nlines"'), (True, False, '2,"a ""q"" b"')]


def test_archives_are_not_taken_as_pandas_objects(frame):
    def packed(text):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as box:
            box.writestr("a.xml", text)
        return out.getvalue()

    rows = [(f"f{i}", bytearray(packed(f"<a>{i}</a>"))) for i in range(2_500)] + [("bad", bytearray(b"x")), ("none", None)]
    texts = archives.archive_texts(frame(rows, "path string, content binary"), r"\.xml$", main=r"\.xml$", checked="xml").cache()
    assert "MapInArrow" in plan_of(texts) and "MapInPandas" not in plan_of(texts)
    got = {r.path: (r.parts, r.error) for r in texts.collect()}
    assert len(got) == 2_502 and all(got[f"f{i}"] == ({"a.xml": f"<a>{i}</a>"}, None) for i in range(2_500))
    assert got["bad"][0] is None and got["bad"][1] and got["none"][0] is None and got["none"][1]


def test_yaml_of_words_is_written_without_the_library(monkeypatch):
    words = ["a", "yes", "No", "null", "1", "007", "08", "1.5", "1e5", "1_000", "2024", "_", "on", "inf", "1.2.3", "0x1F", "é", "a b", "one\ntwo", "", "~", "x" * 130]
    dumper = getattr(yaml, "CSafeDumper", yaml.SafeDumper)
    for key in words:
        for value in words:
            doc = {"s": {key: value, "z": value}, key: value}
            assert config._render(json.dumps(doc), "yaml") == (yaml.dump(doc, Dumper=dumper, allow_unicode=True, default_flow_style=False), None)
    monkeypatch.setattr(config, "_yaml_dump", None)
    assert config._render('{"s": {"b": "007", "a": "x.y"}}', "yaml") == ("s:\n  a: x.y\n  b: '007'\n", None)


def test_a_small_file_of_many_rows_is_dealt_to_many_tasks(spark):
    assert registry.several(spark.range(1_000).coalesce(1), 50).rdd.getNumPartitions() == 20
    assert sorted(r.id for r in registry.several(spark.range(1_000).coalesce(1), 50).collect()) == list(range(1_000))
