"""The pipeline against its stages by brute force, on the smallest tables."""

import os

import pytest

import corpus_pipeline
from reamwork.llm import line_dedup
from reamwork.session import settle

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="tables are not here")
def test_stages(spark):
    import duckdb

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(settle(stage(spark, kept[-1], SF_DIR), name))
    assert all(d.columns == columns for d in kept[:-1])
    tables = [{r["doc_id"]: r.asDict() for r in d.collect()} for d in kept]
    assert all(set(b) <= set(a) for a, b in zip(tables, tables[1:]))
    con = duckdb.connect()
    con.register("kept", kept[1].select("doc_id", "text").toPandas())
    want = {r[0]: r[3] for r in con.execute(line_dedup.SQL.replace("{docs}", "kept")).fetchall()}
    assert {i: r["text"] for i, r in tables[2].items()} == want

    def words(t):
        return t.encode().lower().split()

    sets = {i: {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} for i, r in tables[2].items() if (w := words(r["text"] or ""))}
    label = {i: i for i in tables[2]}
    for _ in range(6):
        for i, a in sets.items():
            for j, b in sets.items():
                if j < i and 100 * len(a & b) >= 75 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    assert set(tables[3]) == set(label.values())
    assert set(tables[5]) == set(tables[4])
    run = {r["doc_id"]: r.asDict() for r in corpus_pipeline.run(spark, SF_DIR).collect()}
    assert run == tables[5]
