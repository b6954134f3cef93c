"""Run registered queries beside their SQL and compare names, row counts and values."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def canonical(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


SQL_NAMES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def compare(spark, con, name: str, job, sql: str | None, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    df = job(spark, sf_dir)
    have_names, have = canonical(df.columns, df.collect())
    if sql is None:
        return None if have else "no rows"
    result = con.execute(sql)
    described = [(d[0], str(d[1])) for d in result.description]
    want_names, want = canonical([d[0] for d in described], result.fetchall())
    if have_names != want_names:
        return f"columns {have_names} and {want_names}"
    have_types = {f.name: SQL_NAMES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    wrong = {n: (have_types[n], t) for n, t in described if have_types[n] != t}
    if wrong:
        return f"types {wrong}"
    if len(have) != len(want):
        return f"{len(have)} rows and {len(want)}"
    for a, b in zip(have, want):
        if a != b:
            return f"first difference:\n   spark {str(a)[:700]}\n   sql   {str(b)[:700]}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from reamwork.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    only = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                         "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    jobs, sqls, bad = entry.queries(), entry.oracle_sql(), 0
    for name, job in jobs.items():
        if only and not any(name.startswith(o) for o in only):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, name, job, sqls.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:900]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s"
              f"{'' if sqls.get(name) else ' (rows only)'}{'' if problem is None else ' ' + problem}", flush=True)
    print("bad:", bad)
