"""SQLite databases as DataFrames.

Two ways in: :class:`SqliteSource` reads one database file on a mount that every executor sees,
split by row id; :func:`sqlite_rows` reads a corpus of database files from any file system Spark
reads, as (path, content) rows.
"""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructType

_KINDS = (("INT", LongType()), ("CHAR", StringType()), ("CLOB", StringType()), ("TEXT", StringType()),
          ("BLOB", BinaryType()), ("REAL", DoubleType()), ("FLOA", DoubleType()), ("DOUB", DoubleType()))


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.removeprefix('file:')}?mode=ro", uri=True)


def table_names(conn: sqlite3.Connection) -> list[str]:
    return [r[0] for r in conn.execute("SELECT name FROM sqlite_master WHERE type='table' ORDER BY rowid")]


def _quoted(conn: sqlite3.Connection, table: str) -> str:
    if table not in table_names(conn):
        raise ValueError(f"no such table: {table}")
    return '"' + table.replace('"', '""') + '"'


class RowRange(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType, partitions: int):
        self.path, self.table, self.wanted, self.parts = path, table, schema, partitions

    def partitions(self) -> list[InputPartition]:
        conn = _open(self.path)
        try:
            low, high = conn.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(conn, self.table)}").fetchone()
        except sqlite3.OperationalError:
            return [RowRange(None, None)]  # a table without row ids is read in one piece
        finally:
            conn.close()
        if low is None:
            return [RowRange(0, 0)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [RowRange(at, min(at + step, high + 1)) for at in range(low, high + 1, step)]

    def read(self, partition: RowRange) -> Iterator[tuple]:
        conn = _open(self.path)
        try:
            names = ", ".join('"' + n.replace('"', '""') + '"' for n in self.wanted.names)
            query, args = f"SELECT {names} FROM {_quoted(conn, self.table)}", ()
            if partition.low is not None:
                query, args = query + " WHERE rowid >= ? AND rowid < ?", (partition.low, partition.high)
            kinds = [f.dataType.simpleString() for f in self.wanted.fields]
            for row in conn.execute(query, args):
                yield tuple(_typed(v, k) for v, k in zip(row, kinds))
        finally:
            conn.close()


def _typed(value, kind: str):
    if value is None:
        return None
    try:
        if kind == "bigint":
            return int(value)
        if kind == "double":
            return float(value)
    except (TypeError, ValueError):
        return None
    if kind == "binary":
        return value if isinstance(value, bytes) else str(value).encode()
    return value if isinstance(value, str) else str(value)


class SqliteSource(DataSource):
    """``spark.read.format("sqlite").option("table", ...).load(path)``"""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        conn = _open(self.options["path"])
        try:
            rows = conn.execute(f"PRAGMA table_info({_quoted(conn, self.options['table'])})").fetchall()
        finally:
            conn.close()
        out = StructType()
        for _, name, declared, *_ in rows:
            declared = (declared or "TEXT").upper()
            out.add(name, next((kind for mark, kind in _KINDS if mark in declared), DoubleType()))
        return out

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(
            self.options["path"], self.options["table"], schema, int(self.options.get("partitions", "8"))
        )


def read_sqlite(spark: SparkSession, path: str, table: str | None = None, partitions: int = 8) -> dict[str, DataFrame]:
    """All tables of a database, or the named one, as DataFrames by name."""
    spark.dataSource.register(SqliteSource)
    if table is None:
        conn = _open(path)
        try:
            names = table_names(conn)
        finally:
            conn.close()
    else:
        names = [table]
    return {
        n: spark.read.format("sqlite").option("table", n).option("partitions", partitions).load(path)
        for n in names
    }


_ROWS_PER_BATCH = 4_096


def _rows_of(raw: bytes, wanted: str | None) -> Iterator[tuple[str | None, int | None, str | None, str | None]]:
    conn = sqlite3.connect(":memory:")
    try:
        conn.deserialize(raw)
        for table in [wanted] if wanted else table_names(conn):
            cursor = conn.execute(f"SELECT * FROM {_quoted(conn, table)}")
            names = [d[0] for d in cursor.description]
            for i, row in enumerate(cursor):
                yield table, i, json.dumps(dict(zip(names, row)), ensure_ascii=False, default=str), None
    except (sqlite3.Error, ValueError) as problem:
        yield None, None, None, str(problem)
    finally:
        conn.close()


def sqlite_rows(files: DataFrame, table: str | None = None, path: str = "path", content: str = "content") -> DataFrame:
    """Rows of a corpus of databases: (path, table_name, row_idx, record, error).

    ``record`` is JSON text, because tables differ in shape; values JSON lacks become text.
    """

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "table_name", "row_idx", "record", "error"]
        for frame in frames:
            for where, raw in zip(frame["path"], frame["content"]):
                batch = []
                for row in _rows_of(raw, table):
                    batch.append((where, *row))
                    if len(batch) == _ROWS_PER_BATCH:
                        yield pd.DataFrame(batch, columns=columns).astype({"row_idx": "Int64"})
                        batch = []
                if batch:
                    yield pd.DataFrame(batch, columns=columns).astype({"row_idx": "Int64"})

    source = files.select(F.col(path).cast("string").alias("path"), F.col(content).alias("content"))
    return source.mapInPandas(load, "path string, table_name string, row_idx bigint, record string, error string")
