"""Archive corpora: ZIP and TAR members as rows, and members packed into bundles."""

from __future__ import annotations

import io
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import amount_before

MEMBER_SCHEMA = "path string, member string, size bigint, content binary, error string"
_BATCH_BYTES = 16 << 20
_TEXT_CHARS = 4 << 20


def binary_corpus(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """One row per file: (path, content, length)."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    return reader.load(path).select("path", "content", "length")


def _members(raw: bytes, password: bytes | None) -> Iterator[tuple[str, int, bytes]]:
    if zipfile.is_zipfile(io.BytesIO(raw)):
        with zipfile.ZipFile(io.BytesIO(raw)) as box:
            for info in box.infolist():
                yield info.filename, info.file_size, b"" if info.is_dir() else box.read(info, password)
        return
    with tarfile.open(fileobj=io.BytesIO(raw), mode="r:*") as box:
        for info in box:
            handle = box.extractfile(info) if info.isfile() else None
            yield info.name, info.size, handle.read() if handle else b""


def _error_text(problem: Exception) -> str:
    if isinstance(problem, RuntimeError) and "password" in str(problem).lower():
        return "ZIP is password-protected. Provide the 'password' parameter."
    if isinstance(problem, tarfile.TarError):
        return f"Not a valid ZIP or TAR archive: {problem}"
    return str(problem) or type(problem).__name__


def archive_members(
    archives: DataFrame, wanted: str | None = None, password: str | None = None, path: str = "path",
    content: str = "content",
) -> DataFrame:
    """One row per member (path, member, size, content, error); a bad archive is one error row.

    ``wanted`` is a regular expression on member names: members it does not match are listed
    without being handed to Spark. Rows leave in batches of bounded size, so an archive that
    unpacks to far more than its own size does not pile up in the worker. Names are never used as
    paths.
    """
    import re

    pattern = re.compile(wanted) if wanted else None
    secret = password.encode() if password else None

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "member", "size", "content", "error"]
        for frame in frames:
            for where, raw in zip(frame["path"], frame["content"]):
                batch, held = [], 0
                try:
                    for name, size, data in _members(raw, secret):
                        if pattern and not pattern.search(name):
                            continue
                        batch.append((where, name, size, data, None))
                        held += len(data)
                        if held > _BATCH_BYTES:
                            yield pd.DataFrame(batch, columns=columns)
                            batch, held = [], 0
                except (zipfile.BadZipFile, tarfile.TarError, RuntimeError, OSError, EOFError,
                        zlib.error, NotImplementedError, ValueError) as problem:
                    batch.append((where, None, None, None, _error_text(problem)))
                if batch:
                    yield pd.DataFrame(batch, columns=columns).astype({"size": "Int64"})

    source = archives.select(F.col(path).cast("string").alias("path"), F.col(content).alias("content"))
    return source.mapInPandas(unpack, MEMBER_SCHEMA)


def archive_listing(members: DataFrame) -> DataFrame:
    """Totals per archive: ``files_extracted``, unpacked bytes, and the error if any."""
    return members.groupBy("path").agg(
        F.count("member").alias("files_extracted"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"),
        F.max("error").alias("error"),
    )


def spread_bundles(members: DataFrame, bundle: str, member: str, max_bytes: int, size: str) -> DataFrame:
    """Add ``bundle_part``: a bundle is cut into containers of ``max_bytes`` at most, but for single members above that.

    The same rule at every size: a new part begins wherever another half of ``max_bytes`` has piled up, and a member above
    half of it is a part of its own. Bundles below half are part 0 alone. Part numbers may have gaps.
    """
    half = max(1, max_bytes // 2)
    bytes_of = F.coalesce(F.col(size), F.lit(0)).cast("bigint")
    placed = amount_before(members, [bundle], [member], bytes_of, "__piled")
    own = F.when(bytes_of > half, 1).otherwise(0)
    return placed.withColumn("bundle_part", (2 * F.floor(F.col("__piled") / half) + own).cast("bigint")).drop("__piled")


def pack_manifest(packed: DataFrame, bundle: str, size: str) -> DataFrame:
    return packed.groupBy(bundle).agg(
        F.count(F.lit(1)).alias("files_added"),
        F.sum(size).alias("total_bytes"),
        F.countDistinct("bundle_part").alias("containers"),
    )


PACKED_CODECS = ("uncompressed", "gzip", "zstd", "snappy", "lz4")


def write_packed(packed: DataFrame, path: str, bundle: str, compression: str = "gzip", mode: str = "errorifexists") -> None:
    """Many small members into few compressed Parquet containers, one set per bundle.

    Big bundles were given several parts by :func:`spread_bundles`, so no single task writes one.
    """
    codec = {"": "uncompressed", "none": "uncompressed", "gz": "gzip"}.get(compression, compression)
    if codec not in PACKED_CODECS:
        raise ValueError(f"containers can't be compressed with {compression!r}, only with {', '.join(PACKED_CODECS)}")
    (
        packed.repartition(bundle, "bundle_part").write.mode(mode).option("compression", codec)
        .partitionBy(bundle).parquet(path)
    )


def zip_bundles(packed: DataFrame, bundle: str, member: str, content: str, level: int = 6) -> DataFrame:
    """ZIP bytes per (bundle, bundle_part): (bundle, bundle_part, files_added, content).

    Groups are bounded by the ``max_bytes`` given to :func:`spread_bundles`.
    """
    kind = packed.schema[bundle].dataType.simpleString()

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        frame = frame.sort_values("__member")
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=level) as box:
            for name, data in zip(frame["__member"], frame["__content"]):
                # a fixed date keeps the bytes the same from run to run
                box.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
        return pd.DataFrame({
            bundle: [frame[bundle].iloc[0]], "bundle_part": [frame["bundle_part"].iloc[0]],
            "files_added": [len(frame)], "content": [out.getvalue()],
        })

    return (
        packed.select(bundle, "bundle_part", F.col(member).alias("__member"), F.col(content).alias("__content"))
        .groupBy(bundle, "bundle_part")
        .applyInPandas(build, f"{bundle} {kind}, bundle_part bigint, files_added bigint, content binary")
    )


def _check_xml(name: str, raw: bytes) -> None:
    parser = expat.ParserCreate()
    try:
        parser.Parse(raw, True)
    except expat.ExpatError as problem:
        raise ValueError(f"{name} is not well-formed XML: {problem}") from problem


def archive_texts(
    archives: DataFrame, wanted: str, path: str = "path", content: str = "content", main: str | None = None,
    checked: str | None = None,
) -> DataFrame:
    """One row per archive with its wanted text members: (path, parts MAP<STRING,STRING>, error).

    For formats that are an archive of XML parts: lookups between the parts of one file then stay
    inside the row and need no join and no shuffle. A file has either parts or an error: it is an
    error that no member matches ``main``, that a wanted member is not UTF-8, and that one whose
    name matches ``checked`` is no well-formed XML.

    Files are read one by one, and their texts leave in batches of bounded size.
    """
    import re

    import pyarrow as pa

    types = [pa.string(), pa.list_(pa.struct([("name", pa.string()), ("text", pa.string())])), pa.string()]

    def rows_of(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], ["path", "parts", "error"])

    pattern = re.compile(wanted)
    needed, strict = re.compile(main or ""), re.compile(checked or "(?!)")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, held = [], 0
            for where, raw in zip(batch.column(0), batch.column(1)):  # out of the batch one by one
                parts, error = None, None
                try:
                    with zipfile.ZipFile(io.BytesIO(raw.as_py() or b"")) as box:
                        if main and not any(map(needed.search, box.namelist())):
                            raise ValueError(f"no part of the archive matches {main}")
                        read = []
                        # a repeated member name counts once, as the last of that name
                        for name in dict.fromkeys(n for n in box.namelist() if pattern.search(n)):
                            data = box.read(name)
                            if strict.search(name):
                                _check_xml(name, data)
                            read.append({"name": name, "text": data.decode("utf-8-sig")})
                        parts = read
                except (zipfile.BadZipFile, RuntimeError, OSError, EOFError, zlib.error,
                        NotImplementedError, ValueError) as problem:
                    error = _error_text(problem)
                done.append((where.as_py(), parts, error))
                held += sum(len(p["text"]) for p in parts or ())
                if held > _TEXT_CHARS or len(done) >= 1_000:
                    yield rows_of(done)
                    done, held = [], 0
            if done:
                yield rows_of(done)

    source = archives.select(F.col(path).cast("string").alias("path"), F.col(content).alias("content"))
    rows = source.mapInArrow(unpack, "path string, parts array<struct<name string, text string>>, error string")
    return rows.withColumn("parts", F.map_from_entries("parts"))
