"""WARC archives: written as compressed records, read back by a salvaging reader.

Writing. Of records with equal payloads the one with the largest id is a response, the others are
revisits that name it and leave the payload out. Equal payloads are found by SHA-1 in a partial aggregate;
the table of repeated digests (28 bytes a row) is broadcast only if it has ``BROADCAST_ROWS`` at most by count, else
joined by an ordinary join. Every record is a gzip member of its own, made inside the tasks. Spark's
text sink writes and commits the files, on any file system: a member ends in the length of its record,
whose last byte is zero, and that zero is the sink's line separator (a record of 16 MiB or more is followed by an empty
member, which ends so too). The files are ordinary ``.warc.gz``.

Reading. An archive is walked member by member (or, uncompressed, record by record); a member may hold several records. Checks: gzip checksum, version
line, headers, length, the end of the record, the payload's digest (SHA-1, SHA-256, SHA-512 or MD5, in base 32 or
hexadecimal; other kinds are not checked). Where one fails, the reader
searches for the next member or version line that passes, goes on from there, and logs the bytes
between as a gap with its reason. The search goes over no byte twice for the same mark. Of a member of several records the first has the member's length and the others none; what is damaged
inside it is a gap beside the records that are not.

Defined results: a null html is an empty payload; null ids and urls are left out of the headers and null
when read; rows of one id and payload are alike, all responses where the id is the largest; a record without any id to refer to is a response;
an empty table gives no archive records and no rows; further columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 200_000
RECORDS_PER_FILE = 20_000
#: Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EMPTY_MEMBER = zlib.compress(b"", wbits=31)
MAGIC = b"\x1f\x8b\x08"
_VERSION_LINE = re.compile(rb"WARC/\d{1,2}\.\d{1,2}\r\n")
HASHES = {"sha1": hashlib.sha1, "sha-1": hashlib.sha1, "sha256": hashlib.sha256, "sha-256": hashlib.sha256, "sha512": hashlib.sha512, "md5": hashlib.md5}
_PIECE = 1 << 16

READ = T.StructType([
    T.StructField("archive", T.StringType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("gap", T.StringType()), T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("payload", T.BinaryType()),
])


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record: a response with its payload, or a revisit of ``refers_to`` without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    headers = ["WARC-Type: " + ("response" if refers_to is None else "revisit")]
    if page_id is not None:
        headers.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        headers.append("WARC-Target-URI: " + quote(url, safe="%/:?#[]@!$&'()*+,;=~-._"))
    if refers_to is not None:
        headers += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {IDENTICAL}"]
    headers += [f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest(payload)}",
                "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + "\r\n".join(headers).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """A gzip member whose last byte is zero, or that is followed by an empty one which ends so."""
    packed = zlib.compress(data, level, wbits=31)
    return packed if packed[-1] == 0 else packed + EMPTY_MEMBER


def write_archives(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
    min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 6,
) -> None:
    """Write the pages as ``.warc.gz`` files below ``path``. Payloads under ``min_bytes`` are all responses."""
    import pyarrow as pa

    rows = pages.select(
        F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"),
        F.coalesce(html, F.lit("")).cast("binary").alias("payload")).withColumn("sha", F.unhex(F.sha1("payload")))
    counted = rows.filter(F.octet_length("payload") >= min_bytes) if min_bytes else rows
    repeated = counted.groupBy("sha").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha", "first")
    if repeated.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    dealt = rows.join(repeated, "sha", "left").select(
        "page_id", "url", "payload", F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).alias("refers_to"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                member(record(i.as_py(), u.as_py(), p.as_py(), r.as_py(), date), level)[:-1]
                for i, u, p, r in zip(*(batch.column(k) for k in range(4)))
            ]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    (dealt.mapInArrow(packed, "value binary").select(F.col("value").cast("string"))
     .write.option("lineSep", "\0").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


class Damaged(ValueError):
    pass


def _headers(data: bytes) -> tuple[dict[str, str], int]:
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise Damaged("headers do not end")
    pairs = (line.partition(":") for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}, end + 4


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def _names(named: str, payload: bytes) -> bool:
    """Whether a digest header can be that of a payload; kinds that are not known can."""
    kind, _, value = named.partition(":")
    make = HASHES.get(kind.strip().lower())
    if make is None:
        return True
    found = make(payload).digest()
    return value.strip().upper().rstrip("=") in (base64.b32encode(found).decode().rstrip("="), found.hex().upper())


def _sha1_of(named: str) -> str | None:
    """The SHA-1 of a digest header as upper-case base 32."""
    kind, _, value = named.partition(":")
    if kind.strip().lower() not in ("sha1", "sha-1"):
        return None
    value = value.strip().upper()
    return base64.b32encode(bytes.fromhex(value)).decode() if re.fullmatch(r"[0-9A-F]{40}", value) else value


def parse(data: bytes) -> tuple[dict, int]:
    """The record at the start of ``data``, checked, and how many bytes it takes."""
    if not _VERSION_LINE.match(data):
        raise Damaged("no version line")
    headers, at = _headers(data)
    try:
        end = at + int(headers["content-length"])
    except (KeyError, ValueError):
        raise Damaged("no length") from None
    if end < at or data[end:end + 4] != b"\r\n\r\n":
        raise Damaged("the length does not meet the end of a record")
    block = data[at:end]
    kind = headers.get("warc-type")
    # a revisit may come without a block; a response may be of another protocol
    is_http = kind in ("response", "revisit") and block and "application/http" in headers.get("content-type", "application/http").lower()
    http, body = _headers(block) if is_http else ({}, 0)
    payload = block[body:]
    named = headers.get("warc-payload-digest", "")
    if kind == "response" and named and not _names(named, payload):
        raise Damaged("the payload is not that of its digest")
    size = http.get("content-length", "") if kind == "revisit" else str(len(payload))
    return {
        "page_id": _page(headers.get("warc-record-id")), "url": headers.get("warc-target-uri"), "record_type": kind,
        "refers_to": _page(headers.get("warc-refers-to")), "payload_bytes": int(size) if size.isdigit() else None,
        "payload_digest": _sha1_of(named) if kind == "revisit" else digest(payload), "payload": None if kind == "revisit" else payload,
    }, end + 4


def inflate(data: memoryview, at: int) -> tuple[bytes, int]:
    """The gzip member at ``at`` and the place after it."""
    unpack, out, fed = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof:
            piece = data[fed:fed + _PIECE]
            if not len(piece):
                raise Damaged("a member is cut off")
            out.append(unpack.decompress(piece))
            fed += len(piece)
    except zlib.error as problem:
        raise Damaged(f"a member is damaged: {problem}") from None
    return b"".join(out), fed - len(unpack.unused_data)


class Marks:
    """Where marks stand in an archive: each search goes on from where the last one of its kind ended."""

    def __init__(self, data: bytes):
        self.data, self.found = data, {}

    def next(self, mark: bytes | re.Pattern, at: int) -> int:
        """The first place of a mark at or after ``at``, or the end. ``at`` must not go back."""
        known = self.found.get(mark, -1)
        if known < at:
            if isinstance(mark, bytes):
                known = self.data.find(mark, at)
            else:
                line = mark.search(self.data, at)
                known = line.start() if line else -1
            self.found[mark] = known = len(self.data) if known < 0 else known
        return known


def _plain(data: bytes, marks: Marks, at: int) -> tuple[dict, int]:
    """The uncompressed record at a place and the place after it: its headers say how far it goes."""
    if not _VERSION_LINE.match(data, at):
        raise Damaged("neither a member nor a version line")
    head = marks.next(b"\r\n\r\n", at)
    if head >= min(len(data), marks.next(_VERSION_LINE, at + 1)):
        raise Damaged("headers do not end")
    length = re.search(rb"\r\ncontent-length:\s*(\d{1,18})", data[at:head + 2].lower())
    if not length:
        raise Damaged("no length")
    end = head + 8 + int(length[1])
    if data[end - 4:end] != b"\r\n\r\n":
        raise Damaged("the length does not meet the end of a record")
    found, used = parse(data[at:end])
    return found, at + used


def salvage(data: bytes) -> Iterator[dict]:
    """Records and gaps of one archive, in order: every byte belongs to one of them or to an empty member."""
    view, marks, at, gap, why = memoryview(data), Marks(data), 0, None, ""
    while at < len(data):
        try:
            if data.startswith(MAGIC, at):
                inside, end = inflate(view, at)
                found = list(salvage(inside)) if inside else []
                if found and all(r.get("gap") for r in found):
                    raise Damaged(found[0]["gap"])
            else:
                record_found, end = _plain(data, marks, at)
                found = [record_found]
        except Damaged as problem:
            if gap is None:
                gap, why = at, str(problem)
            at = min(marks.next(MAGIC, at + 1), marks.next(_VERSION_LINE, at + 1))
            continue
        if gap is not None:
            yield {"start": gap, "length": at - gap, "gap": why}
            gap = None
        for k, one in enumerate(found):
            yield {**one, "start": at, "length": 0 if k else end - at}
        at = end
    if gap is not None:
        yield {"start": gap, "length": len(data) - gap, "gap": why}


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all archives below ``path`` (``gap`` holds the reason of a gap, else null).
    A file is one task's work and must fit a cell."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([f for f in READ.fields if payloads or f.name != "payload"])
    arrow, names = to_arrow_schema(schema), schema.names

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0), batch.column(1)):
                held, size = [], 0
                for row in salvage(content.as_py()):
                    row["archive"] = archive.as_py()
                    held.append({n: row.get(n) for n in names})
                    size += len(held[-1].get("payload") or b"") + 200
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, arrow)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, arrow)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(walked, schema)


def records(read: DataFrame) -> DataFrame:
    """Page records of what :func:`read_archives` found."""
    return read.filter(F.col("gap").isNull() & F.col("record_type").isin("response", "revisit")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def gaps(read: DataFrame) -> DataFrame:
    """The log of quarantined bytes."""
    return read.filter(F.col("gap").isNotNull()).select("archive", "start", "length", F.col("gap").alias("reason"))
