"""Image headers read by column expressions, against a reader of bytes in Python."""

import random
import struct

from pyspark.sql import functions as F

from reamwork.functions.binary import image_header
from reamwork.sources import images


def _jpeg_size(raw: bytes):
    at = 2
    while at + 9 <= len(raw):
        if raw[at] != 0xFF:
            return None
        marker = raw[at + 1]
        if marker == 0xFF:
            at += 1
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width, parts = struct.unpack(">HHB", raw[at + 5:at + 10])
            return width, height, {1: "L", 3: "RGB", 4: "CMYK"}.get(parts, "RGB")
        else:
            at += 2 + struct.unpack(">H", raw[at + 2:at + 4])[0]
    return None


def _tiff_size(raw: bytes):
    end = "<" if raw[:2] == b"II" else ">"
    (at,) = struct.unpack(end + "I", raw[4:8])
    (count,) = struct.unpack(end + "H", raw[at:at + 2])
    tags = {}
    for i in range(count):
        entry = raw[at + 2 + 12 * i:at + 14 + 12 * i]
        tag, kind = struct.unpack(end + "HH", entry[:4])
        tags[tag] = struct.unpack(end + ("H" if kind == 3 else "I"), entry[8:10] if kind == 3 else entry[8:12])[0]
    # tags: 256 width, 257 height, 262 colour model, 277 samples per pixel
    mode = {0: "L", 1: "L", 2: "RGB", 3: "P", 5: "CMYK"}.get(tags.get(262), "RGB")
    return tags[256], tags[257], "RGBA" if (mode, tags.get(277)) == ("RGB", 4) else mode


def by_hand(raw: bytes):
    """(format, width, height, mode) byte by byte."""
    try:
        if raw[:8] == b"\x89PNG\r\n\x1a\n":
            width, height, depth, colour = struct.unpack(">IIBB", raw[16:26])
            mode = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}[colour]
            return "PNG", width, height, "1" if (depth, colour) == (1, 0) else mode
        if raw[:6] in (b"GIF87a", b"GIF89a"):
            return ("GIF", *struct.unpack("<HH", raw[6:10]), "P")
        if raw[:2] == b"BM":
            width, height, _, bits = struct.unpack("<iiHH", raw[18:30])
            return "BMP", width, abs(height), {1: "1", 8: "P", 32: "RGBA"}.get(bits, "RGB")
        if raw[:3] == b"\xff\xd8\xff":
            size = _jpeg_size(raw)
            return ("JPEG", *size) if size else None
        if raw[:4] in (b"II*\x00", b"MM\x00*"):
            return ("TIFF", *_tiff_size(raw))
        if raw[:4] == b"RIFF" and raw[8:12] == b"WEBP":
            if len(raw) < (25 if raw[12:16] == b"VP8L" else 30):
                return None
            if raw[12:16] == b"VP8X":
                width = 1 + int.from_bytes(raw[24:27], "little")
                height = 1 + int.from_bytes(raw[27:30], "little")
                return "WEBP", width, height, "RGBA" if raw[20] & 0x10 else "RGB"
            if raw[12:16] == b"VP8L":
                bits = int.from_bytes(raw[21:25], "little")
                alpha = "RGBA" if bits >> 28 & 1 else "RGB"
                return "WEBP", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, alpha
            width, height = struct.unpack("<HH", raw[26:30])
            return "WEBP", width & 0x3FFF, height & 0x3FFF, "RGB"
    except (struct.error, KeyError, IndexError):
        pass
    return None


def samples():
    segment = lambda marker, size: bytes([0xFF, marker]) + struct.pack(">H", size + 2) + b"\x11" * size
    frame = lambda parts: b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, 480, 640, parts) + b"\0" * 9
    tiff = lambda end, tags: (b"II*\0" if end == "<" else b"MM\0*") + struct.pack(end + "IH", 8, len(tags)) + b"".join(
        struct.pack(end + "HHI", t, k, 1) + (struct.pack(end + "HH", v, 0) if k == 3 else struct.pack(end + "I", v)) for t, k, v in tags)
    webp = lambda kind, body: b"RIFF" + struct.pack("<I", 30) + b"WEBP" + kind + struct.pack("<I", 10) + body
    png = lambda depth, colour: b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">IIBB", 70_000, 5, depth, colour) + b"\0" * 3
    return [
        *(png(d, c) for d in (1, 8) for c in (0, 2, 3, 4, 6, 7)),
        b"GIF87a" + struct.pack("<HH", 40, 30) + b"\0\0\0", b"GIF89a" + struct.pack("<HH", 65535, 1),
        *(b"BM" + b"\0" * 16 + struct.pack("<iiHH", 9, h, 1, bits) for h in (4, -4) for bits in (1, 8, 24, 32)),
        *(b"\xff\xd8" + segment(0xE0, 14) + b"\xff\xff" + frame(p) for p in (1, 3, 4, 9)), b"\xff\xd8" + segment(0xE1, 70) * 300 + segment(0xC4, 5) + frame(3),
        b"\xff\xd8" + segment(0xE1, 65_000) * 3 + frame(3), b"\xff\xd8" + segment(0xE0, 9), b"\xff\xd8\xff\xd9", b"\xff\xd8\xff\xe0\0\0\0\0" * 3, b"\xff\xd8\xff\xc0\0\x11\x08\0\1\0\2",
        *(tiff(e, [(256, 4, 11), (257, 3, 6), (262, 3, m), (277, 3, n)]) for e in "<>" for m in (0, 2, 3, 5, 9) for n in (3, 4)), tiff("<", [(257, 3, 6)]), tiff(">", [(256, 3, 1), (256, 3, 2), (257, 3, 6)]), tiff("<", []),
        webp(b"VP8X", b"\x10\0\0\0" + b"\x0f\0\0" + b"\x1f\1\0"), webp(b"VP8X", b"\0" * 10), webp(b"VP8L", b"\x2f" + struct.pack("<I", 99 | 49 << 14 | 1 << 28) + b"\0" * 5),
        webp(b"VP8 ", b"\0" * 6 + struct.pack("<HH", 0x4010, 20)), b"", b"junk", b"BM", b"RIFF1234WAVE" + b"\0" * 30]


def test_headers_equal_those_read_by_hand(frame):
    dice = random.Random(2)
    files = samples()
    for raw in list(files):
        files += [raw[:dice.randrange(len(raw) + 1)] for _ in range(3)]
        for _ in range(6):
            changed = bytearray(raw[:400])
            for _ in range(dice.randrange(1, 4)):
                if changed:
                    changed[dice.randrange(min(len(changed), 60))] = dice.randrange(256)
            files.append(bytes(changed))
    got = frame(list(enumerate(map(bytearray, files))), "i int, raw binary").select("i", image_header(F.col("raw")).alias("h")).collect()
    for r in got:
        want = by_hand(files[r.i])
        assert (tuple(r.h) if r.h else None) == (want if want is None else tuple(want)), files[r.i][:60]


def test_no_python_in_the_plan(frame):
    done = images.image_info(frame([("a", bytearray(samples()[0])), ("b", None)], "path string, content binary"))
    assert "Python" not in done.rows._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in done.rows.collect()] == [("a", "PNG", 70_000, 5, "1", 29)] and [r.path for r in done.errors.collect()] == ["b"]
