"""Binary content: base64, image headers, resize plans, size routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import names

# Content below this many bytes is returned inline, OCR text above this many
# characters is saved to a file.
INLINE_BYTES = 512_000
OCR_SAVE_CHARS = 2_000


def to_base64(content: Column) -> Column:
    """Base64 without the line breaks Spark puts in."""
    return F.regexp_replace(F.base64(content), "[\r\n]", "")


def data_uri(path: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), names.image_media_type(path), F.lit(";base64,"), to_base64(content))


def from_base64(text: Column) -> Column:
    """Decode plain base64 or a data URI; null when the text is not base64."""
    return F.try_to_binary(F.regexp_replace(F.trim(text), r"^data:[^;]+;base64,", ""), F.lit("base64"))


def is_inline(size: Column) -> Column:
    return size < INLINE_BYTES


def is_saved_text(text: Column) -> Column:
    return F.length(text) > OCR_SAVE_CHARS


def plan_resize(width: Column, height: Column, to_width: Column, to_height: Column) -> Column:
    """Target size: both given, or one given and the other scaled and cut to a whole number."""
    have_w, have_h = to_width > 0, to_height > 0
    new_w = (
        F.when(have_w, to_width)
        .when(have_h, F.floor(width * to_height / height))
        .otherwise(width)
    )
    new_h = (
        F.when(have_h, to_height)
        .when(have_w, F.floor(height * to_width / width))
        .otherwise(height)
    )
    return F.struct(new_w.cast("bigint").alias("width"), new_h.cast("bigint").alias("height"))


def clamp_quality(quality: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(95), quality))


def bbox_envelope(bbox: Column, dpi: Column) -> Column:
    """Bounding rectangle of a polygon of pixel points, in points of 1/72 inch."""
    xs = F.transform(bbox, lambda p: p[0])
    ys = F.transform(bbox, lambda p: p[1])
    scale = F.lit(72.0) / dpi
    return F.struct(
        (F.array_min(xs) * scale).alias("x0"),
        (F.array_min(ys) * scale).alias("y0"),
        (F.array_max(xs) * scale).alias("x1"),
        (F.array_max(ys) * scale).alias("y1"),
    )


def _uint(raw: Column, at: Column | int, size: int, little: bool = False) -> Column:
    """The whole number in ``size`` bytes from ``at`` (from 0) on, null beyond the end."""
    # no cell reaches the last of the places that an int can name
    first = F.lit(at + 1) if isinstance(at, int) else F.least(at + 1, F.lit((1 << 31) - 32)).cast("int")
    piece = F.substr(raw, first, F.lit(size))
    digits = F.hex(piece)
    if little:
        digits = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))])
    return F.when(F.octet_length(piece) == size, F.conv(digits, 16, 10).cast("bigint"))


def _signed(value: Column) -> Column:
    return F.when(value >= 1 << 31, value - (1 << 32)).otherwise(value)


def _begins(raw: Column, *marks: bytes) -> Column:
    return F.hex(F.substring(raw, 1, len(marks[0]))).isin(*[m.hex().upper() for m in marks])


def _names(value: Column, names: dict[int, str], other: str | None = None) -> Column:
    """The name of a number, null or ``other`` for one without."""
    found = F.lit(other).cast("string")
    for number, name in names.items():
        found = F.when(value == number, name).otherwise(found)
    return found


def _header(kind: str, width: Column, height: Column, mode: Column) -> Column:
    """A header whose parts were all found, else null."""
    whole = F.struct(F.lit(kind).alias("format"), width.cast("bigint").alias("width"), height.cast("bigint").alias("height"), mode.alias("mode"))
    return F.when(width.isNotNull() & height.isNotNull() & mode.isNotNull(), whole)


_AHEAD = 64  # segments that a first look takes in; files with more of them before the size go on from there


def _jpeg_header(raw: Column) -> Column:
    """Walks from marker to marker to the first that starts a frame; the state is the place, then the frame's facts."""
    end = F.octet_length(raw)
    state = "struct<at:bigint,on:boolean,width:bigint,height:bigint,parts:bigint>"

    def step(acc: Column, _: Column) -> Column:
        at = acc["at"]
        marker = _uint(raw, at + 1, 1)
        frame = marker.between(0xC0, 0xCF) & ~marker.isin(0xC4, 0xC8, 0xCC)
        no = F.lit(None).cast("bigint")

        def to(place: Column, on: Column, width: Column = no, height: Column = no, parts: Column = no) -> Column:
            return F.struct(place, on, width, height, parts).cast(state)

        return (
            F.when(~acc["on"], acc)
            .when((at + 9 > end) | (_uint(raw, at, 1) != 0xFF), to(at, F.lit(False)))
            .when(marker == 0xFF, to(at + 1, F.lit(True)))
            .when(frame, to(at, F.lit(False), _uint(raw, at + 7, 2), _uint(raw, at + 5, 2), _uint(raw, at + 9, 1)))
            .otherwise(to(at + 2 + _uint(raw, at + 2, 2), F.lit(True)))
        )

    def onward(first: Column) -> Column:
        far = F.aggregate(F.sequence(F.lit(1), F.greatest(end, F.lit(1))), first, step)
        return F.when(first["on"], far).otherwise(first)

    start = F.struct(F.lit(2), F.lit(True), F.lit(None), F.lit(None), F.lit(None)).cast(state)
    near = F.aggregate(F.sequence(F.lit(1), F.lit(_AHEAD)), start, step)
    found = F.transform(F.array(near), onward)

    def facts(done: Column) -> Column:
        mode = F.when(done["parts"].isNotNull(), _names(done["parts"], {1: "L", 3: "RGB", 4: "CMYK"}, "RGB"))
        return _header("JPEG", done["width"], done["height"], mode)

    return F.transform(found, facts)[0]


def _tiff_header(raw: Column, little: bool) -> Column:
    first = _uint(raw, 4, 4, little)
    count = _uint(raw, first, 2, little)

    def entry(i: Column) -> Column:
        at = first + 2 + i * 12
        kind = _uint(raw, at + 2, 2, little)
        value = F.when(kind == 3, _uint(raw, at + 8, 2, little)).otherwise(_uint(raw, at + 8, 4, little))
        return F.struct(_uint(raw, at, 2, little).alias("tag"), value.alias("value"))

    # an entry cut off makes the whole unreadable
    entries = F.transform(F.when(count > 0, F.sequence(F.lit(0).cast("bigint"), count - 1)), entry)
    whole = F.when(F.forall(entries, lambda e: e["value"].isNotNull()), entries)

    def facts(every: Column) -> Column:
        # the last entry of a tag stands
        of = lambda tag: F.try_element_at(F.filter(every, lambda e: e["tag"] == tag), F.lit(-1))["value"]
        # tags: 256 width, 257 height, 262 colour model, 277 samples per pixel
        model = _names(F.coalesce(of(262), F.lit(-1)), {0: "L", 1: "L", 2: "RGB", 3: "P", 5: "CMYK"}, "RGB")
        mode = F.when((model == "RGB") & F.coalesce(of(277) == 4, F.lit(False)), "RGBA").otherwise(model)
        return _header("TIFF", of(256), of(257), mode)

    return F.transform(F.array(whole), facts)[0]


def _webp_header(raw: Column) -> Column:
    kind, bits = F.hex(F.substring(raw, 13, 4)), _uint(raw, 21, 4, True)
    flags = _uint(raw, 20, 1)
    extended = _header("WEBP", _uint(raw, 24, 3, True) + 1, _uint(raw, 27, 3, True) + 1, F.when(flags.bitwiseAND(0x10) > 0, "RGBA").when(flags >= 0, "RGB"))
    lossless = _header(
        "WEBP", bits.bitwiseAND(0x3FFF) + 1, F.shiftright(bits, 14).bitwiseAND(0x3FFF) + 1,
        F.when(F.shiftright(bits, 28).bitwiseAND(1) > 0, "RGBA").when(bits >= 0, "RGB"))
    plain = _header("WEBP", _uint(raw, 26, 2, True).bitwiseAND(0x3FFF), _uint(raw, 28, 2, True).bitwiseAND(0x3FFF), F.lit("RGB"))
    return F.when(kind == b"VP8X".hex().upper(), extended).when(kind == b"VP8L".hex().upper(), lossless).otherwise(plain)


def image_header(raw: Column) -> Column:
    """STRUCT<format, width, height, mode> from the bytes of a file's header, null for anything unreadable.

    PNG, GIF, BMP, JPEG, TIFF and WEBP; column expressions only, so no file leaves the JVM.
    """
    depth, colour = _uint(raw, 24, 1), _uint(raw, 25, 1)
    png_mode = F.when((depth == 1) & (colour == 0), "1").otherwise(_names(colour, {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}))
    bits = _uint(raw, 28, 2, True)
    return (
        F.when(_begins(raw, b"\x89PNG\r\n\x1a\n"), _header("PNG", _uint(raw, 16, 4), _uint(raw, 20, 4), png_mode))
        .when(_begins(raw, b"GIF87a", b"GIF89a"), _header("GIF", _uint(raw, 6, 2, True), _uint(raw, 8, 2, True), F.lit("P")))
        .when(_begins(raw, b"BM"), _header(
            "BMP", _signed(_uint(raw, 18, 4, True)), F.abs(_signed(_uint(raw, 22, 4, True))),
            F.when(bits.isNotNull(), _names(bits, {1: "1", 8: "P", 32: "RGBA"}, "RGB"))))
        .when(_begins(raw, b"\xff\xd8\xff"), _jpeg_header(raw))
        .when(_begins(raw, b"II*\x00"), _tiff_header(raw, True)).when(_begins(raw, b"MM\x00*"), _tiff_header(raw, False))
        .when(_begins(raw, b"RIFF") & (F.hex(F.substring(raw, 9, 4)) == b"WEBP".hex().upper()), _webp_header(raw))
    )
