"""File names, formats and media types."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension to data format.
FORMAT_BY_EXT = {
    ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".csv": "csv", ".toml": "toml",
    ".xlsx": "xlsx", ".xls": "xlsx",
}

# Extension to image format.
IMAGE_FORMAT_BY_EXT = {
    "jpg": "JPEG", "jpeg": "JPEG", "png": "PNG", "webp": "WEBP", "bmp": "BMP", "gif": "GIF",
    "tif": "TIFF", "tiff": "TIFF",
}

# Extension to media type of a converted file.
MEDIA_TYPE_BY_EXT = {
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".html": "text/html", ".txt": "text/plain", ".md": "text/markdown",
    ".json": "application/octet-stream", ".yaml": "text/yaml", ".csv": "text/csv",
    ".xml": "application/xml", ".zip": "application/zip", ".7z": "application/x-7z-compressed",
    ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif",
    ".webp": "image/webp", ".bmp": "image/bmp", ".tiff": "image/tiff",
    ".parquet": "application/octet-stream", ".jsonl": "application/jsonl",
    ".toml": "application/toml", ".epub": "application/epub+zip",
}
MEDIA_TYPE_DEFAULT = "application/octet-stream"

# Extension to media type of an inline image.
IMAGE_MEDIA_TYPE_BY_EXT = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif",
    "webp": "image/webp", "bmp": "image/bmp", "tiff": "image/tiff", "svg": "image/svg+xml",
}
IMAGE_MEDIA_TYPE_DEFAULT = "image/png"


def lookup(table: dict[str, str], key: Column) -> Column:
    """A constant-folded map literal: a lookup in a small fixed table needs no join."""
    return F.try_element_at(F.from_json(F.lit(json.dumps(table)), "map<string,string>"), key)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """Last suffix with its dot, '' if none; a leading dot alone starts no suffix."""
    return F.regexp_extract(file_name(path), r"[^.].*?(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    name = file_name(path)
    return F.substr(name, F.lit(1), F.length(name) - F.length(extension(path)))


def infer_format(path: Column) -> Column:
    """Data format of a path, null when unknown."""
    return lookup(FORMAT_BY_EXT, F.lower(extension(path)))


def infer_image_format(path: Column) -> Column:
    return lookup(IMAGE_FORMAT_BY_EXT, F.ltrim(F.lower(extension(path)), F.lit(".")))


def media_type(path: Column) -> Column:
    return F.coalesce(lookup(MEDIA_TYPE_BY_EXT, F.lower(extension(path))), F.lit(MEDIA_TYPE_DEFAULT))


def image_media_type(path: Column) -> Column:
    ext = F.ltrim(F.lower(extension(path)), F.lit("."))
    return F.coalesce(lookup(IMAGE_MEDIA_TYPE_BY_EXT, ext), F.lit(IMAGE_MEDIA_TYPE_DEFAULT))


def derive_output_name(path: Column, suffix: str, ext: str | None = None) -> Column:
    """stem + suffix + (new or old extension), in the directory of the input."""
    name = file_name(path)
    parent = F.substr(path, F.lit(1), F.length(path) - F.length(name))
    end = F.lit(ext) if ext else extension(path)
    return F.concat(parent, stem(path), F.lit(suffix), end)


def page_image_name(doc_stem: Column, page_no: Column, ext: str = ".png") -> Column:
    return F.format_string(f"%s_page%04d{ext}", doc_stem, page_no)


def slide_image_name(doc_stem: Column, slide_no: Column, ext: str = ".png") -> Column:
    return F.format_string(f"%s_slide%03d{ext}", doc_stem, slide_no)


def frame_name(index: Column, ext: str = ".png") -> Column:
    """Frames count from zero."""
    return F.format_string(f"frame_%04d{ext}", index)


def page_table_name(page_no: Column, table_no: Column) -> Column:
    return F.format_string("Page%d_T%d", page_no, table_no)


def slide_title(slide_no: Column) -> Column:
    return F.format_string("Slide %d", slide_no)


def sheet_name(table: Column) -> Column:
    """Spreadsheet sheet names hold 31 characters at most."""
    return F.substring(table, 1, 31)
