"""Image corpora: header facts, never pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.binary import image_header
from ..operators.sequence import Outcome


def image_info(images: DataFrame, path: str = "path", content: str = "content") -> Outcome:
    """(path, format, width, height, mode, file_size_bytes); unreadable images come back as errors.

    Only the header is looked at, by column expressions: the cost is reading the file, not decoding it.
    """
    # unnested, so that the header is read once and not again for every field and test of it
    seen = images.select(
        F.col(path).alias("path"), F.octet_length(content).cast("bigint").alias("file_size_bytes"),
        F.explode_outer(F.array(image_header(F.col(content)))).alias("__h"),
    ).select("path", "__h.format", "__h.width", "__h.height", "__h.mode", "file_size_bytes")
    good = seen.filter(F.col("format").isNotNull())
    bad = seen.filter(F.col("format").isNull()).select("path", F.lit("Could not read image").alias("error"))
    return Outcome(good, bad)
