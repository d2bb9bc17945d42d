"""Functions on images and colours stored as bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First bytes of image formats.
MAGIC = [("image/png", "89504E470D0A1A0A"), ("image/jpeg", "FFD8FF"), ("image/gif", "474946383761"), ("image/gif", "474946383961"), ("image/bmp", "424D")]
EXTENSIONS = {"image/png": "png", "image/jpeg": "jpeg", "image/gif": "gif", "image/bmp": "bmp"}


def mime_type(data: Column, given: Column | None = None) -> Column:
    """The MIME type of an image by its first bytes, unless one is given; PNG for unknown bytes."""
    head = F.hex(F.substring(data, 1, 8))
    out = F.when(given.isNotNull(), given) if given is not None else F.when(F.lit(False), "")
    for mime, magic in MAGIC:
        out = out.when(head.startswith(magic), mime)
    return out.when(data.isNotNull(), "image/png")


def extension(mime: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])[mime], F.lit("png"))


def average_dpi(width_px: Column, height_px: Column, width_pt: Column, height_pt: Column) -> Column:
    """Mean of an image's resolutions both ways; null without a size in pixels."""
    inches = lambda points: F.greatest(points / 72.0, F.lit(1e-6))
    return F.when((width_px > 0) & (height_px > 0), (width_px / inches(width_pt) + height_px / inches(height_pt)) / 2)


def possible_savings(size: Column, images: Column) -> Column:
    """Bytes that a compression may save: 5 % without images, else 35 % and 2 % for each image, 60 % at most; cut to whole bytes."""
    share = F.when(images > 0, F.least(0.35 + 0.02 * images, F.lit(0.6))).otherwise(F.lit(0.05))
    return F.floor(size * share).cast("bigint")


def compression_result(before: Column, after: Column) -> Column:
    """struct<bytes_saved, ratio>; the ratio of an empty file is 1."""
    return F.struct(F.greatest(before - after, F.lit(0)).alias("bytes_saved"), F.when(before > 0, after / before).otherwise(F.lit(1.0)).alias("ratio"))
