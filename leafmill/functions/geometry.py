"""Geometry of boxes in points (origin at the lower left) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def extent(low: Column, high: Column) -> Column:
    """Width or height, 0 at least."""
    return F.greatest(high - low, F.lit(0.0))


def overlap(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """The area that two boxes (left, bottom, right, top) share."""
    return extent(F.greatest(a[0], b[0]), F.least(a[2], b[2])) * extent(F.greatest(a[1], b[1]), F.least(a[3], b[3]))


def contains(outer: tuple[Column, Column, Column, Column], inner: tuple[Column, Column, Column, Column], tolerance: float) -> Column:
    return (inner[0] >= outer[0] - tolerance) & (inner[1] >= outer[1] - tolerance) & (inner[2] <= outer[2] + tolerance) & (inner[3] <= outer[3] + tolerance)


def near(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column], tolerance: float) -> Column:
    """Whether the gap between two boxes is the tolerance at most, both ways."""
    return (a[0] <= b[2] + tolerance) & (b[0] <= a[2] + tolerance) & (a[1] <= b[3] + tolerance) & (b[1] <= a[3] + tolerance)


def indent(left: Column, margin: Column) -> Column:
    return F.greatest(left - margin, F.lit(0.0))


def alignment(left: Column, right: Column, page_width: Column, margin_left: Column, margin_right: Column) -> Column:
    """``center``, ``right``, ``both`` or ``left`` of a block between the margins; null where they leave no room."""
    usable = page_width - margin_left - margin_right
    width = F.greatest(right - left, F.lit(1.0))
    centre = F.abs((left + right) / 2 - (margin_left + usable / 2))
    return (
        F.when(usable <= 0, F.lit(None))
        .when(centre <= F.greatest(F.lit(10.0), width * 0.1), "center")
        .when((right >= page_width - margin_right - 5.0) & (left > margin_left + width * 0.25), "right")
        .when(width >= usable * 0.9, "both")
        .otherwise("left")
    )


def table_alignment(left: Column, right: Column, page_width: Column) -> Column:
    """A table is centred if its middle is within 12 points or 15 % of its width of the page's."""
    return F.when(F.abs((left + right) / 2 - page_width / 2) <= F.greatest(F.lit(12.0), (right - left) * 0.15), "center").otherwise("left")


def cell_alignment(text: Column) -> Column:
    """Numbers stand at the right, up to three letters in the middle, the rest at the left."""
    bare = F.translate(text, ",·", "")
    number = F.replace(bare, F.lit("−"), F.lit("-"))
    is_number = number.rlike(r"^\s*[+-]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+)?\s*$|^(?i)\s*[+-]?(?:nan|inf|infinity)\s*$")
    return F.when(is_number, "right").when((F.length(text) <= 3) & text.rlike(r"^\p{L}+$"), "center").otherwise("left")


def line_spacing(height: Column, size: Column) -> Column:
    """Height by size, 1 to 2.5, in hundredths; 1.2 without a size."""
    return F.when(size > 0, F.bround(F.least(F.greatest(height / size, F.lit(1.0)), F.lit(2.5)), 2)).otherwise(F.lit(1.2))


def twips(points: Column) -> Column:
    return F.bround(points * 20).cast("bigint")


def emu(points: Column) -> Column:
    return F.bround(points * 12700).cast("bigint")


def column_of(left: Column, page_width: Column, margin_left: Column, margin_right: Column, columns: Column, spacing: Column) -> Column:
    """The first of equally wide columns whose right end a block's left edge doesn't pass (a tenth of a point is allowed)."""
    gap = F.coalesce(spacing, F.lit(18.0))
    width = (page_width - margin_left - margin_right - gap * (columns - 1)) / columns
    offset = F.greatest(left - margin_left, F.lit(0.0))
    at = F.ceil((offset - 0.1 - width) / (width + gap))
    return F.when((columns <= 1) | (width <= 0), F.lit(0)).otherwise(F.least(F.greatest(at, F.lit(0)), columns - 1)).cast("int")


def hex_of_grey(value: Column) -> Column:
    """A grey level as hex colour; values above 1 are scaled, by 255 above 10."""
    level = F.when(value > 10, value / 255.0).otherwise(value)
    part = F.lpad(F.hex(F.bround(F.least(F.greatest(level, F.lit(0.0)), F.lit(1.0)) * 255).cast("bigint")), 2, "0")
    return F.concat(part, part, part)


def hex_of_cmyk(c: Column, m: Column, y: Column, k: Column) -> Column:
    parts = [F.lpad(F.hex(F.bround((1 - F.least(x + k, F.lit(1.0))) * 255).cast("bigint")), 2, "0") for x in (c, m, y)]
    return F.concat(*parts)


def vertical_matrix(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether a text matrix writes upwards or downwards: an axis within 15 degrees of it, or no horizontal part."""
    upright = lambda x, y: F.abs(F.pmod(F.degrees(F.atan2(y, x)), F.lit(180.0)) - 90.0) <= 15.0
    return upright(a, b) | ((F.abs(a) < 1e-6) & (F.abs(d) < 1e-6))


def bezier(p0: tuple[Column, Column], p1: tuple[Column, Column], p2: tuple[Column, Column], p3: tuple[Column, Column], steps: int = 12) -> Column:
    """Points of a cubic curve: array<struct<x, y>>."""

    def at(k: Column) -> Column:
        t = k / float(steps)
        u = 1 - t
        x, y = (u * u * u * p0[i] + 3 * u * u * t * p1[i] + 3 * u * t * t * p2[i] + t * t * t * p3[i] for i in (0, 1))
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(F.sequence(F.lit(0), F.lit(steps)), at)
