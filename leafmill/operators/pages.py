"""Choosing, splitting and merging pages. Page numbers of these operators are 1-based."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidRange


def parse_ranges(spec: str | Iterable, total_pages: int | None = None) -> list[tuple[int, int]]:
    """Inclusive page ranges in the order given: ``"1-2,5"``, or numbers, texts and pairs.

    Blanks are skipped; a number below 1 or beyond ``total_pages``, an end before its start, or nothing at all is an error.
    """
    items = spec.split(",") if isinstance(spec, str) else [y for x in (spec or ()) for y in (x.split(",") if isinstance(x, str) else [x])]
    out = []
    for item in items:
        if isinstance(item, str):
            item = item.strip()
            if not item:
                continue
            first, dash, last = item.partition("-")
            if not re.fullmatch(r"\s*\d+\s*", first) or dash and not re.fullmatch(r"\s*\d+\s*", last):
                raise InvalidRange(f"no page range: {item!r}")
            pair = (int(first), int(last) if dash else int(first))
        elif isinstance(item, int):
            pair = (item, item)
        else:
            pair = (int(item[0]), int(item[1]))
        if pair[0] < 1 or pair[1] < pair[0] or total_pages is not None and pair[1] > total_pages:
            raise InvalidRange(f"page range {pair[0]}-{pair[1]} of {total_pages} pages")
        out.append(pair)
    if not out:
        raise InvalidRange("no page range given")
    return out


def normalise_pages(pages: Iterable, total_pages: int | None = None) -> list[int]:
    """Page numbers, each once, in order; blank texts are skipped."""
    if pages is None:
        raise InvalidRange("no pages given")
    found = sorted({int(p) for p in pages if not (isinstance(p, str) and not p.strip())})
    if not found or found[0] < 1 or total_pages is not None and found[-1] > total_pages:
        raise InvalidRange(f"pages {found} of {total_pages} pages")
    return found


def range_label(start: Column, end: Column) -> Column:
    return F.when(start == end, F.concat(F.lit("page_"), start.cast("string"))).otherwise(F.concat(F.lit("pages_"), start.cast("string"), F.lit("-"), end.cast("string")))


def output_name(stem: Column, start: Column, end: Column, suffix: str = ".pdf") -> Column:
    return F.concat(F.replace(stem, F.lit(" "), F.lit("_")), F.lit("_"), range_label(start, end), F.lit(suffix))


def split_ranges(pages: DataFrame, ranges: list[tuple[int, int]], page: str = "page") -> DataFrame:
    """``pages`` with ``part``, ``range_start`` and ``range_end``: one part a range, in the order given, overlaps kept."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("part"), F.lit(a).alias("range_start"), F.lit(b).alias("range_end")) for i, (a, b) in enumerate(ranges))))
    out = pages.withColumn("_r", each)
    return out.where(F.col(page).between(F.col("_r.range_start"), F.col("_r.range_end"))).select(*pages.columns, "_r.*")


def split_pages(pages: DataFrame, wanted: list[int], page: str = "page") -> DataFrame:
    """One part a page, each page once, in order."""
    return split_ranges(pages, [(p, p) for p in sorted(set(wanted))], page)


def split(pages: DataFrame, mode: str, ranges: str | Iterable | None = None, wanted: Iterable | None = None, page: str = "page") -> DataFrame:
    """Parts by ``mode``: ``range`` (``ranges`` as ``parse_ranges`` takes them) or ``pages`` (``wanted`` as ``normalise_pages``); anything else is an error."""
    if mode == "range":
        return split_ranges(pages, parse_ranges(ranges), page)
    if mode != "pages":
        raise InvalidRange(f"there is no mode {mode} of splitting")
    if wanted is None:
        raise InvalidRange("splitting by pages needs pages")
    return split_pages(pages, normalise_pages(wanted), page)


def extract_pages(pages: DataFrame, wanted: list[int], page: str = "page") -> DataFrame:
    """The wanted pages as one output: each once, in order (``new_page``)."""
    kept = sorted(set(wanted))
    return pages.where(F.col(page).isin(kept)).withColumn("new_page", F.array_position(F.array(*map(F.lit, kept)), F.col(page)).cast("int"))


def extract_ranges(pages: DataFrame, ranges: list[tuple[int, int]], page: str = "page") -> DataFrame:
    """All ranges as one output; overlaps collapse and the order of the ranges is lost."""
    return extract_pages(pages, sorted({p for a, b in ranges for p in range(a, b + 1)}), page)


def split_points(pages: DataFrame, points: list[int], page: str = "page") -> DataFrame:
    """``part`` counts the points (2 and above) up to a page: a part begins at each point."""
    wanted = sorted(set(points))
    if any(p < 2 for p in wanted):
        raise InvalidRange("a split point is 2 at least")
    part = sum(((F.col(page) >= p).cast("int") for p in wanted), F.lit(0))
    return pages.withColumn("part", part)


def split_every(pages: DataFrame, n: int, page: str = "page") -> DataFrame:
    """Parts of ``n`` pages; the last one may be shorter."""
    if n < 1:
        raise InvalidRange("a part has 1 page at least")
    return pages.withColumn("part", F.floor((F.col(page) - 1) / n).cast("int"))


def split_all(pages: DataFrame, page: str = "page") -> DataFrame:
    return pages.withColumn("part", F.col(page) - 1)


def select_pages(pages: DataFrame, wanted: list[int], page: str = "page_no") -> DataFrame:
    """Pages (0-based) in the order wanted, repeated where they are wanted twice; ``seq`` numbers them."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("seq"), F.lit(p).alias("p")) for i, p in enumerate(wanted))))
    return pages.withColumn("_w", each).where(F.col(page) == F.col("_w.p")).select(*pages.columns, "_w.seq")


def merge_pages(pages: DataFrame, group: str, order: str, page: str = "page") -> DataFrame:
    """Pages of the inputs of each group, one input behind the other: ``new_page`` and ``offset`` (pages before the input).

    Offsets are summed over inputs, not pages; an output has as many inputs as its group, which is what a merge is given.
    """
    sizes = pages.groupBy(group, order).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(group, order, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy(group, order).orderBy(page))
    return pages.join(offsets, [group, order]).withColumn("new_page", F.col("offset") + rank)
