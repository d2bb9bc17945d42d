"""What repeats over the pages of a document: headers, footers, watermarks, payloads and link targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import signature, strip
from .layout import PAGE, has_text


def region_items(items: DataFrame, pages: DataFrame, footer: bool, idx: str = "block_idx", depth: int = 3, reach: float = 24.0) -> DataFrame:
    """Paragraphs (or blocks) within the section's margin and ``reach`` of a page's edge, the ``depth`` outermost, with their rank and signature.

    ``pages`` are as ``folds.section_pages`` gives them. Items that reach over a page (``end_page``, where it is there) don't count.
    """
    more = ["end_page"] if "end_page" in items.columns else []
    shown = items.where(has_text(F.col("text"))).select(*PAGE, idx, "text", "x_left", "y_bottom", "y_top", *more).join(pages.select(*PAGE, "section_no", "height", "margin_top", "margin_bottom"), PAGE)
    if more:
        shown = shown.where(F.col("end_page") == F.col("page_no"))
    near = F.col("y_bottom") <= F.col("margin_bottom") + reach if footer else F.col("height") - F.col("y_top") <= F.col("margin_top") + reach
    order = [F.col("y_bottom") if footer else F.col("y_top").desc(), F.col("x_left"), F.col(idx)]
    rank = F.row_number().over(Window.partitionBy(*PAGE).orderBy(*order))
    return shown.where(near).select(*PAGE, "section_no", idx, "text", rank.alias("rank"), signature(F.col("text"), footer).alias("signature")).where(F.col("rank") <= depth)


def _of_pages(each: DataFrame) -> DataFrame:
    """The signature of each page: those of its items, the outermost first."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "signature")))
    return each.groupBy("doc_id", "section_no", "page_no").agg(F.concat_ws("\n", F.transform(ordered, lambda x: x["signature"])).alias("signature"))


def repeating_regions(items: DataFrame, pages: DataFrame, footer: bool, idx: str = "block_idx", depth: int = 3) -> DataFrame:
    """The running header or footer of every section: the signature that most pages share, two at least; of equals the one seen first.

    ``first_variant`` is the section's first page if that has a header or footer of its own, else null.
    """
    of_page = _of_pages(region_items(items, pages, footer, idx, depth))
    counted = of_page.groupBy("doc_id", "section_no", "signature").agg(F.count("*").alias("pages"), F.min("page_no").alias("first_page")).where(F.col("pages") >= 2)
    best = counted.groupBy("doc_id", "section_no").agg(F.min(F.struct((-F.col("pages")).alias("n"), "first_page", "signature")).alias("b"))
    found = best.select("doc_id", "section_no", F.col("b.signature").alias("signature"), (-F.col("b.n")).alias("pages"), F.col("b.first_page").alias("first_page"))
    opening = pages.select("doc_id", "section_no", F.col("first_page").alias("page_no")).distinct()
    own = of_page.join(opening, ["doc_id", "section_no", "page_no"]).select("doc_id", "section_no", F.col("page_no").alias("opening"), F.col("signature").alias("other"))
    variant = F.when(F.col("other") != F.col("signature"), F.col("opening"))
    return found.join(own, ["doc_id", "section_no"], "left").select(*found.columns, variant.alias("first_variant"))


def region_members(items: DataFrame, pages: DataFrame, found: DataFrame, footer: bool, idx: str = "block_idx", depth: int = 3) -> DataFrame:
    """The items that make the headers (or footers) that ``found`` lists, with their section: on all pages that match, and on first pages of their own kind.

    ``variant`` is ``default`` or ``first`` on the page whose items are shown for all, else null.
    """
    each = region_items(items, pages, footer, idx, depth)
    listed = found.select("doc_id", "section_no", F.col("signature").alias("wanted"), F.col("first_page"), F.col("first_variant"))
    of_page = _of_pages(each).join(listed, ["doc_id", "section_no"]).where((F.col("signature") == F.col("wanted")) | (F.col("page_no") == F.col("first_variant")))
    variant = F.when(F.col("page_no") == F.col("first_variant"), "first").when(F.col("page_no") == F.col("first_page"), "default")
    return each.select(*PAGE, idx, "rank", "text").join(of_page.select(*PAGE, "section_no", variant.alias("variant")), PAGE)


def region_texts(members: DataFrame) -> DataFrame:
    """``doc_id, section_no, variant, texts``: what the headers (or footers) of ``region_members`` show, the outermost first."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return members.where(F.col("variant").isNotNull()).groupBy("doc_id", "section_no", "variant").agg(F.transform(ordered, lambda x: x["text"]).alias("texts"))


def watermarks(blocks: DataFrame, pages: DataFrame, share: float = 0.8) -> DataFrame:
    """Texts at the same place in the middle of most pages: of two pages at least, and ``share`` of the document's."""
    at = lambda low, high, size: (F.col(low) + F.col(high)) / 2 / F.col(size)
    x, y = at("x_left", "x_right", "width"), at("y_bottom", "y_top", "height")
    shown = blocks.where(has_text(F.col("text")) & (F.col("opacity").isNull() | (F.col("opacity") <= 0.8))).join(pages, PAGE).where(x.between(0.2, 0.8) & y.between(0.2, 0.8))
    size = pages.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    found = shown.groupBy("doc_id", strip(F.col("text")).alias("text"), F.bround(x * 100).cast("int").alias("x_percent"), F.bround(y * 100).cast("int").alias("y_percent")).agg(F.countDistinct("page_no").alias("pages"))
    return found.join(size, "doc_id").where(F.col("pages") >= F.greatest(F.lit(2), F.floor(F.col("n") * share))).drop("n")


def first_payloads(df: DataFrame, key: str, data: str) -> DataFrame:
    """Each distinct payload once: its SHA-256, the first key that has it, and how many do."""
    return df.where(F.col(data).isNotNull()).groupBy(F.sha2(F.col(data), 256).alias("digest")).agg(F.min(key).alias(key), F.count("*").alias("copies"))


def link_relations(df: DataFrame, order: list[str], target: str = "target", first_id: int = 3) -> DataFrame:
    """Each link target of a document once, numbered by where it stands first: ``rId3`` and on."""
    first = df.where(F.col(target).isNotNull() & (F.col(target) != "")).groupBy("doc_id", target).agg(F.min(F.struct(*order)).alias("at"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("at", target))
    return first.select("doc_id", target, F.concat(F.lit("rId"), (number + first_id - 1).cast("string")).alias("relation_id"))
