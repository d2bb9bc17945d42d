"""Footnotes and comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ANNOTATION_ROLES, footnote_body, has_role
from .layout import PAGE, has_text, overlaps


def match_footnotes(markers: DataFrame, bodies: DataFrame) -> DataFrame:
    """Each footnote's body and its marker, one to one.

    ``markers`` and ``bodies`` have ``doc_id, page_no, seq, marker`` (the normalised marker). On its page, the k-th body of
    a marker takes the k-th place where it stands; bodies beyond those take what is left on the page before. Ids count
    matched bodies of a document from 2. Rows without a marker match nothing.
    """
    key = ["doc_id", "marker"]
    of_page = Window.partitionBy(*key, "page_no").orderBy("seq")
    m = markers.where(F.col("marker").isNotNull()).select(*key, "page_no", F.col("seq").alias("marker_seq"), F.row_number().over(of_page).alias("k"))
    b = bodies.where(F.col("marker").isNotNull()).select(*key, "page_no", "seq", F.row_number().over(of_page).alias("k"))
    n = m.groupBy(*key, "page_no").agg(F.count("*").alias("n"))
    c = b.groupBy(*key, "page_no").agg(F.count("*").alias("c"))
    before = n.join(c, [*key, "page_no"], "left").select(*key, (F.col("page_no") + 1).alias("page_no"), F.least("n", F.coalesce("c", F.lit(0))).alias("used"), F.col("n").alias("n_before"))
    b = b.join(n, [*key, "page_no"], "left").join(before, [*key, "page_no"], "left")
    here = F.col("k") <= F.coalesce("n", F.lit(0))
    want = b.select(*key, F.col("page_no").alias("body_page"), "seq", F.when(here, F.col("page_no")).otherwise(F.col("page_no") - 1).alias("page_no"), F.when(here, F.col("k")).otherwise(F.col("k") - F.coalesce("n", F.lit(0)) + F.coalesce("used", F.lit(0))).alias("k"))
    found = want.join(m, [*key, "page_no", "k"])
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("body_page", "seq")) + 1
    return found.select("doc_id", "marker", "body_page", "seq", F.col("page_no").alias("marker_page"), "marker_seq", number.alias("footnote_id"))


def footnote_bodies(paragraphs: DataFrame, pages: DataFrame) -> DataFrame:
    """Paragraphs that may be a footnote's text: ``doc_id, page_no, seq, marker, prefix``.

    They are no list items, stand within 72 points or 15 % of the page above the bottom margin, their runs have 12.5 points
    at most on average, and they begin with a marker. ``paragraphs`` have ``para_idx, text, runs, number_id`` and edges;
    ``pages`` are as ``folds.section_pages`` gives them.
    """
    size = F.expr("aggregate(filter(runs, r -> r.font_size > 0), cast(0 as double), (a, r) -> a + r.font_size) / nullif(size(filter(runs, r -> r.font_size > 0)), 0)")
    low = F.col("y_top") <= F.col("margin_bottom") + F.greatest(F.lit(72.0), F.col("height") * 0.15)
    shown = paragraphs.where(F.col("number_id").isNull() & (F.col("y_top") > F.col("y_bottom"))).join(pages.select(*PAGE, "height", "margin_bottom"), PAGE)
    found = shown.where(low & (F.coalesce(size, F.lit(0.0)) <= 12.5)).withColumn("note", footnote_body(F.col("text"))).where(F.col("note").isNotNull())
    return found.select(*PAGE, F.col("para_idx").alias("seq"), "note.marker", "note.prefix")


def annotation_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks whose role is that of an annotation, as annotations: ``annot_idx`` counts on from the page's blocks."""
    return blocks.where(has_role(F.col("block_role"), ANNOTATION_ROLES)).select(*PAGE, F.col("block_idx").alias("annot_idx"), "text", F.lit(None).cast("string").alias("author"), "x_left", "y_bottom", "x_right", "y_top")


def match_comments(annotations: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """The paragraph of each annotation with text: the one that it covers most, a tenth at least; ids from 0 in order of pages and annotations.

    ``annotations`` have ``b_``-boxes and ``annot_idx``; the score is relative to the paragraph; of equals the first
    paragraph. A paragraph may have several comments.
    """
    shown = annotations.where(has_text(F.col("text"))).drop("text")
    both = overlaps(paragraphs, shown, ["doc_id", "page_no", "para_idx"], "annot_idx", 0.1)
    best = both.groupBy("doc_id", "page_no", "annot_idx").agg(F.min(F.struct((-F.col("score")).alias("s"), "para_idx")).alias("b"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no", "annot_idx")) - 1
    return best.select("doc_id", "page_no", "annot_idx", F.col("b.para_idx").alias("para_idx"), number.alias("comment_id"))
