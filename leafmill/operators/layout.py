"""Layout of pages from positioned blocks, set-wise.

Blocks have ``doc_id, page_no, block_idx, text, x_left, y_bottom, x_right, y_top`` and more; pages ``doc_id, page_no, width,
height``. Reading order is top down, then from the left, then ``block_idx``. Records that are there twice are removed
by ``once`` before. Blocks without a box or a page take no part in what needs them; their results are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.text import EQUATION_ROLES, has_role, list_marker, strip

PAGE = ["doc_id", "page_no"]
BLOCK = [*PAGE, "block_idx"]


def reading(*before: str) -> list[Column]:
    """Reading order as sort columns."""
    return [*(F.col(c) for c in before), F.col("y_top").desc_nulls_last(), F.col("x_left").asc_nulls_last(), F.col("block_idx").asc_nulls_last()]


def once(df: DataFrame, keys: list[str]) -> DataFrame:
    """Each record once: those that are there twice differ in nothing but when they came."""
    return df.dropDuplicates(keys)


def has_text(text: Column) -> Column:
    return F.coalesce(strip(text) != "", F.lit(False))


def page_margins(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """The four margins of every page from its outermost blocks with text; each 12 at least and half the page at most, 72 without blocks."""
    box = blocks.where(has_text(F.col("text"))).groupBy(*PAGE).agg(F.min("x_left").alias("l"), F.max("x_right").alias("r"), F.max("y_top").alias("t"), F.min("y_bottom").alias("b"))
    fit = lambda x, most: F.coalesce(F.greatest(F.lit(12.0), F.least(x, most / 2)), F.lit(72.0))
    known = lambda edge, x: F.when(F.col(edge).isNotNull(), x)
    w, h = F.col("width"), F.col("height")
    return pages.join(box, PAGE, "left").select(
        *PAGE,
        "width",
        "height",
        fit(known("l", F.col("l")), w).alias("margin_left"),
        fit(known("r", w - F.col("r")), w).alias("margin_right"),
        fit(known("t", h - F.col("t")), h).alias("margin_top"),
        fit(known("b", F.col("b")), h).alias("margin_bottom"),
    )


def page_columns(blocks: DataFrame) -> DataFrame:
    """Columns of every page with blocks, 3 at most, and the gap between them, from the gaps of sorted left edges."""
    order = Window.partitionBy(*PAGE).orderBy("x_left", "block_idx")
    gaps = blocks.where(has_text(F.col("text")) & F.col("x_left").isNotNull()).select(*PAGE, (F.col("x_left") - F.lag("x_left").over(order)).alias("gap"))
    gaps = gaps.withColumn("mean", F.avg("gap").over(Window.partitionBy(*PAGE)))
    large = F.col("gap") > 2 * F.col("mean")
    out = gaps.groupBy(*PAGE).agg(F.count("*").alias("n"), F.sum(F.when(large, 1).otherwise(0)).alias("wide"), F.min(F.when(large, F.col("gap"))).alias("least"))
    few = (F.col("n") < 4) | (F.col("wide") == 0)
    return out.select(*PAGE, F.when(few, 1).otherwise(F.least(F.col("wide") + 1, F.lit(3))).cast("int").alias("columns"), F.when(~few, F.col("least")).alias("spacing"))


def placed(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks with their page's margins, columns and spacing, and ``seq``: their place in the document's reading order."""
    both = page_margins(blocks, pages).join(page_columns(blocks), PAGE, "left")
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy(*reading("page_no")))
    return blocks.join(both, PAGE).withColumn("seq", seq)


def block_formats(shown: DataFrame) -> DataFrame:
    """Column, alignment, indent and line spacing of every block on a page (``shown`` as ``placed`` gives them)."""
    c = F.col
    return shown.select(
        *BLOCK,
        geometry.column_of(c("x_left"), c("width"), c("margin_left"), c("margin_right"), F.coalesce("columns", F.lit(1)), c("spacing")).alias("column_no"),
        geometry.alignment(c("x_left"), c("x_right"), c("width"), c("margin_left"), c("margin_right")).alias("alignment"),
        geometry.indent(c("x_left"), c("margin_left")).alias("indent"),
        geometry.line_spacing(geometry.extent(c("y_bottom"), c("y_top")), c("font_size")).alias("line_spacing"),
    )


def heading_styles(blocks: DataFrame) -> DataFrame:
    """The style of every block that begins a paragraph: list item, by role, or by its size against the mean of all earlier ones' in the document."""
    order = Window.partitionBy("doc_id").orderBy(*reading("page_no"))
    mean = F.coalesce(F.avg("font_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("font_size"))
    role, ratio = F.upper("block_role"), F.col("font_size") / F.col("mean")
    style = (
        F.when(list_marker(F.col("text"), F.col("block_role")).isNotNull(), "ListParagraph")
        .when(role.rlike(r"^H\d+$"), F.concat(F.lit("Heading"), F.substring(role, 2, 9)))
        .when(role == "TITLE", "Title")
        .when(role == "SUBTITLE", "Subtitle")
        .when(role.isin("QUOTE", "BLOCKQUOTE"), "Quote")
        .when(role.isin("CODE", "PRE"), "Code")
        .when(role == "CAPTION", "Caption")
        .when(ratio >= 1.8, "Heading1")
        .when(ratio >= 1.5, "Heading2")
        .when(ratio >= 1.3, "Heading3")
    )
    return blocks.where(has_text(F.col("text"))).withColumn("mean", mean).select(*BLOCK, style.alias("style"))


def block_spacing(blocks: DataFrame) -> DataFrame:
    """Space before and after every block against its neighbours on the page; null where it is no more than half a line.

    After the last block of a page 0.6 of a line counts.
    """
    order = Window.partitionBy(*PAGE).orderBy(*reading())
    size = F.coalesce("font_size", F.lag("font_size").over(order), F.lit(12.0))
    before = F.lag("y_bottom").over(order) - F.col("y_top")
    after = F.col("y_bottom") - F.lead("y_top").over(order)
    last = F.lead("block_idx").over(order).isNull()
    line = F.coalesce("font_size", F.lit(12.0))
    return blocks.select(*BLOCK, F.when(before > 0.5 * size, before).alias("space_before"), F.when(last, 0.6 * line).when(after > 0.5 * line, after).alias("space_after"))


def breaks(shown: DataFrame) -> DataFrame:
    """From blocks as ``placed`` gives them: whether a block begins a page behind the first one of its document, and whether a column behind the first of its page."""
    shown = shown.where(has_text(F.col("text")))
    c = F.col
    shown = shown.withColumn("col", geometry.column_of(c("x_left"), c("width"), c("margin_left"), c("margin_right"), F.coalesce("columns", F.lit(1)), c("spacing")))
    first = F.row_number().over(Window.partitionBy(*PAGE).orderBy("seq")) == 1
    start = F.min("page_no").over(Window.partitionBy("doc_id"))
    first_of_column = F.row_number().over(Window.partitionBy(*PAGE, "col").orderBy("seq")) == 1
    return shown.select(*BLOCK, (first & (c("page_no") > start)).alias("page_break"), (first_of_column & ~first).alias("column_break"))


def edge_clusters(df: DataFrame, keys: list[str], edge: str, tolerance: float = 1.0) -> DataFrame:
    """Clusters of a page's edges: a new one where the gap to the edge before exceeds the tolerance; its centre and size."""
    order = Window.partitionBy(*keys).orderBy(edge)
    each = df.where(F.col(edge).isNotNull()).groupBy(*keys, edge).agg(F.count("*").alias("here"))
    marked = each.withColumn("new", F.when(F.col(edge) - F.lag(edge).over(order) <= tolerance, 0).otherwise(1))
    numbered = marked.withColumn("cluster_no", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return numbered.groupBy(*keys, "cluster_no").agg((F.sum(F.col(edge) * F.col("here")) / F.sum("here")).alias("centre"), F.sum("here").alias("n"))


def roles_to_blocks(roles: DataFrame, blocks: DataFrame) -> DataFrame:
    """The k-th role of a page (``role_idx``, ``role``) for its k-th block in reading order; blocks beyond the roles have none."""
    k = F.row_number().over(Window.partitionBy(*PAGE).orderBy(*reading()))
    r = F.row_number().over(Window.partitionBy(*PAGE).orderBy("role_idx"))
    numbered = roles.select(*PAGE, "role", r.alias("k"))
    return blocks.withColumn("k", k).join(numbered, [*PAGE, "k"], "left").select(*BLOCK, "role")


def chained_roles(of_page: DataFrame, of_file: DataFrame) -> DataFrame:
    """Roles for each page (``role_idx, role``): its own, then those of the whole file (``doc_id, role_idx, role``), which each page without enough goes through."""
    own = of_page.select(*PAGE, F.lit(0).alias("source"), "role_idx", "role")
    pages = of_page.select(*PAGE).distinct()
    both = own.unionByName(pages.join(of_file.select("doc_id", F.lit(1).alias("source"), "role_idx", "role"), "doc_id"))
    k = F.row_number().over(Window.partitionBy(*PAGE).orderBy("source", "role_idx")) - 1
    return both.select(*PAGE, k.alias("role_idx"), "role")


def equation_lines(blocks: DataFrame, lines: DataFrame, least: float = 0.5) -> DataFrame:
    """The lines that cover ``least`` of an equation's block at least: ``lines``, their numbers in order. A line without an area covers nothing.

    ``lines`` have ``line_idx, x0, y0, x1, y1``; blocks without such lines have no row.
    """
    edges = [F.least("x0", "x1").alias("b_x_left"), F.least("y0", "y1").alias("b_y_bottom"), F.greatest("x0", "x1").alias("b_x_right"), F.greatest("y0", "y1").alias("b_y_top")]
    both = overlaps(blocks.where(has_role(F.col("block_role"), EQUATION_ROLES)), lines.select(*PAGE, "line_idx", *edges), BLOCK, "line_idx", 0.0)
    return both.where(F.col("score") >= least).groupBy(*BLOCK).agg(F.array_sort(F.collect_list("line_idx")).alias("lines"))


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(prefix + c) for c in ("x_left", "y_bottom", "x_right", "y_top"))


def overlaps(blocks: DataFrame, boxes: DataFrame, keys: list[str], box_key: str, least: float) -> DataFrame:
    """Pairs of blocks and boxes of their page (columns with the prefix ``b_``) that cover more than ``least`` of the block, as ``score``."""
    area = F.greatest(geometry.extent(F.col("x_left"), F.col("x_right")) * geometry.extent(F.col("y_bottom"), F.col("y_top")), F.lit(1.0))
    score = geometry.overlap(box(), box("b_")) / area
    edges = ["x_left", "y_bottom", "x_right", "y_top"]
    both = blocks.select(*keys, *edges).dropna(subset=edges).join(boxes.dropna(subset=[f"b_{e}" for e in edges]), PAGE).withColumn("score", score).where(F.col("score") > least)
    return both.select(*keys, box_key, "score")


def best_overlap(blocks: DataFrame, boxes: DataFrame, keys: list[str], box_key: str, least: float) -> DataFrame:
    """For each block the box of its page that covers most of it, beyond ``least``; the first one of equals.

    A page's boxes are compared with its blocks only.
    """
    best = overlaps(blocks, boxes, keys, box_key, least).groupBy(*keys).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(box_key))).alias("best"))
    return best.select(*keys, F.col(f"best.{box_key}").alias(box_key), (-F.col("best.s")).alias("score"))


def backgrounds(blocks: DataFrame, rectangles: DataFrame, tolerance: float = 4.0, least_alpha: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Blocks that lie in a filled rectangle with the first one's colour, and the rectangles that hold no block."""
    filled = rectangles.where(F.col("fill").isNotNull() & (F.col("alpha") > least_alpha))
    inside = blocks.where(F.col("text") != "").join(filled, PAGE).where(geometry.contains(box("b_"), box(), tolerance))
    colour = inside.groupBy(*BLOCK).agg(F.min(F.struct("path_idx", "fill", "alpha")).alias("p")).select(*BLOCK, "p.path_idx", F.col("p.fill").alias("background"), F.when(F.col("p.alpha") < 1, F.col("p.alpha")).alias("path_opacity"))
    return colour, rectangles.join(inside.select(*PAGE, "path_idx").distinct(), [*PAGE, "path_idx"], "left_anti")


def anchor_targets(targets: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """The paragraph of every destination (``anchor``, page and ``top``): the first one on the page whose box, a quarter of its height or 12 points wider, holds it.

    A destination without a top takes the page's first paragraph; an anchor stands once.
    """
    height = geometry.extent(F.col("y_bottom"), F.col("y_top"))
    slack = F.greatest(height * 0.25, F.lit(12.0))
    holds = F.col("top").isNull() | F.col("top").between(F.col("y_bottom") - slack, F.col("y_top") + slack)
    both = targets.join(paragraphs, PAGE).where(holds)
    return both.groupBy("doc_id", "anchor").agg(F.min(F.struct("page_no", "para_idx")).alias("p")).select("doc_id", "anchor", "p.page_no", "p.para_idx")
