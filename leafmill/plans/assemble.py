"""From positioned blocks to documents: sections, paragraphs, tables and pictures in reading order, and what belongs to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import forms, geometry, media
from ..functions.text import anchor_name, list_marker
from ..operators import folds, layout, notes, regions, stats
from ..session import staged
from ..sources import docx, pdf

BLOCK, PAGE = layout.BLOCK, layout.PAGE
PARAGRAPH = [*PAGE, "para_idx"]
EDGES = ["x_left", "y_bottom", "x_right", "y_top"]
_RUN = "struct<text: string, break_type: string, font_name: string, font_size: double, bold: boolean, italic: boolean, underline: boolean, language: string, hyperlink_target: string>"
_WANTED = {"font_name": "string", "font_size": "double", "block_role": "string", "bold": "boolean", "italic": "boolean", "underline": "boolean", "rtl": "boolean", "language": "string", "vertical": "boolean", "opacity": "double", "background_color": "string"}
_MEASURES = ["width", "height", "margin_left", "margin_right", "margin_top", "margin_bottom", "columns", "spacing"]


def _complete(blocks: DataFrame) -> DataFrame:
    """Blocks with all columns that the steps below read; those that are missing are null."""
    return blocks.select(*BLOCK, "text", *EDGES, *(F.col(c) if c in blocks.columns else F.lit(None).cast(k).alias(c) for c, k in _WANTED.items()))


def place(rank: int, idx: str) -> Column:
    """Reading order of a page's elements: top down, from the left, text before others."""
    return F.array(*(x.cast("double") for x in (F.col("page_no"), -F.col("y_top"), F.col("x_left"), F.lit(rank), F.col(idx)))).alias("place")


def boxes(df: DataFrame, *more: str) -> DataFrame:
    """Rows with their edges under the prefix that matching expects."""
    return df.select(*PAGE, *more, *(F.col(c).alias(f"b_{c}") for c in EDGES))


def _paragraphs(blocks: DataFrame, placed: DataFrame, sections: DataFrame, links: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Paragraphs of all blocks outside tables, and their list levels."""
    cont = staged(folds.continuations(blocks, sections), "continuations")
    begins = placed.join(cont.where("new_paragraph").select(*BLOCK), BLOCK)
    levels = staged(folds.list_levels(placed), "levels")
    marker = list_marker(F.col("text"), F.col("block_role"))
    shown = placed.select(*BLOCK, "section_no", "seq", F.coalesce(marker["rest"], F.col("text")).alias("text"), *(c for c in _WANTED if c not in ("block_role", "vertical")), *EDGES, marker["punctuation"].alias("punctuation"))
    if links is not None:
        hit = layout.best_overlap(blocks, boxes(links, "link_idx", "target"), BLOCK, "link_idx", 0.05)
        shown = shown.join(hit.join(links.select(*PAGE, "link_idx", "target"), [*PAGE, "link_idx"]).select(*BLOCK, "target"), BLOCK, "left")
    else:
        shown = shown.withColumn("target", F.lit(None).cast("string"))
    of_block = (
        shown.join(cont, BLOCK)
        .join(layout.heading_styles(begins), BLOCK, "left")
        .join(layout.block_formats(placed).select(*BLOCK, "alignment", "indent", "line_spacing"), BLOCK, "left")
        .join(layout.block_spacing(blocks), BLOCK, "left")
        .join(layout.breaks(placed), BLOCK, "left")
        .join(levels.select(*BLOCK, F.col("kind"), F.col("format"), F.col("level")), BLOCK, "left")
    )
    none = F.lit(None).cast("string")
    run = F.struct("text", none.alias("break_type"), "font_name", "font_size", "bold", "italic", "underline", "language", F.col("target").alias("hyperlink_target")).cast(_RUN)
    first = ["page_no", "section_no", "block_idx", "style", "alignment", "indent", "line_spacing", "space_before", "page_break", "column_break", "kind", "format", "punctuation", "level"]
    item = F.struct("seq", run.alias("run"), *first, "space_after", "background_color", F.struct(*EDGES).alias("box"))
    grouped = of_block.groupBy("doc_id", "paragraph_no").agg(
        F.array_sort(F.collect_list(item)).alias("items"), F.min("x_left").alias("x_left"), F.min("y_bottom").alias("y_bottom"), F.max("x_right").alias("x_right"), F.max("y_top").alias("y_top"),
        F.min("opacity").alias("opacity"), F.bool_or(F.coalesce("rtl", F.lit(False))).alias("rtl"),
    )
    head, last, size = F.element_at("items", 1), F.element_at("items", -1), F.size("items")
    spaced = F.transform("items", lambda x, i: x["run"].withField("text", F.when((i + 1 < size) & ~x["run"]["text"].endswith(" "), F.concat(x["run"]["text"], F.lit(" "))).otherwise(x["run"]["text"])))
    order = F.array(*(x.cast("double") for x in (head["page_no"], -head["box"]["y_top"], head["box"]["x_left"], F.lit(0), head["block_idx"])))
    out = grouped.select(
        "doc_id", (F.col("paragraph_no") - 1).alias("para_idx"), order.alias("place"), spaced.alias("runs"),
        *(head[c].alias(c) for c in first if c not in ("block_idx", "kind", "format", "punctuation")),
        last["page_no"].alias("end_page"), last["space_after"].alias("space_after"),
        F.get(F.filter(F.transform("items", lambda x: x["background_color"]), lambda x: x.isNotNull()), 0).alias("background_color"),
        F.when(head["kind"].isNotNull(), folds.numbering_id(head["kind"], head["format"], head["punctuation"])).alias("number_id"),
        *EDGES, "opacity", "rtl",
    )
    return out.withColumn("text", stats.run_text(F.col("runs"))), levels


def build(blocks: DataFrame, pages: DataFrame, links: DataFrame | None = None, lines: DataFrame | None = None, images: DataFrame | None = None, annotations: DataFrame | None = None, outline: DataFrame | None = None, fields: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of a document: ``paragraphs``, ``tables``, ``pictures``, ``sections``, ``pages``, ``edges``, ``watermarks``, ``list_levels``, ``comments``, ``statistics``.

    What several steps read is written once to the shared folder. Blocks of tables are no paragraphs; running headers and
    footers leave the body and are in ``edges``. ``links`` have ``link_idx, uri, anchor``, ``images`` ``image_idx, data,
    mime_type``, ``annotations`` ``annot_idx, text, author``, ``outline`` ``node_id, parent_id, ord, title, page_no, top``,
    ``fields`` what PDF files hold of forms, each of which becomes a table of its label and value; all but the outline have edges. A link to an anchor is kept if the outline or another link says where that is.
    """
    blocks, pages = staged(_complete(blocks), "blocks"), staged(pages.select(*PAGE, "width", "height"), "pages")
    sections = staged(folds.section_pages(blocks, pages), "sections")
    cells = staged(folds.detect_tables(blocks, lines), "cells")
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy(*layout.reading("page_no")))
    every = blocks.join(sections.select(*PAGE, "section_no", *_MEASURES), PAGE).withColumn("seq", seq)
    placed = staged(every.join(cells.select(*BLOCK), BLOCK, "left_anti"), "placed")
    free = blocks.join(cells.select(*BLOCK), BLOCK, "left_anti")
    targets = None
    if links is not None:
        anchor = anchor_name(F.col("anchor")) if "anchor" in links.columns else F.lit(None).cast("string")
        links = links.withColumn("target", F.coalesce("uri", F.concat(F.lit("#"), anchor))).where(F.col("target").isNotNull())
        if {"anchor", "destination_page", "destination_top"} <= set(links.columns):
            targets = links.where(F.col("uri").isNull()).select("doc_id", anchor.alias("anchor"), F.col("destination_page").alias("page_no"), F.col("destination_top").alias("top"))
    paragraphs, levels = _paragraphs(free, placed, sections, links)
    paragraphs = staged(paragraphs, "paragraphs")
    edges, kept = [], paragraphs
    for kind, footer in (("header", False), ("footer", True)):
        found = staged(regions.repeating_regions(paragraphs, sections, footer, "para_idx"), kind)
        members = staged(regions.region_members(paragraphs, sections, found, footer, "para_idx"), f"{kind}-members")
        edges.append(regions.region_texts(members).withColumn("kind", F.lit(kind)))
        kept = kept.join(members.select("doc_id", "para_idx"), ["doc_id", "para_idx"], "left_anti")
    toc = None
    if outline is not None:
        rows = folds.flatten_outline(outline)
        at = rows.join(outline.select("doc_id", "node_id", "page_no", "top"), ["doc_id", "node_id"])
        named = staged(at.withColumn("anchor", F.concat(F.lit("toc_"), F.col("node_id").cast("string"))), "outline")
        of_outline = named.where(F.col("page_no").isNotNull()).select("doc_id", "anchor", "page_no", "top")
        targets = of_outline if targets is None else targets.unionByName(of_outline)
        toc = named
    if targets is not None:
        hits = staged(layout.anchor_targets(targets, kept.select(*PARAGRAPH, *EDGES)), "anchors")
        kept = kept.join(hits.groupBy("doc_id", "para_idx").agg(F.array_sort(F.collect_set("anchor")).alias("bookmarks")), ["doc_id", "para_idx"], "left")
        if toc is not None:
            linked = toc.join(hits.select("doc_id", "anchor", F.lit(True).alias("hit")), ["doc_id", "anchor"], "left")
            order = F.concat(F.array(F.lit(-0.5)), F.transform("path", lambda x: x.cast("double")))
            run = F.struct(F.coalesce("title", F.lit("")).alias("text"), *(F.lit(None).alias(c) for c in ("break_type", "font_name", "font_size", "bold", "italic", "underline", "language")), F.when(F.col("hit"), F.concat(F.lit("#"), F.col("anchor"))).alias("hyperlink_target")).cast(_RUN)
            first = sections.groupBy("doc_id").agg(F.min("page_no").alias("page_no"), F.min("section_no").alias("section_no"))
            entries = linked.drop("page_no").join(first, "doc_id").select("doc_id", "page_no", "section_no", order.alias("place"), F.array(run).alias("runs"), "style", F.col("title").alias("text"))
            kept = kept.unionByName(entries, allowMissingColumns=True)
    comments = None
    if annotations is not None:
        matched = notes.match_comments(boxes(annotations, "annot_idx", "text"), paragraphs.select(*PARAGRAPH, *EDGES))
        comments = matched.join(annotations.select(*PAGE, "annot_idx", "text", "author"), [*PAGE, "annot_idx"])
        listed = F.transform(F.array_sort(F.collect_list(F.struct("comment_id", "author", "text"))), lambda x: F.struct(x["author"].alias("author"), x["text"].alias("text")))
        kept = kept.join(comments.groupBy("doc_id", "para_idx").agg(listed.alias("comments")), ["doc_id", "para_idx"], "left")
    kept = staged(kept, "body")
    of_cell = cells.join(blocks.select(*BLOCK, *EDGES), BLOCK).join(sections.select(*PAGE, "section_no"), PAGE)
    aligned = of_cell.withColumn("alignment", F.when(F.col("header"), "center").otherwise(geometry.cell_alignment(F.col("text"))))
    cell = F.struct("row_no", "column_no", "block_idx", "row_span", "column_span", "header", "header_row", "text", "alignment", F.lit(None).cast("double").alias("share"))
    tables = aligned.groupBy(*PAGE, "section_no", "table_no").agg(F.max("y_top").alias("y_top"), F.min("x_left").alias("x_left"), F.array_sort(F.collect_list(cell)).alias("cells")).withColumn("place", place(1, "table_no"))
    tables = tables.select("doc_id", "page_no", "section_no", "place", "cells")
    if fields is not None:
        label = forms.field_label(F.col("label"), F.col("name"), F.col("field_type"))
        value = F.array_join(forms.field_value(F.col("field_type"), F.col("value"), F.col("checked"), F.col("options"), F.col("label"), F.col("tooltip")), "\n")
        no, one = F.lit(0), F.lit(1)
        half = lambda k, t, share: F.struct(no.alias("row_no"), F.lit(k).alias("column_no"), no.alias("block_idx"), one.alias("row_span"), one.alias("column_span"), F.lit(False).alias("header"), F.lit(False).alias("header_row"), t.alias("text"), F.lit(None).cast("string").alias("alignment"), F.lit(share).alias("share"))
        both = F.array(half(0, label, forms.LABEL_SHARE), half(1, value, 1 - forms.LABEL_SHARE)).alias("cells")
        tables = tables.unionByName(fields.join(sections.select(*PAGE, "section_no"), PAGE).select("doc_id", "page_no", "section_no", place(2, "field_idx"), both))
    pictures = None
    if images is not None:
        image = F.struct("data", media.mime_type(F.col("data"), F.col("mime_type")).alias("mime_type"), (F.col("x_right") - F.col("x_left")).alias("width"), (F.col("y_top") - F.col("y_bottom")).alias("height")).alias("image")
        pictures = images.where(F.col("data").isNotNull()).join(sections.select(*PAGE, "section_no"), PAGE).select("doc_id", "page_no", "section_no", place(3, "image_idx"), image)
    texts = kept.select("doc_id", "text").unionByName(cells.select("doc_id", "text"))
    return {
        "paragraphs": kept,
        "tables": tables,
        "pictures": pictures,
        "pages": pages,
        "sections": sections.select("doc_id", "section_no", *_MEASURES).distinct(),
        "page_sections": sections.select(*PAGE, "section_no", "first_page"),
        "edges": edges[0].unionByName(edges[1]),
        "watermarks": regions.watermarks(free, pages),
        "list_levels": levels,
        "comments": comments,
        "statistics": stats.document_statistics(texts, pages),
    }


def convert(blocks: DataFrame, pages: DataFrame, core: DataFrame, **more: DataFrame | None) -> DataFrame:
    """One DOCX package a document, from its blocks and what ``build`` takes beside them."""
    made = build(blocks, pages, **more)
    return docx.packages(made["paragraphs"], core, made["pages"], made["sections"], made["edges"], made["tables"], made["pictures"])


def convert_files(files: DataFrame, password: str = "") -> DataFrame:
    """One DOCX package a PDF file (``path, content``), whose path is its ``doc_id``; each file is read once."""
    wanted = ["pages", "fragments", "metadata", "links", "lines", "images", "annotations", "outline", "fields"]
    found = {name: df.withColumnRenamed("path", "doc_id") for name, df in pdf.read_tables(files, wanted, password).items()}
    blocks = folds.fragments_to_blocks(found["fragments"])
    core = found["metadata"].select("doc_id", *(F.col("metadata")[f"/{k}"].alias(c) for k, c in (("Title", "title"), ("Author", "creator"), ("Subject", "subject"), ("Keywords", "keywords"))))
    return convert(blocks, found["pages"], core, **{k: found[k] for k in ("links", "lines", "images", "annotations", "outline", "fields")})
