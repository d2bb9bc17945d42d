"""The queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import geometry, media, text
from .operators import folds, layout, notes, pages, regions, stats
from .operators.timestamps import normalised
from .oracle import oracle_sql
from .session import staged, table
from .sources import docx, pdf

__all__ = ["oracle_sql", "queries"]

Query = Callable[[SparkSession, str], DataFrame]
PAGE, BLOCK = layout.PAGE, layout.BLOCK


def _blocks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The blocks, each once, with the columns of boxes and those asked for."""
    shown = table(spark, sf_dir, "text_blocks").select(*BLOCK, "text", "x_left", "y_bottom", "x_right", "y_top", *columns)
    return layout.once(shown, BLOCK)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.once(table(spark, sf_dir, "pdf_pages").select(*PAGE, "width", "height"), PAGE)


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by 1-based number."""
    return _pages(spark, sf_dir).select("doc_id", (F.col("page_no") + 1).alias("page"), "width", "height")


def _timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every timestamp of the tables with the zone and date order of its source, records that are there twice once."""
    meta, sources = table(spark, sf_dir, "doc_metadata"), table(spark, sf_dir, "sources").select("source", "home_zone", "date_order")
    fields = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("created", "modified")))).alias("f")
    a = meta.select(F.lit("document").alias("unit"), F.col("doc_id").alias("rec_id"), "source", fields).select("unit", "rec_id", "source", "f.field", "f.value")
    of_doc = meta.groupBy("doc_id").agg(F.max("source").alias("source"))
    b = table(spark, sf_dir, "conversions").join(of_doc, "doc_id", "left")
    b = b.select(F.lit("conversion").alias("unit"), F.col("conv_id").cast("string").alias("rec_id"), "source", F.lit("created").alias("field"), F.col("created").alias("value"))
    return a.unionByName(b).distinct().join(sources, "source", "left")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timestamps that denote exactly one instant."""
    return normalised(_timestamps(spark, sf_dir)).where(F.col("utc_us").isNotNull()).select("unit", "rec_id", "field", "utc_us").distinct()


def p3_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every timestamp with its instant, the notation it was read in, and why it has none."""
    return normalised(_timestamps(spark, sf_dir)).drop("home_zone", "date_order")


def text_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.normalised(F.col("text")).alias("clean"))


def text_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _blocks(spark, sf_dir).select(*BLOCK, text.guessed_language(t).alias("guess"), text.is_rtl(t).alias("rtl"), text.is_east_asian(t).alias("east_asian"))


def list_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _blocks(spark, sf_dir, "block_role").withColumn("m", text.list_marker(F.col("text"), F.col("block_role")))
    return found.where(F.col("m").isNotNull()).select(*BLOCK, "m.*")


def signature_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _blocks(spark, sf_dir).select(*BLOCK, text.signature(t, False).alias("header"), text.signature(t, True).alias("footer"))


def font_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    fonts = table(spark, sf_dir, "fragments").select("font_name").distinct()
    return fonts.select("font_name", text.font_traits(F.col("font_name")).alias("t")).select("font_name", "t.*")


def pdf_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = text.pdf_date(F.col("created"))
    meta = table(spark, sf_dir, "doc_metadata").select("doc_id", "created").distinct()
    return meta.select("doc_id", F.unix_micros(at).alias("utc_us"), text.w3c(at).alias("w3c"))


def footnote_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _blocks(spark, sf_dir).select(*BLOCK, text.footnote_marker(F.col("text")).alias("marker"))
    return found.where(F.col("marker").isNotNull())


def anchor_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "doc_metadata").select("title").distinct().select("title", text.anchor_name(F.col("title")).alias("anchor"))


def document_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = layout.once(table(spark, sf_dir, "paragraphs").select("doc_id", "page_no", "para_idx", "runs"), ["doc_id", "page_no", "para_idx"])
    return stats.document_statistics(p.withColumn("text", stats.run_text(F.col("runs"))), _pages(spark, sf_dir))


def text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.document_statistics(table(spark, sf_dir, "documents").select("doc_id", "text"))


def core_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.core_properties(layout.once(table(spark, sf_dir, "doc_metadata"), ["doc_id"]))


def metadata_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = layout.once(table(spark, sf_dir, "doc_metadata"), ["doc_id"]).select("doc_id", "title", "author", "last_modified_by", "tagged")
    over = table(spark, sf_dir, "conversions").groupBy("doc_id").agg(F.max("last_modified_by").alias("last_modified_by"), F.max("tagged_pdf").alias("tagged"))
    return stats.overlay(base, over, "doc_id", ["last_modified_by", "tagged"])


def page_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.page_margins(_blocks(spark, sf_dir), _pages(spark, sf_dir))


def page_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.page_columns(_blocks(spark, sf_dir))


def block_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.block_formats(layout.placed(_blocks(spark, sf_dir, "font_size"), _pages(spark, sf_dir)))


def heading_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Styles of the blocks that begin paragraphs."""
    begins = continuations(spark, sf_dir).where("new_paragraph").select(*BLOCK)
    return layout.heading_styles(_blocks(spark, sf_dir, "font_size", "block_role").join(begins, BLOCK))


def block_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.block_spacing(_blocks(spark, sf_dir, "font_size"))


def continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _blocks(spark, sf_dir, "font_size", "block_role", "vertical")
    return folds.continuations(b, folds.section_pages(b, _pages(spark, sf_dir)))


def page_and_column_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.breaks(layout.placed(_blocks(spark, sf_dir), _pages(spark, sf_dir)))


def edge_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.edge_clusters(_blocks(spark, sf_dir), PAGE, "x_left")


def roles_to_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles as a structure tree lists them, here those that the page's blocks carry."""
    b = _blocks(spark, sf_dir, "block_role")
    roles = b.where(F.col("block_role").isNotNull()).select(*PAGE, F.col("block_idx").alias("role_idx"), F.col("block_role").alias("role"))
    return layout.roles_to_blocks(roles, b)


def _boxes(b: DataFrame, key: str, dx: float, dy: float, *more) -> DataFrame:
    edges = [(F.col("x_left") + dx).alias("b_x_left"), (F.col("y_bottom") + dy).alias("b_y_bottom"), (F.col("x_right") + dx).alias("b_x_right"), (F.col("y_top") + dy).alias("b_y_top")]
    return b.select(*PAGE, F.col("block_idx").alias(key), *edges, *more)


def link_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links (here coloured blocks' boxes, shifted) and the blocks they lie on."""
    b = _blocks(spark, sf_dir, "color")
    return layout.best_overlap(b, _boxes(b.where(F.col("color").isNotNull()), "link_idx", 4.0, -3.0), BLOCK, "link_idx", 0.05)


def comment_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations (here boxes of uncoloured blocks, shifted) and the paragraphs (blocks with a role) they lie on."""
    b = _blocks(spark, sf_dir, "block_role", "color")
    a = _boxes(b.where(F.col("color").isNull()), "annot_idx", 2.0, 6.0, "text")
    return notes.match_comments(a, b.where(F.col("block_role").isNotNull()).withColumnRenamed("block_idx", "para_idx"))


def background_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles (here around blocks with a background) and the blocks inside them."""
    b = _blocks(spark, sf_dir, "background_color", "opacity")
    grown = b.where(F.col("background_color").isNotNull()).select(
        *PAGE, F.col("block_idx").alias("path_idx"), (F.col("x_left") - 10).alias("b_x_left"), (F.col("y_bottom") - 30).alias("b_y_bottom"), (F.col("x_right") + 300).alias("b_x_right"), (F.col("y_top") + 30).alias("b_y_top"),
        F.col("background_color").alias("fill"), F.coalesce("opacity", F.lit(1.0)).alias("alpha"),
    )
    return layout.backgrounds(b, grown)[0]


def footnote_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers (here single signs in table cells) and bodies (blocks that begin with one), one to one."""
    b = _blocks(spark, sf_dir, "block_role")
    mark = text.footnote_marker(F.col("text"))
    markers = b.select(*PAGE, F.col("block_idx").alias("seq"), mark.alias("marker"))
    body = F.regexp_extract("text", r"^([0-9]+|[*†‡]) ", 1)
    bodies = b.where(body != "").select(*PAGE, F.col("block_idx").alias("seq"), body.alias("marker"))
    return notes.match_footnotes(markers, bodies)


def header_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _blocks(spark, sf_dir)
    return regions.repeating_regions(b, folds.section_pages(b, _pages(spark, sf_dir)), footer=False)


def footer_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footers of pages that are numbered at their foot."""
    p, at = _pages(spark, sf_dir), dict(zip(("x_left", "y_bottom", "x_right", "y_top"), (280.0, 20.0, 330.0, 32.0)))
    number = p.select(*PAGE, F.lit(-1).alias("block_idx"), F.concat(F.lit("Page "), F.col("page_no") + 1).alias("text"), *(F.lit(v).alias(k) for k, v in at.items()))
    b = _blocks(spark, sf_dir).unionByName(number)
    return regions.repeating_regions(b, folds.section_pages(b, p), footer=True)


def watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watermarks of the blocks, with each PDF's title stamped in the middle of its pages but every fifth."""
    p = _pages(spark, sf_dir)
    title = table(spark, sf_dir, "doc_metadata").where(F.col("title") != "").groupBy("doc_id").agg(F.max("title").alias("text"))
    mid = lambda size, by: F.col(size) / 2 + by
    stamp = p.where(F.col("page_no") % 5 != 4).join(title, "doc_id").select(
        *PAGE, F.lit(-1).alias("block_idx"), "text", mid("width", -90.0).alias("x_left"), mid("height", -20.0).alias("y_bottom"), mid("width", 90.0).alias("x_right"), mid("height", 20.0).alias("y_top"), F.lit(0.4).alias("opacity")
    )
    return regions.watermarks(_blocks(spark, sf_dir, "opacity").unionByName(stamp), p)


def payload_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.first_payloads(table(spark, sf_dir, "documents"), "doc_id", "text")


def hyperlink_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "paragraphs").select("doc_id", "page_no", "para_idx", F.posexplode("runs").alias("run_idx", "run"))
    return regions.link_relations(p.select("doc_id", "page_no", "para_idx", "run_idx", F.col("run.hyperlink_target").alias("target")), ["page_no", "para_idx", "run_idx"])


def split_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.split_ranges(_numbered(spark, sf_dir), pages.parse_ranges("2-3,1,1-2"))
    return found.select("doc_id", "page", "part", pages.output_name(F.col("doc_id"), F.col("range_start"), F.col("range_end")).alias("file"))


def split_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.split_pages(_numbered(spark, sf_dir), pages.normalise_pages([3, "1", 3, " "])).select("doc_id", "page", "part")


def extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_ranges(_numbered(spark, sf_dir), pages.parse_ranges(["4", (2, 3), "2"])).select("doc_id", "page", "new_page")


def select_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.select_pages(_pages(spark, sf_dir), [1, 0, 1])


def split_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.split_points(_numbered(spark, sf_dir), [4, 2, 4]).select("doc_id", "page", "part")


def split_every_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.split_every(_numbered(spark, sf_dir), 3).select("doc_id", "page", "part")


def split_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.split_all(_numbered(spark, sf_dir)).select("doc_id", "page", "part")


def merge_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PDFs of a hundred neighbouring numbers become one output each."""
    p = _numbered(spark, sf_dir).withColumn("output", F.substring("doc_id", 1, 10))
    return pages.merge_pages(p, "output", "doc_id").select("output", "doc_id", "page", "offset", "new_page")


def compression_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Possible savings and the result of saving them, with a text's characters as size and a PDF's pages as images."""
    n = _pages(spark, sf_dir).groupBy(F.col("doc_id").alias("pdf_id")).agg(F.count("*").alias("images"))
    d = table(spark, sf_dir, "documents").select("doc_id", "pdf_id", "n_chars").join(n, "pdf_id", "left").fillna(0, ["images"])
    saved = media.possible_savings(F.col("n_chars"), F.col("images"))
    out = d.select("doc_id", "images", saved.alias("savings"), media.compression_result(F.col("n_chars"), F.col("n_chars") - saved).alias("r"), text.human_size(F.col("n_chars")).alias("size"))
    return out.select("doc_id", "images", "savings", "r.bytes_saved", F.round("r.ratio", 6).alias("ratio"), "size")


def page_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page sizes in the units of the output."""
    c = F.col
    return _pages(spark, sf_dir).select(*PAGE, geometry.twips(c("width")).alias("twips"), geometry.emu(c("height")).alias("emu"), F.when(c("width") > c("height"), "landscape").otherwise("portrait").alias("orientation"))


def cell_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir, "block_role").where(F.col("block_role") == "TD").select(*BLOCK, geometry.cell_alignment(F.col("text")).alias("alignment"))


def style_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbering schemes that the documents' markers use, with the number each has in the output."""
    found = list_markers(spark, sf_dir).groupBy("kind", "format", "punctuation").agg(F.count("*").alias("n"))
    return found.select("kind", "format", "punctuation", folds.numbering_id(F.col("kind"), F.col("format"), F.col("punctuation")).alias("number_id"), "n")


def fragment_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = layout.once(table(spark, sf_dir, "fragments").select("doc_id", "page_no", "frag_idx", "text", "x", "y", "font_name", "font_size", "vertical"), ["doc_id", "page_no", "frag_idx"])
    return folds.fragments_to_blocks(f)


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, p = _blocks(spark, sf_dir), _pages(spark, sf_dir)
    return folds.sections(layout.page_margins(b, p).join(layout.page_columns(b), PAGE, "left"))


def list_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, p = _blocks(spark, sf_dir, "block_role"), _pages(spark, sf_dir)
    return folds.list_levels(layout.placed(b, p))


def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of the cells on each page, closed up, with a second column beside them."""
    b = _blocks(spark, sf_dir, "block_role").where(F.col("block_role") == "TD").withColumn("y_bottom", F.col("y_bottom") / 2).withColumn("y_top", F.col("y_top") / 2)
    at = lambda x, k: b.withColumn("block_idx", F.col("block_idx") + k).withColumn("x_right", F.lit(x + 50.0)).withColumn("x_left", F.lit(x))
    return folds.tagged_tables(at(72.0, 0).unionByName(at(130.0, 1_000)))


def proximity_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.proximity_clusters(_blocks(spark, sf_dir))


def docx_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A DOCX package of every PDF's paragraphs: its name and statistics."""
    p = layout.once(table(spark, sf_dir, "paragraphs").select("doc_id", "page_no", "para_idx", "style", "alignment", "runs"), ["doc_id", "page_no", "para_idx"])
    made = docx.packages(p, core_properties(spark, sf_dir), _pages(spark, sf_dir))
    return made.where(F.length("content") > 0).drop("content")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A PDF file of every document's pages and fragments, written once."""
    f = layout.once(table(spark, sf_dir, "fragments").select("doc_id", "page_no", "frag_idx", "text", "x", "y", "font_name", "font_size", "vertical"), ["doc_id", "page_no", "frag_idx"])
    return staged(pdf.from_fragments(f, _pages(spark, sf_dir)), "files")


def pdf_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fragments as they are read from the files."""
    found = pdf.read(_files(spark, sf_dir), "fragments")
    return found.select(F.col("path").alias("doc_id"), "page_no", "text", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "font_name", F.round("font_size", 3).alias("font_size"), "vertical")


def pdf_page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pdf.read(_files(spark, sf_dir), "pages")
    return found.select(F.col("path").alias("doc_id"), "page_no", F.round("width", 3).alias("width"), F.round("height", 3).alias("height"))


def pdf_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.info(_files(spark, sf_dir)).select(F.col("path").alias("doc_id"), "pages", "encrypted")


def pdf_split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of the files that every file is split into, two pages each."""
    parts = pdf.split(_files(spark, sf_dir), every=2).select(F.col("file").alias("path"), "content")
    return pdf.info(parts).select(F.col("path").alias("file"), "pages")


def pdf_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are protected, then opened again, with and without the password."""
    closed = staged(pdf.protect(_files(spark, sf_dir), "secret").select("path", "content"), "closed")
    opened = pdf.info(pdf.unprotect(closed, "secret").select("path", "content")).select("path", F.col("pages").alias("pages"))
    return pdf.info(closed).select("path", "encrypted").join(opened, "path").select(F.col("path").alias("doc_id"), "encrypted", "pages")


def pdf_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of the files once they are compressed."""
    found = pdf.read(pdf.compress(_files(spark, sf_dir), "high").select("path", "content"), "fragments")
    return found.groupBy(F.col("path").alias("doc_id")).agg(F.count("*").alias("fragments"), F.sum(F.length("text")).alias("characters"))


def page_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks, text and two-column pages by source and orientation, with subtotals."""
    source = table(spark, sf_dir, "doc_metadata").groupBy("doc_id").agg(F.max("source").alias("source"))
    p = _pages(spark, sf_dir).withColumn("orientation", F.when(F.col("width") > F.col("height"), "landscape").otherwise("portrait"))
    b = _blocks(spark, sf_dir).groupBy(*PAGE).agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("characters"))
    return p.join(b, PAGE, "left").join(source, "doc_id", "left").rollup("source", "orientation").agg(F.count("*").alias("pages"), F.sum("blocks").alias("blocks"), F.sum("characters").alias("characters"))


def latest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of each PDF that came last, of those that came twice."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("ingested_at").desc()))
    return table(spark, sf_dir, "doc_metadata").select("doc_id", "source", "ingested_at").withColumn("rank", rank).where(F.col("rank") == 1).select("doc_id", "source", F.unix_micros(F.col("ingested_at").cast("timestamp")).alias("came_us"))


def queries() -> dict[str, Query]:
    own = [
        p3_found, p3_normalised, text_normalised, text_language, list_markers, signature_text, font_traits, pdf_dates, footnote_markers, anchor_names, document_statistics, text_statistics, core_properties,
        metadata_overlay, page_margins, page_columns, block_formats, heading_styles, block_spacing, continuations, page_and_column_breaks, edge_clusters, roles_to_blocks, link_matches, comment_matches,
        background_matches, footnote_matches, header_regions, footer_regions, watermarks, payload_dedup, hyperlink_dedup, split_ranges, split_pages, extract_pages, select_pages, split_points, split_every_n,
        split_all, merge_pages, compression_info, page_units, cell_alignments, style_numbers, fragment_blocks, sections, list_levels, table_cells, proximity_clusters, docx_files, pdf_fragments, pdf_page_sizes, pdf_info, pdf_split_files, pdf_protected, pdf_compressed, page_report, latest_records,
    ]
    return {f.__name__: f for f in own}
