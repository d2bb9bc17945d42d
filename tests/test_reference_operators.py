"""The reference's own acceptance values, and brute force on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from leafmill.errors import InvalidRange
from leafmill.functions import geometry, media, text
from leafmill.operators import folds, layout, notes, pages, regions, stats


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_ranges():
    assert pages.parse_ranges("1-2,5", 5) == [(1, 2), (5, 5)]
    assert [a for a, _ in pages.parse_ranges([(1, 3), "5", 4], 5)] == [1, 5, 4]
    for bad in ("0", "10-12", "", "3-1", "x"):
        with pytest.raises(InvalidRange):
            pages.parse_ranges(bad, 5)
    with pytest.raises(InvalidRange):
        pages.parse_ranges([""], 5)
    assert pages.normalise_pages([3, "1", " ", 3], 5) == [1, 3]
    with pytest.raises(InvalidRange):
        pages.normalise_pages(None)


def test_names(spark):
    assert one(spark, pages.output_name(F.lit("my file"), F.lit(1), F.lit(3))) == "my_file_pages_1-3.pdf"
    assert one(spark, pages.output_name(F.lit("base"), F.lit(2), F.lit(2))) == "base_page_2.pdf"


def test_splits_and_merges(spark):
    df = spark.createDataFrame([("a", k) for k in range(1, 6)] + [("b", 1)], "doc string, page int")
    assert sorted((r.page, r.part) for r in pages.split_points(df.where("doc = 'a'"), [4, 2, 4]).collect()) == [(1, 0), (2, 1), (3, 1), (4, 2), (5, 2)]
    assert [r.part for r in pages.split_every(df.where("doc = 'a'"), 2).orderBy("page").collect()] == [0, 0, 1, 1, 2]
    assert sorted((r.seq, r.page) for r in pages.select_pages(df.where("doc = 'a'"), [2, 1, 2], "page").collect()) == [(0, 2), (1, 1), (2, 2)]
    merged = pages.merge_pages(df.withColumn("g", F.lit(1)), "g", "doc").orderBy("new_page").collect()
    assert [(r.doc, r.page, r.offset, r.new_page) for r in merged][-2:] == [("a", 5, 0, 5), ("b", 1, 5, 6)]
    assert pages.merge_pages(df.withColumn("g", F.lit(1)).limit(0), "g", "doc").count() == 0
    with pytest.raises(InvalidRange):
        pages.split_points(df, [1])


@pytest.mark.parametrize("value, want", [("漢かな", "ja-JP"), ("한글", "ko-KR"), ("汉字", "zh-CN"), ("שלום", "he-IL"), ("سلام", "ar-SA"), ("Größe", "en-US"), ("“x”", "und"), ("", None), (None, None)])
def test_languages(spark, value, want):
    assert one(spark, text.guessed_language(F.lit(value).cast("string"))) == want


@pytest.mark.parametrize(
    "value, want",
    [
        ("1. one", ("ordered", "decimal", "dot", "1.", "one")),
        ("a) one", ("ordered", "lowerLetter", "paren", "a)", "one")),
        ("(i) one", ("ordered", "lowerRoman", "enclosed", "(i)", "one")),
        ("  • one", ("bullet", None, None, "•", "  one")),
        ("Hello. World", ("ordered", "lowerLetter", "dot", "Hello.", "World")),
        ("plain", None),
    ],
)
def test_markers(spark, value, want):
    found = one(spark, text.list_marker(F.lit(value)))
    assert (tuple(found) if found else None) == want


def test_scalars(spark):
    assert str(one(spark, text.w3c(text.pdf_date(F.lit("D:20240304050607Z"))))) == "2024-03-04T05:06:07Z"
    assert one(spark, text.w3c(text.pdf_date(F.lit("D:20240304050607+02'30'")))) == "2024-03-04T02:36:07Z"
    assert one(spark, text.pdf_date(F.lit("2024-03-04"))) is None
    assert one(spark, text.normalised(F.lit(" o\xadﬃce \x1f"))) == "office"
    assert one(spark, text.human_size(F.lit(1280))) == "1.2 KiB"
    assert one(spark, text.footnote_marker(F.lit("(*)"))) == "*"
    assert one(spark, text.anchor_name(F.lit("1 a/b"))) == "dest_1_a_b"
    assert one(spark, geometry.line_spacing(F.lit(20.0), F.lit(12.0))) == 1.67
    assert one(spark, geometry.hex_of_grey(F.lit(0.5))) == "808080"
    assert [one(spark, geometry.cell_alignment(F.lit(x))) for x in ("1,000.5", "−3", "Yes", "Total")] == ["right", "right", "center", "left"]
    assert (one(spark, geometry.twips(F.lit(612.0))), one(spark, geometry.emu(F.lit(1.0)))) == (12240, 12700)
    assert one(spark, geometry.vertical_matrix(F.lit(0.0), F.lit(1.0), F.lit(-1.0), F.lit(0.0))) is True
    assert len(one(spark, geometry.bezier(*[(F.lit(float(k)), F.lit(0.0)) for k in range(4)]))) == 13
    assert [one(spark, media.possible_savings(F.lit(1000), F.lit(k))) for k in (0, 50)] == [50, 600]
    assert tuple(one(spark, media.compression_result(F.lit(200), F.lit(100)))) == (100, 0.5)
    assert tuple(one(spark, media.compression_result(F.lit(0), F.lit(0)))) == (0, 1.0)
    assert one(spark, media.mime_type(F.lit(b"\xff\xd8\xff\x00"))) == "image/jpeg"


def test_statistics(spark):
    df = spark.createDataFrame([("a", "Metadata sample content"), ("b", None), ("b", " x\ny ")], "doc_id string, text string")
    found = {r.doc_id: r for r in stats.document_statistics(df).collect()}
    assert (found["a"].paragraphs, found["a"].words, found["a"].lines, found["a"].characters, found["a"].characters_with_spaces) == (1, 3, 1, 23, 23)
    assert (found["b"].paragraphs, found["b"].words, found["b"].lines, found["b"].characters, found["b"].characters_with_spaces) == (2, 2, 2, 3, 5)


BLOCK = "doc_id string, page_no int, block_idx int, text string, x_left double, y_bottom double, x_right double, y_top double, font_size double, block_role string, vertical boolean, opacity double"


def blocks(spark, rows):
    return spark.createDataFrame([("d", p, i, t, *map(float, b), float(s), r, False, None) for p, i, t, b, s, r in rows], BLOCK)


def page(spark, n=1, w=612.0, h=792.0):
    return spark.createDataFrame([("d", k, w, h) for k in range(n)], "doc_id string, page_no int, width double, height double")


def test_two_columns(spark):
    b = blocks(spark, [(0, k, "x", (x, 700 - 40 * k, x + 200, 710 - 40 * k), 12, None) for k, x in enumerate([72, 72, 330, 330, 72])])
    assert tuple(layout.page_columns(b).select("columns", "spacing").first()) == (2, 258.0)
    m = layout.page_margins(b, page(spark)).first()
    assert (m.margin_left, m.margin_right, m.margin_top) == (72.0, 82.0, 82.0)


def test_heading_then_body(spark):
    b = blocks(spark, [(0, 0, "Title here", (180, 700, 420, 720), 24, "H1"), (0, 1, "body", (72, 640, 400, 660), 12, "P"), (0, 2, "Big", (72, 600, 400, 620), 36, "P")])
    assert [r.style for r in layout.heading_styles(b).orderBy("block_idx").collect()] == ["Heading1", None, "Heading1"]
    s = {r.block_idx: r for r in layout.block_spacing(b).collect()}
    assert s[0].space_after == 40 and s[1].space_before == 40 and math.isclose(s[2].space_after, 21.6)


def test_list_levels(spark):
    b = blocks(spark, [(0, k, t, (x, 700 - 30 * k, 400, 712 - 30 * k), 12, None) for k, (t, x) in enumerate([("1. a", 90), ("a) b", 108), ("(i) c", 126), ("text", 72), ("• d", 90), ("• e", 90), ("• f", 108)])])
    found = folds.list_levels(layout.placed(b, page(spark))).orderBy("block_idx").collect()
    assert [r.level for r in found] == [0, 1, 2, 0, 0, 1]


def test_fragments(spark):
    rows = [("d", 0, 0, "Hello", 10.0, 700.0, "A-Bold", 10.0, False), ("d", 0, 1, "world", 60.0, 701.0, None, 10.0, False), ("d", 0, 2, "あ", 140.0, 740.0, None, 12.0, True), ("d", 0, 3, "い", 140.0, 720.0, None, 12.0, True), ("d", 0, 4, None, 1.0, 1.0, None, None, None)]
    f = spark.createDataFrame(rows, "doc_id string, page_no int, frag_idx int, text string, x double, y double, font_name string, font_size double, vertical boolean")
    found = folds.fragments_to_blocks(f).orderBy("block_idx").collect()
    assert [(r.text, r.vertical, r.bold, r.language) for r in found] == [("あい", True, False, "ja-JP"), ("Hello world", False, True, "en-US")]
    assert folds.fragments_to_blocks(f.limit(0)).count() == 0


def test_tables(spark):
    cells = [("Q1", (10, 100, 60, 120)), ("Q2", (80, 100, 130, 120)), ("10", (10, 70, 60, 90)), ("20", (80, 70, 130, 90))]
    b = blocks(spark, [(0, k, t, box, 12, "TH" if k < 2 else "TD") for k, (t, box) in enumerate(cells)])
    found = [(r.row_no, r.column_no, r.row_span, r.column_span, r.header) for r in folds.tagged_tables(b, tolerance=24.0).orderBy("block_idx").collect()]
    assert found == [(0, 0, 1, 1, True), (0, 1, 1, 1, True), (1, 0, 1, 1, False), (1, 1, 1, 1, False)]


def test_sections_compare_with_their_first_page(spark):
    rows = [("d", k, 612.0, 792.0, 72.0 + 4 * k, 72.0, 72.0, 72.0, 1, None) for k in range(4)]
    p = spark.createDataFrame(rows, "doc_id string, page_no int, width double, height double, margin_left double, margin_right double, margin_top double, margin_bottom double, columns int, spacing double")
    assert [r.section_no for r in folds.sections(p).orderBy("page_no").collect()] == [0, 0, 1, 1]


def test_regions_and_watermarks(spark):
    rows = []
    for p in range(3):
        rows += [(p, 0, "Report Title" if not p else "Quarterly Report", (72, 760, 300, 772), 12, None), (p, 1, f"Page {p + 1}", (280, 20, 330, 32), 8, None), (p, 2, "DRAFT", (200, 380, 400, 420), 40, None)]
    b, pg = blocks(spark, rows), page(spark, 3)
    sec = folds.section_pages(b, pg)
    head, foot = regions.repeating_regions(b, sec, False), regions.repeating_regions(b, sec, True)
    assert [tuple(r) for r in head.collect()] == [("d", 0, "quarterly report", 2, 1, 0)] and [tuple(r) for r in foot.collect()] == [("d", 0, "page", 3, 0, None)]
    assert [tuple(r) for r in regions.watermarks(b, pg).select("text", "pages").collect()] == [("DRAFT", 3)]
    members = regions.region_members(b, sec, head, False)
    assert {(r.page_no, r.block_idx, r.variant) for r in members.collect()} == {(0, 0, "first"), (1, 0, "default"), (2, 0, None)}
    assert {(r.variant, *r.texts) for r in regions.region_texts(members).collect()} == {("first", "Report Title"), ("default", "Quarterly Report")}


def test_regions_of_two_sections(spark):
    rows = [(k, 0, "Part one" if k < 2 else "Part two", (72, 760 if k < 2 else 560, 300, 772 if k < 2 else 572), 12, None) for k in range(4)] + [(k, 1, f"Body {k}", (72, 300, 300, 312), 12, None) for k in range(4)]
    pg = page(spark, 2).unionByName(page(spark, 4, 792.0, 612.0).where("page_no >= 2"))
    b = blocks(spark, rows)
    found = regions.repeating_regions(b, folds.section_pages(b, pg), False)
    assert sorted((r.section_no, r.signature) for r in found.collect()) == [(0, "part one"), (1, "part two")]


def test_two_annotations_on_one_paragraph(spark):
    """Each annotation chooses its paragraph: two on one give two comments; blank ones and those beside all give none."""
    a = spark.createDataFrame(
        [("d", 0, k, t, *map(float, b)) for k, t, b in ((0, "one", (72, 700, 300, 712)), (1, "two", (80, 700, 200, 712)), (2, " ", (72, 700, 300, 712)), (3, "far", (500, 10, 510, 20)), (4, "low", (72, 660, 300, 705)))],
        "doc_id string, page_no int, annot_idx int, text string, b_x_left double, b_y_bottom double, b_x_right double, b_y_top double",
    )
    p = spark.createDataFrame([("d", 0, 5, 72.0, 700.0, 300.0, 712.0), ("d", 0, 6, 72.0, 660.0, 300.0, 672.0), ("d", 0, 7, None, None, None, None)], "doc_id string, page_no int, para_idx int, x_left double, y_bottom double, x_right double, y_top double")
    assert [(r.annot_idx, r.para_idx, r.comment_id) for r in notes.match_comments(a, p).orderBy("comment_id").collect()] == [(0, 5, 0), (1, 5, 1), (4, 6, 2)]


def test_footnote_bodies(spark):
    run = lambda t, s: [(t, None, "F", float(s), False, False, False, None, None)]
    rows = [("d", 0, k, t, run(t, s), n, 72.0, y, 300.0, y + 10) for k, (t, s, n, y) in enumerate([("1 The note", 9, None, 80.0), ("2) Another", 9, 3, 80.0), ("3 too high", 9, None, 500.0), ("4 too large", 14, None, 80.0), ("† dagger", 9, None, 80.0), ("1 ", 9, None, 80.0), ("plain text", 9, None, 80.0)])]
    p = spark.createDataFrame(rows, "doc_id string, page_no int, para_idx int, text string, runs array<struct<text: string, break_type: string, font_name: string, font_size: double, bold: boolean, italic: boolean, underline: boolean, language: string, hyperlink_target: string>>, number_id int, x_left double, y_bottom double, x_right double, y_top double")
    sec = spark.createDataFrame([("d", 0, 792.0, 72.0)], "doc_id string, page_no int, height double, margin_bottom double")
    assert sorted((r.seq, r.marker, r.prefix) for r in notes.footnote_bodies(p, sec).collect()) == [(0, "1", 2), (4, "†", 2)]
    cut = p.where("para_idx = 0").select(text.without_prefix(F.array_union("runs", F.array(F.struct(F.lit("x").alias("text"), *(F.lit(None).alias(c) for c in ("break_type", "font_name")), F.lit(None).cast("double").alias("font_size"), *(F.lit(None).cast("boolean").alias(c) for c in ("bold", "italic", "underline")), *(F.lit(None).cast("string").alias(c) for c in ("language", "hyperlink_target"))))), F.lit(2)).alias("r")).first().r
    assert [x.text for x in cut] == ["The note", "x"]


def test_roles_equations_and_headers_of_tables(spark):
    b = blocks(spark, [(0, k, "x", (10, 10 * k, 20, 10 * k + 10), 12, r) for k, r in enumerate(["Note", "FORMULA", "td", None, "P"])])
    assert [r[0] for r in b.orderBy("block_idx").select(text.element_kind(F.col("block_role"))).collect()] == ["annotation", "equation", "cell", "paragraph", "paragraph"]
    assert [(r.annot_idx, r.text) for r in notes.annotation_blocks(b).collect()] == [(0, "x")]
    lines = spark.createDataFrame([("d", 0, 0, 10.0, 10.0, 20.0, 20.0), ("d", 0, 1, 10.0, 15.0, 20.0, 15.0), ("d", 0, 2, 20.0, 20.0, 10.0, 14.0)], "doc_id string, page_no int, line_idx int, x0 double, y0 double, x1 double, y1 double")
    assert [(r.block_idx, r.lines) for r in layout.equation_lines(b, lines).collect()] == [(1, [0, 2])]
    cells = spark.createDataFrame([("d", 0, 0, r, h) for r, h in ((0, True), (1, True), (2, False), (3, True))] + [("d", 0, 1, 0, True)], "doc_id string, page_no int, table_no int, row_no int, header_row boolean")
    assert sorted((r.table_no, r.header_rows) for r in folds.leading_header_rows(cells).collect()) == [(0, 2), (1, 1)]
    own = spark.createDataFrame([("d", 0, 0, "P"), ("d", 1, 0, "H1")], "doc_id string, page_no int, role_idx int, role string")
    whole = spark.createDataFrame([("d", 0, "L"), ("d", 1, "LI")], "doc_id string, role_idx int, role string")
    assert [(r.page_no, r.role_idx, r.role) for r in layout.chained_roles(own, whole).orderBy("page_no", "role_idx").collect()] == [(0, 0, "P"), (0, 1, "L"), (0, 2, "LI"), (1, 0, "H1"), (1, 1, "L"), (1, 2, "LI")]


def test_small_text_functions(spark):
    df = spark.createDataFrame([("exam-", "ple", "Größe 1!"), ("co-", "Op", "--"), ("plain", None, None)], "a string, b string, c string")
    got = [tuple(r) for r in df.select(text.joined_hyphen(F.col("a"), F.col("b")), text.bookmark_name(F.col("c"))).collect()]
    assert got[0] == ("exam", "Größe_1_") and got[1][0] == "co-" and got[2] == ("plain", "bookmark")


def test_images_are_counted(spark):
    images = spark.createDataFrame([("d", 300, 150, 0.0, 0.0, 72.0, 72.0), ("d", 0, None, 0.0, 0.0, 72.0, 72.0)], "doc_id string, width_px int, height_px int, x_left double, y_bottom double, x_right double, y_top double")
    assert [tuple(r) for r in stats.image_statistics(images, page(spark, 3)).collect()] == [("d", 3, 2, 225.0)]


def test_modes_of_splitting(spark):
    p = spark.range(1, 6).select(F.col("id").cast("int").alias("page"))
    assert pages.split(p, "range", ranges="1-2,4").count() == 3 and pages.split(p, "pages", wanted=[2, 2, "3"]).count() == 2
    for bad in (lambda: pages.split(p, "pages"), lambda: pages.split(p, "odd")):
        with pytest.raises(ValueError):
            bad()


def test_options(tmp_path):
    from leafmill.sources import options

    assert options.output_path("/a/b.pdf") == "/a/b.docx" and options.output_path("s3://x/b.c.pdf") == "s3://x/b.c.docx" and options.output_path(None, "y.docx") == "y.docx"
    assert options.local_path("s3://x/y") == "s3://x/y" and options.local_path(tmp_path / ".." / "z").endswith("/z")
    assert options.flag(["A", "B"], {"A": " Yes "}) and not options.flag(["A", "B"], {"A": "no", "B": "1"}) and not options.flag(["A"], {})
    assert options.form_object('{"a": 1, "b": null}') == {"a": 1} and options.form_object("") is None
    for bad in (lambda: options.output_path(None), lambda: options.form_object("[1]"), lambda: options.form_object("{")):
        with pytest.raises(ValueError):
            bad()


def test_footnotes(spark):
    schema = "doc_id string, page_no int, seq int, marker string"
    m = spark.createDataFrame([("d", 0, 1, "1"), ("d", 0, 2, "1"), ("d", 1, 1, "1"), ("d", 1, 2, None)], schema)
    b = spark.createDataFrame([("d", 0, 9, "1"), ("d", 1, 8, "1"), ("d", 1, 9, "1"), ("d", 2, 9, "x")], schema)
    found = [(r.body_page, r.seq, r.marker_page, r.marker_seq, r.footnote_id) for r in notes.match_footnotes(m, b).orderBy("footnote_id").collect()]
    assert found == [(0, 9, 0, 1, 2), (1, 8, 1, 1, 3), (1, 9, 0, 2, 4)]


def test_outline(spark):
    nodes = spark.createDataFrame([("d", 1, None, 0, "A"), ("d", 2, 1, 0, "B"), ("d", 3, None, 1, "C")], "doc_id string, node_id int, parent_id int, ord int, title string")
    deep = spark.createDataFrame([("e", k, k - 1 if k else None, 0, f"L{k}") for k in range(71)] + [("e", 100, 101, 0, "x"), ("e", 101, 100, 0, "y")], nodes.schema)
    found = folds.flatten_outline(deep).orderBy("path").collect()
    assert [r.title for r in found] == [f"L{k}" for k in range(71)] and found[70].style == "TOC9" and len(found[70].path) == 71
    assert [(r.title, r.style) for r in folds.flatten_outline(nodes).orderBy("path").collect()] == [("A", "TOC1"), ("B", "TOC2"), ("C", "TOC1")]


def test_dedup(spark):
    df = spark.createDataFrame([(2, "x"), (1, "x"), (3, None)], "doc_id long, text string")
    assert [(r.doc_id, r.copies) for r in regions.first_payloads(df, "doc_id", "text").collect()] == [(1, 2)]


def test_backgrounds(spark):
    b = blocks(spark, [(0, 0, "in", (20, 20, 80, 60), 12, None), (0, 1, "out", (300, 20, 380, 60), 12, None)])
    schema = "doc_id string, page_no int, path_idx int, b_x_left double, b_y_bottom double, b_x_right double, b_y_top double, fill string, alpha double"
    r = spark.createDataFrame([("d", 0, 0, 10.0, 10.0, 90.0, 70.0, "808080", 1.0), ("d", 0, 1, 500.0, 10.0, 590.0, 70.0, "FF0000", 1.0)], schema)
    hit, rest = layout.backgrounds(b, r)
    assert [(x.block_idx, x.background) for x in hit.collect()] == [(0, "808080")] and [x.path_idx for x in rest.collect()] == [1]


def test_table_cascade(spark):
    cells = [(0, "TH", (10, 100, 60, 110)), (1, "TH", (65, 100, 130, 110)), (2, "TD", (10, 85, 60, 95)), (3, "TD", (65, 85, 130, 95))]
    spaced = [(k + 10, None, (300 + 60 * (k % 2), 500 - 25 * (k // 2), 340 + 60 * (k % 2), 512 - 25 * (k // 2))) for k in range(4)]
    ruled = [(20, None, (215, 215, 245, 225)), (21, None, (265, 215, 285, 225)), (22, None, (215, 265, 245, 275)), (23, None, (265, 265, 285, 275))]
    b = blocks(spark, [(0, k, f"t{k}", box, 12, role) for k, role, box in [*cells, *spaced, *ruled]])
    edges = [(210.0, y, 290.0, y) for y in (200.0, 250.0, 300.0)] + [(x, 200.0, x, 300.0) for x in (210.0, 250.0, 290.0)]
    lines = spark.createDataFrame([("d", 0, *e) for e in edges], "doc_id string, page_no int, x0 double, y0 double, x1 double, y1 double")
    found = {r.block_idx: r for r in folds.detect_tables(b, lines).collect()}
    assert {k: r.found_by for k, r in found.items()} == {**dict.fromkeys(range(4), "tagged"), **dict.fromkeys(range(20, 24), "ruled"), **dict.fromkeys(range(10, 14), "spaced")}
    assert [(found[k].row_no, found[k].column_no) for k in (20, 21, 22, 23)] == [(1, 0), (1, 1), (0, 0), (0, 1)]
    assert found[0].header_row and not found[2].header_row
    assert folds.detect_tables(b.limit(0)).count() == 0


def test_pictures_are_used_once(spark):
    b = blocks(spark, [(0, 0, "a", (0, 50, 10, 60), 12, None), (0, 1, "b", (0, 50, 10, 60), 12, None), (0, 2, "c", (100, 5, 110, 9), 12, None)])
    i = spark.createDataFrame([("d", 0, 0, 0.0, 50.0, 10.0, 60.0), ("d", 0, 1, 0.0, 55.0, 10.0, 60.0)], "doc_id string, page_no int, image_idx int, x_left double, y_bottom double, x_right double, y_top double")
    assert [(r.block_idx, r.image_idx) for r in folds.match_pictures(b, i).orderBy("block_idx").collect()] == [(0, 0), (1, 1)]


def test_forms_and_equations(spark):
    from leafmill.functions import forms

    rows = [("checkbox", "Yes", True, None, "ok", "ok"), ("dropdown", None, None, ["a", "b"], "x", "tip"), ("signature", "Ann", None, None, "s", None), ("text", "one\n\ntwo", None, None, "t", "t"), ("text", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "kind string, value string, checked boolean, options array<string>, label string, tooltip string")
    got = [r.v for r in df.select(forms.field_value(*(F.col(c) for c in df.columns)).alias("v")).collect()]
    assert got == [["☑"], ["Selected: (none)", "Options: a, b", "(tip)"], [forms.SIGNATURE, "Signed: Ann"], ["one", "\xa0", "two"], ["\xa0"]]
    assert [r.v for r in df.select(forms.field_label(F.col("label"), F.lit(None).cast("string"), F.col("kind")).alias("v")).collect()][-1] == "Text"
    m = "<math xmlns='http://www.w3.org/1998/Math/MathML'><mfrac><msup><mi>x</mi><mn>2</mn></msup><msqrt><mi>y</mi></msqrt></mfrac><mo>=</mo><mfenced><mi>a</mi><mi>b</mi></mfenced></math>"
    assert forms.linear_math("f " + m) == "(x^(2))/(sqrt(y))=(a,b)" and forms.linear_math("<math><mi>x") is None
    out = spark.createDataFrame([(m,), (None,), ("plain",)], "t string").select(forms.math_text("t").alias("v")).collect()
    assert [r.v for r in out] == ["(x^(2))/(sqrt(y))=(a,b)", None, None]
