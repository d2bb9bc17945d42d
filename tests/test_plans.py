"""Whole conversions, and streams."""

import io
import zipfile
from xml.etree import ElementTree as ET

from pyspark.sql import functions as F

from leafmill.operators import layout
from leafmill.plans import assemble
from leafmill.session import table
from leafmill.sources import docx
from leafmill.streaming import landing

from .conftest import SF
from .test_pdf import made
from .test_reference_operators import blocks, page


def test_paragraphs_go_on_below_and_on_the_next_page(spark):
    rows = [
        (0, 0, "Heading", (72, 700, 300, 718), 18, "H1"), (0, 1, "This paragraph", (72, 660, 300, 672), 12, "P"), (0, 2, "goes on here and", (72, 648, 300, 660), 12, "P"),
        (0, 3, "continues", (72, 60, 300, 90), 12, "P"), (1, 0, "on the next page.", (72, 700, 300, 718), 12, "P"), (1, 1, "1. item", (72, 60, 300, 72), 12, "P"),
    ]
    found = assemble.build(blocks(spark, rows), page(spark, 2))
    p = found["paragraphs"].orderBy("para_idx").collect()
    assert ["".join(r.text for r in x.runs) for x in p] == ["Heading", "This paragraph goes on here and", "continues on the next page.", "item"]
    assert [x.style for x in p] == ["Heading1", None, None, "ListParagraph"] and p[3].number_id == 2 and p[3].level == 0
    assert [x.section_no for x in found["sections"].collect()] == [0]
    assert found["statistics"].first().paragraphs == 4


def test_convert_tables(spark):
    b = layout.once(table(spark, SF, "text_blocks").drop("source"), layout.BLOCK)
    core = table(spark, SF, "doc_metadata").select("doc_id", "title").dropDuplicates(["doc_id"])
    made_files = assemble.convert(b, layout.once(table(spark, SF, "pdf_pages"), layout.PAGE).drop("ingested_at"), core)
    assert made_files.where("paragraphs > 0").count() == b.where(layout.has_text(F.col("text"))).select("doc_id").distinct().count()


def test_convert_files(spark):
    files = spark.createDataFrame([("a.pdf", made(pages=1)), ("b.pdf", b"broken")], "path string, content binary")
    found = assemble.convert_files(files).collect()
    assert [r.doc_id for r in found] == ["a.pdf"] and found[0].pages == 1
    z = zipfile.ZipFile(io.BytesIO(found[0].content))
    assert "Hello (you)" in "".join(ET.fromstring(z.read("word/document.xml")).itertext())
    assert ET.fromstring(z.read("docProps/core.xml")).findtext(f"{{{docx.DC}}}title") == "Sample"


def test_convert_writes_running_headers_and_footers(spark):
    rows = [x for k in range(3) for x in ((k, 0, "Annual report", (72, 760, 300, 772), 12, None), (k, 1, f"Body {k}.", (72, 400, 300, 412), 12, None), (k, 2, f"Page {k + 1}", (280, 20, 330, 32), 8, None))]
    same = blocks(spark, [x for x in rows if x[1] != 1]).withColumn("doc_id", F.lit("e"))  # nothing else: it still is a file
    pages = page(spark, 3).unionByName(page(spark, 3).withColumn("doc_id", F.lit("e")))
    core = spark.createDataFrame([("d", "T")], "doc_id string, title string")
    files = {r.doc_id: zipfile.ZipFile(io.BytesIO(r.content)) for r in assemble.convert(blocks(spark, rows).unionByName(same), pages, core).collect()}
    shown = lambda d, part: [t.text for t in ET.fromstring(files[d].read(f"word/{part}.xml")).iter(f"{{{docx.W}}}t")]
    assert (shown("d", "header1"), shown("d", "document"), shown("d", "footer2")) == (["Annual report"], ["Body 0.", "Body 1.", "Body 2."], ["Page 1", "/"])
    assert shown("e", "header1") == ["Annual report"] and shown("e", "document") == []


def test_vertical_blocks_are_paragraphs_of_their_own(spark):
    rows = [(0, k, t, (72, 700 - 12 * k, 300, 712 - 12 * k), 12, "P") for k, t in enumerate(("One", "two", "縦書き", "three", "four"))]
    found = assemble.build(blocks(spark, rows).withColumn("vertical", F.col("block_idx") == 2), page(spark))
    assert ["".join(r.text for r in x.runs) for x in found["paragraphs"].orderBy("para_idx").collect()] == ["One two", "縦書き", "three four"]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(made())
    pages = landing.pages_of_stream(landing.pdf_stream(spark, str(tmp_path / "in")), "pages")
    q = landing.to_parquet(pages, str(tmp_path / "out"), str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    source = table(spark, SF, "text_blocks")
    source.write.parquet(str(tmp_path / "blocks"))
    stream = landing.record_stream(spark, str(tmp_path / "blocks"), source.schema)
    for name, df, mode in (("once", landing.once_in_stream(stream, layout.BLOCK, late="365 days"), "append"), ("arrivals", landing.arrivals(stream, "1 day"), "complete")):
        landing_query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        landing_query.awaitTermination()
    assert spark.table("once").count() == source.select(*layout.BLOCK).distinct().count()
    assert spark.table("arrivals").agg(F.sum("blocks")).first()[0] == source.count()


def test_whole_documents(spark):
    """Tables with spans, pictures, comments, sections, a table of contents, bookmarks and links inside the document."""
    cell = lambda k, t, box, role="TD": (0, k, t, box, 10, role)
    rows = [
        (0, 0, "Heading", (72, 730, 300, 742), 18, "H1"),
        cell(1, "Name", (72, 618, 172, 630), "TH"), cell(2, "Value", (172, 618, 272, 630), "TH"), cell(3, "all rows", (72, 540, 172, 612)), cell(4, "12", (172, 600, 272, 612)), cell(5, "a\nb", (172, 570, 272, 582)), cell(8, "c", (172, 540, 272, 552)),
        (0, 6, "See the end.", (72, 300, 300, 312), 12, "P"), (1, 0, "The end.", (90, 500, 700, 512), 12, "P"),
    ]
    pages = page(spark, 1).unionByName(page(spark, 2, 792.0, 612.0).where("page_no = 1"))
    box = "x_left double, y_bottom double, x_right double, y_top double"
    links = spark.createDataFrame([("d", 0, 0, None, "the end", 1, 505.0, 72.0, 300.0, 300.0, 312.0)], f"doc_id string, page_no int, link_idx int, uri string, anchor string, destination_page int, destination_top double, {box}")
    png = b"\x89PNG\r\n\x1a\n" + bytes(20)
    images = spark.createDataFrame([("d", 0, k, png, None, 72.0, 400.0, 172.0, 450.0) for k in range(2)], f"doc_id string, page_no int, image_idx int, data binary, mime_type string, {box}")
    notes = spark.createDataFrame([("d", 0, k, t, "Ann", 72.0, 300.0, 300.0, 312.0) for k, t in enumerate(("first", "second"))], f"doc_id string, page_no int, annot_idx int, text string, author string, {box}")
    outline = spark.createDataFrame([("d", 1, None, 0, "Start", 0, 742.0), ("d", 2, 1, 0, "Nowhere", None, None)], "doc_id string, node_id int, parent_id int, ord int, title string, page_no int, top double")
    fields = spark.createDataFrame([("d", 0, 0, "dropdown", "n", "City", "Bonn", None, ["Bonn", "Ulm"], None, 72.0, 250.0, 300.0, 262.0)], f"doc_id string, page_no int, field_idx int, field_type string, name string, label string, value string, checked boolean, options array<string>, tooltip string, {box}")
    core = spark.createDataFrame([("d", "T")], "doc_id string, title string")
    file = assemble.convert(blocks(spark, rows), pages, core, links=links, images=images, annotations=notes, outline=outline, fields=fields).first()
    z = zipfile.ZipFile(io.BytesIO(file.content))
    body = ET.fromstring(z.read("word/document.xml"))[0]
    w = lambda tag: f"{{{docx.W}}}{tag}"
    assert [e.tag.split("}")[1] for e in body] == ["p", "p", "p", "tbl", "p", "p", "p", "tbl", "p", "p", "sectPr"]
    assert ["".join(t.text for t in e.iter(w("t"))) for e in body if e.tag == w("p")] == ["Start", "Nowhere", "Heading", "", "", "See the end.", "", "The end."]
    form = body[7]
    assert [["".join(t.text for t in p.iter(w("t"))) for p in c.findall(w("p"))] for c in form.iter(w("tc"))] == [["City"], ["Selected: Bonn", "Options: Bonn, Ulm"]]
    assert [g.get(w("w")) for g in form.iter(w("gridCol"))] == ["3276", "6084"]
    table = body[3]
    shown = [[("".join(t.text for t in c.iter(w("t"))), (m := c.find(f"{w('tcPr')}/{w('vMerge')}")) is not None and (m.get(w("val")) or "on"), len(c.findall(w("p")))) for c in r.findall(w("tc"))] for r in table.findall(w("tr"))]
    assert shown == [[("Name", False, 1), ("Value", False, 1)], [("all rows", "restart", 1), ("12", False, 1)], [("", "on", 1), ("ab", False, 2)], [("", "on", 1), ("c", False, 1)]]
    assert [r.find(f"{w('trPr')}/{w('tblHeader')}") is not None for r in table.findall(w("tr"))] == [True, False, False, False]
    assert [n for n in z.namelist() if n.startswith("word/media/")].__len__() == 1 and len(list(body.iter(f"{{{docx.A}}}blip"))) == 2
    assert [c.get(w("id")) for c in ET.fromstring(z.read("word/comments.xml"))] == ["0", "1"] and len(list(body.iter(w("commentRangeStart")))) == 2
    assert {b.get(w("name")) for b in body.iter(w("bookmarkStart"))} == {"toc_1", "the_end"} and [h.get(w("anchor")) for h in body.iter(w("hyperlink"))] == ["toc_1", "the_end"]
    sizes = [(s.find(w("pgSz")).get(w("w")), s.find(w("pgMar")).get(w("left"))) for s in body.iter(w("sectPr"))]
    assert sizes == [("12240", "1440"), ("15840", "1800")]
