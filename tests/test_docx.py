"""DOCX packages: parts, relationships, statistics, equal bytes."""

import io
import zipfile
from xml.etree import ElementTree as ET

import pytest

from leafmill.errors import InvalidDocument
from leafmill.queries import queries
from leafmill.sources import docx
from leafmill.session import table

from .conftest import SF

RUN = "struct<text: string, break_type: string, font_name: string, font_size: double, bold: boolean, italic: boolean, underline: boolean, language: string, hyperlink_target: string>"


def test_package(spark):
    r = lambda text, **k: (text, k.get("brk"), None, 11.0, True, False, False, "en-US", k.get("link"))
    rows = [
        ("d", 0, 0, "Heading1", None, 1, 0, [r("Metadata \x00sample "), r("content", link="https://a.example/")], "see\nthis", None),
        ("d", 0, 1, None, "both", None, None, [r("again", link="https://a.example/"), r("", brk="page")], None, "a note"),
        ("e", 0, 0, None, None, None, None, None, None, None),
    ]
    p = spark.createDataFrame(rows, f"doc_id string, page_no int, para_idx int, style string, alignment string, number_id int, level int, runs array<{RUN}>, comment string, footnote string")
    core = spark.createDataFrame([("d", "T", "Ann")], "doc_id string, title string, creator string")
    found = {x.doc_id: x for x in docx.packages(p, core).collect()}
    d = found["d"]
    assert (d.paragraphs, d.words, d.lines, d.pages) == (2, 4, 2, 1) and found["e"].words == 0
    z = zipfile.ZipFile(io.BytesIO(d.content))
    assert z.namelist()[0] == "[Content_Types].xml" and {"word/comments.xml", "word/footnotes.xml"} <= set(z.namelist())
    assert {i.date_time for i in z.infolist()} == {(2023, 1, 1, 0, 0, 0)}
    body = ET.fromstring(z.read("word/document.xml"))
    links = body.findall(f".//{{{docx.W}}}hyperlink")
    assert len(links) == 2 and len({x.get(f"{{{docx.R}}}id") for x in links}) == 1
    assert "".join(body.itertext()) == "Metadata sample contentagain"
    assert ET.fromstring(z.read("docProps/core.xml")).findtext(f"{{{docx.DC}}}title") == "T"
    again = docx.packages(p, core).where("doc_id = 'd'").first()
    assert again.content == d.content
    assert docx.packages(p.limit(0), core).count() == 0


def test_checks():
    with pytest.raises(InvalidDocument):
        docx.check({"a.xml": b"<a>"})


def test_tables_to_files(spark):
    made = queries()["docx_files"](spark, SF)
    assert made.count() == table(spark, SF, "paragraphs").select("doc_id").distinct().count()
