"""PDF files built in code: round trips of every reader and writer."""

import zlib

import numpy as np
import pytest

from leafmill.errors import InvalidDocument, WrongPassword
from leafmill.sources import pdf as source
from leafmill.sources import sinks
from leafmill.sources.pdfcontent import translated
from leafmill.sources.pdfobjects import Name, Pdf, Ref, Stream, Writer, rc4

CONTENT = b"BT /F1 12 Tf 72 700 Td (Hello \\(you\\)) Tj 0 -20 Td [(W) -50 (orld)] TJ ET q 2 w 0 0 0 RG 0.5 g 40 50 80 60 re B Q 10 10 m 90 10 l S q 100 0 0 50 20 30 cm /Im1 Do Q"


def made(title="Sample", pages=3, content=CONTENT):
    w = Writer()
    cmap = w.add(Stream({}, b"1 begincodespacerange <00> <FF> endcodespacerange 1 beginbfchar <57> <0056> endbfchar"))
    font = w.add({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica-Bold"), "ToUnicode": cmap})
    image = w.add(Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": 2, "Height": 1, "BitsPerComponent": 8, "ColorSpace": Name("DeviceRGB"), "Filter": Name("FlateDecode")}, zlib.compress(bytes([255, 0, 0, 0, 0, 255]))))
    link = w.add({"Type": Name("Annot"), "Subtype": Name("Link"), "Rect": [150, 80, 10, 60], "A": {"S": Name("URI"), "URI": b"https://a.example/"}})
    note = w.add({"Type": Name("Annot"), "Subtype": Name("Text"), "Rect": [1, 2, 3, 4], "Contents": "Größe", "T": b"Ann"})
    box = w.add({"Type": Name("Annot"), "Subtype": Name("Widget"), "Rect": [1, 2, 3, 4], "FT": Name("Btn"), "T": b"ok", "AS": Name("Yes")})
    for k in range(pages):
        body = w.add(Stream({"Filter": Name("FlateDecode")}, zlib.compress(content, 1)))
        w.kids.append(w.add({"Type": Name("Page"), "MediaBox": [0, 0, 612, 792 + k], "Contents": body, "Resources": {"Font": {"F1": font}, "XObject": {"Im1": image}}, "Annots": [link, note, box]}))
    return w.done({"/Title": title, "/Producer": "tests"})


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([("x/one file.pdf", made()), ("x/two.pdf", made("Zwei – 2", 1)), ("x/bad.pdf", b"not a pdf")], "path string, content binary")


def test_tables(spark, table):
    one = table.where("path like '%one%'")
    got = {t: source.read(one, t).collect() for t in source.TABLES}
    assert [(r.page_no, r.width, r.height) for r in got["pages"]] == [(0, 612.0, 792.0), (1, 612.0, 793.0), (2, 612.0, 794.0)]
    assert [(r.text, r.x, r.y, r.font_name, r.font_size) for r in got["fragments"]][:2] == [("Hello (you)", 72.0, 700.0, "Helvetica-Bold", 12.0), ("Vorld", 72.0, 680.0, "Helvetica-Bold", 12.0)]
    assert len([r for r in got["lines"] if r.page_no == 0]) == 5 and got["lines"][0].stroke_width == 2.0
    assert [(r.fill, r.rectangle, r.x_left, r.y_top) for r in got["paths"]][:1] == [("808080", True, 40.0, 110.0)]
    i = got["images"][0]
    assert i.data[:4] == b"\x89PNG" and (i.x_left, i.y_bottom, i.x_right, i.y_top) == (20.0, 30.0, 120.0, 80.0)
    assert [(r.uri, r.kind, r.x_left) for r in got["links"]][:1] == [("https://a.example/", "external", 10.0)]
    assert [(r.text, r.author) for r in got["annotations"]][:1] == [("Größe", "Ann")]
    assert [(r.field_type, r.label, r.checked) for r in got["fields"]][:1] == [("checkbox", "ok", True)]
    assert got["metadata"][0].metadata == {"/Title": "Sample", "/Producer": "tests"} and got["outline"] == [] and got["roles"] == []


def test_info(spark, table):
    got = {r.path: r for r in source.info(table).collect()}
    assert got["x/one file.pdf"].pages == 3 and got["x/two.pdf"].metadata["/Title"] == "Zwei – 2"
    assert not got["x/bad.pdf"].valid and got["x/bad.pdf"].error
    assert source.read(table.where("path like '%bad%'"), "pages").count() == 0 and source.info(table.limit(0)).count() == 0


def test_split_extract_merge(spark, table):
    good = table.where("path not like '%bad%'")
    parts = source.split(good.where("path like '%one%'"), ranges=[(1, 2), (3, 3), (2, 3)]).collect()
    assert [r.file for r in parts] == ["one_file_pages_1-2.pdf", "one_file_page_3.pdf", "one_file_pages_2-3.pdf"]
    assert [len(Pdf.load(bytes(r.content)).pages()) for r in parts] == [2, 1, 2]
    assert source.split(good, every=2).count() == 3 and source.split(good).count() == 4
    assert Pdf.load(bytes(source.extract(good.where("path like '%one%'"), [3, 1, 3]).first().content)).pages()[1][1]["MediaBox"][3] == 794
    with pytest.raises(Exception, match="no pages"):
        source.split(good, ranges=[(2, 9)]).collect()
    m = source.merge(good, "path").first()
    pdf = Pdf.load(bytes(m.content))
    assert m.pages == 4 and pdf.metadata()["/Title"] == "Sample"
    nodes = source.read(spark.createDataFrame([("m", bytes(m.content))], "path string, content binary"), "outline").collect()
    assert [(r.title, r.page_no) for r in nodes] == [("Sample", 0), ("Zwei – 2", 3)]


def test_passwords(spark, table):
    good = table.where("path like '%two%'")
    locked = source.protect(good, "user", "owner").selectExpr("file as path", "content")
    data = bytes(locked.first().content)
    with pytest.raises(WrongPassword):
        Pdf.load(data)
    assert Pdf.load(data, "owner").metadata()["/Title"] == Pdf.load(data, "user").metadata()["/Title"] == "Zwei – 2"
    assert source.info(locked).first().encrypted and not source.info(locked).first().valid
    opened = source.unprotect(locked, "user").first()
    assert not Pdf.load(bytes(opened.content)).encrypted
    assert rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    with pytest.raises(ValueError):
        source.protect(good, "")
    with pytest.raises(Exception, match="isn't encrypted"):
        source.unprotect(good, "x").collect()


def test_compression(spark, table):
    big = spark.createDataFrame([("b.pdf", made(content=CONTENT * 400))], "path string, content binary")
    r = source.compress(big, "high").first()
    assert r.compressed_size < r.original_size and r.bytes_saved == r.original_size - r.compressed_size
    assert len(Pdf.load(bytes(r.content)).pages()) == 3
    with pytest.raises(ValueError):
        source.compress(big, "most")


def test_archives_and_files(spark, table, tmp_path):
    parts = source.split(table.where("path like '%one%'")).withColumnRenamed("path", "group")
    a = sinks.archives(parts, "group")
    assert a.first().members == 3 and a.first().content == sinks.archives(parts, "group").first().content
    assert sinks.write_files(parts, str(tmp_path / "out")) == 3 and len(list((tmp_path / "out").iterdir())) == 3
    files = source.files(spark, str(tmp_path / "out"))
    assert source.info(files).where("valid").count() == 3


def test_longest_code_first():
    assert translated(b"abc", {b"ab": "X", b"a": "y", b"c": "see"}, 2) == "Xsee"


def test_damaged():
    data = made()
    assert len(Pdf.load(data[: data.rindex(b"xref")] + b"trailer <</Root 99 0 R>>").pages()) == 3
    with pytest.raises(InvalidDocument):
        Pdf.load(b"%PDF-1.4\n1 0 obj\n<<>>\nendobj")
    assert Pdf.load(data).get(Ref(10**6, 0)) is None


def test_pictures_are_downsampled(spark):
    import numpy as np

    from leafmill.sources.pdfobjects import Pdf, _downsampled

    rng = np.random.default_rng(1)
    pixels = rng.integers(0, 256, (40, 60, 3), dtype=np.uint8)
    w = Writer()
    image = w.add(Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": 60, "Height": 40, "BitsPerComponent": 8, "ColorSpace": Name("DeviceRGB"), "Filter": Name("FlateDecode")}, zlib.compress(pixels.tobytes(), 1)))
    body = w.add(Stream({}, b"q 100 0 0 50 20 30 cm /Im1 Do Q"))
    w.kids.append(w.add({"Type": Name("Page"), "MediaBox": [0, 0, 612, 792], "Contents": body, "Resources": {"XObject": {"Im1": image}}}))
    df = spark.createDataFrame([("a.pdf", w.done({}))], "path string, content binary")
    for level, size in (("low", (60, 40)), ("medium", (45, 30)), ("high", (30, 20))):
        r = source.compress(df, level).first()
        pdf = Pdf.load(r.content)
        found = next(o for o in pdf.objects.values() if isinstance(o, Stream) and o.attributes.get("Width"))
        assert (found.attributes["Width"], found.attributes["Height"]) == size
        if level == "high":
            want = np.rint(pixels.reshape(20, 2, 30, 2, 3).astype(float).mean((1, 3))).astype(np.uint8)
            assert pdf.decoded(found) == want.tobytes() and r.backend == "zlib"
    assert _downsampled(Pdf.load(df.first().content), {"Subtype": Name("Image"), "Width": 3, "Height": 1, "BitsPerComponent": 1}, b"x", 0.5) is None


def test_masks_and_many_names():
    from leafmill.sources import pdfcontent
    from leafmill.sources.pdfobjects import Pdf

    w = Writer()
    picture = {"Type": Name("XObject"), "Subtype": Name("Image"), "Width": 2, "Height": 2, "BitsPerComponent": 8, "ColorSpace": Name("DeviceRGB")}
    stencil = w.add(Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": 1, "Height": 2, "ImageMask": True, "BitsPerComponent": 1}, bytes([0x80, 0x00])))
    soft = w.add(Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": 2, "Height": 2, "BitsPerComponent": 8, "ColorSpace": Name("DeviceGray")}, bytes([1, 2, 3, 4])))
    samples = bytes([255, 0, 0] * 2 + [0, 0, 255] * 2)
    own = {"A": w.add(Stream({**picture, "Mask": stencil}, samples)), "B": w.add(Stream({**picture, "Mask": [250, 255, 0, 5, 0, 5]}, samples)), "C": w.add(Stream({**picture, "SMask": soft}, samples))}
    body = w.add(Stream({}, b"/A Do /B Do /C Do /A Do"))
    w.kids.append(w.add({"Type": Name("Page"), "MediaBox": [0, 0, 9, 9], "Contents": body, "Resources": {"XObject": own}}))
    pdf = Pdf.load(w.done({}))
    found = list(pdfcontent.images(pdf, pdf.pages()[0][1]))
    alpha = []
    for data, *_ in found:
        raw = zlib.decompress(data[data.index(b"IDAT") + 4 : data.index(b"IEND") - 8])
        alpha.append([raw[9 * y + 1 + 4 * x + 3] for y in range(2) for x in range(2)])
    assert alpha == [[0, 0, 255, 255], [0, 0, 255, 255], [1, 2, 3, 4], [0, 0, 255, 255]] and found[0][0] is found[3][0]
    # 12,000 names in a tree of leaves, with a leaf that leads back to its own node
    root = pdf.get(pdf.trailer["Root"])
    root["Names"] = {"Dests": {"Kids": [{"Names": [f"n{k:05}".encode(), [0, Name("XYZ"), 0, k]]} for k in range(12_000)]}}
    root["Names"]["Dests"]["Kids"].append({"Kids": [pdf.trailer["Root"], pdf.trailer["Root"]]})
    assert pdfcontent.destination(pdf, b"n11999") == ("n11999", 0, 11999.0) and pdfcontent.destination(pdf, b"none")[1] is None


def test_many_streams_are_encrypted_together(spark, monkeypatch):
    """Streams of all lengths give what each gives alone, and no file's passwords are tried one key stream at a time."""
    from leafmill.sources import pdfobjects

    rng = np.random.default_rng(3)
    jobs = [(rng.bytes(int(rng.integers(1, 17))), rng.bytes(int(n))) for n in [*range(300), 5_000, 0, 1, 20_000]]
    assert pdfobjects.rc4_all(jobs) == [rc4(key, data) for key, data in jobs]
    monkeypatch.setattr(pdfobjects, "_LANES", 64)
    assert pdfobjects.rc4_all(jobs) == [rc4(key, data) for key, data in jobs] and pdfobjects.rc4_all([]) == []

    def opened(data, password):
        try:
            return (yield from Pdf.loading(data, password)).metadata()["/Title"]
        except WrongPassword:
            return None

    df = spark.createDataFrame([(f"{k:03}.pdf", made(f"Title {k}", 1)) for k in range(40)], "path string, content binary")
    locked = [bytes(r.content) for r in source.protect(df, "user", "owner").orderBy("path").collect()]
    alone: list = []
    monkeypatch.setattr(pdfobjects, "rc4", lambda key, data: alone.append(key) or rc4(key, data))
    for password, want in (("user", True), ("owner", True), ("", False)):
        assert pdfobjects.together(opened(x, password) for x in locked) == [f"Title {k}" if want else None for k in range(40)]
    assert not alone
