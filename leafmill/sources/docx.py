"""DOCX files from paragraphs, with the standard library alone: one package a document, equal input gives equal bytes."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidDocument
from ..operators.folds import FORMATS, PUNCTUATIONS, fold
from ..operators.stats import DEFAULT_CREATED
from .sinks import member

# Namespaces, content types and relationship types of the package format.
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
P = "http://schemas.openxmlformats.org/package/2006"
CP = "http://schemas.openxmlformats.org/package/2006/metadata/core-properties"
DC, TERMS, XSI = "http://purl.org/dc/elements/1.1/", "http://purl.org/dc/terms/", "http://www.w3.org/2001/XMLSchema-instance"
APP = "http://schemas.openxmlformats.org/officeDocument/2006/extended-properties"
WORD = "application/vnd.openxmlformats-officedocument.wordprocessingml."
TYPES = {
    "/word/document.xml": WORD + "document.main+xml",
    "/word/styles.xml": WORD + "styles+xml",
    "/word/numbering.xml": WORD + "numbering+xml",
    "/word/footnotes.xml": WORD + "footnotes+xml",
    "/word/comments.xml": WORD + "comments+xml",
    "/docProps/core.xml": "application/vnd.openxmlformats-package.core-properties+xml",
    "/docProps/app.xml": "application/vnd.openxmlformats-officedocument.extended-properties+xml",
}
# Parts that may be there several times, picture formats, style names and their sizes in half points.
NUMBERED = {"header": WORD + "header+xml", "footer": WORD + "footer+xml"}
PICTURES = {"image/png": "png", "image/jpeg": "jpeg", "image/gif": "gif", "image/bmp": "bmp"}
STYLES = ["Normal", "Title", "Subtitle", "Heading1", "Heading2", "Heading3", "ListParagraph", "Quote", "Caption", "Code"]
HEADING_SIZES = {"Title": 48, "Subtitle": 28, "Heading1": 32, "Heading2": 26, "Heading3": 22}
ALIGNMENTS = {"left": "left", "right": "right", "center": "center", "both": "both"}
BREAKS = {"line": None, "page": "page", "column": "column"}
#: What XML can't hold.
_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]")

# Namespaces of drawings.
DRAWING = "http://schemas.openxmlformats.org/drawingml/2006"
WP, A, PIC = f"{DRAWING}/wordprocessingDrawing", f"{DRAWING}/main", f"{DRAWING}/picture"
#: A section where none is given: US letter with margins of an inch.
PLAIN = {"width": 612.0, "height": 792.0, "margin_left": 72.0, "margin_right": 72.0, "margin_top": 72.0, "margin_bottom": 72.0, "columns": 1, "spacing": None}

for _prefix, _uri in (("wp", WP), ("a", A), ("pic", PIC), ("w", W), ("r", R), ("cp", CP), ("dc", DC), ("dcterms", TERMS), ("xsi", XSI)):
    ET.register_namespace(_prefix, _uri)


def _w(tag: str) -> str:
    return f"{{{W}}}{tag}"


def _add(parent: ET.Element, tag: str, text: str | None = None, **attributes: object) -> ET.Element:
    e = ET.SubElement(parent, _w(tag), {_w(k): str(v) for k, v in attributes.items()})
    if text is not None:
        e.text = text
    return e


def _xml(root: ET.Element) -> bytes:
    return ET.tostring(root, "utf-8", xml_declaration=True)


def _type_of(name: str) -> str | None:
    """The content type of a part that must be declared by its name."""
    kind = re.fullmatch(r"word/(header|footer)\d+\.xml", name)
    return NUMBERED[kind[1]] if kind else TYPES.get(f"/{name}")


class Package:
    """The parts of one document while it is built."""

    def __init__(self) -> None:
        self.related: list[tuple[str, str, str, bool]] = [("rId1", "styles", "styles.xml", False), ("rId2", "numbering", "numbering.xml", False)]
        self.targets: dict[str, str] = {}
        self.media: dict[str, bytes] = {}
        self.edges: dict[str, bytes] = {}
        self.comments: list[tuple[str, str]] = []
        self.footnotes: list[str] = []
        self.bookmarks = 0
        self.body = ET.Element(_w("document"))
        self.place = ET.SubElement(self.body, _w("body"))

    def relation(self, kind: str, target: str, outside: bool = False) -> str:
        self.related.append((f"rId{len(self.related) + 1}", kind, target, outside))
        return self.related[-1][0]

    def link(self, target: str) -> str:
        """The relationship of a target; equal targets share one."""
        if target not in self.targets:
            self.targets[target] = self.relation("hyperlink", target, True)
        return self.targets[target]

    def paragraph(self, p: dict, parent: ET.Element | None = None) -> None:
        e = _add(self.place if parent is None else parent, "p")
        form = ET.Element(_w("pPr"))
        if p.get("style"):
            _add(form, "pStyle", val=p["style"])
        if p.get("page_break"):
            _add(form, "pageBreakBefore")
        if p.get("number_id"):
            n = _add(form, "numPr")
            _add(n, "ilvl", val=max(0, min(p.get("level") or 0, 8)))
            _add(n, "numId", val=p["number_id"])
        if p.get("space_before") or p.get("space_after"):
            _add(form, "spacing", **{k: round((p.get(f"space_{k}") or 0) * 20) for k in ("before", "after")})
        if p.get("indent"):
            _add(form, "ind", left=round(p["indent"] * 20))
        if p.get("alignment") in ALIGNMENTS:
            _add(form, "jc", val=ALIGNMENTS[p["alignment"]])
        if len(form):
            e.append(form)
        if p.get("column_break"):
            _add(_add(e, "r"), "br", type="column")
        for name in p.get("bookmarks") or []:
            _add(e, "bookmarkStart", id=self.bookmarks, name=name)
            _add(e, "bookmarkEnd", id=self.bookmarks)
            self.bookmarks += 1
        notes = list(p.get("comments") or []) + ([{"author": p.get("comment_author"), "text": p["comment"]}] if p.get("comment") else [])
        first = len(self.comments)
        for k, c in enumerate(notes, first):
            self.comments.append((c.get("author") or "", c.get("text") or ""))
            _add(e, "commentRangeStart", id=k)
        for run in p.get("runs") or []:
            self._run(e, run)
        for k in range(first, first + len(notes)):
            _add(e, "commentRangeEnd", id=k)
            _add(_add(e, "r"), "commentReference", id=k)
        if p.get("footnote"):
            self.footnotes.append(p["footnote"])
            _add(_add(e, "r"), "footnoteReference", id=len(self.footnotes) + 1)

    def table(self, cells: list[dict]) -> None:
        """A grid of cells with spans; what a cell spans below it continues there, and places without a cell are empty."""
        rows, columns = max(c["row_no"] + c["row_span"] for c in cells), max(c["column_no"] + c["column_span"] for c in cells)
        grid: dict[tuple[int, int], tuple[dict, bool]] = {}
        for c in sorted(cells, key=lambda c: (c["row_no"], c["column_no"])):
            for r in range(c["row_no"], c["row_no"] + c["row_span"]):
                grid.setdefault((r, c["column_no"]), (c, r > c["row_no"]))
        table = _add(self.place, "tbl")
        form = _add(table, "tblPr")
        _add(form, "tblW", w=0, type="auto")
        borders = _add(form, "tblBorders")
        for side in ("top", "left", "bottom", "right", "insideH", "insideV"):
            _add(borders, side, val="single", sz=4, space=0, color="auto")
        widths = _add(table, "tblGrid")
        shares = {c["column_no"]: c.get("share") for c in cells}
        for k in range(columns):
            _add(widths, "gridCol", w=round(9360 * (shares.get(k) or 1 / columns)))
        heads = {r for r in range(rows) if any(c["row_no"] == r for c in cells) and all(c["header_row"] for c in cells if c["row_no"] == r)}
        leading = next((r for r in range(rows) if r not in heads), rows)
        for r in range(rows):
            row = _add(table, "tr")
            if r < leading:
                _add(_add(row, "trPr"), "tblHeader")
            k = 0
            while k < columns:
                c, goes_on = grid.get((r, k), (None, False))
                span = 1
                if c:
                    while span < c["column_span"] and (r, k + span) not in grid:
                        span += 1
                cell = _add(row, "tc")
                form = _add(cell, "tcPr")
                if span > 1:
                    _add(form, "gridSpan", val=span)
                if c and c["row_span"] > 1:
                    _add(form, "vMerge", **({} if goes_on else {"val": "restart"}))
                texts = [x for o in cells if o["row_no"] == r and o["column_no"] == k for x in (o["text"] or "").split("\n")] if c and not goes_on else []
                for text in texts or [""]:
                    runs = [{"text": text, "bold": c["header"]}] if c and text else []
                    self.paragraph({"runs": runs, "alignment": c["alignment"] if c and text else None}, cell)
                k += span

    def picture(self, image: dict) -> None:
        """A picture in a paragraph of its own; equal pictures are one part."""
        mime = image["mime_type"] if image["mime_type"] in PICTURES else "image/png"
        name = f"media/{hashlib.sha256(image['data']).hexdigest()[:16]}.{PICTURES[mime]}"
        if name not in self.media:
            self.media[name] = bytes(image["data"])
            self.targets[name] = self.relation("image", name)
        wide, high = (max(1, round(max(image[k] or 1.0, 1.0) * 12_700)) for k in ("width", "height"))
        drawing = _add(_add(_add(self.place, "p"), "r"), "drawing")
        box = ET.SubElement(drawing, f"{{{WP}}}inline")
        ET.SubElement(box, f"{{{WP}}}extent", {"cx": str(wide), "cy": str(high)})
        ET.SubElement(box, f"{{{WP}}}docPr", {"id": str(image["number"]), "name": f"Picture {image['number']}"})
        data = ET.SubElement(ET.SubElement(box, f"{{{A}}}graphic"), f"{{{A}}}graphicData", {"uri": PIC})
        pic = ET.SubElement(data, f"{{{PIC}}}pic")
        head = ET.SubElement(pic, f"{{{PIC}}}nvPicPr")
        ET.SubElement(head, f"{{{PIC}}}cNvPr", {"id": str(image["number"]), "name": name.split("/")[1]})
        ET.SubElement(head, f"{{{PIC}}}cNvPicPr")
        fill = ET.SubElement(pic, f"{{{PIC}}}blipFill")
        ET.SubElement(fill, f"{{{A}}}blip", {f"{{{R}}}embed": self.targets[name]})
        ET.SubElement(ET.SubElement(fill, f"{{{A}}}stretch"), f"{{{A}}}fillRect")
        shape = ET.SubElement(pic, f"{{{PIC}}}spPr")
        size = ET.SubElement(shape, f"{{{A}}}xfrm")
        ET.SubElement(size, f"{{{A}}}off", {"x": "0", "y": "0"})
        ET.SubElement(size, f"{{{A}}}ext", {"cx": str(wide), "cy": str(high)})
        ET.SubElement(ET.SubElement(shape, f"{{{A}}}prstGeom", {"prst": "rect"}), f"{{{A}}}avLst")

    def section(self, section: dict, edges: list[dict], last: bool) -> None:
        """The end of a section: in the last paragraph before it, or at the end of the body."""
        end = ET.Element(_w("sectPr"))
        for x in sorted(edges, key=lambda x: (x["kind"] != "header", x["variant"])):
            name = f"{x['kind']}{len(self.edges) + 1}.xml"
            self.edges[f"word/{name}"] = _edge(x["kind"], x["texts"])
            ET.SubElement(end, _w(f"{x['kind']}Reference"), {_w("type"): x["variant"], f"{{{R}}}id": self.relation(x["kind"], name)})
        _add(end, "pgSz", w=round(section["width"] * 20), h=round(section["height"] * 20), **({"orient": "landscape"} if section["width"] > section["height"] else {}))
        _add(end, "pgMar", **{k: round(section[f"margin_{k}"] * 20) for k in ("top", "right", "bottom", "left")}, header=720, footer=720, gutter=0)
        if (section["columns"] or 1) > 1:
            _add(end, "cols", num=section["columns"], space=round((section["spacing"] or 36.0) * 20))
        if any(x["variant"] == "first" for x in edges):
            _add(end, "titlePg")
        if last:
            self.place.append(end)
            return
        before = self.place[-1] if len(self.place) and self.place[-1].tag == _w("p") else _add(self.place, "p")
        form = before.find(_w("pPr"))
        if form is None:
            form = ET.Element(_w("pPr"))
            before.insert(0, form)
        form.append(end)

    def _run(self, parent: ET.Element, run: dict) -> None:
        target = run.get("hyperlink_target")
        if target and target.startswith("#"):
            parent = _add(parent, "hyperlink", anchor=target[1:])
        elif target:
            parent = ET.SubElement(parent, _w("hyperlink"), {f"{{{R}}}id": self.link(target)})
        r = _add(parent, "r")
        form = ET.Element(_w("rPr"))
        if target:
            _add(form, "rStyle", val="Hyperlink")
        if font := re.sub(r"^[A-Z]{6}\+", "", _ILLEGAL.sub("", run.get("font_name") or "")):
            _add(form, "rFonts", ascii=font, hAnsi=font)
        for flag, tag in (("bold", "b"), ("italic", "i")):
            if run.get(flag):
                _add(form, tag)
        if run.get("underline"):
            _add(form, "u", val="single")
        if run.get("font_size"):
            _add(form, "sz", val=round(run["font_size"] * 2))
        if run.get("language"):
            _add(form, "lang", val=run["language"])
        if len(form):
            r.append(form)
        for k, part in enumerate(_ILLEGAL.sub("", run.get("text") or "").split("\n")):
            if k:
                _add(r, "br")
            if part:
                t = _add(r, "t", part)
                if part != part.strip():
                    t.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
        if run.get("break_type"):
            kind = BREAKS.get(run["break_type"])
            _add(r, "br", **({"type": kind} if kind else {}))

    def parts(self, core: dict, stats: dict) -> dict[str, bytes]:
        out = {"word/document.xml": _xml(self.body), "word/styles.xml": _styles(), "word/numbering.xml": _numbering(), "docProps/core.xml": _core(core), "docProps/app.xml": _app(stats)}
        out |= self.edges | {f"word/{n}": x for n, x in self.media.items()}
        for name, entries in (("footnotes", [("", t) for t in self.footnotes]), ("comments", self.comments)):
            if entries:
                out[f"word/{name}.xml"] = _notes(name, entries)
                self.relation(name, f"{name}.xml")
        out["word/_rels/document.xml.rels"] = _relations(self.related)
        main = [("rId1", "officeDocument", "word/document.xml", False), ("rId2", P + "/relationships/metadata/core-properties", "docProps/core.xml", False), ("rId3", "extended-properties", "docProps/app.xml", False)]
        out["_rels/.rels"] = _relations(main)
        out["[Content_Types].xml"] = _types(out)
        check(out)
        return out


def _edge(name: str, texts: list[str]) -> bytes:
    """A running header, or a footer with fields of the page's number and of all pages."""
    root = ET.Element(_w("hdr" if name == "header" else "ftr"))
    for text in texts:
        for line in _ILLEGAL.sub("", text).split("\n"):
            _add(_add(_add(root, "p"), "r"), "t", line.strip())
    if name == "footer":
        e = _add(root, "p")
        for field in ("PAGE", "NUMPAGES"):
            if field == "NUMPAGES":
                _add(_add(e, "r"), "t", "/")
            _add(e, "fldSimple", instr=field)
    return _xml(root)


def _notes(name: str, entries: list[tuple[str, str]]) -> bytes:
    root = ET.Element(_w(name))
    first = 2 if name == "footnotes" else 0
    for k, (author, text) in enumerate(entries):
        e = _add(root, name[:-1], id=k + first, **({"author": _ILLEGAL.sub("", author), "date": DEFAULT_CREATED} if name == "comments" else {}))
        for line in _ILLEGAL.sub("", text).split("\n"):
            _add(_add(_add(e, "p"), "r"), "t", line.strip())
    return _xml(root)


def _styles() -> bytes:
    root = ET.Element(_w("styles"))
    for name in STYLES:
        s = _add(root, "style", type="paragraph", styleId=name, **({"default": 1} if name == "Normal" else {}))
        _add(s, "name", val=re.sub(r"(?<=[a-z])(?=\d)", " ", name).lower() if name.startswith("Heading") else name)
        if name != "Normal":
            _add(s, "basedOn", val="Normal")
        if name in HEADING_SIZES:
            form = _add(s, "rPr")
            _add(form, "b")
            _add(form, "sz", val=HEADING_SIZES[name])
    link = _add(root, "style", type="character", styleId="Hyperlink")
    _add(link, "name", val="Hyperlink")
    form = _add(link, "rPr")
    _add(form, "color", val="0563C1")
    _add(form, "u", val="single")
    return _xml(root)


def _numbering() -> bytes:
    """Bullets and every format with every punctuation, each with nine levels that take turns over three formats."""
    root = ET.Element(_w("numbering"))
    turns = {"decimal": ("decimal", "lowerLetter", "lowerRoman"), "lowerLetter": ("lowerLetter", "lowerRoman", "decimal"), "upperLetter": ("upperLetter", "upperRoman", "decimal"), "lowerRoman": ("lowerRoman", "decimal", "lowerLetter"), "upperRoman": ("upperRoman", "decimal", "upperLetter")}
    marks = {"dot": "%{}.", "paren": "%{})", "enclosed": "(%{})"}
    schemes = [("bullet", "dot"), *((f, p) for f in FORMATS for p in PUNCTUATIONS)]
    for k, (form, mark) in enumerate(schemes, 1):
        a = _add(root, "abstractNum", abstractNumId=k)
        for level in range(9):
            e = _add(a, "lvl", ilvl=level)
            _add(e, "start", val=1)
            _add(e, "numFmt", val=form if form == "bullet" else turns[form][level % 3])
            _add(e, "lvlText", val="•" if form == "bullet" else marks[mark].format(level + 1))
    for k in range(1, len(schemes) + 1):
        _add(_add(root, "num", numId=k), "abstractNumId", val=k)
    return _xml(root)


def _core(core: dict) -> bytes:
    root = ET.Element(f"{{{CP}}}coreProperties")
    for ns, tag, key in ((DC, "title", "title"), (DC, "creator", "creator"), (DC, "subject", "subject"), (CP, "keywords", "keywords"), (CP, "lastModifiedBy", "last_modified_by"), (CP, "revision", "revision"), (DC, "language", "language")):
        if core.get(key):
            ET.SubElement(root, f"{{{ns}}}{tag}").text = _ILLEGAL.sub("", str(core[key]))
    for tag in ("created", "modified"):
        ET.SubElement(root, f"{{{TERMS}}}{tag}", {f"{{{XSI}}}type": "dcterms:W3CDTF"}).text = core.get(tag) or DEFAULT_CREATED
    return _xml(root)


def _app(stats: dict) -> bytes:
    root = ET.Element(f"{{{APP}}}Properties")
    for tag, key in (("Pages", "pages"), ("Words", "words"), ("Characters", "characters"), ("Lines", "lines"), ("Paragraphs", "paragraphs"), ("CharactersWithSpaces", "characters_with_spaces")):
        ET.SubElement(root, f"{{{APP}}}{tag}").text = str(stats[key])
    return _xml(root)


def _relations(related: list[tuple[str, str, str, bool]]) -> bytes:
    root = ET.Element(f"{{{P}/relationships}}Relationships")
    for i, kind, target, outside in related:
        ET.SubElement(root, f"{{{P}/relationships}}Relationship", {"Id": i, "Type": kind if "/" in kind else f"{R}/{kind}", "Target": target} | ({"TargetMode": "External"} if outside else {}))
    return _xml(root)


def _types(parts: dict[str, bytes]) -> bytes:
    root = ET.Element(f"{{{P}/content-types}}Types")
    pictures = [(ending, mime) for mime, ending in PICTURES.items() if any(n.endswith(f".{ending}") for n in parts)]
    for ending, kind in (("rels", "application/vnd.openxmlformats-package.relationships+xml"), ("xml", "application/xml"), *pictures):
        ET.SubElement(root, f"{{{P}/content-types}}Default", {"Extension": ending, "ContentType": kind})
    for name in sorted(parts):
        if kind := _type_of(name):
            ET.SubElement(root, f"{{{P}/content-types}}Override", {"PartName": f"/{name}", "ContentType": kind})
    return _xml(root)


def check(parts: dict[str, bytes]) -> None:
    """The package is well-formed, relationship ids are unique, their targets exist, and each typed part is declared."""
    try:
        trees = {n: ET.fromstring(x) for n, x in parts.items() if n.endswith((".xml", ".rels"))}
    except ET.ParseError as e:
        raise InvalidDocument(f"a part isn't well-formed: {e}") from e
    for name, tree in trees.items():
        if not name.endswith(".rels"):
            continue
        base = name.split("_rels/")[0]
        ids = [r.get("Id") for r in tree]
        if len(ids) != len(set(ids)):
            raise InvalidDocument(f"{name} has an id twice")
        for r in tree:
            if r.get("TargetMode") != "External" and base + r.get("Target") not in parts:
                raise InvalidDocument(f"{name} leads to {r.get('Target')}, which isn't there")
    declared = {o.get("PartName") for o in trees["[Content_Types].xml"] if o.get("PartName")}
    if declared != {f"/{n}" for n in parts if _type_of(n)}:
        raise InvalidDocument("the declared parts aren't those of the package")


def _stats(rows: list[dict], pages: int) -> dict:
    out = dict.fromkeys(("paragraphs", "words", "lines", "characters", "characters_with_spaces"), 0)
    for p in rows:
        text = "".join(r.get("text") or "" for r in p.get("runs") or [])
        bare = text.strip()
        out["paragraphs"] += 1
        out["characters_with_spaces"] += len(text)
        if bare:
            out["words"] += len(bare.split())
            out["lines"] += bare.count("\n") + 1
            out["characters"] += len(bare)
    return out | {"pages": pages}


_PARAGRAPH = ("style", "alignment", "indent", "space_before", "space_after", "number_id", "level", "page_break", "column_break", "comment", "comment_author", "comments", "footnote", "bookmarks")


def packages(
    paragraphs: DataFrame,
    core: DataFrame,
    pages: DataFrame | None = None,
    sections: DataFrame | None = None,
    edges: DataFrame | None = None,
    tables: DataFrame | None = None,
    pictures: DataFrame | None = None,
) -> DataFrame:
    """``doc_id, file, content`` and statistics: one DOCX file of each document's paragraphs, tables and pictures, in order.

    ``paragraphs`` have ``doc_id, page_no, para_idx, runs`` and, where they are known, ``section_no``, ``place`` (numbers in
    whose order all is written) and the columns of _PARAGRAPH; ``core`` has the core properties of each ``doc_id``.
    ``sections`` have ``doc_id, section_no`` and sizes, ``edges`` their running ``kind, variant, texts``, ``tables`` cells and
    ``pictures`` an image for each ``place``. A document without properties gets defaults; one without anything but
    ``pages`` gets a file too. A document is built in one task, its properties come with one row.
    """
    place, no_section = F.array(F.col("page_no").cast("double"), F.col("para_idx").cast("double")), F.lit(0)
    own = lambda df, name, default: F.col(name) if name in df.columns else default.alias(name)
    known = [c for c in _PARAGRAPH if c in paragraphs.columns]
    rows = paragraphs.select("doc_id", own(paragraphs, "place", place), own(paragraphs, "section_no", no_section), "page_no", F.struct("runs", *known).alias("paragraph"))
    if tables is not None:
        rows = rows.unionByName(tables.select("doc_id", "place", "section_no", "page_no", "cells"), allowMissingColumns=True)
    if pictures is not None:
        rows = rows.unionByName(pictures.select("doc_id", "place", "section_no", "page_no", "image"), allowMissingColumns=True)
    docs = pages.groupBy("doc_id").agg(F.max("width").alias("w"), F.max("height").alias("h"), F.count("*").alias("n")) if pages is not None else paragraphs.select("doc_id").distinct()
    heads = docs.join(core.select("doc_id", F.struct(*(c for c in core.columns if c != "doc_id")).alias("core")), "doc_id", "left")
    if sections is not None:
        of_doc = sections.groupBy("doc_id").agg(F.collect_list(F.struct("section_no", *PLAIN)).alias("sections"))
        heads = heads.join(of_doc, "doc_id", "left")
    if edges is not None:
        heads = heads.join(edges.groupBy("doc_id").agg(F.collect_list(F.struct("section_no", "kind", "variant", "texts")).alias("edges")), "doc_id", "left")
    head = F.struct(*(c for c in heads.columns if c != "doc_id")).alias("head")
    both = rows.unionByName(heads.select("doc_id", F.array(F.lit(-1.0)).alias("place"), head), allowMissingColumns=True)

    def step(rows: list[dict]) -> Iterator[tuple]:
        head = next((r["head"] for r in rows if r["head"]), {})
        items = [r for r in rows if not r["head"]]
        sizes = {x["section_no"]: x for x in head.get("sections") or []}
        plain = PLAIN | {k: head[n] for k, n in (("width", "w"), ("height", "h")) if head.get(n)}
        edges: dict[int, list[dict]] = {}
        for x in head.get("edges") or []:
            edges.setdefault(x["section_no"], []).append(x)
        package, number = Package(), 0
        now = items[0]["section_no"] if items else min(sizes, default=0)
        for r in items:
            if r["section_no"] != now:
                package.section(sizes.get(now, plain), edges.get(now, []), False)
                now = r["section_no"]
            if r.get("cells"):
                package.table(r["cells"])
            elif r.get("image"):
                number += 1
                package.picture(r["image"] | {"number": number})
            else:
                package.paragraph(r["paragraph"])
        package.section(sizes.get(now, plain), edges.get(now, []), True)
        counted = [r["paragraph"] for r in items if r.get("paragraph")] + [{"runs": [{"text": c["text"]}]} for r in items for c in r.get("cells") or []]
        seen = [r["page_no"] for r in items]
        stats = _stats(counted, head.get("n") or (1 + max(seen) - min(seen) if seen else 0))
        parts = package.parts(head.get("core") or {}, stats)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name in sorted(parts, key=lambda n: (n != "[Content_Types].xml", n)):
                z.writestr(member(name), parts[name])
        yield f"{rows[0]['doc_id']}.docx", out.getvalue(), *(stats[k] for k in ("pages", "paragraphs", "words", "lines", "characters"))

    return fold(both, ["doc_id"], [F.col("place")], step, "file string, content binary, pages int, paragraphs int, words int, lines int, characters int")
