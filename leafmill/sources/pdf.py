"""PDF files in and out of Spark.

``files`` reads a folder as ``path, content``; every other function takes such a table, works on one file at a time inside
the executors and gives rows or files as bytes. A file that can't be read gives no rows but an ``error`` from ``info``.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..errors import InvalidDocument, LeafmillError
from ..operators.folds import fold
from ..session import staged
from . import pdfcontent as content
from .pdfobjects import Asking, Name, Pdf, Stream, Writer, stem, together

_EDGES = "x_left double, y_bottom double, x_right double, y_top double"
#: Tables of what files hold, and their columns behind ``path``.
TABLES = {
    "pages": "page_no int, width double, height double, rotation int",
    "fragments": "page_no int, frag_idx int, text string, x double, y double, font_name string, font_size double, vertical boolean",
    "lines": "page_no int, line_idx int, x0 double, y0 double, x1 double, y1 double, stroke_width double",
    "paths": "page_no int, path_idx int, subpaths array<array<struct<x: double, y: double>>>, stroke string, fill string, stroke_width double, fill_rule string, stroke_alpha double, alpha double, rectangle boolean, " + _EDGES,
    "images": "page_no int, image_idx int, data binary, " + _EDGES + ", mime_type string, name string",
    "links": "page_no int, link_idx int, " + _EDGES + ", uri string, anchor string, tooltip string, kind string, destination_page int, destination_top double",
    "annotations": "page_no int, annot_idx int, " + _EDGES + ", text string, author string, subtype string",
    "fields": "page_no int, field_idx int, " + _EDGES + ", field_type string, name string, label string, value string, checked boolean, options array<string>, tooltip string, read_only boolean, multiline boolean",
    "outline": "node_id int, parent_id int, ord int, title string, page_no int, top double, anchor string",
    "roles": "page_no int, role_idx int, role string",
    "metadata": "metadata map<string, string>",
}


def files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """``path`` and ``content`` of the files of a folder and those below it."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "content")


def _each(df: DataFrame, step: Callable[[str, bytes], Iterable[tuple]], schema: str) -> DataFrame:
    """Rows of ``step(path, content)``, a file at a time."""
    parsed = _parse_datatype_string("path string, " + schema)
    arrow = to_arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0), batch.column(1)):
                rows = [(path.as_py(), *r) for r in step(path.as_py(), data.as_py())] if data.is_valid else []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), arrow.types)], schema=arrow)

    return df.select("path", "content").mapInArrow(run, parsed)


#: Files, and their bytes, that are encrypted side by side at most; a larger file is taken alone.
_SIDE_BY_SIDE, _BYTES = 64, 8_000_000


def _each_locked(df: DataFrame, step: Callable[[str, bytes], Asking], schema: str) -> DataFrame:
    """As ``_each`` for steps that encrypt: they run side by side and return their rows."""
    parsed = _parse_datatype_string("path string, " + schema)
    arrow = to_arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[tuple[str, bytes]] = []
        size = 0

        def made() -> Iterator[pa.RecordBatch]:
            for (path, _), found in zip(some, together(step(*x) for x in some)):
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*((path, *r) for r in found)), arrow.types)], schema=arrow)

        for batch in batches:
            for path, data in zip(batch.column(0), batch.column(1)):
                if not data.is_valid:
                    continue
                content = data.as_py()
                if some and (len(some) >= _SIDE_BY_SIDE or size + len(content) > _BYTES):
                    yield from made()
                    some, size = [], 0
                some.append((path.as_py(), content))
                size += len(content)
        yield from made()

    return df.select("path", "content").mapInArrow(run, parsed)


def _rows(pdf: Pdf, table: str) -> Iterator[tuple]:
    if table == "outline":
        yield from content.outline(pdf)
        return
    if table == "roles":
        yield from content.roles(pdf)
        return
    if table == "metadata":
        yield (list(pdf.metadata().items()),)
        return
    for k, (_, page) in enumerate(pdf.pages()):
        if table == "pages":
            box = content._box(pdf, page.get("MediaBox")) or (0.0, 0.0, 612.0, 792.0)
            yield k, float(box[2] - box[0]), float(box[3] - box[1]), int(pdf.get(page.get("Rotate")) or 0) % 360
            continue
        if table == "lines":
            found = content.graphics(pdf, page)[0]
        elif table == "paths":
            found = [_path_row(p) for p in content.graphics(pdf, page)[1]]
        else:
            found = {"fragments": content.fragments, "images": content.images, "links": content.links, "annotations": content.notes, "fields": content.fields}[table](pdf, page)
        for i, row in enumerate(found):
            yield k, i, *row


def _path_row(p: tuple) -> tuple:
    parts, stroke, fill, width, rule, ca, alpha, box = p
    xs, ys = [x for s in parts for x, _ in s], [y for s in parts for _, y in s]
    return [[{"x": x, "y": y} for x, y in s] for s in parts], content.hex_of(stroke), content.hex_of(fill), width, rule, ca, alpha, box, min(xs), min(ys), max(xs), max(ys)


def read(df: DataFrame, table: str, password: str = "") -> DataFrame:
    """One of ``TABLES``: only what it needs is decoded. Files that can't be read have no rows."""

    def step(_: str, data: bytes) -> list[tuple]:
        try:
            return list(_rows(Pdf.load(data, password), table))
        except LeafmillError:
            return []

    return _each(df, step, TABLES[table])


def read_tables(df: DataFrame, tables: list[str], password: str = "") -> dict[str, DataFrame]:
    """Several of ``TABLES`` from one reading of each file, which is written once to the shared folder."""

    def step(_: str, data: bytes) -> Iterator[tuple]:
        try:
            pdf = Pdf.load(data, password)
            rows = [(k, row) for k, name in enumerate(tables) for row in _rows(pdf, name)]
        except LeafmillError:
            return
        for k, row in rows:
            own: list = [None] * len(tables)
            own[k] = dict(zip(fields[k], row))
            yield tables[k], *own

    parsed = [_parse_datatype_string(TABLES[t]) for t in tables]
    fields = [p.fieldNames() for p in parsed]
    schema = "kind string, " + ", ".join(f"`{t}` struct<{', '.join(f'{f.name}: {f.dataType.simpleString()}' for f in p.fields)}>" for t, p in zip(tables, parsed))
    made = staged(_each(df, step, schema), "pdf")
    return {t: made.where(F.col("kind") == t).select("path", f"{t}.*") for t in tables}


def _page_of_text(rows: list[dict], codes: dict[str, int], fonts: dict[str | None, str]) -> Stream:
    """The content of a page that shows each fragment at its place."""
    out = []
    for r in rows:
        font = fonts.setdefault(r["font_name"], f"F{len(fonts) + 1}")
        shown = "".join(f"{codes.setdefault(ch, len(codes) + 1):04X}" for ch in r["text"])
        turn = "0 1 -1 0" if r["vertical"] else "1 0 0 1"
        out.append(f"BT /{font} {r['font_size'] or 12.0:.4f} Tf {turn} {r['x']:.4f} {r['y']:.4f} Tm <{shown}> Tj ET")
    return Stream({"Filter": Name("FlateDecode")}, zlib.compress("\n".join(out).encode("ascii"), 6))


def from_fragments(fragments: DataFrame, pages: DataFrame) -> DataFrame:
    """``path, content``: a PDF file of each document's pages with its fragments of text at their places.

    ``fragments`` as ``read`` gives them with ``doc_id``, ``pages`` have ``doc_id, page_no, width, height``. Fragments
    without a place or text, or on pages that aren't there, are left out. The characters of a document are numbered in
    the order they come (65,535 different ones at most), with a map back to Unicode.
    """
    good = fragments.where(F.col("x").isNotNull() & F.col("y").isNotNull() & (F.length("text") > 0))
    shown = good.select("doc_id", "page_no", "frag_idx", "text", "x", "y", "font_name", "font_size", F.coalesce("vertical", F.lit(False)).alias("vertical"))
    both = shown.unionByName(pages.select("doc_id", "page_no", F.lit(-1).alias("frag_idx"), "width", "height"), allowMissingColumns=True)

    def step(rows: list[dict]) -> Iterator[tuple]:
        w, codes, fonts = Writer(), {}, {}
        made = []
        for _, of_page in groupby(rows, key=lambda r: r["page_no"]):
            head, *own = of_page
            if head["frag_idx"] == -1 and head["width"] is not None and head["height"] is not None:
                made.append(((head["width"], head["height"]), w.add(_page_of_text(own, codes, fonts))))
        if not made:
            return
        pairs = [f"<{n:04X}> <{ch.encode('utf-16-be', 'surrogatepass').hex()}>" for ch, n in codes.items()]
        cmap = w.add(Stream({"Filter": Name("FlateDecode")}, zlib.compress(f"1 begincodespacerange <0000> <FFFF> endcodespacerange {len(pairs)} beginbfchar {' '.join(pairs)} endbfchar".encode(), 6)))
        of_font = {}
        for name, short in fonts.items():
            base = {"BaseFont": Name(name)} if name else {}
            below = w.add({"Type": Name("Font"), "Subtype": Name("CIDFontType2"), **base})
            of_font[short] = w.add({"Type": Name("Font"), "Subtype": Name("Type0"), "Encoding": Name("Identity-H"), "DescendantFonts": [below], "ToUnicode": cmap, **base})
        for (wide, high), body in made:
            w.kids.append(w.add({"Type": Name("Page"), "MediaBox": [0, 0, wide, high], "Contents": body, "Resources": {"Font": of_font}}))
        yield (w.done({}),)

    return fold(both, ["doc_id"], [F.col("page_no"), F.col("frag_idx")], step, "content binary").withColumnRenamed("doc_id", "path")


def info(df: DataFrame, password: str = "") -> DataFrame:
    """``path, size, pages, encrypted, metadata, valid, error`` of every file; a valid one has a page at least."""

    def step(_: str, data: bytes) -> Asking:
        encrypted = False
        try:
            encrypted = b"/Encrypt" in data
            pdf = yield from Pdf.loading(data, password)
            n = len(pdf.pages())
            return [(len(data), n, pdf.encrypted, list(pdf.metadata().items()), n > 0, None if n else "no pages")]
        except LeafmillError as e:
            return [(len(data), 0, encrypted, [], False, str(e))]

    return _each_locked(df, step, "size bigint, pages int, encrypted boolean, metadata map<string, string>, valid boolean, error string")


_FILES = "file string, content binary, pages int"


def split(df: DataFrame, ranges: list[tuple[int, int]] | None = None, every: int | None = None, metadata: dict[str, str] | None = None) -> DataFrame:
    """New files of page ranges (1-based, each a file, order and overlaps kept), of ``every`` n pages, or of single pages."""

    def step(path: str, data: bytes) -> Iterator[tuple]:
        pdf = Pdf.load(data)
        n = len(pdf.pages())
        own = ranges or [(a, min(n, a + (every or 1) - 1)) for a in range(1, n + 1, every or 1)]
        for a, b in own:
            if not 1 <= a <= b <= n:
                raise InvalidDocument(f"{path} has no pages {a}-{b}")
            w = Writer()
            w.copy(pdf, list(range(a - 1, b)))
            label = f"page_{a}" if a == b else f"pages_{a}-{b}"
            yield f"{stem(path).replace(' ', '_')}_{label}.pdf", w.done(metadata if metadata is not None else pdf.metadata()), b - a + 1

    return _each(df, step, _FILES)


def extract(df: DataFrame, pages: list[int]) -> DataFrame:
    """One new file with the pages (1-based), each once, in order."""
    wanted = sorted(set(pages))

    def step(path: str, data: bytes) -> Iterator[tuple]:
        pdf = Pdf.load(data)
        if not wanted or wanted[0] < 1 or wanted[-1] > len(pdf.pages()):
            raise InvalidDocument(f"{path} hasn't pages {wanted}")
        w = Writer()
        w.copy(pdf, [p - 1 for p in wanted])
        yield f"{stem(path).replace(' ', '_')}_extract.pdf", w.done(pdf.metadata()), len(wanted)

    return _each(df, step, _FILES)


def merge(df: DataFrame, order: str, group: str | None = None, metadata: dict[str, str] | None = None, bookmarks: bool = True) -> DataFrame:
    """The files of each ``group`` (or all) as one, in the order of a column: ``group, content, pages``.

    Metadata, unless given, is that of the first file that has any; a bookmark stands at each file's first page, with its
    title or its name. Only the files of one output meet in a task.
    """
    key = F.col(group).cast("string") if group else F.lit("merged")
    shown = df.select(key.alias("group"), F.col(order).alias("place"), "path", "content")
    parsed = _parse_datatype_string("group string, content binary, pages int")
    arrow = to_arrow_schema(parsed)
    given = {("/" + k.title() if k in ("title", "author", "subject", "keywords") else "/" + k.lstrip("/")): v for k, v in (metadata or {}).items() if v and v.strip()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, w, meta = None, Writer(), {}

        def finish() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((now, w.done(given or meta), len(w.kids)), arrow.types)], schema=arrow)

        for batch in batches:
            for r in batch.to_pylist():
                if r["group"] != now:
                    if now is not None:
                        yield finish()
                    now, w, meta = r["group"], Writer(), {}
                try:
                    pdf = Pdf.load(r["content"])
                except LeafmillError as e:
                    raise InvalidDocument(f"{r['path']}: {e}") from e
                own = pdf.metadata()
                meta = meta or own
                if bookmarks:
                    w.bookmarks.append((own.get("/Title") or stem(r["path"]), len(w.kids)))
                w.copy(pdf, list(range(len(pdf.pages()))))
        if now is not None:
            yield finish()

    return shown.repartition("group").sortWithinPartitions("group", "place").mapInArrow(run, parsed)


# The share of a picture's pixels each way for each level of compression, with zlib's level.
LEVELS = {"low": (1.0, 3), "medium": (0.75, 6), "high": (0.5, 9)}


def compress(df: DataFrame, level: str = "medium") -> DataFrame:
    """Files with their streams compressed again: ``path, file, content, original_size, compressed_size, bytes_saved, ratio, backend``.

    Pictures of plain 8-bit samples get fewer pixels by the level; those of other codecs stay as they are. A file that
    would grow is kept as it is, and its ``backend`` is null.
    """
    if level not in LEVELS:
        raise ValueError(f"no level of compression: {level}")

    def step(path: str, data: bytes) -> Iterator[tuple]:
        pdf = Pdf.load(data)
        w = Writer()
        ratio, packing = LEVELS[level]
        w.copy(pdf, list(range(len(pdf.pages()))), packing, ratio)
        made = w.done(pdf.metadata())
        kept = len(made) >= len(data)
        made = data if kept else made
        yield os.path.basename(path), made, len(data), len(made), max(0, len(data) - len(made)), len(made) / len(data) if data else 1.0, None if kept else "zlib"

    return _each(df, step, "file string, content binary, original_size bigint, compressed_size bigint, bytes_saved bigint, ratio double, backend string")


def protect(df: DataFrame, password: str, owner: str | None = None) -> DataFrame:
    """Encrypted files (128-bit RC4). The password isn't empty, and no file is encrypted already."""
    if not password:
        raise ValueError("the password is empty")

    def step(path: str, data: bytes) -> Asking:
        pdf = yield from Pdf.loading(data)
        if pdf.encrypted:
            raise InvalidDocument(f"{path} is encrypted already")
        w = Writer()
        w.copy(pdf, list(range(len(pdf.pages()))))
        return [(os.path.basename(path), (yield from w.ending(pdf.metadata(), password, owner)), len(w.kids))]

    return _each_locked(df, step, _FILES)


def unprotect(df: DataFrame, password: str) -> DataFrame:
    """Files without their encryption; a wrong password, or a file that isn't encrypted, is an error."""

    def step(path: str, data: bytes) -> Asking:
        pdf = yield from Pdf.loading(data, password)
        if not pdf.encrypted:
            raise InvalidDocument(f"{path} isn't encrypted")
        w = Writer()
        w.copy(pdf, list(range(len(pdf.pages()))))
        return [(os.path.basename(path), w.done(pdf.metadata()), len(w.kids))]

    return _each_locked(df, step, _FILES)
