"""What stands on PDF pages: text fragments, lines, paths, images, links, annotations, form fields, outlines and roles."""

from __future__ import annotations

import math
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from typing import Any

from .pdfobjects import Name, Op, Pdf, Reader, Ref, Stream, text_of

Matrix = tuple[float, float, float, float, float, float]
IDENTITY: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
EAST_ASIAN = re.compile("[㐀-鿿぀-ヿｦ-ﾟ가-힣豈-﫿\U00020000-\U0002ebef]")
_PUSH_BUTTON = 0x10000
_FIELD_TITLES = {"text": "Text field", "checkbox": "Checkbox", "dropdown": "Dropdown", "signature": "Signature"}


def times(a: Matrix, b: Matrix) -> Matrix:
    """First ``a``, then ``b``."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def moved(m: Matrix, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def operations(data: bytes) -> Iterator[tuple[str, list]]:
    """Operators of a content stream with what stands before them; inline images are skipped."""
    r, stack = Reader(data), []
    while True:
        try:
            v = r.value()
        except (EOFError, ValueError):
            return
        if not isinstance(v, Op):
            stack.append(v)
            continue
        if v == "BI":
            end = re.compile(rb"\sEI\s").search(data, r.at)
            r.at = end.end() if end else len(data)
        else:
            yield str(v), stack
        stack = []


def contents(pdf: Pdf, page: dict) -> bytes:
    c = pdf.get(page.get("Contents"))
    parts = c if isinstance(c, list) else [c]
    return b"\n".join(pdf.decoded(s) for s in map(pdf.get, parts) if isinstance(s, Stream))


def _unicode_map(data: bytes) -> tuple[dict[bytes, str], int]:
    """A ToUnicode map: codes and texts, and the longest code."""
    out: dict[bytes, str] = {}
    text = lambda b: b.decode("utf-16-be", "ignore")
    for op, args in operations(data):
        if op == "endbfchar":
            out.update((a, text(b)) for a, b in zip(args[::2], args[1::2]) if isinstance(a, bytes) and isinstance(b, bytes))
        elif op == "endbfrange":
            for a, b, to in zip(args[::3], args[1::3], args[2::3]):
                first, last = int.from_bytes(a, "big"), int.from_bytes(b, "big")
                for k in range(first, min(last, first + 0xFFFF) + 1):
                    if isinstance(to, list):
                        if k - first < len(to):
                            out[k.to_bytes(len(a), "big")] = text(to[k - first])
                    else:
                        out[k.to_bytes(len(a), "big")] = text((int.from_bytes(to, "big") + k - first).to_bytes(len(to), "big"))
    return out, max(map(len, out), default=1)


def glyph_text(name: str) -> str:
    """The character of a glyph name: one letter, a code in it, or its Unicode name in small letters."""
    base = name.split(".")[0]
    if len(base) == 1:
        return base
    if m := re.fullmatch(r"(?:uni|u)([0-9A-Fa-f]{4,6})", base):
        return chr(int(m[1], 16))
    words = re.sub(r"(?<=[a-z])(acute|grave|circumflex|dieresis|tilde|cedilla|ring|caron)$", r" WITH \1", base).replace("dieresis", "diaeresis")
    if " WITH " in words:
        letter, sign = words.split(" WITH ")
        case = "CAPITAL" if letter.isupper() else "SMALL"
        words = f"LATIN {case} LETTER {letter} WITH {sign}"
    try:
        return unicodedata.lookup(words.upper())
    except KeyError:
        return {"space": " ", "period": ".", "hyphen": "-", "germandbls": "ß", "quoteright": "’", "quoteleft": "‘", "quotedblleft": "“", "quotedblright": "”", "endash": "–", "emdash": "—", "bullet": "•", "fi": "ﬁ", "fl": "ﬂ"}.get(base, "")


class Font:
    """Turns a string's codes into text: longest matches of the ToUnicode map, else the encoding's differences, else Windows Latin."""

    def __init__(self, pdf: Pdf, font: dict):
        self.name = (text_of(pdf.get(font.get("BaseFont"))) or "").lstrip("/") or None
        self.map: dict[bytes, str] = {}
        self.longest = 1
        below = [pdf.get(d) for d in pdf.get(font.get("DescendantFonts")) or []]
        for f in [font, *below]:
            s = pdf.get(f.get("ToUnicode")) if isinstance(f, dict) else None
            if isinstance(s, Stream):
                maps = pdf.__dict__.setdefault("_maps", {})  # fonts often share one, and pages share fonts
                if id(s) not in maps:
                    maps[id(s)] = _unicode_map(pdf.decoded(s))
                found, longest = maps[id(s)]
                self.map.update(found)
                self.longest = max(self.longest, longest)
        e = pdf.get(font.get("Encoding"))
        if isinstance(e, dict):
            code = 0
            for d in pdf.get(e.get("Differences")) or []:
                if isinstance(d, int):
                    code = d
                elif 0 <= code < 256:
                    if (t := glyph_text(str(d))) and bytes([code]) not in self.map:
                        self.map[bytes([code])] = t
                    code += 1
        self.wide = bool(below) and not self.map

    def text(self, codes: bytes) -> str:
        return translated(codes, self.map, self.longest) if not self.wide else codes.decode("utf-16-be", "ignore")


def translated(codes: bytes, table: dict[bytes, str], longest: int) -> str:
    """The longest codes of the table first; others as Windows Latin."""
    out, k = [], 0
    while k < len(codes):
        for n in range(min(longest, len(codes) - k), 0, -1):
            if (t := table.get(codes[k : k + n])) is not None:
                out.append(t)
                k += n
                break
        else:
            out.append(codes[k : k + 1].decode("cp1252", "ignore"))
            k += 1
    return "".join(out)


def upright(m: Matrix) -> bool:
    """Whether a matrix writes within 15 degrees of upwards or downwards."""
    near = lambda x, y: abs(math.degrees(math.atan2(y, x)) % 180.0 - 90.0) <= 15.0 and (x or y)
    return bool(near(m[0], m[1]) or near(m[2], m[3]) and abs(m[0]) < 1e-6 or abs(m[0]) < 1e-6 and abs(m[3]) < 1e-6)


def fragments(pdf: Pdf, page: dict) -> Iterator[tuple]:
    """(text, x, y, font, size, vertical) of each shown string that isn't empty."""
    resources = pdf.get(page.get("Resources")) or {}
    fonts = {k: Font(pdf, f) for k, v in (pdf.get(resources.get("Font")) or {}).items() if isinstance(f := pdf.get(v), dict)}
    ctm, saved = IDENTITY, []
    tm = tlm = IDENTITY
    font: Font | None = None
    size = leading = 0.0
    for op, a in operations(contents(pdf, page)):
        try:
            if op == "q":
                saved.append((ctm, font, size, leading))
            elif op == "Q" and saved:
                ctm, font, size, leading = saved.pop()
            elif op == "cm":
                ctm = times(tuple(map(float, a[:6])), ctm)
            elif op == "BT":
                tm = tlm = IDENTITY
            elif op == "Tf":
                font, size = fonts.get(str(a[0])), float(a[1])
            elif op == "TL":
                leading = float(a[0])
            elif op == "Tm":
                tm = tlm = tuple(map(float, a[:6]))
            elif op in ("Td", "TD"):
                leading = -float(a[1]) if op == "TD" else leading
                tm = tlm = times((1, 0, 0, 1, float(a[0]), float(a[1])), tlm)
            elif op == "T*":
                tm = tlm = times((1, 0, 0, 1, 0, -leading), tlm)
            if op in ("'", '"'):
                tm = tlm = times((1, 0, 0, 1, 0, -leading), tlm)
            if op in ("Tj", "TJ", "'", '"'):
                codes = a[-1] if a else b""
                parts = [x for x in codes if isinstance(x, bytes)] if isinstance(codes, list) else [codes] if isinstance(codes, bytes) else []
                text = "".join(font.text(p) if font else p.decode("cp1252", "ignore") for p in parts)
                full = times(tm, ctm)
                if text.strip():
                    scale = math.hypot(full[2], full[3]) or 1.0
                    yield text, full[4], full[5], font.name if font else None, size * scale or None, upright(full) and bool(EAST_ASIAN.search(text))
                tm = times((1, 0, 0, 1, 0.5 * size * len(text), 0), tm)
        except (ValueError, TypeError, IndexError):
            continue


def _color(values: list, kind: str | None) -> tuple[float, float, float] | None:
    v = [float(x) for x in values if isinstance(x, (int, float))]
    v = [min(1.0, max(0.0, x / 255.0 if x > 10 else x)) for x in v]
    if len(v) == 1:
        return v[0], v[0], v[0]
    if len(v) == 4:
        return tuple(1 - min(1.0, x + v[3]) for x in v[:3])
    return tuple(v[:3]) if len(v) >= 3 else None


def hex_of(color: tuple[float, float, float] | None) -> str | None:
    return None if color is None else "".join(f"{round(c * 255):02X}" for c in color)


def is_rectangle(points: list[tuple[float, float]]) -> bool:
    """Whether a closed path has four corners on two verticals and two horizontals (in hundredths)."""
    corners = points[:-1] if len(points) == 5 and points[0] == points[-1] else points
    return len(corners) == 4 and len({round(x, 2) for x, _ in corners}) == 2 and len({round(y, 2) for _, y in corners}) == 2


def graphics(pdf: Pdf, page: dict) -> tuple[list[tuple], list[tuple]]:
    """Lines (x0, y0, x1, y1, width) and paths (subpaths, stroke, fill, width, rule, stroke alpha, fill alpha, rectangle)."""
    states = pdf.get((pdf.get(page.get("Resources")) or {}).get("ExtGState")) or {}
    lines: list[tuple] = []
    paths: list[tuple] = []
    state = {"ctm": IDENTITY, "stroke": (0.0, 0.0, 0.0), "fill": (0.0, 0.0, 0.0), "width": 1.0, "CA": 1.0, "ca": 1.0}
    saved: list[dict] = []
    parts: list[list[tuple[float, float]]] = []

    def point(x: Any, y: Any) -> tuple[float, float]:
        return moved(state["ctm"], float(x), float(y))

    def paint(op: str) -> None:
        stroke, fill, close = op in "SsBb" or op in ("B*", "b*"), op[0] in "fFBb", op[0] in "sb"
        for p in parts:
            if close and len(p) > 1 and p[0] != p[-1]:
                p.append(p[0])
        shown = [p for p in parts if len(p) > 1]
        if not shown or not (stroke or fill):
            return
        if len(shown) == 1 and len(shown[0]) == 2 and stroke and not fill:
            lines.append((*shown[0][0], *shown[0][1], state["width"]))
            return
        box = len(shown) == 1 and is_rectangle(shown[0])
        if box and stroke:
            corners = shown[0][:4]
            lines.extend((*a, *b, state["width"]) for a, b in zip(corners, [*corners[1:], corners[0]]))
            if not fill:
                return
        paths.append((shown, state["stroke"] if stroke else None, state["fill"] if fill else None, state["width"], "evenodd" if "*" in op else "nonzero", state["CA"], state["ca"], box))

    for op, a in operations(contents(pdf, page)):
        try:
            if op == "q":
                saved.append(dict(state))
            elif op == "Q" and saved:
                state = saved.pop()
            elif op == "cm":
                state["ctm"] = times(tuple(map(float, a[:6])), state["ctm"])
            elif op == "w":
                state["width"] = float(a[0])
            elif op in ("RG", "G", "K", "SC", "SCN"):
                state["stroke"] = _color(a, op) or state["stroke"]
            elif op in ("rg", "g", "k", "sc", "scn"):
                state["fill"] = _color(a, op) or state["fill"]
            elif op == "gs":
                g = pdf.get(states.get(str(a[0]))) or {}
                state.update({k: float(pdf.get(g[k])) for k in ("CA", "ca") if k in g})
            elif op == "m":
                parts.append([point(*a[:2])])
            elif op == "l" and parts:
                parts[-1].append(point(*a[:2]))
            elif op in ("c", "v", "y") and parts:
                p0 = parts[-1][-1]
                given = [point(*a[k : k + 2]) for k in range(0, len(a) - 1, 2)]
                p1, p2, p3 = given if op == "c" else (p0, *given) if op == "v" else (*given, given[-1])
                for k in range(1, 13):
                    t, u = k / 12, 1 - k / 12
                    parts[-1].append(tuple(u**3 * p0[i] + 3 * u * u * t * p1[i] + 3 * u * t * t * p2[i] + t**3 * p3[i] for i in (0, 1)))
            elif op == "h" and parts:
                parts[-1].append(parts[-1][0])
            elif op == "re":
                x, y, w, h = map(float, a[:4])
                parts.append([point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h), point(x, y)])
            elif op in ("S", "s", "f", "F", "f*", "B", "B*", "b", "b*"):
                paint(op)
                parts = []
            elif op == "n":
                parts = []
        except (ValueError, TypeError, IndexError, KeyError):
            continue
    return lines, paths


def png(width: int, height: int, rgb: bytes, alpha: bytes | None = None) -> bytes:
    """A PNG file of 8-bit RGB (and alpha) samples."""
    size = 4 if alpha else 3
    rows = bytearray()
    for y in range(height):
        row = rgb[3 * width * y : 3 * width * (y + 1)]
        if alpha:
            row = b"".join(row[3 * x : 3 * x + 3] + alpha[width * y + x : width * y + x + 1] for x in range(width))
        rows += b"\0" + row
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6 if size == 4 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes(rows), 9)) + chunk(b"IEND", b"")


def placeholder(width: int, height: int) -> bytes:
    """A grey picture that stands for one that can't be decoded."""
    width, height = max(1, min(width, 512)), max(1, min(height, 512))
    return png(width, height, bytes([200]) * (3 * width * height))


def _samples(pdf: Pdf, s: Stream) -> bytes | None:
    """RGB samples of an image with 8 bits a component; null where its colours aren't supported."""
    a = {k: pdf.get(v) for k, v in s.attributes.items()}
    n = int(a.get("Width", 0)) * int(a.get("Height", 0))
    space = a.get("ColorSpace")
    kind = pdf.get(space[0]) if isinstance(space, list) and space else space
    data = pdf.decoded(s)
    if a.get("BitsPerComponent", 8) != 8:
        return None
    if kind == "ICCBased":
        profile = pdf.get(space[1])
        kind = {1: "DeviceGray", 3: "DeviceRGB", 4: "DeviceCMYK"}.get(pdf.get(profile.attributes.get("N")) if isinstance(profile, Stream) else 0)
    if kind in ("DeviceRGB", "CalRGB", "RGB") and len(data) >= 3 * n:
        return data[: 3 * n]
    if kind in ("DeviceGray", "CalGray", "G") and len(data) >= n:
        return bytes(c for x in data[:n] for c in (x, x, x))
    if kind in ("DeviceCMYK", "CMYK") and len(data) >= 4 * n:
        return bytes(255 - min(255, data[4 * k + c] + data[4 * k + 3]) for k in range(n) for c in range(3))
    if kind in ("Indexed", "I") and len(space) >= 4 and len(data) >= n:
        table = pdf.get(space[3])
        table = pdf.decoded(table) if isinstance(table, Stream) else table or b""
        base = pdf.get(space[1])
        size = 1 if base == "DeviceGray" else 3
        last = max(0, len(table) // size - 1)
        entry = [(table[size * k : size * k + size] * 3)[:3] for k in range(last + 1)]
        return b"".join(entry[min(x, last)] for x in data[:n])
    return None


def _alpha(pdf: Pdf, mask: Stream, width: int, height: int, stencil: bool) -> bytes | None:
    """A mask as a byte for each pixel of its picture, whose size it takes; of a stencil the ones are hidden."""
    wide, high = (int(pdf.get(mask.attributes.get(k, 0)) or 0) for k in ("Width", "Height"))
    bits = 1 if stencil else pdf.get(mask.attributes.get("BitsPerComponent", 8))
    data, row = pdf.decoded(mask), (wide * bits + 7) // 8
    if bits not in (1, 8) or not wide or not high or len(data) < row * high:
        return None
    flip = stencil != (list(map(pdf.get, pdf.get(mask.attributes.get("Decode")) or [])) == [1, 0])
    if bits == 1:
        data = bytes(255 * ((data[row * y + x // 8] >> (7 - x % 8) & 1) ^ flip) for y in range(high) for x in range(wide))
    elif flip:
        data = bytes(255 - v for v in data[: wide * high])
    if (wide, high) == (width, height):
        return data[: width * height]
    return bytes(data[wide * (y * high // height) + x * wide // width] for y in range(height) for x in range(width))


def image_bytes(pdf: Pdf, s: Stream) -> tuple[bytes, str]:
    """The picture as a file, and its MIME type: JPEG data as it is, other samples as PNG with their soft mask."""
    filters = pdf.get(s.attributes.get("Filter"))
    names = {str(pdf.get(f)) for f in (filters if isinstance(filters, list) else [filters])}
    mask = pdf.get(s.attributes.get("SMask"))
    width, height = int(pdf.get(s.attributes.get("Width", 0))), int(pdf.get(s.attributes.get("Height", 0)))
    if "DCTDecode" in names and mask is None:
        return pdf.decoded(s), "image/jpeg"
    rgb = _samples(pdf, s) if not names & {"DCTDecode", "JPXDecode", "CCITTFaxDecode", "JBIG2Decode"} else None
    if rgb is None or not width or not height:
        return placeholder(width, height), "image/png"
    alpha = _alpha(pdf, mask, width, height, False) if isinstance(mask, Stream) else None
    if alpha is None and (hard := pdf.get(s.attributes.get("Mask"))) is not None:
        if isinstance(hard, Stream):  # a stencil: what is painted by it is hidden
            alpha = _alpha(pdf, hard, width, height, True)
        elif isinstance(hard, list) and len(hard) == 6:  # a range of colours is hidden
            low, high = ([pdf.get(x) for x in hard[k::2]] for k in (0, 1))
            alpha = bytes(0 if all(a <= v <= z for a, v, z in zip(low, rgb[k : k + 3], high)) else 255 for k in range(0, 3 * width * height, 3))
    return png(width, height, rgb, alpha), "image/png"


def images(pdf: Pdf, page: dict) -> Iterator[tuple]:
    """(data, left, bottom, right, top, mime, name) of each image that a page shows."""
    shown = {k: s for k, v in (pdf.get((pdf.get(page.get("Resources")) or {}).get("XObject")) or {}).items() if isinstance(s := pdf.get(v), Stream) and pdf.get(s.attributes.get("Subtype")) == "Image"}
    if not shown:
        return
    made: dict[str, tuple[bytes, str]] = {}
    ctm, saved = IDENTITY, []
    for op, a in operations(contents(pdf, page)):
        if op == "q":
            saved.append(ctm)
        elif op == "Q" and saved:
            ctm = saved.pop()
        elif op == "cm" and len(a) >= 6:
            ctm = times(tuple(map(float, a[:6])), ctm)
        elif op == "Do" and a and (name := str(a[0])) in shown:
            if name not in made:
                made[name] = image_bytes(pdf, shown[name])
            corners = [moved(ctm, x, y) for x in (0, 1) for y in (0, 1)]
            xs, ys = [c[0] for c in corners], [c[1] for c in corners]
            yield made[name][0], min(xs), min(ys), max(xs), max(ys), made[name][1], name


def _box(pdf: Pdf, value: Any) -> tuple[float, float, float, float] | None:
    r = [pdf.get(x) for x in pdf.get(value) or []]
    if len(r) != 4 or not all(isinstance(x, (int, float)) for x in r):
        return None
    return min(r[0], r[2]), min(r[1], r[3]), max(r[0], r[2]), max(r[1], r[3])


def anchor(name: str) -> str:
    """A name that can be an anchor: letters, digits, ``_`` and ``-``; not a digit first; 40 characters."""
    bare = re.sub(r"[^\w-]", "_", name)
    return ("dest_" + bare if bare[:1].isdigit() else bare)[:40]


def destination(pdf: Pdf, value: Any) -> tuple[str | None, int | None, float | None]:
    """Anchor, page (0-based) and top of a destination: an array, or a name of one."""
    name = None
    value = pdf.get(value)
    if isinstance(value, (bytes, Name)):
        name = text_of(value)
        value = _named(pdf, name)
    if isinstance(value, dict):
        value = pdf.get(value.get("D"))
    if not isinstance(value, list) or not value:
        return (anchor(name) if name else None), None, None
    if (numbers := pdf.__dict__.get("_page_numbers")) is None:
        numbers = pdf.__dict__["_page_numbers"] = {n: k for k, (n, _) in enumerate(pdf.pages())}
    page = numbers.get(value[0].number) if isinstance(value[0], Ref) else value[0] if isinstance(value[0], int) else None
    top = pdf.get(value[3]) if len(value) > 3 else None
    top = float(top) if isinstance(top, (int, float)) else None
    made = name or (f"dest_p{page}" + (f"_y{round(top)}" if top is not None else "") if page is not None else None)
    return (anchor(made) if made else None), page, top


def _named(pdf: Pdf, name: str | None) -> Any:
    """The destination of a name: from the names of the file, which are read once, whatever their number."""
    if (found := pdf.__dict__.get("_destinations")) is None:
        root = pdf.get(pdf.trailer["Root"]) or {}
        found, seen = {}, set()
        open_nodes = [(pdf.get(root.get("Names")) or {}).get("Dests")]
        while open_nodes:
            node = open_nodes.pop()
            if isinstance(node, Ref):
                if node.number in seen:
                    continue
                seen.add(node.number)
            node = pdf.get(node)
            if isinstance(node, dict):
                names, kids = pdf.get(node.get("Names")), pdf.get(node.get("Kids"))
                for k, v in zip(names[::2], names[1::2]) if isinstance(names, list) else ():
                    found.setdefault(text_of(pdf.get(k)), v)
                open_nodes += reversed(kids) if isinstance(kids, list) else ()
        old = pdf.get(root.get("Dests")) or {}
        found |= {str(k): v for k, v in old.items()}
        pdf.__dict__["_destinations"] = found
    return pdf.get(found.get(name))


def _annotations(pdf: Pdf, page: dict) -> Iterator[tuple[dict, tuple]]:
    for a in pdf.get(page.get("Annots")) or []:
        if isinstance(a := pdf.get(a), dict) and (box := _box(pdf, a.get("Rect"))):
            yield a, box


def links(pdf: Pdf, page: dict) -> Iterator[tuple]:
    """(left, bottom, right, top, uri, anchor, tooltip, kind, page, top) of each link that leads anywhere."""
    for a, box in _annotations(pdf, page):
        if pdf.get(a.get("Subtype")) != "Link":
            continue
        act = pdf.get(a.get("A")) or {}
        kind, uri, to = pdf.get(act.get("S")), text_of(pdf.get(act.get("URI")) or pdf.get(a.get("URI"))), (None, None, None)
        form = "external"
        if kind in ("GoToR", "Launch"):
            target = pdf.get(act.get("F"))
            uri, form = text_of(pdf.get(target.get("UF", target.get("F"))) if isinstance(target, dict) else target), "file"
        elif uri is None:
            to, form = destination(pdf, act.get("D") if kind == "GoTo" else a.get("Dest")), "internal"
        if uri or to[0]:
            yield *box, uri, to[0], text_of(pdf.get(a.get("Contents"))), form, to[1], to[2]


def notes(pdf: Pdf, page: dict) -> Iterator[tuple]:
    """(left, bottom, right, top, text, author, subtype) of text annotations."""
    for a, box in _annotations(pdf, page):
        if (kind := pdf.get(a.get("Subtype"))) in ("Text", "FreeText"):
            yield *box, text_of(pdf.get(a.get("Contents"))), text_of(pdf.get(a.get("T"))), str(kind)


def fields(pdf: Pdf, page: dict) -> Iterator[tuple]:
    """(left, bottom, right, top, type, name, label, value, checked, options, tooltip, read only, multiline) of form fields."""
    for a, box in _annotations(pdf, page):
        if pdf.get(a.get("Subtype")) != "Widget":
            continue
        above = pdf.get(a.get("Parent")) or {}
        of = lambda k: pdf.get(a.get(k, above.get(k)))
        kind, flags = of("FT"), int(of("Ff") or 0)
        if kind == "Btn" and flags & _PUSH_BUTTON:
            continue
        form = {"Tx": "text", "Btn": "checkbox", "Ch": "dropdown", "Sig": "signature"}.get(str(kind))
        if form is None:
            continue
        value = text_of(next((v for v in (pdf.get(above.get("V")), pdf.get(a.get("V")), of("DV")) if v is not None), None))
        name, tip = text_of(of("T")), text_of(of("TU"))
        checked = None
        if form == "checkbox":
            state = (text_of(pdf.get(a.get("AS"))) or value or "").strip().lower()
            checked = state not in ("", "off", "no", "0")
        options = [text_of(pdf.get(o[-1] if isinstance(o := pdf.get(x), list) and o else o)) or "" for x in of("Opt") or []]
        yield *box, form, name, tip or name or _FIELD_TITLES[form], value, checked, options, tip, bool(flags & 1), bool(flags & 0x1000)


def outline(pdf: Pdf) -> Iterator[tuple]:
    """(node, parent, order, title, page, top, anchor) of the outline, pre-order; a repeated anchor gets a number."""
    seen: set[int] = set()
    used: dict[str, int] = {}
    count = 0

    def walk(ref: Any, parent: int | None) -> Iterator[tuple]:
        nonlocal count
        order = 0
        while isinstance(ref, Ref) and ref.number not in seen:
            seen.add(ref.number)
            node = pdf.get(ref)
            if not isinstance(node, dict):
                return
            act = pdf.get(node.get("A")) or {}
            name, page, top = destination(pdf, node.get("Dest", act.get("D")))
            if name:
                used[name] = used.get(name, -1) + 1
                name += f"_{used[name]}" if used[name] else ""
            count += 1
            own = count
            yield own, parent, order, text_of(pdf.get(node.get("Title"))) or "", page, top, name
            yield from walk(node.get("First"), own)
            ref, order = node.get("Next"), order + 1

    yield from walk((pdf.get((pdf.get(pdf.trailer["Root"]) or {}).get("Outlines")) or {}).get("First"), None)


def roles(pdf: Pdf) -> Iterator[tuple]:
    """(page or none, order, role) of the structure tree, depth first."""
    numbers = {n: k for k, (n, _) in enumerate(pdf.pages())}
    seen, order = set(), 0

    def walk(node: Any, page: int | None) -> Iterator[tuple]:
        nonlocal order
        if isinstance(node, Ref):
            if node.number in seen:
                return
            seen.add(node.number)
        node = pdf.get(node)
        if isinstance(node, list):
            for x in node:
                yield from walk(x, page)
        elif isinstance(node, dict):
            at = node.get("Pg")
            page = numbers.get(at.number, page) if isinstance(at, Ref) else page
            if (s := pdf.get(node.get("S"))) is not None:
                yield page, order, str(s)
                order += 1
            yield from walk(node.get("K"), page)

    yield from walk((pdf.get((pdf.get(pdf.trailer["Root"]) or {}).get("StructTreeRoot")) or {}).get("K"), None)
