"""Text functions as Column expressions. Null in, null out, unless a function says otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that strip and split know (all of Unicode's, and U+001C to U+001F).
SPACE = "\t-\r\x1c-\x20\x85\xa0  -     　"
# Ligatures and what they stand for.
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬀ": "ff", "ﬅ": "st", "ﬆ": "st"}
SOFT_HYPHEN = "\xad"
# Ranges of scripts.
RIGHT_TO_LEFT = "֐-ࣿיִ-﷿ﹰ-ﻼ"
HEBREW = "֐-׿"
KANA = "぀-ゟ゠-ヿｦ-ﾟ"
HANGUL = "가-힣"
HAN = "㐀-䶿一-鿿豈-﫿\U00020000-\U0002a6df\U0002a700-\U0002b73f\U0002b740-\U0002b81f\U0002b820-\U0002ceaf\U0002ceb0-\U0002ebef"
# List markers, tried in this order.
BULLET = "[•‣◦▪⁃–—·∙\\-*]"
MARKERS = [
    ("bullet", f"({BULLET})"),
    ("decimal", r"(\(?\d+[.)])"),
    ("roman", r"(\(?[ivxlcdmIVXLCDM]+[.)])"),
    ("alpha", r"(\(?[a-zA-Z]+[.)])"),
]
LIST_ROLES = ("LI", "LBODY", "LBL", "L")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def lstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+", "")


def words(text: Column) -> Column:
    """What stands between white space."""
    return F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+"), F.lit(0))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def normalised(text: Column, strip_space: bool = True) -> Column:
    """Without soft hyphens, with ligatures written out."""
    out = reduce(lambda t, x: F.replace(t, F.lit(x[0]), F.lit(x[1])), LIGATURES.items(), F.replace(text, F.lit(SOFT_HYPHEN), F.lit("")))
    return strip(out) if strip_space else out


def is_rtl(text: Column) -> Column:
    return text.rlike(f"[{RIGHT_TO_LEFT}]")


def is_east_asian(text: Column) -> Column:
    return text.rlike(f"[{HAN}{KANA}{HANGUL}]")


def guessed_language(text: Column) -> Column:
    """A language by script alone; null for the empty text, ``und`` for other scripts and for signs beyond U+0400."""
    return (
        F.when(text == "", F.lit(None))
        .when(is_rtl(text), F.when(text.rlike(f"[{HEBREW}]"), "he-IL").otherwise("ar-SA"))
        .when(text.rlike(f"[{HANGUL}]"), "ko-KR")
        .when(text.rlike(f"[{KANA}]"), "ja-JP")
        .when(text.rlike(f"[{HAN}]"), "zh-CN")
        .when(text.rlike("[Ё-\U0010ffff]"), "und")
        .when(text.isNotNull(), "en-US")
    )


def font_traits(name: Column) -> Column:
    """struct<bold, italic, underline> by what a font's name contains; all false without a name."""
    upper = F.upper(F.coalesce(name, F.lit("")))
    has = lambda *parts: reduce(lambda a, b: a | b, [upper.contains(p) for p in parts])
    return F.struct(has("BOLD", "BLACK", "HEAVY").alias("bold"), has("ITALIC", "OBLIQUE").alias("italic"), has("UNDERLINE", "UL").alias("underline"))


def list_marker(text: Column, role: Column | None = None) -> Column:
    """struct<kind, format, punctuation, marker, rest> of a list item's text, else null.

    A role of a list makes a bullet where the text has no marker. Where nothing is left behind the marker, the text is kept.
    """
    working = lstrip(text)
    lead = F.substring(text, F.lit(1), F.length(text) - F.length(working))

    def rest(pattern: str) -> Column:
        left = F.concat(lead, F.regexp_replace(working, f"^{pattern}[{SPACE}]+", ""))
        return F.when(left == "", text).otherwise(left)

    def made(kind: str, pattern: str) -> Column:
        marker = F.regexp_extract(working, f"^{pattern}[{SPACE}]+", 1)
        punctuation = F.when(marker.startswith("(") & marker.endswith(")"), "enclosed").when(marker.endswith(")"), "paren").otherwise("dot")
        bare = F.regexp_replace(marker, "[().]", "")
        upper = bare == F.upper(bare)
        form = {
            "bullet": F.lit(None).cast("string"),
            "decimal": F.lit("decimal"),
            "roman": F.when(upper, "upperRoman").otherwise("lowerRoman"),
            "alpha": F.when(upper, "upperLetter").otherwise("lowerLetter"),
        }[kind]
        none = F.lit(None).cast("string")
        return F.struct(
            F.lit("bullet" if kind == "bullet" else "ordered").alias("kind"), form.alias("format"), (none if kind == "bullet" else punctuation).alias("punctuation"), marker.alias("marker"), rest(pattern).alias("rest")
        )

    out = None
    for kind, pattern in MARKERS:
        test = working.rlike(f"^{pattern}[{SPACE}]+")
        out = F.when(test, made(kind, pattern)) if out is None else out.when(test, made(kind, pattern))
    if role is None:
        return out
    none = F.lit(None).cast("string")
    plain = F.struct(F.lit("bullet").alias("kind"), none.alias("format"), none.alias("punctuation"), none.alias("marker"), text.alias("rest"))
    return out.when(F.upper(role).isin(*LIST_ROLES), plain)


def continues(text: Column, role: Column) -> Column:
    """Whether a text may go on on the next page: it has no end mark, or a hyphen or dash at its end; headings never do."""
    end = F.right(F.regexp_replace(text, f"[{SPACE}]+$", ""), F.lit(1))
    return F.coalesce(end != "", F.lit(False)) & ~F.coalesce(F.upper(role).startswith("H"), F.lit(False)) & ~end.isin(".", "!", "?")


def signature(text: Column, footer: bool) -> Column:
    """What running headers and footers are compared by; page numbers don't count in footers."""
    plain = F.lower(F.regexp_replace(strip(text), f"[{SPACE}]+", " "))
    if not footer:
        return plain
    bare = strip(F.regexp_replace(F.regexp_replace(plain, r"\d+", ""), f"[{SPACE}]+", " "))
    return F.when(bare == "", plain).otherwise(bare)


def footnote_marker(text: Column) -> Column:
    """The marker that a superscript text is: digits, one letter, or one of three signs; else null."""
    bare = F.lower(F.regexp_replace(text, "[^\\p{L}\\p{N}*†‡]", ""))
    return F.when(bare.rlike("^([0-9]+|[*†‡]|\\p{L})$"), bare)


def anchor_name(text: Column) -> Column:
    """A name of letters, digits, ``_`` and ``-``, that begins with none of the digits, cut at 40 characters."""
    bare = F.regexp_replace(strip(text), "[^\\p{L}\\p{N}_-]", "_")
    return F.substring(F.when(bare.rlike("^[0-9]"), F.concat(F.lit("dest_"), bare)).otherwise(bare), 1, 40)


def pdf_date(text: Column) -> Column:
    """The instant of a PDF date (``D:YYYYMMDDHHmmSS+HH'mm'``), in UTC; null for anything else.

    Month and day default to 1, the time to 0, the zone to UTC.
    """
    raw = F.regexp_replace(strip(text), "^D:", "")
    part = lambda a, n, default: F.when(F.length(raw) >= a + n - 1, F.substring(raw, a, n)).otherwise(F.lit(default)).try_cast("int")
    local = F.try_make_timestamp(part(1, 4, "x"), part(5, 2, "1"), part(7, 2, "1"), part(9, 2, "0"), part(11, 2, "0"), part(13, 2, "0").cast("decimal(8,6)"))
    zone = F.regexp_extract(raw, r"^\d{14}([+-])(\d{2})'?(\d{2})", 1)
    minutes = F.regexp_extract(raw, r"^\d{14}[+-](\d{2})", 1).try_cast("int") * 60 + F.regexp_extract(raw, r"^\d{14}[+-]\d{2}'?(\d{2})", 1).try_cast("int")
    shift = F.when(zone == "", F.lit(0)).otherwise(F.when(zone == "-", -minutes).otherwise(minutes))
    return F.when(raw.rlike(r"^\d{4}"), F.timestamp_micros(F.unix_micros(local) - shift.cast("bigint") * 60_000_000))


def w3c(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def human_size(n: Column) -> Column:
    """Bytes in the largest unit of 1024 that leaves 1 at least, with one decimal."""
    names = ["bytes", "KiB", "MiB", "GiB", "TiB"]
    out = None
    for k, name in enumerate(names):
        shown = F.format_string(f"%.1f {name}", F.bround(n.cast("double") / float(1024**k), 1))
        if k == len(names) - 1:
            return out.otherwise(shown)
        test = n < 1024 ** (k + 1)
        out = F.when(test, shown) if out is None else out.when(test, shown)
    return out


# Roles of a structure tree, by what they make of a block.
ANNOTATION_ROLES = ("ANNOT", "ANNOTATION", "NOTE", "COMMENT")
EQUATION_ROLES = ("FORMULA", "MATH", "EQUATION")
CELL_ROLES = ("TD", "TH", "CELL", "TABLECELL", "HEADER", "DATA")
HEADER_ROLES = ("TH", "THEAD", "HEADER", "TABLEHEADER")


def has_role(role: Column, names: tuple[str, ...]) -> Column:
    """Whether a role is one of these; false for none."""
    return F.coalesce(F.upper(role).isin(*names), F.lit(False))


def element_kind(role: Column) -> Column:
    """What a block becomes in a document: an annotation, an equation, a cell or a paragraph."""
    kinds = (("annotation", ANNOTATION_ROLES), ("equation", EQUATION_ROLES), ("cell", CELL_ROLES))
    out = F.when(has_role(role, kinds[0][1]), kinds[0][0])
    for name, roles in kinds[1:]:
        out = out.when(has_role(role, roles), name)
    return out.otherwise("paragraph")


def bookmark_name(text: Column) -> Column:
    """As ``anchor_name``; ``bookmark`` where nothing of it is left."""
    name = anchor_name(text)
    return F.when(F.coalesce(F.regexp_replace(name, "_", ""), F.lit("")) == "", "bookmark").otherwise(name)


_NOTE = r"^\s*([0-9A-Za-z]{1,3}|[*†‡])(?:[.)]|\s)+"


def footnote_body(text: Column) -> Column:
    """The marker that a footnote's text begins with and the length of what stands before the note itself (``marker``, ``prefix``); else null."""
    found = F.regexp_extract(text, _NOTE, 0)
    marker = footnote_marker(F.regexp_extract(text, _NOTE, 1))
    good = (found != "") & marker.isNotNull() & (F.length(found) < F.length(text))
    return F.when(good, F.struct(marker.alias("marker"), F.length(found).alias("prefix")))


def without_prefix(runs: Column, n: Column) -> Column:
    """Runs without their first ``n`` characters; runs that are used up are left out."""
    start = lambda i: F.aggregate(F.slice(runs, F.lit(1), i), F.lit(0), lambda a, r: a + F.length(F.coalesce(r["text"], F.lit(""))))
    cut = lambda r, i: r.withField("text", F.substring(r["text"], F.greatest(n - start(i), F.lit(0)) + 1, F.length(r["text"])))
    return F.filter(F.transform(runs, cut), lambda r: F.length(F.coalesce(r["text"], F.lit(""))) > 0)


def joined_hyphen(text: Column, behind: Column) -> Column:
    """A run's text without the hyphen at its end if the text behind begins with a small letter."""
    small = F.substring(behind, 1, 1).rlike(r"^\p{Ll}$")
    return F.when(F.coalesce(small & text.endswith("-"), F.lit(False)), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
