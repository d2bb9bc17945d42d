"""Form fields and equations as text."""

from __future__ import annotations

from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import blank_to_null, normalised

# Signs and words that stand for fields.
CHECKED, UNCHECKED, SIGNATURE = "☑", "☐", "Signature: ____________________"
NO_BREAK_SPACE = "\xa0"
LABEL_SHARE = 0.35


def field_label(label: Column, name: Column, kind: Column) -> Column:
    """What stands in a field's left cell."""
    return F.coalesce(blank_to_null(label), blank_to_null(name), F.initcap(kind))


def field_value(kind: Column, value: Column, checked: Column, options: Column, label: Column, tooltip: Column) -> Column:
    """The paragraphs of a field's right cell; an empty one is a no-break space."""
    filled, tip = F.coalesce(value, F.lit("")), blank_to_null(tooltip)
    hint = lambda *others: F.when(tip.isNotNull() & ~F.array_contains(F.array(*(F.coalesce(o, F.lit("")) for o in others)), tip), F.concat(F.lit("("), tip, F.lit(")")))
    own = F.when(F.lower(filled).isin("yes", "on"), "").otherwise(filled)
    box = F.trim(F.concat(F.when(F.coalesce(checked, F.lit(False)), CHECKED).otherwise(UNCHECKED), F.lit(" "), own))
    chosen = F.concat(F.lit("Selected: "), F.when(filled == "", "(none)").otherwise(filled))
    listed = F.when(F.coalesce(F.size(options), F.lit(0)) > 0, F.concat(F.lit("Options: "), F.array_join(options, ", ")))
    signed = F.when(filled != "", F.concat(F.lit("Signed: "), filled)).otherwise(hint(label))
    lines = F.transform(F.split(filled, "\r\n|\n|\r"), lambda x: normalised(x))
    kept = lambda *parts: F.filter(F.array(*parts), lambda x: x.isNotNull())
    found = (
        F.when(F.lower(kind) == "checkbox", kept(box, hint(label)))
        .when(F.lower(kind) == "dropdown", kept(chosen, listed, hint(label, value)))
        .when(F.lower(kind) == "signature", kept(F.lit(SIGNATURE), signed))
        .otherwise(F.concat(lines, kept(hint(label, value))))
    )
    return F.transform(found, lambda x: F.when(x == "", NO_BREAK_SPACE).otherwise(x))


def label_width(left: Column, right: Column) -> Column:
    return F.greatest(right - left, F.lit(1.0)) * LABEL_SHARE


def _linear(e: ET.Element) -> str:
    tag, parts = e.tag.rsplit("}", 1)[-1], [_linear(c) for c in e]
    forms = {"msup": (2, "{0}^({1})"), "msub": (2, "{0}_({1})"), "msubsup": (3, "{0}_({1})^({2})"), "mfrac": (2, "({0})/({1})"), "msqrt": (1, "sqrt({0})")}
    if tag in forms and len(parts) >= forms[tag][0]:
        return forms[tag][1].format(*parts)
    if tag == "mfenced" and parts:
        return e.get("open", "(") + e.get("separators", ",").join(parts) + e.get("close", ")")
    return "".join(parts) or "".join(e.itertext())


def linear_math(text: str | None) -> str | None:
    """The MathML that begins somewhere in a text as one line; null for anything else."""
    at = (text or "").find("<math")
    if at < 0:
        return None
    try:
        root = ET.fromstring(text[at:].strip())
    except ET.ParseError:
        return None
    return _linear(root).strip() or "".join(root.itertext()).strip() or None


def _linear_series(text: pd.Series) -> pd.Series:
    return text.map(linear_math)


def math_text(text: Column | str) -> Column:
    """``linear_math`` of a column, in Arrow batches."""
    return F.pandas_udf(_linear_series, StringType())(text)
