"""Timestamps in mixed notations, precisions and time zones as one instant in UTC.

Every notation that a value can be read in gives a candidate, both orders of day and month among them. Per source,
expectation-maximisation over the mixture of notations weighs the candidates: a value contributes the likelihood of each
valid reading, and the posterior chooses the reading or marks the value as ambiguous. A source's known order of day and
month is a prior worth many values; a value that only the other order can read may also be no real date, as often as the
source's values are none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from functools import cache
from zoneinfo import ZoneInfo

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import staged

#: A reading is chosen if its posterior is this at least.
SURE = 0.95
ROUNDS = 30
# The instants (1990 to 2039) that documents are expected to have; others are much less likely under a reading.
EXPECTED = (631_152_000_000_000, 2_208_988_800_000_000)
UNEXPECTED = 1e-4
#: Values that the known order of a source counts for, and the likelihood of a date of the other order under no real date.
KNOWN_ORDER, NO_DATE = 1_000, 0.1
# Zone abbreviations and their offsets in minutes, and those that mean something else in one zone.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "IST": 330, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180, "MSD": 240,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
    "JST": 540, "KST": 540, "HKT": 480, "SGT": 480, "PKT": 300, "GST": 240, "WIB": 420, "ICT": 420, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "SAST": 120, "BRT": -180, "ART": -180,
}
LOCAL_ABBREVIATIONS = {("CST", "Asia/Shanghai"): 480, ("IST", "Europe/Dublin"): 60, ("IST", "Asia/Jerusalem"): 120, ("BST", "Asia/Dhaka"): 360, ("CST", "America/Havana"): -300, ("EST", "Australia/Sydney"): 600}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_ZONE = r"(?:\s*(Z|z|[+-]\d{2}:?\d{2}|[+-]\d{2}|(?:UTC|GMT)[+-]\d{1,2}(?::?\d{2})?|[A-Z]{1,5}|[A-Z][A-Za-z_]+(?:/[A-Za-z_+-]+)+))?(?:\[([A-Za-z_/+-]+)\])?"
#: Notation, pattern, and the groups of year, month, day, hour, minute, second, fraction, half of the day, zone, second zone (0: none).
NOTATIONS = [
    ("pdf", re.compile(r"^D:(\d{4})(?:(\d{2})(?:(\d{2})(?:(\d{2})(?:(\d{2})(?:(\d{2}))?)?)?)?)?(?:(Z)(?:00'?(?:00'?)?)?|([+-]\d{2}'?(?:\d{2}'?)?))?$"), (1, 2, 3, 4, 5, 6, 0, 0, 7, 8)),
    ("ymd", re.compile(rf"^(\d{{4}})[-/.](\d{{2}})[-/.](\d{{2}})(?:[Tt ]\s*{_TIME}{_ZONE})?$"), (1, 2, 3, 4, 5, 6, 7, 0, 8, 9)),
    ("basic", re.compile(r"^(\d{4})(\d{2})(\d{2})(?:[Tt](\d{2})(\d{2})(?:(\d{2})(?:[.,](\d{1,9}))?)?\s*(Z|[+-]\d{2}:?(?:\d{2})?)?)?$"), (1, 2, 3, 4, 5, 6, 7, 0, 8, 0)),
    ("compact", re.compile(r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$"), (1, 2, 3, 4, 5, 6, 0, 0, 0, 0)),
    ("worded", re.compile(rf"^(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})[\s-]([A-Za-z]{{3,9}})\.?[\s-](\d{{4}})(?:,?\s+{_TIME}{_ZONE})?$"), (3, 2, 1, 4, 5, 6, 7, 0, 8, 9)),
    ("dmy", re.compile(rf"^(\d{{1,2}})[/.-](\d{{1,2}})[/.-](\d{{4}})(?:,?\s+{_TIME}(?:\s*([AaPp])\.?[Mm]\.?)?{_ZONE})?$"), (3, 2, 1, 4, 5, 6, 7, 8, 9, 10)),
    ("mdy", re.compile(rf"^(\d{{1,2}})[/.-](\d{{1,2}})[/.-](\d{{4}})(?:,?\s+{_TIME}(?:\s*([AaPp])\.?[Mm]\.?)?{_ZONE})?$"), (3, 1, 2, 4, 5, 6, 7, 8, 9, 10)),
]
# Counts since 1970: notation, digits, and how a unit becomes microseconds.
COUNTS = [("seconds", (9, 10), 1_000_000, 1), ("millis", (12, 13), 1_000, 1), ("micros", (15, 16), 1, 1), ("nanos", (18, 19), 1, 1_000)]
_PATTERNS = {kind: (pattern, [(kind, groups)]) for kind, pattern, groups in NOTATIONS if kind not in ("dmy", "mdy")}
_BY_SHAPE = {
    "pdf": [_PATTERNS["pdf"]],
    "ymd": [_PATTERNS["ymd"]],
    "digits": [_PATTERNS["basic"], _PATTERNS["compact"]],
    "other": [_PATTERNS["worded"], (NOTATIONS[-1][1], [(kind, groups) for kind, _, groups in NOTATIONS[-2:]])],
}
_FIXED = re.compile(r"(?:UTC|GMT)?([+-])(\d{1,2})[:']?(\d{2})?'?$")
_READ = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("utc_us", T.LongType()), T.StructField("status", T.StringType())]))
_EPOCH, _MICRO = datetime(1970, 1, 1), timedelta(microseconds=1)


@cache
def _zone(name: str | None) -> ZoneInfo | None:
    try:
        return ZoneInfo(name) if name and not name.startswith(("/", ".")) else None
    except (KeyError, ValueError, OSError):
        return None


@cache
def _offset(zone: str, home: str | None) -> int | None:
    """Minutes east of UTC that a zone's text fixes, else none."""
    if m := _FIXED.match(zone):
        hours, minutes = int(m[2]), int(m[3] or 0)
        return (hours * 60 + minutes) * (-1 if m[1] == "-" else 1) if hours <= 15 and minutes < 60 else None
    zone = zone.upper()
    return LOCAL_ABBREVIATIONS.get((zone, home or ""), ABBREVIATIONS.get(zone))


def _instant(local: datetime, zone: ZoneInfo) -> tuple[int, str]:
    """The instant of a local time, and whether a clock change skips or repeats it."""
    first, second = local.replace(tzinfo=zone), local.replace(tzinfo=zone, fold=1)
    utc = (local - _EPOCH - first.utcoffset()) // _MICRO
    if first.utcoffset() == second.utcoffset():
        return utc, "instant"
    back = first.astimezone(timezone.utc).astimezone(zone).replace(tzinfo=None)
    return utc, "repeated" if back == local.replace(fold=0) and first.utcoffset() > second.utcoffset() else "skipped"


def _reading(kind: str, found: re.Match, groups: tuple[int, ...], home: str | None) -> tuple[str, int, str] | None:
    y, mo, d, h, mi, s, frac, half, zone, zone2 = (found[g] if g else None for g in groups)
    if kind == "worded":
        if (mo := mo[:3].lower()) not in MONTHS:
            return None
        mo = MONTHS.index(mo) + 1
    hour = int(h or 0)
    if half:
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + (12 if half in "Pp" else 0)
    try:
        local = datetime(int(y), int(mo or 1), int(d or 1), hour, int(mi or 0), int(s or 0), int((frac or "0")[:6].ljust(6, "0")))
    except ValueError:
        return None
    zone = zone or zone2
    if zone and (offset := _offset(zone, home)) is not None:
        return kind, (local - _EPOCH) // _MICRO - offset * 60_000_000, "instant"
    where = _zone(zone or home)
    if where is None:
        return None
    try:
        return kind, *_instant(local, where)
    except OverflowError:
        return None


def _notations(v: str) -> list:
    """The notations that a value may have by its first characters."""
    if v.startswith("D:"):
        return _BY_SHAPE["pdf"]
    if v[:4].isdecimal() and len(v) > 4:
        return _BY_SHAPE["ymd" if v[4] in "-/." else "digits"]
    return _BY_SHAPE["other"]


def readings(value: str | None, home: str | None) -> list[tuple[str, int, str]]:
    """Every valid reading of a value: notation, microseconds since 1970, status. None for null and for what is no real time."""
    v = (value or "").strip("\ufeff \t\r\n\u00a0")
    out = []
    for pattern, kinds in _notations(v) if v else ():
        if m := pattern.match(v):
            out += [r for kind, groups in kinds if (r := _reading(kind, m, groups, home))]
    if v.isdecimal() and v.isascii():
        out += [(kind, int(v) * up // down, "instant") for kind, digits, up, down in COUNTS if len(v) in digits]
    return out


def _weights(rows: pd.DataFrame) -> pd.DataFrame:
    """EM over one source's notations; a row is a set of readings (``sig``: kind:likely, comma between) and its count.

    No readings at all count for the notation ``none``.
    """
    order = rows._lm_order.iloc[0]
    other = {"dmy": "mdy", "mdy": "dmy"}.get(order)
    sets = [[(k, 1.0 if x == "1" else UNEXPECTED) for k, x in (p.split(":") for p in s.split(",") if p)] for s in rows._lm_sig]
    sets = [s + [("none", 1.0 if not s else NO_DATE)] if not s or {k for k, _ in s} == {other} else s for s in sets]
    kinds = sorted({k for s in sets for k, _ in s} | ({order, "none"} if other else set()))
    weight = {k: 1.0 / len(kinds) for k in kinds}
    total = rows.n.sum() + len(kinds) + (1.1 * KNOWN_ORDER if other else 0)
    for _ in range(ROUNDS):
        sums = dict.fromkeys(kinds, 1.0)
        if other:
            sums[order] += KNOWN_ORDER
            sums["none"] += KNOWN_ORDER / 10
        for s, n in zip(sets, rows.n):
            z = sum(weight[k] * p for k, p in s)
            for k, p in s:
                sums[k] += n * weight[k] * p / z
        weight = {k: x / total for k, x in sums.items()}
    out = []
    for sig, s in zip(rows._lm_sig, sets):
        if not sig:
            continue
        z = sum(weight[k] * p for k, p in s)
        best, p = max(s, key=lambda kp: (weight[kp[0]] * kp[1], kp[0]))
        out.append((rows._lm_source.iloc[0], order, sig, best, weight[best] * p / z))
    return pd.DataFrame(out, columns=["_lm_source", "_lm_order", "_lm_sig", "_lm_kind", "_lm_posterior"])


def normalised(df: DataFrame, value: str = "value", source: str = "source", home_zone: str = "home_zone", date_order: str = "date_order") -> DataFrame:
    """``df`` with ``utc_us``, ``kind``, ``posterior`` and ``time_status``; columns that have these names already are replaced.

    ``time_status``: ``instant``; ``ambiguous`` (no reading is sure enough); ``skipped`` or ``repeated`` (a local time that
    a clock change skips or repeats); ``unusable`` (null, empty, or no real time; also where only the order of day and
    month that the source does not use can read it). ``utc_us`` is null but for ``instant``. A value without zone is
    local time in ``home_zone``; where that is null it is unusable. Repeated rows stay repeated. The readings are
    written once to the shared folder, as both the weights and the result come from them.
    """
    df = df.drop("utc_us", "kind", "posterior", "time_status")
    columns = df.columns
    own = [T.StructField(f"_lm_{c}", T.StringType()) for c in ("source", "order", "sig")] + [T.StructField("_lm_read", _READ)]
    schema = T.StructType([*df.schema.fields, *own])
    at = [columns.index(c) for c in (value, home_zone, date_order, source)]

    def read_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_schema(schema)
        for batch in batches:
            v, home, order, origin = (batch.column(i).to_pylist() for i in at)
            found = [readings(*x) for x in zip(v, home)]
            sigs = [",".join([f"{k}:{int(EXPECTED[0] <= u < EXPECTED[1])}" for k, u, _ in x]) for x in found]
            made = [[{"kind": k, "utc_us": u, "status": s} for k, u, s in x] for x in found]
            more = [pa.array([x or "" for x in origin]), pa.array([x or "" for x in order]), pa.array(sigs), pa.array(made, kind.field("_lm_read").type)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], schema=pa.schema([*batch.schema, *list(kind)[-4:]]))

    read = staged(df.mapInArrow(read_all, schema), "readings")
    by = ["_lm_source", "_lm_order"]
    counted = read.groupBy(*by, "_lm_sig").agg(F.count("*").alias("n"))
    weights = counted.groupBy(*by).applyInPandas(_weights, "_lm_source string, _lm_order string, _lm_sig string, _lm_kind string, _lm_posterior double")
    chosen = read.join(weights, [*by, "_lm_sig"], "left")
    best = F.element_at(F.filter("_lm_read", lambda c: c["kind"] == F.col("_lm_kind")), 1)
    same = F.size(F.array_distinct(F.transform("_lm_read", lambda c: c["utc_us"]))) == 1
    none = (F.size("_lm_read") == 0) | (F.col("_lm_kind") == "none")
    unsure = (F.col("_lm_posterior") < SURE) & (~same | (F.size("_lm_read") == 1))
    status = F.when(none, "unusable").when(unsure, "ambiguous").otherwise(best["status"])
    return chosen.select(
        *(F.col(f"`{c}`") for c in columns),
        F.when(status == "instant", best["utc_us"]).alias("utc_us"),
        F.when(~none, F.col("_lm_kind")).alias("kind"),
        F.when(~none, F.col("_lm_posterior")).alias("posterior"),
        status.alias("time_status"),
    )
