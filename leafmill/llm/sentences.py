"""Sentence boundaries across languages and scripts.

What a period means is learned per language from the whole corpus, without labels: a word that stands before a period far
more often than chance allows is an abbreviation, words that begin sentences far more often than they stand elsewhere are
starters, and words that follow a number's period far more often than they occur are its collocations; all three by
log-likelihood ratios of counts. Each period is then classified by these; other marks, quotes, brackets, list items and
blank lines follow rules.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from . import langid
from .batches import map_columns
from .encoding import loaded, share

#: Log-likelihood ratios beyond which a word is an abbreviation, a starter, a collocation; the least count of evidence.
ABBREVIATION, STARTER, COLLOCATION, LEAST = 0.3, 30.0, 7.88, 3
#: What is learned must also be this share of a language's periods, starts or numbers: so a language has 1 / RARE words of a kind at most.
RARE = 5e-6
_NEUTRAL = "und"
# Languages that aren't written in Latin script.
OTHER_SCRIPTS = ("ar", "bg", "bn", "el", "fa", "he", "hi", "ja", "ko", "ru", "sr", "th", "uk", "ur", "zh")

# Marks that end a sentence, closing and opening signs, pairs of quotes and brackets, list markers.
STRONG = "!?。！？؟।॥"
CLOSERS = "”“\"»«›’')]}」』）】》〉"
PAIRS = {"“": "”", "„": "“”", "«": "»", "»": "«", "「": "」", "『": "』", "‹": "›", "(": ")", "（": "）", "[": "]", "【": "】", "《": "》", '"': '"'}
BRACKETS = "(（[【"
_SIGNS = re.compile("[" + "".join(re.escape(c) for c in sorted({*PAIRS, *"".join(PAIRS.values())})) + "]")
_CLOSES = {c: [kind for kind, ends in PAIRS.items() if c in ends] for c in "".join(PAIRS.values())}
_MARKS = re.compile(rf"[.{STRONG}…]+")
_BLANK = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
_ITEM = re.compile(r"\n[^\S\n]*(?:([-–—•*‣◦·])|(\d{1,3})[.)]|([A-Za-z])[)])[^\S\n]+(?=\S)")
_WORD = re.compile(r"[^\W\d_]+")
_NUMBER = re.compile(r"[\d.,:/-]*\d$")
_THAI_GAP = re.compile(r"(?<=[฀-๿])[^\S\n]*[\s]+(?=[฀-๿A-Z\"“„«])|(?<=[a-zA-Z.!?\"”»])\s+(?=[฀-๿])")
# How speech goes on behind a quote in scripts without case.
_AFTER_QUOTE = re.compile(r"(?:と|って|という|は|が|を|に|も|の|で|や|など|から|まで)|\s*(?:하고|라고|이라고|라는|이라는|라며|며|고\s)")
#: Stands for what is before the first and behind the last token of a paragraph; no token holds white space.
EDGE = "\n"
_STRIP = "\"'“”„«»‹›‘’()[]{}「」『』（）【】¿¡"


def _cased(ch: str) -> bool:
    return ch.lower() != ch.upper()


def _llr(both: float, first: float, second: float, n: float) -> float:
    """Dunning's ratio that the second comes with the first by another rate than without it; 0 if by a lower one."""
    def part(k: float, m: float, p: float) -> float:
        p = min(max(p, 1e-12), 1 - 1e-12)
        return k * math.log(p) + (m - k) * math.log(1 - p)

    if not first or n <= first:
        return 0.0
    p, p1, p2 = second / n, both / first, (second - both) / (n - first)
    if p1 <= p2:
        return 0.0
    return 2 * (part(both, first, p1) + part(second - both, n - first, p2) - part(both, first, p) - part(second - both, n - first, p))


@dataclass
class Periods:
    """What is learned of one language."""

    abbreviations: set[str] = field(default_factory=set)
    starters: set[str] = field(default_factory=set)
    after_number: set[str] = field(default_factory=set)

    def starts(self, word: str) -> bool:
        return word in self.starters


def _kind(token: str) -> str:
    """A token before a period, without signs around it; numbers are one kind."""
    token = token.strip(_STRIP)
    return "##" if _NUMBER.match(token) and not any(c.isalpha() for c in token) else token


def _is_initial(token: str) -> bool:
    return len(token) == 1 and token.isalpha() or bool(re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", token))


def count_pairs(text: str, out: Counter) -> None:
    """Each token of a paragraph with the one behind it; EDGE stands for what is before the first and behind the last."""
    for paragraph in _BLANK.split(text):
        if found := paragraph.split():
            out.update(zip((EDGE, *found), (*found, EDGE)))


def count_types(t: str, behind: str, n: int, out: Counter) -> None:
    """For ``n`` pairs of tokens, of the first one: with a period at its end, of these at a paragraph's end and before a small letter, digit or comma; without one."""
    if t == EDGE:
        return
    last = behind == EDGE
    if t.endswith(".") and not t.endswith(".."):
        k = _kind(t[:-1])
        # before a closing sign that stands by itself nothing can be told
        if (last or behind.strip(CLOSERS)) and k and k != "##":
            out[(k, "with")] += n
            if last:
                out[(k, "end")] += n
            elif (c := behind.lstrip(_STRIP)[:1]) and (c.islower() or c.isdigit()):
                out[(k, "on")] += n
        out[("", "periods")] += n
        out[("", "marks")] += n
        out[("", "ends")] += n * last
    else:
        if t.rstrip(CLOSERS)[-1:] in STRONG and t.strip(CLOSERS):
            out[("", "marks")] += n
            out[("", "ends")] += n * last
        k = t.strip(_STRIP + ",;:!?…")
        if t.endswith((".,", ".;", ".:")) and k.endswith("."):
            out[(k[:-1], "with")] += n
            out[(k[:-1], "on")] += n
        elif k and any(c.isalpha() for c in k):
            out[(k, "without")] += n
    out[("", "tokens")] += n


def abbreviations(rows: dict[str, dict[str, int]], total: dict[str, int]) -> set[str]:
    """The types of one language that are abbreviations; ``rows`` has the counts of types that stand before periods."""
    n, marks, ends = max(2, total.get("tokens", 0)), max(1, total.get("marks", 0)), total.get("ends", 0)
    p1 = min(0.9, max(1, total.get("periods", 0)) / n)
    out = set()
    for k, c in rows.items():
        a, b = c.get("with", 0), c.get("without", 0)
        if a < max(LEAST, RARE * total.get("periods", 0)) or not any(x.isalpha() for x in k):
            continue
        scale = min(1.0, 1000 / (a + b))
        ratio = 2 * scale * (a * math.log(0.99 / p1) + b * math.log(0.01 / (1 - p1)))
        size = len(k.replace(".", ""))
        score = ratio * math.exp(-size) * (k.count(".") + 1) * max(1, size) ** (-10.0 * b / a)
        # a word that only stands at sentence ends is at a paragraph's end as often as any mark, and nothing goes on behind it
        within = a - c.get("end", 0)
        apart = _llr(marks - ends - within, marks - a, marks - ends, marks)
        inside = c.get("end", 0) < 0.25 * a * ends / marks and (_llr(within, a, marks - ends, marks) >= COLLOCATION or a > marks - ends)
        if score >= ABBREVIATION and (c.get("on", 0) >= 0.2 * a or inside and size < 5) and apart <= COLLOCATION:
            out.add(k)
    return out


def count_words(before: str, t: str, n: int, known: set[str], out: Counter) -> None:
    """For ``n`` pairs of tokens, of the second one if capitalised: at sure starts, inside sentences; of any: after a number's period, in all."""
    if t == EDGE:
        return
    sure = before == EDGE
    if sure:
        before = ""
    else:
        k = _kind(before[:-1]) if before.endswith(".") else ""
        sure = bool(k) and k != "##" and k not in known and not _is_initial(k) and not before.endswith("..") or before.endswith(("!", "?"))
        before = "##." if k == "##" else before
    m = _WORD.search(t)
    if m and m.start() <= 2:
        w = m[0]
        out[(w, "all")] += n
        if w[0].isupper() or not _cased(w[0]):
            if sure:
                out[(w, "start")] += n
            elif before.strip(_STRIP) and not before.endswith((".", ":", "!", "?", "…")) and not before.rstrip(CLOSERS).endswith(tuple("." + STRONG)) and t[0] not in PAIRS:
                out[(w, "mid")] += n
        if before == "##.":
            out[(w, "after")] += n
    out[("", "words")] += n
    out[("", "starts")] += n * sure
    out[("", "numbers")] += n * (t.endswith(".") and _kind(t[:-1]) == "##")


def starters(rows: dict[str, dict[str, int]], total: dict[str, int]) -> tuple[set[str], set[str]]:
    """Words that begin sentences, and words that belong to a number with a period before them."""
    n, begin, numbers = max(2, total.get("words", 0)), total.get("starts", 0), total.get("numbers", 0)
    first = {
        w
        for w, c in rows.items()
        if c.get("start", 0) >= max(LEAST, RARE * begin) and c.get("mid", 0) <= 0.03 * c["start"] and w[0].isupper() and _llr(c["start"], c.get("all", 0), begin, n) >= STARTER
    }
    return first, {w for w, c in rows.items() if w not in first and c.get("after", 0) >= max(LEAST, RARE * numbers) and _llr(c["after"], numbers, c.get("all", 0), n) >= COLLOCATION}


def _spans(text: str) -> list[tuple[int, int, bool]]:
    """Quotes and brackets with both ends, the outer ones: start, end (of the closing sign), whether a bracket."""
    signs = [(m.start(), m[0]) for m in _SIGNS.finditer(text)]
    if len(signs) < 2:
        return []
    # each kind of opening sign is matched by itself; a sign that may do both closes, if its kind is open
    ends: dict[int, int] = {}
    stacks: dict[str, list[int]] = {}
    for i, ch in signs:
        for kind in _CLOSES.get(ch, ()):
            if stacks.get(kind):
                ends[stacks[kind].pop()] = i + 1
                if kind == ch:
                    break
        else:
            if ch in PAIRS:
                stacks.setdefault(ch, []).append(i)
    out: list[tuple[int, int, bool]] = []
    at = 0
    for i, ch in signs:
        if i >= at and i in ends and not (ch in '»"' and i and not text[i - 1].isspace() and text[i - 1] not in "(（[" and not _no_spaces(text[i - 1])):
            out.append((i, ends[i], ch in BRACKETS))
            at = ends[i]
    return out


@cache
def _no_spaces(ch: str) -> bool:
    """Whether the letter's script writes words without spaces."""
    o = ord(ch)
    return 0x3040 <= o < 0xA000 or 0xFF00 <= o < 0xFFF0 or 0x3000 <= o < 0x3040


def _next(text: str, at: int) -> int:
    while at < len(text) and text[at].isspace():
        at += 1
    return at


def _continues(text: str, at: int, framed: bool) -> bool:
    """Whether the sentence goes on behind a quote that ends at ``at`` with a mark inside."""
    k = _next(text, at)
    if k == len(text):
        return False
    c = text[k]
    if c in ",;:–—-.，、；：":
        return True
    if c.isalpha():
        if _cased(c):
            return c.islower()
        if _AFTER_QUOTE.match(text, at):
            return True
        if k == at and _no_spaces(c):
            return not framed
        return not framed and not (0xAC00 <= ord(c) < 0xD7A4)
    return False


def _ends_period(text: str, start: int, dot: int, after: int, p: Periods) -> bool:
    """Whether the single period at ``dot`` ends a sentence; ``after`` is behind its closing signs."""
    if after >= len(text):
        return True
    c = text[after]
    left = dot
    while left > start and not text[left - 1].isspace():
        left -= 1
    token = text[left:dot]
    bare = token.strip(_STRIP)
    if not c.isspace():  # a missing space: only between whole words
        if not bare or re.search(r"[\d/@_]", token) or not text[dot - 1].isalpha():
            return False
        if _cased(c):
            word = re.search(r"[^\W\d_]+$", bare)
            return c.isupper() and bool(word) and len(word[0]) > 1 and (text[dot - 1].islower()) and text[after + 1 : after + 2].islower() | text[after + 1 : after + 2].isspace() and bare not in p.abbreviations
        return c.isalpha() and not _cased(text[dot - 1]) and bare not in p.abbreviations and len(bare) > 1
    k = _next(text, after)
    if k == len(text):
        return True
    lead = k
    while k < len(text) and text[k] in _STRIP:
        k += 1
    c = text[k] if k < len(text) else ""
    if c.isalpha() and _cased(c) and c.islower():  # only behind a whole word that is known for nothing else
        return len(bare) > 3 and bare.isalpha() and bare.islower() and bare not in p.abbreviations and lead == k
    if c in ",;:–—":
        return False
    if c.isalpha() and not _cased(c) and _cased(text[dot - 1]) and len(bare) > 1:
        return True
    word = m[0] if (m := _WORD.match(text, k)) else ""
    number = _kind(token) == "##"
    if number:
        return word not in p.after_number
    last = re.split(r"[-/  (]", bare)[-1]
    if last in p.abbreviations or bare in p.abbreviations or _is_initial(last) or _is_initial(bare):
        if text[lead : lead + 1] in ("¿", "¡"):
            return True
        return p.starts(word)
    return bool(c) or True


def split_piece(text: str, p: Periods, out: list[tuple[int, int]], base: int) -> None:
    """Append the sentences of a text without blank lines or list items, as places from ``base`` on."""
    spans = _spans(text)
    start, k = 0, 0

    def add(end: int) -> None:
        nonlocal start
        a, b = start, end
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((base + a, base + b))
        start = end

    gaps = [(m.start(), m.end()) for m in _THAI_GAP.finditer(text)] if re.search("[฀-๿]", text) else []
    events = sorted([(m.start(), m.end(), True) for m in _MARKS.finditer(text)] + [(a, b, False) for a, b in gaps])
    for a, b, mark in events:
        if b <= start:
            continue
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        span = spans[k] if k < len(spans) and spans[k][0] < a else None
        if not mark:
            if span is None and not text[max(0, a - 1)].isdigit():
                add(b)
            continue
        end = b
        while end < len(text) and text[end] in CLOSERS and (span is not None and end < span[1] or text[end] in "”’')]»" and not (end + 1 < len(text) and text[end + 1].isalpha() and _no_spaces(text[end + 1]))):
            end += 1
        if span is not None and end < span[1] and not text[end : span[1] - 1].strip():  # a space before the closing sign
            end = span[1]
        if span is not None:
            framed = any(c.isalpha() for c in text[start : span[0]])
            if end < span[1]:  # the mark stands inside
                if span[2] or framed or _continues(text, span[1], False) or text[span[1] : span[1] + 1] in tuple("." + STRONG):
                    continue
            elif span[2]:
                if framed:
                    continue
            elif _continues(text, end, framed):
                continue
        run = text[a:b]
        here = text[end] if end < len(text) else ""
        nxt = _next(text, end)
        c = text[nxt] if nxt < len(text) else ""
        if any(x in STRONG for x in run):
            if c.isalpha() and _cased(c) and c.islower() and (span is not None or end == nxt):
                continue
            if here and not here.isspace() and run[-1] in "!?" and end == b and not (here.isalpha() and (here.isupper() or not _cased(here))) and here not in PAIRS:
                continue
            add(end)
        elif len(run) > 1 or run == "…":
            j = nxt
            while j < len(text) and text[j] in _STRIP:
                j += 1
            c = text[j] if j < len(text) else ""
            if not c or c.isalpha() and (c.isupper() or not _cased(c)) and here.isspace():
                add(end)
        elif _ends_period(text, start, a, end, p):
            add(end)
    add(len(text))


def sentences(text: str | None, p: Periods) -> list[tuple[int, int]]:
    """Places of the sentences: code points, end exclusive, without white space around them. Null and empty texts have none."""
    if not text or not text.strip():
        return []
    out: list[tuple[int, int]] = []
    at = 0
    bounds = [(m.start(), m.end()) for m in _BLANK.finditer(text)]
    for a, b in [*bounds, (len(text), len(text))]:
        _paragraph(text[at:a], at, p, out)
        at = b
    return out


def _paragraph(text: str, base: int, p: Periods, out: list[tuple[int, int]]) -> None:
    cuts: list[int] = []
    number, letter, bullet = 0, "", ""
    for m in _ITEM.finditer("\n" + text):
        at = m.start()
        before = text[:at].rstrip()
        leads = not before or before.endswith((":", "："))
        if m[1]:
            good = leads or bullet == m[1]
            bullet = m[1] if good else bullet
        elif m[2]:
            good = int(m[2]) == number + 1 and (number > 0 or leads) or leads and int(m[2]) == 0
            number = int(m[2]) if good else number
        else:
            good = leads and m[3] in "aA" or bool(letter) and ord(m[3]) == ord(letter) + 1
            letter = m[3] if good else letter
        if good:
            cuts.append(at)
    if not cuts:
        return split_piece(text, p, out, base)
    split_piece(text[: cuts[0]], p, out, base)
    for a, b in zip(cuts, [*cuts[1:], len(text)]):
        item = text[a:b]
        lead, tail = len(item) - len(item.lstrip()), len(item.rstrip())
        if lead < tail:
            out.append((base + a + lead, base + a + tail))
    return None


def with_languages(df: DataFrame, key: str, model: bytes, text: str = "text") -> DataFrame:
    """``key``, ``text`` and its main language ``lang``, as a written table; null texts are left out."""
    shared = share(df.sparkSession, model)
    kind = dict(df.dtypes)[key]

    def make():
        m = loaded(shared)
        return lambda keys, texts: (keys, texts, document_languages(m, texts))

    return staged(map_columns(df.where(F.col(text).isNotNull()).select(key, text), make, f"`{key}` {kind}, text string, lang string"), "texts")


def _pairs(df: DataFrame) -> DataFrame:
    """``lang``, ``word``, ``behind``, ``n``: the pairs of neighbouring tokens, counted in each batch before the shuffle, as a written table."""

    def run(langs, texts):
        by: dict[str, Counter] = {}
        for lang, t in zip(langs, texts):
            count_pairs(t, by.setdefault(lang, Counter()))
        keys = [k for c in by.values() for k in c]
        return [lang for lang, c in by.items() for _ in range(len(c))], [a for a, _ in keys], [b for _, b in keys], [n for c in by.values() for n in c.values()]

    each = map_columns(df.select("lang", "text"), lambda: run, "lang string, word string, behind string, n bigint")
    return staged(each.groupBy("lang", "word", "behind").agg(F.sum("n").alias("n")), "pairs")


def _counted(pairs: DataFrame, known: dict[str, set[str]] | None) -> DataFrame:
    """``lang``, ``word``, ``what``, ``n`` over all pairs: of types, or with the ``known`` abbreviations of words."""
    sent = pairs.sparkSession.sparkContext.broadcast(known)

    def run(langs, words, behind, counts):
        by: dict[str, Counter] = {}
        for lang, a, b, n in zip(langs, words, behind, counts):
            c = by.setdefault(lang, Counter())
            if sent.value is None:
                count_types(a, b, n, c)
            else:
                count_words(a, b, n, sent.value.get(lang, set()), c)
        rows = [(lang, w, what, n) for lang, c in by.items() for (w, what), n in c.items() if n]
        return tuple(map(list, zip(*rows))) if rows else ([], [], [], [])

    each = map_columns(pairs, lambda: run, "lang string, word string, what string, n bigint")
    return each.groupBy("lang", "word", "what").agg(F.sum("n").alias("n"))


def document_languages(m: langid.Languages, texts: list[str | None]) -> list[str]:
    """The main language of each text, by all of it."""
    if not m.codes:
        return [_NEUTRAL] * len(texts)
    found = m.scores([t or "" for t in texts])[:, :-1]
    return [m.codes[i] if s[i] else _NEUTRAL for s, i in zip(found, found.argmax(1))]


def _totals(counted: DataFrame) -> dict[str, dict[str, int]]:
    """The totals of each language."""
    out: dict[str, dict[str, int]] = {}
    for lang, what, n in counted.where(F.col("word") == "").select("lang", "what", "n").collect():
        out.setdefault(lang, {})[what] = n
    return out


def _selected(counted: DataFrame, least: str, totals: dict[str, dict[str, int]], test: Callable[[dict, dict], dict[str, set[str]]]) -> dict[str, dict[str, set[str]]]:
    """What ``test`` selects of the words of each language that have counts of ``least``; it runs where the counts are, and only the selected words, the model's parameters, come to the driver."""
    some = F.array_contains(F.map_keys("c"), least.split()[0])
    for other in least.split()[1:]:
        some = some | F.array_contains(F.map_keys("c"), other)
    wide = counted.where(F.col("word") != "").groupBy("lang", "word").agg(F.map_from_entries(F.collect_list(F.struct("what", "n"))).alias("c"))

    def make():
        def run(langs, words, counts):
            by: dict[str, dict[str, dict]] = {}
            for lang, w, c in zip(langs, words, counts):
                by.setdefault(lang, {})[w] = dict(c)
            rows = [(lang, role, w) for lang, x in by.items() for role, found in test(x, totals.get(lang, {})).items() for w in found]
            return tuple(map(list, zip(*rows))) if rows else ([], [], [])

        return run

    out: dict[str, dict[str, set[str]]] = {lang: {} for lang in totals}
    for lang, role, w in map_columns(wide.where(some), make, "lang string, role string, word string").collect():
        out[lang].setdefault(role, set()).add(w)
    return out


def learn(df: DataFrame) -> dict[str, Periods]:
    """What periods mean in each language, from counts over all documents (``df`` as ``with_languages`` gives it)."""
    pairs = _pairs(df)
    types = staged(_counted(pairs, None), "types")
    # foreign words in languages of other scripts count where they are at home
    known = {lang: {w for w in x.get("abbreviation", set()) if not (lang in OTHER_SCRIPTS and re.match("[A-Za-z]", w))} for lang, x in _selected(types, "with", _totals(types), lambda rows, total: {"abbreviation": abbreviations(rows, total)}).items()}
    words = staged(_counted(pairs, known), "words")
    found = _selected(words, "start after", _totals(words), lambda rows, total: dict(zip(("first", "after"), starters(rows, total))))
    return {lang: Periods(x, found.get(lang, {}).get("first", set()), found.get(lang, {}).get("after", set())) for lang, x in known.items()}


def split(df: DataFrame, key: str, learned: dict[str, Periods]) -> DataFrame:
    """``key``, ``lang``, ``start_pos``, ``end_pos`` of every sentence (``df`` as ``with_languages`` gives it); blank texts have none. Repeated rows stay repeated."""
    sent = df.sparkSession.sparkContext.broadcast(learned)
    kind = dict(df.dtypes)[key]

    def make():
        latin = Periods(*({w for p in sent.value.values() for w in part(p) if w.isascii()} for part in (lambda p: p.abbreviations, lambda p: p.starters, lambda p: p.after_number)))
        mixed = {lang: _with_latin(lang, p, latin) for lang, p in sent.value.items()}

        def run(keys, texts, langs):
            out = ([], [], [], [])
            for k, t, lang in zip(keys, texts, langs):
                found = sentences(t, mixed.get(lang, latin))
                out[0].extend([k] * len(found))
                out[1].extend([lang] * len(found))
                out[2].extend([a for a, _ in found])
                out[3].extend([b for _, b in found])
            return out

        return run

    return map_columns(df.select(key, "text", "lang"), make, f"`{key}` {kind}, lang string, start_pos int, end_pos int")


def _with_latin(lang: str, p: Periods, latin: Periods) -> Periods:
    """Languages of other scripts hold foreign sentences now and then: there what holds in languages of Latin script counts too."""
    script = Counter(unicodedata.name(w[0], "?").split()[0] for w in p.abbreviations | p.starters if w)
    if lang not in OTHER_SCRIPTS and script.get("LATIN", 0) * 2 >= sum(script.values()):
        return p
    return Periods(p.abbreviations | latin.abbreviations, p.starters | latin.starters, p.after_number | latin.after_number)
