"""One consistent form for text that looks the same but is made of other characters.

The text of a batch is exploded to positioned code points; each code point is joined to its decomposition (a mapping
table that is sent to every executor) and, by the script of its word, to its look-alike; combining marks are ordered by
their class, the characters are recomposed and the strings built again. The rows of this explosion stay inside an Arrow
batch as numpy columns: a row per character never goes through a shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np

# Letters of other scripts that look like Latin ones.
CYRILLIC_AS_LATIN = dict(zip("аеорсухіјѕԁһԛԝӏАВЕЅІЈКМНОРСТУХԌԚԜҮ", "aeopcyxijsdhqwlABESIJKMHOPCTYXGQWY"))
GREEK_AS_LATIN = dict(zip("οναιρυκχϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ovaipukxcjABEZHIKMNOPTYXCJ"))
LATIN_AS_CYRILLIC = dict(zip("aeopcyxijsABEKMHOPCTYXIJS", "аеорсухіјѕАВЕКМНОРСТУХІЈЅ"))
# Letters of further scripts (Armenian, Cherokee, Coptic, Lisu) that look like Latin ones.
FURTHER_AS_LATIN = dict(zip(
    "օսհոցզՕՍՏԼ" "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏚᏙᏞᏟᏢᏦᏴ" "ⲞⲟⲤⲥⲢⲣⲬⲘⲚⲔⲎⲦ" "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ",
    "ouhngqOUSL" "DRTAJEWMHGZSVLCPKB" "OoCcPpXMNKHT" "BPDTGKJCZFMNLSRVHWXYAEIOU",
))
# Variants inside the Latin script.
LATIN_VARIANTS = {"ɑ": "a", "ɡ": "g"}
# Characters that show nothing; white space of another kind than the plain space; hyphens.
INVISIBLE = "­͏؜᠎​-‏‪-‮⁠-⁤⁪-⁯︀-️﻿\U000e0000-\U000e007f"
SPACES = "   -   　"
HYPHENS = "‐‑﹣－"
# Blocks whose characters are other forms (width, position, ligature, radical, style) of ordinary ones.
FORMS = "Ⅰ-ⅿ⺀-⿟ﬀ-ﬆﬓ-ﬗיִ-﷿ﹰ-ﻼ！-ﾟﾡ-￦\U0001d400-\U0001d7ff"
# Blocks of characters that may have to be composed.
PARTS = "̀-ͯᄀ-ᇿ゙゚ٓ-ٕ"

ALWAYS = re.compile(f"[{INVISIBLE}{SPACES}{HYPHENS}{FORMS}{PARTS}{''.join(LATIN_VARIANTS)}]")
LATIN = re.compile("[A-Za-zÀ-ɏ]")
OTHER = re.compile("[Ͱ-ԯἀ-῿]")
FURTHER = re.compile("[" + "".join(FURTHER_AS_LATIN) + "]")
_NONE, _LATIN, _CYRILLIC, _GREEK, _BREAK = 0, 1, 2, 3, 4
_in_forms = re.compile(f"[{FORMS}]").fullmatch
_in_invisible = re.compile(f"[{INVISIBLE}]").fullmatch
_in_spaces = re.compile(f"[{SPACES}]").fullmatch
_in_hyphens = re.compile(f"[{HYPHENS}]").fullmatch


@cache
def _decomposed(ch: str) -> str:
    """What ``ch`` is made of: nothing for an invisible character, plain letters and marks for other forms."""
    if _in_invisible(ch):
        return ""
    if _in_spaces(ch):
        return " "
    if _in_hyphens(ch):
        return "-"
    if ch in LATIN_VARIANTS:
        return LATIN_VARIANTS[ch]
    if ch == "ｰ":
        return "ー"
    return unicodedata.normalize("NFKD", ch).lstrip(" ") if _in_forms(ch) else unicodedata.normalize("NFD", ch)


@cache
def _script(ch: str) -> int:
    kind = unicodedata.category(ch)[0]
    if kind == "M":
        return _NONE
    if kind != "L":
        return _BREAK
    o = ord(ch)
    return _LATIN if o < 0x250 else _CYRILLIC if 0x400 <= o < 0x530 else _GREEK if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000 else _NONE


@cache
def _ambiguous(ch: str) -> bool:
    """Whether the letter has a look-alike in another of the three scripts."""
    return ch in CYRILLIC_AS_LATIN or ch in GREEK_AS_LATIN or ch in LATIN_AS_CYRILLIC


@cache
def _as_script(ch: str, script: int) -> str:
    latin = CYRILLIC_AS_LATIN.get(ch) or GREEK_AS_LATIN.get(ch) or FURTHER_AS_LATIN.get(ch)
    if script == _LATIN:
        return latin or ch
    if script == _CYRILLIC and _script(ch) != _CYRILLIC:
        return LATIN_AS_CYRILLIC.get(latin or ch, ch)
    return ch


def _scripts_of_words(cp: np.ndarray, row: np.ndarray, script: np.ndarray, sure: np.ndarray) -> np.ndarray:
    """For each position the script of its word; words without a letter of one script only take their neighbours'."""
    letter = script != _BREAK
    start = letter & np.r_[True, ~letter[:-1] | (row[1:] != row[:-1])]
    word = np.cumsum(start) - 1
    n = int(word[-1]) + 1 if len(word) else 0
    out = np.zeros(len(cp), np.int8)
    if not n:
        return out
    at = np.flatnonzero(letter)
    votes = np.zeros((n, 4), np.int32)
    np.add.at(votes, (word[at], script[at]), np.where(sure[at], 1000, 1))
    votes[:, _NONE] = 0
    votes[:, _GREEK] -= votes[:, _GREEK] % 1000 > 0  # a tie goes to the other scripts
    best, top = votes.argmax(1), votes.max(1)
    of_row = row[np.flatnonzero(start)]
    fixed = top >= 1000
    # a word of Latin letters alone is a name or sign that other scripts use, too
    for w in np.flatnonzero(~fixed & (top > 0) & (votes[:, _LATIN] < votes.sum(1))):
        sides = []
        for step in (-1, 1):
            k = w + step
            while 0 <= k < n and of_row[k] == of_row[w] and not fixed[k]:
                k += step
            if 0 <= k < n and of_row[k] == of_row[w]:
                sides.append(best[k])
        if sides and len(set(sides)) == 1:
            best[w] = sides[0]
    out[at] = best[word[at]]
    return out


def _rebuild(texts: list[str]) -> list[str]:
    """The consistent form of each text, by explosion, joins to the mappings, ordering and recomposition."""
    joined = "".join(texts)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    # join with the decompositions
    kinds, which = np.unique(cp, return_inverse=True)
    parts = [_decomposed(chr(k)) for k in kinds]
    size = np.array([len(p) for p in parts], np.int64)
    first = np.cumsum(size) - size
    flat = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    each = size[which]
    row = np.repeat(row, each)
    within = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
    cp = flat[np.repeat(first[which], each) + within] if len(flat) else np.zeros(0, np.uint32)
    if not len(cp):
        return ["" for _ in texts]
    # order the combining marks behind each starter by class
    kinds, which = np.unique(cp, return_inverse=True)
    signs = [chr(k) for k in kinds]
    marks = np.array([unicodedata.combining(c) for c in signs], np.int16)[which]
    if marks.any():
        starter = np.cumsum((marks == 0) | np.r_[True, row[1:] != row[:-1]])
        order = np.lexsort((np.arange(len(cp)), marks, starter))
        cp, row, which = cp[order], row[order], which[order]
    # join with the look-alikes, by the script of the word
    script = np.array([_script(c) for c in signs], np.int8)[which]
    sure = np.array([_script(c) in (1, 2, 3) and not _ambiguous(c) for c in signs], bool)[which]
    of_word = _scripts_of_words(cp, row, script, sure)
    further = np.array([c in FURTHER_AS_LATIN for c in signs], bool)[which]
    change = np.flatnonzero((of_word != script) & (script < _BREAK) & ((script > 0) & (of_word > 0) | further & (of_word == _LATIN)))
    if len(change):
        pairs, at = np.unique(cp[change].astype(np.int64) * 8 + of_word[change], return_inverse=True)
        cp = cp.copy()
        cp[change] = np.array([ord(_as_script(chr(x >> 3), int(x & 7))) for x in pairs.tolist()], np.uint32)[at]
    text = cp.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    ends = np.searchsorted(row, np.arange(len(texts)), "right")
    starts = np.r_[0, ends[:-1]]
    return [unicodedata.normalize("NFC", text[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]


def suspect(text: str) -> bool:
    """Whether a text may have to be changed; what is not suspect is in its consistent form already."""
    if text.isascii():
        return False
    return bool(ALWAYS.search(text) or ((OTHER.search(text) or FURTHER.search(text)) and LATIN.search(text))) or not unicodedata.is_normalized("NFC", text)


def consistent(texts: list[str | None]) -> list[str | None]:
    """Each text in its consistent form; null stays null, the empty text stays empty."""
    out = list(texts)
    at = [i for i, t in enumerate(texts) if t and suspect(t)]
    if at:
        for i, t in zip(at, _rebuild([texts[i] for i in at])):
            out[i] = t
    return out


_NO_LETTERS = re.compile(r"[\W\d_]+")


@cache
def _numbers() -> re.Pattern:
    """Numbers and marks that ``\\w`` takes in and ``\\d`` does not."""
    return re.compile("[" + "".join(re.escape(c) for o in range(0x80, 0x20000) if (c := chr(o)).isalnum() and unicodedata.category(c)[0] != "L") + "]+")


def letters(text: str) -> str:
    """The letters (category L) of a text in order, regardless of case."""
    text = _NO_LETTERS.sub("", text)
    return (text if text.isalpha() else _numbers().sub("", text)).casefold()


WORD = re.compile(r"[^\W_]+")
