"""Text that was decoded with the wrong character encoding.

A hidden Markov model labels the characters of a token: one clean state and one state per pair (encoding of the bytes,
encoding they were read with). A state emits a character given the one before it. The clean state is fitted to the
stored texts; the others to what their pair makes of the same texts. The most likely path gives the spans, and each
span gets its state's inverse.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cache

import numpy as np

from .chars import INVISIBLE, LATIN, OTHER, SPACES, consistent

# Pairs (encoding of the bytes, encoding they were read with).
PAIRS = [
    ("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1250"), ("utf-8", "cp1251"), ("utf-8", "cp1256"), ("utf-8", "cp437"), ("utf-8", "cp850"), ("utf-8", "cp866"),
    ("utf-8", "koi8-r"), ("utf-8", "mac_roman"), ("utf-8", "gb18030"), ("utf-8", "cp932"), ("utf-8", "cp949"), ("utf-8", "big5"), ("utf-8", "ascii"), ("utf-8", "iso8859-2"),
    ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("cp1252", "cp1250"), ("cp1252", "utf-8"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("mac_roman", "latin-1"),
    ("cp437", "latin-1"), ("cp850", "latin-1"), ("cp1250", "cp1252"), ("cp1250", "latin-1"), ("cp1250", "utf-8"), ("iso8859-2", "cp1252"), ("iso8859-2", "cp1250"), ("cp1250", "iso8859-2"), ("cp852", "cp1252"), ("cp852", "cp1250"),
    ("cp1251", "cp1252"), ("cp1251", "latin-1"), ("cp1251", "koi8-r"), ("cp1251", "cp866"), ("cp1251", "mac_roman"), ("cp1251", "utf-8"), ("koi8-r", "cp1251"), ("koi8-r", "cp1252"), ("koi8-r", "latin-1"), ("cp866", "cp1251"), ("cp866", "cp1252"),
    ("cp1256", "cp1252"), ("cp1256", "latin-1"), ("iso8859-6", "latin-1"), ("cp1256", "utf-8"), ("gbk", "cp1252"), ("gbk", "latin-1"), ("gbk", "utf-8"), ("gbk", "mac_roman"), ("big5", "cp1252"),
    ("cp932", "cp1252"), ("cp932", "latin-1"), ("cp932", "mac_roman"), ("cp932", "utf-8"), ("cp932", "gbk"), ("euc_jp", "cp1252"), ("euc_jp", "latin-1"), ("euc_jp", "gbk"), ("euc_jp", "utf-8"),
    ("cp949", "cp1252"), ("cp949", "latin-1"), ("cp949", "mac_roman"), ("cp949", "gbk"), ("cp949", "utf-8"),
]
#: Each pair alone, and what is written as UTF-8 and misread twice.
STEPS = [(p,) for p in PAIRS] + [(("utf-8", a), ("utf-8", a)) for a in ("cp1252", "latin-1", "cp437", "cp1251", "cp1250", "mac_roman", "cp850")]

#: Tokens are counted by so many rows of blocks, and a third as many font names: of larger tables a token counts as often as it stands in so many rows on average.
UNIT_ROWS = 20_000
#: Weights of pairs of characters are summed in whole steps of this share, so that no order of rows changes a sum.
STEP = 1 << 30
#: Rounds in which the model is fitted to what the one before calls clean.
ROUNDS = 1
_CLEAN = 0
#: Bits of the characters of a key of two.
_BITS = 21
_FLOOR = math.log(1e-7)
_ENTER, _LEAVE, _SWITCH = math.log(2e-3), math.log(0.05), math.log(1e-5)
_MULTI = {"gb18030", "gbk", "cp932", "cp949", "big5", "euc_jp", "utf-8"}
_SINGLE_HOLES = {"cp1252", "cp1250", "cp1251", "cp1256"}


_PREFIX = re.compile(r"^[A-Z]{6}\+")
_PARTS = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e、。]+")
_UNSEEN = re.compile(f"[{INVISIBLE}{SPACES}]").match
_BETTER = 2.0
_HIDDEN = math.log(2e-3)


def _to_bytes(text: str, read_as: str, lossy: bool = False) -> bytes | None:
    """The bytes that were read as ``text``; where a code page has no character, the byte's own code point stands for it."""
    try:
        return text.encode(read_as)
    except UnicodeEncodeError:
        if read_as not in _SINGLE_HOLES:
            return None
    out = bytearray()
    for ch in text:
        try:
            out += ch.encode(read_as)
        except UnicodeEncodeError:
            if not 0x80 <= ord(ch) < 0xA0:
                return None
            out.append(ord(ch))
    return bytes(out)


def _from_bytes(data: bytes, read_as: str) -> str:
    if read_as in _SINGLE_HOLES:
        try:
            return data.decode(read_as)
        except UnicodeDecodeError:
            return "".join(bytes([b]).decode(read_as, "ignore") or chr(b) for b in data)
    return data.decode(read_as, "replace")


def garble(text: str, steps: tuple) -> str | None:
    """What the pairs make of a text; null where the text has no such bytes."""
    for true, read_as in steps:
        try:
            text = _from_bytes(text.encode(true), read_as)
        except UnicodeEncodeError:
            return None
    return text


#: States whose bytes are read one by one, so that each character is garbled by itself, and the others; the clean one is neither.
_ALONE = [k + 1 for k, steps in enumerate(STEPS) if not any(read_as in _MULTI for _, read_as in steps)]
_WHOLE = [k + 1 for k, steps in enumerate(STEPS) if any(read_as in _MULTI for _, read_as in steps)]
#: Of each encoding of the bytes, a bit of the states that read them one by one.
_BIT_OF = {STEPS[k - 1][0][0]: i + 1 for i, k in enumerate(_ALONE)}
assert len(_ALONE) < 62 and all(len(STEPS[k - 1]) == 1 and STEPS[k - 1][0][0] in _BIT_OF for k in _WHOLE)
#: The states of each encoding that text may have been read with last.
_READ = list(dict.fromkeys(steps[-1][1] for steps in STEPS))
_BY_READ = {read_as: [steps for steps in STEPS if steps[-1][1] == read_as] for read_as in _READ}


@cache
def _alone(ch: str) -> tuple[int, int]:
    """Bits of what garbles a character by itself: where it can be written, and where it changes."""
    made = changed = 0
    for i, k in enumerate(_ALONE):
        if (out := garble(ch, STEPS[k - 1])) is not None:
            made |= 2 << i
            changed |= (out != ch) << (i + 1)
    return made, changed


@cache
def _read(ch: str) -> int:
    """Bits of the encodings that a character may have been read with."""
    return sum(1 << i for i, read_as in enumerate(_READ) if _to_bytes(ch, read_as) is not None)


def restore(text: str, steps: tuple) -> str | None:
    """The inverse of ``garble``; null where the stored characters don't determine the text."""
    if "\ufffd" in text:
        return None
    for true, read_as in reversed(steps):
        data = _to_bytes(text, read_as)
        if data is None:
            return None
        try:
            text = data.decode(true)
        except UnicodeDecodeError:
            return None
    return text


def inverses(text: str) -> set[str]:
    """All that ``restore`` makes of a text, without the text itself."""
    out: set[str] = set()
    if "\ufffd" in text:
        return out
    bits, tried = -1, set()
    for ch in set(text):
        bits &= _read(ch)
    for i, read_as in enumerate(_READ):
        if bits >> i & 1:
            data = _to_bytes(text, read_as)
            for steps in _BY_READ[read_as]:
                if len(steps) == 1:  # other encodings may give the same bytes
                    if (data, steps[0][0]) in tried:
                        continue
                    tried.add((data, steps[0][0]))
                try:
                    made = data.decode(steps[-1][0])
                except UnicodeDecodeError:
                    continue
                if len(steps) == 1 or (made := restore(made, steps[:-1])) is not None:
                    out.add(made)
    out.discard(text)
    return out


def tokens(text: str) -> list[str]:
    """What is labelled by itself: a font name without its subset prefix, or what stands between spaces."""
    if text[6:7] == "+":
        text = _PREFIX.sub("", text)
    return text.replace("\n", " ").split(" ")


def _bigrams(token: str) -> Iterable[tuple[str, str]]:
    return zip("\x02" + token, token)


@dataclass
class Garble:
    """The fitted model. ``rare``: log-probabilities of single characters by state; ``pairs``: of a character after another one."""

    steps: list[tuple]
    rare: dict[str, np.ndarray]
    pairs: dict[tuple[str, str], tuple[np.ndarray, np.ndarray]]
    floor: np.ndarray
    gain: dict[tuple[str, str], float] = field(default_factory=dict)
    seen: dict[str, list[tuple[int, int, int]]] = field(default_factory=dict)
    clean: set[str] = field(default_factory=set)
    emitted: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        """Without what is cached, and with a few large arrays in place of many small ones."""
        keys = [ord(a) << _BITS | ord(b) for a, b in self.pairs]
        size = [len(x) for x, _ in self.pairs.values()]
        states, logs = (np.concatenate([x[i] for x in self.pairs.values()] or [np.zeros(0, t)]) for i, t in ((0, np.int16), (1, float)))
        rare = np.array(list(self.rare.values())).reshape(len(self.rare), len(self.floor))
        return {"steps": self.steps, "floor": self.floor, "letters": list(self.rare), "rare": rare, "pairs": (np.repeat(keys, size).astype(np.int64), states, logs)}

    def __setstate__(self, of: dict) -> None:
        self.__init__(of["steps"], dict(zip(of["letters"], of["rare"])), _by_pair(*of["pairs"]), of["floor"])

    def _emit(self, a: str, b: str) -> np.ndarray:
        """Log-probabilities of a character after another one by state, which nobody may change."""
        if (out := self.emitted.get((a, b))) is None:
            if len(self.emitted) >= 20_000:
                self.emitted.clear()
            out = self.emitted[a, b] = self._made_of(a, b)
        return out

    def _made_of(self, a: str, b: str) -> np.ndarray:
        out = self.rare.get(b, self.floor).copy()
        if (found := self.pairs.get((a, b))) is not None:
            out[found[0]] = found[1]
        # an invisible character or a special space may stand anywhere in clean text, and a word may begin behind it
        if _UNSEEN(b):
            out[_CLEAN] = max(out[_CLEAN], _HIDDEN)
        elif _UNSEEN(a):
            out[_CLEAN] = max(out[_CLEAN], self.rare.get(b, self.floor)[_CLEAN] - math.log(0.02))
        return out

    def _gain(self, a: str, b: str) -> float:
        """By how much the best garbled state is better than the clean one."""
        if (g := self.gain.get((a, b))) is None:
            e = self._emit(a, b)
            if len(self.gain) > 2_000_000:
                self.gain.clear()
            g = self.gain[(a, b)] = float(e[1:].max() - e[_CLEAN])
        return g

    def spans(self, token: str) -> list[tuple[int, int, int]]:
        """(start, end, state) of each garbled span of the most likely path."""
        if token.isascii():
            return []
        if (found := self.seen.get(token)) is not None:
            return found
        found = [y for a, b in self._stretches(token) for x in self._viterbi(token, a, b) if (y := self._checked(token, *x))]
        if found and "\ufffd" not in token and (form := consistent([token])[0]) != token and bool(LATIN.search(form)) != bool(OTHER.search(form)) and not self.spans(form):
            found = []  # look-alike letters in a word of one script
        if len(self.seen) > 300_000:
            self.seen.clear()
        self.seen[token] = found
        return found

    def _stretches(self, token: str) -> list[tuple[int, int]]:
        """Where garbled spans of the most likely path can stand; each stretch is labelled by itself, however long the token.

        Where all gains since some start have been lost again, a path that comes from before is no better than one that
        begins behind; and a stretch whose gains never reach what it costs to enter a garbled state holds no span.
        """
        out, start, total, most = [], 0, 0.0, 0.0
        known = self.gain
        for t, ab in enumerate(_bigrams(token)):
            total += g if (g := known.get(ab)) is not None else self._gain(*ab)
            if total <= 0:
                if most >= -_ENTER:
                    out.append((start, t))
                start, total, most = t + 1, 0.0, 0.0
            elif total > most:
                most = total
        if most >= -_ENTER:
            out.append((start, len(token)))
        return out

    def _viterbi(self, token: str, first: int, end: int) -> list[tuple[int, int, int]]:
        k, size = len(self.floor), end - first
        enter = _ENTER - math.log(k - 1)
        score = np.full(k, enter)
        score[_CLEAN] = 0.0
        back = np.empty((size, k), np.int16)
        own = np.arange(k)
        before = token[first - 1] if first else "\x02"
        for t, (a, b) in enumerate(zip(before + token[first : end - 1], token[first:end])):
            if t:
                best = int(score[1:].argmax()) + 1
                other = max(score[_CLEAN] + enter, score[best] + _SWITCH)
                come = own.copy()
                worse = score < other
                come[worse] = _CLEAN if score[_CLEAN] + enter >= score[best] + _SWITCH else best
                new = np.maximum(score, other)
                leave = score[best] + _LEAVE
                if leave > score[_CLEAN]:
                    come[_CLEAN], new[_CLEAN] = best, leave
                else:
                    come[_CLEAN], new[_CLEAN] = _CLEAN, score[_CLEAN]
                score = new
                back[t] = come
            score = score + self._emit(a, b)
        state = int(score.argmax())
        path = [state]
        for t in range(size - 1, 0, -1):
            state = int(back[t][state])
            path.append(state)
        path.reverse()
        out, start = [], 0
        for t in range(1, len(path) + 1):
            if t == len(path) or path[t] != path[start]:
                if path[start] != _CLEAN and not token[first + start : first + t].isascii():
                    out.append((first + start, first + t, path[start]))
                start = t
        return out

    def _checked(self, token: str, a: int, b: int, state: int) -> tuple[int, int, int] | None:
        """An exact check: the span, with one character more at either side, is what a pair makes of some other text.

        Where the path's own pair can't have made it, the likeliest pair that can takes its place. What a reader of
        several bytes a character has dropped can't be checked; a long span of that kind stays.
        """
        if "\ufffd" in token or self._made(token, a, b, state):
            return a, b, state
        if b - a >= 6 and self.steps[state][0][1] in _MULTI:
            return a, b, state
        sums = sum(self._emit(x, y) for x, y in zip((token[a - 1] if a else "\x02") + token[a : b - 1], token[a:b]))
        for s in sums.argsort()[::-1]:
            if s == _CLEAN or sums[s] < sums[_CLEAN] - _ENTER:
                return None
            if self._made(token, a, b, s):
                return a, b, int(s)
        return None

    def _made(self, token: str, a: int, b: int, state: int) -> bool:
        """Whether the pair makes the span of a text that is likelier as clean text than the span itself."""
        for x, y in self._around(token, a, b):
            t = restore(token[x:y], self.steps[state])
            if t is not None and t != token[x:y]:  # only what stands there and the character behind it count differently
                before, behind = token[x - 1] if x else "\x02", token[y : y + 1]
                if self._clean(before, t + behind) > self._clean(before, token[x:y] + behind) + _BETTER:
                    return True
        return False

    def _clean(self, before: str, text: str) -> float:
        return sum(float(self._emit(x, y)[_CLEAN]) for x, y in zip(before + text, text))

    @staticmethod
    def _around(token: str, a: int, b: int) -> tuple:
        # ASCII bytes beside a span may belong to it
        return (a, b), (max(0, a - 1), b), (a, min(len(token), b + 1)), (0, len(token))

    def is_garbled(self, text: str | None) -> bool:
        if not text or text.isascii():
            return False
        if "�" in text:
            return True
        found = tokens(text)
        if self.clean.issuperset(found):
            return False
        if any(self.spans(t) for t in found if not t.isascii()):
            return True
        if len(text) <= 2_000:  # so that no long tokens are kept
            if len(self.clean) > 300_000:
                self.clean.clear()
            self.clean.update(found)
        return False

    def restored(self, text: str) -> tuple[str, bool]:
        """The text with each garbled span undone, and whether all of them could be."""
        if not self.is_garbled(text):
            return text, True
        for steps in {self.steps[s] for t in tokens(text) for _, _, s in self.spans(t)}:  # a whole text of one pair
            whole = restore(text, steps)
            if whole is not None and not self.is_garbled(whole):
                return whole, True
        out, whole = [], True
        for line in text.split("\n"):
            words = []
            for token in line.split(" "):
                done = list(token)
                for a, b, s in reversed(self.spans(token)):
                    inverse = None
                    for x, y in self._around(token, a, b):
                        if (inverse := restore(token[x:y], self.steps[s])) is not None:
                            done[x:y] = [inverse]
                            break
                    whole &= inverse is not None
                words.append("".join(done))
            out.append(" ".join(words))
        text = "\n".join(out)
        return text, whole and "�" not in text

    def readable(self, text: str) -> str:
        """The restored text without the tokens that stay garbled; all of it where nothing else has a letter."""
        text, whole = self.restored(text)
        if whole:
            return text
        kept = "\n".join(" ".join(t for t in line.split(" ") if "\ufffd" not in t and not self.spans(t)) for line in text.split("\n"))
        return kept if any(map(str.isalpha, kept)) else text


def rarer(token: str, n: float) -> list[tuple[str, float]]:
    """A token in capitals, which texts have more rarely."""
    return [] if token.isascii() else [(form, max(min(1.0, n), n // 20)) for form in {token.upper(), token[:1].upper() + token[1:]} - {token}]


def _coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of texts that aren't empty, each with a 2 before it; where these stand; and lengths."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer("".join(["\x02" + t for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return flat, np.cumsum(size + 1) - size - 1, size


def _keys(flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Pairs of characters, one after another, as numbers."""
    inside = np.ones(len(flat), bool)
    inside[first] = False
    at = np.flatnonzero(inside)
    return flat[at - 1] << _BITS | flat[at]


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in their order, and the sums of ``n``."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[cut], np.add.reduceat(n[order], cut)


def pairs_of(words: list[str], n: Iterable[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of characters of different tokens, as numbers, and how often they stand there, in steps."""
    flat, first, size = _coded(words)
    return _summed(_keys(flat, first), np.repeat(np.fromiter(n, np.int64, len(words)), size))


def pair(key: int) -> tuple[str, str]:
    return chr(key >> _BITS), chr(key & (1 << _BITS) - 1)


def emissions(words: list[str], n: Iterable[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How often states make each pair of characters of different tokens that count as clean, in steps.

    The first array has the state, as a negative number; or bits, where what is counted is the pair before it is garbled
    by the states of ``_ALONE`` that they name (bit 0: the clean state), which ``spread`` does.
    """
    weights = np.minimum(np.fromiter(n, np.int64, len(words)), 50 * STEP)
    flat, first, size = _coded(words)
    if not len(words):
        return flat, flat, flat
    own, at = np.unique(flat, return_inverse=True)
    bits = np.array([_alone(chr(c)) for c in own.tolist()], np.int64)[at]
    made = np.bitwise_and.reduceat(bits[:, 0], first)  # the 2 before each token is written everywhere and never changes
    kinds, kind = np.unique(made & np.bitwise_or.reduceat(bits[:, 1], first) | 1, return_inverse=True)
    keys, sums = _summed(np.repeat(kind, size) << 2 * _BITS | _keys(flat, first), np.repeat(weights, size))
    out = [(kinds[keys >> 2 * _BITS], keys & (1 << 2 * _BITS) - 1, sums)]
    other = [i for i, t in enumerate(words) if not t.isascii()]  # no pair changes ASCII
    for s in _WHOLE:
        true = STEPS[s - 1][0][0]
        found = [(t, i) for i in other if made[i] >> _BIT_OF[true] & 1 and (t := garble(words[i], STEPS[s - 1])) != words[i]]
        flat, first, size = _coded([t for t, _ in found])
        keys, sums = _summed(_keys(flat, first), np.repeat(weights[[i for _, i in found]], size))
        kept = keys & (1 << _BITS) - 1 != 2
        out.append((np.full(int(kept.sum()), -s), keys[kept], sums[kept]))
    return tuple(np.concatenate(x) for x in zip(*out))


def spread(of: np.ndarray, keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """State, pair of characters and sum, ordered and each once, of what ``emissions`` gives in any order and number."""
    out = []
    for i, s in [(0, _CLEAN), *((i + 1, s) for i, s in enumerate(_ALONE))]:
        some = np.flatnonzero((of > 0) & (of >> i & 1 > 0))
        of_state, sums = _summed(keys[some], n[some])
        if s:
            of_state, sums = _garbled_pairs(of_state, sums, STEPS[s - 1])
        out.append((np.full(len(of_state), s), of_state, sums))
    for s in _WHOLE:
        some = np.flatnonzero(of == -s)
        of_state, sums = _summed(keys[some], n[some])
        out.append((np.full(len(of_state), s), of_state, sums))
    states, pairs, sums = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((pairs, states))
    return states[order], pairs[order], sums[order]


def _garbled_pairs(keys: np.ndarray, n: np.ndarray, steps: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that stand where a pair's second character is garbled, behind what its first one becomes."""
    before, behind = keys >> _BITS, keys & (1 << _BITS) - 1
    made, sums = [], []
    last = {c: ord(garble(chr(c), steps)[-1]) for c in np.unique(before).tolist()}
    known, at = np.unique(behind, return_inverse=True)
    texts = [garble(chr(c), steps) for c in known.tolist()]
    longest = max(map(len, texts), default=0)
    codes = np.array([[*map(ord, t), *[-1] * (longest - len(t))] for t in texts], np.int64).reshape(len(texts), longest)[at]
    a = np.array([last[c] for c in before.tolist()], np.int64)
    for k in range(longest):
        b = codes[:, k]
        some = (b >= 0) & (b != 2)
        made.append(a[some] << _BITS | b[some])
        sums.append(n[some])
        a = np.where(b >= 0, b, a)
    return _summed(np.concatenate(made), np.concatenate(sums)) if made else (keys, n)


def from_emissions(of: np.ndarray, keys: np.ndarray, n: np.ndarray) -> Garble:
    """The model of what ``emissions`` gives, in any order."""
    k = len(STEPS) + 1
    states, keys, sums = spread(of, keys, n)
    weights = sums / STEP
    # sums of a state's second characters, and of its first ones
    behind, at_behind = np.unique(states << _BITS | keys & (1 << _BITS) - 1, return_inverse=True)
    single = np.bincount(at_behind, weights, len(behind))
    _, at_before = np.unique(states << _BITS | keys >> _BITS, return_inverse=True)
    before = np.bincount(at_before, weights)
    total = np.bincount(states, weights, k) + 1
    floor = np.full(k, _FLOOR)
    rare: dict[str, np.ndarray] = {}
    for x, p in zip(behind.tolist(), np.maximum(_FLOOR, np.log(0.02 * single / total[behind >> _BITS])).tolist()):
        if (found := rare.get(b := chr(x & (1 << _BITS) - 1))) is None:
            found = rare[b] = floor.copy()
        found[x >> _BITS] = p
    logs = np.log(0.98 * weights / (before[at_before] + 0.5) + 0.02 * single[at_behind] / total[states])
    for b in rare:
        if "\x7f" <= b < "\xa0" or b == "�":
            rare[b][_CLEAN] = 2 * _FLOOR
    order = np.argsort(keys, kind="stable")
    return Garble([(), *STEPS], rare, _by_pair(keys[order], states[order].astype(np.int16), logs[order]), floor)


def _by_pair(keys: np.ndarray, states: np.ndarray, logs: np.ndarray) -> dict[tuple[str, str], tuple[np.ndarray, np.ndarray]]:
    """States and log-probabilities of each pair; ``keys`` are ordered."""
    cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return {pair(x): (states[a:b], logs[a:b]) for x, a, b in zip(keys[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(keys)])}


def _fit_states(clean: Counter) -> Garble:
    """Emissions of all states from tokens that count as clean, and from these in capitals."""
    more: Counter = Counter()
    for token, n in clean.items():
        for form, m in rarer(token, n):
            more[form] += m
    every = clean + more
    return from_emissions(*emissions(list(every), (round(n * STEP) for n in every.values())))


class Improving:
    """What the inverse of some pair turns into more usual text, by how often each pair of characters stands in all tokens."""

    def __init__(self, usual: dict[tuple[str, str], float]):
        self.usual = {ab: math.log1p(n) for ab, n in usual.items()}

    def _score(self, part: str, whole: bool) -> float:
        found = list(_bigrams(part))[0 if whole or len(part) == 1 else 1 :]
        return sum(self.usual.get(ab, 0.0) for ab in found) / max(1, len(found))

    def _mean(self, found: set) -> float:
        return sum(self.usual.get(ab, 0.0) for ab in sorted(found)) / len(found)

    def decided(self, token: str) -> bool | list[tuple[str, str]]:
        """Whether a token is improved; where this is left to counts, what they must be compared of (part and inverse)."""
        if token.isascii():
            return False
        if any("\x7f" <= c < "\xa0" or c == "�" for c in token):
            return True
        usual, open_ = self.usual, []
        for part in {token, *_PARTS.findall(token)}:
            if part.isascii():
                continue
            whole, own, before = part == token, None, None
            for inverse in inverses(part):
                if len(part) < 3:
                    open_.append((part, inverse))
                    continue
                pairs = list(_bigrams(inverse))
                new = len(pairs) - 1 - sum(map(usual.__contains__, pairs[1:]))
                if not new and pairs[0] in usual:  # no other text is a token
                    open_.append((part, inverse))
                if new <= 0.1 * (len(pairs) - 1):
                    own = self._score(part, whole) if own is None else own
                    if self._score(inverse, whole) > own + 1.0:
                        return True
                # a few characters in a long token: only the bigrams that change
                if new and "\x02" not in inverse:
                    continue
                before = set(_bigrams(part)) if before is None else before
                won = set(pairs) - before
                if won and all(ab in usual for ab in won) and (lost := before - set(pairs)) and self._mean(won) > self._mean(lost) + 3.0:
                    return True
        return open_

    @staticmethod
    def by_counts(part: str, of_part: float, of_inverse: float, n: float) -> bool:
        """Whether counts decide for the inverse; of a short part there is little evidence, only what is far more usual counts."""
        return of_inverse >= 10 * of_part if len(part) < 3 else of_inverse > n


def _seed(count: Counter) -> Counter:
    """Tokens without those that the inverse of some pair turns into more usual text."""
    keys, sums = pairs_of(list(count), (round(n * STEP) for n in count.values()))
    improving = Improving({pair(x): n / STEP for x, n in zip(keys.tolist(), sums.tolist())})
    out = Counter()
    for token, n in count.items():
        found = improving.decided(token)
        if found is not True and not any(improving.by_counts(part, count[part], count[inverse], n) for part, inverse in found or []):
            out[token] = n
    return out


def fit(texts: Iterable[str | None]) -> Garble:
    """Fit the model to stored texts: first to tokens that no inverse improves, then to those it calls clean, and again."""
    count: Counter = Counter()
    for text in texts:
        if text:
            count.update(tokens(text))
    count = Counter({t: n for t, n in count.items() if t})
    model = _fit_states(_seed(count))
    for _ in range(ROUNDS):
        model = _fit_states(Counter({t: n for t, n in count.items() if not model.is_garbled(t)}))
    return model


def counted(n_blocks: int, n_fonts: int, blocks: int, fonts: int) -> float:
    """How often a token counts that stands so often in tables of ``blocks`` and ``fonts`` rows."""
    return n_blocks * min(1.0, UNIT_ROWS / max(1, blocks)) + n_fonts * min(1.0, UNIT_ROWS // 3 / max(1, fonts))


def dumps(model: Garble) -> bytes:
    return pickle.dumps(model)
