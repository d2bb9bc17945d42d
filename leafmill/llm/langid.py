"""The language of a text from unigram pieces, marginalised over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary; characters outside the vocabulary fall
back to their bytes. A forward algorithm sums the probability of a word over all its segmentations into pieces, for all
languages at once; pieces never reach over a word, so a text's score is the sum of its words' and each worker scores a
word once. The probabilities are fitted by expectation-maximisation to labelled rows of each language.

Beside the languages stands a background that knows none: pieces by their rank in the vocabulary. What it explains better
than every language is of a language that the labels don't know, and comes out as ``und``.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import cache, lru_cache
from itertools import repeat

import numpy as np

#: The labelled rows that a language must have at least.
LEAST_ROWS = 5
#: Expected counts of pieces are summed in whole steps of this share, so that no order of words changes a sum.
STEP = 1 << 30
UNKNOWN = "und"
#: By so many nats the background must explain a part better than a language does.
DOUBT = 6.0
#: So many nats a record's own label counts for: labels are right far more often than they name one wrong language.
TRUST = 4.0
#: The share of the background in each language.
FOREIGN = 1e-5
VOCABULARY = "piece_bpe_32k.model"
#: A segment may hold another language than its text only if it is likelier by so many nats.
MARGIN = 12.0
MIN_LETTERS = 25
#: Words of so many letters and more are summed in logarithms, as their products would be too small for a number.
_LONG, _FLOOR = 30, 1e-9

# ISO 639-1 code, ISO 639-2 codes, English name.
LANGUAGES = """
ar ara arabic; bg bul bulgarian; bn ben bengali; ca cat catalan; cs ces cze czech; da dan danish; de deu ger german; el ell gre greek;
en eng english; es spa spanish; et est estonian; fa fas per persian; fi fin finnish; fr fra fre french; he heb hebrew; hi hin hindi;
hr hrv croatian; hu hun hungarian; id ind indonesian; is isl ice icelandic; it ita italian; ja jpn japanese; ko kor korean;
lt lit lithuanian; lv lav latvian; ms msa may malay; nl nld dut dutch; no nor nob norwegian; pl pol polish; pt por portuguese;
ro ron rum romanian; ru rus russian; sk slk slo slovak; sl slv slovenian; sr srp serbian; sv swe swedish; th tha thai; tr tur turkish;
uk ukr ukrainian; ur urd urdu; vi vie vietnamese; zh zho chi chinese
"""
NAMES = {name: entry.split()[0] for entry in LANGUAGES.split(";") for name in entry.split()}

WORDS = re.compile(r"[぀-ヿ]+|[㐀-鿿]+|[^\W\d_]+")
#: What stands between texts that are searched as one; no word holds it, and neither white space nor case goes over it.
_BETWEEN = "\0"
_WORDS_OF_ALL = re.compile(f"{_BETWEEN}|{WORDS.pattern}")
_SYLLABLES = re.compile("[぀-ヿ㐀-鿿]")
_ASCII_WORDS = bytes(c if chr(c).isalpha() or chr(c) == _BETWEEN else 32 for c in range(128)) + bytes(128)
#: Where a sentence may end, for segments of one language.
_ENDS = re.compile(r"[.!?؟।](?=[\s\"”»“)])\s*|[。！？]|\n+")
_MAY_END = np.isin(np.arange(0x110000), [*map(ord, ".!?؟।。！？\n")])
_NO_LETTERS = re.compile(r"[\W\d_]+")
_NO_ASCII_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())
_DOUBLE = re.compile(r"[぀-鿿가-힣]")


@cache
def language_of_label(label: str | None) -> str | None:
    """The ISO 639-1 code that a label names in any notation; null if it names no language."""
    if not label:
        return None
    return NAMES.get(re.split(r"[-_\s(;,]", label.strip().lower(), maxsplit=1)[0])


def weight(text: str) -> int:
    """The letters of a text; those of scripts whose letters stand for whole syllables or words count twice."""
    return n_letters(text) + (0 if text.isascii() else len(_DOUBLE.findall(_letters(text))))


def n_letters(text: str) -> int:
    if text.isascii():
        return len(text.encode().translate(None, _NO_ASCII_LETTERS))
    return len(_letters(text))


@lru_cache(20_000)
def _letters(text: str) -> str:
    return _NO_LETTERS.sub("", text)


@cache
def _kinds() -> np.ndarray:
    """What each code point counts in ``weight``."""
    every = "".join(map(chr, range(0x110000)))
    out = np.ones(len(every), np.int8)
    for m in _DOUBLE.finditer(every):
        out[m.start()] = 2
    for m in _NO_LETTERS.finditer(every):
        out[m.start() : m.end()] = 0
    return out


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def sums_of_letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each text begins in all of them, and ``n_letters`` and ``weight`` of what stands before each character of these and at the end."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    kinds = _kinds()[_code_points("".join(texts))]
    out = np.zeros((2, len(kinds) + 1), np.int64)
    np.cumsum(kinds > 0, out=out[0, 1:])
    np.cumsum(kinds, out=out[1, 1:])
    return np.cumsum(size) - size, out[0], out[1]


def _alike(texts: list[str]) -> list[list[int]]:
    """Numbers of texts that are ASCII, of others without scripts whose words have their own pattern, and of the rest."""
    out: list[list[int]] = [[], [], []]
    for i, t in enumerate(texts):
        out[0 if t.isascii() else 2 if _SYLLABLES.search(t) else 1].append(i)
    return [at for at in out if at]


def _words_of_all(texts: list[str]) -> list[str]:
    """The words of each text in lower case, with ``_BETWEEN`` between texts, which are one group of ``_alike``."""
    joined = _BETWEEN.join(texts)
    if joined.count(_BETWEEN) >= max(1, len(texts)):
        joined = _BETWEEN.join([t.replace(_BETWEEN, " ") for t in texts])
    joined = joined.lower()
    if joined.isascii():
        words = joined.encode().translate(_ASCII_WORDS).decode()
    elif _SYLLABLES.search(joined):
        return _WORDS_OF_ALL.findall(joined)
    else:
        at = _code_points(joined)
        words = np.where((_kinds()[at] > 0) | (at == ord(_BETWEEN)), at, 32).astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    return words.replace(_BETWEEN, f" {_BETWEEN} ").split()


def vocabulary(path: str | None = None) -> dict[str, int]:
    """The pieces of the public vocabulary, regardless of case, with their ranks."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    sp = sentencepiece.SentencePieceProcessor(model_file=str(path))
    out: dict[str, int] = {}
    for i in range(sp.get_piece_size()):
        if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)):
            out.setdefault(sp.id_to_piece(i).lower(), i)
    return out


def _lattice(words: list[str], ids: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges of all words: start node, end node, end position in the word, and four piece ids (0: none)."""
    rows: list[tuple] = []
    node, longest = 0, max(map(len, ids), default=1)
    for word in words:
        text = "▁" + word
        n = len(text)
        for a in range(n):
            single = False
            for b in range(a + 1, min(n, a + longest) + 1):
                piece = text[a:b]
                i = ids.get(piece)
                if i is not None:
                    rows.append((node + a, node + b, b, i, 0, 0, 0))
                    single |= b == a + 1
            if not single:
                data = text[a].encode("utf-8", "surrogatepass")
                rows.append((node + a, node + a + 1, a + 1, *(1 + x for x in data), *[0] * (4 - len(data))))
        node += n + 1
    e = np.array(rows, np.int64).reshape(-1, 7)
    e = e[np.argsort(e[:, 2], kind="stable")]
    return e[:, 0], e[:, 1], e[:, 2], e[:, 3:]


def _nodes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(w) + 2 for w in words], np.int64)
    first = np.cumsum(size) - size
    return first, first + size - 1


def _pass(at: np.ndarray, to: np.ndarray, level: np.ndarray, w: np.ndarray, begin: np.ndarray, n: int, back: bool, logs: bool = False) -> np.ndarray:
    """Sums over all segmentations up to (or, backwards, from) each node, for every language; with ``logs`` all in logarithms."""
    sums = np.full((n, w.shape[1]), -np.inf if logs else 0.0)
    sums[begin] = 0.0 if logs else 1.0
    bounds = np.searchsorted(level, np.arange(1, int(level.max()) + 2)) if len(level) else np.zeros(1, int)
    steps = list(zip(bounds, bounds[1:]))
    for a, b in reversed(steps) if back else steps:
        src, dst = (to[a:b], at[a:b]) if back else (at[a:b], to[a:b])
        order = np.argsort(dst, kind="stable")
        dst = dst[order]
        if not len(dst):
            continue
        cut = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]])
        if logs:
            sums[dst[cut]] = np.logaddexp(sums[dst[cut]], np.logaddexp.reduceat(sums[src[order]] + w[a:b][order], cut))
        else:
            sums[dst[cut]] += np.add.reduceat(sums[src[order]] * w[a:b][order], cut)
    return sums


def words_of_texts(texts: list[str]) -> list[str]:
    """The words of each text in lower case, with a space between them."""
    out = [""] * len(texts)
    for at in _alike(texts):
        for i, words in zip(at, " ".join(_words_of_all([texts[i] for i in at])).split(_BETWEEN)):
            out[i] = words.strip(" ")
    return out


@dataclass
class Languages:
    """The fitted model: ids of pieces, log-probabilities [piece, language]; the last language is the background."""

    codes: list[str]
    ids: dict[str, int]
    logp: np.ndarray
    rows: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None

    def _score(self, words: list[str]) -> np.ndarray:
        """log P(word | language), summed over all segmentations."""
        out = np.empty((len(words), self.logp.shape[1]))
        for logs in (False, True):
            rows = [i for i, w in enumerate(words) if (len(w) >= _LONG) == logs]
            if not rows:
                continue
            some = [words[i] for i in rows]
            at, to, level, ids = _lattice(some, self.ids)
            w = self.logp[ids].sum(1)
            begin, end = _nodes(some)
            alpha = _pass(at, to, level, w if logs else np.exp(w), begin, int(end[-1]) + 1, False, logs)[end]
            out[rows] = alpha if logs else np.log(np.maximum(alpha, 1e-300))
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        """[text, language] log-likelihoods, the background's last; a text without letters has zeros."""
        if not self.codes:
            return np.zeros((len(texts), 2))
        out = np.zeros((len(texts), len(self.codes) + 1))
        for at in _alike(texts):
            out[at] = self.scores_of_words(_words_of_all([texts[i] for i in at]))
        return out

    def scores_of_words(self, words: list[str]) -> np.ndarray:
        """As ``scores`` for the words of texts, with ``_BETWEEN`` between these."""
        if len(self.rows) > 300_000:
            self.rows.clear()
            self.table = None
        row = np.fromiter(map(self.rows.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(row < 0)
        new = dict.fromkeys(words[i] for i in missing.tolist())
        new.pop(_BETWEEN, None)
        new = list(new)
        for k in range(0, len(new), 5_000):
            part = new[k : k + 5_000]
            made = self._score(part)
            base = 0 if self.table is None else len(self.rows)
            if self.table is None or base + len(part) > len(self.table):
                grown = np.zeros((max(8_192, 2 * (base + len(part))), len(self.codes) + 1))
                if self.table is not None:
                    grown[:base] = self.table[:base]
                self.table = grown
            self.table[base : base + len(part)] = made
            self.rows.update((w, base + i) for i, w in enumerate(part))
        row[missing] = np.fromiter((self.rows.get(words[i], -1) for i in missing.tolist()), np.int64, len(missing))
        cut = np.flatnonzero(row < 0)
        ends = np.r_[cut - np.arange(len(cut)), len(row) - len(cut)]
        size = np.diff(ends, prepend=0)
        out = np.zeros((len(size), len(self.codes) + 1))
        some = np.flatnonzero(size)
        if len(some):
            out[some] = np.add.reduceat(self.table[row[row >= 0]], (ends - size)[some])
        return out

    def classify(self, texts: list[str], labels: list[str | None] | None = None) -> list[list[tuple[int, int, str, float]]]:
        """For each text its parts of one language: start, end, language and confidence. A text without letters has none.

        ``labels`` are codes that the texts' records name, if any; they decide where the text leaves doubt.
        """
        if not self.codes:
            return [[] for _ in texts]
        if not texts:
            return []
        first, begins, ends = _parts_of_all(texts)
        count = np.diff(first, append=len(begins))
        flat = [texts[i][a:b] for i, a, b in zip(np.repeat(np.arange(len(texts)), count).tolist(), begins, ends)]
        found = self.scores(flat)
        some = np.logical_or.reduceat(found.any(1), first).tolist()
        found[:, -1] -= DOUBT
        names = [*self.codes, UNKNOWN]
        column = {c: i for i, c in enumerate(self.codes)}
        hint = np.array([column.get(x, -1) for x in labels or [None] * len(texts)])
        totals = np.add.reduceat(found, first)
        own_label = np.flatnonzero(hint >= 0)
        totals[own_label, hint[own_label]] += TRUST
        mains = totals.argmax(1)
        sure_of = (1.0 / np.exp(np.minimum(totals - totals.max(1, keepdims=True), 0.0)).sum(1)).tolist()
        whole = ((count == 1) | np.logical_and.reduceat(found.argmax(1) == np.repeat(mains, count), first)).tolist()
        out = []
        for j, (t, k, n, main) in enumerate(zip(texts, first.tolist(), count.tolist(), mains.tolist())):
            if not some[j]:
                out.append([])
                continue
            if whole[j]:
                out.append([(0, len(t), names[main], sure_of[j])])
                continue
            s, x = found[k : k + n], list(zip(begins[k : k + n], ends[k : k + n]))
            # a text of several languages may be called by none of them: the largest group of sure parts gives the main one
            own = s.argmax(1)
            sure = s[np.arange(n), own] - np.partition(s, -2, 1)[:, -2] >= MARGIN
            if sure.any() and not (sure & (own == main)).any():
                main = int(np.bincount(own[sure], weights=[b - a for (a, b), y in zip(x, sure) if y]).argmax())
            kind = np.where(sure & (s[np.arange(n), own] - s[:, main] >= MARGIN), own, main)
            made: list[tuple[int, int, str, float]] = []
            start = 0
            for i in range(1, n + 1):
                if i == n or kind[i] != kind[start]:
                    of = s[start:i].sum(0)
                    made.append((0 if start == 0 else x[start][0], len(t) if i == n else x[i][0], names[kind[start]], _confidence(of, int(kind[start]))))
                    start = i
            out.append(made)
        return out


def _confidence(scores: np.ndarray, k: int) -> float:
    return float(1.0 / np.exp(np.minimum(scores - scores[k], 20.0)).sum())


def _parts(text: str) -> list[tuple[int, int]]:
    _, begins, ends = _parts_of_all([text])
    return list(zip(begins, ends))


def _parts_of_all(texts: list[str]) -> tuple[np.ndarray, list[int], list[int]]:
    """The number of each text's first part, and where all parts begin and end in their texts."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    start = np.cumsum(size + 1) - size - 1
    joined, found = _BETWEEN.join(texts), [0]
    for i in np.flatnonzero(_MAY_END[_code_points(joined)]).tolist():
        if i >= found[-1] and (m := _ENDS.match(joined, i)):
            found.append(m.end())
    at = np.array(found[1:], np.int64)
    of = np.searchsorted(start, at, "right") - 1
    kept = at - start[of] < size[of]
    at, of = at[kept], of[kept]
    count = np.bincount(of, minlength=len(texts)) + 1
    first = np.cumsum(count) - count
    begins = np.zeros(int(count.sum()), np.int64)
    begins[np.arange(len(at)) + of + 1] = at - start[of]
    ends = np.r_[begins[1:], 0]
    ends[first + count - 1] = size
    return first, begins.tolist(), ends.tolist()


def _background(size: int, ranks: list[int]) -> np.ndarray:
    """Probabilities that know no language: of pieces by their rank, of bytes alike."""
    p = np.empty(size)
    p[0], p[1:257] = 1.0, 0.05 / 256
    p[257:] = 1.0 / (np.array(ranks) + 50.0)
    p[257:] *= 0.95 / p[257:].sum()
    return p


def _expected(words: list[str], counts: np.ndarray, ids: dict[str, int], logs: bool) -> Callable[[np.ndarray], np.ndarray]:
    """A function from piece probabilities to expected counts of pieces over all segmentations; ``counts`` is [word, language]."""
    at, to, level, edges = _lattice(words, ids)
    begin, end = _nodes(words)
    n = int(end[-1]) + 1
    word_of = np.searchsorted(begin, at, "right") - 1

    def run(p: np.ndarray) -> np.ndarray:
        w = np.log(p)[edges].sum(1) if logs else p[edges].prod(1)
        alpha, beta = _pass(at, to, level, w, begin, n, False, logs), _pass(at, to, level, w, end, n, True, logs)
        if logs:
            gamma = np.exp(alpha[at] + w + beta[to] - alpha[end][word_of]) * counts[word_of]
        else:
            gamma = alpha[at] * w * beta[to] / np.maximum(alpha[end], 1e-300)[word_of] * counts[word_of]
        got = np.zeros(p.shape)
        for k in range(4):
            some = slice(None) if not k else np.flatnonzero(edges[:, k])  # 0 stands for no piece
            np.add.at(got, edges[some, k], gamma[some])
        return got

    return run


def expected(words: list[str], counts: np.ndarray, ids: dict[str, int]) -> Callable[[np.ndarray], np.ndarray]:
    """As ``_expected`` for words of any length."""
    parts = []
    for logs in (False, True):
        if rows := [i for i, w in enumerate(words) if (len(w) >= _LONG) == logs]:
            parts.append(_expected([words[i] for i in rows], counts[rows], ids, logs))
    return lambda p: sum(part(p) for part in parts)


def ids_of(pieces: dict[str, int]) -> dict[str, int]:
    return {p: 257 + i for i, p in enumerate(pieces)}


def maximised(codes: list[str], expect: Callable[[np.ndarray], np.ndarray], pieces: dict[str, int], rounds: int = 4) -> Languages:
    """Expectation-maximisation of the piece probabilities; ``expect`` gives the expected counts of pieces [piece, language]."""
    ids, size = ids_of(pieces), 257 + len(pieces)
    p = np.full((size, len(codes)), 1.0 / size)
    p[0] = 1.0
    for _ in range(rounds):
        got = expect(p)
        got[0] = 0
        used = got.any(1)
        shared = got.sum(1, keepdims=True) / max(1.0, got.sum())
        p = (got + 2.0 * shared) / (got.sum(0) + 2.0) * (1 - size * _FLOOR) + _FLOOR
        p[0] = 1.0
    # a piece that no word of the sample holds is the background's; of it each language has a little for foreign words
    used[:257] = True
    p[~used] = 0.0
    background = _background(size, list(pieces.values()))
    logp = np.log(np.column_stack([p + FOREIGN * background[:, None], background]))
    logp[0] = 0.0  # stands for no piece
    return Languages(codes, ids, logp)


def fit(rows: Iterable[tuple[str | None, str | None]], path: str | None = None) -> Languages:
    """Fit to rows of text and label. Labels may be wrong now and then: the second round takes another where the first one is sure of it.

    A language must have LEAST_ROWS rows. Without labelled rows the model knows no language, and all texts
    come out without one.
    """
    # texts of equal words, such as lines repeated on many pages, count once, with the label that most of them have
    by_words: dict[tuple[str, ...], Counter] = {}
    for text, label in rows:
        if text and (code := language_of_label(label)) and (found := WORDS.findall(text.lower())):
            by_words.setdefault(tuple(found), Counter())[code] += 1
    size = Counter()
    for of in by_words.values():
        size.update(of)
    texts = [" ".join(x) for x in by_words]
    labels: list[str | None] = [min(of, key=lambda c: (-of[c], c)) for of in by_words.values()]
    codes = [c for c, n in size.items() if n >= LEAST_ROWS]
    labels = [c if c in codes else None for c in labels]
    pieces = vocabulary(path)
    model = Languages([], {}, np.zeros((257, 1)))
    for _ in range(2):
        codes = sorted(set(filter(None, labels)))
        by = {c: Counter() for c in codes}
        for text, label in zip(texts, labels):
            if label:
                by[label].update(text.split(" "))
        words = sorted({w for x in by.values() for w in x})
        if not words:
            return Languages([], {}, np.zeros((257, 1)))
        counts = np.array([[x.get(w, 0) for x in by.values()] for w in words], float)
        model = maximised(codes, expected(words, counts, ids_of(pieces)), pieces)
        labels = relabelled(model, texts, labels)
    return model


def relabelled(model: Languages, texts: list[str], labels: list[str | None]) -> list[str]:
    """The labels, or what the model is sure of where a text has none or another one. Texts are words with a space between them."""
    if not texts:
        return []
    best = model.scores_of_words(f" {_BETWEEN} ".join(texts).split(" "))[:, :-1]
    column = {c: i for i, c in enumerate(model.codes)}
    own = best[np.arange(len(texts)), [column[c] if c else 0 for c in labels]]
    return [c if c and s[i] - o < MARGIN else model.codes[i] for c, s, i, o in zip(labels, best, best.argmax(1), own)]


def dumps(model: Languages) -> bytes:
    model.rows.clear()
    model.table = None
    return pickle.dumps(model)
