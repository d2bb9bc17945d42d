"""Passages of held-out items inside the documents of a corpus.

Items and documents are words; a window of as many words as make a leak is embedded by random walks (CGK: a step writes
the word it stands on and moves on or not by a random bit of that word), which turns edits into a bounded Hamming
distance. Sampled positions of the walks are the keys of several tables; a document's window that shares a key with an
item's is a candidate, and candidates are verified by the exact edit distance of the item's window to what begins at the
document's word, however long. Windows with equal words share all keys.

Of windows that are within some edits, one run of words at least is equal: with e edits, one of e + 1 equal parts. Windows
of a document without such a run of any item are not embedded, which loses none.

The items are a stated query set. They go to the executors in blocks of a bounded number of windows; documents are read
once, and never shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_columns
from .chars import WORD, consistent

#: Words in a window; edits (of words) that a candidate may have; walks, and sampled positions a key.
WORDS, EDITS, WALKS, SAMPLED = 13, 2, 12, 4
#: Wanted recall for windows whose embeddings differ in this many of the positions.
RECALL, HAMMING = 0.95, 12
#: Bound on the item windows of a block (a window takes about 0.5 kB).
BLOCK_WINDOWS = 200_000
#: Steps of a walk for each word of a window; later ones mostly stand behind its end and tell nothing.
STEPS = 2
SEED = 29


def tables() -> int:
    """Tables that reach the wanted recall."""
    same = (1 - HAMMING / (STEPS * WORDS)) ** SAMPLED
    each = math.ceil(math.log(1 - RECALL) / math.log(1 - same) / WALKS)
    return each * WALKS


def words_of(texts: list[str | None]) -> list[list[str]]:
    """The words of each text: unbroken runs of letters or digits in consistent form, regardless of case."""
    return [WORD.findall(t.casefold()) if t else [] for t in consistent(texts)]


def _id(word: str) -> int:
    """A word's number, the same in every block."""
    return xxhash.xxh64_intdigest(word) >> 2 | 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def keys_of(windows: np.ndarray) -> np.ndarray:
    """[window, table] keys of windows of word ids."""
    n, size = windows.shape
    rng = np.random.default_rng(SEED)
    per = tables() // WALKS
    out = np.zeros((n, tables()), np.uint64)
    padded = np.hstack([windows, np.zeros((n, 1), windows.dtype)]).astype(np.uint64)
    rows = np.arange(n)
    for w in range(WALKS):
        at = np.zeros(n, np.int64)
        sampled = [set(rng.choice(STEPS * size, SAMPLED, replace=False).tolist()) for _ in range(per)]
        salts = rng.integers(1, 2**63, 3 * size, dtype=np.int64).astype(np.uint64)
        for j in range(STEPS * size):
            here = padded[rows, at]
            mixed = _mixed(here + salts[j])
            for t in range(per):
                if j in sampled[t]:
                    out[:, w * per + t] = _mixed(out[:, w * per + t] + mixed)
            at = np.minimum(at + (mixed >> np.uint64(40) & np.uint64(1)).astype(np.int64), size)
    return out


@dataclass
class Items:
    """A block of items: distinct windows of word ids, the items of each, the sorted keys of each table, and all runs of each length."""

    windows: np.ndarray
    owners: list[list[int]]
    keys: list[np.ndarray]
    where: list[np.ndarray]
    runs: dict[int, np.ndarray]


def items_of(rows: list[tuple[int, str | None]]) -> Items:
    of: dict[tuple[int, ...], list[int]] = {}
    for (item, _), words in zip(rows, words_of([t for _, t in rows])):
        ids = [_id(w) for w in words]
        for k in range(len(ids) - WORDS + 1):
            owners = of.setdefault(tuple(ids[k : k + WORDS]), [])
            if not owners or owners[-1] != item:
                owners.append(item)
    windows = np.array(list(of), np.int64).reshape(-1, WORDS)
    keys = keys_of(windows)
    order = [np.argsort(keys[:, t], kind="stable") for t in range(keys.shape[1])]
    runs = {n: np.unique(_runs(windows.ravel(), n).reshape(-1, WORDS)[:, : WORDS - n + 1]) for n in {WORDS // (e + 1) for e in range(WORDS)}}
    return Items(windows, list(of.values()), [keys[o, t] for t, o in enumerate(order)], order, runs)


def _runs(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` words from each place on; runs that reach over the end are of no use."""
    out = np.zeros(len(ids), np.uint64)
    for k in range(n):
        out[: len(ids) - k] = out[: len(ids) - k] * np.uint64(0x9E3779B97F4A7C15) + ids[k:].astype(np.uint64)
    return _mixed(out)


def edits(a: np.ndarray, b: np.ndarray, most: int = WORDS) -> np.ndarray:
    """Least edit distances of windows ``a`` to the first words of ``b``, however many; those beyond ``most`` are some number beyond it."""
    n, size = a.shape
    far = most + 1
    wide = b.shape[1]
    before = np.tile(np.minimum(np.arange(wide + 1), far), (n, 1))
    for i in range(1, size + 1):
        now = np.full_like(before, far)
        now[:, 0] = min(i, far)
        for j in range(max(1, i - most), min(wide, i + most) + 1):
            now[:, j] = np.minimum(np.minimum(before[:, j], now[:, j - 1]) + 1, before[:, j - 1] + (a[:, i - 1] != b[:, j - 1]))
        before = now
    return before[:, max(0, size - most) :].min(1)


def verified(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """As ``edits``, but pairs that have too few equal words at near places are not worked out."""
    n, size = a.shape
    there = np.zeros((n, size), bool)
    for by in range(-most, most + 1):
        low, high = max(0, -by), min(size, b.shape[1] - by)
        there[:, low:high] |= a[:, low:high] == b[:, low + by : high + by]
    out = np.full(n, most + 1)
    at = np.flatnonzero(there.sum(1) >= size - most)
    if len(at):
        out[at] = edits(a[at], b[at], most)
    return out


def _pairs(found: Items, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct candidates: row of ``windows``, row of the items' windows."""
    keys = keys_of(windows)
    n = np.int64(len(found.windows))
    seen = np.zeros(len(windows) * n, bool)
    for t, (own, order) in enumerate(zip(found.keys, found.where)):
        a, b = np.searchsorted(own, keys[:, t], "left"), np.searchsorted(own, keys[:, t], "right")
        each = b - a
        left = np.repeat(np.arange(len(windows)), each)
        right = order[np.repeat(a, each) + np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)]
        seen[left * n + right] = True
    both = np.flatnonzero(seen)
    return both // n, both % n


def leaked(found: list[Items], texts: list[str | None], most_edits: int = EDITS) -> list[tuple[int, int, int, int]]:
    """(place of the text, item, least edits, first word) of each text that holds a window of an item."""
    words = words_of(texts)
    size = np.array([len(w) for w in words], np.int64)
    flat = [w for x in words for w in x]
    number = {w: _id(w) for w in set(flat)}
    ids = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    if len(ids) < WORDS:
        return []
    # a window has most_edits words more than an item's, or what the text still has
    long = WORDS + most_edits
    text = np.r_[np.repeat(np.arange(len(words)), size), np.full(long, -1)]
    ids = np.r_[ids, np.zeros(long, np.int64)]
    first_word = np.cumsum(size) - size
    least = WORDS // (most_edits + 1)
    hashed = _runs(ids, least)
    n = len(ids) - long
    whole = text[:n] == text[WORDS - most_edits - 1 : n + WORDS - most_edits - 1]
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for block in found:
        if not len(block.windows):
            continue
        runs = block.runs[least]
        hits = np.cumsum(np.r_[0, runs[np.minimum(np.searchsorted(runs, hashed), len(runs) - 1)] == hashed])
        step = max(64, min(4_000, 64_000_000 // len(block.windows)))
        at = np.flatnonzero(whole & (hits[long - least + 1 :][:n] > hits[:n]))
        for k in range(0, len(at), step):
            start = at[k : k + step]
            where = start[:, None] + np.arange(long)
            every = np.where(text[where] == text[start][:, None], ids[where], 0)
            windows, which = np.unique(every, axis=0, return_inverse=True)
            places = np.argsort(which.ravel(), kind="stable")
            bounds = np.searchsorted(which.ravel()[places], np.arange(len(windows) + 1))
            left, right = _pairs(block, windows[:, :WORDS])
            for c in range(0, len(left), 200_000):
                a, b = left[c : c + 200_000], right[c : c + 200_000]
                distance = verified(block.windows[b], windows[a], most_edits)
                for i in np.flatnonzero(distance <= most_edits):
                    for place in start[places[bounds[a[i]] : bounds[a[i] + 1]]]:
                        for item in block.owners[b[i]]:
                            case, now = (int(text[place]), item), (int(distance[i]), int(place - first_word[text[place]]))
                            if case not in best or now < best[case]:
                                best[case] = now
    return [(t, item, d, w) for (t, item), (d, w) in best.items()]


def blocks(items: DataFrame, key: str, text: str) -> list[Items]:
    """The items in blocks of a bounded number of windows; an item stands in one block."""
    out, rows, n = [], [], 0
    for item, passage in items.where(F.col(text).isNotNull()).select(key, text).distinct().orderBy(key, text).toLocalIterator():
        rows.append((item, passage))
        n += max(0, len(passage) // 2)
        if n > BLOCK_WINDOWS:
            out.append(items_of(rows))
            rows, n = [], 0
    return [*out, items_of(rows)] if rows or not out else out


def find(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", passage: str = "passage", most_edits: int = EDITS) -> DataFrame:
    """``doc_key``, ``item_key``, ``least_edits`` and ``first_word`` of every document that holds a window of an item's passage.

    Texts and passages that are null or shorter than a window have no leaks. A passage that several items share is
    reported for each of them. Repeated documents are reported once by their key, with their least edits.
    """
    kinds = dict(documents.dtypes) | {"item": dict(items.dtypes)[item_key]}
    schema = f"`{doc_key}` {kinds[doc_key]}, `{item_key}` {kinds['item']}, least_edits int, first_word int"
    shared = [documents.sparkSession.sparkContext.broadcast(block) for block in blocks(items, item_key, passage)]

    def make():
        def run(keys, texts):
            found = leaked([x.value for x in shared], texts, most_edits)
            return [keys[t] for t, *_ in found], [x[1] for x in found], [x[2] for x in found], [x[3] for x in found]

        return run

    made = map_columns(documents.where(F.col(text).isNotNull()).select(doc_key, text), make, schema)
    best = made.groupBy(doc_key, item_key).agg(F.min(F.struct("least_edits", "first_word")).alias("b"))
    return best.select(doc_key, item_key, "b.least_edits", "b.first_word")
