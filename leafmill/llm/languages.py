"""Languages of blocks, runs and PDFs as Spark operators (the model is in ``langid``)."""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from . import langid
from .batches import map_columns, sample_of_each
from .chars import consistent
from .encoding import loaded, share, stored

#: A task keeps what it found of so many texts of so many characters at most, for those that are there again.
_KNOWN, _SHORT = 100_000, 200
#: What rows of sums begin with among those of texts; no word holds it.
_ALL = "\0"
_PLACES = "starts array<int>, ends array<int>, confidence array<double>"


def name_of_label(label: Column) -> Column:
    """What a label begins with, in the notation of ``langid.NAMES``."""
    marks = "\t\n\r-_(;,"
    return F.substring_index(F.ltrim(F.translate(F.lower(label), marks, " " * len(marks))), " ", 1)


def fit_languages(df: DataFrame, text: str = "text", label: str = "language", by: tuple[str, ...] = ("doc_id", "page_no", "block_idx"), vocabulary: str | None = None, rows: int | None = None) -> bytes:
    """The model, fitted to all labelled rows; with ``rows`` to at most so many of each language."""

    def fit() -> bytes:
        if rows is None:
            return langid.dumps(_fitted(df.select(F.col(text).alias("text"), F.col(label).alias("label")), vocabulary))
        return langid.dumps(langid.fit(sample_of_each(df, text, name_of_label(F.col(label)), langid.NAMES, list(by), rows), vocabulary))

    return stored([df], f"languages-{text}-{label}-{rows or 'all'}", fit)


def _fitted(df: DataFrame, vocabulary: str | None) -> langid.Languages:
    """``langid.fit`` for a table of any size; only sums of pieces by language come to the driver."""
    none, parts = langid.Languages([], {}, np.zeros((257, 1))), df.sparkSession.sparkContext.defaultParallelism

    every = sorted(set(langid.NAMES.values()))
    number = {c: i for i, c in enumerate(every)}

    def words_of(texts, labels):
        found = Counter(zip(langid.words_of_texts(texts), (number.get(langid.language_of_label(x), -1) for x in labels)))
        found = Counter({x: n for x, n in found.items() if x[0] and x[1] >= 0})
        for (_, i), n in list(found.items()):
            found[_ALL + every[i], i] += n
        return [x for x, _ in found], [i for _, i in found], list(found.values())

    # texts of equal words count once, with the label that most of them have (ties: the first code); beside them stand the sums of all rows by label
    rows = map_columns(df.where(F.col("text").isNotNull() & F.col("label").isNotNull()), lambda: words_of, "words string, number bigint, n bigint")
    each = rows.repartition("words").groupBy("words", "number").agg(F.sum("n").alias("n"))
    best = F.max(F.col("n") * len(every) + (len(every) - 1 - F.col("number"))).alias("best")
    texts = staged(each.groupBy("words").agg(best), "labelled")
    size = texts.where(F.col("words").startswith(_ALL)).collect()
    codes = [r.words.removeprefix(_ALL) for r in size if r.best // len(every) >= langid.LEAST_ROWS]
    code = F.element_at(F.array(*map(F.lit, every)), (len(every) - F.col("best") % len(every)).cast("int"))
    texts = texts.where(~F.col("words").startswith(_ALL)).select("words", F.when(code.isin(codes), code).alias("code"))
    pieces = langid.vocabulary(vocabulary)
    ids = share(df.sparkSession, pickle.dumps(langid.ids_of(pieces)))
    model = None
    for _ in range(2):
        shared = share(df.sparkSession, langid.dumps(model)) if model else None
        counted = map_columns(texts, lambda shared=shared: _counting(shared), "word string, code string, n bigint")
        if not model:
            codes = sorted(r.code for r in texts.where("code is not null").select("code").distinct().collect())
        sums = [F.sum(F.when(F.col("code") == c, F.col("n")).otherwise(0)).alias(f"n{i}") for i, c in enumerate(codes)]
        if not sums:
            return none
        words = staged(counted.repartition(parts, "word").groupBy("word").agg(*sums).sortWithinPartitions("word"), "words")
        if model:  # a language that all texts lose is none
            left = words.agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(len(codes)))).first()
            kept = [i for i, n in enumerate(left) if n]
            codes, words = [codes[i] for i in kept], words.select("word", *(f"n{i}" for i in kept))
        model = langid.maximised(codes, _expecting(words, ids, 257 + len(pieces), len(codes)), pieces)
    return model


def _counting(shared):
    """Words of texts by the label of each, which a model may change."""
    model = loaded(shared) if shared else None

    def run(texts, codes):
        by: dict[str, Counter] = {}
        for text, c in zip(texts, langid.relabelled(model, texts, codes) if model else codes):
            if c:
                by.setdefault(c, Counter()).update(text.split(" "))
        return [w for x in by.values() for w in x], [c for c, x in by.items() for _ in x], [n for x in by.values() for n in x.values()]

    return run


def _expecting(words: DataFrame, ids, size: int, n_codes: int):
    """From piece probabilities to expected counts over all words, summed in Spark."""

    def expect(p: np.ndarray) -> np.ndarray:
        shared = share(words.sparkSession, pickle.dumps(p))

        def make():
            of, now = loaded(ids), loaded(shared)

            def run(some, *counts):
                got = np.ceil(langid.expected(some, np.array(counts, float).T, of)(now) * langid.STEP).astype(np.int64).ravel()
                at = np.flatnonzero(got)
                return at, got[at]

            return run

        made = map_columns(words, make, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(size * n_codes)
        out[made["at"].to_numpy()] = made["n"].to_numpy() / langid.STEP
        return out.reshape(size, n_codes)

    return expect


def identified(
    df: DataFrame, keys: list[str], model: bytes, garble: bytes | None = None, text: str = "text", label: str = "language", places: bool = True, cases: bool = False
) -> DataFrame:
    """For each row its parts of one language: codes and letters; the weight of all letters (as stored) and what its label names.

    With ``places`` also where the parts stand (code points of the text in consistent form) and how sure they are. With
    ``cases`` only the rows whose label is missing or wrong, or that hold several languages. Rows whose text is null or
    without letters come out with no parts. With ``garble``, the language of a garbled text (and the places) is that of
    its readable form, and its weight is 0, so that it is no case. Records are not made unique.
    """
    spark = df.sparkSession
    shared, other = share(spark, model), share(spark, garble) if garble else None
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", langs array<string>, letters array<int>, weight int, label string" + (", " + _PLACES if places else "")

    def make():
        m, g = loaded(shared), loaded(other) if other else None
        known: dict[tuple[str | None, str | None], tuple] = {}

        def run(*columns):
            *own, texts, labels = columns
            named = [langid.language_of_label(x) for x in labels]
            found = _once(known, list(zip(texts, named)), lambda new: _of_texts(m, g, new))
            if cases:
                at = [i for i, (x, label) in enumerate(zip(found, named)) if x[2] >= langid.MIN_LETTERS and x[0] and (x[0][0] != label or len(x[0]) > 1)]
                own, found, named = [c.take(pa.array(at, pa.int64())) for c in own], [found[i] for i in at], [named[i] for i in at]
            out = list(zip(*found)) if found else [()] * 6
            return (*own, *out[:3], named, *(out[3:] if places else ()))

        return run

    return map_columns(df.select(*keys, text, label), make, schema, len(keys))


def _once(known: dict, records: list[tuple[str | None, str | None]], find: Callable[[list], list[tuple]]) -> list[tuple]:
    """What ``find`` gives for each record, which it is asked once for those that are there again; ``known`` keeps what it said."""
    if len(known) > _KNOWN:
        known.clear()
    new = [x for x in dict.fromkeys(records) if x not in known]
    made = dict(zip(new, find(new)))
    known.update((x, y) for x, y in made.items() if len(x[0] or "") <= _SHORT)
    return [made.get(x) or known[x] for x in records]


def _of_texts(model: langid.Languages, garble, records: list[tuple[str | None, str | None]]) -> list[tuple]:
    """Of texts and the codes of their labels: codes and letters of the parts, weight, and where the parts stand."""
    stored = ["" if t is None else t for t, _ in records]
    bad = [bool(garble) and garble.is_garbled(t) for t in stored]
    texts = consistent([garble.readable(t) if b else t for t, b in zip(stored, bad)])
    parts = model.classify(texts, [label for _, label in records])
    first, letters, weights = langid.sums_of_letters(texts)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    out = []
    for text, whole, b, k, n, weight, p in zip(texts, stored, bad, first.tolist(), *((x[first + size] - x[first]).tolist() for x in (letters, weights)), parts):
        weight = 0 if b else weight if text is whole else langid.weight(whole)
        if len(p) == 1:
            ((start, end, lang, sure),) = p
            out.append(((lang,), (n,), weight, (start,), (end,), (sure,)))
        else:
            starts, ends, langs, sure = zip(*p) if p else ((), (), (), ())
            out.append((langs, tuple(int(letters[k + y] - letters[k + x]) for x, y in zip(starts, ends)), weight, starts, ends, sure))
    return out


def mislabelled(found: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each language of the records whose label is missing or wrong, or that hold several languages; unknown ones are none."""
    langs = F.array_remove(F.array_distinct("langs"), langid.UNKNOWN)
    wrong = (F.size(langs) > 1) | ((F.size(langs) == 1) & ~F.col("label").eqNullSafe(F.element_at(langs, 1)))
    return found.where((F.col("weight") >= langid.MIN_LETTERS) & wrong).select(*keys, F.explode(langs).alias("lang")).distinct()


def of_documents(found: DataFrame) -> DataFrame:
    """``doc_id`` and the language of most letters in its blocks (ties: the first code), with its share of them; unknown languages only where there is no other.

    ``found`` has a row for each block; blocks that are there twice count once.
    """
    each = found.repartition("doc_id").groupBy("doc_id", "page_no", "block_idx").agg(F.first(F.arrays_zip("langs", "letters")).alias("parts"))
    sums = each.select("doc_id", F.explode("parts").alias("p")).groupBy("doc_id", F.col("p.langs").alias("lang")).agg(F.sum("p.letters").alias("n"))
    unknown = (F.col("lang") == langid.UNKNOWN).alias("unknown")
    best = sums.groupBy("doc_id").agg(F.min(F.struct(unknown, (-F.col("n")).alias("n"), "lang")).alias("best"), F.sum("n").alias("all"))
    return best.select("doc_id", F.col("best.lang").alias("lang"), (-F.col("best.n") / F.col("all")).alias("confidence"))


def named(df: DataFrame, key: str, column: str = "language") -> DataFrame:
    """``key`` and ``label``: the code that the label of ``column`` names, or null."""
    kind = dict(df.dtypes)[key]
    return map_columns(df.select(key, column), lambda: lambda k, x: (k, [langid.language_of_label(v) for v in x]), f"`{key}` {kind}, label string")
