"""Find and restore wrongly decoded text (the model is in ``garble``)."""

from __future__ import annotations

import gc
import pickle
from collections import Counter
from collections.abc import Callable
from itertools import chain

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staged
from . import garble
from .batches import NOT_ASCII, map_columns
from .chars import consistent

#: The models that a worker used last, with what they have cached.
_models: dict[int, object] = {}


def stored(frames: list[DataFrame], what: str, fit: Callable[[], bytes]) -> bytes:
    """The model that ``fit`` gives. Where ``spark.leafmill.models`` names a shared folder, it is kept there and fitted once for the files of ``frames``."""
    spark = frames[0].sparkSession
    folder = spark.conf.get("spark.leafmill.models", None)
    files = sorted(f for df in frames for f in df.inputFiles())
    if not folder or not files:
        return fit()
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{what}-{xxhash.xxh64_hexdigest(chr(10).join(files))}.model")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path):
        return bytes(spark.read.format("binaryFile").load(path.toString()).first()["content"])
    model = fit()
    out = fs.create(path, True)
    out.write(bytearray(model))
    out.close()
    return model


def fit_garble(blocks: DataFrame, fragments: DataFrame) -> bytes:
    """The model, fitted to all block texts and font names (rows without any label)."""
    return stored([blocks, fragments], "garble", lambda: garble.dumps(_fitted(_tokens(blocks, fragments))))


def _tokens(blocks: DataFrame, fragments: DataFrame) -> DataFrame:
    """Each token of the texts once, with how often it counts, in steps of ``garble.STEP``."""

    def each(df: DataFrame, column: str, name: str) -> DataFrame:
        def run(texts, rows):
            if rows.count(1) == len(rows):
                count = Counter(chain.from_iterable(map(garble.tokens, texts)))
            else:
                count = Counter()
                for text, n in zip(texts, rows):
                    for token in garble.tokens(text):
                        count[token] += n
            count.pop("", None)
            return list(count), list(count.values())

        texts = df.where(F.col(column).isNotNull())
        some = texts.groupBy(column).agg(F.count("*").alias("rows")) if name == "fonts" else texts.select(column, F.lit(1).alias("rows"))
        return map_columns(some, lambda: run, f"token string, {name} bigint")

    found = each(blocks, "text", "blocks").unionByName(each(fragments, "font_name", "fonts"), allowMissingColumns=True)
    spark, n_blocks, n_fonts = blocks.sparkSession, blocks.count(), fragments.count()
    summed = found.groupBy("token").agg(F.sum("blocks").alias("blocks"), F.sum("fonts").alias("fonts")).fillna(0)

    def steps(tokens, of_blocks, of_fonts):
        return tokens, [round(garble.counted(a, b, n_blocks, n_fonts) * garble.STEP) for a, b in zip(of_blocks, of_fonts)]

    spread = summed.repartition(spark.sparkContext.defaultParallelism, "token")
    return staged(map_columns(spread, lambda: steps, "token string, n bigint"), "tokens")


def _fitted(tokens: DataFrame) -> garble.Garble:
    """``garble.fit`` for a table of tokens; only pairs of characters and their sums come to the driver."""
    usual = share(tokens.sparkSession, pickle.dumps(garble.Improving(_pairs(tokens))))

    def undecided():
        improving = loaded(usual)

        def run(words, counts):
            found = [improving.decided(t) for t in words]
            at = [i for i, x in enumerate(found) if x is not True]
            asked = [[{"part": a, "inverse": b} for a, b in sorted(set(found[i] or []))] for i in at]
            return [words[i] for i in at], [counts[i] for i in at], asked

        return run

    kept = staged(map_columns(tokens, undecided, "token string, n bigint, asked array<struct<part: string, inverse: string>>"), "undecided")
    asked = kept.select("token", "n", F.explode("asked").alias("a")).select("token", "n", "a.part", "a.inverse")
    of_part, of_inverse = (tokens.select(F.col("token").alias(x), F.col("n").alias(f"of_{x}")) for x in ("part", "inverse"))
    # what counts decide, as garble.Improving.by_counts
    long = asked.where(F.length("part") >= 3).join(of_inverse, "inverse").where(F.col("of_inverse") > F.col("n"))
    short = asked.where(F.length("part") < 3).join(of_inverse, "inverse", "left").join(of_part, "part", "left").fillna(0, ["of_inverse", "of_part"])
    improved = long.select("token").unionByName(short.where(F.col("of_inverse") >= 10 * F.col("of_part")).select("token")).distinct()
    model = _states(kept.select("token", "n").join(improved, "token", "left_anti"))
    for _ in range(garble.ROUNDS):
        shared = share(tokens.sparkSession, garble.dumps(model))

        def clean(shared=shared):
            m = loaded(shared)

            def run(words, counts):
                at = [i for i, t in enumerate(words) if not m.is_garbled(t)]
                return [words[i] for i in at], [counts[i] for i in at]

            return run

        model = _states(map_columns(tokens, clean, "token string, n bigint"))
    return model


def _pairs(tokens: DataFrame) -> dict[tuple[str, str], float]:
    made = map_columns(tokens, lambda: garble.pairs_of, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    return {garble.pair(x): n / garble.STEP for x, n in zip(*(c.to_pylist() for c in made.toArrow().columns))}


def _states(clean: DataFrame) -> garble.Garble:
    """The model of tokens that count as clean, and of these in capitals."""

    def forms(words, counts):
        found = [(t, n) for t, n in zip(words, counts)] + [(f, round(m * garble.STEP)) for t, n in zip(words, counts) for f, m in garble.rarer(t, n / garble.STEP)]
        return [t for t, _ in found], [n for _, n in found]

    parts = clean.sparkSession.sparkContext.defaultParallelism
    every = map_columns(clean, lambda: forms, "token string, n bigint").repartition(parts, "token").groupBy("token").agg(F.sum("n").alias("n"))
    made = map_columns(every, lambda: garble.emissions, "of bigint, pair bigint, n bigint").groupBy("of", "pair").agg(F.sum("n").alias("n"))
    return garble.from_emissions(*(c.to_numpy() for c in made.toArrow().columns))


def loaded(shared: _Shared):
    """The model of a broadcast variable, once a worker."""
    if shared.id not in _models:
        while len(_models) > 1:
            del _models[next(iter(_models))]
        _models[shared.id] = pickle.loads(shared.value)
        gc.freeze()  # a model holds many small objects, which collections need not walk
    return _models[shared.id]


def share(spark: SparkSession, model: bytes):
    """The model as a broadcast variable; its size is that of the pairs of characters that are seen."""
    return _Shared(spark.sparkContext.broadcast(model), xxhash.xxh64_intdigest(model))


class _Shared:
    def __init__(self, broadcast, id):
        self.broadcast, self.id = broadcast, id

    @property
    def value(self):
        return self.broadcast.value


def garbled(df: DataFrame, text: str, keys: list[str], model: bytes, restore: bool = False) -> DataFrame:
    """The rows whose ``text`` is garbled at least in part: ``keys``, and with ``restore`` the column's value before and after.

    Null, empty and ASCII texts are never garbled. A record that is there twice comes out once (by ``keys``). Other
    columns are ignored. ``restored`` is null where the stored characters don't determine the intended text.
    """
    shared = share(df.sparkSession, model)
    picked = df.where(F.col(text).rlike(NOT_ASCII)).select(*keys, text)
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + (", stored string, restored string" if restore else "")

    def make():
        m = loaded(shared)

        def run(*columns):
            *own, texts = columns
            at = [i for i, t in enumerate(texts) if m.is_garbled(t)]
            out = [[c[i] for i in at] for c in own]
            if restore:
                made = [m.restored(texts[i]) for i in at]
                out += [[texts[i] for i in at], [t if ok else None for t, ok in made]]
            return tuple(out)

        return run

    return map_columns(picked, make, schema).dropDuplicates(keys)


def look_alikes(df: DataFrame, text: str, keys: list[str], model: bytes | None = None, forms: bool = False) -> DataFrame:
    """The rows whose ``text`` changes when it is brought to its consistent form: ``keys``, and with ``forms`` that form.

    With ``model``, garbled texts are left out. Null and empty texts never change. A record that is there twice comes
    out once (by ``keys``).
    """
    shared = share(df.sparkSession, model) if model else None
    picked = df.where(F.col(text).rlike(NOT_ASCII)).select(*keys, text)
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + (", form string" if forms else "")

    def make():
        m = loaded(shared) if shared else None

        def run(*columns):
            *own, texts = columns
            made = consistent(texts)
            at = [i for i, (a, b) in enumerate(zip(texts, made)) if a != b and not (m and m.is_garbled(a))]
            return tuple([[c[i] for i in at] for c in own] + ([[made[i] for i in at]] if forms else []))

        return run

    return map_columns(picked, make, schema).dropDuplicates(keys)


def unit(name: str) -> Column:
    return F.lit(name).alias("unit")
