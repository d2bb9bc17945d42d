"""Documents of several sources combined to target shares of all tokens.

Documents are counted by source and exact token length. A source's budget is filled by taking all its documents as often
as they fit, then the same share of each length; what is left (twice the longest text at most) is met by a bounded
knapsack over the lengths that remain. The documents of each length are then chosen in a seeded order.
"""

from __future__ import annotations

import base64
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import staged
from .batches import map_columns

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
SEED = 41
#: Parts of the seeded order that are counted before documents of one length are ranked.
PARTS = 1_024

_encoders: dict[int, object] = {}


def token_counts(df: DataFrame, keys: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """``keys`` and ``tokens``: the length of each text in tokens of the public tokenizer; 0 for null and empty texts."""
    import public_tokenizers

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        raw = f.read()
    shared = df.sparkSession.sparkContext.broadcast((raw, public_tokenizers.PATTERN))
    kinds = dict(df.dtypes)

    def make():
        if not _encoders:
            import tiktoken

            data, pattern = shared.value
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
            _encoders[0] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        encode = _encoders[0].encode_ordinary

        def run(*columns):
            *own, texts = columns
            return *own, [len(encode(t)) if t else 0 for t in texts]

        return run

    return map_columns(df.select(*keys, text), make, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", tokens int")


def knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take, at most ``counts``, so that the sum is the largest one up to ``budget``.

    The sums that can be reached are the bits of a number. Every so many steps it is kept, and the steps between are done
    again on the way back, so memory is that of the square root of the steps.
    """
    steps: list[tuple[int, int]] = []
    for k, (length, n) in enumerate(zip(lengths, counts)):
        n, size = min(n, budget // length), 1
        while n > 0:
            steps.append((k, min(size, n)))
            n -= size
            size *= 2
    mask = (1 << (budget + 1)) - 1
    every = math.isqrt(len(steps)) + 1

    def with_step(reach: int, step: tuple[int, int]) -> int:
        return reach | reach << (lengths[step[0]] * step[1]) & mask

    reach, kept, done = 1, [], 0
    for done, step in enumerate(steps, 1):
        if (done - 1) % every == 0:
            kept.append(reach)
        reach = with_step(reach, step)
        if reach >> budget & 1:
            break
    total = reach.bit_length() - 1
    out = [0] * len(lengths)
    for first in reversed(range(0, done, every)):
        part = steps[first : min(first + every, done)]
        before = [kept.pop()]
        for step in part[:-1]:
            before.append(with_step(before[-1], step))
        for (k, take), sums in zip(reversed(part), reversed(before)):
            if not sums >> total & 1:
                out[k] += take
                total -= lengths[k] * take
    return out


def plan(lengths: np.ndarray, counts: np.ndarray, budget: int, most: int) -> tuple[int, np.ndarray]:
    """Repeats of all documents, and how many of each length are taken once more."""
    total = int((lengths * counts).sum())
    extra = np.zeros(len(lengths), np.int64)
    if total == 0 or budget <= 0 or most <= 0:
        return 0, extra
    times = min(most, budget // total)
    if times == most:
        return times, extra
    left = budget - times * total
    # the same share of each length first, rounded so that it also holds over neighbouring lengths; a longest text is kept free
    by_length = np.argsort(lengths, kind="stable")
    share = max(0, left - int(lengths.max())) / total
    upto = np.floor(np.cumsum(counts[by_length]) * share + 0.5).astype(np.int64)
    extra[by_length] = np.minimum(np.diff(np.r_[0, upto]), counts[by_length])
    left -= int((extra * lengths).sum())
    while left < 0:  # rounding may have gone beyond the budget
        k = int(np.flatnonzero(extra)[-1])
        extra[k] -= 1
        left += int(lengths[k])
    order = np.argsort(-lengths, kind="stable")
    rest = [int(k) for k in order if counts[k] > extra[k] and lengths[k] <= left]
    for k, n in zip(rest, knapsack([int(lengths[k]) for k in rest], [int(counts[k] - extra[k]) for k in rest], left)):
        extra[k] += n
    return int(times), extra


def _plans(rows: pd.DataFrame) -> pd.DataFrame:
    """One source: its lengths with the number of documents that are taken once more, and the repeats of all."""
    times, extra = plan(rows.tokens.to_numpy(np.int64), rows.n.to_numpy(np.int64), int(rows.budget.iloc[0]), int(rows.max_repeats.iloc[0]))
    return pd.DataFrame({"source": rows.source, "tokens": rows.tokens, "times": times, "extra": extra})


def counted(documents: DataFrame, targets: DataFrame, path: str | None = None) -> DataFrame:
    """The documents of sources with a target and their token lengths, as a written table; documents without tokens are left out."""
    listed = documents.join(targets.select("source"), "source", "left_semi").where(F.col("text").isNotNull())
    return staged(token_counts(listed, ["doc_id", "source"], path=path).where(F.col("tokens") > 0), "tokens")


def mixed(lengths: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``source``, ``tokens`` and ``repeats`` of the chosen documents.

    ``lengths`` as ``counted`` gives them; ``targets`` has ``source`` (each once), ``target_share`` and ``max_repeats``.
    ``budget`` is the number of all tokens wanted, by default those of all listed documents. A source gets its share of it
    or, if its documents don't suffice at ``max_repeats``, all it has; others don't make up for it. Null shares or repeats
    count as 0.
    """
    histogram = lengths.groupBy("source", "tokens").agg(F.count("*").alias("n"))
    total = F.lit(budget) if budget is not None else F.lit(lengths.agg(F.sum("tokens")).first()[0] or 0)
    wanted = targets.select("source", F.floor(F.coalesce("target_share", F.lit(0.0)) * total + F.lit(1e-6)).alias("budget"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"))
    plans = histogram.join(wanted, "source").groupBy("source").applyInPandas(_plans, "source string, tokens int, times int, extra bigint")
    # the seeded order is counted in parts, so that no group of one length is ever ranked as a whole
    place: Column = F.xxhash64(F.lit(seed), "doc_id")
    docs = lengths.withColumn("place", place).withColumn("part", F.pmod(F.shiftright("place", 20), F.lit(PARTS)).cast("int"))
    parts = docs.groupBy("source", "tokens", "part").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("source", "tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("upto", F.sum("n").over(upto)).join(plans, ["source", "tokens"])
    share = parts.select("source", "tokens", "part", "times", F.greatest(F.lit(0), F.least("n", F.col("extra") - F.col("upto") + F.col("n"))).alias("take"), F.col("n").alias("in_part"))
    both = docs.join(share, ["source", "tokens", "part"])
    whole = both.where((F.col("take") == 0) | (F.col("take") == F.col("in_part"))).withColumn("once", (F.col("take") > 0).cast("int"))
    rank = F.row_number().over(Window.partitionBy("source", "tokens", "part").orderBy("place", "doc_id"))
    cut = both.where((F.col("take") > 0) & (F.col("take") < F.col("in_part"))).withColumn("once", (rank <= F.col("take")).cast("int"))
    chosen = whole.unionByName(cut).withColumn("repeats", F.col("times") + F.col("once"))
    return chosen.where(F.col("repeats") > 0).select("doc_id", "source", "tokens", "repeats")


def shares(chosen: DataFrame, lengths: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target: what the source has, what is taken, its target share and the share reached (of all tokens taken)."""
    taken = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("taken_tokens"), F.sum("repeats").alias("taken_documents"), F.max("repeats").alias("most_repeats"))
    there = lengths.groupBy("source").agg(F.sum("tokens").alias("source_tokens"), F.count("*").alias("source_documents"))
    out = targets.select("source", "target_share", "max_repeats").join(there, "source", "left").join(taken, "source", "left").fillna(0)
    whole = F.sum("taken_tokens").over(Window.partitionBy(F.lit(1)))  # over the targets: a row for each source
    return out.withColumn("reached_share", F.when(whole > 0, F.col("taken_tokens") / whole).otherwise(F.lit(0.0)))
