"""Lines that many documents of one source carry.

The letters of a record are one stream, in which line breaks count for nothing: a chunk ends where the rolling hash of
the last letters says so (content-defined chunking). For each chunk and source the distinct documents are counted, and a
line is repeated excessively if all its chunks are; its head and tail lie in chunks that reach over its ends and are
compared by an exact count of the lines that are left. A line without a chunk of its own is one chunk.

The cuts inside a line depend on its letters alone (a rolling window that reaches over its start makes no chunk of it), so
each of its chunks stands in as many documents as the line at least: no line is lost.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .batches import map_columns
from .chars import consistent, letters

#: Letters in the rolling window, and in a chunk on average.
WINDOW, MEAN = 6, 10
MIN_DOCS, MIN_SHARE = 3, 0.2
#: Stands for a break between runs; a record's text may hold line feeds of its own.
BREAK = "\x1e"

_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _hashed(cp: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each segment's letters in order."""
    at = np.arange(len(cp)) - np.repeat(starts, sizes)
    power = np.cumprod(np.full(int(sizes.max()), _B1, np.uint64))
    return _mixed(np.add.reduceat(_mixed(cp.astype(np.uint64) + _B2) * power[at], starts) + sizes.astype(np.uint64) * _B2)


def chunks_of(lines: list[str]) -> tuple[list[int], list[list[int]]]:
    """For lines of letters (none empty) the hash of each line and those of its chunks."""
    sizes = np.array([len(x) for x in lines], np.int64)
    starts = np.cumsum(sizes) - sizes
    cp = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(cp)
    at = np.arange(n) - np.repeat(starts, sizes)
    # the rolling hash of the last WINDOW letters; a window that reaches over the line's start cuts no chunk of it
    value = _mixed(cp.astype(np.uint64))
    rolling = np.zeros(n, np.uint64)
    for k in range(min(WINDOW, n)):
        rolling[k:] += value[: n - k] * (_B1 ** np.uint64(k) if k else np.uint64(1))
    cut = (at >= WINDOW - 1) & (_mixed(rolling) % np.uint64(MEAN) == 0)
    begin = at == 0
    begin[1:] |= cut[:-1]
    first = np.flatnonzero(begin)
    ends = np.r_[first[1:], n]
    own = np.flatnonzero((at[first] > 0) & cut[ends - 1])
    hashed = _hashed(cp, first, ends - first).astype(np.int64)[own].tolist()
    line = _hashed(cp, starts, sizes).astype(np.int64).tolist()
    bounds = np.searchsorted(first[own], np.r_[starts, n]).tolist()
    return line, [hashed[a:b] or [whole] for a, b, whole in zip(bounds, bounds[1:], line)]


def line_keys(texts: list[str | None], brk: str) -> tuple[list[int], list[int], list[str]]:
    """Of each line with a letter: the place of its text, its number, and its letters in consistent form."""
    at, number, found = [], [], []
    for i, text in enumerate(consistent(texts)):
        if text:
            for k, line in enumerate(text.split(brk) if brk in text else (text,)):
                if key := letters(line):
                    at.append(i)
                    number.append(k)
                    found.append(key)
    return at, number, found


def run_text(runs: Column) -> Column:
    """The text of a paragraph's runs in order, with BREAK where a run is a break."""
    return F.array_join(
        F.transform(runs, lambda r: F.when(r["break_type"].isNull(), F.coalesce(r["text"], F.lit(""))).otherwise(F.lit(BREAK))), ""
    )


def lines(df: DataFrame, keys: list[str], brk: str) -> DataFrame:
    """A row for each line of ``text`` that holds a letter: ``keys``, ``line_no``, ``line`` (hash) and ``chunks`` (hashes)."""
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", line_no int, line bigint, chunks array<bigint>"

    def make():
        def run(*columns):
            *own, texts = columns
            at, number, found = line_keys(texts, brk)
            hashed, chunks = chunks_of(found) if found else ([], [])
            return *([c[i] for i in at] for c in own), number, hashed, chunks

        return run

    return map_columns(df.select(*keys, "text"), make, schema)


def _excessive(rows: DataFrame, size: DataFrame, what: str) -> DataFrame:
    """``unit, source`` and ``what`` where as many distinct documents of the source have it as ``size`` says (``least``)."""
    # rows are counted first: they are as many as the documents at least, and no document has to go through that shuffle
    often = rows.groupBy("unit", "source", what).agg(F.count("*").alias("n")).join(size, "source").where(F.col("n") >= F.col("least"))
    each = rows.join(often.select("unit", "source", what), ["unit", "source", what], "left_semi").groupBy("unit", "source", what, "doc_id").agg(F.lit(1).alias("one"))
    counted = each.groupBy("unit", "source", what).agg(F.count("*").alias("docs")).join(size, "source")
    return counted.where(F.col("docs") >= F.col("least")).select("unit", "source", what)


def repeated(lines: DataFrame, sources: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """The rows of ``lines`` (``unit, source, doc_id, page_no, idx, line_no, line, chunks``) that are repeated excessively in their source.

    ``sources`` has ``doc_id`` and ``source`` of every document, each once. Units are counted apart. Documents without
    a source have no repeated lines. ``lines`` is read several times and should be a written table.
    """
    least = F.greatest(F.lit(min_docs), F.ceil(F.lit(min_share) * F.count("*") - 1e-9))
    size = sources.where(F.col("source").isNotNull()).groupBy("source").agg(least.alias("least"))
    lines = lines.where(F.col("source").isNotNull())
    # a hot chunk stands in a share of its source's documents: a source has (chunks of a mean document) / share at most
    hot = staged(_excessive(lines.select("unit", "source", "doc_id", F.explode("chunks").alias("chunk")), size, "chunk"), "chunks")
    place = ["unit", "doc_id", "page_no", "idx", "line_no"]
    first = lines.withColumn("chunk", F.element_at("chunks", 1)).join(hot, ["unit", "source", "chunk"], "left_semi").drop("chunk")
    others = first.where(F.size("chunks") > 1).select("source", *place, F.explode(F.slice("chunks", F.lit(2), F.size("chunks"))).alias("chunk"))
    cold = others.join(hot, ["unit", "source", "chunk"], "left_anti").select(*place).distinct()
    candidates = staged(first.drop("chunks").join(cold, place, "left_anti"), "candidates")
    return candidates.join(_excessive(candidates, size, "line"), ["unit", "source", "line"], "left_semi")


def lines_of_tables(blocks: DataFrame, paragraphs: DataFrame, sources: DataFrame) -> DataFrame:
    """The lines of blocks and of paragraphs with their source, as a written table."""
    shown = blocks.where(F.col("text").isNotNull()).select("doc_id", "page_no", F.col("block_idx").alias("idx"), "text")
    a = lines(shown, ["doc_id", "page_no", "idx"], "\n")
    p = paragraphs.select("doc_id", "page_no", F.col("para_idx").alias("idx"), run_text(F.col("runs")).alias("text")).where(F.col("text").isNotNull())
    b = lines(p, ["doc_id", "page_no", "idx"], BREAK)
    both = a.withColumn("unit", F.lit("block")).unionByName(b.withColumn("unit", F.lit("paragraph")))
    return staged(both.join(sources, "doc_id", "left"), "lines")


def without_repeated(df: DataFrame, keys: list[str], brk: str, found: DataFrame) -> DataFrame:
    """``keys``, ``text`` without the lines that ``found`` (``keys``, ``line_no``) lists, and ``n_cut``.

    ``df`` has each record once. A record of nothing else keeps an empty text, a null text stays null; other breaks than
    line feeds become line feeds.
    """
    gone = found.groupBy(*keys).agg(F.collect_set("line_no").alias("gone"))
    both = df.select(*keys, "text").join(gone, keys, "left")
    kept = F.filter(F.split("text", brk), lambda x, i: ~F.array_contains("gone", i))
    text = F.when(F.col("gone").isNull(), F.replace("text", F.lit(brk), F.lit("\n"))).otherwise(F.array_join(kept, "\n"))
    return both.select(*keys, text.alias("text"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_cut"))
