"""Statistics and metadata of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.media import average_dpi

from ..functions.text import blank_to_null, strip, words

# What documents get that say nothing of themselves.
DEFAULT_CREATED = "2023-01-01T00:00:00Z"
DEFAULT_REVISION, DEFAULT_CREATOR = "1", "leafmill"


def run_text(runs: Column) -> Column:
    """The texts of a paragraph's runs in order."""
    return F.array_join(F.transform(runs, lambda r: F.coalesce(r["text"], F.lit(""))), "")


def document_statistics(paragraphs: DataFrame, pages: DataFrame | None = None, text: str = "text") -> DataFrame:
    """Paragraphs, words, lines and characters of each ``doc_id`` (and ``pages``, if their table is given)."""
    t = F.coalesce(F.col(text), F.lit(""))
    bare = strip(t)
    shown = bare != ""
    count = lambda x: F.sum(F.when(shown, x).otherwise(0)).cast("bigint")
    out = paragraphs.groupBy("doc_id").agg(
        F.count("*").alias("paragraphs"),
        count(F.size(words(bare))).alias("words"),
        count(F.length(bare) - F.length(F.replace(bare, F.lit("\n"), F.lit(""))) + 1).alias("lines"),
        count(F.length(bare)).alias("characters"),
        F.sum(F.length(t)).cast("bigint").alias("characters_with_spaces"),
    )
    return out if pages is None else out.join(pages.groupBy("doc_id").agg(F.count("*").alias("pages")), "doc_id", "left").fillna(0, ["pages"])


def keywords(text: Column) -> Column:
    """Keywords written with commas between them."""
    return F.filter(F.transform(F.split(text, ","), strip), lambda x: x != "")


def core_properties(meta: DataFrame) -> DataFrame:
    """Properties of each document with defaults; empty strings count as missing. ``created`` and ``modified`` are taken as they are."""
    c = lambda name: blank_to_null(F.col(name))
    creator = F.coalesce(c("author"), F.lit(DEFAULT_CREATOR))
    created = F.coalesce(c("created"), F.lit(DEFAULT_CREATED))
    return meta.select(
        "doc_id",
        F.coalesce(c("title"), F.when(F.col("tagged"), "Tagged PDF").otherwise("PDF Conversion")).alias("title"),
        creator.alias("creator"),
        c("subject").alias("subject"),
        F.array_join(F.filter(F.transform("keywords", strip), lambda x: x != ""), ", ").alias("keywords"),
        F.coalesce(c("last_modified_by"), creator).alias("last_modified_by"),
        created.alias("created"),
        F.coalesce(c("modified"), created).alias("modified"),
        c("language").alias("language"),
        F.coalesce(c("revision"), F.lit(DEFAULT_REVISION)).alias("revision"),
    )


def overlay(base: DataFrame, over: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``base`` with the columns of ``over`` (one row a key) where they aren't null."""
    other = over.select(key, *(F.col(c).alias(f"_o_{c}") for c in columns))
    both = base.join(other, key, "left")
    return both.select(*(F.coalesce(f"_o_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns))


def image_statistics(images: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc_id, pages, images, average_dpi``: images have ``width_px, height_px`` and edges; those without a size count but say nothing of the mean."""
    dpi = average_dpi(F.col("width_px"), F.col("height_px"), F.col("x_right") - F.col("x_left"), F.col("y_top") - F.col("y_bottom"))
    found = images.groupBy("doc_id").agg(F.count("*").alias("images"), F.avg(dpi).alias("average_dpi"))
    size = pages.groupBy("doc_id").agg(F.count("*").alias("pages"))
    return size.join(found, "doc_id", "left").select("doc_id", "pages", F.coalesce("images", F.lit(0)).alias("images"), "average_dpi")
