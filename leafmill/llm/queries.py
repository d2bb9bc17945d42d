"""The queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import staged, table
from . import langid, leaks, mixing, repeats, sentences
from .encoding import fit_garble, garbled, look_alikes, unit
from .languages import fit_languages, identified, mislabelled, named, of_documents

Query = Callable[[SparkSession, str], DataFrame]
BLOCK = ["doc_id", "page_no", "block_idx"]
FRAGMENT = ["doc_id", "page_no", "frag_idx"]
#: Bound on the documents of a language that the model for whole documents is fitted to.
DOCUMENT_SAMPLE = 500


def _cases(df: DataFrame, name: str, idx: str, *more: str) -> DataFrame:
    return df.select(unit(name), "doc_id", "page_no", F.col(idx).alias("idx"), *more)


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "doc_metadata").groupBy("doc_id").agg(F.max("source").alias("source"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are repeated excessively within their source."""
    sources = _sources(spark, sf_dir)
    out = repeats.repeated(repeats.lines_of_tables(table(spark, sf_dir, "text_blocks"), table(spark, sf_dir, "paragraphs"), sources), sources)
    return out.select("unit", "doc_id", "page_no", "idx", "line_no").distinct()


def p1_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block and paragraph without the lines that are repeated within its source."""
    blocks, paragraphs, key = table(spark, sf_dir, "text_blocks"), table(spark, sf_dir, "paragraphs"), ["doc_id", "page_no", "idx"]
    sources = _sources(spark, sf_dir)
    found = staged(repeats.repeated(repeats.lines_of_tables(blocks, paragraphs, sources), sources).select("unit", *key, "line_no"), "repeated")
    a = blocks.select("doc_id", "page_no", F.col("block_idx").alias("idx"), "text").dropDuplicates(key)
    b = paragraphs.select("doc_id", "page_no", F.col("para_idx").alias("idx"), repeats.run_text(F.col("runs")).alias("text")).dropDuplicates(key)
    made = [
        repeats.without_repeated(df, key, brk, found.where(F.col("unit") == name)).select(unit(name), *key, "text", "n_cut")
        for df, name, brk in ((a, "block", "\n"), (b, "paragraph", repeats.BREAK))
    ]
    return made[0].unionByName(made[1])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks and font names that are garbled at least in part."""
    blocks, fragments = table(spark, sf_dir, "text_blocks"), table(spark, sf_dir, "fragments")
    model = fit_garble(blocks, fragments)
    a = _cases(garbled(blocks, "text", BLOCK, model), "block", "block_idx")
    return a.unionByName(_cases(garbled(fragments, "font_name", FRAGMENT, model), "fragment", "frag_idx"))


def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records with the stored and the intended value; the latter is null where it can't be known."""
    blocks, fragments = table(spark, sf_dir, "text_blocks"), table(spark, sf_dir, "fragments")
    model = fit_garble(blocks, fragments)
    a = _cases(garbled(blocks, "text", BLOCK, model, restore=True), "block", "block_idx", "stored", "restored")
    b = garbled(fragments, "font_name", FRAGMENT, model, restore=True)
    return a.unionByName(_cases(b, "fragment", "frag_idx", "stored", "restored"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks and fragments whose text is made of look-alike or invisible characters at least in part."""
    blocks, fragments = table(spark, sf_dir, "text_blocks"), table(spark, sf_dir, "fragments")
    model = fit_garble(blocks, fragments)
    a = _cases(look_alikes(blocks, "text", BLOCK, model), "block", "block_idx")
    return a.unionByName(_cases(look_alikes(fragments, "text", FRAGMENT), "fragment", "frag_idx"))


def p4_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records with their text in its consistent form."""
    blocks, fragments = table(spark, sf_dir, "text_blocks"), table(spark, sf_dir, "fragments")
    model = fit_garble(blocks, fragments)
    a = _cases(look_alikes(blocks, "text", BLOCK, model, forms=True), "block", "block_idx", "form")
    return a.unionByName(_cases(look_alikes(fragments, "text", FRAGMENT, forms=True), "fragment", "frag_idx", "form"))


def _runs(paragraphs: DataFrame, least: int = 1) -> DataFrame:
    """The runs that may have ``least`` letters by weight, one a row; null runs and texts have none."""
    each = paragraphs.select("doc_id", "page_no", "para_idx", F.posexplode("runs").alias("run_idx", "run"))
    return each.where(F.length("run.text") * 2 >= least).select("doc_id", "page_no", "para_idx", "run_idx", F.col("run.text").alias("text"), F.col("run.language").alias("language"))


def _languages(spark: SparkSession, sf_dir: str, places: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of blocks, of runs, of documents (with ``label``)."""
    blocks, fragments = table(spark, sf_dir, "text_blocks"), table(spark, sf_dir, "fragments")
    garble, model = fit_garble(blocks, fragments), fit_languages(blocks)
    of_blocks = staged(identified(blocks.where(F.col("text").isNotNull()), BLOCK, model, garble, places=places), "languages")
    of_runs = identified(_runs(table(spark, sf_dir, "paragraphs"), 1 if places else langid.MIN_LETTERS), ["doc_id", "page_no", "para_idx", "run_idx"], model, places=places, cases=not places)
    labels = table(spark, sf_dir, "doc_metadata").groupBy("doc_id").agg(F.max("language").alias("language"))
    of_docs = of_documents(of_blocks).join(named(labels, "doc_id"), "doc_id")
    return of_blocks, of_runs, of_docs


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks, runs and documents whose language is missing or wrong, and blocks of several languages."""
    of_blocks, of_runs, of_docs = _languages(spark, sf_dir, False)
    none = F.lit(-1)
    a = mislabelled(of_blocks, BLOCK).select(unit("block"), "doc_id", "page_no", F.col("block_idx").alias("idx"), none.alias("run_idx"), "lang")
    b = mislabelled(of_runs, ["doc_id", "page_no", "para_idx", "run_idx"]).select(unit("run"), "doc_id", "page_no", F.col("para_idx").alias("idx"), "run_idx", "lang")
    c = of_docs.where((F.col("lang") != langid.UNKNOWN) & ~F.col("label").eqNullSafe(F.col("lang"))).select(unit("document"), "doc_id", none.alias("page_no"), none.alias("idx"), none.alias("run_idx"), "lang")
    return a.unionByName(b).unionByName(c)


def p5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every PDF, block and run with its language or languages, where they stand, and how sure that is."""
    of_blocks, of_runs, of_docs = _languages(spark, sf_dir, True)
    columns = ["langs", "starts", "ends", "confidence"]
    a = of_blocks.dropDuplicates(BLOCK).select(unit("block"), "doc_id", "page_no", F.col("block_idx").alias("idx"), F.lit(-1).alias("run_idx"), *columns)
    b = of_runs.dropDuplicates(["doc_id", "page_no", "para_idx", "run_idx"]).select(unit("run"), "doc_id", "page_no", F.col("para_idx").alias("idx"), "run_idx", *columns)
    whole = [F.array("lang").alias("langs"), F.array(F.lit(0)).alias("starts"), F.array(F.lit(-1)).alias("ends"), F.array("confidence").alias("confidence")]
    c = of_docs.select(unit("document"), "doc_id", F.lit(-1).alias("page_no"), F.lit(-1).alias("idx"), F.lit(-1).alias("run_idx"), *whole)
    return a.unionByName(b).unionByName(c)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold 13 consecutive words of an item's passage: of all leaks, those that are verified to need no edit."""
    return p6_leaks(spark, sf_dir).where(F.col("least_edits") == 0).select("doc_id", "item_id")


def p6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold 13 words of an item's passage with few edits, where the best match begins, and its edits."""
    return leaks.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents with their repeats."""
    targets = table(spark, sf_dir, "mix_targets")
    return mixing.mixed(mixing.counted(table(spark, sf_dir, "documents"), targets), targets)


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that are reached."""
    targets = table(spark, sf_dir, "mix_targets")
    lengths = mixing.counted(table(spark, sf_dir, "documents"), targets)
    return mixing.shares(mixing.mixed(lengths, targets), lengths, targets)


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    some = documents.where(F.col("text").isNotNull())
    model = fit_languages(some, label="lang", by=("doc_id",), rows=DOCUMENT_SAMPLE)
    known = sentences.with_languages(some, "doc_id", model)
    return sentences.split(known, "doc_id", sentences.learn(known))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence with its place in the text."""
    return _sentences(spark, sf_dir).select("doc_id", "start_pos", "end_pos").distinct()


def p8_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence with its number in the text, its place, and the text's main language."""
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("start_pos")) - 1
    return _sentences(spark, sf_dir).distinct().withColumn("sentence_no", number)


def queries() -> dict[str, Query]:
    return {"p1_found": p1_found, "p1_cleaned": p1_cleaned, "p2_found": p2_found, "p2_restored": p2_restored, "p4_found": p4_found, "p4_consistent": p4_consistent, "p5_found": p5_found, "p5_languages": p5_languages, "p6_found": p6_found, "p6_leaks": p6_leaks, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_sentences": p8_sentences}


def oracle_sql() -> dict[str, str]:
    return {}
