"""The operators and queries on Spark: brute force on the smallest tables, and rows that no table should have."""

import pickle
from collections import Counter, defaultdict
from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from leafmill.llm import encoding, garble, langid, languages, leaks, mixing, repeats, sentences
from leafmill.llm.chars import consistent, letters
from leafmill.llm.queries import _runs, queries
from leafmill.session import table

from ..conftest import SF

QUERIES = queries()
NAMES = sorted(QUERIES)
COLUMNS = {
    "p1_found": ["unit", "doc_id", "page_no", "idx", "line_no"],
    "p2_found": ["unit", "doc_id", "page_no", "idx"],
    "p4_found": ["unit", "doc_id", "page_no", "idx"],
    "p5_found": ["unit", "doc_id", "page_no", "idx", "run_idx", "lang"],
    "p6_found": ["doc_id", "item_id"],
    "p8_found": ["doc_id", "start_pos", "end_pos"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_single_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns == COLUMNS[name]
    rows = df.collect()
    assert len(rows) == len(set(rows)) and (rows or name == "p6_found")


def changed(tmp_path, how):
    """The tables of the smallest size, each changed by ``how``."""
    import pathlib

    for f in pathlib.Path(SF).iterdir():
        pq.write_table(how(f.stem, pq.read_table(f)), tmp_path / f.name)
    return str(tmp_path)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, tmp_path, name):
    assert QUERIES[name](spark, changed(tmp_path, lambda n, t: t.slice(0, 0))).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_null_columns(spark, tmp_path, name):
    """Texts, labels, sources and the like are null in every row; keys stay."""
    keys = {"doc_id", "page_no", "block_idx", "frag_idx", "para_idx", "item_id", "conv_id"}
    sf = changed(tmp_path, lambda n, t: pa.table({f.name: t[f.name] if f.name in keys else pa.nulls(len(t), f.type) for f in t.schema}))
    got = QUERIES[name](spark, sf).count()
    assert got == 0 or name in ("p1_cleaned", "p5_languages", "p7_shares")


CLASH = ["unit", "idx", "line_no", "line", "chunks", "lang", "langs", "letters", "weight", "label", "stored", "restored", "form", "tokens", "repeats", "place", "part", "n", "count", "start_pos", "end_pos", "least_edits", "first_word", "run_idx", "docs", "n_cut", "upto", "take"]


@pytest.mark.parametrize("name", NAMES)
def test_repeated_rows_and_clashing_columns(spark, tmp_path, name):
    """All rows twice, and columns with the names that the operators use: the result is the same."""

    def how(n, t):
        if n in ("eval_items", "mix_targets", "sources"):
            both = t
        else:
            both = t if n == "documents" else pa.concat_tables([t, t])
        for c in CLASH:
            if c not in both.column_names:
                both = both.append_column(c, pa.array(["x"] * len(both)))
        return both

    want = QUERIES[name](spark, SF)
    got = QUERIES[name](spark, changed(tmp_path, how))
    assert got.columns == want.columns
    if name in ("p1_found", "p6_found", "p6_leaks", "p7_mix", "p7_shares", "p8_found", "p8_sentences", "p4_consistent"):  # the fits of others see other samples
        key = lambda r: repr(r)
        assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)


def test_repeated_lines_against_brute_force(spark):
    source = {r.doc_id: r.source for r in table(spark, SF, "doc_metadata").collect()}
    size = Counter(source.values())
    found = []
    for r in table(spark, SF, "text_blocks").dropDuplicates(["doc_id", "page_no", "block_idx"]).collect():
        found += [("block", r.doc_id, r.page_no, r.block_idx, k, x) for k, x in enumerate((r.text or "").split("\n"))]
    for r in table(spark, SF, "paragraphs").dropDuplicates(["doc_id", "page_no", "para_idx"]).collect():
        out = [""]
        for run in r.runs or ():
            if run.break_type is not None:
                out.append("")
            else:
                out[-1] += run.text or ""
        found += [("paragraph", r.doc_id, r.page_no, r.para_idx, k, x) for k, x in enumerate(out)]
    keys = [letters(x) for x in consistent([f[5] for f in found])]
    docs = defaultdict(set)
    for f, k in zip(found, keys):
        docs[f[0], source[f[1]], k].add(f[1])
    want = {f[:5] for f, k in zip(found, keys) if k and len(docs[f[0], source[f[1]], k]) >= max(3, size[source[f[1]]] / 5)}
    assert {tuple(r) for r in QUERIES["p1_found"](spark, SF).collect()} == want and want
    cut = {tuple(r) for r in QUERIES["p1_cleaned"](spark, SF).where("n_cut > 0").select("unit", "doc_id", "page_no", "idx").collect()}
    assert cut == {w[:4] for w in want}


def test_lines_of_one_hot_source(spark):
    """All documents in one source, ties at the share of a fifth."""
    rows = [(f"d{k}", 0, 0, f"own {'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}" + ("\nShared LINE 7" if k % 5 == 0 else "\nrare one" if k % 5 == 1 and k > 5 else "")) for k in range(50)]
    blocks = spark.createDataFrame(rows, "doc_id string, page_no int, block_idx int, text string")
    paragraphs = table(spark, SF, "paragraphs").limit(0)
    sources = blocks.select("doc_id", F.lit("s").alias("source"))
    found = repeats.repeated(repeats.lines_of_tables(blocks, paragraphs, sources), sources)
    assert {(r.doc_id, r.line_no) for r in found.collect()} == {(f"d{k}", 1) for k in range(0, 50, 5)}


def test_lines_of_hot_chunks_that_are_rare_themselves(spark):
    """A line made of the hot chunks of others, in an order of its own, and one whose letters run into the next line's."""
    half = ["every copy of this page keeps the notice of the town library", "share this report with the members of the night shift today"]
    rows = [(f"d{k}", 0, 0, "\n".join([*half, f"only here {'abcdefghij'[k % 10]}{'klm'[k // 10]}"])) for k in range(29)] + [("d29", 0, 0, half[1] + half[0] + "\n" + half[0][:30] + "\n" + half[0][30:])]
    blocks = spark.createDataFrame(rows, "doc_id string, page_no int, block_idx int, text string")
    sources = blocks.select("doc_id", F.lit("s").alias("source"))
    found = repeats.repeated(repeats.lines_of_tables(blocks, table(spark, SF, "paragraphs").limit(0), sources), sources)
    assert {(r.doc_id, r.line_no) for r in found.collect()} == {(f"d{k}", n) for k in range(29) for n in (0, 1)}


def test_leaks_against_brute_force(spark):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "eval_items")
    grams = defaultdict(set)
    for r, w in zip(rows := items.collect(), leaks.words_of([r.passage for r in rows])):
        for k in range(len(w) - 12):
            grams[tuple(w[k : k + 13])].add(r.item_id)
    want = set()
    for r, w in zip(rows := docs.collect(), leaks.words_of([r.text for r in rows])):
        for k in range(len(w) - 12):
            want |= {(r.doc_id, i) for i in grams.get(tuple(w[k : k + 13]), ())}
    assert {tuple(r) for r in QUERIES["p6_found"](spark, SF).collect()} == want


def test_leak_blocks(spark, monkeypatch):
    """Items in many blocks give what one block gives."""
    want = {tuple(r) for r in QUERIES["p6_leaks"](spark, SF).collect()}
    monkeypatch.setattr(leaks, "BLOCK_WINDOWS", 9_000)
    assert len(leaks.blocks(table(spark, SF, "eval_items"), "item_id", "passage")) > 5
    assert {tuple(r) for r in QUERIES["p6_leaks"](spark, SF).collect()} == want


def test_mix_keeps_targets(spark):
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 2), ("gone", 0.0, 1), ("null", None, None)], "source string, target_share double, max_repeats int")
    lengths = spark.createDataFrame([(k, "abc"[k % 3], 1 + k % 7) for k in range(3000)] + [(9000, "null", 5)], "doc_id long, source string, tokens int")
    chosen = mixing.mixed(lengths, targets, budget=6000)
    assert chosen.groupBy("doc_id").count().where("count > 1").count() == 0
    got = {r.source: (r.t, r.m) for r in chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("t"), F.max("repeats").alias("m")).collect()}
    assert {s: t for s, (t, _) in got.items()} == {"a": 3000, "b": 1800, "c": 1200}
    assert sorted(chosen.collect()) == sorted(mixing.mixed(lengths, targets, budget=6000).collect())
    short = mixing.mixed(lengths, targets, budget=10**6)
    assert {r.source: r.m for r in short.groupBy("source").agg(F.max("repeats").alias("m")).collect()} == {"a": 1, "b": 3, "c": 2}
    s = {r.source: r for r in mixing.shares(chosen, lengths, targets).collect()}
    assert abs(s["a"].reached_share - 0.5) < 1e-9 and s["gone"].taken_tokens == 0


def test_one_length_is_never_ranked_whole(spark):
    """A source whose documents all have one length: the seeded order is cut exactly."""
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    lengths = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit(3).alias("tokens"))
    assert mixing.mixed(lengths, targets, budget=4001).count() == 1333


def test_sentences_on_spark(spark):
    texts = [(1, "Dr. Brix came. He left."), (1, "Dr. Brix came. He left."), (2, None), (3, ""), (4, " \n ")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    model = languages.fit_languages(df.withColumn("lang", F.lit("en")), label="lang", by=("doc_id",))
    known = sentences.with_languages(df, "doc_id", model)
    found = sentences.split(known, "doc_id", sentences.learn(known)).distinct()
    assert {r.doc_id for r in found.collect()} == {1}


def test_garbled_rows(spark):
    rows = [("d", 0, k, t) for k, t in enumerate(["Die Prüfung für den jährlichen Bericht"] * 60 + ["Die PrÃ¼fung fÃ¼r den jÃ¤hrlichen Bericht", None, "", "für " * 30_000])]
    df = spark.createDataFrame(rows, "doc_id string, page_no int, block_idx int, text string")
    model = garble.dumps(garble.fit(r[3] for r in rows[:61]))
    found = encoding.garbled(df.union(df), "text", ["doc_id", "page_no", "block_idx"], model, restore=True).collect()
    assert [(r.block_idx, r.restored) for r in found] == [(60, "Die Prüfung für den jährlichen Bericht")]


def test_staged_tables_go_to_the_shared_folder(spark):
    from leafmill import session

    df = session.staged(spark.range(10), "test")
    assert df.count() == 10 and session.shared_dir(spark).split(":")[-1] in df.inputFiles()[0]


def test_garbled_blocks_have_a_language_and_are_no_case(spark):
    clean = ["Die Prüfung der Seiten für den jährlichen Bericht", "The night shift stored every form field again"]
    bad = garble.garble(clean[0], (("utf-8", "cp1252"),))
    model = garble.dumps(garble.fit([*clean * 100, bad]))
    known = langid.dumps(langid.fit([(clean[0], "de"), (clean[1], "en")] * 100))
    df = spark.createDataFrame([("d", 0, 0, bad, "en"), ("d", 0, 1, clean[1], "en")], "doc_id string, page_no int, block_idx int, text string, language string")
    found = languages.identified(df, ["doc_id", "page_no", "block_idx"], known, model).cache()
    assert [r.langs for r in found.orderBy("block_idx").collect()] == [["de"], ["en"]]
    assert languages.of_documents(found).first().lang == "de" and languages.mislabelled(found, ["block_idx"]).count() == 0


def test_short_runs_have_a_language_too(spark):
    """The bound of 25 letters is that of p5_found's cases alone."""
    some = "named_struct('text', '{}', 'language', cast(null as string))"
    p = spark.sql(f"select 'd' as doc_id, 0 as page_no, 0 as para_idx, array({some.format('Kurz.')}, {some.format('')}, {some.format('Ein langer Satz, der für sich steht.')}) as runs")
    assert [r.run_idx for r in _runs(p).orderBy("run_idx").collect()] == [0, 2]
    assert [r.run_idx for r in _runs(p, 25).collect()] == [2]


def test_models_are_kept_where_a_folder_is_named(spark, tmp_path):
    blocks, fragments = table(spark, SF, "text_blocks"), table(spark, SF, "fragments")
    plain = encoding.fit_garble(blocks, fragments)
    spark.conf.set("spark.leafmill.models", f"file://{tmp_path}")
    try:
        assert encoding.fit_garble(blocks, fragments) == plain and len(list(tmp_path.glob("garble-*.model"))) == 1
        assert encoding.stored([blocks, fragments], "garble", lambda: b"") == plain
    finally:
        spark.conf.unset("spark.leafmill.models")


def test_encodings_are_fitted_to_all_rows(spark):
    """The model of a table is that of all its texts, also of 80,000 rows; no letter of a rare row is missing."""
    blocks, fragments = table(spark, SF, "text_blocks"), table(spark, SF, "fragments")
    texts = [r[0] for df, c in ((blocks, "text"), (fragments, "font_name")) for r in df.select(c).collect()]
    want, got = garble.fit(texts), pickle.loads(encoding.fit_garble(blocks, fragments))
    assert want.pairs.keys() == got.pairs.keys() and want.rare.keys() == got.rare.keys()
    assert all((a[0] == b[0]).all() and np.allclose(a[1], b[1]) for a, b in ((want.pairs[x], got.pairs[x]) for x in want.pairs))
    rare = [chr(0x3B1 + k) for k in range(12)]
    letter = "concat('Seite für ', " + f"case when id % 5000 = 0 and id < 60000 then element_at(array({', '.join(repr(x) for x in rare)}), cast(id / 5000 as int) + 1) else 'Jörg' end)"
    many = spark.range(80_000).selectExpr("'d' as doc_id", "0 as page_no", "cast(id as int) as block_idx", letter + " as text")
    model = pickle.loads(encoding.fit_garble(many, fragments.limit(0)))
    assert set(rare) <= model.rare.keys()


@pytest.mark.parametrize("name", ["p4_found", "p5_found"])
def test_queries_fit_encodings_to_all_tokens(spark, monkeypatch, name):
    class Seen(Exception):
        pass

    def fitted(tokens):
        raise Seen(tokens.agg(F.sum("n")).first()[0])

    monkeypatch.setattr(encoding, "_fitted", fitted)
    texts = [r[0] for t, c in (("text_blocks", "text"), ("fragments", "font_name")) for r in table(spark, SF, t).select(c).collect()]
    with pytest.raises(Seen) as e:
        queries()[name](spark, SF)
    assert e.value.args[0] == garble.STEP * sum(1 for text in texts if text for t in garble.tokens(text) if t)


def test_languages_are_fitted_to_all_rows(spark):
    """The model of a table is that of all its labelled texts, also where a language has more than 2,400 rows."""
    words = "substr(translate(conv(cast(id * 7919 as string), 10, 16), '0123456789', 'ghijklmnop'), 1)"
    many = spark.range(6_000).selectExpr("'d' as doc_id", "0 as page_no", "cast(id as int) as block_idx", f"concat('the page ', {words}) as text", "if(id % 3 = 0, 'de', 'en-GB') as language")
    none = many.selectExpr("doc_id", "page_no", "-1 as block_idx", "cast(null as string) as text", "language").limit(1)
    wrong = many.selectExpr("doc_id", "page_no", "-2 as block_idx", "'--' as text", "'klingon' as language").limit(1)
    for df in (many.unionByName(none).unionByName(wrong), table(spark, SF, "text_blocks")):
        want, got = langid.fit((r.text, r.language) for r in df.select("text", "language").collect()), pickle.loads(languages.fit_languages(df))
        assert want.codes == got.codes and want.ids == got.ids and np.abs(want.logp - got.logp).max() < 0.05
    assert pickle.loads(languages.fit_languages(many.limit(3))).codes == []
