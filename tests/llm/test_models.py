"""The models behind the operators, on small inputs."""

import pickle
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import garble, langid, leaks, mixing, repeats, sentences
from leafmill.llm.chars import consistent, letters
from leafmill.llm.languages import _of_texts, _once

from ..conftest import SF

CLEAN = (
    "Die Prüfung der Seiten für den jährlichen Bericht. Le relevé des frais a été publié après la séance. "
    "La sección guardó las páginas según indica la guía. Городская библиотека хранит титульный лист. "
    "Każda strona została sprawdzona po drugim przebiegu. 次の会議の前に図書館は目次を保存した。 The night shift stored every form field."
)


@pytest.fixture(scope="module")
def model():
    words = CLEAN.split()
    rng = random.Random(1)
    texts = [" ".join(rng.choice(words) for _ in range(8)) for _ in range(600)]
    bad = [garble.garble(t, s) for t, s in zip(["für jährlichen Prüfung", "relevé séance été", "библиотека титульный лист"], [(("utf-8", "cp1252"),), (("utf-8", "mac_roman"),), (("utf-8", "cp1251"),)])]
    return garble.fit([*texts, *bad, None, ""])


@pytest.mark.parametrize("steps", [(("utf-8", "cp1252"),), (("utf-8", "mac_roman"),), (("utf-8", "cp437"),), (("utf-8", "cp1252"), ("utf-8", "cp1252"))])
@pytest.mark.parametrize("text", ["Prüfung für jährlichen", "séance relevé publié", "guardó páginas según"])
def test_garbled_text_is_found_and_restored(model, steps, text):
    made = garble.garble(text, steps)
    assert model.is_garbled(made) and model.restored(made) == (text, True)


def test_cyrillic_pairs(model):
    for steps in [(("utf-8", "cp1251"),), (("cp1251", "cp1252"),), (("koi8-r", "cp1251"),)]:
        made = garble.garble("Городская библиотека хранит", steps)
        assert model.is_garbled(made) and model.restored(made)[0] == "Городская библиотека хранит"


def test_clean_text_is_not_garbled(model):
    assert not any(model.is_garbled(t) for t in [CLEAN, None, "", "plain", "für\xa0den", "Bеricht der Seiten"])
    assert model.is_garbled("Pr�fung") and model.restored("Pr�fung")[1] is False
    assert not model.is_garbled("хранит " * 20_000)
    assert garble.fit([]).is_garbled("für") is False


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=40))
def test_round_trip(text):
    for steps in [(("utf-8", "cp1252"),), (("utf-8", "latin-1"),), (("utf-8", "cp437"),)]:
        made = garble.garble(text, steps)
        if made is not None and "�" not in made and not any(0x80 <= ord(c) < 0xA0 for c in text):
            assert garble.restore(made, steps) == text


@pytest.mark.parametrize(
    "text, want",
    [
        ("Mаnuals", "Manuals"), ("читaльный", "читальный"), ("Κesterνane", "Kestervane"), ("ｐаｇеｓ", "pages"), ("a соріеѕ file", "a copies file"), ("без предупреждения (x³) и а после", "без предупреждения (x³) и а после"), ("take а desk", "take a desk"), ("ﾌｫﾝﾄ", "フォント"), ("café", "café"), ("ﬁle\xa0x​y", "file xy"),
        ("В 9 г. the cat. С большой", "В 9 г. the cat. С большой"), ("m² ³ ¼ № – “x”", "m² ³ ¼ № – “x”"), ("한글", "한글"), ("⽂件", "文件"), ("ạ̇", "ạ̇"), ("ạ̇", "ạ̇"), ("", ""), (None, None),
    ],
)
def test_consistent_form(text, want):
    assert consistent([text]) == [want]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="aеοｐ é́​\xa0Ж한ﾊﾟ", max_size=12), max_size=5))
def test_consistent_form_is_stable(texts):
    once = consistent(texts)
    assert once == [consistent([t])[0] for t in texts] and consistent(once) == once
    assert all(unicodedata.is_normalized("NFC", t) for t in once)


def test_letters_of_further_scripts():
    """Look-alikes of Armenian, Cherokee, Coptic and Lisu inside Latin words; words of these scripts alone stay."""
    assert consistent(["Pհօtօ ꓢtandard ᏢDF ⲥopy", "Հայոց լեզու", "ᎠᎡᎢ ᎪᎫᎬ", "ꓐꓳꓡ Report"]) == ["Photo Standard PDF copy", "Հայոց լեզու", "ᎠᎡᎢ ᎪᎫᎬ", "ꓐꓳꓡ Report"]
    from leafmill.llm.chars import FURTHER_AS_LATIN

    assert all(unicodedata.name(a).split()[0] in ("ARMENIAN", "CHEROKEE", "COPTIC", "LISU") and b.isascii() for a, b in FURTHER_AS_LATIN.items())


def test_letters():
    assert letters("Page 1 of ２ – Größe²!") == "pageofgrösse" and letters("12 –") == ""


def test_chunks_depend_on_a_lines_letters_alone():
    lines = ["terms and conditions apply to every copy of this page and its parts", "short", "terms and conditions apply to every copy of that page and its parts", "short"]
    keys, chunks = repeats.chunks_of(lines)
    again = [repeats.chunks_of([x]) for x in lines]
    assert keys == [k[0] for k, _ in again] and chunks == [c[0] for _, c in again]
    assert keys[1] == keys[3] and keys[0] != keys[2]
    assert set(chunks[0]) & set(chunks[2]) and chunks[1] == [keys[1]]
    # in another line the same letters make the same chunks
    longer = repeats.chunks_of(["other words before " + lines[0] + " and behind"])[1][0]
    assert set(chunks[0]) <= set(longer)


@pytest.fixture(scope="module")
def languages():
    rng = random.Random(2)
    by = {"de": "die prüfung der seiten für den bericht und das werkzeug nach der sitzung", "en": "the night shift stored every form field and the cover image", "ru": "городская библиотека хранит титульный лист после второго прохода", "ja": "次の会議の前に図書館は目次を保存した"}
    rows = [(" ".join(rng.sample(t.split(), len(t.split()))), code if rng.random() > 0.1 else rng.choice(list(by))) for code, t in by.items() for _ in range(60)]
    return langid.fit(rows)


def test_languages_of_parts(languages):
    found = languages.classify(["Die Prüfung der Seiten. The night shift stored the cover image.", "городская библиотека", "12", ""])
    assert [x[2] for x in found[0]] == ["de", "en"] and [x[2] for x in found[1]] == ["ru"] and found[2] == [] and found[3] == []
    assert all(0 < x[3] <= 1 for p in found for x in p)


def brute(m, word, k):
    """The sum over all segmentations, by recursion."""
    text = "▁" + word

    def rest(i):
        if i == len(text):
            return 1.0
        total, single = 0.0, False
        for j in range(i + 1, len(text) + 1):
            n = m.ids.get(text[i:j], 0)
            if n > 0 and j - i <= 16:
                total += np.exp(m.logp[n, k]) * rest(j)
                single |= j == i + 1
        if not single:
            total += np.prod([np.exp(m.logp[1 + b, k]) for b in text[i].encode()]) * rest(i + 1)
        return total

    return rest(0)


@pytest.mark.parametrize("word", ["night", "prüfung", "библиотека", "目次", "q"])
def test_forward_algorithm(languages, word):
    want = [np.log(brute(languages, word, k)) for k in range(len(languages.codes) + 1)]
    assert np.allclose(languages._score([word])[0], want)


def test_long_words_are_summed_whole(languages):
    """Words of 40 and of 400 letters: the sums in logarithms equal those of numbers, and no letter is left out."""
    word = "prüfungsberichtsverzeichnisablageordnung"
    want = [np.log(brute_fast(languages, word, k)) for k in range(len(languages.codes) + 1)]
    assert len(word) == 40 and np.allclose(languages._score([word])[0], want)
    long = word * 10
    assert languages._score([long])[0, :-1].argmax() == languages.codes.index("de") and (languages._score([long])[0] < languages._score([word])[0]).all()
    fitted = langid.fit([("kurz und gut", "de")] * 5 + [("x" * 40 + "prüfung", "de"), ("short and good", "en"), ("the night shift", "en")] * 5)
    assert np.isfinite(fitted.logp[:257]).all() and fitted.classify(["die prüfung"])[0][0][2] == "de"


def brute_fast(m, word, k):
    """The same sum by places, in numbers."""
    text = "▁" + word
    sums = [1.0] + [0.0] * len(text)
    for i in range(len(text)):
        single = False
        for j in range(i + 1, len(text) + 1):
            if (n := m.ids.get(text[i:j])) is not None:
                sums[j] += sums[i] * np.exp(m.logp[n, k])
                single |= j == i + 1
        if not single:
            sums[i + 1] += sums[i] * np.prod([np.exp(m.logp[1 + b, k]) for b in text[i].encode()])
    return sums[-1]


FINNISH = ["Kokous pidetään kirjastossa joka viikko ja jäsenet saavat asiakirjat ajoissa", "Kaikki asiakirjat tallennetaan huolellisesti arkistoon ennen kokousta", "Jäsenet ovat tervetulleita ensi viikolla", "Tämä sivu on tarkistettu ja hyväksytty viime vuonna", "Lomake täytetään ja palautetaan kirjastoon"]


def test_rare_and_unknown_languages(spark):
    """Ten labelled rows beside very many of other languages suffice; a language without any is unknown and not sure to be another."""
    from leafmill.llm import languages as operators
    from leafmill.session import table

    blocks = table(spark, "/root/testdata/sf0.001", "text_blocks").select("doc_id", "page_no", "block_idx", "text", "language")
    more = spark.createDataFrame([(f"f{k}", 0, 0, FINNISH[k % 5], "fi-FI") for k in range(10)], blocks.schema)
    text = "Kirjaston kokous pidetään ensi viikolla ja kaikki jäsenet ovat tervetulleita. Asiakirjat tallennetaan arkistoon huolellisesti."
    turkish = "Kütüphane toplantısı gelecek hafta yapılacak ve bütün üyeler davetlidir. Belgeler dikkatle arşivlenecektir."
    without, with_finnish = (pickle.loads(operators.fit_languages(df)) for df in (blocks, blocks.unionByName(more)))
    assert without.classify([text])[0][0][2] == langid.UNKNOWN
    assert [x[2] for x in with_finnish.classify([text])[0]] == ["fi"]
    for m in (without, with_finnish):
        found = m.classify([turkish])[0]
        assert all(x[2] == langid.UNKNOWN or x[3] < 0.5 for x in found)


def test_a_label_decides_doubt_only(languages):
    assert languages.classify(["die prüfung für den bericht"], ["en"])[0][0][2] == "de"
    doubt = languages.scores(["x"])[0]
    assert abs(doubt[:-1] - doubt[0]).max() < langid.TRUST and languages.classify(["x"], ["ru"])[0][0][2] in ("ru", langid.UNKNOWN)


def test_labels():
    assert [langid.language_of_label(x) for x in ("en_US", "EN", "English", "ger", "zh-Hans", "und", "n/a", "xx", " ", "", None)] == ["en", "en", "en", "de", "zh", None, None, None, None, None, None]


def test_no_labels():
    m = langid.fit([("text", None)])
    assert m.classify(["text"]) == [[]]


def learned():
    return sentences.Periods({"Dr", "No", "p.m", "etc", "Ltd", "B", "z"}, {"The", "She", "Der"}, {"März", "Entwurf"})


@pytest.mark.parametrize(
    "text, want",
    [
        ("One. Two! Three?", ["One.", "Two!", "Three?"]),
        ("Dr. Brix came at 9 p.m. The door etc. was shut.", ["Dr. Brix came at 9 p.m.", "The door etc. was shut."]),
        ("He wrote, “Send it. Do not print it,” and left. She ran.", ["He wrote, “Send it. Do not print it,” and left.", "She ran."]),
        ("“Stop!” she said. The end.", ["“Stop!” she said.", "The end."]),
        ("It cost $ 9.10 in v1.2.pdf. (See No. 3.) The end", ["It cost $ 9.10 in v1.2.pdf.", "(See No. 3.)", "The end"]),
        ("Der 9. Entwurf kam am 3. März. Der Rest z. B. nicht.", ["Der 9. Entwurf kam am 3. März.", "Der Rest z. B. nicht."]),
        ("Wait... is it? Yes … No", ["Wait... is it?", "Yes …", "No"]),
        ("Heading\n\nBody of\ntext. More", ["Heading", "Body of\ntext.", "More"]),
        ("Steps:\n1. Open\n2. Close it. Then\nwait\n\nEnd", ["Steps:", "1. Open", "2. Close it. Then\nwait", "End"]),
        ("Steps:\n- a\n- b", ["Steps:", "- a", "- b"]),
        ("処理を止めて！「止めて！」と係が言った。次。", ["処理を止めて！", "「止めて！」と係が言った。", "次。"]),
        ("“第9页签字了吗？”管理员问道。停。", ["“第9页签字了吗？”管理员问道。", "停。"]),
        ("“준비되었습니까?” 하고 물었다. 멈추십시오!", ["“준비되었습니까?” 하고 물었다.", "멈추십시오!"]),
        ("सारांश है। कतार रोक दीजिए!", ["सारांश है।", "कतार रोक दीजिए!"]),
        ("ฝ่ายเอกสารเรียงลำดับ หอจดหมายเหตุเปลี่ยน", ["ฝ่ายเอกสารเรียงลำดับ", "หอจดหมายเหตุเปลี่ยน"]),
        ("La note dit : « Ne pas imprimer. » Qui l’a vu ?", ["La note dit : « Ne pas imprimer. »", "Qui l’a vu ?"]),
        ("any warning.By contrast it ran.", ["any warning.", "By contrast it ran."]),
        ("", []), (" \n\n ", []), (None, []),
    ],
)
def test_sentences(text, want):
    assert [text[a:b] for a, b in sentences.sentences(text, learned())] == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB. !?。“”\"'()\n-1„«» Ж字", max_size=60))
def test_sentences_cover_all_but_white_space(text):
    found = sentences.sentences(text, learned())
    assert all(a < b for a, b in found) and all(b <= c for (_, b), (c, _) in zip(found, found[1:]))
    outside = set(range(len(text))) - {i for a, b in found for i in range(a, b)}
    assert all(text[i].isspace() for i in outside)
    assert all(not text[a].isspace() and not text[b - 1].isspace() for a, b in found)


def test_long_text_without_closing_quotes():
    assert len(sentences.sentences("“a b. " * 20_000, learned())) >= 1


def test_long_quotes():
    """A quote of more than 3,000 characters with a frame is one sentence; opening signs without an end are no quotes."""
    inside = "It rained. " * 300
    text = f"The clerk said: “{inside.strip()}” and left. It was late."
    assert [text[a:b][-9:] for a, b in sentences.sentences(text, learned())] == ["and left.", "was late."]
    assert len(sentences.sentences("“It rained. She left. The end.", learned())) == 3


def test_abbreviations_are_learned():
    rng = random.Random(3)
    from collections import Counter

    c, pairs = Counter(), Counter()
    for _ in range(400):
        words = [rng.choice(["paper", "desk", "plan", "clerk", "sheet"]) for _ in range(12)]
        sentences.count_pairs(f"The {' '.join(words[:6])} of vol. {rng.randint(1, 99)} {' '.join(words[6:])} {rng.choice(words)}. Dr. Vost came approx. {rng.randint(1, 9)} times {words[0]}.", pairs)
    for (a, b), n in pairs.items():
        sentences.count_types(a, b, n, c)
    rows, total = {}, {}
    for (w, what), n in c.items():
        (rows.setdefault(w, {}) if w else total)[what] = n
    found = sentences.abbreviations(rows, total)
    assert {"vol", "Dr", "approx"} <= found and not found & {"paper", "desk", "plan", "clerk", "sheet"}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(1, 3)), min_size=1, max_size=6, unique_by=lambda x: x[0]), st.integers(0, 60))
def test_knapsack_is_the_best(items, budget):
    lengths, counts = [x for x, _ in items], [n for _, n in items]
    got = mixing.knapsack(lengths, counts, budget)
    reach = {0}
    for x, n in items:
        reach = {r + k * x for r in reach for k in range(n + 1)}
    assert all(0 <= g <= n for g, n in zip(got, counts))
    assert sum(g * x for g, x in zip(got, lengths)) == max(r for r in reach if r <= budget)


def test_large_budgets_are_met_to_the_token():
    rng = np.random.default_rng(7)
    lengths = np.unique(rng.integers(300, 4_000_000, 1500))
    counts = rng.integers(1, 40, len(lengths))
    budget = int((lengths * counts).sum() * 3 // 7)
    times, extra = mixing.plan(lengths, counts, budget, 3)
    assert times == 0 and (extra <= counts).all() and int((extra * lengths).sum()) == budget
    even = [x * 2 for x in (700_000, 1_300_003, 999_983)]
    got = mixing.knapsack(even, [3, 3, 3], 10_000_001)
    best = max(a * even[0] + b * even[1] + c * even[2] for a in range(4) for b in range(4) for c in range(4) if a * even[0] + b * even[1] + c * even[2] <= 10_000_001)
    assert sum(g * x for g, x in zip(got, even)) == best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 300), st.integers(1, 50)), min_size=1, max_size=30, unique_by=lambda x: x[0]), st.floats(0, 4), st.integers(0, 3))
def test_plans_keep_the_budget(items, part, most):
    lengths, counts = np.array([x for x, _ in items]), np.array([n for _, n in items])
    total = int((lengths * counts).sum())
    budget = int(total * part)
    times, extra = mixing.plan(lengths, counts, budget, most)
    taken = times * total + int((extra * lengths).sum())
    assert (extra >= 0).all() and (extra <= counts).all() and times + (extra.max() > 0) <= most or taken == 0
    assert taken <= budget and (taken == times * total if times == most else budget - taken <= max(lengths))


def test_leak_windows():
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(50)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(40))) for k in range(6)] + [(9, None), (10, "short")]
    found = [leaks.items_of(items)]
    texts = [None, "", "w1 w2"]
    want = set()
    for k in range(80):
        item = rng.randrange(6)
        words = items[item][1].split()
        n = rng.choice([11, 12, 13, 20])
        at = rng.randrange(40 - n + 1)
        texts.append(" ".join([rng.choice(vocabulary) for _ in range(rng.randrange(30))] + words[at : at + n] + [rng.choice(vocabulary) for _ in range(5)]).upper())
    for t, text in enumerate(texts):
        own = (text or "").lower().split()
        for item, passage in items:
            words = (passage or "").split()
            grams = {tuple(words[k : k + 13]) for k in range(len(words) - 12)}
            if any(tuple(own[k : k + 13]) in grams for k in range(len(own) - 12)):
                want.add((t, item))
    assert {(t, i) for t, i, *_ in leaks.leaked(found, texts, 0)} == want and want


@pytest.mark.parametrize("kind", ["substitution", "insertion", "deletion"])
@pytest.mark.parametrize("n", [1, 2])
def test_leaks_with_edits_reach_the_recall(kind, n):
    """400 items of one window each, so that no other window helps."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(3000)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(13))) for k in range(400)]
    texts = []
    for _, p in items:
        words = p.split()
        for _ in range(n):
            at = rng.randrange(1, len(words) - 1)
            if kind == "substitution":
                words[at] = rng.choice(vocabulary)
            elif kind == "insertion":
                words.insert(at, rng.choice(vocabulary))
            else:
                del words[at]
        texts.append(" ".join([rng.choice(vocabulary) for _ in range(20)] + words + [rng.choice(vocabulary) for _ in range(20)]))
    hits = {(t, i) for t, i, *_ in leaks.leaked([leaks.items_of(items)], texts, 2)} & {(k, k) for k in range(400)}
    assert len(hits) >= 0.95 * len(items)


def test_edit_distance():
    a = np.array([[1, 2, 3, 4], [1, 2, 3, 4], [1, 2, 3, 4]])
    assert leaks.edits(a, np.array([[1, 2, 3, 4], [2, 3, 4, 5], [1, 9, 3, 4]])).tolist() == [0, 1, 1]
    b = np.array([[1, 2, 3, 4, 5, 6], [1, 3, 4, 7, 8, 9], [1, 9, 2, 3, 9, 4]])
    assert leaks.edits(a, b, 2).tolist() == leaks.verified(a, b, 2).tolist() == [0, 1, 2]
    # against the whole table
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 4, (300, 7)), rng.integers(0, 4, (300, 9))

    def plain(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            new = [i]
            for j, d in enumerate(y, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return min(row)

    want = [min(3, plain(x, y)) for x, y in zip(a.tolist(), b.tolist())]
    assert np.minimum(leaks.edits(a, b, 2), 3).tolist() == want == np.minimum(leaks.verified(a, b, 2), 3).tolist()


def test_long_tokens_are_labelled_whole():
    """Texts without spaces of 600 and of 60,000 characters, garbled in the middle or as a whole, and clean."""
    words = "次の会議の前に図書館は目次を保存した。この文書は来年の春に公開される予定です。町の図書館が新しい本を買いました。"
    rng = random.Random(8)
    text = "".join(rng.choice(words) for _ in range(60_000))
    model = garble.fit([text[k : k + 40] for k in range(0, 20_000, 40)] + ["Die Prüfung für den jährlichen Bericht"] * 50)
    steps = (("utf-8", "cp1252"),)
    for size in (200, 20_000):
        clean = text[:size]
        bad = garble.garble(clean, steps)
        assert len(bad) >= 600 and model.restored(bad) == (clean, True)
        mixed = clean + garble.garble(text[size : size + 50], steps) + clean
        assert model.restored(mixed) == (clean + text[size : size + 50] + clean, True)
        assert not model.is_garbled(clean)


def test_emissions_are_those_of_each_token():
    """Against brute force; what a task gives is less than half of the rows that they are spread to, and only inverses that may be tokens are asked for."""
    texts = pq.read_table(f"{SF}/text_blocks.parquet", columns=["text"])["text"].to_pylist()
    count = Counter(t for text in texts for t in garble.tokens(text or "") if t) + Counter({"ß\x02ж": 3, "\x02é": 60, "é\x85": 1, "für\x81日本": 2})
    want = Counter()
    for token, n in count.items():
        for s, steps in enumerate([(), *garble.STEPS]):
            made = garble.garble(token, steps)
            if made is not None and (not s or made != token):
                for ab in zip("\x02" + made, made):
                    if not s or ab[1] != "\x02":
                        want[s, *ab] += min(n, 50) * garble.STEP
    words = list(count)
    parts = [garble.emissions(words[i::3], [count[t] * garble.STEP for t in words[i::3]]) for i in range(3)]
    states, keys, sums = garble.spread(*(np.concatenate(x) for x in zip(*parts)))
    assert {(s, *garble.pair(k)): n for s, k, n in zip(states.tolist(), keys.tolist(), sums.tolist())} == want and len(states) == len(want)
    assert len(garble.emissions(words, [garble.STEP] * len(words))[0]) < len(want) / 2
    for token in words:
        assert garble.inverses(token) == {x for steps in garble.STEPS if (x := garble.restore(token, steps)) is not None} - {token}
    keys, sums = garble.pairs_of(words, [count[t] * garble.STEP for t in words])
    improving = garble.Improving({garble.pair(k): n / garble.STEP for k, n in zip(keys.tolist(), sums.tolist())})
    asked = [x for t in words if isinstance(found := improving.decided(t), list) for x in found]
    assert all(set(zip("\x02" + b, b)) <= improving.usual.keys() for a, b in asked if len(a) > 2)


def test_letters_and_parts_are_those_of_the_patterns():
    """Against the plain patterns; a text is read once for its weight and its letters."""
    ends, rng = re.compile(r"(?<=[.!?؟।])(?=[\s\"”»“)])\s*|(?<=[。！？])|\n+"), random.Random(3)
    for _ in range(5_000):
        text = "".join(rng.choice('.!?؟।。！？\n \t"”»“)ab1_\x1f\u3000é゛・か한٣') for _ in range(rng.randint(0, 12)))
        kept = re.sub(r"[\W\d_]+", "", text)
        assert langid.n_letters(text) == len(kept) and langid.weight(text) == len(kept) + len(re.findall("[぀-鿿가-힣]", kept))
        cut = list(dict.fromkeys(m.end() for m in ends.finditer(text) if 0 < m.end() < len(text)))
        assert langid._parts(text) == list(zip([0, *cut], [*cut, len(text)]))
    before = langid._letters.cache_info().misses
    assert langid.weight("für alle Fälle") + langid.n_letters("für alle Fälle") == 24 and langid._letters.cache_info().misses == before + 1


def test_words_parts_and_letters_of_many_texts_are_those_of_each():
    """Texts that are searched as one against the plain patterns; among them what the text between them is made of."""
    rng = random.Random(7)
    for _ in range(1_000):
        texts = ["".join(rng.choice(".!?؟।。！？\n \t\"”»“)ab1_\x1f　é゛・か한٣\0ΣσΑ'İK漢字ーıß½²Ⅷ\ud800\u0307カA") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 8))]
        assert langid.words_of_texts(texts) == [" ".join(langid.WORDS.findall(t.lower())) for t in texts]
        first, begins, ends = langid._parts_of_all(texts)
        start, letters, weights = langid.sums_of_letters(texts)
        for t, k, of, x in zip(texts, start.tolist(), first.tolist(), [*first[1:].tolist(), len(begins)]):
            cut = list(dict.fromkeys(m.end() for m in langid._ENDS.finditer(t) if 0 < m.end() < len(t)))
            assert list(zip(begins[of:x], ends[of:x])) == list(zip([0, *cut], [*cut, len(t)]))
            assert (letters[k + len(t)] - letters[k], weights[k + len(t)] - weights[k]) == (langid.n_letters(t), langid.weight(t))


def test_equal_texts_are_looked_at_once(languages):
    """Also over batches; what is kept is bounded, and each text has what it has alone."""
    known, asked = {}, []

    def find(records):
        asked.extend(records)
        return _of_texts(languages, None, records)

    texts = ["Der Wind kam aus dem Norden.", "x", None, "", "Der Wind kam aus dem Norden.", "The house of the king was old. " * 9]
    for _ in range(2):
        found = _once(known, [(t, "de") for t in texts], find)
        assert found == [_of_texts(languages, None, [(t, "de")])[0] for t in texts]
    assert len(asked) == 6 and len([t for t, _ in asked if t and len(t) > 200]) == 2
