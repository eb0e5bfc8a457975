"""The operators against brute force, exact round trips and held-out accuracy, and on nulls, empties, ties and clashing columns."""

import os
import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lipigraph.llm import langid, leakage, lookalike, mixing, pairs, pii, safety
from lipigraph.llm.roman import romanise

DIR = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


# Look-alikes
def rewriter(*texts):
    return lookalike.Lookalikes(lookalike.classes_of(lookalike.count_units(texts)))


def test_confusables_by_the_public_table(spark):
    twins = lookalike.confusables(spark, "ᎪꓐⲟΙмωक०ا" + "a")
    assert {c: twins.get(c) for c in "ᎪꓐⲟΙ"} == {"Ꭺ": "A", "ꓐ": "B", "ⲟ": "o", "Ι": "I"} and not set("мक०اa") & set(twins)
    rewrite = lookalike.Lookalikes(lookalike.classes_of(lookalike.count_units(["ꓐank Ꭺ Bonds An owl"]), twins), twins)
    assert rewrite("ꓐⲟnd") == "Bond"


def test_clusters_of_any_length():
    rewrite = rewriter("plain")
    long = "e" + "\u0323\u0301" * 30
    assert rewrite(long) == unicodedata.normalize("NFC", long) and rewrite("न\u093c") == "\u0929" and rewrite("क़") == "क़"


def test_lookalike_forms():
    odd = ["Ｗard", "wаrd", "wa​rd", "a ward", "a­b", "Dāndā", "résumé", "अाज", "क़", "νisit"]
    r = rewriter(*["ward a visit is usual here"] * 9, "Dāndā", "résumé", "क़", "आज", *odd)
    assert [r(t) for t in odd] == ["Ward", "ward", "ward", "a ward", "ab", "Dāndā", "résumé", "आज", "क़", "visit"]
    for t in ("गर्‍यो", "“quoted” – dash…", "Dāndā é", "१२३", "tab\tline\n", "", None):
        assert r(t) == t
    assert r("क‍ख") == "कख"


def test_genuine_other_script_stays():
    r = rewriter("ward desk", "Это дом в городе", "wаrd")
    assert r("Это дом в городе") == "Это дом в городе" and r("wаrd") == "ward"


def test_frequency_chooses():
    assert rewriter("ооо", "oo").patterns.get("o") == "о"


@given(st.text(max_size=40))
@settings(max_examples=200)
def test_rewrite_is_stable_and_composed(s):
    r = rewriter(s, "plain words")
    once = r(s)
    assert r(once) == once
    if r.suspect.search(s):
        assert unicodedata.is_normalized("NFC", once)


def test_consistent_on_tables(spark):
    rows = [("1", "wаrd", None, "a"), ("2", "ward", "x y", "b"), ("3", None, "", "c"), ("1", "wаrd", None, "a"), (None, "​", "ward " * 50_000 + "wаrd", "d")]
    df = spark.createDataFrame(rows, "id string, a string, b string, changed string")
    m = lookalike.model((df, ["a", "b"]))
    got = [(r.row_id, r.field) for r in lookalike.consistent(df, "id", ["a", "b"], m, True).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [("1", "a"), ("1", "a"), (None, "a"), (None, "b")]))
    assert lookalike.consistent(df.limit(0), "id", ["a"], lookalike.model((df.limit(0), ["a"]))).count() == 0


# Personal information
NAMES = pii.Names({pii.skeleton(x) for x in ("Rupsen", "Asmika", "Jamuni")}, {pii.skeleton(x) for x in ("Sangroti", "Tarvani", "Waibesh")})


@given(st.integers(1, 10**6), st.data())
@settings(max_examples=100)
def test_feistel_permutes(n, data):
    f = pii.Feistel(b"k")
    x = data.draw(st.integers(0, n - 1))
    y = f.permute(x, n)
    assert 0 <= y < n and f.permute(y, n, back=True) == x


def test_feistel_is_a_bijection_and_keyed():
    f = pii.Feistel(b"k")
    assert sorted(f.permute(x, 777) for x in range(777)) == list(range(777))
    assert f.digits("012345") != pii.Feistel(b"other").digits("012345") and f.digits(f.digits("012345"), back=True) == "012345"
    assert f.date(2081, 13, 1) is None and f.date(2081, 2, 33) is None


@given(st.integers(1900, 2099), st.integers(1, 12), st.integers(1, 32))
def test_dates_of_a_century_are_permuted(year, month, day):
    import calendar

    f = pii.Feistel(b"k")
    y, m, d = f.date(year, month, day)
    assert y // 100 == year // 100 and 1 <= m <= 12 and 1 <= d <= 32 and f.date(y, m, d, back=True) == (year, month, day)
    # A day of the civil calendar stays one.
    assert (day <= calendar.monthrange(year, month)[1]) == (d <= calendar.monthrange(y, m)[1])


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("Write to a.b@c.example or ring 9812345678", {"email", "phone"}), ("a (at) b.example", {"email"}), ("a.b [at] c [dot] example", {"email"}), ("+९७७ ९८७२३ ४६५१८", {"phone"}), ("(01) 037 4329", {"phone"}), ("01-0552590", {"phone"}),
        ("national ID 9742234567", {"id"}), ("नागरिकता नं. 71/8151/7053", {"id"}), ("राहदानी अङ्क qx ९६९०५४४", {"id"}), ("personal tax no. 987 791 233", {"id"}), ("report for 05-04-2081", set()), ("Dispatch no. 3173-4640", set()), ("case LM-100031", set()), ("short code 188", set()), ("NPR 4,500", set()),
        ("H.N. 463, Ratniphedi galli, Khimtunagar 7", {"address"}), ("घ.नं. ४२८, तिन्पाखोला गल्ली, झोलाडाँडा १२", {"address"}), ("47 Nagduphedi Lane, ward 7, Tinpabesi", {"address"}), ("तिन्पाबेसी वडा ७, नाग्दुफेदी गल्ली ४७", {"address"}), ("flat 10B, Bakhubesi Road 121, Bakhudada", {"address"}), ("वडा ४ मा सडक बत्ती", set()), ("Ward No. 4", set()),
        ("RUPSEN SANGROTI", {"name"}), ("Tarvani, Asmika", {"name"}), ("रुपसेन साङरोटीको बयान", {"name"}), ("Mr Jamuni K. Waibesh", {"name"}), ("Tarvani Chowk", set()), ("Asmika programme", set()), ("[NAME] and [PHONE]", set()), ("９８１２３４５６７８", {"phone"}), ("rup​sen sangroti", {"name"}), ("", set()),
    ],
)
def test_pii_kinds(text, kinds):
    assert set(pii.redact(text, NAMES, pii.Feistel(b"k"))[1]) == kinds


def test_redaction_keeps_the_rest_and_links():
    f = pii.Feistel(b"k")
    text, kinds = pii.redact("Ｎｏｔe: ring 981-2345678 or +977-9812345678, not 9812345679.", NAMES, f)
    assert text.startswith("Ｎｏｔe: ring [PHONE 98") and kinds == ["phone"]
    a, b, c = ("".join(x for x in p.split("]")[0] if x.isdigit()) for p in text.split("[PHONE ")[1:])
    assert a == b.removeprefix("977") and a != c
    assert pii.redact(text, NAMES, f) == (text, []) and pii.redact(None, NAMES, f) == (None, [])
    assert pii.redact("RUPSEN  SANGROTI", NAMES, f)[0] == pii.redact("Sangroti, Rupsen", NAMES, f)[0]
    dated = pii.redact("वडा ५ मा २०४१-०२-०३ र ५०० रुपैयाँ, 9/4/2041", NAMES, f, dates=True)[0]
    new, other = (x.split("]")[0] for x in dated.split("[DATE ")[1:])
    assert dated == f"वडा ५ मा [DATE {new}] र ५०० रुपैयाँ, [DATE {other}]" and not new.isascii() and other.isascii()
    assert f.date(*map(int, new.split("-")), back=True) == (2041, 2, 3)
    assert pii.redact("on 2041-13-03, [ID 2041-02-03]", NAMES, f, dates=True)[0] == "on 2041-13-03, [ID 2041-02-03]"


def test_pseudonyms_link_equal_values_alone():
    f = pii.Feistel(b"k")
    tag = lambda x, kind="name": pii.pseudonym(x, kind, f)
    assert len({tag(x) for x in ("Sita Rana", "Sati Rani", "Suta Rina", "Rana Sita")}) == 4
    assert tag("Sita Rana") == tag("SITA  RANA") == tag("Rana, Sita") == tag("Sitaa Rana") and len(tag("Sita Rana")) == len("[NAME ]") + 24
    assert tag("H.N. 463, X Lane", "address") == tag("House No 463, x lane", "address") != tag("H.N. 464, X Lane", "address")
    assert tag("a (at) b [dot] c", "email") == tag("A@b.c", "email") == tag("a at b dot c", "email") != tag("a@b.d", "email")
    assert len({tag(f"{i}@x.org", "email") for i in range(2000)}) == 2000 and tag("a@b.c", "email") != pii.pseudonym("a@b.c", "email", pii.Feistel(b"m"))
    # Numbers that nobody can have are no part of the permutation.
    assert tag("9812345678", "phone").startswith("[PHONE 98") and tag("0000000000", "phone") != "[PHONE 0000000000]" and len(tag("00000000", "id")) > 24


def test_pii_on_tables(spark):
    rows = [("1", "Mail rupsen.sangroti@a.example", "x"), ("2", "Rupsen Sangroti signed", "x"), ("3", None, None), ("2", "Rupsen Sangroti signed", "x"), ("4", "word " * 50_000 + "9812345678", "x")]
    df = spark.createDataFrame(rows, "id string, t string, types string")
    names = pii.learn_names([df.select("t")])
    got = sorted((r.row_id, tuple(r.types)) for r in pii.find_pii(df, "id", "t", names, b"k").collect())
    assert got == [("1", ("email",)), ("2", ("name",)), ("2", ("name",)), ("4", ("phone",))]
    assert pii.find_pii(df, "id", "t", names, b"k", found_only=False).count() == 5
    assert pii.find_pii(df.limit(0), "id", "t", pii.learn_names([df.select("t").limit(0)]), b"k").count() == 0
    # A lexicon above the bound is joined, with the same results.
    table = pii.learn_names([df.select("t")], most=1)
    assert sorted((r.row_id, tuple(r.types)) for r in pii.find_pii(df, "id", "t", table, b"k").collect()) == got


@pytest.mark.parametrize("cue", ["Dr Rupsen Sangroti", "Prof. Rupsen Sangroti", "Miss Rupsen Sangroti", "Shree Rupsen Sangroti", "श्रीमती रुपसेन साङरोटी", "डा. रुपसेन साङरोटी", "write to rupsen.sangroti at office dot example", "rupsen.sangroti[AT]a.example", "rupsen.sangroti＠a.example"])
def test_every_cue_teaches_names(cue):
    parts = set(pii.name_parts(cue))
    assert {x for r, x in parts if r.endswith("given")} == {pii.skeleton("Rupsen")} and {x for r, x in parts if r.endswith("family")} == {pii.skeleton("Sangroti")}


# Languages
@pytest.fixture(scope="module")
def samples():
    import pandas as pd

    s = pd.read_parquet(f"{DIR}/lang_samples.parquet").sort_values("sample_id")
    return list(zip(s.text, s.lang, strict=True))


@pytest.fixture(scope="module")
def model(samples):
    return langid.train([x for i, x in enumerate(samples) if i % 3])


@needs_data
def test_held_out_languages(samples, model):
    held = [x for i, x in enumerate(samples) if not i % 3]
    assert sum(model.predict(langid.words_of(t))[0] == y for t, y in held) >= 0.99 * len(held)
    roman = [(romanise(t), y) for t, y in held if y == "ne"]
    assert sum(model.predict(langid.words_of(t))[0] == y for t, y in roman) >= 0.95 * len(roman)


@needs_data
def test_mislabelled(spark, samples, model):
    by = {y: [t for t, z in samples if z == y] for y in ("en", "ne", "tmg")}
    docs = [("a", "en", "l"), ("b", None, "l"), ("c", "hi", "l"), ("d", "English (GB)", "l"), ("e", "und", "l"), ("f", "en", "l")]
    seg = [(f"a{i}", "a", by["en"][i]) for i in range(4)] + [("ax", "a", by["ne"][0]), ("ay", "a", by["en"][5] + " " + by["tmg"][0])]
    seg += [("b0", "b", by["tmg"][1]), ("c0", "c", by["ne"][2]), ("d0", "d", by["en"][7]), ("e0", "e", "12 34"), ("e1", "e", None), ("a9", "a", "KF-10 9812345678 https://a.org"), ("ax", "a", by["ne"][0])]
    d = spark.createDataFrame(docs, "id string, source_lang string, lang string")
    s = spark.createDataFrame(seg, "id string, document_id string, source_text string").withColumn("lang", F.lit("x"))
    got = {(r.record_level, r.row_id, r.lang) for r in langid.find_mislabelled(d, s, model).collect()}
    assert got == {("document", "b", "tmg"), ("document", "c", "ne"), ("segment", "ax", "ne"), ("segment", "ay", "en+tmg")}
    assert langid.find_mislabelled(d.limit(0), s.limit(0), model).count() == 0
    assert langid.find_mislabelled(d, s, langid.train([])).count() == 0


@needs_data
def test_every_language(spark, samples, model):
    by = {y: [t for t, z in samples if z == y] for y in ("en", "ne", "tmg")}
    d = spark.createDataFrame([("right", "en"), ("mixed", "en"), ("bare", "en"), ("none", None)], "id string, source_lang string")
    seg = [("r0", "right", by["en"][0]), ("m0", "mixed", by["en"][1]), ("m1", "mixed", by["en"][2]), ("m2", "mixed", by["ne"][0]), ("m3", "mixed", "12 34"), ("m4", "mixed", "Notice board"), ("m5", "mixed", None), ("b0", "bare", "12 34")]
    s = spark.createDataFrame(seg, "id string, document_id string, source_text string")
    got = {(r.record_level, r.row_id): (r.lang, r.confidence) for r in langid.find_languages(d, s, model).collect()}
    assert set(got) == {("document", x) for x in ("right", "mixed", "bare", "none")} | {("segment", f"m{i}") for i in range(6)}
    assert got["document", "right"][0] == got["document", "mixed"][0] == got["segment", "m0"][0] == got["segment", "m4"][0] == "en" and got["segment", "m2"][0] == "ne"
    assert all(got[k] == (None, 0.0) for k in [("document", "bare"), ("document", "none"), ("segment", "m3"), ("segment", "m5")])
    assert all(0.3 < p <= 1 for x, p in got.values() if x)
    assert {(r.lang, r.confidence) for r in langid.find_languages(d, s, langid.train([])).collect()} == {(None, 0.0)}


# Pairs
@needs_data
def test_defects(model):
    read = pairs.PairReader(model)
    src = "The charge for the tenancy letter in Thumkabari is NPR 6,700 and is paid at the health post."
    good = "थुम्काबारीमा बहाल पत्रको दस्तुर रु. ६,७०० हो र स्वास्थ्य चौकीमा तिरिन्छ।"
    first = lambda c, s=src, t="ne": (read(s, c, t)[0] or [None])[0]
    assert first(good) is None and first(good[:-1]) is None
    for c in ("", None, " \t", "N/A", "[]", "(no translation)", "…", "​"):
        assert first(c) == "empty"
    for c in ("I'm sorry, but I can't help with that request.", "MY GUIDELINES DO NOT ALLOW ME TO HELP.", "माफ गर्नुहोस्, म यो पाठ अनुवाद गर्न सक्दिनँ।", "सेम आनागो, ङासे चु गे लाबारी आखाम।"):
        assert first(c) == "refusal"
    for c in (src, src.upper(), "[ne] " + src, f"{src} {src}"):
        assert first(c) == "copied"
    assert first("थुम्काबारीरी दिम तिबा छिठीला दस्तुर रु. ६,७०० हिन्ना, थेदा मन लाबा दिमरी फाला।") == "wrong_language"
    assert first("", "12.4") is None and first("12.4", "12.4") is None and first("x", None) is None and read(good[:30], good[:30], None)[0] is not None


@needs_data
def test_truncation_on_tables(spark, samples, model):
    en = [t for t, y in samples if y == "en"][:60]
    rows = [(f"s{i}", t, t.replace(" the ", " that ") + "", "en") for i, t in enumerate(en)]
    rows += [("cut", en[0], en[0][: len(en[0]) // 2] + "…", "en"), (None, None, None, None), ("head", "Notice about the flood warning service here", "Flood notice now", "en")]
    df = spark.createDataFrame(rows, "segment_id string, source_text string, candidate_text string, target_lang string").withColumn("types", F.lit(1))
    got = {r.segment_id: r.types for r in pairs.find_defects(df, model).collect()}
    assert "truncated" in got["cut"] and "head" not in got and pairs.find_defects(df.limit(0), model).count() == 0


def test_truncation_by_marks_alone():
    off = pairs.broken_off
    assert off("a (b).", "क (ख", True) and off("It ends.", "यो…", True) and off("one, two", "एक,", False) and off('a "b"', 'क "ख', False)
    assert not off("a (b", "क (ख", True) and not off("It ends.", "यो सकियो", True) and not off("Remarks", "कैफियत:", False) and off("The whole is here.", "सबै -", True)


def test_reports_of_attempts(spark):
    rows = [("a", "Response longer than limit"), ("a", "read timeout"), ("a", None), (None, "truncated"), ("b", None)]
    got = pairs.reported(spark.createDataFrame(rows, "segment_id string, error string")).collect()
    assert sorted(map(tuple, got)) == [("a", 2, 1), ("b", 0, 0)]


# Leakage
@given(st.lists(st.text("abc ", min_size=3, max_size=6), min_size=1, max_size=8), st.text("abc ", max_size=60))
@settings(max_examples=200)
def test_wu_manber_is_exact(patterns, text):
    want = {(i, p) for p in set(patterns) for i in range(len(text)) if text.startswith(p, i)}
    assert set(leakage.WuManber(patterns).search(text)) == want


def test_passages():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(6))
    items = [(i, "Read and answer. " + " ".join(word() for _ in range(60))) for i in range(20)]
    f = leakage.LeakFinder(*leakage.prepare(items))
    own = items[3][1].split()
    noise = lambda n: " ".join(word() for _ in range(n))
    assert f.find(noise(20) + " " + " ".join(own[20:36]).upper() + " " + noise(9)) == {3}
    changed = own[10:40]
    for k in (4, 13, 22):
        changed[k] = word()
    assert f.find(noise(5) + " " + ", ".join(changed)) == {3}
    numbered = "\n".join(f"{i}) " + " ".join(own[j : j + 8]) for i, j in enumerate(range(5, 45, 8), 1))
    assert f.find(numbered) == {3} and f.find(items[7][1] + items[3][1]) == {3, 7}
    assert f.find(noise(9) + " " + " ".join(own[20:32])) == set() and f.find("Read and answer. " + noise(40)) == set()
    assert f.find(None) == f.find("") == set()


def test_replaced_words_are_judged_by_what_they_were():
    rng = random.Random(6)
    form = "when file {} vanished from the office of {} a porter from {} swore that the families there had left the paper under shelf {} and went home again"
    place = lambda: "".join(rng.choice("klmnoprstuv") for _ in range(8))
    items = [(i, form.format(1000 + i, place(), place(), 2000 + i)) for i in range(20)]
    own = items[3][1].split()
    swap = lambda words, at: " ".join({k: v for k, v in at}.get(k, w) for k, w in enumerate(words))
    one, other = swap(own, [(14, "zzz")]), swap(own, [(2, "47"), (8, place()), (12, place()), (24, "58")])
    # The same item, or nearly so, under a second id.
    for more in ([], [(99, items[3][1])], [(99, items[3][1] + " today")]):
        f = leakage.LeakFinder(*leakage.prepare(items + more))
        assert f.find(one) == {3, *(i for i, _ in more)} and f.find(other) == set()


def test_leaks_on_tables(spark, monkeypatch):
    text = " ".join(f"w{i}x" for i in range(40))
    docs = spark.createDataFrame([(1, text, 5), (2, None, 5), (1, text, 5), (3, "filler " * 50_000 + text, 5)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(9, text), (8, None), (7, "other words entirely")], "item_id long, text string")
    want = [(1, 9), (1, 9), (3, 9)]
    assert sorted(map(tuple, leakage.find_leaks(docs, items).collect())) == want
    monkeypatch.setattr(leakage, "CHARS_PER_PASS", 100)
    assert sorted(map(tuple, leakage.find_leaks(docs, items).collect())) == want
    assert leakage.find_leaks(docs, items.limit(0)).count() == 0 == leakage.find_leaks(docs.limit(0), items).count()


def test_leaks_do_not_depend_on_blocks(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(6))
    line = "Read the whole of the following passage with care and then answer every question that stands below it in full"
    items = [(i, f"{line}. " + " ".join(word() for _ in range(40))) for i in range(12)]
    own = items[2][1].split()
    texts = [line, " ".join(own[-20:]), f"{line} {' '.join(word() for _ in range(30))}", " ".join([*own[-20:-8], word(), *own[-7:]])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    told, common = leakage.prepared(table)
    here, usual = leakage.prepare(items)
    assert common == usual and sorted((r.item_id, tuple(r.words), r.shared) for r in told.collect()) == sorted((x.id, tuple(x.words), x.shared) for x in here)
    for size in (10**9, 1000, 400):
        monkeypatch.setattr(leakage, "CHARS_PER_PASS", size)
        assert sorted(map(tuple, leakage.find_leaks(docs, table).collect())) == [(1, 2), (3, 2)]


# Mixing
@given(st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.floats(0, 1), st.integers(0, 1000), st.integers(0, 5)), min_size=1), st.floats(0, 5000))
@settings(max_examples=200)
def test_water_filling(sources, total):
    due = mixing.water_fill(total, sources)
    assert all(due[s] <= size * cap + 1e-6 for s, (_, size, cap) in sources.items())
    room = sum(size * cap for share, size, cap in sources.values() if share > 0)
    assert abs(sum(due.values()) - min(total, room)) < 1e-6 * max(1, total) + 1e-6
    free = [due[s] / share for s, (share, size, cap) in sources.items() if share > 1e-9 and due[s] < size * cap - 1e-6]
    assert not free or max(free) - min(free) <= 1e-6 * max(1.0, max(free))


@pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="no vocabulary")
def test_mixture(spark):
    rows = [(i, "ab"[i % 10 == 0] if i % 7 else None, f"text number {i} " * (i % 5 + 1), 1) for i in range(2000)] + [(2000, "c", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, u int")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 3), ("c", 0.1, 2), ("z", 0.0, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(docs, targets)
    got = {r.source: r for r in mixing.shares(mixed, targets).collect()}
    assert got["b"].most_copies <= 3 and got["a"].most_copies == 1 and got["c"].tokens == 0 and got["z"].n_documents == 0
    again = mixing.mix(docs, targets)
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, again.collect()))
    half = mixing.mix(docs, targets, total=4000)
    by = {r.source: r.tokens for r in mixing.shares(half, targets).collect()}
    assert abs(by["a"] - 4000 * 0.5 / 0.9) < 40 and abs(by["b"] - 4000 * 0.4 / 0.9) < 40
    assert mixing.mix(docs.limit(0), targets).count() == 0


# Safety
def naive_kernel(s, t, decay=safety.DECAY):
    from itertools import combinations

    total = 0.0
    for n, w in ((1, 0.2), (2, 1.0), (3, 1.5)):
        for a in combinations(range(len(s)), n):
            for b in combinations(range(len(t)), n):
                if all(s[i] == t[j] for i, j in zip(a, b, strict=True)):
                    total += w * decay ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1) / decay ** (2 if n == 1 else 4)
    return total


@given(st.text("abc*", min_size=1, max_size=6), st.text("abc*", min_size=1, max_size=6))
@settings(max_examples=100)
def test_kernel_is_the_definition(s, t):
    f, g = safety.features(s), safety.features(t)
    assert sum(v * g.get(u, 0.0) for u, v in f.items()) == pytest.approx(naive_kernel(s, t), rel=1e-9)
    assert safety.kernel([s], [t])[0, 0] == pytest.approx(naive_kernel(s, t) / (naive_kernel(s, s) * naive_kernel(t, t)) ** 0.5, rel=1e-3)
    model = safety.SafetyModel([t, "ab"], np.array([0.5, -0.2]), 0.1, 0.0)
    assert model.of_word(s) == pytest.approx(float(safety.kernel([s], [t, "ab"]) @ np.array([0.5, -0.2])), abs=1e-4)


def test_short_sentences_count():
    assert safety.sentences_of("गधा। pig. ") == ["गधा", " pig"] and safety.units_of("गधा") == ["gadhaa"]
    assert safety.sentences_of(" \n ।") == []


def test_disguises():
    assert safety.units_of("you p a t h e t i c  s.c.u.m") [-2:] == ["pathetic", "scum"] or "patheticscum" in safety.units_of("you p a t h e t i c  s.c.u.m")
    assert safety.units_of("cllllowns th1eve$ गधा!!") == ["clowns", "thieves", "gadhaa"]
    near = safety.kernel(["idi0t".translate(safety.LEET), "i-d-i-o-t", "ward"], ["idiot"])
    assert near[0, 0] > 0.99 and near[0, 0] > near[2, 0] and near[1, 0] > 3 * near[2, 0]


def test_safety_learns(spark):
    rng = random.Random(1)
    calm = ["the office opens at nine", "please bring the form", "the road is mended", "thanks to the kind staff", "calling staff idiots in a letter is an offence", "owners of pigs must register them"]
    bad = ["you are filthy idiots shut up", "everyone there is a stupid pig get lost", "what a bunch of rotten thieves go rot"]
    docs = [(". ".join(rng.sample(calm, 3)) + ".", False) for _ in range(60)] + [(". ".join(rng.sample(calm, 2) + [rng.choice(bad)]) + ".", True) for _ in range(30)]
    m = safety.train(docs, landmarks=60)
    good, evil = m.scores(["thanks to the kind staff. the road is mended.", "the office opens at nine. you are fi1thy idi0ts shut up."])
    assert good < m.threshold < evil and m.scores([None, ""]) == [m.bias, m.bias]
    rows = spark.createDataFrame([(1, "s", "you are filthy idiots shut up", True), (2, "s", None, True), (1, "s", "you are filthy idiots shut up", True), (3, None, "x" * 200_000, False)], "doc_id long, source string, text string, flagged boolean")
    got = [(r.doc_id, r.flagged) for r in safety.score_documents(rows, m).collect()]
    assert sorted(got) == [(1, True), (1, True), (2, False), (3, False)]
    labels = spark.createDataFrame([], "doc_id long, annotator string, label string")
    empty = safety.fit(rows, labels)
    assert {r.rate for r in safety.rates(safety.score_documents(rows, empty)).collect()} == {0.0}


@needs_data
def test_held_out_documents():
    import pandas as pd

    d = pd.read_parquet("/root/testdata/sf0.1/documents.parquet").set_index("doc_id").text
    p = pd.read_parquet("/root/testdata/sf0.1/safety_labels.parquet").pivot_table(index="doc_id", columns="annotator", values="label", aggfunc="first")
    rows = [(d[i], True) for i in p.index[(p != "none").all(axis=1)]] + [(d[i], False) for i in p.index[(p == "none").all(axis=1)]]
    random.Random(0).shuffle(rows)
    cut = len(rows) * 2 // 3
    m = safety.train(rows[:cut])
    got = [s > m.threshold for s in m.scores([t for t, _ in rows[cut:]])]
    true = [y for _, y in rows[cut:]]
    hit = sum(a and b for a, b in zip(got, true, strict=True))
    assert hit >= 0.85 * sum(true) and hit >= 0.85 * sum(got)
