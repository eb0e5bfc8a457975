import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lipigraph.functions import entities as E
from lipigraph.functions import rules as R
from lipigraph.functions import text as T


def test_text_columns(spark):
    rows = [("#12", "#१२"), ("2.1", "२.१"), ("iv", "iv"), ("•", "•"), ("....", "...."), ("---", None), ("· - ·", "· - ·"), ("12/05/2024", None), ("word", None), (None, None), ("", None)]
    got = spark.createDataFrame(rows, "t string, want string").select("want", T.structural_label(F.col("t")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_chatter_and_style(spark):
    rows = [("Translation: Sure! \"यो\"", "यो"), ("translation: x", "x"), ("Okay, \"a\" and \"b\"", 'a" and "b'), ("plain", "plain")]
    got = spark.createDataFrame(rows, "t string, want string").select("want", T.strip_chatter(F.col("t")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    rows = [("Fee", "एनपीआर ५००", "ne", "रु ५००"), ("Fee", "रु५००", "ne", "रु ५००"), ("no", "न ५", "ne", "नं. ५"), ("शुल्क", "रु ५००", "en", "NPR 500"), ("cost", "मूल्य मूल्य", "ne", "मूल्य"), ("a a", "b b", "en", "b b"), ("x", "रु५", "tmg", "रु५")]
    got = spark.createDataFrame(rows, "s string, t string, l string, want string").select("want", T.house_style(F.col("s"), F.col("t"), F.col("l")).alias("got")).collect()
    # A source that repeats a word of one letter repeats nothing.
    assert [r.got for r in got] == ["रु ५००", "रु ५००", "नं. ५", "NPR 500", "मूल्य", "b", "रु५"]


def test_normal_forms(spark):
    rows = [("  Ｆｕｌｌ  Ｗidth ",), (None,), ("Straße",), ("\x1cA\u2003b\u0085",), ("ΣΑΣ",)]
    got = spark.createDataFrame(rows, "t string").select(T.normalize_text("t").alias("n"), T.display_normalize("t").alias("d"), T.sanitize_unicode("t").alias("u")).collect()
    assert [r.n for r in got] == ["full width", "", "strasse", "a b", "σασ"] and got[0].d == "Full Width" and got[1].u is None and got[3].u == "A b"


def test_normal_forms_are_those_of_the_standard(spark):
    rng = random.Random(2)
    texts = ["".join(chr(rng.choice([rng.randrange(32, 0x3000), rng.randrange(0xF900, 0xFFE0), rng.randrange(9, 0x250)])) for _ in range(12)) for _ in range(2000)]
    texts = [t for t in texts if all(unicodedata.category(c) not in ("Cn", "Cs") for c in t)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.normalize_text("t").alias("n"), T.display_normalize("t").alias("d")).collect()
    assert len(texts) > 500 and [r.t for r in got if r.d != T.display_form(r.t) or r.n != T.plain_form(r.t)] == []


@given(st.text(alphabet="0123456789०१२३४५६७८९ab", max_size=20))
def test_digits_are_a_bijection(s):
    ascii_ = s.translate(T.TO_ASCII)
    assert ascii_.translate(T.TO_NATIVE).translate(T.TO_ASCII) == ascii_


@given(st.text(max_size=60))
@settings(max_examples=200)
def test_entities_do_not_overlap(s):
    found = E.find_entities(s)
    assert all(a["end"] <= b["start"] for a, b in zip(found, found[1:], strict=False)) and all(s[e["start"] : e["end"]] == e["text"] for e in found)


def test_entities():
    text = "Mail a.b@c.org, see https://x.org/p by 2081-02-03, Ward No. 4, NPR 5,000, call 9812345678, AB-12 and 7."
    assert [e["kind"] for e in E.find_entities(text)] == ["email", "url", "date", "ward", "money", "phone", "id", "number"]
    office = E.find_entities("the Land Office", [{"source_term": "land office", "target_term": "x", "term_type": "office"}])
    assert [(e["kind"], e["start"]) for e in office] == [("office", 4)]


KEPT = [
    ("money", "NPR 5,000", None, "रु. ५,००० तिर्नुहोस्", True), ("money", "NPR 5,000", None, "रु. ६,०००", False), ("money", "NPR 500", None, "शुल्क रु 500", True), ("ward", "Ward No. 4", None, "वडा नं. ४", True), ("ward", "Ward No. 4", None, "वडा नं. ५", False),
    ("number", "12", None, "१२ र १३", True), ("number", "12", None, "१२३", False), ("number", "x", None, "x", False), ("office", "Land office", "मालपोत", "मालपोत कार्यालय", True), ("office", "Land office", "", "Land office", True),
    ("id", "AB-12", None, "ab-12", False), ("id", "AB-12", None, "AB-१२", True), ("url", "https://x.org/1", None, "see https://x.org/१", True), ("date", "2081-02-03", None, "२०८१-०२-०३", True), ("email", "a@b.c", None, None, False), ("id", "ＡＢ-12", None, "AB-12", True),
]


def test_kept_entities(spark):
    rows = [([{"kind": k, "text": x, "target_term": term}], t, want) for k, x, term, t, want in KEPT] + [(None, "x", False), ([], "x", False)]
    df = spark.createDataFrame(rows, "e array<struct<kind:string,text:string,target_term:string>>, t string, want boolean")
    got = df.select("*", E.count_kept(E.full(df, "e"), F.col("t")).alias("n")).collect()
    assert [(r.e, r.t) for r in got if bool(r.n) != r.want] == []
    assert E.variants("money", "NPR 5,000") == ["NPR 5,000", "NPR ५,०००", "रु ५,०००", "रु. ५,०००", "एनपीआर ५,०००", "रुपैया ५,०००"]


LONG = "one two three four five six seven eight nine ten eleven twelve"
CASES = [
    ("changed_number", "Pay 500", "तिर्नुहोस् ५०१", "तिर्नुहोस् ५००", "en"),
    ("hallucination_repetition", "a form", "फारम फारम यहाँ", "फारम यहाँ", "en"),
    ("length_deviation", "a rather long sentence here", "छ", "एउटा लामो वाक्य यहाँ छ", "en"),
    ("untranslated_segment", "Please wait", "Please wait", "पर्खनुहोस्", "en"),
    ("punctuation_mismatch", "a (b)", "क ख", "क (ख)", "en"),
    ("symbol_leak", "a", "क #", "क", "en"),
    ("script_imbalance", "x", "यो सबै english words remain here", "यो सबै नेपालीमा लेखिएको छ", "en"),
    ("word_repetition", "x", "घर घर घर घर", "घर घर घर", "en"),
    ("markup_mismatch", "a: b", "क ख", "क: ख", "en"),
    ("date_mismatch", "by 2081-02-03", "सम्म", "२०८१-०२-०३ सम्म", "en"),
    ("date_mismatch", "२०८१-०२-०३ सम्म", "until then", "until 2081-02-03", "en"),
    ("negation_flip", "no, Ward No. ५", "वडा ५", "वडा ५ होइन", "en"),
    ("ai_filler", "x", "Here is the form", "as an AI, here is a form", "en"),
    ("major_omission", LONG, "एक दुई", LONG, "en"),
    ("major_addition", LONG[:55] + " x y", " ".join(["शब्द"] * 40), LONG, "en"),
    ("negation_flip", "do not pay", "तिर्नुहोस्", "नगर्नु", "en"),
    ("honorific_inconsistency", "x", "तपाईं र तिमी", "तपाईं", "en"),
    ("instruction_leak", "x", "translate the text", "फारम", "en"),
    ("placeholder_broken", "Dear {name}", "प्रिय", "प्रिय {name}", "en"),
    ("directional_flip", "profit", "घाटा", "नाफा", "en"),
    ("currency_missing", "NPR 5", "५", "रु ५", "en"),
    ("currency_unlocalized", "NPR 5", "NPR ५", "रु ५", "ne"),
    ("currency_suboptimal", "NPR 5", "एनपीआर ५", "रु ५", "ne"),
    ("list_sequence_broken", "1. a 2. b", "१. क ३. ख", "१. क २. ख", "en"),
    ("forbidden_term", "x", "यो कागज हो", "यो फाइल हो", "en"),
    ("logical_flow_broken", "because of it", "यो", "किनभने", "en"),
    ("anchor_mismatch", "ward 4", "वडा ५", "वडा ४", "en"),
    ("missing_landmark", "[stamp]", "यहाँ", "[छाप]", "en"),
    ("certification_missing", "verified", "ठीक", "प्रमाणित", "en"),
    ("date_conversion_risk", "in 2024", "२०८१ मा", "२०२४ मा", "en"),
    ("transliteration_drift", "Ram met Ram", "रामले राम्लाई भेटे", "भेट", "en"),
    ("legal_modal_flip", "you must pay", "सक्नेछ", "पर्नेछ", "en"),
    ("untranslated_legalism", "x", "affidavit चाहिन्छ", "शपथपत्र", "en"),
    ("legal_anchor_missing", "provided that", "यदि", "बशर्ते", "en"),
    ("ghost_entity", "पानी", "water from Jupiter", "पानी", "en"),
    ("polarity_flip", "never pay", "तिर्नुहोस्", "नगर", "en"),
    ("spacing_standard", "x", "रु५", "रु ५", "en"),
    ("abbreviation_standard", "x", "न ५", "नं. ५", "en"),
    ("ai_filler", "x", "Sure, here is it", "फारम", "en"),
]


def test_each_rule_fires_and_rests(spark):
    rows = [(code, s, t, lang, fires) for code, s, bad, good, lang in CASES for t, fires in ((bad, True), (good, False))]
    df = spark.createDataFrame(rows, "code string, s string, t string, lang string, fires boolean")
    got = R.counted(df, "s", "t", F.col("lang")).collect()
    assert [(r.code, r.t) for r in got if (r.code in {c.code for c in r.codes}) != r.fires] == []
    only = R.counted(df, "s", "t", F.col("lang"), only={"negation_flip"}).collect()
    assert {c.code for r in only for c in r.codes} == {"negation_flip"}


def counts(spark, s, t, e=(), h=(), lang="en"):
    schema = f"s string, t string, e array<{E.ENTITY}>, h array<{E.HIT}>"
    row = R.score(spark.createDataFrame([(s, t, list(e), list(h))], schema), "s", "t", "e", "h", F.lit(lang)).first()
    out = {}
    for r in row.risk_reasons:
        out[r.code] = out.get(r.code, 0) + 1
    assert row.risk_score == sum(out.values()) or out == {"total_omission": 1}
    return out


def test_reasons_are_counted(spark):
    assert counts(spark, "a (b) [c] \"d", "क ख ग घ")["punctuation_mismatch"] == 3
    assert "negation_flip" not in counts(spark, "Ward No. ५", "वडा ५") and "date_mismatch" not in counts(spark, "२०८१-०२-०३", "2081-02-03")
    entity = lambda kind, text, a=0: {"kind": kind, "text": text, "start": a, "end": a + len(text), "target_term": None, "segment_source_len": None}
    assert counts(spark, "Pay NPR 5 or NPR 6", "तिर्नुहोस्", [entity("money", "NPR 5", 4), entity("money", "NPR 6", 13)])["changed_protected_entity"] == 2
    # What is the same in both and is one technical value isn't left untranslated.
    assert "untranslated_segment" not in counts(spark, "KF-1042", "KF-1042", [entity("id", "KF-1042")]) and "untranslated_segment" in counts(spark, " Please wait", "Please wait ")
    # Glossary terms and links in Latin script don't count for the balance of scripts.
    term = {"source_term": "x", "target_term": "Smart Card Office Section", "term_type": "t"}
    assert "script_imbalance" in counts(spark, "x", "यो Smart Card Office Section हो") and "script_imbalance" not in counts(spark, "x", "यो Smart Card Office Section हो", h=[term])
    # A token is known as a whole, not as a part; a target term doesn't excuse it, a name does.
    assert "untranslated_token" in counts(spark, "fill form", "form भर्नुहोस्", h=[{"source_term": "fill", "target_term": "form", "term_type": "t"}])
    assert "untranslated_token" not in counts(spark, "Ram Thapa", "Ram Thapa") and "untranslated_token" in counts(spark, "Ram waits", "Ram waits")
    assert "untranslated_token" not in counts(spark, "see KF-ab", "KF-ab हेर", [entity("id", "KF-ab", 4)])
    # Repeats of names keep their places.
    assert "identity_swap" not in counts(spark, "Ram and Sita", "Ram र Sita") and "identity_swap" in counts(spark, "Ram Sita", "Sita Ram")
    swap = counts(spark, "house 12, ward 4", "घर ४, वडा १२")
    assert swap["number_swap"] == 2
    far = counts(spark, "5 " + "x" * 100, "क" * 100 + " ५", [entity("number", "5") | {"segment_source_len": 102}])
    assert far["position_shift"] == 1 and "script_mismatch" not in far and counts(spark, "a 5", "क 5", [entity("number", "5", 2)])["script_mismatch"] == 1
    assert [r.repairable for r in R.score(spark.createDataFrame([("a long enough text", "छ", [], [])], f"s string, t string, e array<{E.ENTITY}>, h array<{E.HIT}>"), "s", "t", "e", "h").first().risk_reasons if r.code == "length_deviation"] == [True]


def test_scorer(spark):
    e = E.find_entities("Pay NPR 500 at House 12 and Ward 4")
    schema = f"s string, t string, e array<{E.ENTITY}>, h array<{E.HIT}>"
    hits = [{"source_term": "House", "target_term": "घर", "term_type": "x"}]
    rows = [("Pay", " ", [], []), ("Pay NPR 500 at House 12 and Ward 4", "तिर्नुहोस्", e, hits), ("House 12, Ward 4", "घर ४, वडा १२", [], []), ("Ram and Sita", "Sita र Ram", [], []), ("x", "a​b", None, None)]
    got = R.score(spark.createDataFrame(rows, schema), "s", "t", "e", "h").collect()
    codes = [[r.code for r in x.risk_reasons] for x in got]
    assert codes[0] == ["total_omission"] and got[0].risk_score == 10.0
    assert {"changed_number", "changed_protected_entity", "glossary_miss"} <= set(codes[1]) and got[1].risk_score == len(codes[1])
    assert "number_swap" in codes[2] and "identity_swap" in codes[3] and "unicode_sanitized" in codes[4]
    place = [r.code for r in R.rules()]
    order = [place.index(c) for c in codes[1]]
    assert order == sorted(order)


def test_sanitised_text_is_in_compatibility_form():
    assert unicodedata.normalize("NFKC", T.display_form("ﬁ １")) == "fi 1"


@pytest.mark.parametrize(("text", "want"), [("Ram Sita", True), ("Fee Form", False), ("ram sita", False), ("One Two Three Four", False)])
def test_names(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(R.name_like(F.col("t"))).first()[0] is want
