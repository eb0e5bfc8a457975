"""Rules that judge a rendering against its source. Each is data: a code, a severity, how often it fires as a Column, and
whether a repair may help. All of them are Catalyst expressions over parts that are computed once a row in projections of
their own: lower and display forms, numbers, tokens, the state of each entity. No row goes to Python."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lipigraph.functions import entities as E
from lipigraph.functions import text as T

REASON = "struct<code:string,label:string,severity:string,detail:string,repairable:boolean>"

# The word lists of the rules.
ENGLISH_NEGATION = ["not", "no", "never", "none", "neither", "nor", "cannot", "don't", "can't", "won't"]
NEPALI_NEGATION = ["छैन", "हुँदैन", "नगर्नु", "नगर", "नाईं", "होइन", "छैनन्", "हुन्न", "थिएन"]
HONORIFIC_HIGH = ["तपाईं", "हुनुहुन्छ", "होला", "गर्नुहोस्", "पाल्नुहोस्"]
HONORIFIC_LOW = ["तँ", "तिमी", "छौ", "गछौ", "गरे", "गर"]
INSTRUCTION_KEYWORDS = ["translate", "nepali", "language", "following", "below", "text", "sure", "okay"]
DIRECTIONS = [(["increase", "rise", "gain", "profit", "up"], ["घट्नु", "घाटा", "कम", "तल"]), (["decrease", "fall", "loss", "down"], ["बढ्नु", "नाफा", "बढी", "माथि"])]
CURRENCIES = [(["$", "usd", "dollar"], ["डलर", "अमेरिकी डलर"]), (["rs", "npr", "rupee"], ["रु", "रुपैयाँ", "नेपाली रुपैयाँ", "एनपीआर", "रुपैया"])]
PHONETIC_CURRENCY = ["एनपीआर", "रुपैया"]
CONNECTIVES = [(["however", "but", "yet", "nevertheless"], ["तर", "यद्यपि", "तापनि"]), (["therefore", "so", "consequently", "thus"], ["तसर्थ", "त्यसैले", "अतः"]), (["because", "since", "as"], ["किनभने", "कारण", "ले गर्दा"])]
MODALS = [(["must", "shall", "should", "mandatory"], ["पर्नेछ", "अनिवार्य", "हुनुपर्छ"]), (["may", "can", "permissible"], ["सक्नेछ", "मन्जुरी", "पाउनेछ"])]
CONDITIONS = [(["provided that", "subject to"], ["बशर्ते", "अधिनमा"]), (["notwithstanding", "regardless"], ["तापनि", "वावजुद"])]
LANDMARKS = [(["signature", "signed"], ["हस्ताक्षर", "दस्तखत"]), (["stamp", "seal"], ["छाप", "मोहर", "लाहा"]), (["verified", "certified"], ["रुजु प्रमाणित", "प्रमाणित"]), (["official", "authorized"], ["आधिकारिक", "अधिकृत"]), (["ward"], ["वडा"]), (["house"], ["घर"]), (["no", "number"], ["नं", "नम्बर"])]
ANCHORS = [(["ward"], ["वडा"]), (["house"], ["घर"]), (["no", "number"], ["नं", "नम्बर", "संख्या"])]
OBSOLETE = [["vdc", "village development committee"], ["zonal", "zone"]]
LEGALISMS = ["subpoena", "indemnity", "habeas corpus", "tort", "affidavit"]
FORBIDDEN = [("कागज", "low"), ("Citizenship paper", "medium")]
NEGATIVE_PREFIXES = ["un", "in", "im", "dis", "non", "ir", "mis", "anti", "de"]
NOT_NEGATIVE = ["instruction", "information", "important", "interest", "industry", "individual", "increase", "include", "indeed", "inside", "insight", "inspect", "install", "instead", "intend", "intensity", "interview", "instrument", "instance", "incident", "input", "income", "invite"]
NO_NAMES = ["Applicant", "Application", "Certificate", "Citizenship", "Date", "District", "Fee", "Form", "ID", "Municipality", "Name", "Office", "Phone", "Reference", "Request", "Residence", "Service", "Ward", "Call", "Card", "Fees", "NPR", "Total", "Amount", "Price"]
FILLERS = ["here is the", "sure,", "translation:", "translated text:"]
NO_TOKENS = ["http", "https", "example", "www"]


@dataclass(frozen=True)
class Rule:
    code: str
    severity: str
    #: How often the rule fires for a row.
    n: Column
    label: str
    detail: Column | str = ""
    repairable: Column | bool = False


def once(*conditions: Column) -> Column:
    """How many of the conditions hold."""
    out = F.lit(0)
    for c in conditions:
        out = out + F.coalesce(c, F.lit(False)).cast("int")
    return out


def has_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def has_word(text: Column, words: list[str]) -> Column:
    # Looking for the letters is much cheaper than for their borders.
    return has_any(text, words) & text.rlike(T.EDGE_BEFORE + "(?:" + "|".join(words) + ")" + T.EDGE_AFTER)


def differ(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) > 0) | (F.size(F.array_except(b, a)) > 0)


def minus(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b))


def anchored(text: Column, words: list[str]) -> Column:
    found = [F.transform(F.regexp_extract_all(text, F.lit(rf"{T.EDGE_BEFORE}{w}\.?{T.SPACE}*([0-9०-९]+)"), F.lit(1)), lambda x: F.translate(x, T.NATIVE_DIGITS, T.ASCII_DIGITS)) for w in words]
    return F.array_distinct(F.concat(*found))


def list_markers(text: Column) -> Column:
    """Numbers below a hundred before a full stop and a space."""
    found = F.transform(F.regexp_extract_all(text, F.lit(rf"{T.EDGE_BEFORE}(\p{{Nd}}+)\.{T.SPACE}"), F.lit(1)), lambda x: F.regexp_replace(F.translate(x, T.NATIVE_DIGITS, T.ASCII_DIGITS), "^0+(?=.)", ""))
    return F.filter(found, lambda n: F.length(n) < 3)


def dates(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"\p{Nd}{1,4}[-./]\p{Nd}{1,2}[-./]\p{Nd}{1,4}"), F.lit(0)))


def negatives(text: Column, words: list[str], english: bool) -> Column:
    """Words that negate; in English those that begin like a negation too."""
    by_length: dict[int, list[str]] = {}
    for x in NEGATIVE_PREFIXES:
        by_length.setdefault(len(x), []).append(x)

    def counts(x: Column) -> Column:
        begins = F.lit(False)
        for n, prefixes in by_length.items():
            begins = begins | F.substring(x, 1, n).isin(prefixes)
        return x.isin(words) | ((F.length(x) > 4) & begins & ~x.isin(NOT_NEGATIVE)) if english else x.isin(words)

    return F.size(F.filter(T.words(F.lower(text)), counts))


def name_like(text: Column) -> Column:
    """Two or three capitalised Latin words, none of them a common label."""
    w = T.words(F.coalesce(text, F.lit("")))
    return F.size(w).between(2, 3) & F.forall(w, lambda x: x.rlike("^[A-Z][a-z]+$") & ~x.isin(NO_NAMES))


#: A number between the fifteen characters before and behind it.
NEAR = r"(?s)(?=[+0-9०-९])(?<=(^.{0,14}|.{15}))[+0-9०-९]+(?:[,.\-:/][+0-9०-९]+)*(?=(.{0,15}))"
NEAR_WORD = r"[^\p{Nd}" + T.SPACE[1:-1] + "]{2,}"


def near_numbers(shown: Column) -> Column:
    """(n, words): each number of a display form with the words around it."""
    part = lambda k: F.regexp_extract_all(shown, F.lit(NEAR), F.lit(k))
    around = F.zip_with(part(1), part(2), lambda a, b: F.regexp_extract_all(F.concat(a, F.lit(" "), b), F.lit(NEAR_WORD), F.lit(0)))
    return F.zip_with(part(0), around, lambda n, w: F.struct(F.translate(n, T.NATIVE_DIGITS, T.ASCII_DIGITS).alias("n"), w.alias("words")))


def swapped(mine: Column, theirs: Column) -> Column:
    """Numbers of the source whose label stands beside another number in the target."""

    def moved(n: Column) -> Column:
        out = F.lit(False)
        for a, b in LANDMARKS:
            labelled = F.exists(mine, lambda c: (c["n"] == n) & F.exists(c["words"], lambda w: F.lower(w).isin(a)))
            out = out | (labelled & F.exists(theirs, lambda c: (c["n"] != n) & F.exists(c["words"], lambda w: w.isin(b))))
        return out

    own = F.array_distinct(F.transform(mine, lambda c: c["n"]))
    both = F.filter(own, lambda n: F.exists(theirs, lambda c: c["n"] == n) & moved(n))
    return F.when(F.size(own) < 2, F.array().cast("array<string>")).otherwise(both)


def state_of(e: Column, target: Column, shown: Column, shown_ascii: Column, numbers: Column) -> Column:
    """(kept, shifted, foreign): whether the target keeps an entity, far from its place, and in a script it should have left."""
    text = F.coalesce(e["text"], F.lit(""))
    told = (text != "") & (target != "")

    def of(forms: Column) -> Column:
        found = F.get(F.filter(forms, lambda v: (v != "") & F.contains(shown, v)), F.lit(0))
        return T.let(F.struct(F.coalesce(found, F.lit("")).alias("form"), (F.when(found.isNotNull(), F.instr(shown, found)).otherwise(F.instr(shown_ascii, T.to_ascii_digits(text))) - 1).alias("at")), lambda x: judged(forms, x["form"], x["at"]))

    def judged(forms: Column, form: Column, at: Column) -> Column:
        foreign = F.when(form != "", ~T.contains_devanagari(form) & (T.to_native_digits(form) != form) & ~e["kind"].isin(*E.VERBATIM)).otherwise((at >= 0) & (T.to_native_digits(text) != text))
        whole = F.coalesce(F.nullif(e["segment_source_len"], F.lit(0)), F.nullif(F.length(target), F.lit(0)), F.lit(100))
        far = F.abs(F.coalesce(e["start"], F.lit(0)) / whole - at / F.greatest(F.length(shown), F.lit(1))) > F.when(F.length(shown) < 60, 0.75).otherwise(0.6)
        return F.struct(E.is_kept(e, shown_ascii, numbers, forms).alias("kept"), (told & (at >= 0) & far).alias("shifted"), (told & foreign).alias("foreign"))

    return T.let(E.shown_forms(e), of)


def left_over(source: Column, target_plain: Column, entities: Column, hits: Column) -> Column:
    """Latin words of the source that the target still holds, but for those in entities and glossary terms and for parts of links."""
    hidden = lambda s, e: F.concat(s.substr(F.lit(1), e["start"]), F.repeat(F.lit("_"), e["end"] - e["start"]), s.substr(e["end"] + 1, F.length(s)))
    spans = F.filter(entities, lambda e: e["start"].isNotNull() & e["end"].isNotNull() & (e["end"] > e["start"]))
    open_ = F.aggregate(spans, source, hidden)
    known = F.concat(
        F.array(*map(F.lit, NO_TOKENS)),
        F.flatten(F.transform(hits, lambda h: T.latin_tokens(F.lower(F.coalesce(h["source_term"], F.lit("")))))),
        F.flatten(F.transform(entities, lambda e: T.latin_tokens(F.lower(F.coalesce(e["text"], F.lit("")))))),
    )
    tokens = F.filter(F.array_distinct(T.latin_tokens(open_)), lambda w: F.contains(target_plain, F.lower(w)) & ~F.array_contains(known, F.lower(w)))
    return F.array_sort(tokens)


def reordered(names: Column, shown: Column) -> Column:
    """Whether names, repeats included, come in another order in the target."""
    present = F.filter(names, lambda n: F.contains(shown, n) | F.contains(shown, F.lower(n)))

    def changed(p: Column) -> Column:
        placed = F.array_sort(F.transform(F.filter(p, lambda n: F.contains(shown, n)), lambda n: F.struct(F.instr(shown, n).alias("at"), n.alias("n"))))
        return (F.size(p) >= 2) & (F.size(placed) == F.size(p)) & (F.transform(placed, lambda x: x["n"]) != p)

    return (F.size(names) >= 2) & shown.rlike("[A-Za-z]") & (F.size(F.array_distinct(names)) >= 2) & T.let(present, changed)


def prepared(pairs: DataFrame, source: str, target: str, lang: Column, entities: str | None = None, hits: str | None = None) -> DataFrame:
    """pairs with the parts that the rules share in columns of their own, each computed once a row; those that no rule asks for are pruned."""
    out = pairs.withColumns(
        {
            "_s": F.coalesce(source, F.lit("")), "_t": F.coalesce(target, F.lit("")), "_lang": F.lower(F.coalesce(lang, F.lit("en"))),
            "_e": E.full(pairs, entities) if entities else F.array().cast(f"array<{E.ENTITY}>"), "_h": E.full_hits(pairs, hits) if hits else F.array().cast(f"array<{E.HIT}>"),
        }
    )
    for more in _parts(id(SparkContext._active_spark_context)):
        out = out.withColumns(more)
    return out


@functools.cache
def _parts(context: int) -> list[dict[str, Column]]:
    """What prepared() adds in turn."""
    c = F.col
    first = {"_sl": F.lower("_s"), "_tl": F.lower("_t"), "_ss": T.strip(c("_s")), "_ts": T.strip(c("_t")), "_sd": T.display_normalize("_s"), "_td": T.display_normalize("_t")}
    # Numbers can be exchanged where both sides have two and the source names what one of them is.
    swappable = (F.regexp_count(c("_sd"), F.lit("[0-9०-९]+")) >= 2) & has_any(c("_sl"), [w for a, _ in LANDMARKS for w in a]) & (F.size(T.numbers(c("_sd"))) >= 2) & (F.size(T.numbers(c("_td"))) >= 2)
    second = {
            "_swappable": swappable,
            "_tp": T.casefold(c("_td")), "_ta": T.to_ascii_digits(c("_td")), "_sn": T.numbers(c("_s")), "_tn": T.numbers(c("_t")), "_sw": T.word_count(c("_s")), "_tw": T.word_count(c("_t")),
            "_slatin": T.latin_tokens(c("_sl")), "_tlatin": T.latin_tokens(c("_tl")), "_names": F.filter(T.latin_tokens(c("_s")), lambda w: ~w.isin(NO_NAMES)),
    }
    third = {
        "_near_s": F.when(c("_swappable"), near_numbers(c("_sd"))), "_near_t": F.when(c("_swappable"), near_numbers(c("_td"))),
        "_state": F.transform("_e", lambda e: state_of(e, c("_t"), c("_td"), c("_ta"), c("_tn"))),
        # Where the target has no Latin word of the source there is none to look for.
        "_left": F.when(F.exists("_slatin", lambda w: F.contains(c("_tp"), w)), left_over(c("_s"), c("_tp"), c("_e"), c("_h"))).otherwise(F.array().cast("array<string>")),
    }
    fourth = {"_swapped": F.when(c("_swappable"), swapped(c("_near_s"), c("_near_t"))).otherwise(F.array().cast("array<string>"))}
    return [first, second, third, fourth]


def rules() -> list[Rule]:
    """The rules over the columns of prepared(), in the order in which they report; the empty rendering is score()'s. They are the same expressions for every table, made once a context."""
    return _rules(id(SparkContext._active_spark_context))


@functools.cache
def _rules(context: int) -> list[Rule]:
    s, t, sl, tl, ss, ts, td, lang = (F.col(f"_{x}") for x in ("s", "t", "sl", "tl", "ss", "ts", "td", "lang"))
    e, h, state, sn, tn, ws, wt = (F.col(f"_{x}") for x in ("e", "h", "state", "sn", "tn", "sw", "tw"))
    ratio = F.length(ts) / F.greatest(F.length(ss), F.lit(1))
    symbols = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"[@#$%^&*_=+|\\<>]"), F.lit(0)))
    leaked = F.array_except(symbols(t), symbols(s))
    brackets = [(T.count_of(s, a) != T.count_of(t, a)) | (T.count_of(s, b) != T.count_of(t, b)) for a, b in ("()", "[]", "{}")]
    marks = lambda c: F.length(F.regexp_replace(c, r"[^•\-*|:]", ""))
    latin = lambda c: F.length(F.regexp_replace(c, r"[^A-Za-z]", ""))
    total = lambda parts: F.aggregate(parts, F.lit(0), lambda a, x: a + x)
    exempt = total(F.transform(h, lambda x: F.when(x["target_term"].rlike("[A-Za-z]"), F.length(x["target_term"])).otherwise(0))) + total(F.transform(e, lambda x: F.when(x["kind"].isin("url", "email"), F.coalesce(F.length(x["text"]), F.lit(0))).otherwise(0)))
    imbalance = T.contains_devanagari(t) & (F.length(t) > 20) & (F.greatest(F.lit(0), latin(t) - exempt) / F.length(t) > 0.35)
    first = F.get(e, F.lit(0))
    technical = (F.size(e) == 1) & (F.length(ts) < F.length(first["text"]) + 5) & first["kind"].isin(*E.VERBATIM)
    without_no = F.regexp_replace(s, rf"(?i){T.EDGE_BEFORE}no\.?{T.SPACE}*\p{{Nd}}+", " ")
    s_words = F.regexp_extract_all(F.lower(without_no), F.lit(T.WORD), F.lit(0))
    placeholders = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"\{\{[^}]+\}\}|\{[^}]+\}|\[[A-Z_]+\]"), F.lit(0)))
    first_words = F.slice(F.regexp_extract_all(tl, F.lit(r"[a-z]{4,}"), F.lit(0)), 1, 5)
    new = F.array_except(F.array_except(F.col("_tlatin"), F.col("_slatin")), F.array(*map(F.lit, INSTRUCTION_KEYWORDS)))
    ghosts = F.filter(new, lambda g: ~((lang == "en") & T.contains_devanagari(s)) | ((F.length(g) >= 4) & ~F.concat(F.upper(F.substring(g, 1, 1)), g.substr(F.lit(2), F.length(g))).isin(NO_NAMES)))
    twice = F.exists("_names", lambda w: F.length(s) - F.length(F.replace(s, w, F.lit(""))) >= 2 * F.length(w))
    runs = F.array_distinct(F.regexp_extract_all(t, F.lit(r"[ऀ-ॿ]{3,}"), F.lit(0)))
    ms, mt = list_markers(s), list_markers(t)
    latin_year, native_year = s.rlike(rf"{T.EDGE_BEFORE}20[0-2][0-9]{T.EDGE_AFTER}"), T.to_ascii_digits(t).rlike(rf"{T.EDGE_BEFORE}20[7-9][0-9]{T.EDGE_AFTER}")
    joined = lambda a, n: F.array_join(F.slice(a, 1, n), ", ")
    each = lambda test: F.size(F.filter(state, test))
    money = []
    for a, b in CURRENCIES:
        marked, local, foreign = has_any(sl, a), has_any(tl, b), has_any(tl, a)
        money.append((marked & ~local & ~foreign, marked & foreign & ~local & (lang != "en"), marked & ~(~local & ~foreign) & ~(foreign & ~local & (lang != "en")) & (lang != "en") & has_any(tl, PHONETIC_CURRENCY)))
    return [
        Rule("changed_number", "high", once(minus(sn, tn) > 0), "Number changed or missing", joined(F.array_sort(F.array_except(sn, tn)), 20), True),
        Rule("number_swap", "high", F.size("_swapped"), "Numbers exchanged", joined(F.col("_swapped"), 5)),
        Rule("changed_protected_entity", "high", each(lambda x: ~x["kept"]), "Protected value lost", "", True),
        Rule("position_shift", "medium", each(lambda x: x["shifted"]), "Protected value far from its place"),
        Rule("script_mismatch", "medium", each(lambda x: x["foreign"]), "Protected value in the source's digits"),
        Rule("glossary_miss", "medium", F.size(F.filter(h, lambda x: ~F.contains(t, x["target_term"]))), "Glossary term not used"),
        Rule("hallucination_repetition", "high", once(T.neighbours_equal(T.words(t)) & ~T.neighbours_equal(T.words(s))), "A word repeated", "", True),
        Rule("untranslated_token", "medium", once((F.size("_left") > 0) & ~((ss == ts) & name_like(s))), "Source words left", joined(F.col("_left"), 5), True),
        Rule("length_deviation", "low", once((ratio < 0.35) | (ratio > 3.0)), "Unusual length", F.format_number(ratio, 2), ratio < 0.5),
        Rule("untranslated_segment", "medium", once((ss == ts) & (F.length(ss) > 3) & ~F.coalesce(technical, F.lit(False)) & ~name_like(s) & t.rlike(T.LATIN_TOKEN)), "Source left as it was"),
        Rule("punctuation_mismatch", "medium", once(*brackets, T.count_of(s, '"') % 2 != T.count_of(t, '"') % 2), "Brackets or quotes differ"),
        Rule("symbol_leak", "medium", once(F.size(leaked) > 0), "Symbol that the source lacks", F.array_join(F.array_sort(leaked), " ")),
        Rule("script_imbalance", "medium", once(imbalance), "Much Latin script"),
        Rule("word_repetition", "medium", once(t.rlike(rf"(?iu){T.EDGE_BEFORE}([\p{{L}}\p{{N}}_]+){T.EDGE_AFTER}(?:{T.SPACE}+\1){{3,}}")), "A word in a loop"),
        Rule("markup_mismatch", "low", once(marks(s) != marks(t)), "List or label marks differ"),
        Rule("date_mismatch", "high", once(dates(s) != dates(t)), "Number of dates differs", "", True),
        Rule("major_omission", "high", once((ws > 10) & (F.try_divide(wt, ws) < 0.4)), "Much left out"),
        Rule("major_addition", "medium", once((ws > 10) & (F.try_divide(wt, ws) > 2.5)), "Much added"),
        Rule("negation_flip", "high", once(F.exists(s_words, lambda w: w.isin(ENGLISH_NEGATION)) & ~has_any(t, NEPALI_NEGATION)), "Negation missing"),
        Rule("honorific_inconsistency", "medium", once(has_any(t, HONORIFIC_HIGH) & has_any(t, HONORIFIC_LOW)), "Mixed forms of respect"),
        Rule("instruction_leak", "medium", once(F.exists(first_words, lambda w: w.isin(INSTRUCTION_KEYWORDS))), "Instructions in the text"),
        Rule("placeholder_broken", "high", once(minus(placeholders(s), placeholders(t)) > 0), "Placeholder lost"),
        Rule("directional_flip", "high", once(*(has_any(sl, a) & has_any(t, b) for a, b in DIRECTIONS)), "Direction turned round"),
        Rule("currency_missing", "high", once(*(m[0] for m in money)), "Currency lost"),
        Rule("currency_unlocalized", "medium", once(*(m[1] for m in money)), "Currency in Latin script"),
        Rule("currency_suboptimal", "low", once(*(m[2] for m in money)), "Currency spelled by its sound", "", True),
        Rule("list_sequence_broken", "high", once((F.size(ms) > 0) & (F.size(mt) > 0) & (ms != mt)), "Numbering differs"),
        *(Rule("forbidden_term", severity, once(t.rlike(f"(?iu){T.EDGE_BEFORE}{term}{T.EDGE_AFTER}")), "Term not in use") for term, severity in FORBIDDEN),
        Rule("logical_flow_broken", "medium", once(*(has_word(sl, a) & ~has_any(td, b) for a, b in CONNECTIVES)), "Connective lost"),
        Rule("identity_swap", "high", once(reordered(F.col("_names"), td)), "Names in another order"),
        Rule("anchor_mismatch", "high", once(*(has_any(sl, a) & has_any(td, b) & (F.size(anchored(sl, a)) > 0) & (F.size(anchored(td, b)) > 0) & differ(anchored(sl, a), anchored(td, b)) for a, b in ANCHORS)), "Value beside a label differs"),
        Rule("missing_landmark", "high", once(*(has_any(sl, [f"[{w}]" for w in a] + [f"({w})" for w in a]) & ~has_any(td, b) for a, b in LANDMARKS)), "Official mark lost"),
        Rule("certification_missing", "high", once(has_any(sl, ["verified", "certified"]) & ~F.contains(t, F.lit("प्रमाणित"))), "Certification lost"),
        Rule("date_conversion_risk", "high", once(latin_year & native_year), "Year of another calendar"),
        Rule("anachronism_risk", "medium", once(*(has_any(sl, words) for words in OBSOLETE)), "Obsolete term"),
        Rule("transliteration_drift", "low", once(twice & (F.size(runs) >= 2)), "A name in several spellings"),
        Rule("legal_modal_flip", "high", once(*(has_word(sl, MODALS[i][0]) & has_any(td, MODALS[1 - i][1]) & ~has_any(td, MODALS[i][1]) for i in (0, 1))), "Duty and permission exchanged"),
        Rule("untranslated_legalism", "medium", once(*(has_word(tl, [w]) for w in LEGALISMS)), "Legal term left"),
        Rule("legal_anchor_missing", "medium", once(*(has_any(sl, a) & ~has_any(td, b) for a, b in CONDITIONS)), "Legal condition lost"),
        Rule("ghost_entity", "high", once(F.size(ghosts) > 0), "Word that the source lacks", joined(F.array_sort(ghosts), 2)),
        Rule("polarity_flip", "high", once(negatives(s, ENGLISH_NEGATION, True) % 2 != negatives(t, NEPALI_NEGATION, False) % 2), "Sense turned round"),
        Rule("spacing_standard", "low", once(t.rlike(r"[रु$][०-९0-9]")), "No space after the currency"),
        Rule("abbreviation_standard", "low", once(t.rlike(rf"{T.EDGE_BEFORE}न{T.SPACE}*[०-९0-9]")), "Abbreviation without its dot"),
        Rule("unicode_sanitized", "low", once(T.sanitize_unicode(t) != t), "Characters outside the usual form"),
        Rule("ai_filler", "low", once(has_any(F.substring(tl, 1, 50), FILLERS)), "An assistant's filler"),
    ]


#: Codes that processing adds to those of the rules.
OMITTED, FALLBACK, REPAIRED = "total_omission", "api_fallback", "self_repaired"


def reason(code: str, label: str, severity: str | None, detail: Column | str = "", repairable: Column | bool = False) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(code).alias("code"), F.lit(label).alias("label"), F.lit(severity).cast("string").alias("severity"), lit(detail).alias("detail"), lit(repairable).alias("repairable"))


def counted(pairs: DataFrame, source: str, target: str, lang: Column, entities: str | None = None, hits: str | None = None, only: set[str] | None = None) -> DataFrame:
    """pairs with codes, an array of (code, n): how often each rule fires that does, in the order of the rules."""
    found: dict[str, Column] = {}
    for r in rules():
        if only is None or r.code in only:
            found[r.code] = found[r.code] + r.n if r.code in found else r.n
    df = prepared(pairs, source, target, lang, entities, hits)
    df = df.withColumn("_n", F.array(*found.values())).withColumn("codes", F.filter(F.zip_with(F.array(*map(F.lit, found)), "_n", lambda c, n: F.struct(c.alias("code"), n.alias("n"))), lambda x: x["n"] > 0))
    return df.select(*pairs.columns, "codes")


def score(pairs: DataFrame, source: str, target: str, entities: str, hits: str, lang: Column | None = None, reasons_as: str = "risk_reasons", score_as: str = "risk_score") -> DataFrame:
    """pairs with risk_reasons, in the order of the rules, and risk_score: their number, or ten for an empty rendering. Columns of these names are replaced."""
    df = prepared(pairs, source, target, F.lit("en") if lang is None else lang, entities, hits)
    counts, reasons, total = _scoring(id(SparkContext._active_spark_context))
    return df.withColumn("_n", counts).select(*(c for c in pairs.columns if c not in (reasons_as, score_as)), reasons.alias(reasons_as), total.alias(score_as))


@functools.cache
def _scoring(context: int) -> tuple[Column, Column, Column]:
    """How often each rule fires, null for an empty rendering; and from that the reasons and their number."""
    found = _rules(context)
    omitted = (F.col("_ts") == "") & (F.col("_ss") != "")
    only = F.array(reason(OMITTED, "Empty rendering", "high")).cast(f"array<{REASON}>")
    reasons = F.array(*(reason(r.code, r.label, r.severity, r.detail, r.repairable) for r in found))
    told = F.flatten(F.transform(F.filter(F.arrays_zip(reasons.alias("r"), F.col("_n").alias("n")), lambda x: x["n"] > 0), lambda x: F.array_repeat(x["r"], x["n"])))
    counts = F.when(omitted, F.lit(None)).otherwise(F.array(*(r.n for r in found)))
    return counts, F.when(omitted, only).otherwise(told.cast(f"array<{REASON}>")), F.when(omitted, F.lit(10.0)).otherwise(F.aggregate("_n", F.lit(0), lambda a, x: a + x).cast("double"))
