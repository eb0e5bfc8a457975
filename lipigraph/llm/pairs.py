"""Problem 2: pairs of a source and its rendering that are defective, with every type of defect that shows.

Ordered rules on each pair: emptiness, refusal phrases in several languages, copied text (whole, behind a prefix, or in
another script), script and language that aren't the target's, then truncation. A delimiter that stays open and an ending on
a mark that goes on (an ellipsis, comma, opening bracket) are truncations by themselves where the source has no such thing.
An ending without its closing mark is none by itself: it is one together with a length that the renderings of that pair of
languages don't have, as is such a length alone where it is far off. The usual lengths are medians over all pairs.

Defined results: pairs whose source has nothing to translate have no defect; a null rendering beside a source with words
is empty; a null source or target language only leaves out the rules that need it; texts count whole; repeated rows each
get their result.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lipigraph.llm.langid import LangModel, tokens_of
from lipigraph.llm.lookalike import fold
from lipigraph.llm.pii import detect, Names
from lipigraph.llm.roman import romanise
from lipigraph.session import spread, stable

TYPES = ("empty", "refusal", "copied", "wrong_language", "truncated")

# What stands in for nothing.
STAND_INS = {
    "null", "none", "nil", "nan", "na", "n/a", "undefined", "empty", "blank", "tbd", "todo", "no translation", "not translated", "untranslated", "no output", "no result", "no text", "translation missing", "missing translation", "missing", "translation unavailable",
    "अनुवाद छैन", "अनुवाद उपलब्ध छैन", "खाली", "शून्य",
}
EDGES = " \t\n\r\v\f​⁠﻿ ­   \"'“”‘’()[]{}<>*-–—_.…।:;,!?#/|•·"

# How a provider declines, in its own person.
REFUSALS = [
    r"\bi(?:['’]m| am)? (?:sorry|afraid)?,? ?(?:but )?(?:i )?(?:can(?:no|['’])t|cannot|can not|won['’]?t|will not|would not|am unable|am not able|must decline|have to decline|refuse)\b",
    r"\bi(?:['’]m| am) (?:unable|not able|not allowed|not permitted)\b",
    r"\b(?:sorry|unfortunately|apologies)\b.{0,40}\b(?:i|we) (?:can(?:no|['’])t|cannot|won['’]?t|am|are)\b",
    r"\bmy (?:guidelines|policy|policies|instructions|rules)\b.{0,30}\b(?:do|does|don['’]t|doesn['’]t|not|prevent|forbid)",
    r"\bas an? (?:\w+ )?(?:ai|assistant|language model|translation (?:assistant|model|system))\b",
    r"(?:^|[ ,।(])म .{0,60}(?:सक्दिनँ|सक्दिन|असमर्थ|मिल्दैन|सकिनँ)",
    r"(?:माफ गर्नुहोस्|माफ गर्नुहोला|क्षमा गर्नुहोस्|क्षमा गर्नुहोला|दुर्भाग्यवश|सहायकका रूपमा).{0,80}(?:सक्दिनँ|सक्दिन|असमर्थ|मिल्दैन|सकिनँ)",
    r"ङासे .{0,60}(?:आखाम|लाबारी आखाम)",
    r"(?:सेम आनागो|माफ लागो|ङा ग्योइ ह्रोबा हिन्ना).{0,80}आखाम",
    r"मैं .{0,60}(?:नहीं कर सकता|असमर्थ हूँ|नहीं कर सकती)",
]
REFUSAL = re.compile("|".join(REFUSALS))
ROMAN_REFUSAL = re.compile(r"\bma (?:yo|yas|yas?to).{0,60}(?:sakdina|asamartha|mildaina)|(?:maapha? garnuho|kshamaa garnuho|durbhaagyawash).{0,80}(?:sakdina|asamartha|mildain)|ngaase .{0,60}aakhaam")
#: Without one of these no refusal matches.
REFUSAL_WORDS = ("can't", "can’t", "cannot", "can not", "won't", "won’t", "will not", "would not", "unable", "not able", "not allowed", "not permitted", "decline", "refuse", "sorry", "unfortunately", "apologies", "guideline", "polic", "instructions", "rules do", "my rules", "assistant", "language model", "an ai", "सक्दिन", "असमर्थ", "मिल्दैन", "सकिनँ", "आखाम", "नहीं कर", "sakdina", "asamartha", "mildain", "aakhaam")
DIGITS = str.maketrans("०१२३४५६७८९", "0123456789")
CLOSING = tuple(".।॥?!")
ABRUPT = ("…", "...", "..", ",", ";", "-", "–", "—", ":", "(", "“", "/")
#: Marks that go on; a colon, dash or slash may end a label and counts after sentences alone.
GOES_ON, GOES_ON_SENTENCE = ("…", "..", ",", ";", "(", "“", "[", "{"), (":", "-", "–", "—", "/")
DELIMITERS = (("(", ")"), ("[", "]"), ("{", "}"), ("“", "”"), ("«", "»"))
# What a provider reports of an answer that it cut. It reports it of whole answers too, so this decides nothing.
CUT = ("longer than limit", "length limit", "max tokens", "max_tokens", "truncated")
PREFIX = re.compile(r"^\s*(?:\[[^\]]{1,20}\]|\([^)]{1,20}\)|[A-Za-z]{2,12}\s*[:>-]+)\s*")


def key(text: str) -> str:
    """Letters, marks and digits alone, alike for case, width, layout and script of digits."""
    return "".join(regex.findall(r"[\p{L}\p{M}\p{N}]+", fold(text).casefold().translate(DIGITS)))


def numbers(text: str) -> list[str]:
    return [str(int(x)) for x in re.findall(r"\d+", text)]


def left_open(text: str) -> set[str]:
    """The delimiters that a text opens more often than it closes them."""
    return {a for a, b in DELIMITERS if text.count(a) > text.count(b)} | ({'"'} if text.count('"') % 2 else set())


def broken_off(src: str, cand: str, whole: bool) -> bool:
    """Whether a rendering leaves a delimiter open or ends on a mark that goes on, unlike its source."""
    marks = GOES_ON + GOES_ON_SENTENCE if whole else GOES_ON
    ends = lambda x: x.rstrip(" \n\t\"'”’").endswith(marks)
    return bool(left_open(cand) - left_open(src)) or ends(cand) and not ends(src)


class PairReader:
    """The types a pair shows of itself, and what is needed to judge its length."""

    def __init__(self, model: LangModel) -> None:
        self.model = model

    def language(self, text: str) -> tuple[str | None, float, int, bool]:
        """Language of most letters, confidence of its surest sentence, words, whether there is a whole sentence."""
        letters: dict[str, int] = {}
        sure: dict[str, float] = {}
        words, whole = 0, False
        for s in tokens_of(text):
            lang, p, n, k = self.model.of_sentence(s)
            if lang:
                letters[lang] = letters.get(lang, 0) + k
                sure[lang] = max(sure.get(lang, 0.0), p if n >= 3 else 0.0)
                words += n
                whole |= n >= 6 or n >= 3 and s[-1].endswith(CLOSING)
        if not letters:
            return None, 0.0, 0, False
        lang = max(letters, key=lambda x: letters[x])
        return lang, sure[lang], words, whole

    def __call__(self, source: str | None, candidate: str | None, target: str | None) -> tuple[list[str], str | None, float, bool, bool]:
        """Types; the kind of pair, log of the lengths' ratio, whether the ending is abrupt, whether the last number is missing."""
        src, cand = fold(source or ""), fold(candidate or "")
        from_lang, src_sure, words, whole = self.language(src)
        if not words:
            return [], None, 0.0, False, False
        bare = cand.strip(EDGES)
        if not bare or bare.casefold() in STAND_INS:
            told = words >= 4 or src_sure >= 0.9 or words and len(src.split()) <= 3 and not self.personal(src)
            return (["empty", *["truncated"] * broken_off(src, cand, whole)] if told else []), None, 0.0, False, False
        types = []
        low = cand.casefold()
        if any(w in low for w in REFUSAL_WORDS) and (REFUSAL.search(low) or ROMAN_REFUSAL.search(low)) and not (REFUSAL.search(src.casefold()) or ROMAN_REFUSAL.search(src.casefold())):
            types.append("refusal")
        to_lang, sure, to_words, _ = self.language(cand)
        latin = "r" if src.isascii() and from_lang != "en" else ""
        to_latin = "r" if cand.isascii() and to_lang != "en" else ""
        if whole and (to_lang == from_lang or to_lang != target):
            a, b = key(src), key(PREFIX.sub("", cand))
            same = a == b or bool(a) and not b.replace(a, "") or len(a) >= 20 and (a in b and len(b) <= 1.3 * len(a) or b in a and len(b) >= 0.9 * len(a) and from_lang != target)
            if not same and to_lang == from_lang and from_lang != target and (latin != to_latin) and len(a) >= 15:
                ra, rb = key(romanise(src)), key(romanise(PREFIX.sub("", cand)))
                same = ra == rb or alike(ra, rb)
            if same:
                types.append("copied")
            if to_lang and target and to_lang != target and to_words >= 3 and sure >= 0.8:
                types.append("wrong_language")
        if broken_off(src, cand, whole):
            types.append("truncated")
        ending = cand.rstrip(" \n\t\"'”’)]")
        abrupt = not ending.endswith(CLOSING) or ending.endswith(ABRUPT) or cand.count("(") > cand.count(")") or cand.count("“") > cand.count("”")
        if abrupt and not src.rstrip(" \n\t\"'”’)]").endswith(CLOSING) and not ending.endswith(ABRUPT):
            abrupt = False
        ns, nc = numbers(src), set(numbers(cand))
        # A heading has no usual length: only sentences, lists of fields and abrupt endings are judged by it.
        judged = abrupt or whole and (src.rstrip(" \n\t\"'”’)]").endswith(CLOSING) or ";" in src)
        return types, f"{from_lang}{latin}>{to_lang}{to_latin}" if to_lang and judged else None, math.log(len(cand.strip()) / max(1, len(src.strip()))), abrupt, bool(ns) and ns[-1] not in nc

    def personal(self, text: str) -> bool:
        return bool(detect(text, NOBODY))


NOBODY = Names(set(), set())


def alike(a: str, b: str) -> bool:
    """Whether two romanised keys differ at most in how they spell vowels."""
    squeeze = re.compile(r"[aeiou]+")
    x, y = squeeze.sub("", a), squeeze.sub("", b)
    return len(x) >= 10 and x == y


#: Log ratio of lengths below the median from which a rendering is too short: where its ending is abrupt, and anyhow.
SHORT_ABRUPT, SHORT = -0.26, -0.5
SHORT_NUMBER = -0.16


def find_defects(pairs: DataFrame, model: LangModel) -> DataFrame:
    """(segment_id, types array<string>) for pairs (segment_id, source_text, candidate_text, target_lang) with a defect; types in the order of the rules."""
    shared = pairs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("segment_id", pa.string()), ("types", pa.list_(pa.string())), ("kind", pa.string()), ("ratio", pa.float64()), ("abrupt", pa.bool_()), ("number", pa.bool_()), ("long", pa.bool_()), ("hit", pa.bool_())])

    def run(batches):
        read = PairReader(shared.value)
        for b in batches:
            ids, src, cand, tl = (c.to_pylist() for c in b.columns)
            got = [read(s, c, t) for s, c, t in zip(src, cand, tl, strict=True)]
            hit = [bool(g[1]) and g[1].split(">")[1].rstrip("r") == t for g, t in zip(got, tl, strict=True)]
            cols = [ids, *([g[k] for g in got] for k in range(5)), [len(s or "") >= 25 for s in src], hit]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    ddl = "segment_id string, types array<string>, kind string, ratio double, abrupt boolean, number boolean, long boolean, hit boolean"
    read = stable(pairs.select("segment_id", "source_text", "candidate_text", "target_lang").mapInArrow(run, ddl))
    # As many rows as pairs of languages and scripts.
    usual = read.where("hit and long and size(types) = 0").groupBy("kind").agg(F.percentile_approx("ratio", 0.5, 1000).alias("usual"))
    d = F.col("ratio") - F.col("usual")
    short = F.col("kind").isNotNull() & (
        (F.col("abrupt") & (d < F.when(F.col("long"), SHORT_ABRUPT).otherwise(2 * SHORT_ABRUPT))) | (F.col("long") & (d < SHORT)) | (F.col("abrupt") & F.col("number") & (d < SHORT_NUMBER))
    )
    truncated = F.when(F.coalesce(short, F.lit(False)), F.array(F.lit("truncated"))).otherwise(F.array().cast("array<string>"))
    return read.join(F.broadcast(usual), "kind", "left").select("segment_id", F.array_union("types", truncated).alias("types")).where(F.size("types") > 0)


def pairs_of(segments: DataFrame, translations: DataFrame, documents: DataFrame) -> DataFrame:
    """Each translation with its source text and its document's target language. The language travels on narrow rows; texts are shuffled once, on the segment."""
    lang = segments.select(F.col("id").alias("segment_id"), "document_id").join(documents.select(F.col("id").alias("document_id"), "target_lang"), "document_id", "left").select("segment_id", "target_lang")
    return (
        translations.select("segment_id", "candidate_text")
        .join(segments.select(F.col("id").alias("segment_id"), "source_text"), "segment_id")
        .join(lang, "segment_id", "left")
    )


def reported(results: DataFrame) -> DataFrame:
    """(segment_id, n_errors, n_cut): attempts at a segment that reported an error, and one of an answer that was cut."""
    cut = F.lit(False)
    for phrase in CUT:
        cut = cut | F.contains(F.lower("error"), F.lit(phrase))
    return results.where(F.col("segment_id").isNotNull()).groupBy("segment_id").agg(F.count_if(F.col("error").isNotNull()).alias("n_errors"), F.count_if(cut).alias("n_cut"))
