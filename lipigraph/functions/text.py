"""Scalar functions on text, as Column expressions wherever Catalyst has the parts."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII_DIGITS, NATIVE_DIGITS = "0123456789", "०१२३४५६७८९"
SCOPE_NONE = "__none__"
#: A word as Python's \w+ sees it; Java's \w knows ASCII alone.
WORD = r"[\p{L}\p{N}_]+"
#: Word borders as Python sees them: marks and joiners are no part of a word.
EDGE_BEFORE, EDGE_AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"

#: Two or more Latin letters or hyphens that begin with a letter, between such borders.
LATIN_TOKEN = EDGE_BEFORE + r"[A-Za-z][A-Za-z-]+(?:(?<=[A-Za-z])(?![\p{L}\p{N}_])|(?<=-)(?=[\p{L}\p{N}_]))"


# Python counterparts, for use inside Arrow functions.
def display_form(text: str | None) -> str:
    return " ".join(unicodedata.normalize("NFKC", text or "").split())


def plain_form(text: str | None) -> str:
    return display_form(text).casefold()


TO_ASCII, TO_NATIVE = str.maketrans(NATIVE_DIGITS, ASCII_DIGITS), str.maketrans(ASCII_DIGITS, NATIVE_DIGITS)


#: White space as Python's str.split() sees it.
SPACE = r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def _icu(cls: str, method: str, text: Column) -> Column:
    """A string function of the ICU library that Spark ships; null is the empty text, and text in ASCII alone doesn't leave generated code for it."""
    return F.java_method(F.lit(f"com.ibm.icu.{cls}"), F.lit(method), F.coalesce(text, F.lit("")), F.lit(True))


def compatible(text: Column | str) -> Column:
    """Compatibility form (NFKC). Null is the empty text."""
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(_icu("text.Normalizer", "compose", c))


def casefold(text: Column) -> Column:
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(_icu("lang.UCharacter", "foldCase", text))


SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def display_normalize(text: Column | str) -> Column:
    """Compatibility form with single spaces. Null is the empty text."""
    return F.trim(F.regexp_replace(compatible(text), f"{SPACE}+", " "))


def normalize_text(text: Column | str) -> Column:
    """Compatibility form with single spaces, without case. Null is the empty text."""
    return casefold(display_normalize(text))


def sanitize_unicode(text: Column | str) -> Column:
    """Compatibility form without control, format and unassigned characters, but for line breaks and tabs. Null stays null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.when(c.isNotNull(), F.regexp_replace(compatible(c), r"[\p{C}&&[^\n\r\t]]", ""))


def contains_devanagari(text: Column) -> Column:
    return text.rlike(r"[ऀ-ॿ]")


def to_native_digits(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), ASCII_DIGITS, NATIVE_DIGITS)


def to_ascii_digits(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), NATIVE_DIGITS, ASCII_DIGITS)


def scope(value: Column) -> Column:
    """A blank subdomain as the sentinel that joins can use."""
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit(SCOPE_NONE))


def shown_scope(value: Column) -> Column:
    return F.nullif(F.nullif(value, F.lit(SCOPE_NONE)), F.lit(""))


def title_label(*parts: Column) -> Column:
    """Codes as a readable label: underscores to spaces, each word capitalised, parts joined by a slash; nulls left out."""
    nice = lambda c: F.nullif(F.initcap(F.trim(F.regexp_replace(c, "_", " "))), F.lit(""))
    return F.concat_ws(" / ", *(nice(c) for c in parts))


def effective_text(approved: Column, candidate: Column) -> Column:
    """The approved text, else the candidate; an empty approval counts as none."""
    return strip(F.coalesce(F.nullif(approved, F.lit("")), candidate, F.lit("")))


def without_urls(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)https?://[^\s,;]+", " ")


def numbers(text: Column) -> Column:
    """Distinct numbers in ASCII digits; a date or a phone is one number."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"[+0-9०-९]+(?:[,.\-:/][+0-9०-९]+)*"), F.lit(0)), lambda x: F.translate(x, NATIVE_DIGITS, ASCII_DIGITS)))


def latin_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LATIN_TOKEN), F.lit(0))


def words(text: Column) -> Column:
    """What white space parts."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def count_of(text: Column, what: str) -> Column:
    """Occurrences of one character."""
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def structural_label(text: Column) -> Column:
    """What stays of a segment that is a number, a section label, a roman numeral, a bullet or a leader; null for others and for dates."""
    t = strip(text)
    date = text.rlike(r"(?<![\p{L}\p{N}_])(?:\p{Nd}{4}[-/]\p{Nd}{1,2}[-/]\p{Nd}{1,2}|\p{Nd}{1,2}[-/]\p{Nd}{1,2}[-/]\p{Nd}{2,4})(?![\p{L}\p{N}_])")
    return (
        F.when(text.isNull() | date, F.lit(None).cast("string"))
        .when(t.rlike(r"^(?:#\p{Nd}+|\p{Nd}+(?:[.,:/-]\p{Nd}+)*)$"), to_native_digits(t))
        .when(t.rlike(r"^[ivxlcdmIVXLCDM]{1,8}$") | t.rlike(r"^[•\-–—]$") | (t.rlike(r"^[.·•\-–—\s]{3,}$") & t.rlike(r"[.·•]")), t)
    )


# Openings of assistants' answers.
CHATTER = ["Sure, here is the translation:", "Sure, here's the translation:", "Translation:", "Translated text:", "Here is the translation in Nepali:", "Sure!", "Okay,"]


def let(value: Column, body) -> Column:
    """body of a value that is evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def strip_chatter(text: Column) -> Column:
    """Without such openings, tested in turn; quotation marks around the rest go with an opening."""

    def step(now: Column, opening: Column) -> Column:
        rest = strip(now.substr(F.length(opening) + 1, F.length(now)))
        return F.when(F.startswith(F.lower(now), F.lower(opening)), strip(F.regexp_replace(rest, '(?s)^"(?:(.*)")?$', "$1"))).otherwise(now)

    return F.aggregate(F.array(*map(F.lit, CHATTER)), strip(text), step)


def neighbours_equal(words: Column) -> Column:
    """Whether any word of more than one character stands twice in a row."""

    def twice(w: Column) -> Column:
        return F.when(F.size(w) < 2, False).otherwise(F.exists(F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: a == b), lambda x: x))

    return let(F.filter(words, lambda x: F.length(x) > 1), twice)


def house_style(source: Column, target: Column, lang: Column) -> Column:
    """Currency marks, abbreviations and digits in the style of the target language; in short segments a doubled word once."""
    native = target
    for word in ("एनपीआर", "एन.पी.आर.", "रुपैया"):
        native = F.replace(native, F.lit(word), F.lit("रु"))
    native = F.regexp_replace(native, rf"(^|[ऀ-ॿ]|{SPACE})NPR{SPACE}*([०-९0-9])", "$1रु $2")
    native = F.regexp_replace(native, r"([रु$])([०-९0-9])", "$1 $2")
    native = F.regexp_replace(native, rf"{EDGE_BEFORE}न{SPACE}+([०-९0-9])", "नं. $1")
    latin = F.replace(F.replace(target, F.lit("रु"), F.lit("NPR")), F.lit("एनपीआर"), F.lit("NPR"))
    latin = F.regexp_replace(to_ascii_digits(latin), r"(NPR|Rs\.?)([0-9])", "$1 $2")
    alone = ~neighbours_equal(words(F.lower(source)))

    def once(text: Column) -> Column:
        twice = lambda kind: rf"(^|{SPACE})([{kind}]+){SPACE}+\2($|{SPACE})"
        single = F.regexp_replace(F.regexp_replace(text, twice("ऀ-ॿ"), "$1$2$3"), twice("a-zA-Z"), "$1$2$3")
        return F.when((F.size(words(text)) <= 4) & alone, F.trim(F.regexp_replace(single, f"{SPACE}+", " "))).otherwise(text)

    return let(F.when(F.lower(lang) == "ne", native).when(F.lower(lang) == "en", latin).otherwise(target), once)
