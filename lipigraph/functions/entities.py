"""Protected entities: finding them, the spellings in which a rendering may keep them, and whether it does."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lipigraph.functions import text as T
from lipigraph.functions.arrow import arrow
from lipigraph.functions.text import TO_ASCII, TO_NATIVE

ENTITY = "struct<kind:string,text:string,start:int,end:int,target_term:string,segment_source_len:int>"
HIT = "struct<source_term:string,target_term:string,term_type:string>"

# Kinds and their patterns, in order of priority.
PATTERNS = [
    ("email", r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+", 0),
    ("url", r"https?://[^\s,;]+", re.I),
    ("money", r"(?:NPR|Rs\.?|रु\.?|\$)\s?\d[\d,]*(?:\.\d+)?", re.I),
    ("date", r"\b(?:[0-9०-९]{4}[-/][0-9०-९]{1,2}[-/][0-9०-९]{1,2}|[0-9०-९]{1,2}[-/][0-9०-९]{1,2}[-/][0-9०-९]{2,4})\b", 0),
    ("ward", r"\bWard\s*(?:No\.?|Number)?\s*[-:]?\s*\d+\b", re.I),
    ("id", r"\b(?:ID|Ref|Reference|Citizenship)\s*(?:ID|No\.?|Number)?\s*[-:]?\s*[A-Z0-9/-]*\d[A-Z0-9/-]{1,}\b", re.I),
    ("id", r"\b[A-Z]{2,}(?:-[A-Z0-9]{2,})+\b", 0),
    ("phone", r"(?:\+[9९][7७]{2}[-\s]?)?(?:[0-9०-९][-\s]?){7,12}[0-9०-९]", 0),
    ("number", r"\b[0-9०-९]+(?:[,.][0-9०-९]+)*\b", 0),
]
COMPILED = [(kind, re.compile(p, flags)) for kind, p, flags in PATTERNS]
NUMBER = re.compile(r"[+0-9०-९]+(?:[,.\-:/][+0-9०-९]+)*")
VERBATIM = {"url", "email", "phone", "id"}


def find_entities(text: str | None, hits: list[dict] | None = None) -> list[dict]:
    """Entities in order of their place. A match that touches an earlier pattern's is dropped, not sought anew; offices come from glossary hits and may touch others."""
    if not text:
        return []
    free = bytearray(len(text))
    found = []
    for kind, pattern in COMPILED:
        for m in pattern.finditer(text):
            a, b = m.span()
            if not any(free[a:b]):
                free[a:b] = b"\1" * (b - a)
                found.append({"kind": kind, "text": m[0], "start": a, "end": b, "target_term": None, "segment_source_len": len(text)})
    low = text.lower()
    for h in hits or []:
        if h["term_type"] == "office" and h["source_term"] and (a := low.find(h["source_term"].lower())) >= 0:
            b = a + len(h["source_term"])
            found.append({"kind": "office", "text": text[a:b], "start": a, "end": b, "target_term": h["target_term"], "segment_source_len": len(text)})
    return sorted(found, key=lambda e: (e["start"], e["end"]))


@arrow(f"array<{ENTITY}>")
def detect_entities(text: pd.Series) -> pd.Series:
    return text.map(find_entities)


@arrow(f"array<{ENTITY}>")
def detect_entities_with(text: pd.Series, hits: pd.Series) -> pd.Series:
    return pd.Series([find_entities(t, None if h is None else list(h)) for t, h in zip(text, hits, strict=True)])


# Renderings of sums of money and of wards.
MONEY_FORMS = ["NPR {n}", "रु {n}", "रु. {n}", "एनपीआर {n}", "रुपैया {n}"]
WARD_FORMS = ["वडा नं. {n}", "वडा नं. {a}", "वडा नम्बर {n}", "वडा नम्बर {a}"]


def variants(kind: str, text: str, target_term: str | None = None) -> list[str]:
    """forms() for use inside Arrow functions."""
    if kind == "office":
        return [target_term or text]
    if kind in VERBATIM:
        return [text]
    forms = [text, text.translate(TO_NATIVE)]
    number = NUMBER.search(text) if kind in ("money", "ward") else None
    if number:
        a = number[0].translate(TO_ASCII)
        forms += [f.format(n=a.translate(TO_NATIVE), a=a) for f in (MONEY_FORMS if kind == "money" else WARD_FORMS)]
    return list(dict.fromkeys(forms))


def full(df: DataFrame, column: str) -> Column:
    """A column of entities with every field of ENTITY, whichever of them it has; null is none."""
    return _filled(df, column, ENTITY)


def full_hits(df: DataFrame, column: str) -> Column:
    """The same for glossary hits."""
    return _filled(df, column, HIT)


def _filled(df: DataFrame, column: str, ddl: str) -> Column:
    has = df.schema[column].dataType.elementType.names
    parts = [x.split(":") for x in ddl.removeprefix("struct<").removesuffix(">").split(",")]
    item = lambda e: F.struct(*((e[n] if n in has else F.lit(None)).cast(t).alias(n) for n, t in parts))
    return F.coalesce(F.transform(column, item), F.array().cast(f"array<{ddl}>"))


def number_in(text: Column) -> Column:
    """The first number of a text, in ASCII digits; empty if there is none."""
    return F.translate(F.regexp_extract(text, NUMBER.pattern, 0), T.NATIVE_DIGITS, T.ASCII_DIGITS)


def forms(e: Column) -> Column:
    """Spellings of an entity that count as kept, the plain ones first."""
    return _forms(e, lambda x: x)


def shown_forms(e: Column) -> Column:
    """The same in display form, which the spellings that are made of digits and labels have anyway."""
    return _forms(e, T.display_normalize)


def _forms(e: Column, shown) -> Column:
    text = F.coalesce(e["text"], F.lit(""))
    plain = F.array(shown(text), shown(T.to_native_digits(text)))

    def labelled(templates: list[str]) -> Column:
        part = lambda x, n: T.to_native_digits(n) if x == "{n}" else n if x == "{a}" else F.lit(x)
        made = lambda n: F.array(*(F.concat(*(part(x, n) for x in re.split(r"({\w})", f) if x)) for f in templates))
        return F.concat(plain, T.let(number_in(e["text"]), lambda n: F.when(n == "", F.array().cast("array<string>")).otherwise(made(n))))

    return (
        F.when(e["kind"] == "office", F.array(shown(F.coalesce(F.nullif(e["target_term"], F.lit("")), text))))
        .when(e["kind"].isin(*VERBATIM), F.array(shown(text)))
        .when(e["kind"] == "money", labelled(MONEY_FORMS))
        .when(e["kind"] == "ward", labelled(WARD_FORMS))
        .otherwise(plain)
    )


def is_kept(e: Column, shown: Column, numbers: Column, forms_shown: Column | None = None) -> Column:
    """Whether a target keeps an entity. shown: its display form in ASCII digits; numbers: its numbers; forms_shown: shown_forms(), where the caller has them. A number may be part of a longer list of numbers; digits count alike in both scripts."""
    own = T.numbers(F.coalesce(e["text"], F.lit("")))
    some = F.exists(shown_forms(e) if forms_shown is None else forms_shown, lambda v: F.contains(shown, T.to_ascii_digits(v)))
    return F.when(e["kind"] == "number", T.let(own, lambda n: (F.size(n) > 0) & (F.size(F.array_except(n, numbers)) == 0))).otherwise(some)


def count_kept(entities: Column, target: Column) -> Column:
    """How many of the entities the target keeps."""
    text = F.coalesce(target, F.lit(""))
    body = lambda shown: F.size(F.filter(entities, lambda e: is_kept(e, shown, T.numbers(text))))
    return F.when(F.size(entities) <= 0, 0).otherwise(T.let(T.to_ascii_digits(T.display_normalize(text)), body))


def kinds(entities: Column) -> Column:
    """Distinct kinds, sorted, in one text."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(entities, lambda e: e["kind"]))), ", ")


def overlapping(entities: Column) -> Column:
    """Whether two spans of a row overlap; no table join is needed for intervals within a row."""
    return F.exists(entities, lambda a: F.exists(entities, lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"]) & ((a["start"] != b["start"]) | (a["end"] != b["end"]))))
