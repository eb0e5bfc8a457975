"""Providers of renderings: a registry of batch functions, called for each partition, and the fallback from one to another.

No provider of this package opens a connection. One that does gets batches with bounded concurrency, pauses between
requests and retries from Calls."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lipigraph.functions import text as T
from lipigraph.functions import values
from lipigraph.operators import joins
from lipigraph.session import stable

#: (texts, source language, target language) to renderings; None is a row that failed.
Provider = Callable[[list[str], str, str], list[str | None]]
RESULT = "segment_id string, translated_text string, provider_tier string, error string"
# Codes and names of the languages, and the providers' names for them.
LANGUAGE_NAMES = {"en": "English", "eng": "English", "english": "English", "ne": "Nepali", "nep": "Nepali", "nepali": "Nepali", "tmg": "Tamang", "tam": "Tamang", "tm": "Tamang", "tamang": "Tamang"}

REGISTRY: dict[str, Provider] = {}


def register(name: str) -> Callable[[Provider], Provider]:
    def add(f: Provider) -> Provider:
        REGISTRY[name] = f
        return f

    return add


@register("echo")
def echo(texts: list[str], source: str, target: str) -> list[str | None]:
    return list(texts)


@register("mock")
def mock(texts: list[str], source: str, target: str) -> list[str | None]:
    return [f"[mock:{target}] {t}" for t in texts]


def language_name(code: str) -> str:
    try:
        return LANGUAGE_NAMES[code.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown language {code!r}") from None


class Refused(Exception):
    """An answer of a provider that is none: its status, and the seconds it asks to wait."""

    def __init__(self, status: int, retry_after: float | None = None) -> None:
        super().__init__(f"status {status}")
        self.status, self.retry_after = status, retry_after

    @property
    def passing(self) -> bool:
        return self.status == 429 or self.status >= 500


@dataclass
class Calls:
    """How requests are made: texts in a batch, batches at once, least seconds between requests, attempts and the growing wait before them."""

    batch: int = 25
    at_once: int = 8
    pause: float = 0.05
    attempts: int = 3
    wait: float = 0.4
    sleep: Callable[[float], None] = field(default=time.sleep)

    def run(self, provider: Provider, texts: list[str], source: str, target: str) -> list[str | None]:
        size = max(1, self.batch)
        parts = [texts[i : i + size] for i in range(0, len(texts), size)]
        with ThreadPoolExecutor(max(1, self.at_once)) as pool:
            futures = []
            for p in parts:
                futures.append(pool.submit(self.once, provider, p, source, target))
                self.sleep(self.pause)
            out = [x for f in futures for x in f.result()]
        # Rows that failed get one more try, one by one.
        return [x if x else self.once(provider, [t], source, target)[0] for x, t in zip(out, texts, strict=True)]

    def once(self, provider: Provider, texts: list[str], source: str, target: str) -> list[str | None]:
        for k in range(self.attempts):
            try:
                got = provider(texts, source, target)
                return [*got, *[None] * (len(texts) - len(got))][: len(texts)]
            except Refused as e:
                if not e.passing:
                    break
                pause = self.wait * (k + 1) if e.retry_after is None else max(0.0, e.retry_after)
            except OSError:
                pause = self.wait * (k + 1)
            if k + 1 < self.attempts:
                self.sleep(pause)
        return [None] * len(texts)


def translate(work: DataFrame, name: str, provider: Provider | None = None, calls: Calls | None = None) -> DataFrame:
    """(segment_id, translated_text, provider_tier, error) of work (segment_id, source_text, source_lang, target_lang). A blank answer is an error of its row alone."""
    f, how = provider or REGISTRY[name], calls or Calls(pause=0.0)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for (s, t), g in pdf.groupby(["source_lang", "target_lang"], dropna=False):
                got = how.run(f, g.source_text.fillna("").tolist(), s, t)
                good = [bool(x and x.strip()) for x in got]
                yield pd.DataFrame({"segment_id": g.segment_id.values, "translated_text": [x if ok else None for x, ok in zip(got, good, strict=True)], "provider_tier": name, "error": [None if ok else "blank answer" for ok in good]})

    return work.select("segment_id", "source_text", "source_lang", "target_lang").mapInPandas(run, RESULT)


def tiered(work: DataFrame, tiers: list[tuple[str, Provider]], calls: Calls | None = None) -> DataFrame:
    """Results of the first tier that has one for a row; a row that all failed keeps the last error. Each tier's results are kept before the next sees the rest, so no provider is called twice for a row."""
    left, done = work, None
    for k, (name, provider) in enumerate(tiers):
        got = stable(translate(left, name, provider, calls))
        last = k == len(tiers) - 1
        part = got if last else got.where("error IS NULL")
        done = part if done is None else done.unionByName(part)
        if not last:
            left = left.join(got.where("error IS NOT NULL").select("segment_id"), "segment_id", "left_semi")
    return done


def deterministic(work: DataFrame, bank: DataFrame | None = None) -> DataFrame:
    """work (source_text, source_lang, target_lang and more) with translated_text and how it came about: a phrase of the bank, a date, phone, sum or reference in the target's digits, or the source as it is."""
    b = (joins.bank(work.sparkSession) if bank is None else bank).select("key", "lang", "phrase")
    found = joins.phrase_bank(work, b, "source_lang", "source_text")
    into = b.groupBy("key", F.col("lang").alias("target_lang")).agg(F.min("phrase").alias("_phrase"))
    text = T.strip(F.col("source_text"))
    ascii_ = T.to_ascii_digits(text)
    local = F.when(F.col("target_lang") == "en", ascii_).otherwise(T.to_native_digits(ascii_))
    kinds = (
        F.when(F.col("_phrase").isNotNull(), "phrase").when(text.rlike(values.DATE_VALUE), "date").when(text.rlike(values.MONEY_VALUE), "money").when(text.rlike(values.PHONE_VALUE), "phone").when(ascii_.rlike(values.REFERENCE_VALUE), "reference").otherwise("echo")
    )
    out = found.join(F.broadcast(into), ["key", "target_lang"], "left").withColumn("_kind", kinds)
    said = F.when(F.col("_kind") == "phrase", F.col("_phrase")).when(F.col("_kind").isin("date", "money", "phone"), local).when(F.col("_kind") == "reference", ascii_).otherwise(F.col("source_text"))
    return out.select(*work.columns, said.alias("translated_text"), F.col("_kind").alias("how"))


def in_order(results: DataFrame, requested: DataFrame) -> DataFrame:
    """results in the order of the requests (segment_id, document_id, sequence)."""
    return results.join(requested.select("segment_id", "document_id", "sequence"), "segment_id").orderBy("document_id", "sequence", "segment_id")


def filled(requested: DataFrame, results: DataFrame) -> DataFrame:
    """Every requested row with its first good result; a row without any gets an error."""
    best = results.groupBy("segment_id").agg(F.min_by(F.struct("translated_text", "provider_tier", "error"), F.struct(F.col("error").isNotNull(), "translated_text")).alias("r"))
    return requested.select("segment_id").join(best, "segment_id", "left").select("segment_id", "r.translated_text", "r.provider_tier", F.when(F.col("r").isNull(), "no answer").otherwise(F.col("r.error")).alias("error"))


def response_text(payload):
    """The text of a provider's JSON answer: a key that is known, else the first of its values that isn't blank."""
    known = F.coalesce(*(F.nullif(F.trim(F.get_json_object(payload, f"$.{k}")), F.lit("")) for k in ("NLLB200", "translated_text", "translation", "output", "text")))
    first = F.filter(F.map_values(F.from_json(payload, "map<string,string>")), lambda v: F.trim(F.coalesce(v, F.lit(""))) != "")
    return F.coalesce(known, F.when(F.size(first) > 0, first[0]))
