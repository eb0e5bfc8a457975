"""Problem 4: the language of documents and of segments that mix languages, with a confidence.

A sparse multinomial logistic regression on TF-IDF character n-grams (within words, with word borders), trained with
follow-the-regularised-leader and elastic-net penalties on labelled samples, then calibrated by a temperature on
samples held out. Since no n-gram crosses a word, a text's score is the sum of its words' scores: a worker computes
each distinct word once.

Defined results: null and texts without words (numbers, codes, links) have no language and confidence 0; empty tables
give empty results; a tie between languages goes to the first in alphabetical order; texts count whole.
"""

from __future__ import annotations

import math
import re
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lipigraph.llm.lookalike import fold
from lipigraph.llm.roman import romanise
from lipigraph.session import spread, stable

BITS = 16
ORDERS = (1, 2, 3, 4)
WORD = regex.compile(r"[\p{L}\p{M}‍]+")
# Written marks of money and numbering, the same in any language.
MARKS = {"npr", "rs", "रु", "नं", "no", "h", "n", "kv", "kf"}
ADDRESS = regex.compile(r"\S+\s*[\[(]\s*(?:at|dot)\s*[\])]\s*\S+(?:\s*[\[(]\s*dot\s*[\])]\s*\S+)*|\[[A-Z_]+\]")
ENDS = ".।॥?!"
ENDS_SENTENCE = tuple(ENDS)
MAX_TRAIN_ROWS = 20_000
CACHE_WORDS = 200_000


def grams(word: str) -> list[int]:
    w = f"<{word}>"
    return [zlib.crc32(f"{n}{w[i : i + n]}".encode()) & ((1 << BITS) - 1) for n in ORDERS for i in range(len(w) - n + 1)]


def token_words(token: str) -> list[str]:
    """The words of a token between spaces; none in numbers, codes, links and mail addresses."""
    if "@" in token or "://" in token or any(c.isnumeric() for c in token):
        return []
    return [w for w in WORD.findall(fold(token).casefold().replace("‍", "")) if w not in MARKS]


def tokens_of(text: str) -> list[list[str]]:
    """The tokens of each sentence: lines, cells between bars or slashes, and what ends in a closing mark."""
    if "[" in text or "(" in text:
        text = ADDRESS.sub(" ", text)
    text = fold_spaces(text)
    out: list[list[str]] = []
    for line in text.split("\n"):
        now: list[str] = []
        for t in line.replace("।", "। ").split(" "):
            if not t:
                continue
            if t in ("/", "|", "।"):
                if now:
                    out.append(now)
                now = []
                continue
            now.append(t)
            if t[-1] in ENDS and (t[-1] != "." or len(t) > 4) or t[-1] in "”\"')" and len(t) > 1 and t[-2] in ENDS:
                out.append(now)
                now = []
        if now:
            out.append(now)
    return out


SPACES = str.maketrans({c: " " for c in "\u00a0\u2007\u2009\u202f\u3000\u2002\u2003\u2004\u2005\u2006\u2008\u200a\u1680"} | {c: "" for c in "\u200b\u2060\ufeff\u00ad"})


UNUSUAL = re.compile("[" + "".join(map(chr, SPACES)) + "]")


def fold_spaces(text: str) -> str:
    text = text.replace("\t", " ").replace("\r", "\n")
    return text if text.isascii() or not UNUSUAL.search(text) else text.translate(SPACES)


def words_of(text: str) -> list[str]:
    return [w for s in tokens_of(text) for t in s for w in token_words(t)]


class LangModel:
    """weights: for each gram, its idf and idf times weight for each language; temperature."""

    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float) -> None:
        self.langs, self.bias, self.temperature = langs, bias.tolist(), temperature
        self.table = np.concatenate([idf[:, None] * weights, idf[:, None]], axis=1).astype(np.float32)
        self.cache: dict[str, tuple[float, ...]] = {}
        self.tokens: dict[str, tuple[tuple[float, ...], int, int]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}, "tokens": {}}

    def of_token(self, token: str) -> tuple[tuple[float, ...], int, int]:
        """The score of a token, its words and letters."""
        got = self.tokens.get(token)
        if got is None:
            if len(self.tokens) > CACHE_WORDS:
                self.tokens.clear()
            words = token_words(token)
            got = self.tokens[token] = (tuple(map(sum, zip(*map(self.of_word, words), strict=True))), len(words), sum(map(len, words)))
        return got

    def sums(self, tokens: list[str]) -> tuple[list[float], int, int]:
        """The score of a sentence, its words and letters."""
        total, words, letters = [0.0] * (len(self.langs) + 1), 0, 0
        for t in tokens:
            score, n, k = self.of_token(t)
            if n:
                total = [a + b for a, b in zip(total, score)]  # noqa: B905
                words += n
                letters += k
        return total, words, letters

    def of_sentence(self, tokens: list[str]) -> tuple[str | None, float, int, int]:
        """Language, confidence, words, letters."""
        total, words, letters = self.sums(tokens)
        return (*self.decide(total), words, letters) if words else (None, 0.0, 0, 0)

    def of_word(self, word: str) -> tuple[float, ...]:
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) > CACHE_WORDS:
                self.cache.clear()
            got = self.cache[word] = tuple(self.table[grams(word)].sum(axis=0).tolist())
        return got

    def probabilities(self, total: list[float]) -> list[float]:
        """The calibrated probability of each language."""
        mass = (total[-1] or 1.0) / SCALE * self.temperature
        z = [x / mass + b / self.temperature for x, b in zip(total, self.bias)]  # noqa: B905
        top = max(z)
        e = [math.exp(x - top) for x in z]
        whole = sum(e)
        return [x / whole for x in e]

    def decide(self, total: list[float]) -> tuple[str | None, float]:
        return self.likeliest(self.probabilities(total)) if self.langs else (None, 0.0)

    def likeliest(self, p: list[float]) -> tuple[str, float]:
        k = p.index(max(p))
        return self.langs[k], p[k]

    def predict(self, words: list[str]) -> tuple[str | None, float]:
        if not words:
            return None, 0.0
        return self.decide(list(map(sum, zip(*map(self.of_word, words), strict=True))))


#: Scale of the normalised features, so that one step of training moves the scores.
SCALE = 10.0


def train(rows: list[tuple[str, str]], l1: float = 1e-3, l2: float = 1e-3, alpha: float = 0.5, beta: float = 1.0, epochs: int = 3, seed: int = 7) -> LangModel:
    """rows: (text, language). Every fifth sample is held out for the temperature."""
    langs = sorted({x for _, x in rows})
    if not langs:
        return LangModel([], np.zeros(1 << BITS, np.float32), np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0)
    pieces: list[tuple[list[str], int, bool]] = []
    rng = np.random.default_rng(seed)
    for k, (text, lang) in enumerate(rows):
        held = k % 5 == 4
        for s in (" ".join(x) for x in tokens_of(text)):
            w = words_of(s)
            if not w:
                continue
            y = langs.index(lang)
            pieces.append((w, y, held))
            n = int(rng.integers(1, 5))
            at = int(rng.integers(0, max(1, len(w) - n + 1)))
            pieces.append((w[at : at + n], y, held))
            if any("ऀ" <= c <= "ॿ" for c in s):
                pieces.append((words_of(romanise(s)), y, held))
    seen = np.zeros(1 << BITS)
    for w, _, held in pieces:
        if not held:
            seen[np.unique([g for x in w for g in grams(x)])] += 1
    idf = np.log((1 + len(pieces)) / (1 + seen)) + 1.0
    z = np.zeros((1 << BITS, len(langs)))
    n2 = np.zeros_like(z)
    zb, nb = np.zeros(len(langs)), np.zeros(len(langs))

    def weights(zz: np.ndarray, nn: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))

    def features(w: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, tf = np.unique([g for x in w for g in grams(x)], return_counts=True)
        v = tf * idf[ids]
        return ids, v / v.sum() * SCALE

    data = [(*features(w), y, held) for w, y, held in pieces if w]
    fit = [i for i, d in enumerate(data) if not d[3]]
    for _ in range(epochs):
        for i in rng.permutation(fit):
            ids, v, y, _ = data[i]
            w, b = weights(z[ids], n2[ids]), weights(zb, nb)
            s = v @ w + b
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = v[:, None] * p[None, :]
            sigma = (np.sqrt(n2[ids] + g * g) - np.sqrt(n2[ids])) / alpha
            z[ids] += g - sigma * w
            n2[ids] += g * g
            sb = (np.sqrt(nb + p * p) - np.sqrt(nb)) / alpha
            zb += p - sb * b
            nb += p * p
    w, b = weights(z, n2), weights(zb, nb)
    held = [(v @ w[ids] + b, y) for ids, v, y, h in data if h]

    def loss(t: float) -> float:
        return sum(np.log(np.exp((s - s.max()) / t).sum()) - (s[y] - s.max()) / t for s, y in held)

    temperature = min((float(t) for t in np.geomspace(0.2, 5, 40)), key=loss) if held else 1.0
    return LangModel(langs, idf.astype(np.float32), w.astype(np.float32), b, temperature)


def fit(samples: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> LangModel:
    """The model of labelled samples (lang, text); of more than max_rows samples, those of the smallest sample_id serve."""
    rows = samples.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).orderBy("sample_id").limit(max_rows).select("text", "lang").collect()
    return train([(r.text, r.lang) for r in rows])


#: A whole sentence has so many words of its own, fewer if it ends in a closing mark; a language is told apart with so much confidence.
WHOLE_WORDS = 6
MARKED_WORDS = 4
SURE = 0.8


class Reading(NamedTuple):
    """What a text says of its languages: letters by the language of their sentence, and by each language's probability; the languages of whole sentences; and language and confidence of the text."""

    letters: dict[str, int]
    mass: list[float]
    whole: list[str]
    lang: str | None
    confidence: float


def read(model: LangModel, text: str | None) -> Reading:
    """The text's language is that of its whole sentences, that of all its words where it has none."""
    letters: dict[str, int] = {}
    mass = [0.0] * len(model.langs)
    whole: dict[str, float] = {}
    said: list[tuple[list[str], str, float]] = []
    for s in tokens_of(text or ""):
        total, words, n = model.sums(s)
        if not words or not model.langs:
            continue
        shares = model.probabilities(total)
        lang, p = model.likeliest(shares)
        said.append((s, lang, p))
        mass = [m + n * x for m, x in zip(mass, shares)]  # noqa: B905
        if p >= 0.5:
            letters[lang] = letters.get(lang, 0) + n
        if p >= SURE and (words >= WHOLE_WORDS or words >= MARKED_WORDS and s[-1].rstrip("”\"')")[-1:] in ENDS_SENTENCE):
            whole[lang] = max(whole.get(lang, 0.0), p)
    if whole:
        return Reading(letters, mass, sorted(whole), "+".join(sorted(whole)), min(whole.values()))
    if len(said) > 1:
        return Reading(letters, mass, [], *model.of_sentence([t for s, _, _ in said for t in s])[:2])
    return Reading(letters, mass, [], *(said[0][1:] if said else (None, 0.0)))


def label_segments(segments: DataFrame, model: LangModel) -> DataFrame:
    """(id, document_id, n_<lang> and m_<lang> for each language, whole array<string>, lang, confidence) of segments (id, document_id, source_text): letters of each language's sentences, and letters times its probability."""
    shared = segments.sparkSession.sparkContext.broadcast(model)
    langs = model.langs
    fields = [("id", pa.string()), ("document_id", pa.string()), *((f"n_{x}", pa.int64()) for x in langs), *((f"m_{x}", pa.float64()) for x in langs), ("whole", pa.list_(pa.string())), ("lang", pa.string()), ("confidence", pa.float64())]
    schema = pa.schema(fields)

    def run(batches):
        m = shared.value
        for b in batches:
            out: list[list] = [[] for _ in fields]
            for i, d, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                r = read(m, t)
                for col, x in zip(out, [i, d, *(r.letters.get(x, 0) for x in langs), *r.mass, r.whole, r.lang, r.confidence], strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f[1]) for c, f in zip(out, fields, strict=True)], schema=schema)

    ddl = ", ".join(["id string", "document_id string", *(f"n_{x} long" for x in langs), *(f"m_{x} double" for x in langs), "whole array<string>", "lang string", "confidence double"])
    return spread(segments.select(F.col("id").cast("string"), F.col("document_id").cast("string"), "source_text")).mapInArrow(run, ddl)


def document_languages(labelled: DataFrame, langs: list[str]) -> DataFrame:
    """(document_id, lang, confidence): the language of most of a document's text, and the mean of that language's calibrated probability over its letters."""
    if not langs:
        return labelled.select("document_id", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence")).where("false")
    sums = labelled.groupBy("document_id").agg(*(F.sum(f"{k}_{x}").alias(f"{k}_{x}") for k in "nm" for x in langs))
    total = sum((F.col(f"n_{x}") for x in langs), F.lit(0))
    top = F.greatest(*(F.col(f"n_{x}") for x in langs))
    of_top = lambda value: F.coalesce(*(F.when(F.col(f"n_{x}") == top, value(x)) for x in langs))
    mass = sum((F.col(f"m_{x}") for x in langs), F.lit(0.0))
    return sums.where(total > 0).select("document_id", of_top(F.lit).alias("lang"), (of_top(lambda x: F.col(f"m_{x}")) / mass).alias("confidence"))


# Spellings of the codes and names of the languages.
SPELLINGS = {
    "en": ["en", "eng", "english", "अंग्रेजी", "अङ्ग्रेजी"],
    "ne": ["ne", "nep", "npi", "nepali", "nepalese", "नेपाली"],
    "tmg": ["tmg", "taj", "tdg", "tge", "tmk", "tsf", "tamang", "तामाङ"],
}


def declared(column):
    """The language that a label names, or null. Regions and scripts after a code don't matter."""
    base = F.regexp_replace(F.lower(F.trim(column)), r"[-_ (].*$", "")
    out = F.lit(None).cast("string")
    for lang, names in SPELLINGS.items():
        out = F.when(base.isin(names), F.lit(lang)).otherwise(out)
    return out


def _judged(documents: DataFrame, segments: DataFrame, model: LangModel) -> tuple[DataFrame, DataFrame]:
    """(row_id, lang, confidence, is_case) of every document, and the same with document_id of every segment of a document with a language."""
    labelled = stable(label_segments(segments, model))
    main = document_languages(labelled, model.langs)
    # Words of which no sentence is sure still have a likeliest language; they make no case.
    unsure = labelled.where(F.col("lang").isNotNull()).groupBy("document_id").agg(F.max(F.struct("confidence", "lang")).alias("u"))
    docs = (
        documents.select(F.col("id").cast("string").alias("document_id"), declared(F.col("source_lang")).alias("declared"))
        .join(main, "document_id", "left")
        .join(unsure, "document_id", "left")
        .select(
            F.col("document_id").alias("row_id"),
            F.coalesce("lang", "u.lang").alias("lang"),
            F.coalesce("confidence", "u.confidence", F.lit(0.0)).alias("confidence"),
            (F.col("lang").isNotNull() & ~F.col("declared").eqNullSafe(F.col("lang"))).alias("is_case"),
        )
    )
    segs = labelled.join(main.select("document_id", F.col("lang").alias("main")), "document_id").select(
        "document_id", F.col("id").alias("row_id"), "lang", "confidence", ((F.size("whole") > 1) | (F.size("whole") > 0) & (F.col("whole")[0] != F.col("main"))).alias("is_case")
    )
    return docs, segs


def _levels(docs: DataFrame, segs: DataFrame) -> DataFrame:
    columns = ["row_id", "lang", "confidence"]
    return docs.select(F.lit("document").alias("record_level"), *columns).unionByName(segs.select(F.lit("segment").alias("record_level"), *columns))


def find_languages(documents: DataFrame, segments: DataFrame, model: LangModel) -> DataFrame:
    """(record_level, row_id, lang, confidence): every document, and every segment of documents that hold a whole sentence in another language than their main one."""
    docs, segs = _judged(documents, segments, model)
    mixed = segs.where("is_case").select("document_id").distinct()
    return _levels(docs, segs.join(mixed, "document_id", "left_semi"))


def find_mislabelled(documents: DataFrame, segments: DataFrame, model: LangModel) -> DataFrame:
    """(record_level, row_id, lang, confidence): documents with a missing or wrong label, and segments with a whole sentence in another language than their document's."""
    docs, segs = _judged(documents, segments, model)
    return _levels(docs.where("is_case"), segs.where("is_case"))
