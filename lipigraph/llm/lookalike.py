"""Problem 5: one consistent form for text that looks the same.

Look-alike classes are the connected components (union-find) of pairs of strings that render alike: a width, font or
no-break variant and its plain form, a canonical decomposition and its composition, a letter and its twin in another
script, a vowel sequence and its single letter, a space and its variants, an invisible character and the empty string.
The representative of a class is its most frequent member over the whole corpus. Texts are rewritten by a multi-pattern
automaton, leftmost longest match first. Clusters of a base and marks have no bound in number, but their classes are their
canonical equivalents, whose one composed member stands for them whatever the counts: a worker makes these where they occur.
Letters of other alphabets drawn as a Latin letter are those listed here and, by the rule of confusables(), those of the
public table of confusable characters that Spark's ICU library carries.

Defined results: null stays null (and is no case); the empty text stays empty; texts are processed whole, whatever
their length; repeated rows each get their result; columns beside id and texts aren't touched.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lipigraph.session import spread

# Letters of other scripts that are drawn as a Latin letter.
TWINS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "к": "k", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "ү": "y", "ɡ": "g",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y",
    "α": "a", "ν": "v", "ο": "o", "ρ": "p", "κ": "k", "ι": "i", "υ": "u", "γ": "y", "χ": "x", "ϲ": "c", "ϳ": "j", "τ": "t", "η": "n", "ω": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C",
    "ո": "n", "օ": "o", "ս": "u", "հ": "h", "ց": "g", "ք": "p", "Տ": "S", "Օ": "O", "ı": "i", "ɑ": "a",
}
# Devanagari vowels typed as a letter and signs that draw another letter.
VOWELS = {"अा": "आ", "अो": "ओ", "अौ": "औ", "आे": "ओ", "आै": "औ", "एे": "ऐ", "अॅ": "ॲ", "अॉ": "ऑ", "आॅ": "ऑ", "ाे": "ो", "ाै": "ौ", "ाॅ": "ॉ"}
SAME_DRAWING = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"}
INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
JOINERS = "\u200c\u200d"
#: A joiner is spelling after a virama, or as a non-joiner between Arabic letters.
STRAY_JOINER = regex.compile("(?<![्্੍્୍்్್്්])\u200d|(?<![्্੍્୍்్್്්]|\\p{Arabic})\u200c")
CLUSTER = regex.compile(r"[^\p{M}\s]\p{M}+")
WORD = regex.compile(r"[\p{L}\p{M}]+")


class Union:
    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: str, b: str) -> None:
        self.up[self.find(a)] = self.find(b)

    def classes(self) -> list[list[str]]:
        by: dict[str, list[str]] = {}
        for x in list(self.up):
            by.setdefault(self.find(x), []).append(x)
        return [sorted(v) for v in by.values() if len(v) > 1]


def invisible(c: str) -> bool:
    return (unicodedata.category(c) == "Cf" or ord(c) in INVISIBLE) and c not in JOINERS and not 0x600 <= ord(c) <= 0x605 and ord(c) not in (0x6DD, 0x70F)


#: Alphabets whose letters may stand in for Latin ones.
ALPHABETS = ("CYRILLIC", "GREEK", "ARMENIAN", "COPTIC", "CHEROKEE", "LISU")


def alphabet(c: str) -> str:
    return unicodedata.name(c, "").split(" ")[0]


def confusables(spark: SparkSession, units: Iterable[str]) -> dict[str, str]:
    """Twins among these code points: letters of the ALPHABETS whose skeleton in the public table is one Latin letter. That table has the small l for every upright stroke; a capital is drawn as I."""
    checker = None
    out = dict(TWINS)
    for c in units:
        if len(c) == 1 and c not in out and unicodedata.category(c)[0] == "L" and alphabet(c) in ALPHABETS:
            checker = checker or spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
            drawn = checker.getSkeleton(c)
            if len(drawn) == 1 and drawn.isascii() and drawn.isalpha():
                out[c] = "I" if drawn == "l" and not c.islower() else drawn
    return out


def pairs_of(unit: str, twins: dict[str, str] = TWINS) -> Iterator[tuple[str, str]]:
    """The strings that a code point or a cluster looks like."""
    nfd, nfc = unicodedata.normalize("NFD", unit), unicodedata.normalize("NFC", unit)
    for x in (nfd, nfc):
        if x != unit:
            yield unit, x
    if len(unit) > 1:
        return
    if unit in twins:
        yield unit, twins[unit]
    if invisible(unit):
        yield unit, ""
    elif unicodedata.category(unit) == "Zs" and unit not in "  ":
        yield unit, " "
    tag, _, rest = unicodedata.decomposition(unit).partition(" ")
    if tag in SAME_DRAWING and "Zs" not in unicodedata.category(unit):
        yield unit, "".join(chr(int(x, 16)) for x in rest.split())


def classes_of(counts: dict[str, int], twins: dict[str, str] = TWINS) -> dict[str, str]:
    """Member to representative, for every look-alike class of a corpus with these counts of code points."""
    union = Union()
    for unit in [*counts, *twins, *(c for x in VOWELS for c in x)]:
        for a, b in pairs_of(unit, twins):
            union.join(a, b)
    for a, b in VOWELS.items():
        union.join(a, b)
    to: dict[str, str] = {}
    for members in union.classes():
        usual = [x for x in members if x in ("", " ") or unicodedata.is_normalized("NFC", x) and not any(unicodedata.decomposition(c).split(" ")[0] in SAME_DRAWING for c in x)] or members
        best = min(usual, key=lambda x: (x not in ("", " "), -counts.get(x, 0), x in VOWELS, x in twins, len(x), x))
        to |= {x: best for x in members if x and x != best}
    return to


class Lookalikes:
    """The rewriter of these patterns."""

    def __init__(self, patterns: dict[str, str], twins: dict[str, str] = TWINS) -> None:
        self.patterns, self.twins = patterns, twins
        self.clusters: dict[str, str] = {}
        #: Cheap test; a composed text it passes over is in its consistent form already.
        self.suspect = re.compile("[" + re.escape("".join(sorted({x[0] if len(x) == 1 else x[1] for x in patterns})) + JOINERS) + "\u0300-\u036f]")
        self.automaton = ahocorasick.Automaton()
        for k, v in patterns.items():
            self.automaton.add_word(k, (len(k), v))
        self.automaton.make_automaton()
        self.foreign = {c for c in patterns if c in twins}
        self.twin = re.compile("[" + "".join(sorted(self.foreign)) + "]") if self.foreign else None

    def genuine(self, text: str) -> bool:
        """Whether the text has words of the twins' own script, which then keep their letters."""
        if not self.twin or not self.twin.search(text):
            return False
        for w in WORD.findall(text):
            if any(c in self.foreign for c in w) and any(c not in self.foreign and c.isalpha() and alphabet(c) in ALPHABETS for c in w):
                return True
        return False

    def __call__(self, text: str | None) -> str | None:
        if not text or not self.suspect.search(text) and unicodedata.is_normalized("NFC", text):
            return text
        keep = self.genuine(text)
        # Only a letter in a word of its own script stays; a twin inside a Latin word never does.
        if keep:
            stay = {i for m in WORD.finditer(text) if not any("LATIN" in unicodedata.name(c, "") for c in m[0]) for i in range(m.start(), m.end())}
        out, at = [], 0
        for end, (n, new) in self.automaton.iter_long(text):
            start = end - n + 1
            if keep and start in stay and text[start] in self.foreign:
                continue
            out += (text[at:start], new)
            at = end + 1
        text = STRAY_JOINER.sub("", "".join(out) + text[at:])
        # What composes beyond a cluster are the letters of Hangul syllables.
        return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", CLUSTER.sub(self.cluster, text))

    def cluster(self, m: regex.Match) -> str:
        """The representative of a cluster's class."""
        unit = m[0]
        got = self.clusters.get(unit)
        if got is None:
            union = Union()
            for a, b in pairs_of(unit, {}):
                union.join(a, b)
            got = next((x for members in union.classes() for x in members if unicodedata.is_normalized("NFC", x)), unit)
            if len(self.clusters) < MAX_CLUSTERS and len(unit) <= 8:
                self.clusters[unit] = got
        return got


#: Clusters that a worker keeps; others are made anew.
MAX_CLUSTERS = 100_000


def count_units(texts: Iterable[str]) -> Counter:
    """Occurrences of every code point, and of vowels typed in parts."""
    joined = "\n".join(texts)
    found: Counter = Counter()
    codes, n = np.unique(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4"), return_counts=True)
    found.update({chr(c): int(k) for c, k in zip(codes.tolist(), n.tolist(), strict=True)})
    for x in VOWELS:
        if n := joined.count(x):
            found[x] += n
    return found


def corpus_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(unit, n) over all texts of the columns."""

    def count(batches):
        total: Counter = Counter()
        for b in batches:
            for c in b.columns:
                total.update(count_units(x for x in c.to_pylist() if x))
        if total:
            yield pa.RecordBatch.from_pydict({"unit": list(total), "n": list(total.values())})

    return df.select(*columns).mapInArrow(count, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def model(*parts: tuple[DataFrame, list[str]]) -> Lookalikes:
    """The rewriter for the texts of all parts. What reaches the driver is the table of distinct code points, whose size Unicode bounds, not the data."""
    counts: Counter = Counter()
    for df, columns in parts:
        for r in corpus_counts(df, columns).collect():
            counts[r.unit] += r.n
    twins = confusables(parts[0][0].sparkSession, counts)
    return Lookalikes(classes_of(counts, twins), twins)


def consistent(df: DataFrame, id_column: str, columns: list[str], rewriter: Lookalikes, changed_only: bool = False) -> DataFrame:
    """(row_id, field, text, changed): the consistent form of each text of the columns; with changed_only, only of those that had another form."""
    shared = df.sparkSession.sparkContext.broadcast((rewriter.patterns, rewriter.twins, columns))

    def run(batches):
        patterns, twins, names = shared.value
        rewrite = _cached(patterns, twins)
        for b in batches:
            ids = b.column(0).to_pylist()
            for k, name in enumerate(names):
                rows, texts, flags = [], [], []
                for i, t in zip(ids, b.column(k + 1).to_pylist(), strict=True):
                    new = rewrite(t)
                    if new != t or not changed_only:
                        rows.append(i)
                        texts.append(new)
                        flags.append(new != t)
                if rows:
                    yield pa.RecordBatch.from_pydict({"row_id": rows, "field": [name] * len(rows), "text": texts, "changed": flags}, schema=pa.schema([("row_id", pa.string()), ("field", pa.string()), ("text", pa.string()), ("changed", pa.bool_())]))

    return df.select(F.col(id_column).cast("string").alias("row_id"), *columns).mapInArrow(run, "row_id string, field string, text string, changed boolean")


_rewriters: dict[int, Lookalikes] = {}


def _cached(patterns: dict[str, str], twins: dict[str, str]) -> Lookalikes:
    """The rewriter of these patterns, made once in a worker."""
    key = hash(tuple(sorted(patterns.items())))
    if key not in _rewriters:
        _rewriters.clear()
        _rewriters[key] = Lookalikes(patterns, twins)
    return _rewriters[key]


#: The rewriter without corpus counts, for the other operators' view of a text.
PLAIN = Lookalikes(classes_of({chr(c): 1 for c in [*range(0x20, 0x7F), *range(0xA0, 0x250), *range(0x2000, 0x2070), 0x2126, 0x212A, 0x212B, 0x3000, 0xFEFF, 0x958, 0x959, 0x95A, 0x95B, 0x95C, 0x95D, 0x95E, 0x95F, *range(0xFF01, 0xFF5F)]}))


def fold(text: str) -> str:
    """The text as a reader sees it: plain widths, spaces and letters."""
    return text if text.isascii() else PLAIN(text)
