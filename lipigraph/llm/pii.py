"""Problem 1: personal information in free text, replaced by typed placeholders that keep equal values linked.

Numbers are pseudonymised in their own format: once validated, the digits that identify somebody go through a keyed Feistel
permutation and are written back with the prefix, separators and script of digits of the occurrence. Dates are permuted the
same way among the days of their century. Mail addresses, street addresses, names and numbers that no subscriber or paper
can have get a keyed tag of 96 bits. The same value gets the same pseudonym in every document, whatever its layout. The
key is a secret of the caller: who has it can read the pseudonyms back.

People's names are found by a lexicon of given and family names that the corpus itself gives: both parts of personal mail
addresses, and what follows a form of address. A name is a given beside a family name, in either order and script.

Defined results: null stays null and has no findings; empty texts stay; placeholders already present are none; texts are
processed whole; repeated rows each get their result; where findings overlap the first in the order mail, identity number,
phone, address, name holds.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import re
from calendar import monthrange
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lipigraph.llm.lookalike import fold
from lipigraph.llm.roman import CONSONANT, romanise
from lipigraph.session import spread, stable

DIGITS, NATIVE_DIGITS = str.maketrans("०१२३४५६७८९", "0123456789"), str.maketrans("0123456789", "०१२३४५६७८९")
#: Runs of letters and marks; as ranges, which are searched much faster than properties.
WORD = re.compile("[A-Za-z\u00c0-\u0963\u0971-\u1fff\u200d\u2c00-\u2fef\u3040-\ud7ff\uf900-\ufdff]+")
NATIVE = re.compile("[०-९]")
TYPES = ("email", "phone", "id", "address", "name")

PLACEHOLDER = regex.compile(r"\[(?:EMAIL|PHONE|ID|ADDRESS|NAME|DATE)\b[^\]]*\]")
AT = r"(?:@|\s*[\[({<]\s*(?:at|एट)\s*[\])}>]\s*)"
DOT = r"(?:\.|\s*[\[({<]\s*(?:dot|डट)\s*[\])}>]\s*)"
EMAIL = regex.compile(rf"[\p{{L}}\p{{M}}\d_.+%-]*[\p{{L}}\p{{M}}\d_]{AT}[\p{{L}}\p{{M}}\d-]+(?:{DOT}[\p{{L}}\p{{M}}\d-]+)+|\b[\w.+-]+ at [\w-]+(?: dot [\w-]+)+", regex.I)

NUMBER = r"(?:\p{L}{1,2}[ -]?)?\d(?:[-/ .]?\d){6,13}"
ID_CUE = (
    r"(?:citizenship|national\s+(?:id|identity)|identity\s+(?:card|number)|passport|(?:personal\s+)?tax|\bpan\b|nid\b|licen[cs]e"
    r"|नागरिकता|राष्ट्रिय\s+परिचय\p{L}*\p{M}*\p{L}*|परिचयपत्र|परिचय|राहदानी|पासपोर्ट|स्थायी\s+लेखा|कर|प्यान|ङोसेबा"
    r"|naagarikataa|nagarikta|parichay\w*|raahadaani|rahadani|\bkar)"
)
ID = regex.compile(rf"{ID_CUE}(?:\s+(?:card|certificate|छोय|पत्र))?\s*(?:no\b\.?|number|id\b|nan\b\.?|#|नं\.?|नम्बर|अङ्क|angka\b)?\s*[:#]?\s*({NUMBER})(?![\d-])", regex.I)
ID_SHAPE = regex.compile(r"(?<![\d/.-])(?:\d\d-\d\d-\d\d-\d{5}|\d\d/\d{4}/\d{4}|\d{3}-\d{3}-\d{3}-\d)(?![\d/-])|(?<![\p{L}\d-])[A-Za-z]{1,2}\d{7,8}(?!\d)")
PHONE = regex.compile(
    r"(?<![\d/+-])(?<!\d[ .])(?:(?:\+|00)\s?977[- ]?(?:0?\d{1,2}[- ]?\d{3}[- ]?\d{3,4}|\d{5}[- ]\d{5}|\d(?:[- ]?\d){7,9})"
    r"|\+\d{1,3}(?:[- ]?\d){7,11}|9[678]\d(?:[- .]?\d){7}|\(0\d{1,2}\)\s?\d(?:[- ]?\d){5,6}|0\d{1,2}[- ]\d{6,7}|0\d{1,2}[- ]\d{3}[- ]\d{3,4}|0[1-9]\d{7})(?![\d/]|-\d)"
)
#: Runs of digits long enough for a number of somebody, but for dates and numbers of papers in two groups of four.
LONG_NUMBER = regex.compile(r"(?<![\d/-])(?!(?:\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{4}|\d{4}-\d{4})(?![\d/-]))\d(?:[-/ .()]{0,2}\d){6,}")

STREET = r"(?:lane|road|marg|tole|street|galli|path|avenue|maarg|tol|sadak|गल्ली|सडक|मार्ग|टोल|पथ)"
NAME_PART = r"[\p{L}][\p{L}\p{M}'’]*"
HOUSE_WORD = r"(?:\bh\.?\s?n\.?|\bhouse\s+(?:no\.?|number)|\bflat(?:\s+no\.?)?|\bgha\.?\s?nan\.?|\bghar\s+nan\.?|\bphlyaat|घ\.\s?नं\.?|घर\s+नं\.?|घर\s+नम्बर|फ्ल्याट|दिम\s+अङ्क)"
HOUSE = rf"{HOUSE_WORD}\s*\d+\p{{L}}?(?:/\d+)?"
HOUSE_CUE = regex.compile(HOUSE_WORD + r"\s*", regex.I)
TAIL = rf"(?:,\s*(?:ward|वडा|wadaa)\s+(?:no\.?\s*|नं\.?\s*)?\d+)?(?:,\s*{NAME_PART}(?:[- ]\d{{1,2}}(?![\d/-]))?)?"
ADDRESS = regex.compile(
    rf"{HOUSE}(?:,\s*{NAME_PART}(?:\s+{NAME_PART}){{0,2}}?\s+{STREET}(?:\s+\d+)?|,\s*{NAME_PART}){TAIL}"
    rf"|(?<![\d/-])\d+(?:/\d+)?\p{{L}}?,?\s+(?:upper\s+|lower\s+|old\s+|new\s+|maathillo\s+|tallo\s+|माथिल्लो\s+|तल्लो\s+|पुरानो\s+|नयाँ\s+)?[\p{{L}}][\p{{L}}\p{{M}}]{{3,}}\s+(?:{STREET})(?![\p{{L}}\p{{M}}]){TAIL}"
    rf"|{NAME_PART}\s+(?:ward|वडा|wadaa)\s+(?:no\.?\s*|नं\.?\s*)?\d+,\s*{NAME_PART}(?:\s+{NAME_PART})?\s+{STREET}\s+\d+(?:/\d+)?"
    rf"|{NAME_PART}\s+{STREET}\s+\d+(?:/\d+)?(?![\d-]){TAIL}",
    regex.I,
)
STREETS = {"lane", "road", "marg", "tole", "street", "galli", "path", "avenue", "maarg", "tol", "sadak", "गल्ली", "सडक", "मार्ग", "टोल", "पथ"}
HOUSES = {"house", "flat", "gha", "phlyaat", "घ", "फ्ल्याट"}


def maybe_address(text: str, low: set[str]) -> bool:
    """A word for house numbers, or a word for streets with a number beside it."""
    if not low.isdisjoint(HOUSES) or ("n" in low and "h" in low) or ("नं" in low and ("घर" in low or "दिम" in low)) or "nan" in low and "ghar" in low:
        return True
    if low.isdisjoint(STREETS):
        return False
    tokens = text.split()
    for i, t in enumerate(tokens):
        if t.strip(".,;:।()").lower() in STREETS and any(x[:1].isdigit() for x in tokens[max(0, i - 3) : i + 2]):
            return True
    return False


TITLE = r"(?:mr|mrs|ms|miss|dr|prof|shri|shree|sushri|shrimati|श्री|सुश्री|श्रीमती|श्रीमान|डा)"
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "shri", "shree", "sushri", "shrimati", "श्री", "सुश्री", "श्रीमती", "श्रीमान", "डा"}
TITLED = regex.compile(rf"(?<![\p{{L}}\p{{M}}])({TITLE})\.?\s+({NAME_PART})(?:\s+\p{{L}}\p{{M}}*\.)?\s+({NAME_PART})", regex.I)
# Endings that Nepali and Tamang write onto a name.
ENDINGS = ("ज्यूलाई", "ज्यूले", "ज्यूको", "ज्यूका", "ज्यूदा", "ज्यूसे", "ज्यूला", "ज्यूसँग", "ज्यू", "हरू", "लाई", "ले", "को", "का", "की", "मा", "दा", "से", "ला", "री", "सँग", "बाट", "jyulaai", "jyule", "jyuko", "jyu", "laai", "ko", "le")
# Mailbox names that are no person's.
ROLES = {"info", "help", "helpdesk", "desk", "office", "ward", "admin", "support", "contact", "mail", "form", "desk", "team", "service", "test", "news", "notice"}

SKELETON = {**{k: v for k, v in CONSONANT.items()}}
#: Latin spellings of one consonant, longest first.
SAME = (("chh", "c"), ("ksh", "ks"), ("ph", "f"), ("ng", "n"), ("ny", "ny"), ("sh", "s"), ("kh", "k"), ("gh", "g"), ("ch", "c"), ("jh", "j"), ("th", "t"), ("dh", "d"), ("bh", "b"), ("z", "j"), ("w", "v"), ("q", "k"), ("x", "ks"))


def skeleton(word: str) -> str:
    """The consonants of a word, alike for its spellings in Latin and Devanagari; with the kind of its first vowel where it opens with one."""
    w = word.casefold()
    if any("ऀ" <= c <= "ॿ" for c in w):
        w = "".join("a" if c in "अआ" else "i" if c in "इईएऐ" else "u" if c in "उऊओऔ" else "n" if c in "ंँ" else SKELETON.get(c, "") for c in w)
        first_vowel = w[:1] if w[:1] in "aiu" else ""
    else:
        w = fold(w)
        first_vowel = {"a": "a", "ā": "a", "i": "i", "e": "i", "o": "u", "u": "u"}.get(w[:1], "")
    for a, b in SAME:
        w = w.replace(a, b)
    out = first_vowel
    for c in w:
        if c.isalpha() and c not in "aeiouāīūyh":
            out += c
    return out


class Names:
    """Given and family names, as skeletons."""

    def __init__(self, given: set[str], family: set[str]) -> None:
        self.given, self.family = given, family
        self.cache: dict[str, int] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}

    def roles(self, word: str) -> int:
        """1: given, 2: family, 3: both."""
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            got = self.cache[word] = self._roles(word[: stem(word, self)])
        return got

    def _roles(self, word: str) -> int:
        if len(word) < 3:
            return 0
        s = skeleton(word)
        return (s in self.given) + 2 * (s in self.family) if len(s) > 1 else 0

    def find(self, text: str, words: list[str]) -> Iterable[tuple[int, int]]:
        """Spans of a given beside a family name; a comma or an initial may stand between."""
        cached, roles = self.cache.get, self.roles
        hits = 0
        for w in words:
            r = cached(w)
            if r or (r is None and roles(w)):
                hits += 1
        if hits < 2:
            return
        last: tuple[int, int, int] | None = None
        for m in WORD.finditer(text):
            r = roles(m[0])
            between = text[last[1] : m.start()] if last else ""
            if last and r and (last[2] | r) == 3 and (between in (" ", ", ", "  ", " ") or INITIAL.fullmatch(between)):
                yield last[0], m.start() + stem(m[0], self)
                last = None
            elif r:
                last = (m.start(), m.end(), r)
            elif not (last and (len(m[0]) <= 2 or m[0] in INITIALS)):
                last = None


INITIALS = {"के", "बी", "एम", "एस", "आर"}
INITIAL = regex.compile(r"\s+[\p{L}\p{M}]{1,3}\.\s*")


def stem(word: str, names: Names) -> int:
    """Length of the name in a word with an ending."""
    if names._roles(word):
        return len(word)
    for e in ENDINGS:
        if word.endswith(e) and len(word) - len(e) >= 3 and names._roles(word[: -len(e)]):
            return len(word) - len(e)
    return len(word)


def detect(text: str, names: Names) -> list[tuple[int, int, str]]:
    """(start, end, type) in a folded text, in order, without overlap."""
    y = text.translate(DIGITS) if not text.isascii() and NATIVE.search(text) else text
    taken: list[tuple[int, int, str]] = [(m.start(), m.end(), "") for m in PLACEHOLDER.finditer(y)] if "[" in y else []

    def take(a: int, b: int, kind: str) -> None:
        if b > a and not any(a < d and c < b for c, d, _ in taken):
            taken.append((a, b, kind))

    words = WORD.findall(y)
    low = set(map(str.lower, words))
    if "@" in y or "at" in low and ("dot" in low or "[" in y or "(" in y or "{" in y or "<" in y) or "एट" in low:
        for m in EMAIL.finditer(y):
            take(m.start(), m.end(), "email")
    if LONG_NUMBER.search(y):
        for m in ID.finditer(y):
            if sum(c.isdigit() for c in m[1]) >= 7:
                take(m.start(1), m.end(1), "id")
        for m in ID_SHAPE.finditer(y):
            take(m.start(), m.end(), "id")
        for m in PHONE.finditer(y):
            take(m.start(), m.end(), "phone")
    if maybe_address(y, low):
        for m in ADDRESS.finditer(y):
            take(m.start(), m.end(), "address")
    for a, b in names.find(y, words):
        take(a, b, "name")
    if not low.isdisjoint(TITLES):
        for m in TITLED.finditer(y):
            first, second = m[2], m[3]
            if names.roles(first) and names.roles(second) or (first[0].isupper() and second[0].isupper() and not second.isupper()):
                take(m.start(2), m.end(3), "name")
    return sorted(x for x in taken if x[2])


class Feistel:
    """A keyed permutation of the integers below n: balanced rounds on the bits, walking the cycle until the value is below n."""

    def __init__(self, key: bytes, rounds: int = 8) -> None:
        self.key, self.rounds = key, rounds

    def _round(self, i: int, half: int, bits: int, tweak: bytes) -> int:
        h = hashlib.blake2b(b"%d:%d:%d:" % (i, half, bits) + tweak, key=self.key, digest_size=8).digest()
        return int.from_bytes(h, "big") & ((1 << bits) - 1)

    def permute(self, x: int, n: int, tweak: bytes = b"", back: bool = False) -> int:
        bits = max(1, ((n - 1).bit_length() + 1) // 2)
        mask = (1 << bits) - 1
        while True:
            left, right = x >> bits, x & mask
            if back:
                for i in reversed(range(self.rounds)):
                    left, right = right ^ self._round(i, left, bits, tweak), left
            else:
                for i in range(self.rounds):
                    left, right = right, left ^ self._round(i, right, bits, tweak)
            x = (left << bits) | right
            if x < n:
                return x

    def digits(self, s: str, tweak: bytes = b"", back: bool = False) -> str:
        return str(self.permute(int(s), 10 ** len(s), tweak + b"%d" % len(s), back)).zfill(len(s)) if s else s

    def date(self, year: int, month: int, day: int, back: bool = False) -> tuple[int, int, int] | None:
        """Another day of the same century: of the civil calendar where the date is one of that, else of the days up to the 32nd that only other calendars have. None for what is no date."""
        if not (1 <= month <= 12 and 1 <= day <= 32):
            return None
        start = year - year % 100
        if day <= monthrange(year, month)[1]:
            first = datetime.date(start, 1, 1).toordinal()
            n = datetime.date(start + 99, 12, 31).toordinal() - first + 1
            x = self.permute(datetime.date(year, month, day).toordinal() - first, n, b"civil", back)
            new = datetime.date.fromordinal(first + x)
            return new.year, new.month, new.day
        days, place = other_days(start)
        return days[self.permute(place[year, month, day], len(days), b"other", back)]


@functools.cache
def other_days(start: int) -> tuple[list[tuple[int, int, int]], dict[tuple[int, int, int], int]]:
    """The days of a century up to the 32nd of each month that the civil calendar lacks, in order, and their places."""
    days = [(y, m, d) for y in range(start, start + 100) for m in range(1, 13) for d in range(monthrange(y, m)[1] + 1, 33)]
    return days, {x: i for i, x in enumerate(days)}


def subscriber(digits: str) -> int:
    """Digits before those that identify the subscriber: country code, trunk zero and the kind of number."""
    keep = 5 if digits.startswith("00977") else 3 if digits.startswith("977") and len(digits) > 10 else 0
    keep += 1 if digits[keep : keep + 1] == "0" else 0
    return keep + (2 if digits[keep : keep + 1] == "9" else 1)


def valid(kind: str, digits: str) -> bool:
    """Whether a number of this kind can have these digits."""
    if len(set(digits)) < 2:
        return False
    return 6 <= len(digits) - subscriber(digits) <= 12 and len(digits.removeprefix("00")) <= 15 if kind == "phone" else 7 <= len(digits) <= 14


def in_script(plain: str, like: str) -> str:
    return plain.translate(NATIVE_DIGITS) if NATIVE.search(like) else plain


AT_WORD, DOT_WORD = regex.compile(r"\s*[\[({<]\s*(?:at|एट)\s*[\])}>]\s*|\s+at\s+"), regex.compile(r"\s*[\[({<]\s*(?:dot|डट)\s*[\])}>]\s*|\s+dot\s+")


def plain_value(value: str, kind: str) -> str:
    """What two layouts of one value have in common, and no two values."""
    low = value.translate(DIGITS).casefold()
    if kind == "email":
        return DOT_WORD.sub(".", AT_WORD.sub("@", low))
    if kind == "address":
        return " ".join(regex.findall(r"[\p{L}\p{M}\p{N}]+", HOUSE_CUE.sub("house ", low)))
    if kind == "name":
        family, comma, given = low.partition(",")
        words = WORD.findall(f"{given} {family}" if comma else low)
        return " ".join(REPEATED.sub(r"\1", romanise(w)) for w in words)
    return "".join(c for c in low if c.isalnum())


REPEATED = re.compile(r"([aeiou])\1+")


def pseudonym(value: str, kind: str, feistel: Feistel) -> str:
    """The value's placeholder. Numbers keep format and script, so that +977 98... and 98... of one subscriber share their digits."""
    plain = value.translate(DIGITS)
    digits = "".join(c for c in plain if c.isdigit())
    if kind in ("phone", "id") and valid(kind, digits):
        keep = subscriber(digits) if kind == "phone" else 0
        new = iter(digits[:keep] + feistel.digits(digits[keep:], kind.encode()))
        return f"[{kind.upper()} {in_script(''.join(next(new) if c.isdigit() else c for c in plain), value)}]"
    if kind == "date":
        m = DATE.fullmatch(plain)
        ymd = m[1] is not None
        y, mo, d = (m[1], m[3], m[4]) if ymd else (m[8], m[7], m[5])
        a, b, c = (f"{x:0{len(old)}d}" for x, old in zip(feistel.date(int(y), int(mo), int(d)), (y, mo, d), strict=True))
        sep = m[2] or m[6]
        return f"[DATE {in_script(sep.join((a, b, c) if ymd else (c, b, a)), value)}]"
    tag = hashlib.blake2b(plain_value(value, kind).encode(), key=feistel.key, digest_size=12).hexdigest()
    return f"[{kind.upper()} {tag}]"


DATE = regex.compile(r"(?<![\d/-])((?:19|20)\d\d)([-/])(\d{1,2})\2(\d{1,2})(?![\d/-])|(?<![\d/-])(\d{1,2})([-/])(\d{1,2})\6((?:19|20)\d\d)(?![\d/-])")


def dates_in(text: str) -> Iterable[tuple[int, int, str]]:
    plain = text.translate(DIGITS)
    for m in DATE.finditer(plain):
        month, day = (m[3], m[4]) if m[1] else (m[7], m[5])
        if 1 <= int(month) <= 12 and 1 <= int(day) <= 32:
            yield m.start(), m.end(), "date"


def aligned(text: str) -> tuple[str, list[int] | None]:
    """The folded text, and for each of its characters where it begins in the text; None where they are one to one."""
    folded = fold(text)
    if folded == text:
        return folded, None
    parts = [(m.start(), fold(m[0])) for m in regex.finditer(r"\X", text)]
    if "".join(p for _, p in parts) != folded:
        parts = [(i, fold(c)) for i, c in enumerate(text)]
        folded = "".join(p for _, p in parts)
    return folded, [i for i, p in parts for _ in p]


def redact(text: str | None, names: Names, feistel: Feistel, dates: bool = False) -> tuple[str | None, list[str]]:
    """The text with placeholders, and the sorted types found."""
    if not text:
        return text, []
    folded, at = aligned(text)
    found = detect(folded, names)
    if dates:
        taken = [*found, *((m.start(), m.end(), "") for m in PLACEHOLDER.finditer(folded))]
        found = sorted([*found, *(x for x in dates_in(folded) if not any(x[0] < b and a < x[1] for a, b, _ in taken))])
    out, last = [], 0
    for a, b, kind in found:
        start, end = (a, b) if at is None else (at[a], at[b] if b < len(at) else len(text))
        out += (text[last:start], pseudonym(folded[a:b], kind, feistel))
        last = end
    return "".join(out) + text[last:], sorted({k for *_, k in found if k in TYPES})


#: Whatever EMAIL or TITLED can match has one of these; they are cheaper to look for.
CUES = re.compile(rf"@|[\[({{<]\s*(?:at|एट)\s*[\])}}>]|\bat [\w-]+ dot \w|{TITLE}\.?\s", re.I)


def name_parts(text: str) -> Iterable[tuple[str, str]]:
    """(role, skeleton) that a text gives away."""
    y = fold(text or "")
    if not CUES.search(y):
        return
    for m in EMAIL.finditer(y):
        local = regex.split(r"@|\s*[\[({<]|\s+at\s", m[0])[0].split("+")[0]
        parts = [p for p in regex.split(r"[._-]", local) if p]
        if len(parts) == 2 and not ROLES & {p.casefold() for p in parts} and all(p.isalpha() for p in parts):
            if len(parts[0]) >= 3:
                yield "given", skeleton(parts[0])
            if len(parts[1]) >= 3:
                yield "family", skeleton(parts[1])
    for m in TITLED.finditer(y):
        if m[0].isascii() and not (m[2][0].isupper() and m[3][0].isupper()) or m[1] == "miss":
            continue
        yield "titled_given", skeleton(m[2])
        yield "titled_family", skeleton(next((m[3][: -len(e)] for e in ENDINGS if m[3].endswith(e) and len(m[3]) > len(e) + 2), m[3]))


#: Distinct names that may be sent to every worker, some 20 MB; more are joined to the texts that have them.
MAX_NAMES = 200_000


def learn_names(fields: list[DataFrame], most: int = MAX_NAMES) -> Names | DataFrame:
    """The lexicon of all texts (each frame's one string column): distinct names, not occurrences. Above the bound it stays a table (part, role) instead of going to the driver."""
    texts = fields[0].toDF("text")
    for f in fields[1:]:
        texts = texts.unionByName(f.toDF("text"))

    def run(batches):
        for b in batches:
            c: Counter = Counter(p for t in b.column(0).to_pylist() for p in name_parts(t))
            if c:
                yield pa.RecordBatch.from_pydict({"role": [k[0] for k in c], "part": [k[1] for k in c], "n": list(c.values())})

    counted = spread(texts).mapInArrow(run, "role string, part string, n long").groupBy("role", "part").agg(F.sum("n").alias("n")).where(F.length("part") > 1)
    # A title before two words is weaker evidence than a mail address: it must occur twice.
    kept = counted.where(~F.col("role").startswith("titled") | (F.col("n") >= 2))
    kept = stable(kept.select("part", F.regexp_replace("role", "^titled_", "").alias("role")).distinct())
    if kept.count() > most:
        return kept
    got = kept.collect()
    return Names({r.part for r in got if r.role == "given"}, {r.part for r in got if r.role == "family"})


def skeletons(text: str | None) -> set[str]:
    """The skeletons by which a lexicon may know a word of the text, with and without its ending."""
    y = fold(text or "").translate(DIGITS)
    words = {*WORD.findall(y), *(m[k] for m in TITLED.finditer(y) for k in (2, 3))}
    return {skeleton(x) for w in words for x in (w, *(w[: -len(e)] for e in ENDINGS if w.endswith(e) and len(w) - len(e) >= 3))}


def with_names(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """rows (row_id, text) with names, the part of the lexicon that a row's words are in, by a join on the words."""

    def run(batches):
        for b in batches:
            found = [(i, x) for i, t in zip(*(c.to_pylist() for c in b.columns), strict=True) for x in skeletons(t)]
            yield pa.RecordBatch.from_pydict({"row_id": [i for i, _ in found], "part": [x for _, x in found]}, schema=pa.schema([("row_id", pa.string()), ("part", pa.string())]))

    words = rows.where(F.col("row_id").isNotNull()).mapInArrow(run, "row_id string, part string")
    own = words.join(lexicon, "part").groupBy("row_id").agg(F.collect_set(F.struct("part", "role")).alias("names"))
    return rows.join(own, "row_id", "left").select("row_id", "text", "names")


def find_pii(df: DataFrame, id_column: str, text_column: str, names: Names | DataFrame, key: bytes, dates: bool = False, found_only: bool = True) -> DataFrame:
    """(row_id, text, types array<string>): the redacted text of each row; with found_only, of rows with findings. key: the secret of the pseudonyms, up to 64 bytes. A row of null id is redacted; names that only a joined lexicon knows are not sought in it."""
    schema = pa.schema([("row_id", pa.string()), ("text", pa.string()), ("types", pa.list_(pa.string()))])
    rows = df.select(F.col(id_column).cast("string").alias("row_id"), F.col(text_column).alias("text"))
    rows = spread(rows.where(F.col("text").isNotNull()) if found_only else rows)
    joined = isinstance(names, DataFrame)
    shared = df.sparkSession.sparkContext.broadcast((None if joined else names, key, dates))

    def run(batches):
        lexicon, secret, with_dates = shared.value
        feistel = Feistel(secret)
        for b in batches:
            ids, texts, types = [], [], []
            own = b.column(2).to_pylist() if joined else [None] * b.num_rows
            for i, t, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), own, strict=True):
                known = lexicon if lexicon is not None else Names({x["part"] for x in n or () if x["role"] == "given"}, {x["part"] for x in n or () if x["role"] == "family"})
                new, kinds = redact(t, known, feistel, with_dates)
                if kinds or not found_only:
                    ids.append(i)
                    texts.append(new)
                    types.append(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string()), pa.array(types, pa.list_(pa.string()))], schema=schema)

    return (with_names(rows, names) if joined else rows).mapInArrow(run, "row_id string, text string, types array<string>")
