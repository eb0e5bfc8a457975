"""Problem 6: evaluation texts that occur, wholly or in a passage, in a corpus.

Wu-Manber multi-pattern search: the patterns are all windows of five successive words of the test items. A table of shifts
by blocks of characters skips positions where no pattern can end; where the shift is nothing, the bucket of the characters
before holds the patterns that are compared directly. An occurrence confirms five words; the passage around it is then
aligned word by word with the item, so that replaced words are tolerated.

Five words are enough: of 15 words with two replaced, five successive ones at least are untouched.

Defined results: null and empty texts leak nothing; null items are none; an item shorter than the least passage leaks only
wholly; of repeated rows each reports; an item occurring several times in a document is reported once.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lipigraph.llm.lookalike import fold
from lipigraph.session import spread, stable

SEED_WORDS = 5
LEAST_WORDS = 15
#: Characters of a block of the shift table; fewer where a pattern is shorter.
BLOCK = 5
#: Words of a passage that may be replaced.
REPLACED = 0.14
#: Share of the telling words that may have become others where no number did.
CHANGED = 0.2
#: Numbers, and words in at most this share of the items, tell an item from others of its making.
TELLING = 0.1
#: Characters of items searched for in one pass, some 200 MB as patterns in a worker; more go in further passes over the corpus, with the same results.
CHARS_PER_PASS = 4_000_000
LINE_NUMBER = re.compile(r"^[ \t]*(?:[(\[]?[0-9०-९]{1,4}[.):\]][ \t]*|[0-9०-९]{1,3}[ \t]+(?=\S))(?=\D)|(?<!\S)[(\[]?[0-9०-९]{1,3}[)\]](?=\s)", re.M)
SENTENCE_END = re.compile(r"[.।?!]\s")
TOKEN = re.compile("[0-9०-९]+|[A-Za-zÀ-ॣॱ-῿‍Ⰰ-⿯぀-퟿豈-﷿]+")
DIGITS = str.maketrans("०१२३४५६७८९", "0123456789")


def words_of(text: str) -> list[str]:
    """Words and numbers, without case, punctuation, numbering of lines and script of digits."""
    text = fold(text)
    if "\n" in text or ")" in text or "]" in text:
        text = LINE_NUMBER.sub("", text)
    words = TOKEN.findall(text.casefold())
    return words if text.isascii() else [w.translate(DIGITS) if w[0].isdigit() else w for w in words]


def opening_of(text: str) -> int:
    """Words of the first sentence."""
    return len(words_of(SENTENCE_END.split(text, maxsplit=1)[0]))


class WuManber:
    def __init__(self, patterns: Iterable[str]) -> None:
        patterns = sorted(set(patterns))
        self.least = min(map(len, patterns), default=BLOCK)
        self.block = min(BLOCK, self.least)
        self.shift: dict[str, int] = {}
        #: Buckets by all characters that the patterns have in common length, so that few are compared.
        self.bucket: dict[str, list[str]] = defaultdict(list)
        for p in patterns:
            for end in range(self.block, self.least + 1):
                b = p[end - self.block : end]
                self.shift[b] = min(self.shift.get(b, self.least), self.least - end)
            self.bucket[p[: self.least]].append(p)
        self.default = self.least - self.block + 1

    def search(self, text: str) -> Iterator[tuple[int, str]]:
        """(start, pattern) of all occurrences."""
        least, block, shift, default, bucket, n = self.least, self.block, self.shift.get, self.default, self.bucket.get, len(text)
        end = least
        while end <= n:
            s = shift(text[end - block : end], default)
            if s:
                end += s
                continue
            start = end - least
            for p in bucket(text[start:end], ()):
                if text.startswith(p, start):
                    yield start, p
            end += 1


class Item(NamedTuple):
    id: int
    words: list[str]
    #: Words of an opening that other items have too: an instruction, no content of the item.
    shared: int


def prepare(texts: list[tuple[int, str]]) -> tuple[list[Item], set[str]]:
    """Items of (item_id, text), and the words that more than a TELLING share of them have; find_leaks() computes the same over a table."""
    words = {i: words_of(t) for i, t in texts}
    first = {i: opening_of(t) for i, t in texts}
    distinct = {tuple(w) for w in words.values()}
    count = Counter(x for w in distinct for x in set(w))
    opening = Counter(o for o, _ in {(tuple(w[: first[i]]), tuple(w)) for i, w in words.items()})
    items = [Item(i, w, first[i] if opening[tuple(w[: first[i]])] > 1 else 0) for i, w in words.items()]
    return items, {x for x, n in count.items() if n > few(len(distinct))}


def few(n_items: int) -> int:
    return max(1, int(TELLING * n_items))


class LeakFinder:
    """The finder for some items. common: words that are usual over all items, beyond those given here too."""

    def __init__(self, items: list[Item], common: set[str]) -> None:
        self.words = {x.id: x.words for x in items}
        self.shared = {x.id: x.shared for x in items}
        self.common = common
        self.at: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, w in self.words.items():
            n = min(SEED_WORDS, len(w))
            for k in range(len(w) - n + 1) if n else ():
                self.at[f" {' '.join(w[k : k + n])} "].append((i, k))
        self.search = WuManber(self.at).search

    def find(self, text: str | None) -> set[int]:
        if not text:
            return set()
        doc = words_of(text)
        line = f" {' '.join(doc)} "
        diagonals: dict[tuple[int, int], None] = {}
        starts: list[int] | None = None
        for at, p in self.search(line):
            if starts is None:
                starts, k = [], 0
                for w in doc:
                    starts.append(k)
                    k += len(w) + 1
            j = bisect.bisect_left(starts, at)
            for i, k in self.at[p]:
                diagonals[i, j - k] = None
        leaked: set[int] = set()
        for i, d in diagonals:
            if i not in leaked and self.passage(self.words[i], doc, d, self.shared[i]):
                leaked.add(i)
        return leaked

    def tells(self, word: str) -> bool:
        return word.isdigit() or word not in self.common

    def another(self, mine: str, theirs: str) -> bool:
        """Whether a word of the item gave way to one that may stand there in another item of its making: a number to a number, a telling word to a telling one."""
        if mine.isdigit() or theirs.isdigit():
            return mine.isdigit() and theirs.isdigit()
        return self.tells(mine) and self.tells(theirs)

    def judged(self, item: list[str], doc: list[str], d: int, lo: int, hi: int) -> tuple[list[int], list[int], list[int]]:
        """For each position of the item, how many words before it tell the item, have become others, and are numbers among these."""
        telling, others, numbers = [0], [0], [0]
        for k, w in enumerate(item):
            other = lo <= k < hi and w != doc[k + d] and self.another(w, doc[k + d])
            telling.append(telling[-1] + self.tells(w))
            others.append(others[-1] + other)
            numbers.append(numbers[-1] + (other and w.isdigit()))
        return telling, others, numbers

    def passage(self, item: list[str], doc: list[str], d: int, shared: int) -> bool:
        """Whether word k of the item and word k + d of the document agree over a passage long enough, but for the words that may be replaced."""
        least = min(LEAST_WORDS, len(item))
        lo, hi = max(0, -d), min(len(item), len(doc) - d)
        hits = [k for k in range(lo, hi) if item[k] == doc[k + d]]
        if len(hits) < least - int(least * REPLACED):
            return False
        own = [k >= shared for k in hits]
        ahead = [0]
        for x in own:
            ahead.append(ahead[-1] + x)
        telling: list[int] = []
        # Hits ahead of what a passage needs: a passage from a to b gains no less than -REPLACED, so ends that gain less beside the lowest start are passed over.
        gain = [k - (1 - REPLACED) * h for k, h in enumerate(hits)]
        lowest, starts = float("inf"), 0
        for b in range(len(hits)):
            while hits[b] - hits[starts] + 1 >= least and starts <= b:
                lowest = min(lowest, gain[starts])
                starts += 1
            if gain[b] - lowest < -REPLACED - 1e-9:
                continue
            for a in range(starts):
                if gain[b] - gain[a] < -REPLACED - 1e-9:
                    continue
                n = hits[b] - hits[a] + 1
                replaced = n - (b - a + 1)
                if replaced > int(n * REPLACED) or ahead[b + 1] - ahead[a] < min(5, len(item) - shared):
                    continue
                if not replaced:
                    return True
                if not telling:
                    telling, others, numbers = self.judged(item, doc, d, lo, hi)
                # Of the words that tell the item from others, no more than the same share may have become others; a little more, if no number did.
                first, last = hits[a], hits[b] + 1
                share = REPLACED if numbers[last] > numbers[first] else CHANGED
                if others[last] - others[first] <= int((telling[last] - telling[first]) * share):
                    return True
        return False


def prepared(items: DataFrame) -> tuple[DataFrame, set[str]]:
    """(item_id, words, shared) of items with words, and the common words. Openings and counts are taken over all items; at most the words of an item over TELLING are common, so these fit anywhere."""
    schema = pa.schema([("item_id", pa.int64()), ("words", pa.list_(pa.string())), ("first", pa.int32())])

    def run(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([ids, pa.array(map(words_of, texts), schema[1].type), pa.array(map(opening_of, texts), pa.int32())], schema=schema)

    rows = items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long"), F.col("text")).mapInArrow(run, "item_id long, words array<string>, first int")
    rows = stable(rows.where(F.size("words") > 0).withColumn("opening", F.slice("words", 1, "first")))
    distinct = rows.select("words").distinct()
    least = few(distinct.count())
    words = distinct.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
    openings = rows.select("opening", "words").distinct().groupBy("opening").agg((F.count(F.lit(1)) > 1).alias("is_shared"))
    told = rows.join(openings, "opening").select("item_id", "words", F.when(F.col("is_shared"), F.col("first")).otherwise(0).alias("shared"))
    return told, {r.word for r in words.collect()}


def find_leaks(documents: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, item_id): the documents that contain an item or a passage of it. Items go to the workers in blocks of a bounded size, each searched for in one pass."""
    told, common = prepared(items)
    told = stable(told)
    chars = told.agg(F.sum(F.aggregate("words", F.lit(0), lambda n, w: n + F.length(w) + 1))).first()[0] or 0
    n = 1 + int(chars // CHARS_PER_PASS)
    corpus = spread(documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")))
    sc = documents.sparkSession.sparkContext
    parts = []
    for k in range(n):
        block = [Item(r.item_id, r.words, r.shared) for r in told.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect()]
        parts.append(corpus.mapInArrow(_finder(sc.broadcast((block, common))), "doc_id long, item_id long"))
    return reduce(DataFrame.unionByName, parts)


def _finder(block):
    def run(batches):
        finder = LeakFinder(*block.value)
        for b in batches:
            docs, found = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for k in sorted(finder.find(t)):
                    docs.append(i)
                    found.append(k)
            yield pa.RecordBatch.from_pydict({"doc_id": docs, "item_id": found}, schema=pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64())]))

    return run
