"""Problem 3: records that differ in layout alone, collapsed to one with the number of its copies.

Records get a canonical key: words folded to one case, without punctuation, with single spaces; fields `label: value` in
the order of their text. The keys are written once in narrow form and range-partitioned together with the id, so a group of
any size spreads over as many partitions as its rows need; each partition is sorted externally by Spark and scanned once,
comparing full keys of neighbours. The scan itself emits one representative and the count of each run, and, where asked
for, the run's other ids. Only a partition's first and last run can go on in another partition: their full keys, at most
two a partition, are merged by a small aggregate; other rows know such a run by its number alone.

Defined results: null texts are equal to null texts alone and count as copies of each other; null ids can't be kept or
copied and are left out; empty texts are a group like others; texts are compared whole; of rows with one id and key the
repeats count as copies in n_copies, and no row pairs an id with itself; columns beside those named aren't touched.

Punctuation is Unicode's and the marks of ASCII. It is dropped inside words and numbers (e-mail and email, 7,450 and 7450)
and is a space elsewhere; a comma, colon or slash between letters is one too, since no space need follow it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lipigraph.session import stable, stable_table

#: What parts fields: a bar, semicolon, bullet, line break, spaced slash, or a comma before the next label.
SEPARATOR = r"\s*(?:[;|\n\r•]|\s/\s|,\s+(?=[^:;,|\n]+:\s))+\s*"
#: A field: a label, a colon, its value.
FIELD = r"^[^:;|\n]+:.*\S"
SPACE = r"[\s\p{Z}\p{Cc}]+"
MARK = r"[\p{P}$+<=>^`|~]"
LETTER, DIGIT = r"[\p{L}\p{M}]", r"\p{N}"
#: Marks that join the parts of one word, and of one number.
IN_WORD, IN_NUMBER = r"[-‐‑.'’_]", r"[-‐‑.'’_,:/]"
SCOPE = ("source_lang", "target_lang", "domain", "subdomain")
TEXTS = ("source_text", "target_text")
#: Runs of a partition are numbered below this; the partition's number stands above it.
RUNS = 1 << 33


def plain_words(text: Column) -> Column:
    """Words of one case with single spaces between them and without punctuation."""
    low = F.regexp_replace(F.lower(F.upper(text)), SPACE, " ")
    one_word = F.regexp_replace(low, rf"(?<=[\p{{L}}\p{{M}}\p{{N}}]){IN_WORD}(?=[\p{{L}}\p{{M}}\p{{N}}])", "")
    one_number = F.regexp_replace(one_word, rf"(?<={DIGIT}){IN_NUMBER}(?={DIGIT})", "")
    return F.trim(F.regexp_replace(F.regexp_replace(one_number, MARK + "+", " "), r" +", " "))


def canonical(text: Column) -> Column:
    """The key of a text: its words, or its fields in the order of their words where every part is a field."""
    parts = F.filter(F.split(F.trim(text), SEPARATOR), lambda x: F.length(F.trim(x)) > 0)
    # A quotation mark or bracket around the whole belongs to no field.
    bare = F.transform(parts, lambda x: F.regexp_replace(x, r"^[\s\"'“”‘’(\[{]+", ""))
    fields = (F.size(bare) > 1) & F.forall(bare, lambda x: x.rlike(FIELD))
    # The separator between fields can't occur in a key of words.
    return F.when(fields, F.array_join(F.array_sort(F.transform(bare, lambda x: field_key(x))), "\u0001")).otherwise(plain_words(text))


def field_key(part: Column) -> Column:
    at = F.instr(part, ":")
    return F.concat(plain_words(part.substr(F.lit(1), at - 1)), F.lit("\u0002"), plain_words(part.substr(at + 1, F.length(part))))


def keyed(records: DataFrame, id_column: str = "id", scope: tuple[str, ...] = SCOPE, texts: tuple[str, ...] = TEXTS) -> DataFrame:
    """(id, key): the full key, scope and texts apart, null apart from empty."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("~"))
    key = F.concat_ws("\u0003", *(part(F.col(c).cast("string")) for c in scope), *(part(canonical(F.col(c).cast("string"))) for c in texts))
    return records.select(F.col(id_column).cast("string").alias("id"), key.alias("key")).where(F.col("id").isNotNull())


OUT = "run long, id string, first string, n long, key string"
SCHEMA = pa.schema([("run", pa.int64()), ("id", pa.string()), ("first", pa.string()), ("n", pa.int64()), ("key", pa.string())])


class Scan:
    """One pass over rows sorted by key and id.

    Emits a row of each run (n its rows, id null; the key where the run touches a border of the partition) and, with
    members, one of each other id of the run (n null)."""

    def __init__(self, partition: int, members: bool) -> None:
        self.run, self.members = partition * RUNS, members
        self.key: pa.Scalar | None = None
        self.first = self.last_id = None
        self.n, self.opening = 0, True

    def closed(self, last: bool) -> list[tuple]:
        """The row of the run that ends here."""
        return [] if self.key is None else [(self.run, None, self.first, self.n, self.key.as_py() if self.opening or last else None)]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield self.table(list(self.rows(b)))
        yield self.table(self.closed(True))

    def rows(self, b: pa.RecordBatch) -> Iterator[tuple]:
        ids, keys, n = b.column(0).to_pylist(), b.column(1), b.num_rows
        starts = [0] if self.key is None or keys[0] != self.key else []
        if n > 1:
            starts += (pc.indices_nonzero(pc.not_equal(keys.slice(1), keys.slice(0, n - 1))).to_numpy() + 1).tolist()
        at = 0
        for k in [*starts, n]:
            # Rows from at to k go on with the run that is open.
            for i in ids[at:k]:
                if self.members and i != self.last_id:
                    yield self.run, i, self.first, None, None
                self.last_id = i
            self.n += k - at
            if k == n:
                break
            yield from self.closed(False)
            self.opening = self.key is None
            self.run += 1
            self.key, self.first, self.last_id, self.n = keys[k], ids[k], ids[k], 1
            at = k + 1

    def table(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * 5, SCHEMA, strict=True)], schema=SCHEMA)


def scanned(records: DataFrame, members: bool, **columns) -> DataFrame:
    rows = stable_table(keyed(records, **columns), "keys")
    n = max(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = rows.repartitionByRange(n, "key", "id").sortWithinPartitions("key", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return Scan(TaskContext.get().partitionId(), members)(batches)

    return stable(ordered.mapInArrow(run, OUT))


def _borders(rows: DataFrame) -> DataFrame:
    """(run, first, keep, n): the runs at borders of partitions, at most two a partition, with the first id and count of their whole group."""
    at_border = rows.where(F.col("n").isNotNull() & F.col("key").isNotNull())
    whole = at_border.groupBy("key").agg(F.min("first").alias("keep"), F.sum("n").alias("n"))
    return at_border.select("run", "first", "key").join(whole, "key").select("run", "first", "keep", "n")


def copies(records: DataFrame, **columns) -> DataFrame:
    """(keep_id, copy_id): each id of a group beside the smallest one."""
    rows = scanned(records, True, **columns)
    borders = _borders(rows)
    # As many rows as two a partition, of a number and an id each.
    moved = F.broadcast(borders.where("first <> keep").select("run", "keep"))
    others = rows.where(F.col("n").isNull()).join(moved, "run", "left").select(F.coalesce("keep", "first").alias("keep_id"), F.col("id").alias("copy_id"))
    return others.unionByName(borders.where("first <> keep").select(F.col("keep").alias("keep_id"), F.col("first").alias("copy_id")))


def representatives(records: DataFrame, **columns) -> DataFrame:
    """(keep_id, n_copies): one record of each group with the number of its rows, as the scan counted them."""
    rows = scanned(records, False, **columns)
    inner = rows.where(F.col("n").isNotNull() & F.col("key").isNull()).select(F.col("first").alias("keep_id"), F.col("n").alias("n_copies"))
    return inner.unionByName(_borders(rows).groupBy(F.col("keep").alias("keep_id")).agg(F.max("n").alias("n_copies")))


_SQL_SPACE = r"[\s\p{Z}\p{Cc}\x{0B}]+"
_SQL_MARK = r"[\p{P}$+<=>^`|~]"


def _sql_words(x: str) -> str:
    twice = lambda y, left, mark: f"regexp_replace(regexp_replace({y}, '({left}){mark}({left})', '\\1\\2', 'g'), '({left}){mark}({left})', '\\1\\2', 'g')"
    in_word, in_number = (m.replace("'", "''") for m in (IN_WORD, IN_NUMBER))
    low = f"regexp_replace(lower(upper({x})), '{_SQL_SPACE}', ' ', 'g')"
    joined = twice(twice(low, r"[\p{L}\p{M}\p{N}]", in_word), r"\p{N}", in_number)
    return f"trim(regexp_replace(regexp_replace({joined}, '{_SQL_MARK}+', ' ', 'g'), ' +', ' ', 'g'), ' ')"


def _sql_key(c: str) -> str:
    """The key in DuckDB's dialect, which has no look-around: the comma before a label becomes a line break first."""
    cut = f"regexp_replace(trim({c}, ' '), ',\\s+([^:;,|\\n]+:\\s)', chr(10) || '\\1', 'g')"
    parts = f"list_filter(string_split_regex({cut}, '\\s*([;|\\n\\r•]|\\s/\\s)+\\s*'), lambda x: trim(x, ' ') <> '')"
    bare = f"list_transform({parts}, lambda x: regexp_replace(x, '^[\\s\"''“”‘’(\\[{{]+', ''))"
    field = f"{_sql_words('x[:instr(x, chr(58)) - 1]')} || chr(2) || {_sql_words('x[instr(x, chr(58)) + 1:]')}"
    is_fields = f"len({bare}) > 1 AND len(list_filter({bare}, lambda x: NOT regexp_matches(x, '^[^:;|\\n]+:.*\\S'))) = 0"
    return f"CASE WHEN {c} IS NULL THEN '~' WHEN {is_fields} THEN '=' || array_to_string(list_sort(list_transform({bare}, lambda x: {field})), chr(1)) ELSE '=' || {_sql_words(c)} END"


_SQL_GROUPS = f"""WITH k AS (SELECT id, [source_lang, target_lang, domain, subdomain] AS scope, {_sql_key('source_text')} AS s, {_sql_key('target_text')} AS t FROM memory_entries WHERE id IS NOT NULL),
g AS (SELECT scope, s, t, min(id) AS keep_id, count(*) AS n_copies FROM k GROUP BY ALL)"""
COPIES_SQL = f"{_SQL_GROUPS} SELECT DISTINCT keep_id, id AS copy_id FROM k JOIN g ON k.scope IS NOT DISTINCT FROM g.scope AND k.s = g.s AND k.t = g.t WHERE id <> keep_id"
REPRESENTATIVES_SQL = f"{_SQL_GROUPS} SELECT keep_id, n_copies FROM g"
