"""Problem 7: a mixture of sources by target shares of the total size in tokens.

Capped water-filling: each source gets its share of the total unless that takes more than its repetitions allow; what
exceeds is spread over the others in proportion to their shares until it fits. A source's documents are then all taken the
whole number of times, and a seeded sample of them once more for the fraction: in the order of a hash, up to the tokens
that are due. That order is summed in two levels, so no task holds a whole source.

Defined results: documents without text have no tokens; documents of null or unlisted sources aren't taken; a source that is
listed but has no tokens contributes nothing and its share goes to the others; if all sources are exhausted the total is
less than asked for; repeated rows are records of their own.
"""

from __future__ import annotations

import base64
import functools
import os

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lipigraph.session import spread, stable

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the public pattern that byte-level vocabularies are cut by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BUCKETS = 4096
#: Sources times buckets that are sent to every task, some 60 MB; more are joined by a shuffle.
MAX_LEVELS = 1_000_000


@functools.cache
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens). The vocabulary is a file of the driver that goes to the executors with the job; none of them needs the path."""
    documents.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("n_tokens", pa.int64())])

    def run(batches):
        encode = encoding(SparkFiles.get(name)).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], schema=schema)

    rows = spread(documents.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text"))
    return rows.mapInArrow(run, "doc_id long, source string, n_tokens long")


def water_fill(total: float, sources: dict[str, tuple[float, float, float]]) -> dict[str, float]:
    """Tokens due from each source (share, tokens, most repeats): shares of the total, none above tokens times repeats."""
    due = dict.fromkeys(sources, 0.0)
    open_ = {s for s, (share, size, cap) in sources.items() if share > 0 and size * cap > 0}
    left = total
    while open_ and left > 0:
        weight = sum(sources[s][0] for s in open_)
        full = {s for s in open_ if left * sources[s][0] / weight >= sources[s][1] * sources[s][2]}
        if not full:
            for s in open_:
                due[s] = left * sources[s][0] / weight
            break
        for s in full:
            due[s] = sources[s][1] * sources[s][2]
            left -= due[s]
        open_ -= full
    return due


def _plan(sized: DataFrame, targets: DataFrame, total: int | None) -> tuple[list[tuple], dict[str, tuple[float, float, float]]]:
    """(source, tokens, due, whole repetitions, tokens beyond these) of each listed source, of sizes (source, tokens) in any number of rows."""
    listed = targets.where(F.col("source").isNotNull())
    sums = sized.join(F.broadcast(listed.select("source").distinct()), "source", "left_semi").groupBy("source").agg(F.sum("tokens").alias("tokens"))
    sizes = {r.source: r.tokens or 0 for r in sums.collect()}
    sources = {r.source: (max(0.0, r.target_share or 0.0), float(sizes.get(r.source, 0)), float(max(0, r.max_repeats or 0))) for r in listed.collect()}
    due = water_fill(float(total if total is not None else sum(sizes.values())), sources)
    rows = []
    for s, x in due.items():
        size, cap = sources[s][1], int(sources[s][2])
        whole = min(int(x / size + 1e-9), cap) if size else 0
        rows.append((s, int(size), x, whole, max(0.0, x - whole * size) if whole < cap else 0.0))
    return rows, sources


def plan(sized: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """The plan of a mixture as a table (source, tokens, due, whole, rest)."""
    return sized.sparkSession.createDataFrame(_plan(sized, targets, total)[0], "source string, tokens long, due double, whole int, rest double")


#: The plan with characters as size. The level up to which sources are filled follows from their caps in the order of cap over share.
PLAN_SQL = """WITH z AS (SELECT source, greatest(target_share, 0) AS share, (coalesce((SELECT sum(n_chars) FROM documents d WHERE d.source = t.source), 0))::DOUBLE AS tokens, greatest(max_repeats, 0) AS repeats FROM mix_targets t),
o AS (SELECT *, tokens * repeats AS cap, sum(tokens) OVER () AS total FROM z), r AS (SELECT *, cap / share AS ratio FROM o WHERE share > 0 AND cap > 0),
k AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(share) OVER (ORDER BY ratio, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above FROM r),
l AS (SELECT arg_min((total - below) / above, ratio) AS level FROM k WHERE (total - below) / above <= ratio)
SELECT source, tokens::BIGINT AS tokens, round(CASE WHEN share > 0 AND cap > 0 THEN least(cap, coalesce(share * (SELECT level FROM l), cap)) ELSE 0 END, 3) AS due FROM o"""


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 1, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens, copies) for documents taken at least once. total: tokens of the mixture, by default those of the listed sources. targets (source, target_share, max_repeats) is a parameter of as many rows as there are sources."""
    spark = documents.sparkSession
    sized = stable(count_tokens(documents.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi"), path))
    u = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40))
    sized = sized.withColumn("bucket", (u / F.lit((1 << 40) / BUCKETS)).cast("int")).withColumn("u", u)
    buckets = stable(sized.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens")))
    rows, sources = _plan(buckets, targets, total)
    plan = F.broadcast(spark.createDataFrame([(s, whole, rest) for s, _, _, whole, rest in rows] or [("", 0, 0.0)], "source string, whole int, rest double"))
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    levels = buckets.withColumn("before", before).join(plan, "source").select("source", "bucket", "whole", (F.col("rest") - F.col("before")).alias("room"), "tokens")
    placed = sized.join(F.broadcast(levels) if len(sources) * BUCKETS <= MAX_LEVELS else levels, ["source", "bucket"])
    edge = (F.col("room") > 0) & (F.col("room") < F.col("tokens"))
    inner = placed.where(~edge).withColumn("more", (F.col("room") > 0).cast("int"))
    order = Window.partitionBy("source", "bucket").orderBy("u", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The documents of one bucket of each source are ordered one by one.
    outer = placed.where(edge).withColumn("more", (F.sum("n_tokens").over(order) <= F.col("room")).cast("int"))
    return inner.unionByName(outer).select("doc_id", "source", "n_tokens", (F.col("whole") + F.col("more")).alias("copies")).where("copies > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and actual share of each listed source, its documents and tokens in the mixture."""
    got = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.max("copies").alias("most_copies"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"))
    total = got.agg(F.sum("tokens").alias("total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return (
        targets.select("source", "target_share", "max_repeats").join(got, "source", "left").join(F.broadcast(total))
        .select("source", "target_share", "max_repeats", zero("n_documents"), zero("most_copies"), zero("tokens"), F.round(F.coalesce(F.try_divide("tokens", "total"), F.lit(0.0)), 6).alias("actual_share"))
    )
