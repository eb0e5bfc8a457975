"""The queries of the training-data problems over the shared tables, with production parameters."""

from __future__ import annotations

import hashlib
import secrets
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lipigraph.llm import dedup, langid, leakage, lookalike, mixing, pairs, pii, safety
from lipigraph.session import spread, table

PII_FIELDS = [("segments", "source_text"), ("translations", "approved_text"), ("review_events", "after_text")]


def secret(spark: SparkSession) -> bytes:
    """The key of the pseudonyms: that of the setting spark.lipigraph.pii.key, else one drawn at random for this application."""
    own = spark.conf.get("spark.lipigraph.pii.key", None)
    if own:
        return hashlib.blake2b(own.encode(), digest_size=32).digest()
    sc = spark.sparkContext
    if not hasattr(sc, "_lipigraph_secret"):
        sc._lipigraph_secret = secrets.token_bytes(32)
    return sc._lipigraph_secret


def _pii(spark: SparkSession, d: str, found_only: bool) -> list[tuple[str, DataFrame]]:
    frames = [(f"{t}.{c}", table(spark, d, t), c) for t, c in PII_FIELDS]
    names = pii.learn_names([df.select(c) for _, df, c in frames])
    return [(field, pii.find_pii(df, "id", c, names, secret(spark), dates=not found_only, found_only=found_only)) for field, df, c in frames]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Field values with personal information, and its types."""
    parts = [df.select(F.lit(f).alias("field_name"), "row_id", F.explode("types").alias("pii_type")) for f, df in _pii(spark, d, True)]
    # Repeated rows of review_events have the same id and text.
    return reduce(DataFrame.unionByName, parts).distinct()


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every field value with placeholders in place of personal information, its dates permuted."""
    parts = [df.select(F.lit(f).alias("field_name"), "row_id", "text", F.array_join("types", ",").alias("pii_types")) for f, df in _pii(spark, d, False)]
    return reduce(DataFrame.unionByName, parts)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    model = langid.fit(table(spark, d, "lang_samples"))
    return pairs.find_defects(pairs.pairs_of(spread(table(spark, d, "segments").select("id", "document_id", "source_text")), spread(table(spark, d, "translations").select("segment_id", "candidate_text")), table(spark, d, "document_summary")), model)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Defective pairs with the first type that fits."""
    return _pairs(spark, d).select("segment_id", F.col("types")[0].alias("defect_type"))


def p2_defects(spark: SparkSession, d: str) -> DataFrame:
    """Every type that a defective pair shows, and what the attempts at it reported."""
    told = _pairs(spark, d).join(pairs.reported(table(spark, d, "translation_results")), "segment_id", "left")
    return told.select("segment_id", F.array_join("types", ",").alias("defect_types"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_errors", "n_cut")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Copies of memory entries beside the one that is kept."""
    return dedup.copies(table(spark, d, "memory_entries"))


def p3_representatives(spark: SparkSession, d: str) -> DataFrame:
    """One memory entry of each group of copies, with their number."""
    return dedup.representatives(table(spark, d, "memory_entries"))


def _languages(spark: SparkSession, d: str, find) -> DataFrame:
    return find(table(spark, d, "document_summary"), table(spark, d, "segments"), langid.fit(table(spark, d, "lang_samples")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a missing or wrong language label, and segments in another language."""
    return _languages(spark, d, langid.find_mislabelled).select("record_level", "row_id", "lang")


def p4_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of every document and of every segment of the mixed ones."""
    return _languages(spark, d, langid.find_languages).select("record_level", "row_id", "lang", F.round("confidence", 4).alias("confidence"))


def _consistent(spark: SparkSession, d: str, changed_only: bool) -> DataFrame:
    segments, memory = table(spark, d, "segments"), table(spark, d, "memory_entries")
    both = ["source_text", "normalized_source"]
    rewriter = lookalike.model((segments, both), (memory, ["source_text"]))
    named = lambda df, t: df.select(F.concat(F.lit(f"{t}."), "field").alias("field_name"), "row_id", "text", "changed")
    return named(lookalike.consistent(spread(segments), "id", both, rewriter, changed_only), "segments").unionByName(
        named(lookalike.consistent(spread(memory), "id", ["source_text"], rewriter, changed_only), "memory_entries")
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Field values with characters that only look like the usual ones."""
    return _consistent(spark, d, True).select("field_name", "row_id")


def p5_consistent(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of every field value."""
    return _consistent(spark, d, False).select("field_name", "row_id", "text")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that contain an evaluation item or a passage of it."""
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mixture: documents with the number of times each is taken."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source."""
    targets = table(spark, d, "mix_targets")
    return mixing.shares(mixing.mix(table(spark, d, "documents"), targets), targets)


def p7_plan(spark: SparkSession, d: str) -> DataFrame:
    """What is due from each source where characters are the size."""
    sized = table(spark, d, "documents").select("source", F.col("n_chars").alias("tokens"))
    return mixing.plan(sized, table(spark, d, "mix_targets")).select("source", "tokens", F.round("due", 3).alias("due"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return safety.score_documents(documents, safety.fit(documents, table(spark, d, "safety_labels")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with abusive, hateful or sexual language."""
    return _scored(spark, d).where("flagged").select("doc_id").distinct()


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score of every document."""
    return _scored(spark, d).select("doc_id", F.round("score", 4).alias("score"), "flagged")


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """The rate of harmful documents of every source."""
    return safety.rates(_scored(spark, d))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_redacted, p2_found, p2_defects, p3_found, p3_representatives, p4_found, p4_confidence, p5_found, p5_consistent, p6_found, p7_mix, p7_shares, p7_plan, p8_found, p8_scores, p8_rates)
}
ORACLE: dict[str, str] = {"p3_found": dedup.COPIES_SQL, "p3_representatives": dedup.REPRESENTATIVES_SQL, "p7_plan": mixing.PLAN_SQL}
