"""Suggestion of a document's source language from weighted words and phrases. Both are parameter tables of a checked size
that go to every task; the default ones are the fixed values, others can be learned from labelled samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lipigraph.functions import text as T
from lipigraph.functions import values
from lipigraph.operators.metrics import numbered

LANGS = ("en", "ne", "tmg")
NAMES = {"en": "English", "ne": "Nepali", "tmg": "Tamang"}
TOKEN = r"[A-Za-z]+|[ऀ-ॿ]+"
#: Segments that a suggestion looks at, by their place in the document.
SAMPLE = 12
#: Words with a weight that may be sent to every task.
MAX_WEIGHTS = 100_000


def weights(spark: SparkSession) -> DataFrame:
    """(lang, token, weight): the fixed words, but for those at home in several languages."""
    rows = [(lang, token, w) for lang, words in values.TOKEN_WEIGHTS.items() for token, w in words.items() if token not in values.SHARED_TOKENS]
    return spark.createDataFrame(rows, "lang string, token string, weight double")


def weights_from(samples: DataFrame, least: int = 5, top: float = 3.5) -> DataFrame:
    """(lang, token, weight): words of at least so many samples, weighed up to top by the share of their samples in one language; those at home in several are left out."""
    words = samples.select("sample_id", "lang", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    n = words.groupBy("token", "lang").agg(F.count(F.lit(1)).alias("n"))
    by = n.groupBy("token").agg(F.sum("n").alias("all"), F.max_by("lang", F.struct("n", "lang")).alias("lang"), F.max("n").alias("most"))
    return by.where((F.col("all") >= least) & (F.col("most") / F.col("all") >= 0.8)).select("lang", "token", F.round(F.lit(top) * F.col("most") / F.col("all"), 2).alias("weight"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(T.normalize_text(text), F.lit(TOKEN), F.lit(0))


def letters(text: Column, range_: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{range_}]", ""))


def phrase_scores(plain: Column) -> dict[str, Column]:
    """What the telling phrases of each language in a normalised text add."""
    out = {}
    for x in LANGS:
        known = [values.PHRASES[k][x].lower() for k in values.TELLING_PHRASES]
        out[x] = sum((F.contains(plain, F.lit(p)).cast("double") * values.PHRASE_WEIGHT for p in known), F.lit(0.0))
    return out


def scores(texts: DataFrame, weights: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, s_en, s_ne, s_tmg, latin, native) for one text of each key: weighted words and phrases, and the bonus of Latin script for English."""
    if weights.limit(MAX_WEIGHTS + 1).count() > MAX_WEIGHTS:
        raise ValueError(f"more than {MAX_WEIGHTS} weighted words")
    phrases = phrase_scores(F.col("_plain"))
    # The normal form stands in a projection of its own, so that it is made once a text.
    base = texts.withColumn("_plain", T.normalize_text(text)).select(key, letters(F.col(text), "A-Za-z").alias("latin"), letters(F.col(text), "ऀ-ॿ").alias("native"), *(phrases[x].alias(f"p_{x}") for x in LANGS), F.regexp_extract_all("_plain", F.lit(TOKEN), F.lit(0)).alias("tokens"))
    known = base.select(key, "latin", "native", *(f"p_{x}" for x in LANGS), F.explode_outer("tokens").alias("token")).join(F.broadcast(weights), "token", "left")
    # Integer hundredths, so that sums don't depend on their order.
    sums = [F.coalesce(F.sum(F.when(F.col("lang") == x, F.round(F.col("weight") * 100).cast("long"))), F.lit(0)).alias(f"w_{x}") for x in LANGS]
    out = known.groupBy(key).agg(*(F.first(c).alias(c) for c in ("latin", "native", *(f"p_{x}" for x in LANGS))), *sums)
    bonus = F.when((F.col("latin") >= 18) & (F.col("latin") > 1.5 * F.col("native")), 4.0).when((F.col("latin") > 0) & (F.col("native") == 0), 2.5).otherwise(0.0)
    return out.select(key, *((F.col(f"w_{x}") / 100 + F.col(f"p_{x}") + (bonus if x == "en" else 0.0)).alias(f"s_{x}") for x in LANGS), "latin", "native")


def ranked() -> Column:
    """Languages by score; of equals the earlier of en, ne, tmg."""
    return F.array_sort(F.array(*(F.struct((-F.col(f"s_{x}")).alias("minus"), F.lit(i).alias("place"), F.lit(x).alias("lang")) for i, x in enumerate(LANGS))))


def decide(scored: DataFrame) -> DataFrame:
    """scored with detected and confidence: Latin script alone is English; else the best language by score and by its lead."""
    best, lead = -ranked()[0]["minus"], ranked()[1]["minus"] - ranked()[0]["minus"]
    native, latin = F.col("native") > 0, (F.col("latin") > 0) & (F.col("native") == 0)
    high, medium = native & (best >= 8) & (lead >= 4), native & (best >= 4) & (lead >= 1.5)
    return scored.withColumn("detected", F.when(latin, "en").when(high | medium, ranked()[0]["lang"])).withColumn("confidence", F.when(latin & (F.col("latin") >= 18), "high").when(latin, "medium").when(high, "high").when(medium, "medium").otherwise("low"))


def explained(decided: DataFrame) -> DataFrame:
    """decided (with votes) with an explanation of its outcome."""
    latin = (F.col("latin") > 0) & (F.col("native") == 0)
    name = F.coalesce(*(F.when(F.col("detected") == x, F.lit(n)) for x, n in NAMES.items()))
    across = F.when(F.col("votes") > 0, F.concat(F.lit(" across "), F.col("votes"), F.when(F.col("votes") == 1, " segment").otherwise(" segments"))).otherwise(" in the document preview")
    return decided.withColumn(
        "explanation",
        F.when(latin, "Mostly Latin script, so English.")
        .when(F.col("detected").isNotNull() & (F.col("confidence") == "high"), F.concat(F.lit("Strong "), name, F.lit(" phrase patterns"), across, F.lit(".")))
        .when(F.col("detected").isNotNull(), F.concat(F.lit("Likely "), name, F.lit(" wording; the choice stays manual.")))
        .when(F.col("native") > 0, "Devanagari whose wording several languages share; please confirm.")
        .otherwise("The sample does not tell its language."),
    )


def suggest(segments: DataFrame, weights: DataFrame) -> DataFrame:
    """(document_id, detected, confidence, votes, segment_count, explanation): from the first segments of each document, joined in order, and how many of them vote for the language alone."""
    all_ = numbered(segments.select("document_id", "sequence", "id", F.col("source_text").alias("text")))
    size = all_.groupBy("document_id").agg(F.count(F.lit(1)).alias("segment_count"))
    first = all_.where(F.col("n") <= SAMPLE)
    joined = first.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), " ").alias("text"))
    whole = decide(scores(joined, weights, "document_id"))
    single = scores(first.select(F.struct("document_id", "n").alias("key"), "text"), weights, "key")
    lead = ranked()[1]["minus"] - ranked()[0]["minus"]
    votes = single.where((-ranked()[0]["minus"] >= 3) & (lead >= 1.5)).groupBy(F.col("key.document_id").alias("document_id"), ranked()[0]["lang"].alias("detected")).agg(F.count(F.lit(1)).alias("votes"))
    out = whole.join(votes, ["document_id", "detected"], "left").fillna(0, ["votes"]).join(size, "document_id")
    return explained(out).select("document_id", "detected", "confidence", "votes", "segment_count", "explanation")
