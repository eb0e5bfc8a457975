"""Joins of the document dataflow. Sizes decide how they run: nothing is broadcast by hand but tables whose size is a
parameter or was checked, so at scale the big sides shuffle on their keys and adaptive execution splits hot ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lipigraph.functions import text as T
from lipigraph.functions import values

SCOPE = ["source_lang", "target_lang", "domain", "subdomain"]
#: Rows of a dictionary that may be sent to every task, checked by count.
MAX_DICTIONARY = 50_000


def provenance(translations: DataFrame, memory: DataFrame, documents: DataFrame) -> DataFrame:
    """Translations with the memory entry they came from and the file in which that was approved; a missing link stays null."""
    m = memory.select(F.col("id").alias("memory_entry_id"), "created_from_document_id", "approved_by", "times_used")
    d = documents.select(F.col("id").alias("created_from_document_id"), "original_filename")
    return translations.select("id", "memory_entry_id").join(m, "memory_entry_id", "left").join(d, "created_from_document_id", "left")


def scoped(segments: DataFrame, documents: DataFrame) -> DataFrame:
    """Segments with the scope of their document."""
    d = documents.select(F.col("id").alias("document_id"), "source_lang", "target_lang", "domain", T.scope(F.col("subdomain")).alias("subdomain"))
    return segments.join(d, "document_id")


def glossary_hits(segments: DataFrame, terms: DataFrame, key: Column | None = None) -> DataFrame:
    """(id, source_term, target_term, term_type): terms that a segment (id, source_text and scope) contains, of its scope or of no subdomain. The normal form is made from the text, since a stored one may be stale.

    The dictionary joins by its scope, an equality; the text is compared within. A dictionary above the bound is broadcast in blocks below it, each with its own pass over the segments."""
    t = terms.select("source_lang", "target_lang", "domain", F.col("subdomain").alias("term_subdomain"), "source_term", "target_term", "term_type", "case_sensitive", "normalized_source_term")
    raw = T.without_urls(F.col("source_text"))
    plain = T.normalize_text(raw)
    s = segments.select("id", *SCOPE, raw.alias("raw"), plain.alias("plain"))
    found = F.when(F.col("case_sensitive"), F.contains("raw", "source_term")).otherwise(F.contains("plain", "normalized_source_term"))
    within = (F.col("term_subdomain") == F.col("subdomain")) | (F.col("term_subdomain") == T.SCOPE_NONE)
    on = ["source_lang", "target_lang", "domain"]
    if t.limit(MAX_DICTIONARY + 1).count() <= MAX_DICTIONARY:
        joined = s.join(F.broadcast(t), on).where(within & found)
    else:
        t = t.distinct()
        # Blocks of half the bound on average, so that chance doesn't bring one above it.
        n = 2 * t.count() // max(1, MAX_DICTIONARY) + 1
        block = F.pmod(F.xxhash64(*t.columns), F.lit(n))
        joined = reduce(DataFrame.unionByName, (s.join(F.broadcast(t.where(block == k)), on).where(within & found) for k in range(n)))
    return joined.select("id", "source_term", "target_term", "term_type").distinct()


def nested_hits(segments: DataFrame, hits: DataFrame) -> DataFrame:
    """Segments with their hits as one list in the order of terms; an empty list without hits."""
    lists = hits.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("source_term", "target_term", "term_type"))).alias("hits"))
    return segments.join(lists, "id", "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<struct<source_term:string,target_term:string,term_type:string>>")))


def active_memory(memory: DataFrame) -> DataFrame:
    """One active entry of each scope and source: the one approved last, the smaller id of equals."""
    latest = F.max_by(F.struct("id", "target_text", "times_used"), F.struct(F.coalesce("approved_at", F.lit("1970-01-01").cast("timestamp_ntz")), F.col("id")))
    return memory.where("is_active").groupBy(*SCOPE, "normalized_source").agg(latest.alias("e")).select(*SCOPE, "normalized_source", F.col("e.id").alias("memory_id"), F.col("e.target_text").alias("memory_text"), F.col("e.times_used").alias("memory_times_used"))


def memory_lookup(segments: DataFrame, memory: DataFrame, how: str = "inner") -> DataFrame:
    """Segments (with scope) whose normalised text the memory of their very scope has; no fallback to other subdomains."""
    return segments.join(active_memory(memory), [*SCOPE, "normalized_source"], how)


def work_list(segments: DataFrame, memory: DataFrame) -> DataFrame:
    """Segments left for a provider: neither a structural label nor in the memory."""
    open_ = segments.where(T.structural_label(F.col("source_text")).isNull())
    return open_.join(active_memory(memory).select(*SCOPE, "normalized_source"), [*SCOPE, "normalized_source"], "left_anti")


def identical_open(segments: DataFrame) -> DataFrame:
    """(document_id, source_text, n_open, n): texts that stand several times in a document with an open one among them; the aggregate that a self-join of equal segments comes to, without its pairs."""
    by = segments.groupBy("document_id", "source_text").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") != "approved").alias("n_open"))
    return by.where("n > 1 AND n_open > 0")


def contract_check(requested: DataFrame, results: DataFrame) -> DataFrame:
    """(segment_id, problem): answers that are missing, unasked for, repeated or blank."""
    r = results.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.trim(F.coalesce("translated_text", F.lit(""))) == "").alias("n_blank"))
    both = requested.select(F.col("id").alias("segment_id"), F.lit(True).alias("asked")).join(r, "segment_id", "full_outer")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("asked").isNull(), "extra").when(F.col("n") > 1, "duplicate").when(F.col("n_blank") > 0, "blank")
    return both.select("segment_id", problem.alias("problem")).where("problem IS NOT NULL")


def duplicate_uploads(documents: DataFrame) -> DataFrame:
    """(id, first_id): documents whose checksum and scope an earlier one that didn't fail has."""
    w = Window.partitionBy("checksum", *SCOPE).orderBy("created_at", "id")
    return documents.where("status <> 'failed'").withColumn("first_id", F.first("id").over(w)).where("id <> first_id").select("id", "first_id")


def write_back(cells: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Cells with the new text of their place where there is one."""
    return cells.join(new.withColumnRenamed("text", "new_text"), keys, "left").withColumn("text", F.coalesce("new_text", "text")).drop("new_text")


def bank(spark: SparkSession) -> DataFrame:
    """(key, lang, phrase): the fixed phrases."""
    return spark.createDataFrame([(k, lang, x) for k, by in values.PHRASES.items() for lang, x in by.items()], "key string, lang string, phrase string")


def phrase_bank(texts: DataFrame, bank: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """Texts with the key of the phrase they are, by language and normalised text. The bank is a parameter table; of equal phrases the first key counts."""
    b = bank.select(F.col("lang").alias(lang), T.normalize_text("phrase").alias("_plain"), "key").groupBy(lang, "_plain").agg(F.min("key").alias("key"))
    return texts.withColumn("_plain", T.normalize_text(text)).join(F.broadcast(b), [lang, "_plain"], "left").drop("_plain")


def default_terms(spark: SparkSession) -> DataFrame:
    """The terms of a new glossary."""
    rows = [(a, b, c, d, x, y, t) for a, b, c, d, x, y, t in values.DEFAULT_TERMS]
    df = spark.createDataFrame(rows, "source_lang string, target_lang string, domain string, subdomain string, source_term string, target_term string, term_type string")
    return df.withColumns({"subdomain": T.scope(F.col("subdomain")), "normalized_source_term": T.normalize_text("source_term"), "case_sensitive": F.lit(False)})


def seeded(terms: DataFrame) -> DataFrame:
    """The glossary, or the terms of a new one where it is empty."""
    return default_terms(terms.sparkSession) if terms.isEmpty() else terms


def memory_list(memory: DataFrame, documents: DataFrame) -> DataFrame:
    """Active entries with the file they were approved in and a label of their provenance, the latest approval first."""
    d = documents.select(F.col("id").alias("created_from_document_id"), F.col("original_filename").alias("source_filename"))
    m = memory.where("is_active").join(d, "created_from_document_id", "left")
    return m.select("id", *SCOPE, "target_text", "approved_by", "approved_at", "times_used", "source_filename", provenance_label(F.col("source_filename"), F.col("domain"), F.col("subdomain"), F.col("approved_at"), F.col("times_used")).alias("provenance")).orderBy(F.desc_nulls_last("approved_at"), "id")


def provenance_label(filename: Column, domain: Column, subdomain: Column, approved_at: Column, times_used: Column) -> Column:
    """Where a reused text comes from: file, scope, day of approval, uses."""
    used = F.concat(times_used.cast("string"), F.when(times_used == 1, " use").otherwise(" uses"))
    origin = F.when(F.coalesce(filename, F.lit("")) != "", F.concat(F.lit("Reused from "), filename)).otherwise("Reused from approved memory")
    return F.concat_ws(" · ", origin, T.title_label(domain, T.shown_scope(subdomain)), F.concat(F.lit("approved "), F.date_format(approved_at, "MMM d")), used)


def unprepared(parsed: DataFrame, prepared: DataFrame) -> DataFrame:
    """Parsed segments that aren't prepared yet, by document and place."""
    return parsed.join(prepared.select("document_id", "sequence"), ["document_id", "sequence"], "left_anti")


def insert_documents(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New documents whose checksum and scope no existing one has that didn't fail; of equal new ones the first."""
    key = ["checksum", *SCOPE]
    known = existing.where("status <> 'failed'").select(*key)
    first = new.groupBy(*key).agg(F.min("id").alias("id"))
    on = [F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}")) for c in key]
    return first.alias("n").join(known.alias("k"), on, "left_anti")
