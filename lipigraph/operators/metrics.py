"""Counts and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lipigraph.functions import entities as E
from lipigraph.functions import text as T


def document_counts(segments: DataFrame, translations: DataFrame) -> DataFrame:
    """Segments of each document by status; what is neither approved nor in review is pending."""
    t = translations.select(F.col("segment_id").alias("id"), (F.col("status") == "memory_applied").alias("memory"))
    return segments.select("id", "document_id", "status").join(t, "id", "left").groupBy("document_id").agg(
        F.count(F.lit(1)).alias("segments"),
        F.count_if(F.col("status") == "approved").alias("approved"),
        F.count_if(F.col("status") == "needs_review").alias("needs_review"),
        F.count_if(~F.col("status").isin("approved", "needs_review")).alias("pending"),
        F.count_if("memory").alias("memory_applied"),
    )


def trust_summary(segments: DataFrame, translations: DataFrame, kept: bool = True) -> DataFrame:
    """Approval, memory, protected values and open reasons of each document. Values count where there is a text; rows without a translation count in the totals alone."""
    t = translations.select(F.col("segment_id").alias("id"), F.col("status").alias("t_status"), T.effective_text(F.col("approved_text"), F.col("candidate_text")).alias("effective"), F.size("risk_reasons").alias("n_reasons"))
    j = segments.select("id", "document_id", "status", "protected_entities").join(t, "id", "left")
    has = F.coalesce(F.col("effective") != "", F.lit(False))
    aggregates = [
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "approved").alias("approved"),
        F.count_if(F.col("t_status") == "memory_applied").alias("memory_reused"),
        F.sum(F.when(has, F.greatest(F.size("protected_entities"), F.lit(0))).otherwise(0)).alias("protected_total"),
        F.count_if((F.col("status") != "approved") & (F.col("n_reasons") > 0)).alias("unresolved"),
    ]
    if kept:
        j = j.withColumn("kept", F.when(has, E.count_kept(E.full(segments, "protected_entities"), F.col("effective"))).otherwise(0))
        aggregates.insert(4, F.sum("kept").alias("protected_preserved"))
    return j.groupBy("document_id").agg(*aggregates)


def analytics_summary(documents: DataFrame, segments: DataFrame, translations: DataFrame, memory: DataFrame, events: DataFrame, terms: DataFrame) -> DataFrame:
    """One row of global counts; each table is read once."""
    d = documents.agg(F.count(F.lit(1)).alias("total_documents"), F.count_if(F.col("status") == "exported").alias("total_exports"))
    s = segments.agg(F.count(F.lit(1)).alias("total_segments"), F.count_if(F.col("status") == "approved").alias("approved_segments"))
    # Sums by provider, of which there are few, give the totals too.
    by = translations.groupBy("provider_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("source_type") == "memory").alias("reused"), F.sum("risk_score").alias("risk"), F.count("risk_score").alias("scored"))
    named = F.filter(F.collect_list(F.struct("provider_name", "n")), lambda x: x["provider_name"].isNotNull())
    t = by.agg(
        F.coalesce(F.sum("reused"), F.lit(0)).alias("memory_reuse_count"),
        F.round(F.coalesce(F.try_divide(F.sum("risk"), F.sum("scored")), F.lit(0.0)), 2).alias("average_risk"),
        F.map_from_entries(F.array_sort(named)).alias("provider_breakdown"),
    )
    m = memory.agg(F.count_if("is_active").alias("active_memory"))
    e = events.agg(F.count_if(F.col("event_type").isin("edit", "edit_and_approve")).alias("corrections"))
    g = terms.agg(F.count(F.lit(1)).alias("total_glossary_terms"))
    return d.crossJoin(s).crossJoin(t).crossJoin(m).crossJoin(e).crossJoin(g)  # one row each


def provider_breakdown(translations: DataFrame) -> DataFrame:
    return translations.groupBy("provider_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("risk_score"), 4).alias("average_risk"))


def document_list(documents: DataFrame, segments: DataFrame, translations: DataFrame) -> DataFrame:
    """Every document with its counts, the newest first."""
    counts = document_counts(segments, translations).withColumnRenamed("document_id", "id").select("id", "segments", "approved", "memory_applied")
    shown = documents.select("id", "original_filename", T.title_label(F.col("domain"), T.shown_scope(F.col("subdomain"))).alias("scope_label"), "status", "created_at")
    return shown.join(counts, "id", "left").fillna(0, ["segments", "approved", "memory_applied"]).orderBy(F.desc("created_at"), "id")


def events_by_segment(events: DataFrame) -> DataFrame:
    """The types of a segment's events in order of time, repeated rows once."""
    once = events.dropDuplicates(["id"])
    return once.groupBy("segment_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id", "event_type"))), lambda e: e["event_type"]), ">").alias("events"), F.count(F.lit(1)).alias("n"))


def first_baseline(events: DataFrame) -> DataFrame:
    """(segment_id, baseline): the text before the first edit that has one."""
    edits = events.where(F.col("event_type").isin("edit", "edit_and_approve") & (F.coalesce("before_text", F.lit("")) != ""))
    return edits.groupBy("segment_id").agg(F.min_by("before_text", F.struct("created_at", "id")).alias("baseline"))


#: Segments of a document that one task numbers at a time; a document of any size is many of these.
STRETCH = 1_000


def _stretches(segments: DataFrame) -> tuple[DataFrame, Window, DataFrame]:
    """segments with their stretch of a document (by sequence, nulls first), the order within it, and one narrow row of each stretch: its last text and its rows."""
    s = segments.withColumn("_stretch", F.coalesce(F.floor(F.col("sequence") / STRETCH), F.lit(-1)))
    last = F.max_by(F.col("source_text"), F.struct("sequence", "id")) if "source_text" in segments.columns else F.lit(None).cast("string")
    return s, Window.partitionBy("document_id", "_stretch").orderBy("sequence", "id"), s.groupBy("document_id", "_stretch").agg(last.alias("_last"), F.count(F.lit(1)).alias("_rows"))


def numbered(segments: DataFrame) -> DataFrame:
    """segments (document_id, sequence, id) with n, their place in their document from 1."""
    s, order, each = _stretches(segments)
    over = Window.partitionBy("document_id").orderBy("_stretch")
    ahead = each.withColumn("_ahead", F.coalesce(F.sum("_rows").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("document_id", "_stretch", "_ahead")
    out = s.withColumn("_n", F.row_number().over(order)).join(ahead, ["document_id", "_stretch"], "left")
    return out.select(*segments.columns, (F.coalesce("_ahead", F.lit(0)) + F.col("_n")).cast("long").alias("n"))


def previous_text(segments: DataFrame) -> DataFrame:
    """Each segment with the text before it in its document; a stretch's first gets the last of the stretch before."""
    s, order, each = _stretches(segments)
    before = each.withColumn("_before", F.lag("_last").over(Window.partitionBy("document_id").orderBy("_stretch"))).select("document_id", "_stretch", "_before")
    own = s.withColumns({"_own": F.lag("source_text").over(order), "_n": F.row_number().over(order)}).join(before, ["document_id", "_stretch"], "left")
    return own.select(*segments.columns, F.when(F.col("_n") == 1, F.col("_before")).otherwise(F.col("_own")).alias("previous_text"))


def chunks(segments: DataFrame, size: int, first: int) -> DataFrame:
    """(id, chunk): consecutive segments of a document in groups, a small one first so that something shows soon."""
    n = F.col("n")
    return numbered(segments).select("id", F.when(n <= first, 0).otherwise(F.floor((n - first - 1) / size).cast("int") + 1).alias("chunk"))


def remaining(counts: DataFrame) -> DataFrame:
    """Approvals left, whether all are given, and the share of protected values kept (of counts with protected_preserved); null where there are none."""
    return counts.select(
        "document_id", F.greatest(F.lit(0), F.col("total") - F.col("approved")).alias("remaining"), ((F.col("total") > 0) & (F.col("approved") == F.col("total"))).alias("all_approved"),
        F.round(F.try_divide(F.col("protected_preserved"), F.nullif(F.col("protected_total"), F.lit(0))), 6).alias("preserved_share"),
    )


def usage(translations: DataFrame, events: DataFrame) -> DataFrame:
    """(memory_entry_id, n_used, last_used): how often an entry served, and when one of its translations was last touched."""
    last = events.groupBy(F.col("translation_id").alias("id")).agg(F.max("created_at").alias("at"))
    return translations.where("memory_entry_id IS NOT NULL").select("id", "memory_entry_id").join(last, "id", "left").groupBy("memory_entry_id").agg(F.count(F.lit(1)).alias("n_used"), F.max("at").alias("last_used"))
