"""Read models: what a client is shown of documents, segments and memory, as nested rows that become JSON as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lipigraph.functions import text as T
from lipigraph.operators import joins, metrics

# Labels of codes.
SEGMENT_LABELS = {"paragraph": "Text segment", "table_cell_paragraph": "Table segment"}
ENTITY_LABELS = {"date": "Date", "money": "Money", "number": "Number", "phone": "Phone", "url": "URL", "office": "Office", "id": "ID", "ward": "Ward"}
LANGUAGE_LABELS = {"en": "English", "ne": "Nepali", "tmg": "Tamang"}
SOURCE_LABELS = {"memory": "From scoped translation memory", "preserved": "Preserved exactly"}


def labelled(code: Column, labels: dict[str, str], other: Column) -> Column:
    out = other
    for k, v in labels.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def segment_label(kind: Column) -> Column:
    return labelled(kind, SEGMENT_LABELS, F.lit("Segment"))


def entity_label(kind: Column) -> Column:
    return labelled(kind, ENTITY_LABELS, T.title_label(kind))


def language_label(code: Column) -> Column:
    return labelled(code, LANGUAGE_LABELS, code)


def source_label(source_type: Column, provider: Column) -> Column:
    """How a text came about."""
    by = F.when(F.coalesce(provider, F.lit("")) == "", "From translation provider").otherwise(F.concat(F.lit("From "), T.title_label(provider), F.lit(" provider")))
    return labelled(source_type, SOURCE_LABELS, F.when(source_type == "provider", by).otherwise("Ready for reviewer confirmation"))


def documents(docs: DataFrame, segments: DataFrame, translations: DataFrame) -> DataFrame:
    """Each document with its counts and trust summary; documents without segments have zeros."""
    counts = metrics.document_counts(segments, translations)
    trust = metrics.trust_summary(segments, translations)
    c = counts.select(F.col("document_id").alias("id"), F.struct(*counts.columns[1:]).alias("counts"))
    t = trust.select(F.col("document_id").alias("id"), F.struct(*trust.columns[1:]).alias("trust_summary"))
    shown = docs.select("id", "original_filename", "file_type", "source_lang", "target_lang", "domain", T.shown_scope(F.col("subdomain")).alias("subdomain"), "status", "export_file_uri", "created_at", "updated_at")
    zero = lambda df: F.struct(*(F.lit(0).cast("long").alias(x) for x in df.columns[1:]))
    return shown.join(c, "id", "left").join(t, "id", "left").withColumns({"counts": F.coalesce("counts", zero(counts)), "trust_summary": F.coalesce("trust_summary", zero(trust))})


def segments(segments_: DataFrame, translations: DataFrame, memory: DataFrame, docs: DataFrame) -> DataFrame:
    """Each segment with its translation and where a reused text comes from; nulls where there is none."""
    d = docs.select(F.col("id").alias("created_from_document_id"), F.col("original_filename").alias("source_document_filename"))
    m = memory.join(d, "created_from_document_id", "left").select(
        F.col("id").alias("memory_entry_id"), F.struct("source_document_filename", T.title_label(F.col("domain"), T.shown_scope(F.col("subdomain"))).alias("scope_label"), "approved_at", "times_used").alias("memory_provenance"),
        joins.provenance_label(F.col("source_document_filename"), F.col("domain"), F.col("subdomain"), F.col("approved_at"), F.col("times_used")).alias("label"),
    )
    t = translations.join(m, "memory_entry_id", "left").select(
        F.col("segment_id").alias("id"), F.struct("id", "candidate_text", "raw_candidate_text", "approved_text", "source_type", "provider_name", "memory_entry_id", "risk_score", "risk_reasons", "status", "is_repaired", "memory_provenance").alias("translation"),
        source_label(F.col("source_type"), F.col("provider_name")).alias("source_label"), F.col("label").alias("provenance_label"),
    )
    return segments_.select("id", "document_id", "sequence", "segment_type", segment_label(F.col("segment_type")).alias("segment_label"), "source_text", "normalized_source", "protected_entities", "glossary_hits", "status").join(t, "id", "left")


def as_json(view: DataFrame, key: str = "id") -> DataFrame:
    """(key, json): one JSON object a row."""
    return view.select(key, F.to_json(F.struct(*view.columns)).alias("json"))
