"""Every query of the core, by name, with the SQL it is checked against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lipigraph.functions import entities as E
from lipigraph.functions import register
from lipigraph.functions import rules as R
from lipigraph.functions import text as T
from lipigraph.functions import values
from lipigraph.operators import feedback, joins, language, metrics, pipeline, providers, regions, review, views
from lipigraph.operators.joins import SCOPE
from lipigraph.plans import oracle
from lipigraph.sources import segmenters, sinks
from lipigraph.streaming import progress
from lipigraph.session import spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str = "") -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# Parts of the SQL side.
SPACE = r"[\t\n\v\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ONCE = "(SELECT * FROM review_events QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at) = 1)"
EFFECTIVE = oracle.strip("coalesce(nullif(approved_text, ''), candidate_text, '')")
SCOPED = """scoped AS (SELECT s.*, d.source_lang, d.target_lang, d.domain, coalesce(nullif(trim(d.subdomain), ''), '__none__') AS subdomain
  FROM segments s JOIN document_summary d ON s.document_id = d.id)"""
ACTIVE = """active AS (SELECT * FROM memory_entries WHERE is_active
  QUALIFY row_number() OVER (PARTITION BY source_lang, target_lang, domain, subdomain, normalized_source ORDER BY coalesce(approved_at, TIMESTAMP '1970-01-01') DESC, id DESC) = 1)"""
STRUCTURAL = r"""CASE WHEN source_text IS NULL OR regexp_matches(source_text, '(^|[^\p{L}\p{N}_])(\p{Nd}{4}[-/]\p{Nd}{1,2}[-/]\p{Nd}{1,2}|\p{Nd}{1,2}[-/]\p{Nd}{1,2}[-/]\p{Nd}{2,4})($|[^\p{L}\p{N}_])') THEN NULL
  WHEN regexp_matches(trim(source_text), '^(#\p{Nd}+|\p{Nd}+([.,:/-]\p{Nd}+)*)$') THEN translate(trim(source_text), '0123456789', '०१२३४५६७८९')
  WHEN regexp_matches(trim(source_text), '^[ivxlcdmIVXLCDM]{1,8}$') OR regexp_matches(trim(source_text), '^[•\-–—]$') OR (regexp_matches(trim(source_text), '^[.·•\-–—\s]{3,}$') AND regexp_matches(source_text, '[.·•]')) THEN trim(source_text) END"""


def _scoped(spark: SparkSession, d: str) -> DataFrame:
    return joins.scoped(table(spark, d, "segments"), table(spark, d, "document_summary"))


def _current(spark: SparkSession, d: str) -> DataFrame:
    """The same with the normal form of the text as it is now; a stored one may be stale."""
    return _scoped(spark, d).withColumn("normalized_source", T.normalize_text("source_text"))


CURRENT = f"current AS (SELECT * REPLACE (lower({oracle.shown('source_text')}) AS normalized_source) FROM scoped)"


@query(f"""WITH t AS (SELECT segment_id, status AS t_status, {EFFECTIVE} AS effective, len(risk_reasons) AS n_reasons FROM translations)
SELECT document_id, count(*) AS total, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (t_status = 'memory_applied') AS memory_reused,
  sum(CASE WHEN coalesce(effective, '') <> '' THEN coalesce(len(protected_entities), 0) ELSE 0 END)::BIGINT AS protected_total,
  count(*) FILTER (status <> 'approved' AND n_reasons > 0) AS unresolved
FROM segments LEFT JOIN t ON segment_id = id GROUP BY document_id""")
def trust_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.trust_summary(table(spark, d, "segments"), table(spark, d, "translations"), kept=False)


@query(oracle.PRESERVED)
def trust_summary_preserved(spark: SparkSession, d: str) -> DataFrame:
    return metrics.trust_summary(spread(table(spark, d, "segments")), spread(table(spark, d, "translations")))


@query("""SELECT document_id, count(*) AS segments, count(*) FILTER (s.status = 'approved') AS approved, count(*) FILTER (s.status = 'needs_review') AS needs_review,
  count(*) FILTER (s.status NOT IN ('approved', 'needs_review')) AS pending, count(*) FILTER (t.status = 'memory_applied') AS memory_applied
FROM segments s LEFT JOIN translations t ON t.segment_id = s.id GROUP BY document_id""")
def document_counts(spark: SparkSession, d: str) -> DataFrame:
    return metrics.document_counts(table(spark, d, "segments"), table(spark, d, "translations"))


@query("""WITH c AS (SELECT document_id, count(*) AS segments, count(*) FILTER (s.status = 'approved') AS approved, count(*) FILTER (t.status = 'memory_applied') AS memory_applied
  FROM segments s LEFT JOIN translations t ON t.segment_id = s.id GROUP BY document_id),
title AS (SELECT id, list_transform(string_split(replace(domain, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])) AS dom,
  list_transform(string_split(replace(nullif(nullif(subdomain, '__none__'), ''), '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])) AS sub FROM document_summary)
SELECT d.id, original_filename, concat_ws(' / ', array_to_string(dom, ' '), array_to_string(sub, ' ')) AS scope_label, status, epoch_us(created_at) AS created_us,
  coalesce(segments, 0) AS segments, coalesce(approved, 0) AS approved, coalesce(memory_applied, 0) AS memory_applied
FROM document_summary d JOIN title USING (id) LEFT JOIN c ON c.document_id = d.id""")
def document_list(spark: SparkSession, d: str) -> DataFrame:
    listed = metrics.document_list(table(spark, d, "document_summary"), table(spark, d, "segments"), table(spark, d, "translations"))
    return listed.withColumn("created_at", F.unix_micros(F.col("created_at").cast("timestamp"))).withColumnRenamed("created_at", "created_us")


@query("""SELECT (SELECT count(*) FROM document_summary) AS total_documents, (SELECT count(*) FROM document_summary WHERE status = 'exported') AS total_exports,
  (SELECT count(*) FROM segments) AS total_segments, (SELECT count(*) FROM segments WHERE status = 'approved') AS approved_segments,
  (SELECT count(*) FROM translations WHERE source_type = 'memory') AS memory_reuse_count, (SELECT round(coalesce(avg(risk_score), 0.0), 2) FROM translations) AS average_risk,
  (SELECT count(*) FROM memory_entries WHERE is_active) AS active_memory, (SELECT count(*) FROM review_events WHERE event_type IN ('edit', 'edit_and_approve')) AS corrections,
  (SELECT count(*) FROM glossary_terms) AS total_glossary_terms, (SELECT string_agg(provider_name || '=' || n, ',' ORDER BY provider_name) FROM (SELECT provider_name, count(*) AS n FROM translations GROUP BY 1)) AS providers""")
def analytics_summary(spark: SparkSession, d: str) -> DataFrame:
    one = metrics.analytics_summary(*(table(spark, d, t) for t in ("document_summary", "segments", "translations", "memory_entries", "review_events", "glossary_terms")))
    by = F.array_sort(F.transform(F.map_entries("provider_breakdown"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return one.withColumn("providers", F.array_join(by, ",")).drop("provider_breakdown")


@query("SELECT provider_name, count(*) AS n, round(avg(risk_score), 4) AS average_risk FROM translations GROUP BY provider_name")
def provider_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return metrics.provider_breakdown(table(spark, d, "translations"))


@query(f"SELECT segment_id, string_agg(event_type, '>' ORDER BY created_at, id) AS events, count(*) AS n FROM {ONCE} GROUP BY segment_id")
def events_by_segment(spark: SparkSession, d: str) -> DataFrame:
    return metrics.events_by_segment(table(spark, d, "review_events"))


@query("""SELECT segment_id, before_text AS baseline FROM review_events WHERE event_type IN ('edit', 'edit_and_approve') AND coalesce(before_text, '') <> ''
QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY created_at, id) = 1""")
def first_edit_baseline(spark: SparkSession, d: str) -> DataFrame:
    return metrics.first_baseline(table(spark, d, "review_events"))


@query("SELECT id, lag(source_text) OVER (PARTITION BY document_id ORDER BY sequence, id) AS previous_text FROM segments")
def previous_segment(spark: SparkSession, d: str) -> DataFrame:
    return metrics.previous_text(table(spark, d, "segments").select("id", "document_id", "sequence", "source_text")).select("id", "previous_text")


@query("""WITH n AS (SELECT id, row_number() OVER (PARTITION BY document_id ORDER BY sequence, id) AS n FROM segments)
SELECT id, CASE WHEN n <= 8 THEN 0 ELSE ((n - 9) // 25 + 1)::INTEGER END AS chunk FROM n""")
def chunk_assignment(spark: SparkSession, d: str) -> DataFrame:
    return metrics.chunks(table(spark, d, "segments").select("id", "document_id", "sequence"), 25, 8)


@query("""WITH last AS (SELECT translation_id, max(created_at) AS touched FROM review_events GROUP BY 1)
SELECT memory_entry_id, count(*) AS n_used, epoch_us(max(touched)) AS last_used_us FROM translations LEFT JOIN last ON translation_id = id WHERE memory_entry_id IS NOT NULL GROUP BY 1""")
def memory_usage(spark: SparkSession, d: str) -> DataFrame:
    used = metrics.usage(table(spark, d, "translations"), table(spark, d, "review_events"))
    return used.select("memory_entry_id", "n_used", F.unix_micros(F.col("last_used").cast("timestamp")).alias("last_used_us"))


@query(f"SELECT segment_id, {EFFECTIVE} AS effective_text FROM translations")
def effective_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "translations").select("segment_id", T.effective_text(F.col("approved_text"), F.col("candidate_text")).alias("effective_text"))


@query("""SELECT id, translate(source_text, '0123456789', '०१२३४५६७८९') AS native, translate(source_text, '०१२३४५६७८९', '0123456789') AS ascii FROM segments""")
def digit_forms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "segments").select("id", T.to_native_digits(F.col("source_text")).alias("native"), T.to_ascii_digits(F.col("source_text")).alias("ascii"))


@query(f"SELECT * FROM (SELECT id, normalized_source, lower({oracle.shown('source_text')}) AS normalized_now FROM segments) WHERE normalized_source IS DISTINCT FROM normalized_now")
def normalized_text(spark: SparkSession, d: str) -> DataFrame:
    """Segments whose stored normal form is stale."""
    now = table(spark, d, "segments").select("id", "normalized_source", "source_text").select("id", "normalized_source", T.normalize_text("source_text").alias("normalized_now"))
    return now.where(~F.col("normalized_source").eqNullSafe(F.col("normalized_now")))


@query(f"SELECT * FROM (SELECT id, {STRUCTURAL} AS label FROM segments) WHERE label IS NOT NULL")
def structural_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "segments").select("id", T.structural_label(F.col("source_text")).alias("label")).where("label IS NOT NULL")


@query(f"""WITH {SCOPED}, x AS (SELECT *, regexp_replace(source_text, 'https?://[^\\s,;]+', ' ', 'gi') AS raw, lower({oracle.shown("regexp_replace(source_text, 'https?://[^\\s,;]+', ' ', 'gi')")}) AS plain FROM scoped)
SELECT DISTINCT x.id, g.source_term, g.target_term, g.term_type FROM x JOIN glossary_terms g ON g.source_lang = x.source_lang AND g.target_lang = x.target_lang AND g.domain = x.domain
  AND g.subdomain IN (x.subdomain, '__none__') AND CASE WHEN g.case_sensitive THEN contains(x.raw, g.source_term) ELSE contains(x.plain, g.normalized_source_term) END""")
def glossary_hits(spark: SparkSession, d: str) -> DataFrame:
    return joins.glossary_hits(_scoped(spark, d), table(spark, d, "glossary_terms"))


@query(f"""WITH {SCOPED}, {CURRENT}, {ACTIVE} SELECT s.id, a.id AS memory_id, a.target_text AS memory_text FROM current s JOIN active a
  ON s.source_lang = a.source_lang AND s.target_lang = a.target_lang AND s.domain = a.domain AND s.subdomain = a.subdomain AND s.normalized_source = a.normalized_source""")
def memory_lookup(spark: SparkSession, d: str) -> DataFrame:
    return joins.memory_lookup(_current(spark, d), table(spark, d, "memory_entries")).select("id", "memory_id", "memory_text")


@query(f"""WITH {SCOPED}, {CURRENT}, {ACTIVE}, s AS (SELECT *, {STRUCTURAL} AS label FROM current)
SELECT id FROM s WHERE label IS NULL AND NOT EXISTS (SELECT 1 FROM active a WHERE s.source_lang = a.source_lang AND s.target_lang = a.target_lang AND s.domain = a.domain AND s.subdomain = a.subdomain AND s.normalized_source = a.normalized_source)""")
def provider_work_list(spark: SparkSession, d: str) -> DataFrame:
    return joins.work_list(_current(spark, d), table(spark, d, "memory_entries")).select("id")


@query("""SELECT document_id, source_text, count(*) AS n, count(*) FILTER (status <> 'approved') AS n_open FROM segments GROUP BY 1, 2 HAVING count(*) > 1 AND count(*) FILTER (status <> 'approved') > 0""")
def identical_open_segments(spark: SparkSession, d: str) -> DataFrame:
    return joins.identical_open(table(spark, d, "segments"))


@query("""SELECT * FROM (SELECT id, first(id) OVER (PARTITION BY checksum, source_lang, target_lang, domain, subdomain ORDER BY created_at, id) AS first_id FROM document_summary WHERE status <> 'failed') WHERE id <> first_id""")
def duplicate_uploads(spark: SparkSession, d: str) -> DataFrame:
    return joins.duplicate_uploads(table(spark, d, "document_summary"))


@query("""WITH r AS (SELECT segment_id, count(*) AS n, count(*) FILTER (trim(coalesce(translated_text, '')) = '') AS n_blank FROM translation_results GROUP BY 1),
x AS (SELECT coalesce(s.id, r.segment_id) AS segment_id, CASE WHEN r.n IS NULL THEN 'missing' WHEN s.id IS NULL THEN 'extra' WHEN r.n > 1 THEN 'duplicate' WHEN r.n_blank > 0 THEN 'blank' END AS problem FROM segments s FULL JOIN r ON r.segment_id = s.id)
SELECT * FROM x WHERE problem IS NOT NULL""")
def contract_check(spark: SparkSession, d: str) -> DataFrame:
    return joins.contract_check(table(spark, d, "segments"), table(spark, d, "translation_results"))


@query("""SELECT t.created_from_document_id, t.memory_entry_id, t.id, t.approved_by, t.times_used, d.original_filename
FROM (SELECT t.id, t.memory_entry_id, m.created_from_document_id, m.approved_by, m.times_used FROM translations t LEFT JOIN memory_entries m ON m.id = t.memory_entry_id) t LEFT JOIN document_summary d ON d.id = t.created_from_document_id""")
def provenance_chain(spark: SparkSession, d: str) -> DataFrame:
    return joins.provenance(table(spark, d, "translations"), table(spark, d, "memory_entries"), table(spark, d, "document_summary"))


@query(f"""WITH l AS (SELECT *, count(*) OVER (PARTITION BY segment_id) AS n_events FROM {ONCE} QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY created_at DESC, id DESC) = 1)
SELECT segment_id, CASE WHEN event_type IN ('approve', 'edit_and_approve') THEN 'approved' ELSE 'needs_review' END AS status, CASE WHEN event_type IN ('approve', 'edit_and_approve') THEN after_text END AS approved_text,
  after_text AS candidate_text, actor, n_events FROM l""")
def review_state(spark: SparkSession, d: str) -> DataFrame:
    return review.state(table(spark, d, "review_events"))


def _approvals(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "review_events").dropDuplicates(["id"]).where(F.col("event_type").isin("approve", "edit_and_approve") & F.col("after_text").isNotNull())
    s = _scoped(spark, d).select(F.col("id").alias("segment_id"), "document_id", *SCOPE, "source_text")
    return e.drop("document_id").join(s, "segment_id").select(*SCOPE, "source_text", F.col("after_text").alias("target_text"), F.col("actor").alias("approved_by"), F.col("created_at").alias("approved_at"), "document_id", "segment_id", F.col("id").alias("event_id"))


@query(f"""WITH {SCOPED}, a AS (SELECT s.source_lang, s.target_lang, s.domain, s.subdomain, lower({oracle.shown('s.source_text')}) AS normalized_source, s.document_id, s.id AS segment_id, e.id AS event_id, e.after_text AS target_text, e.actor, e.created_at AS approved_at
  FROM {ONCE} e JOIN scoped s ON s.id = e.segment_id WHERE event_type IN ('approve', 'edit_and_approve') AND after_text IS NOT NULL),
n AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY source_lang, target_lang, domain, subdomain, normalized_source ORDER BY approved_at DESC, event_id DESC) = 1),
o AS (SELECT * FROM memory_entries WHERE is_active QUALIFY row_number() OVER (PARTITION BY source_lang, target_lang, domain, subdomain, normalized_source ORDER BY approved_at DESC, id DESC) = 1)
SELECT coalesce(n.normalized_source, o.normalized_source) AS normalized_source, coalesce(n.source_lang, o.source_lang) AS source_lang, coalesce(n.target_lang, o.target_lang) AS target_lang, coalesce(n.subdomain, o.subdomain) AS subdomain, coalesce(n.target_text, o.target_text) AS target_text,
  CASE WHEN n.event_id IS NULL THEN o.approved_by ELSE n.actor END AS approved_by, CASE WHEN n.event_id IS NULL THEN o.created_from_document_id ELSE n.document_id END AS created_from_document_id,
  CASE WHEN n.event_id IS NULL THEN o.created_from_segment_id ELSE n.segment_id END AS created_from_segment_id, CASE WHEN n.event_id IS NULL THEN o.created_from_review_event_id ELSE n.event_id END AS created_from_review_event_id,
  coalesce(o.times_used, 0)::INTEGER AS times_used, CASE WHEN o.id IS NULL THEN 'inserted' WHEN n.event_id IS NULL THEN 'kept' ELSE 'updated' END AS change
FROM o FULL JOIN n ON o.source_lang IS NOT DISTINCT FROM n.source_lang AND o.target_lang IS NOT DISTINCT FROM n.target_lang AND o.domain IS NOT DISTINCT FROM n.domain AND o.subdomain IS NOT DISTINCT FROM n.subdomain AND o.normalized_source = n.normalized_source""")
def memory_upsert(spark: SparkSession, d: str) -> DataFrame:
    return review.upsert_memory(table(spark, d, "memory_entries"), _approvals(spark, d)).select(
        "normalized_source", "source_lang", "target_lang", "subdomain", "target_text", "approved_by", "created_from_document_id", "created_from_segment_id", "created_from_review_event_id", "times_used", "change"
    )


@query("""SELECT id, document_id FROM segments s WHERE status <> 'approved' AND EXISTS (SELECT 1 FROM translations t WHERE t.segment_id = s.id AND risk_score = 0)""")
def approve_unflagged(spark: SparkSession, d: str) -> DataFrame:
    return review.unflagged(table(spark, d, "segments"), table(spark, d, "translations"))


@query(f"""SELECT s.id, document_id, sequence FROM segments s LEFT JOIN (SELECT *, {EFFECTIVE} AS effective FROM translations) t ON t.segment_id = s.id
WHERE risk_score > 0 AND (contains(lower(source_text), 'ward') OR contains(lower(coalesce(effective, '')), 'ward'))""")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    return review.queue(table(spark, d, "segments"), table(spark, d, "translations"), "Ward", "flagged")


@query(f"""SELECT document_id, greatest(0, total - approved) AS remaining, total > 0 AND approved = total AS all_approved, round(protected_preserved / nullif(protected_total, 0), 6) AS preserved_share FROM ({oracle.PRESERVED})""")
def remaining_approvals(spark: SparkSession, d: str) -> DataFrame:
    return metrics.remaining(metrics.trust_summary(table(spark, d, "segments"), table(spark, d, "translations")))


@query("""SELECT id, array_to_string(list_sort(list_distinct(list_transform(protected_entities, lambda e: e.kind))), ', ') AS kinds, len(glossary_hits) AS n_hits FROM segments WHERE len(protected_entities) > 0""")
def entity_kinds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "segments").where(F.size("protected_entities") > 0).select("id", E.kinds(F.col("protected_entities")).alias("kinds"), F.size("glossary_hits").cast("long").alias("n_hits"))


@query(oracle.detected())
def entities_detected(spark: SparkSession, d: str) -> DataFrame:
    found = spread(table(spark, d, "segments").select("id", "source_text")).select("id", F.explode(E.detect_entities("source_text")).alias("e"))
    return found.select("id", "e.kind", "e.text", "e.start", F.col("e.end").alias("stop"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Segments beside their candidates and the target language of their document."""
    t = spread(table(spark, d, "translations").select(F.col("segment_id").alias("id"), "candidate_text"))
    langs = table(spark, d, "document_summary").select(F.col("id").alias("document_id"), "target_lang")
    return spread(table(spark, d, "segments").select("id", "document_id", "source_text", "protected_entities", "glossary_hits")).join(t, "id").join(langs, "document_id", "left")


def _counted(spark: SparkSession, d: str, only: dict[str, str]) -> DataFrame:
    """(id, code, n): how often each of these rules fires for each pair."""
    rows = R.counted(_pairs(spark, d), "source_text", "candidate_text", F.coalesce("target_lang", F.lit("en")), "protected_entities", "glossary_hits", set(only))
    # An inner explode would put a filter on the codes below their projections, and compute them twice.
    return rows.select("id", F.explode_outer("codes").alias("c")).where("c IS NOT NULL").select("id", "c.code", "c.n")


@query(oracle.counts(oracle.STRUCTURE))
def rules_structure(spark: SparkSession, d: str) -> DataFrame:
    return _counted(spark, d, oracle.STRUCTURE)


@query(oracle.counts(oracle.NUMBERS))
def rules_numbers(spark: SparkSession, d: str) -> DataFrame:
    return _counted(spark, d, oracle.NUMBERS)


@query(oracle.counts(oracle.LEXICON))
def rules_lexicon(spark: SparkSession, d: str) -> DataFrame:
    return _counted(spark, d, oracle.LEXICON)


@query(oracle.counts(oracle.ENTITIES))
def rules_entities(spark: SparkSession, d: str) -> DataFrame:
    return _counted(spark, d, oracle.ENTITIES)


@query(oracle.SCORED)
def risk_scored(spark: SparkSession, d: str) -> DataFrame:
    """The score of every pair, by the rules of its document's target language."""
    return _scored(spark, d).select("id", "risk_score")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return R.score(_pairs(spark, d), "source_text", "candidate_text", "protected_entities", "glossary_hits", F.coalesce("target_lang", F.lit("en")))


@query()
def risk_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Every reason of every pair, in order."""
    return _scored(spark, d).select("id", F.posexplode_outer("risk_reasons").alias("place", "r")).where("place IS NOT NULL").select("id", "place", "r.*")


@query(oracle.HOUSE_STYLE)
def house_style(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that the house style changes."""
    lang = _scoped(spark, d).select("id", "source_text", "target_lang")
    t = table(spark, d, "translations").select(F.col("segment_id").alias("id"), T.strip_chatter(F.col("candidate_text")).alias("text"))
    return lang.join(t, "id").select("id", "text", T.house_style(F.col("source_text"), F.col("text"), F.col("target_lang")).alias("styled")).where("text <> styled")


def _pack(spark: SparkSession, d: str, only_ready: bool = True) -> DataFrame:
    return feedback.rows(*(spread(table(spark, d, t)) for t in ("document_summary", "segments", "translations", "review_events")), only_ready)


@query(f"""SELECT document_id FROM segments s LEFT JOIN translations t ON t.segment_id = s.id GROUP BY 1
HAVING bool_and(s.status = 'approved' AND coalesce({oracle.strip("coalesce(approved_text, '')")}, '') <> '')""")
def feedback_ready(spark: SparkSession, d: str) -> DataFrame:
    """Documents that a pack may leave."""
    return feedback.ready(table(spark, d, "segments"), table(spark, d, "translations"))


@query()
def feedback_rows(spark: SparkSession, d: str) -> DataFrame:
    return feedback.approved_rows(_pack(spark, d))


@query()
def feedback_corrections(spark: SparkSession, d: str) -> DataFrame:
    return feedback.corrections(_pack(spark, d))


@query()
def feedback_manifest(spark: SparkSession, d: str) -> DataFrame:
    return feedback.manifest(_pack(spark, d))


@query()
def feedback_preview(spark: SparkSession, d: str) -> DataFrame:
    """What the packs could share today of documents that still have open segments."""
    return feedback.approved_rows(_pack(spark, d, only_ready=False))


@query(f"""WITH b AS (SELECT segment_id, arg_min(before_text, {{'c': created_at, 'i': id}}) AS baseline FROM review_events WHERE event_type IN ('edit', 'edit_and_approve') AND coalesce(before_text, '') <> '' GROUP BY 1),
a AS (SELECT segment_id, bool_or(event_type IN ('edit', 'edit_and_approve')) AS edited FROM review_events GROUP BY 1),
x AS (SELECT s.document_id, t.status = 'memory_applied' AS reused, coalesce(a.edited, false) AND {oracle.strip(f"coalesce(nullif(b.baseline, ''), {EFFECTIVE})")} <> {EFFECTIVE} AS corrected
  FROM segments s JOIN translations t ON t.segment_id = s.id LEFT JOIN b ON b.segment_id = s.id LEFT JOIN a ON a.segment_id = s.id WHERE s.status = 'approved')
SELECT d.id AS document_id, d.original_filename, count(*) AS total_segments, count(*) AS approved_segments, count(*) FILTER (reused) AS memory_reused_segments, count(*) FILTER (corrected) AS corrected_segments, count(*) AS all_rows, 'protected_entity_placeholders_v1' AS redaction_mode
FROM x JOIN document_summary d ON d.id = x.document_id GROUP BY 1, 2""")
def feedback_preview_manifest(spark: SparkSession, d: str) -> DataFrame:
    m = feedback.manifest(_pack(spark, d, only_ready=False))
    return m.select("document_id", "original_filename", "total_segments", "approved_segments", "memory_reused_segments", "corrected_segments", (F.col("included_rows") + F.col("excluded_rows")).alias("all_rows"), "redaction_mode")


@query("""WITH w AS (SELECT DISTINCT sample_id, lang, unnest(regexp_extract_all(lower(text), '[A-Za-z]+|[ऀ-ॿ]+')) AS token FROM lang_samples), n AS (SELECT token, lang, count(*) AS n FROM w GROUP BY 1, 2),
b AS (SELECT token, sum(n) AS total, max(n) AS most, arg_max(lang, (n, lang)) AS lang FROM n GROUP BY 1)
SELECT lang, token, round(3.5 * most / total, 2) AS weight FROM b WHERE total >= 5 AND most / total >= 0.8""")
def language_weights(spark: SparkSession, d: str) -> DataFrame:
    return language.weights_from(table(spark, d, "lang_samples"))


@query(oracle.language(values.TOKEN_WEIGHTS, values.SHARED_TOKENS))
def language_suggestion(spark: SparkSession, d: str) -> DataFrame:
    return language.suggest(table(spark, d, "segments").select("id", "document_id", "sequence", "source_text"), language.weights(spark)).drop("explanation")


@query()
def language_explained(spark: SparkSession, d: str) -> DataFrame:
    """The suggestion by words learned from the labelled samples, with its explanation."""
    return language.suggest(table(spark, d, "segments").select("id", "document_id", "sequence", "source_text"), language.weights_from(table(spark, d, "lang_samples")))


@query(rf"""WITH b AS (SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n{SPACE}*\n+'), lambda x: trim(regexp_replace(x, '{SPACE}+', ' ', 'g'))), lambda x: x <> '')) AS source_text,
  generate_subscripts(list_filter(list_transform(string_split_regex(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n{SPACE}*\n+'), lambda x: trim(regexp_replace(x, '{SPACE}+', ' ', 'g'))), lambda x: x <> ''), 1)::INTEGER AS sequence FROM documents)
SELECT doc_id, sequence, source_text FROM b""")
def text_blocks(spark: SparkSession, d: str) -> DataFrame:
    return segmenters.segment_texts(table(spark, d, "documents"), "doc_id")


@query(rf"""WITH b AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '{SPACE}+', ' ', 'g'))), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, unnest(l) AS source_text, generate_subscripts(l, 1)::INTEGER AS sequence FROM b""")
def text_lines(spark: SparkSession, d: str) -> DataFrame:
    return segmenters.segment_lines(table(spark, d, "documents"), "doc_id")


@query(f"""SELECT document_id, part, string_agg(e, chr(10) || chr(10) ORDER BY n) AS value FROM (SELECT document_id, {EFFECTIVE} AS e, n, ((n - 1) // 10000)::INTEGER AS part
  FROM (SELECT s.document_id, t.*, row_number() OVER (PARTITION BY document_id ORDER BY sequence, s.id) AS n FROM segments s JOIN translations t ON t.segment_id = s.id)) GROUP BY 1, 2""")
def export_text(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "translations").select(F.col("segment_id").alias("id"), T.effective_text(F.col("approved_text"), F.col("candidate_text")).alias("text"))
    return sinks.as_text(table(spark, d, "segments").select("id", "document_id", "sequence").join(t, "id"))


@query("""SELECT document_id, count(*) AS n_open FROM segments s LEFT JOIN translations t ON t.segment_id = s.id
WHERE s.status <> 'approved' OR coalesce(trim(approved_text), '') = '' GROUP BY 1""")
def export_guard(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "translations").select(F.col("segment_id").alias("id"), F.col("approved_text").alias("text"))
    return sinks.not_ready(table(spark, d, "segments").select("id", "document_id", "status").join(t, "id", "left"))


@query("""SELECT id, CASE WHEN file_type IN ('csv', 'tsv') THEN file_type || ',docx,pdf,txt' WHEN file_type = 'pdf' THEN 'pdf,docx,txt' ELSE 'docx,pdf,txt' END AS formats FROM document_summary""")
def export_formats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "document_summary").select("id", F.array_join(sinks.export_formats(F.col("file_type")), ",").alias("formats"))


@query("""WITH g AS (SELECT event_id, user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS start FROM events)
SELECT event_id, sum(start) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g""")
def gap_sessions(spark: SparkSession, d: str) -> DataFrame:
    return regions.sessions(table(spark, d, "events"), "user_id", "ts", F.expr("INTERVAL 1 HOUR"), "event_id").select("event_id", F.col("session").cast("long").alias("session"))


@query("SELECT event_type, count(*) AS n FROM review_events GROUP BY 1")
def stream_progress(spark: SparkSession, d: str) -> DataFrame:
    """Counts of a stream over the table, equal to those of the table."""
    return progress.run_once(progress.counts(progress.event_stream(spark, f"{d}/review_events.parquet")))


@query("""SELECT source_lang, target_lang, domain, count(*) AS n_terms, count(*) FILTER (case_sensitive) AS n_case_sensitive, count(DISTINCT normalized_source_term) AS n_distinct FROM glossary_terms GROUP BY 1, 2, 3""")
def glossary_scopes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "glossary_terms").groupBy("source_lang", "target_lang", "domain").agg(F.count(F.lit(1)).alias("n_terms"), F.count_if("case_sensitive").alias("n_case_sensitive"), F.countDistinct("normalized_source_term").alias("n_distinct"))


@query("""SELECT source_lang, target_lang, domain, subdomain, normalized_source, count(*) AS n FROM memory_entries WHERE is_active GROUP BY ALL HAVING count(*) > 1""")
def memory_key_violations(spark: SparkSession, d: str) -> DataFrame:
    """Keys of active memory that should be unique and aren't."""
    return table(spark, d, "memory_entries").where("is_active").groupBy(*SCOPE, "normalized_source").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(oracle.reviewed("candidate_text", """CASE WHEN ts = '' THEN NULL WHEN ts = raw THEN 'approve' ELSE 'edit_and_approve' END AS event_type, CASE WHEN ts <> '' THEN ts END AS after_text, CASE WHEN ts = '' THEN status ELSE 'approved' END AS status, CASE WHEN ts = '' THEN 'blank text' END AS error""", "s.status <> 'approved'"))
def approvals_rescored(spark: SparkSession, d: str) -> DataFrame:
    """What comes of approving every open segment with its candidate."""
    segments = table(spark, d, "segments")
    requests = segments.where("status <> 'approved'").select(F.col("id").alias("segment_id"), F.lit(None).cast("string").alias("text"), F.lit("reviewer").alias("actor"))
    return review.approve(segments, table(spark, d, "translations"), requests).select("segment_id", "risk_score", "event_type", "after_text", "status", "error")


@query(oracle.reviewed("after_text", """CASE WHEN ts <> '' THEN 'edit' END AS event_type, CASE WHEN ts <> '' THEN ts END AS after_text, CASE WHEN ts = '' THEN status WHEN status = 'approved' OR score > 0 THEN 'needs_review' ELSE 'pending' END AS status, status = 'approved' AND ts <> '' AS approval_cleared""", "true", """JOIN (SELECT segment_id, arg_max(after_text, {'c': created_at, 'i': id}) AS after_text FROM review_events WHERE event_type = 'edit' GROUP BY 1) ev ON ev.segment_id = s.id"""))
def edits_rescored(spark: SparkSession, d: str) -> DataFrame:
    """What comes of changing each edited segment's candidate to the text of its last edit."""
    last = table(spark, d, "review_events").where("event_type = 'edit'").groupBy("segment_id").agg(F.max_by("after_text", F.struct("created_at", "id")).alias("text")).withColumn("actor", F.lit("reviewer"))
    return review.edit(table(spark, d, "segments"), table(spark, d, "translations"), last).select("segment_id", "risk_score", "event_type", "after_text", "status", "approval_cleared")


@query("""WITH g AS (SELECT document_id, source_text, arg_max(approved_text, s.id) AS text FROM segments s JOIN translations t ON t.segment_id = s.id WHERE s.status = 'approved' AND approved_text IS NOT NULL GROUP BY 1, 2)
SELECT s.id, s.document_id, g.text FROM segments s JOIN g ON g.document_id = s.document_id AND g.source_text = s.source_text WHERE s.status <> 'approved'""")
def propagated_approvals(spark: SparkSession, d: str) -> DataFrame:
    """Open segments that identical approved ones of their document settle."""
    segments = table(spark, d, "segments")
    t = table(spark, d, "translations").where("approved_text IS NOT NULL").select("segment_id", F.col("approved_text").alias("text"))
    approved = segments.where("status = 'approved'").select(F.col("id").alias("segment_id")).join(t, "segment_id")
    return review.propagate(segments, approved)


@query("""SELECT id, is_active AND (NOT is_active OR row_number() OVER (PARTITION BY is_active, source_lang, target_lang, domain, subdomain, normalized_source ORDER BY approved_at DESC, id DESC) = 1) AS is_active FROM memory_entries""")
def memory_deactivated(spark: SparkSession, d: str) -> DataFrame:
    """Memory after all active entries of a key but the latest are given up."""
    memory = table(spark, d, "memory_entries")
    best = review.latest(memory.where("is_active"), [*SCOPE, "normalized_source"], "approved_at", "id").select("id")
    return review.deactivate(memory, memory.where("is_active").join(best, "id", "left_anti")).select("id", "is_active")


@query(f"""WITH n AS (SELECT *, lower({oracle.shown('target_term')}) AS key, row_number() OVER (PARTITION BY target_lang, source_lang, domain, coalesce(nullif(trim(subdomain), ''), '__none__'), lower({oracle.shown('target_term')}) ORDER BY source_term) AS k FROM glossary_terms)
SELECT n.id, n.key AS normalized_source_term, k = 1 AND NOT EXISTS (SELECT 1 FROM glossary_terms g WHERE g.source_lang = n.target_lang AND g.target_lang = n.source_lang AND g.domain = n.domain AND g.subdomain = coalesce(nullif(trim(n.subdomain), ''), '__none__') AND g.normalized_source_term = n.key) AS added FROM n""")
def glossary_added(spark: SparkSession, d: str) -> DataFrame:
    """The glossary turned round, added to itself."""
    terms = table(spark, d, "glossary_terms")
    turned = terms.select("id", F.col("target_lang").alias("source_lang"), F.col("source_lang").alias("target_lang"), "domain", "subdomain", F.col("target_term").alias("source_term"), F.col("source_term").alias("target_term"))
    return review.add_terms(terms, turned).select("id", "normalized_source_term", "added")


@query(f"""SELECT id, source_lang, target_lang, normalized_source_term FROM glossary_terms WHERE term_type <> 'office'""")
def glossary_removed(spark: SparkSession, d: str) -> DataFrame:
    terms = table(spark, d, "glossary_terms")
    return review.remove_terms(terms, terms.where("term_type = 'office'")).select("id", "source_lang", "target_lang", "normalized_source_term")


@query("SELECT * FROM (VALUES ('Ward Office', 'ward office', '__none__', 'office'), ('Municipality', 'municipality', '__none__', 'office'), ('Rural Municipality', 'rural municipality', '__none__', 'office'), ('District Administration Office', 'district administration office', '__none__', 'office'), ('Public Service Commission', 'public service commission', '__none__', 'office'), ('Certificate of Residence', 'certificate of residence', 'residence', 'term')) v(source_term, normalized_source_term, subdomain, term_type)")
def glossary_default(spark: SparkSession, d: str) -> DataFrame:
    """A glossary that was emptied begins anew."""
    return joins.seeded(review.reset({"glossary_terms": table(spark, d, "glossary_terms")})["glossary_terms"].limit(0)).select("source_term", "normalized_source_term", "subdomain", "term_type")


@query("""SELECT m.id, d.original_filename AS source_filename, CASE WHEN coalesce(d.original_filename, '') <> '' THEN 'Reused from ' || d.original_filename ELSE 'Reused from approved memory' END || ' · ' || array_to_string(list_filter([
  array_to_string(list_transform(string_split(replace(m.domain, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' '), array_to_string(list_transform(string_split(replace(nullif(nullif(m.subdomain, '__none__'), ''), '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')], lambda x: x IS NOT NULL), ' / ')
  || ' · approved ' || strftime(approved_at, '%b %-d') || ' · ' || times_used || CASE WHEN times_used = 1 THEN ' use' ELSE ' uses' END AS provenance
FROM memory_entries m LEFT JOIN document_summary d ON d.id = m.created_from_document_id WHERE is_active""")
def memory_list(spark: SparkSession, d: str) -> DataFrame:
    """Active memory, the latest approval first, with its provenance."""
    return joins.memory_list(table(spark, d, "memory_entries"), table(spark, d, "document_summary")).select("id", "source_filename", "provenance")


@query("""WITH o AS (SELECT * FROM document_summary WHERE file_type = 'docx'), n AS (SELECT checksum, source_lang, target_lang, domain, subdomain, min(id) AS id FROM document_summary WHERE file_type <> 'docx' GROUP BY ALL)
SELECT id, checksum FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE status <> 'failed' AND o.checksum IS NOT DISTINCT FROM n.checksum AND o.source_lang IS NOT DISTINCT FROM n.source_lang AND o.target_lang IS NOT DISTINCT FROM n.target_lang AND o.domain IS NOT DISTINCT FROM n.domain AND o.subdomain IS NOT DISTINCT FROM n.subdomain)""")
def documents_inserted(spark: SparkSession, d: str) -> DataFrame:
    """Documents of other types inserted beside those of one."""
    docs = table(spark, d, "document_summary")
    return joins.insert_documents(docs.where("file_type = 'docx'"), docs.where("file_type <> 'docx'")).select("id", "checksum")


@query("""SELECT document_id, sequence, id FROM segments s WHERE NOT EXISTS (SELECT 1 FROM segments p JOIN translations t ON t.segment_id = p.id WHERE p.document_id = s.document_id AND p.sequence = s.sequence)""")
def unprepared_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments whose place has no translation yet."""
    segments = table(spark, d, "segments").select("document_id", "sequence", "id")
    return joins.unprepared(segments, segments.join(table(spark, d, "translations").select(F.col("segment_id").alias("id")), "id", "left_semi"))


@query(oracle.DETERMINISTIC)
def deterministic_answers(spark: SparkSession, d: str) -> DataFrame:
    """What the provider without a connection says of every segment."""
    work = _scoped(spark, d).select("id", "source_text", "source_lang", "target_lang")
    return providers.deterministic(work).select("id", "translated_text", "how")


@query("""SELECT s.id AS segment_id, r.translated_text, r.provider_tier, CASE WHEN r.segment_id IS NULL THEN 'no answer' ELSE r.error END AS error FROM segments s LEFT JOIN
  (SELECT * FROM translation_results QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY error IS NOT NULL, translated_text NULLS FIRST, provider_tier NULLS FIRST, error NULLS FIRST) = 1) r ON r.segment_id = s.id""")
def answers_filled(spark: SparkSession, d: str) -> DataFrame:
    """Every segment with its first good answer, in the order of the documents."""
    segments = table(spark, d, "segments").select(F.col("id").alias("segment_id"), "document_id", "sequence")
    return providers.in_order(providers.filled(segments, table(spark, d, "translation_results")), segments).drop("document_id", "sequence")


@query(oracle.settled_here(STRUCTURAL, SCOPED))
def process_local(spark: SparkSession, d: str) -> DataFrame:
    """Segments that need no provider: text, tier, score and state."""
    found = pipeline.matched(table(spark, d, "segments"), table(spark, d, "document_summary"), None, table(spark, d, "memory_entries"))
    return pipeline.settled_here(found).select("id", "text", "source_type", "risk_score", "status", "translation_status", "is_repaired")


def _processed(spark: SparkSession, d: str, terms: DataFrame | None, translate, repair: bool = True) -> DataFrame:
    return pipeline.process(table(spark, d, "segments"), table(spark, d, "document_summary"), terms, table(spark, d, "memory_entries"), translate, repair)


@query(oracle.process_plain(STRUCTURAL, SCOPED))
def process_plain(spark: SparkSession, d: str) -> DataFrame:
    """Every segment prepared with the provider that needs no connection, with the entities and hits that it brings, without a repair: that provider has no better second answer."""
    done = _processed(spark, d, None, pipeline.deterministic, repair=False)
    return done.select("id", "text", "source_type", "risk_score", "status", "translation_status", "is_repaired")


@query()
def process(spark: SparkSession, d: str) -> DataFrame:
    """Every segment prepared from the start: glossary, values, memory and the provider without a connection."""
    done = _processed(spark, d, table(spark, d, "glossary_terms"), pipeline.deterministic)
    return done.select("id", "text", "source_type", "provider_name", "risk_score", F.array_join("risk_reasons.code", ",").alias("codes"), "status", "translation_status", "is_repaired")


@query()
def process_recorded(spark: SparkSession, d: str) -> DataFrame:
    """Every segment prepared from the recorded answers, with the entities and hits that it brings."""
    done = _processed(spark, d, None, pipeline.recorded(table(spark, d, "translation_results")))
    return done.select("id", "text", "source_type", "provider_name", "risk_score", F.array_join("risk_reasons.code", ",").alias("codes"), "status", "translation_status", "is_repaired")


@query("""WITH o AS (SELECT document_id, count(*) AS n_open FROM segments s LEFT JOIN translations t ON t.segment_id = s.id WHERE s.status <> 'approved' OR coalesce(trim(approved_text), '') = '' GROUP BY 1)
SELECT id AS document_id, file_type IN ('csv') AS allowed, coalesce(n_open, 0) AS n_open, CASE WHEN file_type = 'csv' AND n_open IS NULL AND id IN (SELECT document_id FROM segments) THEN 'exported' ELSE 'export_failed' END AS status FROM document_summary LEFT JOIN o ON document_id = id""")
def export_status(spark: SparkSession, d: str) -> DataFrame:
    """Which documents can leave as CSV."""
    return sinks.export(table(spark, d, "document_summary"), table(spark, d, "segments"), table(spark, d, "translations"), "csv")


@query("""SELECT s.id, CASE s.segment_type WHEN 'paragraph' THEN 'Text segment' WHEN 'table_cell_paragraph' THEN 'Table segment' ELSE 'Segment' END AS segment_label, t.id AS translation_id, t.risk_score,
  CASE t.source_type WHEN 'memory' THEN 'From scoped translation memory' WHEN 'preserved' THEN 'Preserved exactly' WHEN 'provider' THEN 'From ' || array_to_string(list_transform(string_split(replace(t.provider_name, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' provider' END AS source_label,
  d.original_filename AS source_document_filename, m.times_used FROM segments s LEFT JOIN translations t ON t.segment_id = s.id LEFT JOIN memory_entries m ON m.id = t.memory_entry_id LEFT JOIN document_summary d ON d.id = m.created_from_document_id""")
def segment_views(spark: SparkSession, d: str) -> DataFrame:
    """Segments as a client reads them, some fields of the nested rows."""
    v = views.segments(table(spark, d, "segments"), table(spark, d, "translations"), table(spark, d, "memory_entries"), table(spark, d, "document_summary"))
    return v.select("id", "segment_label", F.col("translation.id").alias("translation_id"), "translation.risk_score", "source_label", "translation.memory_provenance.source_document_filename", "translation.memory_provenance.times_used")


@query(f"""SELECT d.id, CASE d.source_lang WHEN 'en' THEN 'English' WHEN 'ne' THEN 'Nepali' WHEN 'tmg' THEN 'Tamang' ELSE d.source_lang END AS language, nullif(nullif(d.subdomain, '__none__'), '') AS subdomain, coalesce(c.segments, 0) AS segments, coalesce(c.needs_review, 0) AS needs_review, coalesce(p.protected_preserved, 0) AS protected_preserved, coalesce(p.unresolved, 0) AS unresolved
FROM document_summary d LEFT JOIN (SELECT document_id, count(*) AS segments, count(*) FILTER (status = 'needs_review') AS needs_review FROM segments GROUP BY 1) c ON c.document_id = d.id LEFT JOIN ({oracle.PRESERVED}) p ON p.document_id = d.id""")
def document_views(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a client reads them, some fields of the nested rows."""
    v = views.documents(table(spark, d, "document_summary"), table(spark, d, "segments"), table(spark, d, "translations"))
    return v.select("id", views.language_label(F.col("source_lang")).alias("language"), "subdomain", "counts.segments", "counts.needs_review", "trust_summary.protected_preserved", "trust_summary.unresolved")


@query()
def document_json(spark: SparkSession, d: str) -> DataFrame:
    return views.as_json(views.documents(table(spark, d, "document_summary"), table(spark, d, "segments"), table(spark, d, "translations")))


_STAGED = """WITH c AS (SELECT document_id, count(*) AS total, count(*) FILTER (s.status IN ('approved', 'needs_review')) + count(*) FILTER (t.status = 'memory_applied') AS done FROM segments s LEFT JOIN translations t ON t.segment_id = s.id GROUP BY 1),
x AS (SELECT id, status AS st, coalesce(total, 0) AS total, coalesce(done, 0) AS done FROM document_summary LEFT JOIN c ON document_id = id),
y AS (SELECT *, CASE WHEN st = 'failed' THEN 'failed' WHEN st = 'processed' THEN 'processed' WHEN st = 'uploaded' OR total = 0 OR done < total OR st = 'processing' THEN 'processing' ELSE st END AS status,
  CASE WHEN st = 'failed' THEN NULL WHEN st = 'processed' THEN 'ready' WHEN st = 'uploaded' OR total = 0 THEN 'parsing' WHEN done < total THEN 'translating' WHEN st = 'processing' THEN 'scoring' END AS step FROM x)
SELECT id, status, step, CASE WHEN step = 'translating' THEN done END AS progress, CASE WHEN step = 'translating' THEN total END AS total FROM y"""


@query(_STAGED)
def document_progress(spark: SparkSession, d: str) -> DataFrame:
    return progress.staged(table(spark, d, "document_summary"), progress.states(table(spark, d, "segments"), table(spark, d, "translations")))


@query(_STAGED)
def stream_document_progress(spark: SparkSession, d: str) -> DataFrame:
    """The same from a stream of segments."""
    states = progress.run_once(progress.states(progress.event_stream(spark, f"{d}/segments.parquet"), table(spark, d, "translations")))
    return progress.staged(table(spark, d, "document_summary"), states)


@query(oracle.TEXT_FUNCTIONS)
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("source_text")
    return table(spark, d, "segments").select(
        "id", T.display_normalize(c).alias("display"), T.normalize_text(c).alias("plain"), T.sanitize_unicode(c).alias("sanitised"), T.contains_devanagari(c).alias("native"), F.array_join(T.latin_tokens(c), " ").alias("latin"),
        F.array_join(F.array_sort(T.numbers(c)), " ").alias("numbers"), R.name_like(c).alias("name_like"), T.neighbours_equal(T.words(c)).alias("repeats"),
    )


@query(oracle.ENTITY_FORMS)
def entity_forms(spark: SparkSession, d: str) -> DataFrame:
    """The spellings in which each entity counts as kept."""
    s = table(spark, d, "segments")
    return s.select("id", F.posexplode(E.full(s, "protected_entities")).alias("place", "e")).select("id", "place", "e.kind", F.array_join(E.forms(F.col("e")), "|").alias("forms"))


@query(oracle.ENTITY_STATES)
def entity_states(spark: SparkSession, d: str) -> DataFrame:
    """Whether each candidate keeps each entity, in its place and script."""
    p = R.prepared(_pairs(spark, d), "source_text", "candidate_text", F.coalesce("target_lang", F.lit("en")), "protected_entities", "glossary_hits")
    return p.select("id", F.posexplode_outer("_state").alias("place", "x")).where("place IS NOT NULL").select("id", "place", "x.kept", "x.shifted", F.col("x.foreign").alias("foreign_script"))


def _page_lines(spark: SparkSession, d: str) -> DataFrame:
    at = ["page_index", "block_index", "line_index", "x0", "y0", "x1", "y1", "font_size"]
    return table(spark, d, "segments").where("location.kind = 'pdf_line'").select(F.col("document_id").alias("doc_id"), F.col("source_text").alias("text"), *(f"location.{c}" for c in at))


@query(oracle.PAGE_LINES)
def page_lines(spark: SparkSession, d: str) -> DataFrame:
    """Segments of page documents, which are short enough to keep their lines."""
    return regions.regions(_page_lines(spark, d)).select("doc_id", "region_id", "segment_type", "text", "line_count")


@query(oracle.PAGE_REGIONS)
def page_regions(spark: SparkSession, d: str) -> DataFrame:
    """Their regions, as those of a long document."""
    return regions.regions(_page_lines(spark, d), few=0).select("doc_id", "region_id", "segment_type", "text", "line_count", *(F.round(c, 4).alias(c) for c in ("x0", "y0", "x1", "y1")))


@query(oracle.TEXT_FILES)
def text_files(spark: SparkSession, d: str) -> DataFrame:
    """Segments of the documents as text files, by checksum."""
    files = spread(table(spark, d, "documents").where("text IS NOT NULL").select(F.lit("txt").alias("file_type"), F.encode("text", "UTF-8").alias("content"))).withColumn("checksum", F.sha2("content", 256))
    return segmenters.segment_files(files).select("doc_id", "sequence", "source_text")


def _effective(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "translations").select(F.col("segment_id").alias("id"), T.effective_text(F.col("approved_text"), F.col("candidate_text")).alias("text"))


@query(oracle.TABLE_FILES)
def table_files(spark: SparkSession, d: str) -> DataFrame:
    """Tables written with their translations and read again."""
    cells = table(spark, d, "segments").where("location.kind = 'cell'").select("id", "document_id", "location.row_index", "location.cell_index").join(_effective(spark, d), "id", "left")
    files = sinks.as_grid(cells).select(F.col("document_id").alias("checksum"), F.lit("csv").alias("file_type"), F.encode("value", "UTF-8").alias("content"))
    return segmenters.segment_files(files).select("doc_id", "sequence", "source_text", "location.row_index", "location.cell_index")


@query(oracle.DOCX_FILES)
def docx_files(spark: SparkSession, d: str) -> DataFrame:
    """Word documents made from segments, written back with the translations there are, and read again."""
    own = table(spark, d, "segments").where("location.kind = 'paragraph'").select("id", "document_id", "sequence", "source_text")
    n = metrics.numbered(own)
    files = sinks.as_docx(n.select("document_id", F.col("n").alias("sequence"), F.col("source_text").alias("text")))
    none = F.lit(None).cast("int")
    place = F.struct((F.col("n") - 1).cast("int").alias("paragraph_index"), none.alias("table_index"), none.alias("row_index"), none.alias("cell_index"))
    texts = n.join(_effective(spark, d), "id").where("text <> ''").select("document_id", place.alias("location"), "text")
    back = sinks.write_back_docx(files, texts).select(F.col("document_id").alias("checksum"), F.lit("docx").alias("file_type"), "content")
    return segmenters.segment_files(back).select("doc_id", "sequence", "source_text")


def _latin_only(texts, source, target):
    return [t.upper() if t and t.isascii() else None for t in texts]


def _short_only(texts, source, target):
    return [f"{target}: {t}" if t and len(t) < 60 else None for t in texts]


@query("""SELECT id AS segment_id, CASE WHEN regexp_matches(source_text, '^[\x00-\x7F]+$') AND trim(source_text) <> '' THEN upper(source_text) WHEN length(source_text) < 60 AND trim(source_text) <> '' THEN target_lang || ': ' || source_text ELSE source_text END AS translated_text,
  CASE WHEN regexp_matches(source_text, '^[\x00-\x7F]+$') THEN 'first' WHEN length(source_text) < 60 THEN 'second' ELSE 'echo' END AS provider_tier, NULL::VARCHAR AS error
FROM (SELECT s.id, s.source_text, d.target_lang FROM segments s JOIN document_summary d ON d.id = s.document_id)""")
def tiered_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers of the first of three providers that has one."""
    work = spread(_scoped(spark, d).select(F.col("id").alias("segment_id"), "source_text", "source_lang", "target_lang"))
    return providers.tiered(work, [("first", _latin_only), ("second", _short_only), ("echo", providers.echo)], providers.Calls(pause=0.0, wait=0.0))


@query(oracle.settled_here(STRUCTURAL, SCOPED))
def stream_process_local(spark: SparkSession, d: str) -> DataFrame:
    """Segments that need no provider, as they arrive."""
    docs, memory = table(spark, d, "document_summary"), table(spark, d, "memory_entries")
    work = lambda batch: pipeline.settled_here(pipeline.matched(batch, docs, None, memory)).select("id", "text", "source_type", "risk_score", "status", "translation_status", "is_repaired")
    return progress.each_batch(progress.event_stream(spark, f"{d}/segments.parquet"), work, "id string, text string, source_type string, risk_score double, status string, translation_status string, is_repaired boolean")


@query(f"""SELECT id, 'data: {{"status":"' || status || '"' || coalesce(',"step":"' || step || '"', '') || coalesce(',"progress":' || progress, '') || coalesce(',"total":' || total, '') || '}}' || chr(10) || chr(10) AS message FROM ({_STAGED})""")
def progress_messages(spark: SparkSession, d: str) -> DataFrame:
    return progress.messages(document_progress(spark, d))


@query(f"""SELECT s.id, {oracle.shown('source_text')} AS shown, lower({oracle.shown('source_text')}) AS plain, translate(source_text, '0123456789', '०१२३४५६७८९') AS native, coalesce(n, 0)::INTEGER AS n_entities
FROM segments s LEFT JOIN (SELECT id, count(*) AS n FROM ({oracle.detected()}) GROUP BY 1) e ON e.id = s.id""")
def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """The registered functions, called from SQL."""
    register.register(spark)
    table(spark, d, "segments").createOrReplaceTempView("lipigraph_segments")
    return spark.sql("SELECT id, display_normalize(source_text) AS shown, normalize_text(source_text) AS plain, to_native_digits(source_text) AS native, size(detect_entities(source_text)) AS n_entities FROM lipigraph_segments")


@query(oracle.TEXT_BLOCKS)
def sql_table_function(spark: SparkSession, d: str) -> DataFrame:
    """The registered table function, called from SQL."""
    register.register(spark)
    table(spark, d, "documents").where("text IS NOT NULL").createOrReplaceTempView("lipigraph_documents")
    return spark.sql("SELECT doc_id, b.sequence, b.source_text FROM lipigraph_documents, LATERAL segment_text(text) b")


@query("""SELECT id, len(list_filter(protected_entities, lambda a: len(list_filter(protected_entities, lambda b: a.start < b."end" AND b.start < a."end" AND (a.start <> b.start OR a."end" <> b."end"))) > 0)) > 0 AS overlaps FROM segments WHERE len(protected_entities) > 0""")
def overlapping_entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "segments").where(F.size("protected_entities") > 0).select("id", E.overlapping(F.col("protected_entities")).alias("overlaps"))


@query("SELECT segment_id, translated_text, provider_tier, coalesce(nullif(trim(translated_text), ''), nullif(trim(provider_tier), '')) AS text FROM translation_results")
def response_texts(spark: SparkSession, d: str) -> DataFrame:
    """The text of answers as a provider's JSON: a known key, else the first value that isn't blank."""
    payload = F.to_json(F.struct(F.col("provider_tier").alias("tier"), F.col("translated_text").alias("output")))
    return table(spark, d, "translation_results").select("segment_id", "translated_text", "provider_tier", providers.response_text(payload).alias("text"))


@query("SELECT segment_id, CASE WHEN status = 'needs_review' THEN '*' || candidate_text ELSE candidate_text END AS candidate_text FROM translations")
def translations_upserted(spark: SparkSession, d: str) -> DataFrame:
    """Translations after new candidates of those in review are written over them."""
    old = table(spark, d, "translations").select("segment_id", "candidate_text", "status")
    new = old.where("status = 'needs_review'").withColumn("candidate_text", F.concat(F.lit("*"), F.col("candidate_text")))
    return review.upsert(old, new, ["segment_id"]).select("segment_id", "candidate_text")


@query("""WITH gone AS (SELECT id FROM document_summary WHERE status = 'exported'), s AS (SELECT id FROM segments WHERE document_id NOT IN (SELECT id FROM gone))
SELECT 'documents' AS name, count(*) AS n, 0 AS cleared FROM document_summary WHERE status <> 'exported' UNION ALL SELECT 'segments', count(*), 0 FROM s UNION ALL SELECT 'translations', count(*), 0 FROM translations WHERE segment_id IN (SELECT id FROM s)
UNION ALL SELECT 'review_events', count(*), 0 FROM review_events WHERE document_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'memory_entries', count(*), count(*) FILTER (created_from_document_id IN (SELECT id FROM gone)) FROM memory_entries""")
def documents_deleted(spark: SparkSession, d: str) -> DataFrame:
    """What is left of each table after the exported documents are deleted, and the memory entries that lost their origin."""
    tables = {"documents": table(spark, d, "document_summary"), **{t: table(spark, d, t) for t in ("segments", "translations", "review_events", "memory_entries")}}
    gone = tables["documents"].where("status = 'exported'").select(F.col("id").alias("document_id"))
    left = review.without_documents(tables, gone)
    rows = [t.agg(F.lit(k).alias("name"), F.count(F.lit(1)).alias("n"), (F.count_if(F.col("created_from_document_id").isNull()) if k == "memory_entries" else F.lit(0).cast("long")).alias("cleared")) for k, t in left.items()]
    had = tables["memory_entries"].agg(F.count_if(F.col("created_from_document_id").isNull()).alias("had"))
    return reduce(DataFrame.unionByName, rows).crossJoin(F.broadcast(had)).select("name", "n", F.when(F.col("name") == "memory_entries", F.col("cleared") - F.col("had")).otherwise(F.col("cleared")).alias("cleared"))  # had is one row
