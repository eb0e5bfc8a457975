"""Review as a fold of events over immutable tables: no row is updated, the state is what its events come to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lipigraph.functions import rules as R
from lipigraph.functions import text as T
from lipigraph.operators.joins import SCOPE, default_terms


def state(events: DataFrame) -> DataFrame:
    """(segment_id, status, approved_text, candidate_text, actor, n_events): the state after each segment's last event. An approval sets the approved text; an edit clears it and asks for review."""
    last = events.dropDuplicates(["id"]).groupBy("segment_id").agg(F.max_by(F.struct("event_type", "after_text", "actor"), F.struct("created_at", "id")).alias("e"), F.count(F.lit(1)).alias("n_events"))
    approved = F.col("e.event_type").isin("approve", "edit_and_approve")
    return last.select(
        "segment_id", F.when(approved, "approved").otherwise("needs_review").alias("status"), F.when(approved, F.col("e.after_text")).alias("approved_text"), F.col("e.after_text").alias("candidate_text"), F.col("e.actor").alias("actor"), "n_events"
    )


def actions(events: DataFrame) -> DataFrame:
    """(segment_id, review_action, corrected): how a segment came to its text."""
    by = events.dropDuplicates(["id"]).groupBy("segment_id").agg(F.max((F.col("event_type") == "edit_and_approve").cast("int")).alias("both"), F.max(F.col("event_type").isin("edit", "edit_and_approve").cast("int")).alias("edited"))
    return by.select("segment_id", F.when(F.col("both") == 1, "edit_and_approve").otherwise("revised_then_approve").alias("review_action"), (F.col("edited") == 1).alias("edited"))


def upsert_memory(memory: DataFrame, approvals: DataFrame) -> DataFrame:
    """Active memory after approvals (scope, source_text, target_text, approved_by, approved_at, document_id, segment_id, event_id): the last approval of a key gives target and provenance; source_text and times_used of an entry that was there stay. Keys are scope and normalised source; nulls equal nulls."""
    key = [*SCOPE, "normalized_source"]
    origin = ["created_from_document_id", "created_from_segment_id", "created_from_review_event_id"]
    now = approvals.withColumns({"normalized_source": T.normalize_text("source_text"), origin[0]: F.col("document_id"), origin[1]: F.col("segment_id"), origin[2]: F.col("event_id")})
    fields = ["source_text", "target_text", "approved_by", "approved_at", *origin]
    new = now.groupBy(*key).agg(F.max_by(F.struct(*fields), F.struct("approved_at", "event_id")).alias("n"))
    old = memory.where("is_active").groupBy(*key).agg(F.max_by(F.struct(*fields, "times_used", "id"), F.struct("approved_at", "id")).alias("o"))
    j = old.select(*(F.col(c).alias(f"o_{c}") for c in key), "o").join(new.select(*(F.col(c).alias(f"n_{c}") for c in key), "n"), [F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}")) for c in key], "full_outer")
    return j.select(
        *(F.when(F.col("o").isNull(), F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c) for c in key),
        F.col("o.id").alias("id"),
        F.coalesce("o.source_text", "n.source_text").alias("source_text"),
        *(F.when(F.col("n").isNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in fields[1:]),
        F.coalesce("o.times_used", F.lit(0)).alias("times_used"),
        F.when(F.col("o").isNull(), "inserted").when(F.col("n").isNull(), "kept").otherwise("updated").alias("change"),
    )


def _rescored(pairs: DataFrame) -> DataFrame:
    """pairs with the score of their new_text; review scores as for an English target."""
    return R.score(pairs, "source_text", "new_text", "protected_entities", "glossary_hits")


def _requested(segments: DataFrame, translations: DataFrame, requests: DataFrame) -> DataFrame:
    t = translations.select("segment_id", F.col("id").alias("translation_id"), "candidate_text", "approved_text")
    s = segments.select(F.col("id").alias("segment_id"), "document_id", "source_text", "protected_entities", "glossary_hits", "status")
    before = F.coalesce(F.nullif("approved_text", F.lit("")), "candidate_text")
    return requests.join(s, "segment_id").join(t, "segment_id").withColumn("before_text", before)


def approve(segments: DataFrame, translations: DataFrame, requests: DataFrame) -> DataFrame:
    """Outcome of requests (segment_id, text, actor), one a segment: the text, or where it is null the candidate, is approved and scored anew. A blank text is refused with an error and changes nothing; segments without translation have no outcome."""
    j = _requested(segments, translations, requests).withColumn("new_text", T.strip(F.coalesce("text", "candidate_text", F.lit(""))))
    blank = F.col("new_text") == ""
    out = _rescored(j)
    return out.select(
        "segment_id", "document_id", "translation_id", "actor", "before_text",
        F.when(~blank, F.when(F.col("new_text").eqNullSafe(F.col("candidate_text")), "approve").otherwise("edit_and_approve")).alias("event_type"),
        F.when(~blank, F.col("new_text")).alias("after_text"), F.when(~blank, F.col("risk_score")).alias("risk_score"), F.when(~blank, F.col("risk_reasons")).alias("risk_reasons"),
        F.when(blank, F.col("status")).otherwise("approved").alias("status"), F.when(blank, "blank text").alias("error"),
    )


def edit(segments: DataFrame, translations: DataFrame, requests: DataFrame) -> DataFrame:
    """Outcome of requests (segment_id, text, actor), one a segment, to change the candidate: scored anew; what was approved needs review again and loses its approved text and memory link, other segments need it where there is a risk. A blank text is refused."""
    j = _requested(segments, translations, requests).withColumn("new_text", T.strip(F.coalesce("text", F.lit(""))))
    blank, risky = F.col("new_text") == "", (F.col("status") == "approved") | (F.col("risk_score") > 0)
    return _rescored(j).select(
        "segment_id", "document_id", "translation_id", "actor", "before_text", F.when(~blank, "edit").alias("event_type"), F.when(~blank, F.col("new_text")).alias("after_text"), F.when(~blank, F.col("risk_score")).alias("risk_score"),
        F.when(blank, F.col("status")).when(risky, "needs_review").otherwise("pending").alias("status"), F.when(blank, None).when(risky, "needs_review").otherwise("candidate").alias("translation_status"),
        ((F.col("status") == "approved") & ~blank).alias("approval_cleared"), F.when(blank, "blank text").alias("error"),
    )


def propagate(segments: DataFrame, approvals: DataFrame) -> DataFrame:
    """(id, document_id, text): open segments that get the text of an approved one (segment_id, text) with the same source in their document, the last segment_id of several. How many there are is its count."""
    s = segments.select(F.col("id").alias("segment_id"), "document_id", "source_text", "status")
    given = approvals.join(s, "segment_id").groupBy("document_id", "source_text").agg(F.max_by("text", "segment_id").alias("text"), F.collect_set("segment_id").alias("from"))
    open_ = s.where("status <> 'approved'").join(given, ["document_id", "source_text"])
    return open_.where(~F.array_contains("from", F.col("segment_id"))).select(F.col("segment_id").alias("id"), "document_id", "text")


def deactivate(memory: DataFrame, ids: DataFrame) -> DataFrame:
    """memory whose entries of these ids (id) are no longer active; nothing is deleted."""
    gone = ids.select("id").distinct().withColumn("_gone", F.lit(True))
    return memory.join(gone, "id", "left").withColumn("is_active", F.col("is_active") & F.col("_gone").isNull()).drop("_gone")


TERM_KEY = [*SCOPE, "normalized_source_term"]


def add_terms(terms: DataFrame, new: DataFrame) -> DataFrame:
    """new (scope, source_term and so on) with whether each term is added; one whose scope and normal form the glossary or an earlier new one (by target term) has is a conflict."""
    fresh = new.withColumns({"subdomain": T.scope(F.col("subdomain")), "normalized_source_term": T.normalize_text("source_term")})
    known = terms.select(*TERM_KEY).distinct().withColumn("_known", F.lit(True))
    place = F.row_number().over(Window.partitionBy(*TERM_KEY).orderBy("target_term"))
    return fresh.withColumn("_place", place).join(known, TERM_KEY, "left").withColumn("added", F.col("_known").isNull() & (F.col("_place") == 1)).drop("_known", "_place")


def remove_terms(terms: DataFrame, ids: DataFrame) -> DataFrame:
    """The glossary without the terms of these ids."""
    return terms.join(ids.select("id"), "id", "left_anti")


def reset(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables empty, the glossary as a new one."""
    return {k: default_terms(t.sparkSession) if k == "glossary_terms" else t.limit(0) for k, t in tables.items()}


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and those of old whose key new doesn't have."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def unflagged(segments: DataFrame, translations: DataFrame) -> DataFrame:
    """Segments that can be approved together: translated, open and without risk."""
    t = translations.where("risk_score = 0").select(F.col("segment_id").alias("id"))
    return segments.where("status <> 'approved'").join(t, "id", "left_semi").select("id", "document_id")


def without_documents(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Tables after documents (ids: document_id) are deleted: their rows go, memory entries lose their provenance."""
    out = {k: t.join(ids, "document_id", "left_anti") for k, t in tables.items() if "document_id" in t.columns}
    if "documents" in tables:
        out["documents"] = tables["documents"].join(ids.withColumnRenamed("document_id", "id"), "id", "left_anti")
    if "translations" in tables:
        gone = tables["segments"].join(ids, "document_id", "left_semi").select(F.col("id").alias("segment_id"))
        out["translations"] = tables["translations"].join(gone, "segment_id", "left_anti")
    if "memory_entries" in tables:
        m = tables["memory_entries"].join(ids.select(F.col("document_id").alias("created_from_document_id"), F.lit(True).alias("_gone")), "created_from_document_id", "left")
        out["memory_entries"] = m.withColumn("created_from_document_id", F.when(F.col("_gone").isNull(), F.col("created_from_document_id"))).drop("_gone")
    return out


def queue(segments: DataFrame, translations: DataFrame, search: str = "", kind: str = "all") -> DataFrame:
    """The review queue: rows of a kind (all, flagged, needs_approval, memory, approved) whose source or effective text has the search text, in any case."""
    t = translations.select(F.col("segment_id").alias("id"), "risk_score", F.col("status").alias("t_status"), T.effective_text(F.col("approved_text"), F.col("candidate_text")).alias("text"))
    j = segments.select("id", "document_id", "sequence", "source_text", "status").join(t, "id", "left")
    wanted = {"all": F.lit(True), "flagged": F.col("risk_score") > 0, "needs_approval": F.col("status") != "approved", "memory": F.col("t_status") == "memory_applied", "approved": F.col("status") == "approved"}[kind]
    q = search.lower()
    return j.where(wanted & (F.contains(F.lower("source_text"), F.lit(q)) | F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit(q)))).select("id", "document_id", "sequence")
