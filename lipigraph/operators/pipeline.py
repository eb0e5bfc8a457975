"""The document dataflow from segments to prepared translations: glossary, protected values, structural labels, memory, a
provider for the rest, then settling of its answers: stabilising, scoring, repair and house style. Every step is a
transformation of the whole table; answers of the provider are kept before anything reads them, so that it is asked once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lipigraph.functions import entities as E
from lipigraph.functions import rules as R
from lipigraph.functions import text as T
from lipigraph.operators import joins, providers
from lipigraph.session import spread, stable_table

#: Work (id, source_text, source_lang, target_lang) to answers (id, translated_text, provider_tier, error).
Translate = Callable[[DataFrame], DataFrame]
PREPARED = ["id", "document_id", "sequence", "source_text", "text", "raw_text", "source_type", "provider_name", "memory_id", "risk_score", "risk_reasons", "status", "translation_status", "is_repaired"]
#: Reasons after which a repair isn't taken.
CRITICAL = ["changed_number", "date_mismatch", "total_omission"]
# What a repair is asked to mend, by reason.
INSTRUCTIONS = {
    "length_deviation": "The translation was incomplete. Provide all of it.",
    "changed_number": "Keep every number exactly.",
    "currency_suboptimal": "Use रु for the currency.",
    "polarity_flip": "The meaning was turned round. Mend the negation.",
    "hallucination_repetition": "Do not repeat words.",
    "ghost_entity": "Remove Latin words that the source does not have.",
    "untranslated_segment": "Translate the whole segment.",
}


def _kept(df: DataFrame, name: str) -> DataFrame:
    """df computed once, on at least as many partitions as there are cores, since scoring is work for these and not for bytes."""
    return spread(stable_table(df, name))


def scored(df: DataFrame, text: str, lang: Column, score: str, reasons: str | None = None) -> DataFrame:
    """df with the score of a text column, and its reasons where asked for."""
    out = R.score(df, "source_text", text, "entities", "hits", lang, reasons_as=reasons or "_unused", score_as=score)
    return out if reasons else out.drop("_unused")


def _digits_only(text: Column) -> Column:
    return F.regexp_replace(text, r"\P{Nd}", "")


def restored(text: Column, entities: Column) -> Column:
    """The text with technical values as the source has them: a mangled one takes the place of a short text, links and addresses keep Latin digits."""

    def one(now: Column, e: Column) -> Column:
        own, ascii_now, ascii_own = e["text"], T.to_ascii_digits(now), T.to_ascii_digits(e["text"])
        lost = ~F.contains(ascii_now, ascii_own)
        short = e["kind"].isin("phone", "id") & (F.length(now) < 2 * F.length(own))
        same_digits = (_digits_only(ascii_own) != "") & F.contains(_digits_only(ascii_now), _digits_only(ascii_own)) & (F.length(now) < 1.5 * F.length(own))
        latin = F.when(e["kind"].isin("url", "email"), F.replace(now, T.to_native_digits(own), own)).otherwise(now)
        return F.when(~e["kind"].isin(*E.VERBATIM) | own.isNull() | (own == ""), now).when(lost & (short | same_digits), own).when(lost, now).otherwise(latin)

    return F.aggregate(entities, text, one)


def localised(text: Column, entities: Column, lang: Column) -> Column:
    """The text with the digits of the target's script; links and addresses keep theirs."""
    native = F.aggregate(F.filter(entities, lambda e: e["kind"].isin("url", "email") & (e["text"] != "")), T.to_native_digits(text), lambda now, e: F.replace(now, T.to_native_digits(e["text"]), e["text"]))
    return F.when(lang == "en", T.to_ascii_digits(text)).otherwise(native)


def stabilised(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with out, a stabilised text column, and out_changed: a text without risk stays; else the source in native digits where that has less risk; else its label, its technical values and the digits of the target. The risks are those for an English target."""
    english = F.lit("en")
    df = df.withColumn("_local", T.to_native_digits(F.col("source_text")))
    df = scored(scored(df, text, english, "_risk"), "_local", english, "_local_risk")
    label = T.structural_label(F.col("source_text"))
    final = localised(restored(F.coalesce(label, F.col(text)), F.col("entities")), F.col("entities"), F.col("target_lang"))
    better = (F.col("_local") != F.col("source_text")) & (F.col("_local_risk") < F.col("_risk"))
    done = F.when(F.col("_risk") == 0, F.struct(F.col(text).alias("t"), F.lit(False).alias("c"))).when(better, F.struct(F.col("_local").alias("t"), F.lit(True).alias("c"))).otherwise(F.struct(final.alias("t"), (label.isNotNull() | (final != F.col(text))).alias("c")))
    return df.withColumn("_done", done).select(*[c for c in df.columns if not c.startswith("_")], F.col("_done.t").alias(out), F.col("_done.c").alias(f"{out}_changed"))


def instruction(codes: Column, source: Column, failed: Column) -> Column:
    """What a provider is asked to mend."""
    lines = F.array_compact(F.array(*(F.when(F.array_contains(codes, c), F.lit(f"\n- {x}")) for c, x in INSTRUCTIONS.items())))
    return F.concat(F.lit("Mend the translation and give it alone."), F.array_join(lines, ""), F.lit("\n\nSOURCE: "), source, F.lit("\nFAILED ATTEMPT: "), failed)


def repaired(df: DataFrame, translate: Translate) -> DataFrame:
    """df (id, source_text, text, risk_score, risk_reasons and so on) with the repair of the rows that a reason allows one for: one more answer of the provider, taken where it has no critical reason and less risk; else the house style alone, where that lowers the risk."""
    lang = F.col("target_lang")
    asked = (F.col("risk_score") > 0) & F.exists("risk_reasons", lambda r: F.coalesce(r["repairable"], F.lit(False)))
    work = df.where(asked)
    answers = translate(work.select("id", instruction(F.col("risk_reasons.code"), F.col("source_text"), F.col("text")).alias("source_text"), "source_lang", "target_lang"))
    answers = answers.where("error IS NULL").select("id", T.strip_chatter(T.strip(F.col("translated_text"))).alias("answer"))
    tried = work.join(answers, "id", "left").withColumn("answer", F.coalesce(F.nullif("answer", F.lit("")), "text"))
    tried = scored(stabilised(tried, "answer", "mended"), "mended", lang, "mended_score", "mended_reasons")
    good = (F.col("mended_score") < F.col("risk_score")) & ~F.exists("mended_reasons", lambda r: r["code"].isin(*CRITICAL))
    tried = tried.withColumn("mended", F.when(good, F.col("mended")).otherwise(T.house_style(F.col("source_text"), F.col("text"), lang)))
    # Kept, since the condition below would otherwise be computed apart from what it takes.
    tried = _kept(scored(tried.drop("mended_score", "mended_reasons"), "mended", lang, "mended_score", "mended_reasons"), "tried")
    note = F.array(R.reason(R.REPAIRED, "Repaired by itself", "low")).cast(f"array<{R.REASON}>")
    taken = tried.where("mended <> text AND mended_score < risk_score").select("id", "mended", "mended_score", F.concat("mended_reasons", note).alias("mended_reasons"))
    j = df.join(taken, "id", "left")
    new = F.col("mended").isNotNull()
    swap = {"text": F.coalesce("mended", "text"), "risk_score": F.coalesce("mended_score", "risk_score"), "risk_reasons": F.when(new, F.col("mended_reasons")).otherwise(F.col("risk_reasons")), "is_repaired": F.col("is_repaired") | new}
    return j.withColumns(swap).drop("mended", "mended_score", "mended_reasons")


def settled(answered: DataFrame, translate: Translate | None = None) -> DataFrame:
    """Answers (id, source_text, raw_text, source_lang, target_lang, entities, hits, tier) with text, risk_score, risk_reasons and is_repaired after every step. translate: the provider that repairs, if any."""
    lang = F.col("target_lang")
    df = stabilised(answered, "raw_text", "text").withColumn("text", T.strip_chatter(F.col("text"))).withColumnRenamed("text_changed", "is_repaired")
    df = scored(df, "text", lang, "risk_score", "risk_reasons")
    offline = F.array(R.reason(R.FALLBACK, "Offline answer", None)).cast(f"array<{R.REASON}>")
    df = _kept(df.withColumn("risk_reasons", F.when(F.col("tier") == "fixture_fallback", F.concat("risk_reasons", offline)).otherwise(F.col("risk_reasons"))), "scored")
    if translate is not None:
        df = _kept(repaired(df, translate), "repaired")
    df = df.withColumn("_styled", T.house_style(F.col("source_text"), F.col("text"), lang))
    df = scored(df, "_styled", lang, "_score", "_reasons")
    new = F.col("_styled") != F.col("text")
    return df.withColumns({"text": F.col("_styled"), "risk_score": F.when(new, F.col("_score")).otherwise(F.col("risk_score")), "risk_reasons": F.when(new, F.col("_reasons")).otherwise(F.col("risk_reasons")), "is_repaired": F.col("is_repaired") | new}).drop("_styled", "_score", "_reasons")


def matched(segments: DataFrame, documents: DataFrame, terms: DataFrame | None, memory: DataFrame) -> DataFrame:
    """Segments (id, document_id, sequence, source_text) with scope, hits, entities, structural label and what the memory has. terms: None where the segments bring entities and hits along."""
    s = joins.scoped(segments, documents)
    if terms is None:
        s = s.withColumns({"entities": E.full(segments, "protected_entities"), "hits": E.full_hits(segments, "glossary_hits")})
    else:
        s = joins.nested_hits(s, joins.glossary_hits(s, terms)).withColumn("entities", E.detect_entities_with("source_text", "hits"))
    length = F.length("source_text")
    s = s.withColumns({"entities": F.transform("entities", lambda e: e.withField("segment_source_len", length)), "label": T.structural_label(F.col("source_text")), "normalized_source": T.normalize_text("source_text")})
    known = joins.active_memory(memory)
    return s.join(known, [*joins.SCOPE, "normalized_source"], "left")


def _status(df: DataFrame) -> DataFrame:
    risky = F.col("risk_score") > 0
    return df.withColumns({"status": F.when(risky, "needs_review").otherwise("pending"), "translation_status": F.when(risky, "needs_review").otherwise("candidate")})


def settled_here(found: DataFrame) -> DataFrame:
    """What needs no provider: labels as they are, and texts that the memory has, which count as approved without risk."""
    none = F.array().cast(f"array<{R.REASON}>")
    labels = scored(found.where("label IS NOT NULL").withColumn("text", F.col("label")), "text", F.col("target_lang"), "risk_score", "risk_reasons")
    labels = _status(labels).withColumns({"raw_text": F.col("text"), "source_type": F.lit("preserved"), "provider_name": F.lit("none"), "memory_id": F.lit(None).cast("string"), "is_repaired": F.col("text") != F.col("source_text")})
    memory = found.where("label IS NULL AND memory_id IS NOT NULL").withColumns(
        {"text": F.col("memory_text"), "raw_text": F.col("memory_text"), "source_type": F.lit("memory"), "provider_name": F.lit("none"), "risk_score": F.lit(0.0), "risk_reasons": none, "status": F.lit("approved"), "translation_status": F.lit("memory_applied"), "is_repaired": F.lit(False)}
    )
    return labels.select(*PREPARED).unionByName(memory.select(*PREPARED))


def process(segments: DataFrame, documents: DataFrame, terms: DataFrame | None, memory: DataFrame, translate: Translate, repair: bool = True) -> DataFrame:
    """Every segment of documents with a scope, prepared. A segment that the provider has no answer for stays pending with an empty text and the score of an omission."""
    found = _kept(matched(segments, documents, terms, memory), "matched")
    work = found.where("label IS NULL AND memory_id IS NULL")
    answers = _kept(translate(work.select("id", "source_text", "source_lang", "target_lang")).select("id", "translated_text", "provider_tier", "error"), "answers")
    best = answers.groupBy("id").agg(F.min_by(F.struct("translated_text", "provider_tier"), F.struct(F.col("error").isNotNull(), "translated_text")).alias("a"))
    answered = work.join(best, "id", "left").withColumns({"raw_text": F.coalesce("a.translated_text", F.lit("")), "tier": F.coalesce("a.provider_tier", F.lit("none"))}).drop("a")
    done = _status(settled(answered, translate if repair else None)).withColumns({"source_type": F.lit("provider"), "provider_name": F.col("tier"), "memory_id": F.lit(None).cast("string")})
    return settled_here(found).unionByName(done.select(*PREPARED))


def deterministic(work: DataFrame) -> DataFrame:
    """The provider that needs no connection."""
    return providers.deterministic(work).select("id", "translated_text", F.lit("fixture").alias("provider_tier"), F.lit(None).cast("string").alias("error"))


def recorded(results: DataFrame) -> Translate:
    """A provider that gives answers recorded in a table (segment_id, translated_text, provider_tier, error), and none to what it wasn't asked."""

    def translate(work: DataFrame) -> DataFrame:
        good = results.select(F.col("segment_id").alias("id"), "translated_text", "provider_tier", "error")
        return work.select("id").join(good, "id")

    return translate
