import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F

from lipigraph.functions import entities as E
from lipigraph.operators import feedback, joins, language, metrics, pipeline, providers, regions, review, views
from lipigraph.sources import segmenters, sinks
from lipigraph.streaming import progress

T0 = dt.datetime(2024, 1, 1)
TERMS = "source_lang string, target_lang string, domain string, subdomain string, source_term string, target_term string, term_type string, case_sensitive boolean, normalized_source_term string"


def test_glossary_both_ways(spark, monkeypatch):
    terms = spark.createDataFrame([("en", "ne", "d", "__none__", "Land office", "क", "office", False, "land office"), ("en", "ne", "d", "x", "Seal", "ख", "t", True, "seal"), ("en", "ne", "d", "y", "form", "ग", "t", False, "form")], TERMS)
    seg = spark.createDataFrame([("1", "en", "ne", "d", "x", "The Land Office Seal form", "the land office seal form"), ("2", "en", "ne", "d", "x", "see https://a.org/seal seal", "see https://a.org/seal seal"), ("3", "en", "ne", "d", "y", "form", "form"), ("4", None, "ne", "d", "y", "form", "form")], "id string, source_lang string, target_lang string, domain string, subdomain string, source_text string, normalized_source string")
    want = {("1", "Land office"), ("1", "Seal"), ("3", "form")}
    assert {(r.id, r.source_term) for r in joins.glossary_hits(seg, terms).collect()} == want
    monkeypatch.setattr(joins, "MAX_DICTIONARY", 0)
    hits = joins.glossary_hits(seg, terms)
    assert {(r.id, r.source_term) for r in hits.collect()} == want
    assert {r.id: len(r.hits) for r in joins.nested_hits(seg, hits).collect()} == {"1": 2, "2": 0, "3": 1, "4": 0}


def test_glossary_hits_do_not_depend_on_its_size(spark, monkeypatch):
    term = lambda source, cased, plain: ("en", "ne", "d", "__none__", source, "क", "t", cased, plain)
    terms = spark.createDataFrame([term("form", False, "form"), term("वडा", False, "वडा"), term("§", False, "§"), term("Seal", True, None), term("Deed", True, "deed"), term("form", False, "form"), term("none", False, "none")], TERMS)
    seg = spark.createDataFrame([("1", "en", "ne", "d", "x", "Forms with a Seal, § 4, a Deed", "a stale text"), ("2", "en", "ne", "d", "x", "वडाको", "वडाको")], "id string, source_lang string, target_lang string, domain string, subdomain string, source_text string, normalized_source string")
    want = [("1", "Deed"), ("1", "Seal"), ("1", "form"), ("1", "§"), ("2", "वडा")]
    for bound in (50_000, 3, 1):
        monkeypatch.setattr(joins, "MAX_DICTIONARY", bound)
        assert sorted((r.id, r.source_term) for r in joins.glossary_hits(seg, terms).collect()) == want


def test_contract(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    got = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y"), ("c", " "), ("e", "x")], "segment_id string, translated_text string")
    assert {tuple(r) for r in joins.contract_check(asked, got).collect()} == {("b", "duplicate"), ("c", "blank"), ("d", "missing"), ("e", "extra")}


def test_tiers(spark):
    def half(texts, s, t):
        return [x.upper() if x < "m" else None for x in texts]

    def slow(texts, s, t):
        raise OSError

    work = spark.createDataFrame([("1", "a", "en", "ne"), ("2", "z", "en", "ne"), ("3", None, "en", "ne")], "segment_id string, source_text string, source_lang string, target_lang string")
    out = {r.segment_id: (r.translated_text, r.provider_tier, r.error is None) for r in providers.tiered(work, [("slow", slow), ("half", half), ("echo", providers.echo)], providers.Calls(pause=0, wait=0)).collect()}
    assert out == {"1": ("A", "half", True), "2": ("z", "echo", True), "3": (None, "echo", False)}
    assert providers.language_name(" NE ") == "Nepali"


def test_response_text(spark):
    rows = [('{"NLLB200": "a", "x": "b"}', "a"), ('{"x": " ", "y": "b"}', "b"), ("{}", None), (None, None)]
    got = spark.createDataFrame(rows, "p string, want string").select("want", providers.response_text(F.col("p")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


PAGE_LINE = "doc_id string, page_index int, block_index int, line_index int, text string, x0 double, y0 double, x1 double, y1 double, font_size double"


def test_regions(spark):
    line = lambda p, i, t, y, x=50.0: ("d", p, 0, i, t, x, y, x + 250, y + 10, 10.0)
    rows = [line(0, 0, "A docu-", 10.0), line(0, 1, "ment begins", 22.0), line(0, 2, "#12", 34.0), line(0, 3, "after iv", 46.0), line(0, 4, "2.1", 58.0), line(0, 5, ". . . .", 70.0), line(0, 6, "far", 200.0), line(1, 0, "next page", 10.0)]
    # Each line begins a little further right: the shift is that from the line before.
    rows += [("e", 0, 0, i, f"step {i}", 50.0 + 60 * i, 10.0 + 20 * i, 100.0 + 60 * i, 20.0 + 20 * i, 10.0) for i in range(4)]
    df = spark.createDataFrame(rows, PAGE_LINE)
    got = regions.regions(df, few=0).orderBy("doc_id", "region_id").collect()
    assert [r.text for r in got] == ["A document begins", "#12", "after iv 2.1", ". . . .", "far", "next page", "step 0 step 1 step 2 step 3"]
    assert [r.segment_type for r in got][:2] == ["pdf_text_region", "pdf_line"] and [r.region_id for r in got] == [1, 2, 3, 4, 5, 6, 1]
    # A short document keeps its lines.
    assert regions.regions(df).count() == len(rows) and regions.regions(df.limit(0)).count() == 0
    foot = spark.createDataFrame([("12", 290.0, 800.0, 310.0, 812.0), ("12", 290.0, 100.0, 310.0, 112.0)], "t string, a double, b double, c double, e double")
    kept = foot.where(regions.not_footer(F.col("t"), F.col("a"), F.col("b"), F.col("c"), F.col("e"), F.lit(600.0), F.lit(840.0))).collect()
    assert [r.b for r in kept] == [100.0]
    many = [line(0, i, f"line {i}", 12.0 * i) for i in range(50)]
    assert [r.line_count for r in regions.regions(spark.createDataFrame(many, df.schema), few=40).orderBy("region_id").collect()] == [24, 24, 2]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\r\ntwo\n \n\nthree", newline="")
    (tmp_path / "b.csv").write_text('h1,h2\n"x, y",\nz\n', newline="")
    (tmp_path / "c.html").write_text("<h1>T</h1><p>a <b>b</b></p><script>no</script>")
    (tmp_path / "d.docx").write_bytes(sinks.docx(["first & <one>", "second"]))
    (tmp_path / "e.exe").write_bytes(b"\0")
    files = segmenters.read_files(spark, str(tmp_path))
    by = {}
    names = {r.checksum: r.path.rsplit("/", 1)[1] for r in files.select("checksum", "path").collect()}
    for r in segmenters.segment_files(files).orderBy("doc_id", "sequence").collect():
        by.setdefault(names[r.doc_id], []).append(r.source_text)
    assert by == {"a.txt": ["one two", "three"], "b.csv": ["h1", "h2", "x, y", "z"], "c.html": ["T", "a b"], "d.docx": ["first & <one>", "second"]}
    cells = spark.createDataFrame([("d", 0, 0, "h"), ("d", 1, 1, "x, y")], "document_id string, row_index int, cell_index int, text string")
    assert sinks.as_grid(cells).first().value == 'h,\n,"x, y"\n'
    new = joins.write_back(cells, cells.where("row_index = 1").select("row_index", "cell_index", F.lit("n").alias("text")), ["row_index", "cell_index"])
    assert {r.text for r in new.collect()} == {"h", "n"}
    out = sinks.as_docx(spark.createDataFrame([("d", 2, "b"), ("d", 1, "a")], "document_id string, sequence int, text string")).first().content
    (tmp_path / "o.docx").write_bytes(out)
    assert [t for _, t, _ in segmenters.docx_pieces(bytes(out))] == ["a", "b"] and zipfile.is_zipfile(tmp_path / "o.docx")
    assert [r.path.rsplit("/", 1)[1] for r in segmenters.unsupported(files).collect()] == ["e.exe"]


def test_documents_are_written_back(spark):
    table = sinks.docx_table([["h", "x & y"], ["only"]])
    assert [(t, p["row_index"], p["cell_index"]) for _, t, p in segmenters.docx_pieces(table)] == [("h", 0, 0), ("x & y", 0, 1), ("only", 1, 0)]
    made = sinks.as_docx_table(spark.createDataFrame([("d", 0, 0, "h"), ("d", 1, 1, "z")], "document_id string, row_index int, cell_index int, text string")).first().content
    assert [t for _, t, _ in segmenters.docx_pieces(bytes(made))] == ["h", "z"]
    body = '<w:p><w:r><w:t>first </w:t></w:r><w:r><w:t>run</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p/>'
    runs = sinks._package(body)
    files = spark.createDataFrame([("d", bytearray(runs)), ("e", bytearray(runs))], "document_id string, content binary")
    place = "struct<paragraph_index:int,table_index:int,row_index:int,cell_index:int>"
    new = spark.createDataFrame([("d", (0, None, None, None), "नयाँ"), ("d", (0, 0, 0, 0), "b < c"), ("d", (1, None, None, None), "was empty")], f"document_id string, location {place}, text string")
    got = {r.document_id: [t for _, t, _ in segmenters.docx_pieces(bytes(r.content))] for r in sinks.write_back_docx(files, new).collect()}
    assert got == {"d": ["नयाँ", "b < c", "was empty"], "e": ["first run", "cell"]}


def test_texts_are_exported_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sinks, "PART", 2)
    rows = [("d", i, f"i{i}", f"t{i}") for i in (3, 1, 5, 2, 4)] + [("e", 1, "x", None)]
    got = {(r.document_id, r.part): r.value for r in sinks.as_text(spark.createDataFrame(rows, "document_id string, sequence int, id string, text string")).collect()}
    assert got == {("d", 0): "t1\n\nt2", ("d", 1): "t3\n\nt4", ("d", 2): "t5", ("e", 0): ""}


def test_numbering_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(metrics, "STRETCH", 3)
    rows = [("d", s, f"i{k}", f"t{k}") for k, s in enumerate([0, 1, 1, 4, 9, 10, 30])] + [("e", None, "a", "x"), ("e", 5, "b", None), ("e", 6, "c", "z"), (None, 1, "n", "q")]
    df = spark.createDataFrame(rows, "document_id string, sequence int, id string, source_text string")
    n = {r.id: r.n for r in metrics.numbered(df).collect()}
    assert n == {**{f"i{k}": k + 1 for k in range(7)}, "a": 1, "b": 2, "c": 3, "n": 1}
    before = {r.id: r.previous_text for r in metrics.previous_text(df).collect()}
    assert before == {"i0": None, **{f"i{k}": f"t{k - 1}" for k in range(1, 7)}, "a": None, "b": "x", "c": None, "n": None}


def test_review_fold(spark):
    rows = [("1", "s", "t", "approve", None, "x", "u", T0), ("2", "s", "t", "edit", "x", "y", "v", T0 + dt.timedelta(1)), ("2", "s", "t", "edit", "x", "y", "v", T0 + dt.timedelta(1)), ("3", "q", "t", "edit_and_approve", "a", "b", "v", T0)]
    e = spark.createDataFrame(rows, "id string, segment_id string, translation_id string, event_type string, before_text string, after_text string, actor string, created_at timestamp")
    got = {r.segment_id: (r.status, r.approved_text, r.n_events) for r in review.state(e).collect()}
    assert got == {"s": ("needs_review", None, 2), "q": ("approved", "b", 1)}
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in review.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_redaction():
    e = [{"kind": "money", "text": "NPR 500", "target_term": None}]
    assert feedback.redact("तिर्नुहोस् रु. ५०० a@b.org", e) == "तिर्नुहोस् <MONEY> <EMAIL>"
    assert feedback.redact(None, e) is None and feedback.redact("", []) == ""
    # The earlier entity takes what both name; marks of entities can't run out.
    two = [{"kind": "office", "text": "Land Office", "target_term": None}, {"kind": "id", "text": "Office 12"}]
    assert feedback.redact("the LAND OFFICE 12", two) == "the <OFFICE> <NUMBER>"
    many = [{"kind": "id", "text": f"KF-{i:05d}"} for i in range(5000)]
    assert feedback.redact(" ".join(x["text"] for x in many), many) == " ".join(["<ID>"] * 5000)


def _reviewed(spark):
    seg = f"id string, document_id string, sequence int, segment_type string, source_text string, status string, protected_entities array<{E.ENTITY}>, glossary_hits array<{E.HIT}>"
    entity = {"kind": "money", "text": "NPR 500", "start": 4, "end": 11, "target_term": None, "segment_source_len": 11}
    hit = {"source_term": "Ward", "target_term": "वडा", "term_type": "t"}
    segments = [
        ("a", "d", 1, "p", "Pay NPR 500", "approved", [entity], []), ("b", "d", 2, "p", "Name", "approved", [], []), ("c", "d", 3, "p", "Ram Thapa", "approved", [], []), ("e", "d", 4, "p", "the Ward", "approved", [], [hit]), ("f", "d", 5, "p", "12", "approved", [], []),
        ("g", "open", 1, "p", "one more", "approved", [], []), ("h", "open", 2, "p", "not yet", "needs_review", [], []), ("i", "blank", 1, "p", "x y", "approved", [], []),
    ]
    texts = {"a": ("NPR ५०० तिर्नुहोस्", "तिर्नुहोस् NPR ५००", "approved"), "b": ("नाम", "नाम", "memory_applied"), "c": ("राम थापा", "राम थापा", "approved"), "e": ("वडा", "वार्ड", "approved"), "f": ("१२", "१२", "approved"), "g": ("अर्को", "अर्को", "approved"), "h": (None, "छैन", "candidate"), "i": (" ", "x", "approved")}
    translations = [(k, f"t{k}", c, a, st, "provider", "p") for k, (a, c, st) in texts.items()]
    events = [("1", "a", "edit_and_approve", "तिर्नुहोस् NPR ५००", texts["a"][0], T0), ("2", "e", "edit", "वार्ड", "वडा", T0), ("3", "e", "approve", "वडा", "वडा", T0 + dt.timedelta(1))]
    docs = [(x, f"{x}.docx", "docx", "en", "ne", "public_service", "__none__") for x in ("d", "open", "blank")]
    return (
        spark.createDataFrame(docs, "id string, original_filename string, file_type string, source_lang string, target_lang string, domain string, subdomain string"),
        spark.createDataFrame(segments, seg),
        spark.createDataFrame(translations, "segment_id string, id string, candidate_text string, approved_text string, status string, source_type string, provider_name string"),
        spark.createDataFrame(events, "id string, segment_id string, event_type string, before_text string, after_text string, created_at timestamp").withColumn("actor", F.lit("r")),
    )


def test_feedback_pack(spark):
    rows, corrections, manifest = (df.collect() for df in feedback.pack(*_reviewed(spark)))
    # Only the document all of whose segments are approved leaves a pack; a name behind its label and a bare number stay out.
    assert {(r.document_id, r.sequence): (r.source_text_redacted, r.approved_text_redacted) for r in rows} == {("d", 1): ("Pay <MONEY>", "<MONEY> तिर्नुहोस्"), ("d", 2): ("Name", "नाम"), ("d", 4): ("the Ward", "वडा")}
    assert {(r.sequence, r.review_action, r.candidate_text_redacted) for r in corrections} == {(1, "edit_and_approve", "तिर्नुहोस् <MONEY>"), (4, "revised_then_approve", "वार्ड")}
    assert [r.glossary_terms_applied for r in rows if r.sequence == 4] == ["Ward -> वडा"] and {r.had_risk_before_approval for r in rows} <= {"true", "false"}
    (m,) = manifest
    assert len(m) == 17 and (m.total_segments, m.approved_segments, m.memory_reused_segments, m.corrected_segments, m.included_rows, m.excluded_rows) == (5, 5, 1, 2, 3, 2)
    assert m.scope_label == "Public Service" and m.subdomain == "" and m.exported_at is not None
    preview = feedback.pack(*_reviewed(spark), only_ready=False)[2].collect()
    assert {r.document_id: r.total_segments for r in preview} == {"d": 5, "open": 1, "blank": 1}
    assert feedback.pack(*(x.limit(0) for x in _reviewed(spark)))[2].count() == 0


def test_reviews_are_scored_anew(spark):
    _, segments, translations, _ = _reviewed(spark)
    ask = lambda *rows: spark.createDataFrame(list(rows), "segment_id string, text string, actor string")
    got = {r.segment_id: r for r in review.approve(segments, translations, ask(("h", None, "x"), ("a", " शुल्क ", "x"), ("g", "  ", "x"), ("zz", "x", "x"))).collect()}
    assert (got["h"].event_type, got["h"].after_text, got["h"].status, got["h"].risk_score) == ("approve", "छैन", "approved", 1.0)
    assert got["a"].event_type == "edit_and_approve" and got["a"].after_text == "शुल्क" and {"changed_number", "changed_protected_entity"} <= {x.code for x in got["a"].risk_reasons}
    assert (got["g"].error, got["g"].after_text, got["g"].status) == ("blank text", None, "approved") and set(got) == set("hag")
    got = {r.segment_id: r for r in review.edit(segments, translations, ask(("h", "अझै होइन", "x"), ("b", "नाम", "x"))).collect()}
    assert (got["b"].status, got["b"].approval_cleared, got["b"].before_text) == ("needs_review", True, "नाम") and not got["h"].approval_cleared
    more = segments.unionByName(segments.where("id = 'h'").withColumn("id", F.lit("h2")))
    spread_ = review.propagate(more, spark.createDataFrame([("h", "छैन")], "segment_id string, text string")).collect()
    assert [(r.id, r.text) for r in spread_] == [("h2", "छैन")]


def test_glossary_and_memory_changes(spark):
    new = joins.default_terms(spark)
    assert new.count() == 6 and joins.seeded(new.limit(0)).count() == 6 and joins.seeded(new.limit(2)).count() == 2
    ask = spark.createDataFrame([("en", "ne", "public_service", None, " WARD  office", "x"), ("en", "ne", "public_service", " ", "Fee", "b"), ("en", "ne", "public_service", None, "FEE", "a")], "source_lang string, target_lang string, domain string, subdomain string, source_term string, target_term string")
    assert {(r.source_term, r.added) for r in review.add_terms(new, ask).collect()} == {(" WARD  office", False), ("FEE", True), ("Fee", False)}
    m = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "id string, is_active boolean")
    assert {(r.id, r.is_active) for r in review.deactivate(m, m.where("id IN ('a', 'c')")).collect()} == {("a", False), ("b", True), ("c", False)}
    empty = review.reset({"glossary_terms": new.limit(1), "segments": m})
    assert empty["glossary_terms"].count() == 6 and empty["segments"].count() == 0


def test_memory_upsert_keeps_provenance_and_nulls(spark):
    key = "source_lang string, target_lang string, domain string, subdomain string"
    memory = spark.createDataFrame([("m", None, "ne", "d", "x", "Old Text", "old text", "क", "s", "t", "e", "u", T0, 3, True)], f"id string, {key}, source_text string, normalized_source string, target_text string, created_from_document_id string, created_from_segment_id string, created_from_review_event_id string, approved_by string, approved_at timestamp, times_used int, is_active boolean")
    a = spark.createDataFrame([(None, "ne", "d", "x", "OLD  text", "ख", "v", T0 + dt.timedelta(1), "d2", "s2", "e2"), (None, "ne", "d", "x", "fresh", "ग", "v", T0, "d2", "s3", "e3")], f"{key}, source_text string, target_text string, approved_by string, approved_at timestamp, document_id string, segment_id string, event_id string")
    got = {r.normalized_source: r for r in review.upsert_memory(memory, a).collect()}
    old, new = got["old text"], got["fresh"]
    assert (old.change, old.id, old.source_text, old.target_text, old.times_used, old.created_from_segment_id, old.source_lang) == ("updated", "m", "Old Text", "ख", 3, "s2", None)
    assert (new.change, new.created_from_review_event_id, new.times_used) == ("inserted", "e3", 0) and len(got) == 2


def test_retries():
    waits = []
    calls = providers.Calls(pause=0, attempts=3, sleep=waits.append)

    def limited(texts, s, t):
        raise providers.Refused(429, 7.0)

    def denied(texts, s, t):
        raise providers.Refused(401)

    answers = iter([providers.Refused(503), None])

    def shaky(texts, s, t):
        if e := next(answers):
            raise e
        return list(texts)

    assert calls.once(limited, ["a"], "en", "ne") == [None] and waits == [7.0, 7.0]
    assert calls.once(denied, ["a"], "en", "ne") == [None] and len(waits) == 2
    assert calls.once(shaky, ["a"], "en", "ne") == ["a"] and waits[2:] == [0.4] and providers.language_name("tm") == "Tamang"


def test_deterministic_provider(spark):
    rows = [("1", "  applicant NAME ", "en", "ne"), ("2", "2081-02-03", "en", "ne"), ("3", "NPR 500", "en", "ne"), ("4", "९८१२३४५६७८", "ne", "en"), ("5", "KF-१०४२", "ne", "tmg"), ("6", "anything else", "en", "ne"), ("7", None, "en", "ne")]
    got = {r.id: (r.translated_text, r.how) for r in providers.deterministic(spark.createDataFrame(rows, "id string, source_text string, source_lang string, target_lang string")).collect()}
    assert got == {"1": ("निवेदकको नाम", "phrase"), "2": ("२०८१-०२-०३", "date"), "3": ("NPR ५००", "money"), "4": ("9812345678", "phone"), "5": ("KF-1042", "reference"), "6": ("anything else", "echo"), "7": (None, "echo")}


def test_stabilising(spark):
    def entity(kind, text):
        return {"kind": kind, "text": text, "start": 0, "end": len(text), "target_term": None, "segment_source_len": len(text)}

    rows = [
        ("label", "2.1", "two one", "ne", []), ("date", "2081-02-03", "2081-2-3-1", "ne", [entity("date", "2081-02-03")]), ("phone", "+977-9812345678", "977/981234567", "ne", [entity("phone", "+977-9812345678")]),
        ("url", "https://x.org/12", "https://x.org/१२ ५", "ne", [entity("url", "https://x.org/12")]), ("fine", "Office", "कार्यालय", "ne", []), ("digits", "the fee is 12 12", "शुल्क १२ 1२ 3", "en", [entity("number", "12")]),
    ]
    df = spark.createDataFrame(rows, f"id string, source_text string, raw string, target_lang string, entities array<{E.ENTITY}>").withColumn("hits", F.array().cast(f"array<{E.HIT}>"))
    got = {r.id: (r.text, r.text_changed) for r in pipeline.stabilised(df, "raw", "text").collect()}
    assert got["label"] == ("२.१", True) and got["date"] == ("२०८१-०२-०३", True) and got["fine"] == ("कार्यालय", False)
    assert got["phone"][1] and got["url"] == ("https://x.org/12 ५", True) and got["digits"] == ("शुल्क १२ 1२ 3", False)


def test_processing(spark):
    docs = spark.createDataFrame([("d", "en", "ne", "public_service", None)], "id string, source_lang string, target_lang string, domain string, subdomain string")
    texts = {"1": "2.1", "2": "Known text", "3": "Applicant Name", "4": "Pay NPR 500 today", "5": "never asked", "6": "Fee Fee form"}
    seg = spark.createDataFrame([(k, "d", int(k), t, [], []) for k, t in texts.items()], f"id string, document_id string, sequence int, source_text string, protected_entities array<{E.ENTITY}>, glossary_hits array<{E.HIT}>")
    memory = spark.createDataFrame([("m", "en", "ne", "public_service", "__none__", "known text", "थाहा", T0, 1, True)], "id string, source_lang string, target_lang string, domain string, subdomain string, normalized_source string, target_text string, approved_at timestamp, times_used int, is_active boolean")
    asked = []

    def translate(work):
        asked.append(sorted(r.source_text for r in work.collect()))
        good = {"3": "निवेदकको नाम", "4": "आज एनपीआर५०० तिर्नुहोस्", "6": "शुल्क शुल्क"}
        rows = [(r.id, "फारम शुल्क" if r.source_text.startswith("Mend") and r.id == "6" else good.get(r.id), "live", None if r.id in good else "no answer") for r in work.collect()]
        return spark.createDataFrame(rows, "id string, translated_text string, provider_tier string, error string")

    got = {r.id: r for r in pipeline.process(seg, docs, joins.default_terms(spark), memory, translate).collect()}
    assert asked[0] == sorted(texts[k] for k in "3456") and set(got) == set(texts)
    assert (got["1"].text, got["1"].source_type, got["2"].text, got["2"].status, got["2"].translation_status) == ("२.१", "preserved", "थाहा", "approved", "memory_applied")
    assert got["3"].text == "निवेदकको नाम" and got["3"].provider_name == "live" and got["4"].is_repaired
    # The source in native digits had less risk than the answer; the house style then wrote the currency.
    assert got["4"].text == "Pay रु ५०० today"
    assert (got["5"].text, got["5"].risk_score, got["5"].status) == ("", 10.0, "needs_review")
    for r in got.values():
        codes = [x.code for x in r.risk_reasons]
        assert r.risk_score == 10.0 or r.risk_score == len([c for c in codes if c not in ("self_repaired", "api_fallback")])


def test_read_models(spark):
    docs, segments, translations, _ = _reviewed(spark)
    docs = docs.withColumns({"status": F.lit("processed"), "export_file_uri": F.lit(None).cast("string"), "created_at": F.lit(T0), "updated_at": F.lit(T0)})
    v = {r.id: r for r in views.documents(docs, segments, translations.withColumn("risk_reasons", F.array().cast("array<string>"))).collect()}
    assert v["d"].counts.segments == 5 and v["open"].counts.needs_review == 1 and v["d"].trust_summary.protected_preserved == 1
    label = spark.range(1).select(joins.provenance_label(F.lit(None).cast("string"), F.lit("public_service"), F.lit("__none__"), F.lit(dt.datetime(2024, 3, 5)), F.lit(1)).alias("a"), views.source_label(F.lit("provider"), F.lit("my_api")).alias("b"), views.entity_label(F.lit("url")).alias("c"), views.segment_label(F.lit("x")).alias("d")).first()
    assert tuple(label) == ("Reused from approved memory · Public Service · approved Mar 5 · 1 use", "From My Api provider", "URL", "Segment")


def test_language_decision(spark):
    w = spark.createDataFrame([("ne", "छ", 2.0), ("ne", "हुन्छ", 3.0), ("tmg", "मुला", 3.0)], "lang string, token string, weight double")
    rows = [("a", "the office is open today ok"), ("b", "hi"), ("c", "छ छ हुन्छ हुन्छ"), ("d", "मुला छ छ"), ("e", ""), ("f", "मुला मुला")]
    got = {r.k: (r.detected, r.confidence) for r in language.decide(language.scores(spark.createDataFrame(rows, "k string, text string"), w, "k")).collect()}
    assert got == {"a": ("en", "high"), "b": ("en", "medium"), "c": ("ne", "high"), "d": (None, "low"), "e": (None, "low"), "f": ("tmg", "medium")}
    seg = [("d", 1, "1", "चु फाराम वडा गेदिमरि पेस लास्ह्युगो।"), ("d", 2, "2", "१२"), ("e", 1, "3", "वडा"), ("f", 1, "4", "12"), ("g", 1, "5", "Please submit this form to the Ward Office.")]
    told = {r.document_id: r for r in language.suggest(spark.createDataFrame(seg, "document_id string, sequence int, id string, source_text string"), language.weights(spark)).collect()}
    assert (told["d"].detected, told["d"].confidence, told["d"].votes, told["d"].segment_count) == ("tmg", "high", 1, 2) and "across 1 segment." in told["d"].explanation
    assert told["e"].detected is None and "share" in told["e"].explanation and told["f"].explanation.startswith("The sample") and told["g"].detected == "en"


def test_streams(spark, tmp_path):
    schema = "id string, event_type string, created_at timestamp"
    days = [("1", "edit", T0), ("1", "edit", T0), ("2", "approve", T0 + dt.timedelta(hours=3)), ("3", "edit", T0 + dt.timedelta(days=9))]
    for i, r in enumerate(days):
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    stream = progress.event_stream(spark, str(tmp_path / "t"))
    assert {(r.event_type, r.n) for r in progress.run_once(progress.counts(stream)).collect()} == {("edit", 3), ("approve", 1)}
    rows = progress.run_once(progress.windowed(progress.event_stream(spark, str(tmp_path / "t"), 10)), "append").collect()
    assert {(r.event_type, r.n) for r in rows} <= {("edit", 1), ("approve", 1)}


def test_streamed_memory(spark, tmp_path):
    fold = progress.remember(str(tmp_path / "m"))
    schema = "key string, target_text string, approved_at timestamp"
    fold(spark.createDataFrame([("a", "1", T0), ("b", "1", T0)], schema), 0)
    fold(spark.createDataFrame([("a", "2", T0 + dt.timedelta(1))], schema), 1)
    fold(spark.createDataFrame([("a", "2", T0 + dt.timedelta(1))], schema), 1)
    want = {("a", "2"), ("b", "1")}
    assert {(r.key, r.target_text) for r in progress.recall(spark, str(tmp_path / "m")).collect()} == want
    assert spark.read.parquet(str(tmp_path / "m/batch=1")).count() == 1
    progress.compact(spark, str(tmp_path / "m"), str(tmp_path / "n"))
    assert {(r.key, r.target_text) for r in progress.recall(spark, str(tmp_path / "n")).collect()} == want


def test_stages(spark):
    docs = spark.createDataFrame([("a", "failed", None), ("b", "processed", None), ("c", "uploaded", None), ("d", "processing", None), ("e", "processing", None), ("f", "processing", {"total_segments": "9", "local_segments": "4"}), ("g", "processing", None), ("h", "exported", None)], "id string, status string, metadata map<string,string>")
    states = spark.createDataFrame([("d", 5, 3), ("e", 5, 5), ("f", 1, 1), ("h", 2, 2)], "document_id string, total long, done long")
    got = {r.id: tuple(r)[1:] for r in progress.staged(docs, states).collect()}
    assert got["a"] == ("failed", None, None, None) and got["b"] == ("processed", "ready", None, None) and got["c"][1] == got["g"][1] == "parsing"
    assert got["d"] == ("processing", "translating", 3, 5) and got["e"][1] == "scoring" and got["f"] == ("processing", "translating", 4, 9) and got["h"] == ("exported", None, None, None)


def test_background_jobs_and_messages(spark):
    assert progress.Background(lambda: 1).wait(10) == "processed"
    job = progress.Background(lambda: 1 / 0)
    assert job.wait(10) == "failed" and "division" in job.error
    staged = spark.createDataFrame([("a", "processing", "translating", 3, 5), ("b", "failed", None, None, None)], "id string, status string, step string, progress long, total long")
    got = {r.id: r.message for r in progress.messages(staged).collect()}
    assert got == {"a": 'data: {"status":"processing","step":"translating","progress":3,"total":5}\n\n', "b": 'data: {"status":"failed"}\n\n'}


def test_packs_are_written(spark, tmp_path):
    sinks.write_pack(*feedback.pack(*_reviewed(spark)), str(tmp_path / "pack"))
    rows = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "pack/approved_segments"))
    assert rows.count() == 3 and "source_text_redacted" in rows.columns
    assert spark.read.json(str(tmp_path / "pack/manifest")).first().redaction_mode == "protected_entity_placeholders_v1"


def test_a_cluster_names_its_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from lipigraph import session

    none = SimpleNamespace(get=lambda *a: None)
    far = SimpleNamespace(conf=none, sparkContext=SimpleNamespace(_conf=none, master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(far)


def test_sql_functions(spark):
    from lipigraph.functions import register

    assert {"normalize_text", "detect_entities", "segment_text"} <= set(register.register(spark))
    r = spark.sql("SELECT normalize_text(' Ｆｕｌｌ  X ') AS n, normalize_text(NULL) AS e, to_native_digits('12') AS d, scope_of(' ') AS s, detect_entities('a@b.co')[0].kind AS k").first()
    assert tuple(r) == ("full x", "", "१२", "__none__", "email")
    assert [tuple(x) for x in spark.sql("SELECT * FROM segment_text('one\n\ntwo')").collect()] == [(1, "one"), (2, "two")]
