"""The quality rules in DuckDB's SQL, written from their definitions with values of their own; no part of the engine is used
here, so that both sides can't share a mistake. DuckDB has no compatibility form: full-width ASCII, the spaces and the
ellipsis that the tables hold are folded by name."""

from __future__ import annotations

SPACE = r"[\t\n\v\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"[\p{L}\p{N}_]"
NUMBER = r"[+0-9०-९]+(?:[,.\-:/][+0-9०-९]+)*"
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F)))
_WIDE_DIGITS = "".join(map(chr, range(0xFF10, 0xFF1A)))
_SPACES = "     　"


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def compatible(x: str) -> str:
    return f"nfc_normalize(replace(translate({x}, {q(_WIDE + _SPACES)}, {q(_NARROW + ' ' * len(_SPACES))}), '…', '...'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def shown(x: str) -> str:
    return f"trim(regexp_replace({compatible(x)}, '{SPACE}+', ' ', 'g'), ' ')"


def ascii_(x: str) -> str:
    return f"translate({x}, '०१२३४५६७८९', '0123456789')"


def native(x: str) -> str:
    return f"translate({x}, '0123456789', '०१२३४५६७८९')"


def has(c: str, words: str) -> str:
    """Whether c contains any of the words, which bars part."""
    return "(" + " OR ".join(f"contains({c}, {q(w)})" for w in words.split("|")) + ")"


def word(c: str, words: str) -> str:
    return f"regexp_matches({c}, '(^|[^\\p{{L}}\\p{{N}}_])({words})($|[^\\p{{L}}\\p{{N}}_])')"


def among(x: str, words: str) -> str:
    return f"{x} IN ({', '.join(map(q, words.split('|')))})"


def found(c: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({c}, '{pattern}', {group})"


def minus(a: str, b: str) -> str:
    return f"list_distinct(list_filter({a}, lambda x: NOT list_contains({b}, x)))"


def some(cond: str) -> str:
    return f"({cond})::INT"


def n_of(c: str, ch: str) -> str:
    return f"(length({c}) - length(replace({c}, {q(ch)}, '')))"


def numbers(c: str) -> str:
    return f"list_distinct(list_transform({found(c, NUMBER)}, lambda x: {ascii_('x')}))"


def latin(c: str) -> str:
    """Latin tokens; letters and digits of other scripts become a word character that is none of theirs."""
    return found(f"regexp_replace({c}, '[ªµºÀ-ÖØ-öø-ˁͰ-ͳΆΈ-ҁҊ-ԯԱ-Ֆա-ֈऄ-हऽॐक़-ॡ०-९ॲ-ॿḀ-ỿ０-９Ａ-Ｚａ-ｚ]', '_', 'g')", r"\b[A-Za-z][A-Za-z-]+\b")


def words(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '{SPACE}+'), lambda x: x <> '')"


def neighbours(c: str) -> str:
    w = f"list_filter({words(c)}, lambda x: length(x) > 1)"
    return f"coalesce(list_bool_or(list_transform(range(1, len({w})), lambda i: ({w})[i] = ({w})[i + 1])), false)"


def name(c: str) -> str:
    return f"(len({words(c)}) BETWEEN 2 AND 3 AND len(list_filter({words(c)}, lambda x: NOT regexp_full_match(x, '[A-Z][a-z]+') OR {among('x', NO_NAMES)})) = 0)"


NO_NAMES = "Applicant|Application|Certificate|Citizenship|Date|District|Fee|Form|ID|Municipality|Name|Office|Phone|Reference|Request|Residence|Service|Ward|Call|Card|Fees|NPR|Total|Amount|Price"
LABELS = [("signature|signed", "हस्ताक्षर|दस्तखत"), ("stamp|seal", "छाप|मोहर|लाहा"), ("verified|certified", "रुजु प्रमाणित|प्रमाणित"), ("official|authorized", "आधिकारिक|अधिकृत"), ("ward", "वडा"), ("house", "घर"), ("no|number", "नं|नम्बर")]
MONEY = [("$|usd|dollar", "डलर|अमेरिकी डलर"), ("rs|npr|rupee", "रु|रुपैयाँ|नेपाली रुपैयाँ|एनपीआर|रुपैया")]
FLOW = [("however|but|yet|nevertheless", "तर|यद्यपि|तापनि"), ("therefore|so|consequently|thus", "तसर्थ|त्यसैले|अतः"), ("because|since|as", "किनभने|कारण|ले गर्दा")]
MODALS = [("must|shall|should|mandatory", "पर्नेछ|अनिवार्य|हुनुपर्छ"), ("may|can|permissible", "सक्नेछ|मन्जुरी|पाउनेछ")]
NO_WORDS = "not|no|never|none|neither|nor|cannot|don't|can't|won't"


def forms(e: str) -> str:
    """Spellings in which an entity counts as kept."""
    text, n = f"coalesce({e}.text, '')", ascii_(f"regexp_extract({e}.text, '{NUMBER}')")
    both = f"[{text}, {native(text)}]"
    money = f"list_concat({both}, [" + ", ".join(f"{q(x)} || {native(n)}" for x in ("NPR ", "रु ", "रु. ", "एनपीआर ", "रुपैया ")) + "])"
    ward = f"list_concat({both}, [" + ", ".join(f"{q(x)} || {y}" for x in ("वडा नं. ", "वडा नम्बर ") for y in (native(n), n)) + "])"
    # The forms of a ward come in the order of label, then script.
    return f"CASE WHEN {e}.kind = 'office' THEN [coalesce(nullif({e}.target_term, ''), {text})] WHEN {e}.kind IN ('url', 'email', 'phone', 'id') THEN [{text}] WHEN {e}.kind = 'money' AND {n} <> '' THEN {money} WHEN {e}.kind = 'ward' AND {n} <> '' THEN {ward} ELSE {both} END"


def kept(e: str, t: str, ta: str) -> str:
    own = numbers(f"coalesce({e}.text, '')")
    return f"CASE WHEN {e}.kind = 'number' THEN len({own}) > 0 AND len({minus(own, numbers(t))}) = 0 ELSE len(list_filter({forms(e)}, lambda v: contains({ta}, {ascii_(shown('v'))}))) > 0 END"


def _state(e: str) -> tuple[str, str]:
    """Conditions of an entity far from its place, and in a foreign script."""
    hit = f"list_filter(list_transform({forms(e)}, lambda v: {shown('v')}), lambda v: v <> '' AND contains(td, v))"
    text = f"coalesce({e}.text, '')"
    at = f"(CASE WHEN len({hit}) > 0 THEN instr(td, ({hit})[1]) ELSE instr(ta, {ascii_(text)}) END - 1)"
    told = f"{text} <> '' AND t <> ''"
    far = f"({told} AND {at} >= 0 AND abs(coalesce({e}.start, 0) / coalesce(nullif({e}.segment_source_len, 0), nullif(length(t), 0), 100) - {at} / greatest(length(td), 1)) > CASE WHEN length(td) < 60 THEN 0.75 ELSE 0.6 END)"
    foreign = f"({told} AND CASE WHEN len({hit}) > 0 THEN NOT regexp_matches(({hit})[1], '[ऀ-ॿ]') AND {native(f'({hit})[1]')} <> ({hit})[1] AND {e}.kind NOT IN ('url', 'email', 'phone', 'id') ELSE {at} >= 0 AND {native(text)} <> {text} END)"
    return far, foreign


def _near(c: str) -> str:
    """Numbers of a display form with the words within fifteen characters."""
    nums, parts = found(c, NUMBER), f"string_split_regex({c}, '{NUMBER}')"
    before = f"(array_to_string(list_transform(range(1, k), lambda j: ({parts})[j] || ({nums})[j]), '') || ({parts})[k])"
    around = f"right({before}, 15) || ' ' || left(substr({c}, length({before}) + length(({nums})[k]) + 1), 15)"
    return f"list_transform(range(1, len({nums}) + 1), lambda k: {{'n': {ascii_(f'({nums})[k]')}, 'w': {found(f'({around})', '[^\\p{Nd}' + SPACE[1:-1] + ']{2,}')}}})"


def _swaps() -> str:
    own = "list_distinct(list_transform(ns, lambda c: c.n))"
    moved = " OR ".join(
        f"(len(list_filter(ns, lambda c: c.n = m AND len(list_filter(c.w, lambda x: {among('lower(x)', a)})) > 0)) > 0 AND len(list_filter(nt, lambda c: c.n <> m AND len(list_filter(c.w, lambda x: {among('x', b)})) > 0)) > 0)" for a, b in LABELS
    )
    return f"CASE WHEN len({own}) < 2 THEN 0 ELSE len(list_filter({own}, lambda m: len(list_filter(nt, lambda c: c.n = m)) > 0 AND ({moved}))) END"


def _values(c: str, labels: str) -> str:
    return "list_distinct(list_concat(" + ", ".join(f"list_transform({found(c, f'(?:^|[^\\p{{L}}\\p{{N}}_]){w}\\.?{SPACE}*([0-9०-९]+)', 1)}, lambda x: {ascii_('x')})" for w in labels.split("|")) + "))"


def _negatives(c: str) -> str:
    prefixed = "regexp_matches(x, '^(un|in|im|dis|non|ir|mis|anti|de)') AND length(x) > 4"
    harmless = "instruction|information|important|interest|industry|individual|increase|include|indeed|inside|insight|inspect|install|instead|intend|intensity|interview|instrument|instance|incident|input|income|invite"
    return f"len(list_filter({words(c)}, lambda x: {among('x', NO_WORDS)} OR ({prefixed} AND NOT {among('x', harmless)})))"


def _money(k: int, a: str, b: str) -> str:
    lost = f"(NOT {has('tl', b)} AND NOT {has('tl', a)})"
    foreign = f"({has('tl', a)} AND NOT {has('tl', b)} AND lang <> 'en')"
    return f"({has('sl', a)} AND " + (lost if k == 0 else foreign if k == 1 else f"NOT {lost} AND NOT {foreign} AND lang <> 'en' AND {has('tl', 'एनपीआर|रुपैया')}") + ")"


def _total(conds: list[str]) -> str:
    return " + ".join(map(some, conds))


def _names(c: str) -> str:
    return f"list_filter({latin(c)}, lambda x: NOT {among('x', NO_NAMES)})"


_present = f"list_filter({_names('s')}, lambda x: contains(td, x) OR contains(td, lower(x)))"
_placed = f"list_transform(list_sort(list_transform(list_filter({_present}, lambda x: contains(td, x)), lambda x: {{'a': instr(td, x), 'x': x}})), lambda y: y.x)"
_masked = "array_to_string(list_transform(range(1, length(s) + 1), lambda i: CASE WHEN len(list_filter(e, lambda x: x.start < i AND i <= x.\"end\")) > 0 THEN '_' ELSE substr(s, i, 1) END), '')"
_known = f"list_concat(['http', 'https', 'example', 'www'], flatten(list_transform(h, lambda x: {latin('lower(x.source_term)')})), flatten(list_transform(e, lambda x: {latin('lower(x.text)')})))"
_tokens = f"list_filter({latin(_masked)}, lambda x: contains(tp, lower(x)) AND NOT list_contains({_known}, lower(x)))"
_symbols = lambda c: found(c, r"[@#$%^&*_=+|\\<>]")
_marks = lambda c: f"len({found(c, '[•\\-*|:]')})"
_dates = lambda c: f"len({found(ascii_(c), '[0-9]{1,4}[-./][0-9]{1,2}[-./][0-9]{1,4}')})"
_count = lambda c: f"len({found(c, WORD + '+')})"
_holders = lambda c: found(c, r"\{\{[^}]+\}\}|\{[^}]+\}|\[[A-Z_]+\]")
_markers = lambda c: f"list_filter(list_transform({found(c, f'(?:^|[^\\p{{L}}\\p{{N}}_])(\\p{{Nd}}+)\\.{SPACE}', 1)}, lambda x: {ascii_('x')}::HUGEINT), lambda x: x < 100)"
_exempt = "coalesce(list_sum(list_transform(h, lambda x: CASE WHEN regexp_matches(x.target_term, '[A-Za-z]') THEN length(x.target_term) ELSE 0 END)), 0) + coalesce(list_sum(list_transform(e, lambda x: CASE WHEN x.kind IN ('url', 'email') THEN length(x.text) ELSE 0 END)), 0)"
_latin_letters = "length(regexp_replace(t, '[^A-Za-z]', '', 'g'))"
_no_number = f"lower(regexp_replace(s, '(^|[^\\p{{L}}\\p{{N}}_])no\\.?{SPACE}*\\p{{Nd}}+', '\\1 ', 'gi'))"
_ghosts = minus(latin("tl"), f"list_concat({latin('sl')}, ['translate', 'nepali', 'language', 'following', 'below', 'text', 'sure', 'okay'])")
_ghosts = f"list_filter({_ghosts}, lambda x: NOT (lang = 'en' AND regexp_matches(s, '[ऀ-ॿ]')) OR (length(x) >= 4 AND NOT {among('upper(x[1]) || x[2:]', NO_NAMES)}))"
_run = f"regexp_extract((lw)[i], '{WORD}+$')"
_repeated = f"len(list_filter(range(1, len(lw) - 2), lambda i: {_run} <> '' AND (lw)[i + 1] = {_run} AND (lw)[i + 2] = {_run} AND starts_with((lw)[i + 3], {_run})))"
_far, _foreign = _state("x")

STRUCTURE = {
    "length_deviation": some("length(ts) / greatest(length(ss), 1) < 0.35 OR length(ts) / greatest(length(ss), 1) > 3.0"),
    "hallucination_repetition": some(f"{neighbours('t')} AND NOT {neighbours('s')}"),
    "punctuation_mismatch": _total([f"{n_of('s', a)} <> {n_of('t', a)} OR {n_of('s', b)} <> {n_of('t', b)}" for a, b in ("()", "[]", "{}")] + [f"{n_of('s', chr(34))} % 2 <> {n_of('t', chr(34))} % 2"]),
    "symbol_leak": some(f"len({minus(_symbols('t'), _symbols('s'))}) > 0"),
    "script_imbalance": some(f"regexp_matches(t, '[ऀ-ॿ]') AND length(t) > 20 AND greatest(0, {_latin_letters} - ({_exempt})) / length(t) > 0.35"),
    "word_repetition": some(f"{_repeated} > 0"),
    "markup_mismatch": some(f"{_marks('s')} <> {_marks('t')}"),
    "major_omission": some(f"{_count('s')} > 10 AND {_count('t')} / {_count('s')} < 0.4"),
    "major_addition": some(f"{_count('s')} > 10 AND {_count('t')} / {_count('s')} > 2.5"),
    "placeholder_broken": some(f"len({minus(_holders('s'), _holders('t'))}) > 0"),
    "unicode_sanitized": some(f"regexp_replace({compatible('t')}, '[^\\PC\\n\\r\\t]', '', 'g') <> t"),
    "ai_filler": some(has("substr(tl, 1, 50)", "here is the|sure,|translation:|translated text:")),
}
NUMBERS = {
    "changed_number": some(f"len({minus(numbers('s'), numbers('t'))}) > 0"),
    "number_swap": _swaps(),
    "date_mismatch": some(f"{_dates('s')} <> {_dates('t')}"),
    "list_sequence_broken": some(f"len({_markers('s')}) > 0 AND len({_markers('t')}) > 0 AND {_markers('s')} <> {_markers('t')}"),
    "anchor_mismatch": _total([f"len({_values('sl', a)}) > 0 AND len({_values('td', b)}) > 0 AND list_sort({_values('sl', a)}) <> list_sort({_values('td', b)})" for a, b in (("ward", "वडा"), ("house", "घर"), ("no|number", "नं|नम्बर|संख्या"))]),
    "date_conversion_risk": some(f"{word('s', '20[0-2][0-9]')} AND {word(ascii_('t'), '20[7-9][0-9]')}"),
    "spacing_standard": some("regexp_matches(t, '[रु$][०-९0-9]')"),
    "abbreviation_standard": some(f"regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_])न{SPACE}*[०-९0-9]')"),
}
LEXICON = {
    "negation_flip": some(f"len(list_filter({found(_no_number, WORD + '+')}, lambda x: {among('x', NO_WORDS)})) > 0 AND NOT {has('t', 'छैन|हुँदैन|नगर्नु|नगर|नाईं|होइन|छैनन्|हुन्न|थिएन')}"),
    "honorific_inconsistency": some(f"{has('t', 'तपाईं|हुनुहुन्छ|होला|गर्नुहोस्|पाल्नुहोस्')} AND {has('t', 'तँ|तिमी|छौ|गछौ|गरे|गर')}"),
    "instruction_leak": some(f"len(list_filter(({found('tl', '[a-z]{4,}')})[1:5], lambda x: {among('x', 'translate|nepali|language|following|below|text|sure|okay')})) > 0"),
    "directional_flip": _total([f"{has('sl', 'increase|rise|gain|profit|up')} AND {has('t', 'घट्नु|घाटा|कम|तल')}", f"{has('sl', 'decrease|fall|loss|down')} AND {has('t', 'बढ्नु|नाफा|बढी|माथि')}"]),
    "currency_missing": _total([_money(0, *m) for m in MONEY]),
    "currency_unlocalized": _total([_money(1, *m) for m in MONEY]),
    "currency_suboptimal": _total([_money(2, *m) for m in MONEY]),
    "forbidden_term": _total([word("t", "कागज"), word("t", "(?i:citizenship paper)")]),
    "logical_flow_broken": _total([f"{word('sl', a)} AND NOT {has('td', b)}" for a, b in FLOW]),
    "missing_landmark": _total([f"{has('sl', '|'.join(f'[{w}]|({w})' for w in a.split('|')))} AND NOT {has('td', b)}" for a, b in LABELS]),
    "certification_missing": some(f"{has('sl', 'verified|certified')} AND NOT contains(t, 'प्रमाणित')"),
    "anachronism_risk": _total([has("sl", "vdc|village development committee"), has("sl", "zonal|zone")]),
    "legal_modal_flip": _total([f"{word('sl', MODALS[i][0])} AND {has('td', MODALS[1 - i][1])} AND NOT {has('td', MODALS[i][1])}" for i in (0, 1)]),
    "untranslated_legalism": _total([word("tl", w) for w in ("subpoena", "indemnity", "habeas corpus", "tort", "affidavit")]),
    "legal_anchor_missing": _total([f"{has('sl', 'provided that|subject to')} AND NOT {has('td', 'बशर्ते|अधिनमा')}", f"{has('sl', 'notwithstanding|regardless')} AND NOT {has('td', 'तापनि|वावजुद')}"]),
    "polarity_flip": some(f"{_negatives('sl')} % 2 <> len(list_filter({words('tl')}, lambda x: {among('x', 'छैन|हुँदैन|नगर्नु|नगर|नाईं|होइन|छैनन्|हुन्न|थिएन')})) % 2"),
}
ENTITIES = {
    "changed_protected_entity": f"len(list_filter(e, lambda x: NOT {kept('x', 't', 'ta')}))",
    "position_shift": f"len(list_filter(e, lambda x: {_far}))",
    "script_mismatch": f"len(list_filter(e, lambda x: {_foreign}))",
    "glossary_miss": "len(list_filter(h, lambda x: NOT contains(t, x.target_term)))",
    "untranslated_token": some(f"len({_tokens}) > 0 AND NOT (ss = ts AND {name('s')})"),
    "untranslated_segment": some(f"ss = ts AND length(ss) > 3 AND NOT coalesce(len(e) = 1 AND length(ts) < length(e[1].text) + 5 AND e[1].kind IN ('url', 'email', 'phone', 'id'), false) AND NOT {name('s')} AND len({latin('t')}) > 0"),
    "identity_swap": some(f"len(list_distinct({_names('s')})) >= 2 AND len({_present}) >= 2 AND len({_placed}) = len({_present}) AND {_placed} <> {_present}"),
    "transliteration_drift": some(f"len(list_filter({_names('s')}, lambda x: length(s) - length(replace(s, x, '')) >= 2 * length(x))) > 0 AND len(list_distinct({found('t', '[ऀ-ॿ]{3,}')})) >= 2"),
    "ghost_entity": some(f"len({_ghosts}) > 0"),
}


def pairs(text: str = "candidate_text", lang: str = "coalesce(d.target_lang, 'en')") -> str:
    """Common table expressions that end in p: the parts of each pair of a segment and a text of its translation."""
    return f"""p0 AS (SELECT s.id, s.document_id, coalesce(s.source_text, '') AS s, coalesce(t.{text}, '') AS t, lower({lang}) AS lang, coalesce(s.protected_entities, []) AS e, coalesce(s.glossary_hits, []) AS h
  FROM segments s JOIN translations t ON t.segment_id = s.id LEFT JOIN document_summary d ON d.id = s.document_id),
p1 AS MATERIALIZED (SELECT *, lower(s) AS sl, lower(t) AS tl, {strip('s')} AS ss, {strip('t')} AS ts, {shown('s')} AS sd, {shown('t')} AS td, {words('lower(t)')} AS lw FROM p0),
p AS MATERIALIZED (SELECT *, lower(td) AS tp, {ascii_('td')} AS ta, {_near('sd')} AS ns, {_near('td')} AS nt FROM p1)"""


def counts(rules: dict[str, str]) -> str:
    """How often each of the rules fires for each pair."""
    listed = ", ".join(f"{{'code': '{code}', 'n': ({n})::INTEGER}}" for code, n in rules.items())
    return f"WITH {pairs()} SELECT id, x.code AS code, x.n AS n FROM (SELECT id, unnest([{listed}]) AS x FROM p) WHERE x.n > 0"


ALL = {**STRUCTURE, **NUMBERS, **LEXICON, **ENTITIES}
SCORED = f"WITH {pairs()} SELECT id, CASE WHEN ts = '' AND ss <> '' THEN 10.0 ELSE ({' + '.join(f'({n})' for n in ALL.values())})::DOUBLE END AS risk_score FROM p"
EFFECTIVE = strip("coalesce(nullif(t.approved_text, ''), t.candidate_text, '')")
PRESERVED = f"""WITH x AS (SELECT s.id, s.document_id, s.status, t.status AS t_status, len(t.risk_reasons) AS n_reasons, coalesce(s.protected_entities, []) AS e, {EFFECTIVE} AS t FROM segments s LEFT JOIN translations t ON t.segment_id = s.id),
y AS MATERIALIZED (SELECT *, {ascii_(shown('t'))} AS ta FROM x)
SELECT document_id, count(*) AS total, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (t_status = 'memory_applied') AS memory_reused,
  sum(CASE WHEN coalesce(t, '') <> '' THEN len(e) ELSE 0 END)::BIGINT AS protected_total, sum(CASE WHEN coalesce(t, '') <> '' THEN len(list_filter(e, lambda x: {kept('x', 't', 'ta')})) ELSE 0 END)::BIGINT AS protected_preserved,
  count(*) FILTER (status <> 'approved' AND n_reasons > 0) AS unresolved FROM y GROUP BY document_id"""


def reviewed(text: str, columns: str, where: str, join: str = "") -> str:
    """Outcomes of review requests with a text of each pair, scored as for an English target."""
    source = {"candidate_text": "t.candidate_text", "after_text": "ev.after_text"}[text]
    base = f"""p0 AS (SELECT s.id, s.document_id, s.status, coalesce(s.source_text, '') AS s, {source} AS raw, {strip(f"coalesce({source}, '')")} AS t, 'en' AS lang, coalesce(s.protected_entities, []) AS e, coalesce(s.glossary_hits, []) AS h
  FROM segments s JOIN translations t ON t.segment_id = s.id {join} WHERE {where})"""
    rest = pairs().split("p1 AS", 1)[1]
    score = f"CASE WHEN ts = '' THEN NULL ELSE ({' + '.join(f'({n})' for n in ALL.values())})::DOUBLE END"
    return f"WITH {base}, p1 AS{rest}, z AS (SELECT *, {score} AS score FROM p) SELECT id AS segment_id, score AS risk_score, {columns} FROM z"


def settled_here(structural: str, scoped: str) -> str:
    """Labels scored for their document's target language, and what the memory has."""
    base = f"""{scoped}, l AS (SELECT *, {structural} AS label, lower({shown('source_text')}) AS key FROM scoped),
a AS (SELECT * FROM memory_entries WHERE is_active QUALIFY row_number() OVER (PARTITION BY source_lang, target_lang, domain, subdomain, normalized_source ORDER BY coalesce(approved_at, TIMESTAMP '1970-01-01') DESC, id DESC) = 1),
p0 AS (SELECT id, document_id, source_text AS s, label AS t, lower(target_lang) AS lang, list_transform(coalesce(protected_entities, []), lambda x: {{'kind': x.kind, 'text': x.text, 'start': x.start, 'end': x."end", 'target_term': x.target_term, 'segment_source_len': length(source_text)}}) AS e, coalesce(glossary_hits, []) AS h FROM l WHERE label IS NOT NULL)"""
    rest = pairs().split("p1 AS", 1)[1]
    return f"""WITH {base}, p1 AS{rest}, z AS (SELECT *, CASE WHEN ts = '' AND ss <> '' THEN 10.0 ELSE ({' + '.join(f'({n})' for n in ALL.values())})::DOUBLE END AS score FROM p)
SELECT id, t AS text, 'preserved' AS source_type, score AS risk_score, CASE WHEN score > 0 THEN 'needs_review' ELSE 'pending' END AS status, CASE WHEN score > 0 THEN 'needs_review' ELSE 'candidate' END AS translation_status, t <> s AS is_repaired FROM z
UNION ALL SELECT l.id, a.target_text, 'memory', 0.0, 'approved', 'memory_applied', false FROM l JOIN a ON a.source_lang = l.source_lang AND a.target_lang = l.target_lang AND a.domain = l.domain AND a.subdomain = l.subdomain AND a.normalized_source = l.key WHERE label IS NULL"""


_BANK = [
    ("title", "Certificate of Residence Request", "बसोबास प्रमाणपत्र अनुरोध", "चिबा ह्रिबाला प्रमाणस्यो"), ("submit_form", "Please submit this form to the Ward Office.", "कृपया यो फारम वडा कार्यालयमा बुझाउनुहोस्।", "चु फाराम वडा गेदिमरि पेस लास्ह्युगो।"),
    ("review_within_days", "The Municipality will review the application within 7 days.", "नगरपालिकाले आवेदन ७ दिनभित्र समीक्षा गर्नेछ।", "नगरपालिकासे ७ रे न्हाङरि स्ह्युसेनला समीक्षा लासेला मुला।"), ("ward_verify", "Ward No. 4 will verify the address.", "वडा नं. ४ ले ठेगाना प्रमाणित गर्नेछ।", "वडा नं. ४ से ठेगाना प्रमाणित लासेला मुला।"),
    ("visit_updates", "Visit https://municipality.example.gov for updates.", "अपडेटका लागि https://municipality.example.gov हेर्नुहोस्।", "अद्यावधिकला लागिरि https://municipality.example.gov निगो।"), ("applicant_name", "Applicant Name", "निवेदकको नाम", "स्ह्युसेन पिन्बा मिन"),
    ("phone", "Phone", "फोन", "फोन लाबा"), ("date", "Date", "मिति", "कुनु"), ("reference_id", "Reference ID", "सन्दर्भ आईडी", "सन्दर्भ ङोसेबास्यो"), ("fee_500", "Fee: NPR 500", "शुल्क: NPR ५००", "शुल्क: NPR ५००"),
]
_BANK_ROWS = ", ".join(f"({q(k)}, {q(lang)}, {q(x)})" for k, *by in _BANK for lang, x in zip(("en", "ne", "tmg"), by, strict=True))
DETERMINISTIC = rf"""WITH bank(key, lang, phrase) AS (VALUES {_BANK_ROWS}),
w AS (SELECT s.id, s.source_text, {strip('s.source_text')} AS x, lower({shown('s.source_text')}) AS plain, d.source_lang, d.target_lang FROM segments s JOIN document_summary d ON d.id = s.document_id),
k AS (SELECT w.*, (SELECT min(key) FROM bank WHERE lang = w.source_lang AND lower(phrase) = w.plain) AS key FROM w),
f AS (SELECT k.*, (SELECT min(phrase) FROM bank b WHERE b.key = k.key AND b.lang = k.target_lang) AS phrase, {ascii_('x')} AS a FROM k),
h AS (SELECT *, CASE WHEN phrase IS NOT NULL THEN 'phrase' WHEN regexp_matches(x, '^[0-9०-९]{{4}}[-/][0-9०-९]{{2}}[-/][0-9०-९]{{2}}$') THEN 'date' WHEN regexp_matches(x, '(?i)^(NPR|Rs\.?|रु\.?|\$)\s?[0-9०-९][0-9०-९,]*(\.[0-9]+)?$') THEN 'money'
  WHEN regexp_matches(x, '^\+?[0-9०-९][0-9०-९\-\s]{{7,}}$') THEN 'phone' WHEN regexp_matches(a, '^[A-Z]{{2,}}(-[A-Z0-9]{{2,}})+$') THEN 'reference' ELSE 'echo' END AS how FROM f)
SELECT id, how, CASE how WHEN 'phrase' THEN phrase WHEN 'reference' THEN a WHEN 'echo' THEN source_text ELSE CASE WHEN target_lang = 'en' THEN a ELSE {native('a')} END END AS translated_text FROM h"""


def language(weights: dict[str, dict[str, float]], shared: list[str]) -> str:
    """The suggestion of each document's language; the weights are the table of values that both sides are given."""
    rows = ", ".join(f"({q(lang)}, {q(token)}, {round(w * 100)})" for lang, by in weights.items() for token, w in by.items() if token not in shared)
    phrases = lambda lang: [x[{"en": 1, "ne": 2, "tmg": 3}[lang]].lower() for x in _BANK[:5]]
    said = lambda lang, c: " + ".join(f"CASE WHEN contains({c}, {q(x)}) THEN 600 ELSE 0 END" for x in phrases(lang))
    bonus = "CASE WHEN latin >= 18 AND latin > 1.5 * native THEN 400 WHEN latin > 0 AND native = 0 THEN 250 ELSE 0 END"
    total = lambda lang: f"coalesce(list_sum(list_transform(tokens, lambda t: coalesce(m_{lang}[t], 0))), 0) + {said(lang, 'plain')}" + (f" + {bonus}" if lang == "en" else "")
    scored = lambda source: f"SELECT *, ({total('en')})::BIGINT AS en, ({total('ne')})::BIGINT AS ne, ({total('tmg')})::BIGINT AS tmg FROM (SELECT *, lower({shown('text')}) AS plain, regexp_extract_all(lower({shown('text')}), '[A-Za-z]+|[ऀ-ॿ]+') AS tokens, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin, length(regexp_replace(text, '[^ऀ-ॿ]', '', 'g')) AS native FROM {source}), maps"
    best = "greatest(en, ne, tmg)"
    top = f"CASE {best} WHEN en THEN 'en' WHEN ne THEN 'ne' ELSE 'tmg' END"
    lead = f"({best} - list_sort([en, ne, tmg])[2])"
    maps = ", ".join(f"map_from_entries(list({{'k': token, 'v': w}}) FILTER (lang = {q(x)})) AS m_{x}" for x in ("en", "ne", "tmg"))
    return f"""WITH weights(lang, token, w) AS (VALUES {rows}), maps AS (SELECT {maps} FROM weights),
n AS (SELECT document_id, source_text AS text, row_number() OVER (PARTITION BY document_id ORDER BY sequence, id) AS n, count(*) OVER (PARTITION BY document_id) AS segment_count FROM segments),
f AS (SELECT * FROM n WHERE n <= 12), j AS (SELECT document_id, string_agg(text, ' ' ORDER BY n) AS text, any_value(segment_count) AS segment_count FROM f GROUP BY 1),
w AS (SELECT *, latin > 0 AND native = 0 AS only_latin, native > 0 AND ({best} >= 800 AND {lead} >= 400) AS strong, native > 0 AND ({best} >= 400 AND {lead} >= 150) AS likely, {top} AS best FROM ({scored('j')})),
v AS (SELECT document_id, {top} AS lang, count(*) AS votes FROM ({scored('f')}) WHERE {best} >= 300 AND {lead} >= 150 GROUP BY 1, 2)
SELECT o.document_id, detected, confidence, coalesce(votes, 0) AS votes, segment_count FROM (SELECT document_id, segment_count, CASE WHEN only_latin THEN 'en' WHEN strong OR likely THEN best END AS detected,
  CASE WHEN only_latin AND latin >= 18 THEN 'high' WHEN only_latin THEN 'medium' WHEN strong THEN 'high' WHEN likely THEN 'medium' ELSE 'low' END AS confidence FROM w) o LEFT JOIN v ON v.document_id = o.document_id AND v.lang = o.detected"""


CHATTER = ["Sure, here is the translation:", "Sure, here's the translation:", "Translation:", "Translated text:", "Here is the translation in Nepali:", "Sure!", "Okay,"]


def without_chatter(c: str, source: str) -> str:
    """Common table expressions c0 to c7 over a table (id, c and more): each takes one opening away."""
    out = [f"c0 AS (SELECT * REPLACE ({strip(c)} AS {c}) FROM {source})"]
    for k, x in enumerate(CHATTER, 1):
        rest = strip(f"substr({c}, {len(x) + 1})")
        bare = f"CASE WHEN {rest} = chr(34) THEN '' WHEN starts_with({rest}, chr(34)) AND ends_with({rest}, chr(34)) THEN {strip(f'substr({rest}, 2, length({rest}) - 2)')} ELSE {rest} END"
        out.append(f"c{k} AS (SELECT * REPLACE (CASE WHEN starts_with(lower({c}), {q(x.lower())}) THEN {bare} ELSE {c} END AS {c}) FROM c{k - 1})")
    return ", ".join(out)


def _once(c: str, pattern: str) -> str:
    """Without the second of the first two equal neighbours of a kind."""
    w = words(c)
    at = f"list_filter(range(1, len({w})), lambda i: ({w})[i] = ({w})[i + 1] AND regexp_full_match(({w})[i], '{pattern}'))"
    return f"CASE WHEN len({at}) > 0 THEN array_to_string(list_transform(list_filter(range(1, len({w}) + 1), lambda i: i <> ({at})[1] + 1), lambda i: ({w})[i]), ' ') ELSE {c} END"


_NE = "replace(replace(replace(text, 'एनपीआर', 'रु'), 'एन.पी.आर.', 'रु'), 'रुपैया', 'रु')"
_NE = f"regexp_replace({_NE}, '(^|[ऀ-ॿ]|{SPACE})NPR{SPACE}*([०-९0-9])', '\\1रु \\2', 'g')"
_NE = f"regexp_replace({_NE}, '([रु$])([०-९0-9])', '\\1 \\2', 'g')"
_NE = f"regexp_replace({_NE}, '(^|[^\\p{{L}}\\p{{N}}_])न{SPACE}+([०-९0-9])', '\\1नं. \\2', 'g')"
_EN = f"regexp_replace({ascii_("replace(replace(text, 'रु', 'NPR'), 'एनपीआर', 'NPR')")}, '(NPR|Rs\\.?)([0-9])', '\\1 \\2', 'g')"
def styled(source: str) -> str:
    """Common table expressions that end in z over a table (id, source_text, text, target_lang and more): z adds styled."""
    return f"""l AS MATERIALIZED (SELECT *, CASE lower(target_lang) WHEN 'ne' THEN {_NE} WHEN 'en' THEN {_EN} ELSE text END AS plain_style FROM {source}),
o AS MATERIALIZED (SELECT *, {_once('plain_style', '[ऀ-ॿ]+')} AS once FROM l),
z AS MATERIALIZED (SELECT *, CASE WHEN len({words('plain_style')}) <= 4 AND NOT {neighbours('lower(source_text)')} THEN trim(regexp_replace({_once('once', '[a-zA-Z]+')}, '{SPACE}+', ' ', 'g'), ' ') ELSE plain_style END AS styled FROM o)"""


HOUSE_STYLE = f"""WITH x AS (SELECT s.id, s.source_text, d.target_lang, t.candidate_text AS text FROM segments s JOIN document_summary d ON d.id = s.document_id JOIN translations t ON t.segment_id = s.id WHERE t.candidate_text IS NOT NULL), {without_chatter('text', 'x')},
{styled('c7')} SELECT id, text, styled FROM z WHERE text <> styled"""
TEXT_FUNCTIONS = rf"""SELECT id, {shown('source_text')} AS display, lower({shown('source_text')}) AS plain, regexp_replace({compatible('source_text')}, '[^\PC\n\r\t]', '', 'g') AS sanitised, regexp_matches(source_text, '[ऀ-ॿ]') AS native,
  array_to_string({latin('source_text')}, ' ') AS latin, array_to_string(list_sort({numbers('source_text')}), ' ') AS numbers, {name('source_text')} AS name_like, {neighbours('source_text')} AS repeats FROM segments"""
ENTITY_FORMS = f"""SELECT id, place::INTEGER AS place, kind, forms FROM (SELECT id, x.kind AS kind, array_to_string({forms('x')}, '|') AS forms, place - 1 AS place FROM (SELECT id, unnest(protected_entities) AS x, generate_subscripts(protected_entities, 1) AS place FROM segments))"""
ENTITY_STATES = f"""WITH {pairs()}, u AS (SELECT id, t, td, ta, unnest(e) AS x, generate_subscripts(e, 1) AS place FROM p)
SELECT id, (place - 1)::INTEGER AS place, {kept('x', 't', 'ta')} AS kept, {_far} AS shifted, {_foreign} AS foreign_script FROM u"""
_LINES = """SELECT document_id, loc.page_index AS page, loc.block_index AS block, loc.line_index AS line, source_text AS t, loc.x0 AS x0, loc.y0 AS y0, loc.x1 AS x1, loc.y1 AS y1, loc.font_size AS font
  FROM (SELECT document_id, source_text, location AS loc, location.kind AS kind FROM segments) WHERE kind = 'pdf_line' AND trim(source_text) <> ''"""
_ALONE = lambda c: f"(trim({c}) = '' OR regexp_matches(trim({c}), '^#?\\p{{Nd}}+$') OR (regexp_matches(trim({c}), '^[. ·•\\-–—]+$') AND regexp_matches({c}, '[.·•]')))"
_NEW = f"(NOT r.open OR {_ALONE('l.t')} OR l.page <> r.page OR r.n_lines >= 24 OR r.chars + length(l.t) > 2800 OR l.y0 - r.y1 > 50 OR (abs(l.x0 - r.x0) > 90 AND l.y0 - r.y1 > 0.7 * coalesce(r.font, 0)))"
PAGE_LINES = f"""WITH l AS MATERIALIZED ({_LINES}) SELECT document_id AS doc_id, (row_number() OVER (PARTITION BY document_id ORDER BY page, block, line))::INTEGER AS region_id, 'pdf_line' AS segment_type, t AS text, 1 AS line_count FROM l QUALIFY count(*) OVER (PARTITION BY document_id) <= 180"""
PAGE_REGIONS = f"""WITH RECURSIVE l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page, block, line) AS n FROM ({_LINES})),
r AS (SELECT document_id, n, 1 AS region, 1 AS n_lines, length(t) AS chars, NOT {_ALONE('t')} AS open, page, x0, y0, x1, y1, font, t FROM l WHERE n = 1
  UNION ALL SELECT l.document_id, l.n, r.region + {_NEW}::INT, CASE WHEN {_NEW} THEN 1 ELSE r.n_lines + 1 END, CASE WHEN {_NEW} THEN length(l.t) ELSE r.chars + length(l.t) END, NOT {_ALONE('l.t')}, l.page, l.x0, l.y0, l.x1, l.y1, l.font, l.t
  FROM r JOIN l ON l.document_id = r.document_id AND l.n = r.n + 1)
SELECT document_id AS doc_id, region AS region_id, CASE WHEN count(*) = 1 THEN 'pdf_line' ELSE 'pdf_text_region' END AS segment_type, count(*)::INTEGER AS line_count,
  CASE WHEN count(*) = 1 THEN any_value(t) ELSE list_reduce(list({strip('t')} ORDER BY n), lambda a, b: CASE WHEN ends_with(a, '-') AND regexp_matches(b, '^\\p{{Ll}}') THEN left(a, length(a) - 1) || b ELSE a || ' ' || b END) END AS text, round(min(x0), 4) AS x0, round(min(y0), 4) AS y0, round(max(x1), 4) AS x1, round(max(y1), 4) AS y1 FROM r GROUP BY 1, 2"""
_BLOCKS = f"list_filter(list_transform(string_split_regex(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\n{SPACE}*\\n+'), lambda b: array_to_string(list_filter(list_transform(string_split(b, chr(10)), lambda y: {shown('y')}), lambda y: y <> ''), ' ')), lambda b: b <> '')"
TEXT_FILES = f"SELECT sha256(text) AS doc_id, unnest({_BLOCKS}) AS source_text, generate_subscripts({_BLOCKS}, 1)::INTEGER AS sequence FROM documents WHERE text IS NOT NULL"
TEXT_BLOCKS = f"SELECT doc_id, unnest({_BLOCKS}) AS source_text, generate_subscripts({_BLOCKS}, 1)::INTEGER AS sequence FROM documents WHERE text IS NOT NULL"
TABLE_FILES = f"""WITH x AS MATERIALIZED (SELECT s.document_id AS doc_id, s.location AS loc, s.location.kind AS kind, {shown(strip("coalesce(nullif(t.approved_text, ''), t.candidate_text, '')"))} AS v FROM segments s LEFT JOIN translations t ON t.segment_id = s.id)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY loc.row_index, loc.cell_index))::INTEGER AS sequence, v AS source_text, loc.row_index AS row_index, loc.cell_index AS cell_index FROM x WHERE kind = 'cell' AND v <> ''"""
DOCX_FILES = f"""WITH x AS MATERIALIZED (SELECT s.document_id AS doc_id, s.sequence, s.id, s.location.kind AS kind, s.source_text, {strip("coalesce(nullif(t.approved_text, ''), t.candidate_text, '')")} AS v FROM segments s LEFT JOIN translations t ON t.segment_id = s.id),
y AS (SELECT doc_id, sequence, id, {shown("CASE WHEN v <> '' THEN v ELSE source_text END")} AS t FROM x WHERE kind = 'paragraph')
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY sequence, id))::INTEGER AS sequence, t AS source_text FROM y WHERE t <> ''"""


_LETTERS = "[ªµºÀ-ÖØ-öø-ˁͰ-ͳΆΈ-ҁҊ-ԯԱ-Ֆա-ֈऄ-हऽॐक़-ॡॲ-ॿḀ-ỿＡ-Ｚａ-ｚ]"
_AS_WORD = lambda c: f"regexp_replace({c}, '{_LETTERS}', '_', 'g')"
#: Kinds in order of priority, each with the view of the text in which ASCII word borders are the right ones, and its pattern.
_KINDS = [
    ("email", "text", r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"), ("url", "text", rf"(?i:https?://(?:[^\s,;\x{{0B}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}])+)"),
    ("money", "wide", rf"(?i:NPR|Rs\.?|रु\.?|\$){SPACE}?[0-9][0-9,]*(?:\.[0-9]+)?"), ("date", "word", r"\b(?:[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}|[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4})\b"),
    ("ward", "word", rf"(?i:\bWard{SPACE}*(?:No\.?|Number)?{SPACE}*[-:]?{SPACE}*[0-9]+\b)"), ("id", "strict", rf"(?i:\b(?:ID|Ref|Reference|Citizenship){SPACE}*(?:ID|No\.?|Number)?{SPACE}*[-:]?{SPACE}*[A-Z0-9/-]*[0-9][A-Z0-9/-]+\b)"),
    ("id", "strict", r"\b[A-Z]{2,}(?:-[A-Z0-9]{2,})+\b"), ("phone", "digits", rf"(?:\+97{{2}}(?:-|{SPACE})?)?(?:[0-9](?:-|{SPACE})?){{7,12}}[0-9]"), ("number", "word", r"\b[0-9]+(?:[,.][0-9]+)*\b"),
]


def _spans(c: str, pattern: str) -> str:
    m, parts = f"regexp_extract_all({c}, '{pattern}')", f"string_split_regex({c}, '{pattern}')"
    before = f"(coalesce(list_sum(list_transform(range(1, k + 1), lambda j: length(({parts})[j]))), 0) + coalesce(list_sum(list_transform(range(1, k), lambda j: length(({m})[j]))), 0))::BIGINT"
    return f"list_transform(range(1, len({m}) + 1), lambda k: {{'a': {before}, 'b': {before} + length(({m})[k])}})"


def detected() -> str:
    """Entities of every segment: a match counts where none of an earlier pattern, nor an earlier one of its own, touches it."""
    views = f"""v0 AS MATERIALIZED (SELECT id, source_text AS text, {ascii_("source_text")} AS digits, translate({ascii_("source_text")}, '{_WIDE_DIGITS}', '0123456789') AS wide, {_AS_WORD(ascii_("source_text"))} AS word,
  {_AS_WORD("regexp_replace(source_text, '[०-९]', '_', 'g')")} AS strict, []::STRUCT(kind VARCHAR, a BIGINT, b BIGINT)[] AS found FROM segments WHERE source_text IS NOT NULL)"""
    steps = [
        f"v{k} AS MATERIALIZED (SELECT * REPLACE (list_concat(found, list_transform(list_filter({_spans(view, pattern)}, lambda s: len(list_filter(found, lambda f: f.a < s.b AND s.a < f.b)) = 0), lambda s: {{'kind': '{kind}', 'a': s.a, 'b': s.b}})) AS found) FROM v{k - 1})"
        for k, (kind, view, pattern) in enumerate(_KINDS, 1)
    ]
    return f"WITH {views}, {', '.join(steps)} SELECT id, f.kind AS kind, substr(text, f.a + 1, f.b - f.a) AS text, f.a::INTEGER AS start, f.b::INTEGER AS stop FROM (SELECT id, text, unnest(found) AS f FROM v{len(_KINDS)})"


def scoring(name: str, source: str, text: str, lang: str) -> str:
    """Common table expressions that end in name (id, score) over a table (id, source_text, e, h and more)."""
    return f"""{name}0 AS (SELECT id, source_text AS s, {text} AS t, lower({lang}) AS lang, e, h FROM {source}),
{name}1 AS MATERIALIZED (SELECT *, lower(s) AS sl, lower(t) AS tl, {strip('s')} AS ss, {strip('t')} AS ts, {shown('s')} AS sd, {shown('t')} AS td, {words('lower(t)')} AS lw FROM {name}0),
{name}2 AS MATERIALIZED (SELECT *, lower(td) AS tp, {ascii_('td')} AS ta, {_near('sd')} AS ns, {_near('td')} AS nt FROM {name}1),
{name} AS MATERIALIZED (SELECT id, CASE WHEN ts = '' AND ss <> '' THEN 10.0 ELSE ({' + '.join(f'({n})' for n in ALL.values())})::DOUBLE END AS score FROM {name}2)"""


def _fold(step: str, start: str) -> str:
    """A text that each entity changes in turn; step names the text acc.t and the entity's x.kind and x.own."""
    return f"list_reduce(list_transform(e, lambda y: {{'t': '', 'kind': y.kind, 'own': coalesce(y.text, '')}}), lambda acc, x: {{'t': {step}, 'kind': '', 'own': ''}}, {{'t': {start}, 'kind': '', 'own': ''}}).t"


def process_plain(structural: str, scoped: str) -> str:
    """Every segment prepared with the provider that needs no connection and without a repair."""
    local = settled_here(structural, scoped)
    digits = lambda c: f"regexp_replace({ascii_(c)}, '[^0-9]', '', 'g')"
    lost = f"NOT contains({ascii_('acc.t')}, {ascii_('x.own')})"
    taken = f"(x.kind IN ('phone', 'id') AND length(acc.t) < 2 * length(x.own)) OR ({digits('x.own')} <> '' AND contains({digits('acc.t')}, {digits('x.own')}) AND length(acc.t) < 1.5 * length(x.own))"
    restore = f"CASE WHEN x.kind NOT IN ('url', 'email', 'phone', 'id') OR x.own = '' THEN acc.t WHEN {lost} THEN CASE WHEN {taken} THEN x.own ELSE acc.t END WHEN x.kind IN ('url', 'email') THEN replace(acc.t, {native('x.own')}, x.own) ELSE acc.t END"
    latin = f"CASE WHEN x.kind IN ('url', 'email') AND x.own <> '' THEN replace(acc.t, {native('x.own')}, x.own) ELSE acc.t END"
    return f"""WITH {scoped}, lab AS (SELECT *, {structural} AS label, lower({shown('source_text')}) AS key FROM scoped),
act AS (SELECT * FROM memory_entries WHERE is_active QUALIFY row_number() OVER (PARTITION BY source_lang, target_lang, domain, subdomain, normalized_source ORDER BY coalesce(approved_at, TIMESTAMP '1970-01-01') DESC, id DESC) = 1),
wk AS MATERIALIZED (SELECT lab.id, lab.source_text, lab.target_lang, coalesce(det.translated_text, '') AS raw, {native('lab.source_text')} AS own, coalesce(glossary_hits, []) AS h,
  list_transform(coalesce(protected_entities, []), lambda x: {{'kind': x.kind, 'text': x.text, 'start': x.start, 'end': x."end", 'target_term': x.target_term, 'segment_source_len': length(lab.source_text)}}) AS e
  FROM lab JOIN ({DETERMINISTIC}) det ON det.id = lab.id LEFT JOIN act ON act.source_lang = lab.source_lang AND act.target_lang = lab.target_lang AND act.domain = lab.domain AND act.subdomain = lab.subdomain AND act.normalized_source = lab.key WHERE label IS NULL AND act.id IS NULL),
{scoring('sr', 'wk', 'raw', "'en'")}, {scoring('so', 'wk', 'own', "'en'")},
re AS MATERIALIZED (SELECT wk.*, sr.score AS raw_score, so.score AS own_score, {_fold(restore, 'raw')} AS restored FROM wk JOIN sr ON sr.id = wk.id JOIN so ON so.id = wk.id),
fi AS MATERIALIZED (SELECT *, CASE WHEN lower(target_lang) = 'en' THEN {ascii_('restored')} ELSE {_fold(latin, native('restored'))} END AS final FROM re),
st AS MATERIALIZED (SELECT id, source_text, target_lang, e, h, CASE WHEN raw_score = 0 THEN raw WHEN own <> source_text AND own_score < raw_score THEN own ELSE final END AS text, raw_score <> 0 AND (own <> source_text AND own_score < raw_score OR final <> raw) AS changed FROM fi),
{without_chatter('text', 'st')}, {scoring('sc', 'c7', 'text', 'target_lang')}, {styled('c7')}, {scoring('sy', 'z', 'styled', 'target_lang')},
done AS (SELECT z.id, styled AS text, CASE WHEN styled <> text THEN sy.score ELSE sc.score END AS score, changed OR styled <> text AS is_repaired FROM z JOIN sc ON sc.id = z.id JOIN sy ON sy.id = z.id)
SELECT id, text, 'provider' AS source_type, score AS risk_score, CASE WHEN score > 0 THEN 'needs_review' ELSE 'pending' END AS status, CASE WHEN score > 0 THEN 'needs_review' ELSE 'candidate' END AS translation_status, is_repaired FROM done
UNION ALL SELECT * FROM ({local})"""
