"""DuckDB SQL for the record queries, written apart from the operators."""

from __future__ import annotations

import re

from ..catalog import AREA_UNITS, ARTIFACT_KEYS, DEVANAGARI, DUPLICATE_RANK, EVIDENCE_SCORES, FIELD_KEYS, FIELDS, IDENTIFIERS, KNOWN_UNITS, LAYOUT_LABELS, MESSAGES, NULL_TOKENS, SECTIONS
from . import adapters as A

RAW, WIDE, REG, DEC, WORDS, LINES = (A.duck(x) for x in (A.RAW_LONG, A.RAW_WIDE, A.REGISTRY, A.DECISIONS, A.WORDS_DUCK, A.LINES))
SQL: dict[str, str] = {}

quoted = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
lookup = lambda c, table, other: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" if not isinstance(v, str) else f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {other} END"
collapse = lambda c: rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"
swap = lambda c, a, b: f"regexp_replace({c}, '{a}', '{b}', 'g')"
digits = lambda c: f"translate({c}, '{DEVANAGARI}', '0123456789')"
plain = lambda c: f"translate(nfc_normalize(coalesce({c}, '')), chr(160) || '’‘“”–—' || chr(8203) || chr(65279), ' ''''\"\"--')"
space = lambda c: collapse(plain(c))
token = lambda c: f"CASE WHEN {c} IS NOT NULL AND lower({space(c)}) NOT IN ({quoted(NULL_TOKENS)}) THEN {space(c)} END"
text = lambda c: collapse(swap(swap(digits(token(c)), r"\s*,\s*", ", "), r"\s*;\s*", "; "))
name = lambda c: collapse(swap(text(c), r"\s*\.\s*", ". "))
ident = lambda c: collapse(swap(swap(digits(token(c)), r"\s*/\s*", "/"), r"\s*-\s*", "-"))
share = lambda c: collapse(swap(text(c), r"\s*/\s*", "/"))
cleaned = lambda c: collapse(rf"regexp_replace(regexp_replace(coalesce({c}, ''), '^[\s:;|,=/\\\-]+', ''), '[\s;|]+$', '')")


def date(c: str) -> str:
    d = digits(token(c))
    pattern = r"^\d{1,2}[/\-.]\d{1,2}[/\-.]\d{4}$"
    return f"CASE WHEN regexp_matches({d}, '{pattern}') THEN coalesce(strftime(try_strptime(replace(replace({d}, '-', '/'), '.', '/'), '%d/%m/%Y'), '%Y-%m-%d'), {d}) ELSE {d} END"


AREA = r"^\s*(\d+(?:\.\d+)?)\s*(acres?|hectares?|ha|sq\.?\s*m|sqm)?\s*$"
#: CTEs from a table src with column value: area text, value and unit.
AREA_PARTS = f"""
a1 AS (SELECT *, {collapse(digits(token('value')))} AS t FROM src),
a2 AS (SELECT *, regexp_matches(t, '(?i){AREA}') AS fits, regexp_extract(t, '(?i){AREA}', 1) AS num, lower({collapse(f"regexp_extract(t, '(?i){AREA}', 2)")}) AS u FROM a1),
a3 AS (SELECT *, CASE WHEN fits THEN CASE WHEN contains(num, '.') THEN rtrim(rtrim(num, '0'), '.') ELSE num END END AS area_value, CASE WHEN fits AND u <> '' THEN {lookup('u', AREA_UNITS, 'u')} END AS area_unit FROM a2),
area AS (SELECT *, CASE WHEN fits THEN area_value || coalesce(' ' || area_unit, '') ELSE t END AS area_text FROM a3)
"""

for key, column, rule in [
    ("norm_digits", "survey_number", digits), ("norm_whitespace", "tehsil", space), ("norm_unicode", "owner_name", plain), ("norm_null", "owner_name", token), ("norm_text", "address", text),
    ("norm_name", "father_name", name), ("norm_location", "tehsil", text), ("norm_identifier", "survey_number", ident), ("norm_date", "mutation_date", date), ("norm_share", "ownership_share", share),
    ("clean_value", "mutation_type", cleaned), ("match_form", "land_classification", lambda c: collapse(rf"regexp_replace(upper({c}), '[^A-Z0-9\s]', ' ', 'g')")),
    ("folded_text", "tehsil", lambda c: collapse(f"lower(translate(coalesce({c}, ''), '’‘–—', '''''--'))")),
]:
    SQL[key] = f"SELECT document_id, {rule(column)} AS out FROM {WIDE} r"
SQL["norm_area"] = f"WITH src AS (SELECT document_id, plot_area AS value FROM {WIDE} r), {AREA_PARTS} SELECT document_id, area_text AS out, area_value AS value, area_unit AS unit FROM area"

NORMALIZED = f"""
src AS (SELECT * FROM {RAW} r), {AREA_PARTS},
normalized AS (SELECT document_id, seq, field, ordinal, validator, value AS raw_value, evidence_type, source_text, n_source_lines, source_page, matched_label,
  CASE WHEN normalizer = 'area' THEN area_value END AS area_value, CASE WHEN normalizer = 'area' THEN area_unit END AS area_unit, normalizer = 'area' AND coalesce(fits, false) AS structured,
  CASE normalizer WHEN 'name' THEN {name('value')} WHEN 'identifier' THEN {ident('value')} WHEN 'date' THEN {date('value')} WHEN 'share' THEN {share('value')} WHEN 'area' THEN area_text ELSE {text('value')} END AS v FROM area)
"""
SQL["norm_fields"] = f"WITH {NORMALIZED} SELECT document_id, field, raw_value, v AS normalized_value, area_unit, CASE WHEN v IS NULL THEN 'missing' ELSE 'normalized' END AS normalization_status FROM normalized"
SQL["norm_summary"] = f"WITH {NORMALIZED} SELECT field, count(*) AS total_fields, count(v) AS normalized, count(*) - count(v) AS missing, count(*) FILTER (WHERE raw_value IS NOT NULL AND raw_value IS DISTINCT FROM v) AS changed FROM normalized GROUP BY field"

LETTERS, ALNUM = r"regexp_replace(v, '[^\p{L}]', '', 'g')", r"length(regexp_replace(v, '[^\p{L}\p{N}]', '', 'g'))"
SHARE = r"^(\d+)/(\d+)(?:\s*\([^()]+\))?$"
#: (validator, code, is it an error, when)
RULES = [
    ("name", "NAME_NO_LETTERS", 1, f"length({LETTERS}) = 0"), ("name", "NAME_TOO_SHORT", 0, f"length({LETTERS}) > 0 AND {ALNUM} < 2"), ("name", "NAME_SUSPICIOUS_CHARACTERS", 0, rf"length({LETTERS}) > 0 AND regexp_matches(v, '[<>{{}}\[\]|]')"),
    ("location", "LOCATION_NO_LETTERS", 1, f"length({LETTERS}) = 0"), ("location", "LOCATION_REPEATED_CHARACTER", 0, f"length({LETTERS}) >= 3 AND replace(lower({LETTERS}), lower({LETTERS})[1], '') = ''"), ("location", "LOCATION_TOO_SHORT", 0, f"length({LETTERS}) = 1"),
    ("text", "TEXT_NO_CONTENT", 1, f"{ALNUM} = 0"),
    ("date", "DATE_INVALID_FORMAT", 1, r"NOT regexp_matches(v, '^\d{4}-\d{2}-\d{2}$')"), ("date", "DATE_INVALID_CALENDAR_DATE", 1, r"regexp_matches(v, '^\d{4}-\d{2}-\d{2}$') AND try_strptime(v, '%Y-%m-%d') IS NULL"),
    ("land", "LAND_IDENTIFIER_INVALID_FORMAT", 1, "NOT regexp_matches(v, '^[A-Za-z0-9]+(?:[/-][A-Za-z0-9]+)*$')"), ("general", "IDENTIFIER_INVALID_FORMAT", 1, "NOT regexp_matches(v, '^[A-Za-z0-9]+(?:[./_-][A-Za-z0-9]+)*$')"),
    ("area", "AREA_STRUCTURE_MISSING", 1, "NOT structured"), ("area", "AREA_NON_POSITIVE", 1, "structured AND try_cast(area_value AS DOUBLE) <= 0"), ("area", "AREA_UNIT_MISSING", 0, "structured AND area_unit IS NULL"), ("area", "AREA_UNIT_UNKNOWN", 1, f"structured AND area_unit NOT IN ({quoted(KNOWN_UNITS)})"),
    ("share", "SHARE_INVALID_FORMAT", 1, rf"NOT regexp_matches(v, '{SHARE}')"), ("share", "SHARE_ZERO_DENOMINATOR", 1, f"try_cast(regexp_extract(v, '{SHARE}', 2) AS BIGINT) = 0"),
    ("share", "SHARE_ZERO_NUMERATOR", 0, f"try_cast(regexp_extract(v, '{SHARE}', 2) AS BIGINT) > 0 AND try_cast(regexp_extract(v, '{SHARE}', 1) AS BIGINT) = 0"),
    ("share", "SHARE_EXCEEDS_WHOLE", 0, f"try_cast(regexp_extract(v, '{SHARE}', 2) AS BIGINT) > 0 AND try_cast(regexp_extract(v, '{SHARE}', 1) AS BIGINT) > try_cast(regexp_extract(v, '{SHARE}', 2) AS BIGINT)"),
]
found = ["CASE WHEN missing THEN 'FIELD_MISSING' END"] + [f"CASE WHEN NOT missing AND validator = '{who}' AND {when} THEN '{code}' END" for who, code, _, when in RULES]
ERRORS = quoted(code for _, code, bad, _ in RULES if bad)
VALIDATED = f"""{NORMALIZED},
v1 AS (SELECT *, v IS NULL OR trim(v) = '' AS missing FROM normalized),
v2 AS (SELECT *, list_filter([{', '.join(found)}], lambda x: x IS NOT NULL) AS codes FROM v1),
validated AS (SELECT *, len(list_filter(codes, lambda x: x IN ({ERRORS}))) AS n_errors, len(list_filter(codes, lambda x: x NOT IN ({ERRORS}))) AS n_warnings,
  CASE WHEN missing THEN 'missing' WHEN len(list_filter(codes, lambda x: x IN ({ERRORS}))) > 0 THEN 'invalid' WHEN len(codes) > 0 THEN 'warning' ELSE 'valid' END AS status FROM v2)
"""
SQL["valid_fields"] = f"WITH {VALIDATED} SELECT document_id, field, v AS normalized_value, status AS validation_status, array_to_string(codes, ',') AS codes FROM validated"
CROSS = "SELECT document_id, max(try_strptime(v, '%Y-%m-%d')) FILTER (WHERE field = 'mutation_date') AS m, max(try_strptime(v, '%Y-%m-%d')) FILTER (WHERE field = 'registration_date') AS r FROM normalized GROUP BY document_id HAVING r < m"
SQL["valid_cross_dates"] = f"WITH {NORMALIZED} SELECT document_id, 'DATE_ORDER_REVIEW' AS code, 'warning' AS severity FROM ({CROSS})"
SQL["valid_issue_list"] = f"""WITH {VALIDATED}, issues AS (SELECT field, unnest(codes) AS code, 'field' AS scope FROM validated UNION ALL SELECT NULL, 'DATE_ORDER_REVIEW', 'cross_field' FROM ({CROSS}))
SELECT field, code, CASE WHEN code IN ({ERRORS}) THEN 'error' ELSE 'warning' END AS severity, scope, count(*) AS n FROM issues GROUP BY ALL"""
counts = ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS \"{s}\"" for s in ("valid", "warning", "invalid", "missing", "not_checked"))
SQL["valid_status_counts"] = f"WITH {VALIDATED} SELECT document_id, {counts}, sum(n_errors)::BIGINT AS errors, sum(n_warnings)::BIGINT AS warnings FROM validated GROUP BY document_id"
SQL["valid_apply_cross"] = f"""WITH {VALIDATED}, late AS ({CROSS}) SELECT field, CASE WHEN field = 'registration_date' AND status = 'valid' AND late.document_id IS NOT NULL THEN 'warning' ELSE status END AS validation_status, count(*) AS n
FROM validated LEFT JOIN late ON late.document_id = validated.document_id GROUP BY ALL"""
SQL["valid_missing_fields"] = f"SELECT document_id, field FROM {RAW} r WHERE value IS NULL"
FAULTS = f"""a AS (SELECT document_id, artifact::JSON AS j FROM {A.duck(A.ARTIFACTS)} a), f AS (SELECT document_id, unnest(json_keys(j->'fields')) AS name, j FROM a WHERE json_type(j->'fields') = 'OBJECT'),
v AS (SELECT document_id, name, j->'fields'->name AS o FROM f), names AS (SELECT unnest([{quoted(f[0] for f in FIELDS)}]) AS name), top AS (SELECT unnest([{quoted(ARTIFACT_KEYS)}]) AS k), own AS (SELECT unnest([{quoted(FIELD_KEYS)}]) AS k),
faults AS (
  SELECT document_id, 'STRUCTURE_MISSING_TOP_LEVEL_KEY' AS code, NULL AS field FROM a, top WHERE NOT list_contains(json_keys(j), k)
  UNION ALL SELECT document_id, 'STRUCTURE_INVALID_FIELDS', NULL FROM a WHERE json_type(j->'fields') <> 'OBJECT'
  UNION ALL SELECT document_id, 'STRUCTURE_FIELD_ABSENT', name FROM a, names WHERE json_type(j->'fields') = 'OBJECT' AND NOT list_contains(json_keys(j->'fields'), name)
  UNION ALL SELECT document_id, 'STRUCTURE_INVALID_FIELD_OBJECT', name FROM v WHERE json_type(o) <> 'OBJECT'
  UNION ALL SELECT document_id, 'STRUCTURE_MISSING_FIELD_METADATA', name FROM v, own WHERE json_type(o) = 'OBJECT' AND NOT list_contains(json_keys(o), k)
  UNION ALL SELECT document_id, 'STRUCTURE_FIELD_NAME_MISMATCH', name FROM v WHERE json_type(o) = 'OBJECT' AND o->>'field' <> name
  UNION ALL SELECT document_id, 'STRUCTURE_INVALID_SOURCE_LINE_IDS', name FROM v WHERE json_type(o) = 'OBJECT' AND json_type(o->'source_line_ids') NOT IN ('ARRAY', 'NULL'))"""
SQL["valid_structure"] = f"WITH {FAULTS} SELECT code, field, count(*) AS n FROM faults GROUP BY ALL"
SQL["valid_structure_summary"] = f"WITH {FAULTS}, n AS (SELECT document_id, count(*) AS c FROM faults GROUP BY ALL) SELECT a.document_id, coalesce(c, 0) AS structural_errors, coalesce(c, 0) = 0 AS structurally_valid FROM a LEFT JOIN n ON n.document_id = a.document_id"

SCORED = f"""{VALIDATED},
s1 AS (SELECT *, CASE WHEN evidence_type IS NULL THEN 0.0 ELSE {lookup('evidence_type', EVIDENCE_SCORES, 40.0)} END::DOUBLE AS e,
  (CASE status WHEN 'valid' THEN 100 WHEN 'warning' THEN 55 WHEN 'invalid' THEN 15 WHEN 'missing' THEN 0 ELSE 40 END)::DOUBLE AS vs, (CASE WHEN v IS NULL THEN 0 ELSE 100 END)::DOUBLE AS ns,
  ((source_text IS NOT NULL AND trim(source_text) <> '')::INT + (coalesce(n_source_lines, 0) > 0)::INT + (source_page IS NOT NULL)::INT + (matched_label IS NOT NULL AND trim(matched_label) <> '')::INT) * 25.0::DOUBLE AS ss FROM validated),
s2 AS (SELECT *, 0.30::DOUBLE * e + 0.40::DOUBLE * vs + 0.15::DOUBLE * ns + 0.15::DOUBLE * ss AS raw FROM s1),
s3 AS (SELECT *, CASE WHEN status = 'missing' THEN 0.0::DOUBLE ELSE round(CASE status WHEN 'invalid' THEN least(raw, 39.0::DOUBLE) WHEN 'warning' THEN least(raw, 64.0::DOUBLE) ELSE raw END, 2) END AS score FROM s2),
s4 AS (SELECT *, CASE WHEN score >= 85 THEN 'high' WHEN score >= 65 THEN 'medium' WHEN score >= 40 THEN 'low' ELSE 'critical' END AS level,
  list_filter([CASE status WHEN 'invalid' THEN 'Validation marked the field invalid.' WHEN 'warning' THEN 'Validation produced warning(s).' WHEN 'missing' THEN 'Field is missing.' END,
    CASE evidence_type WHEN 'composer_fallback' THEN 'Field was extracted from Composer fallback evidence.' WHEN 'ocr_fallback' THEN 'Field was extracted directly from OCR fallback evidence.' END,
    CASE WHEN evidence_type IS NULL THEN 'Extraction evidence type is unavailable.' WHEN evidence_type NOT IN ({quoted(EVIDENCE_SCORES)}) THEN 'Extraction evidence type is unknown.' END,
    CASE WHEN score < 85 THEN 'Confidence is below the automatic acceptance threshold.' END, CASE WHEN source_text IS NULL OR trim(source_text) = '' THEN 'Source evidence text is unavailable.' END], lambda x: x IS NOT NULL) AS why FROM s3),
scored AS (SELECT *, CASE WHEN len(why) > 0 THEN 'required' ELSE 'not_required' END AS review, CASE WHEN len(why) > 0 THEN array_to_string(why, '; ') ELSE 'Field has sufficient supporting evidence.' END AS reason FROM s4)
"""
SQL["conf_field"] = f"WITH {SCORED} SELECT document_id, field, e AS evidence_score, vs AS validation_score, ns AS normalization_score, ss AS source_score, score AS confidence_score, level AS confidence_level, review AS confidence_review FROM scored"
SQL["conf_review_reasons"] = f"WITH {SCORED} SELECT reason AS confidence_reason, review AS confidence_review, count(*) AS n FROM scored GROUP BY ALL"
SQL["conf_level_counts"] = f"WITH {SCORED} SELECT field, level AS confidence_level, count(*) AS n FROM scored GROUP BY ALL"
LEVEL = "CASE WHEN {0} >= 85 THEN 'high' WHEN {0} >= 65 THEN 'medium' WHEN {0} >= 40 THEN 'low' ELSE 'critical' END"
RECORDS = "r1 AS (SELECT document_id, sum(round(score * 100)::BIGINT) / (100.0::DOUBLE * count(*)) AS mean, 100.0::DOUBLE * count(*) FILTER (WHERE status <> 'missing') / count(*) AS filled, count(*) FILTER (WHERE review = 'required') AS fields_to_review FROM scored GROUP BY document_id), records AS (SELECT document_id, round(mean + 1e-9, 2) AS mean_confidence, round(filled + 1e-9, 2) AS completeness, round(0.75::DOUBLE * mean + 0.25::DOUBLE * filled + 1e-9, 2) AS record_confidence, fields_to_review FROM r1)"
SQL["conf_record"] = f"WITH {SCORED}, {RECORDS} SELECT *, {LEVEL.format('record_confidence')} AS record_level FROM records"
SQL["flagship"] = f"""WITH {SCORED}, {RECORDS} SELECT district, {LEVEL.format('record_confidence')} AS record_level, count(*) AS records, round(sum(round(record_confidence * 100)::BIGINT) / (100.0::DOUBLE * count(*)) + 1e-9, 4) AS mean_confidence
FROM records JOIN (SELECT document_id, v AS district FROM normalized WHERE field = 'district') USING (document_id) GROUP BY ALL"""

BIT = lookup("field", {n: 1 << i for i, n in enumerate(IDENTIFIERS)}, 0)
RANK = lambda c: lookup(c, DUPLICATE_RANK, 0)
STATUS = "CASE WHEN {m} & 3 <> 0 THEN 'strong_duplicate' WHEN {m} & 28 = 28 THEN 'possible_duplicate' WHEN {m} & 28 <> 0 THEN 'insufficient_evidence' WHEN {c} <> 0 THEN 'not_duplicate' ELSE 'insufficient_evidence' END"
DUPLICATES = f"""
ids AS (SELECT document_id, seq, ({BIT})::INT AS bit, trim(v) AS value FROM validated WHERE field IN ({quoted(IDENTIFIERS)}) AND status IN ('valid', 'warning') AND trim(v) <> ''),
docs AS (SELECT d.document_id, d.seq, coalesce(sum(bit), 0)::INT AS mask FROM (SELECT DISTINCT document_id, seq FROM validated) d LEFT JOIN ids i ON i.document_id = d.document_id GROUP BY ALL),
shared AS (SELECT a.document_id, b.document_id AS other_id, bit_or(a.bit)::INT AS matched FROM ids a JOIN ids b ON a.bit = b.bit AND a.value = b.value AND a.document_id <> b.document_id GROUP BY ALL),
pairs AS (SELECT s.*, {STATUS.format(m='matched', c='(a.mask & b.mask)')} AS status, bit_count(matched)::INT AS n_matched, (bit_count(a.mask & b.mask) - bit_count(matched))::INT AS n_conflicting, (5 - bit_count(a.mask & b.mask))::INT AS n_missing, b.seq AS other_seq
  FROM shared s JOIN docs a ON a.document_id = s.document_id JOIN docs b ON b.document_id = s.other_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY {RANK('status')} DESC, n_matched DESC, n_conflicting, other_seq) AS nth FROM pairs),
low AS (SELECT mask, document_id AS other, seq AS other_seq FROM (SELECT *, row_number() OVER (PARTITION BY mask ORDER BY seq) AS nth FROM docs) WHERE nth <= 2),
alone AS (SELECT d.document_id, l.other, l.mask & d.mask AS c, row_number() OVER (PARTITION BY d.document_id ORDER BY (l.mask & d.mask = 0)::INT DESC, bit_count(l.mask & d.mask), other_seq) AS nth FROM docs d JOIN low l ON l.other <> d.document_id WHERE d.document_id NOT IN (SELECT document_id FROM pairs)),
assessed AS (SELECT document_id, status, other_id AS best_match, n_matched, n_conflicting FROM ranked WHERE nth = 1
  UNION ALL SELECT document_id, CASE WHEN c = 0 THEN 'insufficient_evidence' ELSE 'not_duplicate' END, other, 0, bit_count(c)::INT FROM alone WHERE nth = 1)
"""
VD = VALIDATED + "," + DUPLICATES
SQL["dup_identifiers"] = f"WITH {VD} SELECT * FROM ids"
SQL["dup_pairs"] = f"WITH {VD} SELECT document_id, other_id, matched, status, n_matched, n_conflicting, n_missing FROM pairs"
NAMES = lambda bits: "concat_ws(',', " + ", ".join(f"CASE WHEN ({bits}) & {1 << i} <> 0 THEN '{n}' END" for i, n in enumerate(IDENTIFIERS)) + ")"
SQL["dup_evidence"] = f"""WITH {VD}, p AS (SELECT p.*, a.mask & b.mask AS common FROM pairs p JOIN docs a ON a.document_id = p.document_id JOIN docs b ON b.document_id = p.other_id)
SELECT document_id, other_id, status, {NAMES('matched')} AS matched_identifiers, {NAMES('common & ~matched')} AS conflicting_identifiers, {NAMES('31 & ~common')} AS missing_identifiers,
  CASE WHEN matched & 1 <> 0 THEN 'Registered document number matched an existing record.' WHEN matched & 2 <> 0 THEN 'Mutation entry number matched an existing record.' WHEN matched & 28 = 28 THEN 'Survey number, Khasra number, and Khata number all matched an existing record.'
  ELSE concat_ws(', ', CASE WHEN matched & 4 <> 0 THEN 'Survey number' END, CASE WHEN matched & 8 <> 0 THEN 'Khasra number' END, CASE WHEN matched & 16 <> 0 THEN 'Khata number' END) || ' matched, but land identifiers alone do not provide sufficient evidence for duplicate classification.' END AS match_reason FROM p"""
SQL["dup_best_match"] = f"WITH {VD} SELECT *, (SELECT count(*) - 1 FROM docs) AS n_compared FROM assessed"
SQL["dup_summary"] = f"WITH {VD} SELECT status, count(*) AS records, (count(*) * (SELECT count(*) - 1 FROM docs))::BIGINT AS compared FROM assessed GROUP BY status"
SQL["conf_duplicate_risk"] = f"""WITH {SCORED}, {DUPLICATES}, {RECORDS} SELECT r.document_id, record_confidence, {LEVEL.format('record_confidence')} AS record_level, a.status AS duplicate_status,
(CASE a.status WHEN 'strong_duplicate' THEN 100 WHEN 'possible_duplicate' THEN 70 WHEN 'insufficient_evidence' THEN 30 ELSE 0 END)::DOUBLE AS duplicate_risk,
CASE WHEN fields_to_review > 0 OR a.status IN ('strong_duplicate', 'possible_duplicate') THEN 'required' ELSE 'not_required' END AS record_review FROM records r LEFT JOIN assessed a ON a.document_id = r.document_id"""

MADE = f"""made AS (SELECT * FROM {DEC} d WHERE decision IN ('accepted', 'edited', 'rejected') AND field IS NOT NULL AND (decision <> 'edited' OR trim(coalesce(edited_value, '')) <> '')),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, field ORDER BY event_seq DESC) AS nth, count(*) OVER (PARTITION BY document_id, field) AS n_decisions FROM made) WHERE nth = 1)"""
REVIEW = f"""{MADE},
opened AS (SELECT s.document_id, s.field, s.ordinal, coalesce(s.v, s.raw_value) AS machine, review = 'required' OR status IN ('warning', 'invalid', 'missing', 'not_checked') AS needed, l.decision AS dec, l.edited_value AS edit FROM scored s LEFT JOIN latest l ON l.document_id = s.document_id AND l.field = s.field),
reviewed AS (SELECT document_id, field, ordinal, needed, coalesce(dec, CASE WHEN needed THEN 'pending' ELSE 'auto_accepted' END) AS decision, CASE WHEN dec = 'accepted' THEN machine WHEN dec = 'edited' THEN edit WHEN dec IS NULL AND NOT needed THEN machine END AS verified FROM opened)"""
SAID = lookup("x", {c: m.replace("'", "''") for c, m in MESSAGES.items()}, "''")
SQL["review_reasons"] = f"""WITH {SCORED}, said AS (SELECT list_concat(CASE WHEN review = 'required' THEN [reason] ELSE [] END, list_transform(codes, lambda x: {SAID})) AS all_said FROM scored),
firsts AS (SELECT array_to_string(list_filter(all_said, lambda x, i: list_position(all_said, x) = i), ' / ') AS reasons FROM said) SELECT reasons, count(*) AS n FROM firsts GROUP BY reasons"""
SQL["review_latest_decision"] = f"WITH {MADE} SELECT document_id, field, decision, edited_value, reviewer, n_decisions, event_seq FROM latest"
SQL["review_before_after"] = f"WITH {MADE} SELECT document_id, field, event_seq, decision, edited_value, coalesce(lag(decision) OVER w, 'pending') AS previous_decision, lag(edited_value) OVER w AS previous_value, (row_number() OVER w)::INT AS nth FROM made WINDOW w AS (PARTITION BY document_id, field ORDER BY event_seq)"
SQL["review_queue"] = f"WITH {SCORED}, {REVIEW} SELECT document_id, count(*)::INT AS n_pending, string_agg(field, ',' ORDER BY ordinal) AS queue FROM reviewed WHERE needed AND decision = 'pending' GROUP BY document_id"
SQL["review_summary"] = f"""WITH {SCORED}, {DUPLICATES}, {REVIEW}, asked AS (SELECT document_id, arg_max(decision, event_seq) AS dd FROM {DEC} d WHERE decision IN ('confirmed_duplicate', 'not_duplicate') GROUP BY document_id),
s AS (SELECT document_id, count(*) AS total_fields, count(*) FILTER (WHERE needed) AS review_required, {', '.join(f"count(*) FILTER (WHERE decision = '{d}') AS {d}" for d in ('pending', 'accepted', 'edited', 'rejected', 'auto_accepted'))}, count(verified) AS verified_values FROM reviewed GROUP BY document_id)
SELECT s.*, a.status AS duplicate_status, q.dd AS duplicate_decision, a.status IN ('strong_duplicate', 'possible_duplicate') AND q.dd IS NULL AS duplicate_review_pending, pending = 0 AND NOT (a.status IN ('strong_duplicate', 'possible_duplicate') AND q.dd IS NULL) AS can_finalize
FROM s LEFT JOIN assessed a ON a.document_id = s.document_id LEFT JOIN asked q ON q.document_id = s.document_id"""
SQL["review_verified_wide"] = f"WITH {SCORED}, {REVIEW} SELECT document_id, {', '.join(f'''max(verified) FILTER (WHERE field = '{f[0]}') AS {f[0]}''' for f in FIELDS)} FROM reviewed GROUP BY document_id"

SQL["store_upsert_documents"] = f"""WITH old AS (SELECT document_id, status, uploaded_at FROM {REG} r), new AS (SELECT CASE WHEN document_id LIKE '%3' THEN document_id || '-N' ELSE document_id END AS document_id FROM old WHERE substr(document_id, -1, 1) IN ('1', '2', '3'))
SELECT document_id, status, strftime(uploaded_at, '%Y-%m-%d %H:%M:%S') AS uploaded_at, strftime(uploaded_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM old WHERE document_id NOT IN (SELECT document_id FROM new)
UNION ALL SELECT n.document_id, 'Verified', '2030-01-01 00:00:00', coalesce(strftime(o.uploaded_at, '%Y-%m-%d %H:%M:%S'), '2030-01-01 00:00:00') FROM new n LEFT JOIN old o ON o.document_id = n.document_id"""
SQL["store_upsert_fields"] = f"""WITH {NORMALIZED}, {MADE}, new AS (SELECT document_id, field, edited_value FROM latest WHERE decision = 'edited')
SELECT document_id, field, v AS normalized_value FROM normalized ANTI JOIN new USING (document_id, field) UNION ALL SELECT * FROM new"""
SQL["store_evidence"] = f"SELECT document_id, field, source_text, source_page, evidence_type, matched_label FROM {RAW} r WHERE seq % 3 <> 0 AND NOT (coalesce(source_text, '') = '' AND source_page IS NULL AND coalesce(evidence_type, '') = '' AND coalesce(matched_label, '') = '')"
SQL["store_audit"] = f"SELECT document_id, event AS event_type, field AS field_name, decision, reviewer, reason AS human_reason, event_seq AS seq FROM {DEC} d"
SQL["store_regroup"] = f"WITH {VALIDATED} SELECT document_id, count(*)::INT AS n_fields, max(v) FILTER (WHERE field = 'district') AS district, max(status) FILTER (WHERE field = 'plot_area') AS area_status FROM validated GROUP BY document_id"

TOP = f"(SELECT * FROM {REG} r ORDER BY uploaded_at DESC, document_id LIMIT 100)"
BUCKET = "CASE WHEN status = 'Verified' THEN 'Verified' WHEN status IN ('CV Failed', 'OCR Failed', 'Under Review') THEN 'Under Review' ELSE 'Processing' END"
KPI = f"SELECT count(*) AS total, count(*) FILTER (WHERE b = 'Processing') AS processing, count(*) FILTER (WHERE b = 'Under Review') AS review, count(*) FILTER (WHERE b = 'Verified') AS verified, round(100.0::DOUBLE * count(*) FILTER (WHERE b = 'Verified') / count(*), 1) AS verified_percent FROM (SELECT {BUCKET} AS b FROM %s t)"
SQL["list_recent"] = f"SELECT document_id, status, original_filename FROM {TOP}"
SQL["doc_lookup"] = f"SELECT document_id, status, document_id IN (SELECT 'DOC-' || lpad(o_orderkey::VARCHAR, 8, '0') FROM orders) AS ocr_result_exists, status IN ('CV Failed', 'OCR Failed') AS can_retry FROM {REG} r WHERE document_id = 'DOC-00000143'"
SQL["kpi"], SQL["kpi_all"] = KPI % TOP, KPI % REG
SQL["facet_filter"] = f"SELECT document_id, status, district FROM {REG} r WHERE status = 'Verified' AND district = '3'"
SQL["keyword_search"] = f"SELECT document_id, status FROM {REG} r WHERE contains(lower(document_id || ' ' || original_filename || ' ' || status), 'ocr proc')"
SQL["status_buckets"] = f"SELECT {BUCKET} AS bucket, status, count(*) AS n FROM {REG} r GROUP BY ALL"
SQL["status_steps"] = f"""WITH r AS (SELECT document_id, CASE status WHEN 'Queued' THEN 1 WHEN 'CV Processing' THEN 1 WHEN 'CV Failed' THEN 1 WHEN 'Verified' THEN 6 ELSE 2 END AS n, CASE status WHEN 'CV Processing' THEN 'active' WHEN 'OCR Processing' THEN 'active' WHEN 'CV Failed' THEN 'failed' WHEN 'OCR Failed' THEN 'failed' ELSE 'pending' END AS t FROM {REG} x)
SELECT document_id, step, CASE WHEN no < n THEN 'done' WHEN no = n THEN t ELSE 'pending' END AS state FROM r, (VALUES (0, 'upload'), (1, 'preprocess'), (2, 'ocr'), (3, 'extract'), (4, 'verify'), (5, 'complete')) AS s(no, step)"""
SQL["retry_eligible"] = f"SELECT document_id, CASE WHEN status = 'OCR Failed' THEN 'ocr' ELSE 'cv' END AS mode FROM {REG} r WHERE status IN ('CV Failed', 'OCR Failed') AND user_id % 3 <> 0"
SQL["date_parts"] = f"SELECT document_id, strftime(uploaded_at + INTERVAL 330 MINUTE, '%d %b %Y') AS day, lower(strftime(uploaded_at + INTERVAL 330 MINUTE, '%I:%M %p')) AS time FROM {REG} r"
SQL["serialize_documents"] = f"SELECT document_id, original_filename AS filename, stored_filename AS stored_as, status, confidence, strftime(uploaded_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(uploaded_at) % 1000000 <> 0 THEN strftime(uploaded_at, '.%f') ELSE '' END || 'Z' AS uploaded_at FROM {REG} r"
SQL["confidence_text"] = f"SELECT document_id, try_cast(regexp_replace(confidence, '%$', '') AS DOUBLE) AS number, coalesce(format('{{:.2f}}%', try_cast(regexp_replace(confidence, '%$', '') AS DOUBLE)), '—') AS shown FROM {REG} r"
SQL["upload_filter"] = f"SELECT document_id, original_filename, size FROM {REG} r WHERE regexp_matches(lower(original_filename), '\\.(pdf|jpg|jpeg|png)$') AND size <= 26214400"
SQL["upload_prepend"] = f"SELECT document_id, CASE WHEN document_id LIKE '%7' THEN 'Queued' ELSE status END AS status FROM {REG} r"
SQL["status_latest"] = f"SELECT 'U' || user_id::VARCHAR AS document_id, arg_max(status, substr(document_id, 5)::BIGINT) AS status, max(substr(document_id, 5)::BIGINT) AS event_seq, count(*) AS n_changes FROM {REG} r GROUP BY user_id"

SQL["ocr_page_conf"] = f"SELECT document_id, page, round(avg(conf) + 1e-9, 2) AS confidence, count(*) AS word_count FROM {WORDS} w GROUP BY ALL"
SQL["ocr_doc_conf"] = f"WITH p AS (SELECT document_id, (idx // 60)::INT AS page, round(avg(conf) + 1e-9, 2) AS c, count(*) AS n FROM {WORDS} w GROUP BY ALL) SELECT document_id, round(sum(c * n) / sum(n) + 1e-9, 2) AS document_confidence, count(*) AS page_count, sum(n)::BIGINT AS word_count FROM p GROUP BY document_id"
SQL["ocr_text"] = f"WITH p AS (SELECT document_id, idx // 60 AS page, string_agg(text, ' ' ORDER BY idx) AS t FROM {WORDS} w GROUP BY ALL) SELECT document_id, sha256(string_agg(t, chr(10) || chr(10) ORDER BY page)) AS text_sha256 FROM p GROUP BY document_id"
BOX = "min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height, round(avg(conf) + 1e-9, 2) AS conf, count(*) AS n"
SQL["layout_lines"] = f"""WITH RECURSIVE w AS (SELECT *, y + height / 2 AS cy FROM {WORDS} w), t AS (SELECT document_id, page, greatest(15.0, 0.6 * median(height)) AS tol FROM w GROUP BY ALL),
o AS MATERIALIZED (SELECT w.*, tol, row_number() OVER (PARTITION BY w.document_id, w.page ORDER BY cy, x, idx) AS i, dense_rank() OVER (ORDER BY w.document_id, w.page) AS sheet FROM w JOIN t ON t.document_id = w.document_id AND t.page = w.page),
f AS (SELECT sheet, i, 1 AS line_no, cy AS total, 1 AS n FROM o WHERE i = 1
  UNION ALL SELECT o.sheet, o.i, CASE WHEN abs(o.cy - f.total / f.n) <= o.tol THEN f.line_no ELSE f.line_no + 1 END, CASE WHEN abs(o.cy - f.total / f.n) <= o.tol THEN f.total + o.cy ELSE o.cy END, CASE WHEN abs(o.cy - f.total / f.n) <= o.tol THEN f.n + 1 ELSE 1 END
  FROM f JOIN o ON o.sheet = f.sheet AND o.i = f.i + 1)
SELECT document_id, page, line_no, sha256(string_agg(text, ' ' ORDER BY x, idx)) AS text_sha256, {BOX} FROM o JOIN f ON f.sheet = o.sheet AND f.i = o.i GROUP BY document_id, page, line_no"""
BAND_WORDS = f"(SELECT * REPLACE (y + 120 * ((line_no + 3) // 7) AS y) FROM (SELECT *, floor(y / 40)::INT AS line_no FROM {WORDS} w))"
BANDS = f"(SELECT document_id, page, line_no, string_agg(text, ' ' ORDER BY x, idx) AS text, {BOX} FROM {BAND_WORDS} b GROUP BY document_id, page, line_no)"
SQL["layout_blocks"] = f"""WITH l AS (SELECT *, y - lag(y + height) OVER (PARTITION BY document_id, page ORDER BY y, line_no) AS gap FROM {BANDS} l), g AS (SELECT document_id, page, greatest(80.0, 3 * median(height)) AS lim FROM l GROUP BY ALL),
b AS (SELECT l.*, (sum(CASE WHEN gap IS NULL OR gap > lim THEN 1 ELSE 0 END) OVER (PARTITION BY l.document_id, l.page ORDER BY y, line_no))::INT AS block_no FROM l JOIN g ON g.document_id = l.document_id AND g.page = l.page)
SELECT document_id, page, block_no, sha256(string_agg(text, chr(10) ORDER BY y, line_no)) AS text_sha256, {BOX} FROM b GROUP BY document_id, page, block_no"""
COLUMNS = """g AS (SELECT {k}, x, x - lag(x) OVER (PARTITION BY {k} ORDER BY x) AS gap FROM src), c AS (SELECT {k}, x, (sum(CASE WHEN gap IS NULL OR gap > 40 THEN 1 ELSE 0 END) OVER (PARTITION BY {k} ORDER BY x))::INT AS column_no FROM g),
cols AS (SELECT {k}, column_no, avg(x) AS center FROM c GROUP BY ALL)"""
SQL["layout_columns"] = f"WITH src AS (SELECT * REPLACE (x + CASE WHEN idx % 5 = 2 THEN 60 ELSE 0 END AS x) FROM {BAND_WORDS} b), {COLUMNS.format(k='document_id, page, line_no')} SELECT * FROM cols"
SQL["layout_tables"] = f"""WITH src AS (SELECT * REPLACE (x + CASE WHEN (idx * 7 + line_no) % 3 = 0 THEN 60 ELSE 0 END AS x), line_no // 4 AS block_no FROM {BAND_WORDS} b), {COLUMNS.format(k='document_id, page, block_no')},
near AS (SELECT s.document_id, s.page, s.block_no::INT AS block_no, s.line_no, s.idx, s.x, s.text, arg_min(column_no, (abs(s.x - center), column_no)) AS column_no FROM src s JOIN cols USING (document_id, page, block_no) GROUP BY ALL),
cells AS (SELECT document_id, page, block_no, line_no, column_no, string_agg(text, ' ' ORDER BY x, idx) AS text FROM near GROUP BY ALL),
wide AS (SELECT document_id, page, block_no, line_no, count(*) AS n FROM cells GROUP BY ALL),
ok AS (SELECT document_id, page, block_no FROM wide GROUP BY ALL HAVING count(*) >= 2 AND count(*) FILTER (WHERE n >= 2) >= greatest(1, count(*) // 2)),
enough AS (SELECT document_id, page, block_no FROM cols GROUP BY ALL HAVING count(*) >= 2)
SELECT cells.* FROM cells SEMI JOIN ok USING (document_id, page, block_no) SEMI JOIN enough USING (document_id, page, block_no)"""

MATCH = collapse(r"regexp_replace(upper(text), '[^A-Z0-9\s]', ' ', 'g')")
SECTION = "CASE " + " ".join(f"WHEN contains({MATCH}, '{s}') THEN '{s}'" for s in SECTIONS) + " END"
FILLED = f"filled AS (SELECT *, last_value(header IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY page, line_no ROWS UNBOUNDED PRECEDING) AS section FROM (SELECT *, {SECTION} AS header FROM {LINES} l))"
SQL["layout_sections"] = f"SELECT document_id, line_no, name, (row_number() OVER (PARTITION BY document_id ORDER BY line_no))::INT AS section_no FROM (SELECT *, {SECTION} AS name FROM {LINES} l) WHERE name IS NOT NULL"
SQL["section_fill"] = f"WITH {FILLED} SELECT document_id, line_no, header, section FROM filled"
SQL["reading_order"] = f"""WITH b AS (SELECT document_id, page, idx AS block_no, CASE WHEN document_id::BIGINT % 2 = 0 THEN x / 9 WHEN x >= 540 THEN x + 300 ELSE x END AS x, y FROM {WORDS} w),
g AS (SELECT *, x - lag(x) OVER (PARTITION BY document_id, page ORDER BY x) AS gap FROM b), m AS (SELECT *, max(coalesce(gap, 0)) OVER (PARTITION BY document_id, page) > 300 AS col FROM g)
SELECT document_id, page, block_no, (row_number() OVER (PARTITION BY document_id, page ORDER BY CASE WHEN col THEN x ELSE 0 END, CASE WHEN col THEN y ELSE 0 END, block_no))::INT AS pos FROM m"""


def spelled(labels: list[str]) -> str:
    """A regular expression for any of the labels, the longest first, with separators between their words."""
    ordered = sorted(set(labels), key=lambda x: (-len(x), x))
    return "(?i)(?:" + "|".join(r"\b" + r"[\s._:/|,\-]*".join(re.findall("[A-Za-z0-9]+", x)) + r"\.?\b" for x in ordered) + ")"


EVERY_LABEL = spelled([x for f in FIELDS for x in f[4]])
V, EX = cleaned("raw"), lambda c, p: f"nullif(regexp_extract({c}, '{p}'), '')"
PARSED = f"""CASE WHEN field IN ('mutation_date', 'registration_date') THEN {EX('cv', r'\b\d{1,2}[/\-.]\d{1,2}[/\-.]\d{4}\b')} WHEN field IN ('survey_number', 'khasra_number', 'khata_number') THEN {EX('cv', r'\b\d+(?:[/\-][A-Za-z0-9]+)*\b')}
WHEN field = 'mutation_entry_number' THEN {EX('cv', r'\b\d+[A-Za-z0-9/\-]*\b')} WHEN field = 'registered_document_number' THEN coalesce({EX('cv', r'\b[A-Za-z0-9\-]+/\d{4}\b')}, {EX('cv', r'\b\d{2,}\b')})
WHEN field = 'plot_area' THEN nullif({cleaned(EX('cv', r'(?i)\b\d+(?:\.\d+)?(?:\s*(?:acres?|hectares?|ha|sq\.?\s*m|sqm))?'))}, '') ELSE nullif(cv, '') END"""
FOUND = " UNION ALL ".join(
    f"SELECT document_id, page, line_no, text, '{n}' AS field, '{sec}' AS field_section, regexp_extract(text, '{spelled(ls)}') AS label, length(regexp_extract(text, '(?s)^(.*?){spelled(ls)}', 1)) AS pos0 FROM filled WHERE (section IS NULL OR section = '{sec}') AND regexp_matches(text, '{spelled(ls)}')"
    for n, sec, _, _, ls in FIELDS
)
LABELLED = f"""{FILLED.replace('filled AS (', 'filled AS MATERIALIZED (', 1)},
rest AS (SELECT *, substr(text, pos0 + length(label) + 1) AS after FROM ({FOUND})),
behind AS MATERIALIZED (SELECT *, {cleaned(f"CASE WHEN regexp_matches(after, '{EVERY_LABEL}') THEN regexp_extract(after, '(?s)^(.*?){EVERY_LABEL}', 1) ELSE after END")} AS raw FROM rest),
nxt AS (SELECT document_id, page, line_no, lead(text) OVER w AS nt, lead(header) OVER w AS nh FROM filled WINDOW w AS (PARTITION BY document_id, page ORDER BY line_no)),
inline_values AS (SELECT * FROM (SELECT document_id, page, line_no, field, raw, {PARSED} AS value, lower(label) AS label FROM (SELECT *, {V} AS cv FROM behind WHERE raw <> '')) WHERE value IS NOT NULL),
below_values AS (SELECT * FROM (SELECT document_id, page, line_no, field, {PARSED} AS value FROM (SELECT b.document_id, b.page, b.line_no, field, {cleaned('nt')} AS cv FROM behind b JOIN nxt n ON n.document_id = b.document_id AND n.page = b.page AND n.line_no = b.line_no
  WHERE raw = '' AND nt IS NOT NULL AND nh IS NULL AND NOT regexp_matches(nt, '{EVERY_LABEL}'))) WHERE value IS NOT NULL)"""
SQL["extract_label_value"] = f"WITH {LABELLED} SELECT document_id, line_no, field, raw, value, label FROM inline_values"
SQL["extract_below"] = f"WITH {LABELLED} SELECT document_id, line_no, field, value FROM below_values"

# Label places: pieces between the matches of a label, added up.
PLACES = " UNION ALL ".join(
    f"SELECT document_id, page, line_no, {i} AS label_no, '{label.replace(chr(39), chr(39) * 2)}' AS label, string_split_regex(t, '(?i){pattern}') AS pieces, regexp_extract_all(t, '(?i){pattern}') AS matches FROM l WHERE regexp_matches(t, '(?i){pattern}')"
    for i, (label, pattern) in enumerate(LAYOUT_LABELS)
)
BELOW = "coalesce(below_gap BETWEEN 0 AND 2 * mid AND trim(next_text) <> '', false)"
RELATIONS = f"""
l AS MATERIALIZED (SELECT *, {collapse('text')} AS t FROM {LINES} l),
m AS (SELECT document_id, page, coalesce(median(height) FILTER (WHERE height > 0), 20) AS mid FROM l GROUP BY ALL),
n AS (SELECT l.*, mid, lead(text) OVER w AS next_text, lead(line_no) OVER w AS next_line, lead(y) OVER w - (y + height) AS below_gap FROM l JOIN m ON m.document_id = l.document_id AND m.page = l.page WINDOW w AS (PARTITION BY l.document_id, l.page ORDER BY line_no)),
spots AS (SELECT document_id, page, line_no, label_no, label, matches, pieces, unnest(range(1, len(matches) + 1)) AS i FROM ({PLACES})),
hit AS (SELECT document_id, page, line_no, label_no, label, i, length(array_to_string(pieces[1:i], '')) + length(array_to_string(matches[1:i - 1], '')) AS start, length(matches[i]) AS size FROM spots),
ordered AS (SELECT h.*, n.t, n.next_text, n.next_line, n.below_gap, n.mid, n.x, n.y, n.width, n.height, (row_number() OVER w - 1)::INT AS hit_no, coalesce(lead(start) OVER w, length(t)) AS until
  FROM hit h JOIN n ON n.document_id = h.document_id AND n.page = h.page AND n.line_no = h.line_no WINDOW w AS (PARTITION BY h.document_id, h.page, h.line_no ORDER BY start, label_no, i)),
behind_label AS (SELECT *, regexp_replace({collapse('substr(t, start + size + 1, greatest(until - start - size, 0))')}, '^[:\\-]\\s*', '') AS own FROM ordered),
beside AS (SELECT a.document_id, a.page, a.line_no, a.hit_no, arg_min(b.line_no, (b.x - (a.x + a.width), b.line_no)) AS right_line, arg_min({collapse('b.text')}, (b.x - (a.x + a.width), b.line_no)) AS right_text
  FROM behind_label a JOIN l b ON a.document_id = b.document_id AND a.page = b.page AND a.line_no <> b.line_no
  WHERE own = '' AND NOT {BELOW} AND least(a.height, b.height) > 0
    AND least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y) >= 0.5 * least(a.height, b.height) AND b.x - (a.x + a.width) BETWEEN 0 AND 15 * mid GROUP BY ALL),
rels AS MATERIALIZED (SELECT a.document_id, a.page, a.line_no, a.hit_no, label, CASE WHEN own <> '' THEN own WHEN {BELOW} THEN {collapse('next_text')} ELSE right_text END AS value,
  CASE WHEN own <> '' THEN 'same_line' WHEN {BELOW} THEN 'below' WHEN right_line IS NOT NULL THEN 'right' END AS relation,
  CASE WHEN own <> '' THEN NULL WHEN {BELOW} THEN next_line ELSE right_line END AS target_line
  FROM behind_label a LEFT JOIN beside b ON b.document_id = a.document_id AND b.page = a.page AND b.line_no = a.line_no AND b.hit_no = a.hit_no)"""
SQL["relationships"] = f"WITH {RELATIONS} SELECT document_id, line_no, hit_no, label, value, relation, target_line FROM rels"

FOLDED = collapse("lower(translate(label, '’‘–—', '''''--'))")
BY_RELATION = " UNION ALL ".join(f"SELECT document_id, page, line_no, value AS raw, '{n}' AS field FROM sectioned WHERE (section IS NULL OR section = '{sec}') AND regexp_matches(folded, '{spelled(ls)}')" for n, sec, _, _, ls in FIELDS)
FIRST = f"""{LABELLED}, {RELATIONS},
sectioned AS MATERIALIZED (SELECT r.*, f.section, {FOLDED} AS folded FROM rels r JOIN filled f ON f.document_id = r.document_id AND f.page = r.page AND f.line_no = r.line_no WHERE r.value IS NOT NULL),
by_relation AS (SELECT * FROM (SELECT document_id, page, line_no, field, {PARSED} AS value FROM (SELECT *, {V} AS cv FROM ({BY_RELATION}))) WHERE value IS NOT NULL),
sources AS (SELECT document_id, page, line_no, field, value, 'layout_relationship' AS evidence_type, 0 AS prio FROM by_relation UNION ALL SELECT document_id, page, line_no, field, value, 'layout_same_line', 1 FROM inline_values
  UNION ALL SELECT document_id, page, line_no, field, value, 'layout_below_label', 2 FROM below_values),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, field ORDER BY prio, page, line_no, value) AS nth FROM sources) WHERE nth = 1)"""
SQL["extract_first_wins"] = f"WITH {FIRST} SELECT document_id, field, value, evidence_type, line_no FROM firsts"
SQL["extract_complete"] = f"WITH {FIRST} SELECT document_id, {len(FIELDS)}::BIGINT AS total_fields, count(value) AS extracted, {len(FIELDS)} - count(value) AS missing FROM firsts GROUP BY document_id"
CELLS = f"cells AS (SELECT document_id, page, line_no, unnest(range(1, len(p) + 1)) AS column_no, unnest(p) AS text FROM (SELECT *, string_split(text, ' | ') AS p FROM {LINES} l WHERE line_no IN (11, 12)))"
TABLES = f"{CELLS}, table_rows AS (SELECT document_id, page, line_no, string_agg(text, ' | ' ORDER BY column_no) AS text FROM cells GROUP BY ALL), whole AS (SELECT document_id, page, '[TABLE - structure detected heuristically, unvalidated]' || chr(10) || string_agg(text, chr(10) ORDER BY line_no) AS text, min(line_no) AS first_line FROM table_rows GROUP BY document_id, page)"
SQL["compose_tables"] = f"WITH {TABLES} SELECT document_id, line_no, w.text FROM table_rows r JOIN whole w USING (document_id, page)"
COMPOSED = f"""{RELATIONS}, {TABLES},
taken AS (SELECT DISTINCT document_id, page, target_line AS line_no FROM rels WHERE target_line IS NOT NULL),
said AS (SELECT document_id, page, line_no, list(rtrim(label || ': ' || coalesce(value, '')) ORDER BY hit_no) AS texts FROM rels GROUP BY ALL),
kinds AS (SELECT l.document_id, l.page, l.line_no, {SECTION.replace('(text)', '(l.text)')} AS header, CASE WHEN t.line_no = w.first_line THEN ['table'] WHEN t.line_no IS NOT NULL THEN [] WHEN {SECTION.replace('(text)', '(l.text)')} IS NOT NULL THEN ['header'] WHEN s.texts IS NOT NULL THEN list_transform(s.texts, lambda x: 'field') WHEN k.line_no IS NOT NULL THEN [] ELSE ['raw'] END AS kind,
    CASE WHEN t.line_no = w.first_line THEN [w.text] WHEN t.line_no IS NOT NULL THEN [] WHEN {SECTION.replace('(text)', '(l.text)')} IS NOT NULL THEN ['[' || {SECTION.replace('(text)', '(l.text)')} || ']'] WHEN s.texts IS NOT NULL THEN s.texts WHEN k.line_no IS NOT NULL THEN [] ELSE [l.text] END AS said
  FROM l LEFT JOIN table_rows t ON t.document_id = l.document_id AND t.page = l.page AND t.line_no = l.line_no LEFT JOIN whole w ON w.document_id = l.document_id AND w.page = l.page
  LEFT JOIN said s ON s.document_id = l.document_id AND s.page = l.page AND s.line_no = l.line_no LEFT JOIN taken k ON k.document_id = l.document_id AND k.page = l.page AND k.line_no = l.line_no),
pieces AS (SELECT document_id, page, line_no, unnest(kind) AS kind, unnest(said) AS text, unnest(range(1, len(said) + 1)) AS part FROM kinds),
numbered AS (SELECT *, row_number() OVER (PARTITION BY document_id, page ORDER BY line_no, part) AS nth FROM pieces),
sheets AS (SELECT document_id, page, string_agg(CASE WHEN kind IN ('table', 'header') AND nth > 1 THEN chr(10) ELSE '' END || text, chr(10) ORDER BY nth) AS text FROM numbered GROUP BY document_id, page),
texts AS (SELECT document_id, string_agg(text, chr(10) || chr(10) || repeat('=', 20) || ' PAGE BREAK ' || repeat('=', 20) || chr(10) || chr(10) ORDER BY page) AS document_text FROM sheets GROUP BY document_id)"""
SQL["compose_text"] = f"WITH {COMPOSED} SELECT document_id, document_text FROM texts"
SQL["layout_summary"] = f"""WITH {RELATIONS}, a AS (SELECT document_id, count(DISTINCT page) AS page_count, count(*) AS line_count, count({SECTION}) AS section_count FROM l GROUP BY ALL),
g AS (SELECT document_id, page, greatest(80.0, 3 * median(height) FILTER (WHERE height > 0)) AS lim FROM l GROUP BY ALL),
b AS (SELECT document_id, count(*) FILTER (WHERE gap IS NULL OR gap > lim) AS block_count FROM (SELECT l.document_id, lim, y - lag(y + height) OVER (PARTITION BY l.document_id, l.page ORDER BY y, line_no) AS gap FROM l JOIN g ON g.document_id = l.document_id AND g.page = l.page) GROUP BY document_id),
r AS (SELECT document_id, count(*) AS relationship_count FROM rels GROUP BY document_id)
SELECT a.document_id, page_count, line_count, block_count, section_count, coalesce(relationship_count, 0) AS relationship_count, 1::BIGINT AS table_count FROM a JOIN b ON b.document_id = a.document_id LEFT JOIN r ON r.document_id = a.document_id"""
FOLDED_TEXT = collapse("lower(translate(text, '’‘–—', '''''--'))")
NAMED = "CASE " + " ".join(f"WHEN contains({FOLDED_TEXT}, '{s.lower()}') THEN '{s}'" for s in SECTIONS) + " END"
TEXT_LINES = f"""{COMPOSED}, cut AS (SELECT document_id, unnest(string_split(document_text, chr(10))) AS text, unnest(range(0, len(string_split(document_text, chr(10))))) AS i FROM texts),
kept_lines AS (SELECT document_id, NULL::INT AS page, (row_number() OVER (PARTITION BY document_id ORDER BY i) - 1)::INT AS line_no, trim(text) AS text, {NAMED} AS header FROM cut WHERE trim(text) <> ''),
filled AS MATERIALIZED (SELECT *, last_value(header IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section FROM kept_lines)"""
SQL["extract_text_lines"] = f"WITH {TEXT_LINES} SELECT document_id, line_no, text, header, section FROM filled"
BEHIND = LABELLED[LABELLED.index("rest AS (") : LABELLED.index("nxt AS (")] + LABELLED[LABELLED.index("inline_values AS (") : LABELLED.index(",\nbelow_values AS (")]
SQL["extract_text_fallback"] = f"WITH {TEXT_LINES}, {BEHIND} SELECT document_id, line_no, field, value, 'composer_fallback' AS evidence_type FROM inline_values"
OCR_LINES = f"filled AS MATERIALIZED (SELECT *, last_value(header IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY page, line_no ROWS UNBOUNDED PRECEDING) AS section FROM (SELECT * REPLACE (trim(text) AS text), {NAMED} AS header FROM {LINES} l WHERE trim(text) <> ''))"
SQL["extract_ocr_fallback"] = f"WITH {OCR_LINES}, {BEHIND} SELECT document_id, line_no, field, value, 'ocr_fallback' AS evidence_type FROM inline_values"
SQL["extract_object_text"] = f"SELECT event_id, CASE event_id % 7 WHEN 1 THEN 'plain' WHEN 2 THEN trim(object->>'text') WHEN 3 THEN object->>'value' WHEN 4 THEN object WHEN 5 THEN object ELSE '' END AS text FROM {A.duck(A.OBJECTS)} o"
SQL["parse_timestamps"] = f"SELECT event_id, strftime(try_cast(nullif(trim(said), '') AS TIMESTAMPTZ) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS at FROM {A.duck(A.SAID_TIMES)} s"
SQL["extract_parse"] = f"WITH p AS (SELECT document_id, field, {cleaned('value')} AS cv FROM {RAW} r) SELECT document_id, field, {PARSED} AS parsed FROM p"
SQL["extract_table_rows"] = f"""WITH r AS (SELECT 'DOC-' || o_orderkey::VARCHAR AS document_id, o_orderkey AS k FROM orders WHERE o_orderkey % 3 <> 0)
SELECT document_id, 'serial_number' AS field, k::VARCHAR AS value FROM r UNION ALL SELECT document_id, 'ownership_owner_name', 'P' || k::VARCHAR FROM r
UNION ALL SELECT document_id, 'ownership_share', (k % 4)::VARCHAR || ' / 4' FROM r WHERE k % 5 <> 0 UNION ALL SELECT document_id, 'nature_of_rights', CASE WHEN k % 5 = 0 THEN 'x' ELSE 'full | x' END FROM r"""

METRICS = A.duck(A.METRICS)
SCORE = "greatest(0.0, 100.0 - (CASE WHEN glyph < 8 THEN 30 WHEN glyph < 16 THEN 15 ELSE 0 END + CASE WHEN blur < 40 THEN 25 WHEN blur < 80 THEN 10 ELSE 0 END + CASE WHEN contrast < 35 THEN 20 ELSE 0 END + CASE WHEN noise > 12 THEN 15 ELSE 0 END + CASE WHEN abs(skew) > 5 THEN 10 WHEN abs(skew) > 1 THEN 5 ELSE 0 END + CASE WHEN illumination > 12 THEN 10 ELSE 0 END))::DOUBLE"
SQL["img_quality"] = f"""SELECT vec_id, score AS quality_score, CASE WHEN glyph < 5 THEN 'IRRECOVERABLE_RISK' WHEN score >= 85 THEN 'GOOD' WHEN score >= 65 THEN 'FAIR' WHEN score >= 40 THEN 'POOR' ELSE 'CRITICAL' END AS quality_level,
concat_ws(',', CASE WHEN glyph < 24 THEN 'LOW_TEXT_SCALE' END, CASE WHEN contrast < 35 THEN 'LOW_CONTRAST' END, CASE WHEN noise > 12 THEN 'HIGH_NOISE' END, CASE WHEN illumination > 12 THEN 'UNEVEN_ILLUMINATION' END, CASE WHEN abs(skew) > 1 THEN 'SKEW' END, CASE WHEN bimodality < 0.35 THEN 'LOW_TEXT_BACKGROUND_SEPARATION' END) AS problems
FROM (SELECT *, {SCORE} AS score FROM {METRICS} m)"""
SQL["img_plan"] = f"SELECT vec_id, round(CASE WHEN glyph IS NULL THEN 1.0 ELSE least(greatest(24.0 / glyph, 1.0), 4.0) END, 4)::DOUBLE AS scale, noise > 12 AS denoise, illumination > 12 AS correct_illumination, contrast < 35 AS clahe, false AS sharpen, abs(skew) > 1 AS deskew, bimodality < 0.35 AS binarize_candidate FROM {METRICS} m"
PIXELS = A.duck(A.PIXELS["duck"])
SQL["img_illumination"] = f"WITH t AS (SELECT vec_id, floor(pos * 4 / n)::INT AS tile, quantile_cont(v::DOUBLE, 0.9) AS p FROM {PIXELS} x GROUP BY ALL) SELECT vec_id, round(stddev_pop(p), 4) AS illumination FROM t GROUP BY vec_id"
SQL["img_bimodality"] = f"""WITH h AS (SELECT vec_id, floor(v * 16)::BIGINT AS level, count(*) AS n FROM {PIXELS} x GROUP BY ALL),
c AS (SELECT vec_id, (sum(n) OVER u)::DOUBLE / sum(n) OVER p AS w, (sum(n * level) OVER u)::DOUBLE / sum(n) OVER p AS m, (sum(n * level) OVER p)::DOUBLE / sum(n) OVER p AS mean, (sum(n * level * level) OVER p)::DOUBLE / sum(n) OVER p AS sq FROM h WINDOW u AS (PARTITION BY vec_id ORDER BY level), p AS (PARTITION BY vec_id))
SELECT vec_id, round(coalesce(max(CASE WHEN w < 1 THEN pow(mean * w - m, 2) / (w * (1 - w)) END) / nullif(max(sq - mean * mean), 0), 0), 4) AS bimodality FROM c GROUP BY vec_id"""
