"""Record-shaped input from the driver's tables, as SQL text that Spark and DuckDB both run.

``{table}`` stands for a table.  Each text uses integer arithmetic, CASE, ``||``, translate, lpad and the like only, so that
both engines give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..catalog import DEVANAGARI, FIELD_KEYS, FIELDS

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

CATALOG = "(VALUES " + ", ".join(f"('{n}', {i}, '{s}', '{norm}', '{val}')" for i, (n, s, norm, val, _) in enumerate(FIELDS)) + ") AS c(field, ordinal, section, normalizer, validator)"


def _date(c: str) -> str:
    return f"lpad(cast(day({c}) as string), 2, '0') || '/' || lpad(cast(month({c}) as string), 2, '0') || '/' || cast(year({c}) as string)"


#: One record per order, a column per field; values carry the noise of recognised text.
RAW_WIDE = f"""
WITH shipped AS (SELECT l_orderkey, min(l_shipdate) AS ship, min(l_quantity) AS qty FROM {{lineitem}} GROUP BY l_orderkey),
base AS (
  SELECT o_orderkey AS k, c_name, n_name, o_orderdate, ship, cast(cast(qty as int) as string) AS qty,
         CASE WHEN o_orderkey % 10 = 9 THEN o_orderkey - 1 ELSE o_orderkey END AS b,
         CASE WHEN o_orderkey % 30 = 29 THEN o_orderkey - 1 ELSE o_orderkey END AS g
  FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey LEFT JOIN shipped ON l_orderkey = o_orderkey
)
SELECT 'DOC-' || lpad(cast(k as string), 8, '0') AS document_id, k AS seq,
  CASE WHEN k % 19 = 0 THEN ' n/a ' WHEN k % 23 = 0 THEN replace(c_name, '#', ' .') WHEN k % 29 = 0 THEN '12-34' WHEN k % 31 = 0 THEN c_name || ' [x]' WHEN k % 37 = 0 THEN 'Q' ELSE c_name END AS owner_name,
  CASE WHEN k % 3 = 0 THEN NULL WHEN k % 8 = 0 THEN 'L .Sterling' ELSE 'Shri  ' || c_name END AS father_name,
  'Plot ' || cast(k as string) || ' , Lane;Ward ' || cast(k % 40 as string) AS address,
  CASE WHEN k % 9 = 0 THEN 'eee' WHEN k % 17 = 0 THEN '123' WHEN k % 22 = 0 THEN 'Q' ELSE n_name END AS village,
  CASE WHEN k % 6 = 0 THEN '--' ELSE '  ' || n_name || '   South ' END AS tehsil,
  n_name AS district,
  CASE WHEN k % 5 = 1 THEN translate(cast(b as string), '0123456789', '{DEVANAGARI}') WHEN k % 7 = 3 THEN '  ' || cast(b as string) || ' ' ELSE cast(b as string) END || CASE WHEN b % 50 = 7 THEN ' / 2' WHEN b % 50 = 11 THEN '//x' ELSE '' END AS survey_number,
  cast((b * 7919) % 1000003 as string) AS khasra_number,
  cast(CASE WHEN k % 20 = 9 THEN b * 3 + 1 ELSE k * 3 + 1 END as string) AS khata_number,
  CASE WHEN k % 5 = 0 THEN qty || ' ACRES' WHEN k % 5 = 1 THEN qty || '.500 ha' WHEN k % 5 = 2 THEN qty WHEN k % 5 = 3 THEN qty || ' sq.m' ELSE CASE WHEN k % 4 = 0 THEN '0.0 Sq M' ELSE 'about ' || qty END END AS plot_area,
  CASE WHEN k % 4 = 0 THEN '***' ELSE 'IRRIGATED | AGRICULTURAL' END AS land_classification,
  CASE WHEN k % 12 = 0 THEN '#' || cast(k as string) ELSE cast(k % 97 as string) END AS serial_number,
  c_name AS ownership_owner_name,
  cast(k % 6 as string) || ' / ' || cast(k % 5 as string) || CASE WHEN k % 7 = 0 THEN ' (Full)' WHEN k % 11 = 0 THEN ' part' ELSE '' END AS ownership_share,
  CASE WHEN k % 2 = 0 THEN 'Owner' ELSE NULL END AS nature_of_rights,
  CASE WHEN k % 6 = 0 OR k % 50 = 19 THEN 'M' || cast(CASE WHEN k % 50 = 19 THEN k - 1 ELSE k END as string) END AS mutation_entry_number,
  CASE WHEN k % 41 = 0 THEN '30/02/2018' WHEN k % 43 = 0 THEN '1-3/2018' WHEN k % 47 = 0 THEN 'March 2018' ELSE {_date("o_orderdate")} END AS mutation_date,
  CASE WHEN k % 2 = 0 THEN 'Inheritance (from | X).' ELSE 'Sale' END AS mutation_type,
  CASE WHEN k % 7 = 0 THEN NULL ELSE cast(g as string) || '/' || cast(1990 + g % 30 as string) END AS registered_document_number,
  CASE WHEN k % 5 = 0 THEN 'None' ELSE 'Office ' || n_name END AS sub_registrar_office,
  {_date("ship")} AS registration_date
FROM base
"""

#: Where a field's value came from, by record and field.
PROVENANCE = {
    "evidence_type": "CASE (seq + ordinal) % 9 WHEN 0 THEN 'layout_relationship' WHEN 1 THEN 'layout_same_line' WHEN 2 THEN 'layout_below_label' WHEN 3 THEN 'layout_table' WHEN 4 THEN 'composer_fallback' WHEN 5 THEN 'ocr_fallback' WHEN 6 THEN 'mystery' WHEN 7 THEN 'layout_relationship' END",
    "source_text": "CASE WHEN (seq + ordinal) % 10 = 0 THEN NULL ELSE field || ' line' END",
    "n_source_lines": "cast((seq + ordinal) % 4 as int)",
    "source_page": "CASE WHEN (seq + ordinal) % 11 <> 0 THEN 1 END",
    "matched_label": "CASE WHEN (seq + ordinal) % 13 = 0 THEN ' ' ELSE field END",
}
#: A row per record and field, for the oracles.
RAW_LONG = f"""
SELECT document_id, seq, field, ordinal, section, normalizer, validator,
  CASE field {" ".join(f"WHEN '{f[0]}' THEN {f[0]}" for f in FIELDS)} END AS value,
  {", ".join(f"{e} AS {c}" for c, e in PROVENANCE.items())}
FROM ({RAW_WIDE}) AS r CROSS JOIN {CATALOG}
"""

#: Positioned words of a document, 240 to a page; idx runs through the document, places start anew on each page.
WORDS = r"""
WITH split_up AS (SELECT doc_id, document_id, {split} AS w FROM {sheets}),
numbered AS (SELECT doc_id, document_id, {explode} FROM split_up),
placed AS (SELECT *, i % 240 AS k FROM numbered)
SELECT document_id, cast(floor(i / 240) as int) + 1 AS page, cast(i as int) AS idx, word AS text,
  cast((k % 12) * 90 as double) AS x, cast(cast(floor(k / 12) as int) * 40 + (k * 7) % 11 as double) AS y,
  cast(9 * length(word) as double) AS width, cast(16 + doc_id % 5 as double) AS height, cast((i * 37 + doc_id) % 101 as double) AS conf
FROM placed WHERE word <> ''
"""
WORDS_SPARK = WORDS.replace("{split}", r"split(text, '[ \\t\\n\\r\\f]+')").replace("{explode}", "posexplode(w) AS (i, word)")
WORDS_DUCK = WORDS.replace("{split}", r"regexp_split_to_array(text, '[ \t\n\r\f]+')").replace("{explode}", "unnest(range(0, len(w))) AS i, w[unnest(range(1, len(w) + 1))] AS word")

#: What rows are multiplied from; Spark deals these tables by document_id before, which later groupings use.
SOURCES = {
    "sheets": "SELECT doc_id, cast(doc_id as string) AS document_id, text FROM {documents}",
    "forms": "SELECT 'DOC-' || lpad(cast(o_orderkey as string), 8, '0') AS document_id, o_orderkey AS k, c_name, n_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey",
}

#: Recognised lines of a form for each order: sections, labels with values behind, below and to the right.
FORM = [
    ("'Landowner Details'", 0, 40), ("'Owner Name: ' || c_name || ' Village: ' || n_name", 60, 40), ("'Address'", 110, 40), ("'Lane ' || cast(k % 9 as string) || ', Ward 3'", 160, 40),
    ("'LAND IDENTIFICATION'", 300, 40), ("'Father''s Name: X' || cast(k % 5 as string) || ' District : ' || n_name", 350, 40),
    ("'Survey No. ' || cast(k as string) || '/2 Khasra Number: ' || cast(k * 7 as string)", 400, 40), ("'Khata Number'", 450, 40), ("cast(k * 3 as string) || '-A'", 452, 400),
    ("'Land Characteristics:'", 600, 40), ("'Plot Area: ' || cast(k % 90 as string) || '.50 ACRES | Land Classification: DRY'", 650, 40),
    ("'Mutation  Records'", 800, 40), ("'Mutation Date: 12/03/20' || lpad(cast(k % 20 as string), 2, '0') || ' Type; Sale'", 850, 40), ("'Latest Mutation Entry No: ' || cast(100 + k % 900 as string)", 900, 40),
    ("'REGISTRATION INFORMATION'", 1100, 40), ("'Registered Document | No. ' || cast(k as string) || '/2018'", 1150, 40), ("'Sub-Registrar Office: ' || n_name || ' ;'", 1200, 40), ("'Date - 15.03.2018'", 1250, 40),
]
LINES = (
    "SELECT document_id, 1 AS page, no AS line_no, CASE no "
    + " ".join(f"WHEN {i} THEN {text}" for i, (text, _, _) in enumerate(FORM, 1))
    + " END AS text, cast(x as double) AS x, cast(y as double) AS y, cast(200 as double) AS width, cast(30 as double) AS height, 90.0 AS conf FROM {forms} CROSS JOIN (VALUES "
    + ", ".join(f"({i}, {x}, {y})" for i, (_, y, x) in enumerate(FORM, 1)) + ") AS f(no, x, y)"
)

REGISTRY = """
SELECT 'DOC-' || lpad(cast(event_id as string), 8, '0') AS document_id, 'file' || cast(event_id as string) || CASE event_id % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.jpg' WHEN 2 THEN '.jpeg' WHEN 3 THEN '.png' ELSE '.txt' END AS original_filename,
  'stored-' || cast(event_id as string) AS stored_filename, event_id * 4000 AS size, user_id, cast(user_id % 7 as string) AS district,
  CASE WHEN event_id % 11 = 0 THEN 'CV Failed' WHEN event_id % 13 = 0 THEN 'OCR Failed' WHEN event_id % 17 = 0 THEN 'Pipeline Failed' WHEN event_type = 'purchase' THEN 'Verified' WHEN event_type = 'click' THEN 'Pending Review' WHEN event_type = 'error' THEN 'OCR Processing' WHEN event_type = 'signup' THEN 'Queued' ELSE 'CV Completed' END AS status,
  CASE WHEN event_id % 4 = 0 THEN '—' ELSE cast(cast(floor(value) as bigint) % 100 as string) || '.50%' END AS confidence, ts AS uploaded_at
FROM {events}
"""

#: Decisions of reviewers on the fields of records; events are dealt to records and fields by number.
DECISIONS = f"""
SELECT 'DOC-' || lpad(cast(event_id % 1500 as string), 8, '0') AS document_id, event_id AS event_seq,
  CASE WHEN event_type IN ('view', 'signup') THEN 'duplicate_decision' ELSE 'field_decision' END AS event,
  CASE WHEN event_type IN ('view', 'signup') THEN NULL ELSE c.field END AS field,
  CASE event_type WHEN 'click' THEN 'accepted' WHEN 'purchase' THEN 'edited' WHEN 'error' THEN 'rejected' WHEN 'view' THEN 'not_duplicate' ELSE 'confirmed_duplicate' END AS decision,
  'user' || cast(user_id as string) AS reviewer, CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 10 = 0 THEN ' ' ELSE 'edit ' || cast(event_id as string) END END AS edited_value,
  'r' || cast(event_id % 3 as string) AS reason, ts
FROM {{events}} JOIN {CATALOG} ON c.ordinal = event_id % 21
"""

#: Artifacts with faults of each kind, by number.
_WHOLE = ", ".join(f"\"{k}\":null" for k in FIELD_KEYS if k not in ("field", "source_line_ids"))
_FIELDS = " || ',' || ".join(
    f"'\"{f[0]}\":' || CASE WHEN o_orderkey % 23 = {i} THEN '7' ELSE '{{\"field\":\"' || CASE WHEN o_orderkey % 29 = {i} THEN 'other' ELSE '{f[0]}' END || '\",' || CASE WHEN o_orderkey % 31 = {i} THEN '\"source_line_ids\":\"x\"' WHEN o_orderkey % 37 = {i} THEN '\"x\":1' ELSE '\"source_line_ids\":[1,2]' END || ',{_WHOLE}}}' END"
    for i, f in enumerate(FIELDS[:-1])
)
ARTIFACTS = f"""
SELECT 'DOC-' || cast(o_orderkey as string) AS document_id, '{{"normalization_version":"1",' || CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE '"document_id":"x",' END || '"source_extraction_version":"1","summary":{{}},"fields":'
  || CASE WHEN o_orderkey % 11 = 0 THEN '5' ELSE '{{' || {_FIELDS} || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE ',"{FIELDS[-1][0]}":{{"field":"{FIELDS[-1][0]}","source_line_ids":[],{_WHOLE}}}' END || '}}' END || '}}' AS artifact
FROM {{orders}}
"""
#: Values of several JSON kinds, and times as text.
OBJECTS = """
SELECT event_id, CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '"  plain "' WHEN 2 THEN '{"text":" t' || cast(event_id as string) || ' "}' WHEN 3 THEN '{"value":5,"content":"c"}' WHEN 4 THEN '{"other":1}' WHEN 5 THEN cast(event_id as string) ELSE 'null' END AS object FROM {events}
"""
SAID_TIMES = """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' 2024-03-0' || cast(1 + event_id % 9 as string) || 'T10:20:30Z ' WHEN 3 THEN '2024-03-01T10:20:3' || cast(event_id % 10 as string) || '+05:30' ELSE '2024-02-29 01:02:03' END AS said FROM {events}
"""

#: A vector as an image of one row: what can be measured of it.
PIXELS = {
    "spark": "SELECT vec_id, posexplode(embedding) AS (pos, v), size(embedding) AS n FROM {embeddings}",
    "duck": "SELECT vec_id, unnest(range(0, len(embedding))) AS pos, embedding[unnest(range(1, len(embedding) + 1))] AS v, len(embedding) AS n FROM {embeddings}",
}
METRICS = """
SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN NULL ELSE cast(3 + vec_id % 30 as double) END AS glyph, cast((vec_id * 13) % 130 as double) AS blur, cast((vec_id * 7) % 70 as double) AS contrast,
  cast((vec_id * 3) % 20 as double) AS noise, cast((vec_id % 15) - 7 as double) AS skew, cast((vec_id * 5) % 24 as double) AS illumination, cast(vec_id % 10 as double) / 10 AS bimodality
FROM {embeddings}
"""


def spark_rows(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    dealt = {name: spark_rows(spark, sf_dir, source).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "document_id") for name, source in SOURCES.items() if "{" + name + "}" in text}
    return spark.sql(text, **used, **dealt)


def braced(text: str) -> str:
    """Text with braces of its own besides those of tables."""
    text = text.replace("{", "{{").replace("}", "}}")
    for t in TABLES:
        text = text.replace("{{" + t + "}}", "{" + t + "}")
    return text


ARTIFACTS, OBJECTS = braced(ARTIFACTS), braced(OBJECTS)


def duck(text: str) -> str:
    for name, source in SOURCES.items():
        text = text.replace("{" + name + "}", f"({source})")
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return "(" + text.replace("{{", "{").replace("}}", "}") + ")"
