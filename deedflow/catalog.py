"""Fields, labels, sections, scores and thresholds that results depend on."""

SECTIONS = ["LANDOWNER DETAILS", "LAND IDENTIFICATION", "LAND CHARACTERISTICS", "OWNERSHIP DETAILS", "MUTATION RECORDS", "REGISTRATION INFORMATION"]

# field, section, normalizer, validator, labels
FIELDS = [
    ("owner_name", "LANDOWNER DETAILS", "name", "name", ["owner name", "name"]),
    ("father_name", "LANDOWNER DETAILS", "name", "name", ["father's name", "father name"]),
    ("address", "LANDOWNER DETAILS", "text", "text", ["address"]),
    ("village", "LAND IDENTIFICATION", "location", "location", ["village"]),
    ("tehsil", "LAND IDENTIFICATION", "location", "location", ["tehsil", "tahsil"]),
    ("district", "LAND IDENTIFICATION", "location", "location", ["district"]),
    ("survey_number", "LAND IDENTIFICATION", "identifier", "land", ["survey number", "survey no"]),
    ("khasra_number", "LAND IDENTIFICATION", "identifier", "land", ["khasra number", "khasra no", "khssra number"]),
    ("khata_number", "LAND IDENTIFICATION", "identifier", "land", ["khata number", "khata no", "account number", "account no"]),
    ("plot_area", "LAND CHARACTERISTICS", "area", "area", ["plot area"]),
    ("land_classification", "LAND CHARACTERISTICS", "text", "text", ["land classification", "classification"]),
    ("serial_number", "OWNERSHIP DETAILS", "identifier", "general", ["serial number", "serial no", "sr no", "s no"]),
    ("ownership_owner_name", "OWNERSHIP DETAILS", "name", "name", ["owner name"]),
    ("ownership_share", "OWNERSHIP DETAILS", "share", "share", ["ownership share", "share"]),
    ("nature_of_rights", "OWNERSHIP DETAILS", "text", "text", ["nature of rights", "nature of right"]),
    ("mutation_entry_number", "MUTATION RECORDS", "identifier", "general", ["latest mutation entry number", "latest mutation entry no", "mutation entry number", "mutation entry no"]),
    ("mutation_date", "MUTATION RECORDS", "date", "date", ["mutation date", "date"]),
    ("mutation_type", "MUTATION RECORDS", "text", "text", ["mutation type", "type"]),
    ("registered_document_number", "REGISTRATION INFORMATION", "identifier", "general", ["registered document number", "registered document no", "document number", "document no"]),
    ("sub_registrar_office", "REGISTRATION INFORMATION", "text", "text", ["sub registrar office", "sub-registrar office", "sub registrar"]),
    ("registration_date", "REGISTRATION INFORMATION", "date", "date", ["registration date", "date"]),
]
FIELD_NAMES = [f[0] for f in FIELDS]
#: Identifiers that may prove a duplicate, in order of evidence; the last three are the land identifiers.
IDENTIFIERS = ["registered_document_number", "mutation_entry_number", "survey_number", "khasra_number", "khata_number"]

IDENTIFIER_LABELS = {"registered_document_number": "Registered document number", "mutation_entry_number": "Mutation entry number", "survey_number": "Survey number", "khasra_number": "Khasra number", "khata_number": "Khata number"}

NULL_TOKENS = ["", "none", "null", "nil", "n/a", "na", "not available", "not applicable", "-", "--"]
AREA_UNITS = {"acre": "acre", "acres": "acre", "hectare": "hectare", "hectares": "hectare", "ha": "hectare", "sqm": "square_meter", "sq m": "square_meter", "sq. m": "square_meter"}
KNOWN_UNITS = ["acre", "hectare", "square_meter"]

EVIDENCE_SCORES = {"layout_relationship": 100.0, "layout_same_line": 90.0, "layout_below_label": 82.0, "layout_table": 90.0, "composer_fallback": 72.0, "ocr_fallback": 62.0}
UNKNOWN_EVIDENCE, NO_EVIDENCE = 40.0, 0.0
VALIDATION_SCORES = {"valid": 100.0, "warning": 55.0, "invalid": 15.0, "missing": 0.0, "not_checked": 40.0}
UNKNOWN_VALIDATION = 40.0
NORMALIZATION_SCORES = {"normalized": 100.0, "missing": 0.0}
UNKNOWN_NORMALIZATION = 50.0
WEIGHTS = {"evidence": 0.30, "validation": 0.40, "normalization": 0.15, "source": 0.15}
RECORD_WEIGHTS = {"fields": 0.75, "completeness": 0.25}
HIGH, MEDIUM, LOW = 85.0, 65.0, 40.0
INVALID_CAP, WARNING_CAP = 39.0, 64.0
DUPLICATE_RISK = {"strong_duplicate": 100.0, "possible_duplicate": 70.0, "insufficient_evidence": 30.0, "not_duplicate": 0.0}
DUPLICATE_RANK = {"strong_duplicate": 4, "possible_duplicate": 3, "insufficient_evidence": 2, "not_duplicate": 1}

LAYOUT = {"line_tolerance": 15.0, "line_factor": 0.6, "block_gap": 80.0, "block_factor": 3.0, "column_tolerance": 40.0, "min_lines": 2, "min_columns": 2, "column_break": 300.0, "default_height": 20.0, "below": 2.0, "right": 15.0, "overlap": 0.5}
LAYOUT_LABELS = [
    ("Name", "Name"), ("Father's Name", "Father.?s Name"), ("Address", "Address"), ("Village", "Village"), ("Tehsil", "Tehsil"), ("District", "District"),
    ("Survey Number", r"Survey Number|Survey No\.?"), ("Khasra Number", r"Khasra Number|Khasra No\.?|Khssra Number"), ("Khata Number", r"Khata Number|Account No\.?"),
    ("Plot Area", "Plot Area"), ("Land Classification", "Land Classification"),
]

QUALITY = {"glyph": 24.0, "max_scale": 4.0, "contrast": 35.0, "noise": 12.0, "skew": 1.0, "illumination": 12.0, "bimodality": 0.35, "severe_blur": 40.0, "blur": 80.0}

UPLOAD_SUFFIXES = ["pdf", "jpg", "jpeg", "png"]
UPLOAD_LIMIT = 25 * 1024 * 1024
FAILED_STATUSES = ["CV Failed", "OCR Failed"]
ACTIVE_STATUSES = ["Queued", "CV Processing", "CV Completed", "OCR Processing", "Pipeline Processing"]
PIPELINE_STEPS = ["upload", "preprocess", "ocr", "extract", "verify", "complete"]

# Patterns of valid values.
LAND = r"^[A-Za-z0-9]+(?:[/-][A-Za-z0-9]+)*$"
GENERAL = r"^[A-Za-z0-9]+(?:[./_-][A-Za-z0-9]+)*$"
SHARE = r"^(\d+)/(\d+)(?:\s*\([^()]+\))?$"
NUMBER = r"^\d+(?:\.\d+)?$"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"

# What issues say, and which of them are warnings.
MESSAGES = {
    "FIELD_MISSING": "Field is missing.",
    "NAME_NO_LETTERS": "Name does not contain alphabetic characters.",
    "NAME_TOO_SHORT": "Name is unusually short.",
    "NAME_SUSPICIOUS_CHARACTERS": "Name contains unusual characters.",
    "LOCATION_NO_LETTERS": "Location does not contain alphabetic characters.",
    "LOCATION_REPEATED_CHARACTER": "Location contains an unusually repeated single character and may be OCR noise.",
    "LOCATION_TOO_SHORT": "Location is unusually short.",
    "TEXT_NO_CONTENT": "Text contains no alphanumeric content.",
    "DATE_INVALID_FORMAT": "Date must use normalized YYYY-MM-DD format.",
    "DATE_INVALID_CALENDAR_DATE": "Date is not a valid calendar date.",
    "LAND_IDENTIFIER_INVALID_FORMAT": "Land identifier contains an invalid structure.",
    "IDENTIFIER_INVALID_FORMAT": "Identifier contains an invalid structure.",
    "AREA_STRUCTURE_MISSING": "Area does not contain normalized numeric/unit structure.",
    "AREA_INVALID_NUMBER": "Area does not contain a valid numeric value.",
    "AREA_NON_POSITIVE": "Area must be greater than zero.",
    "AREA_UNIT_MISSING": "Area value does not include a unit.",
    "AREA_UNIT_UNKNOWN": "Unrecognized area unit.",
    "SHARE_INVALID_FORMAT": "Ownership share must use a fraction such as '1/1' or '1/2', optionally followed by text in parentheses.",
    "SHARE_ZERO_DENOMINATOR": "Ownership share denominator cannot be zero.",
    "SHARE_ZERO_NUMERATOR": "Ownership share numerator is zero.",
    "SHARE_EXCEEDS_WHOLE": "Ownership share numerator exceeds denominator.",
    "DATE_ORDER_REVIEW": "Registration date is earlier than mutation date.",
}
WARNINGS = {"FIELD_MISSING", "NAME_TOO_SHORT", "NAME_SUSPICIOUS_CHARACTERS", "LOCATION_REPEATED_CHARACTER", "LOCATION_TOO_SHORT", "AREA_UNIT_MISSING", "SHARE_ZERO_NUMERATOR", "SHARE_EXCEEDS_WHOLE", "DATE_ORDER_REVIEW"}

# Characters that texts are folded from and to.
DEVANAGARI = "०१२३४५६७८९"
QUOTES_FROM, QUOTES_TO = "’‘“”–—", "''\"\"--"

# Keys that artifacts and their fields must have.
ARTIFACT_KEYS = ["normalization_version", "source_extraction_version", "document_id", "summary", "fields"]
FIELD_KEYS = ["field", "value", "status", "confidence", "section", "source_text", "source_line_ids", "source_page", "evidence_type", "matched_label", "raw_value", "normalized_value", "structured_value", "normalization_status"]
# What tables and page ends look like in composed texts.
TABLE_HEAD = "[TABLE - structure detected heuristically, unvalidated]"
