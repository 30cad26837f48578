"""Validation of normalised fields: issues as an array column, status from the issues, summaries and cross-field rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import ARTIFACT_KEYS, FIELD_KEYS, FIELDS, GENERAL, ISO_DATE, KNOWN_UNITS, LAND, MESSAGES, NUMBER, SHARE, WARNINGS
from ..functions.text import alphanumerics, bind, blank, has_letter

ISSUE = "struct<code:string,severity:string,message:string,field:string,scope:string>"


ERRORS = [c for c in MESSAGES if c not in WARNINGS]


def issues_of(codes: Column, field: Column, scope: str = "field") -> Column:
    """The issues of a comma-separated text of codes."""
    said = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])
    severity = lambda c: F.when(c.isin(sorted(WARNINGS)), "warning").otherwise("error")
    made = F.transform(F.split(codes, ","), lambda c: F.struct(c.alias("code"), severity(c).alias("severity"), said[c].alias("message"), field.alias("field"), F.lit(scope).alias("scope")))
    return F.when(codes == "", F.array().cast(f"array<{ISSUE}>")).otherwise(made)


def rules() -> dict[str, list[tuple[str, Column]]]:
    """Conditions of each validator's issues, in the order in which they are reported.  _letters: those of a location, in lower case."""
    v, number, unit, structured = (F.col(c) for c in ("normalized_value", "area_value", "area_unit", "area_structured"))
    letters = F.col("_letters")
    n_letters = F.length(letters)
    same = F.replace(letters, F.substring(letters, 1, 1), F.lit("")) == ""
    is_number = F.coalesce(number.rlike(NUMBER), F.lit(False))
    # whole numbers of any length, compared by length and then by digits
    top, bottom = (F.regexp_replace(F.regexp_extract(v, SHARE, i), "^0+", "") for i in (1, 2))
    more = (F.length(top) > F.length(bottom)) | ((F.length(top) == F.length(bottom)) & (top > bottom))
    share_ok = v.rlike(SHARE)
    iso = v.rlike(ISO_DATE)
    return {
        "name": [("NAME_NO_LETTERS", ~has_letter(v)), ("NAME_TOO_SHORT", has_letter(v) & (alphanumerics(v) < 2)), ("NAME_SUSPICIOUS_CHARACTERS", has_letter(v) & v.rlike(r"[<>{}\[\]|]"))],
        "location": [("LOCATION_NO_LETTERS", ~has_letter(v)), ("LOCATION_REPEATED_CHARACTER", (n_letters >= 3) & same), ("LOCATION_TOO_SHORT", n_letters == 1)],
        "text": [("TEXT_NO_CONTENT", alphanumerics(v) == 0)],
        "date": [("DATE_INVALID_FORMAT", ~iso), ("DATE_INVALID_CALENDAR_DATE", iso & F.try_to_timestamp(v, F.lit("yyyy-MM-dd")).isNull())],
        "land": [("LAND_IDENTIFIER_INVALID_FORMAT", ~v.rlike(LAND))],
        "general": [("IDENTIFIER_INVALID_FORMAT", ~v.rlike(GENERAL))],
        "area": [
            ("AREA_STRUCTURE_MISSING", ~structured), ("AREA_INVALID_NUMBER", structured & ~is_number), ("AREA_NON_POSITIVE", structured & is_number & (number.try_cast("double") <= 0)),
            ("AREA_UNIT_MISSING", structured & unit.isNull()), ("AREA_UNIT_UNKNOWN", structured & unit.isNotNull() & ~unit.isin(KNOWN_UNITS)),
        ],
        "share": [("SHARE_INVALID_FORMAT", ~share_ok), ("SHARE_ZERO_DENOMINATOR", share_ok & (bottom == "")), ("SHARE_ZERO_NUMERATOR", share_ok & (bottom != "") & (top == "")), ("SHARE_EXCEEDS_WHOLE", share_ok & (bottom != "") & more)],
    }


def codes_of(some: dict[str, list[tuple[str, Column]]]) -> Column:
    """Codes of the issues that rows of these validators have, comma-separated; null for other rows."""
    out = F
    for name, own in some.items():
        out = out.when(F.col("validator") == name, F.concat_ws(",", *[F.when(when, code) for code, when in own]))
    return out


def status_of(codes: Column) -> Column:
    found = F.split(codes, ",")
    return F.when(codes.isNull(), "not_checked").when(codes == "FIELD_MISSING", "missing").when(codes == "", "valid").when(F.arrays_overlap(found, F.array(*map(F.lit, ERRORS))), "invalid").otherwise("warning")


def validate_fields(fields: DataFrame) -> DataFrame:
    """Adds validation_issues and validation_status to normalised rows with validator; unknown validators are not_checked."""
    known = list(rules().items())
    v = F.col("normalized_value")
    judged = bind(fields, _codes=F.when(blank(v), "FIELD_MISSING"), _letters=F.when(F.col("validator") == "location", F.lower(F.regexp_replace(v, r"\P{L}", ""))))
    for some in (known[:3], known[3:6], known[6:]):
        judged = bind(judged, _codes=F.coalesce("_codes", codes_of(dict(some))))
    # not bound: made from bound columns, and left out where nothing reads it
    return judged.withColumns({"validation_issues": issues_of(F.coalesce("_codes", F.lit("")), F.col("field")), "validation_status": status_of(F.col("_codes"))}).drop("_codes", "_letters")


def cross_field_issues(fields: DataFrame) -> DataFrame:
    """(document_id, code, severity): registration before mutation, both valid dates, by conditional aggregation."""
    day = lambda name: F.max(F.when(F.col("field") == name, F.try_to_timestamp("normalized_value", F.lit("yyyy-MM-dd"))))
    both = fields.groupBy("document_id").agg(day("mutation_date").alias("mutated"), day("registration_date").alias("registered"))
    return both.filter("registered < mutated").select("document_id", F.lit("DATE_ORDER_REVIEW").alias("code"), F.lit("warning").alias("severity"))


def apply_cross_issues(fields: DataFrame, issues: DataFrame) -> DataFrame:
    """Cross-field issues (document_id, field, severity) that name a field change its status: error to invalid, warning lifts valid."""
    worst = issues.filter("field IS NOT NULL").groupBy("document_id", "field").agg(F.max((F.col("severity") == "error").cast("int")).alias("is_error"))
    status = F.when(F.col("is_error") == 1, "invalid").when((F.col("is_error") == 0) & (F.col("validation_status") == "valid"), "warning").otherwise(F.col("validation_status"))
    return fields.join(worst, ["document_id", "field"], "left").withColumn("validation_status", status).drop("is_error")


def issue_list(fields: DataFrame) -> DataFrame:
    """All issues, of fields and across fields, as rows."""
    own = fields.select("document_id", F.explode_outer("validation_issues").alias("x")).filter("x IS NOT NULL").select("document_id", "x.field", "x.code", "x.severity", "x.scope")
    cross = cross_field_issues(fields).select("document_id", F.lit(None).cast("string").alias("field"), "code", "severity", F.lit("cross_field").alias("scope"))
    return own.unionByName(cross)


def status_counts(fields: DataFrame, keys: list[str]) -> DataFrame:
    is_status = lambda s: F.count_if(F.col("validation_status") == s).alias(s)
    of = lambda s: F.sum(F.size(F.filter("validation_issues", lambda x: x["severity"] == s))).alias(f"{s}s")
    return fields.groupBy(*keys).agg(*[is_status(s) for s in ("valid", "warning", "invalid", "missing", "not_checked")], of("error"), of("warning"))


def completed(fields: DataFrame) -> DataFrame:
    """Every document with every expected field: those without a row get one with nulls."""
    held = [c for c in fields.columns if c not in ("document_id", "field")]
    of = F.when(F.col("document_id").isNotNull() & F.col("field").isin(*[f[0] for f in FIELDS]), F.struct("field", *held))
    documents = fields.groupBy("document_id").agg(F.collect_list(of).alias("rows"))
    missing = F.array_except(F.array(*[F.lit(f[0]) for f in FIELDS]), F.col("rows.field"))
    none = [F.lit(None).cast(t).alias(c) for c, t in fields.dtypes if c in held]
    return documents.select("document_id", F.inline(F.concat("rows", F.transform(missing, lambda f: F.struct(f.alias("field"), *none)))))


def missing_fields(fields: DataFrame) -> DataFrame:
    """(document_id, field) that are expected but have no row."""
    return completed(fields.select("document_id", "field").distinct().withColumn("there", F.lit(1))).filter("there IS NULL").select("document_id", "field")


def structure_issues(artifacts: DataFrame) -> DataFrame:
    """Faults of JSON artifacts (document_id, artifact) as (document_id, code, field): missing keys, fields that are absent or
    not objects, lack metadata, have another name or line ids that aren't a list."""
    json, none = F.col("artifact"), F.lit(None).cast("string")
    top = bind(artifacts.select("document_id", "artifact"), m=F.from_json(json, "map<string,string>"))
    top = bind(top, fields=F.from_json(F.col("m")["fields"], "map<string,string>"))
    row = lambda code, field: F.struct(F.lit(code).alias("code"), field.alias("field"))
    keys = F.array(*[F.when(~F.coalesce(F.map_contains_key("m", F.lit(k)), F.lit(False)), row("STRUCTURE_MISSING_TOP_LEVEL_KEY", none)) for k in ARTIFACT_KEYS])
    whole = F.array(F.when(F.col("fields").isNull(), row("STRUCTURE_INVALID_FIELDS", none)))
    absent = F.array(*[F.when(~F.map_contains_key("fields", F.lit(f[0])), row("STRUCTURE_FIELD_ABSENT", F.lit(f[0]))) for f in FIELDS])
    found = top.select("document_id", F.explode(F.concat(keys, whole, F.coalesce(absent, F.array().cast("array<struct<code:string,field:string>>")))).alias("x")).filter("x IS NOT NULL")
    own = bind(top.select("document_id", F.explode("fields").alias("name", "value")), of=F.from_json("value", "map<string,string>"))
    is_object = F.coalesce(F.col("value").startswith("{"), F.lit(False))
    lacks = [F.when(is_object & ~F.coalesce(F.map_contains_key("of", F.lit(k)), F.lit(False)), row("STRUCTURE_MISSING_FIELD_METADATA", F.col("name"))) for k in FIELD_KEYS]
    ids = F.col("of")["source_line_ids"]
    faults = F.array(
        F.when(~is_object, row("STRUCTURE_INVALID_FIELD_OBJECT", F.col("name"))), *lacks, F.when(is_object & (F.col("of")["field"] != F.col("name")), row("STRUCTURE_FIELD_NAME_MISMATCH", F.col("name"))),
        F.when(is_object & ids.isNotNull() & ~ids.startswith("["), row("STRUCTURE_INVALID_SOURCE_LINE_IDS", F.col("name"))),
    )
    return found.unionByName(own.select("document_id", F.explode(faults).alias("x")).filter("x IS NOT NULL")).select("document_id", "x.code", "x.field")


def structure_summary(artifacts: DataFrame) -> DataFrame:
    """One row per artifact: how many structural errors it has, and whether it is structurally valid."""
    counts = structure_issues(artifacts).groupBy("document_id").agg(F.count("*").alias("structural_errors"))
    return artifacts.select("document_id").join(counts, "document_id", "left").fillna(0, ["structural_errors"]).withColumn("structurally_valid", F.col("structural_errors") == 0)
