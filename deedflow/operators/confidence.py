"""Confidence of fields and records, and why a field needs a person."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import (
    DUPLICATE_RISK, EVIDENCE_SCORES, HIGH, INVALID_CAP, LOW, MEDIUM, NO_EVIDENCE, NORMALIZATION_SCORES, RECORD_WEIGHTS, UNKNOWN_EVIDENCE, UNKNOWN_NORMALIZATION, UNKNOWN_VALIDATION,
    VALIDATION_SCORES, WARNING_CAP, WEIGHTS,
)
from ..functions.text import bind, blank


def looked_up(c: Column, table: dict[str, float], unknown: float, null: float) -> Column:
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.when(c.isNull(), F.lit(null)).otherwise(F.coalesce(known[c], F.lit(unknown)))


def source_completeness(text: Column, n_lines: Column, page: Column, label: Column) -> Column:
    have = [~blank(text), F.coalesce(n_lines, F.lit(0)) > 0, page.isNotNull(), ~blank(label)]
    return sum((F.when(x, 25.0).otherwise(0.0) for x in have), F.lit(0.0))


def level(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").when(score >= LOW, "low").otherwise("critical")


def score_fields(fields: DataFrame) -> DataFrame:
    """Adds component scores, confidence_score, confidence_level, confidence_review and confidence_reason."""
    status, evidence = F.col("_status"), F.col("evidence_type")
    parts = bind(
        fields, _status=F.coalesce("validation_status", F.lit("not_checked")),
        evidence_score=looked_up(evidence, EVIDENCE_SCORES, UNKNOWN_EVIDENCE, NO_EVIDENCE),
        validation_score=looked_up(F.coalesce("validation_status", F.lit("not_checked")), VALIDATION_SCORES, UNKNOWN_VALIDATION, UNKNOWN_VALIDATION),
        normalization_score=looked_up(F.col("normalization_status"), NORMALIZATION_SCORES, UNKNOWN_NORMALIZATION, UNKNOWN_NORMALIZATION),
        source_score=source_completeness(F.col("source_text"), F.col("n_source_lines"), F.col("source_page"), F.col("matched_label")),
    )
    raw = WEIGHTS["evidence"] * F.col("evidence_score") + WEIGHTS["validation"] * F.col("validation_score") + WEIGHTS["normalization"] * F.col("normalization_score") + WEIGHTS["source"] * F.col("source_score")
    capped = F.when(status == "invalid", F.least(raw, F.lit(INVALID_CAP))).when(status == "warning", F.least(raw, F.lit(WARNING_CAP))).otherwise(raw)
    scored = bind(parts, confidence_score=F.when(status == "missing", 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), capped)), 2)))
    why = F.concat_ws(
        "; ",
        F.when(status == "invalid", "Validation marked the field invalid.").when(status == "warning", "Validation produced warning(s).")
        .when(status == "not_checked", "Field was not fully validated.").when(status == "missing", "Field is missing."),
        F.when(evidence == "composer_fallback", "Field was extracted from Composer fallback evidence.").when(evidence == "ocr_fallback", "Field was extracted directly from OCR fallback evidence."),
        F.when(evidence.isNull() | (evidence == ""), "Extraction evidence type is unavailable.").when(~evidence.isin(list(EVIDENCE_SCORES)), "Extraction evidence type is unknown."),
        F.when(F.col("confidence_score") < HIGH, "Confidence is below the automatic acceptance threshold."),
        F.when(blank(F.col("source_text")), "Source evidence text is unavailable."),
    )
    needed = F.col("_why") != ""
    return bind(scored, _why=why).withColumns({
        "confidence_level": level(F.col("confidence_score")), "confidence_review": F.when(needed, "required").otherwise("not_required"),
        "confidence_reason": F.when(needed, F.col("_why")).otherwise("Field has sufficient supporting evidence."),
    }).drop("_status", "_why")


def score_records(fields: DataFrame, *more: Column) -> DataFrame:
    """One row per document: mean field confidence, completeness, record confidence and level, and more aggregates."""
    # scores have two digits: whole hundredths add up to the same sum in any order
    mean = F.sum(F.round(F.col("confidence_score") * 100).cast("long")) / (100.0 * F.count("*"))
    filled = 100.0 * F.count_if(F.col("validation_status") != "missing") / F.count("*")
    total = F.greatest(F.lit(0.0), F.least(F.lit(100.0), RECORD_WEIGHTS["fields"] * mean + RECORD_WEIGHTS["completeness"] * filled))
    half_up = lambda c: F.round(c + 1e-9, 2)  # noqa: E731  a half in decimal may be a little less in binary
    out = fields.groupBy("document_id").agg(
        half_up(mean).alias("mean_confidence"), half_up(filled).alias("completeness"), half_up(total).alias("record_confidence"),
        F.count_if(F.col("confidence_review") == "required").alias("fields_to_review"), *more,
    )
    return out.withColumn("record_level", level(F.col("record_confidence")))


def with_duplicate_risk(records: DataFrame, statuses: DataFrame) -> DataFrame:
    """Adds duplicate_status, duplicate_risk and record_review; the risk never lowers the score."""
    risk = looked_up(F.col("duplicate_status"), DUPLICATE_RISK, 0.0, 0.0)
    return (
        records.join(statuses.select("document_id", F.col("status").alias("duplicate_status")), "document_id", "left")
        .withColumn("duplicate_risk", risk)
        .withColumn("record_review", F.when((F.col("fields_to_review") > 0) | F.coalesce(F.col("duplicate_status").isin("strong_duplicate", "possible_duplicate"), F.lit(False)), "required").otherwise("not_required"))
    )
