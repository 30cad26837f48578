"""A query for each operator, over the driver's tables seen as records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import FIELD_NAMES, FIELDS, IDENTIFIERS
from ..functions import text as T
from ..functions.scratch import written
from ..operators import compose, confidence, dashboard, duplicates, extract, layout, normalize, quality, review, store, validate
from . import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def rows(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return A.spark_rows(spark, sf_dir, text)


def raw(spark: SparkSession, sf_dir: str, more: DataFrame | None = None) -> DataFrame:
    """A row for each record and field.  Records are dealt by document_id before the fields multiply them, which later groupings
    by document_id use as it is.  more: (document_id, one column) of some documents, a column of their fields."""
    records = rows(spark, sf_dir, A.RAW_WIDE).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "document_id")
    fields = ", ".join(f"named_struct('field', '{f[0]}', 'ordinal', {i}, 'section', '{f[1]}', 'normalizer', '{f[2]}', 'validator', '{f[3]}', 'value', {f[0]})" for i, f in enumerate(FIELDS))
    held = records.columns[:2] if more is None else [*records.columns[:2], more.columns[1]]
    records = records if more is None else records.join(more, "document_id", "left")
    return records.selectExpr(*held, f"inline(array({fields}))").selectExpr("*", *[f"{e} AS {c}" for c, e in A.PROVENANCE.items()])


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.normalize_fields(raw(spark, sf_dir))


def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validate_fields(normalized(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confidence.score_fields(validated(spark, sf_dir))


def _one(field: str, rule: Callable) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        wide = rows(spark, sf_dir, A.RAW_WIDE)
        return wide.select("document_id", rule(F.col(field)).alias("out"))

    return run


QUERIES |= {
    "norm_digits": _one("survey_number", T.ascii_digits),
    "norm_whitespace": _one("tehsil", T.plain_space),
    "norm_unicode": _one("owner_name", T.plain_unicode),
    "norm_null": _one("owner_name", normalize.null_token),
    "norm_text": _one("address", normalize.text_value),
    "norm_name": _one("father_name", normalize.name_value),
    "norm_location": _one("tehsil", normalize.text_value),
    "norm_identifier": _one("survey_number", normalize.identifier_value),
    "norm_date": _one("mutation_date", normalize.date_value),
    "norm_share": _one("ownership_share", normalize.share_value),
    "clean_value": _one("mutation_type", T.clean_value),
    "match_form": _one("land_classification", T.match_form),
    "folded_text": _one("tehsil", T.folded),
}


@query
def norm_area(spark, sf_dir):
    wide = rows(spark, sf_dir, A.RAW_WIDE)
    a = F.col("a")
    return T.bind(wide.withColumn("t", T.ascii_digits(normalize.null_token(F.col("plot_area")))), a=normalize.as_area(F.col("t"))).select("document_id", a["text"].alias("out"), a["value"].alias("value"), a["unit"].alias("unit"))


@query
def norm_fields(spark, sf_dir):
    return normalized(spark, sf_dir).select("document_id", "field", "raw_value", "normalized_value", "area_unit", "normalization_status")


@query
def norm_summary(spark, sf_dir):
    return normalize.normalization_summary(normalized(spark, sf_dir), ["field"])


@query
def valid_fields(spark, sf_dir):
    codes = F.array_join(F.col("validation_issues")["code"], ",")
    return validated(spark, sf_dir).select("document_id", "field", "normalized_value", "validation_status", codes.alias("codes"))


@query
def valid_issue_list(spark, sf_dir):
    return validate.issue_list(validated(spark, sf_dir)).groupBy("field", "code", "severity", "scope").agg(F.count("*").alias("n"))


@query
def valid_status_counts(spark, sf_dir):
    return validate.status_counts(validated(spark, sf_dir), ["document_id"])


@query
def valid_cross_dates(spark, sf_dir):
    return validate.cross_field_issues(normalized(spark, sf_dir))


@query
def valid_apply_cross(spark, sf_dir):
    fields = validated(spark, sf_dir)
    late = validate.cross_field_issues(fields).select("document_id", F.lit("registration_date").alias("field"), "severity")
    return validate.apply_cross_issues(fields, late).groupBy("field", "validation_status").agg(F.count("*").alias("n"))


@query
def valid_missing_fields(spark, sf_dir):
    return validate.missing_fields(raw(spark, sf_dir).filter(F.col("value").isNotNull()))


def _artifacts(spark, sf_dir):
    return rows(spark, sf_dir, A.ARTIFACTS)


@query
def valid_structure(spark, sf_dir):
    return validate.structure_issues(_artifacts(spark, sf_dir)).groupBy("code", "field").agg(F.count("*").alias("n"))


@query
def valid_structure_summary(spark, sf_dir):
    return validate.structure_summary(_artifacts(spark, sf_dir))


@query
def conf_field(spark, sf_dir):
    return scored(spark, sf_dir).select("document_id", "field", "evidence_score", "validation_score", "normalization_score", "source_score", "confidence_score", "confidence_level", "confidence_review")


@query
def conf_review_reasons(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("confidence_reason", "confidence_review").agg(F.count("*").alias("n"))


@query
def conf_level_counts(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("field", "confidence_level").agg(F.count("*").alias("n"))


@query
def conf_record(spark, sf_dir):
    return confidence.score_records(scored(spark, sf_dir))


def _ids(spark, sf_dir):
    fields = normalize.normalize_fields(raw(spark, sf_dir).filter(F.col("field").isin(IDENTIFIERS)))
    ids = duplicates.usable_identifiers(validate.validate_fields(fields))
    records = rows(spark, sf_dir, A.RAW_WIDE).select("document_id", "seq")
    return ids, duplicates.masks(ids, records)


@query
def dup_identifiers(spark, sf_dir):
    return _ids(spark, sf_dir)[0]


@query
def dup_pairs(spark, sf_dir):
    ids, of = _ids(spark, sf_dir)
    return duplicates.matched_pairs(ids, of).select("document_id", "other_id", "matched", "status", "n_matched", "n_conflicting", "n_missing")


@query
def dup_evidence(spark, sf_dir):
    ids, of = _ids(spark, sf_dir)
    return duplicates.with_evidence(duplicates.matched_pairs(ids, of)).select("document_id", "other_id", "status", "matched_identifiers", "conflicting_identifiers", "missing_identifiers", "match_reason")


@query
def dup_best_match(spark, sf_dir):
    # written once: matches, first records, their number and the result all read it
    return duplicates.assess_records(written(duplicates.identified(rows(spark, sf_dir, A.RAW_WIDE))), written)


def _statuses(spark, sf_dir):
    """Written, so that what duplicates shuffle is gone before records are scored."""
    return written(dup_best_match(spark, sf_dir).select("document_id", "status"))


@query
def dup_summary(spark, sf_dir):
    return dup_best_match(spark, sf_dir).groupBy("status").agg(F.count("*").alias("records"), F.sum("n_compared").alias("compared"))


@query
def conf_duplicate_risk(spark, sf_dir):
    return confidence.with_duplicate_risk(conf_record(spark, sf_dir), _statuses(spark, sf_dir)).select("document_id", "record_confidence", "record_level", "duplicate_status", "duplicate_risk", "record_review")


def _review(spark, sf_dir):
    fields = raw(spark, sf_dir, review.decisions_by_document(rows(spark, sf_dir, A.DECISIONS)))
    return review.apply_decided(review.open_review(confidence.score_fields(validate.validate_fields(normalize.normalize_fields(fields)))))


@query
def review_queue(spark, sf_dir):
    return review.pending_fields(_review(spark, sf_dir))


@query
def review_latest_decision(spark, sf_dir):
    return review.latest_decisions(rows(spark, sf_dir, A.DECISIONS)).select("document_id", "field", "decision", "edited_value", "reviewer", "n_decisions", "event_seq")


@query
def review_before_after(spark, sf_dir):
    return review.decision_history(rows(spark, sf_dir, A.DECISIONS))


@query
def review_summary(spark, sf_dir):
    return review.review_summary(_review(spark, sf_dir), _statuses(spark, sf_dir), review.duplicate_decisions(rows(spark, sf_dir, A.DECISIONS)))


@query
def review_reasons(spark, sf_dir):
    r = review.review_reasons(F.col("confidence_reason"), F.col("confidence_review"), F.col("validation_issues"))
    return scored(spark, sf_dir).select(F.array_join(r, " / ").alias("reasons")).groupBy("reasons").agg(F.count("*").alias("n"))


@query
def review_verified_wide(spark, sf_dir):
    return review.verified_wide(_review(spark, sf_dir), FIELD_NAMES)


def _stored(spark, sf_dir):
    registry = rows(spark, sf_dir, A.REGISTRY).select("document_id", "status", "uploaded_at", F.col("uploaded_at").alias("created_in_database_at"))
    late = F.expr("timestamp'2030-01-01 00:00:00'")
    new = registry.filter(F.substring("document_id", -1, 1).isin("1", "2", "3")).select(F.when(F.col("document_id").endswith("3"), F.concat("document_id", F.lit("-N"))).otherwise(F.col("document_id")).alias("document_id"), F.lit("Verified").alias("status"), late.alias("uploaded_at"), late.alias("created_in_database_at"))
    return registry, new


@query
def store_upsert_documents(spark, sf_dir):
    old, new = _stored(spark, sf_dir)
    out = store.upsert(old, new, ["document_id"], ["created_in_database_at"])
    return out.select("document_id", "status", F.date_format("uploaded_at", "yyyy-MM-dd HH:mm:ss").alias("uploaded_at"), F.date_format("created_in_database_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@query
def store_upsert_fields(spark, sf_dir):
    old = normalized(spark, sf_dir).select("document_id", "field", "normalized_value")
    new = review.latest_decisions(rows(spark, sf_dir, A.DECISIONS)).filter("decision = 'edited'").select("document_id", "field", F.col("edited_value").alias("normalized_value"))
    return store.upsert(old, new, ["document_id", "field"])


@query
def store_evidence(spark, sf_dir):
    blank = lambda c: F.when(F.col("seq") % 3 != 0, F.col(c))
    fields = raw(spark, sf_dir).select("document_id", "field", *[blank(c).alias(c) for c in ("source_text", "source_page", "evidence_type", "matched_label")])
    return store.evidence_rows(fields)


@query
def store_audit(spark, sf_dir):
    out = store.audit_rows(rows(spark, sf_dir, A.DECISIONS))
    return out.select("document_id", "event_type", "field_name", "decision", "reviewer", "human_reason", F.get_json_object("event", "$.event_seq").cast("long").alias("seq"))


@query
def store_regroup(spark, sf_dir):
    out = store.regroup(validated(spark, sf_dir))
    return out.select("document_id", F.size("fields").alias("n_fields"), F.col("fields")["district"]["normalized_value"].alias("district"), F.col("fields")["plot_area"]["validation_status"].alias("area_status"))


def _registry(spark, sf_dir):
    return rows(spark, sf_dir, A.REGISTRY)


@query
def list_recent(spark, sf_dir):
    return dashboard.recent(_registry(spark, sf_dir)).select("document_id", "status", "original_filename")


@query
def doc_lookup(spark, sf_dir):
    artifacts = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("DOC-"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("document_id"))
    return dashboard.lookup(_registry(spark, sf_dir), "DOC-00000143", artifacts).select("document_id", "status", "ocr_result_exists", "can_retry")


@query
def kpi(spark, sf_dir):
    return dashboard.indicators(dashboard.recent(_registry(spark, sf_dir)))


@query
def kpi_all(spark, sf_dir):
    return dashboard.indicators(_registry(spark, sf_dir))


@query
def facet_filter(spark, sf_dir):
    return dashboard.facets(_registry(spark, sf_dir), {"status": "Verified", "district": "3", "original_filename": "All types"}).select("document_id", "status", "district")


@query
def keyword_search(spark, sf_dir):
    return dashboard.keyword(_registry(spark, sf_dir), "  OCR proc", ["document_id", "original_filename", "status"]).select("document_id", "status")


@query
def status_steps(spark, sf_dir):
    return dashboard.step_states(_registry(spark, sf_dir))


@query
def status_buckets(spark, sf_dir):
    return _registry(spark, sf_dir).groupBy(dashboard.bucket(F.col("status")).alias("bucket"), "status").agg(F.count("*").alias("n"))


@query
def retry_eligible(spark, sf_dir):
    r = _registry(spark, sf_dir)
    return dashboard.retry_eligible(r, r.filter(F.col("user_id") % 3 == 0)).select("document_id", "mode")


@query
def date_parts(spark, sf_dir):
    day, time = dashboard.date_parts(F.col("uploaded_at"))
    return _registry(spark, sf_dir).select("document_id", day.alias("day"), time.alias("time"))


@query
def serialize_documents(spark, sf_dir):
    return dashboard.serialized(_registry(spark, sf_dir))


@query
def confidence_text(spark, sf_dir):
    number = dashboard.percent_value(F.col("confidence"))
    return _registry(spark, sf_dir).select("document_id", number.alias("number"), F.coalesce(dashboard.percent_text(number), F.lit("—")).alias("shown"))


@query
def upload_filter(spark, sf_dir):
    return _registry(spark, sf_dir).filter(dashboard.upload_accepted(F.col("original_filename"), F.col("size"))).select("document_id", "original_filename", "size")


@query
def upload_prepend(spark, sf_dir):
    r = _registry(spark, sf_dir).select("document_id", "status")
    new = r.filter(F.col("document_id").endswith("7")).withColumn("status", F.lit("Queued"))
    return dashboard.prepend(new, r)


@query
def status_latest(spark, sf_dir):
    log = _registry(spark, sf_dir).select(F.concat(F.lit("U"), "user_id").alias("document_id"), "status", F.substring("document_id", 5, 8).cast("long").alias("event_seq"))
    return dashboard.latest_status(log)


def _words(spark, sf_dir):
    return rows(spark, sf_dir, A.WORDS_SPARK)


@query
def ocr_page_conf(spark, sf_dir):
    return layout.page_confidence(_words(spark, sf_dir))


def _pages(spark, sf_dir):
    return _words(spark, sf_dir).withColumn("page", F.floor(F.col("idx") / 60).cast("int"))


@query
def ocr_doc_conf(spark, sf_dir):
    return layout.document_confidence(layout.page_confidence(_pages(spark, sf_dir)))


@query
def ocr_text(spark, sf_dir):
    pages = layout.ordered_text(_pages(spark, sf_dir), ["document_id", "page"], "idx", " ")
    return layout.ordered_text(pages, ["document_id"], "page", "\n\n").select("document_id", F.sha2("text", 256).alias("text_sha256"))


@query
def layout_lines(spark, sf_dir):
    return layout.lines_of(_words(spark, sf_dir)).select("document_id", "page", "line_no", F.sha2("text", 256).alias("text_sha256"), "x", "y", "width", "height", "conf", "n")


def _bands(spark, sf_dir):
    """Lines by bands of 40 rows, with a gap of 120 before every seventh band."""
    words = _words(spark, sf_dir).withColumn("line_no", F.floor(F.col("y") / 40).cast("int")).withColumn("y", F.col("y") + 120 * F.floor((F.col("line_no") + 3) / 7))
    return words, layout.boxes(words, [*layout.PAGE, "line_no"], ["x", "idx"], " ")


@query
def layout_blocks(spark, sf_dir):
    blocks = layout.blocks_of(_bands(spark, sf_dir)[1])
    return blocks.select("document_id", "page", "block_no", F.sha2("text", 256).alias("text_sha256"), "x", "y", "width", "height", "conf", "n")


def _beside(some: str):
    """x, where some words come so near to the next place that both are in one column."""
    return F.when(F.expr(some), F.col("x") + 60).otherwise(F.col("x"))


@query
def layout_columns(spark, sf_dir):
    words = _bands(spark, sf_dir)[0].withColumn("x", _beside("idx % 5 = 2"))
    return layout.columns_of(words, [*layout.PAGE, "line_no"])


@query
def layout_tables(spark, sf_dir):
    words = _bands(spark, sf_dir)[0].withColumn("block_no", F.floor(F.col("line_no") / 4).cast("int")).withColumn("x", _beside("(idx * 7 + line_no) % 3 = 0"))
    return layout.table_cells(words).select("document_id", "page", "block_no", "line_no", "column_no", "text")


def _lines(spark, sf_dir):
    return rows(spark, sf_dir, A.LINES)


@query
def layout_sections(spark, sf_dir):
    return layout.number_sections(_lines(spark, sf_dir)).select("document_id", "line_no", "name", "section_no")


@query
def section_fill(spark, sf_dir):
    return layout.fill_sections(_lines(spark, sf_dir)).select("document_id", "line_no", "header", "section")


@query
def reading_order(spark, sf_dir):
    # Even documents have one column; of the others, the right half is a column of its own.
    x = F.when(F.col("document_id").cast("long") % 2 == 0, F.col("x") / 9).when(F.col("x") >= 540, F.col("x") + 300).otherwise(F.col("x"))
    words = _words(spark, sf_dir).select(*layout.PAGE, F.col("idx").alias("block_no"), x.alias("x"), "y")
    return layout.reading_order(words).select("document_id", "page", "block_no", "pos")


@query
def relationships(spark, sf_dir):
    return layout.relationships(_lines(spark, sf_dir)).select("document_id", "line_no", F.col("no").alias("hit_no"), "label", "value", "relation", "target_line")


def _cells(spark, sf_dir):
    """Two lines of each form as a table, a cell for each part between bars."""
    parts = _lines(spark, sf_dir).filter("line_no IN (11, 12)").select(*layout.PAGE, "line_no", F.posexplode(F.split("text", r" \| ")).alias("at", "text"))
    return parts.select(*layout.PAGE, F.lit(1).alias("table_no"), "line_no", (F.col("at") + 1).alias("column_no"), "text")


def _composed(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return compose.document_texts(compose.page_texts(compose.text_blocks(lines, layout.relationships(lines), compose.render_tables(_cells(spark, sf_dir)))))


@query
def compose_text(spark, sf_dir):
    return _composed(spark, sf_dir)


@query
def compose_tables(spark, sf_dir):
    return compose.render_tables(_cells(spark, sf_dir)).select("document_id", "line_no", "text")


@query
def layout_summary(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    tables = _cells(spark, sf_dir).select("document_id", "page", "table_no").distinct()
    return layout.summary(lines, layout.blocks_of(lines), layout.number_sections(lines), layout.relationships(lines), tables)


@query
def extract_text_lines(spark, sf_dir):
    return extract.text_lines(_composed(spark, sf_dir)).select("document_id", "line_no", "text", "header", "section")


@query
def extract_text_fallback(spark, sf_dir):
    return extract.from_lines(extract.text_lines(_composed(spark, sf_dir)), "composer_fallback").select("document_id", "line_no", "field", "value", "evidence_type")


@query
def extract_ocr_fallback(spark, sf_dir):
    return extract.from_lines(extract.ocr_lines(_lines(spark, sf_dir)), "ocr_fallback").select("document_id", "line_no", "field", "value", "evidence_type")


@query
def extract_object_text(spark, sf_dir):
    return rows(spark, sf_dir, A.OBJECTS).select("event_id", extract.object_text(F.col("object")).alias("text"))


@query
def parse_timestamps(spark, sf_dir):
    parsed = dashboard.parse_timestamp(F.col("said"))
    return rows(spark, sf_dir, A.SAID_TIMES).select("event_id", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("at"))


def _sectioned(spark, sf_dir):
    return layout.fill_sections(_lines(spark, sf_dir))


@query
def extract_label_value(spark, sf_dir):
    return extract.from_lines(_sectioned(spark, sf_dir), "layout_same_line").select("document_id", "line_no", "field", "raw", "value", "label")


@query
def extract_below(spark, sf_dir):
    return extract.below_labels(_sectioned(spark, sf_dir)).select("document_id", "line_no", "field", "value")


@query
def extract_first_wins(spark, sf_dir):
    lines = _sectioned(spark, sf_dir)
    columns = ["document_id", "page", "line_no", "field", "value", "evidence_type"]
    found = extract.from_relationships(layout.relationships(lines)).select(*columns).unionByName(extract.beside_and_below(lines).select(*columns))
    return extract.first_wins(found).select("document_id", "field", "value", "evidence_type", "line_no")


@query
def extract_complete(spark, sf_dir):
    found = extract_first_wins(spark, sf_dir)
    return extract.extraction_summary(validate.completed(found))


@query
def extract_table_rows(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    cells = F.array(F.when(k % 3 == 0, "Serial No").otherwise(k.cast("string")), F.when(k % 3 == 0, "Owner Name").otherwise(F.concat(F.lit(" : P"), k)), F.when(k % 5 == 0, "").otherwise(F.concat(k % 4, F.lit(" / 4"))), F.lit("| full"), F.lit("x"))
    return extract.table_row_fields(o.select(F.concat(F.lit("DOC-"), k).alias("document_id"), F.lit(1).alias("row_no"), cells.alias("cells"))).select("document_id", "field", "value")


@query
def extract_parse(spark, sf_dir):
    r = raw(spark, sf_dir)
    return extract.parse(T.bind(r, clean=T.clean_value(F.col("value"))), "parsed").select("document_id", "field", "parsed")


@query
def img_quality(spark, sf_dir):
    m = quality.quality_score(rows(spark, sf_dir, A.METRICS))
    return m.select("vec_id", "quality_score", "quality_level", F.array_join(quality.problems(), ",").alias("problems"))


@query
def img_plan(spark, sf_dir):
    p = quality.plan(rows(spark, sf_dir, A.METRICS))
    return p.select("vec_id", F.round("scale", 4).alias("scale"), "denoise", "correct_illumination", "clahe", "sharpen", "deskew", "binarize_candidate")


@query
def img_illumination(spark, sf_dir):
    pixels = rows(spark, sf_dir, A.PIXELS["spark"]).withColumn("value", F.col("v").cast("double"))
    return quality.illumination_spread(pixels, ["vec_id"]).select("vec_id", F.round("illumination", 4).alias("illumination"))


@query
def img_bimodality(spark, sf_dir):
    pixels = rows(spark, sf_dir, A.PIXELS["spark"])
    histogram = pixels.select("vec_id", F.floor(F.col("v") * 16).cast("long").alias("level")).groupBy("vec_id", "level").agg(F.count("*").alias("n"))
    return quality.bimodality(histogram, ["vec_id"]).select("vec_id", F.round("bimodality", 4).alias("bimodality"))


@query
def flagship(spark, sf_dir):
    """Normalise, validate and score every record: mean confidence and level by district."""
    fields = scored(spark, sf_dir)
    district = F.max(F.when(F.col("field") == "district", F.col("normalized_value"))).alias("district")
    records = confidence.score_records(fields, district)
    return records.groupBy("district", "record_level").agg(F.count("*").alias("records"), F.round(F.sum(F.round(F.col("record_confidence") * 100).cast("long")) / (100.0 * F.count("*")) + 1e-9, 4).alias("mean_confidence"))
