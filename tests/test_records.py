"""Normalisation, validation, confidence, duplicates, review and layout on small records."""

import pytest
from pyspark.sql import functions as F

from deedflow.catalog import IDENTIFIERS
from deedflow.functions import text as T
from deedflow.operators import compose, confidence, duplicates, extract, layout, normalize, quality, review, store, validate


def one(spark, rule, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", rule(F.col("v")).alias("o")).orderBy("i").collect()
    return [r.o for r in rows]


def test_normalizers(spark):
    assert one(spark, normalize.identifier_value, "५४ / २", " N/A ", "--", " 54 - 2 ", None) == ["54/2", None, None, "54-2", None]
    assert one(spark, normalize.date_value, "12/03/2018", "30/02/2018", "1-3/2018", "१२/०३/२०१८", "March 2018", "") == ["2018-03-12", "30/02/2018", "2018-03-01", "2018-03-12", "March 2018", None]
    assert one(spark, normalize.name_value, "L .Sterling", " A\t b ") == ["L. Sterling", "A b"]
    assert one(spark, normalize.share_value, "1 / 1 (Full)") == ["1/1 (Full)"]
    assert one(spark, normalize.text_value, "a ,b;c", "é") == ["a, b; c", "é"]
    assert one(spark, T.clean_value, " : =x ;| ", ".5", None) == ["x", ".5", ""]
    areas = one(spark, normalize.area_value, "12 ACRES", "10.500 ha", "5 sq.m", "7", "x", "10.0 Sq M", "100")
    assert [(a.text, a.value, a.unit) for a in areas] == [
        ("12 acre", "12", "acre"), ("10.5 hectare", "10.5", "hectare"), ("5 sq.m", "5", "sq.m"), ("7", "7", None), ("x", None, None), ("10 square_meter", "10", "square_meter"), ("100", "100", None)
    ]


def judged(spark, rows):
    df = spark.createDataFrame(rows, "document_id string, field string, normalizer string, validator string, value string")
    out = validate.validate_fields(normalize.normalize_fields(df)).orderBy("value").collect()
    return {r.value: (r.validation_status, [x.code for x in r.validation_issues]) for r in out}


def test_validators(spark):
    found = judged(spark, [
        ("d", "district", "location", "location", "eee"), ("d", "plot_area", "area", "area", "10.5"), ("d", "plot_area", "area", "area", "5 sq.m"), ("d", "plot_area", "area", "area", "about 3"),
        ("d", "plot_area", "area", "area", "0 acre"), ("d", "s", "share", "share", "0/4"), ("d", "s", "share", "share", "5/4"), ("d", "s", "share", "share", "1/0"), ("d", "s", "share", "share", "half"),
        ("d", "m", "date", "date", "30/02/2018"), ("d", "m", "date", "date", "12/03/2018"), ("d", "n", "identifier", "land", "54//2"), ("d", "x", "text", "odd", "a"), ("d", "o", "name", "name", "12"), ("d", "o", "name", "name", "A[x]"), ("d", "o", "name", "name", None),
    ])
    assert found == {
        "eee": ("warning", ["LOCATION_REPEATED_CHARACTER"]), "10.5": ("warning", ["AREA_UNIT_MISSING"]), "5 sq.m": ("invalid", ["AREA_UNIT_UNKNOWN"]), "about 3": ("invalid", ["AREA_STRUCTURE_MISSING"]),
        "0 acre": ("invalid", ["AREA_NON_POSITIVE"]), "0/4": ("warning", ["SHARE_ZERO_NUMERATOR"]), "5/4": ("warning", ["SHARE_EXCEEDS_WHOLE"]), "1/0": ("invalid", ["SHARE_ZERO_DENOMINATOR"]), "half": ("invalid", ["SHARE_INVALID_FORMAT"]),
        "30/02/2018": ("invalid", ["DATE_INVALID_FORMAT"]), "12/03/2018": ("valid", []), "54//2": ("invalid", ["LAND_IDENTIFIER_INVALID_FORMAT"]), "a": ("not_checked", []), "12": ("invalid", ["NAME_NO_LETTERS"]),
        "A[x]": ("warning", ["NAME_SUSPICIOUS_CHARACTERS"]), None: ("missing", ["FIELD_MISSING"]),
    }


def scored(spark, **change):
    row = {"validation_status": "valid", "normalization_status": "normalized", "evidence_type": "layout_relationship", "source_text": "s", "n_source_lines": 1, "source_page": 1, "matched_label": "m"} | change
    return confidence.score_fields(spark.createDataFrame([tuple(row.values())], "validation_status string, normalization_status string, evidence_type string, source_text string, n_source_lines int, source_page int, matched_label string")).first()


def test_confidence(spark):
    best = scored(spark)
    assert (best.confidence_score, best.confidence_level, best.confidence_review) == (100.0, "high", "not_required")
    fallback = scored(spark, evidence_type="composer_fallback", source_page=None)
    assert (fallback.confidence_score, fallback.confidence_review) == (87.85, "required")
    assert scored(spark, validation_status="warning").confidence_score == 64.0
    assert scored(spark, validation_status="invalid").confidence_level == "critical"
    assert scored(spark, validation_status="missing").confidence_score == 0.0
    rows = spark.createDataFrame([("d", 87.85, "valid", "required")] * 6 + [("d", 64.0, "warning", "required")] * 2 + [("d", 0.0, "missing", "required")] * 13, "document_id string, confidence_score double, validation_status string, confidence_review string")
    r = confidence.score_records(rows).first()
    assert (r.mean_confidence, r.completeness, r.record_confidence, r.record_level) == (31.2, 38.1, 32.92, "critical")


def compare(spark, *records):
    rows = [(f"D{i}", i, name, v, "valid") for i, r in enumerate(records) for name, v in zip(IDENTIFIERS, r, strict=True) if v]
    ids = duplicates.usable_identifiers(spark.createDataFrame(rows or [("-", 0, "x", "", "valid")], "document_id string, seq int, field string, normalized_value string, validation_status string"))
    of = duplicates.masks(ids, spark.createDataFrame([(f"D{i}", i) for i in range(len(records))], "document_id string, seq int"))
    return ids, of


@pytest.mark.parametrize(
    ("a", "b", "status"),
    [
        (("789/2018", None, "1", None, None), ("789/2018", None, "2", None, None), "strong_duplicate"), ((None, "456", None, None, None), (None, "456", None, None, None), "strong_duplicate"),
        ((None, None, "54/2", "100", "88"), (None, None, "54/2", "100", "88"), "possible_duplicate"), ((None, None, "54/2", None, None), (None, None, "54/2", None, None), "insufficient_evidence"),
        (("1/2000", "2", "3", None, None), ("4/2000", "5", "6", None, None), "not_duplicate"), ((None,) * 5, ("1/2000",) + (None,) * 4, "insufficient_evidence"),
    ],
)
def test_duplicate_pairs(spark, a, b, status):
    ids, of = compare(spark, a, b)
    assert {r.document_id: r.status for r in duplicates.assess(ids, of).collect()}["D0"] == status


def test_duplicates_as_all_pairs(spark):
    import random

    rnd = random.Random(3)
    records = [tuple(str(rnd.randrange(12)) if rnd.random() < 0.5 else None for _ in range(5)) for _ in range(60)]
    ids, of = compare(spark, *records)
    got = {r.document_id: (r.status, r.best_match) for r in duplicates.assess(ids, of).collect()}
    rank = {"strong_duplicate": 4, "possible_duplicate": 3, "insufficient_evidence": 2, "not_duplicate": 1}
    best = {}
    for p in duplicates.all_pairs(ids, of).collect():
        key = (rank[p.status], p.n_matched, -p.n_conflicting, -p.other_seq)
        if p.document_id not in best or key > best[p.document_id][0]:
            best[p.document_id] = (key, (p.status, p.other_id))
    assert got == {k: v for k, (_, v) in best.items()}


def test_review_fold(spark):
    fields = spark.createDataFrame(
        [("d", "survey_number", 0, "54/2", "54/2", "valid", "not_required"), ("d", "district", 1, "eee", "eee", "warning", "required"), ("d", "owner_name", 2, None, None, "missing", "required")],
        "document_id string, field string, ordinal int, raw_value string, normalized_value string, validation_status string, confidence_review string",
    )
    opened = review.open_review(fields)
    assert review.pending_fields(opened).first().queue == "district,owner_name"
    events = spark.createDataFrame(
        [("d", 1, "district", "rejected", None), ("d", 2, "district", "edited", "Pune"), ("d", 3, "owner_name", "accepted", None), ("d", 4, "district", "edited", " ")],
        "document_id string, event_seq long, field string, decision string, edited_value string",
    ).withColumn("reviewer", F.lit("r")).withColumn("reason", F.lit("x")).withColumn("ts", F.current_timestamp())
    done = review.apply_decisions(opened, events)
    assert {r.field: r.verified_value for r in done.collect()} == {"survey_number": "54/2", "district": "Pune", "owner_name": None}
    risk = spark.createDataFrame([("d", "possible_duplicate")], "document_id string, status string")
    none = spark.createDataFrame([], "document_id string, duplicate_decision string")
    assert not review.review_summary(done, risk, none).first().can_finalize
    assert review.review_summary(done, risk, spark.createDataFrame([("d", "not_duplicate")], none.schema)).first().can_finalize


def test_store_swaps_versions(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    docs = spark.createDataFrame([("a", "x", 1), ("b", "x", 1)], "document_id string, status string, created_in_database_at int")
    fields = spark.createDataFrame([("a", "f", "1")], "document_id string, field string, normalized_value string")
    log = spark.createDataFrame([("a",)], "document_id string")
    assert s.persist(docs, fields, log, log) == 1
    assert s.persist(spark.createDataFrame([("b", "y", 2), ("c", "y", 2)], docs.schema), fields, log, log) == 2
    assert sorted(tuple(r) for r in s.read("documents").collect()) == [("a", "x", 1), ("b", "y", 1), ("c", "y", 2)]
    assert s.read("land_record_fields").count() == 1 and s.read("evidence").count() == 2


def test_layout_lines_blocks_and_relationships(spark):
    words = spark.createDataFrame([("d", 1, i, t, 90.0, x, y, 50.0, 20.0) for i, (t, x, y) in enumerate([("b", 100.0, 3.0), ("a", 0.0, 0.0), ("  ", 5.0, 0.0), ("c", 0.0, 40.0), ("z", 0.0, 400.0)])], "document_id string, page int, idx int, text string, conf double, x double, y double, width double, height double")
    lines = layout.lines_of(words)
    assert [r.text for r in lines.orderBy("line_no").collect()] == ["a b", "c", "z"]
    assert [r.text for r in layout.blocks_of(lines).orderBy("block_no").collect()] == ["a b\nc", "z"]
    rows = [("d", 1, i + 1, t, x, y, 100.0, 20.0) for i, (t, x, y) in enumerate([("Village: Kothi District Pune", 0.0, 0.0), ("Address", 0.0, 30.0), ("Lane 1", 0.0, 60.0), ("Tehsil", 0.0, 300.0), ("far", 150.0, 305.0), ("Fathers Name: X", 0.0, 500.0)])]
    lines = spark.createDataFrame(rows, "document_id string, page int, line_no int, text string, x double, y double, width double, height double")
    got = [(r.label, r.value, r.relation) for r in layout.relationships(lines).orderBy("line_no", "no").collect()]
    assert got[:4] == [("Village", "Kothi", "same_line"), ("District", "Pune", "same_line"), ("Address", "Lane 1", "below"), ("Tehsil", "far", "right")]
    assert ("Name", "X", "same_line") in got
    blocks = compose.text_blocks(lines, layout.relationships(lines), spark.createDataFrame([], "document_id string, page int, line_no int, table_no int, text string"))
    text = compose.document_texts(compose.page_texts(blocks)).first().document_text
    assert text.startswith("Village: Kothi\nDistrict: Pune\nAddress: Lane 1\nTehsil: far")


def test_extract_labels(spark):
    lines = spark.createDataFrame([("d", 1, 1, "Survey No. 54/2 Khasra Number: 100", None), ("d", 1, 2, "Father's Name: X", None), ("d", 1, 3, "Registered Document | No. 789/2018", None)], "document_id string, page int, line_no int, text string, section string")
    got = {r.field: r.value for r in extract.first_wins(extract.from_lines(lines, "layout_same_line")).collect()}
    assert got["survey_number"] == "54/2" and got["khasra_number"] == "100" and got["registered_document_number"] == "789/2018"
    assert "father_name" not in got and got["owner_name"] == "X"
    rows = spark.createDataFrame([("d", 1, ["12", " : Asha", "1 / 2", "full", "y"]), ("d", 2, ["Serial No", "Owner Name", "Share"])], "document_id string, row_no int, cells array<string>")
    assert {r.field: r.value for r in extract.table_row_fields(rows).collect()} == {"serial_number": "12", "ownership_owner_name": "Asha", "ownership_share": "1 / 2", "nature_of_rights": "full | y"}


def test_quality(spark):
    m = spark.createDataFrame([(6.0, 30.0, 20.0, 13.0, -6.0, 13.0, 0.2), (None, 100.0, 50.0, 1.0, 0.0, 1.0, 0.9)], "glyph double, blur double, contrast double, noise double, skew double, illumination double, bimodality double")
    got = quality.quality_score(m).withColumn("p", quality.problems()).collect()
    assert (got[0].quality_score, got[0].quality_level, len(got[0].p)) == (0.0, "CRITICAL", 6)
    assert (got[1].quality_score, got[1].quality_level, got[1].p) == (100.0, "GOOD", [])
