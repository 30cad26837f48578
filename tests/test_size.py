"""Plans of record queries that have to hold at sixty times sf0.1."""

import glob
import re
import time

from deedflow.catalog import FIELD_NAMES
from deedflow.functions.scratch import FREED, written
from deedflow.operators import duplicates, review, validate
from deedflow.plans import adapters as A
from deedflow.plans import queries as Q


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_duplicates_read_the_records_once(spark, sf):
    got = Q.QUERIES["dup_best_match"](spark, sf)
    assert "orders.parquet" not in plan_of(got)


def test_summary_of_duplicates_reads_the_records_once(spark, sf):
    assert "orders.parquet" not in plan_of(Q.QUERIES["dup_summary"](spark, sf))


def test_identifiers_by_record_are_those_by_field(spark, sf):
    whole = duplicates.identified(A.spark_rows(spark, sf, A.RAW_WIDE))
    ids, of = Q._ids(spark, sf)
    rows = duplicates.held_by(ids, of)
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, rows.select(*whole.columns).collect()), key=str)


def shuffled(spark):
    """Files of shuffles that are on disk."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for d in manager.localDirsString() for f in glob.glob(f"{d}/**/shuffle_*", recursive=True)}


def test_what_is_written_leaves_no_shuffle(spark):
    before = shuffled(spark)
    table = written(spark.range(1000).repartition(4, "id").groupBy("id").count())
    ends = time.time() + 10  # executors are told to delete them
    while shuffled(spark) - before and time.time() < ends:
        time.sleep(0.1)
    assert not shuffled(spark) - before
    assert table.count() == 1000 and spark.conf.get(FREED, "false") == "false"


def test_steps_of_duplicates_end_in_a_table(spark, sf):
    # the plan of the result holds neither the listed values nor the sets of identifiers
    assert "xplode" not in plan_of(Q.QUERIES["dup_summary"](spark, sf))


def test_statuses_are_written_before_records_are_scored(spark, sf):
    assert "deedflow-" in plan_of(Q.QUERIES["conf_duplicate_risk"](spark, sf)) and "others" not in plan_of(Q.QUERIES["conf_duplicate_risk"](spark, sf))


def test_decisions_join_records_not_their_fields(spark, sf):
    got = Q._review(spark, sf)
    want = review.apply_decisions(review.open_review(Q.scored(spark, sf)), A.spark_rows(spark, sf, A.DECISIONS))
    columns = ["document_id", "field", "decision", "verified_value", "reviewer"]
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(map(tuple, want.select(*columns).collect()), key=str)
    joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join LeftOuter" in x]
    assert joins and not [x for x in joins if "field#" in x]


def scans_of_orders(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [o_orderkey#")


def test_labels_are_looked_for_once(spark, sf):
    assert scans_of_orders(Q.QUERIES["relationships"](spark, sf)) == 1
    assert scans_of_orders(Q.QUERIES["layout_summary"](spark, sf)) <= 6


def test_extraction_reads_lines_for_relationships_and_for_labels(spark, sf):
    assert scans_of_orders(Q.QUERIES["extract_first_wins"](spark, sf)) == 2


def test_composition_uses_relationships_once(spark, sf):
    assert scans_of_orders(Q.QUERIES["compose_text"](spark, sf)) <= 6


def test_fields_are_completed_without_finding_them_again(spark, sf):
    assert scans_of_orders(Q.QUERIES["extract_complete"](spark, sf)) == 2


def test_completed_keeps_rows_and_adds_fields(spark):
    held = spark.createDataFrame([("a", "village", 1), ("a", "village", 2), ("a", "other", 3), ("b", "other", 4)], "document_id string, field string, n int")
    got = [(r.document_id, r.field, r.n) for r in validate.completed(held).collect()]
    want = [(d, f, None) for d in "ab" for f in FIELD_NAMES if (d, f) != ("a", "village")] + [("a", "village", 1), ("a", "village", 2)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_code_of_extraction_is_small_enough_to_be_compiled(spark, sf):
    code = spark._jvm.org.apache.spark.sql.execution.debug.package
    for name in ("extract_text_fallback", "extract_complete"):
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = Q.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan()
        spark.conf.unset("spark.sql.adaptive.enabled")
        assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code.codegenString(plan)))) < 8000


def test_steps_that_look_for_labels_hold_no_lambda(spark, sf):
    plan = Q.QUERIES["extract_text_fallback"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    steps = [x for x in plan.split("\n") if re.search(r"Generate .*_bound_(some|hits)_\d", x)]
    assert steps and not [x for x in steps if "lambda" in x]
