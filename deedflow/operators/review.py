"""Human review as a fold over an append-only log of decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank

REVIEW_STATUSES = ["warning", "invalid", "missing", "not_checked"]
FIELD_DECISIONS = ["accepted", "edited", "rejected"]
DUPLICATE_DECISIONS = ["confirmed_duplicate", "not_duplicate"]


def needs_review() -> Column:
    return F.col("confidence_review").eqNullSafe(F.lit("required")) | F.coalesce(F.col("validation_status").isin(REVIEW_STATUSES), F.lit(False))


def review_reasons(reason: Column, review: Column, issues: Column) -> Column:
    """The confidence reason if review is required, then issue messages; the first of equal ones stays."""
    own = F.array(F.when((review == "required") & ~blank(reason), F.trim(reason)))
    messages = F.transform(F.coalesce(issues, F.array().cast("array<struct<code:string,severity:string,message:string,field:string,scope:string>>")), lambda x: F.trim(x["message"]))
    return F.array_distinct(F.filter(F.concat(own, messages), lambda x: x.isNotNull() & (x != "")))


def open_review(fields: DataFrame) -> DataFrame:
    """Adds machine_value, review_required, decision and verified_value before any decision."""
    machine = F.coalesce(F.col("normalized_value"), F.col("raw_value"))
    return (
        fields.withColumn("machine_value", machine).withColumn("review_required", needs_review())
        .withColumn("decision", F.when(F.col("review_required"), "pending").otherwise("auto_accepted"))
        .withColumn("verified_value", F.when(~F.col("review_required"), F.col("machine_value")))
    )


def valid_decisions(events: DataFrame) -> DataFrame:
    """Field decisions of a known kind; an edit needs a value."""
    return events.filter(F.col("decision").isin(FIELD_DECISIONS) & F.col("field").isNotNull() & ((F.col("decision") != "edited") | ~blank(F.col("edited_value"))))


def latest_decisions(events: DataFrame) -> DataFrame:
    """The last decision of each document and field."""
    return (
        valid_decisions(events).groupBy("document_id", "field")
        .agg(F.max_by(F.struct("decision", "edited_value", "reviewer", "reason", "ts"), "event_seq").alias("d"), F.count("*").alias("n_decisions"), F.max("event_seq").alias("event_seq"))
        .select("document_id", "field", "d.*", "n_decisions", "event_seq")
    )


def decisions_by_document(events: DataFrame) -> DataFrame:
    """(document_id, decided): the last decisions of each document, as a map by field."""
    made = F.struct("field", F.struct(F.col("decision").alias("made"), "edited_value", "reviewer"))
    return latest_decisions(events).groupBy("document_id").agg(F.map_from_entries(F.collect_list(made)).alias("decided"))


def apply_decided(fields: DataFrame) -> DataFrame:
    """Fields as opened for review, with the decisions in their column decided.  It joins records before their fields multiply
    them: rows of fields are neither shuffled nor sorted."""
    made = fields.withColumn("_d", F.col("decided")[F.col("field")]).drop("decided")
    return _decided(made.select("*", "_d.made", "_d.edited_value", "_d.reviewer").drop("_d"))


def apply_decisions(fields: DataFrame, events: DataFrame) -> DataFrame:
    """Fields as opened for review, with the last decisions applied."""
    last = latest_decisions(events).select("document_id", "field", F.col("decision").alias("made"), "edited_value", "reviewer")
    return _decided(fields.join(last, ["document_id", "field"], "left"))


def _decided(fields: DataFrame) -> DataFrame:
    value = F.when(F.col("made") == "accepted", F.col("machine_value")).when(F.col("made") == "edited", F.col("edited_value")).when(F.col("made").isNull(), F.col("verified_value"))
    return fields.withColumn("verified_value", value).withColumn("decision", F.coalesce("made", "decision")).drop("made", "edited_value")


def decision_history(events: DataFrame) -> DataFrame:
    """Each decision with the one before it."""
    order = Window.partitionBy("document_id", "field").orderBy("event_seq")
    return valid_decisions(events).select(
        "document_id", "field", "event_seq", "decision", "edited_value",
        F.coalesce(F.lag("decision").over(order), F.lit("pending")).alias("previous_decision"), F.lag("edited_value").over(order).alias("previous_value"), F.row_number().over(order).alias("nth"),
    )


def duplicate_decisions(events: DataFrame) -> DataFrame:
    return events.filter(F.col("decision").isin(DUPLICATE_DECISIONS)).groupBy("document_id").agg(F.max_by("decision", "event_seq").alias("duplicate_decision"))


def review_summary(fields: DataFrame, duplicates: DataFrame, decided: DataFrame) -> DataFrame:
    """Counts by decision, whether a duplicate question is open, and whether the document may be finalised."""
    count = lambda d: F.count_if(F.col("decision") == d).alias(d)
    pending = (F.col("duplicate_status").isin("strong_duplicate", "possible_duplicate")) & F.col("duplicate_decision").isNull()
    return (
        fields.groupBy("document_id")
        .agg(F.count("*").alias("total_fields"), F.count_if("review_required").alias("review_required"), *[count(d) for d in ("pending", "accepted", "edited", "rejected", "auto_accepted")], F.count("verified_value").alias("verified_values"))
        .join(duplicates.select("document_id", F.col("status").alias("duplicate_status")), "document_id", "left").join(decided, "document_id", "left")
        .withColumn("duplicate_review_pending", F.coalesce(pending, F.lit(False)))
        .withColumn("can_finalize", (F.col("pending") == 0) & ~F.col("duplicate_review_pending"))
    )


def pending_fields(fields: DataFrame) -> DataFrame:
    """The queue of each document: pending fields in catalogue order."""
    return (
        fields.filter("review_required AND decision = 'pending'").groupBy("document_id")
        .agg(F.array_sort(F.collect_list(F.struct("ordinal", "field"))).alias("q"))
        .select("document_id", F.size("q").alias("n_pending"), F.array_join(F.transform("q", lambda x: x["field"]), ",").alias("queue"))
    )


def verified_wide(fields: DataFrame, names: list[str]) -> DataFrame:
    return fields.groupBy("document_id").agg(*[F.max(F.when(F.col("field") == n, F.col("verified_value"))).alias(n) for n in names])
