"""Listing, search, facets, indicators and status views over the document registry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import ACTIVE_STATUSES, FAILED_STATUSES, PIPELINE_STEPS, UPLOAD_LIMIT, UPLOAD_SUFFIXES


def recent(registry: DataFrame, n: int = 100) -> DataFrame:
    return registry.orderBy(F.desc("uploaded_at"), "document_id").limit(n)


def lookup(registry: DataFrame, document_id: str, artifacts: DataFrame) -> DataFrame:
    """One document with whether its result exists and whether it may be retried."""
    return (
        registry.filter(F.col("document_id") == document_id)
        .join(artifacts.select("document_id", F.lit(True).alias("there")).distinct(), "document_id", "left")
        .withColumn("ocr_result_exists", F.coalesce("there", F.lit(False))).drop("there")
        .withColumn("can_retry", F.col("status").isin(FAILED_STATUSES))
    )


def facets(rows: DataFrame, chosen: dict[str, str | None]) -> DataFrame:
    """Equality on each chosen column; None or a value that begins with "All " leaves it open."""
    wanted = [F.col(c) == v for c, v in chosen.items() if v is not None and not v.startswith("All ")]
    return rows.filter(reduce(lambda a, b: a & b, wanted)) if wanted else rows


def keyword(rows: DataFrame, query: str, columns: list[str]) -> DataFrame:
    return rows.filter(F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])).contains(query.strip().lower()))


def bucket(status: Column) -> Column:
    return F.when(status == "Verified", "Verified").when(status.isin(*FAILED_STATUSES, "Under Review"), "Under Review").otherwise("Processing")


def indicators(registry: DataFrame) -> DataFrame:
    b = bucket(F.col("status"))
    done = F.count_if(b == "Verified")
    return registry.agg(
        F.count("*").alias("total"), F.count_if(b == "Processing").alias("processing"), F.count_if(b == "Under Review").alias("review"), done.alias("verified"),
        F.coalesce(F.round(100.0 * done / F.nullif(F.count("*"), F.lit(0)), 1), F.lit(0.0)).alias("verified_percent"),
    )


#: How many of the steps are done in a status, and what the next one is.
STEP_STATES = {"Queued": (1, "pending"), "CV Processing": (1, "active"), "CV Completed": (2, "pending"), "CV Failed": (1, "failed"), "OCR Processing": (2, "active"), "OCR Failed": (2, "failed"), "Verified": (6, "pending")}


def step_states(registry: DataFrame) -> DataFrame:
    """A row for each document and step: done, active, failed or pending; unknown statuses wait for recognition."""
    n = F.create_map(*[F.lit(x) for k, (done, _) in STEP_STATES.items() for x in (k, done)])
    after = F.create_map(*[F.lit(x) for k, (_, what) in STEP_STATES.items() for x in (k, what)])
    steps = F.posexplode(F.array(*[F.lit(s) for s in PIPELINE_STEPS])).alias("no", "step")
    rows = registry.select("document_id", F.coalesce(n[F.col("status")], F.lit(2)).alias("n_done"), F.coalesce(after[F.col("status")], F.lit("pending")).alias("then"), steps)
    return rows.select("document_id", "step", F.when(F.col("no") < F.col("n_done"), "done").when(F.col("no") == F.col("n_done"), F.col("then")).otherwise("pending").alias("state"))


def retry_eligible(registry: DataFrame, active: DataFrame) -> DataFrame:
    return registry.filter(F.col("status").isin(FAILED_STATUSES)).join(active.select("document_id"), "document_id", "left_anti").withColumn("mode", F.when(F.col("status") == "OCR Failed", "ocr").otherwise("cv"))


def is_active(status: Column) -> Column:
    return status.isin(ACTIVE_STATUSES)


def date_parts(ts: Column, zone: str = "Asia/Kolkata") -> tuple[Column, Column]:
    local = F.from_utc_timestamp(ts, zone)
    return F.coalesce(F.date_format(local, "dd MMM yyyy"), F.lit("—")), F.coalesce(F.lower(F.date_format(local, "hh:mm a")), F.lit("—"))


def iso_utc(ts: Column) -> Column:
    """ISO with Z; microseconds only if there are any."""
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.lit("Z"))


def parse_timestamp(c: Column) -> Column:
    """ISO text, with Z or an offset, as a timestamp; null for null, empty text and what is no timestamp."""
    return F.try_to_timestamp(F.nullif(F.trim(c), F.lit("")))


def percent_text(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_string("%.2f%%", c))


def percent_value(c: Column) -> Column:
    """The number of a text such as 87.85%; null for a dash or anything else."""
    return F.regexp_replace(c, "%$", "").try_cast("double")


def serialized(registry: DataFrame) -> DataFrame:
    return registry.select("document_id", F.col("original_filename").alias("filename"), F.col("stored_filename").alias("stored_as"), "status", "confidence", iso_utc(F.col("uploaded_at")).alias("uploaded_at"))


def upload_accepted(name: Column, size: Column) -> Column:
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return suffix.isin(UPLOAD_SUFFIXES) & (size <= UPLOAD_LIMIT)


def prepend(new: DataFrame, old: DataFrame) -> DataFrame:
    """New rows, then the old ones whose id isn't among them."""
    return new.unionByName(old.join(new.select("document_id"), "document_id", "left_anti").select(*new.columns))


def latest_status(log: DataFrame) -> DataFrame:
    return log.groupBy("document_id").agg(F.max_by("status", "event_seq").alias("status"), F.max("event_seq").alias("event_seq"), F.count("*").alias("n_changes"))
