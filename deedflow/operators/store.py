"""The relational store on Parquet: upserts by key, appends, and a swap that readers see whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["documents", "land_record_fields", "evidence", "verification_audit"]
EVIDENCE = ["source_text", "source_line_ids", "source_page", "source_bbox", "evidence_type", "matched_label"]


def upsert(old: DataFrame, new: DataFrame, keys: list[str], kept: list[str] | None = None) -> DataFrame:
    """Rows of new replace those of old with the same keys; columns in kept stay as they were in old."""
    kept = kept or []
    if kept:
        before = old.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in kept])
        new = new.join(before, keys, "left")
        for c in kept:
            new = new.withColumn(c, F.coalesce(f"_old_{c}", c)).drop(f"_old_{c}")
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*old.columns))


def evidence_rows(fields: DataFrame) -> DataFrame:
    """Fields with any evidence: lists and pages count if there, texts if not empty."""
    have = F.lit(False)
    for c in EVIDENCE:
        if c in fields.columns:
            kind = dict(fields.dtypes)[c]
            there = F.col(c) != "" if kind == "string" else (F.size(c) > 0 if kind.startswith("array") else F.col(c).isNotNull())
            have = have | F.coalesce(there, F.lit(False))
    return fields.filter(have)


def audit_rows(events: DataFrame) -> DataFrame:
    """Events in the shape of the audit table, each also whole as JSON."""
    return events.select(
        "document_id", F.col("event").alias("event_type"), F.col("field").alias("field_name"), "decision", "reviewer", F.col("reason").alias("human_reason"), F.col("ts").alias("event_timestamp"),
        F.to_json(F.struct(*events.columns)).alias("event"),
    )


def regroup(fields: DataFrame) -> DataFrame:
    """A record for each document: a map from field to value and status."""
    return fields.groupBy("document_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", F.struct("normalized_value", "validation_status"))))).alias("fields"))


class Store:
    """Four tables under versioned folders; a pointer table names the current one.  Readers follow the pointer, so they
    see all of a version or none, and a failed write leaves the last version."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def version(self) -> int:
        fs, path = self._fs("pointer")
        if not fs.exists(path):
            return 0
        return self.spark.read.schema("version long").parquet(f"{self.root}/pointer").agg(F.max("version")).first()[0] or 0

    def _fs(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def read(self, name: str) -> DataFrame | None:
        version = self.version()
        if not version:
            return None
        fs, path = self._fs(f"v{version}/{name}")
        return self.spark.read.parquet(f"{self.root}/v{version}/{name}") if fs.exists(path) else None

    def persist(self, documents: DataFrame, fields: DataFrame, evidence: DataFrame, audit: DataFrame) -> int:
        version = self.version() + 1
        keys = {"documents": ["document_id"], "land_record_fields": ["document_id", "field"]}
        for name, new in zip(TABLES, (documents, fields, evidence, audit), strict=True):
            old = self.read(name)
            if old is None:
                out = new
            elif name in keys:
                out = upsert(old, new, keys[name], ["created_in_database_at"] if name == "documents" and "created_in_database_at" in old.columns else None)
            else:
                out = old.unionByName(new)
            out.write.mode("overwrite").parquet(f"{self.root}/v{version}/{name}")
        self.spark.range(1).select(F.lit(version).cast("long").alias("version")).write.mode("append").parquet(f"{self.root}/pointer")
        return version
