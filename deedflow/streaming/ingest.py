"""Structured Streaming: upload ingest with one run a document, status logs and live review state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dashboard import latest_status
from ..operators.review import valid_decisions

EVENTS = "event_id long, ts timestamp, document_id string, status string"


def status_stream(spark: SparkSession, folder: str, schema: str = EVENTS) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def single_flight(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each document once, however often it is queued within the delay; older state is dropped by the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["document_id"])


def process(stream: DataFrame, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Runs a batch function on each micro-batch and writes a folder for it; a repeated batch overwrites its own folder."""
    def batch(df: DataFrame, n: int) -> None:
        work(df).write.mode("overwrite").parquet(f"{target}/batch={n}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_now(log: DataFrame) -> DataFrame:
    """Batch or stream: the last status of each document."""
    return latest_status(log.withColumnRenamed("event_id", "event_seq"))


def statuses_by_hour(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Late events count until the watermark has passed."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "status").agg(F.count("*").alias("n"))


def live_decisions(stream: DataFrame) -> DataFrame:
    """The last decision of each document and field, kept as streaming aggregation state."""
    return valid_decisions(stream).groupBy("document_id", "field").agg(F.max_by("decision", "event_seq").alias("decision"), F.max("event_seq").alias("event_seq"))
