"""File sources and streams."""

import json

from pyspark.sql import functions as F

from deedflow.sources import uploads
from deedflow.streaming import ingest


def test_uploads_and_pages(spark, tmp_path):
    for name in ("b.PNG", "a.png", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    got = uploads.uploads(spark, f"file://{tmp_path}").withColumn("document_id", F.lit("d"))
    assert sorted(r.original_filename for r in got.collect()) == ["a.png", "b.PNG"]
    assert {r.original_filename: r.page for r in uploads.page_images(got).collect()} == {"a.png": 1, "b.PNG": 2}


def test_ocr_words(spark, tmp_path):
    word = lambda t, c: {"text": t, "confidence": c, "bbox": {"x": 1, "y": 2, "width": 3, "height": 4}}
    (tmp_path / "a.json").write_text(json.dumps({"document_id": "d", "pages": [{"page_number": 1, "words": [word("a", 90.123), word(" ", 50), word("b", -1)]}]}))
    rows = uploads.words_from_ocr(uploads.read_ocr(spark, f"file://{tmp_path}")).collect()
    assert [(r.text, r.conf, r.width) for r in rows] == [("a", 90.12, 3.0)]
    assert uploads.existing_records(spark, f"file://{tmp_path}/none").count() == 0


def test_single_flight_and_batches(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", "d", "Queued"), (2, "2024-01-01 00:00:05", "d", "Queued"), (3, "2024-01-01 00:01:00", "e", "Queued")]
    spark.createDataFrame(rows, "event_id long, ts string, document_id string, status string").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"file://{tmp_path}/in")
    stream = ingest.single_flight(ingest.status_stream(spark, f"file://{tmp_path}/in"))
    ingest.process(stream, lambda df: df.select("document_id"), f"file://{tmp_path}/out", f"file://{tmp_path}/ck").awaitTermination(60)
    assert sorted(r.document_id for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == ["d", "e"]
    last = ingest.status_now(spark.read.parquet(f"file://{tmp_path}/in")).collect()
    assert {r.document_id: r.event_seq for r in last} == {"d": 2, "e": 3}
