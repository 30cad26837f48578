"""Uploaded files, recognised words and stored artifacts as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import UPLOAD_SUFFIXES

WORD = "struct<text:string,confidence:double,bbox:struct<x:double,y:double,width:double,height:double>>"
OCR = f"document_id string, document_confidence double, page_count int, word_count int, text string, pages array<struct<page_number:int,text:string,confidence:double,word_count:int,words:array<{WORD}>>>"


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Files of an accepted kind: name, id, length, and content only if it is asked for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(x for s in UPLOAD_SUFFIXES for x in (s, s.upper())) + "}").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    minted = F.concat(F.lit("DOC-"), F.upper(F.substring(F.sha2("path", 256), 1, 8)))
    return files.select(minted.alias("document_id"), name.alias("original_filename"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("suffix"), "length", F.col("modificationTime").alias("uploaded_at"), F.lit("Queued").alias("status"), "content")


def page_images(files: DataFrame) -> DataFrame:
    """Page numbers of a document's images, by lower-case name from 1."""
    order = Window.partitionBy("document_id").orderBy(F.lower("original_filename"))
    return files.withColumn("page", F.row_number().over(order))


def words_from_ocr(artifacts: DataFrame) -> DataFrame:
    """A row for each recognised word with text and a confidence that isn't negative."""
    pages = artifacts.select("document_id", F.explode("pages").alias("p"))
    words = pages.select("document_id", F.col("p.page_number").alias("page"), F.posexplode("p.words").alias("idx", "w"))
    return words.select("document_id", "page", "idx", F.trim("w.text").alias("text"), F.round("w.confidence", 2).alias("conf"), "w.bbox.x", "w.bbox.y", "w.bbox.width", "w.bbox.height").filter("text <> '' AND conf >= 0")


def read_ocr(spark: SparkSession, folder: str) -> DataFrame:
    """OCR artifacts, a JSON document a file; a missing folder raises."""
    return spark.read.schema(OCR).option("multiLine", True).json(folder)


def existing_records(spark: SparkSession, folder: str) -> DataFrame:
    """The four columns that duplicate detection needs; nothing if there is no store yet."""
    schema = "document_id string, field string, normalized_value string, validation_status string"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.parquet(folder).select("document_id", "field", "normalized_value", "validation_status")


def write_json(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)


def write_csv(df: DataFrame, folder: str) -> None:
    """Headed, every value in quotes, quotes within doubled."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(folder)
