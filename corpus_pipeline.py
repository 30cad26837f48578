"""From raw documents to packed sequences: five stages, each an operator of ``deedflow.llm``.

Every stage takes (spark, docs, sf_dir) and gives the documents that the next one reads; all but the last return the columns
of documents.  ``run`` writes each stage's result to the shared folder and reads it again.

Any column may be null and any table empty; further columns of the documents, whatever their names, pass through all stages
but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deedflow.llm.common import materialize, table
from deedflow.llm.decontaminate import drop_contaminated
from deedflow.llm.jaccard import keep_one_of_each
from deedflow.llm.langid import fit, keep_languages
from deedflow.llm.linededup import dedup_lines
from deedflow.llm.packing import pack_documents
from deedflow.llm.queries import tokenizer_path

#: Near duplicates share this percentage of their shingles of so many words.
SHINGLE_WORDS, SIMILARITY = 5, 80
#: Languages of the mixture that is wanted; None: all that the labels name.
WANTED = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the languages that the labels name stay: their proportions must add up to a least share, and the text must
    be about as likely as text of those languages is.  Null and empty texts and those without letters go."""
    return keep_languages(docs, fit(docs), WANTED)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines leave the texts; every document stays, with its new length.  Null becomes the empty text."""
    return dedup_lines(docs).drop("n_lines", "n_dropped").withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, that of the smallest id (null last); rows that repeat an id are judged
    each on their own, and texts without words are copies of nothing."""
    return keep_one_of_each(docs, SHINGLE_WORDS, SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty items and texts match nothing.  Rows without an id stay."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place; null and empty texts are the end token alone."""
    return pack_documents(docs, tokenizer_path())


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: SQL cannot express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
