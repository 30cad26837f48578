"""Column helpers for the operators that stay inside Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of digits, letters and everything beyond ASCII, in text whose case has been folded.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_array(text: Column) -> Column:
    """Words of the text, null as empty.  lower() differs from folding A-Z alone only beyond ASCII, where every character
    is a word character either way."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def inline(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A constant table as a local relation."""
    def literal(x: object) -> str:
        return f"'{x}'" if isinstance(x, str) else str(x).lower()

    values = ", ".join(f"({', '.join(literal(x) for x in row)})" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")
