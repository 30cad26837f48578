"""Text columns: cleaning, folding and the unicode rules that all stages share.  Everything but NFC stays in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..catalog import DEVANAGARI, QUOTES_FROM, QUOTES_TO

SPACE = r"(?U)\s+"
#: White space of ASCII.
ASCII_SPACE = " \t\n\x0b\f\r"
#: Runs of white space that isn't a single space, in ASCII.
UNEVEN = r"[\t-\r ]{2,}|[\t-\r]"


@F.pandas_udf(StringType())
def composed(text: pd.Series) -> pd.Series:
    return text.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))


def foreign(c: Column) -> Column:
    """Whether a text has characters beyond ASCII."""
    return F.octet_length(c) != F.length(c)


def nfc(c: Column) -> Column:
    """Canonical composition: the one text function that Spark lacks.  ASCII is composed as it is and never goes to Python."""
    return F.coalesce(composed(F.when(foreign(c), c)), c)


def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds (or replaces) columns, each computed once for a row however often later steps name it.  Optimiser rules copy an
    alias's whole expression into filters and projections above it, so that long chains would grow without bound; they don't
    look into the rows that a generator makes, and generators are compiled."""
    kept = [c for c in df.columns if c not in columns]
    made = F.inline(F.array(F.struct(*[c.alias(f"_bound_{n}") for n, c in columns.items()])))
    return df.select("*", made).select(*kept, *[F.col(f"_bound_{n}").alias(n) for n in columns])


def collapse(c: Column) -> Column:
    """Runs of white space become a space; none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def even(c: Column) -> Column:
    """The same, where most texts are printable ASCII without runs of spaces: those are only trimmed."""
    return F.when(c.rlike("[^ -~]|  "), collapse(c)).otherwise(F.trim(c))


def stripped(c: Column) -> Column:
    """No white space at the ends."""
    return F.when(foreign(c), F.regexp_replace(c, r"(?U)^\s+|\s+$", "")).otherwise(F.btrim(c, F.lit(ASCII_SPACE)))


def match_form(c: Column) -> Column:
    """Upper case, letters and digits of ASCII only, single spaces: for finding section names."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(c), "[^A-Z0-9]", " "), " {2,}", " "))


def folded(c: Column) -> Column:
    """Plain quotes and dashes, lower case, single spaces; null is empty."""
    return collapse(F.lower(F.translate(F.coalesce(c, F.lit("")), "’‘–—", "''--")))


def clean_value(c: Column) -> Column:
    """Separators go from the front, blanks and bars from the end; null is empty."""
    c = F.coalesce(c, F.lit(""))
    rest = F.regexp_replace(F.regexp_replace(c, r"(?U)^[\s:;|,=/\\\-]+", ""), r"(?U)[\s;|]+$", "")
    plain = F.rtrim(F.ltrim(c, F.lit(ASCII_SPACE + ":;|,=/\\-")), F.lit(ASCII_SPACE + ";|"))
    return F.when(foreign(c), collapse(rest)).otherwise(even(plain))


def ascii_digits(c: Column) -> Column:
    return F.when(foreign(c), F.translate(c, DEVANAGARI, "0123456789")).otherwise(c)


def plain_unicode(c: Column, compose: bool = True) -> Column:
    """NFC, no-break space as space, invisible marks removed, plain quotes and dashes; null is empty."""
    folded = F.translate(nfc(c) if compose else c, "\u00a0" + QUOTES_FROM + "\u200b\ufeff", " " + QUOTES_TO)
    return F.coalesce(F.when(foreign(c), folded).otherwise(c), F.lit(""))


def plain_space(c: Column, compose: bool = True) -> Column:
    even = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), UNEVEN, " "))
    return F.when(foreign(c), collapse(plain_unicode(c, compose))).otherwise(even)


def blank(c: Column) -> Column:
    return c.isNull() | c.rlike(r"(?U)^\s*$")


def has_letter(c: Column) -> Column:
    return c.rlike(r"\p{L}")


def alphanumerics(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def where(c: Column, has: str, rule: Callable[[Column], Column]) -> Column:
    """The rule where c has one of some characters; other texts, which it would not change, as they are."""
    return F.when(c.rlike(has), rule(c)).otherwise(c)
