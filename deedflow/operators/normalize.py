"""Normalisation of field values.  Each rule is a column of a column; ``normalize_fields`` applies them by the catalogue."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import AREA_UNITS, NULL_TOKENS
from ..functions.text import ascii_digits, bind, collapse, plain_space, where

AREA = r"(?i)^\s*(\d+(?:\.\d+)?)\s*(acres?|hectares?|ha|sq\.?\s*m|sqm)?\s*$"
DATE = r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})$"


def unless_null_token(plain: Column) -> Column:
    return F.when(~plain.rlike("(?i)^(?:" + "|".join(map(re.escape, NULL_TOKENS)) + r")\z"), plain)


def null_token(c: Column, compose: bool = True) -> Column:
    """Plain text, or null for null tokens."""
    return unless_null_token(F.when(c.isNotNull(), plain_space(c, compose)))


# The rules proper, of plain text (single spaces) with ASCII digits.
def as_text(t: Column) -> Column:
    return where(t, "[,;]", lambda c: collapse(F.regexp_replace(F.regexp_replace(c, r"\s*,\s*", ", "), r"\s*;\s*", "; ")))


def tighter_stops(t: Column) -> Column:
    return where(t, r"\.", lambda c: collapse(F.regexp_replace(c, r"\s*\.\s*", ". ")))


def tighter_slashes(t: Column) -> Column:
    return where(t, "/", lambda c: collapse(F.regexp_replace(c, r"\s*/\s*", "/")))


def as_name(t: Column) -> Column:
    return tighter_stops(as_text(t))


def as_share(t: Column) -> Column:
    return tighter_slashes(as_text(t))


def as_identifier(t: Column) -> Column:
    return where(t, "[/-]", lambda c: collapse(F.regexp_replace(F.regexp_replace(c, r"\s*/\s*", "/"), r"\s*-\s*", "-")))


def as_date(t: Column) -> Column:
    """Day, month, year in digits become an ISO date; anything else, impossible dates too, stays as it is."""
    made = F.date_format(F.try_to_timestamp(F.regexp_replace(t, DATE, "$1/$2/$3"), F.lit("d/M/yyyy")), "yyyy-MM-dd")
    return F.coalesce(F.when(t.rlike(DATE), made), t)


def area_number(text: Column) -> Column:
    """The digits of an area, without zeros at the end of a fraction."""
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(text, AREA, 1), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def area_words(text: Column) -> Column:
    return F.lower(collapse(F.regexp_extract(text, AREA, 2)))


def area_unit(words: Column) -> Column:
    """The canonical unit for the words behind an area's number; null without any."""
    units = F.create_map(*[F.lit(x) for pair in AREA_UNITS.items() for x in pair])
    return F.when(words != "", F.coalesce(units[words], words))


def as_area(t: Column) -> Column:
    """(text, value, unit, structured): number without trailing zeros and canonical unit, or the text alone."""
    text = collapse(t)
    fits = F.coalesce(text.rlike(AREA), F.lit(False))
    number, unit = F.when(fits, area_number(text)), F.when(fits, area_unit(area_words(text)))
    return F.struct(F.when(fits, F.concat_ws(" ", number, unit)).otherwise(text).alias("text"), number.alias("value"), unit.alias("unit"), fits.alias("structured"))


def _of(rule: Callable[[Column], Column]) -> Callable[..., Column]:
    return lambda c, compose=True: rule(ascii_digits(null_token(c, compose)))


text_value, name_value, identifier_value, date_value, share_value, area_value = map(_of, (as_text, as_name, as_identifier, as_date, as_share, as_area))


def normalize_fields(fields: DataFrame, compose: bool = True) -> DataFrame:
    """Adds raw_value, normalized_value, area_value, area_unit, area_structured and normalization_status to rows with value
    and normalizer."""
    kind, t, x, fits = (F.col(c) for c in ("normalizer", "_t", "_x", "_fits"))
    area = kind == "area"
    # Few expressions a step: generated methods stay so small that they are compiled to machine code.
    out = bind(fields.withColumn("_p", F.when(F.col("value").isNotNull(), plain_space(F.col("value"), compose))), _p=F.col("_p"))
    out = bind(out, _t=ascii_digits(unless_null_token(F.col("_p"))))
    out = bind(out, _x=F.when(kind == "identifier", as_identifier(t)).when(kind == "date", t).when(area, collapse(t)).otherwise(as_text(t)))
    out = bind(out, _y=F.when(kind == "name", tighter_stops(x)).when(kind == "share", tighter_slashes(x)).when(kind == "date", as_date(x)).otherwise(x), _fits=area & F.coalesce(x.rlike(AREA), F.lit(False)))
    # an expression that stands in several places is made for all rows, whatever the conditions around it: so bind it first
    out = bind(out, _number=F.when(fits, area_number(x)), _words=F.when(fits, area_words(x)))
    out = bind(out, _unit=area_unit(F.col("_words")))
    out = bind(out, normalized_value=F.when(fits, F.concat_ws(" ", "_number", "_unit")).otherwise(F.col("_y")))
    return out.withColumns({
        "raw_value": F.col("value"), "area_value": F.col("_number"), "area_unit": F.col("_unit"), "area_structured": fits,
        "normalization_status": F.when(F.col("normalized_value").isNull(), "missing").otherwise("normalized"),
    }).drop("_p", "_t", "_x", "_y", "_fits", "_number", "_words", "_unit")


def normalization_summary(fields: DataFrame, keys: list[str]) -> DataFrame:
    changed = F.col("raw_value").isNotNull() & ~F.col("raw_value").eqNullSafe(F.col("normalized_value"))
    return fields.groupBy(*keys).agg(
        F.count("*").alias("total_fields"), F.count_if(F.col("normalization_status") == "normalized").alias("normalized"),
        F.count_if(F.col("normalization_status") == "missing").alias("missing"), F.count_if(changed).alias("changed"),
    )
