"""Field extraction by labels from lines, relationships, tables and plain text; the first source and line wins."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import FIELDS, SECTIONS
from ..functions.text import bind, clean_value, folded, stripped

BETWEEN = r"[\s._:/|,\-]*"
SOURCES = ["layout_relationship", "layout_same_line", "layout_below_label", "layout_table", "ocr_fallback", "composer_fallback"]
DATE = r"\b\d{1,2}[/\-.]\d{1,2}[/\-.]\d{4}\b"
LAND = r"\b\d+(?:[/\-][A-Za-z0-9]+)*\b"
MUTATION = r"\b\d+[A-Za-z0-9/\-]*\b"
DOCUMENT = r"\b[A-Za-z0-9\-]+/\d{4}\b"
AREA = r"(?i)\b\d+(?:\.\d+)?(?:\s*(?:acres?|hectares?|ha|sq\.?\s*m|sqm))?"


def label_pattern(label: str) -> str:
    """Words of a label with separators between."""
    return BETWEEN.join(map(re.escape, re.findall("[A-Za-z0-9]+", label)))


def any_of(labels: list[str]) -> str:
    """Matches at the earliest place, there the longest label.  Places that begin no word, or none of a label, are left at once."""
    initials = "".join(sorted({re.findall("[a-z0-9]", x.lower())[0] for x in labels}))
    return rf"(?i)\b(?=[{initials}])(?:" + "|".join(label_pattern(x) for x in sorted(set(labels), key=lambda x: (-len(x), x))) + r")\.?\b"


EVERY = [x for f in FIELDS for x in f[4]]
ALL_LABELS = any_of(EVERY)


def may_hold(low: Column, labels: list[str]) -> Column:
    """Whether lower-case text has the first word of a label: without it, no pattern need be tried."""
    return reduce(or_, [low.contains(w) for w in sorted({re.findall("[a-z0-9]+", x.lower())[0] for x in labels})])


def part_of(field: Column, clean: Column) -> Column:
    """The part of a cleaned value that a field takes; null if there is none."""
    first = lambda p: F.regexp_substr(clean, F.lit(p))
    return (
        F.when(field.isin("mutation_date", "registration_date"), first(DATE)).when(field.isin("survey_number", "khasra_number", "khata_number"), first(LAND))
        .when(field == "mutation_entry_number", first(MUTATION)).when(field == "registered_document_number", F.coalesce(first(DOCUMENT), first(r"\b\d{2,}\b")))
        .when(field == "plot_area", first(AREA)).otherwise(clean)
    )


def parse(rows: DataFrame, name: str = "value") -> DataFrame:
    """Adds what counts of a cleaned value (clean) for its field; null if nothing does.  Each step names few columns: the code of
    all at once would not be compiled to machine code."""
    rows = bind(rows, part=part_of(F.col("field"), F.col("clean")))
    rows = bind(rows, part=F.when(F.col("field") == "plot_area", clean_value(F.col("part"))).otherwise(F.col("part")))
    return rows.withColumn(name, F.when(F.col("part") != "", F.col("part"))).drop("part")


def parsed(rows: DataFrame) -> DataFrame:
    """Rows (field, raw) with value, where raw has one."""
    return parse(bind(rows, clean=clean_value(F.col("raw")))).drop("clean").filter("value IS NOT NULL")


#: Fields whose labels are looked for in one step: generated methods of more would not be compiled to machine code.
AT_ONCE = 5


def with_fields(rows: DataFrame, text: Column, low: Column, label: bool) -> DataFrame:
    """Rows by field of the catalogue with a label in the text (low: in lower case), in the line's section: field, field_section, and
    on demand the label and its place (at)."""
    def one(name: str, section: str, labels: list[str]) -> Column:
        p = F.lit(any_of(labels))
        open_to = (F.col("section").isNull() | (F.col("section") == section)) & may_hold(low, labels)
        own = [F.regexp_substr(text, p).alias("label"), F.regexp_instr(text, p).alias("at")] if label else []
        return F.when(open_to if label else open_to & text.rlike(any_of(labels)), F.struct(F.lit(name).alias("field"), F.lit(section).alias("field_section"), *own))

    every = [one(name, section, labels) for name, section, _, _, labels in FIELDS]
    parts = [f"hits_{i}" for i in range(0, len(every), AT_ONCE)]
    for i, part in zip(range(0, len(every), AT_ONCE), parts, strict=True):
        rows = bind(rows, **{part: F.array(*every[i : i + AT_ONCE])})  # no lambda: one would have all of the step interpreted
    return rows.select("*", F.inline(F.concat(*parts))).drop(*parts).filter("label IS NOT NULL" if label else "field IS NOT NULL")


def labelled(lines: DataFrame) -> DataFrame:
    """Lines by field whose label they hold: label, and raw, the text from there to the next label of any field."""
    text = F.col("text")
    rows = with_fields(bind(lines, low=F.lower(text)), text, F.col("low"), label=True).drop("low").withColumn("label", F.lower("label"))
    rows = bind(rows, rest=F.substring(text, F.col("at") + F.length("label"), F.lit(1 << 30)))
    rows = bind(rows, upto=F.when(may_hold(F.lower("rest"), EVERY), F.regexp_instr("rest", F.lit(ALL_LABELS))).otherwise(0))
    return bind(rows, raw=clean_value(F.when(F.col("upto") > 0, F.substring("rest", F.lit(1), F.col("upto") - 1)).otherwise(F.col("rest")))).drop("at", "rest", "upto")


FOUND = ["document_id", "page", "line_no", "field", "field_section"]


def from_lines(lines: DataFrame, source: str) -> DataFrame:
    """(document_id, line_no, field, value, ...) of labels whose value stands behind them; lines: with section, filled."""
    rows = labelled(lines).filter("raw <> ''").select(*FOUND, "raw", "label", F.col("text").alias("source_text"))
    return parsed(rows).withColumn("evidence_type", F.lit(source))


def below_labels(lines: DataFrame) -> DataFrame:
    """Values in the line below a label that has none behind it, if that line is neither a header nor has labels."""
    order = Window.partitionBy("document_id", "page").orderBy("line_no")
    next_line = lines.withColumn("next_text", F.lead("text").over(order)).withColumn("next_header", F.lead("header").over(order))
    rows = labelled(next_line.filter("next_text IS NOT NULL AND next_header IS NULL")).filter("raw = ''").filter(~F.col("next_text").rlike(ALL_LABELS))
    return parsed(rows.select(*FOUND, "label", F.col("next_text").alias("raw"), F.concat_ws(" | ", "text", "next_text").alias("source_text"))).withColumn("evidence_type", F.lit("layout_below_label"))


def beside_and_below(lines: DataFrame) -> DataFrame:
    """What from_lines (as layout_same_line) and below_labels find, with each line's labels looked for once."""
    order = Window.partitionBy("document_id", "page").orderBy("line_no")
    rows = labelled(lines.withColumn("next_text", F.lead("text").over(order)).withColumn("next_header", F.lead("header").over(order)))
    open_below = F.col("next_text").isNotNull() & F.col("next_header").isNull()
    below = F.when(open_below, F.when(~F.col("next_text").rlike(ALL_LABELS), F.col("next_text")))
    found = bind(rows, own=F.col("raw") != "").withColumn("raw", F.when(F.col("own"), F.col("raw")).otherwise(below)).filter("raw IS NOT NULL")
    return parsed(found.select(*FOUND, "label", "raw", F.when(F.col("own"), "layout_same_line").otherwise("layout_below_label").alias("evidence_type")))


def from_relationships(rels: DataFrame) -> DataFrame:
    """Relationships whose label names a field; rels: with section."""
    rows = bind(rels.filter("value IS NOT NULL").withColumnRenamed("value", "raw"), folded=folded(F.col("label")))
    hits = with_fields(rows.withColumnRenamed("label", "said"), F.col("folded"), F.col("folded"), label=False).withColumnRenamed("said", "label")
    return parsed(hits.select(*FOUND, "raw", F.lower("label").alias("label"), F.concat_ws(": ", "label", "raw").alias("source_text"))).withColumn("evidence_type", F.lit("layout_relationship"))


def table_row_fields(rows: DataFrame) -> DataFrame:
    """(document_id, row_no, field, value) of ownership table rows; rows: with cells, an array of texts."""
    cells = F.filter(F.transform("cells", clean_value), lambda c: c != "")
    joined = folded(F.array_join("c", " "))
    header = sum((F.when(joined.contains(t), 1).otherwise(0) for t in ("owner name", "nature of rights", "serial no")), F.lit(0)) >= 2
    c = lambda i: F.get("c", F.lit(i))
    pair = lambda name, value: F.struct(F.lit(name).alias("field"), value.alias("value"))
    found = F.array(
        F.when(c(0).rlike(r"^\d+$"), pair("serial_number", c(0))), pair("ownership_owner_name", c(1)), F.when(c(2).rlike(r"\d+\s*/\s*\d+"), pair("ownership_share", c(2))),
        F.when(F.size("c") >= 4, pair("nature_of_rights", F.array_join(F.slice("c", 4, F.greatest(F.size("c") - 3, F.lit(0))), " | "))),
    )
    return (
        rows.withColumn("c", cells).filter(F.size("c") >= 3).filter(~header)
        .select("document_id", "row_no", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("h")).select("document_id", "row_no", "h.*")
    )


def first_wins(found: DataFrame) -> DataFrame:
    """One row for each document and field: the best source, there the first line."""
    prio = F.create_map(*[F.lit(x) for i, s in enumerate(SOURCES) for x in (s, i)])[F.col("evidence_type")]
    order = Window.partitionBy("document_id", "field").orderBy(prio, "page", "line_no", "value")
    return found.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


def named_section(text: Column) -> Column:
    """The first section whose name the folded text contains; unlike in layout, punctuation counts."""
    plain, low = folded(text), F.lower(text)
    longest = [max(s.lower().split(), key=len) for s in SECTIONS]  # cheaper to look for than the name in the folded text
    return F.when(reduce(or_, [low.contains(w) for w in longest]), F.coalesce(*[F.when(plain.contains(s.lower()), s) for s in SECTIONS]))


def text_lines(texts: DataFrame) -> DataFrame:
    """(document_id, page, line_no, text, header, section): lines that aren't blank of document_text, numbered from 0, with the
    section named last; no page is known."""
    rows = texts.select("document_id", F.posexplode(F.split("document_text", r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]")).alias("at", "text"))
    rows = bind(rows, text=stripped(F.col("text"))).filter("text <> ''")
    order = Window.partitionBy("document_id").orderBy("at")
    rows = bind(rows, header=named_section(F.col("text")))
    return rows.select("document_id", F.lit(None).cast("int").alias("page"), (F.row_number().over(order) - 1).alias("line_no"), "text", "header", F.last("header", True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("section"))


def ocr_lines(lines: DataFrame) -> DataFrame:
    """Recognised lines (document_id, page, line_no, text) in the same shape, for extraction as the last resort."""
    rows = bind(lines, text=stripped(F.coalesce("text", F.lit("")))).filter("text <> ''")
    order = Window.partitionBy("document_id").orderBy("page", "line_no")
    rows = bind(rows, header=named_section(F.col("text")))
    return rows.withColumn("section", F.last("header", True).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def object_text(value: Column) -> Column:
    """The text of a JSON value: a string itself, an object's text, value or content, else its JSON."""
    inner = F.coalesce(*[F.get_json_object(value, f"$.{k}") for k in ("text", "value", "content")])
    quoted = F.get_json_object(F.concat(F.lit('{"a":'), value, F.lit("}")), "$.a")
    return F.trim(F.when(value.isNull() | (value == "null"), "").when(value.startswith("{"), F.coalesce(inner, value)).otherwise(F.coalesce(quoted, value)))


def extraction_summary(fields: DataFrame) -> DataFrame:
    return fields.groupBy("document_id").agg(F.count("*").alias("total_fields"), F.count("value").alias("extracted"), (F.count("*") - F.count("value")).alias("missing"))
