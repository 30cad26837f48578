"""From positioned words to lines, blocks, columns, tables, sections, reading order and label-value relationships."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import LAYOUT, LAYOUT_LABELS, SECTIONS
from ..functions.text import bind, blank, collapse, even, match_form

PAGE = ["document_id", "page"]
#: A half in decimal may be a little less in binary.
HALF_UP = 1e-9


def usable_words(words: DataFrame) -> DataFrame:
    """Words with text, cleaned, with their middle."""
    return words.withColumn("text", collapse(F.col("text"))).filter("text <> ''").withColumn("cy", F.col("y") + F.col("height") / 2)


def page_confidence(words: DataFrame) -> DataFrame:
    return words.groupBy(*PAGE).agg(F.round(F.coalesce(F.avg("conf"), F.lit(0.0)) + HALF_UP, 2).alias("confidence"), F.count("*").alias("word_count"))


def document_confidence(pages: DataFrame) -> DataFrame:
    """Mean of the pages' rounded means, weighted by words."""
    total = F.sum("word_count")
    return pages.groupBy("document_id").agg(F.round(F.coalesce(F.sum(F.col("confidence") * F.col("word_count")) / F.nullif(total, F.lit(0)), F.lit(0.0)) + HALF_UP, 2).alias("document_confidence"), F.count("*").alias("page_count"), total.alias("word_count"))


def ordered_text(rows: DataFrame, keys: list[str], order: str, sep: str, name: str = "text") -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(order, "text")))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["text"]), sep).alias(name))


def line_tolerance(height: Column) -> Column:
    """From the median of positive heights."""
    return F.greatest(F.lit(LAYOUT["line_tolerance"]), LAYOUT["line_factor"] * F.coalesce(F.median(F.when(height > 0, height)), F.lit(0.0)))


def assign_lines(words: DataFrame) -> DataFrame:
    """Adds line_no to usable words: a fold in order of (middle, left) that joins a word to the line whose running mean of
    middles is near enough, else starts a line.  A page's words are folded as one array; the fold notes a 1 for each word
    that starts a line and a 0 for others."""
    others = [c for c in words.columns if c not in (*PAGE, "cy", "x", "idx")]
    pages = words.groupBy(*PAGE).agg(line_tolerance(F.col("height")).alias("tolerance"), F.array_sort(F.collect_list(F.struct("cy", "x", "idx", *others))).alias("ws"))
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("n"), F.lit("").alias("starts"))

    def step(a: Column, w: Column) -> Column:
        joins = (a["n"] > 0) & (F.abs(w["cy"] - a["total"] / F.nullif(a["n"], F.lit(0))) <= F.col("tolerance"))
        return F.struct((F.when(joins, a["total"]).otherwise(0.0) + w["cy"]).alias("total"), (F.when(joins, a["n"]).otherwise(0) + 1).alias("n"), F.concat(a["starts"], F.when(joins, "0").otherwise("1")).alias("starts"))

    folded = bind(pages, starts=F.aggregate("ws", start, step, lambda a: a["starts"]))
    rows = folded.select(*PAGE, "starts", F.posexplode("ws").alias("at", "w"))
    line_no = F.length(F.replace(F.substring("starts", F.lit(1), F.col("at") + 1), F.lit("0"), F.lit("")))
    return rows.select(*PAGE, "w.*", line_no.alias("line_no"))


def boxes(rows: DataFrame, keys: list[str], order: list[str], sep: str) -> DataFrame:
    """Text in order, the box around all, mean confidence (missing counts as 0) and the number of rows."""
    parts = F.array_sort(F.collect_list(F.struct(*order, "text")))
    right, bottom = F.max(F.col("x") + F.col("width")), F.max(F.col("y") + F.col("height"))
    return rows.groupBy(*keys).agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), sep).alias("text"), F.min("x").alias("x"), F.min("y").alias("y"), (right - F.min("x")).alias("width"), (bottom - F.min("y")).alias("height"),
        F.round(F.avg(F.coalesce(F.col("conf"), F.lit(0.0))) + HALF_UP, 2).alias("conf"), F.count("*").alias("n"),
    )


def lines_of(words: DataFrame) -> DataFrame:
    return boxes(assign_lines(usable_words(words)), [*PAGE, "line_no"], ["x", "idx"], " ")


def assign_blocks(lines: DataFrame) -> DataFrame:
    """Adds block_no: a block ends where the gap to the line above is larger than the page allows."""
    order = Window.partitionBy(*PAGE).orderBy("y", "line_no")
    height = lines.groupBy(*PAGE).agg(F.greatest(F.lit(LAYOUT["block_gap"]), LAYOUT["block_factor"] * F.coalesce(F.median(F.when(F.col("height") > 0, F.col("height"))), F.lit(0.0))).alias("gap"))
    above = F.lag(F.col("y") + F.col("height")).over(order)
    return (
        lines.join(height, PAGE).withColumn("fresh", F.when(above.isNull() | (F.col("y") - above > F.col("gap")), 1).otherwise(0))
        .withColumn("block_no", F.sum("fresh").over(order).cast("int")).drop("fresh", "gap")
    )


def blocks_of(lines: DataFrame) -> DataFrame:
    return boxes(assign_blocks(lines), [*PAGE, "block_no"], ["y", "line_no"], "\n")


def columns_of(words: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, column_no, center): left edges in order, a new column where the gap is larger than the tolerance."""
    order = Window.partitionBy(*keys).orderBy("x")
    gap = F.col("x") - F.lag("x").over(order)
    return (
        words.select(*keys, "x").withColumn("fresh", F.when(gap.isNull() | (gap > LAYOUT["column_tolerance"]), 1).otherwise(0))
        .withColumn("column_no", F.sum("fresh").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)).cast("int"))
        .groupBy(*keys, "column_no").agg(F.avg("x").alias("center"))
    )


def nearest_column(words: DataFrame, columns: DataFrame, keys: list[str]) -> DataFrame:
    """Adds column_no of the nearest center; the first of equally near ones."""
    centers = columns.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("column_no", "center"))).alias("cs"))
    near = F.array_min(F.transform("cs", lambda c: F.struct(F.abs(F.col("x") - c["center"]).alias("d"), c["column_no"].alias("no"))))
    return words.join(centers, keys).withColumn("column_no", near["no"]).drop("cs")


def table_cells(words: DataFrame) -> DataFrame:
    """(page, block_no, line_no, column_no, text): cells of blocks that look like tables.  words: with line_no and block_no."""
    keys = [*PAGE, "block_no"]
    columns = columns_of(words, keys)
    cells = nearest_column(words, columns, keys).groupBy(*keys, "line_no", "column_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "idx", "text"))), lambda p: p["text"]), " ").alias("text"))
    wide = cells.groupBy(*keys, "line_no").agg(F.count("*").alias("n_columns"))
    tables = (
        wide.groupBy(*keys).agg(F.count("*").alias("n_lines"), F.count_if(F.col("n_columns") >= LAYOUT["min_columns"]).alias("n_wide"))
        .join(columns.groupBy(*keys).agg(F.count("*").alias("n_columns")), keys)
        .filter((F.col("n_lines") >= LAYOUT["min_lines"]) & (F.col("n_columns") >= LAYOUT["min_columns"]) & (F.col("n_wide") >= F.greatest(F.lit(1), F.floor(F.col("n_lines") / 2))))
    )
    return cells.join(tables.select(*keys), keys, "left_semi")


def section_of(text: Column) -> Column:
    """The first section whose name the text contains."""
    plain, high = match_form(text), F.upper(text)
    longest = [max(s.split(), key=len) for s in SECTIONS]  # cheaper to look for than the name in the plain form
    return F.when(reduce(or_, [high.contains(w) for w in longest]), F.coalesce(*[F.when(plain.contains(s), s) for s in SECTIONS]))


def summary(lines: DataFrame, blocks: DataFrame, sections: DataFrame, rels: DataFrame, tables: DataFrame) -> DataFrame:
    """One row per document: how many pages, lines, blocks, sections, relationships and tables it has."""
    pages = lines.groupBy("document_id").agg(F.count_distinct("page").alias("page_count"), F.count("*").alias("line_count"))
    parts = [("block_count", blocks), ("section_count", sections), ("relationship_count", rels), ("table_count", tables)]
    for name, rows in parts:
        pages = pages.join(rows.groupBy("document_id").agg(F.count("*").alias(name)), "document_id", "left").fillna(0, [name])
    return pages


def fill_sections(lines: DataFrame, across_pages: bool = True, names: Column | None = None) -> DataFrame:
    """Adds header (the section a line names) and section (the last named up to the line); names: lines that may be headers."""
    order = Window.partitionBy("document_id").orderBy("page", "line_no") if across_pages else Window.partitionBy(*PAGE).orderBy("line_no")
    header = section_of(F.col("text")) if names is None else F.when(names, section_of(F.col("text")))
    return bind(lines, header=header).withColumn("section", F.last("header", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def number_sections(lines: DataFrame) -> DataFrame:
    order = Window.partitionBy(*PAGE).orderBy("line_no")
    return lines.withColumn("name", section_of(F.col("text"))).filter("name IS NOT NULL").select(*PAGE, "line_no", "name", F.row_number().over(order).alias("section_no"))


def reading_order(blocks: DataFrame) -> DataFrame:
    """Adds pos: blocks by (x, y) if the page has a column break, else by number."""
    by_left = Window.partitionBy(*PAGE).orderBy("x")
    page = Window.partitionBy(*PAGE)
    gaps = blocks.withColumn("jump", F.coalesce(F.col("x") - F.lag("x").over(by_left), F.lit(0.0)) > LAYOUT["column_break"]).withColumn("columns", F.max("jump").over(page))
    key = F.when(F.col("columns"), F.struct(F.col("x").cast("double").alias("a"), F.col("y").cast("double").alias("b"), F.col("block_no").alias("c"))).otherwise(
        F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.col("block_no").alias("c"))
    )
    return gaps.withColumn("pos", F.row_number().over(page.orderBy(key))).drop("jump")


#: Labels that are looked for in one step: generated methods of more would not be compiled to machine code.
AT_ONCE = 4


def with_matches(rows: DataFrame, text: Column, low: Column) -> DataFrame:
    """Rows whose text (low: in lower case) holds labels, with some: those labels, what each matched and the pieces between, nulls
    for the others.  Without lambdas, one of which would have the whole step interpreted."""
    def matched(no: int, label: str, pattern: str) -> Column:
        regex = f"(?i){pattern}"
        starts = sorted({re.match("[A-Za-z]+", x)[0].lower() for x in pattern.split("|")})  # cheaper to look for than the pattern
        return F.when(reduce(or_, [low.contains(x) for x in starts]) & text.rlike(regex), F.struct(F.lit(no).alias("label_no"), F.lit(label).alias("label"), F.split(text, regex, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("found")))

    every = [matched(no, *x) for no, x in enumerate(LAYOUT_LABELS)]
    parts = [f"some_{i}" for i in range(0, len(every), AT_ONCE)]
    for i, part in zip(range(0, len(every), AT_ONCE), parts, strict=True):
        rows = bind(rows, **{part: F.array(*every[i : i + AT_ONCE])})
    held = reduce(or_, [F.get(part, F.lit(k)).isNotNull() for part in parts for k in range(AT_ONCE)])
    return rows.filter(held).withColumn("some", F.concat(*parts)).drop(*parts)


def hits_of(some: Column) -> Column:
    """Every place of every label as (start, label_no, i, stop, label), from the left.  some: bound, as it is named many times."""
    def place(m: Column, hit: Column, i: Column) -> Column:
        later = F.length(F.array_join(F.slice(m["pieces"], F.lit(1), i + 1), "")) + F.length(F.array_join(F.slice(m["found"], F.lit(1), i), ""))
        start = F.when(i == 0, F.length(F.get(m["pieces"], F.lit(0)))).otherwise(later)
        return F.struct(start.alias("start"), m["label_no"].alias("label_no"), i.alias("i"), (start + F.length(hit)).alias("stop"), m["label"].alias("label"))

    return F.sort_array(F.flatten(F.transform(F.array_compact(some), lambda m: F.transform(m["found"], lambda hit, i: place(m, hit, i)))))


def relationships(lines: DataFrame) -> DataFrame:
    """(document_id, page, line_no, no, label, value, relation, target_line): beside the label, else below, else to the right.
    A page's lines are one array in which labels find their neighbours; a section of lines goes with their relationships."""
    more = [c for c in ("section",) if c in lines.columns]
    held = F.sort_array(F.collect_list(F.struct("line_no", "text", "x", "y", "width", "height", *more)))
    pages = lines.groupBy(*PAGE).agg(held.alias("ls"), F.coalesce(F.median(F.when(F.col("height") > 0, F.col("height"))), F.lit(LAYOUT["default_height"])).alias("median"))
    rows = pages.select(*PAGE, "ls", "median", F.posexplode("ls").alias("at", "l"))
    rows = bind(rows, text=even(F.col("l.text")), below=F.get("ls", F.col("at") + 1))
    rows = bind(rows, low=F.lower("text"))
    rows = with_matches(rows, F.col("text"), F.col("low"))
    rows = bind(rows, hits=hits_of(F.col("some"))).drop("low", "some")
    hits = rows.select("*", F.posexplode("hits").alias("no", "h"))
    until = F.coalesce(F.get("hits", F.col("no") + 1)["start"], F.length("text"))
    inline = F.regexp_replace(even(F.substring(F.col("text"), F.col("h.stop") + 1, F.greatest(until - F.col("h.stop"), F.lit(0)))), r"^[:\-]\s*", "")
    gap_below = F.col("below.y") - (F.col("l.y") + F.col("l.height"))
    near = gap_below.between(0, LAYOUT["below"] * F.col("median")) & ~blank(F.col("below.text"))
    hits = bind(hits, inline=F.nullif(inline, F.lit("")), near=F.coalesce(near, F.lit(False)))

    def beside(o: Column) -> Column:
        shared = F.least(F.col("l.y") + F.col("l.height"), o["y"] + o["height"]) - F.greatest(F.col("l.y"), o["y"])
        gap, low = o["x"] - (F.col("l.x") + F.col("l.width")), F.least(F.col("l.height"), o["height"])
        return (o["line_no"] != F.col("l.line_no")) & (low > 0) & (shared >= LAYOUT["overlap"] * low) & (gap >= 0) & (gap <= LAYOUT["right"] * F.col("median"))

    nearest = F.array_min(F.transform(F.filter("ls", beside), lambda o: F.struct((o["x"] - (F.col("l.x") + F.col("l.width"))).alias("gap"), o["line_no"].alias("to"), o["text"].alias("text"))))
    hits = bind(hits, r=F.when(F.col("inline").isNull() & ~F.col("near"), nearest))
    own, near = F.col("inline").isNotNull(), F.col("near")
    return hits.select(
        *PAGE, F.col("l.line_no").alias("line_no"), "no", F.col("h.label").alias("label"), F.when(own, F.col("inline")).when(near, collapse(F.col("below.text"))).otherwise(collapse(F.col("r.text"))).alias("value"),
        F.when(own, "same_line").when(near, "below").when(F.col("r.to").isNotNull(), "right").alias("relation"),
        F.when(own, None).when(near, F.col("below.line_no")).otherwise(F.col("r.to")).alias("target_line"), *[F.col("l")[c].alias(c) for c in more],
    )
