"""Benchmark decontamination by spaced-seed hashing, in Spark's own functions.

A seed is the hash of the words at the cared-for places of a fixed mask; the places between may differ.  Seeds of the texts
are joined with those of the benchmark, and each hit's diagonal (word of the text less word of the item) is verified word by
word: a stretch of the aligned words, scored +1 for an equal pair and -2 for a different one, must hold enough of the item.

The benchmark's seeds are broadcast only after their number was counted against ``BROADCAST_SEEDS``: their rows hold numbers
alone, so the number bounds the bytes.  Positions without a hit then never leave the generated stage.  Beyond the bound, both
sides are shuffled as (seed, row, place) without words, and the words of documents with hits are fetched once for each row.
The items' words, which verification needs, are broadcast only if their counted bytes are at most ``BROADCAST_BYTES``.

Items with fewer words than the shortest mask have one seed each, over all their words, and must be found exactly.

Defined cases: null texts and texts without words match nothing, and so do such items; items with equal words are one class and are all listed; repeated documents each match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .native import word_array

#: 1: the word counts, 0: it may differ.
MASKS = ("11101011", "110100111", "1100101101")
SHORTEST = min(map(len, MASKS))
BROADCAST_SEEDS = 500_000
BROADCAST_BYTES = 32 << 20
#: A stretch counts if it holds this share of the item's words, or this many.
LEAST_SHARE, LEAST_WORDS = 0.6, 20

PAIRS = ["doc_id", "item_id", "item_ids", "doc_start", "doc_end", "item_start", "item_end", "n_matched", "n_item_words", "similarity"]


def short_masks(lengths: list[int]) -> dict[int, str]:
    """Masks over all words of items of these lengths, by number."""
    return {len(MASKS) + n: "1" * n for n in lengths}


def seeds(words: str, at: Column, masks: dict[int, str]) -> Column:
    """One hash for each mask at a place; null where the mask does not fit."""
    def seed(n: int, mask: str) -> Column:
        cared = [F.get(words, at + i) for i, c in enumerate(mask) if c == "1"]
        return F.when(at + len(mask) <= F.size(words), F.xxhash64(F.lit(n), *cared))

    return F.array(*[seed(n, mask) for n, mask in masks.items()])


def seeded(df: DataFrame, words: str, at: str, masks: dict[int, str]) -> DataFrame:
    """A row for each place and mask that fits."""
    shortest = min(map(len, masks.values()))
    return (
        df.filter(F.size(words) >= shortest)
        .select("*", F.explode(F.sequence(F.lit(0), F.size(words) - shortest)).alias(at))
        .select("*", F.explode(seeds(words, F.col(at), masks)).alias("seed"))
        .filter(F.col("seed").isNotNull())
    )


def best_stretch(equal: Column) -> Column:
    """Of an array of 0 and 1, the stretch with the most (equal - 2 * different): its start, end and number of ones."""
    start = F.struct(
        F.lit(0).alias("i"), F.lit(0).alias("run"), F.lit(0).alias("from"), F.lit(0).alias("ones"),
        F.lit(0).alias("best"), F.lit(0).alias("best_from"), F.lit(0).alias("best_to"), F.lit(0).alias("best_ones"),
    )

    def step(a: Column, e: Column) -> Column:
        fresh = a["run"] <= 0
        run = F.when(fresh, 0).otherwise(a["run"]) + F.when(e == 1, 1).otherwise(-2)
        begin = F.when(fresh, a["i"]).otherwise(a["from"])
        ones = F.when(fresh, 0).otherwise(a["ones"]) + e
        better = run > a["best"]
        return F.struct(
            (a["i"] + 1).alias("i"), run.alias("run"), begin.alias("from"), ones.alias("ones"),
            F.greatest(run, a["best"]).alias("best"), F.when(better, begin).otherwise(a["best_from"]).alias("best_from"),
            F.when(better, a["i"] + 1).otherwise(a["best_to"]).alias("best_to"), F.when(better, ones).otherwise(a["best_ones"]).alias("best_ones"),
        )

    return F.aggregate(equal, start, step)


def find_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and benchmark item (class of equal items) that it holds: where, and how much."""
    return overlaps(docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), "text"), benchmark).drop("rid")


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """find_overlaps of documents (rid, doc_id, text), with their rid."""
    items = (
        benchmark.select(F.col("item_id").cast("long"), word_array(F.col("text")).alias("item_words"))
        .groupBy("item_words")
        .agg(F.min("item_id").alias("item_id"), F.array_sort(F.collect_list("item_id")).alias("item_ids"))
    )
    size, masks = F.size("item_words"), dict(enumerate(MASKS))
    lengths = sorted(r["n"] for r in items.select(size.alias("n")).filter(F.col("n").between(1, SHORTEST - 1)).distinct().collect())
    item_seeds = seeded(items, "item_words", "j", masks)
    for n in lengths:
        item_seeds = item_seeds.unionByName(seeded(items.filter(size == n), "item_words", "j", short_masks([n])))
    item_seeds = item_seeds.select("seed", "j", "item_id", size.alias("n"))
    n_bytes = items.agg(F.sum(F.octet_length(F.concat_ws(" ", "item_words")) + 8 * size)).first()[0] or 0
    items = F.broadcast(items) if n_bytes <= BROADCAST_BYTES else items
    few = item_seeds.count() <= BROADCAST_SEEDS
    if not few:
        docs = materialize(docs)  # read twice: rid must be the same
    every = masks | short_masks(lengths)
    diag = F.col("i") - F.col("j")
    span = F.slice("words", F.greatest(F.col("diag"), F.lit(0)) + 1, F.col("n") + F.least(F.col("diag"), F.lit(0)))
    with_words = docs.select("doc_id", "rid", word_array(F.col("text")).alias("words"))
    place = ["rid", "doc_id", "item_id", "diag"]
    if few:
        met = seeded(with_words, "words", "i", every).join(F.broadcast(item_seeds), "seed").withColumn("diag", diag)
        hits = met.select(*place, span.alias("span")).groupBy(*place).agg(F.first("span").alias("span"))
    else:
        places = seeded(with_words, "words", "i", every).select("seed", "rid", "i")
        met = materialize(places.join(item_seeds, "seed").select("rid", "item_id", "n", diag.alias("diag")).distinct())
        hits = with_words.join(met.select("rid").distinct(), "rid", "left_semi").join(met, "rid").select(*place, span.alias("span"))
    hits = hits.join(items, "item_id")
    skipped = F.greatest(-F.col("diag"), F.lit(0))
    aligned = F.zip_with("span", F.slice("item_words", skipped + 1, F.greatest(F.size("span"), F.lit(0))), lambda a, b: F.when(a == b, 1).otherwise(0))
    found = (
        hits.withColumn("stretch", best_stretch(aligned))
        .withColumn("n_item_words", F.size("item_words").cast("long"))
        .withColumn("n_matched", F.col("stretch.best_ones").cast("long"))
        .filter((F.col("n_item_words") >= SHORTEST) | (F.col("n_matched") == F.col("n_item_words")))
        .filter((F.col("n_matched") >= LEAST_SHARE * F.col("n_item_words")) | (F.col("n_matched") >= LEAST_WORDS))
        .withColumn("item_start", (skipped + F.col("stretch.best_from")).cast("long"))
        .withColumn("item_end", (skipped + F.col("stretch.best_to")).cast("long"))
        .withColumn("doc_start", F.col("item_start") + F.col("diag"))
        .withColumn("doc_end", F.col("item_end") + F.col("diag"))
        .withColumn("similarity", F.col("n_matched") / F.col("n_item_words"))
    )
    place = [c for c in PAIRS if c not in ("doc_id", "item_id", "item_ids")]
    return (
        found.groupBy("rid", "doc_id", "item_id")
        .agg(F.first("item_ids").alias("item_ids"), F.max_by(F.struct(*place), F.struct("n_matched", -F.col("doc_start"))).alias("at"))
        .select("rid", "doc_id", "item_id", "item_ids", *[f"at.{c}" for c in place])
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns.  Documents without an id are kept."""
    # A text leaks or not whatever its id, so ids may repeat.  The row's number in rid keeps the filter on the number of words
    # above the words, which would otherwise be made twice.
    text_id = [F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b")]
    rid = F.struct(*text_id, F.monotonically_increasing_id().alias("row"))
    searched = docs.filter(F.col("doc_id").isNotNull()).select(rid.alias("rid"), F.col("doc_id").cast("long"), "text")
    leaks = overlaps(searched, benchmark).select(F.struct("rid.a", "rid.b").alias("rid")).distinct()
    return docs.join(leaks, F.col("doc_id").isNotNull() & (F.struct(*text_id) == F.col("rid")), "left_anti")
