"""N-gram Jaccard join with set-relation skipping, as components of documents.

Two documents link when the Jaccard similarity of their sets of word shingles reaches a threshold; the answer is exact up
to 64-bit hashes of shingles.

1. Equal sets become one class; only classes are joined.
2. Shingles are ordered from rare to frequent (by a count sketch of fixed size over all documents, ties by hash), and each
   class lists the first of them, so many that two similar sets must share one.  Entries carry set size and position.
3. Within a list, every set is compared with the list's leader, the member with the fewest rarer shingles (of edited copies,
   the one with the fewest edits), after filters on size, position and a count sketch of the set.  These are star pairs: linear in the list, however long.  For each, the overlap and both
   differences (shingles only the one, only the other has) are kept: the leader's computed answers.
4. What lists may still hide are links between two members that star pairs do not connect.  Each list is cut into blocks of
   equal size, position and component by star pairs; blocks are paired only if size and position allow it and they are of
   different components, so others are skipped whole; blocks meet by list and size class, and those of long lists in
   several cells.  For a remaining pair whose members both were compared with the
   list's leader, the overlap follows from the leader's answers by the small differences alone; the rest are
   compared as whole sets.
5. Components of the links give the smallest reachable doc_id.

No list, group or component is collected in one place.

Defined cases: null text and text without words have the empty set and link with nothing; fewer words than a shingle are one
shingle; rows that repeat a doc_id stand on their own but share the id; null ids are larger than any other for
component_id, and a component of null ids alone has a null one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, as_i64, binary, gram_hashes, materialize, mix, rows_of, text_chunks, words
from .components import components

SKETCH_BITS = 20
SKETCH_PARTS = 64
CELLS = 64
#: Lists longer than this are paired in so many cells that each has about this many blocks a side.
LIST_CELL = 1000
#: Rows of (doc_id, class) up to which they are broadcast instead of shuffling all texts.
BROADCAST_IDS = 2_000_000
#: Column of keep_one_of_each alone.
ROW = "__row"


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    for first_row, end_row, data, offsets in text_chunks(column):
        _, _, hashes, first = words(data, offsets, lower=True)
        grams = gram_hashes(hashes, k)
        for row in range(end_row - first_row):
            a, b = first[row], first[row + 1]
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                yield gram_hashes(hashes[a:b], int(b - a))
            else:
                yield np.zeros(0, U64)


def prefix_length(n: int, percent: int) -> int:
    """So many of the first shingles of a set of n that a set of similarity percent must hold one, in the same order."""
    return n - -(-percent * n // 100) + 1


def least_overlap(n: F.Column | int, m: F.Column | int, percent: int):
    """100 * both >= percent * (n + m - both)."""
    return F.ceil(percent * (n + m) / (100 + percent))


def frequency_sketch(docs: DataFrame, k: int) -> np.ndarray:
    """A class of frequency for each cell of a hashed count of shingles over all documents (one byte each)."""
    size = 1 << SKETCH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(size, np.int64)
        for batch in batches:
            waiting, n = [], 0
            for s in shingle_sets(batch.column(0), k):
                waiting.append(s)
                n += len(s)
                if n > 1 << 19:
                    cells += np.bincount((np.concatenate(waiting) >> U64(64 - SKETCH_BITS)).astype(np.int64), minlength=size)
                    waiting, n = [], 0
            if n:
                cells += np.bincount((np.concatenate(waiting) >> U64(64 - SKETCH_BITS)).astype(np.int64), minlength=size)
        if cells.any():
            parts = cells.reshape(SKETCH_PARTS, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SKETCH_PARTS)), binary([p.astype("<u4" if p.max() < 1 << 32 else "<u8").tobytes() for p in parts])], ["part", "counts"])

    def add(group: pa.Table) -> pa.Table:
        width = size // SKETCH_PARTS
        total = sum(np.frombuffer(x, "<u4" if len(x) == 4 * width else "<u8").astype(np.int64) for x in group.column("counts").to_pylist())
        return pa.table({"part": group.column("part").slice(0, 1), "counts": binary([total.tobytes()])})

    found = docs.select("text").mapInArrow(count, "part long, counts binary").groupBy("part").applyInArrow(add, "part long, counts binary").collect()
    cells = np.zeros((SKETCH_PARTS, size // SKETCH_PARTS), np.int64)
    for r in found:
        cells[r["part"]] = np.frombuffer(r["counts"], np.int64)
    return np.minimum(255, 6 * np.log2(cells.ravel() + 1)).astype(np.uint8)


def document_sets(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, cid, n, prefix, cells): class, size, first shingles from rare to frequent, and counts by hash cells."""
    rarity = docs.sparkSession.sparkContext.broadcast(frequency_sketch(docs, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = rarity.value
        for batch in batches:
            cid, n, prefix, cells = [], [], [], []

            def out(ids: pa.Array) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([ids, pa.array(cid, pa.int64()), pa.array(n, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), binary(cells)], ["doc_id", "cid", "n", "prefix", "cells"])

            start = 0
            for s in shingle_sets(batch.column(1), k):
                cid.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63))
                n.append(len(s))
                take = prefix_length(len(s), percent) if len(s) else 0
                frequent = kind[(s >> U64(64 - SKETCH_BITS)).astype(np.int64)]
                order = np.argsort(frequent.astype(np.uint16), kind="stable")[:take]  # s is in order of hash
                prefix.append(as_i64(s[order]))
                counts = np.bincount((s & U64(CELLS - 1)).astype(np.int64), minlength=CELLS)
                cells.append(counts.astype("<u2").tobytes() if len(s) and counts.max() < 1 << 16 else b"")
                if len(cid) == 2000:
                    yield out(batch.column(0).slice(start, 2000))
                    start += 2000
                    cid, n, prefix, cells = [], [], [], []
            if cid:
                yield out(batch.column(0).slice(start))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, cid long, n long, prefix array<long>, cells binary")


def sketch_filter(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) whose overlap may suffice by their cells' counts."""
    cells = classes.select("cid", "cells")
    joined = pairs.join(cells.select(F.col("cid").alias("a"), F.col("cells").alias("ca")), "a").join(cells.select(F.col("cid").alias("b"), F.col("cells").alias("cb")), "b").select("a", "b", "na", "nb", "ca", "cb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            bound = np.full(n, np.iinfo(np.int64).max)
            lengths = [np.array([len(x) for x in batch.column(i).to_pylist()]) for i in (4, 5)]
            known = np.flatnonzero((lengths[0] > 0) & (lengths[1] > 0))
            if len(known):
                a, b = (np.frombuffer(b"".join(batch.column(i).take(pa.array(known)).to_pylist()), "<u2").reshape(-1, CELLS) for i in (4, 5))
                bound[known] = np.minimum(a, b).sum(axis=1, dtype=np.int64)
            size = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            ok = bound >= -(-percent * size // (100 + percent))
            yield pa.RecordBatch.from_arrays(batch.columns[:4], ["a", "b", "na", "nb"]).filter(pa.array(ok))

    return joined.mapInArrow(run, "a long, b long, na long, nb long")


def whole_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(cid, tokens) of the wanted classes, taken from the text of each class's first document."""
    reps = materialize(classes.join(wanted, "cid", "left_semi").select(F.col("rep"), F.col("cid").alias("want")))
    reps_side = F.broadcast(reps) if reps.count() <= BROADCAST_IDS else reps
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(reps_side, F.col("doc_id").eqNullSafe(F.col("rep"))).select("want", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want, at, own, sets = batch.column(0).to_pylist(), 0, [], []
            for w, s in zip(want, shingle_sets(batch.column(1), k), strict=True):
                if xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) == w:  # else another row of that id
                    own.append(w)
                    sets.append(s.tobytes())
                if len(own) == 500:
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), binary(sets)], ["cid", "tokens"])
                    own, sets = [], []
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), binary(sets)], ["cid", "tokens"])

    return texts.mapInArrow(run, "cid long, tokens binary").dropDuplicates(["cid"])


def compare(pairs: DataFrame, sets: DataFrame, percent: int, differences: bool) -> DataFrame:
    """Pairs (a, b) with their overlap and whether they link; with differences also what only a and only b hold."""
    side = lambda c: sets.select(F.col("cid").alias(c), F.col("tokens").alias(f"t{c}"))
    joined = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb")
    names = ["a", "b", "na", "nb", "overlap", "linked", *["minus", "plus"] * differences]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for x, y in zip(part.column(2), part.column(3), strict=True):
                    x, y = (np.frombuffer(v.as_buffer(), U64) for v in (x, y))
                    in_x = np.zeros(len(y), bool)
                    place = np.minimum(np.searchsorted(x, y), len(x) - 1)
                    in_x = x[place] == y
                    both = int(in_x.sum())
                    row = [len(x), len(y), both, 100 * both >= percent * (len(x) + len(y) - both)]
                    if differences:
                        only_x = np.ones(len(x), bool)
                        only_x[place[in_x]] = False
                        row += [x[only_x].tobytes(), y[~in_x].tobytes()]
                    rows.append(row)
                cols = list(zip(*rows, strict=True)) or [[]] * (len(names) - 2)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, t) for c, t in zip(cols, types, strict=False))], names)

    return joined.mapInArrow(run, "a long, b long, na long, nb long, overlap long, linked boolean" + ", minus binary, plus binary" * differences)


def derive(pairs: DataFrame, answers: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, leader), both compared with the leader: overlap by the leader's answers and the differences."""
    side = lambda c: answers.select(F.col("a").alias("leader"), F.col("b").alias(c), F.col("na").alias("np"), F.col("nb").alias(f"n{c}"), F.col("minus").alias(f"m{c}"), F.col("plus").alias(f"p{c}"))
    joined = pairs.select("leader", "a", "b").join(side("a"), ["leader", "a"]).join(side("b").drop("np"), ["leader", "b"]).select("a", "b", "np", "na", "nb", "ma", "mb", "pa", "pb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, na, nb = (batch.column(i).to_numpy() for i in (2, 3, 4))
            overlap = np.zeros(batch.num_rows, np.int64)
            for i in range(batch.num_rows):
                ma, mb, more_a, more_b = (np.frombuffer(batch.column(c)[i].as_buffer(), U64) for c in (5, 6, 7, 8))
                lost = len(ma) + len(mb) - len(np.intersect1d(ma, mb, assume_unique=True))
                overlap[i] = base[i] - lost + len(np.intersect1d(more_a, more_b, assume_unique=True))
            linked = 100 * overlap >= percent * (na + nb - overlap)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(overlap), pa.array(linked)], ["a", "b", "overlap", "linked"])

    return joined.mapInArrow(run, "a long, b long, overlap long, linked boolean")


def allowed(na, nb, ia, ib, percent: int) -> F.Column:
    """By size and position of the first shared entry, may two sets be similar?"""
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (F.lit(1) + F.least(na - ia, nb - ib) - 1 >= least_overlap(na, nb, percent))


def link_classes(docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b) links between classes that connect all that are similar, directly or through others."""
    entries = classes.select("cid", "n", F.posexplode("prefix").alias("i", "token"))
    leaders = entries.groupBy("token").agg(F.min(F.struct("i", "cid", "n")).alias("lead"), F.count("*").alias("size")).filter("size > 1")
    shared = materialize(
        entries.join(leaders.select("token", "size", F.col("lead.cid").alias("leader"), F.col("lead.n").alias("ln"), F.col("lead.i").alias("li")), "token").filter("cid <> leader")
    )
    stars = shared.filter(allowed(F.col("ln"), F.col("n"), F.col("li"), F.col("i"), percent)).select(F.col("leader").alias("a"), F.col("cid").alias("b"), F.col("ln").alias("na"), F.col("n").alias("nb")).distinct()
    stars = materialize(sketch_filter(stars, classes, percent))
    wanted = stars.select(F.col("a").alias("cid")).union(stars.select("b")).distinct()
    sets = materialize(whole_sets(docs, classes, wanted, k))
    answers = materialize(compare(stars, sets, percent, differences=True))
    linked = answers.filter("linked").select("a", "b")

    # Lists of three and more, cut into blocks; a block's label is what its members are connected with by star pairs.
    label = components(linked.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("cid"), F.col("root").alias("label"))
    # Blocks meet by token and size class (similar sets lie in one class or in neighbours); those of long lists are dealt on
    # a square of cells, so that a cell has a bounded number of blocks from either side.
    width = math.log(100 / percent) + 1e-3
    blocks = (
        shared.filter("size > 2").join(label, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
        .groupBy("token", "leader", "n", "i", "label", F.pmod("cid", F.lit(16)).alias("part"))
        .agg(F.collect_list("cid").alias("members"), F.first("size").alias("size"))
        .withColumn("class", F.floor(F.log("n") / width))
        .withColumn("cells", F.floor(F.col("size") / LIST_CELL) + 1)
        .withColumn("cell", F.pmod(F.xxhash64("n", "i", "label", "part"), F.col("cells")))
    )
    blocks = materialize(blocks)
    left, right = (blocks.select("token", "cells", "class", "cell", *[F.col(c).alias(f"{c}{s}") for c in ("leader", "n", "i", "label", "members")]) for s in "xy")
    every = F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)
    left = left.select("*", F.explode(every).alias("celly")).withColumnRenamed("cell", "cellx").drop("cells")
    right = right.select("*", F.explode(every).alias("cellx")).withColumnRenamed("cell", "celly").drop("cells")
    right = right.withColumn("class", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)))
    block_pairs = left.join(right, ["token", "class", "cellx", "celly"]).filter(
        (F.col("labelx") < F.col("labely")) & allowed(F.col("nx"), F.col("ny"), F.col("ix"), F.col("iy"), percent)
    )
    rest = block_pairs.select(F.col("leaderx").alias("leader"), "nx", "ny", F.explode("membersx").alias("x"), "membersy").select("leader", "nx", "ny", "x", F.explode("membersy").alias("y"))
    one_way = F.col("x") < F.col("y")
    rest = (
        rest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(one_way, F.col("nx")).otherwise(F.col("ny")).alias("na"), F.when(one_way, F.col("ny")).otherwise(F.col("nx")).alias("nb"), "leader")
        .join(answers.select(F.col("a").alias("leader"), F.col("b").alias("a"), F.col("overlap").alias("oa")), ["leader", "a"], "left")
        .join(answers.select(F.col("a").alias("leader"), "b", F.col("overlap").alias("ob")), ["leader", "b"], "left")
        .withColumn("through", F.when(F.col("oa").isNotNull() & F.col("ob").isNotNull(), F.col("leader")))
        # more than both share with the leader, and have beside it, they cannot share
        .filter(F.col("through").isNull() | (F.least("oa", "ob") + F.least(F.col("na") - F.col("oa"), F.col("nb") - F.col("ob")) >= least_overlap(F.col("na"), F.col("nb"), percent)))
        .groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.min("through").alias("leader"))
    )
    rest = materialize(rest)
    derived = derive(rest.filter("leader is not null"), answers, percent).filter("linked").select("a", "b")
    others = materialize(sketch_filter(rest.filter("leader is null"), classes, percent))
    wanted = others.select(F.col("a").alias("cid")).union(others.select("b")).distinct()
    compared = compare(others, whole_sets(docs, classes, wanted, k), percent, differences=False).filter("linked").select("a", "b")
    return linked.unionByName(derived).unionByName(compared)


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    sets = materialize(document_sets(docs, k, percent))
    some = sets.filter("n > 0")
    classes = materialize(some.groupBy("cid", "n").agg(F.min("doc_id").alias("rep"), F.first("prefix").alias("prefix"), F.first("cells").alias("cells")))
    linked = components(link_classes(docs, classes, k, percent).select(F.col("a").alias("u"), F.col("b").alias("v")))
    reps = classes.select("cid", "rep")
    least = linked.join(reps, linked["node"] == reps["cid"]).groupBy("root").agg(F.min("rep").alias("component"))
    of_class = reps.join(linked.join(least, "root").select(F.col("node").alias("cid"), "component"), "cid", "left").select("cid", F.coalesce("component", "rep").alias("component_id"))
    found = some.select("doc_id", "cid", "n").join(of_class, "cid").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return found.unionByName(sets.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def numbered_rows(docs: DataFrame) -> DataFrame:
    """With a number in ROW for each row, the same at each reading: docs come from files, or are written first."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = materialize(docs)
    return docs.withColumn(ROW, F.monotonically_increasing_id())


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, with all its columns: that of the least id, where rows without an id come last."""
    rows = numbered_rows(docs)
    found = materialize(jaccard_components(rows.select(F.col(ROW).alias("doc_id"), "text"), k, percent).select(F.col("doc_id").alias(ROW), "component_id"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"), ROW)
    kept = rows.select(ROW, "doc_id").join(found, ROW).groupBy("component_id").agg(F.min(order)[ROW].alias(ROW))
    return rows.join(found.join(kept, ROW, "left_anti").select(ROW), ROW, "left_anti").drop(ROW)
