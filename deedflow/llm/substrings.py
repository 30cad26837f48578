"""Substring dedup with FM-indexes: passages that occur in a document of smaller id are removed.

A window is ``WINDOW`` consecutive words.  A word goes if a window over it has the words of a window of a document with a
smaller doc_id.

1. What to index.  Each window's least hash of ANCHOR words is its anchor, so equal windows have equal anchors.  Anchors of
   more than one document (their least and largest doc_id differ, which aggregates before the shuffle) go into a Bloom
   filter of bounded size; windows with other anchors occur once.  The hashes of the remaining windows are aggregated in the
   same way and give each repeated window's owner, the smallest doc_id with it.  However many documents hold a passage,
   its owner alone brings it into the library.
2. Shards of the library become compressed FM-indexes, a task each.
3. Documents stream past the indexes.  An index has a bit table of its windows' hashes, so windows that pass the filter go to the
   indexes that may hold them and to no others.  There, backward search over the wavelet matrix, for all windows of a batch
   at once, gives matching statistics: the longest matches, of which those of a window's length or more are intervals.  A
   window occurs in one document of the library, its owner, so any place of an interval names it; intervals whose owner has a smaller id are reported and removed.

The filter, the hashes and the bit tables only choose what is indexed and which index is asked; matches are found in the index.
Tasks read the indexes from the shared folder.  Up to ``SHIP_BYTES`` of them, each task holds all and removes the words where the
document is.  Beyond, a window belongs to the shard of its anchor, in the library as in the documents: runs of windows of one
shard (with the words that they share with their neighbours) travel to tasks that hold that shard's indexes, and the stretches
found join the documents.  So no document is read again for more indexes, and no window asks indexes of other shards.

Defined cases: null text has no words; documents with a null id lose nothing and take nothing from others; equal ids are not
smaller; kept words are joined by one space.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, as_i64, binary, gram_hashes, materialize, mix, partitions, rows_of, scratch, text_chunks, words, worker_cache
from .fmindex import FMIndex

WINDOW = 50
ANCHOR = 20
#: So many first words of a window are searched before all of them, where a match has ended; runs of windows are cut to so many.
PROBE, RUN = 8, 16
#: Chunks of so many words together are searched at once: a step costs little more for more windows.
POOL_WORDS = 4 << 20
SHARD_WORDS = 1 << 21
SHIP_BYTES = 160 << 20
#: About the bytes of an index for each word; and how many times the words of the library those of runs by anchor are.
INDEX_BYTES, SHARED = 6, 4
#: Runs for one shard are dealt to so many tasks.
SPREAD = 8
#: The filter has so many bits a key, up to a bound; a full filter lets more windows through and changes no result.
BITS_PER_KEY = 16
MAX_FILTER_BITS = 28
MIN_FILTER_BITS = 20
FILTER_HASHES = 4
PART_BITS = 18


def sliding(values: np.ndarray, width: int, best: Callable) -> np.ndarray:
    """The best of the width values from each place on (len - width + 1 places)."""
    reach, span = 1, values
    while reach * 2 <= width:
        span = best(span[:-reach], span[reach:])
        reach *= 2
    return span if reach == width else best(span[: len(values) - width + 1], span[width - reach : width - reach + len(values) - width + 1])


def window_starts(first: np.ndarray) -> np.ndarray:
    """Places of the first words of all windows of rows."""
    row = rows_of(first)
    return np.flatnonzero(row[: max(0, len(row) - WINDOW + 1)] == row[WINDOW - 1 :])


class Windows:
    """Windows of all rows of a chunk of texts."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray):
        self.starts = np.zeros(0, np.int64)  # places of windows' first words
        self.least = np.zeros(0, U64)  # each window's anchor
        if len(hashes) < WINDOW:
            return
        self.starts = window_starts(first)
        self.least = sliding(gram_hashes(hashes, ANCHOR), WINDOW - ANCHOR + 1, np.minimum)[self.starts]


def _chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, each row's first word)."""
    for row, _, data, offsets in text_chunks(column):
        _, _, hashes, first = words(data, offsets, lower=False)
        yield row, hashes, first


def _distinct(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(row):
        return row, value
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[fresh], value[fresh]
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[keep], value[keep]


def _repeated(docs: DataFrame, run: Callable) -> DataFrame:
    """(hash, owner) of the hashes that run gives for documents of more than one id."""
    return (
        docs.mapInArrow(run, "hash long, doc_id long")
        .groupBy("hash").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
        .filter("owner < last").select("hash", "owner")
    )


def filter_cells(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    out = []
    for i in range(FILTER_HASHES):
        hashes = mix(hashes + U64(i + 1))
        out.append((hashes >> U64(64 - bits)).astype(np.int64))
    return out


def bloom(keys: DataFrame) -> tuple[np.ndarray, int]:
    """A packed Bloom filter of column hash, of at most 2 ** MAX_FILTER_BITS bits."""
    n = keys.count()
    bits = int(np.clip((max(1, n) * BITS_PER_KEY - 1).bit_length(), MIN_FILTER_BITS, MAX_FILTER_BITS))
    part_bits = min(PART_BITS, bits)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.unique(np.concatenate(filter_cells(as_i64(batch.column(0).to_numpy()).view(U64), bits)))
            yield pa.RecordBatch.from_arrays([pa.array(cell >> part_bits), pa.array(cell & (1 << part_bits) - 1)], ["part", "cell"])

    def pack(group: pa.Table) -> pa.Table:
        on = np.zeros(1 << part_bits, bool)
        on[group.column("cell").to_numpy()] = True
        return pa.table({"part": group.column("part").slice(0, 1), "bits": binary([np.packbits(on, bitorder="little").tobytes()])})

    parts = keys.select("hash").mapInArrow(cells, "part long, cell long").distinct().groupBy("part").applyInArrow(pack, "part long, bits binary").collect()
    out = np.zeros((1 << bits - part_bits, max(1, (1 << part_bits) // 8)), np.uint8)
    for r in parts:
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel(), bits


def in_bloom(packed: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    out = np.ones(len(hashes), bool)
    for cell in filter_cells(hashes, bits):
        out &= (packed[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
    return out


def repeated_windows(docs: DataFrame) -> tuple[DataFrame, Broadcast]:
    """(hash, owner) of the windows that documents of more than one id hold, and the filter of their anchors."""
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, hashes, first in _chunks(batch.column(1)):
                w = Windows(hashes, first)
                row, value = _distinct(rows_of(first)[w.starts], w.least)
                yield pa.RecordBatch.from_arrays([pa.array(as_i64(value)), batch.column(0).take(pa.array(row + at))], ["hash", "doc_id"])

    kept = docs.sparkSession.sparkContext.broadcast(bloom(materialize(_repeated(docs, anchors), freed=True)))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, bits = kept.value
        for batch in batches:
            for at, hashes, first in _chunks(batch.column(1)):
                w = Windows(hashes, first)
                starts = w.starts[in_bloom(packed, bits, w.least)]
                if len(starts):
                    row, value = _distinct(rows_of(first)[starts], gram_hashes(hashes, WINDOW)[starts])
                    yield pa.RecordBatch.from_arrays([pa.array(as_i64(value)), batch.column(0).take(pa.array(row + at))], ["hash", "doc_id"])

    return _repeated(docs, windows), kept


def library(docs: DataFrame, owned: DataFrame) -> DataFrame:
    """(doc_id, n, words): the stretches of each owner that its windows cover, as word hashes."""
    lists = owned.groupBy(F.col("owner").alias("doc_id")).agg(F.collect_list("hash").alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found, sizes, parts = batch.column(0).to_pylist(), [], [], []
            own = batch.column(2)
            for at, hashes, first in _chunks(batch.column(1)):
                grams = gram_hashes(hashes, WINDOW)
                for i in range(len(first) - 1):
                    a, b = first[i], first[i + 1] - WINDOW + 1
                    if b <= a:
                        continue
                    wanted = np.sort(own[at + i].values.to_numpy())
                    here = as_i64(grams[a:b])
                    place = np.minimum(np.searchsorted(wanted, here), len(wanted) - 1)
                    starts = np.flatnonzero(wanted[place] == here)
                    cuts = np.flatnonzero(np.diff(starts) > 1)
                    for s, e in zip(starts[np.concatenate([[0], cuts + 1])] if len(starts) else [], starts[np.concatenate([cuts, [-1]])] if len(starts) else [], strict=True):
                        found.append(ids[at + i])
                        sizes.append(int(e - s) + WINDOW)
                        parts.append(hashes[a + s : a + e + WINDOW].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(sizes, pa.int64()), binary(parts)], ["doc_id", "n", "words"])

    return docs.join(lists, "doc_id").select("doc_id", "text", "own").mapInArrow(run, "doc_id long, n long, words binary")


def build_indexes(passages: DataFrame, folder: str) -> DataFrame:
    """(shard, path): an FM-index of the passages of each shard, written by its task to the shared folder under a name
    of its own; only those of tasks that ended are named."""
    def build(group: pa.Table) -> pa.Table:
        passages = [np.frombuffer(x, U64) for x in group.column("words").to_pylist()]
        grams = gram_hashes(np.concatenate(passages), WINDOW)[window_starts(np.concatenate([[0], np.cumsum([len(x) for x in passages])]))]
        blob = FMIndex(passages, group.column("doc_id").to_pylist(), grams).dump()
        fs, inner = pafs.FileSystem.from_uri(folder)
        fs.create_dir(inner, recursive=True)
        name = f"{uuid.uuid4().hex}.fm"
        with fs.open_output_stream(f"{inner}/{name}") as out:
            out.write(blob)
        return pa.table({"shard": group.column("shard").slice(0, 1), "path": pa.array([f"{folder}/{name}"])})

    return passages.groupBy("shard").applyInArrow(build, "shard long, path string")


def runs_of(starts: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last of windows behind each other that belong to one shard."""
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (starts[1:] - starts[:-1] != 1) | (shard[1:] != shard[:-1])
    first = np.flatnonzero(fresh)
    return first, np.append(first[1:], len(starts))[: len(first)] - 1


def shard_of(anchors: np.ndarray, n_shards: int) -> np.ndarray:
    return (mix(anchors) % U64(n_shards)).astype(np.int64)


def by_anchor(passages: DataFrame, n_shards: int, parts: np.ndarray | None = None) -> DataFrame:
    """(shard, doc_id, n, words): the library's passages cut into runs of one shard.  With parts, the first index of each shard
    (and one beyond the last), shard is the index: a shard of several deals its runs to them.  Without, words are null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = np.frombuffer(b"".join(batch.column(2).to_pylist()), U64)
            w = Windows(hashes, np.concatenate([[0], np.cumsum(batch.column(1).to_numpy())]))
            if not len(w.starts):
                continue
            of = shard_of(w.least, n_shards)
            begin, last = runs_of(w.starts, of)
            row = np.searchsorted(np.cumsum(batch.column(1).to_numpy()), w.starts[begin], "right")
            shard, n = of[begin], last - begin + WINDOW
            if parts is None:
                cut = pa.nulls(len(begin), pa.binary())
            else:
                cut = binary([hashes[a : a + k].tobytes() for a, k in zip(w.starts[begin].tolist(), n.tolist(), strict=True)])
                shard = parts[shard] + (gram_hashes(hashes, WINDOW)[w.starts[begin]] % (parts[shard + 1] - parts[shard]).astype(U64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shard), batch.column(0).take(pa.array(row)), pa.array(n), cut], ["shard", "doc_id", "n", "words"])

    return passages.select("doc_id", "n", "words").mapInArrow(run, "shard long, doc_id long, n long, words binary")


def asked(docs: DataFrame, anchors: Broadcast, n_shards: int, held: np.ndarray) -> DataFrame:
    """(shard, lot, doc_id, of, start, words): the documents' runs of windows that pass the filter, by shard (those that hold
    something), as text; of tells rows with one doc_id apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = ~batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for at, _, data, offsets in text_chunks(batch.column(1)):
                begins, ends, hashes, first = words(data, offsets, lower=False)
                w = Windows(hashes, first)
                keep = in_bloom(*anchors.value, w.least)
                starts, of = w.starts[keep], shard_of(w.least[keep], n_shards)
                keep = known[np.searchsorted(first, starts, "right") - 1 + at] & held[of]
                starts, of = starts[keep], of[keep]
                if not len(starts):
                    continue
                begin, last = runs_of(starts, of)
                row = np.searchsorted(first, starts[begin], "right") - 1
                raw, text = data.tobytes(), {r: text_hash(batch.column(1), r + at) for r in np.unique(row).tolist()}
                cut = [raw[a:b] for a, b in zip(begins[starts[begin]].tolist(), ends[starts[last] + WINDOW - 1].tolist(), strict=True)]
                text = np.array([text[r] for r in row.tolist()], np.int64)
                cols = [pa.array(of[begin]), pa.array(text % SPREAD), batch.column(0).take(pa.array(row + at)), pa.array(text), pa.array(starts[begin] - first[row]), binary(cut)]
                yield pa.RecordBatch.from_arrays(cols, ["shard", "lot", "doc_id", "of", "start", "words"])

    return docs.mapInArrow(run, "shard long, lot long, doc_id long, of long, start long, words binary")


def answered(runs: DataFrame, paths: list[list[str]]) -> DataFrame:
    """(doc_id, start, end, of): the stretches to remove, of runs that are sorted by shard; paths: the indexes of each shard."""
    def pools(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
        pool, of, n = [], -1, 0
        for batch in batches:
            shards = batch.column(0).to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(shards)) + 1, [len(shards)]])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if a == b:
                    continue
                if pool and (shards[a] != of or n >= POOL_WORDS):
                    yield of, pool
                    pool, n = [], 0
                parts = batch.column(5).slice(a, b - a).to_pylist()
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
                _, _, hashes, first = words(np.frombuffer(b"".join(parts), np.uint8), offsets, lower=False)
                pool.append((hashes, np.diff(first), *[batch.column(i).slice(a, b - a).to_numpy() for i in (2, 3, 4)]))
                of, n = int(shards[a]), n + len(hashes)
        if pool:
            yield of, pool

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, pool in pools(batches):
            hashes, n, ids, of, at = (np.concatenate(x) for x in zip(*pool, strict=True))
            first = np.concatenate([[0], np.cumsum(n)])
            starts = window_starts(first)
            own, grams = ids[np.searchsorted(first, starts, "right") - 1], gram_hashes(hashes, WINDOW)[starts]
            for index in opened(paths[shard]):
                start, end = covered(index, hashes, starts, own, grams)
                row = np.searchsorted(first, start, "right") - 1
                move = at[row] - first[row]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[row], start + move, end + move, of[row])], ["doc_id", "start", "end", "of"])

    return runs.mapInArrow(run, "doc_id long, start long, end long, of long")


def opened(paths: list[str]) -> list[FMIndex]:
    """The indexes of these files; a worker keeps those it was last asked for."""
    kept = worker_cache().setdefault("indexes", {})
    for path in set(kept) - set(paths):
        del kept[path]
    for path in paths:
        if path not in kept:
            fs, inner = pafs.FileSystem.from_uri(path)
            with fs.open_input_file(inner) as file:
                kept[path] = FMIndex.load(file.read())
    return [kept[path] for path in paths]


def candidates(hashes: np.ndarray, first: np.ndarray, known: np.ndarray, kept: tuple[np.ndarray, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows whose anchor passes the filter, their rows, and their hashes."""
    w = Windows(hashes, first)
    starts = w.starts[in_bloom(*kept, w.least)]
    row = np.searchsorted(first, starts, "right") - 1
    starts, row = starts[known[row]], row[known[row]]
    return starts, row, gram_hashes(hashes, WINDOW)[starts]


def covered(index: FMIndex, hashes: np.ndarray, starts: np.ndarray, ids: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words to remove: matches of a window's length with documents of smaller id than the
    window's own (ids).  Windows that the index cannot hold by their hashes (grams) are left to the other indexes."""
    inside = index.may_hold(grams)
    starts, ids = starts[inside], ids[inside]
    if not len(starts):
        return starts, starts
    # windows behind each other are a run, cut where it gets long
    cut = np.ones(len(starts), bool)
    cut[1:] = starts[1:] - starts[:-1] != 1
    of_run = np.arange(len(starts)) - np.maximum.accumulate(np.where(cut, np.arange(len(starts)), 0))
    begin = np.flatnonzero(of_run % RUN == 0)
    last = np.append(begin[1:], len(starts)) - 1
    run, start, end, suffix = index.matches(hashes, starts[begin], starts[last], WINDOW, PROBE)
    smaller = index.doc_at(index.locate(suffix)) < ids[begin[run]]
    return start[smaller], end[smaller]


def _matches(indexes: list[FMIndex], kept: tuple[np.ndarray, int], batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    """For each chunk of the batches (doc_id, text, ...): batch, first row, each row's first word, stretches of all indexes
    (start, end)."""
    pool: list[tuple] = []
    for batch in batches:
        ids = batch.column(0)
        known = ~ids.is_null().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        for at, hashes, first in _chunks(batch.column(1)):
            rows = slice(at, at + len(first) - 1)
            starts, row, grams = candidates(hashes, first, known[rows], kept)
            pool.append((batch, at, first, hashes, starts, ids[rows][row], grams))
            if sum(len(x[3]) for x in pool) >= POOL_WORDS:
                yield from _searched(indexes, pool)
                pool = []
    yield from _searched(indexes, pool)


def _searched(indexes: list[FMIndex], pool: list[tuple]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    if not pool:
        return
    base = np.concatenate([[0], np.cumsum([len(x[3]) for x in pool])])
    hashes, ids, grams = (np.concatenate([x[i] for x in pool]) for i in (3, 5, 6))
    starts = np.concatenate([x[4] + b for x, b in zip(pool, base, strict=False)])
    found = [covered(index, hashes, starts, ids, grams) for index in indexes]
    found = np.concatenate([np.stack(x, axis=1) for x in found] or [np.zeros((0, 2), np.int64)])
    found = found[np.argsort(found[:, 0], kind="stable")]
    cuts = np.searchsorted(found[:, 0], base)
    for i, (batch, at, first, *_) in enumerate(pool):
        yield batch, at, first, found[cuts[i] : cuts[i + 1]] - base[i]


def text_hash(texts: pa.Array, i: int) -> int:
    return xxhash.xxh3_64_intdigest(texts[i].as_buffer() or b"") - (1 << 63)


def remove_repeats(docs: DataFrame, ship_bytes: int = SHIP_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, text of the kept words."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    windows, anchors = repeated_windows(docs)
    passages = materialize(library(docs, windows), freed=True)
    n_words = passages.agg(F.sum("n")).first()[0] or 0
    folder = scratch(spark)

    def kept(part: pa.RecordBatch, at: int, first: np.ndarray, stretches: np.ndarray) -> pa.RecordBatch:
        gone = np.zeros(int(first[-1]) + 1, np.int64)
        np.add.at(gone, stretches[:, 0], 1)
        np.add.at(gone, stretches[:, 1], -1)
        gone = np.cumsum(gone)[:-1] > 0
        removed = np.concatenate([[0], np.cumsum(gone)])[first]
        texts = []
        for i, text in enumerate(part.column(1).slice(at, len(first) - 1).to_pylist()):
            own = (text or "").encode().split()
            if removed[i + 1] > removed[i]:
                own = [w for w, g in zip(own, gone[first[i] : first[i + 1]].tolist(), strict=True) if not g]
            texts.append(b" ".join(own).decode())
        return pa.RecordBatch.from_arrays([part.column(0).slice(at, len(first) - 1), pa.array(np.diff(first)), pa.array(np.diff(removed)), pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", "text"])

    schema = "doc_id long, n_words long, n_removed long, text string"
    if n_words * INDEX_BYTES <= ship_bytes:
        shard = F.pmod(F.xxhash64("doc_id", F.xxhash64("words")), F.lit(max(1, -(-n_words // shard_words)))).cast("long")
        paths = [r["path"] for r in materialize(build_indexes(passages.withColumn("shard", shard), folder), freed=True).orderBy("shard").collect()]

        def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            indexes = opened(paths)
            for batch, at, first, stretches in _matches(indexes, anchors.value, batches):
                yield kept(batch, at, first, stretches)

        return docs.mapInArrow(at_once, schema)

    n_shards = -(-n_words * SHARED // shard_words)
    sizes = np.zeros(n_shards, np.int64)
    for r in by_anchor(passages, n_shards).groupBy("shard").agg(F.sum("n").alias("n")).collect():
        sizes[r["shard"]] = r["n"]
    parts = np.concatenate([[0], np.cumsum(-(-sizes // (2 * shard_words)))])  # a shard of much more than its share has several indexes
    built = dict(map(tuple, materialize(build_indexes(by_anchor(passages, n_shards, parts), folder), freed=True).collect()))
    paths = [[built[i] for i in range(parts[s], parts[s + 1]) if i in built] for s in range(n_shards)]
    runs = asked(docs, anchors, n_shards, sizes > 0).repartition(max(partitions(spark), -(-n_shards // 4)), "shard", "lot").sortWithinPartitions("shard")
    found = materialize(answered(runs, paths), freed=True)
    lists = found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "of")).alias("found"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2).to_pylist()
            for at, _, first in _chunks(batch.column(1)):
                # rows that repeat a doc_id share its list: a stretch belongs to texts of its hash
                own = [text_hash(batch.column(1), at + i) if lists[at + i] else None for i in range(len(first) - 1)]
                stretches = [(int(first[i]) + x["start"], int(first[i]) + x["end"]) for i in range(len(own)) for x in lists[at + i] or () if x["of"] == own[i]]
                yield kept(batch, at, first, np.array(stretches, np.int64).reshape(-1, 2))

    return docs.join(lists, "doc_id", "left").select("doc_id", "text", "found").mapInArrow(listed, schema)
