"""Line dedup against sharded minimal perfect hashes.

Lines that many documents hold (``MIN_DOCS``) keep their place only in the largest doc_id.  The keys of such lines are
counted by a partially aggregated groupBy over 128-bit hashes; each shard of them becomes a minimal perfect hash (levels of
bits in which a key alone in its cell is placed, ranks by counting bits) that indexes arrays of fingerprints, counts and
keepers.  Documents probe those arrays; lines are never joined with lines.

The shards travel to every task only if their counted size is at most ``SHIP_BYTES``.  Beyond it the documents' hashes are
routed to the shards: keys of so many documents that they would crowd a shard (at most ``HOT_KEYS`` of them, as their
counts add up to all lines) are looked up where the document is, the others stream past their shard's arrays, and what is
dropped joins the documents by doc_id.

Defined cases: null or empty text is one empty line; a document whose lines all go has empty text; rows that repeat a
doc_id count as documents of their own and keep or lose a line together; a null doc_id never keeps a line that another
document keeps, and a line found under null ids alone stays.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, as_i64, binary, materialize, mix, partitions

# What a line's key is and when it counts as repeated.
STRIPPED = " \t\n\v\f\r"
MIN_CHARS = 40
MIN_DOCS = 5

SHIP_BYTES = 64 << 20
ENTRY_BYTES = 24
SHARD_KEYS = 1 << 20
HOT_KEYS = 4096
SLOTS_PER_KEY = 2
MAX_LEVELS = 40
SLICE = 500


def key_hash(line: str) -> int | None:
    key = line.strip(STRIPPED)
    return xxhash.xxh3_128_intdigest(key.encode().lower()) if len(key) >= MIN_CHARS else None


def to_arrays(keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """High and low halves of 128-bit hashes."""
    both = np.frombuffer(b"".join(k.to_bytes(16, "little") for k in keys), U64).reshape(-1, 2)
    return both[:, 1].copy(), both[:, 0].copy()


class Shard:
    """A minimal perfect hash over the high halves; the low halves are the fingerprints."""

    def __init__(self, high: np.ndarray, low: np.ndarray, counts: np.ndarray, keepers: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        left, place, placed = np.arange(len(high)), np.full(len(high), -1, np.int64), 0
        while len(left) and len(self.levels) < MAX_LEVELS:
            cells = max(64, len(left) * SLOTS_PER_KEY)
            at = self._cell(high[left], len(self.levels), cells)
            alone = np.bincount(at, minlength=cells) == 1
            packed = np.packbits(alone, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8, np.uint8)]).view(U64)
            ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]) + placed
            self.levels.append((cells, packed, ranks))
            fits = alone[at]
            place[left[fits]] = self._rank(packed, ranks, at[fits])
            placed += int(fits.sum())
            left = left[~fits]
        self.rest = {(int(high[i]), int(low[i])): placed + n for n, i in enumerate(left)}  # keys alike in their high halves
        place[left] = placed + np.arange(len(left))
        order = np.argsort(place)
        self.low, self.counts, self.keepers = low[order], counts[order].astype(np.uint32), keepers[order]

    def dump(self) -> bytes:
        return pickle.dumps(self.__dict__)

    @classmethod
    def load(cls, blob: bytes) -> "Shard":
        out = cls.__new__(cls)
        out.__dict__ = pickle.loads(blob)
        return out

    @staticmethod
    def _cell(high: np.ndarray, level: int, cells: int) -> np.ndarray:
        return (mix(high + U64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % U64(cells)).astype(np.int64)

    @staticmethod
    def _rank(packed: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(U64)
        return ranks[word] + np.bitwise_count(packed[word] & ((U64(1) << bit) - U64(1))).astype(np.int64)

    def find(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Place of each key in the arrays, -1 if it isn't there."""
        out, live = np.full(len(high), -1, np.int64), np.arange(len(high))
        for level, (cells, packed, ranks) in enumerate(self.levels):
            if not len(live):
                break
            at = self._cell(high[live], level, cells)
            hit = (packed[at >> 6] >> (at & 63).astype(U64)) & U64(1) == U64(1)
            out[live[hit]] = self._rank(packed, ranks, at[hit])
            live = live[~hit]
        if self.rest:
            for i in live:
                out[i] = self.rest.get((int(high[i]), int(low[i])), -1)
        found = out >= 0
        out[found] = np.where(self.low[out[found]] == low[found], out[found], -1)
        return out


class Shards:
    """Shards by number; keys go to shards by their high halves."""

    def __init__(self, blobs: dict[int, bytes], n: int):
        self.shards, self.n = {k: Shard.load(v) for k, v in blobs.items()}, n

    def keepers(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is repeated, and its keeper."""
        there, keeper = np.zeros(len(high), bool), np.zeros(len(high), np.int64)
        shard = shard_of(high, self.n)
        for k, s in self.shards.items():
            own = np.flatnonzero(shard == k)
            if len(own):
                at = s.find(high[own], low[own])
                hit = at >= 0
                there[own[hit]] = True
                keeper[own[hit]] = s.keepers[at[hit]]
        return there, keeper


def shard_of(high: np.ndarray, n: int) -> np.ndarray:
    return ((high >> U64(33)) % U64(n)).astype(np.int64)


def _keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct line keys of each document."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            keys: list[int] = []
            rows: list[int] = []
            for row, text in enumerate(part.column(1).to_pylist()):
                own = {h for line in (text or "").split("\n") if (h := key_hash(line)) is not None}
                keys += own
                rows += [row] * len(own)
            high, low = to_arrays(keys)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(as_i64(high)), pa.array(as_i64(low))], ["doc_id", "high", "low"])


def repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(high, low, n, keeper) of the keys that at least min_docs documents hold."""
    return (
        docs.select(F.col("doc_id").cast("long"), "text")
        .mapInArrow(_keys_of, "doc_id long, high long, low long")
        .groupBy("high", "low")
        .agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
        .filter((F.col("n") >= min_docs) & F.col("keeper").isNotNull())
    )


def build_shards(lines: DataFrame, n_shards: int) -> DataFrame:
    """(shard, blob): the pickled minimal perfect hash of each shard."""
    def build(group: pa.Table) -> pa.Table:
        col = lambda name: group.column(name).to_numpy()
        high = as_i64(col("high")).view(U64)
        blob = Shard(high, as_i64(col("low")).view(U64), col("n"), col("keeper")).dump()
        return pa.table({"shard": pa.array(shard_of(high[:1], n_shards)), "blob": binary([blob])})

    shard = F.shiftrightunsigned("high", 33) % n_shards
    return lines.groupBy(shard.alias("shard")).applyInArrow(build, "shard long, blob binary")


def _drop_by(columns: list[str], types: str, doomed: Callable) -> tuple[Callable, str]:
    """A mapInArrow function that applies doomed(doc ids, rows, high, low, batch) -> bool to the lines with a key."""
    schema = f"{types}, n_lines long, n_dropped long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                lines_of, keys, where = [], [], []
                for row, text in enumerate(part.column("text").to_pylist()):
                    lines = (text or "").split("\n")
                    lines_of.append(lines)
                    for i, line in enumerate(lines):
                        h = key_hash(line)
                        if h is not None:
                            keys.append(h)
                            where.append((row, i))
                gone: list[set[int]] = [set() for _ in lines_of]
                if keys:
                    high, low = to_arrays(keys)
                    rows = np.array([r for r, _ in where])
                    for j in np.flatnonzero(doomed(part, rows, high, low)):
                        gone[where[j][0]].add(where[j][1])
                texts = ["\n".join(x for i, x in enumerate(lines) if i not in g) if g else "\n".join(lines) for lines, g in zip(lines_of, gone, strict=True)]
                cols = [pa.array(texts, pa.string()) if c == "text" else part.column(c) for c in columns]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([len(x) for x in lines_of], pa.int64()), pa.array([len(g) for g in gone], pa.int64())], [*columns, "n_lines", "n_dropped"])

    return run, schema


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, ship_bytes: int = SHIP_BYTES) -> DataFrame:
    """The documents with their repeated lines taken out of text, and n_lines, n_dropped (columns of these names are replaced)."""
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped").withColumn("doc_id", F.col("doc_id").cast("long"))
    lines = materialize(repeated_lines(docs, min_docs))
    n_lines = lines.count()
    n_shards = max(1, -(-n_lines // SHARD_KEYS))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def ids(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        col = part.column("doc_id")
        return col.fill_null(0).to_numpy(zero_copy_only=False), col.is_null().to_numpy(zero_copy_only=False)

    if n_lines * ENTRY_BYTES <= ship_bytes:
        blobs = spark.sparkContext.broadcast({r.shard: bytes(r.blob) for r in build_shards(lines, n_shards).collect()})
        opened: list[Shards] = []  # filled by each task

        def doomed(part: pa.RecordBatch, rows: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
            if not opened:
                opened.append(Shards(blobs.value, n_shards))
            there, keeper = opened[0].keepers(high, low)
            doc, null = ids(part)
            return there & ((keeper != doc[rows]) | null[rows])

        return docs.mapInArrow(*_drop_by(docs.columns, types, doomed))

    of, keys = (f"{name}_{uuid.uuid4().hex}" for name in ("of", "keys"))  # no column of the documents has these names
    gone = materialize(routed(docs, lines, n_shards)).groupBy(F.col("doc_id").alias(of)).agg(F.collect_set(F.struct("high", "low")).alias(keys))
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(gone[of]), "left").drop(of)

    def listed(part: pa.RecordBatch, rows: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        sets = [frozenset((k["high"], k["low"]) for k in x or ()) for x in part.column(keys).to_pylist()]
        return np.array([(h, w) in sets[r] for h, w, r in zip(as_i64(high).tolist(), as_i64(low).tolist(), rows.tolist(), strict=True)], bool)

    return joined.mapInArrow(*_drop_by(docs.columns, types, listed))


def routed(docs: DataFrame, lines: DataFrame, n_shards: int) -> DataFrame:
    """(doc_id, high, low) of what is dropped, where the shards are too large to ship: each document's keys pass their shard,
    which is dealt to several tasks if there are more tasks than shards."""
    spark = docs.sparkSession
    n = partitions(spark)
    salts = max(1, n // n_shards)
    total = lines.agg(F.sum("n")).first()[0]
    hot_at = max(1, total // HOT_KEYS)
    hot = lines.filter(F.col("n") > hot_at)
    hot_blobs = spark.sparkContext.broadcast({r.shard: bytes(r.blob) for r in build_shards(hot, 1).collect()})

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(hot_blobs.value, 1)
        for batch in _keys_of(batches):
            high, low = (as_i64(batch.column(c).to_numpy()).view(U64) for c in ("high", "low"))
            there, keeper = shards.keepers(high, low)
            doc = batch.column("doc_id")
            own = (doc.fill_null(0).to_numpy() == keeper) & ~doc.is_null().to_numpy(zero_copy_only=False)
            state = np.where(there, np.where(own, 2, 1), 0)  # 0: ask the shard, 1: goes, 2: stays
            keep = pa.array(state < 2)
            n = len(high)
            out = pa.RecordBatch.from_arrays([pa.array(shard_of(high, n_shards)), pa.array(state.astype(np.int32)), doc, batch.column("high"), batch.column("low"), pa.nulls(n, pa.binary())], ["shard", "state", "doc_id", "high", "low", "blob"])
            yield out.filter(keep)

    schema = "shard long, state int, doc_id long, high long, low long, blob binary"
    asked = materialize(docs.select("doc_id", "text").mapInArrow(probes, schema))
    null = lambda t: F.lit(None).cast(t)
    blobs = build_shards(lines, n_shards).select("shard", F.lit(-1).alias("state"), null("long").alias("doc_id"), null("long").alias("high"), null("long").alias("low"), "blob")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            state = batch.column("state").to_numpy()
            cuts = [0, *(np.flatnonzero(state < 0)).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(a, b - a)
                if part.num_rows and state[a] < 0:
                    shard = Shard.load(part.column("blob")[0].as_py())
                    part = part.slice(1)
                if part.num_rows:
                    high, low = (as_i64(part.column(c).to_numpy()).view(U64) for c in ("high", "low"))
                    at = shard.find(high, low) if shard else np.full(len(high), -1)
                    doc = part.column("doc_id")
                    keeper = shard.keepers[np.maximum(at, 0)] if shard else at
                    gone = (at >= 0) & ((keeper != doc.fill_null(0).to_numpy()) | doc.is_null().to_numpy(zero_copy_only=False))
                    yield pa.RecordBatch.from_arrays([doc, part.column("high"), part.column("low")], ["doc_id", "high", "low"]).filter(pa.array(gone))

    passed = (
        asked.filter("state = 0").withColumn("salt", F.pmod("low", F.lit(salts)))
        .unionByName(blobs.withColumn("salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(salts)]))))
        .repartition(n, "shard", "salt").sortWithinPartitions("shard", "salt", "state").drop("salt")
        .mapInArrow(answer, "doc_id long, high long, low long")
    )
    return passed.unionByName(asked.filter("state = 1").select("doc_id", "high", "low"))
