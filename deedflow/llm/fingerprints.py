"""Document fingerprints by Order MinHash.

For each of ``HASHES`` hash functions, the ``TAKEN`` minimal k-mers of a text are selected, where a k-mer that occurs again
counts as another one (occurrence-numbered), put back in text order, and their tuple is hashed: as order matters, the share
of equal tuples falls with the edit distance.

``with_next`` walks the documents by descending doc_id.  Ranges of doc_id (cut at approximate quantiles, the only thing the
driver holds besides each range's largest id) are sorted apart, and the first document of each range is also sent to the
range before it, so texts are shuffled once and no task sees all of them.

Defined cases: null text is empty; a text shorter than a k-mer is one k-mer; empty texts are alike (likeness 1); rows that
repeat a doc_id stand next to each other, by text; null ids come last; a table of one row is next to itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MULT_A, MULT_B, U64, mix, partitions, span_hashes

KMER = 6
TAKEN = 2
HASHES = 32
BLOCK = 2048
#: Expected number of candidates below the threshold that spares sorting whole rows of hashes.
CANDIDATES = 24
POSITION_BITS = 24
RANGES_PER_PARTITION = 4
LOWEST = -(1 << 63)

MULTIPLIERS = mix(np.arange(1, HASHES // 2 + 1, dtype=U64) * MULT_A) | U64(1)
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def numbered_kmers(codes: np.ndarray) -> np.ndarray:
    """A hash of each k-mer with the number of times that it occurred before."""
    n = max(1, len(codes) - KMER + 1)
    h = span_hashes(codes.astype(U64) + U64(1), min(KMER, len(codes)))
    if n < 1 << POSITION_BITS:
        key = np.sort(h >> U64(POSITION_BITS) << U64(POSITION_BITS) | np.arange(n, dtype=U64))
        at = (key & U64((1 << POSITION_BITS) - 1)).astype(np.int64)
        key >>= U64(POSITION_BITS)
    else:
        at = np.argsort(h, kind="stable")
        key = h[at]
    fresh = np.ones(n, bool)
    fresh[1:] = key[1:] != key[:-1]
    if fresh.all():
        return h
    first = np.flatnonzero(fresh)
    again = np.empty(n, U64)
    again[at] = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    return mix(h + again * MULT_A)


def fingerprint(text: str) -> np.ndarray:
    """HASHES unsigned 32-bit values."""
    if not text:
        return np.zeros(HASHES, np.uint32)
    kmers = numbered_kmers(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
    n = len(kmers)
    taken = min(TAKEN, n)
    if n > 4 * CANDIDATES:
        flat = below(kmers, np.uint32(2**32 * CANDIDATES // n))
        row, col = flat // n, flat % n
        few = np.flatnonzero(np.bincount(row, minlength=HASHES) < taken)
        if len(few):  # rare: their whole rows
            some = ~np.isin(row, few)
            row, col = np.concatenate([row[some], np.repeat(few, n)]), np.concatenate([col[some], np.tile(np.arange(n), len(few))])
    else:
        row, col = np.repeat(np.arange(HASHES), n), np.tile(np.arange(n), HASHES)
    order = np.argsort(row.astype(U64) << U64(32) | hash_values(row, kmers[col]), kind="stable")
    start = np.searchsorted(row[order], np.arange(HASHES))
    chosen = np.sort(col[order][start[:, None] + np.arange(taken)], axis=1)  # in text order
    out = np.full(HASHES, taken, U64)
    for i in range(taken):
        out = mix(out * MULT_B + kmers[chosen[:, i]])
    return (out >> U64(32)).astype(np.uint32)


def below(kmers: np.ndarray, least: np.uint32) -> np.ndarray:
    """Places hash * len(kmers) + k-mer of the hash values below a threshold, by blocks that fit a core's cache."""
    n, found = len(kmers), []
    for at in range(0, n, BLOCK):
        block = kmers[at : at + BLOCK]
        place = np.flatnonzero((MULTIPLIERS[:, None] * block).view(np.uint32) < least)
        row, half = place // (2 * len(block)), place % (2 * len(block))
        found.append((2 * row + half % 2) * n + half // 2 + at)
    return found[0] if len(found) == 1 else np.concatenate(found)


def hash_values(row: np.ndarray, kmers: np.ndarray) -> np.ndarray:
    """Each product gives two hash functions: its low and its high half."""
    product = kmers * MULTIPLIERS[row >> 1]
    return np.where(row & 1 == 1, product >> U64(32), product & U64(0xFFFFFFFF))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def as_text(f: np.ndarray) -> str:
    return f.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([as_text(fingerprint(t)) for t in texts], pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """(range, borrowed, key, doc_id, text): by range and descending key, each range followed by the document after it."""
    spark = docs.sparkSession
    n = partitions(spark)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("key"), F.col("doc_id").cast("long"), "text")
    ranges = n * RANGES_PER_PARTITION
    cuts_at = [i / ranges for i in range(1, ranges)]
    found = docs.agg(F.percentile_approx("key", cuts_at, max(10_000, 20 * ranges)).alias("cuts")).first()["cuts"]
    cuts = np.unique(np.array(found or [], np.int64))

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(cuts, key)), pa.array(key)], ["range", "key"])

    heads = docs.select("key").mapInArrow(largest, "range long, key long").groupBy("range").agg(F.max("key").alias("key")).orderBy(F.desc("range")).collect()
    lender = {r["range"]: r["key"] for r in heads}
    borrower = {r["range"]: heads[i - 1]["range"] for i, r in enumerate(heads)}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["range", "borrowed", "key", "doc_id", "text"]
        for batch in batches:
            key = batch.column(0).to_numpy()
            own = np.searchsorted(cuts, key)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.zeros(len(key), bool)), *batch.columns], names)
            lent = np.array([k == lender[r] for k, r in zip(key.tolist(), own.tolist(), strict=True)], bool)
            if lent.any():
                some = batch.filter(pa.array(lent))
                yield pa.RecordBatch.from_arrays([pa.array([borrower[r] for r in own[lent].tolist()], pa.int64()), pa.array(np.ones(len(some), bool)), *some.columns], names)

    return (
        docs.mapInArrow(route, "range long, borrowed boolean, key long, doc_id long, text string")
        .repartition(n, "range")
        .sortWithinPartitions("range", "borrowed", F.desc("key"), "text")
    )


def compare_edited(docs: DataFrame) -> DataFrame:
    """One row per document: fingerprints of its text and of its edited text, and their likeness to each other and to the next one's."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = []
                for where, borrowed, doc_id, text in zip(*(part.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                    if borrowed and waiting is None:
                        continue  # another row of the lent id
                    text = text or ""
                    own = fingerprint(text)
                    if waiting is not None:
                        before, before_text, before_own = waiting
                        changed = edited(before_text, text)
                        new = fingerprint(changed)
                        out.append((before, len(before_text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), as_text(before_own), as_text(new), likeness(before_own, new), likeness(before_own, own)))
                    waiting = None if borrowed else (doc_id, text, own)
                cols = list(zip(*out, strict=True)) or [[]] * 7
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], SCHEMA.replace(",", "").split(" ")[::2])

    return with_next(docs).mapInArrow(run, SCHEMA)
