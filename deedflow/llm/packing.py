"""Best-fit packing of token sequences, with exact complements first.

Documents are tokenized where they are; pieces longer than the capacity are cut.  Only the histogram of piece lengths
reaches the driver (at most capacity x BUCKETS counts, whatever the input).  There a plan is made over counts: for each
length, longest first, single, pair and triple sums of available lengths that fill the rest exactly are looked up and
consumed in bulk; what is left is packed best-fit, longest first, in bulk as well.  A pattern taken in bulk uses up one of
its lengths, so the plan stays small.  Each piece finds its slot from its rank among the pieces of its length, which is
counted within hashed buckets, so a length that a third of all pieces share is ranked by many tasks.

Defined cases: null or empty text is the end token alone; an empty table gives no pieces; repeated documents are packed
each on their own.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, worker_cache

CAPACITY = 1024
END_ID = 2
BUCKETS = 256
#: Exact combinations are sought for pieces longer than so many eighths of the capacity.
EXACT_PARTS = (0, 2, 4, 6, 7)
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: The pre-tokenizer of byte-level BPE, and the characters for which both libraries agree on its classes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
UNSURE = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\u024f]|<\|")


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Ids of a tokenizers file.  Its vocabulary is in order of merging, so it serves as ranks for the faster library, which
    gives the same ids; texts with characters that the two might class differently go through tokenizers itself."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, of = Tokenizer.from_file(path), byte_characters()
        special = {i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        ranks = {bytes(of[c] for c in token): i for token, i in self.tokenizer.get_vocab().items() if i not in special}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if UNSURE.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.asarray(self.fast.encode_to_numpy(text), "<u4").tobytes()


def encoder(path: str) -> Encoder:
    kept = worker_cache().setdefault("encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def tokenized(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents; with_ids adds their ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows, out = [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    raw = enc.encode(text or "") + end
                    for no, (start, length) in enumerate(cut(len(raw) // 4, capacity)):
                        own = raw[4 * start : 4 * (start + length)]
                        rows.append(row)
                        out.append((no, start, length, zlib.crc32(own), own))
                cols = list(zip(*out, strict=True)) or [[]] * 5
                arrays = [part.column(0).take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:4])]
                if with_ids:
                    arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in cols[4]], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def exact_fill(gap: int, have: np.ndarray) -> tuple[int, ...] | None:
    """One, two or three available lengths that add up to the gap, the longest first; have[n]: how many of length n."""
    if have[gap]:
        return (gap,)

    def pair(total: int) -> tuple[int, int] | None:
        a = np.arange((total + 1) // 2, total)
        fits = np.flatnonzero((have[a] > 0) & (have[total - a] > np.where(a * 2 == total, 1, 0)))
        return (int(a[fits[-1]]), int(total - a[fits[-1]])) if len(fits) else None

    if two := pair(gap):
        return two
    for a in np.flatnonzero(have[: gap - 1])[::-1].tolist():
        if 3 * a < gap:
            break
        have[a] -= 1
        two = pair(gap - a)
        have[a] += 1
        if two and two[0] <= a:
            return (a, *two)
    return None


def plan(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences), all pieces used; counts[n]: pieces of length n.

    Exact combinations for short pieces use up what best-fit could put into many gaps, so how far down they are sought is tried
    at a few lengths; the plan with the fewest sequences is taken."""
    return min((plan_down_to(counts, capacity, capacity * part // 8 + 1) for part in EXACT_PARTS), key=lambda p: sum(times for _, times in p))


def plan_down_to(counts: np.ndarray, capacity: int, least: int) -> list[tuple[tuple[int, ...], int]]:
    """The plan whose exact combinations have a longest piece of at least this length."""
    left, out = counts.astype(np.int64).copy(), []
    for a in range(capacity, least - 1, -1):
        while left[a]:
            left[a] -= 1
            rest = exact_fill(capacity - a, left) if a < capacity else ()
            left[a] += 1
            if rest is None:
                break
            whole = (a, *rest)
            times = min(int(left[n]) // whole.count(n) for n in set(whole))
            for n in whole:
                left[n] -= times
            out.append((whole, times))
    open_at: dict[int, list[list]] = {}  # gap -> [lengths, sequences]
    for a in range(capacity, 0, -1):
        n = int(left[a])
        while n:
            gap = min((g for g in open_at if g >= a), default=None)
            lengths, times = open_at[gap].pop() if gap is not None else ((), n)
            if gap is not None and not open_at[gap]:
                del open_at[gap]
            room = gap if gap is not None else capacity
            each = min(room // a, n)
            used = min(times, n // each)
            open_at.setdefault(room - each * a, []).append([lengths + (a,) * each, used])
            if gap is not None and times > used:
                open_at.setdefault(gap, []).append([lengths, times - used])
            n -= used * each
    return out + [(lengths, times) for bins in open_at.values() for lengths, times in bins]


def slots(patterns: list[tuple[tuple[int, ...], int]], capacity: int) -> list[np.ndarray]:
    """For each length, rows (first rank, first sequence, offset) in order of rank."""
    rows: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]
    rank, sequence = [0] * (capacity + 1), 0
    for lengths, times in patterns:
        offset = 0
        for n in lengths:
            rows[n].append((rank[n], sequence, offset))
            rank[n] += times
            offset += n
        sequence += times
    return [np.array(r, np.int64).reshape(-1, 3) for r in rows]


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces (a written table) with sequence_id and offset."""
    pieces = pieces.drop("sequence_id", "offset").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(BUCKETS)).cast("int"))
    counts = np.zeros((capacity + 1, BUCKETS), np.int64)
    for r in pieces.groupBy("length", "bucket").count().collect():
        counts[r["length"], r["bucket"]] = r["count"]
    before = np.cumsum(counts, axis=1) - counts
    places = slots(plan(counts.sum(axis=1), capacity), capacity)
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = pieces.withColumn("sequence_id", F.row_number().over(order).cast("long"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.drop("bucket", "sequence_id").schema)
    kept = ranked.drop("bucket", "sequence_id").columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, bucket = batch.column("length").to_numpy(), batch.column("bucket").to_numpy()
            rank = batch.column("sequence_id").to_numpy() - 1 + before[length, bucket]
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                row = places[n][np.searchsorted(places[n][:, 0], rank[own], "right") - 1]
                sequence[own], offset[own] = row[:, 1] + rank[own] - row[:, 0], row[:, 2]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{types}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    return pack(materialize(tokenized(docs, tokenizer, capacity, with_ids)), capacity)
