"""Scratch storage and vectorised word hashing shared by the operators.

Text columns reach Python as Arrow batches.  ``words`` finds and hashes every word of a batch with
numpy, over chunks of a few MB, so no Python object is made per word.
"""

from __future__ import annotations

import atexit
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

CHUNK_BYTES = 2 << 20
#: Rows of an Arrow batch, unless the session has a number of its own: texts are long.
BATCH_ROWS = 1000
LONG_WORD = 256
#: Whether Spark deletes a query's shuffle files at its end; else they stay until the driver collects its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
U64 = np.uint64
MULT_A, MULT_B = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)


def small_batches(spark: SparkSession) -> None:
    """Python gets long texts by small batches: a batch lies in the memory of the executor and of its Python worker."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # Spark's own
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder name under the shared ``spark.checkpoint.dir``, gone when the driver ends.  A temporary folder is set only if
    that is unset and all runs on one machine."""
    small_batches(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='deedflow-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/deedflow-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    except Exception:  # the session has ended before
        return


def materialize(df: DataFrame, freed: bool = False) -> DataFrame:
    """Write to the shared folder and read again: lineage is cut and lost executors cost no recomputation.  freed: what was
    shuffled for it goes at once."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    before = spark.conf.get(FREED, None)
    if freed:
        spark.conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        if freed:
            spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)
    return spark.read.schema(df.schema).parquet(path)


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker: functions arrive by value, so module globals do not."""
    return sys.modules.setdefault("deedflow_worker", types.ModuleType("deedflow_worker")).__dict__


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    x = x ^ (x >> U64(32))
    x = x * MULT_B
    x ^= x >> U64(29)
    x *= MULT_A
    x ^= x >> U64(32)
    return x


def text_chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of a string column by chunks of about CHUNK_BYTES; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    _, offset_buf, data_buf = column.buffers()
    offsets = np.frombuffer(offset_buf, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buf, np.uint8) if data_buf is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (bytes), 64-bit hashes of all ``[^\\x20\\x09-\\x0D]+`` words, and each row's first word (rows + 1)."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    if lower:
        data = FOLD[data]
    body = ~BLANK[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = body.copy()
    starts[1:] &= ~body[:-1] | edge[1:n]
    ends = body.copy()
    ends[:-1] &= ~body[1:] | edge[1:n]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, hash_spans(data, starts, ends), np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded.view(), shape=(len(data) + 1, 8), strides=(1, 1))
    length = ends - starts
    out = length.astype(U64) * MULT_A
    live, at = np.arange(len(starts)), starts
    long = np.flatnonzero(length > LONG_WORD)
    if len(long):
        live = np.flatnonzero(length <= LONG_WORD)
        at = starts[live]
        raw = data.tobytes()
        out[long] = [xxhash.xxh3_64_intdigest(raw[s:e]) for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    left = length[live]
    while len(live):
        piece = np.ascontiguousarray(eight[at]).view(U64).ravel()
        short = left < 8
        piece = np.where(short, piece & ((U64(1) << (np.minimum(left, 7).astype(U64) << U64(3))) - U64(1)), piece)
        h = (out[live] ^ piece) * MULT_B
        out[live] = h ^ (h >> U64(31))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return mix(out)


def span_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """A polynomial hash of the k values that start at each place (len - k + 1 places), from spans of 1, 2, 4 ... values."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    span, width, step, out, done, left = values.astype(U64), 1, MULT_A, None, 0, k
    while left:
        if left & 1:
            out = span[:n] if out is None else out[:n] * step + span[done : done + n]
            done += width
        left >>= 1
        if left:
            span = span[:-width] * step + span[width:]
            width *= 2
            step = U64(int(step) ** 2 & (1 << 64) - 1)
    return mix(out)


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words that start at each word; the last k-1 entries of the array are left out."""
    return span_hashes(hashes, k)


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row of each word, from each row's first word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def as_i64(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
