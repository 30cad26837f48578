"""Secret scans: fixed base patterns plus sliding-window Shannon entropy over candidate strings.

Entropy is kept over a window of ``WINDOW`` characters by incremental counts (one character enters, one leaves), with a
threshold for each character class of the candidate.  Allow-listed candidates (uuids, placeholders, counting runs) and
candidates that overlap a base span add nothing; base spans always stay.

Defined cases: null text counts as empty and yields a row with no spans; rows repeat as they come; offsets are code
points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns and the least length of what counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_HINTS = ("passw", "secret", "token", "api")
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 20
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy")

# Parameters of the entropy method.
WINDOW = 20
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
#: Bits a character that a window must reach, by class; digits alone are never secrets.
THRESHOLDS = {"hex": 3.0, "letters": 4.1, "mixed": 3.8}
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    re.compile(r"example|placeholder|changeme|your[_-]|dummy|redacted", re.IGNORECASE),
    re.compile(r"abcdefghij|0123456789|1234567890", re.IGNORECASE),
)
N_LOG_N = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string"


def char_class(candidate: str) -> str | None:
    if candidate.isdigit():
        return None
    if re.fullmatch("[0-9a-fA-F]+", candidate):
        return "hex"
    if re.fullmatch("[A-Za-z]+", candidate):
        return "letters"
    return "mixed" if re.search("[0-9]", candidate) and re.search("[A-Za-z]", candidate) else None


def entropy_span(candidate: str) -> tuple[int, int] | None:
    """First and last offset covered by windows whose entropy reaches the class's threshold."""
    kind = char_class(candidate)
    if kind is None or len(candidate) < WINDOW or any(p.search(candidate) for p in ALLOWED):
        return None
    counts: dict[str, int] = {}
    total, first, last = 0.0, None, 0
    least = math.log2(WINDOW) - THRESHOLDS[kind]
    for i, c in enumerate(candidate):
        if i >= WINDOW:
            old = candidate[i - WINDOW]
            n = counts[old]
            total -= N_LOG_N[n] - N_LOG_N[n - 1]
            counts[old] = n - 1
        n = counts.get(c, 0)
        total += N_LOG_N[n + 1] - N_LOG_N[n]
        counts[c] = n + 1
        if i >= WINDOW - 1 and total / WINDOW <= least + 1e-9:
            first = i - WINDOW + 1 if first is None else first
            last = i + 1
    return None if first is None else (first, last)


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and added spans as (start, place of the kind in KINDS, end), sorted."""
    base: list[tuple[int, int, int]] = []
    lower = text.lower()
    if any(h in lower for h in ASSIGN_HINTS):
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    added = []
    for m in CANDIDATE.finditer(text):
        found = entropy_span(m[0])
        if found:
            start, end = m.start() + found[0], m.start() + found[1]
            if not any(s < end and start < e for s, _, e in base):
                added.append((start, 3, end))
    return base, added


def join_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            rows = []
            for text in part.column(1).to_pylist():
                base, added = scan(text or "")
                n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                rows.append((*n, len(added), hashlib.sha256(join_spans(base).encode()).hexdigest(), join_spans(sorted(base + added))))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"],
            )


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: counts by kind, the digest of its base spans, and all spans."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan_batches, SCHEMA)
