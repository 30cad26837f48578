"""Jaccard join, packing, line dedup, archives, substring dedup and the pipeline against brute force."""

import collections
import hashlib
import io
import itertools
import re
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from deedflow.llm import components, fmindex, jaccard, linededup, packing, queries, substrings, warc

from .conftest import words

WORD = r"[^\x20\x09-\x0D]+"


def folded(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(WORD, folded(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard(make, rnd, k, percent):
    rows = []
    for _ in range(10):
        base = words(rnd, rnd.choice([4, 30, 120])).split()
        for _ in range(rnd.choice([2, 25])):
            own = base[:]
            for _ in range(rnd.randrange(4)):
                own[rnd.randrange(len(own))] = f"w{rnd.randrange(300)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(900, None), (901, ""), (902, "One"), (903, "one"), (904, " \n"), (905, rows[0][1].upper())]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(make(rows), k, percent).collect()}
    assert got == brute_components(rows, k, percent)
    if k == 5:
        kept = jaccard.keep_one_of_each(make(rows), k, percent)
        assert {r.doc_id for r in kept.collect()} == {c for _, c in got.values()} and set(kept.columns) == set(make(rows).columns)
        assert jaccard.jaccard_components(make(rows).filter("false")).count() == 0


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 100), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 100: 90}


def test_packing(make, rnd):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    rows = [(i, words(rnd, rnd.choice([1, 5, 100, 300, 900]))) for i in range(80)] + [(100, None), (101, ""), (102, "日本  é\x1c x <|endoftext|> it's 12 \n\n a"), (103, "x"), (103, "x")]
    got = packing.pack_documents(make(rows), path).collect()
    tokenizer, expected, total = Tokenizer.from_file(path), collections.Counter(), 0
    for i, t in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        total += len(ids)
        for no, (start, length) in enumerate(packing.cut(len(ids), 1024)):
            expected[i, no, start, length, zlib.crc32(ids[start : start + length].tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    ends = collections.defaultdict(int)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 1024 and len(ends) <= -(-total // 1024) * 1.1 + 1
    assert packing.pack_documents(make(rows).filter("false"), path).count() == 0


def test_packing_plan(rnd):
    for capacity in (8, 64):
        for _ in range(20):
            counts = np.array([0] + [rnd.choice([0, 0, 1, 5, 400]) for _ in range(capacity)])
            used = np.zeros(capacity + 1, int)
            for lengths, times in packing.plan(counts, capacity):
                assert sum(lengths) <= capacity
                for n in lengths:
                    used[n] += times
            assert (used == counts).all()
    assert sum(t for _, t in packing.plan(np.bincount([512] * 10 + [300, 700, 24] * 6, minlength=1025), 1024)) == 11  # pair and triple sums fill all
    assert packing.cut(2049, 1024) == [(0, 1), (1, 1024), (1025, 1024)] and packing.cut(1024, 1024) == [(0, 1024)]


def brute_lines(rows):
    key = lambda line: folded(line.strip(" \t\n\v\f\r"))
    own = [(i, (t or "").split("\n")) for i, t in rows]
    holders = collections.defaultdict(list)
    for i, lines in own:
        for k in {key(x) for x in lines}:
            holders[k].append(i)
    gone = lambda i, x: len(key(x)) >= 40 and len(holders[key(x)]) >= 5 and i != max(holders[key(x)])
    return {i: (len(lines), sum(gone(i, x) for x in lines), "\n".join(x for x in lines if not gone(i, x))) for i, lines in own}


def test_line_dedup(make, rnd, monkeypatch):
    pool = [words(rnd, 12) for _ in range(15)] + ["short", "Ünïcode " * 6, "x" * 39, "y" * 40]
    rows = [(i, "\n".join(rnd.choice([" ", "\t", ""]) + rnd.choice([str, str.upper])(rnd.choice(pool)) for _ in range(rnd.randrange(1, 9)))) for i in range(60)] + [(90, None), (91, "")]
    want = brute_lines(rows)
    got = lambda **k: {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in linededup.dedup_lines(make(rows), **k).collect()}
    assert got() == want
    monkeypatch.setattr(linededup, "SHARD_KEYS", 3)
    monkeypatch.setattr(linededup, "HOT_KEYS", 20)
    assert got(ship_bytes=0) == want
    assert set(linededup.dedup_lines(make(rows)).columns) == {*make(rows).columns, "n_lines", "n_dropped"}
    assert linededup.dedup_lines(make(rows).filter("false")).count() == 0


def test_minimal_perfect_hash():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 63, 20_000).astype(np.uint64))
    low = rng.integers(0, 1 << 63, len(keys)).astype(np.uint64)
    shard = linededup.Shard.load(linededup.Shard(keys, low, np.arange(len(keys)), np.arange(len(keys))).dump())
    at = shard.find(keys, low)
    assert sorted(at.tolist()) == list(range(len(keys))) and (shard.keepers[at] == np.arange(len(keys))).all()
    assert (shard.find(keys, low + np.uint64(1)) == -1).all()
    same = linededup.Shard(np.array([7, 7], np.uint64), np.array([1, 2], np.uint64), np.array([5, 6]), np.array([8, 9]))
    assert sorted(same.keepers[same.find(np.array([7, 7], np.uint64), np.array([1, 2], np.uint64))].tolist()) == [8, 9]


def test_archives(spark):
    rows = [(1, "http://a", "same"), (2, None, "same"), (3, "u\r\nx", None), (4, "u", ""), (5, "u", "é\r\n\r\nb"), (None, "u", "lone"), (6, "u", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x")).repartition(2)
    got = {r.page_id: r for r in warc.archive_round_trip(pages).collect()}
    assert len(got) == len(rows)
    keepers = {}
    for i, _, h in rows:
        keepers[h or ""] = max(keepers.get(h or "", -1), i if i is not None else -1)
    for i, _, h in rows:
        r, keeper = got[i], keepers[h or ""]
        assert (r.payload_bytes, r.payload_digest) == (len((h or "").encode()), warc.digest_of((h or "").encode()))
        assert (r.record_type, r.refers_to) == (("response", None) if i in (keeper, None) else ("revisit", keeper))
        assert r.html == ((h or "") if r.record_type == "response" else None)
    assert got[3].url == "u" or got[2].url == "urn:page:2"
    assert warc.archive_round_trip(pages.filter("false")).count() == 0


def test_zip_directories():
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_STORED) as z:
        for i in range(3):
            z.writestr(f"m{i}", f"data {i}" * 5)
        z.comment = b"PK\x05\x06 comment"
    for prefix in (b"", b"junk before"):
        raw = prefix + data.getvalue()
        d = warc.ZipDirectory(io.BytesIO(raw), len(raw))
        assert {n: d.range(*d.locate(n)) for n in d.members} == {f"m{i}": (f"data {i}" * 5).encode() for i in range(3)}
    # the same members behind a ZIP64 directory
    body, name = b"payload", b"x"
    local = struct.pack("<4s5H3I2H", b"PK\x03\x04", 45, 0, 0, 0, 0, zlib.crc32(body), len(body), len(body), len(name), 0) + name + body
    extra = struct.pack("<2H3Q", 1, 24, len(body), len(body), 0)
    central = struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, zlib.crc32(body), 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    end64 = struct.pack("<4sQ2H2I4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), len(local))
    raw = local + central + end64 + struct.pack("<4sIQI", b"PK\x06\x07", 0, len(local) + len(central), 1) + struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    d = warc.ZipDirectory(io.BytesIO(raw), len(raw))
    assert d.range(*d.locate("x")) == body
    with pytest.raises(ValueError):
        warc.ZipDirectory(io.BytesIO(b"no archive"), 10)
    with pytest.raises(ValueError):
        warc.read_record(warc.make_record(1, "u", b"abc", None).replace(b"abc", b"abd"))


def brute_substrings(rows, window=50):
    w = {i: re.findall(WORD, t or "") for i, t in rows}
    first = {}
    for i, own in w.items():
        for s in range(len(own) - window + 1):
            k = tuple(own[s : s + window])
            first[k] = min(first.get(k, i), i)
    out = {}
    for i, own in w.items():
        gone = [False] * len(own)
        for s in range(len(own) - window + 1):
            if first[tuple(own[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        out[i] = (len(own), sum(gone), " ".join(x for x, g in zip(own, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("sizes", [{}, {"ship_bytes": 1000, "shard_words": 300}])
def test_substring_dedup(make, rnd, sizes):
    passages = [words(rnd, rnd.randrange(45, 130), 40).split() for _ in range(8)]
    rows = []
    for i in range(60):
        own = []
        for _ in range(rnd.randrange(1, 4)):
            p = rnd.choice(passages)
            own += p[rnd.randrange(15) : len(p) - rnd.randrange(15)] + words(rnd, rnd.randrange(8), 40).split()
        rows.append((i, rnd.choice([" ", "\n", " \t "]).join(own)))
    rows += [(500, None), (501, ""), (502, "a " * 300), (503, "a " * 200), (504, "a b " * 120)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substrings.remove_repeats(make(rows), **sizes).collect()}
    assert got == brute_substrings(rows)
    if not sizes:
        assert substrings.remove_repeats(make(rows).filter("false")).count() == 0
        twice = {(r.doc_id, r.n_removed) for r in substrings.remove_repeats(make([(1, rows[502 - 500][1]), (None, passages[0] and " ".join(passages[0])), (9, " ".join(passages[0]))])).collect()}
        assert (None, 0) in twice


def test_fm_index(rnd):
    text = [np.array([rnd.randrange(9) for _ in range(rnd.randrange(60, 90))], np.uint64) * np.uint64(1 << 40) for _ in range(6)]
    index = fmindex.FMIndex.load(fmindex.FMIndex(text, [3, 1, 4, 1, 5, 9]).dump())
    flat = np.concatenate(text + [np.array([77], np.uint64)])
    held = [x for p in text for x in [*p.tolist(), None]]
    for length in (1, 2, 4):
        starts = np.arange(len(flat) - length + 1)
        live, low, high = index.search(flat, starts, length)
        counts = dict(zip(live.tolist(), (high - low).tolist(), strict=True))
        for s in starts.tolist():
            pattern = flat[s : s + length].tolist()
            want = sum(p[j : j + length].tolist() == pattern for p in text for j in range(len(p) - length + 1))
            assert counts.get(s, 0) == want
        for s, a, b in zip(live[:40].tolist(), low[:40].tolist(), high[:40].tolist(), strict=True):
            for place in index.locate(np.arange(a, b)).tolist():
                assert held[place : place + length] == flat[s : s + length].tolist()
    assert index.doc_at(np.array([0, len(text[0]) + 1])).tolist() == [3, 1]


def test_matching_statistics(rnd):
    text = [np.array([rnd.randrange(5) for _ in range(rnd.randrange(20, 60))], np.uint64) for _ in range(8)]
    index = fmindex.FMIndex.load(fmindex.FMIndex(text, list(range(8))).dump())
    pieces = [p[rnd.randrange(10) : len(p) - rnd.randrange(10)] for p in rnd.choices(text, k=30)]
    query = np.concatenate([np.concatenate([p, np.array([rnd.randrange(7) for _ in range(rnd.randrange(4))], np.uint64)]) for p in pieces])
    for window, probe, width in ((6, 2, 40), (10, 3, 7), (12, 8, 1000), (3, 3, 1)):
        held = {tuple(p[j : j + window].tolist()) for p in text for j in range(len(p) - window + 1)}
        begin = np.arange(0, len(query) - window + 1, width)
        last = np.minimum(begin + width - 1, len(query) - window)
        run, start, end, suffix = index.matches(query, begin, last, window, probe)
        flat = [x for p in text for x in [*p.tolist(), None]]
        got = set()
        for r, s, e, place in zip(run.tolist(), start.tolist(), end.tolist(), index.locate(suffix).tolist(), strict=True):
            assert begin[r] <= s and e <= last[r] + window and flat[place : place + e - s] == query[s:e].tolist()
            got |= set(range(s, e - window + 1))
        assert got == {s for s in range(len(query) - window + 1) if tuple(query[s : s + window].tolist()) in held}


def test_pipeline_stages(spark, sf, make):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    more = spark.createDataFrame([(90_001, "12345 !!", "en", "s", 8), (90_002, "lead in words " + bench, "en", "s", 50)], docs.schema)
    docs = docs.unionByName(more)
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.materialize(stage(spark, kept, sf))
        assert set(kept.columns) == set(columns)
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert not ids & {90_001, 90_002} and len(ids) > 0.7 * docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids
    lines = brute_lines([(r.doc_id, r.text) for r in docs.filter("doc_id < 90000").collect()])
    first, second = (dict(corpus_pipeline.STAGES)[n] for n in ("language_id", "line_dedup"))
    deduped = second(spark, first(spark, docs.filter("doc_id < 90000"), sf), sf).collect()
    assert {r.doc_id: r.text for r in deduped} == {i: x[2] for i, x in lines.items() if i in {r.doc_id for r in deduped}}
    assert len(deduped) == len(lines)
