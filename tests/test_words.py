"""Queries over positioned words: whole texts, against plain Python."""

import hashlib
from statistics import median

import pytest

from deedflow.plans.queries import QUERIES

LENGTHS = {5: 500, 6: 241, 7: 3, 8: 240}


@pytest.fixture(scope="module")
def words_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("words")
    texts = [(k, "  ".join(f"w{i}" + "x" * (i % 4) for i in range(n))) for k, n in LENGTHS.items()]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return str(d)


def placed():
    """(document_id, page) -> [(idx, text, x, y, width, height, conf)]"""
    out = {}
    for k, n in LENGTHS.items():
        for i in range(n):
            at, text = i % 240, f"w{i}" + "x" * (i % 4)
            out.setdefault((str(k), i // 240 + 1), []).append((i, text, at % 12 * 90.0, at // 12 * 40.0 + at * 7 % 11, 9.0 * len(text), 16.0 + k % 5, (i * 37 + k) % 101))
    return out


def half_up(x):
    return round(x + 1e-9, 2)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def box(words, order, sep):
    x, y = min(w[2] for w in words), min(w[3] for w in words)
    text = sep.join(w[1] for w in sorted(words, key=order))
    return sha(text), x, y, max(w[2] + w[4] for w in words) - x, max(w[3] + w[5] for w in words) - y, half_up(sum(w[6] for w in words) / len(words)), len(words)


def answers(spark, words_dir, name):
    return sorted(tuple(r) for r in QUERIES[name](spark, words_dir).collect())


def test_confidences_and_text_of_whole_texts(spark, words_dir):
    pages = placed()
    assert answers(spark, words_dir, "ocr_page_conf") == sorted((d, p, half_up(sum(w[6] for w in ws) / len(ws)), len(ws)) for (d, p), ws in pages.items())
    doc, text = [], []
    for k, n in LENGTHS.items():
        ws = [w for (d, _), of in sorted(pages.items()) if d == str(k) for w in of]
        sheets = [ws[i : i + 60] for i in range(0, n, 60)]
        doc.append((str(k), half_up(sum(half_up(sum(w[6] for w in s) / len(s)) * len(s) for s in sheets) / n), len(sheets), n))
        text.append((str(k), sha("\n\n".join(" ".join(w[1] for w in s) for s in sheets))))
    assert answers(spark, words_dir, "ocr_doc_conf") == sorted(doc)
    assert answers(spark, words_dir, "ocr_text") == sorted(text)


def test_lines_of_whole_texts(spark, words_dir):
    want = []
    for (d, p), ws in placed().items():
        tolerance, lines = max(15.0, 0.6 * median(w[5] for w in ws)), []
        for w in sorted(ws, key=lambda w: (w[3] + w[5] / 2, w[2], w[0])):
            middles = [v[3] + v[5] / 2 for v in lines[-1]] if lines else []
            if middles and abs(w[3] + w[5] / 2 - sum(middles) / len(middles)) <= tolerance:
                lines[-1].append(w)
            else:
                lines.append([w])
        want += [(d, p, no, *box(line, lambda w: (w[2], w[0]), " ")) for no, line in enumerate(lines, 1)]
    assert answers(spark, words_dir, "layout_lines") == sorted(want)


@pytest.mark.parametrize("name", ["layout_blocks", "layout_columns", "layout_tables", "reading_order"])
def test_every_page_is_read(spark, words_dir, name):
    long = {(d, p) for (d, p), ws in placed().items() if len(ws) > 20}
    assert long <= {(r.document_id, r.page) for r in QUERIES[name](spark, words_dir).collect()}


def banded():
    """Words with their band, which is 120 lower for each gap above it."""
    for (d, p), ws in placed().items():
        bands = {}
        for w in ws:
            no = int(w[3] // 40)
            bands.setdefault(no, []).append((*w[:3], w[3] + (no + 3) // 7 * 120, *w[4:]))
        yield d, p, bands


def columns(xs):
    groups = []
    for x in sorted(xs):
        if groups and x - groups[-1][-1] <= 40:
            groups[-1].append(x)
        else:
            groups.append([x])
    return [sum(g) / len(g) for g in groups]


def test_blocks_of_all_words(spark, words_dir):
    want = []
    for d, p, bands in banded():
        lines = [(no, ws, min(w[3] for w in ws), max(w[3] + w[5] for w in ws)) for no, ws in sorted(bands.items())]
        limit, blocks = max(80.0, 3 * median(bottom - y for _, _, y, bottom in lines)), []
        for i, line in enumerate(lines):
            if i and line[2] - lines[i - 1][3] <= limit:
                blocks[-1].append(line)
            else:
                blocks.append([line])
        for no, block in enumerate(blocks, 1):
            text = "\n".join(" ".join(w[1] for w in sorted(ws, key=lambda w: (w[2], w[0]))) for _, ws, _, _ in block)
            x, right = min(w[2] for _, ws, _, _ in block for w in ws), max(w[2] + w[4] for _, ws, _, _ in block for w in ws)
            conf = half_up(sum(half_up(sum(w[6] for w in ws) / len(ws)) for _, ws, _, _ in block) / len(block))
            want.append((d, p, no, sha(text), x, block[0][2], right - x, block[-1][3] - block[0][2], conf, len(block)))
    assert len({w[:3] for w in want}) > len({w[:2] for w in want})
    assert answers(spark, words_dir, "layout_blocks") == sorted(want)


def test_columns_of_all_words(spark, words_dir):
    want = []
    for d, p, bands in banded():
        for line, ws in bands.items():
            want += [(d, p, line, no, c) for no, c in enumerate(columns(w[2] + 60 * (w[0] % 5 == 2) for w in ws), 1)]
    assert answers(spark, words_dir, "layout_columns") == sorted(want)


def test_tables_of_all_words(spark, words_dir):
    want = []
    for d, p, bands in banded():
        blocks = {}
        for line, ws in bands.items():
            blocks.setdefault(line // 4, []).extend((line, w[2] + 60 * ((w[0] * 7 + line) % 3 == 0), w[0], w[1]) for w in ws)
        for block, ws in blocks.items():
            centers, cells = columns(w[1] for w in ws), {}
            for line, x, idx, text in sorted(ws, key=lambda w: w[1:3]):
                column = min((abs(x - c), no) for no, c in enumerate(centers, 1))[1]
                cells.setdefault((line, column), []).append(text)
            wide = {line: len([1 for at, _ in cells if at == line]) for line, *_ in ws}
            if len(wide) >= 2 and len(centers) >= 2 and sum(n >= 2 for n in wide.values()) >= max(1, len(wide) // 2):
                want += [(d, p, block, line, column, " ".join(texts)) for (line, column), texts in cells.items()]
    assert any(" " in w[-1] for w in want)
    assert answers(spark, words_dir, "layout_tables") == sorted(want)


def test_reading_order_of_all_words(spark, words_dir):
    want, by_left = [], 0
    for (d, p), ws in placed().items():
        at = {w[0]: (w[2] / 9 if int(d) % 2 == 0 else w[2] + 300 * (w[2] >= 540), w[3]) for w in ws}
        xs = sorted(x for x, _ in at.values())
        broken = any(b - a > 300 for a, b in zip(xs, xs[1:]))
        by_left += broken
        want += [(d, p, i, pos) for pos, i in enumerate(sorted(at, key=lambda i: (*at[i], i) if broken else i), 1)]
    assert 0 < by_left < len(placed())
    assert answers(spark, words_dir, "reading_order") == sorted(want)
