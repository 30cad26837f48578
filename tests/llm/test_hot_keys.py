"""Keys that hold many rows are split: with the splits' sizes set small, results stay the same."""

import pytest

from deedflow.llm import components, jaccard

from .conftest import words
from .test_corpus_operators import brute_components


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_lists_in_cells(make, rnd, monkeypatch, k, percent):
    monkeypatch.setattr(jaccard, "LIST_CELL", 3)
    monkeypatch.setattr(components, "HUB_EDGES", 1)
    rows = []
    for size in (12, 60, 150):
        base = words(rnd, size).split()
        for _ in range(40):
            own = base[: rnd.randrange(max(4, size - 6), size + 1)]
            for _ in range(rnd.randrange(4)):
                own[rnd.randrange(len(own))] = f"w{rnd.randrange(300)}"
            rows.append((len(rows), " ".join(own)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(make(rows), k, percent).collect()}
    assert got == brute_components(rows, k, percent)


def test_components_of_hubs(spark, rnd, monkeypatch):
    links = [(0, i) for i in range(1, 60)] + [(500, i) for i in range(400, 460)] + [(459, 30), (700, 701), (701, 700)] + [(900 + i, 901 + i) for i in range(20)]
    table = spark.createDataFrame(links, "u long, v long")
    want = {i: 0 for i in [*range(60), *range(400, 460), 500]} | {700: 700, 701: 700} | {900 + i: 900 for i in range(21)}
    for hub_edges in (components.HUB_EDGES, 10, 0):
        monkeypatch.setattr(components, "HUB_EDGES", hub_edges)
        assert {r.node: r.root for r in components.components(table).collect()} == want
