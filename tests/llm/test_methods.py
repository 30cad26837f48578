"""Planted cases for the methods: edited licenses, foreign texts, substituted benchmark items, plans of packing."""

import numpy as np
from pyspark.sql import functions as F

from deedflow.llm import decontaminate, langid, licenses, packing

from .conftest import words


def test_edited_licenses_are_labelled_and_sets_of_words_are_not(make, rnd):
    docs, wanted = [], {}
    for i, (text, label) in enumerate(licenses.TEMPLATES):
        own = text.split()
        if len(own) > 30:  # one word put in, one left out, one changed
            own = own[:9] + ["verily"] + own[9:15] + own[16:]
            own[len(own) // 2] = "otherwise"
        docs.append((i, f"{words(rnd, 20)} {' '.join(own)} {words(rnd, 20)}"))
        wanted[i] = label
    shuffled = licenses.TEMPLATES[0][0].split()
    rnd.shuffle(shuffled)
    docs.append((900, " ".join(shuffled)))
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan_licenses(make(docs)).collect()}
    found = [wanted[i] in got[i] for i in wanted]
    assert sum(found) / len(found) >= 0.9 and got[900] == [""]


def test_base_places_as_brute_force(make, rnd):
    phrases = {phrase: label for phrase, label in licenses.BASE}
    docs = [(i, " ".join(rnd.choice([*phrases, "under the mit", "apache license", "x", "cc by"]) for _ in range(rnd.randrange(1, 30)))) for i in range(20)] + [(30, None), (31, ""), (32, "CC-BY-NC " * 3000)]
    for r in licenses.scan_licenses(make(docs)).collect():
        own = dict(docs)[r.doc_id] or ""
        own = own.lower().replace("-", " ").split()
        places = [(i, label) for phrase, label in phrases.items() for i in range(len(own)) if own[i : i + len(phrase.split())] == phrase.split()]
        starts = [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(own), len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))


def test_foreign_and_unwanted_texts_go(make, rnd):
    english, german = ["the water and house with other people", "there were many things that they had"], ["der hund und die katze mit dem haus", "wir haben nicht auch noch eine andere"]
    rows = [(i, " ".join(rnd.choice(english if i % 2 else german) for _ in range(20))) for i in range(60)]
    docs = make(rows).withColumn("lang", F.expr("CASE WHEN doc_id % 2 = 1 THEN 'en' ELSE 'de' END"))
    model = langid.fit(docs)
    foreign = [(100, "Сегодня утром мы пошли в лес чтобы посмотреть на звёзды " * 5), (101, "12 !?"), (102, None)]
    more = docs.unionByName(make(foreign).withColumn("lang", F.lit(None).cast("string")))
    assert {r.doc_id for r in langid.keep_languages(more, model).collect()} == {i for i, _ in rows}
    assert {r.doc_id for r in langid.keep_languages(more, model, ["en"]).collect()} == {i for i, _ in rows if i % 2}


def test_mixture_as_brute_force():
    p = np.array([[0.5, 0.1], [0.1, 0.6], [0.4, 0.3]])
    n = np.array([30.0, 50.0, 20.0])
    shares, value = langid.Model.em(p, n)
    grid = np.linspace(0.001, 0.999, 999)
    best = grid[np.argmax([n @ np.log(p @ np.array([x, 1 - x])) for x in grid])]
    assert abs(shares[0] - best) < 0.02 and value <= 0


def test_substituted_items_are_found_by_either_join(spark, make, rnd, monkeypatch):
    items = [(i, words(rnd, 24, 5000)) for i in range(12)]
    docs = [(50, words(rnd, 20000, 5000)), (51, None), (52, "")]
    for i, text in items:
        own = text.split()
        for at in rnd.sample(range(24), 3):
            own[at] = "other"
        docs.append((i, f"{words(rnd, 30, 5000)} {' '.join(own)} {words(rnd, 30, 5000)}"))
    bench = spark.createDataFrame(items, "item_id long, text string")

    def found():
        return {(r.doc_id, r.item_id) for r in decontaminate.find_overlaps(make(docs), bench).collect()}

    def has_seed(own, item):
        return any(all(own[i + k] == item[j + k] for k, c in enumerate(mask) if c == "1") for mask in decontaminate.MASKS for j in range(len(item) - len(mask) + 1) for i in [30 + j])

    want = {(i, i) for (i, text) in items if has_seed(dict(docs)[i].split(), text.split())}
    assert len(want) >= 9 and found() == want
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert found() == want


def test_plans_use_every_piece_and_no_more_sequences_than_any_of_their_kind():
    counts = np.zeros(65, np.int64)
    counts[np.random.default_rng(3).integers(1, 65, 4000)] += 7
    made = packing.plan(counts, 64)
    used = np.zeros(65, np.int64)
    for lengths, times in made:
        assert sum(lengths) <= 64
        for n in lengths:
            used[n] += times
    assert (used == counts).all()
    assert sum(t for _, t in made) <= min(sum(t for _, t in packing.plan_down_to(counts, 64, least)) for least in (1, 57))
