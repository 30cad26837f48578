"""Cases that operators left out: short items, repeated and null ids, tables without labels."""

from pyspark.sql import functions as F

from deedflow.llm import decontaminate, jaccard, langid, substrings

from .conftest import words


def test_short_items_are_found_exactly(spark, make, rnd):
    long = words(rnd, 20, 3000)
    bench = spark.createDataFrame([(1, "Alpha"), (2, "beta gamma delta epsilon zeta eta theta"), (3, "one two three"), (4, ""), (5, long), (6, "ONE two, three")], "item_id long, text string")
    docs = [(1, "x alpha y"), (2, "say beta gamma delta, epsilon zeta eta Theta."), (3, "one two other three"), (4, "one two three"), (5, "beta gamma delta epsilon zeta eta"), (6, f"a {long}"), (7, ""), (8, None), (9, "two three one two")]
    for limit in (decontaminate.BROADCAST_SEEDS, 0):
        old, decontaminate.BROADCAST_SEEDS = decontaminate.BROADCAST_SEEDS, limit
        got = {(r.doc_id, r.item_id): r for r in decontaminate.find_overlaps(make(docs), bench).collect()}
        decontaminate.BROADCAST_SEEDS = old
        assert set(got) == {(1, 1), (2, 2), (4, 3), (6, 5)}
        assert got[4, 3].item_ids == [3, 6] and (got[2, 2].doc_start, got[2, 2].doc_end, got[2, 2].similarity) == (1, 8, 1.0)


def near_copies(rnd):
    """A text, a near copy, and two others."""
    a, b, c = (words(rnd, 120, 3000) for _ in range(3))
    return a, a.rsplit(" ", 1)[0] + " changed", b, c


def test_one_row_of_each_though_ids_repeat(spark, make, rnd, tmp_path):
    a, near, b, c = near_copies(rnd)
    rows = [(1, a), (1, a), (2, near), (2, b), (None, c), (None, c), (None, near), (3, ""), (3, None), (4, c), (None, words(rnd, 50))]
    rows.append(rows[-1])
    make(rows).write.parquet(f"{tmp_path}/docs")
    for docs in (make(rows), spark.read.parquet(f"{tmp_path}/docs")):
        kept = jaccard.keep_one_of_each(docs)
        got = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
        assert got == sorted([(1, a), (2, b), (4, c), (3, ""), (3, ""), (0, rows[-1][1])]) and set(kept.columns) == set(docs.columns)


def test_clean_rows_that_share_an_id_stay(spark, make, rnd):
    item, clean = words(rnd, 30, 3000), words(rnd, 50, 3000)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, f"a {item}"), (1, clean), (1, None), (2, f"a {item}"), (2, f"b {item} c"), (3, clean), (3, clean)]
    kept = decontaminate.drop_contaminated(make(rows), bench)
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted([(1, clean), (1, ""), (3, clean), (3, clean)]) and set(kept.columns) == set(make(rows).columns)


def test_letters_decide_without_learned_languages(make):
    rows = [(1, "the and of"), (2, "123 !?"), (3, None), (4, "")]
    docs = make(rows).withColumn("lang", F.lit(None).cast("string"))
    kept = langid.drop_unknown(docs, langid.fit(docs))
    assert [r.doc_id for r in kept.collect()] == [1]


def test_rows_of_one_id_lose_their_own_stretches(make, rnd):
    p, q = (words(rnd, 130, 3000) for _ in range(2))
    x, y = (words(rnd, 60, 3000) for _ in range(2))
    rows = [(1, p), (2, q), (9, f"{p} {x}"), (9, f"{y} {q}"), (9, f"{p} {x}")]
    want = sorted([(1, 0, p), (2, 0, q), (9, 130, x), (9, 130, y), (9, 130, x)])
    for sizes in ({}, {"ship_bytes": 1, "shard_words": 50}):
        assert sorted((r.doc_id, r.n_removed, r.text) for r in substrings.remove_repeats(make(rows), **sizes).collect()) == want


def test_documents_are_not_read_again_for_more_indexes(spark, make, rnd):
    passages = [words(rnd, 90, 3000) for _ in range(40)]
    rows = [(i, f"{words(rnd, 5)} {passages[i % 40]} {passages[(i * 7 + 1) % 40]}") for i in range(120)]

    def jobs(shard_words):
        group = f"indexes of {shard_words}"
        spark.sparkContext.setJobGroup(group, group)
        done = substrings.remove_repeats(make(rows), ship_bytes=1, shard_words=shard_words).agg(F.sum("n_removed")).first()[0]
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return done, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    (few, n_few), (many, n_many) = jobs(4000), jobs(100)
    assert few == many > 0 and n_many < n_few + 10
