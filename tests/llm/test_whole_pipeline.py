"""Near copies are removed by row: rows that are no near copies stay, whatever their ids."""

import random

import corpus_pipeline as pipeline
from tests.llm.test_near import brute_components, texts


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    return sorted(((r.doc_id, r.text) for r in pipeline.near_duplicates(spark, docs, "").collect()), key=str)


def test_repeated_and_missing_ids(spark):
    a, b, c, d = ("one two three four five six seven", "red green blue black white grey pink", "an apple a pear a plum a grape a fig", "some text that stands without an id")
    rows = [(1, a), (2, b), (2, a), (2, c), (3, b), (None, c), (None, d), (None, d), (4, ""), (4, ""), (5, None), (5, d + " x"), (None, None)]
    assert kept(spark, [(*r, 0) for r in rows]) == sorted([(1, a), (2, b), (2, c), (None, d), (4, ""), (4, ""), (5, None), (5, d + " x"), (None, None)], key=str)


def test_rows_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 2, 3, 4, 5, 6, 7, 8]), t) for t in texts(11, 60)]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1] or "", i))
    stays = {k for k, _, c in brute_components([(n, rows[i][1]) for n, i in enumerate(order)], 5, 80) if k == c}
    got = kept(spark, [(*r, 0) for r in rows])
    assert sorted(str(k) for k, _ in got) == sorted(str(rows[order[n]][0]) for n in stays)
