import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessellar.llm import op6_ngram_jaccard_join as op6
from tessellar.llm.components import components, forest
from tessellar.llm.shingles import Levels, jaccard_at_least, shingle_sets
from tessellar.llm.signature_tree import linked


def brute_components(rows, width, percent):
    """doc -> (set size, smallest doc reachable)."""
    sets = []
    for _, text in rows:
        words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
        sets.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set()))
    pairs = [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    root = dict(forest(pairs))
    return sorted((k, len(s), root.get(k, k)) for (k, _), s in zip(rows, sets, strict=True))


def texts(seed, n=120):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    passage = [rng.choice(words) for _ in range(40)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            own = rng.choice(out).split()
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                at = rng.randrange(len(own) + 1)
                own[at : at + rng.choice([0, 1])] = [rng.choice(words)] * rng.choice([0, 1, 1])
        else:
            own = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 8, 20, 60, 150, 300]))]
            if rng.random() < 0.5:
                own = own[: len(own) // 2] + passage + own[len(own) // 2 :]
        out.append(" ".join(own) if rng.random() > 0.1 else " ".join(own).upper())
    return out + ["", None, " \t\n", "Orre " * 500]


def test_components_of_documents_against_brute_force(spark):
    for seed, (width, percent) in enumerate([(3, 90), (5, 80)]):
        rows = list(enumerate(texts(seed)))
        docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, component_id string")
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in op6.jaccard_components(docs, width=width, percent=percent).collect())
        assert got == brute_components(rows, width, percent)


def test_large_clusters_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(op6, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(op6, "GATHERED", 200)
    monkeypatch.setattr(op6, "BROADCAST_CLASSES", 1)
    rows = list(enumerate(texts(7, 80)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in op6.jaccard_components(docs, width=3, percent=90).collect())
    assert got == brute_components(rows, 3, 90)


def test_repeated_ids_nulls_and_empty_table(spark):
    schema = "doc_id long, text string"
    rows = [(3, "a b c d e"), (3, "a b c d e"), (None, "A B c d e"), (5, "x"), (9, "a b c d e"), (None, "only one"), (8, "x y")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in op6.jaccard_components(spark.createDataFrame(rows, schema), width=3, percent=90).collect()), key=str)
    assert got == sorted([(3, 3, 3), (3, 3, 3), (None, 3, 3), (5, 1, 5), (9, 3, 3), (None, 1, None), (8, 1, 8)], key=str)
    assert op6.jaccard_components(spark.createDataFrame([], schema)).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([80, 90, 70]), st.integers(1, 400), st.booleans())
def test_similar_sets_share_a_signature(seed, percent, size, hot):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64) * np.uint64(2))
    drop = rng.integers(0, len(a) // 4 + 1)
    b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2**63, rng.integers(0, len(a) // 4 + 1)).astype(np.uint64)]))
    frequent = np.sort(rng.permutation(a)[: rng.integers(0, len(a) + 1)]) if hot else None
    if jaccard_at_least(a, b, percent) and not np.array_equal(a, b):
        x, y = Levels(percent).signatures([a, b], frequent)
        assert len(np.intersect1d(x, y))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([50, 80, 90]), st.booleans())
def test_tree_finds_every_component(seed, percent, two_sides):
    rng = np.random.default_rng(seed)
    base = [np.unique(rng.integers(0, 60, rng.integers(1, 25)).astype(np.uint64)) for _ in range(6)]
    sets = [np.unique(np.append(rng.permutation(b)[rng.integers(0, 2) :], rng.integers(0, 60, rng.integers(0, 2)).astype(np.uint64))) for b in base for _ in range(rng.integers(1, 12))]
    side = (rng.random(len(sets)) < 0.5).tolist() if two_sides else None
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if jaccard_at_least(sets[i], sets[j], percent) and (side is None or side[i] != side[j])]
    assert sorted(linked(sets, percent, side)) == sorted(forest(pairs))


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(5001, 5400)] + [(7, 7), (None, 3)]
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(7)
    got = {r.v: r.r for r in components(spark, edges).collect()}
    assert got == dict(forest([p for p in pairs if p[0] is not None and p[0] != p[1]]))
    assert components(spark, edges.limit(0)).collect() == []


def test_shingles_follow_the_word_rule():
    a, b, c = shingle_sets(["The cat\tsat\x0bdown É", "the CAT sat down É", "the cat sat down é"], 3)
    assert np.array_equal(a, b) and len(np.intersect1d(a, c)) == 2
    assert [len(s) for s in shingle_sets(["", "a", "a b", "a b c", "a a a a a"], 3)] == [0, 1, 1, 1, 1]
    one, two = shingle_sets(["a b", "a b x"], 3)
    assert not np.array_equal(one, two)


def test_query_against_sql(spark):
    import duckdb

    sf_dir = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"create view documents as select * from read_parquet('{sf_dir}/documents.parquet')")
    got = op6.op6_ngram_jaccard_join(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(db.execute(op6.OP6_SQL).fetchall())
