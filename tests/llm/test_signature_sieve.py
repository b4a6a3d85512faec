"""What the bitmap trees leave out has no similar partner; blocks of a large group lose no link."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessellar.llm import op6_ngram_jaccard_join as op6
from tessellar.llm.shingles import jaccard_at_least
from tessellar.llm.signature_tree import bitmap, possible, wide_enough
from tests.llm.test_near import brute_components, texts


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([70, 80, 90]))
def test_no_similar_pair_is_left_out(seed, percent):
    rng = np.random.default_rng(seed)
    base = [np.unique(rng.integers(0, 2**62, rng.integers(1, 90)).astype(np.uint64)) for _ in range(8)]
    sets = [np.unique(np.append(rng.permutation(b)[rng.integers(0, 4) :], rng.integers(0, 2**62, rng.integers(0, 3)).astype(np.uint64))) for b in base for _ in range(rng.integers(1, 8))]
    sets = [s for s in sets if len(s)]
    if len(sets) < 2:
        return
    partners = {i for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and jaccard_at_least(a, b, percent)}
    found = possible([bitmap(s, wide_enough(len(s))) for s in sets], list(map(len, sets)), percent)
    assert len(found) == len(set(found)) and partners <= set(found)


def test_unlike_sets_are_left_out():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**62, 300).astype(np.uint64)) for _ in range(200)]
    assert possible([bitmap(s, wide_enough(300)) for s in sets], list(map(len, sets)), 80) == []


def test_groups_beyond_the_sieve_and_a_block(spark, monkeypatch):
    monkeypatch.setattr(op6, "BLOCK_SHINGLES", 500)
    rows = list(enumerate(texts(21, 90) + ["same start of a passage that many rows share " + "z%d " % (i // 3) * 5 for i in range(30)]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (3, 1_000):
        monkeypatch.setattr(op6, "SIEVED", most)
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in op6.jaccard_components(docs, width=3, percent=70).collect())
        assert got == brute_components(rows, 3, 70)
