import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessellar.llm import op5_embedding_near_dedup as op5
from tessellar.llm.components import forest

SCHEMA = "vec_id long, embedding array<float>, n_links string"


def brute(rows, threshold):
    ok = {}
    for n, (k, v) in enumerate(rows):
        if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[n] = np.array(v, np.float32).astype(float)
    cos = lambda a, b: a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)
    pairs = [(a, b) for a in ok for b in ok if a < b and len(ok[a]) == len(ok[b]) and cos(ok[a], ok[b]) >= threshold]
    root, least, count = dict(forest(pairs)), {}, np.zeros(len(rows), int)
    for a, b in pairs:
        count[a] += 1
        count[b] += 1
    for n in ok:
        r = root.get(n, n)
        least[r] = min(least.get(r, rows[n][0]), rows[n][0])
    out = []
    for n, (k, _) in enumerate(rows):
        c = least[root.get(n, n)] if n in ok else k
        out.append((k, int(count[n]), c, k is not None and k == c))
    return sorted(out, key=str)


def vectors(seed, n, d):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 6), d))
    return [(int(k), (centres[rng.integers(len(centres))] + rng.normal(size=d) * rng.choice([0, 0.1, 0.3, 0.5])).astype(np.float32).tolist()) for k in rng.permutation(n)]


def test_against_brute_force(spark):
    rows = vectors(0, 300, 16) + [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [1.0, None] * 8), (905, [float("inf")] * 16), (906, [1.0, 0.0]), (907, [2.0, 0.0]), (908, [1.0] * 16), (908, [1.0] * 16), (None, [1.0] * 16)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    for block in (10_000, 40):
        got = op5.near_components(frame, block=block).collect()
        assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str) == brute(rows, 0.9)
    assert op5.near_components(frame.limit(0)).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([2, 7, 64, 1200]), st.sampled_from([0.5, 0.9, 0.99]))
def test_bounds_lose_and_invent_nothing(seed, d, threshold):
    x = np.array([v for _, v in vectors(seed, 60, d)])
    q = op5.Quantised(x)
    found = {(int(a), int(b)) for i, j in op5.links_of(q, q, threshold, True) for a, b in zip(i, j, strict=True)}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    cos = unit @ unit.T
    sure = {(i, j) for i in range(60) for j in range(i + 1, 60) if cos[i, j] >= threshold + 1e-9}
    maybe = {(i, j) for i in range(60) for j in range(i + 1, 60) if cos[i, j] >= threshold - 1e-9}
    assert sure <= found <= maybe
    labels = np.arange(60)
    for i, j in op5.links_of(q, q, threshold, True):
        op5.merge(labels, i, j)
    root = dict(forest(list(found)))
    assert labels.tolist() == [root.get(i, i) for i in range(60)]


def test_query_against_sql(spark, sf_dir):
    import duckdb

    got = op5.op5_embedding_near_dedup(spark, sf_dir).collect()
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from read_parquet('{sf_dir}/embeddings.parquet')")
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == sorted(db.execute(op5.OP5_SQL).fetchall())
