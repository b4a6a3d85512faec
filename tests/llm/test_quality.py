import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellar.llm import components
from tessellar.llm import op9_quality_classifier as op9


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_held_out_accuracy(tables):
    docs, labels = tables
    model = op9.train(docs, labels.where("doc_id % 2 = 0"))
    got = op9.quality_scores(docs, labels, model=model).join(labels, "doc_id").where("doc_id % 2 = 1").collect()
    bad, toxic, clean = ([r for r in got if c(r)] for c in (lambda r: r.quality == 0, lambda r: r.toxic == 1, lambda r: r.quality == 1 and r.toxic == 0))
    assert sum(not r.kept for r in bad) >= 0.97 * len(bad)
    assert sum(not r.kept for r in toxic) >= 0.75 * len(toxic)  # of few labels
    assert sum(r.kept for r in clean) >= 0.98 * len(clean)


def test_sites_shrink_to_their_parents(spark):
    rows = [("big", "a", 0.9)] * 400 + [("big", "b", 0.1)] * 400 + [("other", "x", 0.9)] * 300 + [("tiny", "t", 0.0)]
    sites, mean, _, strength = op9.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double"))
    assert abs(mean - np.mean([r[2] for r in rows])) < 1e-9
    own = {(r.host, r.path): r for r in sites.collect()}
    assert own["tiny", "t"].host_posterior > 0.2 > own["tiny", "t"].p_sum
    assert 0.45 < own["big", "a"].host_posterior < 0.6
    shrunk = {k: (strength * r.host_posterior + r.p_sum) / (strength + r.n) for k, r in own.items()}
    assert shrunk["big", "a"] > 0.8 and shrunk["big", "b"] < 0.2


def test_prior_strength_by_moments():
    rng = np.random.default_rng(0)
    theta = rng.beta(8, 2, 400)
    n = np.full(400, 50)
    m = rng.binomial(50, theta) / 50
    mean = m.mean()
    k = op9.between(400, n.sum(), (n**2).sum(), (n * (m - mean) ** 2).sum(), mean)
    assert 7 < k < 14  # the prior's 10
    assert op9.between(1, 50, 2500, 0, 0.5) == 1e6


def test_small_tables(spark, monkeypatch):
    schema = "doc_id long, text string, lang string, source string, score string"
    docs = spark.createDataFrame([(1, None, "en", "s", "x"), (2, "fine words here", None, None, "x"), (2, "fine words here", "en", "s", "x"), (None, " \n", "en", "s", "x"), (4, "word " * 50_000, "de", "s", "x")], schema)
    labels = spark.createDataFrame([(2, 1, 0), (2, 1, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    for most in (10, 0):
        monkeypatch.setattr(components, "BROADCAST_ROWS", most)
        got = op9.quality_scores(docs, labels).collect()  # both heads abstain
        assert sorted((str(r.doc_id), r.score, r.kept) for r in got) == [("1", 0.0, False), ("2", 1.0, True), ("2", 1.0, True), ("4", 1.0, True), ("None", 0.0, False)]
    assert op9.quality_scores(docs.limit(0), labels).collect() == []
    assert len(op9.quality_scores(docs, labels.limit(0)).collect()) == 5


def test_features_of_repetition_and_case():
    plain, shout, again = (op9.features(t)[1] for t in ("the cat sat on a mat", "THE CAT!! SAT!!", "cat cat cat cat"))
    assert shout[3] == 1 and plain[3] == 0 and again[2] == 0.75 and op9.features(" ") is None


def test_sample_bound_holds_at_any_size():
    from tessellar.llm.common import sample_bound

    for n in (1, 20_000, 20_001, 10**9, 21 * 10**9, 22 * 10**9, 10**11, 10**15):
        expected = (sample_bound(n, 20_000) + (1 << 63) + 1) * n / (1 << 64)
        assert abs(expected - min(n, 20_000)) < 1e-3 * min(n, 20_000) + 1


def test_a_sample_without_rows_is_an_error(spark):
    docs = spark.createDataFrame([(7, "some words")] * 5, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(30)], "doc_id long, quality int, toxic int")
    assert len(op9.quality_scores(docs, labels).collect()) == 5
    with pytest.raises(ValueError, match="in the sample"):
        op9.train(docs, labels, train_rows=0)
    with pytest.raises(ValueError, match="rename"):
        op9.quality_scores(docs.withColumn("kept", docs.text), labels, carry=["kept"])
