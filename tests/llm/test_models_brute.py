"""Predictions and scores of the fitted models against versions in plain loops."""

import math
import unicodedata

import pytest

import corpus_pipeline as pipeline
from tessellar.llm import components
from tessellar.llm import op4_language_id as op4
from tessellar.llm import op9_quality_classifier as op9


def bucket(chars):
    """The hash of up to three characters, None for a space, in plain integers."""
    mixed, full = 0, (1 << 32) - 1
    for c, factor in zip(chars, (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35), strict=False):
        code = 0 if c == " " else ord(c)
        mixed = (mixed * 0x01000193 & full) ^ ((code + 1) * factor & full)
    return ((mixed ^ mixed >> 15) * 0x2C1B3C6D & full) >> 16


def grams(text):
    words = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text.lower()).split()
    line = " " + "".join(w + " " for w in words)
    return [bucket((line + "  ")[i : i + n]) for n in (1, 2, 3) for i in range(len(line))], len(line), bool(words)


def test_language_id_by_loops(spark):
    rows = [(1, "the cat, and the dog", "en"), (2, "der Hund & die Katze", "de"), (3, "the and", None), (4, None, "de"), (7, "12 ?!", "fr"), (8, "le chat et  le chien", "fr"), (9, "ÉCOLE", None), (10, "", None), (12, "a", None), (13, "Größe der Stadt.", "de"), (14, "xq zzv 日本", None)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, score string").repartition(2)
    langs, matrix = op4.train(docs, "doc_id", "text", "lang")
    got = {r.doc_id: r for r in op4.language_id(docs, (langs, matrix)).collect()}
    for k, text, _ in rows:
        found, n, letters = grams(text or "")
        r = got[k]
        if not letters:
            assert (r.lang_pred, r.score, r.fit) == ("und", 0.0, None)
            continue
        total = [math.fsum(float(matrix[i][g]) for g in found) for i in range(len(langs))]
        odds = [math.exp((t - max(total)) / math.sqrt(n)) for t in total]
        assert r.lang_pred == langs[total.index(max(total))]
        assert r.score == pytest.approx(max(odds) / sum(odds), abs=1e-9) and r.fit == pytest.approx(max(total) / (3 * n), abs=1e-9)


def test_language_counts_by_loops(spark):
    rows = [(1, "aab b", "x"), (2, "bc", "y"), (3, "cab", "x")]
    langs, matrix = op4.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    assert langs == ["x", "y"]
    for i, lang in enumerate(langs):
        found = [g for _, t, x in rows if x == lang for g in grams(t)[0]]
        for g in set(found):
            assert matrix[i][g] == pytest.approx(math.log((found.count(g) + 0.5) / (len(found) + 0.5 * op4.BUCKETS)), abs=1e-5)


def sigmoid(z):
    return 1 / (1 + math.exp(-min(30, max(-30, z))))


def logit(p):
    p = min(1 - 1e-6, max(1e-6, p))
    return math.log(p / (1 - p))


def strength(groups, mean):
    """groups: (n, own mean, mean of the level above)."""
    total = sum(n for n, _, _ in groups)
    noise, scale = mean * (1 - mean), total - sum(n * n for n, _, _ in groups) / total
    spread = sum(n * (m - up) ** 2 for n, m, up in groups)
    variance = (spread - (len(groups) - 1) * noise) / scale if scale > 0 else 0
    return min(max(noise / variance - 1, 1.0), 1e6) if variance > 1e-12 and noise > 0 else 1e6


def test_quality_scores_by_loops(spark, monkeypatch):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    odd = spark.createDataFrame([(-1, None, None, None, 0), (-2, "alone at its host, a text", "en", "lonely", 0), (-3, " \n", "en", "src1", 0)], docs.schema)
    docs = docs.union(odd)
    model = op9.train(docs, labels)
    rows = []
    for r in docs.collect():
        z = op9.evidence(model, r.text) if (r.text or "").split() else None
        rows.append((r.doc_id, r.source or "", r.lang or "", 0.0 if z is None else sigmoid(-z[0]), z))
    mean = sum(p for *_, p, _ in rows) / len(rows)
    hosts, paths = {}, {}
    for _, host, path, p, _ in rows:
        for sums, key in ((hosts, host), (paths, (host, path))):
            n, s = sums.get(key, (0, 0.0))
            sums[key] = n + 1, s + p
    of_hosts = strength([(n, s / n, mean) for n, s in hosts.values()], mean)
    posterior = {h: (of_hosts * mean + s) / (of_hosts + n) for h, (n, s) in hosts.items()}
    of_paths = strength([(n, s / n, posterior[h]) for (h, _), (n, s) in paths.items()], mean)
    expected = {}
    for k, host, path, p, z in rows:
        n, s = hosts[host]
        at_host = (of_hosts * mean + s - p) / (of_hosts + n - 1)
        n, s = paths[host, path]
        at_path = (of_paths * at_host + s - p) / (of_paths + n - 1)
        score = 0.0 if z is None else 1 / (1 + math.exp(-(logit(p) + logit(at_path) - logit(mean))))
        toxic = 0.0 if z is None else sigmoid(z[1])
        expected[k] = (p, at_host, at_path, score, toxic)
    for most in (components.BROADCAST_ROWS, 2, 0):
        monkeypatch.setattr(components, "BROADCAST_ROWS", most)
        got = op9.quality_scores(docs, labels, model=model).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.doc_score, r.host_posterior, r.path_posterior, r.score, r.toxic_score) == pytest.approx(expected[r.doc_id], rel=1e-6, abs=1e-9)
            assert r.kept == (r.score >= 0.5 and r.toxic_score < 0.5)
    assert expected[-2][1] == pytest.approx(mean, rel=1e-6)


def test_language_stage_drops_what_is_in_no_learned_language(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    odd = [(-1, "qwzx kjvq xxzq pqkz vvbn zzkw " * 8, None, "s", 0), (-2, "Это русский текст о погоде и работе людей в большом городе.", "ru", "s", 0), (-3, "123 !", "en", "s", 0), (-4, None, "en", "s", 0)]
    kept = pipeline.language(spark, docs.union(spark.createDataFrame(odd, docs.schema)), d)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert not ids & {-1, -2, -3, -4}
    clean = {r.doc_id for r in docs.where("text is not null").join(spark.read.parquet(f"{d}/labels.parquet").where("quality = 1 and toxic = 0"), "doc_id").select("doc_id").collect()}
    assert clean <= ids


def test_columns_named_like_results(spark):
    rows = [(1, "some plain words, of a text", "en", "s", "a", "b"), (1, "some plain words, of a text", "en", "s", "a", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, __host string, host string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert [r.kept for r in op9.quality_scores(docs, labels).collect()] == [True, True]
    assert op9.quality_scores(docs, labels, carry=["__host", "host", "text"]).columns[:3] == ["__host", "host", "text"]
