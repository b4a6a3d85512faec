"""Divergence against loops over all sources and terms."""

import re
from collections import Counter

import numpy as np
import pytest

from tessellar.llm import op13_source_divergence as op13


def by_loops(docs, least, smooth=5, scale=10**9, top=50):
    n, df, groups = {}, Counter(), set()
    for text, lang, source in docs:
        text, lang, source = text or "", lang or "", source or ""
        groups.add((lang, source))
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        n.setdefault((lang, source), Counter()).update(words)
        df.update((lang, w) for w in set(words))
    out = []
    for lang, source in groups:
        kept = [w for (g, w), c in df.items() if g == lang and c >= least]
        mates = [s for g, s in groups if g == lang]
        share = lambda c, total: 1 + scale * (c + smooth) // (total + smooth * len(kept))  # noqa: B023, E731
        p = {s: {w: share(n[lang, s][w], sum(n[lang, s][x] for x in kept)) for w in kept} for s in mates}
        every = {w: sum(n[lang, s][w] for s in mates) for w in kept}
        q = {w: share(every[w], sum(every.values())) for w in kept}
        pairs = [(-sum(abs(p[source][w] - p[s][w]) for w in kept), s.encode()) for s in mates if s != source]
        terms = [(q[w] - p[source][w], w.encode()) for w in kept if n[lang, source][w] and p[source][w] > q[w]]
        for part, rows, most in (("pair", pairs, None), ("term", terms, top)):
            out += [(lang, source, part, item.decode(), -v, k) for k, (v, item) in enumerate(sorted(rows)[:most], 1)]
    return sorted(out)


def texts(seed, many, sources):
    rng = np.random.default_rng(seed)
    vocabulary = np.array(["the", "Of", "é", "ñandú", "a_b", "x1y", "OF", "Zürich", " q", "w"] + [f"t{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)])
    weight = 1 / np.arange(1, len(vocabulary) + 1)
    out = [(" ".join(rng.choice(vocabulary, rng.integers(0, 25), p=weight / weight.sum())), ["en", None, "fr"][k % 3], [None, *(f"s{i}" for i in range(sources))][int(rng.integers(0, sources + 1)) if k % 3 else 1]) for k in range(many)]
    return [*out, (None, "de", "lonely"), ("", "en", "wordless"), ("12 34", None, None), *out[:7]]


@pytest.mark.parametrize("seed, many, sources, least", [(1, 150, 4, 5), (2, 300, 25, 3), (3, 40, 3, 1000)])
def test_divergence_by_loops(spark, seed, many, sources, least):
    docs = texts(seed, many, sources)
    df = spark.createDataFrame([(*d, 1, "z") for d in docs], "text string, lang string, source string, n int, item string")
    assert sorted(tuple(r) for r in op13.divergence(spark, df, least_docs=least).collect()) == by_loops(docs, least)


def test_blocks_and_shards_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(op13, "BLOCK_SOURCES", 3)
    monkeypatch.setattr(op13, "SHARD_POSTINGS", 11)
    docs = texts(5, 200, 17)
    df = spark.createDataFrame(docs, "text string, lang string, source string")
    assert sorted(tuple(r) for r in op13.divergence(spark, df, least_docs=4).collect()) == by_loops(docs, 4)


def test_counts_in_parts():
    parts, total = [op13.Counts()], Counter()
    docs = texts(6, 90, 5)
    for k, (text, lang, source) in enumerate(docs):
        parts[-1].add((lang or "", source or ""), text or "")
        if k % 10 == 9:
            parts.append(op13.Counts())
    for part in parts:
        for batch in part.rows():
            for r in batch.to_pylist():
                if r["term"] is not None:
                    total[r["lang"], r["source"], r["term"]] += r["n"]
    want = Counter()
    for text, lang, source in docs:
        want.update((lang or "", source or "", w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")))
    assert total == want
    long = ("long word " * 1_000_000).encode()
    assert sum(map(len, op13._words(long))) == 2_000_000 and len(list(op13._words(long))) > 1


def test_empty(spark):
    assert op13.divergence(spark, spark.createDataFrame([], "text string, lang string, source string")).collect() == []
