"""The automaton against all substrings, and collocations against loops."""

from collections import Counter
from itertools import chain

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessellar.llm import op12_phrase_collocations as op12
from tessellar.llm.suffix_automaton import ROOT, build


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=9), max_size=6), st.integers(1, 5))
def test_automaton(sequences, depth):
    flat = list(chain.from_iterable(sequences))
    names = {w: k for k, w in enumerate(sorted(set(flat)))}
    words = np.array([names[w] for w in flat], np.int64)
    room = np.array(list(chain.from_iterable(range(1, len(s) + 1) for s in sequences)), np.int64)
    sa = build(words, room, depth)
    ends, at = {}, 0
    for s in sequences:
        for i in range(len(s)):
            for k in range(1, min(depth, i + 1) + 1):
                ends.setdefault(tuple(names[w] for w in s[i - k + 1 : i + 1]), set()).add(at + i)
        at += len(s)
    found = {}
    for k in range(1, depth + 1):
        phrases, n = sa.phrases(k)
        found |= {tuple(p): c for p, c in zip(phrases.tolist(), n.tolist(), strict=True)}
    assert found == {p: len(e) for p, e in ends.items()}
    # as many states as classes of end places, and links lead to the longest suffix of more places
    assert len(sa.longest) == len({frozenset(e) for e in ends.values()})
    for q, up in enumerate(sa.link.tolist()):
        longest = tuple(words[sa.end[q] - sa.longest[q] + 1 : sa.end[q] + 1].tolist())
        suffixes = [longest[k:] for k in range(1, len(longest)) if ends[longest[k:]] != ends[longest]]
        assert (up == ROOT) == (not suffixes)
        if suffixes:
            assert suffixes[0] == tuple(words[sa.end[up] - sa.longest[up] + 1 : sa.end[up] + 1].tolist())


def by_loops(docs, longest, least, percent, top):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            low = low.replace(c, "\n")
        for piece in low.split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = {}
    for p, a in candidates.items():
        lang, w = p[0], p[1:]
        score, _, l, r = min((10**6 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k, f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w)))
        inside = any(q[0] == lang and len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(w)] == w for i in range(1, len(q) - len(w) + 1)) for q, b in candidates.items())
        if not inside:
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, k, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for k, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1))


def texts(seed, many):
    rng = np.random.default_rng(seed)
    vocabulary = ["the", "of", "New", "York", "City", "é", "ñandú", "a\x00b", "x", "\x85", " ", "THE"]
    out = []
    for k in range(many):
        words = rng.choice(vocabulary, rng.integers(0, 60), p=np.array([8, 6, 4, 4, 3, 2, 2, 1, 1, 1, 1, 1]) / 34)
        out.append((" ".join(words).replace("x ", rng.choice([".", "\n", "\t\t", " ! ", "\x0b"])), [None, "en", "und", "fr"][k % 4]))
    return [*out, (None, "en"), ("", None), *out[:5]]


def check(spark, docs, **args):
    df = spark.createDataFrame([(t, g, 1, "z") for t, g in docs], "text string, lang string, grp int, phrase string")
    found = op12.collocations(spark, df, **args)
    want = by_loops(docs, args.get("longest", 3), args.get("least", 10), args.get("within_percent", 50), args.get("top", 2000))
    assert sorted(tuple(r) for r in found.collect()) == want
    return want


def test_collocations_by_loops(spark):
    assert check(spark, texts(1, 120))
    assert check(spark, texts(2, 60), longest=4, least=3, within_percent=70, top=25)
    assert check(spark, texts(3, 20), longest=2, least=1)


def test_small_shards_and_buckets_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(op12, "SHARD_WORDS", 50)
    monkeypatch.setattr(op12, "HELD_PHRASES", 20)
    docs = texts(4, 80)
    df = spark.createDataFrame(docs, "text string, lang string")
    # what tasks run is taken from the module as it is here
    shards, buckets = [], {}
    for text, lang in docs:
        if not shards or shards[-1].words >= op12.SHARD_WORDS:
            shards.append(op12.Shard())
        shards[-1].add(lang or "und", [text or ""])
    assert len(shards) > 20
    for shard in shards:
        for b, block in op12.blocks_of(shard, 1, 3, 7):
            buckets.setdefault(b, op12.Bucket()).add(block)
    rows = [r for bucket in buckets.values() for r in bucket.rows(2)]
    words = Counter()
    for r in rows:
        if r[1] == 0:
            words[r[0]] += r[3]
    whole = [tuple(r) for r in op12.phrase_counts(spark, df, longest=3, least=2).collect()]
    assert sorted(r for r in rows if r[1]) == sorted(r for r in whole if r[1])
    assert words == Counter({g: sum(r[3] for r in whole if r[1] == 0 and r[0] == g) for g in words})


def test_a_full_sieve_changes_nothing(spark, monkeypatch):
    full = np.full(op12.SIEVE_BITS // 64, 2**64 - 1, np.uint64)
    monkeypatch.setattr(op12, "pair_sieve", lambda pairs: full)
    check(spark, texts(1, 120))


def test_hostile(spark):
    schema = "text string, lang string"
    assert op12.collocations(spark, spark.createDataFrame([], schema)).collect() == []
    assert op12.collocations(spark, spark.createDataFrame([(None, None), ("", "en")], schema)).collect() == []
    long = "deep blue sea " * 200_000
    rows = op12.collocations(spark, spark.createDataFrame([(long, "en")], schema)).collect()
    assert [(r["phrase"], r["a"]) for r in rows][0] == ("deep blue sea", 200_000)
