import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessellar.llm import op1_best_fit_packing as op1
from tessellar.llm import op2_byte_bpe as op2
from tessellar.llm import op7_token_counts as op7
from tessellar.llm import word_bpe

HARD = ["", " ", "\n", "  two  spaces ", "it's we'll I'D 'sfoo", "Ünïcode ÇA été Straße İstanbul ΣΑΣ", "á école", "<|startoftext|>x<|endoftext|>", "tabs\t\tand\r\nlines nbsp em", "1234 ½ ②", "日本語 テキスト 한국어 अनुच्छेद", "x" * 3000, "!" * 500 + "a!b?c", "!!! ... *** THE!!", "\x1c\x1d sep \x85", "emoji 👩‍👩‍👧 🏳️‍🌈", " lead", "trail ", "\n\n \n mixed \t "]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_bpe.default_path())


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(op2.default_path(), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


text = st.text(alphabet=st.one_of(st.sampled_from("abcdeéßÇstTHE  \n\t'.,!?|<>012"), st.characters(exclude_categories=["Cs"])), max_size=60)


def test_ids_and_counts_on_hard_texts(library):
    ids, counts = word_bpe.PieceIds(word_bpe.default_path()), word_bpe.PieceCounts(word_bpe.default_path())
    for t, own in zip(HARD, ids.encode(HARD), strict=True):
        expected = library.encode(t, add_special_tokens=False).ids
        assert own.tolist() == expected, t[:40]
        assert counts.count(t) == len(expected), t[:40]


@settings(max_examples=300, deadline=None)
@given(text)
def test_ids_and_counts_on_any_text(library, t):
    expected = library.encode(t, add_special_tokens=False).ids
    assert word_bpe.loaded(word_bpe.PieceIds, word_bpe.default_path()).encode([t])[0].tolist() == expected
    assert word_bpe.loaded(word_bpe.PieceCounts, word_bpe.default_path()).count(t) == len(expected)


@settings(max_examples=300, deadline=None)
@given(text)
def test_byte_bpe_on_any_text(tik, t):
    bpe = op2.loaded(op2.default_path(), P.PATTERN)
    own = bpe.encode([t])[0]
    assert own.tolist() == tik.encode_ordinary(t)
    assert bpe.decode(own) == t.encode()


def test_byte_bpe_on_hard_texts(tik):
    bpe = op2.ByteBpe(op2.default_path(), P.PATTERN)
    rng = random.Random(1)
    more = ["".join(rng.choice("aeiounthrsl") for _ in range(n)) for n in (5, 50, 4000)]
    for t, own in zip(HARD + more, bpe.encode(HARD + more), strict=True):
        assert own.tolist() == tik.encode_ordinary(t), t[:40]


def test_queries_agree_with_libraries(spark, sf_dir, library, tik):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op7.op7_token_counts(spark, sf_dir).collect():
        n = len(library.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(docs[r.doc_id].encode()), n > 2048)
    rows = op2.op2_byte_bpe(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = np.array(tik.encode_ordinary(docs[r.doc_id]), "<u4")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def check_packing(rows, capacity):
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_packing_query(spark, sf_dir, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op1.op1_best_fit_packing(spark, sf_dir).collect()
    total = 0
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert by_doc.keys() == docs.keys()
    for k, own in by_doc.items():
        ids = np.array([*library.encode(docs[k], add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // 2048)))
        for r in own:
            assert r.start == 2048 * r.piece and r.length == min(2048, len(ids) - r.start)
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    n = check_packing(rows, 2048)
    assert n <= -(-total // 2048) + 1


def test_packing_small_tables(spark):
    schema = "doc_id long, text string, sequence_id string"
    assert op1.best_fit_packing(spark.createDataFrame([], schema)).collect() == []
    rows = op1.best_fit_packing(spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "", None), (3, "the " * 50, "y")], schema), capacity=20).collect()
    assert sorted((r.doc_id, r.piece, r.length) for r in rows) == [(1, 0, 1), (1, 0, 1), (2, 0, 1), (3, 0, 20), (3, 1, 20), (3, 2, 11)]
    assert check_packing(rows, 20) == 3


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_histogram_packing_uses_everything_once(lengths):
    counts = np.bincount(lengths, minlength=31) if lengths else np.zeros(31, int)
    bins = op1.pack_histogram(counts, 30)
    back = np.zeros(31, int)
    for own, times in bins:
        assert sum(own) <= 30
        for x in own:
            back[x] += times
    assert (back == counts).all()
    total, n = sum(lengths), sum(t for _, t in bins)
    assert n <= max(1, 2 * total / 30 + 1)


def test_two_for_one_is_tighter():
    # greedy alone leaves [6, 3] with a gap of 1; two 2s fill it
    counts = np.bincount([6, 3, 2, 2], minlength=11)
    assert op1.best_two(np.bincount([2, 2], minlength=11), np.array([2]), 4, 3) == (2, 2)
    assert [10] == [sum(b) for b, _ in op1.pack_histogram(counts, 10)][:1]


def test_small_tables_of_counts_and_bytes(spark):
    schema = "doc_id long, text string, n_tokens string"
    docs = spark.createDataFrame([(None, None, "a"), (2, "", "b"), (2, "", "b")], schema)
    assert [(r.n_bytes, r.n_tokens, r.over_limit) for r in op7.token_counts(docs).collect()] == [(0, 0, False)] * 3
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op2.round_trip(docs).collect()] == [(0, empty, empty)] * 3
    assert op2.round_trip(docs.limit(0)).collect() == [] and op7.token_counts(docs.limit(0)).collect() == []
    back = op2.decode(op2.encode(spark.createDataFrame([(1, "Été, it's")], "doc_id long, text string"))).collect()
    assert bytes(back[0].bytes).decode() == "Été, it's"


def test_long_matches_window_by_window(tik, monkeypatch):
    bpe = op2.ByteBpe(op2.default_path(), P.PATTERN)
    rng = random.Random(8)
    runs = ["=" * 5000, "-" * 1024, "".join(rng.choice("abé") for _ in range(4096)), "e" * 2047, "".join(rng.choice("=-") for _ in range(3000))]
    for window in (64, 1000, 1024):
        monkeypatch.setattr(op2, "WINDOW", window)
        for run in runs:
            assert bpe.backtrack(run.encode().decode("latin-1")) == tik.encode_ordinary(run) or len(bpe.matches(run)) > 1
            assert [x for m in bpe.matches(run) for x in bpe.backtrack(m.encode().decode("latin-1"))] == tik.encode_ordinary(run)


def test_a_very_long_match_needs_little_memory():
    import tracemalloc

    bpe = op2.ByteBpe(op2.default_path(), P.PATTERN)
    raw = "=" * 200_000
    tracemalloc.start()
    ids = bpe.backtrack(raw)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert "".join(bpe.bytes_of[i].decode() for i in ids) == raw and most < 60_000_000
