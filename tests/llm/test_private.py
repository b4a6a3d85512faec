"""Forms against the plain patterns, terms against loops over all documents."""

import hashlib
import math
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessellar.llm import op11_private_terms as op11

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in pattern.finditer(text):
            digits = re.sub(r"[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=1500, deadline=None)
@given(st.one_of(st.text("a%.@-é b1", max_size=40), st.text("0123456789. +-()", max_size=60), st.lists(st.sampled_from(["4111 1111-1111 1111", "+1 (415) 555-0100", "x.y@mail.example.com", "10.0.0.255", "1.2.3.256", "00255.1.1.1", "é", "@", ".", " ", "1", "-", "+4", "a@b", ".c"]), max_size=12).map("".join)))
def test_forms(text):
    assert op11.base_spans(text) == plain_spans(text)


def test_hostile_texts_are_linear():
    began = time.perf_counter()
    for text in ("a" * 300_000, "a@" * 150_000, "1" * 300_000, "1." * 150_000, "+1" + "(" * 300_000, "+1(" * 100_000, "1 " * 150_000, ("a" * 300_000) + "@b.c", "a@b" + ".c" * 150_000):
        op11.base_spans(text)
        op11.evidence(text)
    assert time.perf_counter() - began < 20


def corpus():
    """Term mockturtle only ever beside one address, gryphonish half the time, and a group of copies that proves nothing."""
    docs = []
    for k in range(300):
        docs.append((k, f"word{k % 7} and other{k % 11} words of no person stand here alpha{k} beta{k}"))
    for k in range(8):
        docs.append((1000 + k, f"lead{k} mockturtle tail{k} wrote from carroll@wonder.example.org on day{k}"))
        docs.append((1100 + k, f"some{k} gryphonish text{k} by gryph@wonder.example.org at{k}"))
        docs.append((1200 + k, f"only gryphonish here{k} in text number{k}"))
        docs.append((1300 + k, "copied snarkish passage by snark@wonder.example.org as ever"))
    docs += [(1400, "a mockturtle alone"), (1401, None), (1402, ""), (1400, "a mockturtle alone"), (None, "Mockturtle @ mockturtle@x.example")]
    return docs


def by_loops(docs, disclose, remove, contexts, public):
    n, of, at, words_of = len(docs), {}, {}, {}
    for i, (_, text) in enumerate(docs):
        text = text or ""
        spans = plain_spans(text)
        inside = lambda m: any(a < m.end() and m.start() < b for _, a, b in spans)  # noqa: B023, E731
        words = [m for m in re.finditer(r"[A-Za-z0-9\x80-\U0010ffff]+", text)]
        for w in words:
            words_of.setdefault(w.group().lower(), set()).add(i)
        for kind, a, b in spans:
            e = (kind, text[a:b].lower())
            of.setdefault(e, set()).add(i)
            close = [m for m in words if m.end() <= a and m.start() >= max(0, a - 200)][-8:] + [m for m in words if m.start() >= b and m.end() <= b + 200][:8]
            close = ["", *(m.group().lower() for m in close if not inside(m)), ""]
            for k in range(1, len(close) - 1):
                if len(close[k]) >= 3:
                    at.setdefault((e, close[k]), {}).setdefault(i, (close[k - 1], close[k + 1]))
    best = {}
    for (e, t), docs_of in at.items():
        if len(of[e]) > public * n:
            continue
        every = list(docs_of.values())
        square = sum(every.count(c) ** 2 for c in set(every))
        if len(every) ** 2 < contexts * square:
            continue
        pmi = math.log2(len(every) * n / (len(of[e]) * len(words_of[t])))
        best[t] = max(best.get(t, 0), pmi / math.log2(n / len(of[e])))
    return {t: "remove" if s >= remove else "generalise" for t, s in best.items() if s >= disclose}


def test_terms_by_loops(spark):
    docs = corpus()
    for disclose, contexts in ((0.8, 4), (0.5, 2), (0.1, 1)):
        expected = by_loops(docs, disclose, 0.95, contexts, 0.05)
        df = spark.createDataFrame(docs, "doc_id long, text string")
        rows = op11.find_private(spark, df, disclose=disclose, contexts=contexts, public=0.05, carry=["text"]).collect()
        assert len(rows) == len(docs)
        for r in rows:
            text = r["text"] or ""
            spans = plain_spans(text)
            assert [(s["kind"], s["start"], s["end"]) for s in r["base"]] == spans
            hits = [(expected[m.group().lower()], m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9\x80-\U0010ffff]+", text) if m.group().lower() in expected and not any(a < m.end() and m.start() < b for _, a, b in spans)]
            assert [(s["kind"], s["start"], s["end"]) for s in r["terms"]] == hits
        if contexts == 4:
            assert "mockturtle" in expected and "snarkish" not in expected and not any(t.startswith(("word", "other", "alpha")) for t in expected)
            out = {r["doc_id"]: r["text"] for r in op11.sanitised(op11.find_private(spark, df, public=0.05, carry=["text"])).collect()}
            assert out[1400] in ("a  alone", "a [TERM] alone") and out[1401] is None and out[1402] == "" and "[EMAIL]" in out[1000] and out[0] == docs[0][1]


def test_digest_and_hostile_tables(spark):
    empty = op11.digest(op11.find_private(spark, spark.createDataFrame([], "doc_id long, text string")))
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    clash = spark.createDataFrame([(1, "a@b.cc 1.2.3.4", "x", "y"), (1, "a@b.cc 1.2.3.4", "x", "y"), (None, None, None, None)], "doc_id long, text string, terms string, row_key string")
    rows = sorted(op11.digest(op11.find_private(spark, clash)).collect(), key=lambda r: r["doc_id"] or 0)
    said = "email:0:6,ip:7:14"
    assert [tuple(r) for r in rows] == [(None, 0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "")] + 2 * [(1, 1, 1, 0, 0, hashlib.sha256(said.encode()).hexdigest(), said)]


@pytest.mark.parametrize("copies", [200, 2000])
def test_edited_copies_count_as_about_one_context(spark, copies):
    docs = [(k, f"{'edited%d' % k if k % 30 == 0 else 'prefix'} jabberwock suffix by poet@wonder.example.org") for k in range(copies)]
    docs += [(k, f"noise{k}") for k in range(copies, copies * 200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert op11.revealing_terms(spark, df).count() == 0
