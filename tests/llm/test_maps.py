import hashlib
import math
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessellar.llm import op3_license_scan as op3
from tessellar.llm import op4_language_id as op4
from tessellar.llm import op8_telephony_audio as op8
from tessellar.llm import op10_html_text as op10

SCHEMA = "doc_id long, text string, lang string, n_words string, score string, feature string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (6 - len(r))) for r in rows], SCHEMA)


def brute_licenses(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for phrase, label in op3.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    labels = {b for _, b in places}
    for label, t in op3.NOTICES.items():
        need = set(re.findall(r"[a-z0-9]+", t.lower()))
        if any(len(need & set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", b))) >= 0.8 * len(need) for b in re.split(r"\n[ \t\r\f\v]*\n", low)):
            labels.add(label)
    for label, t in op3.LINES.items():
        need = set(re.findall(r"[a-z0-9]+", t.lower()))
        if any(len(need & set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", b))) >= 0.8 * len(need) for b in re.split("\r\n|\n|\r", low)):
            labels.add(label)
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({b for _, b in places})), ",".join(sorted(labels))


def test_licenses_against_brute_force(spark, sf_dir):
    notice = op3.NOTICES["mit-notice"]
    half = " ".join(notice.split()[: len(notice.split()) // 2])
    rows = [(-1, None), (-2, ""), (-3, "MIT License. the MIT\nlicense; mit-license"), (-4, "xGeneral Public License GNU GENERAL public license"), (-5, f"Ünder\n\n{notice}\n\nother"), (-6, half), (-7, op3.NOTICES["gpl-notice"].upper()), (-7, "apache license Éapache license"), (-8, "mit" * 40_000), (-10, "x\nLicensed under the Apache License, Version 2.0.\nAll rights\nreserved."), (-9, notice.replace("Permission is hereby granted", "Leave") + " x" * 3000)]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = op3.digest(op3.license_scan(frame(spark, rows + docs)))
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in got.collect()), key=str) == sorted(((k, *brute_licenses(t)) for k, t in rows + docs), key=str)
    assert op3.digest(op3.license_scan(frame(spark, []))).collect() == []
    scores = {r.doc_id: r.score for r in got.collect()}
    assert scores[-5] == 1.0 and scores[-2] == 0.0 and 0.8 <= scores[-9] < 1


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefghij"), st.integers(0, 9)), st.lists(st.sets(st.sampled_from("abcdefghij"), min_size=1), min_size=1, max_size=5), st.sets(st.sampled_from("abcdefghijk")), st.sampled_from([0.5, 0.8, 1.0]))
def test_filters_lose_nothing(frequency, templates, block, threshold):
    index = op3.TemplateIndex({str(i): " ".join(t) for i, t in enumerate(templates)}, {k.encode(): v for k, v in frequency.items()}, threshold)
    expected = {str(i) for i, t in enumerate(templates) if len(t & block) >= max(1, math.ceil(threshold * len(t) - 1e-9))}
    assert {label for label, _ in index.matches({w.encode() for w in block})} == expected


def test_language_id_held_out(spark, sf_dir):
    rows = op4.op4_language_id(spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_id_small_tables(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, "the and", None), (4, None, "de"), (6, "123 !?", "en"), (7, "", "de"), (8, "the cat and the dog", "en"), (8, "the cat " * 20_000, "en"), (None, "und die", "de")]
    docs = frame(spark, rows)
    model = op4.train(docs, "doc_id", "text", "lang")
    assert model[0] == ["de", "en"]
    got = [(r.doc_id, r.lang_pred) for r in op4.language_id(docs, model).collect()]
    assert got == [(1, "en"), (2, "de"), (3, "en"), (4, "und"), (6, "und"), (7, "und"), (8, "en"), (8, "en"), (None, "de")]
    none = op4.train(frame(spark, []), "doc_id", "text", "lang")
    assert [(r.lang_pred, r.score) for r in op4.language_id(docs.limit(1), none).collect()] == [("und", 0.0)]
    assert op4.language_id(frame(spark, []), model).collect() == []


def test_language_matrix_is_multinomial_bayes(spark):
    docs = frame(spark, [(1, "aab", "x"), (2, "bc", "y")])
    langs, matrix = op4.train(docs, "doc_id", "text", "lang")
    for lang, text, row in zip(langs, ["aab", "bc"], matrix, strict=True):
        found, n, _ = op4.grams([text])
        counts = np.bincount(np.concatenate(found), minlength=op4.BUCKETS) + 0.5
        assert np.allclose(row, np.log(counts / counts.sum()), atol=1e-5), lang
        assert n[0] == len(text) + 2  # a space before and after


def test_g711_and_adpcm_rules():
    u, a = op8.TABLES[op8.MULAW], op8.TABLES[op8.ALAW]
    assert (u[0], u[127], u[128], u[255]) == (-32124, 0, 32124, 0) and (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    assert len(set(u.tolist())) == 255 and len(set(a.tolist())) == 256
    rng = np.random.default_rng(0)
    block = 36
    raw = rng.integers(0, 256, 5 * block, dtype=np.uint8).tobytes()
    out = []
    for k in range(5):  # one sample after another
        own = raw[k * block : (k + 1) * block]
        value, index = int.from_bytes(own[:2], "little", signed=True), min(own[2], 88)
        out.append(value)
        for byte in own[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(op8.IMA_STEPS[index])
                change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - change if code & 8 else value + change))
                index = max(0, min(88, index + int(op8.IMA_MOVES[code & 7])))
                out.append(value)
    assert op8.decode_ima(raw, block).tolist() == out
    assert op8.resample(np.array([0, 10, 20], np.int16), 8000, 16000).tolist() == [0, 5, 10, 15, 20, 20]
    assert op8.resample(np.array([0, 30, 60, 90], np.int16), 8000, 6000).tolist() == [0, 40, 80]


def test_media_decoding(spark):
    raw = bytes(range(256))
    pcm = np.arange(-5, 5, dtype="<i2").tobytes()
    rows = [(1, op8.wav(raw, op8.MULAW, 8000, 8)), (2, op8.wav(raw, op8.ALAW, 8000, 8)), (3, op8.wav(raw + bytes(32), op8.IMA, 8000, 4, 36)), (4, op8.wav(pcm, op8.PCM, 16000, 16)), (5, None), (6, b"junk"), (7, op8.wav(b"", op8.MULAW, 8000, 8))]
    got = {r.doc_id: r for r in op8.decode_media(spark.createDataFrame(rows, "doc_id long, media binary"), "doc_id", "media").collect()}
    for k, samples in ((1, op8.TABLES[op8.MULAW]), (2, op8.TABLES[op8.ALAW]), (3, op8.decode_ima(raw + bytes(32), 36))):
        tag, rate, block, data = op8.read_wav(bytes(got[k].pcm))
        assert (tag, rate, block) == (op8.PCM, 16000, 2)
        assert np.frombuffer(data, "<i2")[::2].tolist() == samples.tolist()
    assert op8.read_wav(bytes(got[4].pcm))[3] == pcm
    assert got[5].pcm is None and got[6].feature is None and "n=0" in got[7].feature


def test_audio_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op8.op8_telephony_audio(spark, sf_dir).collect()
    small = op8.text_audio(frame(spark, [(-1, None), (-2, ""), (-2, ""), (-3, "é" * 288), (-4, "a" * 577)])).collect()
    docs |= {-1: "", -2: "", -3: "é" * 288, -4: "a" * 577}
    for r in rows + small:
        raw = docs[r.doc_id].encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        media = op8.wav(payload, op8.MULAW, 8000, 8)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert op8.text_audio(frame(spark, [])).collect() == []


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
<div id="cookie-notice">We use cookies, many.</div><div class="wrap"><div class="content"><h1>Title &amp; more</h1><p>One, two,&nbsp;three <b>bo</b>ld<br>next.
<p>Second paragraph, with a <a href="x">link</a>, and commas, of some length so that it counts.<script>var a="</p><p>no";</script></div>
<div class="comments"><p>Reader says, a lot, of things, with, many, commas, and so on and on and on.</p></div>
<aside>Side, bar, text, with, commas</aside><form>Search</form></div><div class="ad">Buy, now, this</div><footer>&copy; foot</footer></body></html>"""


def test_main_text():
    assert op10.main_text(PAGE) == "Title & more One, two, three bold next. Second paragraph, with a link, and commas, of some length so that it counts."
    assert op10.main_text("<article><h1>A&amp</h1><p><b>x<br><p>y</p></article><footer>f</footer>") == "A& x y"
    assert op10.main_text("") == "" and op10.main_text("<p>") == "" and op10.main_text("plain < text") == "plain < text"
    assert op10.main_text("<div>a</div>" * 3) == "a a a"
    assert op10.main_text("<article><p>one</p><div class='comment-list'>no</div><ul><li>a<li>b</ul><table><tr><td>1<td>2</table></article>") == "one a b 1 2"
    assert op10.main_text("<p title='a>b'>x</p><!-- <p>no</p> --><p>y") == "x y"


def test_deep_and_long_pages_take_linear_time():
    assert op10.main_text("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    assert len(op10.main_text("<p>" + "word, " * 200_000)) == 6 * 200_000 - 1
    assert op10.main_text("<a '" * 5000 + "x").endswith("x")


def test_pages_query(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = op10.op10_html_text(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    import html

    for r in rows:  # these pages hold one article each
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        expected = " ".join(html.unescape(re.sub(r"<[^>]*>", "\0", article)).replace("\0", " ").split())
        assert r.text == expected and r.n_chars == len(expected) and r.url == pages[r.page_id].url
    empty = spark.createDataFrame([(1, "u", None, "z"), (1, "u", None, "z")], "page_id long, url string, html string, text string")
    assert [(r.page_id, r.text, r.n_chars) for r in op10.html_text(empty).collect()] == [(1, "", 0)] * 2
    assert op10.html_text(empty.limit(0)).collect() == []
