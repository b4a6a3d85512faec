"""Every stored form of a text against decoders that go sample by sample, and its PCM file."""

import zlib

import numpy as np

from tessellar.llm import op8_telephony_audio as op8
from tests.llm.test_whole_audio import by_sample


def mulaw(byte):
    byte = ~byte & 255
    size = ((byte & 15) * 8 + 132) * 2 ** (byte >> 4 & 7) - 132
    return -size if byte & 128 else size


def alaw(byte):
    byte ^= 0x55
    part, step = byte >> 4 & 7, byte & 15
    size = step * 16 + 8 if part == 0 else (step * 16 + 264) * 2 ** (part - 1)
    return size if byte & 128 else -size


def feature(samples):
    out = []
    for x, y in zip(samples, [*samples[1:], samples[-1]], strict=True):
        out += [x, (x + y) // 2]
    rms = (sum(x * x for x in out) / len(out)) ** 0.5
    crossings = sum((x < 0) != (y < 0) for x, y in zip(out, out[1:], strict=False))
    crc = zlib.crc32(b"".join(x.to_bytes(2, "little", signed=True) for x in out))
    return f"rate=16000;n={len(out)};rms={rms:.3f};peak={max(map(abs, out))};crossings={crossings};crc32={crc}", out


def test_features_of_all_forms(spark):
    rows = [(1, "Some text, é."), (2, None), (3, "x" * 576), (4, "many words " * 120), (4, "many words " * 120), (None, "no id")]
    got = op8.text_audio(spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, pcm string")).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for k, t in rows if k == r.doc_id) or ""
        _, payload = op8.payload_of(text)
        expected, pcm = feature([mulaw(b) for b in payload])
        assert r.feature == expected
        assert r.alaw_feature == feature([alaw(b) for b in payload])[0]
        assert r.adpcm_feature == feature(by_sample(payload, 144))[0]
        tag, rate, block, data = op8.read_wav(bytes(r.pcm))
        assert (tag, rate, block) == (op8.PCM, 16000, 2) and np.frombuffer(data, "<i2").tolist() == pcm


def test_very_long_text(spark):
    got = op8.text_audio(spark.createDataFrame([(1, "word " * 400_000)], "doc_id long, text string")).first()
    assert got.n_bytes == 2_000_000 and got.payload_bytes == 2_000_448
