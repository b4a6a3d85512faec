"""No sample of a recording is left out."""

import struct

import numpy as np

from tessellar.llm import op8_telephony_audio as op8


def by_sample(raw, block):
    out = []
    for at in range(0, len(raw), block):
        own = raw[at : at + block]
        if len(own) < 4:
            break
        value, index = int.from_bytes(own[:2], "little", signed=True), min(own[2], 88)
        out.append(value)
        for code in (c for byte in own[4:] for c in (byte & 15, byte >> 4)):
            step = int(op8.IMA_STEPS[index])
            change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - change if code & 8 else value + change))
            index = max(0, min(88, index + int(op8.IMA_MOVES[code & 7])))
            out.append(value)
    return out


def test_short_last_adpcm_block(spark):
    raw = np.random.default_rng(1).integers(0, 256, 200, dtype=np.uint8).tobytes()
    for n in (0, 2, 4, 5, 35, 36, 37, 72, 75, 76, 77, 100, 107, 108):
        assert op8.decode_ima(raw[:n], 36).tolist() == by_sample(raw[:n], 36), n
    media = op8.wav(raw[:101], op8.IMA, 8000, 4, 36)
    samples = by_sample(raw[:101], 36)
    assert struct.unpack_from("<I", media, media.index(b"fact") + 8)[0] == len(samples) == 2 * 65 + 51
    got = op8.decode_media(spark.createDataFrame([(1, media)], "doc_id long, media binary"), "doc_id", "media").first()
    assert np.frombuffer(op8.read_wav(bytes(got.pcm))[3], "<i2")[::2].tolist() == samples
