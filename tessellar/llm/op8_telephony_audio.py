"""Telephony audio columns: G.711 and ADPCM decoding to resampled PCM.

Mu-law and A-law bytes are expanded through 256-entry tables made from the coding rule. IMA ADPCM
blocks all have one length but the last of a recording, which may be shorter, so numpy steps through the
samples of a block with every block of a slice of recordings side by side. PCM is resampled by linear
interpolation in integers and stored as WAV.

`decode_media` decodes recordings of any of these formats. `text_audio` stores the bytes of texts in
each of the three coded formats, reads every file back, decodes it and gives the digests of the first
(mu-law), its PCM file and the features of all three.

Defined cases: null or unreadable media has null results; null text is empty, one unit of filling; silence
(no samples) has zero features; a very long text is one recording, held a few times over by its task;
repeated rows give repeated rows, equal texts equal values; an empty table gives an empty result; other
columns are ignored, whatever their names. Map-only: no shuffle, memory bounded by one slice of media.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.llm.common import SLICE_BYTES, slices, table, texts_of

PCM, ALAW, MULAW, IMA = 1, 6, 7, 17
RATE, STORED_RATE = 8000, 16000
#: The payload's unit in bytes and the byte that fills it up; fixed values of the query.
UNIT, FILL = 576, 255


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 255
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    part, step = code >> 4 & 7, (code & 15) << 4
    size = np.where(part == 0, step + 8, step + 264 << np.maximum(part - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}
# Fixed values of IMA ADPCM: step sizes and how a code moves between them.
IMA_STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767])
IMA_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8])


def decode_ima(data: bytes, block: int) -> np.ndarray:
    """Mono IMA ADPCM: blocks of a 4-byte header (first sample, step index) and 4-bit codes, low first.

    A shorter last block is decoded by itself; less than a header holds no sample.
    """
    raw = np.frombuffer(data, np.uint8)
    whole = len(raw) // block * block
    if whole < len(raw):
        rest = decode_ima(data[whole:], len(raw) - whole) if len(raw) - whole >= 4 else np.empty(0, np.int16)
        return np.concatenate([decode_ima(data[:whole], block), rest])
    raw = raw.reshape(-1, block)
    value = (raw[:, 0] | raw[:, 1].astype(np.int32) << 8).astype(np.int16).astype(np.int32)
    index = np.minimum(raw[:, 2], 88).astype(np.int32)
    codes = np.empty((len(raw), 2 * (block - 4)), np.int32)
    codes[:, ::2], codes[:, 1::2] = raw[:, 4:] & 15, raw[:, 4:] >> 4
    out = np.empty((len(raw), codes.shape[1] + 1), np.int16)
    out[:, 0] = value
    for k in range(codes.shape[1]):  # one step for all blocks at once
        code, step = codes[:, k], IMA_STEPS[index]
        change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + IMA_MOVES[code & 7], 0, 88)
        out[:, k + 1] = value
    return out.ravel()


def wav(data: bytes, tag: int, rate: int, bits: int, block: int | None = None) -> bytes:
    """A mono WAV file."""
    block = block or bits // 8
    extra = b"" if tag == PCM else struct.pack("<H", 0) if tag != IMA else struct.pack("<HH", 2, 2 * (block - 4) + 1)
    head = struct.pack("<HHIIHH", tag, 1, rate, rate * block if tag != IMA else rate // 2, block, bits) + extra
    rest = len(data) % block
    samples = len(data) if tag != IMA else len(data) // block * (2 * (block - 4) + 1) + (2 * (rest - 4) + 1 if rest >= 4 else 0)
    fact = b"" if tag == PCM else b"fact" + struct.pack("<II", 4, samples)
    body = b"WAVEfmt " + struct.pack("<I", len(head)) + head + fact + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[int, int, int, bytes] | None:
    """(format tag, rate, bytes of a block, sample bytes) of a mono file; None if it isn't one."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt " and size >= 16 and at + 24 <= len(media):
            tag, channels, rate, _, block, _ = struct.unpack_from("<HHIIHH", media, at + 8)
            form = (tag, rate, block) if channels == 1 else None
        elif name == b"data":
            return (*form, media[at + 8 : at + 8 + size]) if form else None
        at += 8 + size + size % 2
    return None


def expand(tag: int, block: int, data: bytes) -> np.ndarray | None:
    """16-bit samples; None for an unknown format."""
    if tag in TABLES:
        return TABLES[tag][np.frombuffer(data, np.uint8)]
    if tag == IMA and block > 4:
        return decode_ima(data, block)
    if tag == PCM and block == 2:
        return np.frombuffer(data[: len(data) // 2 * 2], "<i2")
    return None


def resample(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation in integers; the last sample is held."""
    n = len(samples)
    if rate == to or not n:
        return samples
    ahead = np.append(samples[1:], samples[-1:]).astype(np.int32)
    if to % rate == 0:  # upsampling by a whole factor needs no index arithmetic
        times = to // rate
        out = np.empty((n, times), np.int16)
        base = samples.astype(np.int32)
        for k in range(times):
            out[:, k] = (base * (times - k) + ahead * k) // times
        return out.ravel()
    at = np.arange(n * to // rate, dtype=np.int64) * rate
    i, part = at // to, at % to
    return ((samples[i] * (to - part) + ahead[i] * part) // to).astype(np.int16)


def features(samples: np.ndarray, rate: int) -> str:
    """Rate, length, root mean square, peak and zero crossings of the stored PCM, and its checksum."""
    if not len(samples):
        return f"rate={rate};n=0;rms=0.000;peak=0;crossings=0;crc32=0"
    wide = samples.astype(np.float64)
    negative = samples < 0
    return f"rate={rate};n={len(samples)};rms={np.sqrt(np.dot(wide, wide) / len(wide)):.3f};peak={max(int(samples.max()), -int(samples.min()))};crossings={np.count_nonzero(negative[1:] != negative[:-1])};crc32={zlib.crc32(samples.astype('<i2').tobytes())}"


def decode_media(media: DataFrame, id_col: str, media_col: str, rate: int = STORED_RATE) -> DataFrame:
    """id_col, pcm (a 16-bit WAV at the given rate) and feature of every recording."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                pcm, feature = [], []
                files = [read_wav(raw) if raw is not None else None for raw in part.column(1).to_pylist()]
                decoded = iter(decode_all([f for f in files if f]))
                for found in files:
                    samples = next(decoded) if found else None
                    if samples is not None:
                        samples = resample(samples, found[1], rate)
                    pcm.append(None if samples is None else wav(samples.astype("<i2").tobytes(), PCM, rate, 16))
                    feature.append(None if samples is None else features(samples, rate))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pcm, pa.binary()), pa.array(feature, pa.string())], ["id", "pcm", "feature"])

    source = media.select(F.col(id_col).alias("id"), F.col(media_col).cast("binary").alias("media"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, pcm binary, feature string").withColumnRenamed("id", id_col)


def payload_of(text: str) -> tuple[int, bytes]:
    raw = text.encode()
    return len(raw), raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, bytes([FILL]))


def decode_all(files: list[tuple[int, int, int, bytes]]) -> list[np.ndarray | None]:
    """16-bit samples of files as read_wav gives them; ADPCM files of whole, equal blocks are decoded side by side."""
    out: list[np.ndarray | None] = [None] * len(files)
    together: dict[int, list[int]] = {}
    for i, (tag, _, block, data) in enumerate(files):
        if tag == IMA and block > 4 and len(data) % block == 0:
            together.setdefault(block, []).append(i)
        else:
            out[i] = expand(tag, block, data)
    for block, own in together.items():
        samples = decode_ima(b"".join(files[i][3] for i in own), block)
        ends = np.cumsum([len(files[i][3]) // block * (2 * (block - 4) + 1) for i in own])
        for i, part in zip(own, np.split(samples, ends[:-1]), strict=True):
            out[i] = part
    return out


#: Format, bits of a sample and bytes of a block of the forms in which a payload is stored; UNIT is a whole number of blocks.
FORMS = {"mulaw": (MULAW, 8, 1), "alaw": (ALAW, 8, 1), "adpcm": (IMA, 4, UNIT // 4)}


def text_audio(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = STORED_RATE) -> DataFrame:
    """Stores every text as mu-law, A-law and ADPCM audio and reads it back: digests of payload and
    mu-law file, the features of each decoded form (`feature` of mu-law), and mu-law's PCM file."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES // 4):  # PCM takes twelve times the text
                sizes, payloads = zip(*map(payload_of, texts_of(part, 1)), strict=True)
                stored = {name: [wav(p, tag, RATE, bits, block) for p in payloads] for name, (tag, bits, block) in FORMS.items()}
                files = {name: list(map(read_wav, own)) for name, own in stored.items()}
                pcm = {name: [resample(x, f[1], rate) for x, f in zip(decode_all(own), own, strict=True)] for name, own in files.items()}
                media, data = stored["mulaw"], [f[3] for f in files["mulaw"]]
                columns = [
                    pa.array(sizes, pa.int64()),
                    pa.array(map(len, data), pa.int64()),
                    pa.array([hashlib.sha256(d).hexdigest() for d in data]),
                    pa.array([zlib.crc32(d[-32:]) for d in data], pa.int64()),
                    pa.array(map(len, media), pa.int64()),
                    pa.array([hashlib.sha256(m).hexdigest() for m in media]),
                    *(pa.array([features(x, rate) for x in pcm[name]]) for name in FORMS),
                    pa.array([wav(x.astype("<i2").tobytes(), PCM, rate, 16) for x in pcm["mulaw"]], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["id", *names])

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "alaw_feature", "adpcm_feature", "pcm"]
    kinds = ["long", "long", "string", "long", "long", "string", "string", "string", "string", "binary"]
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, " + ", ".join(map(" ".join, zip(names, kinds, strict=True)))).withColumnRenamed("id", id_col)


def op8_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_audio(table(spark, sf_dir, "documents"))
