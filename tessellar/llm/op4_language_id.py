"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, everything that isn't a letter becomes one space, and the 1- to 3-grams of
what is left are hashed into a fixed number of buckets. Training counts buckets by language in the
executors; the driver gets languages x buckets sums, turns them into a matrix of log probabilities
and broadcasts it. Scoring gathers the matrix at the hashes of a whole batch and sums by document;
only the text crosses to Python, all other columns stay where they are.

Training uses only rows with a language whose crc32(id) mod 5 isn't 0, and of those a sample of
about TRAIN_ROWS whole texts, chosen by a hash of the id (a documented bound; scoring has none). An empty
sample of labelled rows is an error, never an empty model.

The score says which language is likelier than the others; `fit`, the mean log probability of a gram
under the predicted one, says whether the text looks like any learned language at all.

Defined cases: null text, or text without a letter, is `und` with score 0 and no fit; without training
rows everything is `und`, and an empty table gives an empty result; ties go to the alphabetically first
language; a very long text is scored whole, like any other; a row without id is neither held out nor
trained on; repeated rows give repeated rows; other columns are ignored, whatever their names, but one
to be carried under a name of the result is refused. More than MOST_LANGUAGES languages are
refused, since the matrix is broadcast.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.llm.common import sample_bound, slices, table, texts_of

BUCKETS = 1 << 16
GRAMS = 3
#: About so many labelled rows are learned from, of all languages together.
TRAIN_ROWS = 20_000
UNKNOWN = "und"
#: The matrix is broadcast: at most 4 * BUCKETS * MOST_LANGUAGES bytes (64 MB).
MOST_LANGUAGES = 256
_FACTORS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter; built once in a process."""
    if not _letters:
        _letters.append(np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Buckets of the 1-, 2- and 3-grams that start at each kept letter or space; the number kept of
    each text, and its number of letters. Grams don't cross texts: each text starts and ends with
    GRAMS spaces, and its last ones are kept as what follows, not as what starts a gram."""
    pad = " " * GRAMS
    lowered = [pad + t.lower() + pad for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in lowered], np.int64)
    is_letter = letters()[codes]
    codes = np.where(is_letter, codes, np.uint32(0))
    kept = is_letter.copy()
    kept[1:] |= is_letter[:-1]  # a space only after a letter
    kept[0] = True
    starts = np.cumsum(sizes) - sizes
    kept[starts] = True  # and one in front
    begins = kept.copy()
    for k in range(1, GRAMS):
        kept[starts + sizes - k] = True
        begins[starts + sizes - k] = False
    n_letters = np.add.reduceat(is_letter, starts, dtype=np.int64)
    n_kept = np.add.reduceat(begins, starts, dtype=np.int64)
    codes, begins = codes[kept], begins[kept]
    out = []
    mixed = np.zeros(len(codes), np.uint32)
    for n in range(GRAMS):
        shifted = np.zeros_like(codes)
        shifted[: len(codes) - n] = codes[n:] + np.uint32(1)
        mixed = mixed * np.uint32(0x01000193) ^ shifted * _FACTORS[n]
        out.append(((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16))[begins].astype(np.int64))
    return out, n_kept, n_letters


def counted(labelled: DataFrame, text_col: str, lang_col: str) -> dict[str, np.ndarray]:
    """Bucket counts of each language, summed before they leave a task."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, 0):
                langs = np.array(part.column(1).to_pylist(), object)
                found, n_kept, _ = grams(texts_of(part, 0))
                of = np.repeat(np.arange(len(langs)), n_kept)
                for lang in set(langs):
                    own = (langs == lang)[of]
                    for g in found:
                        sums[lang] = sums.get(lang, 0) + np.bincount(g[own], minlength=BUCKETS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])

    out: dict[str, np.ndarray] = {}
    n_langs = labelled.select(lang_col).distinct().limit(MOST_LANGUAGES + 1).count()
    if n_langs > MOST_LANGUAGES:
        raise ValueError(f"{lang_col} holds more than {MOST_LANGUAGES} languages")
    summed = labelled.select(text_col, lang_col).mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = summed.toArrow()  # at most languages x BUCKETS
    for lang, bucket, n in zip(rows["lang"].to_pylist(), rows["bucket"].to_numpy(), rows["n"].to_numpy(), strict=True):
        out.setdefault(lang, np.zeros(BUCKETS, np.int64))[bucket] = n
    return out


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, train_rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and their (languages x BUCKETS) matrix of log probabilities."""
    key = F.col(id_col).cast("string")
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.crc32(key) % 5 != 0))
    n = labelled.select(id_col).count()
    sums = counted(labelled.where(F.xxhash64(key) <= F.lit(sample_bound(n, train_rows))), text_col, lang_col)
    langs = sorted(sums)
    if n and not langs:
        raise ValueError(f"no row of {n} labelled ones is in the sample of about {train_rows}: are their ids the same?")
    if not langs:
        return [], np.zeros((0, BUCKETS), np.float32)
    counts = np.stack([sums[x] for x in langs]) + 0.5
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def language_id(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (id_col if None), lang_pred, score (the posterior with evidence tempered by
    the root of its length) and fit."""
    carry = [id_col] if carry is None else carry
    if clash := {"lang_pred", "score", "fit"}.intersection(carry):
        raise ValueError(f"{sorted(clash)} are names of the result: rename what is to be carried")
    langs, matrix = model
    shared = docs.sparkSession.sparkContext.broadcast(matrix)  # at most MOST_LANGUAGES x BUCKETS floats
    names = ["lang_pred", "score", "fit"]

    def part_of(texts: list[str]) -> list[pa.Array]:
        found, n_kept, n_letters = grams(texts)
        starts = np.cumsum(n_kept) - n_kept
        known = (n_letters > 0) & bool(langs)
        pred, score, fit = np.full(len(n_kept), UNKNOWN, object), np.zeros(len(n_kept)), np.zeros(len(n_kept))
        if known.any():
            total = np.stack([sum(np.add.reduceat(row[g], starts, dtype=np.float64) for g in found) for row in shared.value])
            best, most = total.argmax(axis=0), total.max(axis=0)
            odds = np.exp((total - most) / np.sqrt(n_kept))
            pred[known] = np.array(langs, object)[best[known]]
            score[known] = (odds.max(axis=0) / odds.sum(axis=0))[known]
            fit[known] = (most / (GRAMS * n_kept))[known]
        return [pa.array(pred, pa.string()), pa.array(score), pa.array(fit, mask=~known)]

    @F.arrow_udf("lang_pred string, score double, fit double")
    def scores(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        parts = [pa.StructArray.from_arrays(part_of(texts_of(part, 0)), names) for part in slices(batch, 0)]
        return pa.concat_arrays(parts) if parts else pa.StructArray.from_arrays(part_of([""]), names)[:0]

    # as if not deterministic: else a filter on the result would evaluate it once more
    scored = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(carry)), scores.asNondeterministic()(F.col(text_col).cast("string")).alias("found"))
    return scored.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(carry)), *(F.col(f"found.{n}") for n in names))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id(docs, train(docs, "doc_id", "text", "lang"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "fit")
