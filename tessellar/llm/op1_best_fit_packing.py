"""Best-two-fit packing of documents into fixed-length token sequences.

Only lengths decide how to pack, and there are at most `capacity` of them, so the whole corpus is
packed from one histogram: the driver holds `capacity` counters however large the input. Each bin
starts with the longest piece left and is filled greedily with the longest that fits; then its
smallest piece is replaced by two unpacked ones that fit the expanded gap more tightly. A filled
bin is applied as often as the counters allow before the next is searched, so the number of
distinct bins is bounded by the lengths as well. Executors then hand every piece its place: its
rank among the pieces of its length says which bin takes it.

Hot lengths are ranked in salted parts (a window over a bounded number of rows), never in one task.

Defined cases: null text is empty (a single end token, a piece of length 1); a document longer than
the capacity is cut into full pieces and a rest; of pieces of equal length the smaller id takes the
earlier place, and of pairs that fit equally well the one with the shorter first; repeated rows are packed
as often as they come; an empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessellar.llm import word_bpe
from tessellar.llm.common import slices, table, texts_of, written

CAPACITY = 2048
#: Pieces that are ranked together in one window partition, on average.
RANKED_TOGETHER = 500


def pack_histogram(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """[(lengths in one bin, number of such bins)] that use up counts[length]."""
    counts = counts.astype(np.int64).copy()
    present = np.flatnonzero(counts)
    out = []
    while len(present):
        bin_: list[int] = []
        gap = capacity
        while len(present):  # greedily, the longest that fits
            k = int(np.searchsorted(present, gap, "right")) - 1
            if k < 0:
                break
            length = int(present[k])
            take = min(gap // length, int(counts[length]))
            bin_ += [length] * take
            gap -= take * length
            counts[length] -= take
            if not counts[length]:
                present = np.delete(present, k)
        while gap and len(bin_) > 1:  # two for the smallest, if tighter
            small = bin_[-1]
            pair = best_two(counts, present, gap + small, small)
            if pair is None:
                break
            counts[small] += 1
            for x in pair:
                counts[x] -= 1
            bin_ = sorted([*bin_[:-1], *pair], reverse=True)
            gap += small - sum(pair)
            present = np.flatnonzero(counts)
        lengths, need = np.unique(bin_, return_counts=True)
        again = int((counts[lengths] // need).min())
        counts[lengths] -= need * again
        out.append((bin_, 1 + again))
        present = np.flatnonzero(counts)
    return out


def best_two(counts: np.ndarray, present: np.ndarray, room: int, more_than: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum in (more_than, room]."""
    a = present[present < room]
    if not len(a):
        return None
    k = np.searchsorted(present, room - a, "right") - 1
    same = (k >= 0) & (present[np.maximum(k, 0)] == a) & (counts[a] < 2)
    k = np.where(same, k - 1, k)
    b = np.where(k >= 0, present[np.maximum(k, 0)], -capacity_like(room))
    best = int(np.argmax(a + b))
    if k[best] < 0 or a[best] + b[best] <= more_than:
        return None
    return int(max(a[best], b[best])), int(min(a[best], b[best]))


def capacity_like(room: int) -> int:
    return 4 * room + 4


def runs_of(bins: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first rank, number, first sequence, offset), by length and rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, times in bins:
        offset = 0
        for x in lengths:
            rows.append((x, used.get(x, 0), times, sequence, offset))
            used[x] = used.get(x, 0) + times
            offset += x
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, end_id: int, path: str) -> DataFrame:
    """Token pieces of every document, tokenised once and never longer than capacity."""

    def run(batches):
        ids_of = word_bpe.loaded(word_bpe.PieceIds, path)
        for batch in batches:
            for part in slices(batch, 1):
                row, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(ids_of.encode(texts_of(part, 1))):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        own = ids[at : at + capacity]
                        row.append(i)
                        piece.append(k)
                        start.append(at)
                        length.append(len(own))
                        crc.append(zlib.crc32(own.tobytes()))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit_packing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Every piece with its sequence_id and offset; see the module."""
    spark = docs.sparkSession
    cut = written(spark, pieces(docs, id_col, text_col, capacity, end_id, path or word_bpe.default_path()), "packing")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in cut.groupBy("length").count().collect():  # at most `capacity` rows
        counts[length] = n
    runs = runs_of(pack_histogram(counts, capacity))
    # a row for each length: at most `capacity`
    salts = spark.createDataFrame([(length, 1 + int(counts[length]) // RANKED_TOGETHER) for length in range(1, capacity + 1)], "length long, salts int")
    salted = cut.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("id", "piece", "start"), F.col("salts")).cast("int"))
    by_length = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    # a row for about RANKED_TOGETHER pieces of a frequent length
    before = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(by_length), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")
    ranked = salted.withColumn("place", F.row_number().over(within) - 1).join(before, ["length", "salt"])

    key = runs[:, 0] << 44 | runs[:, 1]  # ranks stay below 2**44

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
            k = np.searchsorted(key, length << 44 | rank, "right") - 1
            found = runs[k] if len(runs) else np.zeros((0, 5), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(found[:, 3] + rank - found[:, 1]), pa.array(found[:, 4])], [*batch.schema.names[:5], "sequence_id", "offset"])

    kind = cut.schema["id"].dataType.simpleString()
    placed = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("place") + F.col("before")).alias("rank")).mapInArrow(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumnRenamed("id", id_col)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))
