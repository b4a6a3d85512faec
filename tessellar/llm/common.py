"""What the training-data operators share: reading, bounded text slices, written intermediates."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a Python worker turns into Python objects at once.
SLICE_BYTES = 1 << 19


#: Bytes and rows that the JVM hands a Python worker at once.
BATCH_BYTES, BATCH_ROWS = 2 << 20, 2_000


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes: each is held by the JVM and by the worker, several times over.

    A lower setting of the session stays.
    """
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in a local session that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tessellar-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


_scopes: list[list[DataFrame]] = []


def written(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts lineage and survives lost executors."""
    small_batches(spark)
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    if _scopes:
        _scopes[-1].append(out)
    return out


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Forgets at its end what was written within, but for tables taken out of the list that it gives."""
    _scopes.append([])
    try:
        yield _scopes[-1]
    finally:
        for df in _scopes.pop():
            forget(spark, df)


def sample_bound(n: int, most: int) -> int:
    """The signed 64-bit hash under which lie `most` of n evenly hashed rows, for any n; all of them if n <= most."""
    return max(-(1 << 63) + (most << 64) // n - 1, -(1 << 63)) if n > most else (1 << 63) - 1


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Deletes what written() wrote, once nothing reads it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def slices(batch: pa.RecordBatch, column: int, budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of the batch with at most budget bytes of text each, or one row."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + budget, "right")))
        yield batch.slice(at, to - at)
        at = to


_owner: list = [None, None]


def claim(owner: str, drop: Callable[[], None]) -> None:
    """Makes owner the one operator whose caches this worker process holds.

    Workers outlive stages: without this each stage's caches would stay beside the next one's.
    """
    if _owner[0] == owner:
        return
    if _owner[0] is not None:
        _owner[1]()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)
    _owner[:] = owner, drop


def texts_of(batch: pa.RecordBatch, column: int) -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of flat[s : s + n] over all (s, n)."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]
