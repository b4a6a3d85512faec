"""Token counts by heap-and-linked-list byte-pair merging.

A word starts as one symbol a byte. A heap holds the mergeable adjacent pairs by rank; the lowest
is popped and merged until none is left, so a word's count is its symbols less its merges, and no
identifier is emitted. Words are counted once and kept in a bounded cache. Null text counts as
empty: 0 bytes, 0 tokens. A very long text is counted whole; of pairs with equal rank the leftmost merges
first; repeated rows give repeated rows; an empty table gives an empty result; other columns are ignored,
whatever their names. Map-only: no shuffle, memory bounded by one slice of text and the cache.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.llm import word_bpe
from tessellar.llm.common import slices, table, texts_of


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, path: str | None = None) -> DataFrame:
    """id_col, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row."""
    path = path or word_bpe.default_path()

    def run(batches):
        counts = word_bpe.loaded(word_bpe.PieceCounts, path)
        for batch in batches:
            for part in slices(batch, 1):
                counts.trim()
                texts = texts_of(part, 1)
                n = np.fromiter(map(counts.count, texts), np.int64, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n)], ["id", "n_bytes", "n_tokens"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    out = source.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
