"""Upserts as merged states: the new table is computed and written beside the old one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def differs(columns: list[str], a: str = "o", b: str = "n") -> Column:
    """IS DISTINCT FROM on any column."""
    out = F.lit(False)
    for c in columns:
        out |= ~F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The merged state with an outcome: inserted, updated, unchanged, kept (not in the new rows)."""
    both = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    has_old, has_new = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()
    outcome = F.when(~has_old, "inserted").when(~has_new, "kept").when(differs(columns), "updated").otherwise("unchanged")
    return both.select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), *(F.when(has_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in columns), outcome.alias("outcome"))


def upsert_chunks(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Chunks by key: a changed content hash drops the embedding and makes it pending, an equal one keeps it."""
    both = new.alias("n").join(old.alias("o"), F.col(f"o.{key}") == F.col(f"n.{key}"), "left")
    same = F.col("o.content_hash").eqNullSafe(F.col("n.content_hash"))
    kept = lambda c: F.when(same, F.col(f"o.{c}")).alias(c)
    return both.select(F.col(f"n.{key}").alias(key), "n.content_hash", kept("embedding"), kept("embedding_error"), F.when(same, F.col("o.embedding_status")).otherwise("pending").alias("embedding_status"))


def merge_crawled(old: DataFrame, new: DataFrame, key: str, columns: list[str], now: Column) -> DataFrame:
    """Blank or [] never overwrites; first_seen stays; updated_at moves only on a change."""
    both = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    has_old = F.col(f"o.{key}").isNotNull()
    blank = lambda c: F.col(f"n.{c}").isNull() | F.trim(F.col(f"n.{c}")).isin("", "[]")
    merged = {c: F.when(blank(c), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")) for c in columns}
    changed = F.lit(False)
    for c in columns:
        changed |= ~merged[c].eqNullSafe(F.col(f"o.{c}"))
    state = F.when(~has_old, "new").when(F.col(f"n.{key}").isNull(), "kept").when(changed, "updated").otherwise("duplicate")
    return both.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *(v.alias(c) for c, v in merged.items()), F.coalesce("o.first_seen", now).alias("first_seen"), F.when(has_old & ~changed, F.col("o.updated_at")).otherwise(now).alias("updated_at"), state.alias("state"))


def merge_hits(hits: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Best score and rank, longest match text, first group; ties keep the earlier row."""
    return hits.groupBy(*keys).agg(F.max("score").alias("score"), F.min("rank").alias("rank"), F.max_by("match", F.struct(F.length("match"), -F.col(seq))).alias("match"), F.min_by("grp", seq).alias("grp"))


def latest_runs(runs: DataFrame, keys: list[str], columns: list[str], order: list[str]) -> DataFrame:
    """The last write of each key."""
    last = F.max_by(F.struct(*columns), F.struct(*order))
    return runs.groupBy(*keys).agg(last.alias("last")).select(*keys, "last.*")


def activate(versions: DataFrame, approved: DataFrame) -> DataFrame:
    """Approved versions become active, other active ones of their documents superseded."""
    a = approved.select("document_id", F.col("version_id").alias("approved_id"))
    joined = versions.join(a, "document_id", "left")
    status = F.when(F.col("version_id") == F.col("approved_id"), "active").when((F.col("status") == "active") & F.col("approved_id").isNotNull(), "superseded").otherwise(F.col("status"))
    return joined.select("version_id", "document_id", status.alias("status"), F.coalesce(F.col("version_id") == F.col("approved_id"), F.lit(False)).alias("is_current"))


def table_difference(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Row counts of both sides, rows on one side only and cells that differ: one row."""
    both = a.alias("o").join(b.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    paired = F.col(f"o.{key}").isNotNull() & F.col(f"n.{key}").isNotNull()
    cells = sum((F.when(paired & ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), 1).otherwise(0) for c in columns), F.lit(0))
    return both.agg(F.count(f"o.{key}").alias("rows_a"), F.count(f"n.{key}").alias("rows_b"), F.count_if(F.col(f"n.{key}").isNull()).alias("only_a"), F.count_if(F.col(f"o.{key}").isNull()).alias("only_b"), F.sum(cells).alias("cells_differ"))


def backfill(chunks: DataFrame, embed, dimension: int, key: str = "chunk_id", text: str = "content", most: int = 500) -> DataFrame:
    """Embeds pending chunks, at most `most` a run, oldest keys first, one batch at a time: a batch is
    ready as a whole or failed as a whole, and blank texts are skipped. embed: list of texts -> list of vectors."""
    import pandas as pd

    def run(batches):
        for own in batches:
            texts = own["text"].fillna("")
            full = texts.str.strip() != ""
            status = pd.Series("skipped", own.index)
            vectors: list = [None] * len(own)
            try:
                found = embed(texts[full].tolist())
                if any(len(v) != dimension for v in found):
                    raise ValueError("dimension")
                for i, v in zip([i for i, f in enumerate(full) if f], found, strict=True):
                    vectors[i] = [float(x) for x in v]
                status[full] = "ready"
            except Exception:  # the embedder is the caller's: its failure is a state of the rows
                vectors = [None] * len(own)
                status[full] = "failed"
            yield pd.DataFrame({"key": own["key"], "embedding": vectors, "embedding_status": status})

    pending = chunks.where("embedding_status = 'pending'").orderBy(key).limit(most).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return pending.mapInPandas(run, "key long, embedding array<double>, embedding_status string").withColumnRenamed("key", key)
