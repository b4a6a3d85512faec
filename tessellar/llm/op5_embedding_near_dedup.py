"""Embedding near-dedup: int8 tile products with rigorous quantisation bounds.

Equal vectors are one class with a count. Classes are dealt into G blocks of bounded size and every
pair of blocks is one task, so no task holds more than two blocks however large a group of near
copies is. In a task each normalised vector x is quantised to s * q with integers |q| <= 127, and its
error e = |x - s q| is measured. Integer tile products are exact, and

    |cos(x, y) - s_x s_y (q_x . q_y)| <= e_y + e_x (1 + e_y),

so a tile's entries below threshold less the bound are dropped, those that reach the threshold even
less the bound are links, and only those in between are computed again in double precision. Tasks
return link counts and a spanning forest, never pairs.

All pairs of a set without structure have to be looked at once: work grows with the square of the
number of distinct vectors, a multiply-add for each pair and dimension (see the README for figures).

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows
without id, link with nothing (n_links 0, their own component); vectors of different lengths don't
link; repeated rows link with each other; a vector of very many dimensions is compared whole; of equal
candidates for a component's name the smallest id is taken; an empty table gives an empty result; other
columns are ignored, whatever their names. Classes are named by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.llm.common import forget, table, written
from tessellar.llm.components import components, looked_up

#: Vectors of one block at most, about; the least of one that is cut to keep all cores busy; rows of a tile.
BLOCK, LEAST_BLOCK, TILE = 8192, 1024, 1024
#: Pairs computed again at once.
AGAIN = 50_000
#: Rounding of a double-precision cosine stays below this.
ROUNDING = 1e-9


class Quantised:
    def __init__(self, x: np.ndarray):
        self.full = x.astype(np.float64)
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.full, self.full))
        unit = self.full / self.norm[:, None]
        self.scale = np.abs(unit).max(axis=1) / 127
        self.q = np.rint(unit / self.scale[:, None]).astype(np.int8)
        rest = unit - self.scale[:, None] * self.q
        self.error = np.sqrt(np.einsum("ij,ij->i", rest, rest)) + ROUNDING


def links_of(a: Quantised, b: Quantised, threshold: float, same: bool):
    """Yields arrays (i, j) of the pairs of rows with cosine >= threshold; with same, of i < j."""
    exact = np.float32 if a.q.shape[1] * 127 * 127 < 1 << 24 else np.float64  # holds the integer sums exactly
    right = b.q.astype(exact)
    for at in range(0, len(a.q), TILE):
        left = a.q[at : at + TILE].astype(exact)
        for to in range(at if same else 0, len(b.q), TILE):
            product = left @ right[to : to + TILE].T
            own, other = slice(at, at + TILE), slice(to, to + TILE)
            # no entry below this can reach the threshold, whatever its row and column
            slack = b.error[other].max() + a.error[own].max() * (1 + b.error[other].max())
            least = (threshold - slack) / (a.scale[own].max() * b.scale[other].max())
            i, j = np.nonzero(product >= least) if least > 0 else np.indices(product.shape).reshape(2, -1)
            value = product[i, j].astype(np.float64)
            i, j = i + at, j + to
            if same:
                keep = i < j
                i, j, value = i[keep], j[keep], value[keep]
            value *= a.scale[i] * b.scale[j]
            bound = b.error[j] + a.error[i] * (1 + b.error[j])
            sure = value - bound >= threshold
            maybe = np.flatnonzero(~sure & (value + bound >= threshold))
            for k in range(0, len(maybe), AGAIN):
                m = maybe[k : k + AGAIN]
                sure[m] = np.einsum("ij,ij->i", a.full[i[m]], b.full[j[m]]) / (a.norm[i[m]] * b.norm[j[m]]) >= threshold
            if sure.any():
                yield i[sure], j[sure]


def merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the components of i and j in labels (smallest member), all pairs at once."""
    while True:
        a, b = labels[i], labels[j]
        open_ = a != b
        if not open_.any():
            return
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := labels[labels], labels):
            labels[:] = up


def near_components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, block: int = BLOCK) -> DataFrame:
    """id_col, n_links, component_id and kept of every row."""
    spark = vectors.sparkSession
    v = F.col("v")
    sound = F.coalesce(F.col("id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"  # half the bytes; computed in double precision
    source = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"))
    source = source.withColumn("h", F.when(sound, F.xxhash64("v", F.size("v"))))
    kind = source.schema["id"].dataType.simpleString()
    classes = written(spark, source.where(F.col("h").isNotNull()).groupBy("h").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("v").alias("v")), "vectors")
    n_classes = classes.count()
    # pairs of blocks are tasks: at least two for each core, if there is work for them
    wanted = math.isqrt(4 * spark.sparkContext.defaultParallelism) + 1
    blocks = max(1, -(-n_classes // block), min(wanted, n_classes // LEAST_BLOCK))
    own = F.pmod(F.xxhash64("h"), F.lit(blocks)).cast("int")
    dealt = classes.select("h", "copies", "v", F.size("v").alias("d"), own.alias("own")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select("d", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "h", "copies", "v")

    def joined(key, parts: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(parts)
        d, x, y = key
        values = pa.compute.list_flatten(rows["v"]).to_numpy().reshape(-1, d)
        names, copies, of = (rows[c].to_numpy() for c in ("h", "copies", "own"))
        n = len(names)
        first, second = np.flatnonzero(of == x), np.flatnonzero(of == y)
        a = Quantised(values[first])
        b = a if x == y else Quantised(values[second])
        labels, links = np.arange(n), np.zeros(n, np.int64)
        for i, j in links_of(a, b, threshold, x == y):
            i, j = first[i], second[j]
            links += np.bincount(i, copies[j], n).astype(np.int64) + np.bincount(j, copies[i], n).astype(np.int64)
            merge(labels, i, j)
        at = np.flatnonzero(links)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(names[at]), pa.array(names[labels[at]]), pa.array(links[at])], ["h", "root", "links"])

    def run(batches):
        key, held = None, []
        for batch in batches:
            cells = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)])
            cuts = np.flatnonzero(np.any(cells[:, 1:] != cells[:, :-1], axis=0)) + 1
            for at, to in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if to == at:
                    continue
                now = tuple(int(c) for c in cells[:, at])
                if now != key:
                    if held:
                        yield from joined(key, held)
                    key, held = now, []
                held.append(batch.slice(at, to - at))
        if held:
            yield from joined(key, held)

    found = written(spark, dealt.repartition("d", "x", "y").sortWithinPartitions("d", "x", "y").mapInArrow(run, "h long, root long, links long"), "links")
    roots = components(spark, found.select("h", "root"))
    links = found.groupBy("h").agg(F.sum("links").alias("links"))
    named = classes.select("h", "least", "copies").join(links, "h", "left").join(roots.select(F.col("v").alias("h"), "r"), "h", "left")
    named = named.select("h", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("r", "h").alias("root"))
    named = written(spark, named, "named")
    names = written(spark, named.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    known = written(spark, looked_up(named, names, "root").select("h", "n_links", "component_id"), "named")
    for used in (found, roots, classes, named, names):
        forget(spark, used)
    out = looked_up(source.select("id", "h"), known, "h")
    component = F.coalesce("component_id", "id").cast(kind)
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "embeddings"))


#: Without null or broken vectors' components, which the tables don't hold; every pair, then reachability.
OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), pair AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach(x, y) AS (
  SELECT x, y FROM pair UNION SELECT r.x, p.y FROM reach r JOIN pair p ON r.y = p.x
), linked AS (SELECT x, count(*) AS n FROM pair GROUP BY x), least AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT v.vec_id, coalesce(l.n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(m.y, v.vec_id)) AS component_id,
       v.vec_id = least(v.vec_id, coalesce(m.y, v.vec_id)) AS kept
FROM v LEFT JOIN linked l ON l.x = v.vec_id LEFT JOIN least m ON m.x = v.vec_id
"""
