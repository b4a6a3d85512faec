"""Connected components of an edge table, without hubs in one task and without the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.llm.common import forget, written

#: Edges that a task contracts to a forest at once.
CONTRACTED = 500_000
#: Rows of a lookup table up to which it is broadcast (16 bytes each); beyond, it is joined.
BROADCAST_ROWS = 1_000_000


def looked_up(rows: DataFrame, by: DataFrame, key: str | list[str], how: str = "left") -> DataFrame:
    """rows joined to a written table by keys that many rows may share.

    A table of at most BROADCAST_ROWS goes to every task. Of a larger one only the entries of hot keys do, those
    that have more than a BROADCAST_ROWS-th of all rows, so there are fewer than that; the rest are a
    plain shuffled join, in which no key is hot.
    """
    if by.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(by), key, how)
    keys = [key] if isinstance(key, str) else key
    held = rows.groupBy(*keys).agg(F.count("*").alias("__held"))
    bound = rows.count() // max(BROADCAST_ROWS, 1)
    hot = F.broadcast(written(rows.sparkSession, held.where(F.col("__held") > bound).select(*keys), "hot"))
    of_hot = rows.join(hot, keys, "left_semi").join(F.broadcast(by.join(hot, keys, "left_semi")), keys, how)
    return of_hot.unionByName(rows.join(hot, keys, "left_anti").join(by, keys, how))


def forest(pairs: list[tuple]) -> list[tuple]:
    """(node, smallest node of its component) for every node that isn't the smallest."""
    parent: dict = {}

    def find(x):
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, find(x)) for x in list(parent)]


def _contract(batches):
    held: list[tuple] = []
    schema = None
    for batch in batches:
        schema = batch.schema
        held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        if len(held) >= CONTRACTED:
            held = forest(held)
            if len(held) >= CONTRACTED // 2:
                yield _rows(held, schema)
                held = []
    if held:
        yield _rows(forest(held), schema)


def _rows(pairs: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], schema.types[i]) for i in range(2)], ["v", "r"])


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """edges (a, b) -> written table (v, r): the smallest node r of v's component, for every other node v.

    Tasks first contract their own edges to forests. Rounds then give every node its smallest known
    neighbour (an aggregation with partial sums), link its other neighbours to that one, and jump
    from each neighbour to the neighbour's own smallest, until the table is a set of stars. Only
    neighbours that have a smaller one themselves are looked up, so the centre of a large star is no
    key of a shuffle. Nodes that appear as r only are their own component. Null nodes are left out.
    """
    a, b = edges.columns
    kind = edges.schema[a].dataType.simpleString()
    pairs = edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("r")).where(f"`{a}` is not null and `{b}` is not null and `{a}` <> `{b}`")
    now = written(spark, pairs.mapInArrow(_contract, f"v {kind}, r {kind}").dropDuplicates(), "edges")
    while True:
        least = written(spark, now.groupBy("v").agg(F.min("r").alias("m"), F.count("*").alias("n")), "least")
        inner = now.select(F.col("r").alias("v")).dropDuplicates()
        jump = written(spark, least.join(inner, "v", "left_semi").select(F.col("v").alias("r"), F.col("m").alias("up")), "jump")
        # a star forest: every node has one neighbour, which has none
        done = not jump.limit(1).count() and not least.where("n > 1").limit(1).count()
        if not done:
            linked = now.join(least, "v").select("v", "r", "m")
            pairs = linked.select("v", F.col("m").alias("r")).union(linked.where("r <> m").select(F.col("r").alias("v"), F.col("m").alias("r")))
            jumped = looked_up(pairs.dropDuplicates(), jump, "r").select("v", F.coalesce("up", "r").alias("r"), F.when(F.col("up").isNotNull(), F.col("r")).alias("via"))
            # keeps both the jump and the link it came by
            both = jumped.select("v", "r").union(jumped.where("via is not null").select(F.col("via").alias("v"), "r")).where("v <> r")
            before, now = now, written(spark, both.select(F.greatest("v", "r").alias("v"), F.least("v", "r").alias("r")).mapInArrow(_contract, f"v {kind}, r {kind}").dropDuplicates(), "edges")
            forget(spark, before)
        forget(spark, least)
        forget(spark, jump)
        if done:
            return now
