"""N-gram Jaccard join: near-duplicate components by exact set similarity with signature trees.

1. Equal shingle sets are one class, named by a 64-bit hash.
2. Classes sign themselves (shingles.Levels): no similar pair shares no signature. The holders of one
   signature form a group under the smallest of their names, its head; a class is in the groups of its
   own signatures' heads and in no other, so groups do not grow through chains of shared signatures.
   Signatures put shingles frequent in a sample last, which changes how selective they are but not
   which pairs must meet.
3. A signature tree of each group's bitmaps (a sixteenth to a thirty-second of a set) leaves the classes that can
   have a similar partner there. Only their sets are fetched.
4. Each group that is left is joined by a signature tree of the sets: a class first in one of its groups,
   then where a tree of bitmaps leaves a similar class of another component possible. A group too large for a task is
   cut into blocks that all hold one class: near copies link to it or to one another in their block, and
   only the classes that end outside that one's component are compared with the other blocks too.
5. Components of the links found, then of all documents through their classes.

Links are never listed by pairs: a task returns a spanning forest of its own. Hot groups: copies are
collapsed in the task that reads them and again by partial aggregation; rows of one signature are at
most one for each slice of input; groups are cut by a bound on their shingles; lookups that many
rows share are broadcast within a checked size and else joined so that Spark can split them.

Defined cases: null text or text without words has 0 shingles and is alone; a text of fewer words
than the width is one shingle; a very long text is one set like any other, its signatures in proportion;
rows without id link others but take no part in choosing a component's name (null if no row has
one); repeated rows and ids share a component; of equal candidates for a name the smallest id is
taken; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessellar.llm.common import forget, slices, table, texts_of, written
from tessellar.llm.components import components, looked_up
from tessellar.llm.shingles import Levels, set_hash, shingle_sets
from tessellar.llm.signature_tree import bitmap, linked, possible, wide_enough

#: Signatures that a task gathers before it emits each distinct one once.
GATHERED = 400_000
#: Members of a group up to which its bitmaps are joined first; a larger one goes on to the sets at once.
SIEVED = 1_000
#: Shingles and classes of one block of a group at most, about; parts compared with every block are bound by shingles only.
BLOCK_SHINGLES, BLOCK_CLASSES = 1_000_000, 4_000
#: Documents whose shingles are counted to find frequent ones: so many and a share of all.
SAMPLED, SAMPLED_SHARE = 5_000, 0.02
#: Shingles in so many sampled documents are frequent; at most so many are broadcast (8 bytes each).
FREQUENT, MOST_FREQUENT = 2, 1_000_000
#: Grouped classes up to which their names are broadcast (8 bytes each); beyond, they are joined.
BROADCAST_CLASSES = 2_000_000


def frequent_shingles(docs: DataFrame, text_col: str, width: int) -> np.ndarray:
    """Sorted hashes of shingles that many documents of a sample hold."""
    n = docs.count()
    share = min(1.0, (SAMPLED + SAMPLED_SHARE * n) / max(n, 1))

    def run(batches):
        for batch in batches:
            for part in slices(batch, 0):
                sets = shingle_sets(texts_of(part, 0), width)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["h"])

    sample = docs.select(F.col(text_col).cast("string").alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20))).dropDuplicates()
    rows = sample.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "h").limit(MOST_FREQUENT).select("h").toArrow()
    return np.sort(rows["h"].to_numpy().view(np.uint64))


def signature_groups(docs: DataFrame, text_col: str, width: int, levels: Levels, frequent: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Written tables: (h, head) of the groups' members that may have a similar partner there, and (h, n, bits) of all members."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(frequent)  # at most MOST_FREQUENT hashes

    def flush(sigs: list[np.ndarray], names: list[np.ndarray]):
        """One row (kind 0) for a signature with one holder in the slice; else one of kind 1 and the others of kind 2."""
        sig, name = np.concatenate(sigs), np.concatenate(names)
        order = np.argsort(sig, kind="stable")
        sig, name = sig[order], name[order]
        first = np.append(True, sig[1:] != sig[:-1])
        more = np.append(~first[1:], False)
        kind = np.where(first, more, 2).astype(np.int8)
        nothing = pa.nulls(len(sig))
        yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(name), pa.array(kind), nothing.cast(pa.int64()), nothing.cast(pa.binary())], schema)

    def described(classes: list[tuple[int, int, bytes]]):
        """Rows of kind 3: a class's size and bitmap."""
        h, n, bits = zip(*classes, strict=True)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(h), pa.int64()), pa.array(h), pa.array([3] * len(h), pa.int8()), pa.array(n), pa.array(bits)], schema)

    schema = ["sig", "h", "kind", "n", "bits"]

    def run(batches):
        seen: set[int] = set()
        sigs, names, n = [], [], 0
        for batch in batches:
            for part in slices(batch, 0):
                classes = []
                for own in shingle_sets(texts_of(part, 0), width):
                    if len(own) and (name := set_hash(own)) not in seen:
                        seen.add(name)
                        s = levels.signatures([own], shared.value)[0]
                        sigs.append(s)
                        names.append(np.full(len(s), name, np.int64))
                        n += len(s)
                        if len(s):
                            classes.append((name, len(own), bitmap(own, wide_enough(len(own)))))
                if classes:
                    yield from described(classes)
                if n >= GATHERED:
                    yield from flush(sigs, names)
                    sigs, names, n = [], [], 0
                    seen.clear()
        if n:
            yield from flush(sigs, names)

    rows = written(spark, docs.select(F.col(text_col).cast("string")).mapInArrow(run, "sig long, h long, kind byte, n long, bits binary"), "signatures")
    of = Window.partitionBy("sig")
    met = rows.where("kind < 2").select("sig", "h", "kind").withColumn("head", F.min("h").over(of)).where("h <> head or kind = 1")
    met = written(spark, met, "met")
    heads = written(spark, met.where("kind = 1").groupBy("sig").agg(F.min("head").alias("head")), "heads")
    rest = looked_up(rows.where("kind = 2").select("sig", "h"), heads, "sig", "inner")
    pairs = met.select("h", "head").union(rest.select("h", "head")).where("h <> head").dropDuplicates()
    groups = written(spark, pairs.union(pairs.select("head", "head").dropDuplicates()), "groups")
    members = groups.select("h").dropDuplicates()
    described_ = rows.where("kind = 3").groupBy("h").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    classes = written(spark, described_.join(members, "h", "left_semi"), "bitmaps")
    kept = sieved(groups.withColumn("r", F.lit(None).cast("long")), classes, levels.percent)
    for used in (rows, met, heads, groups):
        forget(spark, used)
    return kept, classes


def sieved(groups: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Written rows (h, head) of groups (h, head, r) whose bitmaps leave a similar partner possible: one of
    another known component r, if r is given."""
    spark = groups.sparkSession

    def run(batches):
        head, held = None, []
        for batch in batches:
            kept: list[tuple[int, int]] = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if row[0] != head:
                    kept += left(held)
                    head, held = row[0], []
                held.append(row)
            if kept:
                yield rows_of(kept)
        if kept := left(held):
            yield rows_of(kept)

    def left(held: list[tuple]) -> list[tuple[int, int]]:
        if len(held) < 2:
            return []
        known = [x[4] for x in held] if held[0][4] is not None else None
        return [(held[i][1], held[i][0]) for i in possible([x[3] for x in held], [x[2] for x in held], percent, known)]

    def rows_of(kept: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*kept, strict=True)], ["h", "head"])

    large = written(spark, groups.groupBy("head").count().where(F.col("count") > SIEVED), "large")
    marked = looked_up(groups, large, "head")
    small = marked.where("count is null").join(classes, "h").select("head", "h", "n", "bits", "r")
    some = small.repartition("head").sortWithinPartitions("head").mapInArrow(run, "h long, head long")
    kept = written(spark, some.union(marked.where("count is not null").select("h", "head")), "kept")
    forget(spark, large)
    return kept


def shingled(docs: DataFrame, id_col: str, text_col: str, width: int, wanted: DataFrame) -> DataFrame:
    """id, n, h (class) of every row, its task, and the shingles once a task for the wanted classes."""
    spark = docs.sparkSession
    few = wanted.count() <= BROADCAST_CLASSES
    names_ = np.sort(wanted.select("h").toArrow()["h"].to_numpy()) if few else None
    shared = spark.sparkContext.broadcast(names_)  # at most BROADCAST_CLASSES names; else every set goes on to the join

    def run(batches):
        seen: set[int] = set()
        task = TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch, 1):
                sets = shingle_sets(texts_of(part, 1), width)
                names = [set_hash(s) if len(s) else None for s in sets]
                held = []
                for name, own in zip(names, sets, strict=True):
                    keep = name is not None and name not in seen
                    if keep and shared.value is not None:
                        at = np.searchsorted(shared.value, name)
                        keep = at < len(shared.value) and shared.value[at] == name
                    if keep:
                        if len(seen) >= GATHERED:
                            seen.clear()
                        seen.add(name)
                    held.append(own.tobytes() if keep else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.int64()), pa.array([task] * len(sets), pa.int32()), pa.array(held, pa.binary())], ["id", "n", "h", "task", "shingles"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n long, h long, task int, shingles binary")


def tree_tasks(dealt: DataFrame, percent: int) -> DataFrame:
    """Joins every (head, x, y) of rows (head, x, y, side, centre, h, shingles) by signature trees.

    Without sides (null) all rows are joined with one another, else those of side 0 with those of side 1.
    Gives edges (a, b) of a spanning forest; where a centre is given, also (a, null, head) for every
    class a that isn't in the centre's component then.
    """

    def joined(key: tuple, rows: list[tuple]):
        names = [h for _, _, h, _ in rows]
        sets = [np.frombuffer(own, np.uint64) for *_, own in rows]
        found = linked(sets, percent, None if rows[0][0] is None else [bool(side) for side, *_ in rows])
        for i, r in found:
            yield names[i], names[r], None
        if rows[0][1] is not None:
            root = dict(found)
            centre = names.index(rows[0][1])
            centre = root.get(centre, centre)
            for i, h in enumerate(names):
                if root.get(i, i) != centre:
                    yield h, None, key[0]

    def run(batches):
        key, held, out = None, [], []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(7)]
            for head, x, y, *row in zip(*columns, strict=True):
                if (head, x, y) != key:
                    if len(held) > 1:
                        out += joined(key, held)
                    key, held = (head, x, y), []
                held.append(tuple(row))
            if len(out) >= GATHERED:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b", "head"])
                out = []
        if len(held) > 1:
            out += joined(key, held)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b", "head"])

    dealt = dealt.select("head", "x", "y", "side", "centre", "h", "shingles")
    return dealt.repartition("head", "x", "y").sortWithinPartitions("head", "x", "y").mapInArrow(run, "a long, b long, head long")


def tree_links(sets: DataFrame, groups: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Written (v, r) of the components of similar classes over all groups; sets (h, n, task, shingles) hold one for each task.

    A class first goes to one of its groups only, that of its smallest head: near copies share several. Of the
    groups that then hold several components follow the classes that may be similar to one of another.
    """
    spark = sets.sparkSession
    owners = written(spark, sets.groupBy("h").agg(F.min("task").alias("task")), "owners")
    sets = looked_up(sets, owners, ["h", "task"], "left_semi")  # of each class the set of one task
    first = written(spark, groups.groupBy("h").agg(F.min("head").alias("head")), "first")
    edges = group_links(sets, first, percent)
    known = components(spark, edges)
    at = written(spark, looked_up(groups, known.select(F.col("v").alias("h"), "r"), "h").select("h", "head", F.coalesce("r", "h").alias("r")), "at")
    apart = written(spark, at.groupBy("head").agg(F.min("r").alias("least"), F.max("r").alias("most")).where("least < most").select("head", F.lit(True).alias("apart")), "apart")
    open_ = sieved(looked_up(at, apart, "head", "inner").select("h", "head", "r"), classes, percent)
    again = written(spark, open_.select("h").dropDuplicates(), "wanted")
    more = group_links(looked_up(sets, again, "h", "left_semi"), open_, percent)
    roots = components(spark, known.select(F.col("v").alias("a"), F.col("r").alias("b")).union(more))
    for used in (owners, first, edges, known, at, apart, open_, again, more):
        forget(spark, used)
    return roots


def group_links(sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Written edges (a, b) that join the similar classes of each group."""
    spark = sets.sparkSession
    sizes = sets.groupBy("h").agg(F.first("n").alias("n"))
    large = groups.join(sizes, "h").groupBy("head").agg(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count("*") / BLOCK_CLASSES).cast("int").alias("more"), F.min("h").alias("centre")).where("more > 0")
    large = written(spark, large, "large")
    own = looked_up(looked_up(sets.select("h", "shingles"), groups, "h", "inner"), large, "head").withColumn("more", F.coalesce("more", F.lit(0)))
    block = F.pmod(F.xxhash64("h"), F.col("more") + 1).cast("int")
    all_ = F.sequence(F.lit(0), F.col("more"))
    dealt = own.withColumn("x", F.explode(F.when(F.col("h") == F.col("centre"), all_).otherwise(F.array(block))))
    found = written(spark, tree_tasks(dealt.withColumns({"y": F.lit(0), "side": F.lit(None).cast("int")}), percent), "links")
    edges = found.where("b is not null").select("a", "b")
    rest = written(spark, found.where("head is not null").select(F.col("a").alias("h"), "head").dropDuplicates(), "rest")
    used = [large, rest]
    if rest.limit(1).count():
        # of large groups, what isn't like the centre: against every block, in parts of a block's size
        parts = written(spark, rest.join(sizes, "h").groupBy("head").agg((F.sum("n") / BLOCK_SHINGLES).cast("int").alias("parts")), "parts")
        some = looked_up(own, parts, "head", "inner")
        left = some.withColumns({"x": block, "y": F.explode(F.sequence(F.lit(0), F.col("parts"))), "side": F.lit(0)})
        right = some.join(rest, ["h", "head"], "left_semi").withColumns({"x": F.explode(all_), "y": F.pmod(F.xxhash64("h", F.lit(1)), F.col("parts") + 1).cast("int"), "side": F.lit(1)})
        again = written(spark, tree_tasks(left.unionByName(right).withColumn("centre", F.lit(None).cast("long")), percent), "links")
        edges = written(spark, edges.union(again.select("a", "b")), "links")
        used += [parts, again, found]
    for x in used:
        forget(spark, x)
    edges.written_at = getattr(edges, "written_at", found.written_at)
    return edges


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """id_col, n_shingles and component_id of every row: rows link at Jaccard similarity >= percent / 100."""
    spark = docs.sparkSession
    groups, classes = signature_groups(docs, text_col, width, Levels(percent), frequent_shingles(docs, text_col, width))
    wanted = written(spark, groups.select("h").dropDuplicates(), "wanted")
    held = written(spark, shingled(docs, id_col, text_col, width, wanted), "shingles")
    roots = tree_links(held.where("shingles is not null").select("h", "n", "task", "shingles"), groups, classes, percent)
    every = written(spark, held.select("id", "n", "h"), "classes")
    for used in (groups, classes, wanted, held):
        forget(spark, used)

    # only classes of several rows, or linked ones, have another name than their row's
    classes = every.where("h is not null").groupBy("h").agg(F.min("id").alias("least"), F.count("*").alias("rows"))
    linked_ = roots.select(F.col("v").alias("h"), "r").union(roots.select("r", "r").dropDuplicates())
    classes = written(spark, classes.join(linked_, "h", "left").where("rows > 1 or r is not null").select("h", F.coalesce("r", "h").alias("root"), "least"), "named")
    names = written(spark, classes.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    named = written(spark, looked_up(classes, names, "root").select("h", "component_id", F.lit(True).alias("known")), "named")
    for used in (roots, classes, names):
        forget(spark, used)
    out = looked_up(every, named, "h")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("known"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90)


#: Every pair that shares a shingle, then reachability.
OP6_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), pair AS (SELECT x, y FROM met JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * shared >= 90 * (p.n + q.n - shared)
), reach(x, y) AS (SELECT x, y FROM pair UNION SELECT r.x, p.y FROM reach r JOIN pair p ON r.y = p.x
), least AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least m ON m.x = d.doc_id
"""
