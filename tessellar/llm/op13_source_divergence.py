"""Source divergence audit: how differently the sources of each language use its terms, exactly.

A source's share of a term is p = 1 + floor(scale * (count + smooth) / (N + smooth * V)) over the V terms
of its language that stand in `least_docs` documents or more; two sources differ by the sum of |p - p'|
over all V terms. Most counts are zero: with p0 the share of a count of zero, each pair of sources starts
at V * |p0 - p0'|, and an inverted index corrects it, a list of sources for each term. Only
lists emit corrections, added up where they arise:

- a term that one source of a pair has at all adds | p - p0' | - | p0 - p0' |, for all sources of a block at
  once from sums over its sorted shares;
- a term that both have adds | p - p' | less both of these.

Sources are dealt by hash into blocks of about BLOCK_SOURCES, terms into shards of bounded
size for each pair of blocks, so a task's work is bounded whatever the size of a language or how many
sources share a term. The result has one row for each ordered pair of sources of a language, as asked.
The `term` part ranks, in each source's window, the terms it uses more than its language does.

Defined cases: null text, language and source are ''; a very long text is counted in slices; ties of value
are ranked by UTF-8 bytes; repeated rows count each time; a source without terms has its pairs, and one alone
has none; without kept terms all values are 0; an empty table gives an empty result; other columns are
ignored, whatever their names. Counts must stay under 10^15, as shares are computed from exact decimals.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count as numbers

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessellar.llm.common import claim, slices, table, texts_of, written

SCALE, SMOOTH, LEAST_DOCS, TOP_TERMS = 1_000_000_000, 5, 30, 50
BLOCK_SOURCES = 256
#: Entries of a shard of terms for a pair of blocks, besides twice as many as the blocks have pairs of sources.
SHARD_POSTINGS = 25_000
#: (document, term) pairs that a task counts before it hands them on.
HELD_PAIRS = 1_000_000

#: Letters and non-ASCII bytes stay, A-Z in lower case; the rest become spaces.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of one text that are split at once; cut at a space.
CUT = 1 << 22


def _words(raw: bytes):
    """Lists of the words of a text, of bounded size."""
    raw = raw.translate(_TABLE)
    at = 0
    while len(raw) - at > CUT:
        to = raw.find(b" ", at + CUT)
        if to < 0:
            break
        yield raw[at:to].split()
        at = to
    yield raw[at:].split()


class Counts:
    """Occurrences and documents of terms by group, for the texts seen so far."""

    def __init__(self):
        self.group, self.term = defaultdict(numbers().__next__), defaultdict(numbers().__next__)
        self.docs, self.words, self.of, self.held, self.n_docs = [], [], [], 0, 0

    def add(self, group: tuple[str, str], text: str) -> None:
        self.of.append(self.group[group])
        for words in _words(text.encode()):
            ids = np.fromiter(map(self.term.__getitem__, words), np.int64, len(words))
            self.words.append(ids)
            self.docs.append(np.full(len(ids), self.n_docs, np.int64))
            self.held += len(ids)
        self.n_docs += 1

    def rows(self):
        """Columns lang, source, term, n (occurrences), df (documents), in parts; a group itself has a null term."""
        groups, terms = list(self.group), list(self.term)
        own, many = np.array(self.of, np.int64), max(len(terms), 1)
        docs, words = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.docs, self.words))
        pairs, n = np.unique(docs * many + words, return_counts=True)
        key, at, df = np.unique(own[pairs // many] * many + pairs % many, return_inverse=True, return_counts=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, at, n)
        by, term = key // many, key % many
        lang, source = (pa.array([g[i] for g in groups], pa.string()) for i in (0, 1))
        names = pa.array(terms, pa.binary()).cast(pa.string())
        for a in range(0, len(key), 20_000):
            part = slice(a, a + 20_000)
            yield pa.RecordBatch.from_arrays([lang.take(pa.array(by[part])), source.take(pa.array(by[part])), names.take(pa.array(term[part])), pa.array(total[part]), pa.array(df[part])], ["lang", "source", "term", "n", "df"])
        zero = pa.array(np.zeros(len(groups), np.int64))
        yield pa.RecordBatch.from_arrays([lang, source, pa.nulls(len(groups), pa.string()), zero, zero], ["lang", "source", "term", "n", "df"])


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, df), term null for each group itself."""

    def run(batches):
        claim("divergence", lambda: None)
        counts = Counts()
        for batch in batches:
            for part in slices(batch, 2):
                for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts_of(part, 2), strict=True):
                    counts.add((lang, source), text)
                if counts.held >= HELD_PAIRS:
                    yield from counts.rows()
                    counts = Counts()
        yield from counts.rows()

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    source = docs.select(empty(lang_col).alias("lang"), empty(source_col).alias("source"), empty(text_col).alias("text"))
    return source.mapInArrow(run, "lang string, source string, term string, n long, df long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _corrections(part: pa.Table) -> np.ndarray:
    """Sums of corrections over a shard of terms, for each source of one block against each of another (or the same).

    Columns source, side (0: of the first block, 1: of the second, 2: of both), zero (p0), term (null: the source itself), p.
    """
    zero, side, p = (part.column(c).to_numpy() for c in ("zero", "side", "p"))
    term = part.column("term").combine_chunks().dictionary_encode()
    term = term.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    source = part.column("source").combine_chunks().dictionary_encode()
    names, source = source.dictionary.to_pylist(), source.indices.to_numpy(zero_copy_only=False)
    own = term == -1
    sides = [source[own & ((side == s) | (side == 2))] for s in (0, 1)]
    p0 = np.zeros(len(names), np.int64)
    p0[source[own]] = zero[own]
    place = np.full((2, len(names)), -1, np.int64)
    for s in (0, 1):
        place[s, sides[s]] = np.arange(len(sides[s]))
    base = np.abs(p0[sides[0]][:, None] - p0[sides[1]][None, :])
    out = np.zeros(base.shape, np.int64)
    kept = ~own
    term, source, p = term[kept], source[kept], p[kept]
    # terms of one source against counts of zero of all others
    by = np.argsort(source, kind="stable")
    starts = np.searchsorted(source[by], np.arange(len(names) + 1))
    for k in range(len(names)):
        mine = np.sort(p[by[starts[k] : starts[k + 1]]])
        if not len(mine):
            continue
        sums = np.concatenate([[0], np.cumsum(mine)])
        for s in (0, 1):
            if place[s, k] >= 0:
                against = p0[sides[1 - s]]
                below = np.searchsorted(mine, against)
                apart = against * (2 * below - len(mine)) + sums[-1] - 2 * sums[below] - len(mine) * np.abs(p0[k] - against)
                if s == 0:
                    out[place[0, k]] += apart
                else:
                    out[:, place[1, k]] += apart
    # terms that sources of both sides have
    by = np.argsort(term, kind="stable")
    starts = np.flatnonzero(np.diff(term[by], prepend=-1, append=-1))
    for a, b in zip(starts, starts[1:], strict=False):
        if b - a < 2:
            continue
        at = by[a:b]
        rows, columns = at[place[0, source[at]] >= 0], at[place[1, source[at]] >= 0]
        if len(rows) and len(columns):
            i, j = place[0, source[rows]], place[1, source[columns]]
            x, y, x0, y0 = p[rows][:, None], p[columns][None, :], p0[source[rows]][:, None], p0[source[columns]][None, :]
            out[np.ix_(i, j)] += np.abs(x - y) - np.abs(x - y0) - np.abs(x0 - y) + np.abs(x0 - y0)
    return names, sides, base, out


def _blocks_against(key, part):  # no type hints: Spark takes the whole group as one table
    lang, i, j, shard = (k.as_py() for k in key)
    names, sides, _, out = _corrections(part)
    a, b = np.indices(out.shape)
    one = [names[k] for k in sides[0]]
    other = [names[k] for k in sides[1]]
    a, b, value = a.ravel(), b.ravel(), out.ravel()
    if i == j:  # a source is in both sides: each pair once
        once = np.array([one[x] < other[y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], bool)
        a, b, value = a[once], b[once], value[once]
    return pa.table({"lang": pa.array([lang] * len(value), pa.string()), "source": pa.array(one, pa.string()).take(pa.array(a)), "item": pa.array(other, pa.string()).take(pa.array(b)), "value": pa.array(value)})


def _share(n: str, total: str, terms: str, smooth: int, scale: int) -> F.Column:
    """1 + floor(scale * (n + smooth) / (total + smooth * terms)), exactly; 1 without terms."""
    return F.expr(f"case when {terms} > 0 then 1 + (cast({scale} as decimal(19,0)) * cast({n} + {smooth} as decimal(18,0))) div cast({total} + {smooth} * {terms} as decimal(19,0)) else 1L end")


def divergence(spark: SparkSession, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, smooth: int = SMOOTH, scale: int = SCALE, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part (`pair` or `term`), item (other source or term), value, rank."""
    counted = written(spark, term_counts(docs, text_col, lang_col, source_col), "terms")
    every = Window.partitionBy("lang", "term")
    index = counted.where("term is not null").withColumn("docs", F.sum("df").over(every)).withColumn("in_lang", F.sum("n").over(every)).where(F.col("docs") >= least_docs)
    index = written(spark, index.withColumn("first", F.row_number().over(every.orderBy("source")) == 1).select("lang", "source", "term", "n", "in_lang", "first"), "index")
    langs = index.groupBy("lang").agg(F.sum("n").alias("of_lang"), F.sum(F.col("first").cast("long")).alias("terms"), F.count("*").alias("postings"))
    groups = counted.where("term is null").select("lang", "source").join(index.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    sizes = counted.where("term is null").groupBy("lang").agg(F.count("*").alias("sources"))
    langs = sizes.join(langs, "lang", "left").na.fill(0)
    groups = groups.na.fill(0).join(langs, "lang").withColumn("n", F.lit(0)).withColumn("zero", _share("n", "total", "terms", smooth, scale))
    groups = groups.withColumn("blocks", 1 + F.expr(f"(sources - 1) div {BLOCK_SOURCES}")).withColumn("block", F.pmod(F.xxhash64("source"), "blocks"))
    groups = written(spark, groups.withColumn("shards", 1 + F.expr(f"postings div (blocks * {SHARD_POSTINGS} + 2 * sources * (sources div blocks))")).drop("n"), "groups")

    shares = index.join(groups, ["lang", "source"]).withColumn("p", _share("n", "total", "terms", smooth, scale)).withColumn("q", _share("in_lang", "of_lang", "terms", smooth, scale))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_terms)

    def against(rows: DataFrame) -> DataFrame:
        """Each row once for every pair of blocks that its own is in."""
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
        return rows.select("lang", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "shard", "source", side.alias("side"), "zero", "term", "p")

    postings = against(shares.withColumn("shard", F.pmod(F.xxhash64("term"), "shards")))
    own = against(groups.withColumn("term", F.lit(None).cast("string")).withColumn("p", F.col("zero")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))))
    corrections = postings.unionByName(own).groupBy("lang", "i", "j", "shard").applyInArrow(_blocks_against, "lang string, source string, item string, value long")
    pairs = corrections.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    mine = groups.select("lang", "source", "zero", "terms")
    pairs = pairs.join(mine, ["lang", "source"]).join(mine.select("lang", F.col("source").alias("item"), F.col("zero").alias("item_zero")), ["lang", "item"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("value") + F.col("terms") * F.abs(F.col("zero") - F.col("item_zero"))).alias("value"))
    return pairs.withColumn("rank", F.row_number().over(best)).unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark, table(spark, sf_dir, "documents"))


OP13_SQL = r"""
with docs as (
  select row_number() over () as rn, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents
), words as (select rn, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
of_docs as (select rn, lang, source, term, count(*) as n from words group by all),
kept as (select lang, term, sum(n)::hugeint as in_lang from of_docs group by all having count(*) >= 30),
counts as (select lang, source, term, sum(n)::hugeint as n from of_docs semi join kept using (lang, term) group by all),
langs as (select lang, count(*)::hugeint as v, sum(in_lang)::hugeint as total from kept group by all),
grps as (select distinct lang, source from docs),
totals as (select g.lang, g.source, coalesce(sum(n), 0)::hugeint as total from grps g left join counts c on c.lang = g.lang and c.source = g.source group by all),
p as (
  select t.lang, t.source, k.term, coalesce(c.n, 0) as n, 1 + 1000000000 * (coalesce(c.n, 0) + 5) // (t.total + 5 * v) as p, 1 + 1000000000 * (in_lang + 5) // (l.total + 5 * v) as q
  from totals t join kept k on k.lang = t.lang join langs l on l.lang = t.lang left join counts c on c.lang = t.lang and c.source = t.source and c.term = k.term
), pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(sum(abs(x.p - y.p)), 0)::bigint as value
  from grps a join grps b on a.lang = b.lang and a.source <> b.source
  left join p x on x.lang = a.lang and x.source = a.source left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term group by all
), terms as (select lang, source, 'term' as part, term as item, (p - q)::bigint as value from p where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (select * from pairs union all select * from terms))
select * from ranked where part = 'pair' or rank <= 50
"""
