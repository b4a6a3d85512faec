"""Phrase collocation mining: how much more often words stand together than their parts would by chance.

Tasks cut their texts into shards of about SHARD_WORDS words. For each a generalised suffix automaton
(`suffix_automaton.py`) counts the end places of every phrase; its phrases are dealt by their hash into blocks of word
numbers with their own word lists, and tasks add up the blocks of a bucket over all shards. First this is done for phrases
of one and two words. A longer phrase can only occur often enough if all pairs of words within it do, those of its
suffix link among them, so for longer ones the texts are cut, before the second automaton is built, where a pair
doesn't: pairs are looked up in a sieve of SIEVE_BITS bits, whatever their number (were it full, it would let all
through, and the counts would still be right).

What occurs often enough is written, and the rest are joins of that table with itself: a phrase's first and last parts
give its score, and each longer phrase is put to the phrases it holds, to that of its suffix link (without its first word)
and to that without its last word, which is enough as no phrase occurs more often than its parts. No phrase is dropped
before its count over the whole corpus is known to be too low, no shard or bucket holds more than its share of the
corpus, and the best of a language are taken in two steps.

Counts must stay under 10^15, as scores are exact decimals.

Defined cases: null or empty text has no words; null language counts as `und`; very long texts are cut at
pieces' ends only in so far as a shard is closed after whole texts, so no phrase is lost; ties are ranked by
count and then by the phrase's UTF-8 bytes; repeated rows count each time; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import count as numbers

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessellar.llm.common import claim, parallelism, slices, table, texts_of, written
from tessellar.llm.components import looked_up
from tessellar.llm.suffix_automaton import build

#: Words of a shard, of which a task holds one at a time.
SHARD_WORDS = 1_000_000
#: Phrases that a task holds for a bucket before it adds up equal ones.
HELD_PHRASES = 1_000_000
#: Buckets for each shuffle partition: so much smaller is what a task holds.
BUCKETS = 2
#: Bits of the sieve of pairs: SIEVE_BITS / 64 rows at most come to the driver, and as many bits go to every task.
SIEVE_BITS = 1 << 25
#: Shares in which a language is ranked before its best are ranked together.
SHARES = 64
NO_LANG = "und"

_BREAK, _ENTRY = b"\xff", b"\xfe"  # bytes that UTF-8 doesn't have
_TABLE = bytes(255 if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else 32 if b == 9 else b for b in range(256))


def pieces_words(raw: bytes) -> list[bytes]:
    """Words of the text in order, with a break after each piece."""
    return (raw + b"\n").translate(_TABLE).replace(_BREAK, b" \xff ").split()


class Shard:
    """Words of some texts by number; equal words of two groups have two numbers."""

    def __init__(self):
        number = numbers(1).__next__  # 0 is the break
        self.of = defaultdict(lambda: defaultdict(number, {_BREAK: 0}))
        self.parts, self.words = [], 0

    def add(self, group: str, texts: list[str]) -> None:
        words = pieces_words("\n".join(texts).encode())
        self.parts.append(np.fromiter(map(self.of[group].__getitem__, words), np.int64, len(words)))
        self.words += len(words)

    def placed(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Entries (group, break, word) by number; the numbers of all words; the words of its piece up to each."""
        every = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int64)
        entries = [b""] * (sum(len(d) - 1 for d in self.of.values()))
        for group, of in self.of.items():
            head = group.encode() + _BREAK
            for word, k in of.items():
                if k:
                    entries[k - 1] = head + word
        words = every != 0
        return entries, every[words] - 1, _room(every == 0)[words]


def _room(breaks: np.ndarray) -> np.ndarray:
    place = np.arange(len(breaks))
    return place - np.maximum.accumulate(np.where(breaks, place, -1)) if len(breaks) else place


def hashed(words: list[np.ndarray]) -> np.ndarray:
    """One hash of a phrase, given the hashes of its words in order."""
    h = np.zeros(len(words[0]), np.uint64)
    for own in words:
        h = (h ^ own) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def of_words(entries: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, entries), np.uint64, len(entries))


def sieved(hashes: np.ndarray, words: np.ndarray, room: np.ndarray, bits: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """What is left of the texts, cut between words whose pair isn't let through, in runs of `least` words or more."""
    at = (hashed([hashes[words[:-1]], hashes[words[1:]]]) % np.uint64(SIEVE_BITS)).astype(np.int64)
    goes_on = np.zeros(len(words), bool)
    goes_on[1:] = (room[1:] > 1) & (bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
    starts = np.flatnonzero(~goes_on)
    size = np.diff(starts, append=len(words))
    run = np.repeat(np.arange(len(starts)), size)
    kept = size[run] >= least
    return words[kept], (np.arange(len(words)) - starts[run] + 1)[kept]


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers as planes of equally significant bytes, which pack well."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplaned(raw: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def packed(entries: list[bytes], levels: list[tuple[np.ndarray, np.ndarray]], shortest: int) -> bytes:
    """One block: its sizes, the entries that it uses, and its phrases (of `shortest` words and more) and counts under numbers of its own."""
    used, own = np.unique(np.concatenate([p.ravel() for p, _ in levels]), return_inverse=True)
    blob = _ENTRY.join([entries[i] for i in used])
    every = np.concatenate([own, *(c for _, c in levels)])
    head = np.array([shortest, len(levels), len(blob), len(every), *(len(c) for _, c in levels)], "<i4").tobytes()
    raw = head + blob + _planes(every)
    return len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(block: bytes) -> tuple[list[bytes], list[tuple[np.ndarray, np.ndarray]]]:
    raw = pa.decompress(block[4:], decompressed_size=int.from_bytes(block[:4], "little"), codec="zstd", asbytes=True)
    shortest, depth, blob, total = np.frombuffer(raw, "<i4", 4).tolist()
    sizes = np.frombuffer(raw, "<i4", depth, 16).tolist()
    at = 16 + 4 * depth
    every = _unplaned(raw[at + blob :], total)
    counts = total - sum(sizes)
    levels, begun = [], 0
    for k, n in enumerate(sizes, shortest):
        levels.append((every[begun : begun + k * n].reshape(n, k), every[counts : counts + n]))
        begun, counts = begun + k * n, counts + n
    return raw[at : at + blob].split(_ENTRY), levels


def blocks_of(shard: Shard, shortest: int, longest: int, buckets: int, bits: np.ndarray | None = None):
    """(bucket, block) for every bucket that the shard has phrases of, sieved where there is a sieve."""
    entries, words, room = shard.placed()
    hashes = of_words(entries)
    if bits is not None and len(words):
        words, room = sieved(hashes, words, room, bits, shortest)
    if not len(words):
        return
    automaton = build(words, room, longest)
    dealt = []
    for k in range(shortest, longest + 1):
        phrases, n = automaton.phrases(k)
        bucket = (hashed([hashes[c] for c in phrases.T]) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        dealt.append((phrases[order], n[order], np.searchsorted(bucket[order], np.arange(buckets + 1))))
    for b in range(buckets):
        held = [(p[at[b] : at[b + 1]], n[at[b] : at[b + 1]]) for p, n, at in dealt]
        if any(len(n) for _, n in held):
            yield b, packed(entries, held, shortest)


def _added(phrases: np.ndarray, n: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Equal phrases (rows of numbers under many) added up."""
    key, top = phrases[:, 0].copy(), many
    for column in phrases.T[1:]:
        if top > (1 << 62) // many:
            values, key = np.unique(key, return_inverse=True)
            top = len(values)
        key, top = key * many + column, top * many
    _, some, at = np.unique(key, return_index=True, return_inverse=True)
    total = np.zeros(len(some), np.int64)
    np.add.at(total, at, n)
    return phrases[some], total


class Bucket:
    """Phrases of a bucket with their counts over the shards seen so far."""

    def __init__(self):
        self.number = defaultdict(numbers().__next__)
        self.levels, self.held = [], 0

    def add(self, block: bytes) -> None:
        entries, levels = unpacked(block)
        mine = np.fromiter(map(self.number.__getitem__, entries), np.int64, len(entries))
        self.levels = self.levels or [[] for _ in levels]
        for into, (phrases, n) in zip(self.levels, levels, strict=True):
            if len(n):
                into.append((mine[phrases], n))
                self.held += len(n)
        if self.held > HELD_PHRASES:
            self.shrink()
            self.held = min(self.held, HELD_PHRASES // 2)  # as many again come before the next time

    def shrink(self) -> None:
        for k, parts in enumerate(self.levels):
            if parts:
                self.levels[k] = [_added(np.concatenate([p for p, _ in parts]), np.concatenate([n for _, n in parts]), len(self.number))]
        self.held = sum(len(n) for parts in self.levels for _, n in parts)

    def rows(self, least: int):
        """(group, words, phrase, n) of phrases that occur `least` times or more, and of each group its words, as phrase null of no word."""
        self.shrink()
        entries = [tuple(e.split(_BREAK)) for e in self.number]
        totals: dict[bytes, int] = defaultdict(int)
        for parts in self.levels:
            for phrases, n in parts:
                k = phrases.shape[1]
                if k == 1:
                    for p, c in zip(phrases[:, 0].tolist(), n.tolist(), strict=True):
                        totals[entries[p][0]] += c
                kept = n >= least
                for p, c in zip(phrases[kept].tolist(), n[kept].tolist(), strict=True):
                    yield entries[p[0]][0].decode(), k, b" ".join([entries[i][1] for i in p]).decode(), c
        for group, n in totals.items():
            yield group.decode(), 0, None, n


def pair_sieve(pairs: DataFrame) -> np.ndarray:
    """Bits of the pairs of words (grp, phrase), by the hash that shards use."""

    def run(batches):
        bits = np.zeros(SIEVE_BITS // 64, np.uint64)
        for batch in batches:
            two = [tuple(f"{g}".encode() + _BREAK + w for w in p.encode().split(b" ")) for g, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            if two:
                at = (hashed([of_words([p[i] for p in two]) for i in (0, 1)]) % np.uint64(SIEVE_BITS)).astype(np.int64)
                np.bitwise_or.at(bits, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        some = np.flatnonzero(bits)
        for a in range(0, len(some), 50_000):
            part = some[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(bits[part].view(np.int64))], ["word", "bits"])

    rows = pairs.select("grp", "phrase").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    out = np.zeros(SIEVE_BITS // 64, np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def phrase_counts(spark: SparkSession, docs: DataFrame, text_col: str = "text", group_col: str = "lang", shortest: int = 1, longest: int = 2, least: int = 10, bits: np.ndarray | None = None) -> DataFrame:
    """(grp, k, phrase, n): phrases of `shortest` to `longest` words that occur `least` times or more in a group; its words as k = 0."""
    buckets = BUCKETS * parallelism(spark)
    shared = spark.sparkContext.broadcast(bits)  # SIEVE_BITS bits at most

    def deal(batches):
        claim("collocations", lambda: None)
        shard = Shard()
        for batch in batches:
            for part in slices(batch, 1):
                by: dict[str, list[str]] = defaultdict(list)
                for group, text in zip(part.column(0).to_pylist(), texts_of(part, 1), strict=True):
                    by[group].append(text)
                for group, texts in by.items():
                    shard.add(group, texts)
                if shard.words >= SHARD_WORDS:
                    yield from _blocks(shard)
                    shard = Shard()
        yield from _blocks(shard)

    def _blocks(shard):
        held, size = [], 0
        for row in blocks_of(shard, shortest, longest, buckets, shared.value):
            held.append(row)
            size += len(row[1])
            if size > 1 << 20:
                yield _batch(held)
                held, size = [], 0
        yield _batch(held)

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "block"])

    def add(batches):
        claim("collocations", lambda: None)
        now, bucket = None, None
        for batch in batches:
            for b, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if b != now:
                    if bucket:
                        yield from _counted(bucket)
                    now, bucket = b, Bucket()
                bucket.add(block.as_py())
        if bucket:
            yield from _counted(bucket)

    def _counted(bucket):
        rows = list(bucket.rows(least))
        for at in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows[at : at + 10_000], strict=True), (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["grp", "k", "phrase", "n"])

    source = docs.select(F.coalesce(F.col(group_col).cast("string"), F.lit(NO_LANG)).alias("grp"), F.col(text_col).cast("string").alias("text"))
    dealt = source.mapInArrow(deal, "bucket int, block binary").repartition(parallelism(spark), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(add, "grp string, k int, phrase string, n long")


def _part(words: str, begin, size) -> F.Column:
    return F.array_join(F.slice(words, begin, size), " ")


def collocations(spark: SparkSession, docs: DataFrame, text_col: str = "text", group_col: str = "lang", longest: int = 3, least: int = 10, within_percent: int = 50, top: int = 2000) -> DataFrame:
    """Of each group the first `top` phrases of 2 to `longest` words by score: grp, rank, phrase, a, l, r, n, score.

    A phrase of a <= l, r occurrences is scored floor(10^6 a a / (l r)), where l and r are those of its parts at the cut
    with the lowest score; phrases that stand in a longer one with within_percent % of their count or more are left out.
    """
    every = written(spark, phrase_counts(spark, docs, text_col, group_col, 1, 2, least), "phrases")
    if longest > 2:
        bits = pair_sieve(every.where("k = 2"))
        every = every.unionByName(written(spark, phrase_counts(spark, docs, text_col, group_col, 3, longest, least, bits), "longer"))
    counts = every.where("k > 0")
    split = counts.where("k > 1").withColumn("words", F.split("phrase", " "))
    # what any longer phrase reaches, one of one word more reaches that holds the same: that whose link or first part the phrase is
    longer = split.where("k > 2").select("grp", "n", F.explode(F.array(_part("words", F.lit(2), F.col("k") - 1), _part("words", F.lit(1), F.col("k") - 1))).alias("phrase"))
    most = longer.groupBy("grp", "phrase").agg(F.max("n").alias("most"))
    cuts = split.select("grp", F.col("phrase").alias("whole"), F.col("n").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    both = F.array(_part("words", F.lit(1), F.col("cut")), _part("words", F.col("cut") + 1, F.size("words") - F.col("cut")))
    parts = written(spark, cuts.select("grp", "whole", "a", "cut", F.posexplode(both).alias("side", "phrase")), "parts")
    found = looked_up(parts, counts.select("grp", "phrase", "n"), ["grp", "phrase"], "inner")
    side = lambda k: F.max(F.when(F.col("side") == k, F.col("n")))
    scored = found.groupBy("grp", F.col("whole").alias("phrase"), "a", "cut").agg(side(0).alias("l"), side(1).alias("r"))
    scored = scored.withColumn("score", F.expr("cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))"))
    lowest = scored.groupBy("grp", "phrase", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "cut")).alias("of")).select("grp", "phrase", "a", "of.*")
    lowest = lowest.join(most, ["grp", "phrase"], "left").where(f"most is null or 100 * most < {within_percent} * a")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    best = lowest.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("grp", "share").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(*order))).where(F.col("rank") <= top)
    totals = every.where("k = 0").groupBy("grp").agg(F.sum("n").alias("n"))
    return best.join(totals, "grp").select("grp", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark, table(spark, sf_dir, "documents")).withColumnRenamed("grp", "lang")


OP12_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece_text from documents
), lists as (
  select lang, list_filter(string_split_regex(piece_text, '[\x20\x09]+'), lambda w: w <> '') as ws from pieces
), grams as (
  select lang, 1 as k, unnest(ws) as phrase from lists
  union all select lang, 2, unnest([ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))]) from lists
  union all select lang, 3, unnest([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)]) from lists
), f as (select lang, k, phrase, count(*)::hugeint as a from grams group by all),
n as (select lang, sum(a)::bigint as n from f where k = 1 group by lang),
cand as (select *, string_split(phrase, ' ') as ws from f where k > 1 and a >= 10),
cuts as (
  select lang, phrase, a, 1 as cut, ws[1] as lp, array_to_string(ws[2:], ' ') as rp from cand
  union all select lang, phrase, a, 2, array_to_string(ws[1:2], ' '), ws[3] from cand where k = 3
), scored as (
  select c.*, l.a as l, r.a as r, c.a * c.a * 1000000 // (l.a * r.a) as score
  from cuts c join f l on l.lang = c.lang and l.phrase = c.lp join f r on r.lang = c.lang and r.phrase = c.rp
), lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
longer as (
  select lang, phrase, max(a) as most from (
    select lang, array_to_string(ws[1:2], ' ') as phrase, a from cand where k = 3
    union all select lang, array_to_string(ws[2:3], ' '), a from cand where k = 3
  ) group by all
), ranked as (
  select w.lang, row_number() over (partition by w.lang order by score desc, w.a desc, w.phrase) as rank, w.phrase, w.a, l, r, score
  from lowest w left join longer g on g.lang = w.lang and g.phrase = w.phrase where most is null or 100 * most < 50 * w.a
)
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score from ranked join n using (lang) where rank <= 2000
"""
