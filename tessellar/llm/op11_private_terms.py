"""Sanitisation of personal data: fixed forms, and terms that reveal their holders, by information theory.

Entities are the values found by form: e-mail and IP addresses, payment cards, phone numbers. An
entity c of df(c) of all N documents holds IC(c) = log2(N / df(c)) bits. A term t that stands near c in
df(c, t) of its df(t) documents reveals PMI(c, t) = log2(df(c, t) N / (df(c) df(t))) of them: all, if t stands
nowhere else. Terms that reveal `disclose` of an entity's bits or more are generalised to a class of
terms; those that reveal `remove` or more are removed. Terms are words of at least LEAST_LETTERS letters or digits.

Co-occurrence is estimated over all documents. It must come from independent places: with n_i documents for each pair
of words next to t, the effective number of contexts (sum n_i)^2 / sum n_i^2 has to be `contexts` or more, so
a group of copies, edited here and there, counts as about one. Entities of more than `public` of all documents
are public, and nothing that goes with them is held back.

Three passes of the texts: windows about entities; documents of the terms found there; places of
revealing terms. The latter two look words up in a sieve of SIEVE_BITS bits, whatever the number of terms, and
what it lets through is joined with the table of terms, so no table of terms is broadcast or collected. Rows
are handed out under keys of their own, so copies and rows without id stay apart.

Defined cases: null text is empty; a very long text is scanned whole, in time linear in its length; ties don't arise, as
all that reaches a threshold counts; repeated rows give repeated rows; an empty table gives an empty result; other
columns are ignored or carried, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.llm.common import claim, slices, table, texts_of, written
from tessellar.llm.components import looked_up

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Words about an entity, on either side, within so many characters of it.
WINDOW, REACH = 8, 200
LEAST_LETTERS = 3
DISCLOSE, REMOVE, CONTEXTS, PUBLIC = 0.8, 0.95, 4, 0.01
SIEVE_BITS = 1 << 24
#: Counters that a task holds before it hands them on.
HELD = 100_000

# Fixed forms, written so that no place is scanned more than a few times: none begins within a run of what it begins with.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes of words stay, A-Z in lower case; the rest become spaces.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LOWER = {b: b + 32 for b in range(65, 91)}
_NOT_DIGIT = re.compile(r"[^0-9]+")

SPANS = pa.list_(pa.struct({"kind": pa.string(), "start": pa.int64(), "end": pa.int64()}))


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, at, done = [], text.find("@"), 0
    while at >= 0:
        if found := _DOMAIN.match(text, at + 1):
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                done = found.end()
                out.append((start, done))
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    out = [("email", a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(part := p.lstrip("0")) <= 3 and int(part or 0) <= 255 for p in m.group().split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


def value_of(kind: str, found: str) -> str:
    """What tells an entity from others however it is written."""
    return f"{kind}:{found.translate(_LOWER) if kind == 'email' else found if kind == 'ip' else _NOT_DIGIT.sub('', found)}"


def outside(spans: list[tuple[str, int, int]]):
    """Tells whether start..end is in no span."""
    merged: list[list[int]] = []
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    starts = [a for a, _ in merged]

    def test(start: int, end: int) -> bool:
        k = bisect_right(starts, end - 1) - 1
        return k < 0 or merged[k][1] <= start

    return test


def near(text: str, start: int, end: int, free) -> list[str]:
    """Words (A-Z in lower case) of the window about start..end that are in no span, and whole."""
    a, b = max(0, start - REACH), min(len(text), end + REACH)
    before = [m.span() for m in _WORD.finditer(text, a, start) if m.start() > a or not a]
    after = [m.span() for m in islice(_WORD.finditer(text, end, b), WINDOW) if m.end() < b or b == len(text)]
    return [text[x:y].translate(_LOWER) for x, y in before[-WINDOW:] + after if free(x, y)]


def evidence(text: str) -> tuple[set[str], dict[tuple[str, str], int]]:
    """Entities of a text, and (entity, term near it) with the words next to the term, as a number."""
    spans = base_spans(text)
    entities, found = set(), {}
    free = outside(spans)
    for kind, a, b in spans:
        entity = value_of(kind, text[a:b])
        entities.add(entity)
        words = ["", *near(text, a, b, free), ""]
        for k in range(1, len(words) - 1):
            if len(words[k]) >= LEAST_LETTERS:
                found.setdefault((entity, words[k]), zlib.crc32(words[k - 1].encode()) << 31 ^ zlib.crc32(words[k + 1].encode()))
    return entities, found


def _each_text(batches, column: int):
    for batch in batches:
        for part in slices(batch, column):
            yield from texts_of(part, column)


def entity_evidence(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(entity, term, context, n): documents of each entity (term and context null) and of each term near it by context."""

    def run(batches):
        claim("private", lambda: None)
        held: Counter = Counter()
        for text in _each_text(batches, 0):
            entities, found = evidence(text)
            held.update((e, None, None) for e in entities)
            held.update((e, t, c) for (e, t), c in found.items())
            if len(held) >= HELD:
                yield _columns(held)
                held.clear()
        yield _columns(held)

    def _columns(held):
        return pa.RecordBatch.from_arrays([pa.array([k[i] for k in held], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))] + [pa.array(held.values(), pa.int64())], ["entity", "term", "context", "n"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "entity string, term string, context long, n long")


def sieve(terms: DataFrame) -> np.ndarray:
    """Bits (by crc32) of the terms; at most SIEVE_BITS / 64 rows come to the driver."""
    bit = terms.select(F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(SIEVE_BITS)).alias("bit"))
    rows = bit.groupBy(F.expr("bit div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits")).toArrow()
    out = np.zeros(SIEVE_BITS // 64, np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return out


def _let_through(words, bits: np.ndarray) -> set[bytes]:
    """Distinct words whose bit is set."""
    words = list(words)
    at = np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words)) % SIEVE_BITS
    return {words[i] for i in np.flatnonzero(bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).tolist()}


def _words_of(text: str) -> set[bytes]:
    return set(text.encode().translate(_TABLE).split())


def term_documents(docs: DataFrame, bits, text_col: str = "text") -> DataFrame:
    """(term, n): documents that hold each word that the sieve lets through."""

    def run(batches):
        claim("private", lambda: None)
        held: Counter = Counter()
        for text in _each_text(batches, 0):
            held.update(_let_through(_words_of(text), bits.value))
            if len(held) >= HELD:
                yield _columns(held)
                held.clear()
        yield _columns(held)

    def _columns(held):
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(held.values(), pa.int64())], ["term", "n"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def revealing_terms(spark: SparkSession, docs: DataFrame, text_col: str = "text", disclose: float = DISCLOSE, contexts: float = CONTEXTS, public: float = PUBLIC) -> DataFrame:
    """Written table (term, share): terms that reveal `disclose` or more of some entity's bits, and the most that each reveals."""
    found = written(spark, entity_evidence(docs, text_col).groupBy("entity", "term", "context").agg(F.sum("n").alias("n")), "evidence")
    total = docs.count()
    entities = found.where("term is null").select("entity", F.col("n").alias("of_entity")).where(F.col("of_entity") <= public * total)
    square = F.sum(F.col("n").cast("double") * F.col("n"))
    joint = found.where("term is not null").groupBy("entity", "term").agg(F.sum("n").alias("both"), square.alias("square")).where(F.col("both").cast("double") * F.col("both") >= contexts * F.col("square"))
    pairs = written(spark, joint.join(entities, "entity"), "pairs")
    if pairs.limit(1).count():
        bits_of = spark.sparkContext.broadcast(sieve(pairs.select("term").dropDuplicates()))
        documents = written(spark, term_documents(docs, bits_of, text_col), "documents")
    else:
        documents = pairs.selectExpr("term", "0L as n")
    bits = lambda x: F.log2(x.cast("double"))
    share = (bits(F.col("both")) + bits(F.lit(max(total, 1))) - bits(F.col("of_entity")) - bits(F.col("n"))) / (bits(F.lit(max(total, 1))) - bits(F.col("of_entity")))
    shares = looked_up(pairs, documents, "term", "inner").where(F.col("of_entity") < total).withColumn("share", share)
    return written(spark, shares.where(F.col("share") >= disclose - 1e-9).groupBy("term").agg(F.max("share").alias("share")), "revealing")


def class_of(term: str) -> str:
    """What a term is generalised to."""
    return "NUMBER" if any(c.isdigit() for c in term) else "NAME" if term[:1].isupper() else "TERM"


def find_private(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclose: float = DISCLOSE, remove: float = REMOVE, contexts: float = CONTEXTS, public: float = PUBLIC, carry: list[str] | None = None) -> DataFrame:
    """id_col, the columns to carry, base and terms: arrays of kind, start and end; a term's kind is `generalise` or `remove`."""
    carry = carry or []
    terms = revealing_terms(spark, docs, text_col, disclose, contexts, public)
    some = terms.limit(1).count() > 0
    bits = spark.sparkContext.broadcast(sieve(terms)) if some else None

    def run(batches):
        claim("private", lambda: None)
        key = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, 0):
                base, hits = [], []
                for text in texts_of(part, 0):
                    spans = base_spans(text)
                    base.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                    words = {w.decode() for w in _let_through(_words_of(text), bits.value)} if some else None
                    free = outside(spans) if words else None
                    hits.append([{"kind": w, "start": m.start(), "end": m.end()} for m in _WORD.finditer(text) if (w := m.group().translate(_LOWER)) in words and free(*m.span())] if words else [])
                keys = pa.array(np.arange(key, key + part.num_rows))
                key += part.num_rows
                yield pa.RecordBatch.from_arrays([keys, part.column(1), pa.array(base, SPANS), pa.array(hits, SPANS)], ["row_key", "kept", "base", "hits"])

    kept = F.struct(F.col(id_col).alias("id"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)))
    source = docs.select(F.col(text_col).cast("string").alias("text"), kept.alias("kept"))
    span = "array<struct<kind:string,start:long,end:long>>"
    rows = source.mapInArrow(run, f"row_key long, kept {source.schema['kept'].dataType.simpleString()}, base {span}, hits {span}")
    out = [F.col("kept.id").alias(id_col), *(F.col(f"kept.c{i}").alias(c) for i, c in enumerate(carry)), "base"]
    if not some:
        return rows.select(*out, F.col("hits").alias("terms"))
    rows = written(spark, rows, "scanned")
    hits = rows.select("row_key", F.inline("hits")).join(terms, F.col("kind") == F.col("term"))
    action = F.when(F.col("share") >= remove, "remove").otherwise("generalise")
    found = hits.groupBy("row_key").agg(F.sort_array(F.collect_list(F.struct("start", "end", action.alias("kind")))).alias("terms"))
    found = found.select("row_key", F.expr("transform(terms, t -> named_struct('kind', t.kind, 'start', t.start, 'end', t.end))").alias("terms"))
    return rows.join(found, "row_key", "left").select(*out, F.coalesce("terms", F.slice("hits", 1, 0)).alias("terms"))


def sanitised(found: DataFrame, text_col: str = "text") -> DataFrame:
    """The carried text with entities by their kinds, terms by their classes or without them; of what overlaps the first counts for all."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1):
                texts = []
                for text, base, terms in zip(*(part.column(i).to_pylist() for i in (-1, -3, -2)), strict=True):
                    out, at = [], 0
                    for s in sorted([*base, *terms], key=lambda s: (s["start"], -s["end"])):
                        if s["start"] >= at:
                            kind = s["kind"]
                            out += [text[at : s["start"]], "" if kind == "remove" else f"[{class_of(text[s['start'] : s['end']]) if kind == 'generalise' else kind.upper()}]"]
                        at = max(at, s["end"])
                    texts.append("".join([*out, text[at:]]) if text is not None else None)
                yield pa.RecordBatch.from_arrays([*part.columns[:-3], pa.array(texts, pa.string())], names)

    others = [c for c in found.columns if c not in (text_col, "base", "terms")]
    source = found.select(*others, "base", "terms", F.col(text_col).cast("string").alias(text_col))
    names = [*others, text_col]
    return source.mapInArrow(run, source.select(names).schema)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    said = lambda c, kind: F.transform(c, lambda s: F.concat_ws(":", kind(s), s["start"], s["end"]))
    base = said("base", lambda s: s["kind"])
    of = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(of, lambda k: k == kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]  # noqa: B023
    return found.select(id_col, *counts, F.sha2(F.concat_ws(",", base).cast("binary"), 256).alias("base_sha256"), F.concat_ws(",", base, said("terms", lambda s: F.lit(TERM))).alias("spans"))


def op11_private_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_private(spark, table(spark, sf_dir, "documents")))
