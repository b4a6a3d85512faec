"""Hybrid retrieval: access scope, exact similarity, keyword coverage, supplements, neighbours,
reranking, quotas. Operators take and return DataFrames; a request is a small dataclass."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellar.functions.numbers import cosine, dot
from tessellar.functions.text import lexical_score

MIN_SIMILARITY = 0.25
#: Buckets in the order in which their best rows come first.
BUCKETS = ("manual", "company_policy", "public_law", "public_guide", "public_media", "public_incident")


@dataclass(frozen=True)
class Scope:
    """What a user may read."""

    allow_company: bool = False
    allow_private: bool = False
    all_sites: bool = False
    sites: tuple[int, ...] = ()


def in_scope(scope: Scope) -> Column:
    """Public documents with public access; company ones as the scope allows."""
    public = (F.col("document_scope") == "public") & (F.col("access_level") == "public")
    if not scope.allow_company:
        return public
    company = F.col("document_scope") == "company"
    if not scope.allow_private:
        company &= F.col("access_level") != "private"
    if not scope.all_sites:
        company &= F.col("site_id").isin(list(scope.sites))
    return public | company


def scope_clause(types: list[str] | None = None, documents: list[int] | None = None) -> Column:
    """Optional restrictions; an explicit empty list is an error."""
    out = F.lit(True)
    for column, values in (("source_type", types), ("document_id", documents)):
        if values is not None:
            if not values:
                raise ValueError(f"{column}: an explicit list must not be empty")
            out &= F.col(column).isin(list(dict.fromkeys(values)))
    return out


def selected(column: str, chosen: list, supplements: bool) -> Column:
    """An independent restriction by documents or versions; none if nothing is chosen, and public supplements pass it."""
    if not chosen:
        return F.lit(True)
    out = F.coalesce(F.col(column).isin(chosen), F.lit(False))
    return out | ((F.col("document_scope") == "public") & (F.col("access_level") == "public")) if supplements else out


def may_read(scope: Scope, deleted: str = "deleted_at") -> Column:
    """The access check of one document row: not deleted, active, and in scope."""
    return F.col(deleted).isNull() & (F.col("lifecycle_status") == "active") & F.coalesce(in_scope(scope), F.lit(False))


def candidates(chunks: DataFrame, documents: DataFrame, types: DataFrame, versions: DataFrame, scope: Scope, user: int | None = None, chosen_documents: list | None = None, chosen_versions: list | None = None, supplements: bool = False) -> DataFrame:
    """Ready chunks with their document, type and version, as far as a request may see them.

    chunks (document_id, version_id, embedding_status), documents (document_id, type_code, access_level, site_id, lifecycle_status,
    deleted_at), types (type_code, document_scope, is_active), versions (version_id, document_id, version_number, status,
    uploaded_by). Seen are chunks of active versions, or of none, of documents that may be read; and, of chosen company
    documents, the newest version under review that the user uploaded. Types and each user's drafts are joined as they are
    small by nature; Spark decides by size how.
    """
    own = versions.where((F.col("status") == "review_required") & (F.col("uploaded_by") == user)) if user is not None else versions.limit(0)
    newest = own.groupBy("document_id").agg(F.max("version_number").alias("newest_own"))
    rows = chunks.where("embedding_status = 'ready'").join(documents.where("deleted_at is null"), "document_id").join(types.where("is_active"), "type_code")
    rows = rows.join(versions.select("version_id", "version_number", "status", "uploaded_by"), "version_id", "left").join(newest, "document_id", "left")
    live = may_read(scope) & (F.col("version_id").isNull() | F.coalesce(F.col("status") == "active", F.lit(False)))
    draft = F.coalesce((F.col("document_scope") == "company") & (F.col("status") == "review_required") & (F.col("uploaded_by") == user) & (F.col("version_number") == F.col("newest_own")), F.lit(False)) if user is not None else F.lit(False)
    draft &= F.col("document_id").isin(chosen_documents) if chosen_documents else F.lit(False)
    return rows.where((live | draft) & selected("document_id", chosen_documents or [], supplements) & selected("version_id", chosen_versions or [], supplements)).drop("newest_own")


def bucket_of(source_type: Column) -> Column:
    return F.when(source_type.isin("equipment_manual", "component_manual"), "manual").otherwise(source_type)


def with_scores(chunks: DataFrame, query: list[float], terms: list[str]) -> DataFrame:
    """chunks (with embedding) with similarity and keyword coverage."""
    vector = F.array(*(F.lit(float(x)) for x in query))
    return chunks.withColumn("similarity", cosine(F.col("embedding"), vector)).withColumn("keyword", lexical_score(terms, F.col("content")))


def gate(scored: DataFrame, least: float = MIN_SIMILARITY) -> DataFrame:
    return scored.where((F.col("similarity") >= least) | (F.col("keyword") > 0))


def blend() -> Column:
    return 0.75 * F.col("similarity") + 0.25 * F.least(F.col("keyword"), F.lit(1.0))


def top_k(rows: DataFrame, score: Column, k: int, key: str = "chunk_id") -> DataFrame:
    """The k best by score, ties by key: a bounded heap in every task, then one of k rows each."""
    return rows.withColumn("score", score).orderBy(F.desc("score"), F.asc(key)).limit(k)


def neighbours(seeds: DataFrame, chunks: DataFrame, width: int = 1) -> DataFrame:
    """Chunks within `width` places of a seed in its document, each with its best inherited score and
    whether it is a seed itself.

    The interval becomes a few equal keys, so this is a hash join and not a nested loop.
    """
    near = seeds.select("document_id", F.col("chunk_index").alias("seed_index"), F.col("similarity").alias("seed_similarity"))
    near = near.withColumn("chunk_index", F.explode(F.sequence(F.col("seed_index") - width, F.col("seed_index") + width)))
    inherited = F.greatest(F.lit(MIN_SIMILARITY), F.col("seed_similarity") - 0.01 * F.abs(F.col("chunk_index") - F.col("seed_index")))
    best = near.withColumn("inherited", inherited).groupBy("document_id", "chunk_index").agg(F.max("inherited").alias("inherited"), F.bool_or(F.col("chunk_index") == F.col("seed_index")).alias("seed"))
    return chunks.join(best, ["document_id", "chunk_index"])


def union_first(parts: list[DataFrame], key: str = "chunk_id") -> DataFrame:
    """The union, of rows with one key the one from the earliest part."""
    tagged = [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
    every = tagged[0]
    for p in tagged[1:]:
        every = every.unionByName(p)
    first = F.row_number().over(Window.partitionBy(key).orderBy("part"))
    return every.withColumn("rn", first).where("rn = 1").drop("rn")


def supplemented(rows: DataFrame, score: Column, k: int, kinds: list[str], kind: str = "source_type", key: str = "chunk_id") -> DataFrame:
    """The k best rows of all (part 0) and of each kind given (part 1 and on), each in its first part: one pass.

    The best of all are among the k best of each kind there is, so only those are ranked together.
    """
    order = (F.desc("score"), F.asc(key))
    own = F.row_number().over(Window.partitionBy(kind).orderBy(*order))
    best = rows.withColumn("score", score).withColumn("rn", own).where(F.col("rn") <= k).drop("rn")
    part = F.when(F.row_number().over(Window.orderBy(*order)) <= k, 0)
    for i, name in enumerate(kinds, 1):
        part = part.when(F.col(kind) == name, i)
    return best.withColumn("part", part).where("part is not null")


def first_by_hash(rows: DataFrame, order: str) -> DataFrame:
    """Of rows with equal content the first in candidate order, not the best."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("content_hash").orderBy(order))).where("rn = 1").drop("rn")


def rerank_score(maintenance: bool = False) -> Column:
    """0.9 (0.7 similarity + 0.3 keyword) + 0.1 metadata, with bonuses by kind of source."""
    retrieval = 0.7 * F.greatest(F.lit(0.0), F.col("similarity")) + 0.3 * F.col("keyword")
    score = 0.9 * retrieval + 0.1 * F.col("metadata")
    if maintenance:
        bucket = bucket_of(F.col("source_type"))
        score += F.when(bucket == "manual", 0.08).when(bucket.isin("company_policy", "public_law", "public_guide", "public_media"), 0.03).when(bucket == "public_incident", 0.01).otherwise(0.0)
        score += 0.12 * F.col("action") + 0.04 * F.col("safety")
        score = F.when((F.col("document_scope") == "public") & (F.col("action") == 0), F.greatest(F.lit(0.0), score - 0.06)).otherwise(score)
    return score


def bucket_first(ranked: DataFrame, score: str = "score", key: str = "chunk_id", order: tuple[str, ...] = BUCKETS, bucket: Column | None = None) -> DataFrame:
    """Adds place: the best row of each bucket in the buckets' order, then all others by score."""
    own = bucket if bucket is not None else bucket_of(F.col("source_type"))
    rows = ranked.withColumn("bucket", own)
    rn = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc(score), F.asc(key)))
    rows = rows.withColumn("rn", rn)
    listed = F.array_position(F.array(*(F.lit(b) for b in order)), F.col("bucket"))
    lead = F.when((F.col("rn") == 1) & (listed > 0), listed)
    # over one request's bounded candidates
    place = F.row_number().over(Window.orderBy(F.coalesce(lead, F.lit(len(order) + 1)), F.desc(score), F.asc(key)))
    return rows.withColumn("place", place).drop("rn")


@dataclass(frozen=True)
class Quotas:
    per_document: int = 2
    per_bucket: tuple[tuple[str, int], ...] = (("manual", 4), ("company_policy", 2), ("public_law", 2), ("public_guide", 3), ("public_media", 3), ("public_incident", 2))
    total: int = 16


def greedy_quotas(ranked: DataFrame, quotas: Quotas = Quotas(), request: str = "request_id") -> DataFrame:
    """Walks each request's ranked candidates (place) and keeps what no quota forbids.

    What is kept depends on what was kept before, so this runs in Python, one request's bounded
    candidate set at a time.
    """
    limits = dict(quotas.per_bucket)

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        by_document: dict = {}
        by_bucket: dict = {}
        kept = []
        for i, (document, bucket) in enumerate(zip(rows["document_id"], rows["bucket"], strict=True)):
            if by_document.get(document, 0) >= quotas.per_document or by_bucket.get(bucket, 0) >= limits.get(bucket, math.inf):
                continue
            by_document[document] = by_document.get(document, 0) + 1
            by_bucket[bucket] = by_bucket.get(bucket, 0) + 1
            kept.append(i)
            if len(kept) == quotas.total:
                break
        return rows.iloc[kept]

    return ranked.groupBy(request).applyInPandas(walk, ranked.schema)


def quotas_approximately(ranked: DataFrame, per_document: int, per_bucket: int, total: int) -> DataFrame:
    """Independent quotas by windows: a native approximation of the greedy walk."""
    by_document = F.row_number().over(Window.partitionBy("document_id").orderBy("place"))
    rows = ranked.withColumn("d", by_document).where(F.col("d") <= per_document)
    by_bucket = F.row_number().over(Window.partitionBy("bucket").orderBy("place"))
    return rows.withColumn("b", by_bucket).where(F.col("b") <= per_bucket).orderBy("place").limit(total).drop("d", "b")


def diverse_selection(rows: DataFrame, limit: int, request: str = "request_id") -> DataFrame:
    """Picks again and again the best of score, less 0.35 for a page seen and 0.08 for a group seen,
    plus 0.12 for a new group after the first and 0.28 for priority; earlier rows win ties."""

    def pick(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("place").reset_index(drop=True)
        pages: set = set()
        groups: set = set()
        chosen: list[int] = []
        keys = list(zip(own["document_id"], own["page"], strict=True))
        for _ in range(min(limit, len(own))):
            best, at = -math.inf, -1
            for i, base in enumerate(own["score"]):
                if i in chosen:
                    continue
                value = base - 0.35 * (keys[i] in pages) + 0.28 * bool(own["priority"][i])
                value += -0.08 if own["bucket"][i] in groups else 0.12 * bool(chosen)
                if value > best:
                    best, at = value, i
            chosen.append(at)
            pages.add(keys[at])
            groups.add(own["bucket"][at])
        out = own.iloc[chosen].copy()
        out["pick"] = range(1, len(chosen) + 1)
        return out

    return rows.groupBy(request).applyInPandas(pick, f"{_ddl(rows)}, pick int")


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)


def winner_margin(scored: DataFrame, group: str, key: str, score: str, least: float, gap: float) -> DataFrame:
    """Of each group the best key with its lead over the second; routed if both are large enough."""
    w = Window.partitionBy(group).orderBy(F.desc(score), F.asc(key))
    rows = scored.withColumn("rn", F.row_number().over(w)).withColumn("second", F.lead(score).over(w)).where("rn = 1")
    margin = F.col(score) - F.coalesce("second", F.lit(0.0))
    return rows.withColumn("margin", margin).withColumn("routed", (F.col(score) >= least) & (F.col("margin") >= gap)).drop("rn", "second")


def cover_density(documents: DataFrame, terms: list[str], id_col: str, text_col: str) -> DataFrame:
    """All-terms indicator and cover-density rank: the sum over minimal covers of terms / length.

    The indicator is an expression; the ranks of rows that hold all terms come from one Arrow pass.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(r"([0-9a-zÀ-ɏ가-힣]+)"), 1)
    wanted = list(dict.fromkeys(t.lower() for t in terms))
    rows = documents.select(F.col(id_col).alias("id"), words.alias("words"))
    every = F.lit(bool(wanted))
    for t in wanted:
        every &= F.array_contains(F.col("words"), t)
    rows = rows.withColumn("all_terms", every).withColumn("words", F.when(F.col("all_terms"), F.col("words")))

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            out = [0.0 if w is None else sum(len(wanted) / (1 + b - a) for a, b in covers(list(w), wanted)) / 10 for w in own["words"]]
            yield own[["id", "all_terms"]].assign(rank=out)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(rank, f"id {kind}, all_terms boolean, rank double").withColumnRenamed("id", id_col)


def covers(words: list[str], wanted: list[str]) -> list[tuple[int, int]]:
    """Minimal intervals that hold every wanted word, from left to right."""
    last: dict[str, int] = {}
    out: list[tuple[int, int]] = []
    for i, w in enumerate(words):
        if w not in wanted:
            continue
        last[w] = i
        if len(last) == len(wanted):
            start = min(last.values())
            if not out or start > out[-1][0]:
                out.append((start, i))
    return out


def max_view_similarity(pages: DataFrame, views: list[list[float]]) -> Column:
    """The largest inner product with one of a few query views."""
    return F.greatest(*(dot(F.col("embedding"), F.array(*(F.lit(float(x)) for x in v))) for v in views)) if len(views) > 1 else dot(F.col("embedding"), F.array(*(F.lit(float(x)) for x in views[0])))


def expand_query(question: str, synonyms: dict[str, list[str]], groups: list[dict[str, list[str]]] = ()) -> list[str]:
    """A request's terms: its own tokens, the synonyms of those that occur in it, and the aliases of
    phrase groups that one of their triggers sets off; ordered, each once. Runs on the driver for one
    question."""
    low = question.lower()
    squeezed = "".join(c for c in low if not c.isspace() and c not in "_-")
    terms = [w for w in "".join(c if c.isalnum() or c in "_-" else " " for c in low).split() if len(w) >= 2]
    for word, more in synonyms.items():
        if word.lower() in low:
            terms += more
    for group in groups:
        if any("".join(t.lower().split()) in squeezed for t in group["triggers"]):
            terms += group["aliases"]
    return list(dict.fromkeys(terms))


@dataclass(frozen=True)
class DropRules:
    """What a candidate must show to be kept; lower-case terms."""

    topic: tuple[str, ...] = ()
    domain: tuple[str, ...] = ()
    negative: tuple[str, ...] = ()
    safety: tuple[str, ...] = ()
    least_similarity: float = MIN_SIMILARITY
    least_keyword: float = 0.08
    no_incidents: bool = False


def kept_by_rules(rows: DataFrame, rules: DropRules) -> DataFrame:
    """Candidates that no drop rule removes, with topic_hits, domain_hit and safety.

    In order: negative phrases without a positive one; a domain question needs the domain in public
    rows; enough topic terms; some topic, safety or domain evidence; similarity or keyword above its
    least; incidents only where wanted.
    """
    from tessellar.functions.text import signal_score, term_matches, topic_threshold

    low = F.lower(F.concat_ws(" ", "title", "content"))
    any_of = lambda terms: F.lit(False) if not terms else F.greatest(*(F.coalesce(term_matches(t, low), F.lit(False)) for t in (*terms, terms[0])))
    hits = sum((F.when(term_matches(t, low), 1).otherwise(0) for t in rules.topic), F.lit(0))
    out = rows.withColumn("topic_hits", hits).withColumn("domain_hit", any_of(rules.domain)).withColumn("safety", signal_score(list(rules.safety), low) if rules.safety else F.lit(0.0))
    keep = ~(any_of(rules.negative) & ~F.col("domain_hit"))
    if rules.domain:
        keep &= F.col("domain_hit") | (F.col("document_scope") != "public")
    enough = F.col("topic_hits") >= topic_threshold(F.lit(len(rules.topic)))
    keep &= (enough & F.lit(bool(rules.topic))) | F.col("domain_hit") | (F.col("safety") > 0)
    keep &= (F.col("similarity") >= rules.least_similarity) | (F.col("keyword") >= rules.least_keyword)
    if rules.no_incidents:
        keep &= F.col("source_type") != "public_incident"
    return out.where(keep)


def card_pages(chunks: DataFrame, signals: list[str], precautions: list[str], n: int = 3) -> DataFrame:
    """Of each document the first n pages whose section holds every signal word and no precaution,
    one chunk for a section."""
    low = F.lower("content")
    good = F.lit(True)
    for w in signals:
        good &= low.contains(w)
    for w in precautions:
        good &= ~low.contains(w)
    first = chunks.where(good).withColumn("rn", F.row_number().over(Window.partitionBy("document_id", "title").orderBy("chunk_index"))).where("rn = 1")
    return first.withColumn("rn", F.row_number().over(Window.partitionBy("document_id").orderBy("page", "chunk_index"))).where(F.col("rn") <= n).drop("rn")
