"""Retrieval queries over documents as chunks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessellar.functions.numbers import cosine, dot
from tessellar.functions.text import excerpt, lexical_score, tokenize
from tessellar.operators import retrieval as R
from tessellar.plans.base import CHUNKS, VECTORS, chunks, vectors

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

TERMS = ["thandor", "tion", "heit", "the"]
SCOPE = R.Scope(allow_company=True, allow_private=False, all_sites=False, sites=(0, 1, 2))
IN_SCOPE = "((document_scope = 'public' AND access_level = 'public') OR (document_scope = 'company' AND access_level <> 'private' AND site_id IN (0, 1, 2)))"
QUERY_VECTOR = "(SELECT embedding FROM vectors WHERE chunk_id = 0)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def embedded(spark: SparkSession, sf_dir: str, **derived) -> DataFrame:
    """Chunks without their text, with keyword coverage, other columns derived from it, and vector: the text takes no part in the join."""
    rows = chunks(spark, sf_dir).where(R.in_scope(SCOPE)).withColumns({"keyword": lexical_score(TERMS, F.col("content")), **derived}).drop("content", "content_hash")
    return rows.join(vectors(spark, sf_dir), "chunk_id")


def question(spark: SparkSession, sf_dir: str) -> list[float]:
    """The request's vector: one row, the request itself."""
    row = vectors(spark, sf_dir).where("chunk_id = 0").select("embedding").first()
    return row[0] if row else [1.0]


def term_sql(term: str, text: str = "lower(content)") -> str:
    """The matching rule for one lower-case Latin term."""
    if len(term) <= 3:
        return f"regexp_matches({text}, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')"
    squeezed = f"contains(regexp_replace({text}, '[\\s_-]+', '', 'g'), '{term}')"
    tokens = f"list_transform(regexp_extract_all({text}, '[0-9a-z가-힣_-]+'), lambda x: regexp_replace(x, '^[_-]+|[_-]+$', '', 'g'))"
    within = f"len(list_filter({tokens}, lambda x: length(x) >= 4 AND (contains(x, '{term}') OR contains('{term}', x)))) > 0"
    return f"(contains({text}, '{term}') OR {squeezed} OR {within})"


LEXICAL = "(" + " + ".join(f"CASE WHEN {term_sql(t)} THEN 1.0::DOUBLE ELSE 0 END" for t in TERMS) + f") / {len(TERMS)}"
SCORED = f"""WITH {CHUNKS}, {VECTORS}, scored AS (
  SELECT c.*, v.embedding, list_cosine_similarity(v.embedding, {QUERY_VECTOR}) AS similarity, {LEXICAL} AS keyword
  FROM chunks c JOIN vectors v USING (chunk_id) WHERE {IN_SCOPE})"""


def scored(spark: SparkSession, sf_dir: str, **derived) -> DataFrame:
    vector = F.array(*map(F.lit, question(spark, sf_dir)))
    return embedded(spark, sf_dir, **derived).withColumn("similarity", cosine(F.col("embedding"), vector))


@query("hybrid_topk", f"{SCORED} SELECT chunk_id, document_id, round(similarity, 6) AS similarity, round(keyword, 6) AS keyword, round(0.75 * similarity + 0.25 * least(keyword, 1.0), 6) AS score FROM scored WHERE similarity >= 0.25 OR keyword > 0 ORDER BY 0.75 * similarity + 0.25 * least(keyword, 1.0) DESC, chunk_id LIMIT 30")
def hybrid_topk(spark, sf_dir):
    out = R.top_k(R.gate(scored(spark, sf_dir)), R.blend(), 30)
    return out.select("chunk_id", "document_id", *(F.round(c, 6).alias(c) for c in ("similarity", "keyword", "score")))


@query("cosine_topk", f"WITH {VECTORS} SELECT chunk_id, round(list_cosine_similarity(embedding, {QUERY_VECTOR}), 6) AS similarity FROM vectors WHERE 1 - list_cosine_similarity(embedding, {QUERY_VECTOR}) <= 0.75 ORDER BY list_cosine_similarity(embedding, {QUERY_VECTOR}) DESC, chunk_id LIMIT 10")
def cosine_topk(spark, sf_dir):
    v = vectors(spark, sf_dir)
    rows = v.withColumn("similarity", cosine(F.col("embedding"), F.array(*map(F.lit, question(spark, sf_dir)))))
    return R.top_k(rows.where(1 - F.col("similarity") <= 0.75), F.col("similarity"), 10).select("chunk_id", F.round("similarity", 6).alias("similarity"))


@query("scope_filter", f"WITH {CHUNKS} SELECT chunk_id, document_id, source_type FROM chunks WHERE {IN_SCOPE} AND source_type IN ('public_guide', 'equipment_manual')")
def scope_filter(spark, sf_dir):
    return chunks(spark, sf_dir).where(R.in_scope(SCOPE) & R.scope_clause(["public_guide", "equipment_manual"])).select("chunk_id", "document_id", "source_type")


@query("keyword_gate", f"{SCORED} SELECT source_type, count(*) AS n, count(*) FILTER (WHERE keyword > 0) AS n_keyword, count(*) FILTER (WHERE similarity >= 0.25) AS n_similar FROM scored WHERE similarity >= 0.25 OR keyword > 0 GROUP BY source_type")
def keyword_gate(spark, sf_dir):
    return R.gate(scored(spark, sf_dir)).groupBy("source_type").agg(F.count("*").alias("n"), F.count_if(F.col("keyword") > 0).alias("n_keyword"), F.count_if(F.col("similarity") >= 0.25).alias("n_similar"))


@query("ready_chunk_count", f"WITH {CHUNKS} SELECT document_scope, count(*) AS n FROM chunks WHERE {IN_SCOPE} GROUP BY document_scope")
def ready_chunk_count(spark, sf_dir):
    return chunks(spark, sf_dir).where(R.in_scope(SCOPE)).groupBy("document_scope").agg(F.count("*").alias("n"))


@query("lexical_score", f"WITH {CHUNKS} SELECT chunk_id, round({LEXICAL}, 6) AS keyword FROM chunks")
def lexical(spark, sf_dir):
    return chunks(spark, sf_dir).select("chunk_id", F.round(lexical_score(TERMS, F.col("content")), 6).alias("keyword"))


SEEDS = "seeds AS (SELECT *, 0.75 * similarity + 0.25 * least(keyword, 1.0) AS score FROM scored WHERE similarity >= 0.25 OR keyword > 0 ORDER BY score DESC, chunk_id LIMIT 12)"


def seeds(spark, sf_dir):
    return R.top_k(R.gate(scored(spark, sf_dir)), R.blend(), 12)


NEAR = f"""{SCORED}, {SEEDS}, near AS (
  SELECT c.chunk_id, c.document_id, c.chunk_index, max(greatest(0.25::DOUBLE, s.similarity - 0.01::DOUBLE * abs(c.chunk_index - s.chunk_index))) AS inherited
  FROM seeds s JOIN chunks c ON c.document_id = s.document_id AND c.chunk_index BETWEEN s.chunk_index - 2 AND s.chunk_index + 2 GROUP BY ALL)"""


@query("neighbor_expand", f"{NEAR} SELECT chunk_id, document_id, chunk_index FROM near")
def neighbor_expand(spark, sf_dir):
    return R.neighbours(seeds(spark, sf_dir), chunks(spark, sf_dir), 2).select("chunk_id", "document_id", "chunk_index")


@query("neighbor_score", f"{NEAR} SELECT chunk_id, round(inherited, 6) AS inherited FROM near WHERE chunk_id NOT IN (SELECT chunk_id FROM seeds)")
def neighbor_score(spark, sf_dir):
    near = R.neighbours(seeds(spark, sf_dir), chunks(spark, sf_dir), 2)
    return near.where(~F.col("seed")).select("chunk_id", F.round("inherited", 6).alias("inherited"))


def _part_sql(i: int, where: str) -> str:
    return f"SELECT chunk_id, source_type, {i} AS part FROM (SELECT * FROM scored WHERE {where} ORDER BY 0.75 * similarity + 0.25 * least(keyword, 1.0) DESC, chunk_id LIMIT 15)"


@query("supplement_union", f"{SCORED}, parts AS ({_part_sql(0, 'true')} UNION ALL {_part_sql(1, chr(39).join(['source_type = ', 'company_policy', '']))} UNION ALL {_part_sql(2, chr(39).join(['source_type = ', 'public_guide', '']))} UNION ALL {_part_sql(3, chr(39).join(['source_type = ', 'public_incident', '']))}) SELECT chunk_id, any_value(source_type) AS source_type, min(part) AS part FROM parts GROUP BY chunk_id")
def supplement_union(spark, sf_dir):
    return R.supplemented(scored(spark, sf_dir), R.blend(), 15, ["company_policy", "public_guide", "public_incident"]).select("chunk_id", "source_type", "part")


def ranked(spark, sf_dir, k: int = 60) -> DataFrame:
    """One request's bounded candidates with rerank scores."""
    rows = R.gate(scored(spark, sf_dir)).withColumn("blend", R.blend())
    rows = rows.withColumn("metadata", (F.col("page") % 10) / 10.0).withColumn("action", (F.col("chunk_id") % 2).cast("double")).withColumn("safety", (F.col("chunk_id") % 4) / 3.0)
    # all columns before the limit: what is computed after one would part it from its sort, and sort everything
    return rows.withColumn("score", F.round(R.rerank_score(True), 6)).orderBy(F.desc("blend"), "chunk_id").limit(k)


BUCKET_SQL = "CASE WHEN source_type IN ('equipment_manual', 'component_manual') THEN 'manual' ELSE source_type END"
RANKED = f"""{SCORED}, candidates AS (
  SELECT *, (page % 10) / 10.0::DOUBLE AS metadata, (chunk_id % 2)::DOUBLE AS action, (chunk_id % 4) / 3.0::DOUBLE AS safety, {BUCKET_SQL} AS bucket FROM scored
  WHERE similarity >= 0.25 OR keyword > 0 ORDER BY 0.75 * similarity + 0.25 * least(keyword, 1.0) DESC, chunk_id LIMIT 60),
raw AS (SELECT *, 0.9::DOUBLE * (0.7::DOUBLE * greatest(0, similarity) + 0.3::DOUBLE * keyword) + 0.1::DOUBLE * metadata
  + CASE WHEN bucket = 'manual' THEN 0.08::DOUBLE WHEN bucket IN ('company_policy', 'public_law', 'public_guide', 'public_media') THEN 0.03 WHEN bucket = 'public_incident' THEN 0.01 ELSE 0 END
  + 0.12::DOUBLE * action + 0.04::DOUBLE * safety AS s FROM candidates),
ranked AS (SELECT *, round(CASE WHEN document_scope = 'public' AND action = 0 THEN greatest(0, s - 0.06::DOUBLE) ELSE s END, 6) AS score FROM raw)"""


@query("rerank_features", f"{RANKED} SELECT chunk_id, bucket, score FROM ranked")
def rerank_features(spark, sf_dir):
    return ranked(spark, sf_dir).select("chunk_id", R.bucket_of(F.col("source_type")).alias("bucket"), "score")


FIRST = "placed AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN rn = 1 THEN coalesce(list_position(['manual', 'company_policy', 'public_law', 'public_guide', 'public_media', 'public_incident'], bucket), 7) ELSE 7 END, score DESC, chunk_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY score DESC, chunk_id) AS rn FROM ranked))"


@query("bucket_first", f"{RANKED}, {FIRST} SELECT chunk_id, bucket, place FROM placed")
def bucket_first(spark, sf_dir):
    return R.bucket_first(ranked(spark, sf_dir)).select("chunk_id", "bucket", F.col("place").cast("long").alias("place"))


@query("diversify", f"{RANKED}, labelled AS (SELECT r.*, v.label FROM ranked r JOIN embeddings v ON v.vec_id = r.chunk_id), d AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, chunk_id) AS rn FROM labelled) SELECT chunk_id, label, row_number() OVER (ORDER BY CASE WHEN rn = 1 AND label < 5 THEN label ELSE 5 END, score DESC, chunk_id) AS place FROM d")
def diversify(spark, sf_dir):
    out = R.bucket_first(ranked(spark, sf_dir), order=("0", "1", "2", "3", "4"), bucket=F.col("label").cast("string"))
    return out.select("chunk_id", "label", F.col("place").cast("long").alias("place"))


@query("quota_approx", f"{RANKED}, {FIRST}, a AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY place) AS d FROM placed), b AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY place) AS k FROM a WHERE d <= 2) SELECT chunk_id, document_id, bucket, place FROM b WHERE k <= 3 ORDER BY place LIMIT 16")
def quota_approx(spark, sf_dir):
    rows = R.bucket_first(ranked(spark, sf_dir))
    return R.quotas_approximately(rows, 2, 3, 16).select("chunk_id", "document_id", "bucket", F.col("place").cast("long").alias("place"))


@query("quota_greedy")
def quota_greedy(spark, sf_dir):
    rows = R.bucket_first(ranked(spark, sf_dir)).withColumn("request_id", F.lit(1)).select("request_id", "chunk_id", "document_id", "bucket", "place", "score")
    return R.greedy_quotas(rows)


@query("diverse_selection")
def diverse_selection(spark, sf_dir):
    rows = R.bucket_first(ranked(spark, sf_dir)).withColumn("request_id", F.lit(1)).withColumn("priority", F.col("chunk_id") % 9 == 0)
    return R.diverse_selection(rows.select("request_id", "chunk_id", "document_id", "page", "bucket", "priority", "place", "score"), 10)


@query("route_margin", f"{SCORED}, d AS (SELECT source_type, document_id, max(similarity) AS s FROM scored GROUP BY ALL), r AS (SELECT *, row_number() OVER w AS rn, lead(s) OVER w AS second FROM d WINDOW w AS (PARTITION BY source_type ORDER BY s DESC, document_id)) SELECT source_type, document_id, round(s, 6) AS s, round(s - coalesce(second, 0), 6) AS margin, s >= 0.3 AND s - coalesce(second, 0) >= 0.05 AS routed FROM r WHERE rn = 1")
def route_margin(spark, sf_dir):
    best = scored(spark, sf_dir).groupBy("source_type", "document_id").agg(F.max("similarity").alias("s"))
    out = R.winner_margin(best, "source_type", "document_id", "s", 0.3, 0.05)
    return out.select("source_type", "document_id", F.round("s", 6).alias("s"), F.round("margin", 6).alias("margin"), "routed")


@query("content_hash_dedupe", f"WITH {CHUNKS} SELECT content_hash, min(chunk_id) AS chunk_id, count(*) AS n FROM chunks GROUP BY content_hash")
def content_hash_dedupe(spark, sf_dir):
    return chunks(spark, sf_dir).groupBy("content_hash").agg(F.min("chunk_id").alias("chunk_id"), F.count("*").alias("n"))


@query("first_by_hash", f"WITH {CHUNKS} SELECT arg_min(chunk_id, chunk_id) AS chunk_id, content_hash, arg_min(title, chunk_id) AS title FROM chunks GROUP BY content_hash")
def first_by_hash(spark, sf_dir):
    return R.first_by_hash(chunks(spark, sf_dir), "chunk_id").select("chunk_id", "content_hash", "title")


@query("candidate_projection", f"WITH {CHUNKS} SELECT chunk_id::VARCHAR AS chunk_id, coalesce(nullif(page, 50), 1) AS page, title AS section, left(content, 700) AS excerpt FROM chunks")
def candidate_projection(spark, sf_dir):
    return chunks(spark, sf_dir).select(F.col("chunk_id").cast("string").alias("chunk_id"), F.coalesce(F.nullif("page", F.lit(50)), F.lit(1)).alias("page"), F.col("title").alias("section"), excerpt(F.col("content")).alias("excerpt"))


@query("primary_document", f"{RANKED}, p AS (SELECT arg_max(document_id, (score, similarity, -chunk_id)) AS document_id FROM ranked) SELECT chunk_id, r.document_id, score FROM ranked r JOIN p USING (document_id)")
def primary_document(spark, sf_dir):
    rows = ranked(spark, sf_dir)
    best = rows.agg(F.max_by("document_id", F.struct("score", "similarity", -F.col("chunk_id"))).alias("document_id"))
    return rows.join(F.broadcast(best), "document_id").select("chunk_id", "document_id", "score")


@query("keyword_rank", f"WITH {CHUNKS}, w AS (SELECT chunk_id, regexp_extract_all(lower(content), '[0-9a-zÀ-ɏ가-힣]+') AS words FROM chunks) SELECT chunk_id, list_contains(words, 'the') AND list_contains(words, 'is') AND list_contains(words, 'for') AS all_terms FROM w")
def keyword_rank(spark, sf_dir):
    return R.cover_density(chunks(spark, sf_dir), ["the", "is", "for"], "chunk_id", "content").select("chunk_id", "all_terms")


@query("keyword_cover_rank")
def keyword_cover_rank(spark, sf_dir):
    return R.cover_density(chunks(spark, sf_dir), ["the", "is", "for"], "chunk_id", "content")


@query("max_view_similarity", f"WITH {VECTORS}, q AS (SELECT list(embedding ORDER BY chunk_id) AS qs FROM vectors WHERE chunk_id < 7) SELECT chunk_id, round(list_max(list_transform(qs, lambda q: list_dot_product(embedding, q))), 6) AS best FROM vectors, q")
def max_view_similarity(spark, sf_dir):
    v = vectors(spark, sf_dir)
    views = [r.embedding for r in v.where("chunk_id < 7").orderBy("chunk_id").select("embedding").collect()]  # a request's seven views
    return v.select("chunk_id", F.round(R.max_view_similarity(v, views), 6).alias("best"))


@query("page_dedupe_topk", f"{SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY title, page ORDER BY similarity DESC, chunk_id) AS rn FROM scored) SELECT title, page, chunk_id, round(similarity, 6) AS similarity FROM r WHERE rn = 1 ORDER BY r.similarity DESC, chunk_id LIMIT 8")
def page_dedupe_topk(spark, sf_dir):
    w = Window.partitionBy("title", "page").orderBy(F.desc("similarity"), "chunk_id")
    rows = scored(spark, sf_dir).withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return R.top_k(rows, F.col("similarity"), 8).select("title", "page", "chunk_id", F.round("similarity", 6).alias("similarity"))


@query("confidence_bands", f"WITH {VECTORS} SELECT CASE WHEN s >= 0.9 THEN 'high' WHEN s >= 0.82 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM (SELECT least(greatest(round(list_dot_product(embedding, {QUERY_VECTOR}), 4), 0), 1) AS s FROM vectors) GROUP BY 1")
def confidence_bands(spark, sf_dir):
    from tessellar.functions.numbers import clamp, confidence_band

    s = clamp(F.round(dot(F.col("embedding"), F.array(*map(F.lit, question(spark, sf_dir)))), 4), 0.0, 1.0)
    return vectors(spark, sf_dir).select(confidence_band(s).alias("band")).groupBy("band").agg(F.count("*").alias("n"))


@query("category_bonus", f"{SCORED} SELECT chunk_id, round(similarity + CASE WHEN regexp_matches(lower(content), 'tion|heit') THEN 0.08::DOUBLE ELSE 0 END, 6) AS score FROM scored")
def category_bonus(spark, sf_dir):
    bonus = F.when(F.lower("content").rlike("tion|heit"), 0.08).otherwise(0.0)
    return scored(spark, sf_dir, bonus=bonus).select("chunk_id", F.round(F.col("similarity") + F.col("bonus"), 6).alias("score"))


@query("fetch_versions_chunks", f"WITH {CHUNKS} SELECT chunk_id, document_id, chunk_index FROM chunks WHERE document_id IN (SELECT document_id FROM chunks WHERE access_level = 'public' AND source_type = 'equipment_manual')")
def fetch_versions_chunks(spark, sf_dir):
    every = chunks(spark, sf_dir)
    cited = every.where("access_level = 'public' and source_type = 'equipment_manual'").select("document_id")
    return every.join(cited, "document_id", "left_semi").select("chunk_id", "document_id", "chunk_index")


_TOKENS = "list_filter(list_transform(regexp_extract_all(lower(content), '[0-9a-z가-힣_-]+'), lambda x: regexp_replace(x, '^[_-]+|[_-]+$', '', 'g')), lambda x: length(x) >= 2)"


@query("keyword_list", f"WITH {CHUNKS}, t AS (SELECT chunk_id, unnest({_TOKENS}) AS t, generate_subscripts({_TOKENS}, 1) AS pos FROM chunks), f AS (SELECT chunk_id, t, min(pos) AS pos FROM t GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY pos) AS rn FROM f) SELECT c.chunk_id, coalesce(list(t ORDER BY pos) FILTER (rn <= 30), []) AS keywords FROM chunks c LEFT JOIN r USING (chunk_id) GROUP BY c.chunk_id")
def keyword_list(spark, sf_dir):
    return chunks(spark, sf_dir).select("chunk_id", F.slice(tokenize(F.col("content")), 1, 30).alias("keywords"))


@query("metadata_inheritance", f"WITH {CHUNKS} SELECT chunk_id, title AS doc_source, CASE WHEN access_level = 'site' THEN title ELSE access_level END AS merged, nullif(CASE WHEN chunk_index = 0 THEN '' ELSE source_type END, '') AS kept FROM chunks")
def metadata_inheritance(spark, sf_dir):
    doc = F.create_map(F.lit("source"), F.col("title"), F.lit("level"), F.col("title"), F.lit("kind"), F.lit(""))
    own = F.create_map(F.lit("level"), F.when(F.col("access_level") != "site", F.col("access_level")).otherwise(""), F.lit("kind"), F.when(F.col("chunk_index") != 0, F.col("source_type")).otherwise(""))
    full = lambda m: F.map_filter(m, lambda k, v: v != "")
    own, doc = full(own), full(doc)
    # the chunk's values win: the document's keys that it doesn't have, and its own
    merged = F.map_concat(F.map_filter(doc, lambda k, v: ~F.map_contains_key(own, k)), own)
    return chunks(spark, sf_dir).select("chunk_id", merged["source"].alias("doc_source"), merged["level"].alias("merged"), merged["kind"].alias("kept"))


CHOSEN = list(range(0, 90, 2))
#: Customers as documents, nations as types, orders as versions, their lines as chunks.
FOUR = f"""d AS (SELECT c_custkey AS document_id, c_nationkey AS type_code, CASE c_custkey % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'site' ELSE 'private' END AS access_level, c_custkey % 5 AS site_id, CASE WHEN c_custkey % 7 = 3 THEN 'draft' ELSE 'active' END AS lifecycle_status, CASE WHEN c_custkey % 13 = 1 THEN 1 END AS deleted_at FROM customer),
    y AS (SELECT n_nationkey AS type_code, CASE WHEN n_regionkey % 2 = 0 THEN 'public' ELSE 'company' END AS document_scope, n_nationkey % 6 <> 1 AS is_active FROM nation),
    v AS (SELECT o_orderkey AS version_id, o_custkey AS document_id, o_orderkey AS version_number, CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'review_required' ELSE 'superseded' END AS status, o_orderkey % 3 AS uploaded_by FROM orders),
    c AS (SELECT l_orderkey * 8 + l_linenumber AS chunk_id, o_custkey AS document_id, CASE WHEN l_linenumber % 4 <> 0 THEN l_orderkey END AS version_id, CASE WHEN l_linenumber = 3 THEN 'pending' ELSE 'ready' END AS embedding_status FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query(
    "four_way_candidates",
    f"""WITH {FOUR} SELECT chunk_id, c.document_id, c.version_id, document_scope, status FROM c JOIN d USING (document_id) JOIN y USING (type_code) LEFT JOIN v ON v.version_id = c.version_id
    WHERE embedding_status = 'ready' AND deleted_at IS NULL AND is_active AND (
      (lifecycle_status = 'active' AND (c.version_id IS NULL OR status = 'active') AND ((document_scope = 'public' AND access_level = 'public') OR (document_scope = 'company' AND access_level <> 'private' AND site_id IN (0, 1, 2))))
      OR (c.document_id IN {tuple(CHOSEN)} AND document_scope = 'company' AND status = 'review_required' AND uploaded_by = 2 AND version_number = (SELECT max(w.version_number) FROM v w WHERE w.document_id = c.document_id AND w.status = 'review_required' AND w.uploaded_by = 2)))
    AND (c.document_id IN {tuple(CHOSEN)} OR (document_scope = 'public' AND access_level = 'public'))""",
)
def four_way_candidates(spark, sf_dir):
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    k, n, o = F.col("c_custkey"), F.col("n_nationkey"), F.col("o_orderkey")
    access = F.when(k % 3 == 0, "public").when(k % 3 == 1, "site").otherwise("private")
    documents = t("customer").select(k.alias("document_id"), F.col("c_nationkey").alias("type_code"), access.alias("access_level"), (k % 5).alias("site_id"), F.when(k % 7 == 3, "draft").otherwise("active").alias("lifecycle_status"), F.when(k % 13 == 1, 1).alias("deleted_at"))
    types = t("nation").select(n.alias("type_code"), F.when(F.col("n_regionkey") % 2 == 0, "public").otherwise("company").alias("document_scope"), (n % 6 != 1).alias("is_active"))
    status = F.when(F.col("o_orderstatus") == "F", "active").when(F.col("o_orderstatus") == "O", "review_required").otherwise("superseded")
    versions = t("orders").select(o.alias("version_id"), F.col("o_custkey").alias("document_id"), o.alias("version_number"), status.alias("status"), (o % 3).alias("uploaded_by"))
    line = F.col("l_linenumber")
    lines = t("lineitem").join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("document_id")), "l_orderkey")
    rows = lines.select((F.col("l_orderkey") * 8 + line).alias("chunk_id"), "document_id", F.when(line % 4 != 0, F.col("l_orderkey")).alias("version_id"), F.when(line == 3, "pending").otherwise("ready").alias("embedding_status"))
    found = R.candidates(rows, documents, types, versions, SCOPE, user=2, chosen_documents=CHOSEN, supplements=True)
    return found.select("chunk_id", "document_id", "version_id", "document_scope", "status")
