"""Upserts, job lifecycle, quality, risk and proximity: queries with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessellar.functions import numbers as N
from tessellar.operators import lifecycle as L
from tessellar.operators import merge as M
from tessellar.operators import quality as Q
from tessellar.operators import risk as K
from tessellar.plans.base import CHUNKS, EQUIPMENT, JOBS, VECTORS, VERSIONS, chunks, equipment, jobs, table, vectors, versions

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
NOW = "2024-01-20 00:00:00"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def now():
    return F.lit(NOW).cast("timestamp_ntz")


OLD_NEW = """o AS (SELECT p_partkey AS id, p_name AS name, p_size AS size FROM part WHERE p_partkey % 10 <> 0),
n AS (SELECT p_partkey AS id, p_name AS name, p_size + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS size FROM part WHERE p_partkey % 11 <> 0)"""


def old_new(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    return p.where("id % 10 <> 0"), p.where("id % 11 <> 0").withColumn("size", F.col("size") + F.when(F.col("id") % 7 == 0, 1).otherwise(0))


UPSERT = f"WITH {OLD_NEW}, m AS (SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.name ELSE o.name END AS name, CASE WHEN n.id IS NOT NULL THEN n.size ELSE o.size END AS size, CASE WHEN o.id IS NULL THEN 'inserted' WHEN n.id IS NULL THEN 'kept' WHEN n.name IS DISTINCT FROM o.name OR n.size IS DISTINCT FROM o.size THEN 'updated' ELSE 'unchanged' END AS outcome FROM o FULL JOIN n ON o.id = n.id)"


@query("upsert_changed_only", f"{UPSERT} SELECT * FROM m")
def upsert_changed_only(spark, sf_dir):
    return M.upsert(*old_new(spark, sf_dir), "id", ["name", "size"])


@query("upsert_outcomes", f"{UPSERT} SELECT outcome, count(*) AS n FROM m GROUP BY outcome")
def upsert_outcomes(spark, sf_dir):
    return upsert_changed_only(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"))


@query("invalidate_on_hash_change", f"WITH {CHUNKS}, {VECTORS} SELECT c.chunk_id, c.chunk_id % 6 <> 0 AND v.chunk_id IS NOT NULL AS has_vector, CASE WHEN v.chunk_id IS NULL OR c.chunk_id % 6 = 0 THEN 'pending' ELSE 'ready' END AS embedding_status FROM chunks c LEFT JOIN vectors v USING (chunk_id)")
def invalidate_on_hash_change(spark, sf_dir):
    new = chunks(spark, sf_dir).select("chunk_id", "content_hash")
    old = new.join(vectors(spark, sf_dir), "chunk_id").select("chunk_id", F.when(F.col("chunk_id") % 6 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"), "embedding", F.lit(None).cast("string").alias("embedding_error"), F.lit("ready").alias("embedding_status"))
    return M.upsert_chunks(old, new, "chunk_id").select("chunk_id", F.col("embedding").isNotNull().alias("has_vector"), "embedding_status")


@query("crawl_merge", "WITH o AS (SELECT c_custkey AS id, c_name AS title FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN c_name ELSE c_name || '!' END AS title FROM customer WHERE c_custkey % 5 <> 0), m AS (SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.title IS NULL OR n.title = '' THEN o.title ELSE n.title END AS title, o.title AS before, o.id AS oid, n.id AS nid FROM o FULL JOIN n ON o.id = n.id) SELECT id, title, CASE WHEN oid IS NULL THEN 'new' WHEN nid IS NULL THEN 'kept' WHEN title IS DISTINCT FROM before THEN 'updated' ELSE 'duplicate' END AS state FROM m")
def crawl_merge(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    old = c.where("id % 3 <> 0").withColumn("first_seen", now()).withColumn("updated_at", now())
    new = c.where("id % 5 <> 0").withColumn("title", F.when(F.col("id") % 4 == 0, "").when(F.col("id") % 4 == 1, F.col("title")).otherwise(F.concat("title", F.lit("!"))))
    return M.merge_crawled(old, new, "id", ["title"], now()).select("id", "title", "state")


@query("merge_best_hit", "SELECT l_partkey AS term, l_suppkey AS doc, max(l_discount) AS score, min(l_linenumber) AS rank, arg_max(l_returnflag || l_linestatus || repeat('x', l_linenumber), (length(l_returnflag || l_linestatus || repeat('x', l_linenumber)), -l_orderkey)) AS match, arg_min(l_returnflag, l_orderkey * 8 + l_linenumber) AS grp FROM lineitem GROUP BY ALL")
def merge_best_hit(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    match = F.concat("l_returnflag", "l_linestatus", F.repeat(F.lit("x"), F.col("l_linenumber")))
    hits = l.select(F.col("l_partkey").alias("term"), F.col("l_suppkey").alias("doc"), F.col("l_discount").alias("score"), F.col("l_linenumber").alias("rank"), match.alias("match"), F.col("l_returnflag").alias("grp"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"))
    return M.merge_hits(hits, ["term", "doc"], "seq")


@query("run_upsert", f"WITH {JOBS}, r AS (SELECT *, row_number() OVER (PARTITION BY version_id, attempts ORDER BY heartbeat_at DESC, job_id DESC) AS rn FROM jobs) SELECT version_id, attempts, status, job_id FROM r WHERE rn = 1")
def run_upsert(spark, sf_dir):
    return M.latest_runs(jobs(spark, sf_dir), ["version_id", "attempts"], ["status", "job_id"], ["heartbeat_at", "job_id"])


@query("version_activation", f"WITH {VERSIONS}, a AS (SELECT document_id, max(version_id) AS approved FROM versions WHERE status = 'review_required' GROUP BY document_id) SELECT version_id, v.document_id, CASE WHEN version_id = approved THEN 'active' WHEN status = 'active' AND approved IS NOT NULL THEN 'superseded' ELSE status END AS status, coalesce(version_id = approved, false) AS is_current FROM versions v LEFT JOIN a USING (document_id)")
def version_activation(spark, sf_dir):
    v = versions(spark, sf_dir)
    return M.activate(v, v.where("status = 'review_required'").groupBy("document_id").agg(F.max("version_id").alias("version_id")))


@query("checklist_toggle", "WITH t AS (SELECT user_id AS item, arg_max(event_type, (ts, event_id)) AS last, count(*) AS n FROM events GROUP BY user_id) SELECT item, last = 'purchase' AS completed, n AS audit_rows FROM t")
def checklist_toggle(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("item")).agg((F.max_by("event_type", F.struct("ts", "event_id")) == "purchase").alias("completed"), F.count("*").alias("audit_rows"))


@query("dual_sink_diff", f"WITH {OLD_NEW} SELECT count(o.id) AS rows_a, count(n.id) AS rows_b, count(*) FILTER (WHERE n.id IS NULL) AS only_a, count(*) FILTER (WHERE o.id IS NULL) AS only_b, sum(CASE WHEN o.id IS NOT NULL AND n.id IS NOT NULL THEN (o.name IS DISTINCT FROM n.name)::INT + (o.size IS DISTINCT FROM n.size)::INT ELSE 0 END)::BIGINT AS cells_differ FROM o FULL JOIN n ON o.id = n.id")
def dual_sink_diff(spark, sf_dir):
    return M.table_difference(*old_new(spark, sf_dir), "id", ["name", "size"])


@query("natural_key_dedupe", "SELECT l_partkey, l_suppkey, min(l_orderkey * 8 + l_linenumber) AS first FROM lineitem GROUP BY ALL")
def natural_key_dedupe(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.groupBy("l_partkey", "l_suppkey").agg(F.min(F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("first"))


@query("term_dedupe", "WITH t AS (SELECT p_partkey, lower(trim(p_brand || ' ' || p_size)) AS form FROM part), r AS (SELECT form, min(p_partkey) AS first FROM t GROUP BY form) SELECT form, first, row_number() OVER (ORDER BY first) AS priority FROM r")
def term_dedupe(spark, sf_dir):
    from tessellar.operators.relational import global_ids

    form = F.lower(F.trim(F.concat_ws(" ", "p_brand", "p_size")))
    rows = table(spark, sf_dir, "part").groupBy(form.alias("form")).agg(F.min("p_partkey").alias("first"))
    return global_ids(rows, "first").select("form", "first", F.col("id").alias("priority"))


@query("uuid5_ids")
def uuid5_ids(spark, sf_dir):
    name = F.concat(F.lit("doc:"), F.col("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", N.uuid5(uuid.NAMESPACE_URL, name).alias("id"))


@query("short_ids", "SELECT doc_id, 'public:doc:' || left(sha256('src:' || doc_id), 24) AS id, sha256(source || chr(31) || lang || chr(31) || n_chars) AS fields FROM documents")
def short_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", N.short_id("public:doc:", F.concat(F.lit("src:"), F.col("doc_id")), 24).alias("id"), N.fields_hash(F.col("source"), F.col("lang"), F.col("n_chars")).alias("fields"))


# ---- lifecycle


@query("stale_jobs", f"WITH {JOBS} SELECT job_id, CASE WHEN attempts >= 3 THEN 'failed' ELSE 'queued' END AS next_status FROM jobs WHERE status = 'processing' AND date_diff('second', heartbeat_at, TIMESTAMP '{NOW}') > 300")
def stale_jobs(spark, sf_dir):
    return L.recover_stale(jobs(spark, sf_dir), now()).select("job_id", "next_status")


@query("claim_order", f"WITH {JOBS} SELECT job_id, heartbeat_at FROM jobs WHERE status = 'queued' ORDER BY heartbeat_at, job_id LIMIT 25")
def claim_order(spark, sf_dir):
    return L.claim_order(jobs(spark, sf_dir), 25).select("job_id", "heartbeat_at")


@query("retry_schedule", f"WITH {JOBS} SELECT job_id, CASE WHEN attempts < 3 THEN 'queued' ELSE 'failed' END AS next_status, CASE WHEN attempts < 3 THEN heartbeat_at + INTERVAL 10 SECOND END AS next_attempt_at FROM jobs WHERE status = 'failed'")
def retry_schedule(spark, sf_dir):
    return L.after_failure(jobs(spark, sf_dir)).select("job_id", "next_status", "next_attempt_at")


@query("job_join", f"WITH {JOBS}, {VERSIONS} SELECT j.job_id, v.version_id, v.document_id, c_name FROM jobs j JOIN versions v USING (version_id) JOIN customer ON c_custkey = v.document_id WHERE j.status = 'queued'")
def job_join(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), "c_name")
    return jobs(spark, sf_dir).where("status = 'queued'").select("job_id", "version_id").join(versions(spark, sf_dir).select("version_id", "document_id"), "version_id").join(people, "document_id").select("job_id", "version_id", "document_id", "c_name")


STEPS = [("queued", "processing"), ("processing", "completed"), ("processing", "failed"), ("pending", "processing"), ("failed", "queued")]
STEPS_SQL = ", ".join(f"'{a}>{b}'" for a, b in STEPS)


@query("state_transitions", f"WITH {JOBS}, t AS (SELECT job_id, status, lag(status) OVER (PARTITION BY version_id ORDER BY heartbeat_at, job_id) AS before FROM jobs) SELECT job_id, before, status, (before || '>' || status) IN ({STEPS_SQL}) AS allowed FROM t WHERE before IS NOT NULL")
def state_transitions(spark, sf_dir):
    return L.transitions(jobs(spark, sf_dir), "version_id", ["heartbeat_at", "job_id"], STEPS).select("job_id", "before", "status", "allowed")


@query("progress_projection", f"WITH {JOBS} SELECT job_id, CASE status WHEN 'completed' THEN 'done' WHEN 'failed' THEN 'error' WHEN 'processing' THEN CASE WHEN value < 50 THEN 'extracting' ELSE 'embedding' END ELSE 'waiting' END AS stage, round(CASE WHEN status = 'completed' THEN 100 ELSE greatest(0, least(value, 100)) END, 6) AS percent FROM jobs")
def progress_projection(spark, sf_dir):
    stage, percent = L.progress(F.col("status"), F.col("value"))
    return jobs(spark, sf_dir).select("job_id", stage.alias("stage"), F.round(percent, 6).alias("percent"))


@query("progress_clamp", f"WITH {JOBS} SELECT job_id, max(value) OVER w AS shown, coalesce(value > max(value) OVER (PARTITION BY version_id ORDER BY heartbeat_at, job_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS moves FROM jobs WINDOW w AS (PARTITION BY version_id ORDER BY heartbeat_at, job_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def progress_clamp(spark, sf_dir):
    return L.monotonic(jobs(spark, sf_dir), "version_id", ["heartbeat_at", "job_id"], "value").select("job_id", "shown", "moves")


@query("lockout_replay", f"WITH {JOBS}, r AS (SELECT *, sum((status <> 'failed')::INT) OVER (PARTITION BY version_id ORDER BY heartbeat_at, job_id ROWS UNBOUNDED PRECEDING) AS run FROM jobs), f AS (SELECT job_id, sum((status = 'failed')::INT) OVER (PARTITION BY version_id, run ORDER BY heartbeat_at, job_id ROWS UNBOUNDED PRECEDING) AS failures FROM r) SELECT job_id, failures::BIGINT AS failures, failures >= 5 AS locked FROM f")
def lockout_replay(spark, sf_dir):
    return L.lockouts(jobs(spark, sf_dir), "version_id", ["heartbeat_at", "job_id"], F.col("status") != "failed").select("job_id", "failures", "locked")


@query("missing_pages", "WITH p AS (SELECT l_orderkey AS term, list(DISTINCT l_linenumber::BIGINT) AS done FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1), m AS (SELECT term, list_filter(range(1, 8), lambda x: NOT list_contains(done, x)) AS gone FROM p) SELECT term, len(gone) AS n_missing, list_min(gone) AS next_page, len(gone) = 0 AS complete FROM m")
def missing_pages(spark, sf_dir):
    runs = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("term"), F.col("l_linenumber").cast("long").alias("page"))
    return L.missing_pages(runs, "term", "page", F.lit(7))


@query("completed_terms", "WITH t AS (SELECT l_orderkey, max(l_linenumber) AS pages, count(DISTINCT l_linenumber) FILTER (WHERE l_returnflag <> 'R') AS done FROM lineitem GROUP BY 1) SELECT count(*) AS terms, count(*) FILTER (WHERE done = pages) AS completed FROM t")
def completed_terms(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("pages"), F.countDistinct(F.when(F.col("l_returnflag") != "R", F.col("l_linenumber"))).alias("done"))
    return t.agg(F.count("*").alias("terms"), F.count_if(F.col("done") == F.col("pages")).alias("completed"))


@query("session_valid", f"WITH s AS (SELECT event_id, CASE WHEN event_type = 'error' THEN ts END AS revoked_at, ts + INTERVAL 7 DAY AS expires_at FROM events) SELECT event_id FROM s WHERE revoked_at IS NULL AND expires_at > TIMESTAMP '{NOW}'")
def session_valid(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = e.select("event_id", F.when(F.col("event_type") == "error", F.col("ts")).alias("revoked_at"), F.expr("ts + INTERVAL 7 DAYS").alias("expires_at"))
    return L.valid_sessions(s, now()).select("event_id")


# ---- quality


@query("dq_counters", "SELECT count(*) AS rows, count(*) FILTER (WHERE text IS NULL) AS no_text, count(*) FILTER (WHERE n_chars > length(text)) AS too_long, count(*) FILTER (WHERE lang NOT IN ('en', 'fr', 'de', 'es')) AS bad_lang, count(*) FILTER (WHERE contains(text, '|')) AS has_bar, false AS passed FROM documents")
def dq_counters(spark, sf_dir):
    rules = {"no_text": F.col("text").isNull(), "too_long": F.col("n_chars") > F.length("text"), "bad_lang": ~F.col("lang").isin("en", "fr", "de", "es"), "has_bar": F.col("text").contains("|")}
    return Q.counters(table(spark, sf_dir, "documents"), rules)


@query("unique_check", "SELECT count(*) AS rows, count(DISTINCT o_custkey) AS distinct_keys, count(o_custkey) - count(DISTINCT o_custkey) AS surplus, count(*) FILTER (WHERE o_custkey IS NULL) AS empty FROM orders")
def unique_check(spark, sf_dir):
    return Q.duplicates(table(spark, sf_dir, "orders"), "o_custkey")


@query("required_columns", "SELECT doc_id FROM documents WHERE text IS NULL OR source IS NULL")
def required_columns(spark, sf_dir):
    return Q.required(table(spark, sf_dir, "documents"), ["text", "source"]).select("doc_id")


@query("vector_validate", "SELECT vec_id, len(embedding) = 64 AND abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) <= 0.001 AS valid FROM embeddings")
def vector_validate(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", N.vector_is_valid(F.col("embedding"), 64).alias("valid"))


@query("corpus_extremes", f"WITH {CHUNKS}, {VECTORS} SELECT (SELECT max(length(content)) FROM chunks) AS longest, (SELECT round(max(abs(sqrt(list_dot_product(embedding, embedding)) - 1)), 6) FROM vectors) AS norm_error")
def corpus_extremes(spark, sf_dir):
    a = chunks(spark, sf_dir).agg(F.max(F.length("content")).alias("longest"))
    b = vectors(spark, sf_dir).agg(F.round(F.max(F.abs(N.norm(F.col("embedding")) - 1)), 6).alias("norm_error"))
    both = a.unionByName(b, allowMissingColumns=True)
    return both.agg(F.max("longest").alias("longest"), F.max("norm_error").alias("norm_error"))


@query("scanned_documents", f"WITH {CHUNKS} SELECT document_id, round(avg((length(trim(content)) < 400)::INT), 6) AS share, avg((length(trim(content)) < 400)::INT) > 0.5 AS scanned FROM chunks GROUP BY document_id")
def scanned_documents(spark, sf_dir):
    return Q.scanned_documents(chunks(spark, sf_dir), "document_id", "content", 400).withColumn("share", F.round("share", 6))


@query("package_violations", f"WITH {CHUNKS}, d AS (SELECT document_id, any_value(source_type) AS s FROM (SELECT document_id, min(source_type) AS source_type FROM chunks GROUP BY 1) GROUP BY 1), c AS (SELECT vec_id // 8 + CASE WHEN vec_id % 100 = 0 THEN 100000000 ELSE 0 END AS document_id, embedding FROM embeddings) SELECT (SELECT count(*) FROM d WHERE s NOT LIKE 'public_%') AS not_public, (SELECT count(*) FROM c WHERE document_id NOT IN (SELECT document_id FROM d)) AS orphans, (SELECT count(*) FROM d WHERE document_id NOT IN (SELECT document_id FROM c)) AS without_chunks, (SELECT count(*) FROM c WHERE len(embedding) <> 64) AS wrong_dimension, (SELECT count(DISTINCT len(embedding)) FROM c) AS dimensions")
def package_violations(spark, sf_dir):
    docs = chunks(spark, sf_dir).groupBy("document_id").agg(F.min("source_type").alias("source_type"))
    own = table(spark, sf_dir, "embeddings").select((F.expr("vec_id div 8") + F.when(F.col("vec_id") % 100 == 0, 100000000).otherwise(0)).alias("document_id"), "embedding")
    return Q.package_violations(docs, own, 64)


# ---- risk and proximity

RULES = (K.Rule("entanglement", "caught", 3, 4, ("red", "green"), ("lock out", "stand still")), K.Rule("shock", "electric", 2, 4, ("blue", "steel"), ("no voltage", "lock out")), K.Rule("fire", "burn", 2, 3, ("hot", "tin"), ("permit",)))
RULES_SQL = """r(rule, name, likelihood, severity, keys, items) AS (VALUES (0, 'entanglement', 3, 4, ['red', 'green'], ['lock out', 'stand still']), (1, 'shock', 2, 4, ['blue', 'steel'], ['no voltage', 'lock out']), (2, 'fire', 2, 3, ['hot', 'tin'], ['permit'])),
q AS (SELECT p_partkey AS request_id, lower(p_name || ' ' || p_type) AS t FROM part),
h AS (SELECT request_id, rule, name, likelihood, severity, items FROM q JOIN r ON len(list_filter(keys, lambda k: contains(t, k))) > 0),
a AS (SELECT * FROM h UNION ALL SELECT request_id, -1, '작업 조건 추가 확인 필요', 2, 2, ['제조사·모델·부품번호 확인', '사업장 작업표준서와 담당자 확인'] FROM q WHERE request_id NOT IN (SELECT request_id FROM h))"""


def requests(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("request_id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))


@query("risk_rules", f"WITH {RULES_SQL} SELECT request_id, name, likelihood * severity AS score, CASE WHEN likelihood * severity >= 12 THEN 'high' WHEN likelihood * severity >= 6 THEN 'medium' ELSE 'low' END AS risk_level FROM a")
def risk_rules(spark, sf_dir):
    return K.hazards(requests(spark, sf_dir), RULES).select("request_id", "name", "score", "risk_level")


@query("risk_levels", f"WITH {RULES_SQL} SELECT CASE WHEN likelihood * severity >= 12 THEN 'high' WHEN likelihood * severity >= 6 THEN 'medium' ELSE 'low' END AS risk_level, count(*) AS n FROM a GROUP BY 1")
def risk_levels(spark, sf_dir):
    return K.hazards(requests(spark, sf_dir), RULES).groupBy("risk_level").agg(F.count("*").alias("n"))


@query("checklist_seq", f"WITH {RULES_SQL}, i AS (SELECT request_id, rule, unnest(items) AS item, unnest(range(len(items))) AS pos FROM a), f AS (SELECT request_id, item, min((rule, pos)) AS fst FROM i GROUP BY ALL), s AS (SELECT request_id, item, row_number() OVER (PARTITION BY request_id ORDER BY fst, item) AS sequence FROM f) SELECT request_id, sequence, item FROM s WHERE sequence <= 5")
def checklist_seq(spark, sf_dir):
    return K.checklists(K.hazards(requests(spark, sf_dir), RULES))


HAVERSINE = "2 * 6371000.0 * asin(sqrt(power(sin(radians(lat - point_lat) / 2), 2) + cos(radians(point_lat)) * cos(radians(lat)) * power(sin(radians(lon - point_lon) / 2), 2)))"


@query("radius_join", f"WITH {EQUIPMENT}, p AS (SELECT c_custkey AS point_id, 35.0 + (c_custkey % 101) / 2100.0 AS point_lat, 129.0 + (c_custkey % 83) / 1900.0 AS point_lon FROM customer) SELECT point_id, equipment_id, round({HAVERSINE}, 3) AS distance_m FROM p, equipment WHERE is_active AND {HAVERSINE} <= 400")
def radius_join(spark, sf_dir):
    k = F.col("c_custkey")
    points = table(spark, sf_dir, "customer").select(k.alias("point_id"), (35.0 + (k % 101) / 2100.0).alias("point_lat"), (129.0 + (k % 83) / 1900.0).alias("point_lon"))
    out = K.within_radius(points, equipment(spark, sf_dir).where("is_active"), 400.0, digits=3)
    return out.select("point_id", "equipment_id", "distance_m")


@query("nearest_sort", f"WITH {EQUIPMENT}, p AS (SELECT *, 35.01 AS point_lat, 129.02 AS point_lon FROM equipment) SELECT equipment_id, round({HAVERSINE}, 3) AS distance_m FROM p ORDER BY {HAVERSINE}, equipment_id LIMIT 20")
def nearest_sort(spark, sf_dir):
    d = N.haversine_m(F.lit(35.01), F.lit(129.02), F.col("lat"), F.col("lon"))
    return equipment(spark, sf_dir).withColumn("d", d).orderBy("d", "equipment_id").limit(20).select("equipment_id", F.round("d", 3).alias("distance_m"))


@query("recenter", f"WITH {EQUIPMENT} SELECT equipment_id, round(37.5 + (lat - 35.0), 9) AS lat, round(127.0 + (lon - 129.0) * cos(radians(35.0)) / cos(radians(37.5)), 9) AS lon FROM equipment")
def recenter(spark, sf_dir):
    lat, lon = N.recentred(F.col("lat"), F.col("lon"), (35.0, 129.0), (37.5, 127.0))
    return equipment(spark, sf_dir).select("equipment_id", F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"))


@query("equipment_sites", f"WITH {EQUIPMENT} SELECT equipment_id, n_name AS site FROM equipment JOIN nation ON n_nationkey = site_id WHERE is_active")
def equipment_sites(spark, sf_dir):
    sites = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("site_id"), F.col("n_name").alias("site"))
    return equipment(spark, sf_dir).where("is_active").join(sites, "site_id").select("equipment_id", "site")


@query("ppe_lookup", "SELECT p_partkey, CASE WHEN p_size = 1 THEN 'gloves' WHEN p_brand = 'Brand#12' THEN 'goggles' ELSE 'helmet' END AS ppe FROM part")
def ppe_lookup(spark, sf_dir):
    by_code = F.create_map(F.lit(1), F.lit("gloves"))
    by_type = F.create_map(F.lit("Brand#12"), F.lit("goggles"))
    return table(spark, sf_dir, "part").select("p_partkey", K.first_known(F.try_element_at(by_code, F.col("p_size")), F.try_element_at(by_type, F.col("p_brand")), F.lit("helmet")).alias("ppe"))
