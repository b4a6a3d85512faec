"""Versions, roles, dashboards, numbering: queries with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessellar.operators import relational as R
from tessellar.plans.base import CHUNKS, EQUIPMENT, JOBS, VERSIONS, chunks, equipment, jobs, table, versions

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("review_queue_latest", f"WITH {VERSIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY version DESC, created_at DESC, version_id DESC) AS rn FROM versions) SELECT document_id, version_id, c_name AS uploader FROM r LEFT JOIN customer ON c_custkey = document_id WHERE rn = 1 AND status = 'review_required'")
def review_queue_latest(spark, sf_dir):
    newest = R.latest(versions(spark, sf_dir), ["document_id"], F.desc("version"), F.desc("created_at"), F.desc("version_id")).where("status = 'review_required'")
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("uploader"))
    return newest.join(people, "document_id", "left").select("document_id", "version_id", "uploader")


@query("topk_offset", f"WITH {VERSIONS} SELECT version_id, document_id FROM versions ORDER BY created_at DESC, version_id DESC LIMIT 20 OFFSET 40")
def topk_offset(spark, sf_dir):
    return R.page(versions(spark, sf_dir), 40, 20, F.desc("created_at"), F.desc("version_id")).select("version_id", "document_id")


@query("first_per_doc", f"WITH {VERSIONS} SELECT document_id, arg_max(version_id, (created_at, version)) AS version_id FROM versions GROUP BY document_id")
def first_per_doc(spark, sf_dir):
    return R.latest(versions(spark, sf_dir), ["document_id"], F.desc("created_at"), F.desc("version")).select("document_id", "version_id")


@query("next_version", f"WITH {VERSIONS} SELECT c_custkey AS document_id, coalesce(max(version), 0) + 1 AS next_version FROM customer LEFT JOIN versions ON document_id = c_custkey GROUP BY c_custkey")
def next_version(spark, sf_dir):
    own = versions(spark, sf_dir).groupBy("document_id").agg(F.max("version").alias("v"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id")).join(own, "document_id", "left").select("document_id", (F.coalesce("v", F.lit(0)) + 1).alias("next_version"))


@query("active_version_filter", f"WITH {VERSIONS}, cur AS (SELECT document_id, max(version) AS current FROM versions GROUP BY document_id) SELECT v.version_id, v.document_id FROM versions v JOIN cur USING (document_id) WHERE v.version = current AND status = 'active'")
def active_version_filter(spark, sf_dir):
    v = versions(spark, sf_dir)
    rows = v.withColumn("current", F.max("version").over(Window.partitionBy("document_id"))).withColumn("chunk_version", F.col("version"))
    return rows.where(R.active_version("chunk_version", "current", "version", "status")).select("version_id", "document_id")


@query("owner_draft", f"WITH {VERSIONS}, mine AS (SELECT * FROM versions WHERE status = 'review_required' AND uploaded_by = 3) SELECT version_id, document_id, version FROM mine m WHERE version = (SELECT max(version) FROM mine x WHERE x.document_id = m.document_id)")
def owner_draft(spark, sf_dir):
    return R.owner_draft(versions(spark, sf_dir), 3).select("version_id", "document_id", "version")


@query("profile_version_join", f"WITH {VERSIONS}, mine AS (SELECT * FROM versions WHERE status = 'review_required' AND uploaded_by = 3), c AS (SELECT document_id, version, version_id, 0 AS rank FROM versions WHERE status = 'active' UNION ALL SELECT document_id, version, version_id, 1 FROM mine m WHERE version = (SELECT max(version) FROM mine x WHERE x.document_id = m.document_id)), r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY rank, version DESC) AS rn FROM c) SELECT c_custkey AS document_id, version_id, rank FROM customer LEFT JOIN (SELECT * FROM r WHERE rn = 1) ON document_id = c_custkey")
def profile_version_join(spark, sf_dir):
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"))
    return docs.join(R.profile_versions(versions(spark, sf_dir), 3), "document_id", "left").select("document_id", "version_id", "rank")


@query("rbac_semi", "SELECT s_suppkey AS user_id FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE'))")
def rbac_semi(spark, sf_dir):
    users = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_nationkey").alias("role"))
    roles = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    grants = roles.select(F.col("n_nationkey").alias("role"), F.when(F.col("r_name").isin("ASIA", "EUROPE"), "assess").otherwise("read").alias("permission"))
    return R.permitted(users.select("user_id"), users, grants, "assess")


@query("cross_role_perm", "SELECT r_name AS role, n_name AS permission FROM region JOIN nation ON (r_name IN ('ASIA', 'AMERICA')) OR (r_regionkey = n_regionkey AND n_nationkey % 2 = 0)")
def cross_role_perm(spark, sf_dir):
    roles, permissions = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    # every permission for full roles, the role's own even ones for the rest: two equi joins over seed tables
    full = roles.where(F.col("r_name").isin("ASIA", "AMERICA")).withColumn("k", F.lit(1)).join(permissions.withColumn("k", F.lit(1)), "k")
    own = roles.where(~F.col("r_name").isin("ASIA", "AMERICA")).join(permissions.where("n_nationkey % 2 = 0"), F.col("r_regionkey") == F.col("n_regionkey"))
    return full.select(F.col("r_name").alias("role"), F.col("n_name").alias("permission")).union(own.select("r_name", "n_name"))


@query("derived_scope", "SELECT user_id, roles, sites FROM (SELECT o_custkey AS user_id, list_sort(list(DISTINCT o_orderpriority)) AS roles FROM orders GROUP BY 1) FULL JOIN (SELECT o_custkey AS user_id, list_sort(list(DISTINCT o_orderkey % 5)) AS sites FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) USING (user_id)")
def derived_scope(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("role"), (F.col("o_orderkey") % 5).alias("site_id"), "o_orderstatus")
    return R.derived_scope(o, o.where("o_orderstatus = 'F'"))


@query("dashboard_summary", "WITH d AS (SELECT max(o_orderdate)::DATE AS today FROM orders) SELECT count(DISTINCT o_orderkey) FILTER (WHERE o_orderdate::DATE = today) AS tasks_today, count(DISTINCT o_orderkey) FILTER (WHERE o_orderdate::DATE = today AND l_quantity >= 40) AS high_risk_today, count(DISTINCT o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS pending_reviews, CASE WHEN count(l_orderkey) > 0 THEN round_even(count(*) FILTER (WHERE l_linestatus = 'F')::DOUBLE / count(l_orderkey) * 100, 0) ELSE 0 END AS completion FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey, d")
def dashboard_summary(spark, sf_dir):
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_linestatus")
    today = orders.agg(F.max(F.to_date("o_orderdate"))).first()[0]
    of_order = items.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_quantity").alias("q"), F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("done"))
    rows = orders.join(of_order, "o_orderkey", "left")
    on_day = F.to_date("o_orderdate") == F.lit(today)
    out = rows.agg(F.count_if(on_day).alias("tasks_today"), F.count_if(on_day & (F.col("q") >= 40)).alias("high_risk_today"), F.count_if(F.col("o_orderstatus") == "O").alias("pending_reviews"), F.sum("done").alias("done"), F.sum("n").alias("n"))
    return out.select("tasks_today", "high_risk_today", "pending_reviews", R.completion_rate(F.col("done"), F.coalesce("n", F.lit(0))).alias("completion"))


@query("checklist_completion", "SELECT l_orderkey AS assessment_id, count(*) AS total, count(*) FILTER (WHERE l_linestatus = 'F') AS completed, round_even(count(*) FILTER (WHERE l_linestatus = 'F')::DOUBLE / count(*) * 100, 0) AS rate FROM lineitem GROUP BY l_orderkey")
def checklist_completion(spark, sf_dir):
    out = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("assessment_id")).agg(F.count("*").alias("total"), F.count_if(F.col("l_linestatus") == "F").alias("completed"))
    return out.withColumn("rate", R.completion_rate(F.col("completed"), F.col("total")))


@query("high_risk_assessments", "SELECT o_orderkey AS assessment_id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 45)")
def high_risk_assessments(spark, sf_dir):
    risky = table(spark, sf_dir, "lineitem").where("l_quantity >= 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(risky, "o_orderkey", "left_semi").select(F.col("o_orderkey").alias("assessment_id"))


@query("status_counts", f"WITH {JOBS} SELECT status, count(*) AS n FROM jobs GROUP BY status")
def status_counts(spark, sf_dir):
    return jobs(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query("distinct_dims", "SELECT DISTINCT len(embedding) AS dimension FROM embeddings")
def distinct_dims(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.size("embedding").alias("dimension")).distinct()


@query("filtered_count", f"WITH {JOBS} SELECT version_id, count(*) AS n, count(*) FILTER (WHERE status = 'completed' AND value IS NOT NULL) AS n_ready FROM jobs GROUP BY version_id")
def filtered_count(spark, sf_dir):
    return jobs(spark, sf_dir).groupBy("version_id").agg(F.count("*").alias("n"), F.count_if((F.col("status") == "completed") & F.col("value").isNotNull()).alias("n_ready"))


@query("source_type_counts", f"WITH {CHUNKS} SELECT source_type, count(*) AS chunks, count(DISTINCT document_id) AS documents FROM chunks GROUP BY source_type")
def source_type_counts(spark, sf_dir):
    return chunks(spark, sf_dir).groupBy("source_type").agg(F.count("*").alias("chunks"), F.countDistinct("document_id").alias("documents"))


@query("orphans_anti", "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def orphans_anti(spark, sf_dir):
    known = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return table(spark, sf_dir, "labels").join(known, "doc_id", "left_anti").select("doc_id")


@query("docs_without_chunks", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def docs_without_chunks(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@query("raw_metadata_lookup", "SELECT d.source, count(*) AS n, count(l.doc_id) AS found, count(*) - count(l.doc_id) AS missing FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source")
def raw_metadata_lookup(spark, sf_dir):
    raw = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("hit"))
    return table(spark, sf_dir, "documents").join(raw, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.count("hit").alias("found"), (F.count("*") - F.count("hit")).alias("missing"))


@query("profile_sample_listagg", f"WITH {CHUNKS}, r AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY chunk_id) AS rn FROM chunks) SELECT title, string_agg(content, chr(10) ORDER BY rn) AS sample, count(*) AS n FROM r WHERE rn <= 40 GROUP BY title")
def profile_sample_listagg(spark, sf_dir):
    return R.sample_text(chunks(spark, sf_dir).select("title", "chunk_id", "content"), "title", "chunk_id", "content", 40)


@query("profile_sample_whole", f"WITH {CHUNKS}, r AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY CASE WHEN page <= 4 THEN 0 ELSE 1 END, chunk_index, chunk_id) AS rn FROM chunks) SELECT title, string_agg(content, ' ' ORDER BY rn) AS sample, count(*) AS n FROM r WHERE rn <= 40 GROUP BY title")
def profile_sample_whole(spark, sf_dir):
    late = F.when(F.coalesce("page", F.lit(9999)) <= 4, 0).otherwise(1)
    rows = chunks(spark, sf_dir).select("title", late.alias("late"), "chunk_index", "chunk_id", "content")
    return R.sample_text(rows, "title", ["late", "chunk_index", "chunk_id"], "content", 40, " ")


@query("id_sequence", f"WITH {CHUNKS} SELECT chunk_id, row_number() OVER (ORDER BY chunk_id) AS id, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) - 1 AS place FROM chunks")
def id_sequence(spark, sf_dir):
    rows = R.numbered(chunks(spark, sf_dir).select("chunk_id", "document_id", "chunk_index"), ["document_id"], F.col("chunk_index"))
    return R.global_ids(rows.select("chunk_id", F.col("index").alias("place")), "chunk_id").select("chunk_id", "id", "place")


@query("chapter_lookup", "WITH s AS (SELECT DISTINCT l_suppkey % 10 AS doc, l_partkey % 97 AS start FROM lineitem WHERE l_linenumber = 1 AND l_partkey % 5 = 0), c AS (SELECT doc, start, greatest(start, coalesce(lead(start) OVER (PARTITION BY doc ORDER BY start) - 1, 1000000000)) AS last FROM s), p AS (SELECT DISTINCT l_suppkey % 10 AS doc, l_quantity::BIGINT AS page FROM lineitem) SELECT p.doc, p.page, max(c.start) AS chapter FROM p LEFT JOIN c ON c.doc = p.doc AND p.page BETWEEN c.start AND c.last GROUP BY p.doc, p.page")
def chapter_lookup(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    doc = (F.col("l_suppkey") % 10).alias("doc")
    starts = items.where("l_linenumber = 1 and l_partkey % 5 = 0").select(doc, (F.col("l_partkey") % 97).alias("start")).distinct()
    pages = items.select(doc, F.col("l_quantity").cast("long").alias("page")).distinct()
    # as-of lookup by a union and a running maximum: no range join
    both = pages.select("doc", F.col("page").alias("at"), F.lit(1).alias("kind")).union(R.intervals(starts, "doc", "start").select("doc", "start", F.lit(0)))
    last = F.max(F.when(F.col("kind") == 0, F.col("at"))).over(Window.partitionBy("doc").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn("chapter", last).where("kind = 1").select("doc", F.col("at").alias("page"), "chapter")


@query("priority_sort", "SELECT o_orderkey, coalesce(p, 1000000000)::BIGINT AS priority FROM orders LEFT JOIN (VALUES ('1-URGENT', 1), ('2-HIGH', 2), ('3-MEDIUM', 3)) v(o_orderpriority, p) USING (o_orderpriority) ORDER BY priority, o_orderkey LIMIT 50")
def priority_sort(spark, sf_dir):
    ranks = F.create_map(*(F.lit(x) for kv in (("1-URGENT", 1), ("2-HIGH", 2), ("3-MEDIUM", 3)) for x in kv))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(F.try_element_at(ranks, F.col("o_orderpriority")), F.lit(10**9)).cast("long").alias("priority"))
    return rows.orderBy("priority", "o_orderkey").limit(50)


@query("newest_run", f"WITH {JOBS} SELECT version_id, arg_max(job_id, (heartbeat_at, job_id)) AS job_id FROM jobs WHERE status = 'completed' GROUP BY version_id")
def newest_run(spark, sf_dir):
    return jobs(spark, sf_dir).where("status = 'completed'").groupBy("version_id").agg(F.max_by("job_id", F.struct("heartbeat_at", "job_id")).alias("job_id"))


@query("location_conflict", "WITH r AS (SELECT l_partkey, l_suppkey % 5 AS loc, rank() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC) AS k FROM lineitem) SELECT l_partkey, CASE WHEN count(DISTINCT loc) = 1 THEN min(loc) END AS location, count(DISTINCT loc) > 1 AS conflict FROM r WHERE k = 1 GROUP BY l_partkey")
def location_conflict(spark, sf_dir):
    k = F.rank().over(Window.partitionBy("l_partkey").orderBy(F.desc("l_quantity")))
    best = table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_suppkey") % 5).alias("loc"), k.alias("k")).where("k = 1")
    n = F.countDistinct("loc")
    return best.groupBy("l_partkey").agg(F.when(n == 1, F.min("loc")).alias("location"), (n > 1).alias("conflict"))


@query("ambiguous_routes", f"WITH {EQUIPMENT} SELECT site_id, count(DISTINCT (round(lat, 1), round(lon, 1))) >= 2 AS ambiguous FROM equipment GROUP BY site_id")
def ambiguous_routes(spark, sf_dir):
    return equipment(spark, sf_dir).groupBy("site_id").agg((F.countDistinct(F.struct(F.round("lat", 1), F.round("lon", 1))) >= 2).alias("ambiguous"))


@query("location_status_counts", "SELECT o_orderstatus || ':' || split_part(o_orderpriority, '-', 2) AS status, count(*) AS n FROM orders GROUP BY 1")
def location_status_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.concat_ws(":", "o_orderstatus", F.split_part("o_orderpriority", F.lit("-"), F.lit(2))).alias("status")).agg(F.count("*").alias("n"))


@query("region_alias_join", "SELECT s_suppkey, coalesce(alias, n_name) AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN (VALUES ('NATION0', 'A'), ('NATION1', 'B'), ('NATION_2', 'C')) a(n, alias) ON n = n_name")
def region_alias_join(spark, sf_dir):
    alias = F.create_map(*(F.lit(x) for kv in (("NATION0", "A"), ("NATION1", "B"), ("NATION_2", "C")) for x in kv))
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select("s_suppkey", F.coalesce(F.try_element_at(alias, F.col("n_name")), F.col("n_name")).alias("place"))


@query("today_boundary", "SELECT date_trunc('day', ts)::DATE AS day, count(*) AS n FROM events GROUP BY 1")
def today_boundary(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.to_date(F.date_trunc("day", "ts")).alias("day")).agg(F.count("*").alias("n"))


@query("assessment_visibility", "SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 3 OR o_orderkey % 5 IN (1, 2)")
def assessment_visibility(spark, sf_dir):
    return table(spark, sf_dir, "orders").where((F.col("o_custkey") % 10 == 3) | (F.col("o_orderkey") % 5).isin(1, 2)).select("o_orderkey")


@query("duplicate_upload", f"WITH {CHUNKS}, r AS (SELECT chunk_id, content_hash, site_id, row_number() OVER (PARTITION BY content_hash, site_id ORDER BY chunk_id DESC) AS rn FROM chunks) SELECT chunk_id, content_hash, site_id FROM r WHERE rn = 1")
def duplicate_upload(spark, sf_dir):
    return R.latest(chunks(spark, sf_dir), ["content_hash", "site_id"], F.desc("chunk_id")).select("chunk_id", "content_hash", "site_id")


@query("identity_probe", "SELECT c_custkey FROM customer WHERE c_custkey = 17 OR lower(c_name) = lower((SELECT c_name FROM customer WHERE c_custkey = 23))")
def identity_probe(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    name = c.where("c_custkey = 23").select("c_name").first()  # the request's own value
    return c.where((F.col("c_custkey") == 17) | (F.lower("c_name") == F.lit(name[0].lower() if name else None))).select("c_custkey")


@query("reference_chain", "SELECT l_orderkey, l_linenumber, s_suppkey IS NOT NULL AND n_nationkey IS NOT NULL AND s_acctbal > 0 AS valid, coalesce(s_name, '?') AS name FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey")
def reference_chain(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation").select("n_nationkey")
    chain = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "s_name", (F.col("n_nationkey").isNotNull() & (F.col("s_acctbal") > 0)).alias("sound"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").join(chain, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return rows.select("l_orderkey", "l_linenumber", F.coalesce("sound", F.lit(False)).alias("valid"), F.coalesce("s_name", F.lit("?")).alias("name"))


@query("evidence_authorised", f"WITH {CHUNKS} SELECT l.l_orderkey, l.l_linenumber, c.chunk_id FROM lineitem l JOIN chunks c ON c.chunk_id = l.l_partkey WHERE c.access_level <> 'private' AND c.document_id = l.l_partkey // 8")
def evidence_authorised(spark, sf_dir):
    claimed = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("chunk_id"), F.expr("l_partkey div 8").alias("document_id"))
    allowed = chunks(spark, sf_dir).where("access_level <> 'private'").select("chunk_id", "document_id")
    return claimed.join(allowed, ["chunk_id", "document_id"], "left_semi").select("l_orderkey", "l_linenumber", "chunk_id")


@query("signal_scores", f"WITH {CHUNKS} SELECT chunk_id, round(least(1.0, ((contains(lower(content), 'the'))::INT + (contains(lower(content), 'der'))::INT + (contains(lower(content), 'que'))::INT + (contains(lower(content), 'ing'))::INT) / 3.0), 6) AS safety FROM chunks")
def signal_scores(spark, sf_dir):
    from tessellar.functions.text import signal_score

    return chunks(spark, sf_dir).select("chunk_id", F.round(signal_score(["the", "der", "que", "ing"], F.col("content")), 6).alias("safety"))


@query("category_caps", f"WITH {CHUNKS}, r AS (SELECT chunk_id, source_type, row_number() OVER (PARTITION BY source_type ORDER BY chunk_id) AS rn FROM chunks) SELECT chunk_id, source_type FROM r WHERE rn <= CASE source_type WHEN 'public_guide' THEN 8 WHEN 'equipment_manual' THEN 3 ELSE 5 END")
def category_caps(spark, sf_dir):
    rn = F.row_number().over(Window.partitionBy("source_type").orderBy("chunk_id"))
    cap = F.when(F.col("source_type") == "public_guide", 8).when(F.col("source_type") == "equipment_manual", 3).otherwise(5)
    return chunks(spark, sf_dir).withColumn("rn", rn).where((F.col("rn") <= 8) & (F.col("rn") <= cap)).select("chunk_id", "source_type")


@query("tiered_fallback", f"WITH {CHUNKS} SELECT chunk_id, CASE WHEN contains(lower(content), 'heit') THEN 0 ELSE 1 END AS tier FROM chunks ORDER BY tier, chunk_id LIMIT 200")
def tiered_fallback(spark, sf_dir):
    rows = chunks(spark, sf_dir).select("chunk_id", F.when(F.lower("content").contains("heit"), 0).otherwise(1).alias("tier"))
    return rows.orderBy("tier", "chunk_id").limit(200)
