"""How the given tables stand in for chunks, versions, jobs, equipment and the like: each as a
DataFrame and as the SQL text that the oracles use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CHUNKS = """chunks AS (
  SELECT d.doc_id AS chunk_id, d.doc_id // 8 AS document_id, d.doc_id % 8 AS chunk_index, d.text AS content,
         sha256(d.text) AS content_hash, d.source AS title, d.doc_id % 50 + 1 AS page,
         CASE d.lang WHEN 'en' THEN 'public_guide' WHEN 'fr' THEN 'public_incident' WHEN 'de' THEN 'equipment_manual' ELSE 'company_policy' END AS source_type,
         CASE WHEN d.lang IN ('en', 'fr') THEN 'public' ELSE 'company' END AS document_scope,
         CASE d.doc_id % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'site' ELSE 'private' END AS access_level,
         d.doc_id % 5 AS site_id
  FROM documents d)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    lang, k = F.col("lang"), F.col("doc_id")
    return d.select(
        k.alias("chunk_id"),
        F.expr("doc_id div 8").alias("document_id"),
        (k % 8).alias("chunk_index"),
        F.col("text").alias("content"),
        F.sha2("text", 256).alias("content_hash"),
        F.col("source").alias("title"),
        (k % 50 + 1).alias("page"),
        F.when(lang == "en", "public_guide").when(lang == "fr", "public_incident").when(lang == "de", "equipment_manual").otherwise("company_policy").alias("source_type"),
        F.when(lang.isin("en", "fr"), "public").otherwise("company").alias("document_scope"),
        F.when(k % 3 == 0, "public").when(k % 3 == 1, "site").otherwise("private").alias("access_level"),
        (k % 5).alias("site_id"),
    )


VECTORS = "vectors AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS embedding, label FROM embeddings)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").cast("array<double>"), "label")


VERSIONS = """versions AS (
  SELECT o_orderkey AS version_id, o_custkey AS document_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version,
         CASE o_orderstatus WHEN 'O' THEN 'review_required' WHEN 'F' THEN 'active' ELSE 'superseded' END AS status,
         o_orderdate AS created_at, o_orderkey % 7 AS uploaded_by, o_totalprice AS size_bytes, o_orderpriority AS priority
  FROM orders)"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")
    return o.select(
        F.col("o_orderkey").alias("version_id"),
        F.col("o_custkey").alias("document_id"),
        F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("version"),
        F.when(status == "O", "review_required").when(status == "F", "active").otherwise("superseded").alias("status"),
        F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderkey") % 7).alias("uploaded_by"),
        F.col("o_totalprice").alias("size_bytes"),
        F.col("o_orderpriority").alias("priority"),
    )


JOBS = """jobs AS (
  SELECT event_id AS job_id, user_id AS version_id, ts AS heartbeat_at, event_id % 4 AS attempts,
         CASE event_type WHEN 'view' THEN 'processing' WHEN 'click' THEN 'queued' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'pending' END AS status,
         value
  FROM events)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("job_id"),
        F.col("user_id").alias("version_id"),
        F.col("ts").alias("heartbeat_at"),
        (F.col("event_id") % 4).alias("attempts"),
        F.when(kind == "view", "processing").when(kind == "click", "queued").when(kind == "purchase", "completed").when(kind == "error", "failed").otherwise("pending").alias("status"),
        "value",
    )


EQUIPMENT = """equipment AS (
  SELECT s_suppkey AS equipment_id, s_name AS name, s_nationkey AS site_id, 35.0 + (s_suppkey % 97) / 2000.0 AS lat, 129.0 + (s_suppkey % 89) / 2000.0 AS lon, s_acctbal > 0 AS is_active
  FROM supplier)"""


def equipment(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("equipment_id"),
        F.col("s_name").alias("name"),
        F.col("s_nationkey").alias("site_id"),
        (35.0 + (k % 97) / 2000.0).alias("lat"),
        (129.0 + (k % 89) / 2000.0).alias("lon"),
        (F.col("s_acctbal") > 0).alias("is_active"),
    )
