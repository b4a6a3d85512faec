"""Event-time extensions and file round trips as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellar.plans.base import table
from tessellar.streaming import jobs as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_count(spark, sf_dir):
    return S.tumbling_counts(_events(spark, sf_dir)).select(F.to_date("start").alias("day"), "event_type", "n")


def session_windows(spark, sf_dir):
    return S.sessions(_events(spark, sf_dir), "6 hours").groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


def dedup_watermark(spark, sf_dir):
    return S.deduplicated(_events(spark, sf_dir), ["user_id", "event_type"]).groupBy("event_type").agg(F.count("*").alias("n"))


QUERIES |= {f.__name__: f for f in (tumbling_count, session_windows, dedup_watermark)}
ORACLES |= {
    "tumbling_count": "SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "session_windows": "WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 6 HOUR, true)::INT AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), n AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM n GROUP BY user_id",
    "dedup_watermark": "SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY event_type",
}
