"""Job queue, leases, state machines and sessions in batch form: each is a state table computed from rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lease, attempts, wait before the next attempt, failures before a lock.
LEASE_SECONDS, MOST_ATTEMPTS, RETRY_SECONDS, LOCK_FAILURES = 300, 3, 10, 5


def seconds_since(ts: str, now: Column) -> Column:
    return now.cast("timestamp").cast("double") - F.col(ts).cast("timestamp").cast("double")


def recover_stale(jobs: DataFrame, now: Column) -> DataFrame:
    """Processing jobs whose lease has run out: queued again, or failed after the last attempt."""
    stale = (F.col("status") == "processing") & (seconds_since("heartbeat_at", now) > LEASE_SECONDS)
    return jobs.where(stale).withColumn("next_status", F.when(F.col("attempts") >= MOST_ATTEMPTS, "failed").otherwise("queued"))


def claim_order(jobs: DataFrame, n: int) -> DataFrame:
    return jobs.where("status = 'queued'").orderBy("heartbeat_at", "job_id").limit(n)


def after_failure(jobs: DataFrame) -> DataFrame:
    """Failed jobs with attempts left go back to the queue after a wait."""
    again = F.col("attempts") < MOST_ATTEMPTS
    wait = F.expr(f"heartbeat_at + INTERVAL {RETRY_SECONDS} SECONDS")
    return jobs.where("status = 'failed'").withColumn("next_status", F.when(again, "queued").otherwise("failed")).withColumn("next_attempt_at", F.when(again, wait))


def transitions(log: DataFrame, key: str, order: list[str], allowed: list[tuple[str, str]]) -> DataFrame:
    """Consecutive states of each key and whether the step is allowed."""
    before = F.lag("status").over(Window.partitionBy(key).orderBy(*order))
    steps = F.array(*(F.lit(f"{a}>{b}") for a, b in allowed))
    return log.withColumn("before", before).where("before is not null").withColumn("allowed", F.array_contains(steps, F.concat_ws(">", "before", "status")))


def progress(status: Column, percent: Column) -> tuple[Column, Column]:
    """(stage, bounded percent) of a version's job."""
    stage = F.when(status == "completed", "done").when(status == "failed", "error").when(status == "processing", F.when(percent < 50, "extracting").otherwise("embedding")).otherwise("waiting")
    bounded = F.when(status == "completed", 100.0).otherwise(F.greatest(F.lit(0.0), F.least(percent, F.lit(100.0))))
    return stage, bounded


def monotonic(rows: DataFrame, key: str, order: list[str], percent: str) -> DataFrame:
    """Progress that never falls, and whether a row moves it."""
    w = Window.partitionBy(key).orderBy(*order)
    high = F.max(percent).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.max(percent).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("shown", high).withColumn("moves", before.isNull() | (F.col(percent) > before))


def lockouts(logins: DataFrame, user: str, order: list[str], ok: Column) -> DataFrame:
    """Failures since the last success of each login, and whether the account is locked then."""
    w = Window.partitionBy(user).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    since = F.sum(F.when(ok, 1).otherwise(0)).over(w)
    rows = logins.withColumn("__run", since)
    inner = Window.partitionBy(user, "__run").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    failures = F.sum(F.when(ok, 0).otherwise(1)).over(inner)
    return rows.withColumn("failures", failures).withColumn("locked", F.col("failures") >= LOCK_FAILURES).drop("__run")


def missing_pages(runs: DataFrame, key: str, page: str, pages: Column) -> DataFrame:
    """Pages 1..n not yet fetched: their number and the next one."""
    done = runs.groupBy(key).agg(F.collect_set(page).alias("done"), F.max(pages).alias("pages"))
    left = F.array_except(F.sequence(F.lit(1).cast("long"), F.col("pages").cast("long")), F.col("done"))
    return done.select(key, F.size(left).alias("n_missing"), F.array_min(left).alias("next_page"), (F.size(left) == 0).alias("complete"))


def valid_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    return sessions.where(F.col("revoked_at").isNull() & (F.col("expires_at") > now))
