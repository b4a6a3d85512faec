"""Structured Streaming: a job queue of keyed states with timers, its workers, and event-time extensions."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tessellar.operators.lifecycle import LEASE_SECONDS, MOST_ATTEMPTS, RETRY_SECONDS

EVENT = "job_id string, kind string, worker string, at timestamp"
#: What may happen to a job, in the order in which it is taken if it happens at one time.
KINDS = ("submit", "claim", "heartbeat", "complete", "fail")
STATE = "job_id string, status string, attempts int, worker string, at timestamp"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def latest_state(log: DataFrame) -> DataFrame:
    """The last row of each job in an append-only log (job_id, status, at, attempts)."""
    return log.groupBy("job_id").agg(F.max_by(F.struct("status", "attempts"), F.struct("at", "attempts", F.col("status") != "queued")).alias("s"), F.max("at").alias("at")).select("job_id", "s.*", "at")


class JobStates(StatefulProcessor):
    """One job: queued -> processing -> completed, or back to the queue after a wait or a lost lease, or failed.

    A claim takes a queued job, counts an attempt and begins a lease, which the holder's heartbeats prolong. If it
    runs out, a timer gives the job back, or fails it after the last attempt. A failed attempt waits (`waiting`) until
    a timer queues it again. Only the holder of a lease ends it: what lost workers say counts for nothing.
    """

    def __init__(self, lease: float, retry: float, most: int):
        self.lease, self.retry, self.most = int(lease * 1000), int(retry * 1000), most

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "status string, attempts int, worker string, due long")

    def _load(self) -> dict:
        if not self.state.exists():
            return {"status": None, "attempts": 0, "worker": None, "due": None}
        return dict(zip(("status", "attempts", "worker", "due"), self.state.get(), strict=True))

    def _move(self, job: dict, key: str, at: int, status: str, due: int | None = None, worker: str | None = None) -> tuple:
        self._due(job, due)
        job.update(status=status, worker=worker)
        return key, status, job["attempts"], worker, pd.Timestamp(at, unit="ms")

    def _due(self, job: dict, due: int | None) -> None:
        if job["due"] is not None:
            self.handle.deleteTimer(job["due"])
        if due is not None:
            self.handle.registerTimer(due)
        job["due"] = due

    def _given_back(self, job: dict, key: str, at: int, wait: int) -> tuple:
        if job["attempts"] >= self.most:
            return self._move(job, key, at, "failed")
        return self._move(job, key, at, "waiting", at + wait) if wait else self._move(job, key, at, "queued")

    def _stored(self, job: dict, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        self.state.update((job["status"], job["attempts"], job["worker"], job["due"]))
        if rows:
            yield pd.DataFrame(rows, columns=["job_id", "status", "attempts", "worker", "at"]).astype({"attempts": "int32"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows))
        given = given.assign(order=given["kind"].map(KINDS.index)).sort_values(["at", "order"], kind="stable")
        job, out, key = self._load(), [], key[0]
        for kind, worker, at in zip(given["kind"], given["worker"], given["at"], strict=True):
            at, holds = int(at.timestamp() * 1000), job["status"] == "processing" and worker == job["worker"]
            if kind == "submit" and job["status"] is None:
                out.append(self._move(job, key, at, "queued"))
            elif kind == "claim" and job["status"] == "queued":
                job["attempts"] += 1
                out.append(self._move(job, key, at, "processing", at + self.lease, worker))
            elif kind == "heartbeat" and holds:
                self._due(job, at + self.lease)
            elif kind == "complete" and holds:
                out.append(self._move(job, key, at, "completed"))
            elif kind == "fail" and holds:
                out.append(self._given_back(job, key, at, self.retry))
        yield from self._stored(job, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        job, at = self._load(), expiredTimerInfo.getExpiryTimeInMs()
        if job["due"] != at:
            return
        job["due"] = None  # it has gone off
        out = self._move(job, key[0], at, "queued") if job["status"] == "waiting" else self._given_back(job, key[0], at, 0)
        yield from self._stored(job, [out])

    def close(self) -> None:
        pass


def job_states(events: DataFrame, lease: float = LEASE_SECONDS, retry: float = RETRY_SECONDS, most: int = MOST_ATTEMPTS, time_mode: str = "ProcessingTime") -> DataFrame:
    """The log (job_id, status, attempts, worker, at) of a stream of events (job_id, kind, worker, at).

    A row for each change of a state; a job costs the same however many others there are. In time mode EventTime
    timers follow the events' own time, which replays a log as it was.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    sound = events.where(F.col("job_id").isNotNull() & F.col("kind").isin(*KINDS) & F.col("at").isNotNull())
    sound = sound.withWatermark("at", "0 seconds") if time_mode == "EventTime" else sound
    return sound.groupBy("job_id").transformWithStateInPandas(JobStates(lease, retry, most), STATE, "Append", time_mode)


def said(jobs: DataFrame, kind: str | F.Column, worker: str | None = None) -> DataFrame:
    """Events of one kind, now, about jobs (job_id)."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return jobs.select(F.col("job_id").cast("string").alias("job_id"), kind.alias("kind"), F.lit(worker).cast("string").alias("worker"), F.current_timestamp().alias("at"))


def tell(events: str, df: DataFrame, source: str, kind: str) -> None:
    """Appends events to a folder of their source and kind: two writers of one folder would clear each other's files."""
    df.write.mode("append").parquet(f"{events}/{source}/{kind}")


def submit(jobs: DataFrame, events: str, source: str = "submit") -> None:
    tell(events, said(jobs, "submit"), source, "submit")


def _made(spark: SparkSession, path: str) -> str:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)
    return path


def run_queue(spark: SparkSession, events: str, log: str, checkpoint: str, every: str = "2 seconds", **timing):
    """Keeps the log of job_states, as files, from a folder of events."""
    found = spark.readStream.schema(EVENT).parquet(f"{_made(spark, events)}/*/*")
    return job_states(found, **timing).writeStream.format("parquet").option("path", log).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def run_worker(spark: SparkSession, process: Callable[[DataFrame], DataFrame], events: str, log: str, checkpoint: str, worker: str, most_files: int = 10, every: str = "2 seconds", beat: float = LEASE_SECONDS / 3):
    """Claims what the log of states offers, processes what it is given, and says how that went, all as events.

    process takes (job_id) and returns (job_id, ok); a job that it doesn't return has failed that attempt. Only claims
    that the log confirms are processed, so of several workers one has a job. While it works it says so every
    `beat` seconds. A worker that dies leaves leases that run out; one that is replayed repeats what the
    states then pass over. Every job costs a few rows, whatever the length of the queue.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        offers = batch.where("status = 'queued'").select("job_id").dropDuplicates()
        tell(events, said(offers, "claim", worker), worker, "claim")
        mine = batch.where((F.col("status") == "processing") & (F.col("worker") == worker)).select("job_id").dropDuplicates()
        if not mine.limit(1).count():
            return
        stop = threading.Event()

        def beats() -> None:
            while not stop.wait(beat):
                tell(events, said(mine, "heartbeat", worker), worker, "heartbeat")

        thread = threading.Thread(target=beats, daemon=True)
        thread.start()
        try:
            done = process(mine).groupBy("job_id").agg(F.bool_and("ok").alias("ok"))
            kind = F.when(F.coalesce("ok", F.lit(False)), "complete").otherwise("fail")
            tell(events, said(mine.join(done, "job_id", "left"), kind, worker), worker, "end")
        finally:
            stop.set()
            thread.join()

    offered = spark.readStream.schema(STATE).option("maxFilesPerTrigger", most_files).parquet(_made(spark, log))
    return offered.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def tumbling_counts(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events of each type in each window; the same plan on a table and on a stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "1 day") -> DataFrame:
    """A user's events no further apart than the gap."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)
