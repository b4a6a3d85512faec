"""The queue's states against a replay by hand, and a queue with workers that is driven until nothing is left."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from tessellar.streaming import jobs

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def replayed(spark, tmp_path, batches, **timing):
    """The log of batches of (job, kind, worker, second), each a micro-batch; timers follow the events' time."""
    for k, rows in enumerate(batches):
        spark.createDataFrame([(j, kind, w, at(s)) for j, kind, w, s in rows], jobs.EVENT).coalesce(1).write.parquet(f"{tmp_path}/in/{k:04}")
        time.sleep(0.01)
    stream = spark.readStream.schema(jobs.EVENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    log = jobs.job_states(stream, time_mode="EventTime", **timing)
    query = log.writeStream.format("parquet").option("path", f"{tmp_path}/log").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(jobs.STATE).parquet(f"{tmp_path}/log").collect()
    return sorted((r.job_id, (r.at - START).total_seconds(), r.attempts, r.status, r.worker) for r in rows)


def test_leases_heartbeats_and_waits(spark, tmp_path):
    batches = [
        [(j, "submit", None, 0) for j in "abcd"] + [("a", "submit", None, 1), (None, "submit", None, 1), ("x", "dance", None, 1)],
        [(j, "claim", "w1", 10) for j in "abcd"] + [("a", "claim", "w2", 11)],
        [("b", "complete", "w1", 50), ("c", "fail", "w1", 50), ("d", "complete", "w2", 50)],
        [("a", "heartbeat", "w1", 200), ("d", "heartbeat", "w2", 200), ("z", "submit", None, 220)],
        [("y", "submit", None, 320)],
        [("y", "submit", None, 320)],  # timers go off after a batch's events, up to the time of the batches before
        [("d", "claim", "w2", 321), ("c", "claim", "w2", 321)],
        [("x", "submit", None, 505)],
        [("x", "submit", None, 506)],
        [("a", "complete", "w1", 510), ("d", "complete", "w2", 511)],
    ]
    log = replayed(spark, tmp_path, batches)
    of = lambda j: [r[1:] for r in log if r[0] == j]
    assert of("b") == [(0, 0, "queued", None), (10, 1, "processing", "w1"), (50, 1, "completed", None)]
    # w1's failure waits 10 seconds, then w2 takes it; its lease runs on
    assert of("c") == [(0, 0, "queued", None), (10, 1, "processing", "w1"), (50, 1, "waiting", None), (60, 1, "queued", None), (321, 2, "processing", "w2")]
    # no word from w1: the lease of 300 seconds ends, and what w2 said before it had the job counted for nothing
    assert of("d") == [(0, 0, "queued", None), (10, 1, "processing", "w1"), (310, 1, "queued", None), (321, 2, "processing", "w2"), (511, 2, "completed", None)]
    # the heartbeat prolonged the lease to 500; then the job was lost, and the late result is passed over
    assert of("a") == [(0, 0, "queued", None), (10, 1, "processing", "w1"), (500, 1, "queued", None)]
    assert of("x") == [(505, 0, "queued", None)] and {r[0] for r in log} == set("abcdxyz")


def by_hand(batches, lease, retry, most):
    """The same rules in plain Python: events of a batch first, then timers up to the former batches' last time."""
    state, log, seen = {}, [], float("-inf")

    def move(j, s, t, status, due=None, worker=None):
        s.update(status=status, due=due, worker=worker)
        log.append((j, float(t), s["n"], status, worker))

    def back(j, s, t, wait):
        if s["n"] >= most:
            move(j, s, t, "failed")
        elif wait:
            move(j, s, t, "waiting", t + wait)
        else:
            move(j, s, t, "queued")

    for rows in [*batches, []]:
        before = seen
        for j, kind, w, t in sorted(rows, key=lambda r: (r[3], jobs.KINDS.index(r[1]))):
            s = state.setdefault(j, {"status": None, "n": 0, "due": None, "worker": None})
            holds = s["status"] == "processing" and s["worker"] == w
            if kind == "submit" and s["status"] is None:
                move(j, s, t, "queued")
            elif kind == "claim" and s["status"] == "queued":
                s["n"] += 1
                move(j, s, t, "processing", t + lease, w)
            elif kind == "heartbeat" and holds:
                s["due"] = t + lease
            elif kind == "complete" and holds:
                move(j, s, t, "completed")
            elif kind == "fail" and holds:
                back(j, s, t, retry)
            seen = max(seen, t)
        for j, s in state.items():
            if s["due"] is not None and s["due"] <= before:
                t, s["due"] = s["due"], None
                move(j, s, t, "queued") if s["status"] == "waiting" else back(j, s, t, 0)
    return sorted(log, key=lambda r: (r[0], r[1], r[2], str(r[3])))


@pytest.mark.parametrize("seed", [1, 2])
def test_random_events_by_hand(spark, tmp_path, seed):
    rng = random.Random(seed)
    batches, now = [], 0
    for _ in range(12):
        rows, used = [], set()
        for _ in range(40):
            j = f"j{rng.randrange(12)}"
            t = now + rng.randrange(30)
            if (j, t) not in used:  # one event of a job a second, so that no tie depends on the sort
                used.add((j, t))
                rows.append((j, rng.choice(["submit", "claim", "claim", "heartbeat", "complete", "fail", "fail"]), f"w{rng.randrange(2)}", t))
        now += 30
        batches.append(rows)
    timing = {"lease": 45, "retry": 7, "most": 3}
    assert sorted(replayed(spark, tmp_path, batches, **timing), key=lambda r: (r[0], r[1], r[2], str(r[3]))) == by_hand(batches, **timing)


def test_workers_until_nothing_is_left(spark, tmp_path):
    events, log = f"{tmp_path}/events", f"{tmp_path}/log"
    spark.conf.set("spark.sql.streaming.metricsEnabled", "false")
    jobs.submit(spark.range(300).select(F.col("id").alias("job_id")), events)
    queue = jobs.run_queue(spark, events, log, f"{tmp_path}/ck", every="1 second", lease=60, retry=1)
    calls = []

    def process(mine):
        ids = [r.job_id for r in mine.collect()]
        calls.extend(ids)
        return mine.where("job_id <> '7'").withColumn("ok", F.col("job_id") != "8")

    worker = jobs.run_worker(spark, process, events, log, f"{tmp_path}/ck1", "w1", every="1 second")
    other = jobs.run_worker(spark, process, events, log, f"{tmp_path}/ck2", "w2", every="1 second")
    try:
        until = time.time() + 240
        while time.time() < until:
            time.sleep(2)
            try:
                now = {r.job_id: (r.status, r.attempts) for r in jobs.latest_state(spark.read.schema(jobs.STATE).parquet(log)).collect()}
            except Exception:  # the first batch isn't there yet
                continue
            if len(now) == 300 and all(s in ("completed", "failed") for s, _ in now.values()):
                break
        assert not [q.exception() for q in (queue, worker, other) if q.exception()]
        assert now["7"] == ("failed", 3) and now["8"] == ("failed", 3)
        assert {s for j, s in now.items() if j not in "78"} == {("completed", 1)}
        assert sorted(calls) == sorted([str(k) for k in range(300)] + 2 * ["7", "8"])  # no job was given to two workers
    finally:
        for q in (worker, other, queue):
            q.stop()
