"""Timers and state against sequential folds, over any cut into batches."""

import random

import pytest
from pyspark.sql import functions as F

from quarrymill.streaming import timers as T

SIGNAL = "doc_id long, signal string, ts timestamp, seq long"


@pytest.fixture
def run(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", T.STATE_STORE)

    def go(plan, rows, schema, cuts, mode):
        """The rows that plan gives for a stream of rows, cut into files of one batch each."""
        edges = [0, *cuts, len(rows)]
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            spark.createDataFrame(rows[a:b], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k:03}")
            source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
            query = plan(source).writeStream.foreachBatch(lambda df, n, k=k: df.write.mode("append").parquet(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/check").outputMode(mode).trigger(availableNow=True).start()
            query.awaitTermination()
        return spark.read.parquet(f"{tmp_path}/out").collect()

    yield go
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def _at(ms):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(milliseconds=ms)


def _job_by_hand(signals, most=3, stale=120_000):
    """(status, phase, attempts) after signals (ms, signal) in order."""
    status, phase, attempts, until = "queued", "pending", 0, None
    for ms, signal in signals:
        if phase == "waiting" and until <= ms:
            phase = "pending"
        if phase == "active" and until <= ms:
            phase, attempts = "pending", attempts - 1
        if signal == "cancel" and phase != "ended":
            status, phase = "cancelled", "ended"
        elif phase == "pending" and signal == "claim":
            phase, attempts, until = "active", attempts + 1, ms + stale
        elif phase == "active":
            if signal == "beat":
                until = ms + stale
            elif signal == "done":
                status, attempts = {"queued": "parsing", "parsing": "chunking", "chunking": "embedding", "embedding": "upserting", "upserting": "ready"}[status], 0
                phase = "ended" if status == "ready" else "pending"
            elif signal == "fatal" or (signal == "fail" and attempts >= most):
                status, phase = "failed", "ended"
            elif signal == "fail":
                phase, until = "waiting", ms + (2_000, 8_000, 30_000)[min(attempts, 3) - 1]
    return status, phase, attempts


@pytest.mark.parametrize("cuts", [[], [100, 101, 180]])
def test_jobs_are_folds_however_batches_are_cut(run, cuts):
    r = random.Random(3)
    rows, now = [], 0
    for n in range(240):
        now += r.choice([0, 500, 1_000, 2_000, 6_000, 40_000])
        rows.append((r.randint(1, 5), r.choice(["claim", "claim", "claim", "beat", "done", "fail", "fail", "fatal" if n > 200 else "fail", "cancel" if n > 220 else "beat"]), _at(now), n))
    out = run(lambda s: T.retried(s, keep_ms=10**9, late="0 seconds"), rows, SIGNAL, cuts, "update")
    for d in range(1, 6):
        own = [(int((ts - _at(0)).total_seconds() * 1000), s) for x, s, ts, _ in rows if x == d]
        last = next(x for x in out if x.doc_id == d and x.events == len(own) and not x.by_timer)
        assert (last.status, last.phase, last.attempts) == _job_by_hand(own)


def test_waits_and_reclaims_by_the_clock_of_the_stream(run):
    zero = int(__import__("calendar").timegm(_at(0).timetuple())) * 1000
    fail = lambda n, ms: [(1, "claim", _at(ms), n), (1, "fail", _at(ms + 1), n + 1)]
    tick = lambda n, ms: [(99, "beat", _at(ms), n)]
    rows = [*fail(0, 1_000), (2, "claim", _at(1_000), 2), *tick(3, 3_500), *fail(4, 4_000), *tick(6, 12_500), *fail(7, 13_000), *tick(9, 44_000), *fail(10, 45_000), *tick(12, 200_000), (2, "done", _at(200_000), 13), (1, "claim", _at(200_001), 14)]
    out = run(lambda s: T.retried(s, max_attempts=4, late="0 seconds"), rows, SIGNAL, [4, 7, 10], "update")
    woken = [(x.at - zero, x.attempts) for x in sorted(out, key=lambda x: x.at) if x.doc_id == 1 and x.by_timer]
    assert woken == [(1_001 + 2_000, 1), (4_001 + 8_000, 2), (13_001 + 30_000, 3)]
    assert max((x.events, x.status) for x in out if x.doc_id == 1) == (9, "failed")
    stale = [x for x in out if x.doc_id == 2 and x.by_timer or x.doc_id == 2 and x.events == 2]
    assert any(x.attempts == 0 and x.phase == "pending" for x in stale) and all(x.status == "queued" for x in stale)


def _throttled_by_hand(rows):
    last, out = {}, []
    for d, ms, seq, value, force in sorted((x for x in rows if x[1] is not None and x[3] is not None), key=lambda x: (x[0], x[1], x[2])):
        if d not in last or force or ms - last[d][0] >= 400 or abs(value - last[d][1]) >= 5:
            last[d] = (ms, value)
            out.append((d, ms, seq, max(0, min(100, int((value + 0.5) // 1)))))
    return sorted(out)


REPORT = "doc_id long, ts_ms long, seq long, value double, force boolean"


@pytest.mark.parametrize("cuts", [[], [50, 51, 140]])
def test_reports_are_folds(spark, run, cuts):
    r = random.Random(5)
    now, rows = 0, []
    for n in range(200):
        now += r.choice([0, 10, 100, 399, 400])
        rows.append((r.randint(1, 4), now, n, r.choice([None, r.uniform(-5, 108), n / 2, n / 2]), r.choice([None, False, False, n % 17 == 0])))
    want = _throttled_by_hand(rows)
    whole = spark.createDataFrame(rows, REPORT).withColumn("extra", F.lit(1))
    assert sorted(tuple(x) for x in T.throttled(whole).collect()) == want
    assert T.throttled(whole.limit(0)).count() == 0
    assert sorted(tuple(x) for x in run(T.throttled_stream, rows, REPORT, cuts, "append")) == want
