"""Queries of jobs, progress and counters over the log of events."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.operators import counters
from quarrymill.sources.shared import shared_folder
from quarrymill.streaming import timers

QUERIES, ORACLES = {}, {}
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return add


@contextlib.contextmanager
def _state_store(spark: SparkSession):
    """The session's state store is the one with timers while a stream is begun and run."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, timers.STATE_STORE)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _streamed(spark: SparkSession, sf_dir: str, plan, mode: str) -> DataFrame:
    """What plan gives for the log as a stream of millis and the columns of events, written to the shared folder batch by batch."""
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    log = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events*.parquet").parquet(sf_dir).withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    with _state_store(spark):
        out = plan(log)
        out.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out/batch={n}")).option("checkpointLocation", f"{at}/checkpoint").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")


# A thousandth of the log's time, so that waits of seconds and minutes matter, and its types as signals.
_SIGNAL = "CASE WHEN event_type = 'error' AND event_id % 50 = 0 THEN 'fatal' WHEN event_type = 'click' AND event_id % 97 = 0 THEN 'cancel' WHEN event_type = 'signup' OR event_type = 'view' AND event_id % 2 = 0 THEN 'claim' WHEN event_type = 'error' THEN 'fail' WHEN event_type = 'purchase' THEN 'done' ELSE 'beat' END"


@query(f"""WITH RECURSIVE e AS (SELECT user_id, ms, {_SIGNAL} AS signal, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS n FROM (SELECT *, epoch_ms(ts) // 1000 AS ms FROM events)),
    f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, 0 AS stage, 'pending' AS phase, 0 AS attempts, CAST(0 AS BIGINT) AS until, '' AS ended FROM events
    UNION ALL SELECT user_id, n, CASE WHEN p = 'active' AND signal = 'done' THEN stage + 1 ELSE stage END,
        CASE WHEN signal = 'cancel' AND p <> 'ended' OR p = 'active' AND (signal = 'fatal' OR signal = 'fail' AND a >= 3 OR signal = 'done' AND stage = 4) THEN 'ended' WHEN p = 'pending' AND signal = 'claim' THEN 'active' WHEN p = 'active' AND signal = 'done' THEN 'pending' WHEN p = 'active' AND signal = 'fail' THEN 'waiting' ELSE p END,
        CASE WHEN p = 'pending' AND signal = 'claim' THEN a + 1 WHEN p = 'active' AND signal = 'done' THEN 0 ELSE a END,
        CASE WHEN p = 'pending' AND signal = 'claim' OR p = 'active' AND signal = 'beat' THEN ms + 120000 WHEN p = 'active' AND signal = 'fail' THEN ms + list_extract([2000, 8000, 30000], least(a, 3)) ELSE until END,
        CASE WHEN signal = 'cancel' AND p <> 'ended' THEN 'cancelled' WHEN p = 'active' AND (signal = 'fatal' OR signal = 'fail' AND a >= 3) THEN 'failed' ELSE ended END
        FROM (SELECT f.user_id, e.n, e.ms, e.signal, stage, until, ended, CASE WHEN phase IN ('waiting', 'active') AND until <= ms THEN 'pending' ELSE phase END AS p, CASE WHEN phase = 'active' AND until <= ms THEN attempts - 1 ELSE attempts END AS a FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1))
    SELECT user_id AS doc_id, CASE WHEN ended <> '' THEN ended ELSE list_extract(['queued', 'parsing', 'chunking', 'embedding', 'upserting', 'ready'], stage + 1) END AS status, phase, CAST(attempts AS INTEGER) AS attempts, n AS events FROM f QUALIFY n = max(n) OVER (PARTITION BY user_id)""")
def job_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST2 to ST4 as a stream with timers: each user as a document's job, after its last signal."""

    def plan(log: DataFrame) -> DataFrame:
        signals = log.select(F.col("user_id").alias("doc_id"), F.expr(_SIGNAL).alias("signal"), F.timestamp_millis(F.floor(F.col("ms") / 1000)).alias("ts"), F.col("event_id").alias("seq"))
        return timers.retried(signals, keep_ms=1 << 40, late="40 days")

    rows = _streamed(spark, sf_dir, plan, "update").where("NOT by_timer")
    last = rows.groupBy("doc_id").agg(F.max_by(F.struct("status", "phase", "attempts", "events"), "events").alias("last"))
    return last.select("doc_id", "last.*")


# Whole steps of 100 seconds, rounded down as unix_millis and floor do; epoch_ms would round what is behind the milliseconds, and // to zero.
_STEP_SQL = "(epoch_us(ts) - (epoch_us(ts) % 100000000 + 100000000) % 100000000) // 100000000"


@query(f"""WITH RECURSIVE e AS (SELECT user_id, {_STEP_SQL} AS ms, event_id, value / 10 AS v, event_type = 'purchase' AND event_id % 10 = 0 AS force, row_number() OVER (PARTITION BY user_id ORDER BY {_STEP_SQL}, event_id) AS n FROM events),
    f AS (SELECT user_id, n, event_id, ms, v, ms AS last_ms, v AS last_v, true AS goes FROM e WHERE n = 1
    UNION ALL SELECT user_id, n, event_id, ms, v, CASE WHEN goes THEN ms ELSE last_ms END, CASE WHEN goes THEN v ELSE last_v END, goes FROM
        (SELECT e.*, last_ms, last_v, e.force OR e.ms - last_ms >= 400 OR abs(e.v - last_v) >= 5 AS goes FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1))
    SELECT user_id AS doc_id, ms AS ts_ms, event_id AS seq, CAST(least(greatest(floor(v + 0.5), 0), 100) AS INTEGER) AS progress FROM f WHERE goes""")
def progress_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST9: the log's values as progress of each user, and what of it is reported."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    force = (F.col("event_type") == "purchase") & (F.col("event_id") % 10 == 0)
    return timers.throttled(e.select(F.col("user_id").alias("doc_id"), F.floor(F.col("ms") / 100_000).alias("ts_ms"), F.col("event_id").alias("seq"), (F.col("value") / 10).alias("value"), force.alias("force")))


@query("SELECT user_id AS key, count(*) AS calls, round(sum(value), 4) AS total, max(event_id) AS last_event FROM events GROUP BY 1")
def counter_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the log's users, kept as increments of batches: four batches by event, of which one is written twice and one late, and two compactions in between."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kept = counters.Counters(spark, f"{shared_folder(spark)}/counters-{uuid.uuid4().hex}", sums=("calls", "total"), latest=("last_event",))
    rows = lambda n: e.where(F.pmod("event_id", F.lit(4)) == n).select(F.col("user_id").alias("key"), F.lit(1).cast("double").alias("calls"), F.col("value").alias("total"), F.col("event_id").cast("double").alias("last_event"))
    for batch in (0, 1, 1):
        kept.add(batch, rows(batch))
    kept.compact(1)
    for batch in (3, 2, 3):
        kept.add(batch, rows(batch))
    kept.compact(2)
    kept.add(1, rows(1))  # a batch that is counted already, run again
    return kept.read().select("key", F.col("calls").cast("long").alias("calls"), F.round("total", 4).alias("total"), F.col("last_event").cast("long").alias("last_event"))
