"""Structured Streaming: ingestion with back-pressure, idempotent upserts, the job state machine, windows and throttled progress."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# What follows a state, when a job goes stale, and how often it is tried.
NEXT = {"queued": "parsing", "parsing": "chunking", "chunking": "embedding", "embedding": "upserting", "upserting": "ready"}
STALE_MS, MAX_ATTEMPTS = 120_000, 3
STATE_SCHEMA = "status string, attempts int, last_ms long"
OUT_SCHEMA = "doc_id string, status string, attempts int"


def events(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """ST1, ST8: a folder of Parquet files as a stream, so many files at a time; times become timestamps that watermarks accept."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(rows: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """ST5, C19: each key once while it may come again."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def windowed(rows: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Tumbling or sliding counts by type."""
    return rows.withWatermark("ts", late).groupBy(F.window("ts", width, slide) if slide else F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def throttled(rows: DataFrame, width: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """ST9: the last report of each document in each window."""
    return rows.withWatermark("ts", late).groupBy(F.window("ts", width), "user_id").agg(F.max_by("event_type", "ts").alias("last"), F.count(F.lit(1)).alias("reports"))


def state_machine(rows: DataFrame) -> DataFrame:
    """ST2 to ST4: (doc_id, status, attempts) after each batch's signals (doc_id, signal, ts). `done` moves a document on, `fail` has it tried again from where it was until its attempts are used up, `cancel` ends it; without a signal for STALE_MS, it is taken up again and the attempt not charged."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, attempts, last = state.get if state.exists else ("queued", 0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"doc_id": [key[0]], "status": [status if status in ("ready", "failed", "cancelled") else "queued"], "attempts": [attempts]})
            return
        rows_ = pd.concat(list(batches)).sort_values("ts", kind="stable")
        for r in rows_.itertuples():
            if status in ("ready", "failed", "cancelled"):
                break
            if r.signal == "done":
                status = NEXT[status]
            elif r.signal == "cancel":
                status = "cancelled"
            elif r.signal == "fail":
                attempts += 1
                status = "failed" if attempts >= MAX_ATTEMPTS else status
            last = int(r.ts.timestamp() * 1000)
        state.update((status, attempts, last))
        state.setTimeoutDuration(STALE_MS)
        yield pd.DataFrame({"doc_id": [key[0]], "status": [status], "attempts": [attempts]})

    return rows.groupBy("doc_id").applyInPandasWithState(step, OUT_SCHEMA, STATE_SCHEMA, "update", GroupStateTimeout.ProcessingTimeTimeout)


def upsert_batches(rows: DataFrame, path: str, checkpoint: str, key: str = "event_id"):
    """ST5: each batch is written under its own number, so a batch that runs again replaces itself; see upserted for keys that come in several."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserted(spark: SparkSession, path: str, key: str = "event_id") -> DataFrame:
    """ST5, merged when read: of each key the row of the latest batch that upsert_batches wrote to path. An aggregate, so a key in very many batches is reduced before it moves."""
    rows = spark.read.parquet(path)
    latest = rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != "batch")), "batch").alias("row"))
    return latest.select("row.*")
