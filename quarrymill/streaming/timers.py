"""Structured Streaming with timers and state: jobs that wait before they are tried again, and progress that is reported in steps."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarrymill.functions.text import RETRY_MS
from quarrymill.streaming.jobs import MAX_ATTEMPTS, NEXT, STALE_MS

KEEP_MS = 3_600_000  # how long an ended job is remembered, so that what comes late for it changes nothing
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"  # the one that knows timers
JOB_STATE = "status string, phase string, attempts int, due long, beat long, seen long, events long"
JOB_ROWS = "doc_id long, status string, phase string, attempts int, at long, events long, by_timer boolean"
# What lets a report through, in milliseconds since the last that went and in points of progress.
STEP_MS, STEP_POINTS = 400, 5


class JobTimers(StatefulProcessor):
    """ST2 to ST4 for each document; see retried."""

    def __init__(self, max_attempts: int, stale_ms: int, keep_ms: int, by_clock: bool) -> None:
        self.max_attempts, self.stale_ms, self.keep_ms, self.by_clock = max_attempts, stale_ms, keep_ms, by_clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", JOB_STATE, self.keep_ms + self.stale_ms + RETRY_MS[-1] if self.by_clock else None)

    def _load(self) -> dict[str, Any]:
        if not self.state.exists():
            return {"status": "queued", "phase": "pending", "attempts": 0, "due": 0, "beat": 0, "seen": 0, "events": 0}
        return dict(zip((x.split()[0] for x in JOB_STATE.split(", ")), self.state.get(), strict=True))

    def _expiry(self, s: dict[str, Any]) -> int | None:
        """When the job changes by itself; None for never."""
        return {"waiting": s["due"], "active": s["beat"] + self.stale_ms, "ended": s["seen"] + self.keep_ms}.get(s["phase"])

    def _expire(self, s: dict[str, Any], now: int) -> int | None:
        """What time alone has changed until now, and when."""
        at = self._expiry(s)
        if at is None or at > now or s["phase"] == "ended":
            return None
        if s["phase"] == "active":
            s["attempts"] -= 1  # nobody failed: the attempt isn't charged
        s["phase"] = "pending"
        return at

    def _signal(self, s: dict[str, Any], signal: str, now: int) -> None:
        active = s["phase"] == "active"
        if signal == "cancel" and s["phase"] != "ended":
            s |= {"status": "cancelled", "phase": "ended"}
        elif signal == "claim" and s["phase"] == "pending":
            s |= {"phase": "active", "attempts": s["attempts"] + 1, "beat": now}
        elif signal == "beat" and active:
            s["beat"] = now
        elif signal == "done" and active:
            status = NEXT[s["status"]]
            s |= {"status": status, "phase": "pending" if status in NEXT else "ended", "attempts": 0}
        elif signal == "fatal" and active or signal == "fail" and active and s["attempts"] >= self.max_attempts:
            s |= {"status": "failed", "phase": "ended"}
        elif signal == "fail" and active:
            s |= {"phase": "waiting", "due": now + RETRY_MS[min(s["attempts"], len(RETRY_MS)) - 1]}

    def _keep(self, s: dict[str, Any]) -> None:
        self.state.update(tuple(s.values()))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if (at := self._expiry(s)) is not None:
            self.handle.registerTimer(int(at))

    def _row(self, key: tuple, s: dict[str, Any], at: int, by_timer: bool) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": [key[0]], "status": [s["status"]], "phase": [s["phase"]], "attempts": [s["attempts"]], "at": [at], "events": [s["events"]], "by_timer": [by_timer]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        s = self._load()
        signals = pd.concat(list(rows)).sort_values(["ts_ms", "seq"], kind="stable")
        for now, signal in zip(signals["ts_ms"].tolist(), signals["signal"].tolist(), strict=True):
            self._expire(s, now)
            self._signal(s, signal, now)
            s |= {"seen": max(s["seen"], now), "events": s["events"] + 1}
        self._keep(s)
        yield self._row(key, s, s["seen"], False)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        s = self._load()
        now = expiredTimerInfo.getExpiryTimeInMs()
        if s["phase"] == "ended":
            if self._expiry(s) <= now:
                self.state.clear()
        elif (at := self._expire(s, now)) is not None:
            self._keep(s)
            yield self._row(key, s, at, True)

    def close(self) -> None:
        pass


def retried(signals: DataFrame, max_attempts: int = MAX_ATTEMPTS, stale_ms: int = STALE_MS, keep_ms: int = KEEP_MS, by_clock: bool = False, late: str = "10 seconds") -> DataFrame:
    """ST2 to ST4: (doc_id, status, phase, attempts, at, events, by_timer) of jobs after each batch of signals (doc_id, signal, ts, seq), and whenever time alone changes one.

    A job is pending until it is claimed, which charges an attempt, and then active. `done` moves its document on to the next state and
    `beat` says that it goes on; without a signal for stale_ms it is pending again and the attempt isn't charged. After `fail` it waits
    for 2, 8 or 30 s by its attempts before it is pending again; with no attempt left, or after `fatal`, it has failed. `cancel` ends it.
    Signals that don't fit the phase change nothing, nor do any for a job that has ended, as long as it is remembered.

    Time is that of the signals' watermark, so that a replay gives the same; by_clock takes the machine's, and then the state store forgets
    idle jobs itself. Time passes between the signals of one batch too, so results don't depend on how batches are cut. The session
    needs STATE_STORE as its state store.
    """
    at = F.unix_millis("ts") if not by_clock else F.unix_millis(F.current_timestamp())
    rows = signals.select("doc_id", "signal", F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("long").alias("seq")).withColumn("ts_ms", at)
    rows = rows if by_clock else rows.withWatermark("ts", late)
    return rows.groupBy("doc_id").transformWithStateInPandas(JobTimers(max_attempts, stale_ms, keep_ms, by_clock), JOB_ROWS, "Update", "ProcessingTime" if by_clock else "EventTime")


def throttled(reports: DataFrame) -> DataFrame:
    """ST9: of each document's reports (doc_id, ts_ms, seq, value, force), those that go: the first, forced ones, and those STEP_MS or STEP_POINTS from the last that went; values are rounded and held to 0 to 100.

    What goes depends on what went before, so a document's reports are folded in their order; rows that fit none of this don't come back. A
    null force is false; reports without a value or time don't count.
    """
    whole = reports.where("value IS NOT NULL AND ts_ms IS NOT NULL").select("doc_id", "ts_ms", "seq", F.col("value").cast("double").alias("value"), F.coalesce("force", F.lit(False)).alias("force"))
    kinds = {f.name: f.dataType.simpleString() for f in whole.schema}
    schema = ", ".join(f"{c} {k}" for c, k in kinds.items() if c not in ("value", "force")) + ", progress int"
    # Sorted within partitions, so that a document's reports pass by one after another, whatever their number.
    return whole.repartition("doc_id").sortWithinPartitions("doc_id", "ts_ms", "seq").mapInPandas(_fold, schema)


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    last: tuple | None = None
    for batch in batches:
        goes = []
        for doc, ts, value, force in zip(batch["doc_id"].tolist(), batch["ts_ms"].tolist(), batch["value"].tolist(), batch["force"].tolist(), strict=True):
            go = last is None or last[0] != doc or force or ts - last[1] >= STEP_MS or abs(value - last[2]) >= STEP_POINTS
            goes.append(go)
            if go:
                last = (doc, ts, value)
        yield _progress(batch[pd.Series(goes, index=batch.index, dtype=bool)])


def _progress(went: pd.DataFrame) -> pd.DataFrame:
    return went.assign(progress=(went["value"] + 0.5).floordiv(1).clip(0, 100).astype("int32")).drop(columns=["value", "force"])


class Throttle(StatefulProcessor):
    """ST9 as a stream: remembers what of a document went last."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts_ms long, value double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(["ts_ms", "seq"], kind="stable")
        last, goes = self.last.get() if self.last.exists() else None, []
        for ts, value, force in zip(batch["ts_ms"].tolist(), batch["value"].tolist(), batch["force"].tolist(), strict=True):
            go = last is None or force or ts - last[0] >= STEP_MS or abs(value - last[1]) >= STEP_POINTS
            goes.append(go)
            if go:
                last = (ts, value)
        if last is not None:
            self.last.update(last)
        yield _progress(batch[goes])[["doc_id", "ts_ms", "seq", "progress"]]

    def close(self) -> None:
        pass


def throttled_stream(reports: DataFrame) -> DataFrame:
    """ST9: throttled for a stream of reports (doc_id long, ts_ms long, seq long, value double, force boolean); what went last is kept between batches, so the result is that of one pass, if batches come in order. The session needs STATE_STORE."""
    whole = reports.where("value IS NOT NULL AND ts_ms IS NOT NULL").select("doc_id", "ts_ms", "seq", F.col("value").cast("double").alias("value"), F.coalesce("force", F.lit(False)).alias("force"))
    return whole.groupBy("doc_id").transformWithStateInPandas(Throttle(), "doc_id long, ts_ms long, seq long, progress int", "Append", "None")
