"""Streams of progress events: pairing of starts and completions, timeouts, incremental ingestion."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.dedup import keep_first
from ..operators.runs import FINISHED, PHASE_KEYS, STAGE_FINISHED, STAGE_STARTED, STARTED, WRAPPERS

PAIR = "key string, started_at timestamp, completed_at timestamp, seconds double, status string"


def event_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New Parquet files of a folder, as they come."""
    return spark.readStream.schema(schema).parquet(path)


def paired_stream(events: DataFrame, started: str = "started", completed: str = "completed", timeout_seconds: int = 0) -> DataFrame:
    """Completed pairs of a stream (key, kind, ts). State is one start per key.

    A second start replaces the first, a completion without a start goes. Within a batch events count by time. With
    timeout_seconds, a start without a completion for so long in event time (give the stream a watermark) is returned once,
    with the status timeout, and forgotten.
    """
    limit = timeout_seconds * 1000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        start = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        if state.hasTimedOut:
            out.append((key[0], start, pd.NaT, None, "timeout"))
            state.remove()
        else:
            for row in pd.concat(list(batches)).sort_values("ts").itertuples():
                if row.kind == started:
                    start = row.ts
                elif row.kind == completed and start is not None:
                    out.append((key[0], start, row.ts, (row.ts - start).total_seconds(), "completed"))
                    start = None
            if start is None:
                if state.exists:
                    state.remove()
            else:
                state.update((int(start.value // 1000),))
                if limit:
                    state.setTimeoutTimestamp(max(int(start.value // 1_000_000), state.getCurrentWatermarkMs()) + limit)
        yield pd.DataFrame(out, columns=["key", "started_at", "completed_at", "seconds", "status"])

    timeout = GroupStateTimeout.EventTimeTimeout if limit else GroupStateTimeout.NoTimeout
    return events.groupBy("key").applyInPandasWithState(step, PAIR, "started long", "append", timeout)


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An extension: events per kind and window, final once the watermark has passed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "kind").agg(F.count("*").alias("n"))


#: What a report of `reported_stream` holds; times in microseconds.
REPORT = "phase string, position string, candidate string, status string, started_us long, completed_us long, seconds double, subphases long, longest string, longest_seconds double, last string, last_status string"
#: State of a key: its start, how many sub-phases ended, the last sub-phase told, and for leaves and wrappers the longest and the last.
_STATE = "open boolean, start long, n long, told string, told_status string, l_any boolean, l_longest string, l_seconds double, l_last string, l_status string, w_any boolean, w_longest string, w_seconds double, w_last string, w_status string"
_FRESH = (False, None, 0, None, None) + (False, None, None, None, None) * 2


def _longer(seconds: float | None, best: float | None) -> bool:
    """No time at all counts below any other; the first of equals stays."""
    return seconds is not None and (best is None or (seconds or -1.0) > (best or -1.0))


class Reports(StatefulProcessor):
    """One key's starts, ends and sub-phases; memory of a key is one row, and one start for each open sub-phase."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle) -> None:
        self.handle = handle
        self.summary = handle.getValueState("summary", _STATE)
        self.begun = handle.getMapState("begun", "subphase string", "start long")

    def handleInputRows(self, key, rows, timerValues):
        out, latest = [], None
        timers = list(self.handle.listTimers()) if self.limit else []
        if any(timer <= timerValues.getCurrentWatermarkInMs() for timer in timers):
            out += self.forgotten(key)
        state = list(self.summary.get() or _FRESH)
        # The open starts are read once and written once; in between no event asks the state store.
        held = {name[0]: value[0] for name, value in self.begun.iterator()}
        begun = dict(held)
        for row in pd.concat(list(rows)).sort_values("ordinal").itertuples():
            at = None if pd.isna(row.us) else int(row.us)
            latest = at if latest is None else max(latest, at or latest)
            subphase = row.subphase or ""
            if subphase and row.kind.startswith("worker_stage_"):
                state[3:5] = [subphase, row.status]
            if subphase and row.kind == STAGE_STARTED:
                begun[subphase] = at
            elif subphase and row.kind in STAGE_FINISHED:
                if subphase in begun:
                    start = begun.pop(subphase)
                    seconds = None if start is None or at is None else (at - start) / 1e6
                    base = 10 if subphase in WRAPPERS else 5
                    state[2] += 1
                    if _longer(seconds, state[base + 2]):
                        state[base + 1 : base + 3] = [subphase, seconds]
                    state[base], state[base + 3], state[base + 4] = True, subphase, row.status
            elif row.kind == STARTED:
                state[0:2] = [True, at]
            elif row.kind == FINISHED and state[0]:
                if state[1] is not None and at is not None:
                    out.append((*key, row.status, state[1], at, (at - state[1]) / 1e6, *self.told(state, key, (at - state[1]) / 1e6, row.status)))
                state[0:2] = [False, None]
        self.summary.update(tuple(state))
        for name in held.keys() - begun.keys():
            self.begun.removeKey((name,))
        for name, start in begun.items():
            if name not in held or held[name] != start:
                self.begun.updateValue((name,), (start,))
        if self.limit:
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max((latest or 0) // 1000, timerValues.getCurrentWatermarkInMs()) + self.limit)
        if out:
            yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield self.frame(self.forgotten(key))

    def forgotten(self, key) -> list:
        state = self.summary.get()
        self.summary.clear()
        self.begun.clear()
        return [(*key, "timeout", state[1], None, None, *self.told(state, key, None, "timeout"))] if state and state[0] else []

    def close(self) -> None:
        pass

    def told(self, state, key, seconds, status) -> tuple:
        base = 5 if state[5] else 10
        if state[base]:
            return (state[2], *state[base + 1 : base + 5])
        if state[3]:
            return (state[2], None, None, state[3], state[4])
        total = f"{key[0] or 'candidate'}_total"
        return (state[2], total, seconds, total, status)

    @staticmethod
    def frame(rows: list) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=[c.split()[0] for c in REPORT.split(", ")])
        whole = {c: "Int64" for c in ("started_us", "completed_us", "subphases")}
        return frame.astype({c: "object" for c in frame.columns if c not in whole and not c.endswith("seconds")} | whole | {"seconds": "float64", "longest_seconds": "float64"})


def reported_stream(events: DataFrame, timeout_seconds: int = 0) -> DataFrame:
    """`runs.phase_reports` of a stream: a report of every completed start, with the longest and the last of the sub-phases that ended so far.

    events: (phase, position, candidate, kind, subphase, status, ts, ordinal). Rows of a micro-batch count by ordinal. With timeout_seconds (give the stream a
    watermark), a key without rows for so long in event time is forgotten; if it has an open start, that is told with the status timeout.
    Needs the RocksDB state store (`durable_state`).
    """
    rows = events.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*PHASE_KEYS, "kind")} | {"us": F.unix_micros("ts")})
    grouped = rows.select(*PHASE_KEYS, "kind", "subphase", "status", "ts", "us", "ordinal").groupBy(*PHASE_KEYS)
    told = grouped.transformWithStateInPandas(Reports(timeout_seconds * 1000), REPORT, "append", "EventTime" if timeout_seconds else "None")
    return told.select(*PHASE_KEYS, "status", F.timestamp_micros("started_us").alias("started_at"), F.timestamp_micros("completed_us").alias("completed_at"), "seconds", "subphases", "longest", "longest_seconds", "last", "last_status")


def durable_state(spark: SparkSession) -> None:
    """State of streams started from now on lies in RocksDB: on disk, changes alone in checkpoints."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def open_timeouts(reports: DataFrame) -> DataFrame:
    """Keys whose latest start timed out: a later report of the key clears it, a later timeout takes its place."""
    return keep_first(reports, PHASE_KEYS, [F.desc("started_at")]).filter("status = 'timeout'")
