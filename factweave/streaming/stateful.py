"""Stateful stream operators: the lease machine of operations and the interval gate.

Both keep a few numbers per key in the state store (RocksDB provider). With ``keep_seconds`` a key that was not written for so long (processing
time) is forgotten, so the state holds the keys in use and not every key ever seen: a stream that runs on for ever should name it. It needs
a trigger that fires again by time; Spark goes on making empty batches there, so a run with ``availableNow`` has no end and has to leave it out.
A lease that was forgotten is unknown and a later BEGIN claims it anew; a gate that was forgotten passes the next event. Events of one micro-batch are taken in the order of their
times; an event older than one already taken is judged against the state as it is. Rows with a null time are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from factweave.operators.fold import fold_in_order

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Seconds of a lease and how often a stale operation may be claimed again. Fixed values.
LEASE_SECONDS, MAX_RECOVERIES = 120, 3
NO_LEASE = -1
LEASE_OUT = "operation_key string, ts timestamp, kind string, outcome string, status string, attempt_count int, recovery_count int"
LEASE_COLUMNS = [x.split()[0] for x in LEASE_OUT.split(", ")]


def next_state(state: tuple | None, kind: str, at: int, lease_seconds: int = LEASE_SECONDS) -> tuple[tuple | None, str]:
    """(state, outcome) after an event; a state is (status, lease end in microseconds, attempts, recoveries).

    BEGIN claims an unknown operation (CLAIMED) or a stale one (RECLAIMED, LIMIT after three times), else it is REFUSED.
    HEARTBEAT extends the lease of a started one; COMPLETE and FAIL end a known one. Anything else is IGNORED.
    """
    lease = at + lease_seconds * 1_000_000
    if kind == "BEGIN" and state is None:
        return ("STARTED", lease, 1, 0), "CLAIMED"
    if state is None:
        return None, "IGNORED"
    status, until, attempts, recoveries = state
    if kind == "BEGIN":
        if status != "STARTED" or until > at:
            return state, "REFUSED"
        if recoveries >= MAX_RECOVERIES:
            return ("FAILED", NO_LEASE, attempts, recoveries), "LIMIT"
        return ("STARTED", lease, attempts + 1, recoveries + 1), "RECLAIMED"
    if kind == "HEARTBEAT" and status == "STARTED":
        return (status, lease, attempts, recoveries), "EXTENDED"
    if kind in ("COMPLETE", "FAIL"):
        return ("COMPLETED" if kind == "COMPLETE" else "FAILED", NO_LEASE, attempts, recoveries), "ENDED"
    return state, "IGNORED"


def _ordered(rows: Iterator[pd.DataFrame], *cols: str) -> pd.DataFrame:
    """The wanted columns of a key's rows of this micro-batch, by time."""
    every = pd.concat([r[list(cols)] for r in rows], ignore_index=True).dropna(subset=["ts"])
    return every.sort_values(list(cols), kind="stable", ignore_index=True)


def _micros(ts: pd.Series) -> np.ndarray:
    return ts.to_numpy().astype("datetime64[us]").astype("int64")


class LeaseMachine(StatefulProcessor):
    """With ``timers`` a lease that isn't renewed gives a row (kind TIMER, outcome EXPIRED) when the watermark passes its end, without an event of its key."""

    def __init__(self, keep_seconds: int | None, lease_seconds: int = LEASE_SECONDS, timers: bool = False):
        self.keep, self.lease, self.timers = keep_seconds and keep_seconds * 1000, lease_seconds, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("lease", "status string, until long, attempts int, recoveries int", self.keep)

    def _keep(self, before: tuple | None, now: tuple) -> None:
        if self.timers and (before is None or before[1] != now[1]):
            if before is not None and before[1] != NO_LEASE:
                self.handle.deleteTimer(-(-before[1] // 1000))
            if now[1] != NO_LEASE:
                self.handle.registerTimer(-(-now[1] // 1000))
        self.state.update(now)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        row = initialState.iloc[0]
        ends = NO_LEASE if row["status"] != "STARTED" else int(_micros(initialState["lease"])[0])
        self._keep(None, (row["status"], ends, int(row["attempts"]), int(row["recoveries"])))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = _ordered(rows, "ts", "kind")
        before = now = tuple(self.state.get()) if self.state.exists() else None
        out = []
        for at, ts, kind in zip(_micros(events["ts"]), events["ts"], events["kind"]):
            now, outcome = next_state(now, kind, int(at), self.lease)
            out.append((key[0], ts, kind, outcome, *((now[0], now[2], now[3]) if now else (None, 0, 0))))
        if now is not None:
            self._keep(before, now)
        yield pd.DataFrame(out, columns=LEASE_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = tuple(self.state.get()) if self.state.exists() else None
        if now and now[0] == "STARTED" and now[1] <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            yield pd.DataFrame([(key[0], pd.Timestamp(now[1] * 1000), "TIMER", "EXPIRED", now[0], now[2], now[3])], columns=LEASE_COLUMNS)

    def close(self) -> None:
        pass


class IntervalGate(StatefulProcessor):
    def __init__(self, seconds: int, keep_seconds: int | None):
        self.step, self.keep = seconds * 1_000_000, keep_seconds and keep_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long", self.keep)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ts = _ordered(rows, "ts")["ts"]
        at = _micros(ts)
        last = self.last.get()[0] if self.last.exists() else None
        passed, i = [], 0
        while i < len(at):
            if last is None or at[i] - last >= self.step:
                passed.append(i)
                last = int(at[i])
            i = max(i + 1, int(np.searchsorted(at, last + self.step)))
        if passed:
            self.last.update((last,))
        yield pd.DataFrame({"key": [key[0]] * len(passed), "ts": ts.iloc[passed].reset_index(drop=True)})

    def close(self) -> None:
        pass


def _mode(keep_seconds: int | None) -> str:
    return "None" if keep_seconds is None else "ProcessingTime"


def lease_stream(events: DataFrame, keep_seconds: int | None = None, lease_seconds: int = LEASE_SECONDS, watermark: str | None = None, store: DataFrame | None = None) -> DataFrame:
    """Outcome of each event (operation_key, ts, kind) of a stream of BEGIN, HEARTBEAT, COMPLETE and FAIL.

    With a ``watermark`` (a delay) leases end by event time without an event of their own; events later than it are dropped. ``store``
    (operation_key, status, lease, attempts, recoveries; one row a key) is the state that the stream starts with.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = events.select("operation_key", "ts", "kind")
    rows = rows.withWatermark("ts", watermark) if watermark else rows
    held = store.select("operation_key", "status", "lease", "attempts", "recoveries").groupBy("operation_key") if store is not None else None
    mode = "EventTime" if watermark else _mode(keep_seconds)
    return rows.groupBy("operation_key").transformWithStateInPandas(LeaseMachine(None if watermark else keep_seconds, lease_seconds, bool(watermark)), LEASE_OUT, "Append", mode, held)


def lease_batch(events: DataFrame, lease_seconds: int = LEASE_SECONDS) -> DataFrame:
    """The outcomes of ``lease_stream`` for a table of events. A key's events are read in order with its state, however many they are."""
    def step(state: tuple | None, row: tuple) -> tuple[tuple | None, tuple]:
        state, outcome = next_state(state, row[1], row[0], lease_seconds)
        return state, (outcome, *((state[0], state[2], state[3]) if state else (None, 0, 0)))

    return fold_in_order(events.where("ts is not null"), "operation_key", ("ts", "kind"), step, "outcome string, status string, attempt_count int, recovery_count int")


def interval_stream(events: DataFrame, key: str, seconds: int, keep_seconds: int | None = None) -> DataFrame:
    """Events (key, ts) let through if at most one per interval and key may pass, without catching up."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    kind = events.schema[key].dataType.simpleString()
    return events.select(key, "ts").groupBy(key).transformWithStateInPandas(IntervalGate(seconds, keep_seconds), f"key {kind}, ts timestamp", "Append", _mode(keep_seconds)).withColumnRenamed("key", key)
