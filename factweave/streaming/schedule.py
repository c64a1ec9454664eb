"""Scheduled outputs: at most one per interval and key, a delay after a failure, pause, and drafts that wait for a verdict.

An event (key, ts, kind) is a tick or what an owner says. One rule, ``next_post``, serves the stream and the batch form. Kinds:

* ``TICK``: an output is tried and would succeed; ``TICK_FAILS``: nothing usable comes of it; ``TICK_UNSEEN``: it can't be delivered.
* ``PAUSE`` and ``RESUME``; ``APPROVE`` and ``SKIP`` of a waiting draft (review mode).

A key starts with its first event, and its first output is due a whole interval later. After a long silence one tick gives one output: missed
intervals aren't made up. Rows with a null time are ignored; an unknown or null kind, APPROVE and SKIP without a draft are IGNORED. Equal
times go by kind. State is five numbers a key.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from factweave.operators.fold import fold_in_order
from factweave.streaming.stateful import PROVIDER, _micros, _mode, _ordered

ADDED = "outcome string, n_done int, waiting boolean, paused boolean"
ADDED_COLUMNS = [x.split()[0] for x in ADDED.split(", ")]
NEVER = -(2**62)
TICKS = ("TICK", "TICK_FAILS", "TICK_UNSEEN")


class Post(NamedTuple):
    """Times in microseconds; ``draft`` is the time of the waiting draft or NEVER, ``done`` how many outputs were published or skipped."""

    last: int
    retry: int = NEVER
    draft: int = NEVER
    paused: bool = False
    done: int = 0


def next_post(state: Post | None, kind: str | None, at: int, interval: int, retry: int, review: bool) -> tuple[Post, str]:
    """(state, outcome) after an event; interval and retry in microseconds."""
    now = state or Post(at)
    if kind in ("PAUSE", "RESUME"):
        return now._replace(paused=kind == "PAUSE"), f"{kind}D"
    if kind in ("APPROVE", "SKIP") and now.draft != NEVER:
        return now._replace(last=at, draft=NEVER, done=now.done + 1), "POSTED" if kind == "APPROVE" else "SKIPPED"
    if kind not in TICKS:
        return now, "IGNORED"
    if now.paused:
        return now, "HELD"
    if at < now.retry:
        return now, "RETRY_WAIT"
    waits = review and now.draft != NEVER
    if at - (now.draft if waits else now.last) < interval:
        return now, "DRAFT_WAITS" if waits else "NOT_DUE"
    if kind != "TICK":
        return now._replace(retry=at + retry, draft=NEVER if kind == "TICK_UNSEEN" else now.draft), "FAILED"
    if review:
        return now._replace(draft=at), "DRAFTED"
    return now._replace(last=at, done=now.done + 1), "POSTED"


def _said(state: Post, outcome: str) -> tuple[str, int, bool, bool]:
    return outcome, state.done, state.draft != NEVER, state.paused


class PostMachine(StatefulProcessor):
    def __init__(self, interval: int, retry: int, review: bool, keep_seconds: int | None):
        self.rule, self.keep = (interval, retry, review), keep_seconds and keep_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("post", "last long, retry long, draft long, paused boolean, done int", self.keep)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = _ordered(rows, "ts", "kind")
        now, out = Post(*self.state.get()) if self.state.exists() else None, []
        for at, ts, kind in zip(_micros(events["ts"]), events["ts"], events["kind"]):
            now, outcome = next_post(now, kind, int(at), *self.rule)
            out.append((key[0], ts, kind, *_said(now, outcome)))
        if now is not None:
            self.state.update(tuple(now))
        yield pd.DataFrame(out, columns=["key", "ts", "kind", *ADDED_COLUMNS])

    def close(self) -> None:
        pass


def post_stream(events: DataFrame, key: str, interval_seconds: int, retry_seconds: int = 600, review: bool = False, keep_seconds: int | None = None) -> DataFrame:
    """Outcome of each event of a stream; ``keep_seconds`` as in ``stateful``."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    kind = events.schema[key].dataType.simpleString()
    machine = PostMachine(interval_seconds * 1_000_000, retry_seconds * 1_000_000, review, keep_seconds)
    out = events.select(key, "ts", "kind").groupBy(key).transformWithStateInPandas(machine, f"key {kind}, ts timestamp, kind string, {ADDED}", "Append", _mode(keep_seconds))
    return out.withColumnRenamed("key", key)


def post_batch(events: DataFrame, key: str, interval_seconds: int, retry_seconds: int = 600, review: bool = False) -> DataFrame:
    """The outcomes of ``post_stream`` for a table of events; a key's events are read in order with its state, however many they are."""
    def step(state: Post | None, row: tuple) -> tuple[Post, tuple]:
        state, outcome = next_post(state, row[1], row[0], interval_seconds * 1_000_000, retry_seconds * 1_000_000, review)
        return state, _said(state, outcome)

    return fold_in_order(events.where("ts is not null"), key, ("ts", "kind"), step, ADDED)
