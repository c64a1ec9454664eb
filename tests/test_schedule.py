"""Scheduled outputs: cases, and the stream against the batch form."""

import datetime as dt

import pytest

from factweave.streaming import schedule

START = dt.datetime(2024, 1, 1)


def rows(key, *events):
    return [(key, None if h is None else START + dt.timedelta(hours=h), kind) for h, kind in events]


AUTO = rows("a", (0, "TICK"), (10, "TICK"), (24, "TICK"), (100, "TICK"), (101, "TICK"), (124, "TICK_FAILS"), (125, "TICK"), (127, "TICK"), (150, "PAUSE"), (160, "TICK"), (161, "RESUME"), (162, "TICK"), (163, "APPROVE"))
AUTO_SAYS = ["NOT_DUE", "NOT_DUE", "POSTED", "POSTED", "NOT_DUE", "FAILED", "RETRY_WAIT", "POSTED", "PAUSED", "HELD", "RESUMED", "POSTED", "IGNORED"]
REVIEW = rows("a", (0, "RESUME"), (24, "TICK"), (30, "TICK"), (31, "APPROVE"), (32, "APPROVE"), (54, "TICK"), (55, "TICK"), (78, "TICK_FAILS"), (79, "TICK_UNSEEN"),
              (81, "TICK_UNSEEN"), (82, "SKIP"), (84, "TICK"), (85, "SKIP"), (86, None), (90, "other"), (110, "TICK"), (134, "TICK_FAILS"), (135, "APPROVE"))
REVIEW_SAYS = ["RESUMED", "DRAFTED", "DRAFT_WAITS", "POSTED", "IGNORED", "NOT_DUE", "DRAFTED", "DRAFT_WAITS", "FAILED",
               "FAILED", "IGNORED", "DRAFTED", "SKIPPED", "IGNORED", "IGNORED", "DRAFTED", "FAILED", "POSTED"]


def outcomes(df):
    return [r.outcome for r in df.orderBy("ts", "kind").collect()]


@pytest.fixture()
def make(spark):
    return lambda r: spark.createDataFrame(r, "key string, ts timestamp, kind string")


def test_auto(make):
    """One output an interval, none made up after a silence, rest after a failure, nothing while paused."""
    got = schedule.post_batch(make(AUTO + rows("b", (None, "TICK"))), "key", 24 * 3600, 2 * 3600)
    assert outcomes(got) == AUTO_SAYS
    last = got.orderBy("ts").collect()[-1]
    assert (last.n_done, last.waiting, last.paused) == (4, False, False)
    assert schedule.post_batch(make([]), "key", 60).count() == 0


def test_review(make):
    """A draft waits for its verdict and is written anew after an interval; a failure keeps it, a draft nobody saw is gone."""
    got = schedule.post_batch(make(REVIEW), "key", 24 * 3600, 2 * 3600, review=True)
    assert outcomes(got) == REVIEW_SAYS
    assert got.orderBy("ts").collect()[-1].n_done == 3


def test_stream_equals_batch(spark, make, tmp_path):
    """State goes on from one micro-batch to the next, for every key."""
    every = [(f"{key}{i}", ts, kind) for i in range(5) for key, ts, kind in AUTO + REVIEW if kind is not None]
    cut = START + dt.timedelta(hours=79)
    for n in range(2):
        make([r for r in every if (r[1] < cut) == (n == 0)]).coalesce(1).write.parquet(f"{tmp_path}/in/p={n}")
    stream = spark.readStream.schema("key string, ts timestamp, kind string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    out = schedule.post_stream(stream, "key", 24 * 3600, 2 * 3600, review=True)
    out.writeStream.format("memory").queryName("posts").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.table("posts").collect()))
    assert len(got) == len(every) and got == sorted(map(tuple, schedule.post_batch(make(every), "key", 24 * 3600, 2 * 3600, review=True).collect()))
