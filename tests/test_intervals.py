"""As-of look-ups over overlapping intervals against all pairs."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from factweave.operators import intervals, windows

START = datetime(2020, 1, 1)


@pytest.mark.parametrize("closed", [False, True])
def test_as_of_brute(spark, closed):
    """Long, short, open, empty and turned intervals, ends at cell borders and inside cells; the sweep gives the same."""
    rng = random.Random(3)
    at = lambda: START + rng.choice([timedelta(hours=rng.randint(0, 30_000)), timedelta(seconds=rng.randint(0, 100_000)), timedelta(microseconds=rng.randint(0, 5))])
    versions = [(rng.choice(["a", "a", "b", None]), v, f"m{v}", at(), rng.choice([None, at(), at()])) for v in range(160)] + [("a", 999, "x", None, None)]
    versions = [(k, v, m, f, f if t is not None and v % 13 == 0 else t) for k, v, m, f, t in versions]
    asked = [(rng.choice(["a", "b", "z"]), rng.choice([at(), rng.choice(versions)[3], rng.choice(versions)[4]])) for _ in range(300)]
    v = spark.createDataFrame(versions, "k string, version int, memory_id string, valid_from timestamp, valid_to timestamp")
    i = spark.createDataFrame(asked, "k string, instant timestamp")
    want = {}
    for k, t in set(asked):
        hits = [(n, m) for kk, n, m, f, to in versions if t is not None and kk == k and f is not None and f <= t and (to is None or t < to or (closed and t == to and to >= f))]
        if hits:
            want[k, t] = (*max(hits)[::-1], len(hits))
    got = {(r.k, r.instant): (r.memory_id, r.version, r.n_matches) for r in intervals.as_of(v, i, "k", closed).collect()}
    assert got == want
    assert {(r.k, r.instant): (r.memory_id, r.version, r.n_matches) for r in windows.as_of(v, i, "k", closed).collect()} == want
    assert intervals.as_of(v, i.limit(0), "k", closed).count() == 0 and intervals.as_of(v.limit(0), i, "k", closed).count() == 0


def test_hot_chain(spark):
    """20,000 open versions of one key and 20,000 instants: 200 million pairs hold, and none of them is made."""
    v = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").alias("version"), F.col("id").alias("memory_id"), F.timestamp_seconds(F.col("id") * 1000).alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))
    i = spark.range(20_000).select(F.lit("hot").alias("k"), F.timestamp_seconds(F.col("id") * 1000 + 500).alias("instant"))
    r = intervals.as_of(v, i, "k").agg(F.count("*").alias("n"), F.sum((F.col("n_matches") == F.col("version") + 1).cast("int")).alias("right")).first()
    assert (r.n, r.right) == (20_000, 20_000)
