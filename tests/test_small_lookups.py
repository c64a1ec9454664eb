"""Lifecycle look-ups, histories and recall on a few rows."""

import pytest
from pyspark.sql import functions as F

from factweave.operators import lookup, vector


@pytest.fixture(scope="module")
def entities(spark):
    cols = ("entity_id long, name string, aliases array<string>, temporal_status string, lifecycle_status string, lifecycle_score double, first_seen_at string, last_seen_at string, "
            "mention_count int, confidence double")
    return spark.createDataFrame([(1, "Ada", [], None, " dormant", .3, None, None, 2, .5), (2, "Bob", ["Bobby"], "past", None, None, None, None, None, None), (3, "Cy", [], None, "odd", 1., None, None, 1, 1.)], cols)


def test_lifecycle(spark, entities):
    ids = lambda state: sorted(r.entity_id for r in lookup.by_lifecycle(entities, state).collect())
    assert (ids("Dormant"), ids("ACTIVE"), ids(None), ids("nonsense")) == ([1], [], [1, 2, 3], [1, 2, 3])
    asked = spark.createDataFrame([(7, "bobby"), (8, "ada"), (9, "nobody"), (10, "3")], "query_id long, q string")
    got = {r.query_id: (r.entity_id, r.temporal_status, r.lifecycle_status, r.lifecycle_score, r.mention_count) for r in lookup.entity_lifecycle(asked, entities).collect()}
    assert got == {7: (2, "past", "ACTIVE", 0.0, 0), 8: (1, "current", "DORMANT", .3, 2), 10: (3, "current", "ACTIVE", 1.0, 1)}


def test_history(spark):
    """The text has to stand in one column; two columns side by side don't make a hit."""
    log = spark.createDataFrame([(1, "new", "york"), (2, "New York", None), (3, None, "in new york"), (3, "b", "x"), (3, "a", "x")], "at int, name string, source string")
    told = lambda text, n=50: [(r.at, r.name) for r in lookup.log_history(log, text, ("name", "source"), "at", n).collect()]
    assert told(" new YORK ") == [(3, None), (2, "New York")]
    assert told("", 4) == [(3, None), (3, "a"), (3, "b"), (2, "New York")] and told("z") == []


def test_recall(spark):
    rows = [(i, [1.0, i / 10], f"m{i}", "fact", 3, 0, "2024-01-01", 0.5) for i in range(12)] + [(99, [-1.0, 0.0], "away", "fact", 3, 0, "2024-01-01", 0.5)]
    corpus = spark.createDataFrame(rows, "key long, vector array<double>, memory string, type string, importance int, access_count int, valid_from string, confidence double")
    corpus = vector.with_norm(corpus.withColumn("last_accessed", F.to_timestamp("valid_from")))
    asked = vector.with_norm(spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>"))
    now = F.lit("2024-01-02").cast("timestamp")
    counts = [vector.recall(asked, corpus, now, k).count() for k in (0, 3, 50)]
    got = vector.recall(asked, corpus, now).orderBy("rank").collect()
    assert counts == [1, 3, 10] and [r.memory for r in got] == ["m0", "m1", "m2", "m3", "m4"] and got[0].similarity == 1.0
