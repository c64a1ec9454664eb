"""Leader selection in order, journal compaction and contexts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factweave.operators import context, leaders
from factweave.streaming import commits, journal


def test_leaders(spark, tmp_path):
    """The rows a sequential pass drops: near vectors, chains of them, equal ones, forced rows, rows without a direction."""
    rng = random.Random(3)
    base = [np.array([rng.gauss(0, 1) for _ in range(4)]) for _ in range(6)]
    rows = [(k, (base[rng.randrange(6)] + rng.choice([0, 0.3, 0.6]) * np.array([rng.gauss(0, 1) for _ in range(4)])).tolist(), rng.random() < 0.1) for k in range(120)]
    rows += [(200 + k, rows[rng.randrange(120)][1], False) for k in range(30)] + [(300, None, False), (301, [], False), (302, [0.0] * 4, False), (303, [0.0] * 4, False)]
    kept, dropped = [], []
    for k, v, forced in rows:
        x = np.array(v) if v else None
        cos = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
        has = x is not None and np.linalg.norm(x) > 0
        near = has and any(y is not None and np.linalg.norm(y) > 0 and (cos(x, y) >= 0.85 or (x == y).all()) for y in kept)
        if near and not forced:
            dropped.append(k)
        else:
            kept.append(x)
    got = leaders.near_earlier(spark.createDataFrame(rows, "ord int, vector array<double>, forced boolean"), f"file://{tmp_path}")
    assert sorted(r.ord for r in got.collect()) == dropped and len(dropped) > 20


@pytest.mark.parametrize("head,step", [(7, 3), (50, 256)])
def test_leaders_in_rounds(spark, tmp_path, monkeypatch, head, step):
    """Rounds of a few rows, each settled in order, drop what one pass over all rows drops, for a product of either sign of error at the threshold."""
    monkeypatch.setattr(leaders, "HEAD", head, raising=False)
    monkeypatch.setattr(leaders, "STEP", step, raising=False)
    rng = random.Random(8)
    rows = [(3 * k, [rng.choice([-2.0, -1.0, 0.0, 1.0, 2.0]) for _ in range(rng.choice([3, 3, 4]))], rng.random() < 0.2) for k in range(150)]
    # at the threshold of .6 itself: 3, 4 against 5, 0 and multiples of them
    rows += [(1000 + k, [[5.0, 0.0], [3.0, 4.0], [0.3, 0.4], [-4.0, 3.0], [0.0, 7.0]][k % 5] + [0.0] * 3, False) for k in range(10)]
    kept, dropped = [], []
    for k, v, forced in rows:
        near = any(len(v) == len(y) and sum(a * a for a in v) and sum(b * b for b in y) and (sum(a * b for a, b in zip(v, y)) / (sum(a * a for a in v) * sum(b * b for b in y)) ** 0.5 >= 0.6 or v == y) for y in kept)
        (dropped if near and not forced else kept).append(k if near and not forced else v)
    got = leaders.near_earlier(spark.createDataFrame(rows, "ord long, vector array<double>, forced boolean").repartition(3), f"file://{tmp_path}", 0.6)
    assert sorted(r.ord for r in got.collect()) == dropped and 20 < len(dropped) < 150


def test_a_dense_group_is_not_written_as_pairs(spark, tmp_path):
    """Near rows of one group, all different: what is written grows with the rows and not with their pairs."""
    rows = spark.range(1500).selectExpr("id as ord", "array(100 + rand(1), rand(2)) as vector")
    assert leaders.near_earlier(rows, f"file://{tmp_path}").count() == 1499
    assert sum(spark.read.parquet(str(p)).count() for p in tmp_path.iterdir()) <= 4 * 1500


def test_compaction(spark, tmp_path):
    """Two compactions, a NOOP, states on both sides of the checkpoint, and damage of a record, of the chain and a gap."""
    rng, rows, last = random.Random(1), [], journal.NOTHING
    schema = "sequence long, key string, value string, previous_record_hash string"
    for n in range(1, 31):
        row = (n, rng.choice("abc"), rng.choice(["x", "y", None]), last)
        last = journal.record_hash(spark.createDataFrame([row], schema)).first().record_hash if n in (10, 20) else f"h{n}"
        rows.append((*row, last))
    frame = spark.createDataFrame(rows, schema + ", record_hash string")
    c = commits.Commits(spark, f"{tmp_path}/j")
    assert journal.compact_stored(c, 2) == "NOOP"
    c.commit(0, {journal.TAIL: frame.where("sequence <= 20")})
    assert journal.compact_stored(c, 8) == "COMPACTED" and journal.compact_stored(c, 8) == "NOOP" and c.numbers() == [1, 0]
    c.commit(2, {journal.TAIL: c.read(journal.TAIL).unionByName(frame.where("sequence > 20"))})
    assert journal.compact_stored(c, 5) == "COMPACTED"
    meta, state, tail = (c.read(n) for n in (journal.META, journal.STATE, journal.TAIL))
    assert tuple(meta.first()) == (25, "h25", 25) and sorted(r.sequence for r in tail.collect()) == [26, 27, 28, 29, 30]
    for at, status in ((24, "HISTORY_COMPACTED"), (25, "RECONSTRUCTED"), (28, "RECONSTRUCTED"), (30, "RECONSTRUCTED"), (31, "HISTORY_NOT_AVAILABLE")):
        said, got = journal.state_at(meta, state, tail, at)
        want = {k: (v, n) for n, k, v, _, _ in rows if n <= at} if status == "RECONSTRUCTED" else {}
        assert said == status and {r.key: (r.value, r.sequence) for r in got.collect()} == want


def test_verify_tail(spark):
    rows, last = [], "start"
    schema = "sequence long, key string, value string, previous_record_hash string"
    for n in range(4, 10):
        r = journal.record_hash(spark.createDataFrame([(n, "k", str(n), last)], schema)).first()
        rows.append(tuple(r))
        last = r.record_hash
    meta = spark.createDataFrame([(3, "start", 3)], "sequence long, record_hash string, n_events long")
    tail = spark.createDataFrame(rows, schema + ", record_hash string")
    assert journal.verify(meta, tail).count() == 0
    bad = tail.withColumn("value", F.when(F.col("sequence") == 5, "other").otherwise(F.col("value"))).where("sequence <> 7")
    assert {(r.sequence, r.reason) for r in journal.verify(meta, bad).collect()} == {(5, "CONTENT_HASH_MISMATCH"), (8, "SEQUENCE_GAP")}
    assert [r.reason for r in journal.verify(meta.withColumn("record_hash", F.lit("no")), tail).collect()] == ["CHAIN_BROKEN"]


def test_context_cases(spark):
    hits = spark.createDataFrame([(1, "m1", 1), (1, "m2", 2), (1, "m9", 6), (2, "m8", 1)], "query_id int, memory_id string, rank int")
    edges = spark.createDataFrame([("m1", "m2", "NEXT", 0), ("m1", "m3", None, 1), ("m2", "m3", "CAUSES", 0), ("m2", "m4", "CAUSES", 0), *[("m1", f"x{k}", "Z", 1) for k in range(9)]], "memory_id string, neighbor string, relation string, dir int")
    items = spark.createDataFrame([("m2", " two "), ("m3", "three"), ("m4", "three"), ("x0", " ")], "memory_id string, memory string")
    mentions = spark.createDataFrame([("m1", "e1", "Bob", None), ("m2", "e1", "Bob", None), ("m2", "e2", None, "PLACE"), ("m9", "e3", "Al", "PERSON")], "memory_id string, entity_id string, name string, type string")
    got = {r.query_id: (r.graph, r.entities) for r in context.graph_context(hits, edges, items, mentions).collect()}
    assert got == {1: ("- NEXT: two\n- RELATED: three", "- Bob (OTHER)\n-  (PLACE)"), 2: (context.NO_GRAPH, context.NO_ENTITIES)}


@pytest.mark.parametrize("n", [0, 3, 40])
def test_causal_filling(spark, n):
    facts = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(n)], "key int, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id int, vector array<double>")
    rows = context.causal_candidates(q, facts, 2).collect()
    for query in (1, 2):
        own = [r for r in rows if r.query_id == query]
        assert len(own) == len({r.key for r in own}) == min(12, n)
    assert all(r.tier == 2 for r in rows if r.query_id == 2)
