"""What grows with the input is neither sent to the driver nor cut into cells that nobody asks for."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from factweave.operators import aggregate, intervals, windows
from factweave.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["entity_changes", "entity_parts"])
def test_growing_sides_are_not_broadcast(spark, name):
    assert "Broadcast" not in plan(QUERIES[name](spark, SF))


def test_versions_of_entities_are_made_once(spark, monkeypatch):
    """Where the highest version begun holds every instant no version is cut into cells; a missing history leaves the current version."""
    monkeypatch.setattr(intervals, "as_of", lambda *a, **k: pytest.fail("cells"))
    day = lambda n: datetime(2020, 1, n)
    kind = "entity_id int, version int, name string, type string, valid_from timestamp, valid_to timestamp, history array<struct<snapshot:struct<version:int,name:string,type:string,valid_from:timestamp,valid_to:timestamp>>>"
    e = spark.createDataFrame([(1, 2, "b", "X", day(5), None, [((1, "a", "X", day(1), day(5)),)]), (2, 1, "c", "Y", day(2), None, None)], kind)
    asked = spark.createDataFrame([(1, day(3)), (1, day(5)), (2, day(1)), (2, day(9))], "entity_id int, instant timestamp")
    got = sorted(tuple(r) for r in intervals.entity_as_of(e, asked).select("entity_id", "instant", "version", "name", "current", "n_matches").collect())
    assert got == [(1, day(3), 1, "a", False, 1), (1, day(5), 2, "b", True, 2), (2, day(9), 1, "c", True, 1)]


@pytest.mark.parametrize("closed", [False, True])
def test_equal_versions_give_one_row(spark, closed):
    """A version that occurs twice with other intervals is one answer an instant."""
    v = spark.createDataFrame([("a", 1, "m", 1, 4), ("a", 1, "m", 2, 9), ("a", 0, "o", 0, None)], "k string, version int, memory_id string, f int, t int")
    v = v.select("k", "version", "memory_id", F.timestamp_seconds("f").alias("valid_from"), F.timestamp_seconds("t").alias("valid_to"))
    asked = spark.createDataFrame([("a", 3), ("a", 6), ("a", 10)], "k string, s int").select("k", F.timestamp_seconds("s").alias("instant"))
    one, other = (sorted((r.instant, r.memory_id, r.version, r.n_matches) for r in f.as_of(v, asked, "k", closed).collect()) for f in (windows, intervals))
    assert one == other and [x[1:] for x in one] == [("m", 1, 3), ("m", 1, 2), ("o", 0, 1)]


@pytest.mark.parametrize("name", ["asof_half_open", "asof_closed"])
def test_instants_are_not_held_as_a_set(spark, name, monkeypatch):
    """Repeated instants are dropped in the sorted order; no task builds a table of all that its rows make."""
    seen = []
    monkeypatch.setattr(windows.shared, "kept", lambda df, _: seen.append(plan(df)) or df)
    rows = QUERIES[name](spark, SF)
    assert "HashAggregate" not in seen[0]
    assert rows.count() == rows.select("chain_id", "instant").distinct().count() > 0


@pytest.mark.parametrize("name", ["edges", "neighbors"])
def test_edges_are_dealt_out_before_their_minimum(spark, name):
    """The minimum of structs sorts its rows: it stands after the exchange and not before it, where a task has a whole part of a file."""
    found = QUERIES[name](spark, SF)
    below = plan(found).split("Initial Plan")[-1].splitlines()
    first = next(i for i, line in enumerate(below) if "partial_min" in line)
    final = next(i for i, line in enumerate(below) if "functions=[min(" in line)
    assert not [line for line in below[final:first] if "Exchange" in line]


def test_edges_are_read_once_by_the_audit_of_the_graph(spark):
    """All rules of an end of an edge are seen in one join; no side is sent out."""
    found = plan(QUERIES["audit_graph"](spark, SF)).split("Initial Plan")[-1]
    assert sum("FileScan" in x and "lineitem" in x for x in found.splitlines()) == 1
    assert "Broadcast" not in found


def test_violations_are_made_once_by_a_reconciliation(spark):
    """What is found before and after stands in a folder: comparing the two doesn't derive stores and graph again."""
    from factweave.operators import reconcile

    items = spark.createDataFrame([("m1",), ("m2",)], "memory_id string")
    ents = spark.createDataFrame([("p1", ["m1"])], "entity_id string, memory_ids array<string>")
    nodes = spark.createDataFrame([("m1", "memory"), ("m1", "memory"), ("p1", "entity")], "id string, kind string")
    edges = spark.createDataFrame([("m1", "p9", "MEMORY_HAS_ENTITY")], "source string, target string, type string")
    done = reconcile.reconcile({"items": items, "entities": ents, "nodes": nodes, "edges": edges})
    assert done.status == "REPAIRED" and done.before.count() == 3 and done.after.isEmpty()
    assert all("Join" not in plan(df) and "Exchange" not in plan(df) for df in (done.before, done.after))


@pytest.mark.parametrize("rest,digits", [(True, 2), (False, 4)])
def test_tasks_hand_on_what_can_be_best(spark, rest, digits):
    """Cut to k rows a query in the tasks: the same first k as from all pairs, ties by rounding and copies among them, rows without a score last."""
    import numpy as np

    from factweave.operators import vector

    rng = np.random.default_rng(3)
    made = np.round(rng.normal(size=(60, 4)), 1)
    rows = [(i, made[i % 60].tolist(), None if i % 17 == 0 else float(i % 3)) for i in range(300)] + [(300, [0.0] * 4, 1.0), (301, None, 2.0)]
    corpus = spark.createDataFrame(rows, "key long, vector array<double>, more double").repartition(3)
    queries = corpus.where("key % 10 = 0").selectExpr("key as query_id", "vector")
    more = 0.5 * F.col("more")
    score = F.round(0.4 * F.col("sim") + more, digits) if rest else F.col("sim")
    every = vector.similar_pairs(queries, corpus, -1.0)
    cut = vector.similar_pairs(queries, corpus, -1.0, k=4, weight=0.4, rest=more if rest else None, digits=digits)
    ranked = [sorted(map(tuple, vector.top_k(df.withColumn("score", score), 4, "score").select("query_id", "key", "score", "rank").collect()), key=lambda r: (r[0], r[3])) for df in (every, cut)]
    assert ranked[0] == ranked[1] and len(ranked[0]) == 4 * 31
    assert cut.count() <= 4 * 31 * 3 + 20 < every.count()


def test_ends_meet_their_items_in_one_join(spark):
    """The first end that fits is found over the rows as joined, not by a second join that sorts the batch again."""
    from factweave.operators import changes

    t = lambda c: F.timestamp_seconds(c).alias(c)
    items = spark.createDataFrame([(1, 10), (2, None)], "memory_id long, valid_from long").select("memory_id", t("valid_from"))
    batch = spark.createDataFrame([(1, 1, 5), (1, 2, 20), (1, 3, 30), (2, 4, 1), (3, 5, 9), (None, 6, 9), (None, 7, 9)], "memory_id long, ord long, ended_at long").select("memory_id", "ord", t("ended_at"))
    done = changes.judge_ends(items, batch)
    assert [r.outcome for r in sorted(done.collect(), key=lambda r: r.ord)] == ["NOT_AFTER_START", "ENDED", "ALREADY_ENDED", "ENDED", "NOT_FOUND", "NOT_FOUND", "NOT_FOUND"]
    assert plan(done).split("Initial Plan")[-1].count("SortMergeJoin") == 1


@pytest.mark.parametrize("name", ["relation_upsert", "relation_merge"])
def test_relations_are_dealt_out_once(spark, name):
    """Rows are neither sorted to meet their endpoints nor dealt out anew for their ids: what is read for the rows leaves in one exchange, crowded relations in one more."""
    found = plan(QUERIES[name](spark, SF)).split("Initial Plan")[-1]
    assert "SortMergeJoin" not in found
    assert sum("Exchange hashpartitioning(" in line and "memory_id" not in line and "_h" in line for line in found.splitlines()) == 2
    assert sum("FileScan" in line and "l_orderkey" in line for line in found.splitlines()) == 2


@pytest.mark.parametrize("many,few", [(100_000, 100_000), (20, 0), (0, 0)])
def test_relations_in_parts(spark, monkeypatch, many, few):
    """Crowded relations that are cut first, and unknown endpoints that are joined by sorting, give what a loop over the rows gives."""
    for k, v in {"_MANY": many, "_FEW": few}.items():
        monkeypatch.setattr(aggregate, k, v, raising=False)
    draw, cap = random.Random(3), 7
    batch = [(draw.choice("abbbx"), draw.choice("bccccy"), draw.choice(["R", "R", "R", "S", None]), draw.choice([0.5, 0.65, 0.8, 0.9]), draw.choice(["", " ", None, "e", "f"]), draw.choice([None, *range(20)]), draw.randrange(40)) for _ in range(400)]
    old = [("a", "c", "R", 0.95, "kept", [90, 3]), ("b", "c", None, 0.7, "old", [91, 2]), ("x", "y", "R", 0.7, None, [5, 4]), ("a", "d", "S", 0.7, " ", [])]
    want = {}
    for s, t, r, c, e, ids in old:
        want[s, t, r] = [c, {(-1, e)} if e and e.strip() else set(), set(ids), False]
    for s, t, r, c, e, i, n in batch:
        if s != t and c >= 0.65 and {s, t} <= set("abcd"):
            w = want.setdefault((s, t, r), [c, set(), set(), False])
            w[0], w[3] = max(w[0], c), True
            w[1] |= {(n, e)} if e and e.strip() else set()
            w[2] |= {i} - {None}
    want = {k: (c, max(said)[1] if said else None, touched, sorted(ids)[:cap]) for k, (c, said, ids, touched) in want.items()}
    frame = lambda rows, kind: spark.createDataFrame(rows, f"source string, target string, relation string, confidence double, evidence string, {kind}")
    got = aggregate.upsert_relations(frame(old, "memory_ids array<long>"), frame(batch, "memory_id long, seq long"), spark.createDataFrame([(x,) for x in "abcd"], "entity_id string"), cap=cap)
    rows = got.collect()
    assert {(r.source, r.target, r.relation): (r.confidence, r.evidence, r.touched, list(r.memory_ids)) for r in rows} == want and len(rows) == len(want)
