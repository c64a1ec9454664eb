"""Look-ups, journal ranges, logs and graphs on a few rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from factweave.operators import aggregate, lookup, trigrams
from factweave.sources import stores
from factweave.streaming import ledger


def test_references(spark):
    active, archive = spark.createDataFrame([("m1", "tea"), ("m2", "tea")], "memory_id string, memory string"), spark.createDataFrame([("a1", "coffee"), ("a2", "tea")], "memory_id string, memory string")
    q = spark.createDataFrame([(1, "tea"), (2, "coffee"), (3, "milk"), (4, "water"), (5, None)], "query_id int, q string")
    assert {r.query_id: (r.memory_id, r.tier) for r in lookup.find_item(q, active, archive).collect()} == {1: ("m1", 0), 2: ("a1", 1)}
    near, far = spark.createDataFrame([(3, "m2", 0.6), (3, "m1", 0.7), (4, "m1", 0.5)], "query_id int, memory_id string, sim double"), spark.createDataFrame([(4, "a1", 0.9), (3, "a1", 0.99)], "query_id int, memory_id string, sim double")
    assert {r.query_id: r.memory_id for r in lookup.resolve_reference(q, active, archive, near, far).collect()} == {1: "m1", 2: "a1", 3: "m1", 4: "a1"}


def test_find_by_part(spark):
    e = spark.createDataFrame([("1", "Apollo Data", ["Moon"]), ("2", "Apollo Music", None)], "entity_id string, name string, aliases array<string>")
    q = spark.createDataFrame([(1, "data"), (2, "apollo"), (3, "oon"), (4, " "), (5, None)], "query_id int, q string")
    assert {r.query_id: r.entity_id for r in lookup.find_by_part(q, e).collect()} == {1: "1", 3: "1"}


def test_search_inside(spark):
    """A name inside the query or around it scores .85 without a shared word, aliases too."""
    e = spark.createDataFrame([("1", "ChatGPT", None), ("2", "chat room", []), ("3", "Other", ["My Chatbot", "", None]), ("4", "hat", []), ("5", "!!", []), ("6", " ", [])], "entity_id string, name string, aliases array<string>")
    e = e.withColumns({"mention_count": F.lit(1), "confidence": F.lit(0.5)})
    q = spark.createDataFrame([(1, "chat"), (2, "!!"), (3, " "), (4, None), (5, "room big")], "query_id int, q string")
    got = {(r.query_id, r.entity_id): r.score for r in lookup.search_entities(q, e, 10).collect()}
    assert got == {(1, "1"): 0.85, (1, "2"): 0.85, (1, "3"): 0.85, (1, "4"): 0.85, (2, "5"): 1.0, (5, "2"): 0.3333}


def test_trigrams_brute(spark):
    """All patterns against all texts, short and blank ones, texts in several scripts; no nested loop in the plan."""
    rng = random.Random(8)
    make = lambda low, high: "".join(rng.choice("abAé 日") for _ in range(rng.randint(low, high)))
    texts, patterns = [make(0, 14) for _ in range(150)] + [None, "aaaaaaaa"], [make(0, 5) for _ in range(200)] + [None, "aaa", "zzz"]
    p, t = spark.createDataFrame([(x,) for x in patterns], "pattern string"), spark.createDataFrame([(x,) for x in texts], "text string")
    found = trigrams.containing(p, t)
    assert sorted(map(tuple, found.collect())) == sorted({(x, y) for x in patterns if x for y in texts if y is not None and x in y})
    assert sorted(map(tuple, trigrams.containing(p, t, postings=trigrams.index(t, "text")).collect())) == sorted(map(tuple, found.collect()))
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()


def test_search_brute(spark):
    """Every rank of a search against scores of all pairs; more entities of one name than are asked for."""
    rng = random.Random(9)
    names = ["red car", "Car", "red  CAR", "art", "blue cart", "x", "green"]
    rows = [(k, rng.choice(names), [rng.choice(names)] * rng.randint(0, 1), rng.randint(0, 2), 0.5) for k in range(40)]
    asked = [(k, rng.choice([*names, "a", "ca", "red thing"])) for k in range(30)]
    e = spark.createDataFrame(rows, "entity_id int, name string, aliases array<string>, mention_count int, confidence double")
    got = {(r.query_id, r["rank"]): (r.entity_id, r.score) for r in lookup.search_entities(spark.createDataFrame(asked, "query_id int, q string"), e, 4).collect()}
    canon = lambda x: " ".join(x.lower().split())
    for k, q in asked:
        scores = []
        for i, name, aliases, mentions, _ in rows:
            def score(n, q=canon(q)):
                a, b = set(q.split()), set(n.split())
                return 1.0 if n == q else 0.85 if n in q or q in n else len(a & b) / len(a | b)
            best = max(score(canon(n)) for n in [name, *aliases])
            if best > 0:
                scores.append((-round(best, 4), -mentions, i))
        for place, (s, _, i) in enumerate(sorted(scores)[:4], 1):
            assert got.pop((k, place)) == (i, -s)
    assert not got


def test_filters(spark):
    c = spark.createDataFrame([("c1", "Bob", "Bobby", "ACTIVE", "SAME", 1), ("c2", "Al", "Bob", "RESOLVED", "SAME", 2), ("c3", "Al", "Al", "ACTIVE", "DIFFERENT", 3)], "conflict_id string, candidate_name string, entity_name string, status string, decision string, updated_at int")
    ids = lambda df: [r.conflict_id for r in df.collect()]
    assert ids(lookup.conflict_query(c)) == ["c3", "c2", "c1"] and ids(lookup.conflict_query(c, "bob", "active")) == ["c1"] and ids(lookup.conflict_query(c, decisions=("DIFFERENT",))) == ["c3"]
    e = spark.createDataFrame([("a", "Ann"), ("b", "Ben")], "entity_id string, name string")
    r = spark.createDataFrame([("a", "b", "BUILDS", 0.9), ("b", "zz", "LEARNS", 0.7)], "source string, target string, relation string, confidence double")
    assert [x.target for x in lookup.search_relations(r, e, "ben").collect()] == ["b", "zz"]
    assert {(x.entity_id, x.dir) for x in lookup.incident_relations(r, e.where("entity_id = 'b'")).collect()} == {("b", "in"), ("b", "out")}


def test_context(spark):
    got = spark.createDataFrame([(1, "x", 2), (1, "y", 1), (2, "z", 1)], "query_id int, memory string, rank int")
    recent = spark.createDataFrame([("y", 1), ("new", 2)], "memory string, place int")
    assert {r.query_id: r.context for r in lookup.context_pack(got, recent, 3).collect()} == {1: "- y\n- x\n- new", 2: "- z\n- y\n- new"}


def test_archived_sources(spark):
    i = spark.createDataFrame([("m1", "g"), ("m2", "g"), ("m3", "h")], "memory_id string, grp string").withColumn("superseded_by", F.lit(None).cast("string"))
    left, gone = aggregate.archive_sources(i, spark.createDataFrame([("g", "new")], "grp string, new_id string"), "grp", F.to_timestamp(F.lit("2024-01-01")))
    assert [r.memory_id for r in left.collect()] == ["m3"] and {(r.memory_id, r.superseded_by, r.status) for r in gone.collect()} == {("m1", "new", "archived"), ("m2", "new", "archived")}


def test_journal(spark):
    j = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(3, 9)], "sequence int, event_type string")
    seq = lambda **k: [r.sequence for r in ledger.journal_query(j, **k).collect()]
    assert seq(low=4, high=6) == [4, 5, 6] and seq(types=("b",), reverse=True, limit=2) == [7, 5] and seq(low=100) == []
    for bad in ({"low": 5, "high": 4}, {"limit": 0}):
        with pytest.raises(ValueError, match="INVALID_QUERY"):
            ledger.journal_query(j, **bad)
    c = ledger.coverage(j, 2).first()
    assert (c["first"], c["last"], c.n, c.compacted) == (3, 8, 6, True)
    ops = spark.createDataFrame([("o1", "k", "RECONCILIATION_REPAIR", "COMPLETED", 1, 1, '{"status":"REPAIRED"}'), ("o2", "k", "OTHER", "COMPLETED", 1, 2, None)], "operation_id string, operation_key string, operation_type string, status string, created_at int, updated_at int, result_data string")
    assert [(r.operation_id, r.status) for r in ledger.repair_history(ops).collect()] == [("o1", "REPAIRED")]


def test_files(spark, tmp_path):
    (tmp_path / "log.json").write_text(json.dumps({"log": [{"i": k, "at": f"2024-01-0{k}"} for k in range(1, 6)]}))
    assert sorted(r.i for r in stores.read_log(spark, f"{tmp_path}/log.json", "log", "struct<i:int,at:string>", "at", 2).collect()) == [4, 5]
    (tmp_path / "g1.json").write_text('{"nodes":[{"id":"a"},3],"edges":{"no":1}}')
    nodes, edges = stores.read_graph(spark, f"{tmp_path}/g1.json")
    assert [json.loads(r.json) for r in nodes.collect()] == [{"id": "a"}] and edges.count() == 0
    for v in (1, 2):
        stores.write_store(spark.createDataFrame([(v,)], "v int"), f"{tmp_path}/store", v)
    (tmp_path / "store" / "v=000000000003").mkdir()
    assert [r.v for r in stores.newest_snapshot(spark, f"{tmp_path}/store").collect()] == [2]
