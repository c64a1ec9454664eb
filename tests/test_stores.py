"""Readers, look-ups and approvals on a few rows."""

import json

from pyspark.sql import functions as F

from factweave.operators import approvals, lookup
from factweave.sources import stores


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"memory": "x", "importance": "4"}, {"memory": " "}, {"importance": "1"}]))
    assert [r.memory for r in stores.read_items(spark, str(tmp_path / "a.json"), "memory string, importance string").collect()] == ["x"]
    (tmp_path / "w.json").write_text(json.dumps({"schema_version": 4, "entities": [{"entity_id": "1", "name": "a"}, {"entity_id": "1", "name": "b"}, {"entity_id": "", "name": "c"}]}))
    assert [r.name for r in stores.read_wrapped(spark, str(tmp_path / "w.json"), "entities", "struct<entity_id:string,name:string>", "entity_id").collect()] == ["a"]
    (tmp_path / "v.json").write_text('{"t": [1, 2.5],\n "u": []}')
    assert {r.key: r.vector for r in stores.read_vectors(spark, str(tmp_path / "v.json")).collect()} == {"t": [1.0, 2.5], "u": []}
    (tmp_path / "q.json").write_text('{"k": 1}\n{broken\n\n{"k": "no number"}\n')
    good, bad = stores.read_quarantined(spark, str(tmp_path / "q.json"), "k int")
    assert [r.k for r in good.collect()] == [1] and bad.count() == 2


def test_snapshot_and_sync(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",)], "memory string")
    path = stores.write_store(df, str(tmp_path), 3)
    assert spark.read.parquet(path).count() == 2 and path.endswith("v=000000000003")
    missing, orphans = stores.sync_vectors(df, spark.createDataFrame([("b",), ("z",)], "key string"))
    assert [r.memory for r in missing.collect()] == ["a"] and [r.key for r in orphans.collect()] == ["z"]


def test_migrate(spark):
    rows = spark.createDataFrame([(1, " Learn Spark "), (2, "learn spark"), (3, ""), (4, "other thing")], "ord int, text string")
    assert {(r.memory, r.type, r.importance) for r in stores.migrate_legacy(rows).collect()} == {("Learn Spark", "learning", 5), ("other thing", "other", 5)}


def test_find_entity_tiers(spark):
    e = spark.createDataFrame([("1", "Apollo", ["Ap"]), ("2", "The Zeus Project", None), ("3", "ap", None)], "entity_id string, name string, aliases array<string>")
    q = spark.createDataFrame([(1, "2"), (2, "AP"), (3, "the zeus project tool"), (4, "none")], "query_id int, q string")
    assert {r.query_id: (r.entity_id, r.tier) for r in lookup.find_entity(q, e).collect()} == {1: ("2", 0), 2: ("1", 1), 3: ("2", 2)}


def test_refs(spark):
    df = spark.createDataFrame([(1, ["b", "x", "a"]), (2, ["x"])], "k int, refs array<string>")
    got = lookup.prune_refs(df, "k", "refs", spark.createDataFrame([("a",), ("b",)], "ref string"))
    assert {r.k: r.refs for r in got.collect()} == {1: ["b", "a"], 2: []}
    links = spark.createDataFrame([("m", "t"), ("m", "gone")], "source string, target string")
    assert {r.target_text for r in lookup.causality(links, spark.createDataFrame([("t", "text")], "memory_id string, memory string")).collect()} == {"text", "[missing]"}


def test_approval_set(spark):
    rows = [(1, "p", "a", "x", True), (2, "p", "b", "y", True), (3, "q", "a", "x", True), (4, "q", "a", "y", True), (5, "r", "a", "x", True), (5, "r", "b", "y", True), (6, "s", "a", "x", True), (7, "s", "b", "x", True), (8, "t", "a", "x", True), (9, "t", "b", "y", False)]
    df = spark.createDataFrame(rows, "approval_id int, plan_id string, actor string, role string, valid boolean")
    got = {r.plan_id: r.status for r in approvals.approval_set_status(df, ("x", "y"), 2).collect()}
    assert got == {"p": "APPROVED", "q": "ACTORS_NOT_DISTINCT", "r": "DUPLICATE_APPROVAL", "s": "ROLES_MISSING", "t": "QUORUM_NOT_MET"}
    used = spark.createDataFrame([("COMPLETED", ["f1"]), ("STARTED", ["f2"])], "status string, approval_fingerprints array<string>")
    assert [r.fingerprint for r in approvals.consumed(spark.createDataFrame([("f1",), ("f2",)], "fingerprint string"), used).collect()] == ["f1"]
    who = spark.createDataFrame([("a", True, False, "x", "2030-01-01")], "actor string, active boolean, revoked boolean, role string, valid_until string").withColumn("valid_until", F.to_timestamp("valid_until"))
    assert {r.actor: r.identity for r in approvals.identity_status(df.where("plan_id = 's'"), who, F.to_timestamp(F.lit("2024-01-01"))).collect()} == {"a": "OK", "b": "UNKNOWN"}
