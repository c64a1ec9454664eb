"""Normalisation, shapes and the composed reconciliation on a few rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from factweave.operators import normalise, reconcile, shapes

def now():
    return F.to_timestamp(F.lit("2024-06-01"))


def test_items(spark):
    df = spark.createDataFrame([("a", " text ", "9", "x", "2024-05-31", "-3", "0", "odd", "zz"), ("", "t2", None, "2", "bad", None, None, "aging", "ended"), ("c", "  ", None, None, None, None, None, None, None), ("d", None, None, None, None, None, None, None, None)],
                               "memory_id string, memory string, importance string, confidence string, created_at string, access_count string, version string, status string, temporal_status string")
    r = {x.memory: x for x in normalise.normalize_items(df, now()).collect()}
    assert len(r) == 2 and len(r["text"]) == 20 and len(normalise.normalize_items(df, now(), True).columns) == 22
    assert (r["text"].importance, r["text"].confidence, r["text"].access_count, r["text"].version, r["text"].status, r["text"].temporal_status, r["text"].chain_id) == (5, 0.9, 0, 1, "active", "current", "a")
    assert (r["t2"].confidence, r["t2"].status, r["t2"].temporal_status, r["t2"].created_at) == (0.99, "aging", "ended", dt.datetime(2024, 6, 1)) and r["t2"].memory_id.startswith("mem_")


def test_entities_and_relations(spark):
    e = spark.createDataFrame([("e1", "  Bob   Stone ", "human", ["Bob", "bob stone", "BOB"], ["m1", " ", "m1", "m2"], "7"), (None, "Acme", "company", None, None, None), ("e3", " ", None, None, None, None)], "entity_id string, name string, type string, aliases array<string>, memory_ids array<string>, confidence string")
    r = {x.name: x for x in normalise.normalize_entities(e, now()).collect()}
    assert set(r) == {"Bob Stone", "Acme"} and len(r["Acme"]) == 28
    assert (r["Bob Stone"].aliases, r["Bob Stone"].memory_ids, r["Bob Stone"].mention_count, r["Bob Stone"].confidence, r["Bob Stone"].type) == (["Bob"], ["m1", "m2"], 2, 1.0, "OTHER") and r["Acme"].type == "ORGANIZATION"
    known = spark.createDataFrame([("a",), ("b",)], "entity_id string")
    rel = spark.createDataFrame([("a", "b", "works with", None), ("a", "a", "builds", 0.9), ("a", "z", "builds", 0.9), ("a", "b", "likes", 0.9), ("a", "b", "builds", 0.5), (None, "b", "builds", 0.9)], "source_entity_id string, target_entity_id string, relation string, confidence double")
    got = normalise.normalize_relations(rel, known, now()).collect()
    assert [(x.relation, x.directed, x.confidence, x.status) for x in got] == [("WORKS_WITH", False, 0.7, "active")]


def test_records_and_lists(spark):
    c = normalise.normalize_conflicts(spark.createDataFrame([(None, "Bob", "e", "same", "odd", "x")], "conflict_id string, candidate_name string, entity_id string, decision string, status string, score string"), now()).first()
    assert (c.decision, c.status, c.score) == ("SAME", "ACTIVE", 0.0)
    o = normalise.normalize_operations(spark.createDataFrame([("k", "t", "odd", "-1"), (None, "t", None, None)], "operation_key string, operation_type string, status string, attempt_count string"), now()).collect()
    assert [(x.operation_type, x.status, x.attempt_count) for x in o] == [("T", "COMPLETED", 1)]
    t = spark.createDataFrame([(1, " a "), (2, "a"), (3, ""), (4, None), (5, "b" * 600)], "i int, t string")
    assert sorted((x.ord, len(x.text)) for x in normalise.clean_text_list(t, "t", "i").collect()) == [(1, 1), (5, 500)]
    mixed = spark.createDataFrame([("plain", None, None, None), (None, "m", "SKILL", "9"), (None, None, "x", "1")], "text string, memory string, type string, importance string")
    assert [tuple(x) for x in normalise.validate_rewrite(mixed).collect()] == [("plain", "other", 5), ("m", "skill", 5)]
    n = lambda *g: spark.createDataFrame([(x,) for x in g], "g string")
    assert {x.g: x.accepted for x in normalise.accept_rewrite(n("a", "a", "b", "c"), n("a", "b", "b"), "g").collect()} == {"a": True, "b": False, "c": False}


def test_shapes(spark):
    rows = lambda *j: spark.createDataFrame(list(enumerate(j)), "i int, j string")
    led = shapes.audit_ledger_documents(rows('{"operations":[{},1,null,"x"]}', "[]", '{"operations":{}}', "{}", "{bad", None), "i", "j")
    assert {(r.code, r.key, r.n) for r in led.collect()} == {("OPERATION_INVALID_RECORD", "0", 3), ("OPERATION_INVALID_STORE", "1", 1), ("OPERATION_INVALID_COLLECTION", "2", 1), ("OPERATION_INVALID_COLLECTION", "3", 1), ("OPERATION_INVALID_STORE", "4", 1), ("OPERATION_INVALID_STORE", "5", 1)}
    g = shapes.audit_graph_documents(rows('{"nodes":[1],"edges":[{},[]]}', '{"nodes":[]}'), "i", "j")
    assert {(r.code, r.key) for r in g.collect()} == {("GRAPH_INVALID_NODE", "0"), ("GRAPH_INVALID_EDGE", "0"), ("GRAPH_INVALID_COLLECTIONS", "1")}
    e = shapes.audit_entity_records(rows('{"memory_ids":"m","history":[1,{"snapshot":3},{"snapshot":{}},{}]}', '{"history":null,"memory_ids":[]}', "7", "{}"), "i", "j")
    assert {(r.code, r.key, r.n) for r in e.collect()} == {("ENTITY_MEMORY_LINKS_NOT_LIST", "0", 1), ("ENTITY_HISTORY_INVALID_ENTRY", "0", 1), ("ENTITY_HISTORY_INVALID_SNAPSHOT", "0", 2), ("ENTITY_HISTORY_NOT_LIST", "1", 1), ("ENTITY_INVALID_RECORD", "2", 1)}


@pytest.fixture(scope="module")
def stores(spark):
    ents = spark.createDataFrame([("e1", "ACTIVE", "ACTIVE", "current", 1, None, ["m1", "m1", "", "zz"])], "entity_id string, archive_state string, lifecycle_status string, temporal_status string, version int, history_versions array<int>, memory_ids array<string>")
    arch = spark.createDataFrame([("e2", "ACTIVE", "DORMANT", "current", 1, None, None)], ents.schema)
    items = spark.createDataFrame([("m1", "active", None, None)], "memory_id string, status string, supersedes string, superseded_by string")
    rel = spark.createDataFrame([("r1", "e1", "e2", ["m1", "gone"])], "relation_id string, source string, target string, memory_ids array<string>")
    return {"entities": ents, "entity_archive": arch, "items": items, "item_archive": items.limit(0), "relations": rel}


def test_reconcile(spark, stores):
    done = reconcile.reconcile(stores)
    assert done.status == "REPAIRED" and {r.code for r in done.before.collect()} == {"ENTITY_EMPTY_MEMORY_LINK", "ENTITY_DUPLICATE_MEMORY_LINK", "ENTITY_MEMORY_REFERENCE_MISSING", "ARCHIVE_ENTITY_NOT_ARCHIVED", "RELATION_MEMORY_REFERENCE_MISSING"}
    assert done.stores["entities"].first().memory_ids == ["m1"] and done.stores["relations"].first().memory_ids == ["m1"] and done.stores["entity_archive"].first().archive_state == "ARCHIVED"
    assert reconcile.reconcile(done.stores).status == "HEALTHY"


def test_reconcile_policies(spark, stores):
    code = "ARCHIVE_ENTITY_NOT_ARCHIVED"
    assert reconcile.reconcile(stores, dry_run=True).status == "DRY_RUN" and reconcile.reconcile(stores, {code: "BLOCKED"}).status == "BLOCKED"
    assert reconcile.reconcile(stores, {code: "APPROVAL_REQUIRED"}).status == "APPROVAL_REQUIRED" and reconcile.reconcile(stores, {code: "APPROVAL_REQUIRED"}, approved=True).status == "REPAIRED"
    assert reconcile.reconcile(stores, {code: "DRY_RUN_ONLY"}).status == "DRY_RUN_REQUIRED"
    broken = stores | {"items": stores["items"].unionByName(stores["items"])}
    assert reconcile.reconcile(broken).status == "PARTIALLY_REPAIRED"
    assert reconcile.reconcile({"items": broken["items"], "item_archive": broken["item_archive"]}).status == "BLOCKED"


def test_reconcile_graph(spark, stores):
    fixed = reconcile.reconcile(stores).stores
    items = spark.createDataFrame([("m1", "active", None, None, "c", [("m1", "causes", 0.5), ("m9", "causes", 0.5)]), ("m2", "active", "m1", None, "c", None), (" ", "active", None, None, None, None)],
                                  "memory_id string, status string, supersedes string, superseded_by string, chain_id string, causal_links array<struct<target_memory_id:string,relation:string,confidence:double>>")
    nodes = spark.createDataFrame([("m1", "memory"), ("m1", "memory"), ("x", "entity"), (None, "memory")], "id string, kind string")
    edges = spark.createDataFrame([("m1", "x", "MEMORY_HAS_ENTITY", "MENTIONS", 1.0), ("e1", "e7", "ENTITY_RELATION", "USES", 1.0)], "source string, target string, type string, relation string, confidence double")
    done = reconcile.reconcile(fixed | {"items": items, "nodes": nodes, "edges": edges})
    n = {r.code: (r.before, r.after) for r in reconcile.compare(done.before, done.after).collect() if r.code.startswith("GRAPH") or "CAUSAL" in r.code}
    assert n == {"GRAPH_NODE_MISSING_ID": (1, 0), "GRAPH_DUPLICATE_NODE_ID": (1, 0), "GRAPH_ENTITY_NODE_MISSING_SOURCE": (1, 0), "GRAPH_EDGE_NODE_MISSING": (2, 0), "GRAPH_MEMORY_ENTITY_ENTITY_MISSING": (1, 0),
                 "GRAPH_ENTITY_RELATION_ENTITY_MISSING": (1, 0), "MEMORY_CAUSAL_REFERENCE_MISSING": (1, 1)}
    assert sorted(r.id for r in done.stores["nodes"].collect()) == ["e1", "e2", "m1", "m2"]
    assert {(r.source, r.target, r.relation) for r in done.stores["edges"].collect()} == {("m1", "e1", "MENTIONS"), ("e1", "e2", "RELATED_TO"), ("m2", "m1", "SUPERSEDES"), ("m1", "m2", "NEXT_VERSION")}


def test_bare_history(spark):
    names = lambda j, t: [h.snapshot.name for h in normalise.normalize_entities(spark.createDataFrame([("e", "Bob", j)], f"entity_id string, name string, history {t}"), now()).first().history]
    bare = "version:string,name:string,type:string"
    assert names([("1", " Old  Bob ", None), ("2", None, None), ("3", " ", None), None], f"array<struct<{bare}>>") == ["Old Bob", "Bob"]
    assert names([(("1", "In"), "out"), (None, "out")], "array<struct<snapshot:struct<version:string,name:string>,name:string>>") == ["In", "out"]
    assert names(None, f"array<struct<{bare}>>") == [] and names("odd", "string") == []
