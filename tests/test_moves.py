"""Moves between stores with guards, causality both ways, names in any case."""

from datetime import datetime

from pyspark.sql import functions as F

from factweave.functions import columns as C
from factweave.operators import moves

ENT = "entity_id string, name string, aliases array<string>, last_seen timestamp, mention_count long, confidence double, ended boolean"


def now():
    return F.lit(datetime(2024, 6, 1))


def test_archive_and_restore(spark):
    old, new = datetime(2023, 1, 1), datetime(2024, 5, 30)
    e = spark.createDataFrame([("1", "Bob", ["Rob"], old, 1, 0.5, False), ("2", "Al", None, new, 1, 0.5, False), ("3", "Cy", ["Two"], old, 1, 0.5, False), ("4", "Di", ["Two"], new, 1, 0.5, True)], ENT)
    active, archive, out = moves.archive_entities(e, e.limit(0), now())
    assert sorted(r.entity_id for r in archive.collect()) == ["1", "3", "4"] and active.first().name == "Al" and {r.outcome for r in out.collect()} == {"ARCHIVED"}
    assert {r.entity_id: r.pre_archive_lifecycle for r in archive.collect()} == {"1": "DORMANT", "3": "DORMANT", "4": "ENDED"}
    asked = spark.createDataFrame([(1, "ROB"), (2, "Bob"), (3, "2"), (4, "two"), (5, None)], "query_id int, q string")
    for force, want in ((False, "NOT_ARCHIVABLE"), (True, "ARCHIVED")):
        active2, archive2, out = moves.archive_entities(e, e.limit(0), now(), asked, force)
        assert {r.query_id: r.outcome for r in out.collect()} == {1: "ARCHIVED", 2: "ARCHIVED", 3: want, 4: "NOT_FOUND", 5: "NOT_FOUND"}
        assert archive2.count() == 1 + force and active2.count() == 3 - force
    twice = archive.unionByName(archive.where("entity_id = '1'"))
    back, left, said = moves.restore_entities(active, twice, spark.createDataFrame([("1",), ("1",), ("2",), ("9",)], "entity_id string"), now())
    assert {r.entity_id: r.outcome for r in said.collect()} == {"1": "RESTORED", "2": "ALREADY_ACTIVE", "9": "NOT_FOUND"}
    assert sorted(r.entity_id for r in back.collect()) == ["1", "2"] and sorted(r.entity_id for r in left.collect()) == ["1", "3", "4"]
    assert {r.entity_id: r.lifecycle for r in moves.by_lifecycle(e, now(), "dormant").collect()} == {"1": "DORMANT", "3": "DORMANT"}
    seen = moves.mark_seen(e.withColumn("first_seen", F.lit(None).cast("timestamp")), spark.createDataFrame([("1", new)], "entity_id string, ts timestamp"), now())
    assert {r.entity_id: r.lifecycle for r in seen.collect()}["1"] == "ACTIVE"


def test_causality(spark):
    links = "array<struct<target_memory_id:string,relation:string,confidence:double,timestamp:timestamp>>"
    rows = spark.createDataFrame([("a", "A", [("b", "causes", 0.9, datetime(2024, 1, 2)), ("zz", "causes", 0.8, datetime(2024, 1, 1))]), ("b", "B", None), ("c", "C", [("b", "enables", 0.7, datetime(2024, 1, 1))])], f"memory_id string, memory string, causal_links {links}")
    ids = spark.createDataFrame([("a",), ("b",), ("b",)], "memory_id string")
    got = sorted((r.memory_id, r.place, r.dir, r.relation, r.text) for r in moves.causality(rows, ids).collect())
    assert got == [("a", 1, "out", "CAUSES", "[missing]"), ("a", 2, "out", "CAUSES", "B"), ("b", 1, "in", "ENABLES", "C"), ("b", 2, "in", "CAUSES", "A")]
    assert moves.causality(rows, ids, "in").count() == 2


def test_recall_bounds(spark):
    v = spark.createDataFrame([(k, [1.0, float(k)], 3, 1, 0.8, datetime(2024, 5, 1)) for k in range(20)], "key int, vector array<double>, importance int, access_count int, confidence double, last_accessed timestamp")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [])], "query_id int, vector array<double>")
    rows = moves.recall(q, v, now(), 99, -3.0).collect()
    assert len(rows) == 10 and {r.query_id for r in rows} == {1} and moves.recall(q, v, now(), 0).count() == 1


def test_case_folding(spark):
    pairs = [("ΣΑΣ ﬁ", "σας FI"), ("Groß", "GROSS"), ("ſo", "SO"), ("µ", "Μ"), ("ŉ", "ʼN")]
    rows = spark.createDataFrame(pairs, "a string, b string").select(C.canonical_name(F.col("a")).alias("a"), C.canonical_name(F.col("b")).alias("b")).collect()
    assert all(r.a == r.b == x.casefold() for r, (x, _) in zip(rows, pairs, strict=True))
    assert spark.range(1).select(C.canonical_name(F.lit("ıI"))).first()[0] == "ıi"
