"""Actions with their outcomes, and operations of a stream applied once."""

import datetime as dt

from pyspark.sql import functions as F

from factweave.operators import temporal
from factweave.streaming import ledger

STORE = "memory string, valid_from timestamp, valid_to timestamp, status string"
BATCH = "ord int, action string, memory_text string, old_memory string, consolidation_memory string, targets array<string>, effective_from timestamp, effective_to timestamp"


def test_apply_actions(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    active = spark.createDataFrame([(m, day(5), None, "active") for m in "abcdef"], STORE)
    archive = spark.createDataFrame([("z", day(1), day(2), "archived")], STORE)
    rows = [(1, "delete", None, "a", None, [], None, None), (2, "UPDATE", "a2", "a", None, [], day(9), None), (3, "ADD", "b2", "b", None, [], day(9), None), (4, "ADD", "c2", "c", None, [], day(1), None),
            (5, "END", None, "d", None, [], None, day(8)), (6, "END", None, "e", None, [], None, day(5)), (7, None, "x", None, None, None, None, None), (8, "ADD", " z ", None, None, None, None, None), (9, "ADD", "z", None, None, None, None, None),
            (10, "ADD", "", None, "ef", ["e", "f", None], None, None), (11, "CONSOLIDATE", None, None, "q", ["nope"], None, None), (12, "CONSOLIDATE", None, None, "q", [], None, None), (13, "ADD", "b", None, None, None, None, None), (14, "UPDATE", None, "f", None, None, None, None)]
    left, old, done = temporal.apply_actions(active, archive, spark.createDataFrame(rows, BATCH), F.to_timestamp(F.lit("2024-02-01")))
    got = {r.ord: (r.route, r.success, r.reason) for r in done.collect()}
    assert got == {
        1: ("DELETE", True, "archived"), 2: ("UPDATE", False, "update_failed"), 3: ("UPDATE", True, "conflict_replaced"), 4: ("UPDATE", False, "conflict_resolution_failed"), 5: ("END", True, "temporal_end"), 6: ("END", False, "end_failed"),
        7: ("IGNORE", True, "ignored"), 8: ("ADD", True, "added"), 9: ("ADD", False, "duplicate_or_rejected"), 10: ("CONSOLIDATE", True, "consolidated"), 11: ("CONSOLIDATE", False, "consolidation_failed"), 12: ("CONSOLIDATE", False, "no_target_memories"),
        13: ("ADD", False, "duplicate_or_rejected"), 14: ("UPDATE", False, "missing_memory_data")}
    assert sorted(r.memory for r in left.collect()) == ["b2", "c", "ef", "z"] and sorted(r.memory for r in old.collect()) == ["a", "b", "d", "e", "f"]
    done.unpersist()
    assert temporal.judge_actions(active.limit(0), archive, spark.createDataFrame([], BATCH)).count() == 0


def test_apply_stream(spark, tmp_path):
    source, seen = f"{tmp_path}/in", []
    for part in (["a", "b", "a"], ["b", "c"]):
        spark.createDataFrame([(k, 1) for k in part], "operation_key string, n int").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("operation_key string, n int").parquet(source)
        run = ledger.apply_stream(stream, lambda batch, number: seen.append(sorted(r.operation_key for r in batch.collect())), f"{tmp_path}/state").trigger(availableNow=True).start()
        run.awaitTermination(60)
        assert run.exception() is None
    assert seen == [["a", "b"], ["c"]]


def test_rows_without_a_text_are_dealt_out(spark, request):
    """Rows that lack a text do not meet in one task, whatever the store holds under a blank text; no side is sent out."""
    active = spark.createDataFrame([("", "2020-01-01"), ("a", "2020-01-01")], "memory string, t string").select("memory", F.to_timestamp("t").alias("valid_from"))
    kind = "ord long, action string, memory_text string, old_memory string, consolidation_memory string, targets array<string>, effective_from timestamp, effective_to timestamp"
    batch = spark.createDataFrame([(k, "ADD", f"n{k}", "", None, [], None, None) for k in range(400)] + [(400, "DELETE", "", "a", None, [], None, None), (401, "ADD", "a", None, None, [], None, None)], kind)
    done = temporal.judge_actions(active, active.limit(0), batch)
    got = {r.ord: (r.route, r.success, r.reason) for r in done.collect()}
    assert len(got) == 402 and all(got[k] == ("ADD", True, "added") for k in range(400)) and got[400] == ("DELETE", True, "archived") and got[401] == ("ADD", False, "duplicate_or_rejected")
    assert "Broadcast" not in done._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small parts would be put together again
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    parts = temporal._by_text(batch.withColumnRenamed("old_memory", "_old"), "_old", active.select(F.col("memory").alias("_old"), F.lit(1).alias("one")))
    most = max(r["count"] for r in parts.where("_old = ''").groupBy(F.spark_partition_id()).count().collect())
    assert parts.where("one = 1").count() == 401 and most < 400
