"""Commits of several stores: crashes between two writes, repeated and late operations, damaged snapshots."""

import glob
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from factweave.streaming import commits

STORE = "memory string, valid_from timestamp, valid_to timestamp, status string"
OPS = "operation_key string, ts timestamp, ord int, action string, memory_text string, old_memory string, consolidation_memory string, targets array<string>, effective_from timestamp, effective_to timestamp"
DAY = datetime(2024, 1, 1)


def op(key, hour, ord_, action, new=None, old=None):
    return (key, DAY + timedelta(hours=hour), ord_, action, new, old, None, [], None, None)


class Killed(Exception):
    pass


def test_commit_crash(spark, tmp_path, monkeypatch, dies_after=2):
    """Three micro-batches; the second dies after some of its writes and runs again: the stores are those of a run without a crash."""
    source, folder = f"{tmp_path}/in", f"{tmp_path}/out"
    parts = [[op("k1", 1, 1, "ADD", "tea"), op("k2", 1, 2, "ADD", "milk"), op("k1", 1, 3, "ADD", "tea again")],
             [op("k2", 2, 1, "ADD", "not again"), op("k3", 3, 2, "UPDATE", "green tea", "tea")], [op("k4", 40, 1, "DELETE", None, "milk"), op("k0", 1, 2, "ADD", "just in time"), op("k3", 3, 3, "ADD", "again")]]
    empty, count = spark.createDataFrame([], STORE), {"n": 0}

    def run():
        stream = spark.readStream.schema(OPS).option("maxFilesPerTrigger", 1).parquet(source)
        q = commits.apply_to_stores(stream, folder, {"active": empty, "archive": empty}, commits.action_rule(F.to_timestamp(F.lit("2024-02-01"))), delay_seconds=24 * 3600).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return q.exception()

    kept = commits.Commits.commit

    def dying(self, number, stores):
        """Writes only some of the snapshots and dies before the manifest."""
        if number != 1 or count["n"]:
            return kept(self, number, stores)
        count["n"] += 1
        for name in list(stores)[:dies_after]:
            stores[name].write.mode("overwrite").parquet(f"{self.folder}/{name}/v={number:012d}")
        raise Killed

    for n, part in enumerate(parts):
        spark.createDataFrame(part, OPS).coalesce(1).write.mode("append").parquet(source)
        if n == 1:
            monkeypatch.setattr(commits.Commits, "commit", dying)
            with pytest.raises(Exception, match="Killed"):
                raise RuntimeError(str(run()))
            assert commits.Commits(spark, folder).numbers() == [0]
            monkeypatch.setattr(commits.Commits, "commit", kept)
        assert run() is None
    c = commits.Commits(spark, folder)
    assert c.numbers() == [2, 1, 0]
    assert sorted(r.memory for r in c.read("active").collect()) == ["green tea", "just in time"] and sorted(r.memory for r in c.read("archive").collect()) == ["milk", "tea"]
    assert sorted(r.memory for r in c.read("active", 0).collect()) == ["milk", "tea"]
    assert sorted(r.operation_key for r in c.read(commits.LEDGER).collect()) == ["k4"]  # older keys are behind the horizon, and so refused if they come again
    assert sorted(r.operation_key for r in c.read(commits.LEDGER, 1).collect()) == ["k1", "k2", "k3"]


def test_late_and_repeated(spark):
    ledger = spark.createDataFrame([("a", DAY + timedelta(hours=30)), ("b", DAY + timedelta(hours=20))], "operation_key string, ts timestamp")
    batch = spark.createDataFrame([("a", DAY + timedelta(hours=30), 1), ("c", DAY, 2), ("d", None, 3), ("e", DAY + timedelta(hours=60), 4), ("e", DAY + timedelta(hours=61), 5)], "operation_key string, ts timestamp, n int")
    fresh, refused, after = commits.split_late(batch, ledger, "operation_key", "ts", 24 * 3600)
    assert [(r.operation_key, r.n) for r in fresh.collect()] == [("e", 4)]
    assert {r.operation_key: r.reason for r in refused.collect()} == {"a": "REPEATED", "c": "LATE", "d": "LATE"}
    assert [r.operation_key for r in after.collect()] == ["e"]
    assert commits.split_late(batch.limit(0), ledger.limit(0), "operation_key", "ts", 5)[2].count() == 0


def test_damaged_snapshot(spark, tmp_path):
    c = commits.Commits(spark, f"{tmp_path}/s")
    assert c.newest_readable("t") == (None, [])
    for n in range(3):
        c.commit(n, {"t": spark.range(10 + n)} | ({"u": spark.range(1)} if n == 0 else {}))
    for path in glob.glob(f"{tmp_path}/s/t/v={2:012d}/*.parquet"):
        with open(path, "r+b") as f:
            f.truncate(20)
    df, broken = c.newest_readable("t")
    assert df.count() == 11 and broken == [2] and c.versions()["u"] == (0, 1)
