"""Commits of several stores at once, and a stream of operations that makes one for each micro-batch.

A commit writes a snapshot of every store that changed, and then one manifest row that names the version of each: what readers see is the newest
manifest, so stores and ledger always belong together. A run that dies between two writes leaves snapshots that no manifest names; the batch runs
again, writes over them, and a batch of which the manifest is there is not applied again.

The ledger of operation keys is a store like the others. Operations older than ``delay`` behind the newest committed time are refused, so
keys that old are dropped from it: a batch reads and writes the keys of the last ``delay``, not all there ever were.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from factweave.operators import temporal
from factweave.streaming.ledger import once

#: (stores, operations, batch number) -> the stores that changed.
Rule = Callable[[dict[str, DataFrame], DataFrame, int], dict[str, DataFrame]]
LEDGER = "_ledger"


class Commits:
    """Commits under ``folder``, which all executors see: ``<store>/v=<n>`` for snapshots, ``_commits/c=<n>`` for manifests."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _manifest(self, number: int) -> str:
        return f"{self.folder}/_commits/c={number:012d}"

    def done(self, number: int) -> bool:
        """Whether the commit's manifest is whole."""
        return self._exists(f"{self._manifest(number)}/_SUCCESS")

    def numbers(self) -> list[int]:
        """Commits that are whole, the newest first: a listing of one folder."""
        if not self._exists(f"{self.folder}/_commits"):
            return []
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/_commits")
        found = (int(x.getPath().getName()[2:]) for x in at.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(at) if x.getPath().getName().startswith("c="))
        return [n for n in sorted(found, reverse=True) if self.done(n)]

    def versions(self, number: int | None = None) -> dict[str, tuple[int, int]]:
        """Version and number of rows of each store, as of a commit (the newest if not given)."""
        number = next(iter(self.numbers()), None) if number is None else number
        if number is None:
            return {}
        return {r["store"]: (r["version"], r["n_rows"]) for r in self.spark.read.parquet(self._manifest(number)).collect()}  # a row for each store

    def read(self, name: str, number: int | None = None) -> DataFrame | None:
        held = self.versions(number).get(name)
        return None if held is None else self.spark.read.parquet(f"{self.folder}/{name}/v={held[0]:012d}")

    def newest_readable(self, name: str) -> tuple[DataFrame | None, list[int]]:
        """(the store as of the newest commit that still reads as a whole, the versions that don't): footers are read and rows counted, as the manifest has them."""
        broken = []
        for number in self.numbers():
            held = self.versions(number).get(name)
            if held is None or held[0] in broken:
                continue
            rows = self.spark.read.option("ignoreCorruptFiles", False)
            try:
                df = rows.parquet(f"{self.folder}/{name}/v={held[0]:012d}")
                if df.count() == held[1]:
                    return df, broken
            except Exception:  # a damaged file shows itself in many ways; the version is reported
                pass
            broken.append(held[0])
        return None, broken

    def commit(self, number: int, stores: dict[str, DataFrame]) -> None:
        """Snapshots of ``stores`` and then the manifest; stores that aren't given keep their version."""
        held = self.versions()
        for name, df in stores.items():
            path = f"{self.folder}/{name}/v={number:012d}"
            df.write.mode("overwrite").parquet(path)
            held[name] = (number, self.spark.read.parquet(path).count())
        rows = [(name, version, n) for name, (version, n) in sorted(held.items())]
        self.spark.createDataFrame(rows, "store string, version long, n_rows long").coalesce(1).write.mode("overwrite").parquet(self._manifest(number))


def split_late(batch: DataFrame, ledger: DataFrame, key: str, ts: str, delay_seconds: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(operations to apply, once for each key; those refused with a reason; the ledger after the batch).

    The horizon is ``delay_seconds`` before the newest time in the ledger. LATE: older than it, or without a time. REPEATED: a key of the ledger.
    """
    horizon = ledger.agg((F.max(ts) - F.make_dt_interval(secs=F.lit(delay_seconds))).alias("_horizon"))  # one row
    rows = batch.join(F.broadcast(horizon)).join(ledger.select(key, F.lit(True).alias("_known")), key, "left")
    why = F.when(F.col(ts).isNull() | (F.col(ts) < F.col("_horizon")), "LATE").when(F.col("_known"), "REPEATED")
    judged = rows.withColumn("reason", why).drop("_horizon", "_known")
    fresh = once(judged.where("reason is null").drop("reason"), key, ts).drop("n_seen").select(batch.columns)
    after = ledger.select(key, ts).unionByName(fresh.select(key, ts))
    newest = after.agg((F.max(ts) - F.make_dt_interval(secs=F.lit(delay_seconds))).alias("_horizon"))
    return fresh, judged.where("reason is not null"), after.join(F.broadcast(newest)).where(F.col(ts) >= F.col("_horizon")).select(key, ts)


def apply_to_stores(stream: DataFrame, folder: str, initial: dict[str, DataFrame], rule: Rule, key: str = "operation_key", ts: str = "ts", delay_seconds: int = 86_400) -> DataStreamWriter:
    """A stream of operations as commits under ``folder``: each operation key takes effect once, stores and ledger move together.

    ``initial``: the stores before the first commit. ``rule`` gets the stores, the operations of a micro-batch (once for each key) and its number.
    """
    def once_each(batch: DataFrame, number: int) -> None:
        commits = Commits(batch.sparkSession, folder)
        if commits.done(number):
            return
        held = {name: commits.read(name) for name in (*initial, LEDGER)}
        stores = {name: held[name] if held[name] is not None else df for name, df in initial.items()}
        ledger = held[LEDGER] if held[LEDGER] is not None else batch.select(key, ts).limit(0)
        batch = batch.persist()
        fresh, _, after = split_late(batch, ledger, key, ts, delay_seconds)
        try:
            commits.commit(number, rule(stores, fresh, number) | {LEDGER: after})
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(once_each).option("checkpointLocation", f"{folder.rstrip('/')}/_checkpoint")


def action_rule(now: Column) -> Rule:
    """Actions (the columns of ``temporal.judge_actions``) on the stores ``active`` and ``archive``; outcomes are a store of the batch's own."""
    def rule(stores: dict[str, DataFrame], batch: DataFrame, number: int) -> dict[str, DataFrame]:
        active, archive, done = temporal.apply_actions(stores["active"], stores["archive"], batch, now)
        return {"active": active, "archive": archive, "outcomes": done.select("ord", "route", "success", "reason").withColumn("batch", F.lit(number).cast("long"))}

    return rule
