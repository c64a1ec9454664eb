"""Operation ledger and journal: batch forms, and Structured Streaming forms of the same rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import columns as C


def once(ops: DataFrame, key: str, order: str) -> DataFrame:
    """First row of each operation key and how often it was seen; a partial aggregate, so a key repeated often is one row a task."""
    cols = [c for c in ops.columns if c != key]
    return ops.groupBy(key).agg(F.min(F.struct(order, *[c for c in cols if c != order])).alias("x"), F.count("*").alias("n_seen")).select(key, "x.*", "n_seen")


def new_operations(ops: DataFrame, ledger: DataFrame, key: str = "operation_key") -> DataFrame:
    return ops.dropDuplicates([key]).join(ledger.select(key), key, "left_anti")


def ops_by_key(ops: DataFrame, keys: DataFrame, key: str = "operation_key") -> DataFrame:
    """Operations of the keys; a key of kind and payload is ``functions.canonical.op_key``."""
    return ops.join(keys.select(key), key, "left_semi")


def dedupe_stream(stream: DataFrame, key: str, ts: str, delay: str = "10 minutes") -> DataFrame:
    """At most one effect per key within the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def apply_stream(stream: DataFrame, apply: Callable[[DataFrame, int], None], folder: str, key: str = "operation_key"):
    """Hand each micro-batch of operations to ``apply`` without those done before; keys and batch ids are kept in a ledger under ``folder``.

    Equal keys inside a batch count once (the first in the order of its columns). The ledger's part of a batch is written after its effects under
    the batch's own name, so a batch that runs again after a loss is handed on again as a whole with the same id, and one that was done isn't.
    """
    def once_each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        root = f"{folder.rstrip('/')}/ledger"
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        fresh = once(batch, key, sorted(c for c in batch.columns if c != key)[0]).drop("n_seen").select(batch.columns)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            past = spark.read.schema(f"{key} {batch.schema[key].dataType.simpleString()}, batch long").parquet(root).where(F.col("batch") != number)
            fresh = fresh.join(past.select(key), key, "left_anti")
        fresh = fresh.persist()
        apply(fresh, number)
        fresh.select(key).write.mode("overwrite").parquet(f"{root}/batch={number}")
        fresh.unpersist()

    return stream.writeStream.foreachBatch(once_each).option("checkpointLocation", f"{folder.rstrip('/')}/checkpoint")


def lease_state(ops: DataFrame, now: Column) -> DataFrame:
    """``state``: STALE for started operations whose lease is over, else the status."""
    return ops.withColumn("state", F.when(C.is_stale(F.col("status"), F.col("lease"), F.col("started"), now), "STALE").otherwise(F.col("status")))


def one_per_interval(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Events let through if at most one per interval and key may pass, without catching up.

    An event an interval or more after the one before it always passes, so a key's times are cut there and each run is folded by
    itself: what is gathered is a run of close times, not a key.
    """
    times = events.where(F.col(ts).isNotNull()).select(key, F.unix_micros(ts).alias("_t")).distinct()
    w = Window.partitionBy(key).orderBy("_t")
    apart = F.coalesce(F.col("_t") - F.lag("_t").over(w) >= seconds * 1_000_000, F.lit(True))
    runs = times.withColumn("_new", apart).withColumn("_run", F.sum(F.col("_new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<bigint>").alias("out"))
    step = lambda acc, t: F.when(acc["last"].isNull() | (t - acc["last"] >= seconds * 1_000_000), F.struct(t.alias("last"), F.array_append(acc["out"], t).alias("out"))).otherwise(acc)
    kept = runs.groupBy(key, "_run").agg(F.aggregate(F.sort_array(F.collect_list("_t")), start, step, lambda acc: acc["out"]).alias("_kept"))
    return kept.select(key, F.explode("_kept").alias("_t")).select(key, F.timestamp_micros("_t").alias(ts))


def verify_chain(journal: DataFrame) -> DataFrame:
    """(sequence, reason) of broken records: own content first, then the link to the record before.

    Records carry consecutive numbers, so the one before is found by an equi join, not by a window over all.
    """
    before = journal.select((F.col("sequence") + 1).alias("sequence"), F.col("record_hash").alias("_prev"))
    bad = journal.join(before, "sequence", "left").withColumn("reason", F.when(F.col("content_hash") != F.col("record_hash"), "CONTENT_HASH_MISMATCH").when(~F.col("previous_record_hash").eqNullSafe(F.col("_prev")), "CHAIN_BROKEN"))
    return bad.where("reason is not null").select("sequence", "reason")


def compact(journal: DataFrame, keep: int) -> DataFrame:
    """Checkpoint (head - keep) and size of the retained tail."""
    head = journal.agg((F.max("sequence") - keep).alias("checkpoint"))
    return journal.join(F.broadcast(head), F.col("sequence") > F.col("checkpoint")).groupBy("checkpoint").agg(F.count("*").alias("tail"))  # one row


def as_of(journal: DataFrame, checkpoint: int, sequence: int) -> DataFrame:
    """The record at a sequence, or why there is none: HISTORY_COMPACTED or HISTORY_NOT_AVAILABLE."""
    found = journal.where(F.col("sequence") == sequence).agg(F.first("record_hash").alias("record_hash"))
    return found.withColumn("status", F.when(F.lit(sequence < checkpoint), "HISTORY_COMPACTED").when(F.col("record_hash").isNull(), "HISTORY_NOT_AVAILABLE").otherwise("OK"))


def consume_once(log: DataFrame, key: str, order: str) -> DataFrame:
    """CONSUMED for the first use of each key, REPLAY_REJECTED for the later ones; of uses with one order the first by its other columns counts."""
    first = log.groupBy(key).agg(F.min(order).alias("_first"))
    place = F.row_number().over(Window.partitionBy(key, order).orderBy(F.to_json(F.struct(*log.columns))))
    rows = log.withColumn("_place", place).join(first, key)
    return rows.withColumn("outcome", F.when((F.col(order) == F.col("_first")) & (F.col("_place") == 1), "CONSUMED").otherwise("REPLAY_REJECTED")).drop("_first", "_place")


def journal_query(journal: DataFrame, low: int | None = None, high: int | None = None, types: tuple[str, ...] = (), reverse: bool = False, limit: int | None = None) -> DataFrame:
    """Records of a range of sequence numbers (both ends in) and of the types, in order; a range that ends before it starts or a limit under 1 is an error."""
    if (low is not None and high is not None and low > high) or (limit is not None and limit < 1):
        raise ValueError("INVALID_QUERY")
    out = journal
    if low is not None:
        out = out.where(F.col("sequence") >= low)
    if high is not None:
        out = out.where(F.col("sequence") <= high)
    if types:
        out = out.where(F.col("event_type").isin(*types))
    out = out.orderBy(F.col("sequence").desc() if reverse else F.col("sequence"))
    return out.limit(limit) if limit else out


def coverage(journal: DataFrame, checkpoint: int) -> DataFrame:
    """(first, last, n, compacted): what a compacted journal still covers."""
    return journal.agg(F.min("sequence").alias("first"), F.max("sequence").alias("last"), F.count("*").alias("n")).withColumn("compacted", F.coalesce(F.col("first") > 1, F.lit(checkpoint > 0)))


def repair_history(ops: DataFrame, n: int = 100) -> DataFrame:
    """Newest n repairs of the ledger with what their stored result says."""
    get = lambda f: F.get_json_object("result_data", f"$.{f}").alias(f)
    rows = ops.where("operation_type = 'RECONCILIATION_REPAIR'").select("operation_id", "operation_key", F.col("status").alias("operation_status"), "created_at", "updated_at", get("status"), get("repaired_codes"), get("plan_fingerprint"))
    return rows.orderBy(F.col("updated_at").desc(), "operation_id").limit(n)
