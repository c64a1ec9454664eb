"""Journal of keyed events as a checkpoint and the records after it: append, compaction, and the state as of a sequence.

A record sets the value of a key. The checkpoint holds the state that the records up to its sequence leave (one row a key) and the hash of the last of them, so that
the tail's chain can be verified without what was compacted. State, checkpoint and tail move in one commit of ``commits.Commits``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.streaming.commits import Commits

META, STATE, TAIL = "checkpoint", "state", "tail"
NOTHING = "genesis"


def record_hash(records: DataFrame) -> DataFrame:
    """``records`` (sequence, key, value, previous_record_hash) with record_hash as their content implies."""
    said = F.to_json(F.struct("sequence", "key", "value", "previous_record_hash"), {"ignoreNullFields": "false"})
    return records.withColumn("record_hash", F.sha2(said, 256))


def compacted(journal: DataFrame, retain: int, before: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(checkpoint, state, tail) that keep the newest ``retain`` records; ``before`` are checkpoint and state that ``journal`` is the tail of.

    checkpoint: one row (sequence, record_hash, n_events). A journal with no more than ``retain`` records keeps its checkpoint, if it has one.
    """
    spark = journal.sparkSession
    head = journal.agg(F.max("sequence").alias("head")).first()["head"]
    meta, state = before or (spark.createDataFrame([], "sequence long, record_hash string, n_events long"), journal.select("key", "value", "sequence").limit(0))
    last = meta.agg(F.max("sequence")).first()[0]
    cut = (last or 0) if head is None else max(head - retain, last or 0)
    if cut == (last or 0):
        return meta, state, journal
    gone = journal.where(F.col("sequence") <= cut)
    every = state.select("key", "value", "sequence").unionByName(gone.select("key", "value", "sequence"))
    new_state = every.groupBy("key").agg(F.max_by("value", "sequence").alias("value"), F.max("sequence").alias("sequence"))
    counted = meta.agg(F.coalesce(F.max("n_events"), F.lit(0)).alias("b")).crossJoin(F.broadcast(gone.agg(F.count("*").alias("n"), F.max_by("record_hash", "sequence").alias("h"))))  # one row each
    new_meta = counted.select(F.lit(cut).cast("long").alias("sequence"), F.col("h").alias("record_hash"), (F.col("b") + F.col("n")).alias("n_events"))
    return new_meta, new_state, journal.where(F.col("sequence") > cut)


def state_at(meta: DataFrame, state: DataFrame, tail: DataFrame, sequence: int) -> tuple[str, DataFrame]:
    """(RECONSTRUCTED and the state (key, value, sequence) as of a sequence), or HISTORY_COMPACTED, HISTORY_NOT_AVAILABLE and no rows."""
    last = meta.agg(F.max("sequence")).first()[0] or 0
    head = tail.agg(F.max("sequence")).first()[0] or last
    if not last <= sequence <= head:
        return ("HISTORY_COMPACTED" if sequence < last else "HISTORY_NOT_AVAILABLE"), state.limit(0)
    every = state.select("key", "value", "sequence").unionByName(tail.where(F.col("sequence") <= sequence).select("key", "value", "sequence"))
    return "RECONSTRUCTED", every.groupBy("key").agg(F.max_by("value", "sequence").alias("value"), F.max("sequence").alias("sequence"))


def verify(meta: DataFrame, tail: DataFrame) -> DataFrame:
    """(sequence, reason) of broken records of a tail: CONTENT_HASH_MISMATCH, CHAIN_BROKEN (to the record before or the checkpoint), SEQUENCE_GAP."""
    base = meta.select("sequence", "record_hash").unionByName(tail.select("sequence", "record_hash"))
    prev = base.select((F.col("sequence") + 1).alias("sequence"), F.col("record_hash").alias("_prev"))
    start = tail.agg(F.min("sequence")).first()[0]
    own = record_hash(tail.drop("record_hash")).select("sequence", F.col("record_hash").alias("_own"))
    j = tail.join(own, "sequence").join(prev, "sequence", "left")
    opens = (F.col("sequence") == start) & F.lit(meta.isEmpty())
    reason = (F.when(F.col("record_hash") != F.col("_own"), "CONTENT_HASH_MISMATCH").when(F.col("_prev").isNull() & ~opens, "SEQUENCE_GAP")
              .when(~opens & ~F.col("previous_record_hash").eqNullSafe(F.col("_prev")), "CHAIN_BROKEN"))
    return j.withColumn("reason", reason).where("reason is not null").select("sequence", "reason")


def compact_stored(commits: Commits, retain: int) -> str:
    """Compaction of the journal that ``commits`` holds (stores checkpoint, state, tail): COMPACTED, or NOOP without a commit if there is nothing to cut."""
    meta, state, tail = (commits.read(n) for n in (META, STATE, TAIL))
    if tail is None:
        return "NOOP"
    before = (meta, state) if meta is not None else None
    new = compacted(tail, retain, before)
    if new[2] is tail:
        return "NOOP"
    commits.commit(commits.numbers()[0] + 1, dict(zip((META, STATE, TAIL), new, strict=True)))
    return "COMPACTED"
