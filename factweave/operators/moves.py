"""Moves between the active store and the archive that look up what they move, guard it, and say what became of each request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.operators import lookup, temporal, vector

#: Lifecycles of entities that may be archived. Fixed values.
ARCHIVABLE = ("DORMANT", "ENDED")


def by_lifecycle(entities: DataFrame, now: Column, *states: str) -> DataFrame:
    """Entities with lifecycle and score, those of the named states if any are named."""
    out = temporal.with_entity_lifecycle(entities, now)
    return out.where(F.col("lifecycle").isin(*[s.strip().upper() for s in states])) if states else out


def archive_entities(active: DataFrame, archive: DataFrame, now: Column, wanted: DataFrame | None = None, force: bool = False, reason: str = "lifecycle") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(active, archive, outcomes): the entities asked for, or all that may be archived, move; they replace rows of their id in the archive.

    wanted: query_id, q (an id, or a name or alias that only one entity bears). Outcomes (query_id, entity_id, outcome): ARCHIVED, NOT_ARCHIVABLE (its lifecycle
    isn't over; not with ``force``), NOT_FOUND. Without ``wanted`` the query is the entity itself. Two requests for one entity move it once.
    """
    aged = temporal.with_entity_lifecycle(active, now)
    state = aged.select("entity_id", "lifecycle").dropDuplicates(["entity_id"])
    if wanted is None:
        asked = state.where(F.col("lifecycle").isin(*ARCHIVABLE)).select(F.col("entity_id").alias("query_id"), "entity_id", "lifecycle")
        missed = None
    else:
        found = lookup.find_archived_entity(wanted, active)
        asked = found.join(state, "entity_id").select("query_id", "entity_id", "lifecycle")
        missed = wanted.select("query_id").join(found, "query_id", "left_anti").select("query_id", F.lit(None).cast(active.schema["entity_id"].dataType).alias("entity_id"), F.lit("NOT_FOUND").alias("outcome"))
    judged = asked.withColumn("outcome", F.when(F.col("lifecycle").isin(*ARCHIVABLE) | F.lit(force), "ARCHIVED").otherwise("NOT_ARCHIVABLE")).drop("lifecycle")
    ids = judged.where("outcome = 'ARCHIVED'").select("entity_id").distinct()
    gone = aged.join(ids, "entity_id", "left_semi").withColumns({
        "pre_archive_lifecycle": F.col("lifecycle"), "archive_state": F.lit("ARCHIVED"), "archived_at": now, "archive_reason": F.substring(F.lit(reason), 1, 300)}).drop("lifecycle", "lifecycle_score")
    kept = archive.join(ids, "entity_id", "left_anti").unionByName(gone, allowMissingColumns=True)
    return active.join(ids, "entity_id", "left_anti"), kept, judged if missed is None else judged.unionByName(missed)


def restore_entities(active: DataFrame, archive: DataFrame, wanted: DataFrame, now: Column, reason: str = "recovery") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(active, archive, outcomes of entity_id): RESTORED, ALREADY_ACTIVE or NOT_FOUND. Of several archived rows of one id one comes back and the others stay."""
    ids = wanted.select("entity_id").distinct()
    judged = ids.join(archive.select("entity_id", F.lit(True).alias("_in")).distinct(), "entity_id", "left").join(active.select("entity_id", F.lit(True).alias("_on")).distinct(), "entity_id", "left")
    judged = judged.select("entity_id", F.when(F.col("_on"), "ALREADY_ACTIVE").when(F.col("_in"), "RESTORED").otherwise("NOT_FOUND").alias("outcome"))
    moved = judged.where("outcome = 'RESTORED'").select("entity_id")
    order = [F.col(c).desc_nulls_last() for c in ("archived_at", "version") if c in archive.columns]
    ranked = archive.withColumn("_rn", F.row_number().over(Window.partitionBy("entity_id").orderBy(*order, F.xxhash64(*archive.columns))))
    back = ranked.where("_rn = 1").drop("_rn").join(moved, "entity_id", "left_semi").withColumns({
        "archive_state": F.lit("ACTIVE"), "recovered_at": now, "recovery_reason": F.substring(F.lit(reason), 1, 300), "last_seen": now, "archived_at": F.lit(None).cast("timestamp"), "archive_reason": F.lit("")})
    left = ranked.join(moved.withColumn("_moved", F.lit(True)), "entity_id", "left").where("_moved is null or _rn > 1").drop("_rn", "_moved")
    return active.unionByName(back, allowMissingColumns=True), left, judged


def recover_items(queries: DataFrame, active: DataFrame, archive: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(active, archive, found): the best archived fact of every query that the active ones answer badly comes back. Facts: key, vector and the columns of ``vector.recover``."""
    found = vector.recover(queries, active, archive, now).select("query_id", "key", "score")
    ids = found.select("key").distinct().join(active.select("key"), "key", "left_anti")
    back = archive.join(ids, "key", "left_semi").withColumns({"status": F.lit("active"), "last_accessed": now})
    return active.unionByName(back, allowMissingColumns=True), archive.join(ids, "key", "left_anti"), found


def recall(queries: DataFrame, corpus: DataFrame, now: Column, k: int = 10, threshold: float = 0.2) -> DataFrame:
    """(query_id, key, score, sim, rank) of the best facts; k is held between 1 and 10, the threshold between 0 and 1, queries without a vector find nothing."""
    k, threshold = max(1, min(10, k)), max(0.0, min(1.0, threshold))
    asked = queries.where("vector is not null and size(vector) > 0").select("query_id", "vector")
    return vector.search(asked, corpus, now, threshold, k).select("query_id", "key", "score", "sim", "rank")


def causality(items: DataFrame, ids: DataFrame, direction: str = "both") -> DataFrame:
    """(memory_id, dir, relation, other, text, confidence, at, place) of the causal links that leave (out) or reach (in) the facts of ``ids``, oldest first.

    items: memory_id, memory and causal_links (target_memory_id, relation, confidence, timestamp). The text of an unknown fact is ``[missing]``.
    """
    links = items.select(F.col("memory_id").alias("source"), F.col("memory").alias("source_text"), F.explode("causal_links").alias("x"))
    links = links.select("source", "source_text", F.col("x.target_memory_id").alias("target"), F.upper("x.relation").alias("relation"), F.col("x.confidence").alias("confidence"), F.col("x.timestamp").alias("at"))
    asked, texts = ids.select("memory_id").distinct(), items.select(F.col("memory_id").alias("target"), F.col("memory").alias("target_text")).dropDuplicates(["target"])
    out = links.join(asked.withColumnRenamed("memory_id", "source"), "source", "left_semi").join(texts, "target", "left").select(F.col("source").alias("memory_id"), F.lit("out").alias("dir"), "relation", F.col("target").alias("other"), F.coalesce("target_text", F.lit("[missing]")).alias("text"), "confidence", "at")
    into = links.join(asked.withColumnRenamed("memory_id", "target"), "target", "left_semi").select(F.col("target").alias("memory_id"), F.lit("in").alias("dir"), "relation", F.col("source").alias("other"), F.coalesce("source_text", F.lit("[missing]")).alias("text"), "confidence", "at")
    every = {"out": out, "in": into, "both": out.unionByName(into)}[direction]
    return every.withColumn("place", F.row_number().over(Window.partitionBy("memory_id").orderBy("at", "dir", "relation", "other")))


def mark_seen(entities: DataFrame, sightings: DataFrame, now: Column) -> DataFrame:
    """``aggregate.mark_seen`` with lifecycle and score as the new times imply."""
    from factweave.operators import aggregate

    return temporal.with_entity_lifecycle(aggregate.mark_seen(entities, sightings), now)


def log_history(log: DataFrame, text: str, columns: tuple[str, ...], ts: str, n: int) -> DataFrame:
    """The newest n log rows that hold the text in one of the columns, the oldest of them first."""
    return lookup.log_history(log, text, columns, ts, n).orderBy(F.col(ts))
