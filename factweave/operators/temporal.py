"""Change of facts over time: insert, archive, restore, and routing of actions. Batches of changes of versions are in ``changes``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import columns as C
from factweave.operators.joins import large
from factweave.operators.windows import first_per_key, move


def with_lifecycle(items: DataFrame, now: Column) -> DataFrame:
    """band, life_score, archive_score and eligible for each fact."""
    days = C.age_days(F.col("last_accessed"), now)
    imp, acc = F.col("importance"), F.col("access_count")
    return items.withColumns({
        "band": C.item_lifecycle(imp, days), "life_score": F.round(C.item_lifecycle_score(imp, days, acc), 4),
        "archive_score": F.round(C.archive_score(imp, days, acc), 4), "eligible": C.archive_eligible(imp, days, acc)})


def archive_old(active: DataFrame, archive: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Move eligible facts to the archive."""
    ids = with_lifecycle(active, now).where("eligible").select("memory_id")
    return move(active, archive, ids, "memory_id", status=F.lit("archived"), archive_reason=F.lit("automatic_lifecycle"), archived_at=now)


def restore(active: DataFrame, archive: DataFrame, ids: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(active, archive) after the ids came back; ids that are active already are refused."""
    wanted = ids.select("memory_id").join(active.select("memory_id"), "memory_id", "left_anti")
    rest, back = move(archive, active, wanted, "memory_id", status=F.lit("active"), last_accessed=now)
    return back, rest


def with_entity_lifecycle(entities: DataFrame, now: Column) -> DataFrame:
    days = C.age_days(F.col("last_seen"), now, missing=float("inf"))
    return entities.withColumns({
        "lifecycle": C.entity_lifecycle(days, F.col("ended")),
        "lifecycle_score": F.round(C.entity_lifecycle_score(days, F.col("mention_count"), F.col("confidence"), F.col("ended")), 4)})


def archivable_entities(entities: DataFrame, now: Column) -> DataFrame:
    return with_entity_lifecycle(entities, now).where(F.col("lifecycle").isin("DORMANT", "ENDED"))


def add_items(active: DataFrame, archive: DataFrame, batch: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """Outcome of each row of ``batch`` (ord, memory): BLANK, DUPLICATE, RESTORE or ADDED.

    A text twice in the batch is added once. ``near`` (ord) names rows with a near duplicate, found by the vector search.
    """
    text = F.trim(F.coalesce("memory", F.lit("")))
    rows = batch.withColumn("memory", text)
    w = Window.partitionBy("memory").orderBy("ord")
    marked = (rows.join(active.select(F.col("memory"), F.lit(True).alias("is_active")).distinct(), "memory", "left")
              .join(archive.select(F.col("memory"), F.lit(True).alias("is_archived")).distinct(), "memory", "left"))
    if near is not None:
        marked = marked.join(near.select("ord", F.lit(True).alias("is_near")).distinct(), "ord", "left")
    else:
        marked = marked.withColumn("is_near", F.lit(None).cast("boolean"))
    return marked.withColumn("outcome", F.when(F.col("memory") == "", "BLANK").when(F.col("is_active") | (F.row_number().over(w) > 1), "DUPLICATE")
                             .when(F.col("is_archived"), "RESTORE").when(F.col("is_near"), "DUPLICATE").otherwise("ADDED")).drop("is_active", "is_archived", "is_near")


def route_actions(actions: DataFrame) -> DataFrame:
    """Route of each action row: a known action, else UPDATE with old and new text, CONSOLIDATE with several sources, else ADD."""
    known = F.upper(F.trim("action"))
    return actions.withColumn("route", F.when(known.isin("ADD", "UPDATE", "END", "DELETE", "CONSOLIDATE", "IGNORE"), known)
                              .when(F.col("old_memory").isNotNull() & F.col("new_memory").isNotNull(), "UPDATE")
                              .when(F.size("sources") > 1, "CONSOLIDATE").when(F.col("new_memory").isNotNull(), "ADD").otherwise("IGNORE"))


def newest_per_text(items: DataFrame) -> DataFrame:
    """Last duplicate text wins."""
    return first_per_key(items, "memory", F.col("created_at").desc(), F.col("memory_id").desc())


#: Parts in which the rows of a batch without a text are dealt out where rows meet by their texts.
PARTS = 64


def _by_text(rows: DataFrame, text: str, found: DataFrame) -> DataFrame:
    """``rows`` left joined by ``text`` with ``found``, which has each text once. Most rows of a batch lack one of their texts: those are dealt out, so that no task gets them all."""
    part = lambda blank: F.when(F.col(text) == "", blank)
    dealt = rows.withColumn("_part", F.coalesce(part(F.pmod(F.xxhash64("ord"), F.lit(PARTS)).cast("int")), F.lit(0)))
    found = found.withColumn("_part", F.explode(F.coalesce(part(F.sequence(F.lit(0), F.lit(PARTS - 1))), F.array(F.lit(0)))))
    return dealt.join(large(found), [text, "_part"], "left").drop("_part")


def judge_actions(active: DataFrame, archive: DataFrame, batch: DataFrame) -> DataFrame:
    """``batch`` plus route, success and reason of each action.

    batch: ord, action, memory_text, old_memory, consolidation_memory, targets (array), effective_from, effective_to. An unknown action is
    ignored; ADD with an old and a new text is an update, with a consolidation text and targets in the store a consolidation.
    The stores (memory, valid_from) are taken as they stand before the batch, but of the actions that would take one active text
    only the first takes it, and of equal new texts the first is added. Actions on texts that the same batch makes belong into the next batch.
    """
    said = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    known = F.upper(F.trim(F.coalesce("action", F.lit("IGNORE"))))
    rows = batch.withColumns({"_new": said("memory_text"), "_old": said("old_memory"), "_con": said("consolidation_memory"), "_act": F.when(known.isin("ADD", "UPDATE", "DELETE", "CONSOLIDATE", "END"), known).otherwise("IGNORE")})
    held = active.groupBy("memory").agg(F.max("valid_from").alias("_from"))
    rows = _by_text(rows, "_old", held.withColumnRenamed("memory", "_old"))
    rows = _by_text(rows, "_new", held.select(F.col("memory").alias("_new"), F.lit(True).alias("_dup")))
    aims = rows.select("ord", F.explode("targets").alias("memory")).where("memory is not null and memory <> ''").distinct()
    found = aims.join(large(held), "memory", "left").groupBy("ord").agg(F.count("*").alias("_aims"), F.count("_from").alias("_found"))
    rows = rows.join(large(found), "ord", "left").fillna(0, ["_aims", "_found"])
    implied = F.col("_act") == "ADD"
    route = (F.when(implied & (F.col("_old") != "") & (F.col("_new") != ""), "UPDATE").when(implied & (F.col("_con") != "") & (F.col("_found") > 0), "CONSOLIDATE").otherwise(F.col("_act")))
    rows = rows.withColumn("route", route)
    has, starts = F.col("_from").isNotNull(), F.coalesce(F.col("effective_from") >= F.col("_from"), F.lit(True))
    fits = (F.when(F.col("route") == "DELETE", has).when(F.col("route") == "END", has & F.coalesce(F.col("effective_to") > F.col("_from"), F.lit(True)))
            .when(F.col("route") == "UPDATE", has & (F.col("_new") != "") & starts).when(F.col("route") == "CONSOLIDATE", (F.col("_con") != "") & (F.col("_found") > 0))
            .when(F.col("route") == "ADD", (F.col("_new") != "") & F.col("_dup").isNull()).otherwise(F.lit(True)))
    rows = rows.withColumn("_fits", F.coalesce(fits, F.lit(False)))
    takes = F.col("_fits") & F.col("route").isin("DELETE", "END", "UPDATE")
    first = lambda on, key, name: rows.where(on).groupBy(key).agg(F.min("ord").alias(name))
    took, added = first(takes, "_old", "_took"), first(F.col("_fits") & (F.col("route") == "ADD"), "_new", "_added")
    rows = _by_text(_by_text(rows, "_old", took), "_new", added)
    rows = rows.withColumn("success", F.col("_fits") & F.when(takes, F.col("ord") == F.col("_took")).when(F.col("route") == "ADD", F.col("ord") == F.col("_added")).otherwise(F.lit(True)))
    ok = F.col("success")
    reason = (F.when(F.col("route") == "IGNORE", "ignored").when(F.col("route").isin("DELETE", "END") & (F.col("_old") == ""), "missing_old_memory")
              .when(F.col("route") == "DELETE", F.when(ok, "archived").otherwise("not_found")).when(F.col("route") == "END", F.when(ok, "temporal_end").otherwise("end_failed"))
              .when((F.col("route") == "UPDATE") & ((F.col("_old") == "") | (F.col("_new") == "")), "missing_memory_data").when(F.col("route") == "UPDATE", F.when(ok, "conflict_replaced").when(implied, "conflict_resolution_failed").otherwise("update_failed"))
              .when((F.col("route") == "CONSOLIDATE") & (F.col("_con") == ""), "missing_consolidated_memory").when((F.col("route") == "CONSOLIDATE") & (F.col("_aims") == 0), "no_target_memories")
              .when(F.col("route") == "CONSOLIDATE", F.when(ok, "consolidated").otherwise("consolidation_failed")).when(F.col("_new") == "", "missing_memory").otherwise(F.when(ok, "added").otherwise("duplicate_or_rejected")))
    return rows.withColumn("reason", reason).select(*batch.columns, "route", "success", "reason")


def apply_actions(active: DataFrame, archive: DataFrame, batch: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(active, archive, outcomes) after a batch of actions; stores: memory, valid_from, valid_to, status. Outcomes are those of ``judge_actions``.

    DELETE archives, END closes the interval and archives, UPDATE opens the new text and archives the old one as historical, CONSOLIDATE opens one
    text for its targets, ADD opens a text or brings an equal archived one back. A text in the archive is replaced by one that is archived again.
    """
    done = judge_actions(active, archive, batch).persist()  # read by several branches; the caller may unpersist the outcomes
    good = done.where("success")
    gone = good.where("route in ('DELETE', 'END', 'UPDATE')").select(
        F.trim("old_memory").alias("memory"), F.when(F.col("route") == "END", F.coalesce("effective_to", now)).when(F.col("route") == "UPDATE", F.coalesce("effective_from", now)).alias("_to"),
        F.when(F.col("route") == "DELETE", "manual_delete_request").when(F.col("route") == "END", "ended").otherwise("superseded").alias("archive_reason"))
    merged = good.where("route = 'CONSOLIDATE'").select(F.explode("targets").alias("memory"), F.lit(None).cast("timestamp").alias("_to"), F.lit("consolidated").alias("archive_reason"))
    gone = gone.unionByName(merged).groupBy("memory").agg(F.max("_to").alias("_to"), F.min("archive_reason").alias("archive_reason"))
    moved = active.drop("archive_reason").join(large(gone), "memory").withColumns({"valid_to": F.coalesce("_to", "valid_to"), "status": F.lit("archived")}).drop("_to")
    text = F.when(F.col("route") == "CONSOLIDATE", F.trim("consolidation_memory")).otherwise(F.trim("memory_text"))
    fresh = good.where("route in ('ADD', 'UPDATE', 'CONSOLIDATE')").groupBy(text.alias("memory")).agg(F.min(F.coalesce("effective_from", now)).alias("valid_from"))
    fresh = fresh.withColumns({"valid_to": F.lit(None).cast("timestamp"), "status": F.lit("active")})
    back = archive.join(large(fresh.select("memory")), "memory", "left_semi").withColumn("status", F.lit("active"))
    back = back if "archive_reason" in active.columns else back.drop("archive_reason")
    opened = fresh.join(large(back.select("memory")), "memory", "left_anti").unionByName(back, allowMissingColumns=True)
    left = active.join(large(gone.select("memory")), "memory", "left_anti").join(large(opened.select("memory")), "memory", "left_anti")
    kept = archive.join(large(opened.select("memory")), "memory", "left_anti").join(large(moved.select("memory")), "memory", "left_anti")
    return left.unionByName(opened, allowMissingColumns=True), kept.unionByName(moved, allowMissingColumns=True), done
