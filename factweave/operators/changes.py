"""Batches with several changes of one key, applied in their order as if each were a call of its own.

A batch has a column ``ord``; without one its rows are ordered by their time and id. What decides whether a change is taken depends on the changes
taken before it. Here that is always a running value (the latest start, the last name, the first end), so each fold is a window or a grouped
minimum, and one key with many changes is sorted (and spilled) by Spark, never collected. Ids that occur twice do not multiply rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factweave.functions import columns as C
from factweave.operators.joins import large

HISTORY, ALIASES = 20, 20


def _ordered(batch: DataFrame, *fallback: str) -> DataFrame:
    return batch if "ord" in batch.columns else batch.withColumn("ord", F.struct(*fallback))


def _optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def _before(w) -> object:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def supersede(items: DataFrame, batch: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(items with old versions closed and new ones opened, outcome per row of ``batch``).

    batch: chain_id, new_id, memory, effective_from (missing: ``now``) and, if wanted, ord and old_memory. A change is SUPERSEDED unless its text is
    missing (BLANK) or that of old_memory (SAME_TEXT), its id is missing (NO_ID), that of a version of its chain (KNOWN_ID) or of an earlier row of the batch
    (REPEATED), its chain has no current version (NO_CURRENT), or it starts before the version that is current when its turn comes (TOO_EARLY).
    A later change of a chain closes the earlier one. Of several current versions of a chain the highest is closed.
    """
    asked = _ordered(batch, "effective_from", "new_id").withColumns({"_eff": F.coalesce("effective_from", now if now is not None else F.current_timestamp()), "_text": F.trim(F.coalesce(F.col("memory").cast("string"), F.lit("")))})
    current = items.where("valid_to is null").groupBy("chain_id").agg(F.max(F.struct("version", "memory_id", "valid_from")).alias("c"))
    current = current.select("chain_id", F.col("c.memory_id").alias("old_id"), F.col("c.version").alias("old_version"), F.col("c.valid_from").alias("old_from"))
    known = items.select("chain_id", F.col("memory_id").alias("new_id")).distinct().withColumn("_known", F.lit(True))
    firsts = asked.where("new_id is not null").groupBy("new_id").agg(F.min("ord").alias("_first"))
    asked = asked.join(large(current), "chain_id", "left").join(large(known), ["chain_id", "new_id"], "left").join(large(firsts), "new_id", "left")
    refused = (F.when(F.col("_text") == "", "BLANK").when(F.col("_text") == F.trim(_optional(batch, "old_memory")), "SAME_TEXT").when(F.col("new_id").isNull(), "NO_ID")
               .when(F.col("_known"), "KNOWN_ID").when(F.col("ord") > F.col("_first"), "REPEATED").when(F.col("old_id").isNull(), "NO_CURRENT"))
    w = Window.partitionBy("chain_id").orderBy("ord", "new_id", "_eff", "_text")
    # equal rows share their ord: only the first of them is a change
    twin = F.row_number().over(Window.partitionBy("new_id").orderBy("ord", "chain_id", "_eff", "_text"))
    judged = asked.withColumn("_refused", refused).withColumn("_refused", F.coalesce("_refused", F.when(twin > 1, "REPEATED")))
    # the start of the version that is current: every start taken is the latest so far, and one that isn't taken is earlier
    start = F.greatest(F.col("old_from"), F.max(F.when(F.col("_refused").isNull(), F.col("_eff"))).over(_before(w)))
    judged = judged.withColumn("outcome", F.coalesce("_refused", F.when(F.col("_eff") < start, "TOO_EARLY"), F.lit("SUPERSEDED")))
    good = judged.where("outcome = 'SUPERSEDED'").withColumns({"_n": F.row_number().over(w), "_next": F.lead("new_id").over(w), "_until": F.lead("_eff").over(w), "_prev": F.coalesce(F.lag("new_id").over(w), "old_id")})
    ended = good.where("_n = 1").select("chain_id", F.col("old_id").alias("memory_id"), F.col("_eff").alias("_to"), F.col("new_id").alias("_by"))
    has_status = "temporal_status" in items.columns
    changes = {"valid_to": F.coalesce("_to", "valid_to"), "superseded_by": F.coalesce("_by", "superseded_by")}
    closed = items.join(large(ended), ["chain_id", "memory_id"], "left").withColumns(changes | ({"temporal_status": F.when(F.col("_to").isNotNull(), "historical").otherwise(F.col("temporal_status"))} if has_status else {})).drop("_to", "_by")
    opened = good.select(F.col("new_id").alias("memory_id"), "chain_id", (F.col("old_version") + F.col("_n")).alias("version"), F.col("_eff").alias("valid_from"), F.col("_until").alias("valid_to"),
                         F.col("_prev").alias("supersedes"), F.col("_next").alias("superseded_by"), F.col("_text").alias("memory"),
                         *([F.when(F.col("_next").isNull(), "current").otherwise("historical").alias("temporal_status")] if has_status else []))
    return closed.unionByName(opened, allowMissingColumns=True), judged.select(*(["ord"] if "ord" in batch.columns else []), "chain_id", "new_id", "outcome")


def judge_ends(items: DataFrame, batch: DataFrame, now: Column | None = None) -> DataFrame:
    """``batch`` (memory_id, ended_at) with outcome: ENDED for the first end of an item that is after its start, then ALREADY_ENDED; NOT_AFTER_START, NOT_FOUND."""
    asked = _ordered(batch, "ended_at").withColumn("ended_at", F.coalesce("ended_at", now if now is not None else F.current_timestamp()))
    starts = items.groupBy("memory_id").agg(F.min("valid_from").alias("_from"), F.lit(True).alias("_found"))
    asked = asked.join(large(starts), "memory_id", "left").withColumn("_fits", F.col("_found") & (F.col("_from").isNull() | (F.col("ended_at") > F.col("_from"))))
    # over the rows as the join has sorted them; a second join would sort the batch once more in the same task
    first = F.min(F.when(F.col("_fits"), F.struct("ord", "ended_at"))).over(Window.partitionBy("memory_id"))
    judged = asked.withColumn("_first", first).withColumn("outcome", F.when(F.col("_found").isNull(), "NOT_FOUND").when(~F.col("_fits"), "NOT_AFTER_START")
                                                               .when(F.struct("ord", "ended_at") == F.col("_first"), "ENDED").otherwise("ALREADY_ENDED"))
    return judged.drop("_from", "_found", "_fits", "_first", *([] if "ord" in batch.columns else ["ord"]))


def _ends(items: DataFrame, batch: DataFrame, now: Column | None) -> tuple[DataFrame, DataFrame]:
    judged = judge_ends(items, batch, now)
    ends = judged.where("outcome = 'ENDED'").groupBy("memory_id").agg(F.min("ended_at").alias("_to"))  # equal rows of a batch are one
    return items.join(large(ends), "memory_id", "left").withColumns({
        "valid_to": F.coalesce("_to", "valid_to"), "temporal_status": F.when(F.col("_to").isNotNull(), "ended").otherwise(F.col("temporal_status"))}), judged


def end_items(items: DataFrame, batch: DataFrame, now: Column | None = None) -> DataFrame:
    """Items with the intervals of ``batch`` (memory_id, ended_at) closed, each by its first end that is after its start."""
    return _ends(items, batch, now)[0].drop("_to")


def end_and_archive(active: DataFrame, archive: DataFrame, batch: DataFrame, now: Column, reason: str = "temporal_end") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(active, archive, outcomes): ended items leave the active store; in the archive they replace rows of their id."""
    marked, judged = _ends(active, batch, now)
    gone = marked.where("_to is not null").withColumns({"status": F.lit("archived"), "archive_reason": F.lit(reason), "archived_at": now}).drop("_to")
    kept = archive.join(large(gone.select("memory_id")), "memory_id", "left_anti").unionByName(gone, allowMissingColumns=True)
    return marked.where("_to is null").drop("_to"), kept, judged


def _snapshot(schema: StructType, values: dict[str, Column]) -> Column:
    """A struct of the given schema; fields without a value are null."""
    return F.struct(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def evolve_entities(entities: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities after the batch, outcome per row: APPLIED, UNKNOWN_EVENT, NOT_FOUND).

    batch: entity_id, action (CHANGE, also if missing, or END), new_name, new_type, effective and, if wanted, ord, new_description, aliases_add and the
    columns of a history entry. Every change pushes the state before it to the history (the newest 20 stay) and raises the version. CHANGE
    takes the new name if its canonical form differs from the one before (which becomes an alias), a type other than OTHER and a description, and opens
    the interval; END closes it at its time. Aliases are those before the batch, then old names and aliases_add in order of their first mention,
    cleaned once under the last name. Snapshots hold no aliases.
    """
    asked = _ordered(batch, "effective", "action", "new_name", "new_type").withColumn("_event", F.upper(F.trim(F.coalesce(F.when(F.trim("action") != "", F.col("action")), F.lit("CHANGE")))))
    base = entities.select("entity_id", *[F.col(c).alias(f"_{c}") for c in ("name", "type", "version", "valid_from")], _optional(entities, "description").alias("_description"))
    asked = asked.join(large(base.dropDuplicates(["entity_id"])), "entity_id", "left").withColumn("outcome", F.when(~F.col("_event").isin("CHANGE", "END"), "UNKNOWN_EVENT").when(F.col("_version").isNull(), "NOT_FOUND").otherwise("APPLIED"))
    w = Window.partitionBy("entity_id").orderBy("ord", "effective", "_event", "new_name")
    said = lambda c: F.when((F.col("_event") == "CHANGE") & (F.trim(c) != ""), c)
    rows = asked.where("outcome = 'APPLIED'").withColumns({"_asked": F.when(said(F.col("new_name")).isNotNull(), C.canonical_name(F.col("new_name"))), "_n": F.row_number().over(w), "_last": F.count("*").over(Window.partitionBy("entity_id"))})
    renames = F.col("_asked") != F.coalesce(F.last("_asked", True).over(_before(w)), C.canonical_name(F.col("_name")))
    rows = rows.withColumn("_new", F.when(renames, C.norm_name(F.col("new_name"))))
    kind = C.norm_enum(said(F.col("new_type")), C.ENTITY_TYPES, "OTHER")
    rows = rows.withColumns({"_kind": F.when(kind != "OTHER", kind), "_said": said(_optional(asked, "new_description"))})
    earlier = lambda c, first: F.coalesce(F.last(c, True).over(_before(w)), F.col(first))
    rows = rows.withColumns({
        "_name_before": earlier("_new", "_name"), "_type_before": earlier("_kind", "_type"), "_desc_before": earlier("_said", "_description"), "_from_before": F.when(F.col("_n") == 1, F.col("_valid_from")).otherwise(F.lag("effective").over(w))})
    entry = entities.schema["history"].dataType.elementType
    held = {"version": F.col("_version") + F.col("_n") - 1, "name": F.col("_name_before"), "canonical_name": C.canonical_name(F.col("_name_before")), "type": F.col("_type_before"), "description": F.col("_desc_before"),
            "valid_from": F.col("_from_before"), "valid_to": F.col("effective"), "temporal_status": F.lit("historical")}
    told = {"event": F.col("_event"), "recorded_at": F.col("effective")} | {c: F.col(c) for c in ("recorded_at", "reason", "source_text", "memory_id") if c in batch.columns}
    pushed = F.struct(*[(_snapshot(f.dataType, held) if f.name == "snapshot" else told.get(f.name, F.lit(None)).cast(f.dataType)).alias(f.name) for f in entry])
    newest = rows.where(F.col("_n") > F.col("_last") - HISTORY).groupBy("entity_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", pushed.alias("e")))), lambda x: x["e"]).alias("_pushed"))
    # names in order of their first mention; more than the first of these can't be among the aliases
    more = F.coalesce(_optional(asked, "aliases_add", "array<string>"), F.array().cast("array<string>"))
    names = rows.select("entity_id", "_n", F.posexplode(F.concat(F.when(F.col("_new").isNotNull(), F.array("_name_before")).otherwise(F.array().cast("array<string>")), F.when(F.col("_event") == "CHANGE", more).otherwise(F.array().cast("array<string>")))).alias("_p", "_alias"))
    names = names.groupBy("entity_id", C.canonical_name(F.col("_alias")).alias("_c")).agg(F.min(F.struct("_n", "_p", "_alias")).alias("m"))
    names = names.withColumn("_rn", F.row_number().over(Window.partitionBy("entity_id").orderBy("m"))).where(F.col("_rn") <= 2 * ALIASES + 1)
    names = names.groupBy("entity_id").agg(F.transform(F.sort_array(F.collect_list("m")), lambda x: x["_alias"]).alias("_named"))
    final = rows.where("_n = _last").select(
        "entity_id", F.coalesce("_new", "_name_before").alias("_to_name"), F.coalesce("_kind", "_type_before").alias("_to_type"), F.coalesce("_said", "_desc_before").alias("_to_description"), F.col("effective").alias("_to_from"), F.col("_event").alias("_to_event"), F.col("_last").alias("_more"))
    changed, ended = F.col("_more").isNotNull(), F.col("_to_event") == "END"
    out = entities.join(large(final), "entity_id", "left").join(large(newest), "entity_id", "left").join(large(names), "entity_id", "left")
    new = {"history": F.when(changed, C.keep_newest(F.concat("history", "_pushed"), HISTORY)).otherwise(F.col("history")), "aliases": F.when(F.col("_named").isNotNull(), C.clean_aliases(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), "_named"), F.col("_to_name"))).otherwise(F.col("aliases")),
           "name": F.coalesce("_to_name", "name"), "type": F.coalesce("_to_type", "type"), "version": (F.col("version") + F.coalesce("_more", F.lit(0))).cast(entities.schema["version"].dataType),
           "valid_from": F.when(changed, F.col("_to_from")).otherwise(F.col("valid_from")), "valid_to": F.when(ended, F.col("_to_from")).when(changed, F.lit(None)).otherwise(F.col("valid_to"))}
    if "description" in entities.columns:
        new["description"] = F.coalesce("_to_description", "description")
    if "temporal_status" in entities.columns:
        new["temporal_status"] = F.when(ended, "ended").when(changed, "current").otherwise(F.col("temporal_status"))
    return out.select(*[(new[c] if c in new else F.col(c)).alias(c) for c in entities.columns]), asked.select(*batch.columns, "outcome")
