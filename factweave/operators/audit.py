"""Integrity audit: violations as rows (code, key, n), one small plan per group.

Row rules of a store are evaluated in one scan; repeated ids, dangling references and overlaps are
partial aggregates and semi or anti joins. A row that an earlier rule of its group skips (blank id,
missing endpoint) isn't tested by later ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.operators.joins import large


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")) == "", F.lit(True))


def row_rules(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(code, key, 1) for each rule that a row breaks."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in rules.items()]))
    return df.select(F.explode(broken).alias("code"), F.col(key).cast("string").alias("key"), F.lit(1).cast("long").alias("n"))


def repeated(df: DataFrame, key: str, code: str) -> DataFrame:
    return df.where(~blank(F.col(key))).groupBy(F.col(key).cast("string").alias("key")).agg((F.count("*") - 1).alias("n")).where("n > 0").select(F.lit(code).alias("code"), "key", "n")


def dangling(refs: DataFrame, ref: str, key: str, known: DataFrame, known_key: str, code: str) -> DataFrame:
    """Rows whose non-blank reference is unknown."""
    bad = refs.where(~blank(F.col(ref))).join(known.select(F.col(known_key).alias(ref)).distinct(), ref, "left_anti")
    return bad.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit(code).alias("code"), "key", "n")


def present(refs: DataFrame, ref: str, key: str, known: DataFrame, known_key: str, code: str) -> DataFrame:
    """Rows whose reference is in a store where it must not be."""
    return refs.join(known.select(F.col(known_key).alias(ref)).distinct(), ref, "left_semi").select(F.lit(code).alias("code"), F.col(key).cast("string").alias("key"), F.lit(1).cast("long").alias("n"))


def union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def audit_operations(ops: DataFrame) -> DataFrame:
    has_id = ops.where(~blank(F.col("operation_id")))
    return union(
        row_rules(ops, "operation_id", {"OPERATION_MISSING_ID": blank(F.col("operation_id"))}),
        row_rules(has_id, "operation_id", {
            "OPERATION_MISSING_KEY": blank(F.col("operation_key")), "OPERATION_INVALID_STATUS": ~F.coalesce(F.col("status").isin("COMPLETED", "FAILED", "STARTED"), F.lit(False)),
            "OPERATION_INVALID_ATTEMPT_COUNT": F.coalesce(F.col("attempt_count") < 1, F.lit(True)),
            "OPERATION_INVALID_RECOVERY_COUNT": F.coalesce((F.col("recovery_count") < 0) | (F.col("recovery_count") > 3), F.lit(True)),
            "COMPLETED_OPERATION_HAS_LEASE": (F.col("status") == "COMPLETED") & F.col("lease_expires_at").isNotNull()}),
        repeated(ops, "operation_id", "OPERATION_DUPLICATE_ID"), repeated(has_id, "operation_key", "OPERATION_DUPLICATE_KEY"))


def audit_items(active: DataFrame, archive: DataFrame) -> DataFrame:
    every = active.select("memory_id").unionByName(archive.select("memory_id"))
    both = active.select("memory_id", "supersedes", "superseded_by").unionByName(archive.select("memory_id", "supersedes", "superseded_by"))
    return union(
        row_rules(active, "memory_id", {"MEMORY_MISSING_ID": blank(F.col("memory_id")), "ACTIVE_MEMORY_MARKED_ARCHIVED": ~blank(F.col("memory_id")) & (F.col("status") == "archived")}),
        row_rules(archive, "memory_id", {"MEMORY_ARCHIVE_MISSING_ID": blank(F.col("memory_id")), "MEMORY_ARCHIVE_STATUS_INVALID": ~blank(F.col("memory_id")) & F.coalesce(F.col("status") != "archived", F.lit(True))}),
        repeated(active, "memory_id", "MEMORY_DUPLICATE_ID_ACTIVE"), repeated(archive, "memory_id", "MEMORY_DUPLICATE_ID_ARCHIVE"),
        present(active.select("memory_id").distinct(), "memory_id", "memory_id", archive, "memory_id", "MEMORY_ACTIVE_ARCHIVE_OVERLAP"),
        dangling(both, "supersedes", "memory_id", every, "memory_id", "MEMORY_SUPERSEDES_REFERENCE_MISSING"),
        dangling(both, "superseded_by", "memory_id", every, "memory_id", "MEMORY_SUPERSEDED_BY_REFERENCE_MISSING"))


def audit_causal(links: DataFrame, items: DataFrame) -> DataFrame:
    return dangling(links, "target", "source", items, "memory_id", "MEMORY_CAUSAL_REFERENCE_MISSING")


def audit_entities(active: DataFrame, archive: DataFrame) -> DataFrame:
    """Groups entities and lifecycle. history: array of snapshot versions as ``history_versions``."""
    state, life = F.col("archive_state"), F.col("lifecycle_status")
    bad_life = (state == "ARCHIVED") & ~F.coalesce(life.isin("DORMANT", "ENDED"), F.lit(False))
    named = lambda c: ~blank(F.col("entity_id")) & c
    return union(
        row_rules(active, "entity_id", {
            "ENTITY_MISSING_ID": blank(F.col("entity_id")), "ACTIVE_ENTITY_MARKED_ARCHIVED": named(state == "ARCHIVED"),
            "ENTITY_HISTORY_INVALID_VERSION": named(F.exists("history_versions", lambda v: v.isNull())),
            "ENTITY_HISTORY_CURRENT_VERSION_COLLISION": named(F.array_max("history_versions") >= F.col("version"))}),
        row_rules(active.unionByName(archive), "entity_id", {
            "ENTITY_ENDED_LIFECYCLE_MISMATCH": named((F.col("temporal_status") == "ended") & F.coalesce(life != "ENDED", F.lit(True))),
            "ENTITY_ARCHIVE_LIFECYCLE_MISMATCH": named(bad_life), "ARCHIVE_INVALID_LIFECYCLE": named(bad_life)}),
        row_rules(archive, "entity_id", {"ARCHIVE_MISSING_ID": blank(F.col("entity_id")), "ARCHIVE_ENTITY_NOT_ARCHIVED": named(F.coalesce(state != "ARCHIVED", F.lit(True)))}),
        repeated(active, "entity_id", "ENTITY_DUPLICATE_ID_ACTIVE"), repeated(archive, "entity_id", "ENTITY_DUPLICATE_ID_ARCHIVE"),
        present(active.select("entity_id").distinct(), "entity_id", "entity_id", archive, "entity_id", "ENTITY_ACTIVE_ARCHIVE_OVERLAP"),
        present(active.where(F.coalesce(state == "ACTIVE", F.lit(True))), "entity_id", "entity_id", archive, "entity_id", "ARCHIVE_ENTITY_ACTIVE_STATE_MISMATCH"))


def audit_conflicts(conflicts: DataFrame, entities: DataFrame) -> DataFrame:
    good = conflicts.where(~blank(F.col("conflict_id")))
    return union(
        row_rules(conflicts, "conflict_id", {"CONFLICT_MISSING_ID": blank(F.col("conflict_id"))}),
        row_rules(good, "conflict_id", {
            "CONFLICT_MERGE_BLOCK_VIOLATED": F.col("decision").isin("POSSIBLE_CONFLICT", "DIFFERENT") & (F.col("created_entity_id") == F.col("entity_id")),
            "CONFLICT_SAME_ID_MISMATCH": (F.col("decision") == "SAME") & ~blank(F.col("created_entity_id")) & (F.col("created_entity_id") != F.col("entity_id"))}),
        repeated(conflicts, "conflict_id", "CONFLICT_DUPLICATE_ID"), dangling(good, "entity_id", "conflict_id", entities, "entity_id", "CONFLICT_ENTITY_REFERENCE_MISSING"))


def audit_recoveries(recoveries: DataFrame, active: DataFrame, archive: DataFrame) -> DataFrame:
    done = recoveries.where(~blank(F.col("recovery_id")) & (F.col("status") == "RECOVERED"))
    return union(
        row_rules(recoveries, "recovery_id", {"RECOVERY_MISSING_ID": blank(F.col("recovery_id"))}),
        row_rules(done, "recovery_id", {"RECOVERY_DECISION_MISMATCH": F.coalesce(F.col("decision") != "SAME", F.lit(True))}),
        repeated(recoveries, "recovery_id", "RECOVERY_DUPLICATE_ID"),
        present(done, "entity_id", "recovery_id", archive, "entity_id", "RECOVERED_ENTITY_STILL_ARCHIVED"), dangling(done, "entity_id", "recovery_id", active, "entity_id", "RECOVERED_ENTITY_NOT_ACTIVE"))


def audit_relations(relations: DataFrame, entities: DataFrame, items: DataFrame) -> DataFrame:
    good = relations.where(~blank(F.col("relation_id")))
    whole = good.where(~blank(F.col("source")) & ~blank(F.col("target")))
    ends = whole.select("relation_id", F.explode(F.array_distinct(F.array("source", "target"))).alias("ref"))
    used = whole.select("relation_id", F.explode("memory_ids").alias("ref"))
    return union(
        row_rules(relations, "relation_id", {"RELATION_MISSING_ID": blank(F.col("relation_id"))}), repeated(relations, "relation_id", "RELATION_DUPLICATE_ID"),
        row_rules(good, "relation_id", {"RELATION_MISSING_ENDPOINT": blank(F.col("source")) | blank(F.col("target"))}), row_rules(whole, "relation_id", {"RELATION_SELF_REFERENCE": F.col("source") == F.col("target")}),
        dangling(ends, "ref", "relation_id", entities, "entity_id", "RELATION_ENTITY_REFERENCE_MISSING"), dangling(used, "ref", "relation_id", items, "memory_id", "RELATION_MEMORY_REFERENCE_MISSING"))


def audit_links(entities: DataFrame, items: DataFrame) -> DataFrame:
    """Elements of memory_ids that are blank, repeated or unknown."""
    links = entities.select("entity_id", F.explode("memory_ids").alias("ref"))
    counted = links.where(~blank(F.col("ref"))).groupBy("entity_id", "ref").agg(F.count("*").alias("n"))
    twice = counted.where("n > 1").groupBy(F.col("entity_id").cast("string").alias("key")).agg(F.sum(F.col("n") - 1).alias("n"))
    return union(
        row_rules(links, "entity_id", {"ENTITY_EMPTY_MEMORY_LINK": blank(F.col("ref"))}).groupBy("code", "key").agg(F.sum("n").alias("n")),
        twice.select(F.lit("ENTITY_DUPLICATE_MEMORY_LINK").alias("code"), "key", "n"), dangling(counted, "ref", "entity_id", items, "memory_id", "ENTITY_MEMORY_REFERENCE_MISSING"))


def _known_ids(nodes: DataFrame, items: DataFrame, entities: DataFrame) -> DataFrame:
    """A row for each id that isn't blank: its nodes, its nodes of either kind, and whether a fact and an entity have it."""
    n = lambda on: F.coalesce(on, F.lit(False)).cast("long")
    no = F.lit(0).cast("long")
    rows = lambda df, key, nodes, memory, entity, items, ents: df.select(
        F.col(key).cast("string").alias("ref"), nodes.alias("nodes"), memory.alias("memory_nodes"), entity.alias("entity_nodes"), items.alias("items"), ents.alias("ents"))
    every = union(rows(nodes, "id", no + 1, n(F.col("kind") == "memory"), n(F.col("kind") == "entity"), no, no), rows(items, "memory_id", no, no, no, no + 1, no), rows(entities, "entity_id", no, no, no, no, no + 1))
    return every.where(~blank(F.col("ref"))).groupBy("ref").agg(*[F.sum(c).alias(c) for c in ("nodes", "memory_nodes", "entity_nodes", "items", "ents")])


def audit_graph(nodes: DataFrame, edges: DataFrame, items: DataFrame, entities: DataFrame) -> DataFrame:
    """Faults of nodes and edges. All rules of an end of an edge are seen when it meets the row of its id, so that an edge is shuffled once for each end, not for each rule."""
    known = _known_ids(nodes, items, entities)
    by_id = known.select(F.col("ref").alias("key"), F.explode(F.array(*[F.struct(F.lit(code).alias("code"), n.alias("n")) for code, n in (
        ("GRAPH_DUPLICATE_NODE_ID", F.col("nodes") - 1), ("GRAPH_MEMORY_NODE_MISSING_SOURCE", F.when(F.col("items") == 0, F.col("memory_nodes"))), ("GRAPH_ENTITY_NODE_MISSING_SOURCE", F.when(F.col("ents") == 0, F.col("entity_nodes"))))])).alias("x"))
    end = lambda ref, other, first: F.struct(F.col(ref).cast("string").alias("ref"), F.col(other).cast("string").alias("other"), F.lit(first).alias("first"))
    kind = F.when(F.col("type") == "MEMORY_HAS_ENTITY", 1).when(F.col("type") == "ENTITY_RELATION", 2).otherwise(0).alias("kind")
    ends = edges.select(kind, F.explode(F.array(end("source", "target", True), end("target", "source", False))).alias("x")).select("kind", "x.*").where(~blank(F.col("ref")))
    met = ends.join(large(known.select("ref", *[(F.col(c) > 0).alias(c) for c in ("nodes", "items", "ents")])), "ref", "left")
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    met = met.withColumn("edge", F.when(F.col("first"), F.concat_ws(">", "ref", "other")).otherwise(F.concat_ws(">", "other", "ref")))
    faults = row_rules(met, "edge", {
        "GRAPH_EDGE_NODE_MISSING": no("nodes"), "GRAPH_MEMORY_ENTITY_MEMORY_MISSING": (F.col("kind") == 1) & F.col("first") & no("items"),
        "GRAPH_MEMORY_ENTITY_ENTITY_MISSING": (F.col("kind") == 1) & ~F.col("first") & no("ents"), "GRAPH_ENTITY_RELATION_ENTITY_MISSING": (F.col("kind") == 2) & no("ents")})
    return union(row_rules(nodes, "id", {"GRAPH_NODE_MISSING_ID": blank(F.col("id"))}), by_id.select("x.code", "key", "x.n").where("n > 0"), faults.groupBy("code", "key").agg(F.sum("n").alias("n")))


#: Codes repaired without a person. Fixed values.
REPAIRABLE = (
    "COMPLETED_OPERATION_HAS_LEASE", "MEMORY_ARCHIVE_STATUS_INVALID", "ARCHIVE_ENTITY_NOT_ARCHIVED", "RELATION_MEMORY_REFERENCE_MISSING", "ENTITY_MEMORY_LINKS_NOT_LIST", "ENTITY_EMPTY_MEMORY_LINK",
    "ENTITY_DUPLICATE_MEMORY_LINK", "ENTITY_MEMORY_REFERENCE_MISSING", "GRAPH_INVALID_STORE", "GRAPH_INVALID_COLLECTIONS", "GRAPH_INVALID_NODE", "GRAPH_NODE_MISSING_ID", "GRAPH_DUPLICATE_NODE_ID",
    "GRAPH_MEMORY_NODE_MISSING_SOURCE", "GRAPH_ENTITY_NODE_MISSING_SOURCE", "GRAPH_INVALID_EDGE", "GRAPH_EDGE_NODE_MISSING", "GRAPH_MEMORY_ENTITY_MEMORY_MISSING", "GRAPH_MEMORY_ENTITY_ENTITY_MISSING", "GRAPH_ENTITY_RELATION_ENTITY_MISSING")
RANKS = {"BLOCKED": 0, "APPROVAL_REQUIRED": 1, "DRY_RUN_ONLY": 2, "AUTO": 3}


def classify(violations: DataFrame) -> DataFrame:
    """(code, n, repairable) per code."""
    return violations.groupBy("code").agg(F.sum("n").alias("n")).withColumn("repairable", F.col("code").isin(*REPAIRABLE))


def evaluate_policy(violations: DataFrame, policy: dict[str, str]) -> DataFrame:
    """(code, n, action) with the strictest action of all as ``effective``; a code without a rule is BLOCKED."""
    rule = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in policy.items() for x in p]), F.col("code")), F.lit("BLOCKED"))
    rated = classify(violations).withColumn("action", rule)
    rank = F.element_at(F.create_map(*[F.lit(x) for p in RANKS.items() for x in p]), F.col("action"))
    worst = rated.agg(F.min_by("action", rank).alias("effective"))
    return rated.join(F.broadcast(worst)).select("code", "n", "action", "effective")  # one row


def repair_links(entities: DataFrame, items: DataFrame) -> DataFrame:
    """memory_ids without blank, repeated and unknown elements in their order, and how many went."""
    links = entities.select("entity_id", F.posexplode_outer("memory_ids").alias("pos", "ref"))
    known = items.select(F.col("memory_id").alias("ref"), F.lit(True).alias("ok")).distinct()
    first = links.join(known, "ref", "left").groupBy("entity_id", "ref").agg(F.min("pos").alias("pos"), F.count("pos").alias("n"), F.max("ok").alias("ok"))
    kept = F.array_compact(F.transform(F.sort_array(F.collect_list(F.when(F.col("ok") & ~blank(F.col("ref")), F.struct("pos", "ref")))), lambda x: x["ref"]))
    return first.groupBy("entity_id").agg(kept.alias("memory_ids"), F.sum("n").alias("before")).select("entity_id", "memory_ids", (F.col("before") - F.size("memory_ids")).cast("long").alias("removed"))


def repair_leases(ops: DataFrame) -> DataFrame:
    return ops.withColumn("lease_expires_at", F.when(F.col("status") == "COMPLETED", F.lit(None)).otherwise(F.col("lease_expires_at")))


def table_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, field, change, old, new) for rows added or removed and for fields that differ; a full outer join on the key."""
    cols = [c for c in before.columns if c != key]
    text = lambda c: F.to_json(F.struct(c.alias("v")))
    b = before.select(key, F.lit(True).alias("_b"), *[text(F.col(c)).alias(f"b_{c}") for c in cols])
    a = after.select(key, F.lit(True).alias("_a"), *[text(F.col(c)).alias(f"a_{c}") for c in cols])
    j = b.join(a, key, "full_outer")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    fields = F.array(*[F.when(both & ~F.col(f"b_{c}").eqNullSafe(F.col(f"a_{c}")), F.struct(F.lit(c).alias("field"), F.lit("value_changed").alias("change"), F.col(f"b_{c}").alias("old"), F.col(f"a_{c}").alias("new"))) for c in cols],
                     F.when(~both, F.struct(F.lit("*").alias("field"), F.when(F.col("_b").isNull(), "added").otherwise("removed").alias("change"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new"))))
    return j.select(key, F.explode(F.array_compact(fields)).alias("x")).select(key, "x.*")
