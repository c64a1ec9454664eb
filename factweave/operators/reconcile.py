"""Reconciliation: audit, classify, policy, dry run or approval, repair, audit again, status.

Stores are DataFrames by name; those that are absent aren't audited: operations, items, item_archive, entities, entity_archive,
relations, conflicts, recoveries, and nodes with edges. A dry run is the repaired plan, which writes to no store, since DataFrames don't change. Violations and a graph built
anew are made once, in folders under ``spark.checkpoint.dir``. What reaches the driver are the codes found, of which there are 76 at most.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.operators import audit as A
from factweave.operators import graph
from factweave.sources import shared

Stores = dict[str, DataFrame]


class Outcome(NamedTuple):
    status: str
    stores: Stores
    before: DataFrame
    after: DataFrame


def _both(stores: Stores, a: str, b: str, *cols: str) -> DataFrame | None:
    have = [stores[n].select(*cols) for n in (a, b) if n in stores]
    return A.union(*have) if have else None


def _audits(stores: Stores) -> list[tuple[tuple[str, ...], DataFrame]]:
    """The groups of the audit that the stores given allow, each with the stores that it reads."""
    items, ents = _both(stores, "items", "item_archive", "memory_id"), _both(stores, "entities", "entity_archive", "entity_id")
    facts, named = ("items", "item_archive"), ("entities", "entity_archive")
    out = []
    if "operations" in stores:
        out.append((("operations",), A.audit_operations(stores["operations"])))
    if set(facts) <= set(stores):
        out.append((facts, A.audit_items(stores["items"], stores["item_archive"])))
    if set(named) <= set(stores):
        out.append((named, A.audit_entities(stores["entities"], stores["entity_archive"])))
    if items is not None and ents is not None:
        out.append((facts + named, A.audit_links(_both(stores, "entities", "entity_archive", "entity_id", "memory_ids"), items)))
        if "relations" in stores:
            out.append((("relations", *facts, *named), A.audit_relations(stores["relations"], ents, items)))
    if "conflicts" in stores and ents is not None:
        out.append((("conflicts", *named), A.audit_conflicts(stores["conflicts"], ents)))
    if "recoveries" in stores and set(named) <= set(stores):
        out.append((("recoveries", *named), A.audit_recoveries(stores["recoveries"], stores["entities"], stores["entity_archive"])))
    if items is not None and (links := _causal(stores)) is not None:
        out.append((facts, A.audit_causal(links, items)))
    if {"nodes", "edges"} <= set(stores) and items is not None and ents is not None:
        out.append((("nodes", "edges", *facts, *named), A.audit_graph(stores["nodes"], stores["edges"], items, ents)))
    return out


def audit(stores: Stores) -> DataFrame:
    """(code, key, n) over all stores given."""
    return A.union(*[found for _, found in _audits(stores)])


def _causal(stores: Stores) -> DataFrame | None:
    """(source, target) of the causal links of the fact stores that have any."""
    have = [stores[n] for n in ("items", "item_archive") if n in stores and "causal_links" in stores[n].columns]
    return A.union(*[s.select(F.col("memory_id").alias("source"), F.explode("causal_links").alias("x")).select("source", F.col("x.target_memory_id").alias("target")) for s in have]) if have else None


def _whole(stores: Stores, a: str, b: str) -> DataFrame:
    """Both stores of a kind with all their columns."""
    have = [stores[n] for n in (a, b) if n in stores]
    return have[0] if len(have) == 1 else have[0].unionByName(have[1], allowMissingColumns=True)


def _clean_links(df: DataFrame, key: str, items: DataFrame) -> DataFrame:
    fixed = A.repair_links(df.select(F.col(key).alias("entity_id"), "memory_ids"), items).select(F.col("entity_id").alias(key), F.col("memory_ids").alias("_ids"))
    return df.join(fixed, key, "left").withColumn("memory_ids", F.coalesce("_ids", "memory_ids")).drop("_ids")


LINK_CODES = ("ENTITY_EMPTY_MEMORY_LINK", "ENTITY_DUPLICATE_MEMORY_LINK", "ENTITY_MEMORY_REFERENCE_MISSING")


def repair(stores: Stores, codes: set[str]) -> Stores:
    """Stores after the repairs that belong to the codes. The graph is derived, so any of its faults, and any mended link, has it built anew; the rest is handed on as it is. Rows of a repeated id are left alone by link repair's key."""
    out = dict(stores)
    if "COMPLETED_OPERATION_HAS_LEASE" in codes:
        out["operations"] = A.repair_leases(out["operations"])
    if "MEMORY_ARCHIVE_STATUS_INVALID" in codes:
        out["item_archive"] = out["item_archive"].withColumn("status", F.lit("archived"))
    if "ARCHIVE_ENTITY_NOT_ARCHIVED" in codes:
        out["entity_archive"] = out["entity_archive"].withColumn("archive_state", F.lit("ARCHIVED"))
    items = _both(out, "items", "item_archive", "memory_id")
    if codes & set(LINK_CODES):
        for name in ("entities", "entity_archive"):
            if name in out:
                out[name] = _clean_links(out[name], "entity_id", items)
    if "RELATION_MEMORY_REFERENCE_MISSING" in codes:
        out["relations"] = _clean_links(out["relations"], "relation_id", items)
    if {"nodes", "edges"} <= set(out) and any(c.startswith("GRAPH_") or c in LINK_CODES for c in codes):
        built = graph.rebuild(_whole(out, "items", "item_archive"), _whole(out, "entities", "entity_archive"), out.get("relations"))
        out["nodes"], out["edges"] = (shared.kept(df, name) for df, name in zip(built, ("nodes", "edges")))
    return out


def reconcile(stores: Stores, policy: dict[str, str] | None = None, dry_run: bool = False, approved: bool = False) -> Outcome:
    """Status, stores and violations before and after.

    HEALTHY: nothing found. BLOCKED (DRY_RUN_BLOCKED): nothing found can be repaired, or the policy blocks a repairable code.
    DRY_RUN: what a repair would give. DRY_RUN_REQUIRED and APPROVAL_REQUIRED: the policy asks for it. Else the repair is made:
    REPAIRED if no violation is left, PARTIALLY_REPAIRED otherwise. Repairable codes without a rule are AUTO.
    """
    first = _audits(stores)
    rows = shared.kept(A.union(*[found.withColumn("part", F.lit(i)) for i, (_, found) in enumerate(first)]), "violations")
    before = rows.drop("part")
    found = {r.code for r in before.select("code").distinct().collect()}
    if not found:
        return Outcome("HEALTHY", stores, before, before)
    codes = found & set(A.REPAIRABLE)
    strictest = min((A.RANKS[(policy or {}).get(c, "AUTO")] for c in codes), default=A.RANKS["BLOCKED"])
    if strictest == A.RANKS["BLOCKED"]:
        return Outcome("DRY_RUN_BLOCKED" if dry_run else "BLOCKED", stores, before, before)
    if not dry_run and strictest == A.RANKS["DRY_RUN_ONLY"]:
        return Outcome("DRY_RUN_REQUIRED", stores, before, before)
    if not dry_run and strictest == A.RANKS["APPROVAL_REQUIRED"] and not approved:
        return Outcome("APPROVAL_REQUIRED", stores, before, before)
    fixed = repair(stores, codes)
    # a group of which no store has changed has the violations that it had
    same = [all(fixed.get(n) is stores.get(n) for n in names) for names, _ in first]
    again = [found for (_, found), old in zip(_audits(fixed), same) if not old]
    after = rows.where(F.col("part").isin([i for i, old in enumerate(same) if old])).drop("part")
    after = shared.kept(A.union(after, *again), "violations") if again else after
    if dry_run:
        return Outcome("DRY_RUN", fixed, before, after)
    return Outcome("REPAIRED" if after.isEmpty() else "PARTIALLY_REPAIRED", fixed, before, after)


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """(code, before, after): violations of each code before and after."""
    n = lambda df, name: df.groupBy("code").agg(F.sum("n").alias(name))
    return n(before, "before").join(n(after, "after"), "code", "full_outer").fillna(0, ["before", "after"])
