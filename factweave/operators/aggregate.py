"""Grouped merges: consolidation, upserts, reinforcement, quorums. All combine before they shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import columns as C
from factweave.operators.joins import large
from factweave.sources.shared import kept


def consolidate(items: DataFrame, group: str) -> DataFrame:
    """One row per group: highest importance and confidence, summed use, first creation, source ids in order."""
    return items.groupBy(group).agg(
        F.max("importance").alias("importance"), F.max("confidence").alias("confidence"), F.sum("access_count").alias("access_count"),
        F.min("created_at").alias("created_at"), F.array_sort(F.collect_list("memory_id")).alias("derived_from"), F.count("*").alias("n_sources"))


def archive_sources(items: DataFrame, merged: DataFrame, group: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(items that stay, sources archived) after ``consolidate``; merged: group and new_id. Sources point to the fact that took their place."""
    m = merged.select(group, F.col("new_id").alias("superseded_by"))
    gone = items.drop("superseded_by").join(m, group).withColumns({"status": F.lit("archived"), "archive_reason": F.lit("consolidated"), "archived_at": now})
    return items.join(m.select(group), group, "left_anti"), gone


#: Relations are counted in so many buckets; those of a bucket with more than so many rows are cut in so many parts first. Up to so many unknown endpoints are sent to all tasks.
_BUCKETS, _MANY, _PARTS, _FEW = 65_536, 100_000, 32, 100_000


def _unknown_ends(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """Endpoints of rows that are no entities, each once."""
    ends = rows.select(F.explode(F.array("source", "target")).alias("entity_id")).distinct()
    return kept(ends.join(large(entities.select("entity_id")), "entity_id", "left_anti"), "unknown-ends")


def _first_ids(rows: DataFrame, dealt: list[str], key: list[str], cap: int) -> DataFrame:
    """The first ``cap`` ids of each group (``dealt`` and ``key``) and a missing one, a row each, with the group's highest confidence, latest evidence and freshness.

    Rows are dealt out and sorted once and then read through; no group is gathered.
    """
    by = [*dealt, *key]
    place = Window.partitionBy(*by).orderBy("memory_id")
    whole = place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    most = {c: F.max(c) for c in ("confidence", "said", "touched")}
    ids = rows.repartition(*dealt).groupBy(*by, "memory_id").agg(*[m.alias(c) for c, m in most.items()])
    return ids.withColumns({c: m.over(whole) for c, m in most.items()} | {"_rn": F.row_number().over(place)}).where(F.col("_rn") <= cap + 1)


def upsert_relations(old: DataFrame, batch: DataFrame, entities: DataFrame, least: float = 0.65, cap: int = 100) -> DataFrame:
    """Relations by (source, target, relation): highest confidence, latest non-empty evidence, union of memory ids.

    Batch rows need two different known endpoints and enough confidence; a relation in the batch is active again.
    Rows are dealt out once; only relations of very many rows are first cut in parts to what their first ids and highest values need.
    """
    key = ["source", "target", "relation"]
    cols = ["_h", *key, "memory_id", "confidence", F.when(F.trim("evidence") != "", F.struct("seq", "evidence")).alias("said"), "touched"]
    good = batch.where((F.col("source") != F.col("target")) & (F.col("confidence") >= least)).withColumn("_h", F.xxhash64(*key))
    bucket = F.pmod("_h", F.lit(_BUCKETS)).alias("_bucket")
    crowded = F.broadcast(good.groupBy(bucket).count().where(F.col("count") > _MANY).select("_bucket"))
    unknown = _unknown_ends(good, entities)
    side = F.broadcast if unknown.limit(_FEW + 1).count() <= _FEW else large

    def met(how: str) -> DataFrame:
        rows = good.withColumn("_bucket", bucket).join(crowded, "_bucket", how)
        for end in ("source", "target"):
            rows = rows.join(side(unknown.select(F.col("entity_id").alias(end))), end, "left_anti")
        return rows.withColumn("touched", F.lit(True))

    parts = met("left_semi").select(F.pmod(F.hash("memory_id", "seq"), F.lit(_PARTS)).alias("_part"), *cols)
    stored = old.select(*key, "confidence", "evidence", F.explode_outer("memory_ids").alias("memory_id"), F.lit(-1).cast(batch.schema["seq"].dataType).alias("seq"), F.lit(False).alias("touched"))
    rows = met("left_anti").select(*cols).unionByName(stored.withColumn("_h", F.xxhash64(*key)).select(*cols)).unionByName(_first_ids(parts, ["_h", "_part"], key, cap).drop("_part", "_rn"))
    # by a hash first, since names of one kind begin alike and are slow to sort
    first = _first_ids(rows, ["_h"], key, cap)
    whole = Window.partitionBy("_h", *key).orderBy("memory_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    merged = first.withColumn("memory_ids", F.slice(F.collect_list("memory_id").over(whole), 1, cap)).where("_rn = 1")
    return merged.select(*key, "confidence", F.col("said")["evidence"].alias("evidence"), "touched", "memory_ids", C.relation_id(F.col("source"), F.col("target"), F.col("relation")).alias("relation_id"))


def merge_causal(links: DataFrame, least: float = 0.7) -> DataFrame:
    """Causal links by (source, target, relation): highest confidence, last evidence; no self links."""
    return links.where((F.col("source") != F.col("target")) & (F.col("confidence") >= least)).groupBy("source", "target", "relation").agg(
        F.max("confidence").alias("confidence"), F.max_by("evidence", "seq").alias("evidence"))


def touch(items: DataFrame, hits: DataFrame, now: Column) -> DataFrame:
    """Reinforce: per hit one access and .03 confidence, .99 at most; hit rows become active."""
    n = hits.groupBy("memory_id").agg(F.count("*").alias("_n"))
    hit = F.coalesce("_n", F.lit(0))
    return items.join(n, "memory_id", "left").withColumns({
        "access_count": F.col("access_count") + hit, "confidence": F.round(F.least(F.lit(0.99), F.col("confidence") + 0.03 * hit), 4),
        "last_accessed": F.when(hit > 0, now).otherwise(F.col("last_accessed")), "status": F.when(hit > 0, "active").otherwise(F.col("status"))}).drop("_n")


def mark_seen(entities: DataFrame, sightings: DataFrame) -> DataFrame:
    """last_seen moves up to the newest sighting; first_seen keeps the oldest known."""
    s = sightings.groupBy("entity_id").agg(F.max("ts").alias("_hi"), F.min("ts").alias("_lo"), F.count("*").alias("_n"))
    return entities.join(s, "entity_id", "left").withColumns({
        "last_seen": F.greatest("last_seen", "_hi"), "first_seen": F.coalesce("first_seen", "_lo"), "mention_count": F.col("mention_count") + F.coalesce("_n", F.lit(0))}).drop("_hi", "_lo", "_n")


def archive_stats(archive: DataFrame, state: str) -> DataFrame:
    return archive.rollup(state).agg(F.count("*").alias("n")).withColumnRenamed(state, "state")


def store_counts(stores: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in stores.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("store"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def violation_codes(violations: DataFrame, by: str) -> DataFrame:
    return violations.groupBy(by).agg(F.array_sort(F.collect_set("code")).alias("codes"))


def quorum(approvals: DataFrame, required_roles: tuple[str, ...], needed: int) -> DataFrame:
    """Valid approvals, distinct actors and missing roles per plan, and whether the quorum is met."""
    need = F.array(*[F.lit(r) for r in required_roles])
    return approvals.where("valid").groupBy("plan_id").agg(
        F.count("*").alias("n_valid"), F.countDistinct("actor").alias("n_actors"), F.array_sort(F.array_except(need, F.collect_set("role"))).alias("missing_roles"),
    ).withColumn("met", (F.col("n_actors") >= needed) & (F.size("missing_roles") == 0))


def combine_requirements(requirements: DataFrame) -> DataFrame:
    """Strictest of the codes' requirements per plan: largest count, any flag, all delegations, common roles, union of required ones."""
    return requirements.groupBy("plan_id").agg(
        F.max("min_approvals").alias("min_approvals"), F.bool_or("distinct_actors").alias("distinct_actors"), F.bool_and("allow_delegation").alias("allow_delegation"),
        F.collect_set("allowed_roles").alias("_a"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("required_roles")))).alias("required_roles"),
    ).withColumn("allowed_roles", F.array_sort(F.aggregate(F.slice("_a", F.lit(2), F.size("_a")), F.get("_a", F.lit(0)), lambda acc, x: F.array_intersect(acc, x)))).drop("_a")
