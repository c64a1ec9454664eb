"""Version chains, retention, packing and moves between stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.sources import shared


def first_per_key(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row per key, the first in the given order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")


def keep_first(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def keep_last(df: DataFrame, n: int, by: str, *newest_first: Column) -> DataFrame:
    """Newest n rows of each log."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(*newest_first))).where(F.col("_rn") <= n).drop("_rn")


def version_chain(items: DataFrame, ids: DataFrame) -> DataFrame:
    """All versions of the chains that the given memory_ids belong to, with their place."""
    chains = items.join(ids.select("memory_id"), "memory_id", "left_semi").select("chain_id").distinct()
    w = Window.partitionBy("chain_id").orderBy("version", "valid_from", "memory_id")
    return items.join(chains, "chain_id", "left_semi").withColumn("place", F.row_number().over(w))


def adjacent_versions(items: DataFrame) -> DataFrame:
    w = Window.partitionBy("chain_id").orderBy("version", "valid_from", "memory_id")
    return items.select("chain_id", F.col("memory_id").alias("prev_id"), F.lead("memory_id").over(w).alias("next_id")).where("next_id is not null")


def chain_repair(items: DataFrame) -> DataFrame:
    """valid_to, superseded_by and temporal_status as the next version of the chain implies."""
    w = Window.partitionBy("chain_id").orderBy("version", "valid_from", "memory_id")
    nxt, at = F.lead("memory_id").over(w), F.lead("valid_from").over(w)
    return items.withColumns({"superseded_by": nxt, "valid_to": F.coalesce(at, F.col("valid_to"))}).withColumn(
        "temporal_status", F.when(F.col("superseded_by").isNotNull(), "historical").when(F.col("valid_to").isNotNull(), "ended").otherwise("current"))


def as_of(versions: DataFrame, instants: DataFrame, key: str, closed: bool = False) -> DataFrame:
    """For each (key, instant) the highest version whose interval holds it, and how many hold it.

    Facts are half-open [from, to); entities are closed, where a boundary matches two versions. Starts, ends and instants of a
    key are put in one order and read once: every version opens at its start and closes at its end, so the work is a sort
    and not versions times instants. Intervals may overlap; open versions are few at any time.
    """
    v = versions.where(f"valid_from is not null and (valid_to is null or valid_to {'>=' if closed else '>'} valid_from)")
    # of equal versions and ids the one that holds longest stands last
    one = F.struct(F.col("version").cast("long").alias("version"), F.col("memory_id").alias("memory_id"), F.col("valid_to").isNull().alias("open"), F.col("valid_to").alias("until"))
    none = F.lit(None).cast(v.select(one.alias("x")).schema["x"].dataType)
    # of equal times: half-open ends come before starts, starts before instants, closed ends last
    mark = lambda at, step: F.struct(F.col(at).cast("timestamp").alias("at"), F.lit(step).alias("step"))
    ends = v.select(key, one.alias("_v"), F.explode(F.array(mark("valid_from", 1), mark("valid_to", 3 if closed else 0))).alias("_m")).where("_m.at is not null")
    marks = ends.unionByName(instants.select(key, none.alias("_v"), mark("instant", 2).alias("_m"))).select(key, F.col("_m.at").alias("_at"), F.col("_m.step").alias("_step"), "_v")
    w = Window.partitionBy(key).orderBy("_at", "_step").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.sum(F.when(F.col("_step") == 1, 1).when(F.col("_step") == 2, 0).otherwise(-1)).over(w)
    told = marks.withColumns({"n_matches": opened, "_top": F.max(F.when(F.col("_step") == 1, F.col("_v"))).over(w)})
    # an instant asked twice stands beside itself: no set of instants is held
    order = Window.partitionBy(key).orderBy("_at", "_step")
    told = told.withColumn("_again", (F.lag("_at").over(order) == F.col("_at")) & (F.lag("_step").over(order) == 2))
    hits = told.where("_step = 2 and n_matches > 0 and not coalesce(_again, false)")
    # the highest version begun so far holds the instant unless it has ended; then the open ones are looked up
    until = (F.col("_at") <= F.col("_top.until")) if closed else (F.col("_at") < F.col("_top.until"))
    seen = hits.select(key, "_at", "n_matches", "_top.version", "_top.memory_id", (F.col("_top.open") | until).alias("holds"))
    seen = shared.kept(seen, "as-of")
    sure = seen.where("holds").select(key, F.col("_at").alias("instant"), "memory_id", "version", "n_matches")
    rest = seen.where("not holds").select(F.col(key), F.col("_at").alias("instant"))
    if rest.isEmpty():
        return sure
    from factweave.operators import intervals

    other = intervals.as_of(v, rest, key, closed).select(sure.columns)
    return sure.unionByName(other)


def timeline(df: DataFrame, array_col: str, *keep: str) -> DataFrame:
    """Rows of a nested log in order, with their place."""
    return df.select(*keep, F.posexplode(array_col).alias("place", "entry")).select(*keep, "place", "entry.*")


def entity_timeline(entities: DataFrame, include_current: bool = True) -> DataFrame:
    """History snapshots and the current version, by (valid_from, version)."""
    old = entities.select("entity_id", F.explode("history").alias("h")).select("entity_id", "h.snapshot.version", "h.snapshot.name", "h.snapshot.valid_from", "h.snapshot.valid_to", F.lit(False).alias("current"))
    now = entities.select("entity_id", "version", "name", "valid_from", "valid_to", F.lit(True).alias("current"))
    every = old.unionByName(now) if include_current else old
    return every.withColumn("place", F.row_number().over(Window.partitionBy("entity_id").orderBy("valid_from", "version")))


def pack_by_budget(df: DataFrame, group: str, budget: int, score: str, cost: str, item: str) -> DataFrame:
    """Greedy choice per group in score order: a row that doesn't fit is passed over and later ones may still fit."""
    rows = F.sort_array(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(item).alias("item"), F.col(cost).cast("long").alias("cost"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{df.schema[item].dataType.simpleString()}>").alias("items"))
    step = lambda acc, x: F.when(acc["used"] + x["cost"] <= budget, F.struct((acc["used"] + x["cost"]).alias("used"), F.array_append(acc["items"], x["item"]).alias("items"))).otherwise(acc)
    return df.groupBy(group).agg(F.aggregate(rows, start, step).alias("p")).select(group, "p.used", F.col("p.items").alias("items"))


def last_turns(turns: DataFrame, n: int = 2) -> DataFrame:
    """System rows plus the newest 2n others of each conversation."""
    w = Window.partitionBy("conv_id", F.col("role") == "system").orderBy(F.col("turn").desc())
    return turns.withColumn("_rn", F.row_number().over(w)).where((F.col("role") == "system") | (F.col("_rn") <= 2 * n)).drop("_rn")


def chunks(df: DataFrame, text: str, limit: int, *keep: str) -> DataFrame:
    """Slices of at most ``limit`` characters, one at least."""
    n = F.greatest(F.ceil(F.length(text) / limit).cast("int"), F.lit(1))
    return df.select(*keep, text, F.explode(F.sequence(F.lit(0), n - 1)).alias("place")).select(*keep, "place", F.substring(F.col(text), F.col("place") * limit + 1, F.lit(limit)).alias("chunk"))


def move(source: DataFrame, target: DataFrame, ids: DataFrame, key: str, **changes: Column) -> tuple[DataFrame, DataFrame]:
    """(source without the ids, target with them): moved rows get the changes and replace rows of their key."""
    moved = source.join(ids.select(key), key, "left_semi").withColumns(changes)
    return source.join(ids.select(key), key, "left_anti"), target.join(moved.select(key), key, "left_anti").unionByName(moved, allowMissingColumns=True)


def merge_by_priority(frames: list[DataFrame], key: str, *order: Column, cap: int | None = None, by: str | None = None) -> DataFrame:
    """Union of frames, earlier ones first, one row per key (and ``by``), at most ``cap`` per ``by``."""
    tiers = [f.withColumn("tier", F.lit(i)) for i, f in enumerate(frames)]
    every = tiers[0]
    for t in tiers[1:]:
        every = every.unionByName(t, allowMissingColumns=True)
    keys = [key] if by is None else [by, key]
    kept = every.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy("tier", *order))).where("_rn = 1").drop("_rn")
    if cap is not None:
        kept = kept.withColumn("_rn", F.row_number().over(Window.partitionBy(by or F.lit(0)).orderBy("tier", *order, key))).where(F.col("_rn") <= cap).drop("_rn")
    return kept
