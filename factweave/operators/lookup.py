"""Keyed look-ups and searches over many queries at once, and joins on nested references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import columns as C
from factweave.operators import trigrams
from factweave.operators.joins import large


def first_tier(frames: list[DataFrame], by: str = "query_id", *order) -> DataFrame:
    """Best row per query of the earliest frame that has one."""
    every = None
    for i, f in enumerate(frames):
        f = f.withColumn("tier", F.lit(i))
        every = f if every is None else every.unionByName(f, allowMissingColumns=True)
    return every.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy("tier", *order))).where("_rn = 1").drop("_rn")


def _all_names(entities: DataFrame) -> Column:
    return F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))


def find_entity(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, entity_id, tier): by id, then by canonical name or alias, then by core words if they fit one entity only.

    queries: query_id, q. entities: entity_id, name, aliases. Of the entities that bear a name the smallest id is taken before queries meet it.
    """
    q = queries.withColumn("k", C.canonical_name(F.col("q")))
    names = entities.select("entity_id", F.explode(_all_names(entities)).alias("nm")).groupBy(C.canonical_name(F.col("nm")).alias("k")).agg(F.min("entity_id").alias("entity_id"))
    by_id = q.join(entities.select("entity_id", F.col("entity_id").cast("string").alias("q")), "q").select("query_id", "entity_id")
    by_name = q.join(names, "k").select("query_id", "entity_id")
    core = entities.select("entity_id", C.core_key(F.col("name")).alias("c")).where("c <> ''")
    only = core.groupBy("c").agg(F.min("entity_id").alias("entity_id"), F.count("*").alias("n")).where("n = 1")
    by_core = q.withColumn("c", C.core_key(F.col("q"))).join(only, "c").select("query_id", "entity_id")
    return first_tier([by_id, by_name, by_core], "query_id", F.col("entity_id"))


def search_entities(queries: DataFrame, entities: DataFrame, k: int = 5) -> DataFrame:
    """Top k entities per query: 1 for an equal name, .85 for one inside the other, else Jaccard of words; ties by mentions, confidence, id.

    Different queries meet different names by a shared word, or by the trigram index where one lies inside the other. Only the best k entities
    of a name are kept, since they stand before its others in every result. Blank queries and names match nothing.
    """
    order = (F.col("mention_count").desc(), F.col("confidence").desc(), F.col("entity_id"))
    q = queries.select("query_id", C.canonical_name(F.col("q")).alias("qk"), C.word_set(F.col("q")).alias("qw")).where("qk <> ''")
    names = entities.select("entity_id", "mention_count", "confidence", F.explode(_all_names(entities)).alias("nm"))
    names = names.select("entity_id", "mention_count", "confidence", C.canonical_name(F.col("nm")).alias("nk"), C.word_set(F.col("nm")).alias("nw")).where("nk <> ''")
    asked, texts = q.select("qk", "qw").distinct(), names.select("nk", "nw").distinct()
    shared = asked.withColumn("w", F.explode("qw")).join(texts.withColumn("w", F.explode("nw")), "w").select("qk", "nk", "qw", "nw").distinct()
    jac = shared.groupBy("qk", "nk").agg(F.max(F.size(F.array_intersect("qw", "nw")) / F.size(F.array_union("qw", "nw"))).alias("score"))
    inside = trigrams.containing(asked, texts, "qk", "nk").toDF("qk", "nk").unionByName(trigrams.containing(texts, asked, "nk", "qk").toDF("nk", "qk"))
    score = F.when(F.col("qk") == F.col("nk"), 1.0).otherwise(0.85)
    # a name inside the other counts by that alone, whatever words they share
    scored = jac.join(inside.distinct().withColumn("part", score), ["qk", "nk"], "full").select("qk", "nk", F.round(F.coalesce("part", "score"), 4).alias("score"))
    hit = scored.join(trigrams.best_per_text(names.select("entity_id", "mention_count", "confidence", "nk").distinct(), "nk", k, *order), "nk")
    best = hit.groupBy("qk", "entity_id").agg(F.max("score").alias("score"), F.max("mention_count").alias("mention_count"), F.max("confidence").alias("confidence"))
    w = Window.partitionBy("qk").orderBy(F.col("score").desc(), *order)
    best = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return q.select("query_id", "qk").join(best, "qk").select("query_id", "entity_id", "score", "mention_count", "confidence", "rank")


def recent(items: DataFrame, n: int) -> DataFrame:
    return items.orderBy(F.col("updated_at").desc(), "memory_id").limit(n)


def log_history(log: DataFrame, text: str, columns: tuple[str, ...], ts: str, n: int) -> DataFrame:
    """Newest n log rows, newest first, that hold the text (trimmed, case aside) in one of the columns; an empty text asks for all. Equal times go by the columns."""
    wanted = text.strip().lower()
    holds = [F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(wanted)) for c in columns]
    return log.where(F.array_max(F.array(*holds))).orderBy(F.col(ts).desc(), *columns).limit(n)


def by_lifecycle(entities: DataFrame, state: str | None = None) -> DataFrame:
    """Entities in a lifecycle state (any case; ACTIVE, AGING, DORMANT or ENDED), all without one; a name that is no state asks for all as well."""
    wanted = (state or "").strip().upper()
    return entities.where(F.upper(F.trim("lifecycle_status")) == wanted) if wanted in C.LIFECYCLES else entities


def entity_lifecycle(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """Lifecycle columns of the entity that each query (query_id, q) finds; one row per query that finds one."""
    state = F.upper(F.trim(F.coalesce("lifecycle_status", F.lit(""))))
    shown = entities.select(
        "entity_id", "name", F.coalesce("temporal_status", F.lit("current")).alias("temporal_status"), F.when(state.isin(*C.LIFECYCLES), state).otherwise("ACTIVE").alias("lifecycle_status"),
        F.coalesce("lifecycle_score", F.lit(0.0)).alias("lifecycle_score"), "first_seen_at", "last_seen_at", F.coalesce("mention_count", F.lit(0)).alias("mention_count"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    return find_entity(queries, entities).join(shown, "entity_id").select("query_id", *shown.columns)


def entities_of_items(entities: DataFrame, items: DataFrame) -> DataFrame:
    """(memory_id, entity_id) pairs of array membership."""
    return entities.select("entity_id", F.explode("memory_ids").alias("memory_id")).join(items.select("memory_id"), "memory_id", "left_semi").distinct()


def relation_names(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations with the names of their ends, the id where a name is unknown."""
    n = entities.select("entity_id", "name")
    return (relations.join(large(n.select(F.col("entity_id").alias("source"), F.col("name").alias("_s"))), "source", "left").join(large(n.select(F.col("entity_id").alias("target"), F.col("name").alias("_t"))), "target", "left")
            .withColumns({"source_name": F.coalesce("_s", "source"), "target_name": F.coalesce("_t", "target")}).drop("_s", "_t"))


def prune_refs(df: DataFrame, key: str, array: str, valid: DataFrame) -> DataFrame:
    """``array`` without references that are not in ``valid`` (ref), order kept."""
    refs = df.select(key, F.posexplode(array).alias("p", "ref")).join(valid.select("ref").distinct(), "ref", "left_semi")
    kept = refs.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "ref"))), lambda x: x["ref"]).alias("_kept"))
    return df.join(kept, key, "left").withColumn(array, F.coalesce("_kept", F.array().cast(df.schema[array].dataType))).drop("_kept")


def causality(links: DataFrame, items: DataFrame) -> DataFrame:
    """Causal links with the text of the target, ``[missing]`` where it is unknown."""
    return links.join(items.select(F.col("memory_id").alias("target"), F.col("memory").alias("target_text")), "target", "left").withColumn("target_text", F.coalesce("target_text", F.lit("[missing]")))


def find_item(queries: DataFrame, active: DataFrame, archive: DataFrame, column: str = "memory") -> DataFrame:
    """(query_id, memory_id, tier): first fact whose ``column`` equals q, active ones (tier 0) before archived ones (tier 1)."""
    hit = lambda df: queries.join(df.groupBy(F.col(column).cast("string").alias("q")).agg(F.min("memory_id").alias("memory_id")), "q").select("query_id", "memory_id")
    return first_tier([hit(active), hit(archive)], "query_id", F.col("memory_id"))


def resolve_reference(queries: DataFrame, active: DataFrame, archive: DataFrame, similar_active: DataFrame, similar_archive: DataFrame, least: float = 0.55) -> DataFrame:
    """(query_id, memory_id, tier): equal text first, else the most similar active fact, else the most similar archived one, from ``least`` on.

    similar_*: query_id, memory_id, sim of the vector search.
    """
    exact = find_item(queries, active, archive).select("query_id", "memory_id", F.lit(1.0).alias("sim"))
    near = [s.where(F.col("sim") >= least).select("query_id", "memory_id", F.col("sim").cast("double").alias("sim")) for s in (similar_active, similar_archive)]
    return first_tier([exact, *near], "query_id", F.col("sim").desc(), F.col("memory_id"))


def find_by_part(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, entity_id) of queries whose text lies inside the names of one entity only; the last resort after ``find_entity``.

    Names are found by the trigram index; each stands for the smallest and the largest id that bear it.
    """
    names = entities.select("entity_id", F.explode(_all_names(entities)).alias("nm")).groupBy(C.canonical_name(F.col("nm")).alias("nk")).agg(F.min("entity_id").alias("_lo"), F.max("entity_id").alias("_hi"))
    q = queries.select("query_id", C.canonical_name(F.col("q")).alias("k")).where("k <> ''")
    found = trigrams.containing(q, names, "k", "nk").join(large(names.withColumnRenamed("nk", "text")), "text")
    only = found.groupBy(F.col("pattern").alias("k")).agg(F.min("_lo").alias("entity_id"), F.max("_hi").alias("_hi")).where("entity_id = _hi")
    return q.join(large(only), "k").select("query_id", "entity_id")


def conflict_query(conflicts: DataFrame, text: str | None = None, status: str | None = None, decisions: tuple[str, ...] = (), n: int = 50) -> DataFrame:
    """Newest n conflicts that hold the text in a name, have the status and one of the decisions; what isn't given doesn't filter."""
    out = conflicts
    if text:
        out = out.where(F.contains(F.lower(F.concat_ws(" ", "candidate_name", "entity_name")), F.lower(F.lit(text))))
    if status:
        out = out.where(F.col("status") == status.strip().upper())
    if decisions:
        out = out.where(F.col("decision").isin(*decisions))
    return out.orderBy(F.col("updated_at").desc(), "conflict_id").limit(n)


def search_relations(relations: DataFrame, entities: DataFrame, text: str, k: int = 10) -> DataFrame:
    """k most certain relations whose "source relation target" names hold the text."""
    named = relation_names(relations, entities)
    return named.where(F.contains(F.lower(F.concat_ws(" ", "source_name", "relation", "target_name")), F.lower(F.lit(text)))).orderBy(F.col("confidence").desc(), "source", "target").limit(k)


def incident_relations(relations: DataFrame, ids: DataFrame, direction: str = "both") -> DataFrame:
    """Relations that leave (out), enter (in) or touch the entities of ``ids`` (entity_id), with ``entity_id`` and ``dir``."""
    out = relations.join(ids.select(F.col("entity_id").alias("source")), "source", "left_semi").withColumns({"entity_id": F.col("source"), "dir": F.lit("out")})
    into = relations.join(ids.select(F.col("entity_id").alias("target")), "target", "left_semi").withColumns({"entity_id": F.col("target"), "dir": F.lit("in")})
    return {"out": out, "in": into, "both": out.unionByName(into)}[direction]


def context_pack(recalled: DataFrame, recent_items: DataFrame, n: int = 10) -> DataFrame:
    """(query_id, context): recalled facts (query_id, memory, rank), then recent ones (memory, place), one line each and no text twice; the first n lines."""
    q = recalled.select("query_id").distinct()
    every = recalled.select("query_id", "memory", F.struct(F.lit(0).alias("t"), F.col("rank").cast("long").alias("p")).alias("o")).unionByName(
        q.join(F.broadcast(recent_items.orderBy("place").limit(n))).select("query_id", "memory", F.struct(F.lit(1).alias("t"), F.col("place").cast("long").alias("p")).alias("o")))
    once = every.groupBy("query_id", "memory").agg(F.min("o").alias("o")).withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("o"))).where(F.col("_n") <= n)
    return once.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "memory"))), lambda x: F.concat(F.lit("- "), x["memory"])), "\n").alias("context"))


def find_archived_entity(queries: DataFrame, archive: DataFrame) -> DataFrame:
    """(query_id, entity_id): the archived entity of that id, else the only one that has the text as name or alias."""
    by_id = queries.join(archive.select("entity_id", F.col("entity_id").cast("string").alias("q")), "q").select("query_id", "entity_id")
    names = archive.select("entity_id", F.explode(F.array_distinct(F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), C.canonical_name))).alias("k")).where("k <> ''")
    only = names.groupBy("k").agg(F.min("entity_id").alias("entity_id"), F.max("entity_id").alias("_hi")).where("entity_id = _hi").drop("_hi")
    by_name = queries.withColumn("k", C.canonical_name(F.col("q"))).join(only, "k").select("query_id", "entity_id")
    return first_tier([by_id, by_name], "query_id", F.col("entity_id")).select("query_id", "entity_id")


def search_archived_entities(queries: DataFrame, archive: DataFrame, k: int = 10) -> DataFrame:
    """Newest k archived entities per query whose name and aliases, joined, hold its text; found by the trigram index, the newest k of each text."""
    order = (F.col("archived_at").desc(), F.col("entity_id"))
    texts = archive.withColumn("text", F.lower(F.concat_ws(" ", F.array("name"), "aliases")))
    q = queries.select("query_id", F.lower(F.trim("q")).alias("pattern")).where("pattern <> ''")
    hit = trigrams.containing(q, texts).join(trigrams.best_per_text(texts, "text", k, *order), "text").drop("text")
    best = hit.withColumn("rank", F.row_number().over(Window.partitionBy("pattern").orderBy(*order))).where(F.col("rank") <= k)
    return q.join(best, "pattern").drop("pattern")


def active_relations(relations: DataFrame, include_inactive: bool = False) -> DataFrame:
    return relations if include_inactive else relations.where(F.coalesce(F.lower("status"), F.lit("active")) != "inactive")
