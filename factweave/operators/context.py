"""What goes into a prompt beside the recalled facts: their neighbours and entities, candidates for causes, and the budget of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.operators import vector

#: Hits that neighbours and entities are taken of, neighbours of a hit, candidates for causes and their least similarity. Fixed values.
GRAPH_HITS, ENTITY_HITS, NEIGHBORS, CANDIDATES, BROAD = 3, 5, 5, 12, 0.2
NO_GRAPH, NO_ENTITIES = "No graph-related memories found.", "No known entities connected."


def _lines(rows: DataFrame, line, *order: str) -> DataFrame:
    """One text for each query; a query has a few rows."""
    said = F.transform(F.sort_array(F.collect_list(F.struct(*order, line.alias("line")))), lambda x: x["line"])
    return rows.groupBy("query_id").agg(F.array_join(said, "\n").alias("text"))


def graph_context(hits: DataFrame, edges: DataFrame, items: DataFrame, mentions: DataFrame) -> DataFrame:
    """(query_id, graph, entities) of every query with a hit.

    hits: query_id, memory_id, rank. edges: memory_id, neighbor, relation, dir (both directions of an edge are rows of their own). items: memory_id,
    memory. mentions: memory_id, entity_id, name, type. The first three hits give five neighbours each (by dir, relation and id), the first five
    their entities; a text and an entity are told once, where they come first. Edges are cut to those of the asked facts, and to five a fact, before texts are joined.
    """
    top = hits.where(F.col("rank") <= GRAPH_HITS).select("query_id", "memory_id", "rank")
    first = Window.partitionBy("memory_id").orderBy("dir", "relation", "neighbor")
    near = edges.join(top.select("memory_id").distinct(), "memory_id", "left_semi").withColumn("place", F.row_number().over(first)).where(F.col("place") <= NEIGHBORS)
    told = top.join(near, "memory_id").join(items.select(F.col("memory_id").alias("neighbor"), F.trim("memory").alias("memory")).where("memory <> ''"), "neighbor")
    once = told.groupBy("query_id", "memory").agg(F.min(F.struct("rank", "place", "relation")).alias("m")).select("query_id", "memory", "m.*")
    graph = _lines(once, F.concat(F.lit("- "), F.coalesce("relation", F.lit("RELATED")), F.lit(": "), "memory"), "rank", "place").withColumnRenamed("text", "graph")
    known = hits.where(F.col("rank") <= ENTITY_HITS).select("query_id", "memory_id", "rank").join(mentions, "memory_id")
    known = known.groupBy("query_id", "entity_id").agg(F.min("rank").alias("rank"), F.min(F.struct(F.coalesce("name", F.lit("")).alias("name"), F.coalesce("type", F.lit("OTHER")).alias("type"))).alias("e"))
    entities = _lines(known, F.concat(F.lit("- "), F.col("e.name"), F.lit(" ("), F.col("e.type"), F.lit(")")), "rank", "entity_id").withColumnRenamed("text", "entities")
    every = hits.select("query_id").distinct().join(graph, "query_id", "left").join(entities, "query_id", "left")
    return every.select("query_id", F.coalesce("graph", F.lit(NO_GRAPH)).alias("graph"), F.coalesce("entities", F.lit(NO_ENTITIES)).alias("entities"))


def causal_candidates(queries: DataFrame, facts: DataFrame, recall: int = 3, least: float = 0.35) -> DataFrame:
    """(query_id, key, sim, tier): the best ``recall`` facts, then others of .2 or more, then any at similarity 0, twelve in all and each once.

    Only the twelve facts of the smallest keys can be needed as filling for a query, beside those it has already; so twice as many are offered.
    """
    found = vector.similar_pairs(queries, facts.select("key", "vector"), min(least, BROAD)).select("query_id", "key", "sim")
    broad = vector.top_k(found, CANDIDATES, "sim")
    tiers = broad.withColumn("tier", F.when((F.col("rank") <= recall) & (F.col("sim") >= least), 0).otherwise(1)).where((F.col("tier") == 0) | (F.col("sim") >= BROAD)).select("query_id", "key", "sim", "tier")
    some = facts.select("key").orderBy("key").limit(2 * CANDIDATES)
    short = tiers.groupBy("query_id").agg(F.count("*").alias("n"))
    open_ = queries.select("query_id").join(short, "query_id", "left").where(F.coalesce("n", F.lit(0)) < CANDIDATES).select("query_id")
    filling = open_.join(F.broadcast(some)).join(tiers.select("query_id", "key"), ["query_id", "key"], "left_anti").select("query_id", "key", F.lit(0.0).alias("sim"), F.lit(2).alias("tier"))
    w = Window.partitionBy("query_id").orderBy("tier", F.col("sim").desc(), "key")
    return tiers.unionByName(filling).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= CANDIDATES).drop("_rn")


def token_budget(turns: DataFrame, cost: str, budget: int, keep: int = 2) -> DataFrame:
    """Tokens of each conversation (conv_id, turn, role) before and after only the newest ``keep`` exchanges and the system rows are kept, and what remains of the budget."""
    w = Window.partitionBy("conv_id", F.col("role") == "system").orderBy(F.col("turn").desc())
    stays = (F.col("role") == "system") | (F.col("_rn") <= 2 * keep)
    rows = turns.withColumn("_rn", F.row_number().over(w))
    out = rows.groupBy("conv_id").agg(F.coalesce(F.sum(cost), F.lit(0)).cast("long").alias("used_before"), F.coalesce(F.sum(F.when(stays, F.col(cost))), F.lit(0)).cast("long").alias("used_after"))
    return out.select("conv_id", "used_before", "used_after", (budget - F.col("used_after")).alias("remaining"), (F.col("used_before") <= budget).alias("fits_before"), (F.col("used_after") <= budget).alias("fits_after"))
