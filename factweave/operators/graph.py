"""The graph of facts and entities, derived from the stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.operators.joins import large

EDGE = ("source", "target", "type", "relation", "confidence")


def build_nodes(items: DataFrame, entities: DataFrame) -> DataFrame:
    return items.select(F.col("memory_id").alias("id"), F.lit("memory").alias("kind")).unionByName(entities.select(F.col("entity_id").alias("id"), F.lit("entity").alias("kind")))


def build_edges(items: DataFrame, mentions: DataFrame, relations: DataFrame, causal: DataFrame, related: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """Edges of all families; of equal (source, target, type, relation) the first family's and then the most certain one stays.

    mentions: memory_id, entity_id and maybe confidence. relations: source, target, relation, directed, confidence. causal: source, target, relation, confidence.
    related: source, target of facts named together in a provenance entry. With ``nodes`` (id) an edge needs both ends among them.
    """
    one = F.lit(1.0)
    w = Window.partitionBy("chain_id").orderBy("version", "valid_from", "memory_id")
    chained = items.withColumn("nxt", F.lead("memory_id").over(w))
    fam = [
        mentions.select(F.col("memory_id").alias("source"), F.col("entity_id").alias("target"), F.lit("MEMORY_HAS_ENTITY").alias("type"), F.lit("MENTIONS").alias("relation"), (F.col("confidence") if "confidence" in mentions.columns else one).alias("confidence")),
        relations.select("source", "target", F.lit("ENTITY_RELATION").alias("type"), "relation", "confidence"),
        relations.where("not directed").select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit("ENTITY_RELATION").alias("type"), "relation", "confidence"),
        items.select(F.col("memory_id").alias("source"), F.col("supersedes").alias("target"), F.lit("TEMPORAL_SUPERSEDES").alias("type"), F.lit("SUPERSEDES").alias("relation"), one.alias("confidence")),
        items.select(F.col("memory_id").alias("source"), F.col("superseded_by").alias("target"), F.lit("TEMPORAL_SUPERSEDES").alias("type"), F.lit("SUPERSEDED_BY").alias("relation"), one.alias("confidence")),
        items.select(F.col("memory_id").alias("source"), F.explode("derived_from").alias("target"), F.lit("DERIVED_FROM").alias("type"), F.lit("DERIVED_FROM").alias("relation"), one.alias("confidence")),
        causal.select("source", "target", F.lit("CAUSAL").alias("type"), "relation", "confidence"),
        *([related.select("source", "target", F.lit("DERIVED_FROM").alias("type"), F.lit("PROVENANCE_RELATED").alias("relation"), one.alias("confidence"))] if related is not None else []),
        chained.select(F.col("memory_id").alias("source"), F.col("nxt").alias("target"), F.lit("TEMPORAL_SAME_CHAIN").alias("type"), F.lit("NEXT_VERSION").alias("relation"), one.alias("confidence")),
    ]
    every = None
    for i, f in enumerate(fam):
        f = f.withColumn("prio", F.lit(i))
        every = f if every is None else every.unionByName(f)
    good = every.where("source is not null and target is not null and source <> target")
    if nodes is not None:
        good = good.join(large(nodes.select(F.col("id").alias("source"))), "source", "left_semi").join(large(nodes.select(F.col("id").alias("target"))), "target", "left_semi")
    best = F.min(F.struct("prio", (-F.col("confidence")).alias("neg")))
    # dealt out before the minimum of structs, which sorts: most edges stand once, so a first pass over a read part would sort all of it for nothing
    good = good.repartition("source", "target", "type", "relation")
    return good.groupBy("source", "target", "type", "relation").agg(best.alias("b")).select("source", "target", "type", "relation", (-F.col("b.neg")).alias("confidence"))


def _column(df: DataFrame, name: str, kind: str) -> Column:
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind)


def rebuild(items: DataFrame, entities: DataFrame, relations: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) derived anew from all facts and entities, active and archived.

    items: memory_id; chain_id, version, valid_from, supersedes, superseded_by, derived_from, causal_links and provenance where there are any.
    entities: entity_id; memory_ids and confidence where there are any. Rows with a blank id give nothing, a repeated id gives one node,
    a fact without a chain is its own, and an edge needs both its ends.
    """
    items = items.where(F.trim(F.col("memory_id").cast("string")) != "").withColumn("memory_id", F.trim(F.col("memory_id").cast("string")))
    entities = entities.where(F.trim(F.col("entity_id").cast("string")) != "").withColumn("entity_id", F.trim(F.col("entity_id").cast("string")))
    nodes = build_nodes(items, entities).dropDuplicates(["id", "kind"])
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(_column(entities, "confidence", "double"), F.lit(1.0))))
    mentions = entities.select(F.explode(_column(entities, "memory_ids", "array<string>")).alias("memory_id"), "entity_id", sure.alias("confidence"))
    facts = items.select(
        "memory_id", F.coalesce(_column(items, "chain_id", "string"), F.col("memory_id")).alias("chain_id"), F.coalesce(_column(items, "version", "int"), F.lit(1)).alias("version"), _column(items, "valid_from", "timestamp").alias("valid_from"),
        _column(items, "supersedes", "string").alias("supersedes"), _column(items, "superseded_by", "string").alias("superseded_by"), _column(items, "derived_from", "array<string>").alias("derived_from"))
    none = nodes.where("false").select(F.col("id").alias("source"), F.col("id").alias("target"), F.lit("").alias("relation"), F.lit(True).alias("directed"), F.lit(0.0).alias("confidence"))
    known, causal, related = none, none, None
    if relations is not None:
        known = relations.select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"), F.coalesce(F.upper(_column(relations, "relation", "string")), F.lit("RELATED_TO")).alias("relation"),
                                 F.coalesce(_column(relations, "directed", "boolean"), F.lit(True)).alias("directed"), F.coalesce(_column(relations, "confidence", "double"), F.lit(0.7)).alias("confidence"))
    if "causal_links" in items.columns:
        links = items.select(F.col("memory_id").alias("source"), F.explode("causal_links").alias("x"))
        causal = links.select("source", F.col("x.target_memory_id").cast("string").alias("target"), F.upper("x.relation").alias("relation"), F.coalesce(F.col("x.confidence").cast("double"), F.lit(0.0)).alias("confidence"))
    if "provenance" in items.columns:
        entries = items.select(F.col("memory_id").alias("source"), F.explode("provenance").alias("x"))
        related = entries.select("source", F.explode("x.related_memory_ids").cast("string").alias("target"))
    return nodes, build_edges(facts, mentions, known, causal, related, nodes)


def neighbors(edges: DataFrame, ids: DataFrame, k: int = 10, direction: str = "both") -> DataFrame:
    """First k distinct neighbours of each id in edge order, with direction."""
    out = edges.select(F.col("source").alias("id"), F.col("target").alias("neighbor"), F.lit("out").alias("dir"), "type", "relation")
    into = edges.select(F.col("target").alias("id"), F.col("source").alias("neighbor"), F.lit("in").alias("dir"), "type", "relation")
    every = {"out": out, "in": into, "both": out.unionByName(into)}[direction].join(large(ids.select("id")), "id", "left_semi")
    first = every.repartition("id", "neighbor").groupBy("id", "neighbor").agg(F.min(F.struct("dir", "type", "relation")).alias("e"))
    w = Window.partitionBy("id").orderBy("e.dir", "e.type", "e.relation", "neighbor")
    return first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("id", "neighbor", "e.dir", "e.type", "e.relation", "place")


def subgraph(edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node ids, induced edges) of the ids and their one-hop neighbours."""
    out = edges.join(large(ids.select(F.col("id").alias("source"))), "source", "left_semi").select(F.col("target").alias("id"))
    into = edges.join(large(ids.select(F.col("id").alias("target"))), "target", "left_semi").select(F.col("source").alias("id"))
    nodes = ids.select("id").unionByName(out).unionByName(into).distinct()
    inner = edges.join(large(nodes.withColumnRenamed("id", "source")), "source", "left_semi").join(large(nodes.withColumnRenamed("id", "target")), "target", "left_semi")
    return nodes, inner


def view(nodes: DataFrame, edges: DataFrame, ids: DataFrame | None = None, archived: bool = True, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """(first ``most`` nodes by id, edges): of the whole graph, or of ``ids`` and their one-hop neighbours among the nodes (id, archived, ...).

    Edges are those of the whole graph, or those between the selected nodes; the cut to ``most`` is one of the nodes shown only. Without
    ``archived`` archived nodes and their edges are left out of a neighbourhood; null counts as not archived.
    """
    chosen, inner = nodes, edges
    if ids is not None:
        chosen = nodes.join(subgraph(edges, ids)[0], "id", "left_semi")
        chosen = chosen if archived else chosen.where(~F.coalesce("archived", F.lit(False)))
        ends = chosen.select("id").distinct()
        inner = edges.join(ends.withColumnRenamed("id", "source"), "source", "left_semi").join(ends.withColumnRenamed("id", "target"), "target", "left_semi").select(edges.columns)
    return chosen.orderBy("id").limit(most), inner
