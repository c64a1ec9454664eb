"""Typed rows from loose ones: every column is coerced, missing ones get their default. One projection each, no shuffle but for references.

Input columns may have any type or be absent; extra columns are dropped. A time that can't be read counts as missing. Ids that are
missing are derived from the row's natural key, so a rerun gives the same. `now` is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions import columns as C

PROVENANCE = "array<struct<timestamp:string,action:string,event:string,reason:string,source_text:string,related_memory_ids:array<string>>>"
CAUSAL = "array<struct<target_memory_id:string,relation:string,confidence:string,evidence:string,timestamp:string>>"
HISTORY = "array<struct<snapshot:struct<version:string,name:string,type:string,valid_from:string,valid_to:string>>>"
DECISIONS = ("SAME", "POSSIBLE_CONFLICT", "DIFFERENT")


class _Loose:
    """Columns of a loose table by name, null where there is none."""

    def __init__(self, df: DataFrame):
        self.types = {f.name: f.dataType for f in df.schema}

    def text(self, name: str) -> Column:
        """Stripped text; blank is null."""
        if name not in self.types:
            return F.lit(None).cast("string")
        return F.nullif(F.regexp_replace(F.col(name).cast("string"), r"^\s+|\s+$", ""), F.lit(""))

    def number(self, name: str, kind: str = "int") -> Column:
        return self.text(name).try_cast(kind)

    def time(self, name: str) -> Column:
        if name not in self.types:
            return F.lit(None).cast("timestamp")
        return C.parse_ts(F.col(name).cast("string"))

    def list(self, name: str, kind: str = "array<string>") -> Column:
        """A list; anything else is empty, a single text is a list of one."""
        empty = F.array().cast(kind)
        if name not in self.types:
            return empty
        if self.types[name].typeName() == "array":
            return F.coalesce(F.col(name).cast(kind), empty)
        if kind == "array<string>" and self.types[name].typeName() == "string":
            return F.when(self.text(name).isNotNull(), F.array(self.text(name))).otherwise(empty)
        return empty


def _own_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 12))


def _history(c: _Loose, current: Column) -> Column:
    """Snapshots of a history. An entry without one is a snapshot itself, as older stores have it; one without a name has the entity's own, one with a blank name goes."""
    kind = c.types.get("history")
    if kind is None or kind.typeName() != "array" or kind.elementType.typeName() != "struct":
        return F.array().cast(HISTORY)
    own = set(kind.elementType.names)
    wrapped = kind.elementType["snapshot"].dataType if "snapshot" in own else None
    inner = set(wrapped.names) if wrapped is not None and wrapped.typeName() == "struct" else set()

    def field(h: Column, name: str) -> Column:
        bare = (h[name] if name in own else F.lit(None)).cast("string")
        if not inner:
            return bare
        return F.when(h["snapshot"].isNotNull(), (h["snapshot"][name] if name in inner else F.lit(None)).cast("string")).otherwise(bare)

    def entry(h: Column) -> Column:
        named = C.norm_name(F.coalesce(field(h, "name"), current))
        return F.struct(F.struct(field(h, "version").alias("version"), named.alias("name"), *[field(h, n).alias(n) for n in ("type", "valid_from", "valid_to")]).alias("snapshot"))

    whole = F.filter(F.coalesce(F.col("history"), F.array().cast(kind)), lambda h: h.isNotNull())
    return F.filter(F.transform(whole, entry), lambda h: h["snapshot"]["name"] != "").cast(HISTORY)


def normalize_items(df: DataFrame, now: Column, archived: bool = False) -> DataFrame:
    """Facts in 20 columns (22 for archived ones); rows without a text go.

    Times default to created_at and that to now, confidence to the one importance gives, chain_id to memory_id, status to the
    lifecycle unless it is one of active, aging, decaying.
    """
    c = _Loose(df)
    imp, created = C.clamp_importance(c.text("importance")), F.coalesce(c.time("created_at"), now)
    accessed, memory = F.coalesce(c.time("last_accessed"), created), c.text("memory")
    key = F.coalesce(c.text("memory_id"), _own_id("mem_", memory, created))
    status = F.lit("archived") if archived else F.when(c.text("status").isin("active", "aging", "decaying"), c.text("status")).otherwise(C.item_lifecycle(imp, C.age_days(accessed, now)))
    conf = F.round(F.greatest(F.lit(0.2), F.least(F.lit(0.99), F.coalesce(c.number("confidence", "double"), C.initial_confidence(imp)))), 4)
    temporal = F.when(c.text("temporal_status").isin(*C.TEMPORAL_STATUSES), c.text("temporal_status")).otherwise("current")
    extra = [F.coalesce(c.time("archived_at"), now).alias("archived_at"), F.coalesce(c.text("archive_reason"), F.lit("")).alias("archive_reason")] if archived else []
    return df.where(memory.isNotNull()).select(
        memory.alias("memory"), F.coalesce(c.text("type"), F.lit("other")).alias("type"), imp.alias("importance"), conf.alias("confidence"),
        created.alias("created_at"), F.coalesce(c.time("updated_at"), created).alias("updated_at"), accessed.alias("last_accessed"),
        F.greatest(F.lit(0), F.coalesce(c.number("access_count"), F.lit(0))).alias("access_count"), status.alias("status"), key.alias("memory_id"), F.coalesce(c.text("chain_id"), key).alias("chain_id"),
        F.greatest(F.lit(1), F.coalesce(c.number("version"), F.lit(1))).alias("version"), F.coalesce(c.time("valid_from"), created).alias("valid_from"), c.time("valid_to").alias("valid_to"),
        c.text("supersedes").alias("supersedes"), c.text("superseded_by").alias("superseded_by"), temporal.alias("temporal_status"), C.clean_ids(c.list("derived_from")).alias("derived_from"),
        C.norm_provenance(c.list("provenance", PROVENANCE)).alias("provenance"), C.norm_causal(c.list("causal_links", CAUSAL)).alias("causal_links"), *extra)


def normalize_entities(df: DataFrame, now: Column) -> DataFrame:
    """Entities in 28 columns; rows without a name go. Mentions default to the number of memory ids."""
    c = _Loose(df)
    squeeze = lambda n: F.nullif(C.norm_name(c.text(n)), F.lit(""))
    name, created = squeeze("name"), F.coalesce(c.time("created_at"), now)
    updated, kind = F.coalesce(c.time("updated_at"), created), C.norm_entity_type(c.text("type"))
    key, refs = F.coalesce(squeeze("entity_id"), _own_id("ent_", C.canonical_name(name), kind)), C.clean_ids(c.list("memory_ids"), 200)
    share = lambda n, default: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.number(n, "double"), F.lit(default)))), 4)
    count = lambda n, default: F.greatest(F.lit(0), F.coalesce(c.number(n), default))
    temporal = F.when(c.text("temporal_status").isin(*C.TEMPORAL_STATUSES), c.text("temporal_status")).otherwise("current")
    history = C.keep_newest(_history(c, name), 20)
    return df.where(name.isNotNull()).select(
        key.alias("entity_id"), F.coalesce(squeeze("entity_chain_id"), key).alias("entity_chain_id"), F.greatest(F.lit(1), F.coalesce(c.number("version"), F.lit(1))).alias("version"),
        F.coalesce(c.time("valid_from"), created).alias("valid_from"), c.time("valid_to").alias("valid_to"), temporal.alias("temporal_status"), history.alias("history"), name.alias("name"),
        C.canonical_name(name).alias("canonical_name"), kind.alias("type"), C.clean_aliases(c.list("aliases"), name).alias("aliases"), F.substring(F.coalesce(c.text("description"), F.lit("")), 1, 500).alias("description"),
        share("confidence", 0.7).alias("confidence"), count("mention_count", F.size(refs)).alias("mention_count"), refs.alias("memory_ids"), count("identity_resolution_count", F.lit(0)).alias("identity_resolution_count"),
        F.coalesce(c.text("identity_resolution_method"), F.lit("")).alias("identity_resolution_method"), share("identity_resolution_score", 0.0).alias("identity_resolution_score"),
        F.coalesce(c.time("first_seen_at"), created).alias("first_seen_at"), F.coalesce(c.time("last_seen_at"), updated).alias("last_seen_at"), C.norm_enum(c.text("lifecycle_status"), C.LIFECYCLES, "ACTIVE").alias("lifecycle_status"),
        share("lifecycle_score", 0.0).alias("lifecycle_score"), C.norm_enum(c.text("archive_state"), ("ACTIVE", "ARCHIVED"), "ACTIVE").alias("archive_state"), c.time("archived_at").alias("archived_at"),
        F.substring(F.coalesce(c.text("archive_reason"), F.lit("")), 1, 300).alias("archive_reason"), F.upper(F.coalesce(c.text("pre_archive_lifecycle_status"), F.lit(""))).alias("pre_archive_lifecycle_status"),
        created.alias("created_at"), updated.alias("updated_at"))


def normalize_relations(df: DataFrame, entities: DataFrame, now: Column) -> DataFrame:
    """Relations of a known kind between two different known entities with confidence of .65 or more; the kind decides on direction if nothing else does."""
    c = _Loose(df)
    s, t, rel = c.text("source_entity_id"), c.text("target_entity_id"), C.canonical_relation(c.text("relation"))
    created = F.coalesce(c.time("created_at"), now)
    directed = F.coalesce(c.number("directed", "boolean"), ~rel.isin(*C.UNDIRECTED_RELATIONS))
    rows = df.select(
        F.coalesce(c.text("relation_id"), C.relation_id(s, t, rel)).alias("relation_id"), s.alias("source_entity_id"), t.alias("target_entity_id"), rel.alias("relation"), directed.alias("directed"),
        C.clamp_confidence(c.text("confidence"), 0.0, 1.0, 0.7).alias("confidence"), F.substring(F.coalesce(c.text("evidence"), F.lit("")), 1, 500).alias("evidence"), C.clean_ids(c.list("memory_ids"), 100).alias("memory_ids"),
        F.when(F.lower(c.text("status")) == "inactive", "inactive").otherwise("active").alias("status"), created.alias("created_at"), F.coalesce(c.time("updated_at"), created).alias("updated_at"))
    good = rows.where((F.col("source_entity_id") != F.col("target_entity_id")) & F.col("relation").isin(*C.RELATIONS) & (F.col("confidence") >= 0.65))
    known = entities.select(F.col("entity_id").cast("string").alias("_e")).distinct()
    for end in ("source_entity_id", "target_entity_id"):
        good = good.join(known, F.col(end) == F.col("_e"), "left_semi")
    return good


def normalize_conflicts(df: DataFrame, now: Column) -> DataFrame:
    """Conflict records; an unknown decision is POSSIBLE_CONFLICT, an unknown status ACTIVE."""
    c = _Loose(df)
    created, name, ent = F.coalesce(c.time("created_at"), now), F.coalesce(c.text("candidate_name"), F.lit("")), F.coalesce(c.text("entity_id"), F.lit(""))
    text = lambda n, cap=1000: F.substring(F.coalesce(c.text(n), F.lit("")), 1, cap).alias(n)
    return df.select(
        F.coalesce(c.text("conflict_id"), _own_id("ecf_", C.canonical_name(name), ent)).alias("conflict_id"), name.alias("candidate_name"), F.coalesce(F.upper(c.text("candidate_type")), F.lit("OTHER")).alias("candidate_type"),
        ent.alias("entity_id"), text("entity_name"), F.coalesce(F.upper(c.text("entity_type")), F.lit("OTHER")).alias("entity_type"), C.norm_enum(c.text("decision"), DECISIONS, "POSSIBLE_CONFLICT").alias("decision"),
        C.norm_enum(c.text("status"), ("ACTIVE", "RESOLVED", "DISMISSED"), "ACTIVE").alias("status"), F.round(F.coalesce(c.number("score", "double"), F.lit(0.0)), 4).alias("score"), text("method"), text("reason"), text("source_text"),
        text("memory_id"), text("created_entity_id"), text("resolution_reason"), created.alias("created_at"), F.coalesce(c.time("updated_at"), created).alias("updated_at"))


def normalize_operations(df: DataFrame, now: Column) -> DataFrame:
    """Ledger rows; those without a key or a type go, an unknown status is COMPLETED."""
    c = _Loose(df)
    created = F.coalesce(c.time("created_at"), now)
    return df.where(c.text("operation_key").isNotNull() & c.text("operation_type").isNotNull()).select(
        F.coalesce(c.text("operation_id"), _own_id("op_", c.text("operation_key"), created)).alias("operation_id"), c.text("operation_key").alias("operation_key"), F.upper(c.text("operation_type")).alias("operation_type"),
        C.norm_enum(c.text("status"), ("STARTED", "COMPLETED", "FAILED"), "COMPLETED").alias("status"), F.coalesce(c.text("result_ref"), F.lit("")).alias("result_ref"), F.substring(F.coalesce(c.text("error"), F.lit("")), 1, 1000).alias("error"),
        F.greatest(F.lit(1), F.coalesce(c.number("attempt_count"), F.lit(1))).alias("attempt_count"), F.greatest(F.lit(0), F.coalesce(c.number("recovery_count"), F.lit(0))).alias("recovery_count"),
        F.coalesce(c.time("started_at"), created).alias("started_at"), c.time("lease_expires_at").alias("lease_expires_at"), created.alias("created_at"), F.coalesce(c.time("updated_at"), created).alias("updated_at"))


def clean_text_list(df: DataFrame, text: str, order: str, cap: int = 500) -> DataFrame:
    """(ord, text): stripped, cut to ``cap`` characters, without empty ones, the first of equal texts."""
    t = F.substring(F.regexp_replace(F.col(text), r"^\s+|\s+$", ""), 1, cap)
    return df.select(F.col(order).alias("ord"), t.alias("text")).where("text <> ''").groupBy("text").agg(F.min("ord").alias("ord")).select("ord", "text")


def normalize_mixed(df: DataFrame) -> DataFrame:
    """(memory, type, importance) of rows that hold a plain text (``text``) or a record (``memory``, ``type``, ``importance``); defaults other and 5."""
    c = _Loose(df)
    memory = F.coalesce(c.text("memory"), c.text("text"))
    return df.where(memory.isNotNull()).select(memory.alias("memory"), F.coalesce(c.text("type"), F.lit("other")).alias("type"), F.greatest(F.lit(0), F.least(F.lit(5), F.coalesce(c.number("importance"), F.lit(5)))).alias("importance"))


def validate_rewrite(df: DataFrame) -> DataFrame:
    """Rewritten facts: no empty texts, type one of nine, importance 0 to 5 (5 if it is no number)."""
    m = normalize_mixed(df)
    return m.withColumn("type", F.when(F.lower("type").isin(*C.REWRITE_TYPES), F.lower("type")).otherwise("other"))


def accept_rewrite(before: DataFrame, after: DataFrame, group: str) -> DataFrame:
    """(group, n_before, n_after, accepted): a rewrite of a group counts if it isn't empty and not larger."""
    n = lambda df, name: df.groupBy(group).agg(F.count("*").alias(name))
    both = n(before, "n_before").join(n(after, "n_after"), group, "full_outer").fillna(0, ["n_before", "n_after"])
    return both.withColumn("accepted", (F.col("n_after") > 0) & (F.col("n_after") <= F.col("n_before")))


def cap_entities(entities: DataFrame, most: int = 5000) -> DataFrame:
    """The ``most`` entities of a store that are kept: most mentions, then confidence, then name."""
    return entities.orderBy(F.col("mention_count").desc(), F.col("confidence").desc(), "canonical_name", "entity_id").limit(most)


def with_place(df: DataFrame, by: str, *order: Column) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
