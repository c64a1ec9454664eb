"""Shape codes of the audit: what a typed table can't hold, found in the raw JSON before it is parsed.

Input is one JSON text per row; results are (code, key, n). A text that isn't JSON counts as the wrong shape. A field that is absent
is fine, a null field isn't a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.operators.audit import union


def _shape(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("NONE"))


def is_object(v: Column) -> Column:
    return _shape(v).startswith("OBJECT")


def is_list(v: Column) -> Column:
    return _shape(v).startswith("ARRAY")


def _rows(df: DataFrame, bad: Column, code: str) -> DataFrame:
    return df.where(bad).groupBy(F.col("key").cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit(code).alias("code"), "key", "n")


def _variants(df: DataFrame, key: str, json: str) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.try_parse_json(F.col(json)).alias("v"))


def audit_records(df: DataFrame, key: str, json: str, code: str) -> DataFrame:
    """One element of a store per row: those that are no object get ``code`` (MEMORY_INVALID_RECORD, RELATION_INVALID_RECORD, ...)."""
    v = _variants(df, key, json)
    return _rows(v, ~is_object(F.col("v")), code)


def audit_documents(df: DataFrame, key: str, json: str, fields: dict[str, str], store: str, collection: str) -> DataFrame:
    """One document of a store per row: no object (``store``), a field that isn't a list (``collection``), elements that are no objects (code per field)."""
    v = _variants(df, key, json)
    whole = v.where(is_object(F.col("v")))
    lists = {f: F.variant_get("v", f"$.{f}", "variant") for f in fields}
    wrong = F.lit(False)
    for c in lists.values():
        wrong = wrong | ~is_list(c)
    parts = [_rows(v, ~is_object(F.col("v")), store), _rows(whole, wrong, collection)]
    for f, code in fields.items():
        inner = whole.where(~wrong).select("key", F.explode(F.try_variant_get("v", f"$.{f}", "array<variant>")).alias("v"))
        parts.append(_rows(inner, F.col("v").isNull() | ~is_object(F.col("v")), code))
    return union(*parts)


def audit_ledger_documents(df: DataFrame, key: str, json: str) -> DataFrame:
    return audit_documents(df, key, json, {"operations": "OPERATION_INVALID_RECORD"}, "OPERATION_INVALID_STORE", "OPERATION_INVALID_COLLECTION")


def audit_graph_documents(df: DataFrame, key: str, json: str) -> DataFrame:
    return audit_documents(df, key, json, {"nodes": "GRAPH_INVALID_NODE", "edges": "GRAPH_INVALID_EDGE"}, "GRAPH_INVALID_STORE", "GRAPH_INVALID_COLLECTIONS")


def audit_entity_records(df: DataFrame, key: str, json: str) -> DataFrame:
    """Shapes inside entity objects: memory_ids and history are lists, history holds objects, and so does each entry's snapshot."""
    v = _variants(df, key, json)
    whole = v.where(is_object(F.col("v")))
    field = lambda f: F.variant_get("v", f"$.{f}", "variant")
    not_list = lambda f: field(f).isNotNull() & ~is_list(field(f))
    entry = whole.where(is_list(field("history"))).select("key", F.explode(F.try_variant_get("v", "$.history", "array<variant>")).alias("v"))
    object_entry = F.col("v").isNotNull() & is_object(F.col("v"))
    snap = entry.where(object_entry).select("key", F.variant_get("v", "$.snapshot", "variant").alias("v"))
    return union(
        _rows(v, ~is_object(F.col("v")), "ENTITY_INVALID_RECORD"), _rows(whole, not_list("memory_ids"), "ENTITY_MEMORY_LINKS_NOT_LIST"), _rows(whole, not_list("history"), "ENTITY_HISTORY_NOT_LIST"),
        _rows(entry, ~object_entry, "ENTITY_HISTORY_INVALID_ENTRY"), _rows(snap, F.col("v").isNull() | ~is_object(F.col("v")), "ENTITY_HISTORY_INVALID_SNAPSHOT"))
