"""Fingerprints of tables by a tree of digests, and differences of nested rows with their paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factweave.functions import canonical

#: Changes that a plan lists, and elements of a list from which it is compared as a whole. Fixed values.
MOST_CHANGES, MOST_ELEMENTS = 200, 50
#: Rows that a leaf of a tree holds, about.
LEAF_ROWS = 1024
_CHANGE = "struct<path:string,change:string,old:string,new:string>"


def depth_for(n: int) -> int:
    """Levels of a tree of ``n`` rows: each level splits by 16."""
    depth = 0
    while n > LEAF_ROWS << (4 * depth):
        depth += 1
    return depth


def leaves(df: DataFrame, depth: int, key: str | None = None, cols: tuple[str, ...] = ()) -> DataFrame:
    """(prefix, digest, n_rows, low, high) for each range of hashes of the key (of the row, if there is none); low and high are the keys in it.

    Equal rows are counted before they are gathered, and a leaf gathers the digests of one range only.
    """
    cols = cols or tuple(df.columns)
    row = F.sha2(canonical.row_text(df, **{c: F.col(c) for c in cols}), 256)
    place = F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("")), 256) if key else row
    rows = df.select(row.alias("d"), place.alias("p"), (F.col(key) if key else F.lit(None).cast("string")).alias("k")).groupBy("d", "p", "k").agg(F.count("*").alias("n"))
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("d", "n"))), lambda x: F.concat_ws(":", x["d"], x["n"])), ",")
    return rows.groupBy(F.substring("p", 1, depth).alias("prefix")).agg(F.sha2(said, 256).alias("digest"), F.sum("n").alias("n_rows"), F.min("k").alias("low"), F.max("k").alias("high"))


def fingerprint(df: DataFrame, *cols: str, depth: int | None = None) -> DataFrame:
    """One row: the digest of a table whatever the order of its rows and columns. Node digests are those of their children, in order."""
    depth = depth_for(df.count()) if depth is None else depth
    nodes = leaves(df, depth, None, cols).select("prefix", "digest")
    for level in range(depth - 1, -1, -1):
        said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("prefix", "digest"))), lambda x: F.concat_ws(":", x["prefix"], x["digest"])), ",")
        nodes = nodes.groupBy(F.substring("prefix", 1, level).alias("prefix")).agg(F.sha2(said, 256).alias("digest"))
    return nodes.agg(F.sha2(F.coalesce(F.max("digest"), F.lit("")), 256).alias("fingerprint"))  # one row at most


def differing(before: DataFrame, after: DataFrame, key: str, depth: int | None = None) -> DataFrame:
    """(prefix, low, high, rows_before, rows_after) of the ranges in which two tables differ; only their rows have to be compared."""
    depth = depth_for(max(before.count(), after.count())) if depth is None else depth
    b, a = (leaves(df, depth, key).toDF("prefix", f"{s}_digest", f"{s}_rows", f"{s}_low", f"{s}_high") for df, s in ((before, "b"), (after, "a")))
    j = b.join(a, "prefix", "full").where(~F.col("b_digest").eqNullSafe(F.col("a_digest")))
    return j.select("prefix", F.least("b_low", "a_low").alias("low"), F.greatest("b_high", "a_high").alias("high"), F.coalesce("b_rows", F.lit(0)).alias("rows_before"), F.coalesce("a_rows", F.lit(0)).alias("rows_after"))


def _json(c: Column) -> Column:
    """A value as JSON text; null for a missing one."""
    whole = F.to_json(F.struct(c.alias("v")))
    return F.when(c.isNotNull(), F.substring(whole, F.lit(6), F.length(whole) - 6))


def _one(path: Column, change: str, old: Column | None, new: Column | None) -> Column:
    none = F.lit(None).cast("string")
    return F.array(F.struct(path.alias("path"), F.lit(change).alias("change"), (none if old is None else old).alias("old"), (none if new is None else new).alias("new")))


def changes(b: Column, a: Column, before: T.DataType, after: T.DataType, path: Column) -> Column:
    """Array of (path, change, old, new) between two values: added, removed, type_changed (also to or from a missing value), value_changed, collection_rebuilt."""
    nothing = F.array().cast(f"array<{_CHANGE}>")
    swapped = _one(path, "type_changed", _json(b), _json(a))
    if isinstance(before, T.StructType) and isinstance(after, T.StructType):
        old, new = {f.name: f.dataType for f in before}, {f.name: f.dataType for f in after}
        parts = []
        for n in sorted({*old, *new}):
            at = F.concat(path, F.lit(f".{n}"))
            parts.append(_one(at, "added", None, _json(a[n])) if n not in old else _one(at, "removed", _json(b[n]), None) if n not in new else changes(b[n], a[n], old[n], new[n], at))
        same = F.concat(*parts) if parts else nothing
    elif isinstance(before, T.ArrayType) and isinstance(after, T.ArrayType):
        at = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
        most = F.greatest(F.size(b), F.size(a))
        each = F.flatten(F.transform(F.sequence(F.lit(0), most - 1), lambda i: F.when(i >= F.size(b), _one(at(i), "added", None, _json(F.get(a, i)))).when(i >= F.size(a), _one(at(i), "removed", _json(F.get(b, i)), None))
                                     .otherwise(changes(F.get(b, i), F.get(a, i), before.elementType, after.elementType, at(i)))))
        rebuilt = F.when(_json(b) != _json(a), _one(path, "collection_rebuilt", F.size(b).cast("string"), F.size(a).cast("string"))).otherwise(nothing)
        same = F.when(most == 0, nothing).when(most > MOST_ELEMENTS, rebuilt).otherwise(each)
    elif isinstance(before, T.MapType) and isinstance(after, T.MapType):
        names = F.array_sort(F.array_distinct(F.concat(F.map_keys(b), F.map_keys(a))))
        at = lambda n: F.concat(path, F.lit("."), n.cast("string"))
        has = lambda m, n: F.array_contains(F.map_keys(m), n)
        same = F.flatten(F.transform(names, lambda n: F.when(~has(b, n), _one(at(n), "added", None, _json(F.try_element_at(a, n)))).when(~has(a, n), _one(at(n), "removed", _json(F.try_element_at(b, n)), None))
                                     .otherwise(changes(F.try_element_at(b, n), F.try_element_at(a, n), before.valueType, after.valueType, at(n)))))
    elif isinstance(before, T.VariantType) and isinstance(after, T.VariantType):
        same = F.when(F.to_json(b) == F.to_json(a), nothing).when(F.schema_of_variant(b) != F.schema_of_variant(a), swapped).otherwise(_one(path, "value_changed", _json(b), _json(a)))
    elif before == after:
        same = F.when(b == a, nothing).otherwise(_one(path, "value_changed", _json(b), _json(a)))
    else:
        same = swapped
    return F.when(b.isNull() & a.isNull(), nothing).when(b.isNull() | a.isNull(), swapped).otherwise(same)


def nested_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, path, change, old, new) of all rows of two tables; rows of one of them only are added or removed as a whole (path $)."""
    cut = lambda df: T.StructType([f for f in df.schema if f.name != key])
    whole = lambda df, n: df.select(F.col(key), F.struct(*[F.col(f"`{f.name}`") for f in cut(df)]).alias(n))
    j = whole(before, "_b").join(whole(after, "_a"), key, "full")
    root = F.lit("$")
    found = (F.when(F.col("_b").isNull(), _one(root, "added", None, _json(F.col("_a")))).when(F.col("_a").isNull(), _one(root, "removed", _json(F.col("_b")), None))
             .otherwise(changes(F.col("_b"), F.col("_a"), cut(before), cut(after), root)))
    return j.select(key, F.explode(found).alias("x")).select(key, "x.*")


def change_plan(tables: dict[str, tuple[DataFrame, DataFrame]], key: str, most: int = MOST_CHANGES) -> DataFrame:
    """The first ``most`` changes of each table by key and path, with the number of all of them, so that a plan cut short says so."""
    out = None
    for name, (before, after) in tables.items():
        rows = nested_diff(before, after, key)
        first = rows.orderBy(key, "path").limit(most).join(F.broadcast(rows.agg(F.count("*").alias("n_changes"))))  # one row
        first = first.select(F.lit(name).alias("table"), F.col(key).cast("string").alias("key"), "path", "change", "old", "new", "n_changes", (F.col("n_changes") > most).alias("cut"))
        out = first if out is None else out.unionByName(first)
    return out
