"""Merkle manifest of a dataset: a leaf for each row, a tree for each group (language), a tree over the groups, a proof for each row.

Rows are put in order by a range partitioning and numbered from the counts of its partitions, so that no group meets in one task. The trees
are cut into superblocks of 2**LEVELS leaves. Each stage reduces the superblocks to one node, and these nodes are the next stage's leaves,
until one is left. On the way back leaves and the outer nodes that their superblock needs (the siblings from its node up to the root) are
cogrouped by superblock in applyInPandas, which finishes the local reduction, joins local and outer proof and folds the leaf to the root.

Defined cases: a null group comes first and is a group like any other; a null field counts as ``-``; rows of equal group and order key are
ordered by their leaf, and rows equal in all fields are leaves of their own; a table without rows has no root and gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.llm.common import materialise, pick, table

#: A superblock holds 2**LEVELS leaves, so its task's work has a bound.
LEVELS = 9
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = "g long, i long, n long, d string"
_PATH = "g long, i long, path array<string>"


def leaf_of(*fields: Column) -> Column:
    """SHA-256 of the fields, each as its length in bytes, a colon and its text, or a dash."""
    said = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in said]), 256)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def local_levels(nodes: list[str], depth: int) -> list[list[str]]:
    """The nodes and the ``depth`` levels above them; a node without a partner is hashed by itself."""
    out = [nodes]
    for _ in range(depth):
        below = out[-1]
        out.append([digest("".join(below[k:k + 2])) for k in range(0, len(below), 2)])
    return out


def siblings(levels: list[list[str]], place: int) -> Iterator[str]:
    """For each level the sibling with its side (L or R), or an empty text where there is none."""
    for nodes in levels[:-1]:
        other = place ^ 1
        yield "" if other >= len(nodes) else ("L" if other < place else "R") + nodes[other]
        place >>= 1


def fold(node: str, path: list[str]) -> str:
    for step in path:
        node = digest(step[1:] + node if step[:1] == "L" else node + step[1:])
    return node


def depth_of(n: int, levels: int) -> int:
    """Levels that a superblock of a tree of ``n`` leaves reduces by."""
    return min(levels, (n - 1).bit_length())


def _local(block: pd.DataFrame, levels: int) -> tuple[pd.DataFrame, list[list[str]]]:
    block = block.sort_values("i")
    return block, local_levels(block["d"].tolist(), depth_of(int(block["n"].iloc[0]), levels))


def _reduce(levels: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A superblock to its node."""
    def reduced(block: pd.DataFrame) -> pd.DataFrame:
        block, nodes = _local(block, levels)
        return pd.DataFrame({"g": [int(block["g"].iloc[0])], "i": [int(block["i"].iloc[0]) >> levels], "n": [-(-int(block["n"].iloc[0]) >> levels)], "d": nodes[-1]})

    return reduced


def _extend(levels: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Path to the root for each node of a superblock."""
    def extended(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        (block, nodes), rest = _local(block, levels), list(outer["path"].iloc[0])
        return pd.DataFrame({"g": block["g"], "i": block["i"], "path": [[*siblings(nodes, k), *rest] for k in range(len(block))]})

    return extended


def _prove(levels: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The leaves of a superblock, proven and folded."""
    def proven(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        (block, nodes), rest, root = _local(block, levels), list(outer["path"].iloc[0]), outer["root"].iloc[0]
        paths = [[*siblings(nodes, k), *rest] for k in range(len(block))]
        folded = [fold(probe, path) for probe, path in zip(block["probe"], paths, strict=True)]
        return pd.DataFrame({
            "id": block["id"].to_numpy(), "leaf": block["d"].to_numpy(), "subroot": outer["subroot"].iloc[0], "root": root,
            "proof_sha256": [digest("".join(step[1:] for step in path)) for path in paths], "folded_root": folded, "verified": [x == root for x in folded]})

    return proven


def _block(levels: int) -> Column:
    return F.shiftright("i", levels).alias("block")


def _up(leaves: DataFrame, levels: int) -> list[DataFrame]:
    """Node tables from the leaves (g, i, n, d) up to one node for each tree."""
    stages, most = [leaves], leaves.agg(F.max("n")).first()[0] or 1
    while most > 1:
        stages.append(materialise(stages[-1].select("g", "i", "n", "d").groupBy("g", _block(levels)).applyInPandas(_reduce(levels), _NODE), "merkle-nodes"))
        most = -(-most >> levels)
    return stages


def _down(stages: list[DataFrame], paths: DataFrame, levels: int) -> DataFrame:
    """Paths (g, i, path) of the nodes of the first of ``stages`` from those of the nodes above the last."""
    for nodes in reversed(stages):
        paths = materialise(nodes.select("g", "i", "n", "d").groupBy("g", _block(levels)).cogroup(paths.groupBy("g", "i")).applyInPandas(_extend(levels), _PATH), "merkle-paths")
    return paths


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (row, grp, key, leaf, probe) as g (place of the group), i (place in it), n (its size), id, d and probe.

    The number that Spark gives to sorted rows holds their partition and their place in it. What is added up are counts, one for each group and partition.
    """
    order = ("grp", "key", "leaf", "row")
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = materialise(placed.withColumn("part", F.shiftright("at", 33)), "merkle-order")
    group = Window.partitionBy("grp")
    ends = placed.groupBy("grp", "part").agg(F.min("at").alias("first_at"), F.count("*").alias("in_part"))
    ends = materialise(ends.withColumns({
        "before": F.sum("in_part").over(group.orderBy("part")) - F.col("in_part"), "n": F.sum("in_part").over(group), "opens": F.min("first_at").over(group) == F.col("first_at")}), "merkle-parts")
    opened = ends.where("opens").groupBy("part").agg(F.count("*").alias("groups"))
    opened = opened.select("part", (F.sum("groups").over(Window.orderBy("part")) - F.col("groups")).alias("earlier"))
    names = ends.where("opens").join(opened, "part").select(
        F.col("grp").alias("_grp"), (F.col("earlier") + F.row_number().over(Window.partitionBy("part").orderBy("first_at")) - 1).cast("long").alias("g"))
    ends = ends.join(names, F.col("grp").eqNullSafe(F.col("_grp"))).select("_grp", F.col("part").alias("_part"), "g", "n", (F.col("before") - F.col("first_at")).alias("shift"))
    found = placed.join(ends, (F.col("part") == F.col("_part")) & F.col("grp").eqNullSafe(F.col("_grp")))
    return found.select("g", (F.col("at") + F.col("shift")).alias("i"), "n", F.col("key").cast("string").alias("id"), F.col("leaf").alias("d"), "probe")


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group_col: str = "lang", id_col: str = "doc_id", probed: dict[str, Column] | None = None,
             levels: int = LEVELS) -> DataFrame:
    """One row per row of ``docs``: its id, leaf, subroot, root, proof_sha256, folded_root and verified.

    ``probed`` gives fields their values as they are found when the data is verified; the folded root is that of these values.
    """
    cols = list(dict.fromkeys((*fields, group_col, id_col)))
    leaf = leaf_of(*[F.col(c) for c in fields])
    again = leaf_of(*[(probed or {}).get(c, F.col(c)) for c in fields]) if probed else leaf
    same = F.lit(True)
    for c, value in (probed or {}).items():
        same = same & value.eqNullSafe(F.col(c))
    rows = pick(docs, *cols).select(F.monotonically_increasing_id().alias("row"), F.col(group_col).alias("grp"), F.col(id_col).alias("key"), leaf.alias("leaf"), F.when(~same, again).alias("changed"))
    rows = materialise(rows, "merkle-rows").withColumn("probe", F.coalesce("changed", "leaf")).drop("changed")
    leaves = materialise(numbered(rows), "merkle-leaves")
    stages = _up(leaves, levels)
    subroots = stages[-1].select("g", F.col("d").alias("subroot"))
    trees = _up(materialise(subroots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("i"), F.lit(subroots.count()).cast("long").alias("n"), F.col("subroot").alias("d")), "merkle-subroots"), levels)
    top = trees[-1].select("g", "i", F.array().cast("array<string>").alias("path"))
    paths = _down(trees[:-1], top, levels).select(F.col("i").alias("g"), F.lit(0).cast("long").alias("i"), "path")
    root = trees[-1].select("d").first()
    outer = _down(stages[1:-1], paths, levels).join(subroots, "g").withColumn("root", F.lit(root[0] if root else None).cast("string"))
    proven = leaves.groupBy("g", _block(levels)).cogroup(outer.groupBy("g", "i")).applyInPandas(
        _prove(levels), "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return proven.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return manifest(table(spark, sf_dir, "documents"), probed={"n_chars": tampered})


#: Trees of up to 2**24 leaves in the SQL.
_TOP = 24


def _oracle() -> str:
    said = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
    leaf = lambda n: f"sha256({' || '.join(said(c if c != 'n_chars' else n) for c in FIELDS)})"
    bits = "list_reduce([x::bigint] || range(8), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))"
    crc = f"xor(list_reduce([4294967295::bigint] || list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint), lambda a, b: {bits.replace('x::bigint', 'xor(a, b)')}), 4294967295)"
    tree = lambda name, source: f"""{name}0 as ({source}), """ + ", ".join(
        f"{name}{k + 1} as (select g, i >> 1 as i, case when any_value(n) = 1 then any_value(d) else sha256(string_agg(d, '' order by i)) end as d, (any_value(n) + 1) >> 1 as n from {name}{k} group by g, i >> 1)"
        for k in range(_TOP))
    every = lambda name: f"{name} as (" + " union all ".join(f"select {k} as level, g, i, d from {name}{k} where n > 1" for k in range(_TOP)) + ")"
    path = lambda name, leaves: f"""select l.g, l.i, list(case when s.d is null then '' when s.i < m.i then 'L' || s.d else 'R' || s.d end order by m.level) as path
      from {leaves} l join {name} m on m.g = l.g and m.i = l.i >> m.level left join {name} s on s.g = m.g and s.level = m.level and s.i = xor(m.i, 1) group by l.g, l.i"""  # noqa: E731
    folds = "list_reduce([probe] || p, lambda a, x: case x[1] when 'L' then sha256(x[2:] || a) when 'R' then sha256(a || x[2:]) else sha256(a) end)"
    return f"""with base as (select doc_id, lang, {leaf('n_chars')} as d, case when {crc} % 7 = 0 then {leaf('(n_chars + 1)')} else {leaf('n_chars')} end as probe from documents),
leaves as (select dense_rank() over (order by lang nulls first) - 1 as g, row_number() over (partition by lang order by doc_id) - 1 as i, count(*) over (partition by lang) as n, d, doc_id, probe from base),
{tree('a', 'select g, i, d, n from leaves')}, {tree('b', f'select 0 as g, g as i, d, count(*) over () as n from a{_TOP}')}, {every('a')}, {every('b')},
inner_path as ({path('a', 'leaves')}), outer_path as ({path('b', 'b0')}),
whole as (select doc_id, leaves.d as leaf, probe, s.d as subroot, t.d as root, coalesce(inner_path.path, []::varchar[]) || coalesce(outer_path.path, []::varchar[]) as p
  from leaves join a{_TOP} s using (g) cross join b{_TOP} t left join inner_path on inner_path.g = leaves.g and inner_path.i = leaves.i left join outer_path on outer_path.i = leaves.g),
folded as (select *, {folds} as folded_root from whole)
select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(p, lambda x: x[2:]), '')) as proof_sha256, folded_root, folded_root = root as verified from folded"""


QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
ORACLE = {"op12_merkle_manifest": _oracle()}
