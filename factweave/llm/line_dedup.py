"""Line deduplication by overlapping three-line windows.

Consecutive lines are hashed as windows of three. A window whose lines occurred earlier anywhere
(smaller doc_id, then smaller position) is a later occurrence; the positions it covers are merged
with those of its neighbours and removed. A document of one or two lines is one window by itself.

Defined cases: null text stays null and has no lines; a null doc_id sorts first; rows equal in
doc_id and text are one document and get one result each; a line end after the last line makes an
empty last line as any other. Blank windows (no letter or digit in any of the lines) never count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.common import KEY, pick, row_key, table

WINDOW = 3


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """_fw_key, id, pos (0-based), h: one row per window with something in it; h stands for all its lines in order."""
    lines = pick(docs, id_col, text_col).select(
        row_key(id_col, text_col).alias(KEY), id_col, F.split(F.col(text_col), "\n").alias("l"))
    hashed = lines.select(KEY, id_col, F.transform("l", lambda x: F.xxhash64(x)).alias("h"), F.transform("l", lambda x: x.rlike(r"[\p{L}\p{N}]")).alias("said"))
    n = F.size("h")
    one = F.transform(
        F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))),
        lambda i: F.when(F.exists(F.slice("said", i + 1, F.lit(size)), lambda x: x), F.xxhash64(F.slice("h", i + 1, F.lit(size)), F.least(n, F.lit(size)))))
    return (
        hashed.where(n > 0)
        .select(KEY, id_col, F.posexplode(one).alias("pos", "h"))
        .where("h is not null")
    )


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """_fw_key and ``at``, the sorted distinct starts of windows that are later occurrences.

    The first occurrence of each window is found by a partial aggregate, so that a window shared by a
    third of the documents leaves each task as one row; the join back to the occurrences reads
    small rows and can be split by adaptive execution.
    """
    found = windows(docs, id_col, text_col, size)
    place = F.struct(F.col(id_col).alias("i"), F.col(KEY).alias("k"), F.col("pos").alias("p"))
    first = found.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    first = first.where(~F.col("first").eqNullSafe(F.col("last"))).select("h", "first")
    later = found.join(first, "h").where(~place.eqNullSafe(F.col("first")))
    return later.groupBy(KEY).agg(F.array_sort(F.collect_set("pos")).alias("at"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """All columns of ``docs`` with ``text_col`` cleaned, plus n_lines and n_removed (replacing columns of these names).

    Rows are as many as before: a text that is all later copies becomes empty. The lines kept are the slices between
    the merged windows, so the work on a document grows with its lines and not with their square.
    """
    gone = repeated_windows(docs, id_col, text_col, size).withColumnRenamed("at", "_fw_at")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (text_col, "n_lines", "n_removed")]
    split = docs.select(*rest, F.split(F.col(text_col), "\n").alias("_fw_lines"), row_key(id_col, text_col).alias(KEY))
    joined = split.join(gone, KEY, "left").withColumn("_fw_n", F.coalesce(F.size("_fw_lines"), F.lit(0)))
    after = F.slice("_fw_at", F.lit(2), F.greatest(F.size("_fw_at") - 1, F.lit(0)))
    between = F.zip_with("_fw_at", after, lambda a, b: F.slice("_fw_lines", a + size + 1, F.greatest(F.coalesce(b, F.col("_fw_n")) - a - size, F.lit(0))))
    kept = F.flatten(F.concat(F.array(F.slice("_fw_lines", F.lit(1), F.get("_fw_at", F.lit(0)))), between))
    out = joined.withColumn("_fw_kept", F.when(F.col("_fw_at").isNull(), F.col("_fw_lines")).otherwise(kept))
    n = F.when(F.col("_fw_lines").isNull(), F.lit(0)).otherwise(F.col("_fw_n")).cast("long")
    extra = {text_col: F.array_join("_fw_kept", "\n"), "n_lines": n, "n_removed": (n - F.when(F.col("_fw_lines").isNull(), F.lit(0)).otherwise(F.size("_fw_kept"))).cast("long")}
    order = [c for c in docs.columns if c not in ("n_lines", "n_removed")] + ["n_lines", "n_removed"]
    return out.select(*[extra[c].alias(c) if c in extra else F.col(f"`{c}`") for c in order])


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op9_line_dedup": _query}

ORACLE: dict[str, str] = {
    "op9_line_dedup": r"""
with l as (select doc_id, text, string_split(text, chr(10)) as l from documents),
w as (select doc_id, p, l[p:p + 2] as w from (select doc_id, l, unnest(range(1, greatest(len(l) - 2, 1) + 1)) as p from l)),
v as (select * from w where regexp_matches(array_to_string(w, chr(10)), '[\p{L}\p{N}]')),
o as (select doc_id, p, row_number() over (partition by w order by doc_id, p) as r from v),
c as (select distinct doc_id, p + k as p from (select doc_id, p, unnest([0, 1, 2]) as k from o where r > 1)),
x as (select doc_id, list(p) as gone from c group by doc_id)
select l.doc_id,
  case when gone is null then text else coalesce(array_to_string(list_filter(l.l, lambda s, i: not list_contains(gone, i)), chr(10)), '') end as text,
  len(l.l)::bigint as n_lines, coalesce(len(list_filter(gone, lambda p: p <= len(l.l))), 0)::bigint as n_removed
from l left join x using (doc_id)""",
}
