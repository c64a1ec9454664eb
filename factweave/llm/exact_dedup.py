"""Exact deduplication: rows are grouped by a 128-bit content hash and their bytes compared inside the groups.

One pass over the texts writes a small digest table (id, row number, digest); groups, the row that stays and the answer for every row come
from that table alone. The byte check reads the texts again, but only those whose hash may be a repeated one leave their task, and equal ones
are collapsed in the task before they are shuffled. A hash that two different texts share (found, not assumed away) is taken out of the
digest table and its rows are grouped by hash and text.

Defined cases: a null text counts as the empty one; null ids are later than all others under both rules, so such a row stays only where no row
of its group has an id, and its keep_id is null; of rows equal in text and id exactly one stays; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.common import materialise, pick, table

#: Bits of the filter of repeated hashes. It is sent as (word, 64 bits), words without a bit left out: 2**22 rows of 16 bytes at most.
FILTER_BITS = 1 << 28


def fold_ascii(text: Column) -> Column:
    """A to Z become a to z and nothing else changes; texts of ASCII only take the short way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def hash128(sha256_hex: Column) -> Column:
    """The first 128 bits of the text's SHA-256."""
    return F.unhex(F.substring(sha256_hex, 1, 32))


def _best(keep: str) -> Column:
    """The row that stays, by id and then row number."""
    if keep == "smallest":
        return F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row")))
    if keep == "largest":
        return F.max(F.struct(F.col("id").isNotNull().alias("none"), F.col("id"), F.col("row")))
    raise ValueError("keep is smallest or largest")


def _word(h: Column) -> tuple[Column, Column]:
    bit = F.pmod(F.xxhash64(h), F.lit(FILTER_BITS))
    return F.floor(bit / 64).cast("long"), F.pmod(bit, F.lit(64)).cast("int")


def _answer(rows: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
    """Rows without a group are alone. A hot group's rows are split by the skew join, its group is one row."""
    first = F.col("best.row")
    return rows.join(groups, on, "left").select(
        "id", F.when(first.isNull(), F.col("id")).otherwise(F.col("best.id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (first.isNull() | (first == F.col("row"))).alias("kept"), "sha")


def collided(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """h of every hash in ``repeated`` (h) that different texts of ``docs`` (h, t) share."""
    word, bit = _word(F.col("h"))
    seen = repeated.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
    may = docs.withColumns({"word": word, "bit": bit}).join(F.broadcast(seen), "word").where(F.getbit("mask", F.col("bit")) == 1)
    return may.select("h", "t").distinct().groupBy("h").agg(F.count("*").alias("n_texts")).where("n_texts > 1").select("h")


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
         normalise: Callable[[Column], Column] = fold_ascii, content_hash: Callable[[Column], Column] = hash128) -> DataFrame:
    """One row per row of ``docs``: its id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    text = normalise(F.coalesce(F.col("t").cast("string"), F.lit("")))
    rows = pick(docs, id_col, text_col).toDF("id", "t").withColumn("t", text).withColumn("sha", F.sha2("t", 256)).withColumn("h", content_hash(F.col("sha")))
    digests = materialise(rows.select("id", F.monotonically_increasing_id().alias("row"), "sha", "h"), "exact-digests")
    groups = digests.groupBy("h").agg(F.count("*").alias("group_size"), _best(keep).alias("best")).where("group_size > 1")
    groups = materialise(groups, "exact-groups")
    shared = materialise(collided(rows.select("h", "t"), groups.select("h")), "exact-collisions")
    out = _answer(digests, groups, ["h"])
    if not shared.isEmpty():
        whole = materialise(rows.join(shared, "h", "left_semi").withColumn("row", F.monotonically_increasing_id()), "exact-collided")
        apart = whole.groupBy("h", "t").agg(F.count("*").alias("group_size"), _best(keep).alias("best"))
        out = _answer(digests.join(shared, "h", "left_anti"), groups, ["h"]).unionByName(_answer(whole, apart, ["h", "t"]))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark(table(spark, sf_dir, "documents"), keep="largest")


QUERIES = {"op11_exact_dedup": op11_exact_dedup}
ORACLE = {"op11_exact_dedup": f"""with d as (select doc_id, translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}') as t from documents),
w as (select doc_id, t, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size from d)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from w"""}
