"""Substring search by an inverted index of character trigrams.

A pattern can only lie in texts that hold every trigram of it, so it is looked up by the one that fewest texts hold and then verified; a pattern
with a trigram that no text has is done at once. Patterns of one or two characters are found by the texts' single characters and pairs,
which is exact by itself. All joins are on equal keys. Texts and patterns are taken once each, however many rows bear them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.operators.joins import large


def grams(text: Column, n: int) -> Column:
    """The different stretches of n characters."""
    return F.when(F.char_length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def index(texts: DataFrame, column: str, n: int = 3) -> DataFrame:
    """Postings (gram, text) of the different texts. They are hashed by gram, so a table kept of them can be appended to by new texts."""
    t = texts.select(F.col(column).alias("text")).distinct()
    return t.select(F.explode(grams(F.col("text"), n)).alias("gram"), "text")


def containing(patterns: DataFrame, texts: DataFrame, pattern: str = "pattern", text: str = "text", postings: DataFrame | None = None) -> DataFrame:
    """Every (pattern, text) of which the text holds the pattern. Empty and missing ones match nothing.

    ``postings``: the trigram index of ``texts`` if it is kept.
    """
    p = patterns.select(F.col(pattern).alias("pattern")).where("pattern <> ''").distinct()
    long = p.where(F.char_length("pattern") >= 3).select("pattern", F.explode(grams(F.col("pattern"), 3)).alias("gram"))
    postings = index(texts, text) if postings is None else postings
    held = postings.join(large(long.select("gram").distinct()), "gram", "left_semi")  # only what is asked for meets the patterns
    common = held.groupBy("gram").agg(F.count("*").alias("held_by"))
    rarest = long.join(large(common), "gram", "left").groupBy("pattern").agg(F.min(F.struct(F.coalesce("held_by", F.lit(0)).alias("held_by"), F.col("gram").alias("gram"))).alias("r"))
    rarest = rarest.where("r.held_by > 0").select("pattern", "r.gram")
    out = rarest.join(large(held), "gram").where(F.contains("text", "pattern")).select("pattern", "text")
    for n in (1, 2):
        short = p.where(F.char_length("pattern") == n).select("pattern", F.col("pattern").alias("gram"))
        out = out.unionByName(short.join(large(index(texts, text, n)), "gram").select("pattern", "text"))
    return out


def best_per_text(rows: DataFrame, text: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each text: of rows with one text the later ones can't be among the best k of a search."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(text).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")
