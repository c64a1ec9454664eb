"""As-of look-ups over intervals that overlap, by cells of time.

Time is cut into cells of several sizes. An interval is the cells that lie whole inside it (as few and as large as possible) and a piece of a cell at
either end. Whole cells are reduced before anything meets them: one row for each key and cell with the highest version and the number of intervals that
cover it. An instant then reads one row for each size of cell, and only pieces are compared one by one, with the instants of their smallest cell. Rows are dealt
out by key and cell, so a key with a third of all versions and instants is no single group, and versions never meet all instants of their key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.operators.joins import large

#: Seconds of the smallest cell, cells that one of the next size holds, number of sizes.
CELL_SECONDS, RADIX, SIZES = 3600, 16, 5


def _span(low: Column, high: Column, level: int) -> Column:
    """Cells low to high of one size, none if high is lower."""
    none = F.array().cast("array<struct<level:int,cell:bigint>>")
    return F.when(low <= high, F.transform(F.sequence(low, high), lambda c: F.struct(F.lit(level).alias("level"), c.alias("cell")))).otherwise(none)


def with_cover(df: DataFrame, low: str, high: str) -> DataFrame:
    """``df`` once for each cell (level, cell) of the cover of the smallest cells ``low`` to ``high``."""
    df, parts = df.withColumns({"_lo": F.col(low), "_hi": F.col(high)}), []
    for level in range(SIZES - 1):
        up_low, up_high = F.floor((F.col("_lo") + RADIX - 1) / RADIX).cast("long"), F.floor((F.col("_hi") + 1) / RADIX).cast("long") - 1
        df = df.withColumns({"_ul": up_low, "_uh": up_high})
        inner = F.col("_ul") <= F.col("_uh")
        left = _span(F.col("_lo"), F.when(inner, F.col("_ul") * RADIX - 1).otherwise(F.col("_hi")), level)
        right = F.when(inner, _span((F.col("_uh") + 1) * RADIX, F.col("_hi"), level))
        df = df.withColumn(f"_p{level}", F.concat(left, F.coalesce(right, F.array().cast("array<struct<level:int,cell:bigint>>"))))
        df = df.withColumns({"_lo": F.when(inner, F.col("_ul")).otherwise(1), "_hi": F.when(inner, F.col("_uh")).otherwise(0)})
        parts.append(f"_p{level}")
    top = _span(F.col("_lo"), F.col("_hi"), SIZES - 1)
    return df.withColumn("_c", F.explode(F.concat(*parts, top))).select("*", "_c.level", "_c.cell").drop("_c", "_lo", "_hi", "_ul", "_uh", *parts)


def as_of(versions: DataFrame, instants: DataFrame, key: str, closed: bool = False, cell_seconds: int = CELL_SECONDS) -> DataFrame:
    """(key, instant, memory_id, version, n_matches): the highest version whose interval holds the instant, and how many hold it.

    The rows of ``windows.as_of``: half-open [from, to), or closed; an open end holds for ever. versions: key, version, memory_id, valid_from, valid_to.
    """
    size = cell_seconds * 1_000_000
    asked = instants.where("instant is not null").select(key, "instant").distinct().withColumn("_t", F.unix_micros("instant"))
    # only the stretch of a key's time that is asked for is cut into cells
    reach = asked.groupBy(key).agg(F.min("_t").alias("_low"), (F.max("_t") + 1).alias("_high"))
    best = F.struct(F.col("version").cast("long").alias("version"), "memory_id")
    start, end = F.unix_micros("valid_from"), F.unix_micros("valid_to") + (1 if closed else 0)
    v = versions.where("valid_from is not null").select(key, best.alias("best"), start.alias("_start"), end.alias("_end")).where("_end is null or _start < _end").join(large(reach), key)
    v = v.select(key, "best", F.greatest("_start", "_low").alias("_from"), F.least("_end", "_high").alias("_to")).where("_from < _to")
    v = v.withColumns({"_first": F.ceil(F.col("_from") / size).cast("long"), "_last": F.floor(F.col("_to") / size).cast("long") - 1})
    whole = with_cover(v.where("_first <= _last"), "_first", "_last").groupBy(key, "level", "cell").agg(F.max("best").alias("best"), F.count("*").alias("n"))
    # pieces: the cells that hold an end and don't lie whole inside
    ends = F.array_distinct(F.array(F.floor(F.col("_from") / size).cast("long"), F.floor((F.col("_to") - 1) / size).cast("long")))
    pieces = v.select(key, "best", "_from", "_to", "_first", "_last", F.explode(ends).alias("cell")).where("not (cell between _first and _last)")
    levels = F.array(*[F.struct(F.lit(n).alias("level"), F.floor(F.col("_t") / (size * RADIX**n)).cast("long").alias("cell")) for n in range(SIZES)])
    up = asked.select(key, "instant", F.explode(levels).alias("c")).select(key, "instant", "c.level", "c.cell").join(large(whole), [key, "level", "cell"]).select(key, "instant", "best", "n")
    near = asked.select(key, "instant", "_t", F.floor(F.col("_t") / size).cast("long").alias("cell")).join(large(pieces), [key, "cell"]).where("_from <= _t and _t < _to").select(key, "instant", "best", F.lit(1).cast("long").alias("n"))
    found = up.unionByName(near).groupBy(key, "instant").agg(F.max("best").alias("best"), F.sum("n").alias("n_matches"))
    return found.select(key, "instant", F.col("best.memory_id").alias("memory_id"), F.col("best.version").alias("version"), "n_matches")


def entity_as_of(entities: DataFrame, instants: DataFrame) -> DataFrame:
    """(entity_id, instant, version, name, type, current, n_matches) from the history and the current version of entities, closed at both ends."""
    fields = ["version", "name", "type", "valid_from", "valid_to"]
    kinds = {f.name: f.dataType for f in entities.select(*fields).schema}
    version = lambda at, current: F.struct(*[at(f).cast(kinds[f]).alias(f) for f in fields], F.lit(current).alias("current"))
    old = F.transform("history", lambda h: version(lambda f: h["snapshot"][f], False))
    every = entities.select("entity_id", F.explode(F.concat(F.coalesce(old, F.array()), F.array(version(F.col, True)))).alias("v")).select("entity_id", "v.*")
    state = F.struct("name", "type", "current").alias("memory_id")
    from factweave.operators import windows

    found = windows.as_of(every.select("entity_id", "version", state, "valid_from", "valid_to"), instants, "entity_id", closed=True)
    return found.select("entity_id", "instant", "version", "memory_id.name", "memory_id.type", "memory_id.current", "n_matches")
