"""Readers and writers of fact stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.functions import columns as C


def read_items(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON arrays of facts with a text."""
    return spark.read.schema(schema).option("multiLine", True).json(path).where(F.trim("memory") != "")


def read_wrapped(spark: SparkSession, path: str, field: str, element: str, key: str) -> DataFrame:
    """Rows of ``field`` in wrapped stores, the first per key."""
    rows = spark.read.schema(f"{field} array<{element}>").option("multiLine", True).json(path).select(F.posexplode(field).alias("_p", "r")).select("_p", "r.*").where(F.trim(key) != "")
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy("_p"))).where("_rn = 1").drop("_rn", "_p")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(key, vector) of stores that map texts to vectors."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<double>>").alias("m"))
    return whole.select(F.explode("m").alias("key", "vector"))


def read_quarantined(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, raw texts of records that don't fit) of a file of JSON lines."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    parsed = raw.withColumn("r", F.from_json("value", schema + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()
    return parsed.where(~bad).select("r.*").drop("_corrupt_record"), parsed.where(bad).select("value")


def write_store(df: DataFrame, folder: str, version: int, schema_version: int = 1) -> str:
    """A new snapshot of a store. The manifest gets its row (version, schema_version, updated_at) after the data is whole, so readers never see a part of one."""
    path = f"{folder.rstrip('/')}/v={version:012d}"
    df.write.mode("overwrite").parquet(path)
    stamp = df.sparkSession.range(1, numPartitions=1).select(F.lit(version).cast("long").alias("version"), F.lit(schema_version).alias("schema_version"), F.current_timestamp().alias("updated_at"))
    stamp.write.mode("append").parquet(f"{folder.rstrip('/')}/manifest")
    return path


def migrate_legacy(texts: DataFrame) -> DataFrame:
    """Typed rows of old stores of plain texts (ord, text): trimmed, guessed type, importance 5, first of each case-folded text."""
    rows = texts.select("ord", F.trim("text").alias("memory")).where("memory <> ''").withColumn("k", C.canonical_name(F.col("memory")))
    first = rows.groupBy("k").agg(F.min(F.struct("ord", "memory")).alias("x"))
    return first.select("x.ord", "x.memory", C.guess_type(F.col("x.memory")).alias("type"), F.lit(5).alias("importance"))


def sync_vectors(items: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts without a vector, keys of vectors without a text)."""
    return items.select("memory").distinct().join(vectors.select(F.col("key").alias("memory")), "memory", "left_anti"), vectors.select("key").join(items.select(F.col("memory").alias("key")), "key", "left_anti")


def read_log(spark: SparkSession, path: str, field: str, element: str, order: str, keep: int = 5000) -> DataFrame:
    """Newest ``keep`` rows of an append-only log wrapped in ``field``."""
    rows = spark.read.schema(f"{field} array<{element}>").option("multiLine", True).json(path).select(F.posexplode(field).alias("_p", "r")).select("_p", "r.*")
    return rows.orderBy(F.col(order).desc(), F.col("_p").desc()).limit(keep).drop("_p")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of graph documents as JSON texts of objects; what is no list counts as empty."""
    doc = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    part = lambda f: doc.select(F.explode(F.try_variant_get("v", f"$.{f}", "array<variant>")).alias("v")).where(F.schema_of_variant("v").startswith("OBJECT")).select(F.to_json("v").alias("json"))
    return part("nodes"), part("edges")


def newest_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the newest snapshot that ``write_store`` finished."""
    newest = spark.read.parquet(f"{folder.rstrip('/')}/manifest").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{folder.rstrip('/')}/v={newest:012d}")
