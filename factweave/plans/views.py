"""Tables of the fact engine derived from the driver's tables, once for Spark and once as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factweave.functions import columns as C

NOW_ORDERS, NOW_EVENTS = "2001-08-02", "2024-02-01"


def now(text: str = NOW_ORDERS) -> Column:
    return F.to_timestamp(F.lit(text))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str, shipped: bool = True) -> DataFrame:
    """One fact per order; a customer's orders are the versions of one chain."""
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    base = o.select(
        F.col("o_orderkey").alias("memory_id"), F.col("o_custkey").alias("chain_id"), F.row_number().over(w).cast("long").alias("version"),
        F.col("o_orderdate").cast("timestamp").alias("valid_from"), F.lead("o_orderdate").over(w).cast("timestamp").alias("valid_to"),
        (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("importance"), (F.col("o_orderkey") % 12).alias("access_count"), F.col("o_orderstatus").alias("group_id"))
    base = base.withColumn("confidence", C.initial_confidence(F.col("importance"))).withColumn("created_at", F.col("valid_from"))
    if not shipped:
        return base.withColumn("last_accessed", F.col("valid_from"))
    ship = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("memory_id")).agg(F.max("l_shipdate").cast("timestamp").alias("ship"))
    return base.join(ship, "memory_id", "left").withColumn("last_accessed", F.coalesce("ship", "valid_from")).drop("ship")


ITEMS_SQL = """
b as (select o_orderkey as memory_id, o_custkey as chain_id, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as version,
  o_orderdate::timestamp as valid_from, lead(o_orderdate::timestamp) over (partition by o_custkey order by o_orderdate, o_orderkey) as valid_to,
  6 - substr(o_orderpriority, 1, 1)::int as importance, o_orderkey % 12 as access_count, o_orderstatus as group_id from orders),
s as (select l_orderkey as memory_id, max(l_shipdate)::timestamp as ship from lineitem group by 1),
items as (select b.*, case when importance >= 4 then 0.9::double when importance >= 3 then 0.8::double else 0.7::double end as confidence, valid_from as created_at,
  coalesce(ship, valid_from) as last_accessed from b left join s using (memory_id))"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("key"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"), (F.col("label") % 5 + 1).alias("importance"),
        (F.col("vec_id") % 12).alias("access_count"), F.lit(0.8).alias("confidence"),
        (F.to_timestamp(F.lit(NOW_EVENTS)) - F.make_dt_interval(days=(F.col("vec_id") % 200).cast("int"))).alias("last_accessed"), (F.col("vec_id") % 5 != 0).alias("active"))


VECTORS_SQL = f"""
vecs as (select vec_id as key, embedding::double[] as vector, label % 5 + 1 as importance, vec_id % 12 as access_count, 0.8::double as confidence,
  vec_id % 200 as days, vec_id % 5 <> 0 as active from embeddings),
q as (select key as query_id, vector as qv from vecs where key % 50 = 0),
sims as (select query_id, vecs.*, list_cosine_similarity(qv, vector) as sim from q, vecs)"""


def queries_of(vecs: DataFrame) -> DataFrame:
    return vecs.where("key % 50 = 0").select(F.col("key").alias("query_id"), "vector")


LIFE_SQL = """(case when importance >= 4 or {d} < 30 then 'active' when {d} < 90 then 'aging' else 'decaying' end)"""
REINF_SQL = "least(1.0::double, ln(1 + access_count::double) / ln(21.0::double))"


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("mention_count"), F.max("l_shipdate").cast("timestamp").alias("last_seen"))
    return table(spark, sf_dir, "part").join(used, F.col("p_partkey") == F.col("l_partkey"), "left").select(
        F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.array("p_brand").alias("aliases"),
        F.coalesce("mention_count", F.lit(0)).alias("mention_count"), "last_seen", F.lit(0.8).alias("confidence"), (F.col("p_size") % 10 == 0).alias("ended"))


ENTITIES_SQL = """
ents as (select p_partkey as entity_id, p_name as name, p_type as type, coalesce(n, 0) as mention_count, last_seen, 0.8::double as confidence, p_size % 10 = 0 as ended
  from part left join (select l_partkey, count(*) as n, max(l_shipdate)::timestamp as last_seen from lineitem group by 1) on p_partkey = l_partkey)"""


def ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers and parts of lineitem, each once."""
    one = lambda k, prefix: table(spark, sf_dir, "lineitem").select(k).distinct().select(F.concat(F.lit(prefix), k).alias("entity_id"))
    return one("l_suppkey", "s").unionByName(one("l_partkey", "p"))
