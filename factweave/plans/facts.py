"""Queries over facts, vectors and entities, with the same results in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions import columns as C
from factweave.operators import aggregate, changes, graph, temporal, vector, windows
from factweave.plans import views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


_RANK = "row_number() over (partition by query_id order by {s} desc, key) as rank"


@query("vec_topk", f"with {V.VECTORS_SQL} select * from (select query_id, key, round(sim, 4) as sim, {_RANK.format(s='sim')} from sims where active and sim >= 0.2) where rank <= 5")
def vec_topk(spark, sf):
    v = V.vectors(spark, sf)
    return vector.top_k(vector.similar_pairs(V.queries_of(v), v.where("active"), 0.2, k=5), 5, "sim").select("query_id", "key", F.round("sim", 4).alias("sim"), F.col("rank").cast("long").alias("rank"))


@query("vec_dups", f"with {V.VECTORS_SQL} select * exclude (rank) from (select query_id, key, round(sim, 4) as sim, {_RANK.format(s='sim')} from sims where sim >= 0.15 and key <> query_id) where rank = 1")
def vec_dups(spark, sf):
    v = V.vectors(spark, sf)
    return vector.top_k(vector.similar_pairs(V.queries_of(v), v, 0.15, k=1, apart=True), 1, "sim").select("query_id", "key", F.round("sim", 4).alias("sim"))


_LIFE = V.LIFE_SQL.format(d="days")
_ITEM_SCORE = f"(0.5 * case {_LIFE} when 'active' then 1 when 'aging' then 0.65 else 0.3 end + 0.3 * importance / 5 + 0.2 * {V.REINF_SQL})"


@query("vec_score", f"""with {V.VECTORS_SQL}, c as (select query_id, key, round(0.55 * sim + 0.15 * importance / 5 + 0.1 * {V.REINF_SQL} + 0.1 * {_ITEM_SCORE} + 0.1 * confidence, 4) as score
  from sims where active and sim >= 0.1) select * from (select *, {_RANK.format(s='score')} from c) where rank <= 5""")
def vec_score(spark, sf):
    v = V.vectors(spark, sf)
    return vector.search(V.queries_of(v), v.where("active"), V.now(V.NOW_EVENTS), 0.1, 5).select("query_id", "key", "score", F.col("rank").cast("long").alias("rank"))


@query("archive_recall", f"with {V.VECTORS_SQL} select * from (select query_id, key, round(sim, 4) as sim, {_RANK.format(s='sim')} from sims where not active and sim >= 0.1) where rank <= 3")
def archive_recall(spark, sf):
    v = V.vectors(spark, sf)
    return vector.top_k(vector.similar_pairs(V.queries_of(v), v.where("not active"), 0.1), 3, "sim").select("query_id", "key", F.round("sim", 4).alias("sim"), F.col("rank").cast("long").alias("rank"))


@query("rank_blend", f"""with {V.VECTORS_SQL}, c as (select query_id, key, round(0.35 * sim + 0.2 * importance / 5 + 0.15 * confidence
  + 0.1 * case {_LIFE} when 'active' then 1 when 'aging' then 0.7 else 0.4 end + 0.1 * least(access_count / 20.0, 1) + 0.1 * exp(-days / 30.0::double), 4) as score
  from sims where sim >= 0) select * from (select *, {_RANK.format(s='score')} from c) where rank <= 5""")
def rank_blend(spark, sf):
    v = V.vectors(spark, sf)
    return vector.rank_blend(V.queries_of(v), v, V.now(V.NOW_EVENTS), 0.0, 5).select("query_id", "key", "score", F.col("rank").cast("long").alias("rank"))


@query("recovery", f"""with {V.VECTORS_SQL}, best as (select query_id, max(sim) as best from sims where active group by 1),
c as (select query_id, key, round(0.6 * sim + 0.25 * importance / 5 + 0.15 * {V.REINF_SQL} - least(0.2, days / 3650.0::double), 4) as score
  from sims join best using (query_id) where best < 0.7 and not active and sim >= 0.55)
select query_id, key, score from (select *, {_RANK.format(s='score')} from c where score >= 0.62) where rank = 1""")
def recovery(spark, sf):
    v = V.vectors(spark, sf)
    return vector.recover(V.queries_of(v), v.where("active"), v.where("not active"), V.now(V.NOW_EVENTS)).select("query_id", "key", "score")


@query("chain", f"with {V.ITEMS_SQL} select memory_id, chain_id, version from items where chain_id in (select chain_id from items where memory_id % 50 = 0)")
def chain(spark, sf):
    i = V.items(spark, sf, False)
    return windows.version_chain(i, i.where("memory_id % 50 = 0")).select("memory_id", "chain_id", "version")


@query("adjacent", f"with {V.ITEMS_SQL} select * from (select chain_id, memory_id as prev_id, lead(memory_id) over (partition by chain_id order by version) as next_id from items) where next_id is not null")
def adjacent(spark, sf):
    return windows.adjacent_versions(V.items(spark, sf, False))


@query("chain_repair", f"""with {V.ITEMS_SQL} select memory_id, lead(memory_id) over w as superseded_by, epoch_us(valid_to) as valid_to,
  case when lead(memory_id) over w is null then 'current' else 'historical' end as temporal_status from items window w as (partition by chain_id order by version)""")
def chain_repair(spark, sf):
    fixed = windows.chain_repair(V.items(spark, sf, False).withColumn("valid_to", F.lit(None).cast("timestamp")))
    return fixed.select("memory_id", "superseded_by", F.unix_micros("valid_to").alias("valid_to"), "temporal_status")


_INSTANTS = "i as (select c_custkey as chain_id, d::timestamp as instant from customer, range(timestamp '1995-01-01', timestamp '2001-10-01', interval 3 month) t(d) union select chain_id, valid_from from items)"


def _instants(spark, sf):
    c = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("chain_id"))
    quarters = c.withColumn("instant", F.explode(F.expr("sequence(timestamp'1995-01-01', timestamp'2001-07-01', interval 3 month)")))
    return quarters.unionByName(V.items(spark, sf, False).select("chain_id", F.col("valid_from").alias("instant")))


def _as_of_sql(until: str) -> str:
    return f"""with {V.ITEMS_SQL}, {_INSTANTS} select i.chain_id, epoch_us(instant) as instant, max(version) as version, count(*) as n_matches
from i join items using (chain_id) where valid_from <= instant and (valid_to is null or instant {until} valid_to) group by 1, 2"""


@query("asof_half_open", _as_of_sql("<"))
def asof_half_open(spark, sf):
    return windows.as_of(V.items(spark, sf, False), _instants(spark, sf), "chain_id").select("chain_id", F.unix_micros("instant").alias("instant"), "version", "n_matches")


@query("asof_closed", _as_of_sql("<="))
def asof_closed(spark, sf):
    return windows.as_of(V.items(spark, sf, False), _instants(spark, sf), "chain_id", closed=True).select("chain_id", F.unix_micros("instant").alias("instant"), "version", "n_matches")


@query("scd2", f"""with {V.ITEMS_SQL}, e as (select *, case chain_id % 3 when 0 then timestamp '2001-08-02' when 1 then timestamp '1997-06-01' else timestamp '1990-01-01' end as eff from items),
cur as (select * from e where valid_to is null and eff >= valid_from)
select memory_id, chain_id, version, epoch_us(case when memory_id in (select memory_id from cur) then eff else valid_to end) as valid_to from e
union all select -chain_id, chain_id, version + 1, null from cur""")
def scd2(spark, sf):
    """A change for every customer: accepted, too early for some chains, or of a chain without versions."""
    i = V.items(spark, sf, False).withColumns({"superseded_by": F.lit(None).cast("long"), "memory": F.lit("x")})
    k = F.col("c_custkey")
    start = F.when(k % 3 == 0, V.now()).when(k % 3 == 1, V.now("1997-06-01")).otherwise(V.now("1990-01-01"))
    batch = V.table(spark, sf, "customer").select(k.alias("chain_id"), (-k).alias("new_id"), F.lit("new").alias("memory"), start.alias("effective_from"))
    return changes.supersede(i, batch)[0].select("memory_id", "chain_id", "version", F.unix_micros("valid_to").alias("valid_to"))


_DAYS = f"(epoch_us(timestamp '{V.NOW_ORDERS}') - epoch_us(last_accessed)) / 86400000000.0::double"
_AGED = f"aged as (select *, greatest(0, {_DAYS}) as days from items)"


@query("lifecycle", f"with {V.ITEMS_SQL}, {_AGED} select memory_id, {_LIFE} as band, round({_ITEM_SCORE}, 4) as life_score from aged")
def lifecycle(spark, sf):
    return temporal.with_lifecycle(V.items(spark, sf), V.now()).select("memory_id", "band", "life_score")


@query("archive_score", f"""with {V.ITEMS_SQL}, {_AGED} select memory_id, round(0.35 * least(days / 180.0::double, 1) + 0.3 * (5 - importance) / 4 + 0.15 * (1 - least(1, access_count / 10.0::double))
  + 0.2 * case {_LIFE} when 'decaying' then 1 when 'aging' then 0.45 else 0 end, 4) as archive_score from aged""")
def archive_score(spark, sf):
    return temporal.with_lifecycle(V.items(spark, sf), V.now()).select("memory_id", "archive_score")


@query("archive_move", f"with {V.ITEMS_SQL}, {_AGED} select memory_id, case when importance <= 3 and access_count <= 3 and {_LIFE} = 'decaying' and days >= 180 then 'archived' else 'active' end as status from aged")
def archive_move(spark, sf):
    i = V.items(spark, sf).withColumn("status", F.lit("active"))
    left, moved = temporal.archive_old(i, i.limit(0), V.now())
    return left.select("memory_id", "status").unionByName(moved.select("memory_id", "status"))


@query("reinforce", f"""with {V.ITEMS_SQL}, h as (select user_id as memory_id, count(*) as n from events group by 1)
select memory_id, access_count + coalesce(n, 0) as access_count, round(least(0.99, confidence + 0.03 * coalesce(n, 0)), 4) as confidence from items left join h using (memory_id)""")
def reinforce(spark, sf):
    i = V.items(spark, sf, False).withColumn("status", F.lit("aging"))
    hits = V.table(spark, sf, "events").select(F.col("user_id").alias("memory_id"))
    return aggregate.touch(i, hits, V.now()).select("memory_id", "access_count", "confidence")


@query("consolidate", f"""with {V.ITEMS_SQL} select chain_id, max(importance) as importance, max(confidence) as confidence, sum(access_count)::bigint as access_count, epoch_us(min(created_at)) as created_at,
  count(*) as n_sources, string_agg(memory_id::varchar, ',' order by memory_id) as derived_from from items group by 1""")
def consolidate(spark, sf):
    return aggregate.consolidate(V.items(spark, sf, False), "chain_id").withColumns({"created_at": F.unix_micros("created_at"), "derived_from": F.array_join(F.transform("derived_from", lambda x: x.cast("string")), ",")})


@query("mark_seen", """select u as entity_id, epoch_us(max(ts)) as last_seen, epoch_us(min(ts)) as first_seen, count(*) as mention_count from (select user_id as u, ts from events) group by 1""")
def mark_seen(spark, sf):
    e = V.table(spark, sf, "events").select(F.col("user_id").alias("entity_id"), F.col("ts").cast("timestamp").alias("ts"))
    blank = e.select("entity_id").distinct().withColumns({"last_seen": F.lit(None).cast("timestamp"), "first_seen": F.lit(None).cast("timestamp"), "mention_count": F.lit(0).cast("long")})
    return aggregate.mark_seen(blank, e).select("entity_id", F.unix_micros("last_seen").alias("last_seen"), F.unix_micros("first_seen").alias("first_seen"), "mention_count")


@query("entity_lifecycle", f"""with {V.ENTITIES_SQL}, x as (select *, (epoch_us(timestamp '{V.NOW_ORDERS}') - epoch_us(last_seen)) / 86400000000.0::double as d from ents),
y as (select *, case when d is null then null else greatest(d, 0) end as days from x)
select entity_id, case when ended then 'ENDED' when days is null then 'DORMANT' when days <= 30 then 'ACTIVE' when days <= 90 then 'AGING' else 'DORMANT' end as lifecycle,
  round(case when ended then 0.2 else greatest(0.2, least(1, 0.55 * coalesce(1 / (1 + ln(1 + days)), 0) + 0.3 * least(1, ln(1 + mention_count::double) / ln(21.0::double)) + 0.15 * confidence)) end, 4)::double as lifecycle_score from y""")
def entity_lifecycle(spark, sf):
    return temporal.with_entity_lifecycle(V.entities(spark, sf), V.now()).select("entity_id", "lifecycle", "lifecycle_score")


def _relations(spark, sf):
    return V.table(spark, sf, "lineitem").select(
        F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"), F.lit("SUPPLIES").alias("relation"),
        F.least(F.lit(1.0), 0.6 + 0.05 * F.col("l_linenumber")).alias("confidence"), F.col("l_returnflag").alias("evidence"), F.col("l_orderkey").alias("memory_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))


@query("relation_upsert", """select 's' || l_suppkey as source, 'p' || l_partkey as target, 'SUPPLIES' as relation, 'rel_' || substr(sha256('s' || l_suppkey || '|p' || l_partkey || '|SUPPLIES'), 1, 16) as relation_id,
  round(max(least(1.0, 0.6 + 0.05 * l_linenumber)), 4)::double as confidence, arg_max(l_returnflag, l_orderkey * 10 + l_linenumber) as evidence, least(count(distinct l_orderkey), 100)::int as n_memory
from lineitem where 0.6 + 0.05 * l_linenumber >= 0.65 group by l_suppkey, l_partkey""")
def relation_upsert(spark, sf):
    rel = _relations(spark, sf)
    old = spark.createDataFrame([], "source string, target string, relation string, confidence double, evidence string, memory_ids array<long>")
    return aggregate.upsert_relations(old, rel, V.ends(spark, sf)).select("source", "target", "relation", "relation_id", F.round("confidence", 4).alias("confidence"), "evidence", F.size("memory_ids").alias("n_memory"))


def _graph(spark, sf):
    i = V.items(spark, sf, False).withColumns({"memory_id": F.concat(F.lit("m"), "memory_id"), "supersedes": F.lit(None).cast("string"), "superseded_by": F.lit(None).cast("string"), "derived_from": F.array().cast("array<string>")})
    mentions = V.table(spark, sf, "lineitem").select(F.concat(F.lit("m"), "l_orderkey").alias("memory_id"), F.concat(F.lit("p"), "l_partkey").alias("entity_id"))
    rel = _relations(spark, sf).groupBy("source", "target", "relation").agg(F.max("confidence").alias("confidence")).withColumn("directed", F.lit(True))
    return graph.build_edges(i, mentions, rel, rel.limit(0))


_EDGES_SQL = f"""{V.ITEMS_SQL}, edges as (
select distinct 'm' || l_orderkey as source, 'p' || l_partkey as target, 'MEMORY_HAS_ENTITY' as type, 'MENTIONS' as relation, 1.0::double as confidence from lineitem
union all select 's' || l_suppkey, 'p' || l_partkey, 'ENTITY_RELATION', 'SUPPLIES', round(max(least(1.0, 0.6 + 0.05 * l_linenumber)), 4)::double from lineitem group by l_suppkey, l_partkey
union all select * from (select 'm' || memory_id, 'm' || lead(memory_id) over (partition by chain_id order by version) as t, 'TEMPORAL_SAME_CHAIN', 'NEXT_VERSION', 1.0::double from items) where t is not null)"""


@query("edges", f"with {_EDGES_SQL} select * from edges")
def edges(spark, sf):
    return _graph(spark, sf).withColumn("confidence", F.round("confidence", 4))


@query("nodes", "select 'm' || o_orderkey as id, 'memory' as kind from orders union all select 'p' || p_partkey, 'entity' from part")
def nodes(spark, sf):
    i = V.table(spark, sf, "orders").select(F.concat(F.lit("m"), "o_orderkey").alias("memory_id"))
    return graph.build_nodes(i, V.table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("entity_id")))


@query("neighbors", f"""with {_EDGES_SQL}, e as (select source as id, target as neighbor, 'out' as dir, type, relation from edges union all select target, source, 'in', type, relation from edges),
f as (select id, neighbor, min(struct_pack(dir := dir, type := type, relation := relation)) as e from e where id in (select 'p' || p_partkey from part) group by 1, 2)
select id, neighbor, e.dir as dir, e.type as type, e.relation as relation, place from (select *, row_number() over (partition by id order by e.dir, e.type, e.relation, neighbor)::int as place from f) where place <= 10""")
def neighbors(spark, sf):
    ids = V.table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"))
    return graph.neighbors(_graph(spark, sf), ids, 10)


@query("subgraph", f"""with {V.ITEMS_SQL}, l as materialized (select distinct l_orderkey, l_suppkey, l_partkey from lineitem where l_partkey % 50 = 0 and l_partkey in (select p_partkey from part)), near as materialized (select distinct l_orderkey as k from l),
nxt as (select memory_id as a, lead(memory_id) over (partition by chain_id order by version) as b from items)
select distinct 'm' || l_orderkey as source, 'p' || l_partkey as target, 'MEMORY_HAS_ENTITY' as type, 'MENTIONS' as relation from l
union all select distinct 's' || l_suppkey, 'p' || l_partkey, 'ENTITY_RELATION', 'SUPPLIES' from l
union all select 'm' || a, 'm' || b, 'TEMPORAL_SAME_CHAIN', 'NEXT_VERSION' from nxt where a in (select k from near) and b in (select k from near)""")
def subgraph(spark, sf):
    ids = V.table(spark, sf, "part").where("p_partkey % 50 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("id"))
    return graph.subgraph(_graph(spark, sf), ids)[1].select("source", "target", "type", "relation")


@query("graph_view", """with n as (select distinct 'm' || o_orderkey as id, 'memory' as kind from lineitem join orders on l_orderkey = o_orderkey where l_partkey % 50 = 0 and l_partkey in (select p_partkey from part) and o_orderstatus <> 'F'
union all select 'p' || p_partkey, 'entity' from part where p_partkey % 50 = 0) select id, kind from n order by id limit 50""")
def graph_view(spark, sf):
    """The first 50 nodes around the asked parts, facts of finished orders being archived."""
    done = V.table(spark, sf, "orders").select(F.concat(F.lit("m"), "o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("archived"))
    ids = V.table(spark, sf, "part").where("p_partkey % 50 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("id"))
    return graph.view(nodes(spark, sf).join(done, "id", "left"), _graph(spark, sf), ids, archived=False)[0].select("id", "kind")


@query("token_sim", r"""with n as (select distinct p_name as name from part), t as (select name, list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(name), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+'), lambda x: x <> '')) as w from n)
select a.name as a, b.name as b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 4)::double as jaccard from t a join t b on a.name < b.name and len(list_intersect(a.w, b.w)) > 0""")
def token_sim(spark, sf):
    from factweave.operators.resolve import token_pairs

    n = V.table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct()
    return token_pairs(n, n).where("a < b").select("a", "b", F.round("jaccard", 4).alias("jaccard"))


@query("last_turns", "select conv_id, turn, role from (select *, row_number() over (partition by conv_id, role = 'system' order by turn desc) as r from conversations) where role = 'system' or r <= 4")
def last_turns(spark, sf):
    return windows.last_turns(V.table(spark, sf, "conversations")).select("conv_id", "turn", "role")


@query("budget_pack", r"""with recursive r as (select conv_id, turn, len(string_split(text, ' '))::bigint as cost, row_number() over (partition by conv_id order by turn desc) as i from conversations),
f as (select conv_id, 0::bigint as i, 0::bigint as used, 0::bigint as n from r group by 1
union all select f.conv_id, f.i + 1, case when used + cost <= 300 then used + cost else used end, case when used + cost <= 300 then n + 1 else n end from f join r on r.conv_id = f.conv_id and r.i = f.i + 1)
select conv_id, arg_max(used, i) as used, arg_max(n, i)::int as n from f group by 1""")
def budget_pack(spark, sf):
    t = V.table(spark, sf, "conversations").select("conv_id", "turn", F.size(F.split("text", " ")).alias("cost"))
    return windows.pack_by_budget(t, "conv_id", 300, "turn", "cost", "turn").select("conv_id", "used", F.size("items").alias("n"))


@query("chunks", "select doc_id, k::int as place, substr(text, k::int * 1000 + 1, 1000) as chunk from (select doc_id, text, unnest(range(greatest(1, ceil(length(text) / 1000.0))::bigint)) as k from documents)")
def chunks(spark, sf):
    return windows.chunks(V.table(spark, sf, "documents"), "text", 1000, "doc_id")


@query("relation_keys", "select p_partkey, 'rel_' || substr(sha256(p_name || '|' || p_brand || '|' || p_type), 1, 16) as relation_id from part")
def relation_keys(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", C.relation_id(F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("relation_id"))
