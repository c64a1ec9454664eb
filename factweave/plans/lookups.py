"""Queries over look-ups, approvals and migrations, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.operators import aggregate, approvals, lookup, resolve
from factweave.plans import views as V
from factweave.sources import stores

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


@query("entity_find", r"""with n as (select p_partkey as entity_id, lower(trim(regexp_replace(p_name, '\s+', ' ', 'g'))) as k from part union select p_partkey, lower(p_brand) from part)
select p.p_partkey as query_id, min(entity_id) as entity_id from part p join n on n.k = lower(case when p_partkey % 2 = 0 then p.p_name else p.p_brand end) group by 1""")
def entity_find(spark, sf):
    """Every part asked for by its name (even keys) or its brand, an alias."""
    asked = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.col("p_brand"))
    q = V.table(spark, sf, "part").select(F.col("p_partkey").alias("query_id"), F.upper(asked).alias("q"))
    return lookup.find_entity(q, V.entities(spark, sf)).select("query_id", "entity_id")


@query("entity_search", r"""with w as (select p_partkey, lower(p_name) as nm, lower(p_brand) as br, trim(lower(left(p_name, length(p_name) - 2))) as cut from part),
t as (select k, list_distinct(list_filter(regexp_split_to_array(regexp_replace(k, '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+'), lambda x: x <> '')) as ws from (select nm as k from w union select br from w union select cut from w)),
q as (select p_partkey as query_id, case p_partkey % 3 when 0 then nm when 1 then br else cut end as qk from w),
""" + V.ENTITIES_SQL.strip() + r""", n as (select entity_id, mention_count, unnest([nm, br]) as nk from ents join w on p_partkey = entity_id),
p as (select a.k as qk, b.k as nk, round(case when a.k = b.k then 1 when contains(b.k, a.k) or contains(a.k, b.k) then 0.85 else len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws))) end, 4)::double as score
  from t a join t b on len(list_intersect(a.ws, b.ws)) > 0 or contains(b.k, a.k) or contains(a.k, b.k) where a.k in (select qk from q) and b.k in (select nk from n)),
s as (select qk, entity_id, any_value(mention_count) as mention_count, max(score) as score from p join n using (nk) group by 1, 2),
r as (select *, row_number() over (partition by qk order by score desc, mention_count desc, entity_id)::int as rank from s)
select query_id, entity_id, score, rank from q join r using (qk) where rank <= 5""")
def entity_search(spark, sf):
    """Every part asked for by the whole name, by the brand (an alias) or by a name whose last two letters are missing, so that its last word is only part of one."""
    k = F.col("p_partkey")
    asked = F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, F.col("p_brand")).otherwise(F.expr("left(p_name, length(p_name) - 2)"))
    return lookup.search_entities(V.table(spark, sf, "part").select(k.alias("query_id"), asked.alias("q")), V.entities(spark, sf)).select("query_id", "entity_id", "score", "rank")


@query("entity_parts", """with c as (select c_custkey as entity_id, lower(c_name) as nm from customer), q as (select c_custkey as query_id, lower(right(c_name, case when c_custkey % 3 = 0 then 5 when c_custkey % 3 = 1 then 3 else 2 end)) as k from customer)
select query_id, min(entity_id) as entity_id from (select distinct k from q) join c on contains(nm, k) join q using (k) group by query_id having count(*) = 1""")
def entity_parts(spark, sf):
    """Every customer asked for by the end of the name: five, three or two characters. A query that lies in the names of several finds none."""
    k = F.col("c_custkey")
    c = V.table(spark, sf, "customer")
    q = c.select(k.alias("query_id"), F.expr("right(c_name, case when c_custkey % 3 = 0 then 5 when c_custkey % 3 = 1 then 3 else 2 end)").alias("q"))
    return lookup.find_by_part(q, c.select(k.alias("entity_id"), F.col("c_name").alias("name"), F.lit(None).cast("array<string>").alias("aliases")))


@query("entity_relations", """select l_suppkey as source, l_partkey as target, s_name as source_name, p_name as target_name, count(*) as n from lineitem join supplier on s_suppkey = l_suppkey join part on p_partkey = l_partkey group by all""")
def entity_relations(spark, sf):
    rel = V.table(spark, sf, "lineitem").groupBy(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target")).agg(F.count("*").alias("n"))
    ends = V.table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("entity_id"), F.col("s_name").alias("name")).unionByName(V.table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("entity_id"), F.col("p_name").alias("name")))
    return lookup.relation_names(rel, ends).select(F.substring("source", 2, 20).cast("long").alias("source"), F.substring("target", 2, 20).cast("long").alias("target"), "source_name", "target_name", "n")


_APPR = """a as (select event_id as approval_id, ts::date::varchar as plan_id, user_id as actor, event_type as role, user_id % 7 = 0 as own, event_id % 9 <> 0 as granted, event_id % 11 = 0 as forged, ts::timestamp as issued_at, ts::timestamp + interval 30 day as expires_at from events),
v as (select *, case when not granted then 'NOT_GRANTED' when forged then 'FINGERPRINT_MISMATCH' when expires_at <= timestamp '2024-02-10' then 'EXPIRED' when issued_at > timestamp '2024-02-10' then 'ISSUED_IN_FUTURE'
  when own then 'SELF_APPROVAL' when role not in ('click', 'purchase', 'signup') then 'ROLE_NOT_ALLOWED' end as failure from a)"""


def _approvals(spark, sf):
    e = V.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    day = F.date_format("ts", "yyyy-MM-dd")
    a = e.select(F.col("event_id").alias("approval_id"), day.alias("plan_id"), F.col("user_id").alias("actor"), F.col("event_type").alias("role"), F.when(F.col("user_id") % 7 == 0, F.col("user_id")).otherwise(-1).alias("requester"),
                 (F.col("event_id") % 9 != 0).alias("granted"), F.when(F.col("event_id") % 11 == 0, "forged").otherwise(F.md5(day)).alias("fingerprint"), F.col("ts").alias("issued_at"), (F.col("ts") + F.expr("interval 30 days")).alias("expires_at"))
    plans = a.select("plan_id", F.md5("plan_id").alias("plan_fingerprint")).distinct()
    return approvals.validate_approvals(a, plans, V.now("2024-02-10"), ("click", "purchase", "signup"))


@query("approval_checks", f"with {_APPR} select approval_id, failure from v")
def approval_checks(spark, sf):
    return _approvals(spark, sf).select("approval_id", "failure")


@query("approval_quorum", f"""with {_APPR}, p as (select plan_id, count(*) as n_valid, count(distinct actor) as n_actors, count(distinct role) as r from v where failure is null group by 1) select plan_id, n_valid, n_actors, n_actors >= 40 and r = 3 as met from p""")
def approval_quorum(spark, sf):
    return aggregate.quorum(_approvals(spark, sf), ("click", "purchase", "signup"), 40).select("plan_id", "n_valid", "n_actors", "met")


@query("migrate", """select p_name as memory, min(p_partkey) as ord, 5 as importance from part group by p_name""")
def migrate(spark, sf):
    return stores.migrate_legacy(V.table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("text"))).select("memory", "ord", "importance")


def candidates(spark, sf):
    """A candidate per part: its name as it is, with a generic word, or with its first word changed."""
    p, k = V.table(spark, sf, "part"), F.col("p_partkey")
    name = F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, F.concat("p_name", F.lit(" tool"))).otherwise(F.regexp_replace("p_name", r"^\S+", "plain"))
    return p.select(k.alias("candidate_id"), name.alias("name"), _entity_type(F.col("p_size") + 1).alias("type"))


def _entity_type(n):
    return F.element_at(F.array(*[F.lit(x) for x in ("PRODUCT", "SOFTWARE", "PLACE", "OTHER")]), n % 4 + 1)


def _entities(spark, sf, archived: bool):
    p = V.table(spark, sf, "part").where((F.col("p_size") % 2 == 1) if archived else (F.col("p_size") % 2 == 0))
    return p.select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.array("p_brand").alias("aliases"), _entity_type(F.col("p_size")).alias("type"))


@query("entity_resolve")
def entity_resolve(spark, sf):
    return resolve.resolve(candidates(spark, sf), _entities(spark, sf, False))


@query("entity_core", """with c as (select p_partkey as k, p_name, ['PRODUCT', 'SOFTWARE', 'PLACE', 'OTHER'][(p_size + 1) % 4 + 1] as ct from part where p_partkey % 3 <> 2),
e as (select p_partkey as entity_id, p_name, ['PRODUCT', 'SOFTWARE', 'PLACE', 'OTHER'][p_size % 4 + 1] as et from part where p_size % 2 = 0),
s as (select k, entity_id, case when ct = et and ct <> 'OTHER' then 1.0 else 0.98 end::double as score from c join e using (p_name))
select k as candidate_id, entity_id, score, 'MATCHED' as decision from (select *, row_number() over (partition by k order by score desc, entity_id) as r from s) where r = 1""")
def entity_core(spark, sf):
    """Candidates that a core key decides: those named as an entity, with or without a generic word."""
    c = candidates(spark, sf).where("candidate_id % 3 <> 2")
    return resolve.resolve(c, _entities(spark, sf, False)).where("score >= 0.98").select("candidate_id", "entity_id", "score", "decision")


@query("entity_recover")
def entity_recover(spark, sf):
    return resolve.recover_entities(candidates(spark, sf), _entities(spark, sf, True))


@query("entity_ingest")
def entity_ingest(spark, sf):
    return resolve.ingest_entities(candidates(spark, sf), _entities(spark, sf, False), _entities(spark, sf, True))
