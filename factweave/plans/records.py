"""Queries over record rules, actions, logs, conflicts and the audits of entities, relations and the graph, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factweave.functions import columns as C
from factweave.functions.canonical import op_key
from factweave.operators import aggregate, approvals, audit, changes, diff, graph, lookup, reconcile, resolve, temporal, vector, windows
from factweave.plans import governance as G
from factweave.plans import views as V
from factweave.sources import shared
from factweave.streaming import ledger

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _pick(values: tuple[str, ...], n):
    return F.element_at(F.array(*[F.lit(x) for x in values]), (n % len(values) + 1).cast("int"))


@query("field_rules", """select o_orderkey, round(greatest(0.2, least(0.99, 0.7 + 0.06 * (o_orderkey % 5) + least(0.06, 0.01 * (o_orderkey % 9)))), 4)::double as confidence,
  ['SOFTWARE', 'SOFTWARE', 'TECHNOLOGY', 'ORGANIZATION', 'PERSON', 'PLACE', 'OTHER'][o_orderkey % 7 + 1] as entity_type, ['RELATED_TO', 'USED_FOR', 'WORKS_WITH', 'LEADS_TO', 'PART_OF'][o_orderkey % 5 + 1] as relation,
  ['ACTIVE', 'AGING', 'DORMANT', 'ACTIVE'][o_orderkey % 4 + 1] as lifecycle, case when o_orderkey % 2 = 0 then 'm' || o_orderkey else 'e' || o_orderkey end as ref,
  ['learning', 'tool', 'goal', 'project', 'other'][o_orderkey % 5 + 1] as kind from orders""")
def field_rules(spark, sf):
    k = F.col("o_orderkey")
    body = F.to_json(F.struct(F.concat(F.lit("m"), k).alias("memory_id"), F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("e"), k)).alias("entity_id")))
    return V.table(spark, sf, "orders").select(
        k, C.effective_confidence(0.7 + 0.06 * (k % 5), k % 9).alias("confidence"), C.norm_entity_type(_pick((" app", "Tool", "tech", "company", "person", "Place ", "x-y"), k)).alias("entity_type"),
        C.canonical_relation(_pick(("relates to", "use-for", "works_with", " results in", "part of"), k)).alias("relation"), C.norm_enum(_pick(("active", " aging ", "dormant", "??"), k), C.LIFECYCLES, "ACTIVE").alias("lifecycle"),
        C.result_ref(body).alias("ref"), C.guess_type(_pick(("Learning a goal", "the software project", "a GOAL here", "one project", "plain"), k)).alias("kind"))


@query("aliases", "select p_partkey, p_brand || '|' || p_type as aliases from part")
def aliases(spark, sf):
    names = F.array(F.upper("p_name"), F.concat(F.lit("  "), "p_brand"), F.lit(""), F.col("p_type"), F.lower("p_brand"))
    return V.table(spark, sf, "part").select("p_partkey", F.array_join(C.clean_aliases(names, F.col("p_name")), "|").alias("aliases"))


@query("causal_merge", """select l_orderkey as source, l_partkey as target, 'CAUSES' as relation, max(l_linenumber) as line, arg_max(l_returnflag, l_extendedprice) as evidence
from lineitem where l_linenumber >= 3 and l_orderkey <> l_partkey group by 1, 2""")
def causal_merge(spark, sf):
    links = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"), F.lit("CAUSES").alias("relation"), (0.55 + 0.06 * F.col("l_linenumber")).alias("confidence"), F.col("l_returnflag").alias("evidence"), F.col("l_extendedprice").alias("seq"))
    return aggregate.merge_causal(links).select("source", "target", "relation", F.round((F.col("confidence") - 0.55) / 0.06).cast("int").alias("line"), "evidence")


@query("archive_stats", "select event_type as state, count(*) as n from events group by rollup (event_type)")
def archive_stats(spark, sf):
    return aggregate.archive_stats(V.table(spark, sf, "events"), "event_type")


@query("store_counts", "select 'items' as store, count(*) as n from orders union all select 'entities', count(*) from part union all select 'operations', count(*) from events")
def store_counts(spark, sf):
    return aggregate.store_counts({"items": V.table(spark, sf, "orders"), "entities": V.table(spark, sf, "part"), "operations": V.table(spark, sf, "events")})


@query("violation_codes", f"select key, string_agg(distinct code, ',' order by code) as codes from ({G.ORACLE['audit_operations']}) group by 1")
def violation_codes(spark, sf):
    return aggregate.violation_codes(audit.audit_operations(G.ops(spark, sf)), "key").select("key", F.array_join("codes", ",").alias("codes"))


@query("requirements", """select user_id as plan_id, max(event_id % 3 + 1)::int as min_approvals, bool_or(event_id % 50 = 0) as distinct_actors, bool_and(event_id % 20 <> 0) as allow_delegation,
  string_agg(distinct event_type, ',' order by event_type) as required_roles, case when min(event_id % 2) <> max(event_id % 2) then 'b,c' when min(event_id % 2) = 0 then 'a,b,c' else 'b,c,d' end as allowed_roles from events group by 1""")
def requirements(spark, sf):
    k = F.col("event_id")
    words = lambda *x: F.array(*[F.lit(w) for w in x])
    r = V.table(spark, sf, "events").select(F.col("user_id").alias("plan_id"), (k % 3 + 1).cast("int").alias("min_approvals"), (k % 50 == 0).alias("distinct_actors"), (k % 20 != 0).alias("allow_delegation"),
                                            F.array("event_type").alias("required_roles"), F.when(k % 2 == 0, words("a", "b", "c")).otherwise(words("b", "c", "d")).alias("allowed_roles"))
    return aggregate.combine_requirements(r).withColumns({"required_roles": F.array_join("required_roles", ","), "allowed_roles": F.array_join("allowed_roles", ",")})


@query("entity_timeline", f"with {V.ITEMS_SQL} select chain_id as entity_id, version, epoch_us(valid_from) as valid_from, valid_to is null as current, version::int as place from items")
def entity_timeline(spark, sf):
    i = V.items(spark, sf, False)
    snap = F.struct(F.struct("version", F.col("memory_id").cast("string").alias("name"), "valid_from", "valid_to").alias("snapshot"))
    e = i.groupBy(F.col("chain_id").alias("entity_id")).agg(
        F.collect_list(F.when(F.col("valid_to").isNotNull(), snap)).alias("history"), F.max("version").alias("version"), F.max_by(F.col("memory_id").cast("string"), "version").alias("name"), F.max("valid_from").alias("valid_from"))
    return windows.entity_timeline(e.withColumn("valid_to", F.lit(None).cast("timestamp"))).select("entity_id", "version", F.unix_micros("valid_from").alias("valid_from"), "current", "place")


@query("newest_events", "select user_id, event_id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 3")
def newest_events(spark, sf):
    return windows.keep_last(V.table(spark, sf, "events"), 3, "user_id", F.col("ts").desc(), F.col("event_id").desc()).select("user_id", "event_id")


@query("first_events", "select user_id, event_id from events qualify row_number() over (partition by user_id order by ts, event_id) = 1")
def first_events(spark, sf):
    return windows.first_per_key(V.table(spark, sf, "events"), "user_id", F.col("ts"), F.col("event_id")).select("user_id", "event_id")


@query("restore_items", """select o_orderkey as memory_id, 'active' as store from orders where o_orderkey % 5 <> 0 or o_orderkey % 15 = 0
union all select o_orderkey, 'archive' from orders where o_orderkey % 5 = 0 and (o_orderkey % 15 <> 0 or o_orderkey % 45 = 0)""")
def restore_items(spark, sf):
    """Archived facts of every third key come back, but for those that are active already, which are refused."""
    o, k = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("memory_id")), F.col("memory_id")
    frame = lambda on: o.where(on).withColumns({"status": F.lit("x"), "last_accessed": F.lit(None).cast("timestamp")})
    active, rest = temporal.restore(frame((k % 5 != 0) | (k % 45 == 0)), frame(k % 5 == 0), o.where(k % 3 == 0), V.now())
    return active.select("memory_id", F.lit("active").alias("store")).unionByName(rest.select("memory_id", F.lit("archive").alias("store")))


@query("add_items", """with b as (select p_partkey as ord, case when p_partkey % 50 = 0 then '' else p_name end as memory from part), r as (select *, row_number() over (partition by memory order by ord) as n from b)
select ord, case when memory = '' then 'BLANK' when memory in (select p_name from part where p_size = 1) or n > 1 then 'DUPLICATE' when memory in (select p_name from part where p_size = 2) then 'RESTORE' else 'ADDED' end as outcome from r""")
def add_items(spark, sf):
    p = V.table(spark, sf, "part")
    held = lambda n: p.where(F.col("p_size") == n).select(F.col("p_name").alias("memory"))
    batch = p.select(F.col("p_partkey").alias("ord"), F.when(F.col("p_partkey") % 50 == 0, "  ").otherwise(F.concat("p_name", F.lit(" "))).alias("memory"))
    return temporal.add_items(held(1), held(2), batch).select("ord", "outcome")


@query("end_items", f"""with {V.ITEMS_SQL} select memory_id, epoch_us(case when memory_id % 8 = 4 then valid_from + interval 5 day else valid_to end) as valid_to, case when memory_id % 8 = 4 then 'ended' else 'current' end as temporal_status from items""")
def end_items(spark, sf):
    i = V.items(spark, sf, False).withColumn("temporal_status", F.lit("current"))
    k = F.col("memory_id")
    batch = i.where(k % 4 == 0).select("memory_id", F.when(k % 8 == 4, F.col("valid_from") + F.expr("interval 5 days")).otherwise(F.col("valid_from")).alias("ended_at"))
    return changes.end_items(i, batch).select("memory_id", F.unix_micros("valid_to").alias("valid_to"), "temporal_status")


@query("evolve_entities", """select p_partkey as entity_id, case when p_partkey % 3 = 0 then p_name || ' new' else p_name end as name, case when p_partkey % 3 <> 2 then 2 else 1 end::int as version, case when p_partkey % 3 <> 2 then 1 else 0 end::int as n_history,
  case when p_partkey % 3 = 0 then p_brand || '|' || p_name else p_brand end as aliases, case when p_partkey % 6 = 0 then 'SOFTWARE' else 'PRODUCT' end as type, p_partkey % 3 = 1 as ended from part""")
def evolve_entities(spark, sf):
    k, none = F.col("p_partkey"), F.lit(None).cast("timestamp")
    empty = F.array().cast("array<struct<snapshot:struct<version:int,name:string,valid_from:timestamp,valid_to:timestamp>>>")
    p = V.table(spark, sf, "part")
    e = p.select(k.alias("entity_id"), F.col("p_name").alias("name"), F.lit(1).alias("version"), empty.alias("history"), F.array("p_brand").alias("aliases"), F.lit("PRODUCT").alias("type"), V.now("2000-01-01").alias("valid_from"), none.alias("valid_to"))
    b = p.where(k % 3 != 2).select(k.alias("entity_id"), F.when(k % 3 == 0, "CHANGE").otherwise("END").alias("action"), F.concat("p_name", F.lit(" new")).alias("new_name"), F.when(k % 6 == 0, "software").otherwise("odd").alias("new_type"), V.now().alias("effective"))
    return changes.evolve_entities(e, b)[0].select("entity_id", "name", "version", F.size("history").alias("n_history"), F.array_join("aliases", "|").alias("aliases"), "type", F.col("valid_to").isNotNull().alias("ended"))


def _actions(spark, sf):
    e = V.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    u, k, kind = F.col("user_id"), F.col("event_id"), F.col("event_type")
    fact = F.concat(F.lit("fact "), u)
    active = e.select(fact.alias("memory")).distinct().withColumns({"valid_from": V.now("2024-01-01"), "valid_to": F.lit(None).cast("timestamp"), "status": F.lit("active")})
    archive = e.where(u % 5 == 0).select(F.concat(F.lit("old "), u).alias("memory")).distinct().withColumns({"valid_from": V.now("2023-01-01"), "valid_to": V.now("2023-06-01"), "status": F.lit("archived")})
    batch = e.select(
        k.alias("ord"), F.when(kind == "signup", "add").when(kind == "click", F.when(k % 7 == 0, "ADD").otherwise("UPDATE")).when(kind == "view", "look").when(kind == "purchase", "END").otherwise("DELETE").alias("action"),
        F.when(kind == "signup", F.when(u % 3 == 0, F.concat(F.lit("old "), u)).otherwise(F.concat(F.lit("new "), u))).when(kind == "click", F.concat(F.lit("changed "), k)).alias("memory_text"),
        F.when((kind == "signup") | ((kind == "error") & (k % 6 == 0)), "").otherwise(fact).alias("old_memory"), F.lit(None).cast("string").alias("consolidation_memory"), F.array().cast("array<string>").alias("targets"),
        F.when((kind == "click") & (k % 4 == 0), V.now("2023-01-01")).otherwise(F.col("ts")).alias("effective_from"), F.col("ts").alias("effective_to"))
    return active, archive, batch


_ACTIONS_SQL = """b as (select event_id as ord, user_id as u, event_type as t, event_id % 7 = 0 as implied, 'fact ' || user_id as old, case when event_type = 'signup' then case when user_id % 3 = 0 then 'old ' else 'new ' end || user_id else 'changed ' || event_id end as txt,
  case event_type when 'signup' then 'ADD' when 'click' then 'UPDATE' when 'view' then 'IGNORE' when 'purchase' then 'END' else 'DELETE' end as route, ts::timestamp as ts, event_type = 'error' and event_id % 6 = 0 as missing, event_id % 4 = 0 as early from events),
f as (select *, route <> 'IGNORE' and not missing and not (route = 'UPDATE' and early) and not (route = 'END' and ts <= timestamp '2024-01-01') as fits from b),
w as (select *, case when route in ('DELETE', 'END', 'UPDATE') then fits and ord = min(ord) filter (fits and route in ('DELETE', 'END', 'UPDATE')) over (partition by u)
  when route = 'ADD' then ord = min(ord) filter (route = 'ADD') over (partition by txt) else true end as success from f)"""


@query("apply_actions", f"""with {_ACTIONS_SQL} select ord, route, coalesce(success, false) as success, case when route = 'IGNORE' then 'ignored' when missing then 'missing_old_memory' when route = 'DELETE' then case when success then 'archived' else 'not_found' end
  when route = 'END' then case when success then 'temporal_end' else 'end_failed' end when route = 'UPDATE' then case when success then 'conflict_replaced' when implied then 'conflict_resolution_failed' else 'update_failed' end
  when success then 'added' else 'duplicate_or_rejected' end as reason from w""")
def apply_actions(spark, sf):
    return temporal.judge_actions(*_actions(spark, sf)).select("ord", "route", "success", "reason")


@query("action_stores", f"""with {_ACTIONS_SQL}, g as (select distinct old from w where success and route in ('DELETE', 'END', 'UPDATE')), n as (select distinct txt from w where success and route in ('ADD', 'UPDATE')),
a as (select distinct old as memory from b), r as (select distinct 'old ' || u as memory from b where u % 5 = 0)
select memory, 'active' as store from a where memory not in (select old from g) union all select txt, 'active' from n union all select memory, 'archive' from r where memory not in (select txt from n) union all select old, 'archive' from g""")
def action_stores(spark, sf):
    active, archive, _ = temporal.apply_actions(*_actions(spark, sf), V.now(V.NOW_EVENTS))
    return active.select("memory", F.lit("active").alias("store")).unionByName(archive.select("memory", F.lit("archive").alias("store")))


@query("consume_once", "select event_id, case when row_number() over (partition by user_id, event_type order by event_id) = 1 then 'CONSUMED' else 'REPLAY_REJECTED' end as outcome from events")
def consume_once(spark, sf):
    log = V.table(spark, sf, "events").select("event_id", F.concat_ws("|", "user_id", "event_type").alias("nonce"))
    return ledger.consume_once(log, "nonce", "event_id").select("event_id", "outcome")


@query("journal_query", "select event_id as sequence, event_type from events where event_id between 100 and 5000 and event_type in ('click', 'error')")
def journal_query(spark, sf):
    return ledger.journal_query(V.table(spark, sf, "events").select(F.col("event_id").alias("sequence"), "event_type"), 100, 5000, ("click", "error"), reverse=True)


@query("conflict_log", """with o as (select distinct lower(p_name) as c, p_brand as e from part where p_size % 2 = 0), b as (select lower(p_name) as c, p_brand as e, p_partkey as seq, ['SAME', 'POSSIBLE_CONFLICT', 'DIFFERENT'][p_size % 3 + 1] as d from part),
r as (select c, e, -1 as seq, 'DIFFERENT' as d from o union all select * from b)
select c as candidate, e as entity_id, arg_max(d, seq) as decision, case when arg_max(d, seq) = 'SAME' then 'RESOLVED' else 'ACTIVE' end as status, count(*) as n_analyses from r group by 1, 2""")
def conflict_log(spark, sf):
    p = V.table(spark, sf, "part")
    old = p.where("p_size % 2 = 0").select(F.col("p_name").alias("candidate_name"), F.col("p_brand").alias("entity_id"), F.lit("DIFFERENT").alias("decision")).distinct()
    batch = p.select(F.upper("p_name").alias("candidate_name"), F.col("p_brand").alias("entity_id"), _pick(("SAME", "POSSIBLE_CONFLICT", "DIFFERENT"), F.col("p_size")).alias("decision"), F.col("p_partkey").cast("long").alias("seq"))
    return resolve.record_conflicts(old, batch).select("candidate", "entity_id", "decision", "status", "n_analyses")


def _conflicts(spark, sf):
    p, k = V.table(spark, sf, "part"), F.col("p_partkey")
    return p.select(F.when(k % 97 == 0, "").otherwise((k - F.when(k % 89 == 0, 1).otherwise(0)).cast("string")).alias("conflict_id"), _pick(("SAME", "POSSIBLE_CONFLICT", "DIFFERENT"), k).alias("decision"),
                    F.when(k % 13 == 0, F.concat(F.lit("x"), k)).otherwise(F.concat(F.lit("s"), k % 10 + 1)).alias("entity_id"), F.when(k % 4 == 0, F.concat(F.lit("s"), k % 10 + 1)).when(k % 4 == 1, "").otherwise("other").alias("created_entity_id"),
                    F.lit("ACTIVE").alias("status"), F.lit("").alias("reason"))


_CONFLICTS_SQL = """c as (select case when k % 97 = 0 then '' else (k - case when k % 89 = 0 then 1 else 0 end)::varchar end as conflict_id, ['SAME', 'POSSIBLE_CONFLICT', 'DIFFERENT'][k % 3 + 1] as decision,
  case when k % 13 = 0 then 'x' || k else 's' || (k % 10 + 1) end as entity_id, case when k % 4 = 0 then 's' || (k % 10 + 1) when k % 4 = 1 then '' else 'other' end as created from (select p_partkey as k from part)),
g as (select * from c where conflict_id <> '')"""


@query("audit_conflicts", f"""with {_CONFLICTS_SQL} select 'CONFLICT_MISSING_ID' as code, conflict_id as key, 1::bigint as n from c where conflict_id = ''
union all select 'CONFLICT_MERGE_BLOCK_VIOLATED', conflict_id, 1 from g where decision <> 'SAME' and created = entity_id union all select 'CONFLICT_SAME_ID_MISMATCH', conflict_id, 1 from g where decision = 'SAME' and created <> '' and created <> entity_id
union all select 'CONFLICT_DUPLICATE_ID', conflict_id, count(*) - 1 from g group by 2 having count(*) > 1 union all select 'CONFLICT_ENTITY_REFERENCE_MISSING', conflict_id, count(*) from g where entity_id not in (select 's' || s_suppkey from supplier) group by 2""")
def audit_conflicts(spark, sf):
    return audit.audit_conflicts(_conflicts(spark, sf), V.table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("entity_id")))


@query("settle_conflicts", """select p_partkey::varchar as conflict_id, case when p_partkey % 6 = 0 then 'DISMISSED' when p_partkey % 6 = 2 then 'RESOLVED' else 'ACTIVE' end as status, case when p_partkey % 6 in (0, 2) then 'why' else '' end as reason from part""")
def settle_conflicts(spark, sf):
    k = F.col("p_partkey")
    c = V.table(spark, sf, "part").select(k.cast("string").alias("conflict_id"), F.lit("ACTIVE").alias("status"), F.lit("").alias("reason"))
    changes = V.table(spark, sf, "part").where(k % 2 == 0).select(k.cast("string").alias("conflict_id"), _pick(("dismissed", " Resolved", "open"), k / 2).alias("status"), F.lit(" why ").alias("reason"))
    return resolve.set_conflict_status(c, changes)


_RECOVERIES_SQL = """r as (select case when event_id % 101 = 0 then '' else (event_id - case when event_id % 97 = 0 then 1 else 0 end)::varchar end as recovery_id, user_id as entity_id, case when event_id % 4 = 0 then 'DIFFERENT' else 'SAME' end as decision,
  case when event_type = 'error' then 'BLOCKED' else 'RECOVERED' end as status from events), d as (select * from r where recovery_id <> '' and status = 'RECOVERED'),
act as (select distinct user_id as e from events where user_id % 3 <> 0), arc as (select distinct user_id as e from events where user_id % 5 = 0)"""


@query("audit_recoveries", f"""with {_RECOVERIES_SQL} select 'RECOVERY_MISSING_ID' as code, recovery_id as key, 1::bigint as n from r where recovery_id = '' union all select 'RECOVERY_DECISION_MISMATCH', recovery_id, 1 from d where decision <> 'SAME'
union all select 'RECOVERY_DUPLICATE_ID', recovery_id, count(*) - 1 from r where recovery_id <> '' group by 2 having count(*) > 1 union all select 'RECOVERED_ENTITY_STILL_ARCHIVED', recovery_id, 1 from d where entity_id in (select e from arc)
union all select 'RECOVERED_ENTITY_NOT_ACTIVE', recovery_id, count(*) from d where entity_id not in (select e from act) group by 2""")
def audit_recoveries(spark, sf):
    e, k = V.table(spark, sf, "events"), F.col("event_id")
    r = e.select(F.when(k % 101 == 0, "").otherwise((k - F.when(k % 97 == 0, 1).otherwise(0)).cast("string")).alias("recovery_id"), F.col("user_id").alias("entity_id"), F.when(k % 4 == 0, "DIFFERENT").otherwise("SAME").alias("decision"), F.when(F.col("event_type") == "error", "BLOCKED").otherwise("RECOVERED").alias("status"))
    users = e.select(F.col("user_id").alias("entity_id")).distinct()
    return audit.audit_recoveries(r, users.where("entity_id % 3 <> 0"), users.where("entity_id % 5 = 0"))


_RELATIONS_SQL = """r as (select case when o % 97 = 0 then '' else (o * 10 + l - case when o % 89 = 0 and l = 2 then 1 else 0 end)::varchar end as id, case when o % 83 = 0 then '' else 's' || s end as src, case when o % 79 = 0 then 's' || s when o % 73 = 0 then 'x' else 'p' || p end as tgt,
  o from (select l_orderkey as o, l_linenumber as l, l_suppkey as s, l_partkey as p from lineitem)), g as (select * from r where id <> ''), w as (select * from g where src <> ''),
ends as (select id, src as ref from w union all select id, tgt from w where tgt <> src), known as (select 's' || s_suppkey as e from supplier union select 'p' || p_partkey from part)"""


@query("audit_relations", f"""with {_RELATIONS_SQL} select 'RELATION_MISSING_ID' as code, id as key, 1::bigint as n from r where id = '' union all select 'RELATION_DUPLICATE_ID', id, count(*) - 1 from g group by 2 having count(*) > 1
union all select 'RELATION_MISSING_ENDPOINT', id, 1 from g where src = '' union all select 'RELATION_SELF_REFERENCE', id, 1 from w where src = tgt union all select 'RELATION_ENTITY_REFERENCE_MISSING', id, count(*) from ends where ref not in (select e from known) group by 2
union all select 'RELATION_MEMORY_REFERENCE_MISSING', id, count(*) from w where o % 71 = 0 group by 2""")
def audit_relations(spark, sf):
    o, n, s = F.col("l_orderkey"), F.col("l_linenumber"), F.concat(F.lit("s"), "l_suppkey")
    r = V.table(spark, sf, "lineitem").select(
        F.when(o % 97 == 0, "").otherwise((o * 10 + n - F.when((o % 89 == 0) & (n == 2), 1).otherwise(0)).cast("string")).alias("relation_id"), F.when(o % 83 != 0, s).otherwise(" ").alias("source"),
        F.when(o % 79 == 0, s).when(o % 73 == 0, "x").otherwise(F.concat(F.lit("p"), "l_partkey")).alias("target"), F.array(F.concat(F.lit("m"), o), F.when(o % 71 == 0, "none").otherwise("")).alias("memory_ids"))
    ents = V.table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("entity_id")).unionByName(V.table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("entity_id")))
    return audit.audit_relations(r, ents, V.table(spark, sf, "orders").select(F.concat(F.lit("m"), "o_orderkey").alias("memory_id")))


@query("audit_entities", """with a as (select case when k % 101 = 0 then '' else (k - case when k % 97 = 0 then 1 else 0 end)::varchar end as id, case when k % 7 = 0 then 'ARCHIVED' else 'ACTIVE' end as st, case when k % 3 = 0 then 'DORMANT' else 'ACTIVE' end as life, case when k % 11 = 0 then 'ended' else 'current' end as tmp, k from (select p_partkey as k from part where p_partkey % 5 <> 0)),
r as (select k::varchar as id, case when k % 15 = 0 then 'ACTIVE' else 'ARCHIVED' end as st, 'ENDED' as life, k from (select p_partkey as k from part where p_partkey % 5 = 0) union all select k::varchar, 'ARCHIVED', 'ENDED', k from (select p_partkey as k from part where p_partkey % 50 = 1)), g as (select * from a where id <> '')
select 'ENTITY_MISSING_ID' as code, id as key, 1::bigint as n from a where id = '' union all select 'ACTIVE_ENTITY_MARKED_ARCHIVED', id, 1 from g where st = 'ARCHIVED' union all select 'ENTITY_HISTORY_INVALID_VERSION', id, 1 from g where k % 17 = 0
union all select 'ENTITY_HISTORY_CURRENT_VERSION_COLLISION', id, 1 from g where k % 19 = 0 and k % 17 <> 0 union all select 'ENTITY_ENDED_LIFECYCLE_MISMATCH', id, 1 from g where tmp = 'ended' union all select 'ENTITY_ARCHIVE_LIFECYCLE_MISMATCH', id, 1 from g where st = 'ARCHIVED' and life = 'ACTIVE'
union all select 'ARCHIVE_INVALID_LIFECYCLE', id, 1 from g where st = 'ARCHIVED' and life = 'ACTIVE' union all select 'ARCHIVE_ENTITY_NOT_ARCHIVED', id, 1 from r where st <> 'ARCHIVED' union all select 'ENTITY_DUPLICATE_ID_ACTIVE', id, count(*) - 1 from g group by 2 having count(*) > 1
union all select distinct 'ENTITY_ACTIVE_ARCHIVE_OVERLAP', id, 1 from g where id in (select id from r) union all select 'ARCHIVE_ENTITY_ACTIVE_STATE_MISMATCH', id, 1 from g where st = 'ACTIVE' and id in (select id from r)""")
def audit_entities(spark, sf):
    p, k = V.table(spark, sf, "part"), F.col("p_partkey")
    versions = F.array(F.lit(1), F.when(k % 17 == 0, F.lit(None)).when(k % 19 == 0, 3).otherwise(2))
    cols = lambda key, state, life, tmp: (key.alias("entity_id"), state.alias("archive_state"), life.alias("lifecycle_status"), tmp.alias("temporal_status"), versions.alias("history_versions"), F.lit(3).alias("version"))
    a = p.where(k % 5 != 0).select(*cols(F.when(k % 101 == 0, "").otherwise((k - F.when(k % 97 == 0, 1).otherwise(0)).cast("string")), F.when(k % 7 == 0, "ARCHIVED").otherwise("ACTIVE"), F.when(k % 3 == 0, "DORMANT").otherwise("ACTIVE"), F.when(k % 11 == 0, "ended").otherwise("current")))
    old = lambda on, state: p.where(on).select(*cols(k.cast("string"), state, F.lit("ENDED"), F.lit("current")))
    return audit.audit_entities(a, old(k % 5 == 0, F.when(k % 15 == 0, "ACTIVE").otherwise("ARCHIVED")).unionByName(old(k % 50 == 1, F.lit("ARCHIVED"))))


@query("audit_graph", """with n as (select case when k % 101 = 0 then '' else 'm' || (k - case when k % 97 = 0 then 1 else 0 end) end as id, k from (select o_orderkey as k from orders)), e as (select 'm' || l_orderkey || '>' || t as edge, 'm' || l_orderkey as s, t from (select l_orderkey, case when l_orderkey % 31 = 0 then 'none' else 'p' || l_partkey end as t from lineitem)),
ids as (select id from n union select 'p' || p_partkey from part), refs as (select edge, s as ref from e union all select edge, t from e)
select 'GRAPH_NODE_MISSING_ID' as code, id as key, 1::bigint as n from n where id = '' union all select 'GRAPH_DUPLICATE_NODE_ID', id, count(*) - 1 from n where id <> '' group by 2 having count(*) > 1
union all select 'GRAPH_MEMORY_NODE_MISSING_SOURCE', id, count(*) from n where id <> '' and id not in (select 'm' || o_orderkey from orders where o_orderkey % 41 <> 0) group by 2
union all select 'GRAPH_EDGE_NODE_MISSING', edge, count(*) from refs where ref not in (select id from ids) group by 2 union all select 'GRAPH_MEMORY_ENTITY_MEMORY_MISSING', edge, count(*) from e where s not in (select 'm' || o_orderkey from orders where o_orderkey % 41 <> 0) group by 2
union all select 'GRAPH_MEMORY_ENTITY_ENTITY_MISSING', edge, count(*) from e where t = 'none' group by 2""")
def audit_graph(spark, sf):
    nodes, edges = _faulty_graph(spark, sf)
    items = V.table(spark, sf, "orders").where("o_orderkey % 41 <> 0").select(F.concat(F.lit("m"), "o_orderkey").alias("memory_id"))
    return audit.audit_graph(nodes, edges, items, V.table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("entity_id")))


def _faulty_graph(spark, sf):
    k, n = F.col("o_orderkey"), F.col("l_orderkey")
    ents = V.table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.lit("entity").alias("kind"))
    nodes = V.table(spark, sf, "orders").select(F.when(k % 101 == 0, "").otherwise(F.concat(F.lit("m"), k - F.when(k % 97 == 0, 1).otherwise(0))).alias("id"), F.lit("memory").alias("kind")).unionByName(ents)
    edges = V.table(spark, sf, "lineitem").select(F.concat(F.lit("m"), n).alias("source"), F.when(n % 31 == 0, "none").otherwise(F.concat(F.lit("p"), "l_partkey")).alias("target"), F.lit("MEMORY_HAS_ENTITY").alias("type"))
    return nodes, edges


_LIVE = "select o_orderkey as k from orders where o_orderkey % 41 <> 0"


def _graph_stores(spark, sf):
    """Fact, entity and relation stores with the faulty graph of ``audit_graph``; some causal links lead nowhere."""
    k = F.col("o_orderkey")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    m = lambda c: F.concat(F.lit("m"), c)
    link = F.struct(m(k + 1).alias("target_memory_id"), F.lit("causes").alias("relation"), F.lit(0.8).alias("confidence"))
    items = V.table(spark, sf, "orders").where(k % 41 != 0).select(
        m(k).alias("memory_id"), F.concat(F.lit("c"), "o_custkey").alias("chain_id"), F.row_number().over(w).alias("version"), F.col("o_orderdate").cast("timestamp").alias("valid_from"),
        F.when(k % 7 == 0, m(k - 1)).alias("supersedes"), F.lit(None).cast("string").alias("superseded_by"), F.when(k % 10 == 0, F.array(link)).alias("causal_links"))
    named = V.table(spark, sf, "lineitem").where("l_orderkey % 41 <> 0").select("l_partkey", m(F.col("l_orderkey")).alias("m")).distinct().groupBy("l_partkey").agg(F.collect_list("m").alias("memory_ids"))
    part = V.table(spark, sf, "part").select("p_partkey", F.concat(F.lit("p"), "p_partkey").alias("entity_id"))
    ents = part.join(named, F.col("p_partkey") == F.col("l_partkey"), "left").select("entity_id", "memory_ids")
    p = F.col("p_partkey")
    rel = part.where(p % 3 == 0).select(F.concat(F.lit("r"), p).alias("relation_id"), "entity_id", (p % 2 == 0).alias("directed"), F.when(p >= 3, F.concat(F.lit("p"), p - 3)).otherwise(F.col("entity_id")).alias("target"))
    rel = rel.where("target <> entity_id").select("relation_id", F.col("entity_id").alias("source"), "target", F.lit("PART_OF").alias("relation"), "directed", F.lit(0.8).alias("confidence"), F.array().cast("array<string>").alias("memory_ids"))
    nodes, edges = _faulty_graph(spark, sf)
    return {"items": items, "entities": ents, "relations": rel, "nodes": nodes, "edges": edges}


@query("reconcile_graph", f"""with live as ({_LIVE}), b as (select code, sum(n)::bigint as before from ({ORACLE['audit_graph']}) group by 1
union all select 'MEMORY_CAUSAL_REFERENCE_MISSING', count(*) from live where k % 10 = 0 and k + 1 not in (select k from live))
select code, before, case when code like 'GRAPH%' then 0 else before end as after from b where before > 0""")
def reconcile_graph(spark, sf):
    """Violations of a faulty graph and of causal links before and after a reconciliation, which builds the graph anew."""
    stores = _graph_stores(spark, sf)
    derived = {name: shared.kept(stores[name], name) for name in ("items", "entities")}  # read by several groups of the audit
    done = reconcile.reconcile(stores | derived)
    return reconcile.compare(done.before, done.after)


@query("rebuilt_edges", f"""with live as ({_LIVE}), p as (select p_partkey as p from part), o as (select o_orderkey as k, lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as nxt from orders where o_orderkey % 41 <> 0)
select distinct 'm' || l_orderkey as source, 'p' || l_partkey as target, 'MEMORY_HAS_ENTITY' as type, 'MENTIONS' as relation, 1.0::double as confidence from lineitem where l_orderkey in (select k from live) and l_partkey in (select p from p)
union all select 'p' || p, 'p' || (p - 3), 'ENTITY_RELATION', 'PART_OF', 0.8::double from p where p % 3 = 0 and p - 3 in (select p from p)
union all select 'p' || (p - 3), 'p' || p, 'ENTITY_RELATION', 'PART_OF', 0.8::double from p where p % 3 = 0 and p % 2 <> 0 and p - 3 in (select p from p)
union all select 'm' || k, 'm' || (k - 1), 'TEMPORAL_SUPERSEDES', 'SUPERSEDES', 1.0::double from live where k % 7 = 0 and k - 1 in (select k from live)
union all select 'm' || k, 'm' || (k + 1), 'CAUSAL', 'CAUSES', 0.8::double from live where k % 10 = 0 and k + 1 in (select k from live)
union all select 'm' || k, 'm' || nxt, 'TEMPORAL_SAME_CHAIN', 'NEXT_VERSION', 1.0::double from o where nxt is not null""")
def rebuilt_edges(spark, sf):
    s = _graph_stores(spark, sf)
    return graph.rebuild(s["items"], s["entities"], s["relations"])[1]


@query("item_entities", "select distinct l_orderkey as memory_id, l_partkey as entity_id from lineitem where l_orderkey % 3 = 0")
def item_entities(spark, sf):
    e = V.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("entity_id")).agg(F.collect_list("l_orderkey").alias("memory_ids"))
    return lookup.entities_of_items(e, V.table(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("memory_id")))


@query("pruned_refs", "select l_orderkey, coalesce(string_agg(l_partkey::varchar, ',' order by l_linenumber, l_partkey) filter (l_partkey % 2 = 0), '') as refs from lineitem group by 1")
def pruned_refs(spark, sf):
    e = V.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("refs"))
    out = lookup.prune_refs(e, "l_orderkey", "refs", V.table(spark, sf, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("ref")))
    return out.select("l_orderkey", F.array_join(F.transform("refs", lambda x: x.cast("string")), ",").alias("refs"))


@query("found_items", "select p_partkey as query_id, min(case when p_partkey % 3 = 0 then 1 else 0 end)::int as tier, p_partkey as memory_id from part group by 1")
def found_items(spark, sf):
    p = V.table(spark, sf, "part").select(F.col("p_partkey").alias("memory_id"), F.concat("p_name", F.lit(" "), "p_partkey").alias("memory"))
    q = p.select(F.col("memory_id").alias("query_id"), F.col("memory").alias("q"))
    return lookup.find_item(q, p.where("memory_id % 3 <> 0"), p.where("memory_id % 3 = 0 or memory_id % 7 = 0")).select("query_id", "tier", "memory_id")


@query("lexical", r"""with d as (select doc_id, list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+'), lambda x: x <> '')) as w from documents)
select doc_id, round(0.7 * len(list_intersect(w, ['the', 'der', 'license', 'contact'])) / 4 + 0.3 * (doc_id % 5 + 1) / 5, 4)::double as score from d""")
def lexical(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", vector.budget_rank(F.lit("The license, der contact"), F.col("text"), F.col("doc_id") % 5 + 1).alias("score"))


@query("table_fingerprint", """with d as (select sha256('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') as d from orders), r as (select d, count(*) as n from d group by 1),
n2 as (select substr(d, 1, 2) as p, sha256(string_agg(d || ':' || n, ',' order by d)) as h from r group by 1), n1 as (select substr(p, 1, 1) as p, sha256(string_agg(p || ':' || h, ',' order by p)) as h from n2 group by 1)
select sha256((select sha256(string_agg(p || ':' || h, ',' order by p)) from n1)) as fingerprint""")
def table_fingerprint(spark, sf):
    return diff.fingerprint(V.table(spark, sf, "orders"), "o_orderstatus", "o_orderkey", depth=2)


@query("differing_ranges", """with x as (select o_orderkey as k, o_totalprice, substr(sha256(o_orderkey::varchar), 1, 2) as prefix, o_orderkey % 4001 = 7 as changed, o_orderkey % 5003 = 11 as gone from orders)
select prefix, min(k) as low, max(k) as high, count(*)::bigint as rows_before, count(*) filter (not gone)::bigint as rows_after from x group by 1 having bool_or(changed or gone)""")
def differing_ranges(spark, sf):
    """A few rows of the orders are changed or missing: the ranges that hold them."""
    o, k = V.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_comment" if "o_comment" in V.table(spark, sf, "orders").columns else "o_orderstatus"), F.col("o_orderkey")
    after = o.where(k % 5003 != 11).withColumn("o_totalprice", F.col("o_totalprice") + F.when(k % 4001 == 7, 1).otherwise(0))
    return diff.differing(o, after, "o_orderkey", depth=2)


@query("nested_diff", """with n as (select o_orderkey as k, o_totalprice as price, o_orderstatus as st, count(*) as n, arg_min(l_quantity, l_linenumber) as q1, arg_max(l_partkey, l_linenumber) as plast, arg_max(l_quantity, l_linenumber) as qlast from orders join lineitem on l_orderkey = o_orderkey group by all)
select k, '$.info.price' as path, 'value_changed' as change from n where k % 5 = 0 union all select k, '$.lines[' || (n - 1) || ']', 'removed' from n where k % 5 = 1
union all select k, '$.lines[0].qty', 'value_changed' from n where k % 5 = 2 union all select k, '$.info.status', 'type_changed' from n where k % 5 = 3
union all select k, '$.lines[' || n || ']', 'added' from n where k % 5 = 4 and k % 2 = 0 union all select k, '$.tags.b', 'added' from n where k % 7 = 0 union all select k, '$.tags.a', 'removed' from n where k % 7 = 0
union all select k, '$', 'removed' from n where k % 5 = 4 and k % 2 = 1""".replace("k % 7 = 0", "k % 7 = 0 and not (k % 5 = 4 and k % 2 = 1)"))
def nested_diff(spark, sf):
    """Orders with their lines as one nested row, of which every one but some is changed inside or gone."""
    line = F.struct("l_linenumber", F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty"))
    lines = V.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.sort_array(F.collect_list(line)), lambda x: F.struct(x["part"].alias("part"), x["qty"].alias("qty"))).alias("lines"))
    o = V.table(spark, sf, "orders").join(lines, "o_orderkey")
    k = F.col("o_orderkey")
    before = o.select(k.alias("k"), F.struct(F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status")).alias("info"), "lines", F.create_map(F.lit("a"), F.lit(1)).alias("tags"))
    k = F.col("k")
    last = F.size("lines")
    after = before.where(~((k % 5 == 4) & (k % 2 == 1))).select(
        "k", F.struct((F.col("info.price") + F.when(k % 5 == 0, 1).otherwise(0)).alias("price"), F.when(k % 5 != 3, F.col("info.status")).alias("status")).alias("info"),
        F.when(k % 5 == 1, F.slice("lines", F.lit(1), last - 1)).when(k % 5 == 2, F.transform("lines", lambda x, i: F.struct(x["part"].alias("part"), (x["qty"] + F.when(i == 0, 1).otherwise(0)).alias("qty"))))
        .when(k % 5 == 4, F.concat("lines", F.slice("lines", -1, 1))).otherwise(F.col("lines")).alias("lines"),
        F.when(k % 7 == 0, F.create_map(F.lit("b"), F.lit(1))).otherwise(F.col("tags")).alias("tags"))
    return diff.nested_diff(before, after, "k").select("k", "path", "change")


_CHAINED = """i as (select 'm' || o_orderkey as id, o_orderkey as k, 'm' || lag(o_orderkey) over w as prev, 'm' || lead(o_orderkey) over w as nxt from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey))"""


@query("edge_families", f"""with {_CHAINED}, s as (select distinct 's' || l_suppkey as s, 'p' || l_partkey as p from lineitem)
select s as source, p as target, 'ENTITY_RELATION' as type, 'RELATED_TO' as relation from s union all select p, s, 'ENTITY_RELATION', 'RELATED_TO' from s
union all select id, prev, 'TEMPORAL_SUPERSEDES', 'SUPERSEDES' from i where prev is not null union all select id, nxt, 'TEMPORAL_SUPERSEDES', 'SUPERSEDED_BY' from i where nxt is not null union all select id, nxt, 'TEMPORAL_SAME_CHAIN', 'NEXT_VERSION' from i where nxt is not null
union all select id, 'm' || (k - 1), 'DERIVED_FROM', 'DERIVED_FROM' from i where k % 10 = 0 union all select id, 'm' || (k + 2), 'CAUSAL', 'CAUSES' from i where k % 7 = 0 union all select id, 'm' || (k + 3), 'DERIVED_FROM', 'PROVENANCE_RELATED' from i where k % 9 = 0""")
def edge_families(spark, sf):
    """Every family but mentions; self links and missing ends are dropped."""
    i = V.items(spark, sf, False)
    w = windows.Window.partitionBy("chain_id").orderBy("version")
    k, m = F.col("memory_id"), lambda c: F.concat(F.lit("m"), c)
    own = i.select("chain_id", "version", "valid_from", m(k).alias("memory_id"), m(F.lag("memory_id").over(w)).alias("supersedes"), m(F.lead("memory_id").over(w)).alias("superseded_by"), F.when(k % 10 == 0, F.array(m(k - 1), m(k))).otherwise(F.array().cast("array<string>")).alias("derived_from"))
    pair = lambda on, to: i.where(on).select(m(k).alias("source"), m(to).alias("target"))
    rel = V.table(spark, sf, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target")).withColumns({"relation": F.lit("RELATED_TO"), "directed": F.lit(False), "confidence": F.lit(0.9)})
    none = rel.limit(0).select(F.col("source").alias("memory_id"), F.col("target").alias("entity_id"))
    causal = pair(k % 7 == 0, k + 2).withColumns({"relation": F.lit("CAUSES"), "confidence": F.lit(0.9)})
    return graph.build_edges(own, none, rel, causal, pair(k % 9 == 0, k + 3)).select("source", "target", "type", "relation")


@query("relation_merge", """with b as (select l_suppkey as s, l_partkey as p, max(l_linenumber) as line, arg_max(l_returnflag, l_extendedprice) as e, count(distinct l_orderkey) as n from lineitem where l_linenumber % 2 = 0 group by 1, 2), o as (select distinct l_suppkey as s, l_partkey as p from lineitem where l_linenumber = 1)
select 's' || s as source, 'p' || p as target, case when o.s is null then 0.6 + 0.05 * line else greatest(0.75, 0.6 + 0.05 * coalesce(line, 0)) end::decimal(4, 2)::double as confidence, coalesce(e, 'old') as evidence, (coalesce(n, 0) + case when o.s is null then 0 else 1 end)::int as n_memory, b.s is not null as touched
from b full join o using (s, p)""")
def relation_merge(spark, sf):
    """A batch against a store that has some of its relations and others."""
    rows = V.table(spark, sf, "lineitem").select(
        F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"), F.lit("SUPPLIES").alias("relation"), F.round(0.6 + 0.05 * F.col("l_linenumber"), 2).alias("confidence"), F.col("l_returnflag").alias("evidence"),
        F.col("l_orderkey").alias("memory_id"), F.col("l_extendedprice").alias("seq"), "l_linenumber")
    old = rows.where("l_linenumber = 1").select("source", "target", "relation").distinct().withColumns({"confidence": F.lit(0.75), "evidence": F.lit("old"), "memory_ids": F.array(F.lit(-1).cast("long"))})
    return aggregate.upsert_relations(old, rows.where("l_linenumber % 2 = 0"), V.ends(spark, sf)).select("source", "target", "confidence", "evidence", F.size("memory_ids").alias("n_memory"), "touched")


@query("archived_found", """with n as (select p_name as k, min(p_partkey) as id, count(*) as c from part group by 1)
select p_partkey as query_id, case when p_partkey % 2 = 0 then p_partkey else id end as entity_id from part left join n on k = p_name where p_partkey % 2 = 0 or c = 1""")
def archived_found(spark, sf):
    p = V.table(spark, sf, "part")
    q = p.select(F.col("p_partkey").alias("query_id"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey").cast("string")).otherwise(F.upper("p_name")).alias("q"))
    return lookup.find_archived_entity(q, p.select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.array("p_brand").alias("aliases")))


@query("archived_search", """with a as (select p_partkey, p_size, lower(p_name || ' ' || p_brand) as txt from part), q as (select s_suppkey as query_id, case when s_suppkey % 2 = 0 then 'brand#' || (s_suppkey % 5 + 1) else lower(substr(p_name, 2, s_suppkey % 6 + 1)) end as q from supplier join part on p_partkey = s_suppkey),
t as (select q, p_partkey, row_number() over (partition by q order by p_size desc, p_partkey)::int as rank from (select distinct q from q where trim(q) <> '') join a on contains(txt, trim(q)))
select query_id, p_partkey as entity_id, rank from q join t using (q) where rank <= 10""")
def archived_search(spark, sf):
    """Every supplier asks for a brand or for one to six letters from the middle of a name."""
    k = F.col("s_suppkey")
    p = V.table(spark, sf, "part")
    q = V.table(spark, sf, "supplier").join(p, k == F.col("p_partkey")).select(k.alias("query_id"), F.when(k % 2 == 0, F.concat(F.lit("Brand#"), k % 5 + 1)).otherwise(F.upper(F.substring(F.col("p_name"), F.lit(2), (k % 6 + 1).cast("int")))).alias("q"))
    a = p.select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.array("p_brand").alias("aliases"), F.col("p_size").alias("archived_at"))
    return lookup.search_archived_entities(q, a, 10).select("query_id", "entity_id", "rank")


@query("active_relations", "select event_id as relation_id from events where event_type <> 'error'")
def active_relations(spark, sf):
    return lookup.active_relations(V.table(spark, sf, "events").select(F.col("event_id").alias("relation_id"), F.when(F.col("event_type") == "error", "inactive").otherwise("active").alias("status"))).select("relation_id")


@query("operations_by_key", "select e.event_id from events e join (select distinct user_id, props from events where event_id % 50 = 0 and event_type = 'click') q using (user_id, props) where e.event_type = 'click'")
def operations_by_key(spark, sf):
    e = V.table(spark, sf, "events")
    keyed = e.withColumn("operation_key", op_key(e, F.col("event_type"), payload=F.struct("user_id", "props")))
    some = e.where("event_id % 50 = 0 and event_type = 'click'")
    spaced = F.concat(F.lit("  "), F.regexp_replace("props", " ", "  \t"))  # the same payload in another form
    asked = some.select(op_key(some, F.lit(" Click"), payload=F.struct(spaced.alias("props"), "user_id")).alias("operation_key"))
    return ledger.ops_by_key(keyed, asked).select("event_id")


@query("created_attached", "select p_partkey::varchar as conflict_id, case when p_partkey % 3 = 0 then 'new' || p_partkey when p_partkey % 2 = 0 then 'own' else '' end as created_entity_id from part")
def created_attached(spark, sf):
    p, k = V.table(spark, sf, "part"), F.col("p_partkey")
    c = p.select(k.cast("string").alias("conflict_id"), F.when(k % 2 == 0, "own").otherwise("").alias("created_entity_id"))
    return resolve.attach_created(c, p.where(k % 3 == 0).select(k.cast("string").alias("conflict_id"), F.concat(F.lit("new"), k).alias("created_entity_id")))


@query("conflicts_reanalyzed", """with c as (select p_partkey as id, (p_partkey % 100) / 100.0::double as score, ['PERSON', 'SOFTWARE', 'OTHER'][p_partkey % 3 + 1] as ct, ['PERSON', 'SOFTWARE'][p_partkey % 2 + 1] as et, p_partkey % 5 = 0 as same from part)
select id as conflict_id, decision, case when decision = 'SAME' then 'RESOLVED' else 'ACTIVE' end as status from (select id, case when ct <> et and ct <> 'OTHER' then 'DIFFERENT' when same and ct = et and et = 'PERSON' then 'POSSIBLE_CONFLICT'
  when same and score >= 0.68 then 'SAME' when score >= 0.92 then 'SAME' when score >= 0.68 then 'POSSIBLE_CONFLICT' else 'DIFFERENT' end as decision from c)""")
def conflicts_reanalyzed(spark, sf):
    k = F.col("p_partkey")
    c = V.table(spark, sf, "part").select(k.alias("conflict_id"), F.concat(F.lit("name "), k).alias("candidate_name"), _pick(("PERSON", "SOFTWARE", "OTHER"), k).alias("candidate_type"), F.when(k % 5 == 0, F.concat(F.lit("NAME "), k)).otherwise(F.concat(F.lit("else "), k)).alias("entity_name"),
                                          _pick(("PERSON", "SOFTWARE"), k).alias("entity_type"), (k % 100 / 100.0).alias("score"), F.lit("ACTIVE").alias("status"), F.lit("DIFFERENT").alias("decision"))
    return resolve.reanalyze(c).select("conflict_id", "decision", "status")


@query("decision_candidates", f"with {V.VECTORS_SQL} select * from (select query_id, key, round(sim, 4) as sim, row_number() over (partition by query_id order by sim desc, key)::bigint as rank from sims where sim >= 0.75) where rank <= 3")
def decision_candidates(spark, sf):
    v = V.vectors(spark, sf)
    return vector.decision_candidates(V.queries_of(v), v).select("query_id", "key", F.round("sim", 4).alias("sim"), F.col("rank").cast("long").alias("rank"))


@query("approval_bounds", """select event_id, 'APPROVAL_' || case when event_id % 29 = 0 then 'POLICY_VERSION_MISMATCH' when event_id % 31 = 0 then 'CYCLE_KEY_MISMATCH' when event_id % 11 = 0 then 'REQUESTER_REQUIRED' when event_id % 7 = 0 then 'REQUESTER_APPROVAL_FORBIDDEN'
 when event_type not in ('click', 'purchase', 'signup') then 'ROLE_NOT_ALLOWED' when event_id % 5 = 0 then 'REQUESTER_DELEGATION_FORBIDDEN' when event_id % 5 = 1 then 'DELEGATOR_SELF_REFERENCE'
 when event_id % 5 = 2 and event_id % 2 = 0 then 'DELEGATION_REFERENCE_REQUIRED' when event_id % 5 in (3, 4) and event_id % 2 = 1 then 'DELEGATION_REFERENCE_WITHOUT_DELEGATOR' end as code from events""")
def approval_bounds(spark, sf):
    """Events as approvals of their user's plan, with wrong policies, cycles, requesters and delegators planted by their numbers."""
    n, e = F.col("event_id"), V.table(spark, sf, "events")
    actor, asker = F.concat(F.lit("a"), "user_id"), F.concat(F.lit("q"), "user_id")
    bound = [F.lit("f").alias("policy_fingerprint"), F.lit("p").alias("plan_fingerprint"), F.lit("o").alias("previous_id")]
    a = e.select(
        n, F.col("user_id").alias("plan_id"), actor.alias("actor"), F.col("event_type").alias("role"), F.when(n % 11 == 0, " ").when(n % 7 == 0, actor).otherwise(asker).alias("requester"), F.lit(None).cast("string").alias("requester_role"),
        F.when(n % 29 == 0, 1).otherwise(2).alias("policy_version"), *bound, F.when(n % 31 != 0, F.lit("k")).alias("previous_key"),
        F.when(n % 5 == 0, asker).when(n % 5 == 1, actor).when(n % 5 == 2, "d").alias("delegated_by"), F.when(n % 2 == 1, "ref").otherwise("").alias("delegation_reference"))
    plans = e.select(F.col("user_id").alias("plan_id")).distinct().select("plan_id", F.lit(2).alias("policy_version"), *bound, F.lit("k").alias("previous_key"))
    need = approvals.Requirement(need_requester=True, no_requester=True, allowed_roles=("click", "purchase", "signup"), delegation=True, need_reference=True)
    return approvals.bound_to(a, plans, need).select("event_id", "code")
