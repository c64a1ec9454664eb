"""Queries over batches with several changes of one key, each with SQL that applies one change after the other, and over indexes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factweave.operators import changes, context, intervals, leaders, moves, vector_index
from factweave.plans import views as V
from factweave.sources import shared
from factweave.streaming import journal, stateful

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


_STEPS = "steps as (select unnest(range(1, 4)) as i)"

_SCD2 = f"""with recursive {V.ITEMS_SQL}, {_STEPS},
bt as (select c_custkey as k, i, case i when 1 then case k % 3 when 0 then timestamp '2001-08-02' when 1 then timestamp '1997-06-01' else timestamp '1990-01-01' end
    when 2 then timestamp '2001-08-02' + to_days((k % 5 * 30 - case when k % 4 = 0 then 400 else 0 end)::int) else timestamp '2001-09-01' + to_days(((k % 7 - 3) * 20)::int) end as eff,
  case when i = 3 and k % 6 = 0 then -(k * 10 + 1) when i = 3 and k % 11 = 0 and low is not null then low else -(k * 10 + i) end as new_id, case when i = 3 and k % 10 = 3 then '' else 'text ' || i end as memory from steps, customer left join (select chain_id, min(memory_id) as low from items group by 1) on chain_id = c_custkey),
f as (select bt.*, case when memory = '' then 'BLANK' when exists (select 1 from items where chain_id = bt.k and memory_id = new_id) then 'KNOWN_ID' when exists (select 1 from bt o where o.new_id = bt.new_id and o.k * 10 + o.i < bt.k * 10 + bt.i) then 'REPEATED' end as refused from bt),
cur as (select chain_id, memory_id, version, valid_from from items where valid_to is null),
r as (select c_custkey as k, 0 as i, memory_id as cur_id, version as ver, valid_from as start, null::varchar as outcome, null::bigint as was from customer left join cur on chain_id = c_custkey
  union all select k, i, case when outcome = 'SUPERSEDED' then new_id else cur_id end, case when outcome = 'SUPERSEDED' then ver + 1 else ver end, case when outcome = 'SUPERSEDED' then eff else start end, outcome, cur_id
  from (select r.k, f.i, r.cur_id, r.ver, r.start, f.new_id, f.eff, coalesce(f.refused, case when r.cur_id is null then 'NO_CURRENT' when f.eff < r.start then 'TOO_EARLY' else 'SUPERSEDED' end) as outcome from r join f on f.k = r.k and f.i = r.i + 1)),
done as (select r.k, r.i, outcome, was, ver, f.new_id, eff from r join f using (k, i))"""


def _changes(spark, sf):
    """Three changes a customer: some too early, some of a chain without versions, with a repeated or a known id or without a text."""
    k, i = F.col("k"), F.col("i")
    days = lambda n: F.make_dt_interval(days=n.cast("int"))
    low = V.items(spark, sf, False).groupBy(F.col("chain_id").alias("c_custkey")).agg(F.min("memory_id").alias("low"))
    rows = V.table(spark, sf, "customer").join(low, "c_custkey", "left").select(F.col("c_custkey").alias("k"), "low", F.explode(F.array(*[F.lit(n) for n in (1, 2, 3)])).alias("i"))
    eff = (F.when(i == 1, F.when(k % 3 == 0, V.now()).when(k % 3 == 1, V.now("1997-06-01")).otherwise(V.now("1990-01-01")))
           .when(i == 2, V.now() + days(k % 5 * 30 - F.when(k % 4 == 0, 400).otherwise(0))).otherwise(V.now("2001-09-01") + days((k % 7 - 3) * 20)))
    new_id = F.when((i == 3) & (k % 6 == 0), -(k * 10 + 1)).when((i == 3) & (k % 11 == 0) & F.col("low").isNotNull(), F.col("low")).otherwise(-(k * 10 + i))
    return rows.select((k * 10 + i).alias("ord"), k.alias("chain_id"), new_id.alias("new_id"), F.when((i == 3) & (k % 10 == 3), " ").otherwise(F.concat(F.lit("text "), i)).alias("memory"), eff.alias("effective_from"))


def _superseded(spark, sf):
    items = V.items(spark, sf, False).withColumns({"superseded_by": F.lit(None).cast("long"), "supersedes": F.lit(None).cast("long"), "memory": F.lit("x")})
    return changes.supersede(items, _changes(spark, sf))


@query("scd2_batch", f"""{_SCD2}, good as (select *, lead(eff) over w as until, lead(new_id) over w as by_id, row_number() over w as n from done where outcome = 'SUPERSEDED' window w as (partition by k order by i))
select memory_id, chain_id, version, epoch_us(valid_from) as valid_from, epoch_us(coalesce(g.eff, valid_to)) as valid_to, null::bigint as supersedes, g.new_id as superseded_by from items left join (select * from good where n = 1) g on g.was = memory_id
union all select new_id, k, ver, epoch_us(eff), epoch_us(until), was, by_id from good""")
def scd2_batch(spark, sf):
    return _superseded(spark, sf)[0].select("memory_id", "chain_id", "version", F.unix_micros("valid_from").alias("valid_from"), F.unix_micros("valid_to").alias("valid_to"), "supersedes", "superseded_by")


@query("scd2_outcomes", f"{_SCD2} select k as chain_id, k * 10 + i as ord, outcome from done")
def scd2_outcomes(spark, sf):
    return _superseded(spark, sf)[1].select("chain_id", "ord", "outcome")


_ENDS = f"""with recursive {V.ITEMS_SQL}, {_STEPS},
bt as (select o_orderkey + case when o_orderkey % 13 = 0 then 1000000000 else 0 end as memory_id, o_orderkey * 10 + i as ord, i, o_orderdate::timestamp + to_days(case i when 1 then (o_orderkey % 3)::int - 1 when 2 then (o_orderkey % 4)::int else 9 end) as ended_at
  from orders, steps where o_orderkey % 4 <> 1),
r as (select memory_id, 0 as i, valid_from, null::timestamp as ended, null::varchar as outcome from items
  union all select r.memory_id, bt.i, valid_from, case when ended is null and ended_at > valid_from then ended_at else ended end, case when ended_at <= valid_from then 'NOT_AFTER_START' when ended is null then 'ENDED' else 'ALREADY_ENDED' end
  from r join bt on bt.memory_id = r.memory_id and bt.i = r.i + 1)"""


def _ended(spark, sf):
    """Three ends for most items: some before the start, some for ids that there are not."""
    k, i = F.col("memory_id"), F.col("i")
    items = V.items(spark, sf, False).withColumns({"temporal_status": F.lit("current"), "status": F.lit("active")})
    rows = items.where(k % 4 != 1).select(k, "valid_from", F.explode(F.array(*[F.lit(n) for n in (1, 2, 3)])).alias("i"))
    after = F.when(i == 1, k % 3 - 1).when(i == 2, k % 4).otherwise(9).cast("int")
    batch = rows.select((k + F.when(k % 13 == 0, 1_000_000_000).otherwise(0)).alias("memory_id"), (k * 10 + i).alias("ord"), (F.col("valid_from") + F.make_dt_interval(days=after)).alias("ended_at"))
    return changes.end_and_archive(items, items.limit(0), batch, V.now())


@query("end_batch", f"""{_ENDS}, e as (select memory_id, max(ended) as ended from r group by 1) select memory_id, case when ended is null then 'active' else 'archived' end as status, epoch_us(coalesce(ended, valid_to)) as valid_to,
  case when ended is null then 'current' else 'ended' end as temporal_status from items join e using (memory_id)""")
def end_batch(spark, sf):
    active, archive, _ = _ended(spark, sf)
    return active.unionByName(archive, allowMissingColumns=True).select("memory_id", "status", F.unix_micros("valid_to").alias("valid_to"), "temporal_status")


@query("end_outcomes", f"{_ENDS} select bt.memory_id, bt.ord, coalesce(r.outcome, 'NOT_FOUND') as outcome from bt left join r on r.memory_id = bt.memory_id and r.i = bt.i")
def end_outcomes(spark, sf):
    return _ended(spark, sf)[2].select("memory_id", "ord", "outcome")


_ENTITY_RUN = f"""with recursive {_STEPS}, bt as (select p_partkey as k, i, case when i = 3 and k % 3 = 0 then 'END' else 'CHANGE' end as event,
  case when i = 1 then p_name || ' new' when i = 2 then upper(p_name || ' new') when k % 3 = 1 then p_name when k % 3 = 2 then 'thing ' || k end as new_name, case i when 1 then 'SOFTWARE' when 2 then 'OTHER' else 'PLACE' end as kind,
  timestamp '2001-08-02' + to_days(i::int) as eff from part, steps),
r as (select p_partkey as k, 0 as i, p_name as name, 'PRODUCT' as type, 1 as version, [p_brand] as aliases, timestamp '2000-01-01' as valid_from, null::timestamp as valid_to, []::varchar[] as history from part
  union all select r.k, bt.i, case when event = 'CHANGE' and lower(new_name) <> lower(name) then new_name else name end, case when event = 'CHANGE' and kind <> 'OTHER' then kind else type end, version + 1,
    case when event = 'CHANGE' and lower(new_name) <> lower(name) then list_filter(list_append(aliases, name), lambda x: lower(x) <> lower(new_name)) else aliases end, eff, case when event = 'END' then eff end,
    list_append(history, version || ':' || name || ':' || type || ':' || epoch_us(valid_from) || ':' || epoch_us(eff)) from r join bt on bt.k = r.k and bt.i = r.i + 1)"""


def _evolved(spark, sf):
    """Three changes of every part: renamed, renamed to other letters only, then ended, renamed back or renamed again."""
    k, i, none = F.col("p_partkey"), F.col("i"), F.lit(None).cast("timestamp")
    p = V.table(spark, sf, "part")
    empty = F.array().cast("array<struct<snapshot:struct<version:int,name:string,type:string,valid_from:timestamp,valid_to:timestamp>,event:string>>")
    e = p.select(k.alias("entity_id"), F.col("p_name").alias("name"), F.lit(1).alias("version"), empty.alias("history"), F.array("p_brand").alias("aliases"), F.lit("PRODUCT").alias("type"), V.now("2000-01-01").alias("valid_from"), none.alias("valid_to"))
    b = p.select(k, "p_name", F.explode(F.array(*[F.lit(n) for n in (1, 2, 3)])).alias("i"))
    new = F.concat("p_name", F.lit(" new"))
    b = b.select(k.alias("entity_id"), i.alias("ord"), F.when((i == 3) & (k % 3 == 0), "end").when(i == 2, None).otherwise("Change").alias("action"),
                 F.when(i == 1, new).when(i == 2, F.upper(new)).when(k % 3 == 1, F.col("p_name")).when(k % 3 == 2, F.concat(F.lit("thing "), k)).alias("new_name"),
                 F.when(i == 1, "software").when(i == 2, "odd").otherwise("PLACE").alias("new_type"), (V.now() + F.make_dt_interval(days=i)).alias("effective"))
    return changes.evolve_entities(e, b)[0]


@query("entity_changes", f"""{_ENTITY_RUN}
select k as entity_id, name, type, version::int as version, array_to_string(aliases, '|') as aliases, epoch_us(valid_from) as valid_from, epoch_us(valid_to) as valid_to, array_to_string(history, '|') as history from r where i = 3""")
def entity_changes(spark, sf):
    said = lambda h: F.concat_ws(":", h["snapshot"]["version"], h["snapshot"]["name"], h["snapshot"]["type"], F.unix_micros(h["snapshot"]["valid_from"]), F.unix_micros(h["snapshot"]["valid_to"]))
    return _evolved(spark, sf).select("entity_id", "name", "type", "version", F.array_join("aliases", "|").alias("aliases"), F.unix_micros("valid_from").alias("valid_from"), F.unix_micros("valid_to").alias("valid_to"), F.array_join(F.transform("history", said), "|").alias("history"))


@query("entity_asof", f"""{_ENTITY_RUN}, h as (select k, version, name, type, valid_from, lead(valid_from) over (partition by k order by i) as valid_to, valid_to as own_to, i from r),
t as (select distinct p_partkey as k, unnest([timestamp '2000-06-01', timestamp '2001-08-03', timestamp '2001-08-04' + to_hours((p_partkey % 30)::int), timestamp '2001-08-05' + to_minutes((p_partkey % 2)::int), timestamp '2009-01-01', timestamp '1999-01-01']) as instant from part),
m as (select t.k, instant, version, name, type, i = 3 as current from t join h on h.k = t.k and valid_from <= instant and (coalesce(valid_to, own_to) is null or instant <= coalesce(valid_to, own_to)))
select k as entity_id, epoch_us(instant) as instant, max(version)::bigint as version, arg_max(name, version) as name, arg_max(type, version) as type, arg_max(current, version) as current, count(*) as n_matches from m group by k, instant""")
def entity_asof(spark, sf):
    """What every entity was at six times, among them the times of its changes, where two versions hold."""
    k = F.col("p_partkey")
    day = lambda text: V.now(text)
    times = F.array(day("2000-06-01"), day("2001-08-03"), day("2001-08-04") + F.make_dt_interval(hours=(k % 30).cast("int")), day("2001-08-05") + F.make_dt_interval(mins=(k % 2).cast("int")), day("2009-01-01"), day("1999-01-01"))
    asked = V.table(spark, sf, "part").select(k.alias("entity_id"), F.explode(times).alias("instant"))
    return intervals.entity_as_of(_evolved(spark, sf), asked).withColumn("instant", F.unix_micros("instant"))


_ALL_PAIRS = """with p as (select a.vec_id as query_id, b.vec_id as key, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as sim from embeddings a, embeddings b where b.vec_id % 5 <> 0)"""


def _index(spark, sf):
    """An index of two thirds of the rows to which the rest is appended."""
    v = V.vectors(spark, sf).where("active").select("key", "vector")
    return vector_index.build(v.where("key % 3 <> 0")).append(v.where("key % 3 = 0"))


@query("vec_index_exact", f"{_ALL_PAIRS} select * from (select query_id, key, round(sim, 4) as sim, row_number() over (partition by query_id order by sim desc, key) as rank from p where sim >= 0.2) where rank <= 5")
def vec_index_exact(spark, sf):
    """The best five facts for every vector, by lists read as far as the result needs."""
    asked = V.vectors(spark, sf).select(F.col("key").alias("query_id"), "vector")
    return vector_index.search(_index(spark, sf), asked, 5, 0.2, exact=True).select("query_id", "key", F.round("sim", 4).alias("sim"), F.col("rank").cast("long").alias("rank"))


@query("vec_index_probe")
def vec_index_probe(spark, sf):
    """The same from the nearest lists only, as many as a recall of .95 takes on a sample of queries; the test measures the recall of all."""
    asked, index = V.vectors(spark, sf).select(F.col("key").alias("query_id"), "vector"), _index(spark, sf)
    return vector_index.search(index, asked, 5, 0.2, probes=vector_index.probes_for(index, asked, 5, 0.2)).select("query_id", "key", F.round("sim", 4).alias("sim"), F.col("rank").cast("long").alias("rank"))


@query("lease_fold", """with recursive e as (select user_id || ':' || (event_id % 3) as k, epoch_us(ts::timestamp) as at_us, case event_type when 'click' then 'HEARTBEAT' when 'purchase' then 'COMPLETE' when 'error' then 'FAIL' else 'BEGIN' end as kind from events),
o as (select *, row_number() over (partition by k order by at_us, kind) as i from e), lim as (select 43200000000 as lease),
r as (select distinct k, 0::bigint as i, null::varchar as status, null::bigint as until, 0 as attempts, 0 as recoveries, null::bigint as at_us, null::varchar as kind, null::varchar as outcome from e
  union all select k, i, case outcome when 'LIMIT' then 'FAILED' when 'ENDED' then case kind when 'COMPLETE' then 'COMPLETED' else 'FAILED' end when 'CLAIMED' then 'STARTED' else status end,
    case when outcome in ('LIMIT', 'ENDED') then null when outcome in ('CLAIMED', 'RECLAIMED', 'EXTENDED') then at_us + lease else until end, attempts + case when outcome in ('CLAIMED', 'RECLAIMED') then 1 else 0 end,
    recoveries + case when outcome = 'RECLAIMED' then 1 else 0 end, at_us, kind, outcome
  from (select r.k, o.i, r.status, r.until, r.attempts, r.recoveries, o.at_us, o.kind, lease,
      case when r.status is null then case when o.kind = 'BEGIN' then 'CLAIMED' else 'IGNORED' end
        when o.kind = 'BEGIN' then case when r.status <> 'STARTED' or r.until > o.at_us then 'REFUSED' when r.recoveries >= 3 then 'LIMIT' else 'RECLAIMED' end
        when o.kind = 'HEARTBEAT' then case when r.status = 'STARTED' then 'EXTENDED' else 'IGNORED' end else 'ENDED' end as outcome from r join o on o.k = r.k and o.i = r.i + 1, lim))
select k as operation_key, at_us, kind, outcome, status, attempts as attempt_count, recoveries as recovery_count from r where i > 0""")
def lease_fold(spark, sf):
    """Each user's events, dealt out to three operations, as claims, heartbeats and ends with a lease of twelve hours."""
    t = F.col("event_type")
    kind = F.when(t == "click", "HEARTBEAT").when(t == "purchase", "COMPLETE").when(t == "error", "FAIL").otherwise("BEGIN")
    e = V.table(spark, sf, "events").select(F.concat_ws(":", "user_id", F.col("event_id") % 3).alias("operation_key"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"))
    return stateful.lease_batch(e, 43200).select("operation_key", F.unix_micros("ts").alias("at_us"), "kind", "outcome", "status", "attempt_count", "recovery_count")


@query("batch_near", """with recursive e as (select vec_id as ord, embedding::double[] as v, vec_id % 40 = 3 as forced from embeddings),
p as materialized (select b.ord as later, a.ord as earlier from e a, e b where a.ord < b.ord and list_cosine_similarity(a.v, b.v) >= 0.4), o as (select *, row_number() over (order by ord) as i from e),
r as (select 0::bigint as i, []::bigint[] as kept, null::bigint as ord, false as drops
  union all select o.i, case when forced or not exists (select 1 from p where later = o.ord and list_contains(kept, earlier)) then list_append(kept, o.ord) else kept end, o.ord,
    not forced and exists (select 1 from p where later = o.ord and list_contains(kept, earlier)) from r join o on o.i = r.i + 1)
select ord from r where drops""")
def batch_near(spark, sf):
    """Vectors as a batch in the order of their ids, some of them restored and so kept: those near an earlier one that stays."""
    rows = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("ord"), F.col("embedding").alias("vector"), (F.col("vec_id") % 40 == 3).alias("forced"))
    return leaders.near_earlier(rows, shared.folder(spark, "batch-near"), 0.4)


@query("journal_states", """with j as (select event_id + 1 as sequence, user_id as key, event_type as value from events), n as (select max(sequence) as head from j), s as (select unnest([head - 300, head - 150, head]) as at_sequence from n)
select at_sequence, key, arg_max(value, sequence) as value, max(sequence) as sequence from j join s on sequence <= at_sequence group by 1, 2""")
def journal_states(spark, sf):
    """The state at the checkpoint, inside the tail and at the head, from a journal of events that was compacted twice."""
    rows = V.table(spark, sf, "events").select((F.col("event_id") + 1).alias("sequence"), F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.lit(None).cast("string").alias("previous_record_hash"))
    rows = journal.record_hash(rows)
    head = rows.agg(F.max("sequence")).first()[0]
    meta, state, tail = journal.compacted(rows, 500)
    meta, state, tail = journal.compacted(tail, 300, (meta, state))
    out = None
    for at in (head - 300, head - 150, head):
        one = journal.state_at(meta, state, tail, at)[1].select(F.lit(at).cast("long").alias("at_sequence"), "key", "value", "sequence")
        out = one if out is None else out.unionByName(one)
    return out


_CONTEXT = f"""with {V.ITEMS_SQL}, ev as (select distinct user_id % (select max(o_orderkey) from orders) as q from events), hits as (select q as query_id, memory_id, row_number() over (partition by q order by importance desc, memory_id) as rank from ev join items on chain_id = q % (select max(c_custkey) from customer)),
h as (select * from hits where rank <= 8), nxt as (select memory_id, lead(memory_id) over w as n1, lag(memory_id) over w as n2 from items window w as (partition by chain_id order by version)),
nb as (select memory_id as id, unnest([n1, n2]) as neighbor, unnest(['NEXT_VERSION', 'PREVIOUS_VERSION']) as relation, unnest([0, 1]) as dir from nxt),"""


@query("graph_context", f"""{_CONTEXT} g as (select query_id, rank, relation, neighbor, row_number() over (partition by query_id, rank order by dir, relation, neighbor) as place from h join nb on id = memory_id where rank <= 3 and neighbor is not null),
f as (select query_id, neighbor, relation, rank, place, row_number() over (partition by query_id, neighbor order by rank, place) as seen from g where place <= 5),
e as (select query_id, l_partkey as entity, min(rank) as rank from h join lineitem on l_orderkey = memory_id where rank <= 5 group by 1, 2),
gl as (select query_id, string_agg('- ' || relation || ': fact ' || neighbor, chr(10) order by rank, place) as graph from f where seen = 1 group by 1), el as (select query_id, string_agg('- part ' || entity || ' (PRODUCT)', chr(10) order by rank, entity) as entities from e group by 1)
select q.query_id, coalesce(graph, 'No graph-related memories found.') as graph, coalesce(entities, 'No known entities connected.') as entities from (select distinct query_id from h) q left join gl using (query_id) left join el using (query_id)""")
def graph_context(spark, sf):
    """For each user the neighbours of the first three hits and the entities of the first five, as text."""
    items, hits, edges = _context(spark, sf)
    mentions = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("memory_id"), F.col("l_partkey").alias("entity_id")).distinct()
    named = mentions.select("memory_id", "entity_id", F.concat(F.lit("part "), "entity_id").alias("name"), F.lit("PRODUCT").alias("type"))
    return context.graph_context(hits, edges, items.select("memory_id", F.concat(F.lit("fact "), "memory_id").alias("memory")), named)


def _context(spark, sf):
    items = V.items(spark, sf, False)
    most, last = V.table(spark, sf, "orders").agg(F.max("o_orderkey")).first()[0], V.table(spark, sf, "customer").agg(F.max("c_custkey")).first()[0]
    asked = V.table(spark, sf, "events").select((F.col("user_id") % most).alias("query_id")).distinct()
    w = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("importance").desc(), "memory_id"))
    hits = asked.join(items, F.col("chain_id") == F.col("query_id") % last).select("query_id", "memory_id", "importance", w.alias("rank")).where("rank <= 8")
    v = Window.partitionBy("chain_id").orderBy("version")
    near = items.select("memory_id", F.lead("memory_id").over(v).alias("after"), F.lag("memory_id").over(v).alias("before"))
    one = lambda c, relation, place: F.struct(F.col(c).alias("n"), F.lit(relation).alias("relation"), F.lit(place).alias("dir"))
    both = near.select("memory_id", F.explode(F.array(one("after", "NEXT_VERSION", 0), one("before", "PREVIOUS_VERSION", 1))).alias("e"))
    return items, hits, both.select("memory_id", F.col("e.n").alias("neighbor"), "e.relation", "e.dir").where("neighbor is not null")


@query("causal_candidates", f"""with {V.VECTORS_SQL}, a as (select query_id, key, sim, row_number() over (partition by query_id order by sim desc, key) as r1 from sims where active and sim >= 0.35), b as (select query_id, key, sim, row_number() over (partition by query_id order by sim desc, key) as r2 from sims where active and sim >= 0.2),
c as (select query_id, key, sim, 0 as tier from a where r1 <= 3 union all select query_id, key, sim, 1 from b where r2 <= 12 union all select query_id, key, 0.0, 2 from q, vecs where active),
d as (select query_id, key, arg_min(sim, tier) as sim, min(tier) as tier from c group by 1, 2)
select query_id, key, round(sim, 4)::double as sim, tier from (select *, row_number() over (partition by query_id order by tier, sim desc, key) as r from d) where r <= 12""")
def causal_candidates(spark, sf):
    """Recall, then the broad search, then other facts at similarity 0, twelve for each query."""
    v = V.vectors(spark, sf).where("active")
    return context.causal_candidates(V.queries_of(V.vectors(spark, sf)), v, recall=3).select("query_id", "key", F.round("sim", 4).alias("sim"), "tier")


@query("token_budget", r"""with t as (select *, len(string_split(text, ' '))::bigint as cost, row_number() over (partition by conv_id, role = 'system' order by turn desc) as r from conversations)
select conv_id, sum(cost)::bigint as used_before, sum(case when role = 'system' or r <= 4 then cost else 0 end)::bigint as used_after, (200 - sum(case when role = 'system' or r <= 4 then cost else 0 end))::bigint as remaining,
  sum(cost) <= 200 as fits_before, sum(case when role = 'system' or r <= 4 then cost else 0 end) <= 200 as fits_after from t group by 1""")
def token_budget(spark, sf):
    t = V.table(spark, sf, "conversations").withColumn("cost", F.size(F.split("text", " ")))
    return context.token_budget(t, "cost", 200)


_AGES = f"""with {V.ENTITIES_SQL}, x as (select *, (epoch_us(timestamp '{V.NOW_ORDERS}') - epoch_us(last_seen)) / 86400000000.0::double as d from ents),
life as (select entity_id, case when ended then 'ENDED' when d is null then 'DORMANT' when greatest(d, 0) <= 30 then 'ACTIVE' when greatest(d, 0) <= 90 then 'AGING' else 'DORMANT' end as lifecycle from x)"""


@query("entity_archive", f"{_AGES} select entity_id, case when lifecycle in ('DORMANT', 'ENDED') then 'archive' else 'active' end as store, case when lifecycle in ('DORMANT', 'ENDED') then lifecycle end as before from life")
def entity_archive(spark, sf):
    """All entities whose lifecycle is over move to the archive and keep the state they had."""
    e = V.entities(spark, sf)
    active, archive, _ = moves.archive_entities(e, e.limit(0), V.now())
    return active.select("entity_id", F.lit("active").alias("store"), F.lit(None).cast("string").alias("before")).unionByName(archive.select("entity_id", F.lit("archive").alias("store"), F.col("pre_archive_lifecycle").alias("before")))


@query("entity_archive_outcomes", f"""{_AGES}, n as (select p_name as k, min(p_partkey) as id, count(*) as c from part group by 1),
q as (select p_partkey as query_id, case when p_partkey % 3 = 0 then p_partkey when p_partkey % 3 = 1 and c = 1 then id end as entity_id from part join n on k = p_name)
select query_id, q.entity_id, case when q.entity_id is null then 'NOT_FOUND' when lifecycle in ('DORMANT', 'ENDED') then 'ARCHIVED' else 'NOT_ARCHIVABLE' end as outcome from q left join life using (entity_id)""")
def entity_archive_outcomes(spark, sf):
    """A request for every entity: by id, by name (found where only one bears it) or by a name there is not."""
    e, k = V.entities(spark, sf), F.col("p_partkey")
    q = V.table(spark, sf, "part").select(k.alias("query_id"), F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.upper("p_name")).otherwise(F.concat(F.lit("no such "), k)).alias("q"))
    return moves.archive_entities(e, e.limit(0), V.now(), q)[2]


@query("recover_moves", f"""with {V.VECTORS_SQL}, best as (select query_id, max(sim) as best from sims where active group by 1),
c as (select query_id, key, round(0.6 * sim + 0.25 * importance / 5 + 0.15 * {V.REINF_SQL} - least(0.2, days / 3650.0::double), 4) as score from sims join best using (query_id) where best < 0.7 and not active and sim >= 0.55),
f as (select key from (select *, row_number() over (partition by query_id order by score desc, key) as r from c where score >= 0.62) where r = 1) select key, case when active or key in (select key from f) then 'active' else 'archive' end as store from vecs""")
def recover_moves(spark, sf):
    v = V.vectors(spark, sf)
    active, archive, _ = moves.recover_items(V.queries_of(v), v.where("active"), v.where("not active"), V.now(V.NOW_EVENTS))
    return active.select("key", F.lit("active").alias("store")).unionByName(archive.select("key", F.lit("archive").alias("store")))


@query("causality_both", f"""with {V.ITEMS_SQL}, l as (select memory_id as s, unnest([memory_id - 1, memory_id + 3]) as t, unnest(['CAUSES', 'ENABLES']) as relation, unnest([0.9, 0.7])::double as confidence, unnest([valid_from, valid_from + interval 1 day]) as link_at from items where memory_id % 3 = 0),
cl as (select s as memory_id, 'out' as dir, relation, t as other, case when i.memory_id is null then '[missing]' else 'fact ' || t end as text, l.confidence, link_at from l left join items i on i.memory_id = t
  union all select t, 'in', relation, s, 'fact ' || s, confidence, link_at from l)
select memory_id, dir, relation, other, text, confidence, epoch_us(link_at) as link_at, row_number() over (partition by memory_id order by link_at, dir, relation, other)::int as place from cl where memory_id in (select memory_id from items where memory_id % 2 = 0)""")
def causality_both(spark, sf):
    """Causes and effects of every other fact, some of them unknown."""
    i, k = V.items(spark, sf, False), F.col("memory_id")
    link = lambda n, relation, sure, at: F.struct((k + n).alias("target_memory_id"), F.lit(relation).alias("relation"), F.lit(sure).alias("confidence"), at.alias("timestamp"))
    links = F.array(link(-1, "causes", 0.9, F.col("valid_from")), link(3, "enables", 0.7, F.col("valid_from") + F.expr("interval 1 day")))
    rows = i.select(k, F.concat(F.lit("fact "), k).alias("memory"), F.when(k % 3 == 0, links).alias("causal_links"))
    return moves.causality(rows, rows.where(k % 2 == 0)).select("memory_id", "dir", "relation", "other", "text", "confidence", F.unix_micros("at").alias("link_at"), "place")
